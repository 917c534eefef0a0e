"""Ant-style path globs as anchored regexes, and the named pattern profiles.

Semantics: ``**`` spans any number of whole segments, including none;
``*`` stays within one segment; ``?`` is one character other than ``/``;
the match covers the whole path and is case-sensitive. So ``*.*`` only hits
root-level names, ``WEB-INF/lib/**`` is anchored at the root and
``**/package.html`` also matches ``package.html`` at the root.

The translation runs once on the driver per pattern (tens of patterns); the
resulting literal regex is evaluated by ``rlike`` in codegen, compiled once
per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import ColumnOrName, _c

# ---------------------------------------------------------------------------
# The reference's include/exclude sets, by profile name.
PROFILES: dict[str, dict[str, tuple[str, ...]]] = {
    "package_classes": {
        "include": ("**/**",),
        "exclude": ("**/package.html", "**/fr/paris/lutece/**/resources/**"),
    },
    "package_webapp": {
        "include": ("**/**",),
        "exclude": ("**/WEB-INF/classes/**", "WEB-INF/lib/**", "**/.svn/**"),
    },
    "package_site": {
        "include": ("**/user/**",),
        "exclude": ("**/.svn/**",),
    },
    "package_resources": {
        "include": ("**/resources/**",),
        "exclude": ("**/fr/paris/lutece/**/business/**", "**/fr/paris/lutece/**/web/**",
                    "**/fr/paris/lutece/**/service/**", "**/fr/paris/lutece/**/utils/**",
                    "**/fr/paris/lutece/**/util/**", "**/WEB-INF/test/**", "**/package.html",
                    "**/.svn/**"),
    },
    "assembly_webapp": {
        "include": ("**/**",),
        "exclude": ("**/WEB-INF/classes/**", "WEB-INF/lib/**", "**/.svn/**"),
    },
    "assembly_site": {
        "include": ("**/user/**",),
        "exclude": ("**/.svn/**",),
    },
    "updater": {
        "include": ("**/**",),
        "exclude": ("**/WEB-INF/classes/**", "WEB-INF/lib/**", "**/.svn/**", "**/target/**",
                    "**/src/**", "**/.settings/**", "*.*"),
    },
    "release": {
        "include": ("**/create*.sql", "**/init*.sql"),
        "exclude": ("**/.svn/**",),
    },
    "source_src": {
        "include": ("**/src/**",),
        "exclude": ("**/.svn/**", "**/target/**", "**/webapp/**"),
    },
    "source_webapp": {
        "include": ("**/webapp/**",),
        "exclude": ("**/.svn/**", "**/WEB-INF/classes/**"),
    },
}
# The site assembly takes the whole tree but for what the resources leave out.
PROFILES["assembly_site_tree"] = {"include": ("**/**",), "exclude": PROFILES["package_resources"]["exclude"]}
# ---------------------------------------------------------------------------


def _segment_regex(seg: str) -> str:
    out = []
    for ch in seg:
        if ch == "*":
            if not out or out[-1] != "[^/]*":   # "a**b" inside a segment is "a*b"
                out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        else:
            out.append("\\" + ch if ch in r"\.[]{}()+^$|" else ch)
    return "".join(out)


def glob_to_regex(glob: str) -> str:
    """Translate one Ant glob to an anchored regex over ``"/" + path``.

    Matching against the path with a leading slash lets every piece carry its
    own separator: a segment is ``/seg``, and ``**`` is ``(?:/[^/]*)*``, zero
    or more whole segments. So ``a/**/**`` matches ``a``, ``**/x`` matches
    ``x`` and ``a/**`` matches ``a`` and everything below it. The result is a
    valid JVM regex and RE2 (the oracle's dialect).
    """
    parts = []
    glob = glob + "**" if glob.endswith("/") else glob   # a directory: everything below it
    for seg in glob.strip("/").split("/"):
        parts.append("(?:/[^/]*)*" if seg == "**" else "/" + _segment_regex(seg))
    return "^" + "".join(parts) + "$"


def globs_column_regex(glob: ColumnOrName) -> Column:
    """``glob_to_regex`` for globs that are rows: the same regex, as a column."""
    g = _c(glob)
    whole = F.when(g.endswith("/"), F.concat(g, F.lit("**"))).otherwise(g)
    special = F.lit(r"([\\.\[\]{}()+^$|])")

    def piece(seg: Column) -> Column:
        plain = F.regexp_replace(seg, special, F.lit(r"\\$1"))
        stars = F.regexp_replace(plain, F.lit(r"\*+"), F.lit("[^/]*"))
        return F.when(seg == "**", F.lit("(?:/[^/]*)*")).otherwise(F.concat(F.lit("/"), F.replace(stars, F.lit("?"), F.lit("[^/]"))))

    segs = F.split(F.regexp_replace(whole, "^/+|/+$", ""), "/")
    return F.concat(F.lit("^"), F.array_join(F.transform(segs, piece), ""), F.lit("$"))


def globs_regex(globs: Sequence[str]) -> str | None:
    """One alternation for a set of globs: a single ``rlike`` per row."""
    if not globs:
        return None
    return "(?s)(?:" + "|".join(glob_to_regex(g) for g in globs) + ")"


def glob_match(path: ColumnOrName, globs: Sequence[str]) -> Column:
    """True when the path matches any of the globs (false for none)."""
    rx = globs_regex(globs)
    if rx is None:
        return F.lit(False)
    return F.coalesce(F.concat(F.lit("/"), _c(path)).rlike(rx), F.lit(False))


def selected(path: ColumnOrName, includes: Sequence[str] | None, excludes: Sequence[str] | None) -> Column:
    """Matches an include (all paths when none given) and no exclude."""
    inc = F.lit(True) if not includes else glob_match(path, includes)
    exc = F.lit(False) if not excludes else glob_match(path, excludes)
    return inc & ~exc


def pattern_profile(name: str) -> dict[str, tuple[str, ...]]:
    """The named include/exclude sets."""
    try:
        return PROFILES[name]
    except KeyError:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}") from None
