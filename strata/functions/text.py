"""Column functions over script text, lines and paths.

All are built-in expressions (regex, string, higher-order array functions),
so they stay inside whole-stage codegen; no Python runs per row.
Spark's regex engine is the JVM's, so the patterns below mean what they
mean in a JVM build tool: ``\\b`` is Unicode-aware, ``(?m)^`` also matches
after ``\\r``, case-insensitivity is ASCII-only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# ---------------------------------------------------------------------------
# These must equal the reference build tool's for equal results.
# SQL order keywords (whole word, case-insensitive, comments included):
SQL_ORDER_KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE",
                      "ALTER", "DROP", "TRUNCATE", "GRANT", "REVOKE")
# The two accepted spellings of the script header (case-sensitive prefix):
TAG_HEADER = "-- liquibase formatted sql"
TAG_HEADER_COMPACT = "--liquibase formatted sql"
# Header lines 2 and 3 written when a script is tagged:
CHANGESET_PREFIX = "-- changeset "
PRECONDITIONS_LINE = "-- preconditions onFail:MARK_RAN onError:WARN"
# Comment words that must be followed by a space after "--":
COMPACT_COMMENT_WORDS = ("liquibase formatted sql", "changeset", "preconditions")
# Script actions, in decision order:
IGNORED, TAGGED, FIXED, UNCHANGED = "IGNORED", "TAGGED", "FIXED", "UNCHANGED"
# ---------------------------------------------------------------------------

# A line ends at \r\n, \n or \r.
LINE_BREAK = "\r\n|\n|\r"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rx_lit(s: str) -> str:
    """Quote a literal for a JVM regex."""
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r"\.[]{}()*+?^$|" else ch)
    return "".join(out)


def keyword_regex(keywords: Sequence[str] = SQL_ORDER_KEYWORDS) -> str:
    return "(?i)\\b(" + "|".join(_rx_lit(k) for k in keywords) + ")\\b"


def has_sql_orders(c: ColumnOrName, keywords: Sequence[str] = SQL_ORDER_KEYWORDS) -> Column:
    """Whole-word, case-insensitive match of any keyword, anywhere."""
    return _c(c).rlike(keyword_regex(keywords))


def is_blank(c: ColumnOrName) -> Column:
    """True when every character is <= U+0020 (the JVM's ``trim().isEmpty()``).

    Spark's ``trim`` strips only spaces, so the test is a regex instead.
    """
    return ~_c(c).rlike("[^\\x00-\\x20]")


def is_tagged(c: ColumnOrName) -> Column:
    """Content starts with either header spelling (case-sensitive)."""
    c = _c(c)
    return c.startswith(TAG_HEADER) | c.startswith(TAG_HEADER_COMPACT)


def first_line_tagged(c: ColumnOrName) -> Column:
    """Header test on line 1 only; unreadable (null) content counts as not tagged.

    A prefix test on the whole content gives the same answer as one on the
    first line, since both headers hold no line break.
    """
    return F.coalesce(is_tagged(c), F.lit(False))


_COMPACT_RX = "(?m)^--(?=" + "|".join(_rx_lit(w) for w in COMPACT_COMMENT_WORDS) + ")"


def needs_fixing(c: ColumnOrName) -> Column:
    """Some line begins with ``--`` directly followed by a header word."""
    return _c(c).rlike(_COMPACT_RX)


def fix_comments(c: ColumnOrName) -> Column:
    """Insert a space after ``--`` on those lines (one pass; the words are disjoint)."""
    return F.regexp_replace(_c(c), _COMPACT_RX, "-- ")


def add_tag(c: ColumnOrName, component: ColumnOrName, file_name: ColumnOrName) -> Column:
    """Prepend the three header lines."""
    return F.concat(F.lit(TAG_HEADER + "\n" + CHANGESET_PREFIX), _c(component), F.lit(":"),
                    _c(file_name), F.lit("\n" + PRECONDITIONS_LINE + "\n"), _c(c))


def script_action(c: ColumnOrName) -> Column:
    """IGNORED / TAGGED / FIXED / UNCHANGED, tested in that order."""
    c = _c(c)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(is_blank(c) | ~has_sql_orders(c), F.lit(IGNORED))
            .when(~is_tagged(c), F.lit(TAGGED))
            .when(needs_fixing(c), F.lit(FIXED))
            .otherwise(F.lit(UNCHANGED)))


def substitute(c: ColumnOrName, value: str, mark: str) -> Column:
    """Replace every literal occurrence of ``mark`` by ``value`` (note the order)."""
    return F.replace(_c(c), F.lit(mark), F.lit(value))


def normalize_path(c: ColumnOrName) -> Column:
    """Drop a leading char before a drive colon, backslash to slash, drop one ending slash."""
    c = _c(c)
    s = F.when((F.length(c) > 3) & (F.instr(c, ":") == 3), F.substring(c, 2, 1 << 30)).otherwise(c)
    s = F.replace(s, F.lit("\\"), F.lit("/"))
    return F.when(s.endswith("/"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


def has_extension(c: ColumnOrName, ext: str, case_sensitive: bool = False) -> Column:
    """File name ends with ``ext``; lower-cased unless ``case_sensitive``."""
    c = _c(c)
    return c.endswith(ext) if case_sensitive else F.lower(c).endswith(ext.lower())


def base_name(c: ColumnOrName) -> Column:
    """Last path segment."""
    return F.element_at(F.split(_c(c), "/"), -1)


def strip_final_break(c: ColumnOrName) -> Column:
    """Remove exactly one final line terminator (``\\z``, not ``$``, which would take two)."""
    return F.regexp_replace(_c(c), "(\r\n|\n|\r)\\z", "")


def split_lines(c: ColumnOrName) -> Column:
    """Lines of a text; a trailing terminator adds no empty line; '' has no lines."""
    c = _c(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.split(strip_final_break(c), LINE_BREAK, -1))


def map_lines(c: ColumnOrName, fn: Callable[[Column], Column] | None = None) -> Column:
    """Apply ``fn`` to each line; keep order; end every line with '\\n'.

    With no function the text is returned unchanged; empty text stays empty.
    """
    c = _c(c)
    if fn is None:
        return c
    return F.when(c == "", c).otherwise(
        F.concat(F.array_join(F.transform(split_lines(c), fn), "\n"), F.lit("\n")))


def last_line(c: ColumnOrName) -> Column:
    """Last line, '' when there is none; a trailing terminator is ignored."""
    return F.coalesce(F.try_element_at(split_lines(c), F.lit(-1)), F.lit(""))


def line_count(c: ColumnOrName) -> Column:
    return F.size(split_lines(c))


def fold_replace(line: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply ordered (pattern, replacement) regex rules to a line."""
    for pattern, repl in rules:
        line = F.regexp_replace(line, pattern, repl)
    return line
