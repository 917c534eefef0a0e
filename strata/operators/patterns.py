"""Path selection: glob filters, profiles, path rules, re-rooting, purge, package membership.

Rule sets are small (tens of globs) and become literal predicates: one
scan, codegen, each regex compiled once per task. Package rules that are a
table meet the paths through an index of their literal parts (``glob_index``),
as a join on a pattern column would plan as a nested loop. Prefix tables of any size (``purge``) are matched by an equi-join on the
ancestor directories instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.globs import PROFILES, globs_column_regex, pattern_profile, selected
from strata.functions.text import ColumnOrName, _c
from strata.operators.overlay import pick, unpick

# ---------------------------------------------------------------------------
# Documentation paths dropped when copying a site tree,
# written (like the reference) for a backslash separator; full-path match.
DOC_EXCLUDE_REGEXES_BACKSLASH = (
    r"(.)*site\\site(.)*.xml",
    r"(.)*\\tech(\\.)*",
    r"(.)*\\xdoc\\[^\\]*\.(.)*",
    r"(.)*\\resources\\images\\[^\\]*\.(.)*",
)
PRUNED_DIRECTORY_NAMES = (".svn", "tech")   # skipped with everything below them
# ---------------------------------------------------------------------------


def glob_filter(df: DataFrame, path: str, includes: Sequence[str] | None = None,
                excludes: Sequence[str] | None = None) -> DataFrame:
    """Keep rows matching any include (all when none) and no exclude."""
    return df.where(selected(path, includes, excludes))


def profile_filter(df: DataFrame, path: str, profile: str) -> DataFrame:
    p = pattern_profile(profile)
    return glob_filter(df, path, p["include"], p["exclude"])


def profile_membership(df: DataFrame, path: str, profiles: Sequence[str] | None = None) -> DataFrame:
    """One row per (profile, row) selected by the profile; a single pass over ``df``."""
    names = list(profiles or PROFILES)
    tags = F.array(*[F.when(selected(path, PROFILES[n]["include"], PROFILES[n]["exclude"]), F.lit(n))
                     for n in names])
    return df.select(F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("profile"), *df.columns)


def _for_separator(rx: str, separator: str) -> str:
    if separator == "\\":
        return rx
    return rx.replace("\\\\", "\\" + separator if separator in ".$^|?*+()[]{}" else separator)


def path_exclude(df: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """Drop documentation paths and anything under a pruned directory name. A
    null path is excluded by no rule and stays."""
    p = F.col(path)
    sep = "\\\\" if separator == "\\" else separator
    keep = F.lit(True)
    for rx in DOC_EXCLUDE_REGEXES_BACKSLASH:
        keep = keep & ~p.rlike("^(?:" + _for_separator(rx, separator) + ")$")
    for name in PRUNED_DIRECTORY_NAMES:
        seg = name.replace(".", "\\.")
        keep = keep & ~p.rlike(f"(^|{sep}){seg}{sep}")
    return df.where(F.coalesce(keep, F.lit(True)))


def remap_prefix(df: DataFrame, path: str, to: str, from_: str = "") -> DataFrame:
    """Relocate rows under ``from_`` to ``to`` (other rows unchanged)."""
    p = F.col(path)
    moved = F.concat(F.lit(to), F.substring(p, len(from_) + 1, 1 << 30))
    return df.withColumn(path, F.when(p.startswith(from_), moved).otherwise(p) if from_ else moved)


def relative_path(df: DataFrame, path: str, base: str) -> DataFrame:
    """Strip a base directory from paths below it."""
    b = base.rstrip("/") + "/"
    p = F.col(path)
    return df.withColumn(path, F.when(p.startswith(b), F.substring(p, len(b) + 1, 1 << 30)).otherwise(p))


def extract_subtree(df: DataFrame, path: str, prefix: str, to: str,
                    existing: DataFrame | None = None) -> DataFrame:
    """Entries below ``prefix``, re-rooted under ``to``; they replace ``existing`` entries."""
    pre = prefix.rstrip("/") + "/"
    sub = remap_prefix(df.where(F.col(path).startswith(pre)), path, to, pre)
    if existing is None:
        return sub
    # Distinct first: a re-rooted path repeated many times is reduced map-side.
    return (existing.join(sub.select(path).distinct(), on=path, how="left_anti")
            .unionByName(sub, allowMissingColumns=True))


def ancestors(path: ColumnOrName) -> Column:
    """Every directory above a path, plus the path itself: a/b/c -> [a, a/b, a/b/c]."""
    segs = F.split(_c(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, 1, i), "/"))


def purge(df: DataFrame, path: str, roots: Sequence[str] | DataFrame = (),
          includes: Sequence[str] | None = None, excludes: Sequence[str] | None = None,
          root_col: str = "root") -> DataFrame:
    """Remove rows under the given roots, plus rows picked by extra pattern sets.

    Roots as a list become literal prefix tests. Roots as a DataFrame (any
    size) are matched by equality with the ancestors of each directory, a
    hash/sort-merge join rather than a nested loop. Null paths stay.
    """
    out = df
    if isinstance(roots, DataFrame):
        r = roots.select(F.regexp_replace(F.col(root_col), "/+$", "").alias("_anc")).where("_anc IS NOT NULL").distinct()
        # Directories, not files, climb to their ancestors, and only to depths at
        # which there is a root; a directory of very many files is one row here.
        depths = sorted(x["d"] for x in r.select(F.size(F.split("_anc", "/")).alias("d")).distinct().collect())
        own = F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1)
        segs = F.split("_dir", "/")
        above = [F.when(F.size(segs) >= d, F.array_join(F.slice(segs, 1, d), "/")) for d in depths]
        climbed = (df.select(own.alias("_dir")).distinct()
                   .select("_dir", F.explode(F.array(*above) if above else F.array().cast("array<string>")).alias("_anc")))
        under = climbed.join(r, on="_anc", how="left_semi").select("_dir").distinct()
        out = (out.withColumn("_dir", own).join(under, on="_dir", how="left_anti")
                  .join(r, on=F.col(path) == F.col("_anc"), how="left_anti").select(*df.columns))
    elif roots:
        hit = F.lit(False)
        for root in roots:
            r = root.rstrip("/")
            hit = hit | (F.col(path) == r) | F.col(path).startswith(r + "/")
        out = out.where(~F.coalesce(hit, F.lit(False)))
    if includes:
        out = out.where(~F.coalesce(selected(path, includes, excludes), F.lit(False)))
    return out


def package_membership(files: DataFrame, rules: Sequence[Mapping], path: str = "path",
                       layer: str = "layer", resolve: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Which files go into which package, at which entry path.

    A rule: ``package``, optional ``layer`` (source layer), ``include`` and
    ``exclude`` globs, ``entry_prefix``, ``rule_order``. A file may be in
    several packages. Output ``(package, entry_path, source_path, rule_order,
    ...)``. With ``resolve`` a duplicated entry path inside a package keeps
    the file of the latest rule (then the greatest source path, then ``tiebreak``).
    """
    rs = [dict(r) for r in rules]
    if not rs:
        raise ValueError("package_membership needs at least one rule")
    hits = []
    for i, r in enumerate(rs):
        cond = selected(path, r.get("include"), r.get("exclude"))
        if r.get("layer") is not None:
            cond = cond & (F.col(layer) == F.lit(r["layer"]))
        hits.append(F.when(cond, F.struct(F.lit(r["package"]).alias("package"),
                                          F.concat(F.lit(r.get("entry_prefix") or ""), F.col(path)).alias("entry_path"),
                                          F.lit(int(r.get("rule_order", i))).alias("rule_order"))))
    m = (files.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_m"),
                      F.col(path).alias("source_path"), *[c for c in files.columns if c != path])
              .select("_m.*", "source_path", *[c for c in files.columns if c != path]))
    if not resolve:
        return m
    order = ["rule_order", "source_path", *tiebreak]
    return (m.groupBy("package", "entry_path")
             .agg(pick(order, m.columns).alias("_w")).select(*unpick(F.col("_w"), m.columns)))


RULE_FIELDS = ("package", "layer", "include", "exclude", "entry_prefix", "rule_order")


def glob_index(globs: DataFrame, glob: str = "glob") -> DataFrame:
    """Add ``regex`` and the index key ``kind, part`` to globs that are rows.

    The key is the most selective literal that every matching path has: its last
    segment (``name``), its first one with its extension (``both``), its first
    one, its extension, or nothing (``any``).
    """
    g = F.col(glob)
    segs = F.split(F.regexp_replace(F.when(g.endswith("/"), F.concat(g, F.lit("**"))).otherwise(g), "^/+|/+$", ""), "/")
    first, last = segs[0], F.element_at(segs, -1)
    literal = lambda c: ~c.rlike("[*?]")
    ext = F.regexp_extract(last, r"(\.[^.*?]*)$", 1)  # what follows the last dot is literal
    has_ext, has_first = (ext != "") & (last != "**"), literal(first)
    kind = (F.when(literal(last), "name").when(has_first & has_ext, "both").when(has_first, "first").when(has_ext, "ext").otherwise("any"))
    part = (F.when(kind == "name", last).when(kind == "both", F.concat(first, F.lit("|"), ext))
            .when(kind == "first", first).when(kind == "ext", ext).otherwise(""))
    return globs.withColumns({"regex": globs_column_regex(g), "kind": kind, "part": part})


def path_keys(path: Column) -> Column:
    """The index keys under which a path's globs lie, one of each kind."""
    first, last = F.substring_index(path, "/", 1), F.substring_index(path, "/", -1)
    ext = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    key = lambda kind, part: F.struct(F.lit(kind).alias("kind"), part.alias("part"))
    return F.array(key("name", last), key("both", F.concat(first, F.lit("|"), ext)), key("first", first), key("ext", ext), key("any", F.lit("")))


def package_membership_by_table(files: DataFrame, rules: DataFrame, path: str = "path", layer: str = "layer",
                                resolve: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """``package_membership`` with rules as rows (``RULE_FIELDS``, globs as arrays), any number of them.

    Distinct paths meet the include globs by equality of index keys
    (``glob_index``); only those candidates are tested with their regex, and the
    rules found are joined to the files by path. No nested loop: a
    path meets the globs that share a literal with it, and those without any.
    A rule without includes takes every path, a null one as well, which matches
    no glob; a null ``rule_order`` is 0.
    """
    listed = F.when(F.size("include") > 0, F.col("include")).otherwise(F.array(F.lit(None).cast("string")))
    excluded = F.when(F.size("exclude") > 0, F.concat(F.lit("(?s)(?:"), F.array_join(F.transform("exclude", globs_column_regex), "|"), F.lit(")")))
    rule = F.struct("package", F.coalesce("entry_prefix", F.lit("")).alias("entry_prefix"), F.coalesce("rule_order", F.lit(0)).cast("int").alias("rule_order"),
                    F.col("layer").alias("of_layer"), excluded.alias("excluded"))
    index = glob_index(rules.select(rule.alias("rule"), listed.alias("globs")).select("rule", F.explode("globs").alias("glob")))
    index = index.select("rule", F.concat(F.lit("(?s)"), "regex").alias("regex"), "kind", "part").distinct()
    slashed = F.concat(F.lit("/"), F.col("_path"))
    paths = files.select(F.col(path).alias("_path")).distinct()
    keyed = paths.select("_path", F.explode(path_keys(F.col("_path"))).alias("_k")).select("_path", "_k.*")
    found = (keyed.join(index, ["kind", "part"]).where(F.col("regex").isNull() | F.rlike(slashed, F.col("regex")))
             .where(~F.coalesce(F.rlike(slashed, F.col("rule.excluded")), F.lit(False))).select("_path", "rule").distinct())
    cols = [c for c in files.columns if c != path]
    of_layer = F.col(layer) if layer in files.columns else F.lit(None)
    m = (files.join(found, files[path].eqNullSafe(F.col("_path"))).where(F.col("rule.of_layer").isNull() | (F.col("rule.of_layer") == of_layer))
         .select("rule.package", F.concat("rule.entry_prefix", F.col(path)).alias("entry_path"), "rule.rule_order", F.col(path).alias("source_path"), *cols))
    if not resolve:
        return m
    order = ["rule_order", "source_path", *tiebreak]
    return m.groupBy("package", "entry_path").agg(pick(order, m.columns).alias("_w")).select(*unpick(F.col("_w"), m.columns))
