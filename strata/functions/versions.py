"""Version keys and artifact/archive naming as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import ColumnOrName, _c, base_name

# ---------------------------------------------------------------------------
# Fixed values.
SNAPSHOT_SUFFIX = "-SNAPSHOT"        # cut from a version to get the release
SNAPSHOT_MARK = "SNAPSHOT"           # replaced by a time stamp in names
STAMP_PATTERN = "yyyyMMdd.HHmmss"    # default time stamp put in place of the mark
ARCHIVE_STAMP_PATTERN = "yyMMdd-hhmm"  # archive names: 12-hour clock ("hh")
# Timestamped snapshot versions, e.g. 1.0-20240101.120000-3:
TIMESTAMPED_SNAPSHOT_RX = "^(.*)-([0-9]{8}\\.[0-9]{6})-([0-9]+)$"
# Qualifier order (low to high); no qualifier ranks as a release.
QUALIFIER_RANKS = (
    (("alpha", "a"), 1),
    (("beta", "b"), 2),
    (("milestone", "m"), 3),
    (("rc", "cr"), 4),
    (("snapshot",), 5),
    (("", "ga", "final", "release"), 6),
    (("sp",), 7),
)
UNKNOWN_QUALIFIER_RANK = 8
# ---------------------------------------------------------------------------


def qualifier_rank(q: Column) -> Column:
    """Rank of a lower-cased qualifier word (letters only)."""
    expr = None
    for words, rank in QUALIFIER_RANKS:
        cond = q.isin(*words)
        expr = F.when(cond, F.lit(rank)) if expr is None else expr.when(cond, F.lit(rank))
    return expr.otherwise(F.lit(UNKNOWN_QUALIFIER_RANK))


def version_key(c: ColumnOrName) -> Column:
    """Comparable key ``struct(nums array<decimal>, rank int, qnum decimal, qtext string)``.

    ``1.2.0-rc1`` -> ([1, 2], 4, 1, ''). The leading dotted numbers have
    trailing zeros removed (``1.0`` equals ``1.0.0``); an array that is a
    prefix of another sorts lower. What follows, behind ``.``, ``-``, ``_`` or
    nothing (``5.4.0.Final``, ``1.0b2``), is the qualifier: alpha < beta <
    milestone < rc < snapshot < release < sp < unknown words, which order by
    their text. A version that does not begin with a number, has one of more
    than 38 digits, or goes on with a dot and an unknown word (``1.x``) has no
    key ("null version range").

    Structs and arrays compare field by field, so ``max``/``max_by`` and
    ``>`` order versions directly.
    """
    v = _c(c)
    lead = F.regexp_extract(v, "^[0-9]+(?:\\.[0-9]+)*", 0)
    qual = F.lower(F.regexp_replace(F.substring(v, F.length(lead) + 1, F.length(v)), "^[._-]+", ""))
    nums = F.transform(F.split(F.regexp_replace(lead, "(\\.0+)+$", ""), "\\."), lambda x: x.try_cast("decimal(38,0)"))
    word = F.regexp_extract(qual, "^([a-z]*)", 1)
    qnum = F.coalesce(F.regexp_extract(qual, "([0-9]+)$", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    rank = qualifier_rank(word)
    qtext = F.when(rank == UNKNOWN_QUALIFIER_RANK, qual).otherwise(F.lit(""))
    key = F.struct(nums.alias("nums"), rank.alias("rank"), qnum.alias("qnum"), qtext.alias("qtext"))
    odd = F.substring(v, F.length(lead) + 1, 1).eqNullSafe(F.lit(".")) & (rank == UNKNOWN_QUALIFIER_RANK)
    return F.when(v.isNull() | odd | F.exists(nums, lambda x: x.isNull()), F.lit(None)).otherwise(key)


def target_version(c: ColumnOrName) -> Column:
    """The version a script leads to: of an ``update...-A-B.sql`` (or
    ``update...-B.sql``) file name the text after the last hyphen; null for any
    other script."""
    name = base_name(c)
    return F.when(name.rlike("(?is)^update.*-[^-]*\\.sql$"), F.regexp_extract(name, "(?is)-([^-]*)\\.sql$", 1))


def release_version(c: ColumnOrName) -> Column:
    """Cut from ``-SNAPSHOT`` when the version ends with it."""
    v = _c(c)
    return F.when(v.endswith(SNAPSHOT_SUFFIX), F.substring_index(v, SNAPSHOT_SUFFIX, 1)).otherwise(v)


def version_from(c: ColumnOrName, use_path: bool = False) -> Column:
    """Text between the first and the last ``-`` of the file name.

    Fewer than two hyphens gives null. ``use_path=True`` reads the whole
    relative path, as the reference does (a hyphenated directory then leaks
    into the result).
    """
    s = _c(c) if use_path else base_name(c)
    rx = "^[^-]*-((?s).*)-[^-]*$"
    return F.when(s.rlike(rx), F.regexp_extract(s, rx, 1))


def is_snapshot(c: ColumnOrName) -> Column:
    v = _c(c)
    return F.upper(v).endswith(SNAPSHOT_MARK) | v.rlike(TIMESTAMPED_SNAPSHOT_RX)


def stamp_name(name: ColumnOrName, version: ColumnOrName, ts: ColumnOrName,
               pattern: str = STAMP_PATTERN) -> Column:
    """Replace ``SNAPSHOT`` in a name by the formatted time when the version is a snapshot."""
    n = _c(name)
    return F.when(is_snapshot(version), F.replace(n, F.lit(SNAPSHOT_MARK), F.date_format(_c(ts), pattern))
                  ).otherwise(n)


def archive_name(base: ColumnOrName, classifier: ColumnOrName | None, version: ColumnOrName | None,
                 ts: ColumnOrName | None, ext: str) -> Column:
    """``base[-classifier][-version][-yyMMdd-hhmm].ext``; null parts are skipped."""
    parts = [_c(base)]
    for p in (classifier, version):
        if p is not None:
            parts.append(_c(p))
    if ts is not None:
        parts.append(F.date_format(_c(ts), ARCHIVE_STAMP_PATTERN))
    return F.concat(F.concat_ws("-", *parts), F.lit("." + ext))
