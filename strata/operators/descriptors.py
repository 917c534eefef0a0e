"""Plugin descriptors (XML text) to fields and to state lines.

Spark's XPath functions abort the job on text that its XML reader takes, and
its reader takes text behind the root element. So a descriptor is parsed once,
by a strict parser in an Arrow-batched function: anything but one well-formed
document (also a byte-order mark, text or an element behind the root) is
invalid and has no fields.
"""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import ColumnOrName, _c

# ---------------------------------------------------------------------------
# Element names read, and the state lines written per plugin.
NAME_TAG, VERSION_TAG, DB_TAG = "name", "version", "db-pool-required"
INSTALLED_SUFFIX, INSTALLED_VALUE = ".installed", "1"
POOL_SUFFIX, POOL_VALUE = ".pool", "portal"
STATE_LINE_SEP = "\r\n"                      # plugin state files end lines with CRLF
# Default comment header of the state file (callers may pass their own
# lines to ``write_state``; the tool-identification line is left out).
STATE_HEADER = (
    "# plugins.dat file",
    "# This file stores the state of each plugin available in the webapp ",
    "# and the database pool it may be using.",
    "",
)
# ---------------------------------------------------------------------------


def flag_is_one(c: ColumnOrName) -> Column:
    """Text equals '1' exactly (null is false)."""
    return F.coalesce(_c(c) == "1", F.lit(False))


def _elements(xml: str | None, tags: tuple[str, ...]) -> tuple:
    """(valid, first and last text of each tag); an empty text is none."""
    none = (False, *[None] * (2 * len(tags)))
    if xml is None or xml.startswith("\ufeff"):
        return none
    found: dict[str, list[str]] = {t: [] for t in tags}
    open_: list[tuple[str, list[str]]] = []

    def begin(name, _):
        if name in found:
            open_.append((name, []))
            found[name].append("")
            open_[-1][1].append(str(len(found[name]) - 1))

    def text(data):
        for _, parts in open_:
            parts.append(data)

    def end(name):
        if open_ and open_[-1][0] == name:
            _, (at, *parts) = open_.pop()
            found[name][int(at)] = "".join(parts)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, text
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, ValueError, UnicodeError):
        return none
    return (True, *[(found[t][i] or None) if found[t] else None for t in tags for i in (0, -1)])


def parsed(xml: ColumnOrName, tags: tuple[str, ...]) -> Column:
    """Struct ``valid, <tag>_first, <tag>_last, ...`` from one parse per row;
    texts of elements at any depth, hyphens in tag names as underscores."""
    names = ["valid", *[f"{t.replace('-', '_')}_{w}" for t in tags for w in ("first", "last")]]
    kind = ", ".join(f"{n} {'boolean' if n == 'valid' else 'string'}" for n in names)

    @F.pandas_udf(kind)
    def fields(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_elements(x, tags) for x in texts], columns=names, dtype=object)

    return fields(_c(xml))


def xml_valid(xml: ColumnOrName) -> Column:
    """One well-formed document and nothing else (null is not)."""
    return parsed(xml, ())["valid"]


def descriptor_field(xml: ColumnOrName, tag: str, which: str = "first") -> Column:
    """Text of the first or last ``tag`` element at any depth; null when the
    XML is malformed or the element is missing or empty."""
    return parsed(xml, (tag,))[f"{tag.replace('-', '_')}_{which}"]


def parse_descriptors(df: DataFrame, xml: str = "xml", which: str = "last") -> DataFrame:
    """Add ``valid``, ``name``, ``version``, ``db_required`` (and ``name_first``).

    ``which``: the ``name`` element kept when several exist at any depth,
    ``"last"`` (the streaming-parser behaviour) or ``"first"`` (the DOM one).
    A missing element gives null, not ''.
    """
    if which not in ("first", "last"):
        raise ValueError("which must be 'first' or 'last'")
    p = F.col("_parsed")
    return (df.withColumn("_parsed", parsed(xml, (NAME_TAG, VERSION_TAG, DB_TAG)))
              .withColumns({"valid": p["valid"], "name": p[f"name_{which}"], "version": p["version_first"],
                            "db_required": p["valid"] & flag_is_one(p["db_pool_required_last"]), "name_first": p["name_first"]})
              .drop("_parsed"))


def one_per_component(df: DataFrame, component: str, path: str = "path") -> DataFrame:
    """``df`` with ``extra``: false on the descriptor of the lowest path of each
    component, true on the others, which are to be reported. One partial
    aggregate and a join that adaptive execution can split."""
    low = df.groupBy(F.col(component).alias("_c")).agg(F.min(path).alias("_low"))
    return (df.join(low, F.col(component).eqNullSafe(F.col("_c"))).withColumn("extra", ~F.col(path).eqNullSafe(F.col("_low")))
            .drop("_c", "_low"))


def state_lines(name: ColumnOrName, db_required: ColumnOrName) -> Column:
    """``array<struct<key,value>>``: ``name.installed=1`` and, when a database
    is required, ``name.pool=portal``."""
    n = _c(name)
    return F.filter(F.array(
        F.struct(F.concat(n, F.lit(INSTALLED_SUFFIX)).alias("key"), F.lit(INSTALLED_VALUE).alias("value")),
        F.when(F.coalesce(_c(db_required), F.lit(False)),
               F.struct(F.concat(n, F.lit(POOL_SUFFIX)).alias("key"), F.lit(POOL_VALUE).alias("value")))),
        lambda s: s.isNotNull())


def plugin_state(df: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Descriptors to ``(key, value)`` state rows. Malformed or nameless
    descriptors give no rows (see ``descriptor_rejects``); duplicated names
    are not merged."""
    p = parse_descriptors(df, xml, which="last")
    return (p.where(F.col("valid") & F.col("name").isNotNull())
             .select(*keep, F.explode(state_lines("name", "db_required")).alias("kv"))
             .select(*keep, "kv.key", "kv.value"))


def descriptor_rejects(df: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Rows that give no state: malformed XML or no name element."""
    p = parse_descriptors(df, xml, which="last")
    reason = F.when(~F.col("valid"), F.lit("MALFORMED")).when(F.col("name").isNull(), F.lit("NO_NAME"))
    return p.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*keep, "reason")
