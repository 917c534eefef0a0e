"""SQL script processing: classify, tag, repair, gate, and line rewriting.

All narrow: every script is one row and every step a column expression, so
a corpus of any size is processed in one pass with no shuffle. Whole texts
are processed (no prefixes); line work uses ``split`` + ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T

# Our default for "a path the migration scheme understands": the real grammar
# lives in an external library, so callers may pass their own predicate.
MANAGED_RX = "(?i)(^|/)(create|init|update)[^/]*\\.sql$"
DEFAULT_COMPONENT = "core"
BUILD_PROPERTIES = "build.properties"
PASS, REJECT, DROP = "PASS", "REJECT", "DROP"
REJECTED = "REJECTED"


def is_managed(path: T.ColumnOrName, predicate: Callable[[Column], Column] | None = None) -> Column:
    p = T._c(path)
    return F.coalesce(predicate(p) if predicate else p.rlike(MANAGED_RX), F.lit(False))


def process_scripts(df: DataFrame, path: str = "path", content: str = "content",
                    component: str | None = "component", file_name: str | None = None,
                    managed: bool | Callable[[Column], Column] = False) -> DataFrame:
    """Classify and transform: ``(path, action, content)`` plus the input's other columns.

    TAGGED rows get the three header lines, FIXED rows get their compact
    comments repaired; IGNORED and UNCHANGED keep their content. Only
    TAGGED and FIXED rows need writing (``write_scripts`` does that).
    With ``managed`` (True: the default rule, or a predicate on the path) an
    unmanaged path gets action REJECTED and keeps its content.
    """
    c = F.col(content)
    comp = F.coalesce(F.col(component), F.lit(DEFAULT_COMPONENT)) if component else F.lit(DEFAULT_COMPONENT)
    name = F.col(file_name) if file_name else T.base_name(path)
    action = T.script_action(c)
    if managed:
        known = is_managed(path, managed if callable(managed) else None)
        action = F.when(known, action).otherwise(F.lit(REJECTED))
    new = (F.when(action == T.TAGGED, T.add_tag(c, comp, name))
           .when(action == T.FIXED, T.fix_comments(c)).otherwise(c))
    return df.withColumn("action", action).withColumn(content, new)


def gate_scripts(df: DataFrame, path: str = "path", content: str = "content",
                 managed: Callable[[Column], Column] | None = None,
                 keep_build_properties: bool | Column = True) -> DataFrame:
    """Add ``gate``: PASS (managed and tagged), REJECT (managed, not tagged or
    unreadable), DROP (not a non-empty .sql file, or unmanaged: never reported).

    ``build.properties`` passes when no vendor rules apply (a flag, or a
    predicate per row); otherwise it is dropped like any other file.
    """
    p, c = F.col(path), F.col(content)
    keep = keep_build_properties if isinstance(keep_build_properties, Column) else F.lit(keep_build_properties)
    gate = (F.when(keep & (T.base_name(p) == BUILD_PROPERTIES), F.lit(PASS))
            .when(~T.has_extension(p, ".sql") | (F.coalesce(F.octet_length(c), F.lit(1)) == 0), F.lit(DROP))
            .when(~is_managed(p, managed), F.lit(DROP))
            .when(T.first_line_tagged(c), F.lit(PASS))
            .otherwise(F.lit(REJECT)))
    return df.withColumn("gate", gate)


def _line_rules(rules: Sequence[Mapping]) -> list[dict]:
    return sorted((dict(r) for r in rules), key=lambda r: (r.get("vendor") or "", r.get("rule_order", 0)))


def _folder(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    # One-argument function: ``transform`` passes an index too when the
    # lambda declares two parameters.
    def fold(line: Column) -> Column:
        return T.fold_replace(line, pairs)
    return fold


def rewrite_lines(df: DataFrame, rules: Sequence[Mapping], content: str = "content",
                  vendor: str | None = None, out: str | None = None) -> DataFrame:
    """Rewrite every line with ordered regex rules ``(vendor, rule_order, pattern, replacement)``.

    Without ``vendor`` all rules apply to all rows; with it, a row gets only
    its vendor's rules (rows of other vendors, or none, are left unchanged).
    Output lines end with '\\n' (``map_lines`` contract).
    """
    rs = _line_rules(rules)
    c = F.col(content)
    if vendor is None:
        pairs = [(r["pattern"], r["replacement"]) for r in rs]
        new = T.map_lines(c, lambda line: T.fold_replace(line, pairs))
    else:
        by_vendor: dict[str, list[tuple[str, str]]] = {}
        for r in rs:
            by_vendor.setdefault(r["vendor"], []).append((r["pattern"], r["replacement"]))
        new = None
        for v, pairs in by_vendor.items():
            expr = T.map_lines(c, _folder(pairs))
            new = F.when(F.col(vendor) == v, expr) if new is None else new.when(F.col(vendor) == v, expr)
        new = c if new is None else new.otherwise(c)
    return df.withColumn(out or content, new)


RULE_BYTES = 8 << 20  # rules of at most this size are broadcast


def rewrite_lines_by_table(df: DataFrame, rules: DataFrame, vendor: str, content: str = "content",
                           out: str | None = None, broadcast_bytes: int = RULE_BYTES) -> DataFrame:
    """``rewrite_lines`` with rules as rows ``vendor, rule_order, pattern, replacement``.

    Each row gets its vendor's rules as one array, folded over its lines in
    order (equal orders by pattern). The rules' size is added up first: up to ``broadcast_bytes`` they
    are broadcast and the texts are not shuffled; beyond, they are joined by
    shuffle. Rows of vendors without rules, or of none, are left unchanged; rules
    with a null in any column apply to nothing.
    """
    whole = rules.select("vendor", "rule_order", "pattern", "replacement").dropna()
    size = whole.agg(F.sum(F.octet_length("pattern") + F.octet_length("replacement") + F.octet_length("vendor") + 32)).first()[0] or 0
    folded = whole.groupBy(F.col("vendor").alias("_vendor")).agg(F.sort_array(F.collect_list(F.struct("rule_order", "pattern", "replacement"))).alias("_rules"))
    folded = F.broadcast(folded) if size <= broadcast_bytes else folded.hint("merge")
    fold = lambda line: F.aggregate("_rules", line, lambda acc, r: F.regexp_replace(acc, r["pattern"], r["replacement"]))
    name = out or content
    joined = df.join(folded, F.col(vendor) == F.col("_vendor"), "left")
    new = F.when(F.col("_rules").isNotNull(), T.map_lines(F.col(content), fold)).otherwise(F.col(content))
    return joined.withColumn(name, new).drop("_vendor", "_rules")


def deploy_scripts(df: DataFrame, rules: Sequence[Mapping], requested: str = "vendor",
                   configured: Column | str | None = None, path: str = "path", content: str = "content",
                   managed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The scripts copied for deployment: vendor route, gate, then line rewrite.

    Only PASS rows are kept; each gets ``target_vendor`` and its content
    rewritten line by line with that vendor's rules (rows routed to no
    vendor keep their bytes unchanged). Rows with an unknown vendor keep
    ``route_status = 'ERROR'`` and their message, for the caller to raise on
    or report. All narrow: one pass, no shuffle.
    """
    from strata.operators.artifacts import vendor_route
    routed = vendor_route(df, requested, configured)
    gated = gate_scripts(routed, path=path, content=content, managed=managed,
                         keep_build_properties=F.col("target_vendor").isNull())
    return rewrite_lines(gated.where(F.col("gate") == PASS), rules, content=content, vendor="target_vendor")
