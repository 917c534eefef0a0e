"""Layer merging: union, last-wins / newer-wins overlay, first-per-key, flatten.

Design. Every merge here is ONE aggregate keyed on the merge key:
``max(struct(order..., row...))`` per layer segment, then the segment
winners are folded in a projection. The aggregate has a partial (map-side)
phase, so a key repeated in millions of rows (a hot path, a popular
artifact) is reduced to one row per map task before the shuffle; a
``row_number`` window would instead send every row of the hot key to one
task and sort it. A chain of replace and newer layers still costs one
shuffle: segments are conditional aggregates of the same groupBy, not a
fold of joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import base_name

REPLACE, NEWER = "replace", "newer"


def union_layers(*dfs: DataFrame) -> DataFrame:
    """Bring several trees into one (by column name; missing columns become null)."""
    if not dfs:
        raise ValueError("union_layers needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def with_layer(df: DataFrame, layer: str, priority: int) -> DataFrame:
    """Tag a DataFrame as one layer."""
    return df.withColumn("layer", F.lit(layer)).withColumn("priority", F.lit(priority))


def newer_than(a: Column, b: Column) -> Column:
    """``a`` strictly newer than ``b``; a missing time counts as the oldest."""
    return F.when(a.isNull(), F.lit(False)).when(b.isNull(), F.lit(True)).otherwise(a > b)


def pick(order: Sequence[Column | str], cols: Sequence[str], cond: Column | None = None,
         least: bool = False) -> Column:
    """Aggregate: the row (``cols``) with the greatest (``least``: smallest) ``order``.

    ``max(struct(order..., rest of row...))``: one struct buffer, partial
    aggregation before the shuffle, and full ties resolved by the row itself,
    so the winner is deterministic. Order items that are column names are
    stored once (as themselves); expressions get ``_o<i>`` fields. Rows where
    ``cond`` is false do not take part.
    """
    fields, seen = [], set()
    for i, o in enumerate(order):
        if isinstance(o, str):
            if o not in seen:
                fields.append(F.col(f"`{o}`"))
                seen.add(o)
        else:
            fields.append(o.alias(f"_o{i}"))
    fields += [F.col(f"`{c}`") for c in cols if c not in seen]
    s = F.struct(*fields)
    s = s if cond is None else F.when(cond, s)
    return F.min(s) if least else F.max(s)


def unpick(c: Column, cols: Sequence[str]) -> list[Column]:
    return [c[x].alias(x) for x in cols]


def layered_overlay(layers: DataFrame, key: Sequence[str], priority: str = "priority",
                    tiebreak: Sequence[str] = (), newer: Sequence[int] | Mapping[int, str] = (),
                    ts: str | None = None) -> DataFrame:
    """Merge prioritised layers: per key, the highest layer wins.

    ``layers`` holds all layers unioned, with an integer ``priority`` column
    (low to high). ``tiebreak`` columns order rows within a layer; rows
    still tied are ordered by their remaining columns, so the winner never
    depends on arrival order.

    ``newer`` lists priorities that are *newer-wins* layers: such a layer
    replaces what lies below it only when its ``ts`` is strictly greater (a
    missing time is the oldest). All other priorities are *replace* layers.
    Mixed chains cost one shuffle (see module doc).
    """
    if isinstance(newer, Mapping):
        newer = [p for p, m in newer.items() if m == NEWER]
    newer = sorted(set(newer))
    if newer and ts is None:
        raise ValueError("newer-wins layers need a ts column")
    cols = layers.columns
    p = F.col(priority)
    tb = list(tiebreak)
    if not newer:
        w = layers.groupBy(*key).agg(pick([priority, *tb], cols).alias("_w"))
        return w.select(*unpick(F.col("_w"), cols))

    # Segments in order: replace ranges between the newer priorities, and each newer one.
    segments: list[tuple[str, Column]] = []
    lo = None
    for n in newer:
        cond = p < n if lo is None else (p > lo) & (p < n)
        segments.append((REPLACE, cond))
        segments.append((NEWER, p == n))
        lo = n
    segments.append((REPLACE, p > lo))

    aggs = []
    for i, (mode, cond) in enumerate(segments):
        order = [priority, *tb] if mode == REPLACE else [ts, *tb]
        aggs.append(pick(order, cols, cond).alias(f"_w{i}"))
    w = layers.groupBy(*key).agg(*aggs)
    # Segment winners as plain rows (their order fields differ in type).
    for i in range(len(segments)):
        wi = F.col(f"_w{i}")
        w = w.withColumn(f"_w{i}", F.when(wi.isNotNull(), F.struct(*unpick(wi, cols))))

    # Fold the segment winners, one projection per step (keeps expressions small).
    w = w.withColumn("_s", F.col("_w0"))
    for i, (mode, _) in enumerate(segments[1:], start=1):
        cur, st = F.col(f"_w{i}"), F.col("_s")
        if mode == REPLACE:
            nxt = F.coalesce(cur, st)
        else:
            nxt = F.when(cur.isNotNull() & (st.isNull() | newer_than(cur[ts], st[ts])), cur).otherwise(st)
        w = w.withColumn("_s", nxt)
    return w.where(F.col("_s").isNotNull()).select(*unpick(F.col("_s"), cols))


def overlay_decisions(layers: DataFrame, key: Sequence[str], priority: str = "priority",
                      tiebreak: Sequence[str] = (), newer: Sequence[int] | Mapping[int, str] = (),
                      ts: str | None = None) -> DataFrame:
    """Every input row with ``won``: the overlay with its losers.

    Winners come from the one-aggregate overlay (partial aggregation). The
    input is reduced to distinct rows with their number (partial as well),
    joined null-safely to its key's winner (a join that adaptive execution can
    split for a hot key), and written out again; of identical copies of the
    winning row one is marked.
    """
    cols = layers.columns
    win = layered_overlay(layers, key, priority, tiebreak, newer, ts)
    win = win.select(*[F.col(f"`{c}`").alias(f"_w_{c}") for c in cols])
    rows = layers.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(f"_w_{k}")) for k in key]
    joined = rows.join(win, on=reduce(lambda a, b: a & b, cond), how="left")
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_w_{c}")) for c in cols])
    return (joined.withColumn("_same", same).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select(*[F.col(f"`{c}`") for c in cols], (F.col("_same") & (F.col("_i") == 1)).alias("won")))


POSITION = ("_file", "_row")


def with_position(df: DataFrame, by_row: bool = True) -> DataFrame:
    """Add ``_file`` and ``_row``, where each row lies in the files that ``df`` scans.

    ``df`` is a scan with projections and filters over it. ``by_row=False`` for
    formats whose files are one row each (``binaryFile``).
    """
    row = F.col("_metadata.row_index") if by_row else F.lit(0).cast("long")
    return df.select("*", F.col("_metadata.file_path").alias("_file"), row.alias("_row"))


def fetch(winners: DataFrame, layers: DataFrame, late: Sequence[str]) -> DataFrame:
    """Join the ``late`` columns of ``layers`` to ``winners`` by position.

    The winners are the side that is hashed; the wide rows stream past it and
    are neither sorted nor aggregated, and where the filter of winners is worth it Spark puts
    one before their exchange. Positions are unique, so there is no hot key.
    """
    wide = layers.select(*POSITION, *[F.col(f"`{c}`") for c in late])
    return winners.hint("shuffle_hash").join(wide, list(POSITION)).drop(*POSITION)


def layered_overlay_late(layers: DataFrame, key: Sequence[str], late: Sequence[str], priority: str = "priority",
                         tiebreak: Sequence[str] = (), newer: Sequence[int] | Mapping[int, str] = (),
                         ts: str | None = None) -> DataFrame:
    """``layered_overlay`` for wide rows: winners are chosen on the narrow columns,
    and the ``late`` ones (contents) are read afterwards, for winners only.

    ``layers`` has positions (``with_position`` on each layer before the union).
    No late column may be a key or order a layer; rows that are tied in all
    other columns are ordered by their position.
    """
    if clash := set(late) & {*key, *tiebreak, priority, ts}:
        raise ValueError(f"late columns {sorted(clash)} take part in the choice")
    narrow = layers.drop(*late)
    win = layered_overlay(narrow, key, priority, tiebreak, newer, ts)
    cols = [c for c in layers.columns if c not in POSITION]
    return fetch(win, layers, late).select(*[F.col(f"`{c}`") for c in cols])


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in ``order`` (ascending; give a total order).

    A ``min`` over a struct aggregates partially before the shuffle, unlike a window.
    Use ``dropDuplicates`` only when any row will do.
    """
    w = df.groupBy(*key).agg(pick(list(order), df.columns, least=True).alias("_w"))
    return w.select(*unpick(F.col("_w"), df.columns))


def flatten_to(df: DataFrame, dir_prefix: str, path: str = "path", mtime: str = "mtime",
               tiebreak: Sequence[str] = ()) -> DataFrame:
    """Put every file directly under ``dir_prefix`` by its base name.

    Equal base names collide; the newer one wins, ties broken by the
    original path then ``tiebreak`` (the reference's order is a hash set's,
    i.e. undefined). The original path is kept as ``source_path``.
    """
    flat = (df.withColumn("source_path", F.col(path))
              .withColumn(path, F.concat(F.lit(dir_prefix), base_name(path))))
    order = [mtime, "source_path", *tiebreak]
    return flat.groupBy(path).agg(pick(order, flat.columns).alias("_w")).select(*unpick(F.col("_w"), flat.columns))
