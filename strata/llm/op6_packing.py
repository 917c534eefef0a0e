"""Packing: optimal length buckets and token-budget batches.

Lengths are counted into a global histogram; dynamic programming over it picks
the at most ``BUCKETS`` bucket lengths that minimise padding when each text is
padded to its bucket's length.  Inside a bucket, texts are numbered and a batch
takes as many as fit ``BUDGET`` padded tokens (one at least).

Scale: the histogram has a cell for each length that occurs, so the bounds are
optimal, not rounded.  Texts of d different lengths have d * d / 2 tokens or more,
so even 100 TB (some 2.5e13 tokens) give 7 million cells at most, which reach the
driver as two Arrow columns; real corpora have some 1e5.  A cost that is linear in
the bound lets each bucket be added in one pass over a convex hull instead of
over all pairs of lengths, in whole numbers.  Numbering takes no global sort: each bucket is dealt over lanes by a hash, rows are numbered inside a lane, and
a lane starts at the sum of the lanes before it (one small row per lane).

Cases: a null or empty text has no tokens and forms its own bucket of length 0
in batches of ``BUDGET`` texts; a text longer than the budget has a batch of its
own; rows that repeat each get a place; null ids are kept; an empty table gives
no rows; further columns are ignored.  Ties are dealt by id, then by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.scratch import written

BUCKETS = 16
BUDGET = 65_536
LANE_ROWS = 100_000
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"


def token_count(text: Column) -> Column:
    """Words and single symbols: the pieces that subword tokenizers start from."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Bucket lengths of least padding for (length, count, token sum) cells in
    order of length; the fewest buckets among equals.

    With the last bucket after cell i and up to cell j the padding is
    ``best[i] + s[i] - top[j] * n[i]`` and terms of j alone: the least of lines in
    ``top[j]``, found on the lower hull of the points (n[i], best[i] + s[i])."""
    if not cells:
        return []
    top, count, total = (np.array(x, np.int64) for x in zip(*cells, strict=True))
    n = np.concatenate([[0], np.cumsum(count)])
    s = np.concatenate([[0], np.cumsum(total)])
    m = len(top)
    best, back, costs = np.zeros(1, np.int64), [], []
    for _ in range(min(buckets, m)):
        hull: list[tuple[int, int, int]] = []
        for i, (x, y) in enumerate(zip(n[:len(best)].tolist(), (best + s[:len(best)]).tolist(), strict=True)):
            while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (x - hull[-1][0]) >= (y - hull[-1][1]) * (hull[-1][0] - hull[-2][0]):
                hull.pop()
            hull.append((x, y, i))
        steeper = np.array([(q[1] - p[1]) // (q[0] - p[0]) for p, q in zip(hull, hull[1:])], np.int64)
        frm = np.array([h[2] for h in hull], np.int64)[np.searchsorted(steeper, top, "left")]
        # a line of i = j means no further bucket
        best = np.concatenate([[0], best[frm] + top * (n[1:] - n[frm]) - (s[1:] - s[frm])])
        back.append(frm)
        costs.append(int(best[m]))
    k, j, out = int(np.argmin(costs)), m, []
    while j > 0:
        i = int(back[k][j - 1])
        if i < j:
            out.append(int(top[j - 1]))
        j, k = i, k - 1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, buckets: int = BUCKETS,
         budget: int = BUDGET, lane_rows: int = LANE_ROWS) -> DataFrame:
    """``id_col, n_tokens, bucket_len, batch, place, padding``: the text's batch
    within its bucket and its place there."""
    tokens = token_count(F.col("text")) if tokens is None else tokens
    sized = written(docs.select(F.col(id_col).alias("id"), tokens.alias("n_tokens"), F.xxhash64("text").alias("hash")), "pack-lengths")
    hist = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    cells = [(t, n, t * n) for t, n in zip(hist["n_tokens"].to_pylist(), hist["n"].to_pylist(), strict=True)]
    zero = [c for c in cells if c[0] == 0]
    bounds = [0] * bool(zero) + boundaries([c for c in cells if c[0] > 0], buckets)
    rows = sum(c[1] for c in cells)
    # enough lanes for the row count, and for all tasks of a shuffle to have work
    lanes = max(-(-rows // lane_rows), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = F.lit(None).cast("long")
    for b in reversed(bounds):
        size = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(size)
    dealt = sized.withColumn("bucket_len", size).withColumn("lane", F.pmod(F.xxhash64("id", "hash"), F.lit(lanes)).cast("int"))
    loads = dealt.groupBy("bucket_len", "lane").agg(F.count(F.lit(1)).alias("n"))
    starts = loads.withColumn("before", F.sum("n").over(Window.partitionBy("bucket_len").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("bucket_len", "lane").orderBy(F.xxhash64("id", "hash"), "id", "hash"))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    numbered = (dealt.withColumn("number", number).join(starts.drop("n"), ["bucket_len", "lane"])
                .withColumn("number", F.col("number") - 1 + F.coalesce("before", F.lit(0))))
    return numbered.select(
        F.col("id").alias(id_col), "n_tokens", "bucket_len", F.floor(F.col("number") / per_batch).cast("long").alias("batch"),
        (F.col("number") % per_batch).cast("long").alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the places of all documents."""
    return pack(docs)
