"""Target-distribution importance resampling, ranked by regular sampling.

Features of a text are its runs of 1 to ``RUN`` consecutive words (A-Z folded,
joined by one space, repeats counted), hashed by CRC-32 into ``BUCKETS``
buckets.  A bucket's gain is the smoothed log ratio of its share in the target
texts to its share in the documents, in thousandths, rounded down.  A
document's weight is the sum of its features' gains, looked up in one array;
its score is the weight plus Gumbel noise from a keyed hash of its id, so the
highest scores are a draw without replacement in proportion to the weights.

Ranks come from parallel sorting by regular sampling.  Each partition of the
written scores is sorted where it lies and gives rows at regular distances;
``segments`` splitters are taken from those; rows are counted by segment;
segments are exchanged, sorted locally, and the counts of the segments before
give exact ranks.  Segments that lie wholly behind the draw keep no rank and are
not exchanged at all.  A row number that is written with the scores ends the
sort key, so keys are unique and equal scores or repeated rows split as well.

Scale: documents are read twice (counts, weights) and never shuffled; what is
shuffled is ``BUCKETS`` counts per task and the narrow rows of the segments
drawn from.  To the driver come ``BUCKETS`` counts of either side,
about ``SAMPLES`` sampled keys at most (they set the balance of the segments, never
the ranks) and one count a segment.  A text is taken in pieces of ``PIECE`` bytes.

Cases: a null or wordless text has no features, weight 0 and is never drawn; an
empty target gives every bucket its share in the documents alone; a null id is
hashed as the empty string and comes first among equal scores; rows that repeat
are ranked one after the other; ties go to the smaller id, then fewer features;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.scratch import written
from strata.llm.textvec import buffers

RUN, BUCKETS = 3, 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
PIECE = 1 << 20
SAMPLES, SAMPLES_A_SEGMENT = 500_000, 256
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a folded text, cut between words about every ``PIECE`` bytes."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        upto = cut.start() if cut else len(text)
        yield WORD.findall(text, at, upto)
        at = upto


def feature_buckets(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) by piece of the text.
    The checksum of a run goes on from that of the run one word shorter."""
    last: list[bytes] = []
    for new in _word_pieces(text.translate(FOLD)):
        words = last + new
        spaced = [b" " + w for w in words]
        sums, found = list(map(crc32, words)), []
        for n in range(RUN):
            found += sums[max(0, len(last) - n):]
            sums = list(map(crc32, spaced[n + 1:], sums))
        last = words[1 - RUN:]
        yield len(new), np.array(found, np.uint32) % np.uint32(BUCKETS)


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, off = buffers(column)
    for i in range(len(off) - 1):
        yield data[off[i]: off[i + 1]].tobytes()


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all ``text`` rows by bucket."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in _texts(b.column(0)):
                for _, at in feature_buckets(text):
                    total += np.bincount(at, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(have: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all = float(have.sum() + BUCKETS), float(wanted.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(have.tolist(), wanted.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id, n_words, n_features, weight`` of every ``id, text`` row."""
    def run(batches):
        for b in batches:
            rows = np.zeros((3, len(b)), np.int64)
            for i, text in enumerate(_texts(b.column(1))):
                for n, at in feature_buckets(text):
                    rows[:, i] += n, len(at), gain[at].sum()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows)], ["id", "n_words", "n_features", "weight"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def _ordered(values) -> tuple:
    """A key that compares, nulls first."""
    return tuple((v is not None, v) for v in values)


def _regular(keys: list[str], step: int):
    """Every ``step``-th row of a sorted run, from half a step on."""
    def run(batches):
        seen = 0
        for b in batches:
            yield b.select(keys).take(pa.array(np.arange((step // 2 - seen) % step, len(b), step)))
            seen += len(b)

    return run


def _segmented(keys: list[str], splitters: list[tuple]):
    def run(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in keys]
            at = [bisect.bisect_right(splitters, _ordered(key)) for key in zip(*cols, strict=True)]
            yield b.append_column("segment", pa.array(at, pa.int32()))

    return run


def _numbered(before: dict[int, int], take: int):
    """Ranks of rows that come sorted by segment and key."""
    def run(batches):
        nth: dict[int, int] = {}
        for b in batches:
            ranks = []
            for s in b.column("segment").to_pylist():
                nth[s] = rank = nth.get(s, before[s]) + 1
                ranks.append(rank if rank <= take else None)
            yield b.append_column("rank", pa.array(ranks, pa.int64()))

    return run


def ranked(rows: DataFrame, keys: list[str], share: tuple[int, int], segments: int | None = None) -> DataFrame:
    """``rows`` with ``rank``: from 1 for the given share of them (rounded down) in
    the order of ``keys`` (ascending,
    nulls first, together unique), null behind.  ``rows`` is a written table
    without columns ``segment`` and ``rank``."""
    spark = rows.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    key_fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = rows.count()
    take = share[0] * n // share[1]
    step = max(1, n // min(SAMPLES, SAMPLES_A_SEGMENT * segments))
    samples = sorted(_ordered(r) for r in rows.select(*keys).sortWithinPartitions(*keys).mapInArrow(_regular(keys, step), key_fields).collect())
    splitters = [samples[len(samples) * i // segments] for i in range(1, segments)] if len(samples) > segments else samples[:segments - 1]
    dealt = written(rows.mapInArrow(_segmented(keys, splitters), fields + ", segment int"), "ranked-segments")
    before, n = {}, 0  # rows in the segments before each that is drawn from
    for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy("segment").collect():  # one row a segment
        if n >= take:
            break
        before[r["segment"]], n = n, n + r["n"]
    front = max(before, default=-1)
    drawn = (dealt.where(F.col("segment") <= front).repartitionById(segments, F.col("segment")).sortWithinPartitions("segment", *keys)
             .mapInArrow(_numbered(before, take), fields + ", segment int, rank long"))
    behind = dealt.where(F.col("segment") > front).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(behind).drop("segment")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, segments: int | None = None) -> DataFrame:
    """``id_col, n_words, n_features, weight, score, rank`` of every row of ``docs``;
    the ``percent`` highest scores among texts of ``min_words`` or more have ranks."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(docs), bucket_counts(target.select(F.col(target_text).cast("string").alias("text"))))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = written(weights(docs, gain).withColumn("score", F.col("weight") + noise)
                     .withColumns({"down": -F.col("score"), "row": F.monotonically_increasing_id()}), "resample-scores")
    able = F.col("n_words") >= min_words
    rows = ranked(scored.where(able), ["down", "id", "n_features", "row"], (percent, 100), segments)
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return rows.unionByName(rest).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum is taken bit by bit: bytes are mixed in, -1 shifts.
SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, text, true AS doc FROM documents UNION ALL SELECT NULL, row_number() OVER (), text, false FROM benchmark),
w AS (SELECT doc_id, row, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
f AS MATERIALIZED (SELECT row, doc, array_to_string(ws[i:i + n - 1], ' ') AS f
      FROM (SELECT row, doc, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) k(n) WHERE len(ws) >= n)),
b AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295] || flatten(list_transform(range(1, octet_length(encode(f)) + 1),
        lambda j: [CAST('0x' || substring(hex(encode(f)), 2 * j - 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM f)),
n AS MATERIALIZED (SELECT row, doc, b, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
c AS (SELECT b, coalesce(sum(n) FILTER (doc), 0) AS s, coalesce(sum(n) FILTER (NOT doc), 0) AS t FROM n GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM c)::DOUBLE + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM c)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM c),
d AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN g USING (b) WHERE doc GROUP BY row),
e AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST('0x' || substring(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
      FROM w LEFT JOIN d USING (row) WHERE doc),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS rank FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 5 // 100 FROM r WHERE n_words >= 20) THEN rank END AS rank FROM r
"""
