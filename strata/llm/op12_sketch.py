"""Document fingerprints: threshold-scaled sketches of word shingles.

Words are runs of letters, digits and non-ASCII characters with A-Z folded.
Every run of ``SHINGLE`` words (one run of all words in a shorter text) is hashed
to 64 bits, and every distinct hash below 1/``SCALE`` of the range is retained.  So a
sketch grows with its text, the sketch of a union is the union of sketches
(``merged``), and the share of the smaller sketch that lies in the larger estimates how much
of one text is contained in the other, however unequal they are.  A text none of
whose hashes lies below the bound keeps its least one, so no text with words
has an empty sketch.

``against_next`` compares each text with the next one by descending id, and with
an edited version of itself, whose last third is the beginning of that next text.
Neighbours are found without a global sort: keys (id, hash of the text) that
are sampled by their hash cut the id range into chunks, each of which begins
with such a key; the row that begins a chunk is also sent to the chunk before it
as a guest, so that every chunk has the neighbours of all its rows.

Scale: only built-in functions.  Each text is shuffled once, by chunk; the
sampled keys (about ``SAMPLES``, they set the balance of chunks and nothing else)
are all that reaches the driver.  Copies of one (id, text) in more than a chunk's share of
rows are counted before the shuffle and sent once; the first of k copies
have one another as neighbours, so their results are repeated from one row.

Cases: a null text is empty; empty and wordless texts have the empty sketch,
which is like itself (1) and like no other (0); equal ids are ordered by their
texts' hashes, descending, and null ids come last; rows that repeat get a row
each; the only row is its own neighbour; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.op2_winnow import LOWER, NON_WORD, UPPER
from strata.llm.scratch import written

SHINGLE, SCALE = 5, 8
SAMPLES = 100_000
HOT_COPIES = 1000


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Add the sketch of column ``text``: sorted hashes of 16 hex digits."""
    plain = F.octet_length(text) == F.char_length(text)  # lower() would change more than A-Z in others
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    df = df.withColumn("_words", F.array_remove(F.split(folded, NON_WORD), ""))
    run = lambda i: F.concat_ws(" ", *(F.get("_words", i + j) for j in range(shingle)))
    at = F.sequence(F.lit(0), F.greatest(F.size("_words"), F.lit(shingle)) - shingle)
    df = df.withColumn("_hashes", F.when(F.size("_words") > 0, F.transform(at, lambda i: F.substring(F.md5(run(i)), 1, 16)))
                       .otherwise(F.array().cast("array<string>"))).drop("_words")
    bound = f"{(1 << 64) // scale:016x}" if scale > 1 else "g"
    df = df.withColumn("_kept", F.sort_array(F.array_distinct(F.filter("_hashes", lambda h: h < bound))))
    least = F.filter(F.array(F.array_min("_hashes")), lambda h: h.isNotNull())
    return df.withColumn(name, F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(least)).drop("_hashes", "_kept")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller shingle set that lies in the larger."""
    less = F.least(F.size(a), F.size(b))
    return F.when(less > 0, F.size(F.array_intersect(a, b)) / less).otherwise((F.size(a) == F.size(b)).cast("double"))


def _cut(rows: DataFrame, chunks: int, n: int) -> tuple[Column, int]:
    """An array of ascending keys, the last of them the greatest of ``rows``, and its size."""
    every = max(1, n // SAMPLES)
    keys = rows.select(F.struct("id", "hash").alias("key"))
    sample = [r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).distinct().orderBy("key").collect()]
    last = keys.agg(F.max("key").alias("key")).first()["key"]
    cuts = [sample[len(sample) * i // chunks] for i in range(1, chunks)] if len(sample) > chunks else sample
    cuts = [k for i, k in enumerate(cuts) if (i == 0 or k != cuts[i - 1]) and k != last] + [last]
    kind = keys.schema["key"].dataType.simpleString()
    text = json.dumps([k.asDict() for k in cuts], default=str)
    return F.from_json(F.lit(text), f"array<{kind}>"), len(cuts)  # folded to one constant


def with_next(rows: DataFrame, chunks: int | None = None, hot_copies: int = HOT_COPIES) -> DataFrame:
    """``id, hash, text`` rows and their other columns, each with ``next``: a struct of the columns of
    the row that follows by descending (id, hash), of the first after the last.  ``rows`` must give
    the same rows when it is read again."""
    spark, cols = rows.sparkSession, rows.columns
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = written(rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("copies")), "sketch-keys")
    size = keys.agg(F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("rows")).first()
    if not size["keys"]:
        return rows.withColumn("next", F.struct(*cols))
    hot = written(keys.where(F.col("copies") > max(hot_copies, size["rows"] // chunks)), "sketch-hot")  # fewer than chunks
    some_hot = not hot.isEmpty()
    one = rows.withColumn("copies", F.lit(1).cast("long"))
    if some_hot:
        same = F.expr("r.id <=> h.id AND r.hash = h.hash")
        several = (rows.alias("r").join(F.broadcast(hot).alias("h"), same).select("r.*", "h.copies").dropDuplicates(["id", "hash"]))
        one = one.alias("r").join(F.broadcast(hot).alias("h"), same, "left_anti").unionByName(several)
    cuts, n = _cut(keys, chunks, size["keys"])
    key = F.struct("id", "hash")
    # how many cuts lie before the key: one bit a step
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(n.bit_length()))))
    chunk = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(cuts, at + s - 1) < key), at + s).otherwise(at))
    dealt = one.withColumn("chunk", chunk)
    home = F.struct("chunk", F.lit(0).alias("guest"))
    abroad = F.struct(((F.col("chunk") + 1) % n).alias("chunk"), F.lit(1).alias("guest"))
    dealt = (dealt.withColumn("to", F.explode(F.when(F.get(cuts, F.col("chunk")) == key, F.array(home, abroad)).otherwise(F.array(home))))
             .drop("chunk").select(*cols, "copies", "to.chunk", "to.guest"))
    line = Window.partitionBy("chunk").orderBy("guest", F.col("id").desc_nulls_last(), F.col("hash").desc())
    found = dealt.repartition(chunks, "chunk").withColumn("next", F.lead(F.struct(*cols)).over(line)).where("guest = 0")
    if some_hot:
        follows = F.array(F.struct("next", F.lit(1).cast("long").alias("times")), F.struct(F.struct(*cols).alias("next"), (F.col("copies") - 1).alias("times")))
        found = (found.select(*cols, F.explode(follows).alias("f")).where("f.times > 0")
                 .select(*cols, "f.next", F.explode(F.sequence(F.lit(1).cast("long"), "f.times")).alias("_")))
    return found.select(*cols, "next")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE,
                 chunks: int | None = None, hot_copies: int = HOT_COPIES) -> DataFrame:
    """``id_col, n_chars, sketch, edited`` (the text)``, edited_sketch, next_sketch``
    of every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_sketch(rows.select("id", F.md5("text").alias("hash"), "text"), "text", "sketch", shingle, scale)
    found = with_next(rows, chunks, hot_copies)
    n = F.char_length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring("next.text", F.lit(1), third))
    found = found.select("id", n.alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    found = with_sketch(found, "edited", "edited_sketch", shingle, scale)
    return found.select(F.col("id").alias(id_col), "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("sketch", ",").alias("fingerprint"),
                      F.array_join("edited_sketch", ",").alias("edited_fingerprint"), containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                      containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER w AS nth, lead(text) OVER w AS after, first_value(text) OVER w AS first_text
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT nth, doc_id, text, CASE WHEN after IS NULL THEN first_text ELSE after END AS follows, length(text) AS n_chars, length(text) // 3 AS third FROM o),
e AS (SELECT *, substring(text, 1, n_chars - third) || substring(follows, 1, third) AS edited FROM n),
t AS (SELECT nth, 'own' AS kind, text FROM e UNION ALL SELECT nth, 'edited', edited FROM e UNION ALL SELECT nth, 'follows', follows FROM e),
w AS (SELECT nth, kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
h AS (SELECT nth, kind, md5(array_to_string(ws[i:i + 4], ' '))[1:16] AS h
      FROM (SELECT nth, kind, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
k AS (SELECT nth, kind, coalesce(list_sort(list_distinct(list(h) FILTER (h < '2000000000000000'))), [min(h)]) AS sketch FROM h GROUP BY nth, kind),
s AS (SELECT nth, coalesce(any_value(sketch) FILTER (kind = 'own'), []) AS own, coalesce(any_value(sketch) FILTER (kind = 'edited'), []) AS edited_sketch,
             coalesce(any_value(sketch) FILTER (kind = 'follows'), []) AS next_sketch
      FROM e LEFT JOIN k USING (nth) GROUP BY nth),
c AS (SELECT *, least(len(own), len(edited_sketch)) AS m_edited, least(len(own), len(next_sketch)) AS m_next FROM s)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, ',') AS fingerprint, array_to_string(edited_sketch, ',') AS edited_fingerprint,
       CASE WHEN m_edited > 0 THEN len(list_intersect(own, edited_sketch)) / m_edited ELSE CAST(len(own) = len(edited_sketch) AS DOUBLE) END AS near_edited,
       CASE WHEN m_next > 0 THEN len(list_intersect(own, next_sketch)) / m_next ELSE CAST(len(own) = len(next_sketch) AS DOUBLE) END AS near_next
FROM e JOIN c USING (nth)
"""
