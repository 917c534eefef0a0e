"""Benchmark decontamination: winnowing of shared word windows.

Words are runs of letters, digits and non-ASCII characters after A-Z are
lower-cased.  A benchmark item's windows are its runs of ``SPAN`` words; an
item of fewer words (but not none) is one window of all its words.

Winnowing: for a span of L words every k-gram of words is hashed
(k = (L + 1) // 2), and each window of L - k + 1 consecutive k-grams keeps its
minimum.  A window that a document shares with an item has the same minimum in
both, so joining the two fingerprint sets misses no shared span of L words.
Document windows whose fingerprint is a benchmark fingerprint are extended to
their full text and joined with the benchmark windows on that text, so hash
collisions cannot make a hit.

Scale: the document side is hashed and matched row by row.  Benchmark
fingerprints are counted first; up to ``BROADCAST_FINGERPRINTS`` (16 MB) they
are broadcast and documents are not shuffled at all; beyond that, distinct
(document, fingerprint) pairs are joined by shuffle and only matching documents
are read again.  What is shuffled then is the extended hits.  Items are held
once per distinct set of items and once per distinct combination of sets, so a
passage in many items and many documents is not multiplied out.

Cases: a null or wordless text has no words and no hits; rows that repeat
(same id and text) each get their row; null ids are kept; an item with a null
id counts its hits but is not listed; repeated items count once; an empty
benchmark leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.scratch import few, written

SPAN = 13
BROADCAST_FINGERPRINTS = 500_000
BROADCAST_WINDOWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NON_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"  # of texts without A-Z
SENTINEL = -1  # mark of the row that tells a text's size


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``words``, without ``text``."""
    # lower() has a fast path for plain ASCII texts; on others it would change more than A-Z
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    pieces = df.withColumn("pieces", F.split(folded, NON_WORD)).drop(text)
    # only the first and the last piece can be empty
    return (pieces.withColumn("words", F.expr("""slice(pieces, IF(pieces[0] = '', 2, 1), greatest(0, size(pieces)
                - IF(pieces[0] = '', 1, 0) - IF(element_at(pieces, -1) = '', 1, 0)))""")).drop("pieces"))


def _doubled(df: DataFrame, col: str, n: int, combine: str) -> DataFrame:
    """Replace the array ``col`` by ``combine`` over each n neighbours, in
    log2(n) steps: a run of n is two runs of the next lower power of two, which
    may overlap.  The last n - 1 entries are no whole runs; the caller drops them."""
    done = 1
    while done < n:
        shift = min(done, n - done)
        df = df.withColumn(col, F.expr(f"zip_with({col}, slice({col}, {shift + 1}, size({col})), (a, b) -> {combine}(a, b))"))
        done += shift
    return df


def with_fingerprints(df: DataFrame, span: int) -> DataFrame:
    """Add ``mins``: for each window of ``span`` words the minimum k-gram hash
    (null for texts of fewer words).  Needs ``words``.  Callers use the outer
    forms of explode: the plain ones add a filter on the array, which is pushed
    to the scan and computes the whole expression a second time."""
    k = (span + 1) // 2
    df = df.withColumn("mins", F.expr("transform(words, x -> xxhash64(x))"))
    df = _doubled(_doubled(df, "mins", k, "xxhash64"), "mins", span - k + 1, "least")
    return df.withColumn("mins", F.expr(f"CASE WHEN size(words) >= {span} THEN slice(mins, 1, size(words) - {span - 1}) END"))


def _gram(span: int) -> Column:
    return F.expr(f"array_join(slice(words, at + 1, {span}), ' ')").alias("gram")


def find_hits(docs: DataFrame, items: DataFrame, span: int = SPAN,
              broadcast_fingerprints: int = BROADCAST_FINGERPRINTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(hits, sets, sizes)``: hits are ``id, hash, at, span, set_id`` for each
    document window that is a benchmark window; sets are ``set_id, items``; sizes
    are ``id, hash, n_words`` of every document.

    ``docs`` has ``id, text``; ``items`` has ``item_id, text``."""
    listed = words(items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))).where("size(words) > 0")
    listed = written(listed.withColumn("span", F.least(F.size("words"), F.lit(span))), "bench-words")
    spans = [r["span"] for r in listed.select("span").distinct().collect()]  # span values at most
    side, grams = [], []
    for n in sorted(spans):
        own = with_fingerprints(listed.where(F.col("span") == n), n).select("item_id", "words", F.posexplode_outer("mins").alias("at", "mark"))
        grams.append(own.select(F.lit(n).alias("span"), F.col("item_id").cast("string").alias("item"), "mark", _gram(n)))
    base = words(docs.select("id", F.xxhash64("text").alias("hash"), "text"))
    sizes = base.select("id", "hash", F.size("words").alias("n_words"))
    if not grams:
        empty = docs.limit(0).select("id", F.lit(0).cast("long").alias("hash"), F.lit(0).alias("at"), F.lit(0).alias("span"), F.lit("").alias("set_id"))
        return empty, items.limit(0).select(F.lit("").alias("set_id"), F.array(F.lit("")).alias("items")), sizes
    every = grams[0]
    for g in grams[1:]:
        every = every.unionByName(g)
    bench = written(every.groupBy("span", "gram", "mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
                    .withColumn("set_id", F.sha2(F.array_join("items", ","), 256)), "bench-windows")
    sets = bench.select("set_id", "items").dropDuplicates(["set_id"])
    counts = {r["span"]: (r["marks"], r["grams"]) for r in
              bench.groupBy("span").agg(F.countDistinct("mark").alias("marks"), F.count(F.lit(1)).alias("grams")).collect()}
    counted = False
    for n in sorted(spans):
        of_span = bench.where(F.col("span") == n)
        marks = of_span.select("mark").distinct()
        marked = with_fingerprints(base, n)
        if counts[n][0] <= broadcast_fingerprints:
            # a last row for each text meets a mark of its own, so sizes need no second pass
            marks = marks.union(docs.sparkSession.range(1).select(F.lit(SENTINEL).cast("long")))
            every = F.concat(F.coalesce("mins", F.array().cast("array<long>")), F.array(F.lit(SENTINEL).cast("long")))
            near = (marked.select("id", "hash", "words", F.posexplode_outer(every).alias("at", "mark"))
                    .join(F.broadcast(marks), "mark", "left_semi")
                    .select("id", "hash", "at", F.size("words").alias("n_words"), _gram(n)))
            near = written(near, "bench-near")
            last = F.col("at") == F.greatest(F.lit(0), F.col("n_words") - (n - 1))
            if not counted:
                sizes, counted = near.where(last).select("id", "hash", "n_words"), True
            near = near.where(~last)
        else:
            met = (marked.select("id", "hash", F.explode_outer(F.array_distinct("mins")).alias("mark"))
                   .join(marks, "mark", "left_semi").groupBy("id", "hash").agg(F.collect_set("mark").alias("met")))
            again = marked.alias("d").join(met.alias("m"), F.expr("d.id <=> m.id AND d.hash = m.hash"))
            near = (again.select("d.id", "d.hash", "words", F.explode(F.expr(
                "filter(sequence(0, size(mins) - 1), i -> array_contains(met, mins[i]))")).alias("at"))
                .select("id", "hash", "at", _gram(n)))
        known = of_span.select("gram", "set_id")
        if counts[n][1] <= BROADCAST_WINDOWS:
            known = F.broadcast(known)
        side.append(near.join(known, "gram").select("id", "hash", "at", F.lit(n).alias("span"), "set_id"))
    hits = side[0]
    for h in side[1:]:
        hits = hits.unionByName(h)
    return hits, sets, sizes


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", span: int = SPAN,
                  broadcast_fingerprints: int = BROADCAST_FINGERPRINTS, with_hash: bool = False) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` for every
    row of ``docs``: contaminated if a twentieth of its words or more are hit.
    ``with_hash`` adds ``hash``, the xxhash64 of the text (a null one as empty)."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    hits, sets, sizes = find_hits(docs, items, span, broadcast_fingerprints)
    union = """aggregate(array_sort(collected), CAST(named_struct('n', 0, 'upto', 0) AS STRUCT<n: BIGINT, upto: BIGINT>),
        (a, x) -> named_struct('n', a.n + greatest(0L, CAST(x.at + x.span AS BIGINT) - greatest(a.upto, CAST(x.at AS BIGINT))),
                               'upto', greatest(a.upto, CAST(x.at + x.span AS BIGINT)))).n"""
    per_doc = written(hits.groupBy("id", "hash").agg(
        F.collect_set(F.struct("at", "span")).alias("collected"), F.sort_array(F.collect_set("set_id")).alias("combo"))
        .select("id", "hash", F.expr(union).alias("n_hit"), "combo"), "bench-hits")
    listed = (per_doc.select("combo").distinct().select("combo", F.explode("combo").alias("set_id")).join(sets, "set_id")
              .select("combo", F.explode_outer("items").alias("item")).groupBy("combo")
              .agg(F.sort_array(F.collect_set("item")).alias("items"))
              .select("combo", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    found = per_doc.join(listed, "combo").select("id", "hash", "n_hit", "n_items", "items_sha256")
    out = sizes.withColumn("n_words", F.col("n_words").cast("long")).alias("d").join(found.alias("f"), F.expr("d.id <=> f.id AND d.hash = f.hash"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("d.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *([F.col("d.hash")] if with_hash else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated, unchanged.  A document
    is its id (null or not) and its text: of two with one id each has its own verdict."""
    judged = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_hash=True)
    bad = judged.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_of")).distinct()
    bad = few(written(bad, "bench-bad"))
    keyed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
