"""Secret scans: ownership frequency of candidate secrets over the whole corpus.

Candidates come from four patterns (``assign``, ``access``, ``hex`` and, added
by this method, ``owned``: runs of 20 or more key characters with a digit, a
letter and ten different characters that touch no other candidate).  The hash
of each candidate's secret is counted over the corpus by distinct repositories
and owners (``source`` is ``owner/repository`` or just the owner).  A secret
that ``EXAMPLE_OWNERS`` or more owners carry is a copied example; one that
fewer carry looks live.  The three base kinds are always reported with that
verdict; an ``owned`` candidate is reported only if it looks live.

Spans count code points and are found without Python: the pieces between the
matches (``split``) and the matches (``regexp_extract_all``) alternate, so a
running sum of their lengths gives every offset.

Scale: texts are scanned once; candidates are written and read for both the
spans and the counts.  One narrow row per candidate is shuffled, by document for the offsets
and by secret for the counts.  Counting goes over distinct (secret, owner,
repository) with map-side partial steps, so a secret in a third of all rows is
reduced before it is shuffled; the join back is an ordinary shuffle join, which
adaptive execution splits where a secret is hot.

Cases: a null text is empty and has no spans; rows that repeat (same id and
text) each get their row; a null source is one unnamed owner; null ids are
kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.scratch import written

EXAMPLE_OWNERS = 3
KINDS = ("assign", "access", "hex", "owned")
#: Java patterns. For access and hex the length is part of the pattern, which
#: gives the same spans as matching whole runs and dropping the short ones.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}",
    "owned": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
}
ASSIGN_MIN = 8
BLOCK = 4096  # code points that are cut out of a text at once
OWNED_DISTINCT = 10


def _found(kind: str) -> Column:
    """Array of (kind, number, length before, match) for one kind."""
    rx = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all("text", rx, F.lit(0))
    pieces = F.split("text", PATTERNS[kind], -1)
    return F.when(F.size(matches) > 0, F.zip_with(
        F.transform(matches, lambda m, i: F.struct(i.alias("at"), m.alias("match"))), F.slice(pieces, 1, F.size(matches)),
        lambda m, p: F.struct(F.lit(kind).alias("kind"), m["at"].alias("at"), F.char_length(p).alias("gap"), m["match"].alias("match"))))


def candidates(docs: DataFrame) -> DataFrame:
    """``id, hash, source, kind, rank, start, end, secret`` of every candidate of
    ``id, text, source`` rows, once per distinct row."""
    every = [F.coalesce(_found(k), F.array().cast("array<struct<kind:string,at:int,gap:int,match:string>>")) for k in KINDS]
    raw = (docs.where(F.col("text").rlike("|".join(f"(?:{p})" for p in (PATTERNS["assign"], PATTERNS["access"], PATTERNS["hex"], PATTERNS["owned"]))))
           .select("id", F.xxhash64("text", "source").alias("hash"), "source", F.explode_outer(F.concat(*every)).alias("c"))
           .select("id", "hash", "source", "c.*").where("kind IS NOT NULL"))
    # one partitioning serves both windows: all rows of a document
    doc = raw.repartition(F.col("id"), F.col("hash"))
    run = Window.partitionBy("id", "hash", "kind").orderBy("at")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("match")
    spans = (doc.withColumn("again", F.lag("at").over(run).eqNullSafe(F.col("at"))).where("NOT again")
             .withColumn("end", F.sum((F.col("gap") + size).cast("long")).over(upto))
             .withColumn("start", F.col("end") - size))
    secret = F.when(F.col("kind") == "assign", F.regexp_extract("match", PATTERNS["assign"], 1)).otherwise(F.col("match"))
    spans = spans.withColumn("secret", secret).where(
        ((F.col("kind") != "assign") | (F.char_length("secret") >= ASSIGN_MIN))
        & ((F.col("kind") != "owned") | (F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]")
                                         & (F.size(F.array_distinct(F.split("match", ""))) >= OWNED_DISTINCT))))
    line = Window.partitionBy("id", "hash").orderBy("start", "end", "kind")
    base = F.col("kind") != "owned"
    before = F.max(F.when(base, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return (spans.withColumn("free", free).where(base | F.col("free"))
            .select("id", "hash", "source", "kind", rank.alias("rank"), "start", "end", F.sha2("secret", 256).alias("secret")))


def judged(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Candidates with ``n_owners, n_repos, live``; copied ``owned`` ones go."""
    owner = F.coalesce(F.substring_index("source", "/", 1), F.lit(""))
    carriers = found.select("secret", owner.alias("owner"), F.coalesce("source", F.lit("")).alias("repo")).distinct()
    spread = (carriers.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("repos"))
              .groupBy("secret").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos")))
    live = F.col("n_owners") < example_owners
    return (found.join(spread, "secret").withColumn("live", live).where((F.col("kind") != "owned") | F.col("live")))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(rows: str, kind: str) -> Column:
    return F.size(F.filter(rows, lambda s: s["kind"] == kind)).cast("long")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: counts by kind, ``base_sha256``, ``spans`` (all
    spans), ``n_live`` and ``n_example``, and ``found``, the spans as an array, each
    with the numbers of owners and repositories that carry its secret."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    found = written(candidates(docs), "secret-candidates")
    per = (judged(found, example_owners).groupBy("id", "hash")
           .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "live", "n_owners", "n_repos"))).alias("found")))
    base = docs.select("id", F.xxhash64("text", "source").alias("hash"))
    out = base.alias("d").join(per.alias("p"), F.expr("d.id <=> p.id AND d.hash = p.hash"), "left")
    found = F.coalesce("found", F.array().cast(per.schema["found"].dataType))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    out = out.select(F.col("d.id").alias("id"), found.alias("found"))
    return out.select(
        F.col("id").alias(id_col), *(_of_kind("found", k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(F.filter("found", lambda s: s["kind"] != "owned")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"), "found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


def _merged(spans: DataFrame) -> DataFrame:
    """``id, hash, spans``: overlapping spans of a text as one, in order."""
    line = Window.partitionBy("id", "hash").orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (spans.withColumn("new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
                .withColumn("number", F.sum("new").over(upto)))
    return (numbered.groupBy("id", "hash", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("live").alias("live"))
            .groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "live"))).alias("spans")))


def _masked(text: str, spans: str) -> tuple[Column, Column]:
    """The text's ``_blocks``, and from them the text with each span replaced.  It is cut into blocks once, so that a
    piece between two spans is taken from its own blocks and the work is linear."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(begin: Column, end: Column) -> Column:
        i, j = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        own = F.array_join(F.slice("_blocks", i + 1, j - i + 1), "")
        return F.substring(own, (begin % BLOCK + 1).cast("int"), (end - begin).cast("int"))

    end_of = lambda i: F.coalesce(F.get(spans, i)["end"], F.lit(0).cast("long"))
    label = lambda x: F.when(x["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))
    parts = F.transform(spans, lambda x, i: F.concat(piece(end_of(i - 1), x["start"]), label(x)))
    tail = piece(F.element_at(spans, -1)["end"], F.char_length(text).cast("long"))
    return blocks, F.concat(F.array_join(parts, ""), tail)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; each span (overlapping ones as one)
    becomes ``[SECRET]`` if one of its secrets looks live, else ``[EXAMPLE]``,
    and ``n_chars`` follows.  Texts without spans are unchanged."""
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "source")
    per = _merged(judged(written(candidates(own), "secret-candidates")).select("id", "hash", "start", "end", "live"))
    per = per.select(F.col("id").alias("_id"), F.col("hash").alias("_of"), F.col("spans").alias("_spans"))
    keyed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit("")), F.col("source")).alias("_hash"))
    rows = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left")
    blocks, masked = _masked("text", "_spans")
    some = F.col("_spans").isNotNull()
    rows = rows.withColumn("_blocks", F.when(some, blocks)).withColumn("_masked", F.when(some, masked))
    changed = {"text": F.when(some, F.col("_masked")).otherwise(F.col("text")),
               "n_chars": F.when(some, F.char_length("_masked").cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
k(kind, rank, rx) AS (VALUES
  ('assign', 1, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 2, 'AKIA[A-Z0-9]{12,}'), ('hex', 3, '[0-9a-f]{32,}'), ('owned', 4, '[A-Za-z0-9+/_=-]{20,}')),
m AS (SELECT doc_id, source, kind, rank, rx, regexp_extract_all(text, rx) AS ms, string_split_regex(text, rx) AS ps FROM d, k),
c AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, source, kind, rank, ms[i] AS match, CASE WHEN kind = 'assign' THEN regexp_extract(ms[i], rx, 1) ELSE ms[i] END AS secret,
         CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM c),
f AS (
  SELECT *, start + length(match) AS stop FROM s
  WHERE (kind <> 'assign' OR length(secret) >= 8)
    AND (kind <> 'owned' OR (regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AND len(list_distinct(string_split(match, ''))) >= 10))),
b AS (SELECT * FROM f WHERE kind <> 'owned'
      UNION ALL SELECT o.* FROM f o WHERE kind = 'owned' AND NOT EXISTS (
        SELECT 1 FROM f x WHERE x.kind <> 'owned' AND x.doc_id = o.doc_id AND x.start < o.stop AND o.start < x.stop)),
w AS (SELECT secret, count(DISTINCT split_part(coalesce(source, ''), '/', 1)) < 3 AS live FROM b GROUP BY secret),
j AS (SELECT b.*, live, kind || ':' || start || ':' || stop AS span FROM b JOIN w USING (secret) WHERE kind <> 'owned' OR live),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'owned'), '')) AS base_sha256,
         string_agg(span, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id)
"""
