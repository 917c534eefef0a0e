"""N-gram Jaccard join: MinHash candidates pruned by their Bayesian posterior.

Words are runs of letters, digits and non-ASCII characters with A-Z folded.  A
text's set is that of its ``SHINGLE``-word shingles (a shorter text: one shingle
of all its words).  Texts are linked if the Jaccard similarity of their sets is
``THRESHOLD`` or more; a class is a connected component of links, and its id the
least ``doc_id`` in it.

1. Each text gets a key (digest of its words) and ``HASHES`` MinHash values, of
   which 16 bits each are kept: unequal values agree in them by chance once in
   65,536, far below what bands and posterior allow for.
   Equal keys are one text from here on; copies cost one row each.
2. ``BANDS`` bands of ``ROWS`` values give buckets: a pair at the threshold
   shares none with probability 5e-8.
3. Every text in a bucket is compared with the bucket's leader (the least key,
   which leads most buckets of a large group): rows grow with the group, not
   with its square.
4. Candidates are compared ``STEP`` MinHash values at a time; after each step a
   pair whose posterior probability of reaching the threshold (uniform prior)
   is under ``TOLERANCE`` is dropped.  The rest are verified exactly on their
   shingle sets.
5. Pairs in a bucket that the links so far do not connect, and that were not
   compared in 3, are swept block by block inside tasks with the same pruning;
   only survivors become rows, and they are verified too.  A first sweep keeps
   the likeliest pair of each two components, which joins most of what belongs
   together; the second keeps every pair that is left.  So each pair of
   different texts that shares a bucket is compared unless a chain of links
   already joins it.
6. Components by alternating large-star and small-star steps on the links.
7. Every link lies inside a class, so ``n_links`` is counted there: all pairs of
   different texts of a class are compared exactly, bands and posterior aside.
   Each set is written as its difference from the set of the class's first text:
   what two sets share follows from the shingles that both add or both lack.
   Classes are dealt in blocks of ``LINK_BLOCKS * BLOCK`` texts and about
   ``BLOCK_SHINGLES`` differing shingles; tasks emit a count for each text of a
   pair of blocks, not pairs.

``n_links`` is the number of other texts at the threshold or above to a
document's text.  The comparisons of step 7 grow with the square of a class, and
its differences (not its sets) are sent once for each of its blocks.

Cases: a null or wordless text has no shingles and is a class of its own, with
its own id.  Rows that repeat are copies of one text.  A null id stays null and
takes the class id of its text's other documents (null if none has one).  An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.scratch import few, written
from strata.llm.textvec import buffers, row_groups, shingles, words

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BANDS, ROWS = 256, 32, 4  # the bands take the first 128 values
STEP = 16
TOLERANCE = 1e-3
BLOCK = 1024
LINK_BLOCKS = 8
BLOCK_SHINGLES = 1 << 19
BROADCAST_IDS = 100_000
_RNG = np.random.RandomState(7)
_MUL = _RNG.randint(0, 1 << 62, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.randint(0, 1 << 62, HASHES).astype(np.uint64)


def minhash(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signatures (rows x HASHES, uint16) of rows of shingle hashes, none empty.

    The least of 64-bit values is taken and its bits 16 to 31 are kept, which are
    as good as random however many shingles a text has."""
    out = np.empty((len(off) - 1, HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(h * _MUL[k] + _ADD[k], off[:-1]) >> np.uint64(16)
    return out


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of n at which the posterior of similarity >= threshold
    is at least ``tolerance``: P(Binomial(n + 1, threshold) <= m), uniform prior."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


LEAST = {n: least_matches(n) for n in range(STEP, HASHES + 1, STEP)}


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of the signature pairs that incremental comparison keeps."""
    alive, same = np.arange(len(a)), np.zeros(len(a), int)
    for n in range(STEP, HASHES + 1, STEP):
        same = same + (a[alive, n - STEP: n] == b[alive, n - STEP: n]).sum(axis=1)
        keep = same >= LEAST[n]
        alive, same = alive[keep], same[keep]
    return alive


def _matrix(col: pa.Array) -> np.ndarray:
    if not len(col):
        return np.zeros((0, HASHES), np.uint16)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), HASHES)


def _sign(batches):
    for b in batches:
        data, off = buffers(b.column("text"))
        for i, j in row_groups(off, 1 << 20):
            keys, sigs = [], []
            h, at, _, _ = words(data, off[i: j + 1])
            s, to = shingles(h, at, SHINGLE)
            full = np.flatnonzero(np.diff(to))
            own = dict(zip(full.tolist(), minhash(s, np.append(to[full], to[-1])) if len(full) else [], strict=True))
            for r in range(j - i):
                keys.append(hashlib.blake2b(h[at[r]: at[r + 1]].tobytes(), digest_size=16).digest() if r in own else None)
                sigs.append(own[r].tobytes() if r in own else None)
            yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                             ["id", "key", "sig"])


def _sets(batches):
    """(key, set) of texts: distinct shingle hashes; with a wanted key, only of
    the text that has it."""
    for b in batches:
        data, off = buffers(b.column("text"))
        want = b.column("want").to_pylist()
        for i, j in row_groups(off, 1 << 22):
            h, at, _, _ = words(data, off[i: j + 1])
            s, to = shingles(h, at, SHINGLE)
            keys, sets = [], []
            for r in range(j - i):
                key = hashlib.blake2b(h[at[r]: at[r + 1]].tobytes(), digest_size=16).digest()
                if to[r + 1] > to[r] and want[i + r] in (None, key):
                    keys.append(key)
                    sets.append(np.unique(s[to[r]: to[r + 1]]).view(np.int64))
            sizes = pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32())
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(sizes, flat)], ["key", "set"])


def _prune(batches):
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            keep = survivors(_matrix(part.column("sa")), _matrix(part.column("sb")))
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _swept(keys, comps, sides, leaders, sigs, band, best):
    """Surviving pairs of one group of block members, sorted by key, that have
    different components and no leader in them.  Blocks of two sides compare
    across only; a pair that shares an earlier band is left to that.  With ``best``, one pair for each pair of components: that of
    most equal values."""
    n, top = len(keys), {}
    for i in range(n - 1):
        if keys[i] == leaders[i]:
            continue
        rest = np.flatnonzero(comps[i + 1:] != comps[i]) + i + 1
        if sides is not None:
            rest = rest[sides[rest] != sides[i]]
        if not len(rest):
            continue
        rest = rest[survivors(np.broadcast_to(sigs[i], (len(rest), HASHES)), sigs[rest])]
        earlier = (sigs[rest, : band * ROWS] == sigs[i, : band * ROWS]).reshape(len(rest), band, ROWS).all(axis=2).any(axis=1)
        rest = rest[~earlier]
        same = (sigs[rest] == sigs[i]).sum(axis=1)
        for j, m in zip(rest.tolist(), same.tolist(), strict=True):
            if keys[j] == leaders[j]:
                continue
            both = (min(comps[i], comps[j]), max(comps[i], comps[j])) if best else (i, j)
            if m > top.get(both, (-1,))[0]:
                top[both] = (m, (keys[i], keys[j]) if keys[i] < keys[j] else (keys[j], keys[i]))
    return [pair for _, pair in top.values()]


def _sweep(best: bool):
    """Rows come sorted by (bucket, x, y): hold one group at a time."""
    def done(t: pa.Table):
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        comps = np.unique(np.array(t.column("comp").to_pylist(), object), return_inverse=True)[1]
        sides = np.array(t.column("block").to_pylist()) if x != y else None
        return _swept(t.column("key").to_pylist(), comps, sides, t.column("leader").to_pylist(), _matrix(t.column("sig").combine_chunks()),
                      t.column("band")[0].as_py(), best)

    def emit(pairs):
        pairs = list(dict.fromkeys(pairs))
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            ids = np.stack([t.column(c).to_numpy() for c in ("bucket", "x", "y")])
            pairs, frm = [], 0
            for c in np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1:
                pairs += done(t.slice(frm, c - frm))
                frm = int(c)
            held = t.slice(frm).to_batches()
            if pairs:
                yield emit(pairs)
        if held and (pairs := done(pa.Table.from_batches(held))):
            yield emit(pairs)

    return run


def swept(together: DataFrame, reps: DataFrame, roots: DataFrame, best: bool, block: int) -> DataFrame:
    """Candidate pairs (a, b) inside buckets, across the components in ``roots``."""
    crowd = (together.where("n > 2").join(roots, "key", "left")
             .select("bucket", "band", "key", "leader", "n", F.coalesce("root", "key").alias("comp")))
    open_ = crowd.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    dealt = (crowd.join(open_, "bucket", "left_semi").join(reps, "key")
             .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "band", "block", "key", "leader", "comp", "sig"))
    return (dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "key")
            .mapInArrow(_sweep(best), "a binary, b binary").distinct())


def pruned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that the posterior does not rule out."""
    a, b = (reps.select(F.col("key").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_prune, "a binary, b binary")


def with_sets(pairs: DataFrame, docs: DataFrame, members: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """``have`` (key, set) and the sets of the texts in ``pairs`` that it lacks."""
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    if have is not None:
        needed = needed.join(have.select("key"), "key", "left_anti")
    # one document of each text: its least id, and how many rows have both
    holders = (members.join(needed, "key").groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("one")).select("key", "one.id", "one.n"))
    holders = written(holders, "near-holders")
    held = holders.groupBy("id").agg(F.min("key").alias("want"), (F.count(F.lit(1)) + F.max("n") == 2).alias("one_row"))
    plain = held.where("id IS NOT NULL AND one_row").select(F.col("id").alias("held"), "want")
    others = held.where("id IS NULL OR NOT one_row").select(F.col("id").alias("held"))
    small = holders.count() <= BROADCAST_IDS  # else by shuffle
    # an id that stands for one row gives its set as it is read
    sets = (docs.join(F.broadcast(plain) if small else plain, F.col("id") == F.col("held")).select("text", "want")
            .mapInArrow(_sets, "key binary, set array<long>"))
    if not others.isEmpty():
        keys = holders.join(others, F.col("id").eqNullSafe(F.col("held")), "left_semi").select("key")
        texts = docs.join(F.broadcast(others) if small else others, F.col("id").eqNullSafe(F.col("held")), "left_semi")
        more = texts.select("text", F.lit(None).cast("binary").alias("want")).mapInArrow(_sets, "key binary, set array<long>")
        sets = sets.unionByName(more.join(keys, "key", "left_semi").dropDuplicates(["key"]))
    sets = written(sets, "near-sets")
    return sets if have is None else have.unionByName(sets)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose shingle sets are similar enough, with ``jaccard``."""
    a, b = (sets.select(F.col("key").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(a, "a").join(b, "b").select("a", "b", (both / (F.size("set_a") + F.size("set_b") - both)).alias("jaccard"))
            .where(F.col("jaccard") >= threshold))


def links_of(sizes: np.ndarray, kept: np.ndarray, first: int, counts: np.ndarray, flat: np.ndarray, near_side: int | None,
             threshold: float) -> np.ndarray:
    """For each of some sets, to how many others it is similar enough; with
    ``near_side``, the first so many sets against the rest.

    ``flat`` has their differences from a set of ``first`` shingles end to end,
    ``counts`` of each; ``kept`` is what each shares with that set."""
    n = len(sizes)
    out = np.zeros(n, np.int64)
    _, code, holders = np.unique(flat, return_inverse=True, return_counts=True)
    shared = holders[code] > 1
    rows, code = np.repeat(np.arange(n), counts)[shared], code[shared]
    at = np.searchsorted(rows, np.arange(n + 1))
    mark = np.zeros(len(holders), bool)
    for i in range(n if near_side is None else near_side):
        lo = i + 1 if near_side is None else near_side
        if lo == n:
            break
        both = kept[i] + kept[lo:] - first
        own = code[at[i]: at[i + 1]]
        if len(own):
            mark[own] = True
            same = np.concatenate([[0], np.cumsum(mark[code[at[lo]:]])])
            mark[own] = False
            both = both + np.diff(same[at[lo:] - at[lo]])
        linked = both / (sizes[i] + sizes[lo:] - both) >= threshold
        out[lo:] += linked
        out[i] += linked.sum()
    return out


def _links(threshold: float):
    """Rows come sorted by (bucket, x, y, block): hold one group at a time."""
    def done(t: pa.Table):
        less, more = (pa.concat_arrays(t.column(c).chunks) for c in ("less", "more"))
        n_less, n_more = (np.diff(x.offsets.to_numpy()) for x in (less, more))
        first = t.column("first")[0].as_py()
        # a shingle of the first set can only be lacked, another only be added, so one array holds both
        order = np.argsort(np.concatenate([np.repeat(np.arange(len(x)), x) for x in (n_less, n_more)]), kind="stable")
        flat = np.concatenate([less.flatten().to_numpy(), more.flatten().to_numpy()])[order]
        side = None
        if t.column("x")[0].as_py() != t.column("y")[0].as_py():
            side = int((t.column("block").to_numpy() == t.column("x")[0].as_py()).sum())
        n = links_of(first - n_less + n_more, first - n_less, first, n_less + n_more, flat, side, threshold)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(t.column("key").chunks), pa.array(n)], ["key", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            ids = np.stack([t.column(c).to_numpy() for c in ("bucket", "x", "y")])
            frm = 0
            for c in np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1:
                yield done(t.slice(frm, c - frm))
                frm = int(c)
            held = t.slice(frm).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def degrees(roots: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``key, n_links`` for every key in ``roots``: all pairs inside components."""
    firsts = roots.select("root").distinct().join(sets.select(F.col("key").alias("root"), F.col("set").alias("base")), "root")
    differing = written(roots.join(sets, "key").join(firsts, "root").select(
        "key", "root", F.size("base").alias("first"), F.array_except("base", "set").alias("less"), F.array_except("set", "base").alias("more")), "near-differing")
    whole = differing.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("less") + F.size("more")).alias("shingles"))
    sized = differing.join(whole, "root")
    blocks = F.ceil(F.greatest(F.col("n") / (LINK_BLOCKS * block), F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = (sized.where("n > 2").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select(F.xxhash64("root").alias("bucket"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "key",
                     "first", "less", "more"))
    counted = (dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "block")
               .mapInArrow(_links(threshold), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n_links")))
    return counted.unionByName(sized.where("n = 2").select("key", F.lit(1).cast("long").alias("n_links")))


def components(links: DataFrame) -> DataFrame:
    """``key, root`` (the least key) for every key in links (a, b)."""
    u, v = F.col("u"), F.col("v")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(u != v).distinct(), "near-edges")
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = written(small.select(v.alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where(u != v).distinct(), "near-edges")
        # done when all are stars: nothing points to two nodes, nothing that points is pointed to
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(v.alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out = 1 AND in = 1)").isEmpty():
            break
    return edges.select(u.alias("key"), v.alias("root")).unionByName(edges.select(v.alias("key"), v.alias("root")).distinct())


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                 block: int = BLOCK, counts: bool = True) -> DataFrame:
    """``id_col, class_id, n_links, text_key`` for every row of ``docs``; without
    ``counts``, ``n_links`` is null and step 7 is left out."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    signed = written(docs.mapInArrow(_sign, f"id {id_type}, key binary, sig binary"), "near-signed")
    members = signed.select("id", "key")
    reps = written(signed.where("key IS NOT NULL").select("key", "sig").dropDuplicates(["key"]), "near-texts")
    bands = reps.select("key", F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> substring(sig, i * {2 * ROWS} + 1, {2 * ROWS}))")).alias("band", "part"))
    bands = bands.select(F.xxhash64("band", "part").alias("bucket"), "band", "key")
    full = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("leader")).where("n > 1")
    together = written(bands.join(full, "bucket"), "near-buckets")
    # from here on only texts that share a bucket matter
    reps = written(reps.join(together.select("key").distinct(), "key", "left_semi"), "near-busy")
    star = together.where("key != leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    kept = written(pruned(star, reps), "near-pairs")
    sets = with_sets(kept, docs, members)
    links = written(verified(kept, sets, threshold), "near-links")
    roots = written(components(links), "near-roots")
    for best in (True, False):
        more = written(swept(together, reps, roots, best, block).join(kept, ["a", "b"], "left_anti"), "near-pairs")
        kept = kept.unionByName(more)
        sets = with_sets(more, docs, members, sets)
        links = links.unionByName(written(verified(more, sets, threshold), "near-links"))
        roots = written(components(links), "near-roots")
    first = members.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"))
    linked = written(first.join(roots, "key"), "near-linked")
    least_id = linked.groupBy("root").agg(F.min("first").alias("class_id"))
    classed = linked.join(least_id, "root").select("key", "class_id")
    texts = first.join(classed, "key", "left").select("key", F.coalesce("class_id", "first").alias("class_id"))
    none = F.lit(0 if counts else None).cast("long")
    if counts:
        texts = texts.join(written(degrees(roots, sets, threshold, block), "near-degrees"), "key", "left").withColumn("n_links", F.coalesce("n_links", none))
    else:
        texts = texts.withColumn("n_links", none)
    out = members.where("key IS NOT NULL").join(texts, "key").select("id", "class_id", "n_links", F.hex("key").alias("text_key"))
    alone = members.where("key IS NULL").select("id", F.col("id").alias("class_id"), none.alias("n_links"), F.lit(None).cast("string").alias("text_key"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least id, unchanged.

    Of rows that repeat it with one text, one stays; a repeated id with several
    texts stays if one of them does.  Documents without an id stay."""
    judged = written(near_classes(docs, counts=False).where("doc_id IS NOT NULL").groupBy("doc_id")
                     .agg(F.max(F.col("doc_id") == F.col("class_id")).alias("first"), F.count(F.lit(1)).alias("n")), "near-judged")
    kept = docs.join(few(judged.where("NOT first").select("doc_id")), "doc_id", "left_anti")
    twice = judged.where("n > 1").select("doc_id")
    if twice.isEmpty():
        return kept.select(docs.columns)
    twice = few(twice)
    doubled = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(doubled).select(docs.columns)
