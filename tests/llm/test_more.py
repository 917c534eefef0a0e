"""Resampling, sketches and the manifest against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from strata.llm import op11_resample, op12_sketch, op13_manifest
from strata.llm.op13_manifest import Appender, levels_of, witness
from tests.llm.test_native import folded_words
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "été", "ÀB", "naïve", "Don't", "𝄞x"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i * 3, say(rng.choice([1, 2, 3, 5, 19, 20, 21, 50, 90]))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "?! .."), (1003, "line\n" * 40), (None, say(30)), (None, say(30)), (5, docs[4][1])]
    docs += [(7, docs[3][1])] * 30 + [(9, f"very long {i} text " * 6000) for i in range(2)]
    rng.shuffle(docs)
    return docs


def frame(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("id", "hash", "rank", "score", "weight", "segment", "chunk", "guest", "next", "sketch", "row", "bucket")})


# resampling

def features(text):
    w = folded_words(text)
    return len(w), [crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target, percent):
    of = [features(t) for _, t in docs]
    have, wanted = Counter(b for _, f in of for b in f), Counter(b for t in target for b in features(t)[1])
    s_all, t_all = have.total() + 10_000, wanted.total() + 10_000
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * s_all / ((have[b] + 1.0) * t_all))) for b in range(10_000)]
    out = []
    for (i, _), (n, f) in zip(docs, of, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("percent, segments", [(5, 8), (40, 3), (100, 50), (100, 1), (0, 4)])
def test_resampling_equals_brute_force(spark, percent, segments):
    docs, target = corpus(), ["w1 w2 w3 w4", None, "", "été w5 w5 w5"]
    got = op11_resample.resample(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, segments=segments)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, target, percent)


def test_resampling_without_rows_or_target(spark):
    docs, none = frame(spark, [(1, "a " * 30), (2, "b " * 30)]), spark.createDataFrame([], "text string")
    assert op11_resample.resample(docs.limit(0), none).count() == 0
    got = [tuple(r) for r in op11_resample.resample(docs, none, percent=50).select("doc_id", "weight", "score", "rank").collect()]
    want = [(r[0], r[3], r[4], r[5]) for r in resampled([(1, "a " * 30), (2, "b " * 30)], [], 50)]
    assert sorted(got) == sorted(want)


def test_pieces_of_a_long_text(monkeypatch):
    text = ("ab cde, f " * 50).encode()
    whole = sorted(b for _, at in op11_resample.feature_buckets(text) for b in at.tolist())
    monkeypatch.setattr(op11_resample, "PIECE", 7)
    parts = list(op11_resample.feature_buckets(text))
    assert len(parts) > 20 and sorted(b for _, at in parts for b in at.tolist()) == whole


# sketches

def sketch(text, scale=8):
    w = folded_words(text)
    n = min(5, len(w))
    hashes = sorted({hashlib.md5(" ".join(w[i:i + n]).encode()).hexdigest()[:16] for i in range(len(w) - n + 1)}) if w else []
    return [h for h in hashes if int(h, 16) < (1 << 64) // scale] or hashes[:1]


def against_next(docs):
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    line = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])), reverse=True)
    out = []
    for j, (i, text) in enumerate(line):
        text, follows = text or "", line[(j + 1) % len(line)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + follows[:third]
        out.append((i, len(text), edited, sketch(text), sketch(edited), sketch(follows)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunks, hot", [(8, 1000), (1, 1000), (40, 1000), (8, 3)])
def test_sketches_equal_brute_force(spark, chunks, hot):
    docs = corpus()
    got = op12_sketch.against_next(frame(spark, docs), chunks=chunks, hot_copies=hot)
    assert sorted(map(tuple, got.collect()), key=str) == against_next(docs)


def test_sketch_of_one_and_of_none(spark):
    one = op12_sketch.against_next(frame(spark, [(1, "a b c d e f g h i")]))
    assert [(r.edited, r.sketch == r.next_sketch) for r in one.collect()] == [("a b c d e f a b c", True)]
    assert op12_sketch.against_next(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_containment_of_unequal_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(20_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[4000:7000]), " ".join(words[6000:8000]))], "a string, b string, c string")
    for c in "abc":
        df = op12_sketch.with_sketch(df, c, "s" + c)
    got = df.select(op12_sketch.containment(F.col("sa"), F.col("sb")), op12_sketch.containment(F.col("sb"), F.col("sc")),
                    op12_sketch.containment(F.col("sb"), op12_sketch.merged(F.col("sb"), F.col("sc"))), F.size("sa")).first()
    assert got[0] == 1 and abs(got[1] - 0.5) < 0.1 and got[2] == 1 and abs(got[3] - 2500) < 250


# manifest

def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def ternary(nodes):
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3: i // 3 * 3 + 3]
            proofs[k].append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
        at = [i // 3 for i in at]
        nodes = [digest("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81])
def test_append_extends_witnesses(n):
    nodes, tree = [digest(str(i)) for i in range(n)], Appender()
    leaves = [tree.append(h) for h in nodes]
    root, proofs = ternary(nodes)
    assert tree.close(levels_of(n, 9)) == root
    assert [[(s["at"], s["siblings"]) for s in witness(x)] for x in leaves] == proofs


def manifest_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "b", "é", None, ""]), None, i % 5, f"text {i}\nand more" if i % 2 else None) for i in range(300)]
    rows += [(10 ** 6 + i, f"single{i}", "en", 0, "") for i in range(20)] + [(5, "hot", "en", 1, "same")] * 40 + [(None, "hot", None, None, "x"), (None, None, None, None, None)]
    return rows + [(11, "b", "fr", 3, "long\n" * 100_000)]


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_manifest_equals_brute_force(spark, depth):
    rows = manifest_rows()
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: ternary([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = ternary([made[g][0] for g in names])
    want = sorted(((i, h, made[g][0], root, [*p, *top]) for g, top in zip(names, tops, strict=True)
                   for (_, _, h, i), p in zip(sorted(groups[g]), made[g][1], strict=True)), key=str)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("leaf", "grp", "pos", "row")})
    out = op13_manifest.manifest(op13_manifest.leaves_of(df), depth)
    out = out.withColumn("folded", op13_manifest.fold(F.col("leaf"), F.col("steps"))).collect()
    got = sorted(((r.id, r.leaf, r.subroot, r.root, [(s["at"], s["siblings"]) for s in r.steps]) for r in out), key=str)
    assert got == want and all(r.folded == r.root for r in out)


def test_manifest_of_none(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert op13_manifest.manifest(op13_manifest.leaves_of(df)).count() == 0


@pytest.mark.parametrize("name, module", [("op11_resample", op11_resample), ("op12_sketch", op12_sketch), ("op13_manifest", op13_manifest)])
def test_queries_equal_sql(spark, name, module):
    assert compare(spark, duck(SF), name, module.query, module.SQL, SF)["ok"]
