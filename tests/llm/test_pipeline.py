"""The pipeline against brute-force versions of its stages."""

import random
import re

import corpus_pipeline
from strata.llm import op2_winnow, op3_language, op5_secrets, op9_near, scratch
from tests.llm.test_near import brute
from tests.llm.test_native import contamination

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(1)
    long = [r for r in rows if len(r[1].split()) > 80]
    for n in range(12):
        r = rng.choice(long)
        w = r[1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((10_000 + n, " ".join(w), r[2], r[3], 0))
    rows += [(20_000, "intro words here " + bench[0][1] + " closing words", "en", "s", 0), (20_001, None, "en", None, None), (20_002, "", None, "s", 0)]
    rows.append((20_003, rows[0][1] + " password=hunter2hunter2 yes", "fr", "mine", 0))
    return rows, bench


def test_stages_against_brute_force(spark):
    rows, bench = corpus(spark)
    docs = spark.createDataFrame(rows, COLUMNS)
    model = op3_language.train(docs.where(~op3_language.held_out(docs["doc_id"])))
    out = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns and at.schema == docs.schema
        out[name] = {r.doc_id: r.text for r in at.collect()}
        at = spark.createDataFrame(at.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()

    judged = model.judge([op3_language.normalised((t or "").encode()) for _, t, *_ in rows])
    spoken = {r[0]: r[1] for r, j in zip(rows, judged, strict=True) if not j[4]}
    assert out["language"] == spoken and {20_001, 20_002}.isdisjoint(spoken)
    classes = brute(list(spoken.items()))
    single = {i: t for i, t in spoken.items() if classes[i] == i}
    assert out["near copies"] == single and len(single) < len(spoken)
    dirty = contamination(list(single.items()), bench)
    clean = {i: t for i, t in single.items() if not dirty[i][4]}
    assert out["decontamination"] == clean and 20_000 not in clean
    masked = out["secrets"]
    assert masked.keys() == clean.keys()
    for i, t in clean.items():
        if re.search(op5_secrets.PATTERNS["assign"], t):
            assert "[SECRET]" in masked[i] or "[EXAMPLE]" in masked[i]
    assert sorted(r.doc_id for r in packed) == sorted(clean)


def test_run_over_a_table(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) > 100
    assert all(r.n_tokens <= r.bucket_len for r in out)


def test_empty_table(spark):
    at = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
    assert at.count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_to_drop_some(spark, tmp_path, monkeypatch):
    """Ids to drop are broadcast up to a limit above the planner's own; beyond it the join goes by shuffle, with the same rows."""
    rng = random.Random(3)
    bench = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)), "en", "s", 0) for i in range(30)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(5)]
    rows += [(200, bench, "en", "s", 0), (200, rows[7][1], "en", "s", 0), (None, bench, "en", "s", 0), (9, rows[9][1], "en", "s", 0), (201, None, "en", "s", 0)]
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, COLUMNS)
    planned = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {}
        for limit in (1_000_000, 0):
            monkeypatch.setattr(scratch, "BROADCAST_KEYS", limit)
            for stage, at in ((op9_near.keep_one, docs.where("doc_id < 200 AND doc_id != 9")), (op9_near.keep_one, docs), (op2_winnow.drop_contaminated, docs)):
                out = stage(spark, at, str(tmp_path))
                got.setdefault(limit, []).append(sorted((tuple(r) for r in out.collect()), key=repr))
                if at is not docs or stage is op2_winnow.drop_contaminated:
                    assert ("Exchange hashpartitioning" in plan(out)) == (limit == 0)
        assert got[1_000_000] == got[0]
        near, _, clean = got[0]
        assert {r[0] for r in near} == set(range(30)) - {9} and {r[0] for r in rows} - {r[0] for r in clean} == {None}
        assert len(clean) == len(rows) - 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", planned)
