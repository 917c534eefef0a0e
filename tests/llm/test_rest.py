"""Language ID, packing, PII, licenses, quality, chat: exact rules, round trips,
held-out accuracy and brute-force versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import op1_pii as pii
from strata.llm import op3_language as lang
from strata.llm import op4_licenses as lic
from strata.llm import op6_packing as packing
from strata.llm import op7_divergence as quality
from strata.llm import op8_chat as chat

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ language
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang.identify(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("held_out").collect()
    assert len(got) > 40
    assert sum(r.lang_pred == r.truth for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat sat on the mat again and again", "en"), ("le chat est sur la table encore une fois", "fr")] * 20)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "123 !!!", None), (None, "the cat", "en"), (103, "THE CAT", None), (103, "THE CAT", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    got = sorted(((r.doc_id, r.lang_pred, r.score > 0) for r in lang.identify(df).where("doc_id >= 100 OR doc_id IS NULL").collect()), key=str)
    assert got == sorted([(100, "und", False), (101, "und", False), (102, "und", False), (None, "en", True), (103, "en", True), (103, "en", True)], key=str)
    assert {r.lang_pred for r in lang.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang.identify(df.limit(0)).count() == 0


def test_kneser_ney_is_a_distribution_and_arrays_agree():
    rng = random.Random(1)
    text = " " + "".join(rng.choice("ab c") for _ in range(400)) + " "
    counts = {}
    for i in range(len(text) - 3):
        counts[text[i:i + 4]] = counts.get(text[i:i + 4], 0) + 1
    kn = lang.KneserNey(counts, 4)
    seen = sorted(set(text))
    for ctx in ("abc", "a b", "zzz", ""):
        rest = 1 - sum(kn.prob(ctx + c) for c in seen)
        assert -1e-9 < rest < 1  # the rest is the mass of characters not seen
    model = lang.Model({"x": counts, "y": {"dddd": 3, "ddd ": 1}})
    for sample in ("abcab c", "ddqd ab", "zz"):
        cp = lang.normalised(sample.encode())
        s = "".join(map(chr, cp))
        want = [[np.log(m.prob(s[max(0, i - 3): i + 1])) for m in (kn, lang.KneserNey({"dddd": 3, "ddd ": 1}, 4))] for i in range(1, len(s))]
        assert np.allclose(model.log_probs(cp), want, atol=1e-4)


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    junk = "xq zvjk qqwx " * 20
    more = docs.unionByName(spark.createDataFrame([(10 ** 9, junk, None, "s", 1), (10 ** 9 + 1, None, "en", "s", 0)], docs.schema))
    out = lang.keep_identified(spark, more, "")
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.select("doc_id").collect()}
    assert 10 ** 9 not in left and 10 ** 9 + 1 not in left
    assert len(left) >= 0.99 * docs.count()


@pytest.mark.parametrize("foreign", ["es", "en"])
def test_a_language_that_was_not_learned_is_rejected(spark, foreign):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang.train(docs.where(~lang.held_out(docs["doc_id"])).where(docs["lang"] != foreign))
    judged = lang.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own, other = [r.rejected for r in judged if r.lang != foreign], [r.rejected for r in judged if r.lang == foreign]
    assert sum(other) >= 0.95 * len(other) and sum(own) <= 0.02 * len(own)


def test_texts_that_mix_known_languages_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {x: [r.text for r in docs.where(docs["lang"] == x).limit(40).collect() if len(r.text) > 600] for x in ("en", "fr", "de")}
    model = lang.train(docs.where(~lang.held_out(docs["doc_id"])))
    mixed = [lang.normalised((a[:500] + "\n" + b[:500]).encode()) for a, b in zip(by["en"], by["fr"] + by["de"], strict=False)]
    rejected = [j[4] for j in model.judge(mixed)]
    assert len(rejected) > 20 and sum(rejected) <= 0.05 * len(rejected)


def test_every_labelled_language_is_learned(spark):
    words = {"aa": ["alba", "ara", "abala"], "bb": ["tok", "tik", "kot"], "cc": ["nu", "mu", "nunu"]}
    rng = random.Random(2)
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(i, say("aa", 30_000), "aa") for i in range(4)] + [(10, say("bb", 5), "bb")] + [(20 + i, "nu mu nunu " * 3, "cc") for i in range(40)]
    rows += [(100, "?!", "dd"), (101, None, "ee"), (102, "word", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang.train(df, train_chars=20_000)
    assert model.langs == ["aa", "bb", "cc"]
    assert [model.judge([lang.normalised(say(x, 20).encode())])[0][0] for x in words] == list(words)
    with pytest.raises(ValueError):
        lang.train(spark.range(1001).selectExpr("CAST(id AS STRING) AS lang", "'a' AS text"))


# ------------------------------------------------------------------- packing
def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(30):
        sizes = sorted(rng.randrange(1, 40) for _ in range(rng.randrange(1, 12)))
        cells = [(n, sizes.count(n), n * sizes.count(n)) for n in sorted(set(sizes))]
        k = rng.randrange(1, 4)
        waste = lambda bs: sum(min(b for b in bs if b >= n) - n for n in sizes)
        lengths = [c[0] for c in cells]
        best = min(waste((*c, lengths[-1])) for r in range(k) for c in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
        got = packing.boundaries(cells, k)
        assert len(got) <= k and got[-1] == lengths[-1] and waste(got) == best


def test_boundaries_of_long_lengths_are_optimal():
    rng = random.Random(14)
    for k in (1, 2, 5, 16):
        sizes = sorted(int(rng.lognormvariate(6, 1.2)) + 1 for _ in range(1500))
        lengths = sorted(set(sizes))
        cells = [(n, sizes.count(n), n * sizes.count(n)) for n in lengths]
        n = np.cumsum([0] + [c[1] for c in cells]).astype(float)
        s = np.cumsum([0] + [c[2] for c in cells]).astype(float)
        least = np.array([0.0] + [np.inf] * len(cells))
        for _ in range(k):  # every pair of places
            least = np.array([0.0] + [min(least[:j] + lengths[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])) for j in range(1, len(cells) + 1)])
        got = packing.boundaries(cells, k)
        assert len(got) <= k and got[-1] == lengths[-1]
        assert sum(got[np.searchsorted(got, x)] - x for x in sizes) == least[-1]
    assert packing.boundaries([(5, 2, 10)], 4) == [5] and packing.boundaries([(5, 2, 10), (9, 1, 9)], 4) == [5, 9]


def test_batches(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 3, 9, 300, 700])))) for i in range(400)] + [(7, "w"), (7, "w"), (None, "w w"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("lane", F.lit(1))
    got = packing.pack(docs, buckets=3, budget=600, lane_rows=7).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").split())) for i, t in rows)
    by = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        by.setdefault((r.bucket_len, r.batch), []).append(r.place)
    last = {}
    for b, n in by:
        last[b] = max(last.get(b, 0), n)
    for (b, n), places in by.items():
        room = max(1, 600 // max(b, 1))
        assert sorted(places) == list(range(len(places))) and (len(places) == room if n < last[b] else len(places) <= room)
    assert len({b for b, _ in by if b}) <= 3
    assert packing.pack(docs.limit(0)).count() == 0


# ----------------------------------------------------------------------- pii
KEY = hashlib.blake2b(b"k", digest_size=32).digest()


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000, 73049])
def test_permutation_and_inverse(size):
    values = range(size) if size <= 1000 else random.Random(1).sample(range(size), 300)
    out = [pii.permute(v, size, KEY, "t") for v in values]
    assert len(set(out)) == len(out) and all(0 <= v < size for v in out)
    assert [pii.unpermute(v, size, KEY, "t") for v in out] == list(values)


def test_pseudonyms_keep_format_and_link():
    text = ("Mail bo.42@mail8.example.com, call +1 (386) 555-3733 or 030-123-4567, card 4041 8949 7460 8795, ip 25.86.162.211, "
            "born 1980-02-29, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00. Again bo.42@mail8.example.com 4041894974608795.")
    if not pii.luhn("4041894974608795"):
        text = text.replace("4041 8949 7460 8795", "4111 1111 1111 1111").replace("4041894974608795", "4111111111111111")
    out, spans = pii.replace_text(text, KEY)
    assert [s[0] for s in spans] == ["email", "phone", "phone", "card", "ipv4", "date", "ssn", "iban", "email", "card"]
    assert len(out) != 0 and out != text
    new, new_spans = pii.replace_text(out, KEY)
    assert [s[0] for s in new_spans] == [s[0] for s in spans]  # still valid values of their kinds
    found = re.findall(r"\S+@\S+", out)
    assert found[0].rstrip(",") == found[1] and found[1].endswith("@mail8.example.com")
    for kind, s, e in spans:
        assert text[s:e] not in out, kind


def test_every_date_moves_to_one_of_its_own():
    days = [pii.dt.date.fromordinal(pii.FIRST_DAY + i).isoformat() for i in range(pii.DAYS)]
    out = [pii.pseudonym("date", d, KEY) for d in days]
    assert sorted(out) == days and all(a != b for a, b in zip(days, out, strict=True))


@pytest.mark.parametrize("size", [2, 3, 10, 500])
def test_moves_are_permutations_without_fixed_points(size):
    out = [pii._moved(v, size, KEY, "t") for v in range(size)]
    assert sorted(out) == list(range(size)) and all(v != o for v, o in enumerate(out))
    assert [pii._moved(o, size, KEY, "t", -1) for o in out] == list(range(size))


@pytest.mark.parametrize("value", ["3 May 1984", "May 3, 1984", "1984-5-3", "03-05-1984", "1984-05-03", "3/5/1984", "3.5.1984", "12 December 2001"])
def test_dates_in_other_layouts(value):
    out, spans = pii.replace_text(f"born {value}.", KEY)
    assert spans == [("date", 5, 5 + len(value))] and value not in out
    assert pii._day(out[5:-1])[1] == pii._day(value)[1]


PHONES = ["+49 1512 3456789", "+49 30 12345678", "+44 7911 123456", "2125551234", "+33 6 12 34 56 78", "1-800-555-0199", "030 12345678", "12125551234"]
IBANS = ["ES9121000418450200051332", "AT611904300234573201", "BE68 5390 0754 7034", "NO9386011117947", "DE89 3704 0044 0532 0130 00"]


@pytest.mark.parametrize("kind,value", [*(("phone", p) for p in PHONES), *(("iban", i) for i in IBANS)])
def test_common_layouts_are_whole_values(kind, value):
    behinds = [" BIC X", " BANK OF", "."] if kind == "iban" else [" or", ".", " 2023 12 34" if value == "+49 1512 3456789" else ","]
    for behind in behinds:
        out, spans = pii.replace_text(f"see {value}{behind}", KEY)
        assert spans == [(kind, 4, 4 + len(value))], (value, behind)
        assert out.startswith("see ") and out.endswith(behind) and value not in out
        assert pii.replace_text(out, KEY)[1] == spans


def test_equal_phones_link_in_all_layouts():
    got = {re.sub(r"\D", "", pii.replace_text(t, KEY)[0]) for t in ("2125551234", "212-555-1234", "(212) 555-1234")}
    assert len(got) == 1
    many = [f"{n}" for n in range(2125550000, 2125550300)]
    assert len({pii.replace_text(t, KEY)[0] for t in many}) == len(many)


def test_other_numbers_stay():
    for text in ("1 2 3 4 5 6 7 8 9 10 11", "at 1712345678 s", "2125551234.55", "AB12 CDEF GHIJ 1234 WORD"):
        assert pii.replace_text(text, KEY) == (text, []), text


def test_what_is_no_personal_value_stays():
    for text in ("version 2.0.0 of 300.1.2.3", "4111111111111112", "2023-02-30", "a@b", "room 12 34", "000-12-3456 x", "plain words", ""):
        assert pii.replace_text(text, KEY) == (text, []), text


def test_pii_table(spark):
    rows = [(1, "x a.b1@c.de y"), (2, None), (3, ""), (1, "x a.b1@c.de y"), (None, "10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii_spans", F.lit("q"))
    got = pii.pseudonymise(df).collect()
    assert sorted((str(r.doc_id), r.pii_spans, r.n_pii) for r in got) == [("1", "email:2:11", 1), ("1", "email:2:11", 1), ("2", "", 0), ("3", "", 0), ("None", "ipv4:0:8", 1)]
    assert len({r.text for r in got if r.doc_id == 1}) == 1
    assert pii.pseudonymise(df.limit(0)).count() == 0


# ------------------------------------------------------------------ licenses
def test_license_spans_and_edits(spark):
    mit = " ".join(lic.TEMPLATES["MIT"].split())
    edited = mit.replace("free of charge", "free of any charge").replace("substantial", "major").replace("publish, ", "")
    rows = [(1, f"é intro {mit} outro"), (2, f"words before\n{edited}\nafter"), (3, "Released under the MIT License. " + "x " * 50 + "licensed under the apache license, version 2.0"),
            (4, "the license of the software is here and there"), (5, None), (6, ""), (None, mit[:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(1))
    got = {r.doc_id: [tuple(x) for x in r.licenses] for r in lic.scan_licenses(df).collect()}
    assert [(x[0], x[1]) for x in got[1]] == [("MIT", 1.0)]
    assert rows[0][1][got[1][0][2]: got[1][0][3]] == mit.rstrip(".")
    assert [x[0] for x in got[2]] == ["MIT"] and 0.9 < got[2][0][1] < 1
    assert [x[0] for x in got[3]] == ["MIT-line", "Apache-2.0-line"]
    assert got[4] == got[5] == got[6] == got[None] == []
    assert lic.scan_licenses(df.limit(0)).count() == 0


def test_alignment_against_full_table():
    rng = random.Random(8)
    for _ in range(20):
        t = np.array([rng.randrange(6) for _ in range(12)], np.uint64)
        a = np.concatenate([np.array([9] * rng.randrange(4), np.uint64), t[: rng.randrange(8, 13)], np.array([9, 9], np.uint64)])
        best = 0
        s = np.zeros((len(t) + 1, len(a) + 1), int)
        for i in range(len(t)):
            for j in range(len(a)):
                s[i + 1, j + 1] = max(0, s[i, j] + (1 if t[i] == a[j] else -1), s[i, j + 1] - 1, s[i + 1, j] - 1)
                best = max(best, s[i + 1, j + 1])
        matched, first, end = lic.align(a, t, 0, band=20)
        assert matched >= best and end - first >= matched


def license_words(text):
    return [hash(w) % (1 << 62) for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]


def whole_scan(text):
    """The best template over the whole text with no index, band or chain:
    (license, coverage, first and last + 1 word)."""
    a, out = license_words(text), []
    for name, template in lic.TEMPLATES.items():
        t = license_words(template)
        rows = [(0, 0, 0)] * (len(a) + 1)  # (score, matched, -first)
        best = (0, 0, 0, 0)
        for w in t:
            now = [(0, 0, 0)]
            for j, v in enumerate(a):
                s, m, f = rows[j]
                up, left = rows[j + 1], now[-1]
                cell = max((s + 8, m + 1, f if s else -j) if v == w else (s - 8, m, f), (up[0] - 8, *up[1:]), (left[0] - 1, *left[1:]))
                now.append(cell if cell[0] > 0 else (0, 0, 0))
                if v == w and cell[:2] > best[:2]:
                    best = (*cell, j + 1)
            rows = now
        if best[1] >= 0.8 * len(t):
            out.append((best[1], name, best[1] / len(t), -best[2], best[3]))
    if not out:
        return None
    return min(out, key=lambda r: (-r[0], r[1]))[1:]


def edited_licenses():
    rng = random.Random(12)
    noise = lambda n: [f"zz{rng.randrange(50)}" for _ in range(n)]
    texts = []
    for name in ("MIT", "Apache-2.0-notice", "GPL-3.0-notice", "BSD-2-Clause", "MPL-2.0"):
        w = lic.TEMPLATES[name].split()
        for n in (9, 20, 40):
            texts.append((name, 1.0, [*noise(5), *w[: len(w) // 2], *noise(n), *w[len(w) // 2:], *noise(7)]))
        for head in ("dnl", "rem", "<br>"):
            texts.append((name, 1.0, [*noise(3), *(x for i in range(0, len(w), 9) for x in (head, *w[i: i + 9])), *noise(30)]))
        texts.append((name, None, [*noise(4), *(x for i, x in enumerate(w) if i % 15 != 14), *noise(4)]))
        texts.append((name, None, [*noise(4), *w[: len(w) // 3], *noise(4)]))
        texts.append((name, None, [*noise(4), *(f"qq{i}" if i % 11 == 10 else x for i, x in enumerate(w)), *noise(4)]))
    return [(name, want, " ".join(words)) for name, want, words in texts]


def test_scan_of_edited_licenses_equals_a_whole_scan(spark):
    cases = edited_licenses()
    rows = [(i, text) for i, (_, _, text) in enumerate(cases)]
    got = {r.doc_id: (r.licenses, rows[r.doc_id][1]) for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, want, text) in enumerate(cases):
        best = whole_scan(text)
        if best is None:
            assert got[i][0] == [], (name, text)
            continue
        places = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", text)]
        assert [tuple(x) for x in got[i][0]] == [(best[0], best[1], places[best[2]][0], places[best[3] - 1][1])], (name, text)
        if want:
            assert best[:2] == (name, want)


def test_licenses_in_long_texts_repeats_and_ties(spark):
    mit, line = " ".join(lic.TEMPLATES["MIT"].split()), lic.TEMPLATES["MIT-line"]
    long = ("lorem ipsum dolor " * 20_000) + mit + (" sit amet" * 20_000) + " " + line
    crowd = f"{mit}\n" * 40 + f"{line} " * 500
    rows = [(1, long), (2, crowd), (2, crowd), (3, "the above copyright notice and this permission notice " * 3_000)]
    got = lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.license, x.start, x.end) for r in got if r.doc_id == 1 for x in r.licenses] == [
        ("MIT", 360_000, 360_000 + len(mit) - 1), ("MIT-line", len(long) - len(line), len(long) - 1)]
    for r in got:
        if r.doc_id == 2:
            assert [(x.license, x.coverage) for x in r.licenses] == [("MIT", 1.0)] * 40 + [("MIT-line", 1.0)] * 500
    assert sum(r.doc_id == 2 for r in got) == 2 and [r.n_licenses for r in got if r.doc_id == 3] == [0]
    tie = lic.scan_licenses(spark.createDataFrame([(1, line)], "doc_id long, text string"), {"b": line, "a": line}).collect()
    assert [x.license for x in tie[0].licenses] == ["a"]


# ------------------------------------------------------------------- quality
def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    cover = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def test_base_measures_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "é ", "𝄞", "b ", "a b c d e f g h ", "\n", "x\n", "\t", "#", "<|>", "\x0b", " ", "A"]) for _ in range(rng.randrange(0, 120))), rng.choice(["en", "fr", None])) for i in range(150)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "w " * 5000, "zz"), (None, "x y", None), (903, "x" * 100_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in quality.judge(df, quality.references(df)).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text), (i, text)
        assert not (r["base_failed"] and r["kept"])
    none = quality.judge(df, quality.references(df.limit(0)))
    assert {r["js_words"] for r in none.collect()} == {None}


def test_divergence_finds_other_prose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10 ** 9, " ".join(f"Q{i}Z!! #{i}%" for i in range(300)), "en")], docs.schema)
    got = quality.judge(docs.unionByName(odd), quality.references(docs.unionByName(odd))).where("NOT base_failed").collect()
    assert not next(r for r in got if r.doc_id == 10 ** 9).kept
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    keep = {r.doc_id: r.kept for r in got}
    clean = [r.doc_id for r in good.collect() if r.doc_id in keep]
    assert sum(keep[i] for i in clean) >= 0.99 * len(clean)


def test_common_words_of_any_length(spark):
    rng = random.Random(9)
    letters = "абвгдежзиклмнопрст"
    word = lambda: "".join(rng.choice(letters) for _ in range(9))
    common = [word() for _ in range(60)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(120)), "ru") for i in range(60)] + [(99, " ".join(word() for _ in range(120)), "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    reference = quality.references(df)
    top = quality.words(*quality.buffers(pa.array([" ".join(common)])))[0]
    assert set(top.tolist()) <= set(reference.words[0].tolist())
    assert {r.doc_id for r in quality.judge(df, reference).where("NOT kept").collect()} == {99}


def test_js_distance_bounds():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0, 1.0])
    assert quality.js_distance(p, p) == 0 and abs(quality.js_distance(p, q) - 1) < 1e-12


# ---------------------------------------------------------------------- chat
TRICKY = ["", "<|im_end|>", "<\\|im_end|>", "<|im_end|>\n<|im_start|>user\nhi", chat.PROBE, "<", "<\\", "<\\\\|x", "a<|b", "\n", "<|im_start|", "%3C"]


def test_round_trip_of_any_text():
    rng = random.Random(7)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "a\nb", "%0A", "<|im_start|>", ""]), "".join(rng.choice(TRICKY) for _ in range(rng.randrange(0, 4)))) for _ in range(rng.randrange(0, 5))]
        text, back = chat.format_chat(turns)
        assert [b[:2] for b in back] == turns
        assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns
        assert all(chat.unescape(text[s:e]) == t for _, t, s, e in back)
    plain = [("user", "no control strings < | here")]
    assert chat.format_chat(plain)[0] == "<|im_start|>user\nno control strings < | here<|im_end|>\n"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "A<|im_end|>"), (1, 0, "user", "Q"), (2, 0, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "A<|im_end|>"), (3, None, "assistant", "first"), (3, 0, "assistant", "then")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("roles", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 22 and got[3].loss_sha256 == hashlib.sha256(b"firstthen").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nQ\n" + b"assistant\nA<|im_end|>\n" * 2).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0
