"""Language ID: interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, runs of other characters than letters become one space,
and so do words with digits in them.
The model is of order ``ORDER``: raw counts for the longest n-grams,
continuation counts (distinct preceding characters) below, absolute discounts
from the counts of counts, and every order interpolated with the next shorter
one.  For each order the n-grams of all languages are kept as one sorted array
of 64-bit hashes with a row of log-probabilities, and contexts likewise with
their back-off weights; a text is scored by binary search for all its
positions at once.  The language of least cross-entropy per character wins.

Training: labelled texts are cut into pieces of ``TRAIN_PIECE`` characters, and
pieces are drawn by their hash so that about ``TRAIN_CHARS`` characters per
language are counted (all of them where a language has fewer, and always at least
one piece with a letter, so that every labelled language with a letter is learned).
n-grams are counted by Spark; what reaches the driver is bounded by that
parameter times the number of languages, of which there may be
``MAX_LANGUAGES`` (more labels raise ValueError: that is no language column).

Rejection is calibrated on a fifth of the drawn pieces that is kept from the
counts: each is scored with all languages and with its own left out, which
shows what texts of an unknown language cost under each language that takes them.
A language's limit lies between the two means, nearer to the one that varies
less but at least ``KEPT_GAP`` of the way from known texts.  A text is scored in pieces of ``PIECE_CHARS``, each by its cheapest language,
so that one that mixes known languages is kept; it is rejected if
it has ``MIN_CHARS`` characters or more and costs more than the limits of
those languages (for short texts at least ``NEAR_SD`` deviations, which grow as the text shortens, above the mean).
Languages with fewer than ``FEW`` calibration pieces use pooled values; a
single language is given ``ALONE_SD`` deviations.

Cases: a text that is null or has no letter is ``und`` with score 0 and
rejected; so is every text if nothing is labelled.  Ties go to the first
language in sort order.  Rows that repeat are judged alike, one result each;
null ids are kept and count as not held out; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.textvec import buffers, mix, row_groups

ORDER = 4
TRAIN_CHARS = 1_000_000
MAX_LANGUAGES = 1000
MIN_CHARS = 20
PIECE_CHARS = 100  # a text that mixes languages is judged by pieces
TRAIN_PIECE = 10_000  # characters of a text that are drawn together
KEPT_GAP, NEAR_SD, ALONE_SD, LEAST_SD, FEW = 0.5, 6.0, 8.0, 0.05, 5
SHORT = 200.0
ALPHABET = 2000  # characters that the model without context spreads its last mass over
PEAK = 20.0  # characters of evidence that the score stands for
UND = "und"
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_letters: list[np.ndarray] = []


def normalised(data: bytes) -> np.ndarray:
    """Code points of a text: lower-cased letters, other runs as one space, a
    space at either end; empty without letters.  Letters that touch digits (keys,
    codes) are left out unless there are no others."""
    if not _letters:
        _letters.append(_letter_table())
    cp = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters[0][cp]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    digit = (cp >= 48) & (cp <= 57)
    if digit.any():
        run = is_letter | digit
        number = np.cumsum(run & ~np.concatenate([[False], run[:-1]]))
        mixed = np.zeros(number[-1] + 1, bool)
        mixed[number[digit]] = True
        prose = is_letter & ~mixed[number]
        is_letter = prose if prose.any() else is_letter
    cp = np.concatenate([[32], np.where(is_letter, cp, 32), [32]]).astype(np.uint32)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    return cp[keep]


def gram_hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that start at each position."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    wide = cp.astype(np.uint64)
    for j in range(n):
        out += wide[j: j + m] * _MULT[j]
    return mix(out)


def _string_hashes(grams: list[str]) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    n = len(grams[0])
    cp = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
    return mix((cp * np.array(_MULT[:n], np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(n))


class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language from its counts."""

    def __init__(self, counts: dict[str, int], order: int):
        self.order = order
        self.levels: list[tuple[dict, dict, float]] = [({}, {}, 0.5)] * (order + 1)
        for n in range(order, 0, -1):
            have = counts.values()
            ones, twos = sum(1 for v in have if v == 1), sum(1 for v in have if v == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: dict[str, list] = defaultdict(lambda: [0, 0])
            for g, c in counts.items():
                t = total[g[:-1]]
                t[0] += c
                t[1] += 1
            self.levels[n] = (counts, dict(total), discount)
            counts = Counter(g[1:] for g in counts)

    def backoff(self, context: str) -> float:
        """Weight of the shorter model after ``context`` (1 if unseen)."""
        _, total, d = self.levels[len(context) + 1]
        t = total.get(context)
        return d * t[1] / t[0] if t else 1.0

    def prob(self, gram: str) -> float:
        """Probability of the last character after those before it."""
        if not gram:
            return 1.0 / ALPHABET
        counts, total, d = self.levels[len(gram)]
        t = total.get(gram[:-1])
        low = self.prob(gram[1:])
        return (max(counts.get(gram, 0) - d, 0.0) + d * t[1] * low) / t[0] if t else low


class Model:
    """Sorted hash arrays with a column per language."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.langs = sorted(counts)
        self.order = order
        models = [KneserNey(counts[x], order) for x in self.langs]
        self.grams, self.contexts = {}, {}
        for n in range(1, order + 1):
            seen = sorted({g for m in models for g in m.levels[n][0]})
            self.grams[n] = self._table(seen, lambda g: [m.prob(g) for m in models])
            if n > 1:
                self.contexts[n] = self._table(sorted({g for m in models for g in m.levels[n][1]}), lambda g: [m.backoff(g) for m in models])
        self.floor = np.log(np.array([m.backoff("") for m in models]) / ALPHABET).astype(np.float32)
        self.limits = np.full((len(self.langs), 3), np.inf)  # limit, mean, deviation

    def _table(self, keys: list[str], values) -> tuple[np.ndarray, np.ndarray]:
        h = _string_hashes(keys)
        by = np.argsort(h)
        v = np.log(np.array([values(k) for k in keys], float).reshape(len(keys), len(self.langs))).astype(np.float32)
        return h[by], v[by]

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
        return at, (table[at] == h) if len(table) else np.zeros(len(h), bool)

    def log_probs(self, cp: np.ndarray) -> np.ndarray:
        """For each position but the first, log-probabilities by language."""
        n = self.order
        out = np.empty((max(len(cp) - 1, 0), len(self.langs)), np.float32)
        head = min(n - 2, len(out))
        for i in range(head):  # fewer characters before it than the order has
            out[i] = self._level(cp[: i + 2], i + 2, np.array([0]))[0]
        if len(out) > head:
            out[head:] = self._level(cp, n, np.arange(len(cp) - n + 1))
        return out

    def _level(self, cp: np.ndarray, n: int, start: np.ndarray) -> np.ndarray:
        """Log-probabilities of the n-grams at ``start``, backing off if unseen."""
        if not n:
            return np.broadcast_to(self.floor, (len(start), len(self.langs)))
        h, v = self.grams[n]
        own = gram_hashes(cp, n)[start] if len(start) > 64 else np.array([gram_hashes(cp[s: s + n], n)[0] for s in start], np.uint64)
        at, found = self._find(h, own)
        out = v[at] if len(h) else np.zeros((len(start), len(self.langs)), np.float32)
        if not found.all():
            rest = start[~found]
            low = np.array(self._level(cp, n - 1, rest + 1))
            if n > 1:
                ch, cv = self.contexts[n]
                ctx = np.array(gram_hashes(cp[:-1], n - 1)[rest] if len(rest) > 64 else [gram_hashes(cp[s: s + n - 1], n - 1)[0] for s in rest], np.uint64)
                cat, cfound = self._find(ch, ctx)
                low[cfound] += cv[cat[cfound]]
            out[~found] = low
        return out

    def costs(self, cps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For non-empty texts: the cost of each piece of ``PIECE_CHARS`` under each
        language, the pieces' first rows by text, and the texts' sizes.  The
        texts are laid end to end (each begins and ends with a space)."""
        logs = self.log_probs(np.concatenate(cps))
        sizes = np.array([len(c) - 1 for c in cps])
        first = np.cumsum([0] + [len(c) for c in cps[:-1]])
        starts = [np.arange(f, f + n, PIECE_CHARS) for f, n in zip(first, sizes, strict=True)]
        begin = np.cumsum([0] + [len(x) for x in starts[:-1]])
        cost = -np.add.reduceat(logs, np.concatenate(starts), axis=0).astype(float)
        # the step from one text's last space to the next text's first one belongs to no text
        cost[begin[1:] - 1] += logs[first[1:] - 1]
        return cost, begin, sizes

    def far(self, cost: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By text the cost a character where each piece takes its cheapest
        language, and the limit for it."""
        best = cost.argmin(axis=1)
        count = np.diff([*begin, len(cost)])
        weight = np.full(len(cost), float(PIECE_CHARS))
        weight[begin + count - 1] = sizes - (count - 1) * PIECE_CHARS
        total = lambda x: np.add.reduceat(x, begin) / sizes
        middle, mean, sd = self.limits.T
        near = total(weight * mean[best]) + NEAR_SD * total(weight * sd[best]) * np.sqrt(1 + SHORT / sizes)
        return total(cost.min(axis=1)), np.maximum(total(weight * middle[best]), near)

    def judge(self, cps: list[np.ndarray]) -> list[tuple[str, float, float, int, bool]]:
        """(language, score, cross-entropy, characters, rejected) by text."""
        out = [(UND, 0.0, 0.0, 0, True)] * len(cps)
        at = [i for i, c in enumerate(cps) if len(c)]
        if not at or not self.langs:
            return out
        cost, begin, sizes = self.costs([cps[i] for i in at])
        pieced, limit = self.far(cost, begin, sizes)
        for i, ce, n, own, most in zip(at, np.add.reduceat(cost, begin, axis=0) / sizes[:, None], sizes, pieced, limit, strict=True):
            best = int(np.argmin(ce))
            score = 1.0 / np.exp(-(ce - ce[best]) * min(PEAK, n)).sum()
            out[i] = (self.langs[best], float(score), float(ce[best]), int(n), bool(n >= MIN_CHARS and own > most))
        return out

    def left_out(self, cps: list[np.ndarray], langs: list[str]) -> list[tuple[str, str | None, float, float]]:
        """By text (language, the next best one, cost a character with and without the
        language), each piece at its cheapest language; for calibration."""
        if not cps:
            return []
        cost, begin, sizes = self.costs(cps)
        out = []
        for i, lang in enumerate(langs):
            part = cost[begin[i]: begin[i + 1] if i + 1 < len(begin) else len(cost)]
            rest = part.copy()
            rest[:, self.langs.index(lang)] = np.inf
            other = self.langs[int(rest.sum(axis=0).argmin())] if len(self.langs) > 1 else None
            out.append((lang, other, float(part.min(axis=1).sum() / sizes[i]), float(rest.min(axis=1).sum() / sizes[i])))
        return out


def _texts(col: pa.Array, limit: int = 1 << 19):
    """Groups of normalised texts."""
    data, off = buffers(col)
    for i, j in row_groups(off, limit):
        raw = data[off[i]: off[j]].tobytes()
        yield [normalised(raw[off[r] - off[i]: off[r + 1] - off[i]]) for r in range(i, j)]


def _count(batches):
    """(lang, gram, n) partial counts."""
    for b in batches:
        have: dict[str, Counter] = defaultdict(Counter)
        langs = b.column("lang").to_pylist()
        at = 0
        for cps in _texts(b.column("text")):
            for cp in cps:
                t = cp.tobytes().decode("utf-32-le", "surrogatepass")
                have[langs[at]].update(t[i: i + ORDER] for i in range(len(t) - ORDER + 1))
                at += 1
        rows = [(x, g, n) for x, c in have.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _calibration(model: Model):
    """``lang, other, own, foreign`` of the texts that are long enough."""
    names = ["lang", "other", "own", "foreign"]

    def run(batches):
        for b in batches:
            langs, at, rows = b.column("lang").to_pylist(), 0, []
            for cps in _texts(b.column("text")):
                use = [i for i, c in enumerate(cps) if len(c) > MIN_CHARS and langs[at + i] in model.langs]
                rows += model.left_out([cps[i] for i in use], [langs[at + i] for i in use])
                at += len(cps)
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)

    return run


def limits(model: Model, sample: DataFrame) -> np.ndarray:
    """(limit, mean, deviation) by language from held-back ``text, lang`` rows.  A
    language with fewer than ``FEW`` of them, or that takes fewer left-out
    ones, is given the values pooled over all languages."""
    found = sample.mapInArrow(_calibration(model), "lang string, other string, own double, foreign double")
    stats = lambda by, x: {r[0]: r[1:] for r in found.groupBy(by).agg(
        F.count(F.lit(1)), F.avg(x), F.coalesce(F.stddev_pop(x), F.lit(0.0))).collect()}  # a row a language
    own, foreign = stats("lang", "own"), stats("other", "foreign")

    def pooled(groups: dict) -> tuple[float, float] | None:
        n = sum(g[0] for g in groups.values())
        return (sum(g[0] * g[1] for g in groups.values()) / n, max(g[2] for g in groups.values())) if n else None

    foreign.pop(None, None)
    all_own, all_foreign = pooled(own), pooled(foreign)
    out = np.full((len(model.langs), 3), np.inf)
    for i, lang in enumerate(model.langs):
        if all_own is None:
            continue  # nothing is known of what texts cost: none is rejected
        mean, sd = own[lang][1:] if own.get(lang, (0,))[0] >= FEW else all_own
        sd = max(sd, LEAST_SD)
        far = foreign[lang][1:] if foreign.get(lang, (0,))[0] >= FEW else all_foreign
        if far is None or not np.isfinite(far[0]):
            out[i] = mean + ALONE_SD * sd, mean, sd
        else:
            out[i] = mean + max(far[0] - mean, 0.0) * max(sd / (sd + max(far[1], LEAST_SD)), KEPT_GAP), mean, sd
    return out


def train(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> Model:
    """Fit on ``text, lang`` rows (those with a null in either are skipped)."""
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    cuts = F.expr(f"transform(sequence(0, greatest(char_length(text) - 1, 0) div {TRAIN_PIECE}), i -> substring(text, CAST(i * {TRAIN_PIECE} + 1 AS INT), {TRAIN_PIECE}))")
    known = known.select("lang", F.explode(cuts).alias("text")).withColumn("hash", F.xxhash64(F.lit("sample"), "text"))
    # a piece with a letter that is always counted: a language with any such text is learned
    sizes = known.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n"), F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("hash"))).alias("least"))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in sizes.limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels; is this a language column?")
    if not sizes:
        return Model({})
    share = F.create_map(*(F.lit(v) for x, (n, _) in sizes.items() for v in (x, min(1.0, train_chars / max(n, 1)))))
    least = F.create_map(*(F.lit(v) for x, (_, h) in sizes.items() for v in (x, h if h is not None else 0)))
    always = F.col("hash") == F.element_at(least, F.col("lang"))
    chosen = known.where(always | (F.pmod("hash", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000))
    fifth = (F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(5)) == 0) & ~always
    counted = (chosen.where(~fifth).mapInArrow(_count, "lang string, gram string, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict())
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for x, g, n in zip(counted["lang"], counted["gram"], counted["n"], strict=True):
        counts[x][g] = n
    model = Model(counts)
    if model.langs:
        model.limits = limits(model, chosen.where(fifth).select("text", "lang"))
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col, lang_pred, score, cross_entropy, chars, rejected`` for each
    row of ``docs``; other columns than ``id_col`` and ``text`` are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TRAIN_CHARS x languages
    names = [id_col, "lang_pred", "score", "cross_entropy", "chars", "rejected"]

    def run(batches):
        for b in batches:
            got = [x for cps in _texts(b.column("text")) for x in shared.value.judge(cps)]
            cols = list(zip(*got, strict=True)) or [[]] * 5
            types = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col("text").cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, lang_pred string, score double, cross_entropy double, chars long, rejected boolean")


def identify(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """Learn from the rows of ``docs`` (``doc_id, text, lang``) that are not held
    out, and predict all of them."""
    model = train(docs.where(~held_out(F.col("doc_id"))), train_chars)
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is not rejected, unchanged."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [x for cps in _texts(b.column("text")) for x in shared.value.judge(cps)]
            yield b.filter(pa.array([not x[4] for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
