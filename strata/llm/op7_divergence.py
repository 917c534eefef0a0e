"""Quality rules: divergence of a text from its language's histograms.

Two references per language are counted over the whole corpus: shares of the
``CLASSES`` character classes, and shares of the ``COMMON`` most frequent
words, of any length, with all other words as one cell.  A text's
own histograms are compared with them by Jensen-Shannon distance (base 2, 0 to
1).  A text of ``MIN_CHARS`` characters or ``MIN_WORDS`` words at least fails if
the distance of that histogram is over its limit, which falls with the text's
length (``CHAR_LIMIT``, ``WORD_LIMIT``); shorter ones are not judged by it, since
their histograms are mostly chance.

Base measures go beside it: words are runs without ASCII white space; a text
fails by them if it has under 20 words, or if over 30 % of its words lie in
8-word windows that the text repeats.

Scale: counting is one pass that emits partial sums per Arrow batch; what is
shuffled is a row per language and word of a batch, what reaches the
driver is ``COMMON`` words per language.  Judging is a second pass without a
shuffle.

Cases: a null text has no words and fails; a null label, or one of a language
without a reference, is compared with every reference and judged by the nearest
one; without any labels the distances are null and only base measures count;
rows that repeat and null ids are kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.textvec import ALNUM, SOLID, buffers, row_groups, windows, words

CLASSES = 8  # lower, upper, digit, space, line end, mark, symbol, beyond ASCII
COMMON = 100
MIN_CHARS, MIN_WORDS = 200, 50
#: Limits are a + b / sqrt(n) for n characters or words: chance differences shrink
#: with length. At 300 characters 0.38, at 3,000 0.24; at 100 words 0.60, at 1,000 0.33.
CHAR_LIMIT, WORD_LIMIT = (0.18, 3.5), (0.2, 4.0)
MAX_LANGUAGES = 1000
MIN_BASE_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
_CLASS[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = CLASSES  # continuation bytes are no characters
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def class_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Characters by row and class."""
    n = len(off) - 1
    rows = np.repeat(np.arange(n), np.diff(off))
    cells = rows * (CLASSES + 1) + _CLASS[data[off[0]: off[-1]]]
    return np.bincount(cells, minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of p and q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def limit(of: tuple[float, float], n: int) -> float:
    return of[0] + of[1] / n ** 0.5


def repeated_words(h: np.ndarray, k: int = REPEAT_WINDOW) -> int:
    """Words in k-word windows that occur twice or more (the first included)."""
    w = windows(h, k)
    if len(w) < 2:
        return 0
    s = np.sort(w)
    if not (s[1:] == s[:-1]).any():
        return 0
    _, which, n = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[which] > 1)
    cover = np.zeros(len(h) + 1, int)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _tally(batches):
    """Partial counts (lang, kind, item, n): character classes and words."""
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        data, off = buffers(b.column("text"))
        known = [x for x in dict.fromkeys(langs.tolist())]
        number = np.array([known.index(x) for x in langs], int) if len(known) < 50 else np.array(list(map({x: i for i, x in enumerate(known)}.get, langs)), int)
        out = []
        for i, j in row_groups(off, 1 << 22):
            classes = class_counts(data, off[i: j + 1])
            h, at, _, _ = words(data, off[i: j + 1], ALNUM)
            of = np.repeat(number[i:j], np.diff(at))
            for n in np.unique(number[i:j]):
                sums = classes[number[i:j] == n].sum(axis=0)
                out += [(known[n], 0, c, int(v)) for c, v in enumerate(sums)]
                own = of == n
                out.append((known[n], 2, 0, int(own.sum())))
                item, count = np.unique(h[own], return_counts=True)
                out += zip([known[n]] * len(item), [1] * len(item), item.view(np.int64).tolist(), count.tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                         ["lang", "kind", "item", "n"])


class Reference:
    """Histograms of each language: classes x shares, and common word hashes."""

    def __init__(self, rows: list):
        self.langs = sorted({r["lang"] for r in rows})
        self.chars = np.zeros((len(self.langs), CLASSES))
        self.words, self.shares = [], []
        for i, x in enumerate(self.langs):
            own = [r for r in rows if r["lang"] == x]
            for r in own:
                if r["kind"] == 0:
                    self.chars[i, r["item"]] = r["n"]
            total = max(sum(r["n"] for r in own if r["kind"] == 2), 1)
            common = sorted((r["item"] & (1 << 64) - 1, r["n"]) for r in own if r["kind"] == 1)
            self.words.append(np.array([c[0] for c in common], np.uint64))
            shares = np.array([c[1] for c in common], float) / total
            self.shares.append(np.append(shares, max(1 - shares.sum(), 0)))
        self.chars /= np.maximum(self.chars.sum(axis=1, keepdims=True), 1)

    def distances(self, i: int, classes: np.ndarray, h: np.ndarray) -> tuple[float, float]:
        """Of one text from language i: by characters and by words."""
        chars = js_distance(classes / max(classes.sum(), 1), self.chars[i])
        table = self.words[i]
        hist = np.zeros(len(table) + 1)
        if len(h) and len(table):
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            at = np.where(table[at] == h, at, len(table))
            hist = np.bincount(at, minlength=len(table) + 1).astype(float)
        elif len(h):
            hist[-1] = len(h)
        return float(chars), float(js_distance(hist / max(hist.sum(), 1), self.shares[i]))


def references(docs: DataFrame) -> Reference:
    """Counted over all rows of ``docs`` that have ``text`` and ``lang``."""
    counts = (docs.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
              .mapInArrow(_tally, "lang string, kind int, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    # the most frequent words of a language: a limit per group that Spark applies before the shuffle
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    rows = counts.withColumn("place", place).where(F.col("place") <= COMMON).drop("place").limit(MAX_LANGUAGES * (COMMON + CLASSES + 1) + 1).collect()
    if len({r["lang"] for r in rows}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels; is this a language column?")
    return Reference(rows)


def judge(docs: DataFrame, reference: Reference, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` (``id_col, text, lang``) with the base
    measures, ``base_failed``, ``kept``, ``js_chars``, ``js_words``."""
    shared = docs.sparkSession.sparkContext.broadcast(reference)
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches):
        ref = shared.value
        number = {x: [i] for i, x in enumerate(ref.langs)}
        for b in batches:
            langs = b.column("lang").to_pylist()
            data, off = buffers(b.column("text"))
            rows = []
            for i, j in row_groups(off, 1 << 20):
                part = off[i: j + 1]
                classes = class_counts(data, part)
                solid, at, _, _ = words(data, part, SOLID, fold=False)
                alnum, to, _, _ = words(data, part, ALNUM)
                for r in range(j - i):
                    raw = data[part[r]: part[r + 1]]
                    n = int(at[r + 1] - at[r])
                    repeat = repeated_words(solid[at[r]: at[r + 1]])
                    failed = n < MIN_BASE_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                    chars = int(classes[r].sum())
                    word_chars = chars - int((~SOLID[raw]).sum())
                    h = alnum[to[r]: to[r + 1]]
                    near = min((ref.distances(k, classes[r], h) for k in number.get(langs[i + r], range(len(ref.langs)))),
                               key=lambda d: d[0] + d[1], default=(None, None))
                    far = near[0] is not None and (chars >= MIN_CHARS and near[0] > limit(CHAR_LIMIT, chars)
                                                        or len(h) >= MIN_WORDS and near[1] > limit(WORD_LIMIT, len(h)))
                    rows.append((n, word_chars, int(_SYMBOL[raw].sum()), duplicate_lines(raw.tobytes()), repeat, failed, not (failed or far), *near))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, js_chars double, js_words double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, references(docs))
