"""Language identification in two levels: the family first, then one-versus-one linear support vector
machines among the languages of that family.

Features are hashed byte n-grams of orders 1 to 4 of the lower-cased text, as shares of all n-grams, so
that a text's decision value is the mean weight of its n-grams: whole texts are scored in one pass of
table look-ups, however long they are. Training reads a bounded sample per language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mediafuse.llm import wordhash as W
from mediafuse.llm.columns import col

#: Different labelled texts that training uses of each language.
SAMPLE_PER_LANGUAGE = 200
#: Characters of one of them at most.
SAMPLE_CHARS = 65_536
#: A piece of each is also learned from as a short text, of these lengths in turn.
SHORT_BYTES = (24, 60, 150)
ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 12
#: Families of languages by code. Fixed values; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la", "ast"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indo-iranian": ("hi", "bn", "ur", "fa", "ne", "mr", "pa", "gu"),
    "sinitic": ("zh", "yue"),
    "austronesian": ("id", "ms", "tl", "jv", "mi"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), lang)


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orders, bytes) bucket of the n-gram that ends at each byte, and for each byte the n-grams that its text allows there."""
    low = W._LOWER[data]
    low = np.where(W.SPACE[low] | (low < 0x41) & (low >= 0x20), np.uint8(0x20), low).astype(np.uint32)
    rows, h = [], np.zeros(len(low), dtype=np.uint32)
    for n in ORDERS:
        lag = n - 1
        h = h * np.uint32(0x01000193)
        h[lag:] += low[: len(low) - lag] + np.uint32(1)
        x = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
        rows.append((x >> np.uint32(20)).astype(np.int64))
    depth = np.minimum(np.arange(len(low)) - np.repeat(off[:-1], np.diff(off)) + 1, len(ORDERS))
    return np.array(rows), depth


def _mean_weights(data: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(texts, classifiers) mean weight over the n-grams of each text, block by block; empty texts give 0."""
    total, count = np.zeros((len(off) - 1, weights.shape[1])), np.zeros(len(off) - 1)
    back = max(ORDERS) - 1
    for a in range(0, len(data), W.SLICE_BYTES):
        b, lead = min(a + W.SLICE_BYTES, len(data)), min(a, back)
        local = np.clip(off, a - lead, b) - (a - lead)
        first, last = int(np.searchsorted(off, a, side="right")) - 1, int(np.searchsorted(off, b, side="left"))
        rows, depth = _grams(data[a - lead : b], local[first : last + 1])
        edge = np.maximum(local[first : last + 1], lead)
        for c in range(weights.shape[1]):
            w = np.zeros(len(depth))
            for i in range(len(ORDERS)):
                w += np.where(depth > i, weights[i * BUCKETS + rows[i], c], 0.0)
            ends = np.concatenate([[0.0], np.cumsum(w)])
            total[first:last, c] += ends[edge[1:]] - ends[edge[:-1]]
        ends = np.concatenate([[0], np.cumsum(depth)])
        count[first:last] += ends[edge[1:]] - ends[edge[:-1]]
    return total / np.maximum(count, 1)[:, None]


def _features(texts: list[bytes]) -> np.ndarray:
    """(texts, buckets): shares of the n-grams of each whole text, block by block."""
    x = np.zeros((len(texts), len(ORDERS) * BUCKETS), dtype=np.float32)
    back = max(ORDERS) - 1
    for k, t in enumerate(texts):
        data = np.frombuffer(t, dtype=np.uint8)
        for a in range(0, len(data), W.SLICE_BYTES):
            lead = min(a, back)
            rows, depth = _grams(data[a - lead : a + W.SLICE_BYTES], np.array([0, len(data[a - lead : a + W.SLICE_BYTES])]))
            at = np.concatenate([i * BUCKETS + rows[i][lead:][depth[lead:] > i] for i in range(len(ORDERS))])
            x[k] += np.bincount(at, minlength=x.shape[1])
        x[k] /= max(1.0, x[k].sum())
    return x


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 100.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient descent; y is -1 or 1. Deterministic."""
    n = len(y)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1.0 / (1.0 + 2 * cost * float((share[:, None] * x * x).sum() + 1))
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    z, last = w.copy(), w.copy()
    for t in range(1, rounds + 1):
        miss = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * share
        g = np.concatenate([-2 * cost * ((miss * y) @ x), [-2 * cost * float((miss * y).sum())]]).astype(np.float32)
        g[:-1] += z[:-1]
        last, w = w, z - step * g
        z = w + np.float32((t - 1) / (t + 2)) * (w - last)
    return w[:-1], float(w[-1])


class Model:
    """Weights of all classifiers side by side, with the classes each of them decides between."""

    def __init__(self, sample: list[tuple[str, bytes]]):
        langs = sorted({lang for lang, _ in sample})
        self.families = {f: [g for g in langs if family_of(g) == f] for f in sorted({family_of(g) for g in langs})}
        names = list(self.families)
        self.pairs: list[tuple[str, str, str]] = [("family", a, b) for a, b in combinations(names, 2)]
        self.pairs += [("language", a, b) for f in names for a, b in combinations(self.families[f], 2)]
        x = _features([t for _, t in sample])
        used = np.flatnonzero(x.any(axis=0))
        x = x[:, used]
        middle = x.mean(axis=0)
        x -= middle
        scale = (1.0 / (np.sqrt((x**2).mean(axis=0)) + 1e-6) / np.sqrt(len(used))).astype(np.float32)
        x *= scale
        lang = np.array([g for g, _ in sample])
        fam = np.array([family_of(g) for g in lang])
        self.weights = np.zeros((len(ORDERS) * BUCKETS, len(self.pairs)))
        self.bias = np.zeros(len(self.pairs))
        for c, (level, a, b) in enumerate(self.pairs):
            kind = fam if level == "family" else lang
            rows = np.flatnonzero((kind == a) | (kind == b))
            w, self.bias[c] = _svm(x[rows], np.where(kind[rows] == a, 1.0, -1.0).astype(np.float32))
            self.weights[used, c] = w * scale
            self.bias[c] -= float(middle @ (w * scale))

    def _vote(self, margin: np.ndarray, pairs: list[tuple[str, str, str]], classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The class with most pairwise wins (sum of margins decides ties, then the name) and its confidence."""
        wins, sums = np.zeros((len(margin), len(classes))), np.zeros((len(margin), len(classes)))
        for c, (_, a, b) in enumerate(pairs):
            i, j, m = classes.index(a), classes.index(b), np.clip(margin[:, c], -30, 30)
            wins[:, i] += m >= 0
            wins[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
        best = np.argmax(wins * 1e6 + sums, axis=1)
        mean = sums[np.arange(len(margin)), best] / max(1, len(classes) - 1)
        return best, 1 / (1 + np.exp(-2 * mean)) if len(classes) > 1 else np.ones(len(margin))

    def _decide(self, data: np.ndarray, off: np.ndarray, level: str, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Only the classifiers between these classes look at the texts."""
        use = [c for c, (kind, a, b) in enumerate(self.pairs) if kind == level and a in classes and b in classes]
        return self._vote(_mean_weights(data, off, self.weights[:, use]) + self.bias[use], [self.pairs[c] for c in use], classes)

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        family, sure = self._decide(data, off, "family", names)
        lang, score = np.empty(len(off) - 1, dtype=object), np.zeros(len(off) - 1)
        for f, name in enumerate(names):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            classes = self.families[name]
            best, inner = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows))
            if len(classes) > 1:
                own = np.concatenate([data[off[r] : off[r + 1]] for r in rows])
                bound = np.concatenate([[0], np.cumsum(np.diff(off)[rows])])
                best, inner = self._decide(own, bound, "language", classes)
            lang[rows] = np.array(classes, dtype=object)[best]
            score[rows] = sure[rows] * inner
        return lang.tolist(), np.clip(score, 0.0, 1.0)


def _crop(text: bytes, size: int) -> bytes:
    """About ``size`` bytes of the text from a word's start, at a place that the text itself decides."""
    if len(text) <= size:
        return text
    at = zlib.crc32(text) % (len(text) - size)
    return text[text.find(b" ", at, at + 40) + 1 or at :][:size]


def train(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of ``sample_per_language`` different texts of each language, those of least hash (all, if fewer). None without rows.

    Copies of a text count once, every language that has a text with a letter is learned, and the sample depends
    neither on the order of rows nor on their partitions. Rows of null text or language and texts without a letter
    teach nothing. Texts are learned from whole, those of more than ``SAMPLE_CHARS`` characters by so many from a place
    that their hash gives, and a short piece of each besides. Only the sample and one count per language reach the
    driver: sample_per_language * SAMPLE_CHARS characters a language at most.
    """
    rows = labelled.where(col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}")).select(
        col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    different = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not different:
        return None
    # Four times the sample lies below a bound on the hash (the counts are right within a few percent); the least of them are taken.
    share = F.coalesce(*(F.when(F.col("lang") == g, F.lit(min(1 << 30, 1 + 4 * sample_per_language * (1 << 30) // max(1, n)))) for g, n in sorted(different.items())))
    texts = rows.where(F.shiftrightunsigned("h", 34) < share).groupBy("lang", "h").agg(F.min("text").alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))
    place = F.pmod("h", F.length("text") - SAMPLE_CHARS + 1).cast("int") + 1
    part = F.when(F.length("text") > SAMPLE_CHARS, F.substring("text", place, F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    picked = texts.withColumn("r", least).where(F.col("r") <= sample_per_language).select("lang", part.alias("text")).toArrow().to_pylist()
    whole = sorted((r["lang"], r["text"].encode()) for r in picked)
    return Model(whole + [(g, _crop(t, SHORT_BYTES[i % len(SHORT_BYTES)])) for i, (g, t) in enumerate(whole)])


def _predicted(model, names: tuple[str, str]):
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i, j, data, off in W.slices(texts):
                lang, score = model.value.predict(data, off) if model.value else ([UNKNOWN] * (j - i), np.zeros(j - i))
                real = [letter.search(t) is not None if t else False for t in texts.slice(i, j - i).to_pylist()]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:-1], pa.array([g if r else UNKNOWN for g, r in zip(lang, real, strict=True)], pa.string()), pa.array(np.where(real, score, 0.0))],
                    names=[*own.schema.names[:-1], *names])
    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of docs (default: all) with the language and a score (0 to 1), called by ``names``.

    Null and empty texts and texts without a letter are ``und`` with score 0, as all are without a model.
    Existing columns of these names are replaced; others pass, whatever they are called. Rows keep their
    number, repeated ones too. Whole texts are scored, block by block however long.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*map(col, keep), col(text_col).cast("string").alias("\0text"))
    schema = StructType([*rows.schema.fields[:-1], StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return rows.mapInArrow(_predicted(shared, names), schema)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the documents that training does not use; a null id counts as 0."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = train(docs.where("not held_out").select("text", "lang"))
    return identify(docs, model, keep=["doc_id", "held_out"])
