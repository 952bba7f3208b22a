"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts, spell each word character
by character from its start to its end marker.  Their highest order holds the counts of the own class;
below it both share one chain of backoff distributions made of continuation counts, so an expression
that neither class knows well is judged alike by both and rare ones (an inflected or compounded word)
are judged by the parts they share with frequent ones.  A text is compared by the length-normalised
difference of the two log-likelihoods: over its strongest expression, its three strongest ones, and all
its characters.  A logistic function of these and of the length, fitted on labelled rows that the models did not see, gives the score.

Only the bounded, documented sample of labelled rows (``per_class`` of each class, those with the
smallest hashes of their ids) is used for fitting; every whole text is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 8
DISCOUNT = 0.9
STRONGEST = 3
FEATURES = 4
PER_CLASS = 8000
RIDGE = 0.05
_START, _END = b"\x02", b"\x03"
_CACHE = 400_000
_PIECE = 4 << 20

_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


def spell(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each character after the start marker: code of it and the ``order - 1`` before it, and its word."""
    flat = np.frombuffer(b"".join(_START + w + _END for w in words), np.uint8).astype(np.uint64)
    starts = flat == _START[0]
    index = np.arange(len(flat))
    depth = index - np.maximum.accumulate(np.where(starts, index, 0))
    code = np.zeros(len(flat), np.uint64)
    for back in range(order):
        seen = np.zeros(len(flat), np.uint64)
        seen[back:] = flat[: max(0, len(flat) - back)]
        seen[depth < back] = 0
        code |= seen << np.uint64(8 * back)
    return code[~starts], (np.cumsum(starts) - 1)[~starts]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Level:
    """Counts of grams, and total and number of types of each context."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray = field(init=False)
    totals: np.ndarray = field(init=False)
    types: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.contexts, of = np.unique(self.grams >> np.uint64(8), return_inverse=True)
        self.totals = np.bincount(of, self.counts, len(self.contexts)).astype(np.float32)
        self.types = np.bincount(of, self.counts > 0, len(self.contexts)).astype(np.float32)

    def smooth(self, code: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
        """Absolute discounting over ``lower``; an unknown context leaves ``lower``."""
        if not len(self.grams):
            return lower
        at, have = _find(self.grams, code)
        count = np.where(have, self.counts[at], 0)
        at, known = _find(self.contexts, code >> np.uint64(8))
        total = self.totals[at]
        known &= total > 0
        mixed = (np.maximum(count - discount, 0) + discount * self.types[at] * lower) / np.maximum(total, 1)
        return np.where(known, mixed, lower)


class KneserNey:
    """The pair of models from ``(gram, toxic count, ordinary count)``, grams ascending."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, discount: float = DISCOUNT) -> None:
        self.order, self.discount, self._counts = order, discount, (grams, toxic, ordinary)
        self.own = [Level(grams, counts.astype(np.float32)) for counts in (toxic, ordinary)]
        self.shared: list[Level] = []
        for k in range(order - 1, 0, -1):
            grams, types = np.unique(grams & np.uint64((1 << 8 * k) - 1), return_counts=True)
            self.shared.append(Level(grams, types.astype(np.float32)))

    def __reduce__(self) -> tuple:
        """Only the counts travel, compressed; tables are made again where they are used."""
        grams, *counts = self._counts
        packed = [zlib.compress(_planes(np.diff(grams, prepend=np.uint64(0))), 1)] + [zlib.compress(_planes(c.astype(np.uint64)), 1) for c in counts]
        return _unpack, (packed, self.order, self.discount)

    def ratio(self, words: list[bytes]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        if not words:
            return np.zeros(0)
        code, word = spell(words, self.order)
        lower = np.full(len(code), 1 / 256)
        for k, level in zip(range(1, self.order), reversed(self.shared), strict=True):
            lower = level.smooth(code & np.uint64((1 << 8 * k) - 1), lower, self.discount)
        toxic, ordinary = (np.log(level.smooth(code, lower, self.discount)) for level in self.own)
        return np.bincount(word, toxic - ordinary, len(words))


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(packed: list[bytes], order: int, discount: float) -> KneserNey:
    gaps, toxic, ordinary = (np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).view(np.uint64).ravel() for x in packed)
    return KneserNey(np.cumsum(gaps, dtype=np.uint64), toxic, ordinary, order, discount)


@dataclass
class Model:
    """The two models (a broadcast of them), and mean, scale and weights of the logistic function of the features."""

    kn: Broadcast
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(features)), (features - self.center) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Features:
    """For whole texts: log-likelihood difference of the strongest expression, mean of the strongest
    distinct ones, mean per character, and the log of the length in words."""

    def __init__(self, kn: KneserNey) -> None:
        self.kn, self.known = kn, {}

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        out, held, size = [], [], 0
        for text in texts:
            held.append(words_of(text))
            size += len(text or b"")
            if size >= _PIECE:
                out.append(self._of(held))
                held, size = [], 0
        out.append(self._of(held))
        return np.concatenate(out)

    def _of(self, docs: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > _CACHE:
            self.known.clear()
        new = list({w for words in docs for w in words}.difference(self.known))
        self.known.update(zip(new, self.kn.ratio(new).tolist(), strict=True))
        got = np.zeros((len(docs), FEATURES))
        for row, words in zip(got, docs, strict=True):
            if words:
                value = np.fromiter(map(self.known.__getitem__, words), float, len(words))
                top = np.unique(value)[-STRONGEST:]
                row[:] = top[-1], top.sum() / STRONGEST, value.sum() / (sum(map(len, words)) + len(words)), np.log1p(len(words))
        return got


def logistic(features: np.ndarray, label: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: center, scale, weights.  One class only: a constant."""
    center = features.mean(0) if len(features) else np.zeros(FEATURES)
    scale = np.maximum(features.std(0), 1e-9) if len(features) else np.ones(FEATURES)
    weights = np.zeros(FEATURES + 1)
    share = label.mean() if len(label) else 0.0
    if not 0 < share < 1:
        weights[0] = -6.0 if share < 0.5 else 6.0
        return center, scale, weights
    x = np.column_stack([np.ones(len(features)), (features - center) / scale])
    penalty = np.diag([0.0] + [ridge] * FEATURES)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (label - p) - penalty @ weights
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(FEATURES + 1)
        step = np.linalg.solve(hessian, gradient)
        weights += step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, weights


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int) -> DataFrame:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    known = known.withColumn("__hash", F.xxhash64(F.lit("toxicity"), F.col("__id")))
    both = [known.where(F.col("__label") == c).orderBy("__hash", "__id").limit(per_class) for c in (0, 1)]
    rows = F.broadcast(both[0].unionByName(both[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(rows, "__id").select("text", F.col("__label").alias("label"), (F.pmod("__hash", F.lit(4)) == 0).alias("calibrates"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Model from ``labels(doc_id, toxic 0/1)``; of several labels of an id the largest holds, others than 0 and 1 do not count."""
    sample = _sample(docs, labels, label_col, id_col, text_col, per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[label].update(words_of(text.as_py()))
        grams, counts = [], []
        for label, words in enumerate(seen):
            if words:
                code, word = spell(list(words))
                number = np.fromiter(words.values(), np.int64, len(words))[word]
                both = np.zeros((len(code), 2), np.int64)
                both[:, label] = number
                grams.append(code)
                counts.append(both)
        if grams:
            code, of = np.unique(np.concatenate(grams), return_inverse=True)
            every = np.concatenate(counts)
            sums = [pa.array(np.bincount(of, every[:, c], len(code)).astype(np.int64)) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *sums], names=["gram", "toxic", "ordinary"])

    counted = sample.where("not calibrates").select("text", "label").mapInArrow(count, "gram long, toxic long, ordinary long")
    table = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
    grams, *counts = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("gram", "toxic", "ordinary"))
    order = np.argsort(grams)
    kn = KneserNey(grams[order], counts[0][order], counts[1][order])
    sent = docs.sparkSession.sparkContext.broadcast(kn)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sent.value)
        for batch in batches:
            got = features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*map(pa.array, got.T), batch.column(1)], names=[*names, "label"])

    names = [f"f{i}" for i in range(FEATURES)]
    seen = sample.where("calibrates").select("text", "label").mapInArrow(measure, "".join(f"{n} double, " for n in names) + "label int").toArrow().to_pandas()
    seen = seen.sort_values([*names, "label"])
    return Model(sent, *logistic(seen[names].to_numpy(float), seen["label"].to_numpy(float)))


def scorer(model: Model):
    """A column function of a text: its score between 0 and 1."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(model.kn.value)
        for batch in texts:
            yield pd.Series(model.scores(features(batch.tolist())))

    return lambda text: score(F.col(text).cast("binary"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``.

    Null, empty and wordless texts have no expressions and get the score of a text without evidence.
    Repeated rows get equal scores; null ids are kept; other columns are not read.  Without labelled rows
    of both classes every text gets one constant score, below 0.5 unless all labels are 1.
    """
    got = docs.select(F.col(id_col).alias("doc_id"), scorer(model)(text_col).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns stay as they are."""
    return docs.where(scorer(model)(text_col) < 0.5)
