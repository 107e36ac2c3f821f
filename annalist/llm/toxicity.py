"""Toxicity by a classifier chain: linear models predict the categories in order, each fed its predecessors' probabilities.

A later model is trained with out-of-fold probabilities of the earlier ones, so it never sees how well they fit their own
training rows. The judged categories of `labels` are `low_quality` (quality = 0) and `toxic`; any list of 0/1 label
columns can be given, and the last one gives the verdict. Features are the presence of words and of word beginnings
of 4 to 6 letters (hashed); those without a clear association (|z| < MIN_Z in the training rows) are left out.

The models are fitted on the driver from at most `rows` labelled documents (smallest hash of the id: the documented
bound of the sample); scoring is one pass over all documents. Null texts count as empty and get the base rates; null
ids and null labels are no training rows, and of documents of equal id the least text is the labelled one; an empty
sample scores every row 0. Every row is scored, repeated ones and ones of a null id too; kept columns that are called like
a result are replaced by it. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.common import chunks, tidy

ROWS = 8000
BUCKETS = 1 << 20
FOLDS = 3
MIN_Z = 4.0
CATEGORIES = ("low_quality", "toxic")
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    heads = [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]
    return [zlib.crc32(x.encode()) & (BUCKETS - 1) for x in heads]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Linear:
    """L2-regularised logistic regression over present features and dense chain inputs."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, chain: np.ndarray, steps: int = 300):
        n, pos = len(y), max(int(y.sum()), 0)
        base = np.clip(pos / n, 1e-3, 1 - 1e-3)
        every = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        total = np.bincount(every, minlength=BUCKETS)
        hit = np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, t in zip(rows, y, strict=True) if t)]), minlength=BUCKETS)
        z = np.divide(hit - total * base, np.sqrt(total * base * (1 - base)), out=np.zeros(BUCKETS), where=total >= 4)
        self.features = np.flatnonzero(np.abs(z) >= MIN_Z)
        slot = np.full(BUCKETS, -1, np.int32)
        slot[self.features] = np.arange(len(self.features))
        col = slot[every]
        del total, hit, z, every
        kept = col >= 0
        owner, col = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])[kept], col[kept]
        k, d = len(self.features), chain.shape[1]
        theta = np.zeros(k + d + 1)
        theta[-1] = _logit(np.array(base))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            margin = np.bincount(owner, theta[col], n) + chain @ theta[k : k + d] + theta[-1]
            g = _sigmoid(margin) - y
            grad = np.concatenate((np.bincount(col, g[owner], k), chain.T @ g, [g.sum()])) / n
            grad[:-1] += 1e-5 * theta[:-1]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights, self.chain, self.bias = theta[:k], theta[k : k + d], theta[-1]

    def predict(self, rows: list[np.ndarray], chain: np.ndarray) -> np.ndarray:
        table = np.zeros(BUCKETS)
        table[self.features] = self.weights
        return _sigmoid(np.array([table[r].sum() for r in rows]) + chain @ self.chain + self.bias)


class Chain:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS):
        n = len(rows)
        fold = np.arange(n) % folds
        chain = np.zeros((n, 0))
        self.models = []
        for j in range(labels.shape[1]):
            y = labels[:, j].astype(float)
            self.models.append(Linear(rows, y, chain))
            if j == labels.shape[1] - 1:
                break
            out = np.zeros(n)
            for f in range(folds):
                fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(fit) and len(rest):
                    out[rest] = Linear([rows[i] for i in fit], y[fit], chain[fit]).predict([rows[i] for i in rest], chain[rest])
            chain = np.column_stack((chain, _logit(out)))
        used: dict[int, list[float]] = {}
        for j, model in enumerate(self.models):
            for f, w in zip(model.features.tolist(), model.weights.tolist(), strict=True):
                used.setdefault(f, [0.0] * len(self.models))[j] = w
        self.weights = used
        self.links = [m.chain.tolist() for m in self.models]
        self.bias = [float(m.bias) for m in self.models]
        del self.models

    def score(self, texts: list[str | None], cache: dict) -> list[list[float]]:
        out = []
        for text in texts:
            present: set[int] = set()
            for word in set(_WORD.findall((text or "").lower())):
                own = cache.get(word)
                if own is None:
                    if len(cache) > 300_000:
                        cache.clear()
                    own = cache[word] = tuple(f for f in word_features(word) if f in self.weights)
                if own:
                    present.update(own)
            probs, chain = [], []
            for j, bias in enumerate(self.bias):
                margin = bias + sum(self.weights[f][j] for f in present) + sum(a * b for a, b in zip(chain, self.links[j], strict=True))
                probs.append(float(_sigmoid(margin)))
                chain.append(float(_logit(np.array(probs[-1]))))
            out.append(probs)
        return out


def _features(texts: DataFrame, names: list[str]) -> DataFrame:
    def run(batches):
        for batch in chunks(batches, "text"):
            rows = [np.unique(np.array([f for w in set(_WORD.findall((t or "").lower())) for f in word_features(w)], np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(n) for n in names), pa.array(rows, pa.binary())], names=["id", *names, "features"])

    return texts.mapInArrow(tidy(run), "id long, " + ", ".join(f"{n} int" for n in names) + ", features binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = CATEGORIES, rows: int = ROWS) -> Chain | None:
    """labels: id_col and one 0/1 column per category; a row with a null label or without a document is not used."""
    names = list(categories)
    few = labels.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("int").alias(c) for c in names)).dropna()
    few = few.groupBy("id").agg(*(F.max(c).alias(c) for c in names)).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # few has at most `rows` rows, and a repeated id is one row before Python and the driver see it.
    labelled = texts.join(F.broadcast(few), "id").groupBy("id", *names).agg(F.min("text").alias("text"))
    got = sorted(_features(labelled, names).collect(), key=lambda r: zlib.crc32(str(r.id).encode()))
    if not got:
        return None
    return Chain([np.frombuffer(r.features, np.uint32).astype(np.int32) for r in got], np.array([[r[n] for n in names] for r in got]))


def label_categories(labels: DataFrame) -> DataFrame:
    """`labels` (doc_id, quality, toxic) as the judged categories."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


def score(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = CATEGORIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, p_<category>..., toxic) for every row; `toxic` tells whether the last category's probability is 0.5 or more."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    made = [f"p_{c}" for c in categories]
    kept = [c for c in dict.fromkeys((id_col, *keep)) if c not in (*made, "toxic")]
    text = text_col if text_col in kept else "__text"  # the text goes to Python once
    base = docs.select(*(F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept), *([] if text in kept else [F.col(text_col).cast("string").alias(text)]))
    out = T.StructType([*base.select(*kept).schema.fields, *(T.StructField(c, T.DoubleType()) for c in made)])

    def run(batches):
        chain, cache = held.value, {}
        for batch in chunks(batches, text):
            texts = batch.column(text).to_pylist()
            probs = chain.score(texts, cache) if chain else [[0.0] * len(categories)] * len(texts)
            cols = [pa.array([p[j] for p in probs], pa.float64()) for j in range(len(categories))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], names=out.names)

    return base.mapInArrow(tidy(run), out).withColumn("toxic", F.col(made[-1]) >= 0.5)
