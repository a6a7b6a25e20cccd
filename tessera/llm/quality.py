"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated scores.

Random indexing gives every word of the fitted vocabulary a sparse ternary index vector, and
a word vector that adds the index vectors of its neighbours in the fitting texts.  A word
outside the vocabulary stands under its shape (letters, digits and marks in a row folded),
hashed to one of ``SHAPES`` places.  A text is pooled to the mean and the spread of its word
vectors, a two-layer numpy network scores it, and a temperature fitted on rows kept aside
from training calibrates the probability.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, kept

VOCABULARY, SHAPES, DIM, HIDDEN, EPOCHS = 3000, 1024, 48, 24, 40
#: The classifier is fitted on this many labelled rows, and this many bytes of text, at most, in
#: the order of a hash; a text that would go beyond the bytes is passed over.
SAMPLE, SAMPLE_BYTES = 8000, 32 << 20
#: Shapes of words that the driver remembers while it fits.
FIT_CACHE = 50_000
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
_UP, _LOW, _DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")


def shape(word: bytes) -> int:
    """Folds runs: Word9! -> A a 0 !; marks keep their kind and their number up to three."""
    folded = _DIGIT.sub(b"0", _LOW.sub(b"a", _UP.sub(b"A", word)))[:8]
    return VOCABULARY + crc32(folded) % SHAPES


class Words:
    def __init__(self, vocabulary: dict[bytes, int], cache: int = 400_000):
        self.fixed, self.cache, self.most = vocabulary, dict(vocabulary), cache

    def of(self, text: str | None) -> np.ndarray:
        if len(self.cache) > self.most:
            self.cache = dict(self.fixed)
        cache, out = self.cache, []
        for w in (text or "").encode("utf-8", "surrogatepass").split():
            k = cache.get(w)
            if k is None:
                k = cache[w] = shape(w)
            out.append(k)
        return np.array(out, dtype=np.int32)


def word_vectors(texts: list[np.ndarray], seed: int) -> np.ndarray:
    """Random indexing with a window of one word to either side."""
    rng = np.random.default_rng(seed)
    size = VOCABULARY + SHAPES
    index = rng.choice(np.array([-1, 0, 0, 0, 0, 0, 0, 1], dtype=np.float32), (size, DIM)) * 2
    context = np.zeros((size, DIM), dtype=np.float32)
    end = np.array([-1], dtype=np.int32)
    flat = np.concatenate([x for t in texts for x in (t, end)]) if texts else np.zeros(0, np.int32)
    if len(flat) > 1:
        a, b = flat[:-1], flat[1:]
        both = (a >= 0) & (b >= 0)
        key, n = np.unique(a[both] * size + b[both], return_counts=True)
        a, b = key // size, key % size
        for lo in range(0, len(key), 50_000):
            x, y, w = a[lo : lo + 50_000], b[lo : lo + 50_000], n[lo : lo + 50_000, None].astype(np.float32)
            np.add.at(context, x, index[y] * w)
            np.add.at(context, y, index[x] * w)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + 2 * context / np.where(norm > 0, norm, 1)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, the share of repeats and the log length; zeros for no words."""
    if not len(ids):
        return np.zeros(2 * DIM + 2, dtype=np.float32)
    at, n = np.unique(ids, return_counts=True)
    share = (n / len(ids)).astype(np.float32)
    v = vectors[at]
    mean = share @ v
    spread = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    same = float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0
    return np.concatenate([mean, spread, [same, np.log1p(len(ids)) / 5]]).astype(np.float32)


class Network:
    """Two layers; ``fit`` leaves a temperature from the rows kept aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        train = ~aside if (~aside).any() else np.ones(len(y), dtype=bool)
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-3
        z, t = (x - self.mean) / self.scale, y.astype(np.float64)
        k = x.shape[1]
        p = [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, step = [0 * a for a in p], [0 * a for a in p], 0
        rows = np.nonzero(train)[0]
        for _ in range(EPOCHS):
            rng.shuffle(rows)
            for lo in range(0, len(rows), 128):
                r = rows[lo : lo + 128]
                h = np.maximum(z[r] @ p[0] + p[1], 0)
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[r]) / len(r)
                back = np.outer(e, p[2]) * (h > 0)
                grad = [z[r].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
                step += 1
                for i, g in enumerate(grad):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.99 * s[i] + 0.01 * g * g
                    p[i] = p[i] - 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        kept_aside = aside if aside.any() else np.ones(len(y), dtype=bool)
        logit, t = self.logit(x[kept_aside]), t[kept_aside]
        loss = {c: float(np.mean(np.logaddexp(0, np.where(t > 0, -1, 1) * logit / c))) for c in np.geomspace(0.5, 8, 33)}
        self.temperature = min(loss, key=loss.get)

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0)
        return h @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple:
    """(vocabulary, word vectors, network or None) from at most ``sample`` labelled rows.

    Rows held out, without a label or without an id teach nothing; of the texts and labels
    that repeat an id the least teaches, so the model is a function of the tables however they
    are partitioned.  Null texts teach as empty ones.  With labels of one kind only, or empty
    tables, there is nothing to tell apart, and the network is None.
    """
    y = F.col(label_col).cast("int")
    known = labels.where(y.isin(0, 1) & F.col(id_col).isNotNull() & ~held_out).select(F.col(id_col).alias("__id"), y.alias("__y"))
    known = known.groupBy("__id").agg(F.min("__y").alias("__y")).withColumn("__order", F.md5(F.concat(F.lit("sample"), F.col("__id").cast("string"))))
    known = known.orderBy("__order").limit(sample)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("__id")).groupBy("__order", "__y").agg(F.min(text).alias("__text"))
    rows = cut(rows)
    left, chosen = SAMPLE_BYTES, []
    for order, size in sorted(map(tuple, rows.select("__order", F.octet_length("__text")).collect())):
        if size <= left:
            left -= size
            chosen.append((order,))
    picked = rows.sparkSession.createDataFrame(chosen, "__order string")
    rows = rows.join(F.broadcast(picked), "__order")
    words = rows.select(F.explode(F.array_distinct(F.split("__text", BLANKS))).alias("word")).where("word <> ''")
    frequent = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    vocabulary = {r["word"].encode(): k for k, r in enumerate(frequent.collect())}
    taught = rows.orderBy("__order").toArrow()
    y, texts = taught.column("__y").to_numpy(), taught.column("__text")
    known_words = Words(vocabulary, FIT_CACHE)
    ids = [known_words.of(t.as_py()) for t in texts]
    del taught, texts
    vectors = word_vectors(ids, seed)
    if not len(y) or y.min() == y.max():
        return vocabulary, vectors, None
    x = np.stack([pool(i, vectors) for i in ids])
    return vocabulary, vectors, Network(x, y, np.arange(len(y)) % 5 == 0, seed)


def _score(batches: Iterator[pa.RecordBatch], key: str, shared) -> Iterator[pa.RecordBatch]:
    vocabulary, vectors, network = shared.value
    words = kept(("quality", key), lambda: Words(vocabulary))
    for b in batches:
        texts = b.column(b.num_columns - 1)
        scores: list[float] = []
        for lo in range(0, b.num_rows, 256):
            x = np.stack([pool(words.of(t.as_py()), vectors) for t in texts.slice(lo, 256)])
            scores += (network.score(x) if network else np.ones(len(x))).tolist()
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "score"])


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``; only the text is an input of a score.

    Null and empty texts are pooled to zeros and scored like any other; without a fitted
    network every row scores 1.  Equal texts score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(partial(_score, key=_key(model), shared=shared), f"`{id_col}` {kind}, score double")


def _key(model: tuple) -> str:
    return hashlib.md5(b"".join(model[0]) + model[1].tobytes()).hexdigest()


def keep_good(docs: DataFrame, model: tuple, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``limit``; all columns stay as they are."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text = pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(text_col))], names=["text"])
                scores = next(_score(iter([text]), key, shared)).column(0).to_numpy()
                yield b.filter(pa.array(scores >= limit))

    return docs.mapInArrow(good, docs.schema)
