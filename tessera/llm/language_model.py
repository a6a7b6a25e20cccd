"""Log-bilinear language model trained with noise-contrastive estimation, and unigram scores.

The most frequent words, up to ``WORDS`` of those met ``LEAST`` times, are units of their own,
as is the end of a text; the rest fall into ``BUCKETS`` buckets by their ends.  Units are cut
into classes of about equal weight, and the probability of a unit is that of its class times
that of the unit within the class.  The context vector is the position-weighted sum of the two
last units' vectors; the logit of a class or a unit is its product with an output vector plus a
bias.  Both levels are trained by noise-contrastive estimation against the unigram; the
expectation over ``NOISE`` noise units is taken in full instead of by draws, so training has no
randomness beyond its seed.  Batched matrix products over all classes, and over the units of
each class, give the normalised log-probabilities.  Within a bucket a word has its add-one
share.

Training reads every token of the training texts once.  Texts are dealt by a hash of their row
to shards, one for each ``SHARD`` tokens, and ordered by that hash, so neither partitions nor
lost executors change the result; each shard trains from the same start, and the parameters
are averaged by tokens, ``FAN`` shards at a time.

Word counts are exact.  The counts of the ``TABLE`` most frequent words travel as a broadcast
table of that bounded size; tokens beyond it are joined with the counts by a shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, slices

WORDS, LEAST, BUCKETS, CLASSES = 4000, 20, 64, 64
TABLE, FLUSH, CACHE = 131_072, 200_000, 400_000
#: Rows at once at the level of classes, so that the products stay in a cache.
PIECE = 2048
#: The end of a text as a token; no word holds a blank.
END_KEY = b" "
DIM, BATCH, NOISE, RATE, SHARD, FAN = 16, 8192, 10, 0.2, 4_000_000, 64


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket(word: bytes) -> int:
    return crc32(word[:1] + b" " + word[-2:]) % BUCKETS


class Units(dict):
    """From a word to its number in the table; a word beyond it gets a number of its own for a while.

    Units are the end, the first ``words`` of the table, and the buckets; ``unit`` gives those
    of the numbers.
    """

    def __init__(self, table: list[bytes], words: int):
        super().__init__({w: k for k, w in enumerate(table)})
        self.table, self.words = table, words
        self.size = words + 1 + BUCKETS
        self.of_table = np.array([words if w == END_KEY else k if k < words else words + 1 + bucket(w) for k, w in enumerate(table)], dtype=np.int64)
        self.others: list[int] = []
        self.known = self.of_table

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.table) + len(self.others)
        self.others.append(self.words + 1 + bucket(word))
        return k

    def unit(self) -> np.ndarray:
        met = len(self.known) - len(self.table)
        if met < len(self.others):
            self.known = np.concatenate([self.known, np.array(self.others[met:], dtype=np.int64)])
        return self.known

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words; the cache is emptied before, never within, a call."""
        if len(self.others) > CACHE:
            self.clear()
            self.update((w, k) for k, w in enumerate(self.table))
            self.others, self.known = [], self.of_table
        get = self.__getitem__
        return np.fromiter(map(get, chain.from_iterable(texts)), dtype=np.int64)


class Model:
    """Parameters by the rank of a unit; ranks go by count, so that classes are ranges of them."""

    NAMES = ("context", "position", "class_out", "class_bias", "out", "bias")

    def __init__(self, counts: np.ndarray, seed: int = 3):
        n = np.asarray(counts, dtype=np.float64)
        order = np.argsort(-n, kind="stable")
        self.rank = np.empty(len(n), dtype=np.int64)
        self.rank[order] = np.arange(len(n))
        mass = np.sqrt(n[order] + 1)
        cls = np.floor((np.cumsum(mass) - mass) / mass.sum() * CLASSES)
        self.cls = np.unique(cls, return_inverse=True)[1]
        self.start = np.concatenate([np.nonzero(np.diff(self.cls, prepend=-1))[0], [len(n)]])
        p = (n[order] + 0.1) / (n + 0.1).sum()
        class_noise = np.bincount(self.cls, weights=p)
        self.class_noise, self.noise = class_noise.astype(np.float32), (p / class_noise[self.cls]).astype(np.float32)
        self.pad = len(n)
        rng, classes = np.random.default_rng(seed), len(self.start) - 1
        f = np.float32
        self.context = rng.normal(0, 0.5, (len(n) + 1, DIM)).astype(f)
        self.position = np.ones((2, DIM), dtype=f)
        self.class_out, self.class_bias = np.zeros((classes, DIM), dtype=f), np.log(self.class_noise).astype(f)
        self.out, self.bias = np.zeros((len(n), DIM), dtype=f), np.log(self.noise).astype(f)

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            x = getattr(self, k)
            setattr(self, k, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size

    def hidden(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self.context * self.position[0]).take(a, axis=0)
        h += (self.context * self.position[1]).take(b, axis=0)
        return h

    def by_class(self, w: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The order of the rows by class, and the units and sorted rows of each class of more than one unit."""
        cls = self.cls[w].astype(np.uint16)  # 16 bits are sorted by radix
        order = np.argsort(cls, kind="stable")
        ends = np.concatenate([[0], np.bincount(cls, minlength=len(self.start) - 1).cumsum()]).tolist()
        return order, [(slice(x, y), slice(lo, hi)) for x, y, lo, hi in zip(self.start[:-1].tolist(), self.start[1:].tolist(), ends, ends[1:]) if y - x > 1 and hi > lo]

    def log10p(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | a, b) of ranks, normalised over all units."""
        order, parts = self.by_class(w)
        w = w[order]
        h = self.hidden(a[order], b[order])
        cls, p = self.cls[w], np.empty(len(w))
        for lo in range(0, len(w), PIECE):
            rows = slice(lo, lo + PIECE)
            p[rows] = _log_softmax_at(h[rows] @ self.class_out.T + self.class_bias, cls[rows])
        for units, rows in parts:
            p[rows] += _log_softmax_at(h[rows] @ self.out[units].T + self.bias[units], w[rows] - units.start)
        out = np.empty_like(p)
        out[order] = p
        return out / math.log(10)


def _log_softmax_at(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
    if logit.size and not -60 < logit.min() <= logit.max() < 60:  # else no exponential leaves its range
        logit -= logit.max(axis=1, keepdims=True)
    picked = logit[np.arange(len(at)), at].astype(np.float64)
    return picked - np.log((np.exp(logit, out=logit) @ np.ones(logit.shape[1], dtype=logit.dtype)).astype(np.float64))


def _errors(against: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gradient of the noise-contrastive objective by logit: data at ``at`` against noise units of expected number ``weight``.

    ``against`` holds the logarithm of that number less the logit and is overwritten.
    """
    e = np.exp(against, out=against)  # an infinite one stands for no error of the noise, a whole one of the data
    picked = e[(rows := np.arange(len(at))), at]
    e += 1
    np.divide(-weight, e, out=e)
    e[rows, at] += 1 - 1 / (1 + picked)
    return e


class Trainer:
    """Adagrad over batches of (a, b, w) ranks."""

    def __init__(self, model: Model):
        self.m = model
        self.seen = {k: np.full(getattr(model, k).shape, 1e-6, dtype=np.float32) for k in model.NAMES}
        self.class_noise, self.noise = ((NOISE * x, np.log(NOISE * x)) for x in (model.class_noise, model.noise))

    @np.errstate(over="ignore")
    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        order, parts = m.by_class(w)
        a, b, w = a[order], b[order], w[order]
        h = m.hidden(a, b)
        weight, log_weight = self.class_noise
        back, grad = np.empty_like(h), {"class_out": np.zeros_like(m.class_out), "class_bias": np.zeros_like(m.class_bias)}
        against, cls = log_weight - m.class_bias, m.cls[w]
        for lo in range(0, n, PIECE):
            rows = slice(lo, lo + PIECE)
            e = _errors(h[rows] @ -m.class_out.T + against, weight, cls[rows])
            back[rows] = e @ m.class_out
            grad["class_out"] += e.T @ h[rows]
            grad["class_bias"] += e.sum(0)
        grad["out"], grad["bias"] = np.zeros_like(m.out), np.zeros_like(m.bias)
        weight, log_weight = self.noise
        against = log_weight - m.bias
        for units, rows in parts:
            out, x = m.out[units], h[rows]
            e = _errors(x @ -out.T + against[units], weight[units], w[rows] - units.start)
            back[rows] += e @ out
            grad["out"][units], grad["bias"][units] = e.T @ x, e.sum(0)
        grad["position"] = np.stack([np.einsum("ij,ij->j", back, m.context[x]) for x in (a, b)])
        # Context vectors: the rows of one unit are added up after sorting, and only met units move.
        at, d = np.concatenate([a, b]), np.concatenate([back * m.position[0], back * m.position[1]])
        order = np.argsort(at.astype(np.min_scalar_type(m.pad)), kind="stable")
        at = at[order]
        first = np.nonzero(np.diff(at, prepend=-1))[0]
        self._move("context", at[first], np.add.reduceat(d.take(order, axis=0), first, axis=0) / np.float32(n))
        for k, g in grad.items():
            self._move(k, slice(None), g / np.float32(n))

    def _move(self, name: str, where, g: np.ndarray) -> None:
        seen = self.seen[name][where] + g * g
        self.seen[name][where] = seen
        getattr(self.m, name)[where] += np.float32(RATE) * g / np.sqrt(seen)


def contexts(units: np.ndarray, sizes: np.ndarray, rank: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) ranks of every token of texts laid end to end, each led by two pads."""
    w = rank[units]
    start = np.zeros(len(w), dtype=bool)
    start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    b = np.where(start, pad, np.concatenate([[pad], w[:-1]]))
    a = np.concatenate([[pad], b[:-1]])
    return np.where(start, pad, a), b, w


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words, sent on whenever ``FLUSH`` different ones have been met."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    for b in batches:
        for t in b.column(0):
            seen.update(tokens_of(t.as_py()))
            seen[END_KEY] += 1
            if len(seen) >= FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _sums(batches: Iterator[pa.RecordBatch], table: list[bytes], words: int) -> Iterator[pa.RecordBatch]:
    """Tokens and different words of each unit."""
    units = Units(table, words)
    n, v = np.zeros(units.size, dtype=np.int64), np.zeros(units.size, dtype=np.int64)
    for b in batches:
        numbers = units.numbers([b.column(0).to_pylist()])
        at = units.unit()[numbers]
        np.add.at(n, at, b.column(1).to_numpy())
        np.add.at(v, at, 1)
    some = np.nonzero(v)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(v[some])], names=["unit", "n", "v"])


SHARDED = "shard long, tokens long, parameters binary"


def _sharded(shard: int, tokens: int, parameters: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([tokens], pa.int64()), pa.array([parameters.tobytes()], pa.binary())], names=["shard", "tokens", "parameters"])


def _learn(batches: Iterator[pa.RecordBatch], key: str, shared, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (shard, text) come sorted by shard: parameters of each shard."""
    table, words = shared.value
    units = kept(("units", key), lambda: Units(table, words))
    shard, tokens, trainer, waiting = None, 0, None, []

    def steps(last: bool) -> None:
        nonlocal waiting
        x = [np.concatenate(c) for c in zip(*waiting)]
        whole = len(x[0]) if last else len(x[0]) // BATCH * BATCH
        for lo in range(0, whole, BATCH):
            trainer.step(*(c[lo : min(lo + BATCH, whole)] for c in x))
        waiting = [tuple(c[whole:] for c in x)]

    for whole in batches:
        shards = whole.column(0).to_numpy()
        ends = np.concatenate([[0], np.nonzero(np.diff(shards))[0] + 1, [whole.num_rows]]) if whole.num_rows else [0]
        for lo, hi in zip(ends[:-1], ends[1:]):
            if shards[lo] != shard:
                if trainer:
                    steps(True)
                    yield _sharded(shard, tokens, trainer.m.parameters())
                shard, tokens, trainer, waiting = shards[lo], 0, Trainer(Model(counts)), []
            for part in slices([whole.slice(lo, hi - lo)]):
                texts = [[*tokens_of(t.as_py()), END_KEY] for t in part.column(1)]
                numbers = units.numbers(texts)
                waiting.append(contexts(units.unit()[numbers], np.array([len(t) for t in texts]), trainer.m.rank, trainer.m.pad))
                tokens += len(numbers)
                steps(False)
    if trainer:
        steps(True)
        yield _sharded(shard, tokens, trainer.m.parameters())


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and shard: the mean of each group by tokens."""
    group, tokens, total = None, 0, 0.0
    for b in batches:
        for g, n, p in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
            if g != group and group is not None:
                yield _sharded(group, tokens, (total / tokens).astype(np.float32))
                tokens, total = 0, 0.0
            group, tokens, total = g, tokens + n, total + np.frombuffer(p, dtype=np.float32).astype(np.float64) * n
    if group is not None:
        yield _sharded(group, tokens, (total / tokens).astype(np.float32))


def train(training: DataFrame, table: list[bytes], words: int, counts: np.ndarray, tokens: int, key: str) -> Model:
    """The model from all rows (row hash, text) of ``training``; ``counts`` are the tokens of each unit."""
    model, shards = Model(counts), max(1, math.ceil(tokens / SHARD))
    shared = training.sparkSession.sparkContext.broadcast((table, words))
    dealt = training.select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "text").repartition(shards, "shard").sortWithinPartitions("shard", "h", "text")
    learned = cut(dealt.select("shard", "text").mapInArrow(partial(_learn, key=key, shared=shared, counts=counts), SHARDED))
    while shards > FAN:
        shards = math.ceil(shards / FAN)
        grouped = learned.select(F.expr(f"shard div {FAN}").alias("g"), "shard", "tokens", "parameters").repartition(shards, "g").sortWithinPartitions("g", "shard")
        learned = cut(grouped.mapInArrow(_mean, SHARDED))
    rows = sorted(learned.collect())
    if rows:
        model.set(sum(np.frombuffer(r["parameters"], dtype=np.float32).astype(np.float64) * r["tokens"] for r in rows) / sum(r["tokens"] for r in rows))
    return model


def _least(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach; found from the number of words by count."""
    above, least = 0, 1
    for c, n in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        if above + n > most:
            return c + 1
        above, least = above + n, c
    return least


MISS = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))


def _score(batches: Iterator[pa.RecordBatch], key: str, shared) -> Iterator[pa.RecordBatch]:
    """Sums over the tokens that the broadcast table has, and the other words with their counts."""
    table, words, counts, share, model = shared.value
    units = kept(("units", key), lambda: Units(table, words))
    logs = kept(("logs", key), lambda: np.log10(counts + 1.0))
    for b in slices(batches):
        texts = [[*tokens_of(t.as_py()), END_KEY] for t in b.column(b.num_columns - 1)]
        sizes = np.array([len(t) for t in texts])
        numbers = units.numbers(texts)
        unit = units.unit()[numbers]
        told = numbers < len(table)
        value = np.where(told, logs[np.where(told, numbers, 0)], 0.0)
        p = np.concatenate([model.log10p(*(c[lo : lo + 65_536] for c in x)) for x in [contexts(unit, sizes, model.rank, model.pad)] for lo in range(0, len(unit), 65_536)])
        # A word in a bucket has, beside the bucket's probability, its share of it.
        p += share[unit] + np.where(unit > words, value, 0.0)
        first = np.cumsum(sizes) - sizes
        known, base, score = (np.add.reduceat(x, first) for x in (told.astype(np.int64), value, p))
        misses = []
        for t, at, n in zip(texts, first.tolist(), (sizes - known).tolist()):
            lost = Counter([t[k] for k in np.nonzero(~told[at : at + len(t)])[0].tolist()]) if n else {}
            misses.append([{"word": w, "times": c} for w, c in lost.items()])
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pa.array(sizes, pa.int64()), pa.array(known), pa.array(base), pa.array(score), pa.array(misses, MISS)],
            names=[*b.schema.names[:-1], "n_tokens", "n_known", "base", "score", "misses"],
        )


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The counts and the model come from all rows that are not held out.  base_score is the
    add-one unigram log10 probability; score the model's.  Null and empty texts are their end
    token alone.  Without training rows every word is unknown and units are alike.  Rows that
    repeat an id are scored one by one; an empty table gives no rows; other columns are not
    read.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(~F.col("held_out")).select(F.xxhash64("id", "text").alias("h"), "text")
    counts = cut(training.select("text").mapInArrow(_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    end = F.coalesce(F.sum(F.when(F.col("word") == F.lit(END_KEY), F.col("c"))), F.lit(0))
    total, different, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), end).first()
    frequent = {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= _least(counts, TABLE)).collect()}
    frequent.pop(END_KEY, None)
    table = sorted(frequent, key=lambda w: (-frequent[w], w))
    words = sum(frequent[w] >= LEAST for w in table[:WORDS])
    known = np.array([*(frequent[w] for w in table), ends], dtype=np.int64)
    table.append(END_KEY)
    sums = counts.mapInArrow(partial(_sums, table=table, words=words), "unit int, n long, v long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tokens, kinds = np.zeros(words + 1 + BUCKETS, dtype=np.int64), np.zeros(words + 1 + BUCKETS, dtype=np.int64)
    for r in sums:
        tokens[r["unit"]], kinds[r["unit"]] = r["n"], r["v"]
    # log10 of 1 / (a bucket's tokens + words + 1), 0 for units that are one word.
    share = np.where(np.arange(len(tokens)) > words, -np.log10(tokens + kinds + 1.0), 0.0)
    # Workers keep what they made for a key: it tells this corpus and its counts from all others of the session.
    key = f"{total}-{different}-{words}-{sc.applicationId}-{hashlib.md5(b' '.join(table) + known.tobytes() + tokens.tobytes() + kinds.tobytes()).hexdigest()}"
    model = train(training, table, words, tokens, total, key)
    shared = sc.broadcast((table, words, known, share, model))
    kind = docs.schema[id_col].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, misses array<struct<word:binary,times:long>>"
    part = cut(numbered.mapInArrow(partial(_score, key=key, shared=shared), schema))
    missing = part.select("row", F.explode("misses").alias("m")).select("row", "m.word", "m.times")
    found = missing.join(counts, "word").groupBy("row").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log"))
    whole = part.drop("misses").join(found, "row", "left")
    log, times = F.coalesce("log", F.lit(0.0)), F.coalesce("times", F.lit(0)).cast("long")
    return whole.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") - (F.lit(0) if total else F.lit(1)) + times).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * log10(total + different + 1)).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
