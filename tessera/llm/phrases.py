"""Phrase collocations by level-wise passes over the documents.

Level 1 counts words.  Pass k reads the documents again and emits a phrase of k words only
where both its overlapping parts of k - 1 words are frequent, as an Apriori search does.  The
frequent phrases of a level are broadcast as a bitmap of 2 ** ``BITS`` hashes, whose size does
not depend on the corpus: a wrong hit lets a rare phrase be counted for nothing, and the exact
counts by phrase then leave it out.  Workers count a block of texts at once with arrays of word
hashes.  The counts travel packed by a hash of the phrase, and those of one bucket are summed by
language and phrase where they meet.

The cuts of a phrase are scored by joins with the tables of the levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, slices

#: Bytes of text that a worker counts at once; bits of a hash that number a place in a bitmap;
#: counts that come together before a worker adds them up.
BLOCK, BITS, HELD = 12_000_000, 27, 2_000_000
#: A-Z become a-z, tabs blanks, and all marks that part pieces line feeds.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of a block of texts, each text with the number of its language."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, names: list[str]):
        self.text = b"\n".join([*texts, b"\n" * 8]).translate(_TABLE)
        raw = np.frombuffer(self.text, np.uint8)
        word = (raw != 32) & (raw != 10)
        edge = np.nonzero(np.diff(word, prepend=False, append=False))[0]
        self.start, self.end = edge[::2], edge[1::2]
        pieces = np.cumsum(raw == 10, dtype=np.int32)[self.start]
        #: Whether a word and the next stand in one piece.
        self.linked = pieces[1:] == pieces[:-1]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.lang = langs[np.searchsorted(ends, self.start, side="right")]
        self.names = names
        #: The eight bytes from each place on.
        self.eight = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
        seeds = np.frombuffer(b"".join(_seed(n) for n in names), np.uint64) if names else np.zeros(0, np.uint64)
        self.seeds = seeds.reshape(-1, 2)

    def hashes(self, way: int) -> np.ndarray:
        """A 64-bit hash of each word and its language; ``way`` is 0 or 1 and chooses the seeds."""
        size = self.end - self.start
        h = self.seeds[self.lang, way] + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        eight = self.eight
        at, left, row = self.start, size, None
        while len(at):
            part = eight[at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * np.minimum(left, 8).astype(np.uint64)))
            if row is None:
                h = _mix(h ^ part)
            else:
                h[row] = _mix(h[row] ^ part)
            more = np.nonzero(left > 8)[0]
            row = more if row is None else row[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def grams(self, k: int, way: int) -> np.ndarray:
        """A hash of the ``k`` words that start at each word; right only where ``fits(k)``."""
        h = self.hashes(way)
        g = h
        for j in range(1, k):
            g = _mix(g[: len(h) - j] * _U(0xD6E8FEB86659FD93) + h[j:]) if len(h) > j else h[:0]
        return g

    def fits(self, k: int) -> np.ndarray:
        """Whether the ``k`` words that start at each word stand in one piece."""
        ok = np.ones(max(0, len(self.start) - k + 1), bool)
        for j in range(k - 1):
            ok &= self.linked[j : j + len(ok)]
        return ok

    def phrases(self, at: np.ndarray, k: int) -> list[bytes]:
        """The ``k`` words that start at each of the words ``at``, joined by single spaces."""
        lo, hi, text = self.start[at], self.end[at + k - 1], self.text
        out = [text[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        if k > 1:
            plain = sum(self.end[at + j] - self.start[at + j] for j in range(k)) + k - 1
            for n in np.nonzero(hi - lo != plain)[0].tolist():
                out[n] = b" ".join(x for x in out[n].split(b" ") if x)
        return out

    def sorted(self, at: np.ndarray, k: int, bucket: np.ndarray) -> np.ndarray:
        """The order of the phrases at ``at`` by language, bucket and the fronts of their first two
        words: neighbours are alike, so that they pack well."""
        keys = [self.eight[self.start[at + j]].byteswap() for j in range(min(k, 2))]
        return np.lexsort((*keys[::-1], bucket, self.lang[at]))

    def distinct(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One place, the count and the hash of each phrase of ``k`` words among those at ``at``."""
        one = self.grams(k, 0)[at]
        _, first, back, often = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
        two = self.grams(k, 1)[at]
        if not np.array_equal(two[first][back], two):  # two phrases share a hash: tell them apart by both
            both = np.stack([one, two], axis=1)
            _, first, often = np.unique(both, axis=0, return_index=True, return_counts=True)
        return at[first], often, one[first]


def _seed(name: str) -> bytes:
    return hashlib.blake2b(name.encode(), digest_size=16).digest()


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[Words]:
    """Columns (lang, text) in blocks of about ``block`` bytes, as far as may be of one language each:
    the fewer blocks a language is spread over, the fewer counts there are to add up."""
    texts, size = {}, {}

    def taken(names: list[str]) -> Words:
        mine = [texts.pop(n) for n in names]
        for n in names:
            size.pop(n)
        return Words([t for x in mine for t in x], np.repeat(np.arange(len(names)), [len(x) for x in mine]), names)

    for b in slices(batches, 2000):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            texts.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] >= block:
                yield taken([lang])
        while sum(size.values()) > 2 * block:
            yield taken([max(size, key=size.get)])
    while size:
        names, full = [], 0
        for n in sorted(size, key=size.get, reverse=True):
            if not names or full + size[n] <= block:
                names.append(n)
                full += size[n]
        yield taken(names)


def _pack(phrases: list[bytes], n: np.ndarray) -> bytes:
    sizes = np.fromiter(map(len, phrases), "<u4", len(phrases))
    return zstandard.compress(np.uint32(len(phrases)).tobytes() + sizes.tobytes() + n.astype("<i8").tobytes() + b"".join(phrases), 3)


def _unpack(blob: bytes) -> tuple[pa.Array, pa.Array]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.append(0, np.cumsum(np.frombuffer(raw, "<u4", n, 4))).astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 + 12 * n :])])
    return text, pa.array(np.frombuffer(raw, "<i8", n, 4 + 4 * n))


def _row(lang: str, bucket: list[int], n: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], names=["lang", "bucket", "n", "counts"])


def _count(batches: Iterator[pa.RecordBatch], k: int, frequent, block: int, bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n, counts): each block's phrases and their counts, packed by a hash of the phrase;
    at level 1 also the number of words, n."""
    bitmap = np.frombuffer(frequent.value, np.uint8) if frequent else None
    for words in _blocks(batches, block):
        ok = words.fits(k)
        if bitmap is not None:
            place = words.grams(k - 1, 0)[: len(ok) + 1] >> _U(64 - bits)
            often = (bitmap[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
            ok &= often[:-1] & often[1:] if len(ok) else ok
        at, n, h = words.distinct(np.nonzero(ok)[0], k)
        bucket = ((h >> _U(8)) % _U(buckets)).astype(np.int32)
        order = words.sorted(at, k, bucket)
        at, n, bucket = at[order], n[order], bucket[order]
        lang = words.lang[at]
        totals = np.bincount(words.lang, minlength=len(words.names))
        for j, name in enumerate(words.names):
            lo, hi = np.searchsorted(lang, [j, j + 1])
            text, mine = words.phrases(at[lo:hi], k), bucket[lo:hi]
            heads = np.append(np.nonzero(np.diff(mine, prepend=-1))[0], len(mine)).tolist()
            spans = list(zip(heads, heads[1:]))
            if k == 1:
                yield _row(name, [0], [int(totals[j])], [None])
            yield _row(name, [int(mine[a]) for a, _ in spans], [None] * len(spans), [_pack(text[a:b], n[lo + a : lo + b]) for a, b in spans])


def _merge(batches: Iterator[pa.RecordBatch], least: int, held: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of the phrases of a bucket with ``least`` or more; a null phrase has the words in all.

    Counts are summed whenever ``held`` rows have come together.
    """
    tables, rows = [], 0

    def summed() -> pa.Table:
        t = pa.concat_tables(tables).combine_chunks().group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        return t.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

    for b in batches:
        for lang, n, blob in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
            text, f = (pa.array([None], pa.string()), pa.array([n], pa.int64())) if blob is None else _unpack(blob)
            tables.append(pa.table({"lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(f), np.int8))), "phrase": text, "f": f}))
            rows += len(f)
            if rows >= held:
                tables = [summed()]
                rows, held = 0, max(held, 2 * len(tables[0]))
    if tables:
        t = summed()
        yield from t.filter(pc.or_(pc.greater_equal(t["f"], least), pc.is_null(t["phrase"]))).combine_chunks().to_batches()


def _places(batches: Iterator[pa.RecordBatch], k: int, block: int, bits: int) -> Iterator[pa.RecordBatch]:
    for words in _blocks(batches, block):
        place = words.grams(k, 0)[np.nonzero(words.fits(k))[0]] >> _U(64 - bits)
        yield pa.RecordBatch.from_arrays([pa.array((place >> _U(6)).astype(np.int32)), pa.array((place & _U(63)).astype(np.int32))], names=["cell", "bit"])


def _bitmap(level: DataFrame, k: int) -> bytes:
    """The bitmap of a level's phrases: at most 2 ** (``BITS`` - 6) cells reach the driver."""
    places = level.select("lang", "phrase").mapInArrow(partial(_places, k=k, block=BLOCK, bits=BITS), "cell int, bit int")
    cells = places.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.tobytes()


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, k) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n).

    A null language is ``und``; a null or empty text has no words.  Overlapping occurrences all
    count, repeated rows count each time, texts are read whole.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    # As many buckets as follow the input, so that a bucket's counts do not grow with it.
    buckets = min(1 << 14, max(64, 4 * texts.rdd.getNumPartitions()))
    levels, frequent = [], None
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(partial(_count, k=k, frequent=frequent, block=BLOCK, bits=BITS, buckets=buckets), "lang string, bucket int, n long, counts binary")
        found = cut(counted.repartition(buckets, "bucket").mapInArrow(partial(_merge, least=least, held=HELD), "lang string, phrase string, f long"))
        if k == 1:
            totals = found.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
            found = found.where("phrase IS NOT NULL")
        levels.append(found.withColumn("k", F.lit(k)))
        if k < longest:
            frequent = sc.broadcast(_bitmap(found, k))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, totals


def _part(start, length):
    return F.array_join(F.slice("words", start, length), " ")


def collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, keep_ratio: int = 100, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Words are parted by spaces and tabs, pieces by ``. , ; : ! ?`` and line ends; only A-Z are
    lower-cased.  a counts the phrase, n the language's words.  A cut after k words gives
    l = f(first k), r = f(rest) and floor(1000 a n / (l r)); the lowest cut counts, of equal ones
    the first.  A phrase inside a longer one goes if 100 f(longer) >= ``keep_ratio`` a.  Ties are
    ranked by a, then by the phrase's bytes.  Empty tables give no rows.
    """
    levels, totals = frequent_phrases(docs, longest, least, lang_col, text_col)
    words = levels.withColumn("words", F.split("phrase", " "))
    candidates = words.where("k > 1")
    parts = candidates.select("lang", "phrase", "words", "k", "f", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    parts = parts.select("lang", "phrase", F.col("f").alias("a"), "at", _part(F.lit(1), F.col("at")).alias("head"), _part(F.col("at") + 1, F.col("k") - F.col("at")).alias("tail"))
    counts = levels.select("lang", "phrase", "f")
    heads, tails = (counts.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("head", "l"), ("tail", "r")))
    scored = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(broadcast_if_small(totals, totals.count()), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("__up", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n")).withColumn("__down", wide("l") * wide("r")).withColumn("score", F.expr("__up div __down"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    spans = [(start, size) for size in range(2, longest) for start in range(1, longest - size + 2)]
    inner = F.array(*[F.when(F.col("k") >= max(s + z - 1, z + 1), _part(F.lit(s), F.lit(z))) for s, z in spans]) if spans else F.array().cast("array<string>")
    longer = candidates.select("lang", "f", F.explode(inner).alias("phrase")).where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    stay = best.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {keep_ratio} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stay.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
