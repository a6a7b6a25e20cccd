"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items form one suffix automaton over word numbers.  A text's
words stream through it while the length of the longest match ending at each word is tracked;
a length of ``window`` or more means that the window ending there occurs in an item, and the
state of that window holds the set of its items.  An item shorter than the window counts as a
whole and is marked on the state of its last word.

Where two neighbouring words never neighbour in an item the automaton can only be at a length
of one or less.  Such places are found for a whole batch at once, and the automaton walks the
stretches between them.

The driver builds the automaton of at most ``MAX_WORDS`` words and broadcasts it as flat
arrays, measured at 110 bytes a word in a worker (and 400 in the driver while it is built).  A larger benchmark is taken in blocks,
each a pass over the rows that adds its spans and items to theirs.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, kept

#: Words of the items that one automaton holds; more are taken in blocks, each with a pass of its own.
MAX_WORDS = 500_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FOLD = str.maketrans(UPPER, LOWER)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and all beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Builder:
    """States and transitions while items are added; a transition's key is state * words + word."""

    def __init__(self, size: int):
        self.size, self.to = size, {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.first, self.word, self.rest = array("i", [-1]), array("i"), array("i")  # each state's words as a chain

    def _add(self, state: int, w: int, target: int) -> None:
        key = state * self.size + w
        if key not in self.to:
            self.word.append(w)
            self.rest.append(self.first[state])
            self.first[state] = len(self.word) - 1
        self.to[key] = target

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.first.append(-1)
        return len(self.link) - 1

    def extend(self, last: int, w: int) -> int:
        q = self.to.get(last * self.size + w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur, p = self._state(self.length[last] + 1, 0), last
        while p != -1 and p * self.size + w not in self.to:
            self._add(p, w, cur)
            p = self.link[p]
        if p != -1:
            q = self.to[p * self.size + w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        copy, edge = self._state(self.length[p] + 1, self.link[q]), self.first[q]
        while edge != -1:
            self._add(copy, self.word[edge], self.to[q * self.size + self.word[edge]])
            edge = self.rest[edge]
        self.link[q] = copy
        while p != -1 and self.to.get(p * self.size + w) == q:
            self.to[p * self.size + w] = copy
            p = self.link[p]
        return copy


def _grouped(states: list[int], items: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different items of each state: those of state s stand from start[s] to start[s + 1]."""
    both = np.unique(np.array([states, items], dtype=np.int64).reshape(2, -1), axis=1)
    return np.searchsorted(both[0], np.arange(n + 1)).astype(np.int32), both[1].astype(np.int32)


def build(items: list[tuple[str | None, list[bytes]]], window: int) -> dict:
    """The automaton of the items as flat arrays.  An item without a name is found but not named."""
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number)) for w in words] for _, words in items]
    size = max(1, len(number))
    b = _Builder(size)
    ends, pairs = [], set()
    for seq in sequences:
        state = 0
        for w in seq:
            state = b.extend(state, w)
        ends.append(state)
        pairs.update(zip(seq, seq[1:]))
    n = len(b.link)
    keys = np.fromiter(b.to.keys(), dtype=np.int64, count=len(b.to))
    order = np.argsort(keys)
    link, length = np.array(b.link, dtype=np.int32), np.array(b.length, dtype=np.int32)
    # The state of the last ``window`` words of a state's strings, found upwards along the links.
    at, near, whole = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=bool)
    whole[[end for end, seq in zip(ends, sequences) if 0 < len(seq) < window]] = True
    for s in np.argsort(length, kind="stable").tolist():
        up = link[s]
        if length[s] >= window:
            at[s] = at[up] if up >= 0 and length[up] >= window else s
        near[s] = s if whole[s] else near[up] if up >= 0 else -1
    states, named = [], []
    for k, (seq, end) in enumerate(zip(sequences, ends)):
        if len(seq) < window:
            states += [end] if seq else []
        else:
            state = 0
            for i, w in enumerate(seq):
                state = b.to[state * size + w]
                if i >= window - 1:
                    states.append(int(at[state]))
        named += [k] * (len(states) - len(named))
    start, members = _grouped(states, named, n)
    return {
        "window": window, "words": list(number), "keys": keys[order], "to": np.fromiter(b.to.values(), dtype=np.int32, count=len(b.to))[order], "link": link, "length": length,
        "at": at, "near": near, "start": start, "members": members, "names": [name for name, _ in items],
        "pairs": np.array(sorted(x * size + y for x, y in pairs), dtype=np.int64), "single": np.unique(np.array([s[0] for s in sequences if len(s) == 1], dtype=np.int64)) if window > 1 else np.arange(size),
        "least": min([window, *(len(s) for s in sequences if s)]),
    }


class Automaton:
    """The broadcast arrays ready for walking."""

    def __init__(self, parts: dict):
        self.__dict__.update(parts)
        self.number = {w: k for k, w in enumerate(self.words)}
        self.size = max(1, len(self.words))
        self.keys, self.to, self.link, self.length, self.at, self.near, self.start = (array("q" if k == "keys" else "i", parts[k].tobytes()) for k in ("keys", "to", "link", "length", "at", "near", "start"))
        self.alone = np.zeros(self.size, dtype=bool)
        self.alone[self.single] = True

    def step(self, state: int, w: int) -> int:
        key = state * self.size + w
        i = bisect_left(self.keys, key)
        return self.to[i] if i < len(self.keys) and self.keys[i] == key else -1

    def walk(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word the state and the length of the longest match that ends there."""
        state, n = 0, 0
        for w in ids:
            while (t := self.step(state, w)) < 0 and state:
                state = self.link[state]
                n = self.length[state]
            if t >= 0:
                state, n = t, n + 1
            yield state, n

    def found(self, state: int, n: int) -> Iterator[tuple[int, int]]:
        """(state, length) of the windows and whole items that end a match of n words."""
        if n >= self.window:
            yield self.at[state], self.window
        s = self.near[state]
        if s == state and self.length[s] > n:
            s = self.near[self.link[s]]
        while s > 0:
            yield s, self.length[s]
            s = self.near[self.link[s]]

    def match(self, texts: list[list[bytes]]) -> dict[int, tuple[np.ndarray, set[str]]]:
        """By index of the text: a mask of the words inside windows, and the names of the items met."""
        sizes = [len(t) for t in texts]
        get = self.number.get
        flat = np.fromiter((get(w, -1) for w in chain.from_iterable(texts)), dtype=np.int64, count=sum(sizes))
        if not len(flat) or not len(self.keys):
            return {}
        doc = np.repeat(np.arange(len(texts)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])
        known = flat >= 0
        joint = np.zeros(len(flat) + 1, dtype=bool)  # joint[i]: words i-1 and i may neighbour
        both = np.nonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1]))[0]
        if len(self.pairs) and len(both):
            key = flat[both] * self.size + flat[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joint[both[self.pairs[at] == key] + 1] = True
        edge = np.diff(np.concatenate([[False], joint[1:], [False]]).astype(np.int8))
        starts, stops = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] + 1
        long = stops - starts >= max(2, self.least)
        runs = list(zip(starts[long].tolist(), stops[long].tolist()))
        if self.least == 1:
            runs += [(i, i + 1) for i in np.nonzero(known & self.alone[np.where(known, flat, 0)])[0].tolist()]
        out: dict[int, tuple[np.ndarray, set[str]]] = {}
        for a, b in runs:
            for end, (state, n) in enumerate(self.walk(flat[a:b].tolist()), a + 1):
                for s, length in self.found(state, n):
                    d = int(doc[a])
                    hit, met = out.setdefault(d, (np.zeros(sizes[d], dtype=bool), set()))
                    hit[end - first[d] - length : end - first[d]] = True
                    met.update(x for k in self.members[self.start[s] : self.start[s + 1]].tolist() if (x := self.names[k]) is not None)
        return out


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])]


def strip(text: str, spans: list[dict[str, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]])
        last = at[s["stop"] - 1][1]
    return "".join([*out, text[last:]])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_STATE = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def _pass(batches: Iterator[pa.RecordBatch], key: str, shared, cleaned: tuple[int, float] | None = None) -> Iterator[pa.RecordBatch]:
    """Adds spans and items of one automaton to rows (row, text, n_words, spans, items); ``cleaned`` (max_span, max_coverage) cuts the spans out at last."""
    automaton = kept(("automaton", key), lambda: Automaton(shared.value))
    for whole in batches:
        for lo in range(0, whole.num_rows, 500):
            b = whole.slice(lo, 500)
            texts, spans, items = (b.column(k).to_pylist() for k in (1, 3, 4))
            words = [words_of(t) for t in texts]
            for i, (hit, met) in automaton.match(words).items():
                for s in spans[i]:
                    hit[s["start"] : s["stop"]] = True
                spans[i], items[i] = _spans(hit), sorted({*items[i], *met})
            if cleaned is None:
                columns = [*b.columns[:2], pa.array([len(w) for w in words], pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)
                continue
            keep = np.ones(len(texts), dtype=bool)
            for i, found in enumerate(spans):
                found = [s for s in found if s["stop"] - s["start"] > cleaned[0]]
                keep[i] = sum(s["stop"] - s["start"] for s in found) <= cleaned[1] * len(words[i])
                if found and keep[i]:
                    texts[i] = strip(texts[i], found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=b.schema.names[:2]).filter(pa.array(keep))


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, streamed in blocks of ``max_words`` words at most (one item at least)."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).orderBy(F.col(id_col).cast("string")).toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    yield block


def _passes(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text: str, max_words: int, cleaned: tuple[int, float] | None) -> DataFrame:
    """(row, text) through one pass for each block of items; between passes rows are written once."""
    kind = rows.schema["row"].dataType.simpleString()
    state = rows.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    waiting = None
    for block in blocks_of(benchmark, item_col, item_text, max_words):
        if waiting:
            state = cut(state.mapInArrow(partial(_pass, **waiting), f"row {kind}, text string, {_STATE}"))
        shared = rows.sparkSession.sparkContext.broadcast(build(block, window))
        waiting = {"key": hashlib.md5(repr((window, block)).encode()).hexdigest(), "shared": shared}
    schema = f"row {kind}, text string" + (f", {_STATE}" if cleaned is None else "")
    return state.mapInArrow(partial(_pass, **waiting, cleaned=cleaned), schema)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(id, n_words, spans, items) for every row of ``docs``: the word spans inside windows of items.

    Null and empty texts have no words.  Items without words match nothing; those without an id
    hit words but are not listed; items that repeat an id are one item.  An empty benchmark
    leaves every text clean; equal rows get equal results; an empty table gives no rows.
    """
    rows = docs.select(F.struct(F.col(id_col)).alias("row"), F.col(text_col).cast("string").alias("text"))
    return _passes(rows, benchmark, window, item_col, item_text, max_words, None).select(F.col("row")[id_col].alias(id_col), "n_words", "spans", "items")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_span: int = 0, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` without benchmark passages.

    A span of more than ``max_span`` words is cut out of its text; a row of whose words more
    than ``max_coverage`` lie in such spans is dropped.  Clean rows, and null or empty texts,
    stay as they are, whatever their other columns hold; repeated rows are treated alike; an
    empty table or benchmark changes nothing.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    out = _passes(rows, benchmark, window, item_col, item_text, max_words, (max_span, max_coverage))
    return out.select(*[(F.col("text").cast(docs.schema[c].dataType) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
