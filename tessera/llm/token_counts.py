"""Token counts by a map-side two-tier lookup.

Byte-level BPE cuts a text into pre-tokens and encodes each on its own, so a text's count is
the sum over its pre-tokens.  Tier one is a broadcast table of the lengths of frequent
pre-tokens: the ``FREQUENT`` most frequent ones of about ``SAMPLE`` sampled texts.  It changes
no count, only how often tier two is asked.  Tier two is a cache in each worker, filled by
encoding what misses; it is emptied when full.  No pre-token is shuffled.

A tokenizer file that cuts texts in another way is left to its library whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter as Tally
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

CACHE, FREQUENT, SAMPLE = 400_000, 50_000, 2000
#: Fixed by byte-level BPE: how it cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd(c: str) -> bool:
    """An ASCII control, or a character that this Python's Unicode leaves unassigned.

    Only on such characters can two regex engines differ in what is a letter, a number or a
    blank; a text that holds one goes to the library whole.
    """
    return unicodedata.category(c) == "Cn" or c < " " and c not in "\t\n\x0b\x0c\r" or c == "\x7f"


def _cuts_by_pattern(model: str) -> bool:
    """Whether the file is plain byte-level BPE: no normalizer, no added space, plain special strings."""
    m = json.loads(model)
    pre = m.get("pre_tokenizer") or {}
    plain = all(not x.get(k) for x in m.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not m.get("normalizer") and plain


class Counter:
    """Counts the tokens of texts as the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, model: bytes, table: dict[str, int]):
        self.table, self.cache, self.cut = table, {}, None
        if model[:1] != b"{":
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_proto=model)
            self.whole = lambda text: len(pieces.encode(text))
            return
        import regex
        from tokenizers import Tokenizer

        text = model.decode()
        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        if _cuts_by_pattern(text):
            self.cut, self.known = regex.compile(PATTERN).findall, set()
            self.special = [x["content"] for x in json.loads(text).get("added_tokens", [])]

    def odd(self, text: str) -> bool:
        """Whether the text holds an odd character; characters found to be none are remembered."""
        new = set(text) - self.known
        if not new:
            return False
        odd = {c for c in new if _odd(c)}
        self.known |= new - odd
        return bool(odd)

    def length(self, pretoken: str) -> int:
        n = self.cache.get(pretoken)
        if n is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            n = self.cache[pretoken] = self.whole(pretoken)
        return n

    def pretokens(self, text: str) -> tuple[int, list[list[str]]]:
        """The special strings in a text, and the pre-tokens between them."""
        parts, n = [text], 0
        for s in self.special:
            if s in text:
                pieces = [p.split(s) for p in parts]
                n += sum(len(p) - 1 for p in pieces)
                parts = [x for p in pieces for x in p]
        return n, [self.cut(p) for p in parts]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or self.odd(text):
            return self.whole(text)
        n, parts = self.pretokens(text)
        get, slow = self.table.get, self.length
        return n + sum(sum([get(x) or slow(x) for x in p]) for p in parts)


def _frequent(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    counter, seen = Counter(model, {}), Tally()
    for b in batches:
        for t in b.column(0).to_pylist():
            if t and counter.cut and not counter.odd(t):
                for p in counter.pretokens(t)[1]:
                    seen.update(p)
    often = seen.most_common(FREQUENT)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64()), pa.array([counter.whole(x) for x, _ in often], pa.int32())], names=["token", "n", "length"])


def frequent_lengths(rows: DataFrame, model: bytes) -> dict[str, int]:
    """The lengths of the most frequent pre-tokens of about ``SAMPLE`` of the rows (id, text).

    Rows are chosen by the hash of id and text, so that copies of a hot text are no more likely
    than others, and each text of the sample counts once.
    """
    one_in = max(1, rows.count() // SAMPLE)
    key, text = rows.columns
    chosen = rows.where(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(text)), F.lit(one_in)) == 0)
    # All input partitions are read where they lie; only the few chosen texts move together.
    sample = chosen.select(text).distinct().repartition(8)
    found = sample.mapInArrow(partial(_frequent, model=model), "token string, n long, length int")
    best = found.groupBy("token").agg(F.sum("n").alias("n"), F.max("length").alias("length")).where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT)
    return {r["token"]: r["length"] for r in best.collect()}


def _count(batches: Iterator[pa.RecordBatch], key: str, shared) -> Iterator[pa.RecordBatch]:
    counter = kept(("tokens", key), lambda: Counter(*shared.value))
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([counter.count(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``path`` names a .json file of tokenizers or a .model file of sentencepiece.  Null and
    empty texts have no bytes and no tokens.  Special strings inside a text are special tokens,
    as the library has it.  Repeated rows are counted alike, other columns are not read, long
    texts are read whole, and an empty table gives no rows.
    """
    with open(path or tokenizer_path(), "rb") as f:
        model = f.read()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model, frequent_lengths(rows.select(F.col(id_col), "text"), model)))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = rows.mapInArrow(partial(_count, key=hashlib.md5(model).hexdigest(), shared=shared), f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
