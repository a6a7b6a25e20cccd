"""SentencePiece encoding by a table of distinct chunks, and decoding.

Where no piece of a BPE model holds a whitespace marker behind another character, merges never
cross from a word to the marker of the next: each marked word is segmented alike wherever it
stands.  The documents are read in blocks of about ``BLOCK`` bytes.  The distinct chunks of each
block are dealt out by hash, so that equal chunks of all blocks meet; there each is segmented
once by the library.  The segments go back to the blocks that asked, and a block's texts are
joined with them by block; a text's ids are those of its chunks in the order of their positions.
Chunks that a block did not ask for (its rows came otherwise on a second reading) are encoded
where they are met, so the result does not depend on the order of rows.

Models of which this does not hold encode whole texts by the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import kept, slices

#: Bytes of text in a block; chunks whose segments a worker keeps at once; texts in a packed slice.
BLOCK, CACHE, SLICE = 12_000_000, 2_000_000, 500
_CHUNK = re.compile(r" *[^ ]+(?: +\Z)?| +\Z")
MARK = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _library(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return kept(("pieces", hash(model)), lambda: SentencePieceProcessor(model_proto=model))


def chunks_apart(model: bytes) -> bool:
    """Whether chunks can be segmented alone: BPE, texts taken as they are, markers only in front."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    norm, train = m.normalizer_spec, m.trainer_spec
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    by_merges = train.model_type == train.BPE and not train.treat_whitespace_as_suffix
    defined = any(p.type == p.USER_DEFINED for p in m.pieces)
    return plain and by_merges and not defined and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces)


def chunks_of(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, which the library puts in front."""
    text = text.replace(MARK, " ")
    if text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(f" {text}")] if text else []


def _ids(segments: list[list[int]]) -> list[bytes]:
    return [np.array(x, "<u4").tobytes() for x in segments]


def _raw(parts: list[bytes]) -> bytes:
    return np.uint32(len(parts)).tobytes() + np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def _pack(parts: list[bytes]) -> bytes:
    return zstandard.compress(_raw(parts), 3)


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _mark(chunks: list[bytes]) -> bytes:
    """Tells one sorted list of chunks from another."""
    return hashlib.blake2b(_raw(chunks), digest_size=16).digest()


def _shares(met: set[str], ranges: int) -> list[tuple[int, list[bytes]]]:
    """The chunks shared out by hash, each share sorted."""
    shares: list[list[bytes]] = [[] for _ in range(ranges)]
    for c in map(str.encode, met):
        shares[xxhash.xxh3_64_intdigest(c) % ranges].append(c)
    return [(k, sorted(s)) for k, s in enumerate(shares) if s]


def _blocks(batches: Iterator[pa.RecordBatch], block: int, rows: int) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """Columns (id, text) in blocks, named by the task's partition and a running number."""
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
    for b in slices(batches, rows):
        held.append(b)
        size += b.column(1).nbytes
        if size >= block:
            yield f"{part}-{n}", held
            n, held, size = n + 1, [], 0
    if held:
        yield f"{part}-{n}", held


def _ask(batches: Iterator[pa.RecordBatch], ranges: int, block: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(block, share, chunks): a block's distinct chunks, shared out by hash."""
    for name, held in _blocks(batches, block, rows):
        met: set[str] = set()
        for b in held:
            for t in b.column(1):
                met.update(chunks_of(t.as_py()))
        full = _shares(met, ranges)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array([k for k, _ in full], pa.int32()), pa.array([_pack(s) for _, s in full], pa.binary())], names=["block", "share", "chunks"])


def _segment(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(block, share, mark, ids): each distinct chunk of a share goes to the library once.

    The ids come back in the order of the chunks; the mark tells which chunks these were.
    """
    library, table = _library(shared.value), {}
    for b in slices(batches, 50):
        marks, out = [], []
        for blob in b.column(2).to_pylist():
            chunks = _unpack(blob)
            new = [c for c in chunks if c not in table]
            if len(table) + len(new) > CACHE:
                table, new = {}, chunks
            if new:
                table.update(zip(new, _ids(library.encode([c.decode() for c in new], num_threads=1))))
            marks.append(_mark(chunks))
            out.append(_pack([table[c] for c in chunks]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.binary()), pa.array(out, pa.binary())], names=["block", "share", "mark", "ids"])


def _texts(batches: Iterator[pa.RecordBatch], block: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(block, rows): a block's rows, packed by slices."""
    for name, held in _blocks(batches, block, rows):
        for b in held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])


def _columns(texts: list[str], encode, frame: tuple[list[int], list[int]], library, back: bool) -> list[pa.Array]:
    """The packed ids of texts, and what the library decodes them to if ``back``."""
    front, end = _ids([*frame])
    packed = [front + encode(t) + end for t in texts]
    out = [pa.array(packed, pa.binary())]
    return [*out, pa.array([library.decode(np.frombuffer(x, "<u4").tolist()) for x in packed], pa.string())] if back else out


def _join(left: pa.Table, right: pa.Table, shared, frame, schema: pa.Schema, ranges: int, back: bool) -> pa.Table:
    """The ids of a block's texts from the segments of its chunks."""
    library, met = _library(shared.value), set()
    slices_ = left.column("rows").to_pylist()
    for rows in slices_:
        for b in pa.ipc.open_stream(rows):
            for t in b.column(1):
                met.update(chunks_of(t.as_py()))
    answers = {(k, m): x for k, m, x in zip(*(right.column(c).to_pylist() for c in ("share", "mark", "ids")))}
    table: dict[str, bytes] = {}
    for k, chunks in _shares(met, ranges):
        blob = answers.get((k, _mark(chunks)))
        names = [c.decode() for c in chunks]
        table.update(zip(names, _unpack(blob) if blob is not None else _ids(library.encode(names, num_threads=1))))

    def encode(text: str) -> bytes:
        return b"".join([table[c] for c in chunks_of(text)])

    out = []
    for rows in slices_:
        for b in pa.ipc.open_stream(rows):
            out.append(pa.RecordBatch.from_arrays([b.column(0), *_columns(b.column(1).to_pylist(), encode, frame, library, back)], schema=schema))
    return pa.Table.from_batches(out, schema)


def _whole(batches: Iterator[pa.RecordBatch], shared, frame, schema: pa.Schema, back: bool) -> Iterator[pa.RecordBatch]:
    library = _library(shared.value)
    for b in slices(batches, SLICE):
        yield pa.RecordBatch.from_arrays([b.column(0), *_columns(b.column(1).to_pylist(), lambda t: _ids([library.encode(t)])[0], frame, library, back)], schema=schema)


def encode(docs: DataFrame, path: str | None = None, begin: bool = True, end: bool = True, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row of ``docs``: its ids as little-endian 32-bit numbers in a binary;
    with ``decoded`` also the text that the library decodes them to.

    ``id_list`` turns them into an array.  A null text counts as empty, an empty one has only the
    begin and end ids.  Repeated rows and null ids are encoded like others, other columns are not
    read, long texts are encoded whole, and an empty table gives no rows.
    """
    with open(path or model_path(), "rb") as f:
        model = f.read()
    library = _library(model)
    frame = ([library.bos_id()] if begin else [], [library.eos_id()] if end else [])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = StructType([docs.schema[id_col], StructField("ids", BinaryType()), *([StructField("decoded", StringType())] if decoded else [])])
    how = {"shared": shared, "frame": frame, "schema": to_arrow_schema(out), "back": decoded}
    if not chunks_apart(model):
        return rows.mapInArrow(partial(_whole, **how), out)
    # As many shares as input partitions: what meets in a share does not grow with the input.
    shares = min(4096, max(16, rows.rdd.getNumPartitions()))
    asked = rows.mapInArrow(partial(_ask, ranges=shares, block=BLOCK, rows=SLICE), "block string, share int, chunks binary")
    segments = asked.repartition(shares, "share").mapInArrow(partial(_segment, shared=shared), "block string, share int, mark binary, ids binary")
    packed = rows.mapInArrow(partial(_texts, block=BLOCK, rows=SLICE), "block string, rows binary")
    return packed.groupBy("block").cogroup(segments.groupBy("block")).applyInArrow(partial(_join, ranges=shares, **how), out)


def _decoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    library = _library(shared.value)
    for b in slices(batches, 200):
        texts = [None if x is None else library.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its packed ids as the library decodes them; null ids stay null."""
    with open(path or model_path(), "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    rows = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != ids_col], F.col(ids_col))
    return rows.mapInArrow(partial(_decoded, shared=shared), StructType([*rows.schema, StructField("decoded", StringType())]))


def n_ids(packed: Column) -> Column:
    return F.floor(F.octet_length(packed) / 4).cast("long")


def id_list(packed: Column) -> Column:
    """The packed ids as an array of integers."""
    at = F.sequence(F.lit(0), n_ids(packed) - 1)
    byte = lambda i: F.concat(*[F.substring(F.hex(packed), (i * 8 + 7 - 2 * k).cast("int"), F.lit(2)) for k in range(4)])
    return F.when(n_ids(packed) > 0, F.transform(at, lambda i: F.conv(byte(i), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
