"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` seeded random directions and sorted by each.  A
pair at the threshold cosine lies ``s`` apart, so its projections differ by about s / sqrt(dim);
the query-centred window is ``Z`` times that.  A pair collides in a projection where one lies in
the other's window, which is a range of the sorted list; over all projections it collides a
binomial number of times, and the least count that keeps ``RECALL`` of such pairs is the bar for
verifying the pair in double precision.

A window's rows are a range of the sorted list, hence the difference of two prefix sets.  A
piece keeps, for each projection, the sets of its first 0, 1, 2, ... rows in sorted order as
bits; collisions are counted for 64 rows at a time by adding such bit sets into bit-sliced
counters, and only pairs that reach the bar are unpacked.

Equal vectors are gathered first and take part once, with their number.  Vectors of one length
are sorted by the first projection and cut into blocks; a row is sent to the blocks that a
window of ``ROUTE`` times the deviation around it reaches, and each pair of blocks is one tile.
The rows lost by that wider window are part of the calibrated recall.  There are ``BLOCKS``
blocks until a block would take more than ``BLOCK_BYTES``.  A tile reports link counts and stars
of linked rows, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .simhash import forest

PROJECTIONS, Z, ROUTE, RECALL, PIECE = 24, 2.0, 4.0, 0.998, 1024
BLOCKS, BLOCK_BYTES, SALTS = 16, 32 << 20, 32


def window_width(threshold: float, dim: int, z: float = Z) -> float:
    return z * math.sqrt(max(2 - 2 * threshold, 0) / dim) + 1e-6


def least_count(projections: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches, within the route, with probability ``recall``."""
    p, tail = math.erf(Z / math.sqrt(2)), 0.0
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail * math.erf(ROUTE / math.sqrt(2)) >= recall:
            return k
    return 0


def directions(dim: int, seed: int) -> np.ndarray:
    g = np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS))
    return g / np.linalg.norm(g, axis=0)


def block_rows(n: int, dim: int) -> int:
    """Rows of a block of n vectors: at least ``PIECE``, and no more than ``BLOCK_BYTES`` hold."""
    return min(max(PIECE, math.ceil(n / BLOCKS)), max(PIECE, BLOCK_BYTES // (8 * dim)))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    sizes = np.diff(b.column(column).offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        yield dim, b.take(pa.array(np.nonzero(sizes == dim)[0])) if len(b) else b


def _anchor(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for dim, b in _by_length(whole, 1):
            at = _unit(b.column(1), dim) @ directions(dim, seed)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(at), dim), pa.int32()), pa.array(at)], names=["id", "v", "m", "node", "dim", "at"])


def _cells(batches: Iterator[pa.RecordBatch], cuts) -> Iterator[pa.RecordBatch]:
    """Rows by vector length and cell, counted for each batch."""
    for b in batches:
        dims, at = b.column(0).to_numpy(), b.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            cell, n = np.unique(np.searchsorted(cuts.value[dim], at[dims == dim], side="right"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["dim", "cell", "n"])


def _deal(batches: Iterator[pa.RecordBatch], plans, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each row to the tiles of its own block and the blocks that its window reaches."""
    for whole in batches:
        for dim, b in _by_length(whole, 1):
            cuts, start, chunks = plans.value[dim]
            at, w = b.column(5).to_numpy(), window_width(threshold, dim, ROUTE)
            cell, low, high = (np.searchsorted(cuts, x, side="right") for x in (at, at - w, at + w))
            node = b.column(3).to_numpy()
            block = start[cell] + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % chunks[cell]
            first, last = start[low], start[high] + chunks[high] - 1
            n = last - first + 1
            row = np.repeat(np.arange(len(at)), n)
            other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
            sent = b.take(pa.array(row))
            lo, hi = np.minimum(block[row], other), np.maximum(block[row], other)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim), pa.int32()), *(pa.array(x, pa.int64()) for x in (lo, hi, block[row])), *sent.columns[:4]], names=["dim", "lo", "hi", "block", "id", "v", "m", "node"])


class Piece:
    """Rows whose projections are sorted, with the prefix sets of every sorted list as bits."""

    def __init__(self, p: np.ndarray):
        n, self.words = len(p), -(-len(p) // 64)
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.take_along_axis(p, order, axis=0)
        self.prefix = np.zeros((p.shape[1], n + 1, self.words), dtype=np.uint64)
        at = np.arange(n)
        for k in range(p.shape[1]):
            self.prefix[k, at + 1, order[:, k] >> 6] = np.uint64(1) << (order[:, k] & 63).astype(np.uint64)
            np.bitwise_or.accumulate(self.prefix[k], axis=0, out=self.prefix[k])

    def collided(self, q: np.ndarray, w: float, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs that lie in each other's windows of ``bar`` projections or more."""
        planes: list[np.ndarray] = []
        for k in range(q.shape[1]):
            lo = np.searchsorted(self.sorted[:, k], q[:, k] - w, side="left")
            hi = np.searchsorted(self.sorted[:, k], q[:, k] + w, side="right")
            carry = self.prefix[k, hi] ^ self.prefix[k, lo]
            for j, plane in enumerate(planes):
                planes[j], carry = plane ^ carry, plane & carry
            if (k + 1) & k == 0:
                planes.append(carry)
        # counts >= bar, from the highest bit down
        more, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
        for j in range(len(planes) - 1, -1, -1):
            if bar >> j & 1:
                same &= planes[j]
            else:
                more |= same & planes[j]
                same &= ~planes[j]
        reached = more | same
        row, word = np.nonzero(reached)
        bits = np.unpackbits(reached[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        i, j = row[hit], word[hit] * 64 + bit
        inside = j < len(self.sorted)
        return i[inside], j[inside]


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile (dim, lo, hi)."""
    bar = least_count()

    def tile(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        dim, lo, hi = (t.column(c)[0].as_py() for c in ("dim", "lo", "hi"))
        blocks, ids, m, node = (t.column(c).to_numpy() for c in ("block", "id", "m", "node"))
        x = _unit(t.column("v").combine_chunks(), dim)
        p, w, reach = x @ directions(dim, seed), window_width(threshold, dim), window_width(threshold, dim, ROUTE)
        order = np.argsort(p[:, 0], kind="stable")
        x, p, m, ids, node, blocks = x[order], p[order], m[order], ids[order], node[order], blocks[order]
        first, second = np.nonzero(blocks == lo)[0], np.nonzero(blocks == hi)[0]
        # Pairs are added to the counts and the forest as they are found, so that a dense cluster takes no more memory.
        n, root = np.zeros(len(ids), np.int64), None
        for b in range(0, len(second), PIECE):
            v = second[b : b + PIECE]
            piece = None
            for a in range(0, min(len(first), b + PIECE) if lo == hi else len(first), PIECE):
                u = first[a : a + PIECE]
                if p[v[0], 0] - p[u[-1], 0] > reach or p[u[0], 0] - p[v[-1], 0] > reach:
                    continue
                piece = piece or Piece(p[v])
                i, j = piece.collided(p[u], w, bar)
                i, j = u[i], v[j]
                if lo == hi:
                    i, j = i[i < j], j[i < j]
                for at in range(0, len(i), 1 << 16):
                    k, l = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    good = np.einsum("ij,ij->i", x[k], x[l]) >= threshold
                    k, l = k[good], l[good]
                    if len(k):
                        np.add.at(n, k, m[l])
                        np.add.at(n, l, m[k])
                        root = forest(len(ids), k, l, root)
        if root is None:
            return None
        some = np.nonzero(n)[0]
        peer = ids[root[some]]
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(ids[some]), pa.array(n[some]), pa.array(peer, pa.int64())], names=["node", "id", "n", "peer"])

    carry: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        carry = t if carry is None else pa.concat_tables([carry, t])
        key = np.stack([carry.column(c).to_numpy() for c in ("dim", "lo", "hi")], axis=1)
        last = 0
        for e in (np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1).tolist():
            if (out := tile(carry.slice(last, e - last))) is not None:
                yield out
            last = e
        carry = carry.slice(last)
    if carry is not None and carry.num_rows and (out := tile(carry)) is not None:
        yield out


def _plans(placed: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: cuts of the first projection, and for each cell its first block and number of blocks.

    Equal values cannot be cut apart, so a crowded cell is dealt out over several blocks.  The
    driver holds a few numbers for each block.
    """
    sizes = {r["dim"]: r["n"] for r in placed.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {dim: math.ceil(n / block_rows(n, dim)) for dim, n in sizes.items()}
    most = max(parts.values(), default=1)
    at: dict[int, list[float]] = {}
    if most > 1:
        shares = [k / most for k in range(1, most)]
        at = {r["dim"]: r["q"] for r in placed.groupBy("dim").agg(F.percentile_approx("at", shares, 100 * most).alias("q")).collect()}
    cuts = {dim: sorted({at[dim][round(k * most / parts[dim]) - 1] for k in range(1, parts[dim])}) for dim in sizes}
    shared = placed.sparkSession.sparkContext.broadcast({dim: np.array(c) for dim, c in cuts.items()})
    crowded = placed.select("dim", "at").mapInArrow(partial(_cells, cuts=shared), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n"))
    crowd = {(r["dim"], r["cell"]): r["n"] for r in crowded.collect()}
    out = {}
    for dim, c in cuts.items():
        chunks = np.array([max(1, math.ceil(crowd.get((dim, k), 0) / (2 * block_rows(sizes[dim], dim)))) for k in range(len(c) + 1)])
        out[dim] = (np.array(c, dtype=np.float64), np.cumsum(chunks) - chunks, chunks)
    return out


def embedding_links(vectors: DataFrame, threshold: float = 0.9, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Pairs of one length and of cosine ``threshold`` or more are linked, none below it; n_links
    counts the other rows linked directly and component_id is the least id reachable.  Vectors
    that are null, empty, zero, or hold null or non-finite numbers link with nothing.  Ids are
    whole numbers, one for each row: a repeated id has the links of its different vectors added
    up, and a row without an id links with nothing.  Ties at the threshold link; an empty table
    gives no rows; other columns are not read.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    kind = "array<float>" if "float" in vectors.schema[vector_col].dataType.simpleString() else "array<double>"
    good = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), v.cast(kind).alias("v")).where("id IS NOT NULL")
    distinct = good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")).select("id", "v", "m", F.monotonically_increasing_id().alias("node"))
    placed = cut(distinct.mapInArrow(partial(_anchor, seed=seed), f"id long, v {kind}, m long, node long, dim int, at double"))
    plans = vectors.sparkSession.sparkContext.broadcast(_plans(placed))
    tiles = placed.mapInArrow(partial(_deal, plans=plans, threshold=threshold), f"dim int, lo long, hi long, block long, id long, v {kind}, m long, node long")
    found = tiles.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi").mapInArrow(partial(_tiles, threshold=threshold, seed=seed), "node long, id long, n long, peer long")
    found = cut(found)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("id").alias("u"), F.col("peer").alias("v"))).withColumnRenamed("node", "id")
    links = F.coalesce("n", F.lit(0)) + F.col("m") - 1
    known = cut(placed.select("id", "v", "m", "node").join(counts, "node", "left").join(roots, "id", "left").select("id", "v", "m", "node", links.alias("n"), F.coalesce("root", "id").alias("root")))
    # Copies take what their first one has; a third of all rows may be copies of one vector.
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    copied = known.where("m > 1").select("v", F.col("id").alias("first"), "node", "n", "root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = good.withColumn("salt", salt).join(copied, ["v", "salt"]).where("id <> first").select("id", "n", "root", "node").distinct()
    told = known.select("id", "n", "root").unionByName(copies.drop("node")).groupBy("id").agg(F.sum("n").alias("n"), F.min("root").alias("root"))
    component = F.coalesce("root", "id")
    named = vectors.select(F.col(id_col).cast("long").alias("id")).join(told, "id", "left")
    return named.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
