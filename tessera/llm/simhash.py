"""SimHash near-duplicates found through vantage-point trees.

A fingerprint of ``bits`` bits is cut into ``blocks`` blocks.  By the pigeonhole principle two
fingerprints within ``radius`` bits lie within a small block radius on some ``intact`` blocks
together, so every choice of so many blocks gets a vantage-point tree over its own Hamming
distance: 64 bits in two blocks and a radius of 3 give two trees over 32 bits and a block
radius of 1.

A tree is fitted on a bounded sample of the fingerprints (``SAMPLE``, one in eight at most): a
node's vantage point is one of its sample rows, and its cut is a distance near the median that
few balls cross.  A row's home is the leaf at the end of its path.  By the triangle inequality
two rows within the block radius are parted at a node only if their distances to its vantage
point lie around the cut, so a row outside the cut by no more than the block radius is also
sent inside, and such a copy goes on to every shard that its ball overlaps; all other branches
are pruned.  Where the sample is used up, further levels take vantage points and cuts of the
whole sample, so that a leaf is the home of about ``LEAF`` rows at any size.  Within a leaf home
rows are compared with all rows by their whole fingerprints, and tasks report spanning links
instead of all pairs.  A leaf above ``CHUNK`` rows is dealt out as pairs of chunks.

At block radius 0 a ball is one value of the chosen bits, no ball crosses a cut, and the shard
is named by that value alone.

A block radius may also be given that is smaller than the radius asks for.  Then rows meet that lie
within it on some block, of blocks cut from several orders of the bits (``deals``).  Leaves are wider
there (``WIDE``), so that fewer balls cross a cut, and rows of a leaf are compared on its block first.

Where a ``similarity`` is asked for, links of fingerprints only gather candidates: the texts of
each linked group are compared by the Jaccard similarity of their shingle sets, nearest
fingerprints first, and those links alone make components.  A larger group is dealt out as
pairs of chunks too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut
from .components import connected_components

CHUNK, TEXTS, LEAF, SAMPLE = 2048, 512, 256, 1 << 18
#: Where a block radius is given: rows at home in a leaf, rows of a chunk, and codes for one of the sample at least.
WIDE, WIDE_CHUNK, ONE_IN = 4096, 32768, 64
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def digests(text: str | None, shingle: int) -> bytes:
    """XXH64 (seed 42) of every shingle, eight bytes each; null or wordless: none.

    Words are split at ASCII blanks after lower-casing A-Z; a text of fewer words than a
    shingle counts as one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b""
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(x + 1 for x in ends[:-1])]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:])])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of distinct numbers; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def simhash(text: str | None, shingle: int, bits: int) -> bytes:
    """The fingerprint, most significant byte first; null or wordless: zero.

    The first 64 bits vote over the ``digests`` of the shingles, further ones over mixes of it.
    """
    if not (h := digests(text, shingle)):
        return bytes(bits // 8)
    votes, n = np.zeros(bits, dtype=np.int64), len(h) // 8
    for lo in range(0, n, 16384):
        base = np.frombuffer(h, dtype=">u8", offset=lo * 8, count=min(16384, n - lo))
        cols = [base]
        for k in range(1, bits // 64):
            x = (base.astype(np.uint64) ^ (base.astype(np.uint64) >> np.uint64(29))) * _SPREAD[k % 8] + np.uint64(k)
            cols.append((x ^ (x >> np.uint64(32))) * _SPREAD[(k + 3) % 8])
        block = np.stack(cols, axis=1).astype(">u8").view(np.uint8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > n).tobytes()


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int, bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [simhash(t.as_py(), shingle, bits) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=[b.schema.names[0], "code"])


def fingerprints(docs: DataFrame, shingle: int = 5, bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code) for every row of ``docs``, repeated rows included; code is binary."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(partial(_fingerprint, shingle=shingle, bits=bits), f"`{id_col}` {kind}, code binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a binary column of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width) if len(column) else np.zeros((0, width), dtype=np.uint8)


def block_radius_of(radius: int, blocks: int, intact: int) -> int:
    """The most bits in which the ``intact`` blocks that differ least can differ: the even spread is the worst."""
    each, rest = divmod(radius, blocks)
    return intact * each + max(0, rest - (blocks - intact))


def masks(bits: int, blocks: int, intact: int, deal: int = 0, seed: int = 0) -> list[np.ndarray]:
    """For each tree the bits that it looks at, as words of 64 bits; a deal cuts its blocks from an order of its own."""
    out, order = [], np.random.default_rng([seed, deal]).permutation(bits) if deal else np.arange(bits)
    for chosen in combinations(range(blocks), intact):
        m = np.zeros(bits, dtype=np.uint8)
        for k in chosen:
            m[order[k * bits // blocks : (k + 1) * bits // blocks]] = 1
        out.append(np.packbits(m).view(">u8").astype(np.uint64))
    return out


def _dealt_anew(raw: np.ndarray, deal: int, seed: int) -> np.ndarray:
    """The codes with their bits in another order, so that blocks hold other bits; deal 0 is the given order."""
    if not deal:
        return raw
    order = np.random.default_rng([seed, deal]).permutation(raw.shape[1] * 8)
    return np.ascontiguousarray(np.packbits(np.unpackbits(raw, axis=1)[:, order], axis=1))


class VantageTree:
    """A tree over the bits of ``mask``; ``route`` gives the leaves that rows and their balls meet.

    Nodes are rows of arrays: ``point``, ``cut`` (a distance of at most this is inside), and the
    numbers of the nodes ``inside`` and ``outside``; a leaf has -1 there.
    """

    def __init__(self, sample: np.ndarray, mask: np.ndarray, radius: int, leaf: int, extra: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mask, self.radius = mask, radius
        s = sample & mask
        self.far = s[rng.integers(0, len(s), extra)] if len(s) else np.zeros((0, len(mask)), dtype=np.uint64)
        self.far_cut = [int(np.median(self._distance(s, p))) for p in self.far]
        points, cuts, sides, todo = [np.zeros(len(mask), dtype=np.uint64)], [0], [[-1, -1]], [(0, np.arange(len(s)))]
        while todo:
            node, rows = todo.pop()
            found = self._split(s, rows, rng) if len(rows) >= 2 * leaf else None
            if found is None:
                continue
            points[node], cuts[node], d = found
            for side, part in enumerate((rows[d <= cuts[node]], rows[d > cuts[node]])):
                sides[node][side] = len(points)
                todo.append((len(points), part))
                points.append(points[0] * np.uint64(0))
                cuts.append(0)
                sides.append([-1, -1])
        self.point, self.cut, self.side = np.stack(points), np.array(cuts, dtype=np.int32), np.array(sides, dtype=np.int64)

    @staticmethod
    def _distance(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.bitwise_count(rows ^ point).sum(axis=-1, dtype=np.int32)

    def _split(self, s: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple | None:
        """Of four vantage points and their cuts between the quartiles the one that fewest balls cross for what it parts."""
        best = None
        for p in rng.choice(rows, min(4, len(rows)), replace=False):
            d = self._distance(s[rows], s[p])
            for cut in range(int(np.quantile(d, 0.25)), int(np.quantile(d, 0.75)) + 1):
                share = float((d <= cut).mean())
                if not 0 < share < 1:
                    continue
                crossing = float(((d > cut - self.radius) & (d <= cut + self.radius)).mean())
                cost = np.log1p(crossing + 0.01) / -(share * np.log(share) + (1 - share) * np.log(1 - share))
                if best is None or cost < best[0]:
                    best = (cost, s[p], cut, d)
        return best and best[1:]

    def _branch(self, d: np.ndarray, cut: np.ndarray | int, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows go inside and which outside: home rows to their side, and inside where their ball reaches in; copies wherever their ball reaches."""
        inside = d - self.radius <= cut
        return inside, np.where(home, d > cut, d + self.radius > cut)

    def route(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for rows of words; a row has one home leaf."""
        words = codes & self.mask
        row, node, home = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=bool)
        done = []
        while len(row):
            inner = self.side[node, 0] >= 0
            done.append((row[~inner], node[~inner], home[~inner]))
            row, node, home = row[inner], node[inner], home[inner]
            d, cut = self._distance(words[row], self.point[node]), self.cut[node]
            inside, outside = self._branch(d, cut, home)
            row, home, node = (
                np.concatenate([row[inside], row[outside]]),
                np.concatenate([home[inside] & (d <= cut)[inside], home[outside]]),
                np.concatenate([self.side[node[inside], 0], self.side[node[outside], 1]]),
            )
        row, leaf, home = (np.concatenate(x) for x in zip(*done)) if done else (row, node, home)
        for point, cut in zip(self.far, self.far_cut):
            d = self._distance(words[row], point)
            inside, outside = self._branch(d, cut, home)
            row, home, leaf = (
                np.concatenate([row[inside], row[outside]]),
                np.concatenate([home[inside] & (d <= cut)[inside], home[outside]]),
                np.concatenate([leaf[inside] * 2, leaf[outside] * 2 + 1]),
            )
        return row, leaf, home


def _routes(batches: Iterator[pa.RecordBatch], trees, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        words = _matrix(b.column(0), bits // 8).view(">u8").astype(np.uint64)
        for k, tree in enumerate(trees.value):
            row, leaf, home = tree.route(words)
            yield pa.RecordBatch.from_arrays([pa.array(leaf * len(trees.value) + k), b.column(0).take(pa.array(row)), pa.array(home)], names=["leaf", "code", "home"])


def _blocks(batches: Iterator[pa.RecordBatch], bits: int, blocks: int, intact: int, seed: int, deals: int) -> Iterator[pa.RecordBatch]:
    """Each row to the shard of its value on every choice of blocks."""
    chosen = masks(bits, blocks, intact)
    for b in batches:
        if not b.num_rows:
            continue
        raw = _matrix(b.column(0), bits // 8)
        for deal in range(deals):
            words = _dealt_anew(raw, deal, seed).view(">u8").astype(np.uint64)
            for k, mask in enumerate(chosen):
                leaf = np.full(len(raw), deal * len(chosen) + k, dtype=np.uint64)
                for at in np.nonzero(mask)[0]:
                    leaf = (leaf ^ (words[:, at] & mask[at])) * _SPREAD[0]
                    leaf = (leaf ^ (leaf >> np.uint64(31))) * _SPREAD[1]
                yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), b.column(0), pa.array(np.ones(len(raw), dtype=bool))], names=["leaf", "code", "home"])


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least reachable index of each of n items linked by pairs (a, b), and by those behind an earlier ``root``."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _by_block(raw: np.ndarray, home: np.ndarray, mask: np.ndarray, rho: int, radius: int) -> np.ndarray:
    """The ``forest`` of a leaf's rows: home rows against all, on the block of ``mask`` first and then on all bits.

    Pairs join the forest a strip of home rows at a time and are not held.
    """
    bits = np.unpackbits(raw, axis=1)[:, np.unpackbits(mask.astype(">u8").view(np.uint8)).astype(bool)]
    packed = np.packbits(bits, axis=1)
    word = np.zeros((len(raw), -(-packed.shape[1] // 4) * 4), dtype=np.uint8)
    word[:, : packed.shape[1]] = packed
    words, code, at = word.view(np.uint32), raw.view(np.uint64), np.nonzero(home)[0]
    n, root = len(raw), np.arange(len(raw))
    eights, strip = -(-n // 8), max(1, (1 << 17) // n)
    for lo in range(0, len(at), strip):
        h = at[lo : lo + strip]
        d = np.bitwise_count(words[h, None, 0] ^ words[None, :, 0])
        for c in range(1, words.shape[1]):
            d = d + np.bitwise_count(words[h, None, c] ^ words[None, :, c])
        # Few pairs are near: they are looked for eight at a time.
        hits = np.zeros((len(h), eights * 8), dtype=bool)
        np.less_equal(d, rho, out=hits[:, :n])
        some = np.flatnonzero(hits.view(np.uint64))
        k, bit = np.nonzero(hits.reshape(-1, 8)[some])
        i, j = h[some[k] // eights], some[k] % eights * 8 + bit
        new = (i != j) & ((i < j) | ~home[j]) & (root[i] != root[j])
        i, j = i[new], j[new]
        near = np.bitwise_count(code[i] ^ code[j]).sum(axis=1, dtype=np.int32) <= radius
        root = forest(n, i[near], j[near], root)
    return root


def _compare(batches: Iterator[pa.RecordBatch], bits: int, radius: int, trees: list[np.ndarray] | None = None, rho: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leaf, lo, hi), home rows first; a group that may go on is carried to the next batch.

    With ``trees``, the masks by leaf number, rows come by code behind the group: links then go to the least
    code of each component, which many leaves share.
    """
    width = bits // 8

    def stars(raw: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        linked = np.nonzero(root != np.arange(len(root)))[0]
        us, vs = raw[root[linked]], raw[linked]
        apart = (us != vs).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in us[apart]], pa.binary()), pa.array([x.tobytes() for x in vs[apart]], pa.binary())], names=["u", "v"])

    def by_leaf(key: np.ndarray, raw: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        cuts = [0, *(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1).tolist(), len(key)]
        roots = [_by_block(raw[a:b], home[a:b], trees[int(key[a, 0]) % len(trees)], rho, radius) + a for a, b in zip(cuts, cuts[1:])]
        return stars(raw, np.concatenate(roots))

    def links(t: pa.Table) -> pa.RecordBatch | None:
        n = t.num_rows
        key = np.stack([t.column(c).to_numpy() for c in ("leaf", "lo", "hi")], axis=1)
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
        raw = _matrix(t.column("code").combine_chunks(), width)
        code, home = raw.view(np.uint64), t.column("home").to_numpy(zero_copy_only=False)
        if trees:
            return by_leaf(key, raw, home)
        at, left, right, step = np.nonzero(home[: n - 1])[0], [], [], 0
        while len(at):
            step += 1
            at = at[at + step < n]
            at = at[group[at] == group[at + step]]
            near = np.zeros(len(at), dtype=bool)
            for lo in range(0, len(at), 1 << 18):
                x = at[lo : lo + (1 << 18)]
                near[lo : lo + len(x)] = np.bitwise_count(code[x] ^ code[x + step]).sum(axis=1, dtype=np.int32) <= radius
            hit = at[near]
            if len(hit):
                left.append(hit)
                right.append(hit + step)
        if not left:
            return None
        return stars(raw, forest(n, np.concatenate(left), np.concatenate(right)))

    carry: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        carry = t if carry is None else pa.concat_tables([carry, t])
        if carry.num_rows < 200_000:
            continue
        key = np.stack([carry.column(c).to_numpy() for c in ("leaf", "lo", "hi")], axis=1)
        ends = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0]
        if len(ends):
            whole = int(ends[-1]) + 1
            if (out := links(carry.slice(0, whole))) is not None:
                yield out
            carry = carry.slice(whole)
    if carry is not None and carry.num_rows and (out := links(carry)) is not None:
        yield out


def _tiles(rows: DataFrame, counted: DataFrame, group: str, by: str, columns: list[str], most: int, order: list) -> DataFrame:
    """(group, lo, hi, columns): the rows of each group, a group of more than ``most`` as pairs of chunks by the hash of ``by``."""
    hot = cut(counted.groupBy(group).count().where(F.col("count") > most).select(group, F.ceil(F.col("count") / most).cast("int").alias("k")))
    k = F.coalesce("k", F.lit(1))
    chunk, other = F.pmod(F.xxhash64(by), k).cast("int"), F.col("other")
    dealt = (
        rows.join(broadcast_if_small(hot, hot.count()), group, "left")
        .select(group, *columns, chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), k - 1)).alias("other"))
        .select(group, F.least("chunk", other).alias("lo"), F.greatest("chunk", other).alias("hi"), *columns)
    )
    return dealt.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", *order)


def _similar(batches: Iterator[pa.RecordBatch], shingle: int, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Spanning links (u, v) of the keys whose texts are similar; rows (root, lo, hi, key, code, text) come sorted."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    us, vs = [], []
    for _, group in groupby(rows, key=lambda r: r[:3]):
        keys, codes, texts = zip(*(r[3:] for r in group))
        n = len(keys)
        code = np.frombuffer(b"".join(codes), dtype=np.uint64).reshape(n, -1)
        at, left, right = [], [], []
        for i in range(n - 1):
            d = np.bitwise_count(code[i + 1 :] ^ code[i]).sum(axis=1, dtype=np.int32)
            hit = np.nonzero(d <= radius)[0]
            at.append(d[hit])
            left.append(np.full(len(hit), i))
            right.append(hit + i + 1)
        if not left:
            continue
        left, right = np.concatenate(left), np.concatenate(right)
        nearest = np.argsort(np.concatenate(at), kind="stable")
        sets: dict[int, np.ndarray] = {}
        root = list(range(n))
        for i, j in zip(left[nearest].tolist(), right[nearest].tolist()):
            a, b = i, j
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a == b:
                continue
            for x in (i, j):
                if x not in sets:
                    sets[x] = np.unique(np.frombuffer(digests(texts[x], shingle), dtype=np.uint64))
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= similarity * large and jaccard(sets[i], sets[j]) >= similarity:
                root[max(a, b)] = min(a, b)
        # Stars around the least key: components settle at once but for groups of several tiles.
        members: dict[int, list[int]] = {}
        for x in sets:
            a = x
            while root[a] != a:
                a = root[a]
            members.setdefault(a, []).append(keys[x])
        for found in members.values():
            least = min(found)
            us += [least] * (len(found) - 1)
            vs += [x for x in found if x != least]
        if len(us) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            us, vs = [], []
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def plant(codes: DataFrame, bits: int, looked_at: list[np.ndarray], rho: int, seed: int, rows: int, least: int) -> list[VantageTree]:
    """A tree for each mask of ``looked_at``, fitted on at most about ``SAMPLE`` of the distinct codes, one in ``least`` at most.

    Codes are sampled by their hash; ``rows`` are at home in a leaf.  An empty sample gives trees of one leaf.
    """
    n = codes.count()
    one_in = max(least, math.ceil(n / SAMPLE))
    sample = codes.where(F.pmod(F.xxhash64(F.lit(seed), "code"), F.lit(one_in)) == 0).orderBy("code").toArrow().column("code")
    words = _matrix(sample.combine_chunks(), bits // 8).view(">u8").astype(np.uint64)
    leaf = max(8, rows // one_in)
    extra = max(0, math.ceil(math.log2(leaf * one_in / rows)))
    return [VantageTree(words, mask, rho, leaf, extra, seed + k) for k, mask in enumerate(looked_at)]


def code_links(codes: DataFrame, bits: int, radius: int, block_radius: int | None = None, seed: int = 7, blocks: int | None = None, intact: int = 1, deals: int = 1) -> DataFrame:
    """Spanning links (u, v) between the distinct ``code`` values within ``radius`` bits.

    With ``block_radius`` None all links are found.  At 0, given or following from the radius,
    the blocks are cut ``deals`` times, each time from another order of the bits, and rows meet
    where one block is equal; a given radius above 0 has trees over such blocks, and rows meet
    within it on one of them.  ``blocks`` is by default two, or as many as hold 16 bits each
    where the block radius is given.
    """
    blocks = blocks or (2 if block_radius is None else bits // 16)
    rho = block_radius_of(radius, blocks, intact) if block_radius is None else block_radius
    kind = "leaf long, code binary, home boolean"
    if block_radius:
        # Codes are few bytes and much work: they are dealt out, not merged into a few partitions.
        codes = cut(codes.select("code").repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "code"))
        looked_at = [m for deal in range(deals) for m in masks(bits, blocks, intact, deal, seed)]
        trees = codes.sparkSession.sparkContext.broadcast(plant(codes, bits, looked_at, rho, seed, WIDE, ONE_IN))
        routed = codes.select("code").mapInArrow(partial(_routes, trees=trees, bits=bits, seed=seed), kind)
        sorted_ = _tiles(routed, routed, "leaf", "code", ["code", "home"], WIDE_CHUNK, ["code"])
        return sorted_.mapInArrow(partial(_compare, bits=bits, radius=radius, trees=looked_at, rho=rho), "u binary, v binary").distinct()
    if rho:
        trees = codes.sparkSession.sparkContext.broadcast(plant(codes, bits, masks(bits, blocks, intact), rho, seed, LEAF, 8))
        routed = codes.select("code").mapInArrow(partial(_routes, trees=trees, bits=bits, seed=seed), kind)
    else:
        routed = codes.select("code").mapInArrow(partial(_blocks, bits=bits, blocks=blocks, intact=intact, seed=seed, deals=deals), kind)
    sorted_ = _tiles(routed, routed, "leaf", "code", ["code", "home"], CHUNK, [F.desc("home")])
    return sorted_.mapInArrow(partial(_compare, bits=bits, radius=radius), "u binary, v binary").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    bits: int = 256,
    radius: int = 45,
    block_radius: int | None = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int | None = None,
    intact: int = 1,
    deals: int = 1,
    similarity: float | None = None,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least id reachable over links of ``radius`` bits or fewer.  With
    ``block_radius`` None all links are found; at 0 those of pairs with an equal block.  Null
    and empty texts share the zero fingerprint; rows without an id are linked but name no
    component; repeated rows get equal results; an empty table gives no rows; other columns
    of ``docs`` are not read.  With a ``similarity`` texts are linked by the Jaccard similarity
    of their shingle sets among those that chains of such links of fingerprints gather, and
    ``radius`` only bounds the candidates.
    """
    if similarity is not None:
        return _verified(docs, shingle, bits, radius, block_radius, id_col, text_col, blocks, intact, deals, similarity)
    coded = cut(fingerprints(docs, shingle, bits, id_col, text_col).withColumnRenamed(id_col, "id"))
    codes = cut(coded.groupBy("code").agg(F.min("id").alias("first")))
    roots = connected_components(code_links(codes, bits, radius, block_radius, blocks=blocks, intact=intact, deals=deals))
    rooted = codes.join(roots, codes.code == roots.node, "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    rooted = cut(rooted)
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(least, "root").select("code", "component_id")
    return coded.join(named, "code").select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("fingerprint"), "component_id")


def _verified(docs: DataFrame, shingle: int, bits: int, radius: int, block_radius: int | None, id_col: str, text_col: str, blocks: int | None, intact: int, deals: int, similarity: float) -> DataFrame:
    """``near_duplicates`` with links between texts, which their 64-bit hash ``key`` names."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    both = fingerprints(named.select(F.struct("id", "key").alias("row"), "text"), shingle, bits, "row", "text")
    coded = cut(both.select("row.id", "row.key", "code"))
    nodes = cut(coded.groupBy("key", "code").agg(F.min("id").alias("first")))
    near = connected_components(code_links(nodes.select("code").distinct(), bits, radius, block_radius, blocks=blocks, intact=intact, deals=deals))
    grouped = cut(nodes.join(near, nodes.code == near.node, "left").select("key", "code", F.xxhash64(F.coalesce("root", "code")).alias("root")))
    many = grouped.groupBy("root").count().where("count > 1").select("root")
    members = cut(grouped.join(many, "root"))
    few = broadcast_if_small(members.select("key"), members.count())
    texts = named.select("key", "text").join(few, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    tiles = _tiles(members.join(texts, "key"), members, "root", "key", ["key", "code", "text"], TEXTS, [])
    links = tiles.mapInArrow(partial(_similar, shingle=shingle, radius=radius, similarity=similarity), "u long, v long")
    roots = connected_components(links)
    rooted = cut(nodes.join(roots, nodes.key == roots.node, "left").select("key", "first", F.coalesce("root", "key").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    component = rooted.join(least, "root").select("key", "component_id")
    return coded.join(component, "key").select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the near copies: of each group the row with the least id stays.

    Near copies have a similarity of 0.8 or more unless ``how`` says otherwise.  Candidates
    differ in at most 62 of 256 bits (39 on average at 0.8, and four standard deviations more)
    and meet in one of 28 vantage-point trees: they differ in one bit at most on one of 28 blocks of
    18 or 19 bits, cut from two orders of the bits.  Null and empty texts are near copies of each other.

    Rows that repeat one id count as one document, of which the row with the least hash
    stays.  A row without an id cannot stand for a group and is left as it is.
    """
    groups = near_duplicates(docs, id_col=id_col, **({"radius": 62, "block_radius": 1, "blocks": 14, "deals": 2, "similarity": 0.8} | how))
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept")).distinct()
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")])
    # Which row of an id stays is decided on ids and hashes; the rows themselves are only looked up.
    times = docs.select(F.col(id_col).alias("__kept"), row.alias("__row")).groupBy("__kept", "__row").agg(F.count(F.lit(1)).alias("n"))
    first = cut(times.join(kept, "__kept", "left_semi").groupBy("__kept").agg(F.min(F.struct("__row", "n")).alias("f")).select("__kept", "f.__row", "f.n"))
    keyed = docs.withColumn("__kept", F.col(id_col)).withColumn("__row", row)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = keyed.join(first.where("n = 1"), ["__kept", "__row"], "left_semi").select(*columns)
    equal = keyed.join(first.where("n > 1"), ["__kept", "__row"], "left_semi").dropDuplicates(["__kept", "__row"]).select(*columns)
    return one.unionByName(equal).unionByName(docs.where(docs[id_col].isNull()))
