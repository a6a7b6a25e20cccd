"""Ranked lexical search over impact-ordered postings, score at a time.

One pass over the documents cuts each whole text into terms and keeps, for the terms that some
query holds, how often the text has them.  The postings go to the shared folder, where the
corpus statistics are counted.  A second pass reads them in pieces of at most ``CHUNK``
postings.  Within a piece the postings of a term are grouped by their exact impact, highest
first.  A query takes the groups of all its terms in falling order of impact and adds each to
its documents' sums.  It stops once no document outside a short list can reach the best ``k``,
however much the groups left could add; the sums of the list are then completed.  The best of
all pieces meet in one window.  Documents of a piece compete under the statistics of the whole
corpus, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: Postings of a piece; query terms of one pass (a longer list of queries takes several).
CHUNK, MAX_TERMS = 2_000_000, 500_000
#: Digits, letters and all bytes above ASCII stay, A-Z become a-z, all else a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [sorted(set(terms_of(t))) for t in _raw(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=[b.schema.names[0], "terms"])


def _postings(batches: Iterator[pa.RecordBatch], name: str, shared) -> Iterator[pa.RecordBatch]:
    number = shared.value
    for b in slices(batches):
        length, start, term, often = [], [0], [], []
        for t in _raw(b.column(1)):
            words = terms_of(t)
            length.append(len(words))
            for w, n in Counter(words).items():
                k = number.get(w)
                if k is not None:
                    term.append(k)
                    often.append(n)
            start.append(len(term))
        lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x, pa.int32())) for x in (term, often)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.int64()), *lists], names=[name, "n", "terms", "often"])


class Piece:
    """Impact-ordered postings of some documents.

    Postings are sorted by term, then by falling impact; ``head``, ``size`` and ``impact`` are
    the groups of equal impact, ``drop`` by how much a term's next group is lower, and
    ``first[t]:first[t+1]`` the groups of a term.  The postings in document order are kept to
    complete sums.
    """

    def __init__(self, n: np.ndarray, start: np.ndarray, term: np.ndarray, often: np.ndarray, weight: np.ndarray, documents: int, length: int):
        m = 50 + (50 * n * documents) // length
        doc = np.repeat(np.arange(len(n)), np.diff(start))
        self.start, self.term, self.score = start, term, weight[term] * ((1_000_000_000 * often) // (1000 * often + 20 * m[doc]))
        order = np.lexsort((-self.score, term))
        by_term, by_score = term[order], self.score[order]
        self.doc = doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (by_term[1:] != by_term[:-1]) | (by_score[1:] != by_score[:-1])
        self.head = np.nonzero(new)[0]
        self.size = np.diff(np.append(self.head, len(order)))
        self.impact, owner = by_score[self.head], by_term[self.head]
        self.first = np.searchsorted(owner, np.arange(len(weight) + 1))
        later = np.append(self.impact[1:], 0)
        later[np.append(owner[1:] != owner[:-1], True)[: len(owner)]] = 0
        self.drop = self.impact - later
        self.sums, self.wanted = np.zeros(len(n), np.int64), np.zeros(len(weight), bool)

    @staticmethod
    def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of all ranges [start, start + size), one after the other."""
        ends = np.cumsum(size)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that may be among the best ``k`` with ``floor`` or more, with their scores."""
        groups = self._ranges(self.first[terms], self.first[terms + 1] - self.first[terms])
        groups = groups[np.argsort(-self.impact[groups], kind="stable")]
        upto = np.cumsum(self.size[groups])
        # What the groups left can still add to a document, after each group.
        left = self.drop[groups].sum() - np.cumsum(self.drop[groups])
        self.sums[:] = 0
        done, share = 0, 32
        while done < len(groups):
            stop = len(groups) if share < 2 else max(done + 1, int(np.searchsorted(upto, upto[-1] // share)))
            g = groups[done:stop]
            self.sums += np.bincount(self.doc[self._ranges(self.head[g], self.size[g])], np.repeat(self.impact[g], self.size[g]).astype(np.float64), len(self.sums)).astype(np.int64)
            done, share = stop, share // 2
            rest, bar = int(left[done - 1]), max(floor, 1)
            if len(self.sums) >= k:
                bar = max(bar, int(np.partition(self.sums, -k)[-k]))
            if done == len(groups) or rest < bar:
                found = np.nonzero(self.sums + rest >= bar)[0]
                if done == len(groups):
                    return found, self.sums[found]
                if len(found) <= 4 * k:
                    return self._complete(found, terms, bar)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _complete(self, docs: np.ndarray, terms: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray]:
        self.wanted[terms] = True
        size = self.start[docs + 1] - self.start[docs]
        rows = self._ranges(self.start[docs], size)
        mine = np.where(self.wanted[self.term[rows]], self.score[rows], 0)
        self.wanted[terms] = False
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, np.repeat(np.arange(len(docs)), size), mine)
        return docs[total >= bar], total[total >= bar]


def _pieces(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.Table]:
    held, many = [], 0
    for b in slices(batches, 20_000):
        held.append(b)
        many += len(b.column(2).flatten())
        if many >= chunk:
            yield pa.Table.from_batches(held)
            held, many = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(batches: Iterator[pa.RecordBatch], name: str, k: int, chunk: int, shared) -> Iterator[pa.RecordBatch]:
    weight, queries, documents, length = shared.value
    floors = [[] for _ in queries]
    for t in _pieces(batches, chunk):
        ids = t.column(0).combine_chunks()
        terms, often = (t.column(c).combine_chunks() for c in (2, 3))
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        piece = Piece(t.column(1).to_numpy(), np.append(0, np.cumsum(sizes)), terms.flatten().to_numpy().astype(np.int64), often.flatten().to_numpy().astype(np.int64), weight, documents, length)
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        rows: list[np.ndarray] = []
        for q, mine in enumerate(queries):
            doc, score = piece.best(mine, k, floors[q][-1] if len(floors[q]) == k else 0)
            top = np.lexsort((place[doc], -score))[:k]
            if len(top):
                rows.append(np.stack([np.full(len(top), q), doc[top], score[top]]))
                floors[q] = sorted([*floors[q], *score[top].tolist()], reverse=True)[:k]
        if rows:
            q, doc, score = np.concatenate(rows, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids.take(pa.array(doc)), pa.array(score, pa.int64())], names=["query", name, "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` highest-scoring documents of each query, scores above 0.

    Terms are runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased.  A
    query's terms count once each.  Equal scores are ranked by ascending id, null ids last.
    Null and empty texts have no terms: such documents match nothing and count in no statistic,
    such queries give no rows.  Rows of one query id are one query with the terms of them all;
    a null query id is an id like others.  A document row that is repeated is ranked as often as
    it is there.  Other columns are not read.  Empty tables give no rows.

    Queries are taken in blocks of about ``MAX_TERMS`` terms; each block reads the documents once.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (queries, item_col)))
    name = "__id"
    asked = queries.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    asked = asked.mapInArrow(_query_terms, f"item {item_kind}, terms array<binary>")
    asked = cut(asked.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / MAX_TERMS))
    texts = docs.select(F.col(id_col).alias(name), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = []
    for block in range(blocks):
        mine = [(r["item"], [bytes(t) for t in r["terms"]]) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()]
        number = {t: n for n, t in enumerate(sorted({t for _, ts in mine for t in ts}))}
        shared = sc.broadcast(number)
        posted = cut(texts.mapInArrow(partial(_postings, name=name, shared=shared), f"`{name}` {kind}, n long, terms array<int>, often array<int>").where("n > 0"))
        documents, length = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents or not mine:
            continue
        weight = np.zeros(len(number), np.int64)
        for r in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weight[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
        held = sc.broadcast((weight, [np.array([number[t] for t in ts], np.int64) for _, ts in mine], documents, length))
        best = posted.where(F.size("terms") > 0).mapInArrow(partial(_search, name=name, k=k, chunk=CHUNK, shared=held), f"query int, `{name}` {kind}, score long")
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(mine)], f"query int, item {item_kind}")
        found.append(best.join(F.broadcast(names), "query").select("item", name, "score"))
    if not found:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(name))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col(name).alias(id_col), "score")
