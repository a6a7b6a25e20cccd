"""Lexical search, SentencePiece and phrases against brute force, with the hard cases small."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical_search, phrases, sentence_pieces

DOCS = "doc_id long, text string, lang string, score string, rank string, block string, item string"
ITEMS = "item_id string, text string, query string, rank long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)


def rows(n=150, seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Über", "the", "The", "日本", "don't", "a_b", "x\x00y"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(n)]
    texts += [texts[5]] * 60 + ["", None, " ", "...", "the " * 4000, "İ É the", "w1\tw2\nw3"]
    return [(k, t, r.choice(["en", "de", "", None]), "s", "r", "b", "i") for k, t in enumerate(texts)] + [(3, texts[3], "en", "", "", "", ""), (None, "w1 w2 the", None, "", "", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


QUERIES = [("q1", "w1 w2 w3 THE the"), ("q2", "Über 日本 nothing"), ("q3", None), ("q4", "?!"), ("q5", "absent"), ("q6", "the"), ("q7", " ".join(f"w{k}" for k in range(30))), (None, "w4 w9"), ("q8", "w5 w6"), ("q8", "w7 w6")]


def brute_search(data, queries, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in data]
    held = [x for x in held if x[2]]
    n_docs, length = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    asked = defaultdict(set)
    for i, t in queries:
        asked[i] |= set(terms(t))
    out = set()
    for item, ws in asked.items():
        scored = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in ws if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("chunk,most,k", [(2_000_000, 500_000, 50), (150, 500_000, 7), (400, 12, 5)])
def test_search_is_exact(spark, docs, empty, monkeypatch, chunk, most, k):
    """One piece, many pieces, and queries in several blocks give what a full scan gives."""
    monkeypatch.setattr(lexical_search, "CHUNK", chunk)
    monkeypatch.setattr(lexical_search, "MAX_TERMS", most)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in QUERIES], ITEMS)
    got = lexical_search.search(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_search(rows(), QUERIES, k)
    if chunk == 150:
        assert lexical_search.search(empty, items).count() == 0
        assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_search_stops_early():
    """Score at a time ends before the low impacts where the best are proven, and is still exact."""
    rng = np.random.default_rng(1)
    n, terms = 5000, 12
    held = [np.sort(rng.choice(terms, rng.integers(1, terms), replace=False)) for _ in range(n)]
    start = np.append(0, np.cumsum([len(h) for h in held]))
    term = np.concatenate(held)
    often = rng.integers(1, 30, len(term))
    length = rng.integers(30, 300, n)
    piece = lexical_search.Piece(length, start, term, often, np.array([9000, 400, 30, 20, 10, 9, 8, 7, 6, 5, 4, 3]), n, int(length.sum()))
    assert all((np.diff(piece.impact[piece.first[t] : piece.first[t + 1]]) < 0).all() for t in range(terms)), "groups of a term fall in impact"
    seen = []
    complete = piece._complete
    piece._complete = lambda docs, *a: seen.append(len(docs)) or complete(docs, *a)
    docs, score = piece.best(np.arange(terms), 10, 0)
    total = np.bincount(np.repeat(np.arange(n), np.diff(start)), piece.score).astype(int)
    assert seen and seen[0] <= 40, "a short list was completed before the end"
    top = np.sort(total)[-10:]
    assert np.array_equal(np.sort(score)[-10:], top) and np.array_equal(total[docs], score)


TEXTS = ["", None, " ", "   ", "a", "a ", " a", "a  b", "  a   b  ", "a\n b\t c", "▁a▁▁b", "<s> </s> <unk>", "日本語 テキスト", "😀 é́ \x00 \x01", "Hello, world! Hello, world!", "word " * 3000, "x" * 5000, "don't\r\nstop ", "　   a", "ab" * 40 + " " * 40 + "cd"]


def test_sentence_pieces_as_the_library(spark, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(sentence_pieces, "BLOCK", 400)
    monkeypatch.setattr(sentence_pieces, "SLICE", 7)
    lib = SentencePieceProcessor(model_file=sentence_pieces.model_path())
    r = random.Random(5)
    made = [" ".join(r.choice(["the", "cat", "Über", "naïve", "x1", "…", "", "😀z", "\n"]) for _ in range(r.randrange(30))) for _ in range(120)]
    data = list(enumerate(TEXTS + made + [made[0]] * 30)) + [(None, "no id"), (4, "a")]
    df = spark.createDataFrame([(i, t, "clash", b"x") for i, t in data], "doc_id long, text string, block string, ids binary").repartition(4)
    for begin, end in ((True, True), (False, False)):
        got = sentence_pieces.decode(sentence_pieces.encode(df, begin=begin, end=end)).withColumn("list", sentence_pieces.id_list(F.col("ids"))).withColumn("n", sentence_pieces.n_ids(F.col("ids"))).collect()
        want = Counter((i, tuple(lib.encode(t or "", add_bos=begin, add_eos=end))) for i, t in data)
        assert Counter((x.doc_id, tuple(np.frombuffer(x.ids, "<u4").tolist())) for x in got) == want
        assert all(x.decoded == lib.decode(np.frombuffer(x.ids, "<u4").tolist()) and x.list == np.frombuffer(x.ids, "<u4").tolist() and x.n == len(x.list) for x in got)
    both = sentence_pieces.encode(df, decoded=True)
    assert both.columns == ["doc_id", "ids", "decoded"] and all(x.decoded == lib.decode(np.frombuffer(x.ids, "<u4").tolist()) for x in both.collect())
    assert sentence_pieces.encode(df.limit(0)).count() == 0


def test_each_chunk_is_segmented_once_and_misses_are_met(spark, monkeypatch):
    """A share gets each chunk once from the library; chunks that no block asked for are still encoded."""
    import pyarrow as pa

    model = open(sentence_pieces.model_path(), "rb").read()
    assert sentence_pieces.chunks_apart(model)
    lib, asked = sentence_pieces._library(model), []

    class Spy:
        def encode(self, chunks, **how):
            asked.extend(chunks)
            return lib.encode(chunks, **how)

    class Shared:
        value = model

    monkeypatch.setattr(sentence_pieces, "_library", lambda m: Spy())
    blob = sentence_pieces._pack([b"cat", b"dog", b""])
    batch = pa.RecordBatch.from_arrays([pa.array(["0-0", "1-0"]), pa.array([0, 0]), pa.array([blob, sentence_pieces._pack([b"dog", b"cow"])])], names=["block", "share", "chunks"])
    out = list(sentence_pieces._segment(iter([batch]), Shared))[0]
    assert sorted(asked) == ["", "cat", "cow", "dog"]
    assert sentence_pieces._unpack(out["ids"][1].as_py()) == sentence_pieces._ids([lib.encode("dog"), lib.encode("cow")])
    rows = pa.table({"block": ["0-0"], "rows": [_stream(pa.record_batch({"id": [1], "text": ["dog elk  dog "]}))]})
    met, asked[:] = {"dog", "elk", " dog "}, []
    want = lib.encode("dog elk  dog ")
    for known in (met, {"dog"}, set()):  # asked for all, for others, for none
        shares = sentence_pieces._shares(known, 1)
        right = pa.table({"share": pa.array([k for k, _ in shares], pa.int32()), "mark": pa.array([sentence_pieces._mark(s) for _, s in shares], pa.binary()), "ids": pa.array([sentence_pieces._pack(sentence_pieces._ids(lib.encode([c.decode() for c in s]))) for _, s in shares], pa.binary())})
        got = sentence_pieces._join(rows, right, Shared, ([], []), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), 1, False)
        assert np.frombuffer(got["ids"][0].as_py(), "<u4").tolist() == want
    assert sorted(asked) == sorted([*met, *met])


def _stream(batch):
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def test_models_whose_pieces_cross_markers_go_whole(spark, tmp_path, monkeypatch):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(sentence_pieces.model_path(), "rb").read())
    m.pieces[700].piece = "s▁t"
    path = tmp_path / "crossing.model"
    path.write_bytes(m.SerializeToString())
    assert not sentence_pieces.chunks_apart(path.read_bytes())
    lib = SentencePieceProcessor(model_file=str(path))
    df = spark.createDataFrame([(1, "cats take"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in sentence_pieces.encode(df, str(path)).collect()}
    assert got == {1: lib.encode("cats take", add_bos=True, add_eos=True), 2: [1, 2]}
    assert {x.doc_id: x.decoded for x in sentence_pieces.encode(df, str(path), decoded=True).collect()} == {1: "cats take", 2: ""}


def brute_phrases(data, longest, least, top, ratio):
    n, f = Counter(), Counter()
    for _, t, lang, *_ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    best = defaultdict(list)
    for (lang, p), a in cand.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(other[0] == lang and len(other[1]) > len(p) and any(other[1][j : j + len(p)] == p for j in range(len(other[1]))) and 100 * b >= ratio * a for other, b in cand.items())
        if not inside:
            best[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, xs in best.items() for rank, (s, a, p, l, r) in enumerate(sorted(xs)[:top], 1)}


def phrase_rows():
    r = random.Random(8)
    words = ["new", "York", "CITY", "é", "the", "of", "a\x01b", "supercalifragilistic", "supercalifragilistiq", "x" * 40, "x" * 41, "日本"]
    mark = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", " ; "]
    made = ["".join(r.choice(words) + r.choice(mark) for _ in range(r.randrange(0, 50))) for _ in range(150)]
    made += ["New York City of the north"] * 30 + ["la la la la la la la"] * 8 + ["", None, " ", ".,;", "!"] + ["the of " * 500]
    return [(k, t, r.choice(["en", "en", "de", "", "und", None]), "", "", "", "") for k, t in enumerate(made)]


@pytest.mark.parametrize("block,bits,longest,least,top,ratio", [(12_000_000, 27, 5, 10, 2000, 100), (500, 10, 5, 10, 2000, 100), (3000, 27, 3, 6, 7, 60), (500, 20, 2, 3, 5, 100)])
def test_phrases_as_brute_force(spark, empty, monkeypatch, block, bits, longest, least, top, ratio):
    """Small blocks and a crowded bitmap (many wrong hits) change nothing."""
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "HELD", block)
    data = phrase_rows()
    df = spark.createDataFrame(data, DOCS).repartition(3)
    got = phrases.collocations(df, longest, least, top, ratio)
    want = brute_phrases(data, longest, least, top, ratio)
    assert len(want) > 8 and {tuple(r) for r in got.collect()} == want
    if longest == 2:
        assert phrases.collocations(empty).count() == 0


def test_phrases_with_equal_hashes_are_told_apart(monkeypatch):
    """Were all first hashes equal, the second would still part the phrases."""
    words = phrases.Words([b"a b a c a b", b"a b"], np.array([0, 1]), ["en", "de"])
    real = words.grams
    monkeypatch.setattr(words, "grams", lambda k, way: real(k, way) * np.uint64(way))
    at = np.nonzero(words.fits(2))[0]
    first, n, _ = words.distinct(at, 2)
    assert Counter({(words.names[words.lang[i]], p): int(c) for i, p, c in zip(first, words.phrases(first, 2), n)}) == {("en", b"a b"): 2, ("en", b"b a"): 1, ("en", b"a c"): 1, ("en", b"c a"): 1, ("de", b"a b"): 1}


def test_phrases_overflow_64_bits(spark):
    """1000 a n beyond 64 bits is divided exactly."""
    up, down = 10**15 * 1000 * 10**16, 10**7 * 10**9
    got = spark.range(1).select(F.expr("cast(1000000000000000000 as decimal(19,0)) * cast(10000000000000000 as decimal(19,0)) div (cast(10000000 as decimal(19,0)) * cast(1000000000 as decimal(19,0)))")).first()[0]
    assert got == up // down
