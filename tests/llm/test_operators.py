"""Operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, embedding_dedup, language_model, line_templates, mixing, quality, sharding, simhash, token_counts, url_reputation
from tessera.llm.common import is_held_out
from tessera.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, code string, root string"
WORDS = ["alpha", "Beta", "gamma,", "delta", "eps", "zeta.", "eta", "theta", "iota", "kappa"]


def corpus(n=80, seed=1):
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(0, 60))) for _ in range(n)]
    texts += [texts[3]] * 5 + ["", "", None, "one", "two words", "x " * 3000, "Ünï\u2003cødé 日本 <|endoftext|> don't  \n\n", texts[4] + " tail", "\x1f a\x85b"]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src7", "src12", None]), 1, "c", "r") for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id", "en", "src0", 1, "c", "r")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unite(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, None)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    real = [(a, b) for a, b in pairs if b is not None and a != b]
    want = unite(real, {x for p in real for x in p})
    assert got == want


def brute_code(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def test_simhash_is_exact(docs, empty):
    got = simhash.near_duplicates(docs, 3, 64, 3, None).collect()
    codes = {r.fingerprint: int(r.fingerprint, 16) for r in got}
    rows = corpus()
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter((i, brute_code(t)) for i, t, *_ in rows)
    near = [(a, b) for a in codes.values() for b in codes.values() if a < b and (a ^ b).bit_count() <= 3]
    root, least = unite(near, set(codes.values())), {}
    for i, t, *_ in rows:
        c = root[brute_code(t)]
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least[root[brute_code(t)]]) for i, t, *_ in rows}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_blocks_and_hot_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = {int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, 2)) for b in base for _ in range(12)} | set(map(int, base))
    df = spark.createDataFrame([(c.to_bytes(8, "big"),) for c in codes], "code binary")
    links = [(int.from_bytes(r.u, "big"), int.from_bytes(r.v, "big")) for r in simhash.code_links(df, 64, 3).collect()]
    near = [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 3]
    assert unite(links, codes) == unite(near, codes)
    for radius, blocks, intact in [(3, 5, 2), (3, 6, 3), (6, 5, 2), (3, 1, 1), (6, 2, 1)]:
        found = [(int.from_bytes(r.u, "big"), int.from_bytes(r.v, "big")) for r in simhash.code_links(df, 64, radius, blocks=blocks, intact=intact).collect()]
        assert unite(found, codes) == unite([(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= radius], codes)


@pytest.mark.parametrize("radius,blocks,extra", [(3, 2, 0), (3, 2, 3), (5, 1, 0), (7, 2, 2)])
def test_vantage_trees_prune_and_overlap(radius, blocks, extra):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, radius + 1), replace=False)) for b in base for _ in range(3)], dtype=np.uint64)
    codes = np.unique(np.concatenate([base, near]))[:, None]
    rho, met = simhash.block_radius_of(radius, blocks, 1), set()
    for k, mask in enumerate(simhash.masks(64, blocks, 1)):
        tree = simhash.VantageTree(codes[::8], mask, rho, 8, extra, k)
        row, leaf, home = tree.route(codes)
        assert np.array_equal(np.sort(row[home]), np.arange(len(codes))), "one home each"
        assert len(np.unique(leaf)) >= 8 and (~home).sum() > 0, "balls that cross a cut are sent to two shards"
        assert len(row) < len(codes) * len(np.unique(leaf)) / 2, "branches are pruned"
        assert len(set(zip(row.tolist(), leaf.tolist()))) == len(row)
        for x in np.unique(leaf):
            here = np.nonzero(leaf == x)[0]
            mine, every = row[here[home[here]]], row[here]
            met |= {(min(a, b), max(a, b)) for a in mine.tolist() for b in every.tolist() if a != b}
    links = {(a, b) for a in range(len(codes)) for b in np.nonzero(np.bitwise_count(codes[:, 0] ^ codes[a, 0]) <= radius)[0].tolist() if a < b}
    assert len(links) > 600 and links <= met and len(met) < len(codes) ** 2 / 3


def test_keep_one_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (2, text + " end", "c"), (None, text, "d"), (None, text, "d"), (3, None, "e"), (4, "", "f"), (5, "x y", "g")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 3, 5] and sum(r.doc_id is None for r in kept) == 2
    assert simhash.keep_one(spark.createDataFrame(rows[:0], "doc_id long, text string, root string")).count() == 0


def test_near_copies_are_found_and_others_stay(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [[r.choice(vocabulary) for _ in range(300)] for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(30):  # two words of 300 differ: a similarity of about 0.93
        t = list(texts[k])
        t[r.randrange(300)], t[r.randrange(300)] = "new", "other"
        rows.append((100 + k, " ".join(t)))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(60))


def brute_mix(rows, share, epochs, seed, weights):
    leaves = defaultdict(int)
    keyed = []
    for i, t, lang, source, *_ in rows:
        n = len(re.findall(r"[^ \t\n\x0B\f\r]+", t or ""))
        key = ("=" + source if source else "-", "=" + lang if lang else "-")
        leaves[key] += n
        keyed.append((i, t, key, n))

    def fill(children, budget):
        order = sorted(children, key=lambda c: (c[1] / c[2], c[0]))
        out, left, w = {}, budget, sum(c[2] for c in order)
        for k, (name, cap, weight) in enumerate(order):
            if cap * w <= left * weight:
                out[name] = cap
                left, w = left - cap, w - weight
            else:
                rest = {name2: left * weight2 // w for name2, _, weight2 in order[k:]}
                over = left - sum(rest.values())
                out |= {name2: x + (n < over) for n, (name2, x) in enumerate(rest.items())}
                break
        return out

    caps = {k: v * epochs for k, v in leaves.items() if v}
    total = min(sum(caps.values()), sum(leaves.values()) * share[0] // share[1])
    top = fill([(d, sum(c for k, c in caps.items() if k[1] == d), weights.get(d[1:], 1)) for d in sorted({k[1] for k in caps})], total)
    budget = {}
    for d, b in top.items():
        for name, got in fill([(k[0], c, 1) for k, c in caps.items() if k[1] == d], b).items():
            budget[name, d] = got
    used = []
    for key, have in leaves.items():
        whole, part = divmod(budget.get(key, 0), have) if have else (0, 0)
        upto = 0
        mine = [x for x in keyed if x[2] == key]
        for i, t, _, n in sorted(mine, key=lambda x: (hashlib.md5(f"{seed}|{whole}|{'' if x[0] is None else x[0]}|{hashlib.md5((x[1] or '').encode()).hexdigest()}".encode()).hexdigest(), crc32((x[1] or "").encode()), x[3])):
            upto += n
            used.append((i, whole + (1 if part and upto <= part else 0)))
    return used


@pytest.mark.parametrize("share,epochs", [((9, 10), 1), ((1, 1), 4), ((1, 3), 2)])
def test_mixing(docs, empty, share, epochs):
    got = mixing.mix(docs, {"lang": {"en": 3, "de": 1}}, F.lit(None), share, epochs)
    want = brute_mix(corpus(), share, epochs, 77, {"en": 3, "de": 1})
    assert Counter((r.doc_id, r.epochs) for r in got.collect()) == Counter(want)
    assert mixing.mix(empty, {}, F.lit("d")).count() == 0
    most = Counter()
    for r in got.collect():
        most[r.doc_id] = max(most[r.doc_id], r.epochs)
    used = mixing.materialize(docs, got)
    assert used.columns == docs.columns and Counter(r.doc_id for r in used.collect()) == Counter(i for i, *_ in corpus() for _ in range(most[i]))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((30, 16))
    x = [list(map(float, c + 0.15 * rng.standard_normal(16))) for c in centre for _ in range(40)]
    rows = list(enumerate(x)) + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, x[0]), (9004, x[0]), (9005, [1.0, None] * 8), (9006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(df).collect()}
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    m = np.stack([v / np.linalg.norm(v) for _, v in good])
    ids = [i for i, _ in good]
    sim = m @ m.T
    near = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(sim >= 0.9)) if a < b]
    n = Counter(y for p in near for y in p)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * 2 * len(near) <= found <= 2 * len(near) and all(got[i].n_links <= n[i] for i in got)
    assert {i: r.component_id for i, r in got.items()} == unite(near, got)
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0 and got[9002].kept and got[9003].component_id == 0


def test_embeddings_in_many_blocks_with_a_third_of_copies(spark, monkeypatch):
    for name, value in [("PIECE", 16), ("BLOCKS", 6), ("BLOCK_BYTES", 40 * 8 * 16)]:
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(3)
    x = [list(map(float, c + 0.1 * rng.standard_normal(16))) for c in rng.standard_normal((40, 16)) for _ in range(8)]
    x += [x[7]] * 150 + [[v * 1e-30 for v in x[9]], [v * 1e30 for v in x[9]]]
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")).collect()}
    m = np.array(x, dtype=np.float32).astype(float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = [(int(a), int(b)) for a, b in zip(*np.nonzero(m @ m.T >= 0.9)) if a < b]
    n = Counter(y for p in near for y in p)
    assert len(got) == len(x) and all(got[i].n_links <= n[i] for i in got) and 0.99 * sum(n.values()) <= sum(r.n_links for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == unite(near, got)
    assert {r.n_links for i, r in got.items() if x[i] == x[7]} == {got[7].n_links}


def test_embeddings_of_mixed_lengths_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PIECE", 16)
    rng = np.random.default_rng(5)
    x = [list(map(float, c + 0.1 * rng.standard_normal(len(c)))) for n in (3, 8, 24) for c in rng.standard_normal((12, n)) for _ in range(5)]
    # 0.9 exactly in doubles: (1, 0, ...) against (0.9, ...) of length 1
    rows = list(enumerate(x)) + [(500, [1.0, 0.0]), (501, [2.0, 0.0]), (502, [5.0]), (503, [0.25]), (504, [-5.0]), (None, x[0])]
    df = spark.createDataFrame([(i, v, "n", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, lo int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(df).collect()}
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None}
    near = [(a, b) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    n = Counter(y for p in near for y in p)
    assert {i: r.n_links for i, r in got.items()} == {i: n[i] for i, _ in rows}
    assert {i: r.component_id for i, r in got.items() if i is not None} == unite(near, units) and got[None].component_id is None
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_links(twice).collect()) == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1)]


def test_window_collisions_are_counted_exactly_and_recall_holds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 32))
    y = x + 0.0575 * math.sqrt(2) * rng.standard_normal(x.shape)
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    d, w, bar = embedding_dedup.directions(32, 11), embedding_dedup.window_width(0.9, 32), embedding_dedup.least_count()
    got = set(zip(*(z.tolist() for z in embedding_dedup.Piece(y @ d).collided(x @ d, w, bar))))
    n = sum((np.abs((x @ d)[:, k, None] - (y @ d)[None, :, k]) <= w).astype(int) for k in range(embedding_dedup.PROJECTIONS))
    assert got == set(zip(*(z.tolist() for z in np.nonzero(n >= bar)))) and len(got) < 0.05 * 300 * 300
    near = np.nonzero((x * y).sum(1) >= 0.9)[0].tolist()
    assert len(near) > 100 and sum((k, k) in got for k in near) >= 0.99 * len(near)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, empty, file, monkeypatch):
    path = token_counts.tokenizer_path(file)
    if file.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        count = lambda t, p=SentencePieceProcessor(model_file=path): len(p.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, p=Tokenizer.from_file(path): len(p.encode(t, add_special_tokens=False).ids)
    monkeypatch.setattr(token_counts, "CACHE", 20)
    more = ["漢字かな交じり文 と 한국어 텍스트", "مرحبا بالعالم 123", "हिन्दी में पाठ ४५६", "emoji 😀👍🏽 mix\u0558 \U00010940", "a\x00b\x1cc\x7f \x85 \u3000x", "<|endoftext|><|endoftext|> x", "it's we'll 3.14  \n\n tail  ", "word " * 30_000]
    rows = [(i, t) for i, t, *_ in corpus()] + [(700 + k, t) for k, t in enumerate(more)]
    df = spark.createDataFrame([(i, t, "t", "n") for i, t in rows], "doc_id long, text string, token string, n_tokens string")
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, path).collect())
    want = Counter((i, len((t or "").encode()), n, n > 1024) for i, t in rows for n in [count(t) if t else 0])
    assert got == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_frequent_pretokens_have_their_lengths(docs):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path()
    t, model = Tokenizer.from_file(path), open(path, "rb").read()
    table = token_counts.frequent_lengths(docs.select("doc_id", "text"), model)
    assert len(table) > 20 and {x: len(t.encode(x).ids) for x in table} == table and max(table.values()) > 1
    assert token_counts.Counter(model, table).cut and not token_counts.Counter(open(token_counts.tokenizer_path("word_bpe_49k.json"), "rb").read(), {}).cut


@pytest.mark.parametrize("table", [5, 50])
def test_language_model(docs, empty, monkeypatch, table):
    monkeypatch.setattr(language_model, "TABLE", table)
    monkeypatch.setattr(language_model, "CACHE", 30)
    rows = corpus()
    out = lambda i: i is not None and crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, t, *_ in rows:
        if not out(i):
            c.update((t or "").encode().lower().split())
            c[b" "] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        ws = [*(t or "").encode().lower().split(), b" "]
        want[i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
    got = language_model.score(docs, is_held_out("doc_id", 7, 2)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    again = language_model.score(docs.repartition(7), is_held_out("doc_id", 7, 2)).collect()
    by_row = lambda rs: sorted((r.doc_id or -1, r.score) for r in rs)
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-3 for x, y in zip(by_row(again), by_row(got)))
    assert language_model.score(empty, is_held_out("doc_id", 7, 2)).count() == 0
    none = language_model.score(docs, F.lit(True)).collect()
    assert len(none) == len(rows) and {(r.n_known, r.train_tokens) for r in none} == {(0, 0)}


def brute_log10p(m, a, b, w):
    """The whole softmax over classes times units, in plain loops."""
    h = m.context[a].astype(float) * m.position[0] + m.context[b].astype(float) * m.position[1]
    classes = np.exp(m.class_out.astype(float) @ h + m.class_bias)
    units = np.exp(m.out.astype(float) @ h + m.bias)
    p = np.array([classes[c] / classes.sum() * units[k] / units[m.cls == c].sum() for k, c in enumerate(m.cls)])
    return np.log10(p[w]), p.sum()


def test_language_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 400, 150)
    m = language_model.Model(counts)
    m.set(m.parameters() + rng.normal(0, 0.3, len(m.parameters())))
    a, b, w = (rng.integers(0, n, 40) for n in (151, 151, 150))
    got = m.log10p(a, b, w)
    for k in range(40):
        want, total = brute_log10p(m, a[k], b[k], w[k])
        assert abs(got[k] - want) < 1e-4 and abs(total - 1) < 1e-9
    # a language in which each word nearly fixes the next
    text = np.cumsum(rng.random(60_000) < 0.1) * 7 + np.arange(60_000)
    units = text % 150
    counts = np.bincount(units, minlength=150)
    m = language_model.Model(counts)
    x = language_model.contexts(units, np.array([60_000]), m.rank, m.pad)
    trainer = language_model.Trainer(m)
    before = m.log10p(*(c[50_000:] for c in x)).mean()
    for _ in range(5):
        for lo in range(0, 50_000, 2000):
            trainer.step(*(c[lo : lo + 2000] for c in x))
    assert abs(before + log10(150)) < 0.1 and m.log10p(*(c[50_000:] for c in x)).mean() > before + 0.5
    a, b, w = language_model.contexts(np.array([4, 5, 6, 9]), np.array([0, 3, 0, 1, 0]), np.arange(10), 10)
    assert (a.tolist(), b.tolist(), w.tolist()) == ([10, 10, 4, 10], [10, 4, 5, 10], [4, 5, 6, 9])


def test_language_model_beats_the_unigram_on_held_out_text(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD", 20_000)
    monkeypatch.setattr(language_model, "FAN", 2)
    monkeypatch.setattr(language_model, "BATCH", 256)
    r, v = random.Random(2), [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(900):
        k, t = r.randrange(300), []
        for _ in range(r.randrange(20, 120)):
            k = (k * 3 + 1) % 300 if r.random() < 0.85 else r.randrange(300)
            t.append(v[k])
        texts.append(" ".join(t))
    got = language_model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), is_held_out("doc_id", 7, 2)).where("held_out").collect()
    assert sum(x.score for x in got) > sum(x.base_score for x in got) + 0.2 * sum(x.n_tokens for x in got)


def test_line_dedup(spark):
    rows = [(k, f"own line number w{k}x\nAll rights reserved {1990 + k} by us\n\nbye") for k in range(6)] + [(6, None), (7, ""), (8, "bye"), (8, "bye"), (9, "rare 5")]
    got = line_templates.drop_recurring_lines(spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, h string"), min_docs=7).collect()
    out = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got}
    assert (0, "own line number w0x\nAll rights reserved 1990 by us\n", 4, 1) in out and (6, None, 0, 0) in out and (7, "", 1, 0) in out and (8, "", 1, 1) in out and (9, "rare 5", 1, 0) in out
    assert len(got) == len(rows)
    five = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5).where("doc_id = 3").first()
    assert five.text == "" and five.n_dropped == 3  # the line of its own has a variable field as well


def brute_lines(rows, min_docs=5, depth=2):
    flat = lambda x: re.sub(r"[^ ]*[0-9][^ ]*", "<*>", " ".join(w for w in re.split(r"[ \t\x0b\f\r]+", x) if w))
    seen = {(t, flat(x)) for _, t in rows if t is not None for x in t.split("\n")}
    seen = {(t, tuple(f.split(" "))) for t, f in seen if f}
    n, leaves, at = Counter(f for _, f in seen), defaultdict(set), Counter()
    for t, f in seen:
        leaves[len(f), f[:depth]].add(t)
        for k, w in enumerate(f):
            at[len(f), f[:depth], k, w] += 1
    templates = defaultdict(set)
    for t, f in seen:
        if n[f] < min_docs and len(leaves[len(f), f[:depth]]) >= min_docs:
            made = tuple(w if at[len(f), f[:depth], k, w] >= min_docs else "<*>" for k, w in enumerate(f))
            if 5 * sum(w != "<*>" for w in made) >= 3 * len(f):
                templates[made].add((t, f))
    gone = {f for f in n if n[f] >= min_docs} | {f for s in templates.values() if len({t for t, _ in s}) >= min_docs for _, f in s}
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if tuple(flat(x).split(" ")) not in gone]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("listed", [1000, 1])
def test_line_templates_vary_in_words_and_keep_blank_lines(spark, monkeypatch, listed):
    monkeypatch.setattr(line_templates, "LISTED", listed)
    r = random.Random(5)
    names = ["anna", "bert", "carl", "dora", "emil", "finn"]
    rows = [(k, f"Posted by {n}\r\n\r\n{' '.join(r.choice(WORDS) for _ in range(12))}\r\nShare this page with {n} now\r\n \t\r\nown {n}") for k, n in enumerate(names)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (23, "x\n" * 3000 + "Posted by zoe"), (24, "The end 7"), (25, "lone")]
    rows += [(100 + k, "\n".join(" ".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(8))) for k in range(40)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n int")
    got = Counter((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in line_templates.drop_recurring_lines(df).collect())
    assert got == Counter(brute_lines(rows))
    first = next(t for i, t, *_ in got if i == 1)
    assert "Posted" not in first and "Share" not in first and first.count("\n") == 3 and (22, "\n\n", 3, 0) in got
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_line_templates_send_leaves_instead_of_lines(spark, monkeypatch, small):
    """What goes to every task counts leaves, not lines; results stay where it is too large for that.

    Leaves: many lines and no template; a line that recurs (sure); lines of few texts each (doubtful); enough lines of too few texts.
    """
    sizes = []
    monkeypatch.setattr(line_templates, "broadcast_if_small", lambda df, rows, limit=0: sizes.append(rows) or (F.broadcast(df) if small else df))
    monkeypatch.setattr(line_templates, "SMALL", 200_000 if small else -1, raising=False)
    rows = [(k, "see also " + " ".join(c * (k + 1) for c in "wqz")) for k in range(60)]
    assert [r.n_dropped for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0] * 60
    assert sizes and max(sizes) == 1
    rows += [(100 + k, f"to be sure\nto be {'mnopqr'[k]}\nwe {'mnopqr'[k]} had that\nwe had {'mnopqr'[k]} that") for k in range(6)]
    rows += [(200 + k, "\n".join(f"of two {c} {k}" for c in "abcdef")) for k in range(2)] + [(300 + k, f"page <*> of the {'ab'[k % 2]} {'book' if k < 6 else 'bo:ok'}") for k in range(9)]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in got.collect()) == Counter(brute_lines(rows))


def test_rows_near_many_keys(spark, monkeypatch):
    """The bitmap keeps each row whose key is among the many, and of the others what its size tells."""
    df, some = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("t"), "id"), spark.range(0, 20_000, 10).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("t"))
    near = {r.id for r in line_templates._near(df, some, "t").collect()}
    assert near >= set(range(0, 20_000, 10)) and len(near) < 2010
    monkeypatch.setattr(line_templates, "SMALL", 100)
    assert sorted(r.id for r in line_templates._met(df, some, 2000, "t").collect()) == list(range(0, 20_000, 10))
    monkeypatch.setattr(line_templates, "BITS", 14)
    assert 3000 < line_templates._near(df, some, "t").count() < 6000


def test_sharding(docs, empty):
    rows = corpus()
    got = sharding.interleave(docs, 5).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5)) and len(got) == len(rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    total = Counter(r.source for r in got)
    for s in range(5):
        for source, n in Counter(r.source for r in got if r.shard == s).items():
            assert abs(n - total[source] / 5) <= 2
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.interleave(empty).count() == 0
    whole = sharding.with_shards(docs, 5)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    assert Counter((r.doc_id, r.shard, r.slot) for r in whole.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in got)


def test_url_rules_and_bounds(spark):
    urls = ["http://A.Example.NET/en/1", "http://x.example.net/de/", "https://m.example.com/de/2?x", "https://m.example.com/en/2", "http://b.org/fr/", "http://b.org/fr", "nothing", None, "http://bad.org/x", "http://net", "x://good.org?q#/fr/", "http://notnet/"]
    pages = spark.createDataFrame([(k, u, "a", "b") for k, u in enumerate(urls)], "page_id long, url string, host string, bound string")
    outcomes = spark.createDataFrame([("bad.org", 0)] * 40 + [("good.org", 1)] * 40 + [(None, 1), ("good.org", None)], "host string, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, outcomes).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][1:] == ("/de/2", "example.com/de/", "block") and got[3][2] is None
    assert got[4][2:] == ("org/fr/", "allow") and got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8][3] == "block" and got[9][:3] == ("net", "", None) and got[10] == ("good.org", "", None, "allow") and got[11][2] is None
    assert url_reputation.judge(pages.limit(0), outcomes.limit(0)).count() == 0


def test_url_names():
    import duckdb

    want = {
        "news.bbc.co.uk": ("news.bbc.co.uk", "bbc.co.uk", "co.uk"), "a.example.com:8080": ("a.example.com", "example.com", "com"), "me@x.org": ("x.org", "x.org", "org"),
        "10.0.0.7:80": ("10.0.0.7", "10.0.0.7", "10.0.0.7"), "localhost": ("localhost", "localhost", "localhost"), "co.uk": ("co.uk", "co.uk", "co.uk"), "": ("", "", ""), "x.y.com.au": ("x.y.com.au", "y.com.au", "com.au"),
    }
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(h,) for h in want], "host string")
    assert {r[0]: tuple(r[1:]) for r in df.select("host", *url_reputation.names(F.col("host"))).collect()} == want
    u = url_reputation
    got = duckdb.sql(f"SELECT DISTINCT regexp_extract('news.bbc.co.uk', '{u.DOMAIN}', 1), regexp_extract('news.bbc.co.uk', '{u.SUFFIX}', 1)").fetchall()
    assert got == [("bbc.co.uk", "co.uk")]


def test_url_bounds_are_shrunk_from_level_to_level(spark):
    r = random.Random(7)
    rate = {"a.x.com": 0.9, "b.x.com": 0.8, "c.y.com": 0.2, "d.y.com": 0.1, "e.co.uk": 0.5, "f.z.org": 1.0}
    rows = [(h, int(r.random() < p)) for h, p in rate.items() for _ in range(r.randrange(3, 60))]
    got, overall = url_reputation.reputation(spark.createDataFrame(rows, "host string, good int"))

    def key(h, level):
        return h if level == "name" else {"a.x.com": "x.com", "b.x.com": "x.com", "c.y.com": "y.com", "d.y.com": "y.com", "e.co.uk": "e.co.uk", "f.z.org": "z.org"}[h] if level == "domain" else "co.uk" if h == "e.co.uk" else h.rsplit(".", 1)[1]

    assert abs(overall - (sum(g for _, g in rows) + 1) / (len(rows) + 2)) < 1e-12
    above = None
    for level, up in (("suffix", None), ("domain", "suffix"), ("name", "domain")):
        n, good, prior = Counter(), Counter(), {}
        for h, g in rows:
            k = key(h, level)
            n[k], good[k], prior[k] = n[k] + 1, good[k] + g, above[key(h, up)] if up else overall
        excess = (sum(n[k] * (good[k] / n[k] - prior[k]) ** 2 for k in n) - sum(prior[k] * (1 - prior[k]) for k in n)) / max(len(rows) - len(n), 1)
        s = min(max(sum(n[k] * prior[k] * (1 - prior[k]) for k in n) / len(rows) / excess - 1, 1), 1000) if excess > 0 else 1000
        above = {k: (good[k] + prior[k] * s) / (n[k] + s) for k in n}
        found = {x.key: (x["mean"], x.bound) for x in got[level].collect()}
        assert found.keys() == above.keys()
        for k, m in above.items():
            assert abs(found[k][0] - m) < 1e-9 and abs(found[k][1] - (m - 1.645 * math.sqrt(m * (1 - m) / (n[k] + s + 1)))) < 1e-9
    pages = spark.createDataFrame([(k, f"http://a.x.com/{'p' * 100_000}", "q") for k in (1, 1, 2)], "page_id long, url string, prior string")
    assert sorted(x.verdict for x in url_reputation.judge(pages, spark.createDataFrame(rows, "host string, good int")).collect()) == ["allow"] * 3


def test_quality_model_is_a_function_of_the_tables(spark):
    r = random.Random(4)
    rows = [(k % 150, " ".join(r.choice(WORDS) + ("!!" if k % 3 == 0 else "") for _ in range(r.randrange(0, 60)))) for k in range(200)] + [(160, None), (161, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(165)] + [(3, 1), (4, None)], "doc_id long, quality int")
    models = [quality.fit(docs.repartition(n), labels.repartition(n), is_held_out("doc_id", 5, 0)) for n in (1, 3, 7)]
    assert len({quality._key(m) for m in models}) == 1 and len({m[2].p[0].tobytes() + m[2].p[2].tobytes() for m in models}) == 1
    vocabulary, vectors, network = models[0]
    words = quality.Words(vocabulary)

    def brute(text):
        ids = [vocabulary.get(w, quality.shape(w)) for w in (text or "").encode().split()]
        if not ids:
            x = np.zeros(2 * quality.DIM + 2)
        else:
            v = np.array([vectors[k] for k in ids], dtype=float)
            same = [a == b for a, b in zip(ids, ids[1:])]
            x = np.concatenate([v.mean(0), v.std(0), [np.mean(same) if same else 0.0, np.log1p(len(ids)) / 5]])
        hidden = [max(0.0, float((x - network.mean) / network.scale @ network.p[0][:, j] + network.p[1][j])) for j in range(quality.HIDDEN)]
        return 1 / (1 + math.exp(-(sum(h * o for h, o in zip(hidden, network.p[2])) + float(network.p[3][0])) / network.temperature))

    got = Counter((x.doc_id, round(x.score, 3)) for x in quality.score(docs, models[0]).collect())
    assert sum((got - Counter((i, round(brute(t), 3)) for i, t in rows)).values()) <= 3  # rounding at the third place
    assert words.of("alpha zzz9!").tolist() == [vocabulary[b"alpha"], quality.shape(b"zzz9!")]
    assert quality.fit(docs.limit(0), labels, F.lit(False))[2] is None and quality.score(docs.limit(0), models[0]).count() == 0


def test_shards_of_rows_without_ids_and_of_equal_rows(spark):
    rows = [(None if k % 3 else k, f"text {k}", "s", 1) for k in range(300)] + [(None, "same", "s", 1)] * 40 + [(7, None, None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    out = sharding.with_shards(df, 4)
    got = out.collect()
    assert out.columns == [*df.columns, "shard", "slot"] and Counter((r.doc_id, r.text, r.source, r.position) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {(r.shard, r.slot) for r in got} == {(s, k) for s, n in sizes.items() for k in range(n)}
    assert sharding.with_shards(df.limit(0)).count() == 0


def test_quality_tells_junk(spark):
    r = random.Random(3)
    good = [" ".join(r.choice(WORDS) for _ in range(80)) for _ in range(300)]
    bad = [" ".join(r.choice(WORDS).upper() + "!!" for _ in range(80)) for _ in range(60)] + [(r.choice(WORDS) + " ") * 80 for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1 if k < 300 else 0) for k in range(420)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = is_held_out("doc_id", 5, 0)
    model = quality.fit(docs, labels, out)
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    held = [k for k in range(420) if crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.3) == (k < 300) for k in held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, s in got.items() if s >= 0.3}
    none = quality.fit(docs, labels.limit(0), out)
    assert {x.score for x in quality.score(docs, none).collect()} == {1.0}


def brute_hits(text, items, window=10, mask=False):
    words = decontaminate.words_of(text)
    hit, met = [False] * len(words), set()
    for item, t in items:
        ws = decontaminate.words_of(t)
        n = min(window, len(ws))
        if not ws:
            continue
        for k in range(len(ws) - n + 1):
            for a in range(len(words) - n + 1):
                if words[a : a + n] == ws[k : k + n]:
                    hit[a : a + n] = [True] * n
                    met |= {item} - {None}
    if mask:
        edges = [k for k in range(len(hit) + 1) if (k and hit[k - 1]) != (k < len(hit) and hit[k])]
        return len(words), sum(hit), list(zip(edges[::2], edges[1::2]))
    return len(words), sum(hit), sorted(map(str, met))


@pytest.mark.parametrize("most", [decontaminate.MAX_WORDS, 40])
def test_decontamination(spark, most):
    r = random.Random(6)
    v = ["a", "b", "c", "Dé", "9"]
    items = [(k, " ".join(r.choice(v) for _ in range(r.choice([1, 3, 12, 25])) )) for k in range(8)] + [(50, "Rare Solo!"), (51, None), (52, "..."), (None, "a b c"), (None, " ".join(f"only{k}" for k in range(11)))]
    texts = [" ".join(r.choice(v) for _ in range(r.randrange(120))) for _ in range(30)] + [None, "", "x " + items[4][1].upper() + " y", "rare, SOLO rare", "q " + " ".join(f"ONLY{k}" for k in range(11)), items[6][1] * 60]
    docs = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, match string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, sum(s.stop - s.start for s in x.spans), list(x["items"])) for x in decontaminate.matches(docs, bench, max_words=most).collect()}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(texts)}
    assert decontaminate.matches(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    twice = decontaminate.matches(docs.unionByName(docs), bench, max_words=most)
    assert Counter(x.doc_id for x in twice.collect()) == Counter({k: 2 for k in got})
    # removal, by the same spans
    for span, coverage in ((0, 0.5), (12, 0.9), (0, 0.0)):
        want = {}
        for k, t in enumerate(texts):
            n, cut_, masks_ = brute_hits(t, items, mask=True)
            runs = [(a, b) for a, b in masks_ if b - a > span]
            if sum(b - a for a, b in runs) <= coverage * n:
                ws = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())]
                out, last = "", 0
                for a, b in runs:
                    out, last = out + t[last : ws[a][0]], ws[b - 1][1]
                want[k] = out + t[last:] if runs else t
        cleaned = decontaminate.remove(docs, bench, max_span=span, max_coverage=coverage, max_words=most)
        assert cleaned.columns == docs.columns and {x.doc_id: x.text for x in cleaned.collect()} == want
    assert decontaminate.remove(docs, bench.limit(0)).count() == len(texts) and decontaminate.remove(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_decontamination_removes_spans(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps"
    own = "some words of its own that nobody else would ever think to write down here in full"
    rows = [(1, f"{own}. {item.title()}! {own}", "z"), (2, item, "z"), (3, own, "z"), (4, None, "z"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, match string")
    out = {r.doc_id: r.text for r in decontaminate.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: f"{own}. ! {own}", 3: own, 4: None, 5: ""}


def test_pipeline_stages(spark, tmp_path):
    """The stages on a small corpus: each keeps the columns, and planted cases meet their fate."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(12)
    v = [f"word{k}" for k in range(900)]
    texts = [" ".join(r.choice(v) for _ in range(120)) for _ in range(200)]
    junk = [" ".join(r.choice(v).upper() + "!!" for _ in range(120)) for _ in range(60)]
    item = " ".join(f"test{k}" for k in range(30))
    rows = [(k, t) for k, t in enumerate(texts + junk)] + [(500, texts[0]), (501, texts[1] + " tail"), (502, texts[2][:300] + " " + item + " " + texts[3][:300])]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1 if k < 200 else 0, 0) for k in range(0, 260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns == (columns if k < 4 else [*columns, "shard", "slot"])
        seen[k] = {x.doc_id: x.text for x in docs.collect()}
    assert not set(range(200, 260)) & set(seen[0]) and len(set(range(200)) & set(seen[0])) >= 198
    assert {500, 501}.isdisjoint(seen[1]) and {0, 1} <= set(seen[1])
    assert "test5" not in seen[2][502] and seen[2][502].startswith(texts[2][:200])
    assert 0.8 * len(seen[2]) <= len(seen[3]) <= len(seen[2])
    sizes = Counter(x.shard for x in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and seen[4] == seen[3]


def test_near_copies_are_verified_around_the_bound(spark, monkeypatch):
    """Pairs of a similarity just at 0.8 are linked and pairs just under it are not, small chunks or large."""
    r, rows, want = random.Random(3), [], {}
    for k in range(240):
        n = r.choice([45, 99, 400])
        words = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
        # An end of m other words changes m of n shingles: a similarity of (n - m) / (n + m).
        m = n // 9 + k % 2
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-m] + [f"v{r.randrange(10**6)}" for _ in range(m)]))]
        want[2 * k + 1] = (n - m) / (n + m) >= 0.8
    rows += [(1000, "x " * 2000 + " ".join(f"a{k}" for k in range(60))), (1001, "x " * 2000 + " ".join(f"b{k}" for k in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (512, 2):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        kept = {x.doc_id for x in simhash.keep_one(df).collect()}
        assert {1000, 1001} <= kept and all(2 * k in kept for k in range(240))
        assert not [i for i, same in want.items() if not same and i not in kept]
        assert sum(i not in kept for i, same in want.items() if same) >= 0.96 * sum(want.values())


@pytest.mark.parametrize("wide,one_in", [(4096, 64), (16, 2)])
def test_near_copies_meet_in_vantage_trees(spark, monkeypatch, wide, one_in):
    """All links of a given block radius are found, in one leaf a tree or in many, and a large group sends few links."""
    monkeypatch.setattr(simhash, "WIDE", wide)
    monkeypatch.setattr(simhash, "ONE_IN", one_in)
    rng = np.random.default_rng(5)
    flipped = lambda code, n: code ^ np.packbits(np.isin(np.arange(256), rng.choice(256, n, replace=False)))
    base = rng.integers(0, 256, (150, 32), dtype=np.uint8)
    raw = [*base, *(flipped(b, int(rng.integers(20, 50))) for b in base), *(flipped(base[0], int(rng.integers(1, 12))) for _ in range(300))]
    raw = np.unique(np.stack(raw), axis=0)
    words, a, b = raw.view(">u8").astype(np.uint64), [], []
    looked_at = [m for deal in range(2) for m in simhash.masks(256, 14, 1, deal, 7)]
    for i in range(len(raw)):
        x = words ^ words[i]
        near = np.any([np.bitwise_count(x & m).sum(axis=1) <= 1 for m in looked_at], axis=0) & (np.bitwise_count(x).sum(axis=1) <= 62)
        a += [i] * int(near.sum())
        b += np.nonzero(near)[0].tolist()
    want = simhash.forest(len(raw), np.array(a), np.array(b))
    df = spark.createDataFrame([(x.tobytes(),) for x in raw], "code binary")
    index = {x.tobytes(): k for k, x in enumerate(raw)}
    links = [(index[bytes(r.u)], index[bytes(r.v)]) for r in simhash.code_links(df, 256, 62, 1, blocks=14, deals=2).collect()]
    got = simhash.forest(len(raw), np.array([x for x, _ in links]), np.array([x for _, x in links]))
    assert np.array_equal(got, want) and len(np.unique(want)) < 200
    assert len(links) < (2 if wide == 4096 else 28) * len(raw)


def test_keep_one_bands_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_blocks", None)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*words[: 299 - k], "x"])) for k in range(3)] + [(9, "another text of its own")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9]
