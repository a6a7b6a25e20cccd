"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, language_model, lexical_search, line_templates, mixing, phrases, quality, sentence_pieces, sharding, simhash, token_counts, url_reputation
from .common import LOWER, UPPER, is_held_out, read

LANGUAGES = {"en": 6, "de": 2, "fr": 2, "es": 1}
DOMAINS = {"web": 4, "books": 3, "news": 2, "forum": 1}


def domain_of(source: Column) -> Column:
    """The domain of srcN: five sources each are web, books and news, the rest forum."""
    n = F.try_to_number(F.regexp_extract(source, "([0-9]+)$", 1), F.lit("999999999"))
    return F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "news").when(n.isNotNull(), "forum")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, bits=64, radius=3, block_radius=None, blocks=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"domain": DOMAINS, "lang": LANGUAGES}
    return mixing.mix(read(spark, sf_dir, "documents"), weights, domain_of(F.col("source")), (1, 1), max_epochs=4).drop("text_crc32")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(read(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"), is_held_out("doc_id", 7, 2))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that ends a page's path is the document it was made from, whose labels are the outcome."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    by_doc = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", good.alias("good"))
    doc = F.try_to_number(F.regexp_extract(url_reputation.path_of(F.col("url")), "^/[a-z]+/([0-9]+)", 1), F.lit("999999999999999")).cast("long")
    made = pages.select(url_reputation.host_of(F.col("url")).alias("host"), doc.alias("doc_id"))
    out = url_reputation.judge(pages, made.join(by_doc, "doc_id").select("host", "good"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), is_held_out("doc_id", 5, 0)
    model = quality.fit(docs, read(spark, sf_dir, "labels"), out)
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_pieces.encode(read(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", sentence_pieces.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_mixing, op3_embeddings, op4_token_counts, op5_lm_score, op6_line_dedup, op7_sharding, op8_url_filter, op9_quality, op10_decontaminate, op11_lexical_search, op12_sentence_pieces, op13_phrases)
}

_DOMAIN = "CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'books' WHEN n < 15 THEN 'news' WHEN n IS NOT NULL THEN 'forum' END"


def _share(name: str, parent: list[str], column: str, weights: dict[str, int]) -> str:
    """One level of the budget: children by capacity per weight, those that fill up first."""
    keys, by = ", ".join(["root", *parent]), f"PARTITION BY {', '.join(['root', *parent])}"
    weight = "CASE " + " ".join(f"WHEN {column} = '={k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END" if weights else "1"
    above = f"p{len(parent)}"
    step = f"p{len(parent) + 1}"
    return f"""children_{name} AS (SELECT {keys}, {column}, sum(cap)::BIGINT AS cap FROM tree GROUP BY ALL),
weighed_{name} AS (SELECT children_{name}.*, {weight} AS weight, {above}.got AS budget FROM children_{name} JOIN {above} USING ({keys})),
ordered_{name} AS (SELECT *, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed_{name} WINDOW o AS ({by} ORDER BY cap::DOUBLE / weight, {column})),
marked_{name} AS (SELECT *, cap * rest <= spare * weight AS filled FROM ordered_{name}),
shared_{name} AS (SELECT *, max(CASE WHEN NOT filled THEN spare END) OVER ({by}) AS open_budget,
  CASE WHEN NOT filled THEN (max(CASE WHEN NOT filled THEN spare END) OVER ({by}) * weight) // (max(CASE WHEN NOT filled THEN rest END) OVER ({by})) END AS share FROM marked_{name}),
{step} AS (SELECT {keys}, {column}, (CASE WHEN filled THEN cap ELSE share + CASE WHEN count(share) OVER ({by} ORDER BY cap::DOUBLE / weight, {column} ROWS UNBOUNDED PRECEDING) <= open_budget - sum(share) OVER ({by}) THEN 1 ELSE 0 END END)::BIGINT AS got FROM shared_{name})"""


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
#: Maximal runs of digits, letters and characters beyond ASCII.
_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

ORACLES = {
    "op2_mixing": f"""WITH numbered AS (SELECT doc_id, lang, source, md5(coalesce(text, '')) AS text_md5, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS n,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_tokens FROM documents),
docs AS (SELECT *, {_DOMAIN} AS domain FROM numbered),
keyed AS (SELECT *, 0 AS root, coalesce('=' || domain, '-') AS d, coalesce('=' || lang, '-') AS l, coalesce('=' || source, '-') AS s FROM docs),
leaves AS (SELECT root, d, l, s, sum(n_tokens)::BIGINT AS tokens FROM keyed GROUP BY ALL),
tree AS (SELECT *, tokens * 4 AS cap FROM leaves WHERE tokens > 0),
p0 AS (SELECT 0 AS root, least(sum(cap), sum(tokens))::BIGINT AS got FROM tree),
{_share("d", [], "d", DOMAINS)},
{_share("l", ["d"], "l", LANGUAGES)},
{_share("s", ["d", "l"], "s", {})},
plan AS (SELECT leaves.*, coalesce(got, 0) AS budget FROM leaves LEFT JOIN p3 USING (root, d, l, s)),
cutting AS (SELECT keyed.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part
  FROM keyed JOIN plan USING (root, d, l, s)),
ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY md5('77|' || whole || '|' || coalesce(doc_id::VARCHAR, '') || '|' || text_md5) ROWS UNBOUNDED PRECEDING) AS upto FROM cutting)
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS budget, (whole + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END)::BIGINT AS epochs FROM ranked""",
    "op3_embeddings": """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
least AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)""",
    "op6_line_dedup": """WITH lines AS (SELECT DISTINCT text, regexp_replace(trim(regexp_replace(line, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS t
  FROM (SELECT DISTINCT text, unnest(string_split(text, chr(10))) AS line FROM documents)),
tree AS (SELECT text, t, string_split(t, ' ') AS tokens, len(string_split(t, ' ')) || chr(9) || array_to_string(string_split(t, ' ')[1:2], ' ') AS leaf FROM lines WHERE t <> ''),
each AS (SELECT t, tokens, leaf, count(*) AS n FROM tree GROUP BY ALL),
leaves AS (SELECT leaf FROM tree GROUP BY leaf HAVING count(DISTINCT text) >= 5),
tokens AS (SELECT t, leaf, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM each JOIN leaves USING (leaf)),
constant AS (SELECT leaf, pos, token FROM tokens GROUP BY ALL HAVING sum(n) >= 5),
template AS (SELECT t, string_agg(CASE WHEN constant.token IS NULL THEN '<*>' ELSE tokens.token END, ' ' ORDER BY tokens.pos) AS template
  FROM tokens LEFT JOIN constant ON constant.leaf = tokens.leaf AND constant.pos = tokens.pos AND constant.token = tokens.token
  WHERE n < 5 GROUP BY t HAVING count(*) FILTER (WHERE constant.token IS NOT NULL AND tokens.token <> '<*>') * 5 >= count(*) * 3),
recurring AS (SELECT template FROM template JOIN tree USING (t) GROUP BY template HAVING count(DISTINCT text) >= 5),
dropped AS (SELECT t FROM each WHERE n >= 5 UNION SELECT t FROM template JOIN recurring USING (template)),
each_line AS (SELECT d.doc_id, u.line, u.pos, dropped.t IS NULL AS stays FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u
  LEFT JOIN dropped ON dropped.t = regexp_replace(trim(regexp_replace(u.line, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g')),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_md5 FROM each_line GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, kept_md5 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op7_sharding": """WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, coalesce('=' || source, '-') AS stratum, coalesce(text, '') AS text FROM documents),
sized AS (SELECT doc_id, stratum, (strlen(text) + 1)::BIGINT AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)))::BIGINT AS text_crc32 FROM docs, poly),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('1234|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32 || '|' || size), text_crc32, size) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n), stratum, r) - 1 AS position, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (position * 16) // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (position - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM cut""",
    "op8_url_filter": f"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcome AS (SELECT host, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM p JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
bare AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '{url_reputation.USER}', ''), '{url_reputation.PORT}', '') AS name FROM p),
names AS (SELECT host, name, CASE WHEN regexp_matches(name, '{url_reputation.ADDRESS}') OR regexp_extract(name, '{url_reputation.DOMAIN}', 1) = '' THEN name ELSE regexp_extract(name, '{url_reputation.DOMAIN}', 1) END AS domain,
  CASE WHEN regexp_matches(name, '{url_reputation.ADDRESS}') THEN name ELSE regexp_extract(name, '{url_reputation.SUFFIX}', 1) END AS suffix FROM bare),
h AS (SELECT name, domain, suffix, count(*) AS n, sum(good) AS good FROM outcome JOIN names USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
overall AS (SELECT (coalesce(sum(good), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS prior FROM s),
s1 AS (SELECT s.*, prior FROM s, overall),
s2 AS (SELECT *, (good + prior * k) / (n + k) AS mean, n + k AS weight FROM s1, (SELECT CASE WHEN x > 0 THEN least(greatest(m / x - 1, 1), 1000) ELSE 1000 END AS k FROM (SELECT
  (sum(n * (good::DOUBLE / n - prior) ** 2) - sum(prior * (1 - prior))) / greatest(sum(n) - count(*), 1) AS x, sum(n * prior * (1 - prior)) / greatest(sum(n), 1) AS m FROM s1))),
d1 AS (SELECT d.*, s2.mean AS prior FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT *, (good + prior * k) / (n + k) AS mean, n + k AS weight FROM d1, (SELECT CASE WHEN x > 0 THEN least(greatest(m / x - 1, 1), 1000) ELSE 1000 END AS k FROM (SELECT
  (sum(n * (good::DOUBLE / n - prior) ** 2) - sum(prior * (1 - prior))) / greatest(sum(n) - count(*), 1) AS x, sum(n * prior * (1 - prior)) / greatest(sum(n), 1) AS m FROM d1))),
h1 AS (SELECT h.*, d2.mean AS prior FROM h JOIN d2 USING (domain)),
h2 AS (SELECT *, (good + prior * k) / (n + k) AS mean, n + k AS weight FROM h1, (SELECT CASE WHEN x > 0 THEN least(greatest(m / x - 1, 1), 1000) ELSE 1000 END AS k FROM (SELECT
  (sum(n * (good::DOUBLE / n - prior) ** 2) - sum(prior * (1 - prior))) / greatest(sum(n) - count(*), 1) AS x, sum(n * prior * (1 - prior)) / greatest(sum(n), 1) AS m FROM h1))),
bounds AS (SELECT names.host, coalesce(h2.mean - 1.645 * sqrt(h2.mean * (1 - h2.mean) / (h2.weight + 1)), d2.mean - 1.645 * sqrt(d2.mean * (1 - d2.mean) / (d2.weight + 1)),
  s2.mean - 1.645 * sqrt(s2.mean * (1 - s2.mean) / (s2.weight + 1)), (SELECT prior FROM overall)) AS bound
  FROM names LEFT JOIN h2 USING (name) LEFT JOIN d2 ON d2.domain = names.domain LEFT JOIN s2 ON s2.suffix = names.suffix),
ruled AS (SELECT page_id, p.host, path, bound,
  CASE WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p JOIN bounds USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict FROM ruled""",
    "op11_lexical_search": rf"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, ws, len(ws)::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents) WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM d),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY t, docs),
impact AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))) AS x FROM p JOIN w USING (t) JOIN d USING (r), total),
scored AS (SELECT item_id, r, sum(x)::BIGINT AS score FROM q JOIN impact USING (t) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored JOIN d USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50""",
    "op13_phrases": rf"""WITH pieces AS (SELECT row_number() OVER () AS piece, lang, ws FROM (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\n\x0B\f\r]')) AS p FROM documents)) WHERE len(ws) > 0),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS pos FROM f WHERE k > 1),
scored AS (SELECT cuts.lang, cuts.phrase, a, pos, h.f AS l, t.f AS r, n, (1000 * a * n) // (h.f * t.f) AS score FROM cuts JOIN totals USING (lang)
  JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(ws[1:pos], ' ') JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(ws[pos + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
stay AS (SELECT best.* FROM best WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = best.lang AND f.k > 1 AND f.phrase <> best.phrase AND contains(' ' || f.phrase || ' ', ' ' || best.phrase || ' ') AND 100 * f.f >= 100 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
