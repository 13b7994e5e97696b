"""One query per operator, over whole tables, and the DuckDB SQL of those that
SQL can express. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import ann, divergence, htmltext, langid, mixing, packing, phrases, secrets, simhash, substring, topk, toxicity, warc
from scriptorium.llm.common import held_out, table_path, word_count

TOP_K = 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def asks(vec_id: Column) -> Column:
    """The stated query set of the two searches."""
    return vec_id % 20 == 0


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back as chunk rows."""
    chunks = warc.roundtrip(_table(spark, sf_dir, "pages"), table_path(spark, "warc"))
    return warc.digests(chunks).withColumnRenamed("source_id", "page_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents (4-word shingles, 4 bits)."""
    g = simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return g.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target words."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that windows repeat from documents with smaller ids, removed."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 20 best integer scores of every 20th vector."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), asks(F.col("vec_id")), TOP_K)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 2048 words; copies of one text are a
    duplicate cluster."""
    return packing.pack(_table(spark, sf_dir, "documents"), word_count(F.col("text")), F.md5(F.col("text")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    docs = _table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs.select("doc_id", "text"), secrets.fit(docs)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out(F.col("doc_id")))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors found of every 20th vector."""
    return ann.approximate_top_k(_table(spark, sf_dir, "embeddings"), asks(F.col("vec_id")), TOP_K)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows not held out."""
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return htmltext.extract_text(pages.select("page_id", "url", "html"), htmltext.fit(pages)).select(
        "page_id", "url", "text", "n_chars")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language, from all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources, from all documents."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_mixing, op4_substring, op5_topk, op6_packing,
                                   op7_secrets, op8_langid, op9_ann, op10_toxicity, op11_html, op12_phrases, op13_divergence)}

ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op4_substring": r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::varchar[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
v AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM v),
f AS (SELECT k, min(doc_id) AS lo FROM k GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN f USING (k) WHERE doc_id > lo),
r AS (SELECT doc_id, count(*) AS n, list(j) AS gone FROM g GROUP BY 1),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM x LEFT JOIN g USING (doc_id, j)
  WHERE g.doc_id IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    # the given pages hold their main text in one article element of headings and paragraphs
    "op11_html": r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS body FROM pages),
b AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<br>', ' ', 'g'), '<[^<>]*>') AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
  replace(regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))),
  lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::bigint AS n_chars FROM t""",
    "op12_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
g1 AS (SELECT lang, unnest(w) AS phrase FROM p),
g2 AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM p),
g3 AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM p),
t AS (SELECT lang, count(*) AS n FROM g1 GROUP BY 1),
f AS (SELECT lang, phrase, 1 AS words, count(*) AS f FROM g1 GROUP BY 1, 2
  UNION ALL SELECT lang, phrase, 2, count(*) FROM g2 GROUP BY 1, 2 HAVING count(*) >= 10
  UNION ALL SELECT lang, phrase, 3, count(*) FROM g3 GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE words = 3
  UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE words = 3) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::bigint AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total)::bigint AS ln FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::hugeint AS gn
  FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.gn + 2 * v.v))::hugeint AS p,
  (1 + (1000000000::hugeint * (k.total + 2)) // (v.ln::hugeint + 2 * v.v))::hugeint AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pa AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::bigint AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pr ON pr.lang = x.lang AND pr.source = x.source AND pr.item = y.source),
te AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::bigint AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank
  FROM (SELECT * FROM pa UNION ALL SELECT * FROM te))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
