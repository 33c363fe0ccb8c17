"""Registered queries of this subpackage: the numbered operators with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import alignment, decontaminate, html_extract, mixing, pii, quality, sentence_pieces, simhash, suffix_dedup, token_counts, token_store, url_filter, whitening
from newsloom.tables import read_table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"))


#: The rules of the URL query.  Its list: the canonical URLs of pages on hosts with one of these labels, and those under
#: which pages were fetched from several addresses.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
SPAM_LABELS = ("spam-farm", "free-bets", "cheap-pills", "casino-win", "ads-track", "adult-x")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    spam = F.arrays_overlap(F.split(url_filter.host_and_path(F.col("url"))[0], r"\."), F.array(*map(F.lit, SPAM_LABELS)))
    forms = pages.where("instr(url, '://') > 0").groupBy(url_filter.canonical(F.col("url")).alias("key")).agg(F.max(spam).alias("spam"), (F.min("url") < F.max("url")).alias("several"))
    listed = forms.where("spam OR several").select("key")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge_urls(pages, rules, listed)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = token_store.write_ids(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_store.read_ids(spark, folder, shards)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_rules(docs, read_table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode_texts(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), decoded=True, packed=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "as_library")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_pii_pseudonyms, op3_url_filter, op4_token_ids, op5_quality_rules, op6_simhash, op7_decontaminate, op8_suffix_dedup, op9_mix_sources, op10_html_text, op11_sentencepiece, op12_whitening, op13_alignment)}

_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win FROM dp),
hit AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
marked AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP3 = r"""
WITH r(rule, v) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
a AS (SELECT page_id, url, row_number() OVER () AS k, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS args FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\.[a-z]+$', '/'), '/+$', '') || CASE WHEN args <> '' THEN '?' || args ELSE '' END AS form FROM q),
l AS (SELECT form FROM c WHERE host <> '' OR instr(url, '://') > 0 GROUP BY form HAVING count(DISTINCT url) > 1 OR bool_or(len(list_intersect(string_split(host, '.'), ['spam-farm', 'free-bets', 'cheap-pills', 'casino-win', 'ads-track', 'adult-x'])) > 0)),
f AS (SELECT k, rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, rule) AS n FROM p JOIN r
      ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND host <> '' AND starts_with(path, substr(rule, instr(rule, '/'))))
SELECT page_id, host, path, f.rule, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM (SELECT *, host <> '' AND form IN (SELECT form FROM l) AS listed FROM c) c LEFT JOIN f ON f.k = c.k AND f.n = 1
"""

#: Every window of 100 bytes, numbered among its equals; fine for small tables.
_OP8 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, b[p : p + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM r)),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS z FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM runs UNION ALL SELECT doc_id, coalesce(max(z), 0) + 1, 1000000000 FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[f : least(t, n)]), '' ORDER BY f) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id) USING (doc_id)
"""

ORACLE_SQL = {"op3_url_filter": _OP3, "op7_decontaminate": _OP7, "op8_suffix_dedup": _OP8}
