"""The registered queries of this package and their SQL.  Each applies one operator,
with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import (align, bpe, decontaminate, exact_dedup, langid, line_dedup, lm_score, minhash_join, mixing,
                          quality, ranked_search, url_filter, wavelet)
from tabsmith.llm.common import scratch, table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op4_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # texts alone in their group carry no hash; an id with several of them comes once here, and gets a row for each below
    out = exact_dedup.exact_dedup(docs).dropDuplicates(["doc_id", "sha256"])
    digest = docs.select(F.col("doc_id").alias("_id"),
                         exact_dedup.full_hash("text").alias("text_sha256")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.coalesce(F.col("sha256") == F.col("text_sha256"), F.lit(True))
    return out.join(digest, same).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


LISTED_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_SPAM_SQL = ", ".join(f"('{w}')" for w in url_filter.SPAM_WORDS)


@register("op5_url_filter", rf"""
WITH rules(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net',
       '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
words(word) AS (VALUES {_SPAM_SQL}),
cuts AS (SELECT page_id, row_number() OVER () AS rid,
       CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, rid,
       coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '') AS host,
       coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cuts),
fit AS (SELECT p.rid, r.rule, r.verdict, row_number() OVER (PARTITION BY p.rid ORDER BY length(r.rule) DESC, r.rule) AS k
       FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
own AS (SELECT p.rid, min(word) AS word FROM p JOIN words
       ON list_contains(regexp_split_to_array(lower(p.host || p.path), '[^0-9a-z]+'), word) GROUP BY p.rid)
SELECT p.page_id, p.host, p.path, f.rule, CASE WHEN f.rule IS NULL THEN o.word END AS pattern_rule,
       coalesce(f.verdict, CASE WHEN o.word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit f ON f.rid = p.rid AND f.k = 1 LEFT JOIN own o ON o.rid = p.rid
""")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, [url_filter.listed_rule(*r) for r in LISTED_RULES]
                                  + [url_filter.word_rule(w) for w in url_filter.SPAM_WORDS])
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@register("op8_mixing", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h,
       coalesce('s' || source, 'n') AS k FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
r AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w,
       2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
       coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_open
       FROM r WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * w_open <= (total - cap_before) * w AS filled FROM o),
t AS (SELECT k, source_size, CASE WHEN filled THEN cap ELSE w * (total - (SELECT coalesce(sum(cap), 0) FROM f WHERE filled))
       / (SELECT nullif(sum(w), 0) FROM f WHERE NOT filled) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS INTEGER) ELSE 0 END AS epochs FROM t),
m AS (SELECT *, target - epochs * source_size AS rem FROM e),
g AS (SELECT k, h, sum(size) AS words FROM d GROUP BY k, h),
c AS (SELECT g.*, sum(words) OVER (PARTITION BY k ORDER BY h) AS upto FROM g),
x AS (SELECT c.k, h + CASE WHEN upto - rem < rem - (upto - words) THEN 1 ELSE 0 END AS threshold
       FROM c JOIN m USING (k) WHERE upto - words <= rem AND rem < upto),
y AS (SELECT d.*, m.source_size, m.target, CASE WHEN m.source_size > 0 THEN m.epochs +
       CASE WHEN d.h < coalesce(x.threshold, 0) THEN 1 ELSE 0 END ELSE 0 END AS copies
       FROM d JOIN m USING (k) LEFT JOIN x USING (k))
SELECT doc_id, size, source_size, target, CAST(copies AS INTEGER) AS copies, CAST(copies * size AS BIGINT) AS taken FROM y
""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@register("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = bpe.read_spec(tokenizer_path("word_bpe_49k.json"))
    return bpe.digest(table(spark, sf_dir, "documents"), spec)


@register("op7_token_ids")
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json"), "rb") as f:
        spec = f.read()
    path = scratch(spark, "token-ids")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, spec, end_id=2)
    return wavelet.checksums(spark, path)


@register("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_dedup(table(spark, sf_dir, "documents"), k=2)


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page; the text model comes from all labelled documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = docs.select("doc_id", none.alias("page_id"), *[c.alias(n) for n, c in langid.document_evidence(docs).items()])
    rows = rows.unionByName(pages.select(none.alias("doc_id"), "page_id",
                                         *[c.alias(n) for n, c in langid.page_evidence(pages).items()]))
    return langid.identify(rows, langid.train(docs), ["doc_id", "page_id"])


@register("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@register("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@register("op13_decontamination", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM s),
p AS (SELECT d.rid, t.k, unnest(range(1, len(d.w) - t.k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM n) t ON len(d.w) >= t.k),
q AS (SELECT p.rid, p.k, p.i, array_to_string(d.w[p.i:p.i + p.k - 1], ' ') AS g FROM p JOIN d USING (rid)),
m AS (SELECT q.rid, q.k, q.i, n.item_id FROM q JOIN n USING (k, g)),
h AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM m) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "binary") AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN o USING (rid)
""")
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    names = F.array_join(F.array_sort(F.expr("transform(items, i -> CAST(i AS string))")), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@register("op11_ranked_search", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
q AS (SELECT iid, unnest(w) AS term FROM b),
t AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
       FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g),
m AS (SELECT rid, doc_id, 50 + (50 * CAST(len(w) AS BIGINT) * n_docs) // n_words AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT q.iid, t.rid, CAST(sum(v.weight * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score
       FROM q JOIN t USING (term) JOIN v USING (term) JOIN m ON m.rid = t.rid GROUP BY q.iid, t.rid),
r AS (SELECT s.*, doc_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
       FROM s JOIN m USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN b USING (iid) WHERE rank <= 50
""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pair = align.load(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return align.link_counts(align.align(table(spark, sf_dir, "documents"), pair))
