"""What the operators do once, seen in their plans and counters; results are compared elsewhere."""

import os

from tabsmith.llm import bpe, exact_dedup, line_dedup, lm_score, minhash_join, quality, url_filter, wavelet
from tabsmith.llm.common import cut, scratch, tokenizer_path


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _joins_shuffled(spark, make) -> str:
    """The plan where no table is known to be small."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return _plan(make())
    finally:
        spark.conf.set(name, before)


def test_quality_evaluates_each_array_once(spark):
    docs = spark.createDataFrame([(1, "a b c a b c", "en"), (2, None, None)], "doc_id long, text string, lang string")
    plan = _plan(quality.base_counts(docs, "doc_id", "text", "lang"))
    assert plan.count("sort_array(") == 1
    assert plan.count("xxhash64(lambda") == 3  # words, pairs, triples
    rows = {r["doc_id"]: (r["n_words"], r["n_dup_lines"], r["n_repeat_words"])
            for r in quality.base_counts(docs, "doc_id", "text", "lang").collect()}
    assert rows == {1: (6, 0, 6), 2: (0, 0, 0)}


def test_ids_of_shards_are_not_shuffled(spark):
    path = scratch(spark, "cost-shards")
    with open(tokenizer_path("byte_bpe_50k.json"), "rb") as f:
        spec = f.read()
    docs = spark.createDataFrame([(k, f"text {k} of some") for k in range(20)], "doc_id long, text string")
    wavelet.write_shards(docs, path, spec, shard_bytes=100)
    plan = _joins_shuffled(spark, lambda: wavelet.read_documents(spark, path))
    assert "SortMergeJoin" not in plan.split("MapInArrow")[0].split("BroadcastExchange")[0]
    assert sorted(r[0] for r in wavelet.checksums(spark, path).select("doc_id").collect()) == list(range(20))


def test_exact_dedup_shuffles_texts_once(spark):
    docs = spark.createDataFrame([(1, "a  b", 1), (2, "a b", 2), (None, "a b", 3), (None, "x", 4), (None, "x ", 5), (3, "c", 6),
                                  (3, "c", 6), (4, None, 7), (5, "", 8)], "doc_id long, text string, extra int")
    plan = _joins_shuffled(spark, lambda: exact_dedup.keep_first(docs))
    texts = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_sha#" in x]
    assert len(texts) == 1, texts
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(kept.select("doc_id", "extra").collect(), key=lambda r: r["extra"]) == [
        (1, 1), (None, 4), (None, 5), (3, 6), (4, 7)]


def test_frequent_words_stay_in_the_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 64)
    m = bpe.BpeModel(bpe.read_spec(tokenizer_path("word_bpe_49k.json")))
    common, asked, encode_word = ["house", "river", "stone"], [], m.encode_word

    def counted(word):
        asked.append(word)
        return encode_word(word)

    monkeypatch.setattr(m, "encode_word", counted)
    texts = [" ".join(common + [f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}q{chr(97 + k // 676)}"] * 2) for k in range(400)]
    for t in texts:
        m.encode(t)
    assert sum(any(w.startswith(c[:-1]) for c in common) for w in asked) == 3
    assert len(m.pieces.new) + len(m.pieces.old) <= 64
    fresh = bpe.BpeModel(bpe.read_spec(tokenizer_path("word_bpe_49k.json")))
    assert [m.encode(t) for t in texts] == [fresh.encode(t) for t in texts]


def test_quick_tests_of_white_space_agree_with_the_patterns():
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    for c in spaces + ["a", "\x00", "\u200b"]:
        for text in (f"x{c} y", f"x {c}y", f"{c} ", c, f"é{c} y"):
            assert wavelet.odd_space(text) == bool(wavelet.ODD_SPACE.search(text)), (c, text)
        for n in (998, 999, 1000, 1001, 1250):
            for lead in (0, 1, 249, 250, 251, 733):
                text = "b" * lead + c * (n // 2) + " " * (n - n // 2) + "b" * (lead % 7)
                assert wavelet.long_space(text) == bool(wavelet.LONG_SPACE.search(text)), (c, n, lead)


def test_near_copies_of_a_line_are_not_paired(spark, monkeypatch):
    pairs = []

    def counted(df):
        out = cut(df)
        if set(df.columns) == {"a", "b"}:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:i % 50 + 5] + [f"own{i}"] + base[i % 50 + 6:])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.match_id, r.match_line) for r in line_dedup.matches(docs).collect()}
    assert got == {i: (0, 0) for i in range(1, 200)}
    assert sum(pairs) < 10 * len(rows)


def test_near_dedup_shuffles_no_texts(spark, monkeypatch):
    plans, sets = [], minhash_join._sets

    def seen(docs, k):
        plans.append(_joins_shuffled(spark, lambda: docs))
        return sets(docs, k)

    monkeypatch.setattr(minhash_join, "_sets", seen)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(words[i % 10 * 2:] + [f"own{i // 10}"])) for i in range(40)] + [(None, "w1 w2"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_join.near_dedup(docs, k=1).collect()}
    shingles = {i: set(t.split()) for i, t in rows if i is not None and t}
    label = {i: i for i in shingles}
    for _ in shingles:
        for a in shingles:
            for b in shingles:
                if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                    label[a] = min(label[a], label[b])
    assert got == {**label, None: None, 50: 50}
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)


def test_tokens_of_urls_are_not_broadcast(spark, monkeypatch):
    urls = spark.range(5000).selectExpr("id AS page_id", "concat('http://a', id % 7, '.example.net/en/casino/page-', id) AS url")
    rules = url_filter.rule_table(spark, [url_filter.listed_rule("net/", "block"), url_filter.listed_rule("example.net/en/", "allow")]
                                  + [url_filter.word_rule(w) for w in url_filter.SPAM_WORDS])
    found = []
    for most in (url_filter.FEW_RULES, 1):  # the rules travel, or both sides are shuffled
        monkeypatch.setattr(url_filter, "FEW_RULES", most)
        out = url_filter.judge_urls(urls, rules)
        joins = [x for x in _plan(out).splitlines() if "Join [_token#" in x and "Inner" in x]
        assert len(joins) == 1 and ("BuildRight" in joins[0] or "SortMergeJoin" in joins[0]), joins
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] and len(found[0]) == 5000


def test_lm_scoring_writes_no_row_for_each_bit_or_edge(spark):
    def written() -> int:
        top = spark.sparkContext.getCheckpointDir().replace("file:", "", 1)
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)

    docs, before = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), written()
    assert lm_score.score(docs).count() == docs.count()
    text = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert written() - before < 8 * text
