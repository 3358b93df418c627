"""The training-data operators on odd rows (nulls, empty and long texts, ties, repeats,
clashing column names, empty tables) and against brute force in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import (bpe, exact_dedup, langid, line_dedup, lm_score, minhash_join, mixing, quality, url_filter,
                          wavelet)
from tabsmith.llm.common import cut, scratch, tokenizer_path

WORDS = [f"w{k}x{k * 7 % 13}" for k in range(160)]
LONG = " ".join(WORDS)
NEAR = " ".join(WORDS[:150] + ["other"] + WORDS[151:])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, _id long, size int, kept int"
ROWS = [(1, LONG, "en", "a"), (2, NEAR, "en", "a"), (3, LONG.replace(" ", "\n", 3), "en", "b"), (4, None, None, None),
        (5, "", "fr", "b"), (6, "  \t\n ", "zz-long", "b"), (7, "one two", "en", "c"), (7, "one two", "en", "c"),
        (8, "One  two", None, "c"), (9, "é " * 3000 + "x", "fr", "b"), (10, "same line here now ok\nsame line here now ok", "en", "a")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0, "t", 1, 2, 3) for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark)).collect()}
    groups = Counter(norm(r[1]) for r in ROWS)
    for i, text, *_ in ROWS:
        first = min(r[0] for r in ROWS if norm(r[1]) == norm(text))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (first, groups[norm(text)], i == first)
    kept = exact_dedup.keep_first(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 7, 8, 9, 10]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_brute_force(spark, k):
    rows = [r for r in ROWS if r[0] != 7] + [(100 + j, " ".join(WORDS[j:j + 140]), "en", "a") for j in range(0, 20, 2)]
    got = {r.doc_id: r for r in minhash_join.near_dedup(frame(spark, rows), k=k).collect()}
    sets = {}
    for i, text, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(s), label[i], label[i] == i) for i, s in sets.items()}
    assert minhash_join.near_dedup(frame(spark, [])).count() == 0


def test_trees_keep_similar_pairs_at_depth(spark):
    """Pairs that agree in 80% of the functions stay together in some node of ten levels in a
    row; functions of a node do not repeat on its path."""
    rng, n = np.random.default_rng(11), 300
    a = rng.integers(0, 1 << 30, (n, 64))
    b = np.where(rng.random((n, 64)) < 0.8, a, rng.integers(0, 1 << 30, (n, 64)))
    sigs = spark.createDataFrame([(2 * k + j, x.tolist()) for k in range(n) for j, x in enumerate((a[k], b[k]))], "id long, sig array<int>")
    rows = sigs.selectExpr("id", "sig", "1 AS n", "0L AS s0", "0L AS s1", "0L AS s2", "0L AS s3", "explode(array(0, 1, 2, 3)) AS tree")
    rows = rows.selectExpr("*", "CAST(tree AS long) AS node", "0L AS used").drop("sig")
    for level in range(10):
        rows = minhash_join._children(rows, sigs)
        together = rows.groupBy(F.expr("id div 2").alias("pair"), "node").count().where("count = 2")
        rows = cut(rows.withColumn("pair", F.expr("id div 2")).join(together.select("pair", "node"), ["pair", "node"], "left_semi").drop("pair"))
        assert rows.where(F.bit_count("used") != level + 1).isEmpty()
    assert rows.selectExpr("id div 2 AS pair").distinct().count() >= n - 2


def test_blocks_find_all_links(spark):
    rng = np.random.default_rng(1)
    sets = {i: np.unique(rng.integers(0, 40, 30)) for i in range(60)}
    rows = spark.createDataFrame([(0, i, len(s)) for i, s in sets.items()], "node long, id long, n int")
    shingles = spark.createDataFrame([(i, s.tolist()) for i, s in sets.items()], "doc_id long, shingles array<long>")
    links = {(r.a, r.b) for r in minhash_join._block_links(rows, shingles, 1, 2).collect()}
    near = {(a, b) for a in sets for b in sets if a < b and
            2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))}
    assert links <= near

    def classes(pairs):
        label = {i: i for i in sets}
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label
    assert classes(links) == classes(near)


def test_mixing(spark):
    got = mixing.mix(frame(spark)).collect()
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(words(text))
    assert len(got) == len(ROWS)
    assert math.isclose(sum({r.source: r.target for r in got}.values()), 1.5 * sum(sizes.values()))
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark)).collect()))
    assert mixing.mixed_documents(frame(spark)).columns == frame(spark).columns
    assert mixing.mix(frame(spark, [])).count() == 0


def test_url_filter(spark):
    urls = [(1, "http://A.example.net/en/x?q"), (2, "https://b.net/"), (3, "x.net/en"), (4, None), (5, "http://casino.com/a"),
            (6, "http://example.com/de/1#t"), (7, "ftp://q.org/fr/"), (7, "ftp://q.org/fr/"), (8, "http://net"), (9, "http://notnet/")]
    rules = url_filter.rule_table(spark, [url_filter.listed_rule(*r) for r in (
        ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))]
        + [url_filter.word_rule(w) for w in url_filter.SPAM_WORDS])
    pages = spark.createDataFrame([(*u, "host", "rule") for u in urls], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("b.net", "/", "net/", "block"),
                   3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("casino.com", "/a", None, "block"),
                   6: ("example.com", "/de/1", "example.com/de/", "block"), 7: ("q.org", "/fr/", "org/fr/", "allow"),
                   8: ("net", "", None, "allow"), 9: ("notnet", "/", None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_quality_counts(spark):
    rows = ROWS + [(20, "a b c " * 40, "en", "a"), (21, "x #y\n\nx #y\n a\na", "en", "a")]
    for r in quality.quality(frame(spark, rows)).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        inside = {j for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality(frame(spark, [])).count() == 0


def test_line_dedup_equals_brute_force(spark):
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine extra"
    rows = ROWS + [(30, a + "\nunique words only", "en", "a"), (31, b + "\n" + a + "\n\n", "en", "a"), (32, "ten " + a, "en", "b")]
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    lines = sorted({(i, k, frozenset(x.lower() for x in words(line))) for i, t, *_ in rows
                    for k, line in enumerate((t or "").split("\n")) if words(line)}, key=lambda x: x[:2])
    want = {i: [] for i, *_ in rows}
    for n, (i, k, s) in enumerate(lines):
        if any(5 * len(s & x) >= 4 * len(s | x) for _, _, x in lines[:n]):
            want[i].append(k)
    assert got == want
    texts = {r.doc_id: r.text for r in line_dedup.without_lines(frame(spark, rows)).collect()}
    assert texts[10] == "same line here now ok" and texts[4] is None
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_of_long_lines(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        line = [f"t{x}" for x in rng.integers(0, 400, rng.integers(3, 150))]
        rows.append((2 * i, " ".join(line)))
        for j in rng.integers(0, len(line), rng.integers(0, 1 + len(line) // 6)):
            line[j] = f"n{i}x{j}"
        rows.append((2 * i + 1, " ".join(line)))
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(t.split()) for _, t in rows]
    assert got == {k: int(any(5 * len(s & x) >= 4 * len(s | x) for x in sets[:k])) for k, s in enumerate(sets)}
    assert 0 < sum(got.values()) < 60


ODD = ["Hello  WORLD's café", "<|endoftext|> a", "ｆｕｌｌ İ ẞ\x1c!", "", None, "a" * 5000, "don't\x85stop　now"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in bpe.digest(docs, bpe.read_spec(path)).collect():
        ids = lib.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_wavelet_matrix_and_shards(spark):
    from tokenizers import Tokenizer
    a = np.random.default_rng(0).integers(0, 30, 3000)
    m = wavelet.WaveletMatrix.build(a, 5)
    assert (m.sequence() == a).all() and all(m.access(k) == a[k] for k in range(0, 3000, 211))
    for v in (0, 7, 29):
        places = np.flatnonzero(a == v)
        assert m.count(v) == len(places) and m.rank(v, 1000) == (a[:1000] == v).sum()
        assert [m.select(v, k) for k in range(len(places))] == places.tolist()
    path = tokenizer_path("byte_bpe_50k.json")
    lib, out, start = Tokenizer.from_file(path), scratch(spark, "test-shards"), 0
    docs = spark.createDataFrame(list(enumerate(ODD))[::-1], "doc_id long, text string")
    with open(path, "rb") as f:
        wavelet.write_shards(docs, out, f.read(), shard_bytes=2000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.checksums(spark, out).collect()}
    for i, text in enumerate(ODD):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language_id(spark):
    text = {"en": "the house and the garden of this town were in that country with many people ",
            "fr": "la maison et le jardin de cette ville dans le pays avec des gens ",
            "de": "das haus und der garten dieser stadt in dem land mit vielen leuten ",
            "es": "la casa y el jardín de esta ciudad en el país con mucha gente "}
    rows = [(k, text[c] * 4, c, "s") for k, c in enumerate(text)] + [(10, None, None, None), (11, "", "fr", "s"), (12, "漢字 " * 90, None, "t")]
    docs = frame(spark, rows)
    e = langid.document_evidence(docs)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", *[c.alias(n) for n, c in e.items()]), model, ["doc_id"]).collect()}
    assert [got[k].language for k in range(4)] == list(text) and all(got[k].accepted for k in range(4))
    assert len(got) == len(rows) and not got[12].accepted
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {0, 1, 2, 3} <= {r.doc_id for r in kept.collect()}


def test_lm_scoring(spark):
    rows = [(k, LONG if k % 3 else NEAR, "en", "a") for k in range(12)] + [(50, None, None, None), (51, "Unseen zzz", "en", "a")]
    got = {r.doc_id: r for r in lm_score.score(frame(spark, rows)).collect()}
    toks = {i: [x.lower() for x in words(t)] + ["\n"] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c = Counter(w for i in toks if not held[i] for w in toks[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(toks[i]), sum(c[w] > 0 for w in toks[i]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_lm_counts_are_whole(spark):
    """One row for each (prefix, byte), with the counts of plain Python; learning sees every occurrence."""
    rng = np.random.default_rng(5)
    some = ["".join("abcdefé"[x] for x in rng.integers(0, 7, rng.integers(1, 9))) for _ in range(300)]
    rows = [(k, " ".join(some[j] for j in rng.integers(0, 300, 40)), k % 5 == 1) for k in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    words_ = lm_score.vocabulary(docs)
    table = lm_score.inputs(words_)
    c, seen = Counter(), set()
    for _, text, held in rows:
        for w in lm_score.tokens(text):
            seen.add(w)
            c[w] += not held
    steps, want = {(w[:j], (w + b" ")[j]) for w in seen for j in range(len(w) + 1)}, Counter()
    nodes = [{} for _ in range(4)]
    for w in seen:
        for j, byte in enumerate(w + b" "):
            for node, context in zip(nodes, (w[max(j - 1, 0):j], w[max(j - 2, 0):j], w[max(j - 3, 0):j], w[:j])):
                for k in range(8):
                    node.setdefault((context, k, byte >> (8 - k)), [0, 0])[byte >> (7 - k) & 1] += c[w]
    for prefix, byte in steps:
        contexts = [prefix[-1:], prefix[-2:], prefix[-3:], prefix]
        path = [nodes[x][context, k, byte >> (8 - k)] for x, context in enumerate(contexts) for k in range(8)]
        want[byte, min(len(prefix), 3), np.array(path, "<f4").tobytes()] += 1
    got = table.collect()
    assert Counter((r.byte, r.place, bytes(r.f)) for r in got) == want and len(got) == len(steps)


def test_lm_learns_from_every_training_document(spark):
    rows = [(k, f"w{k} the {k * k} of", k % 5 == 1) for k in range(600)]
    words_ = lm_score.vocabulary(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    table = lm_score.inputs(words_)
    c = Counter(w for _, text, held in rows for w in lm_score.tokens(text) if not held)
    seen = {w for _, text, _ in rows for w in lm_score.tokens(text)}
    weights, hits, total = lm_score.learn(table)
    assert total.sum() == 8 * sum(n * (len(w) + 1) for w, n in c.items())
    assert hits.sum() == sum(n * sum(x.bit_count() for x in w + b" ") for w, n in c.items())
    scores = lm_score.edge_scores(table, weights, lm_score.refined(hits, total)).collect()
    assert len(scores) == len({(w[:j], (w + b" ")[j]) for w in seen for j in range(len(w) + 1)}) and all(r.s < 0 for r in scores)


def test_lm_score_depends_on_the_order_of_words(spark):
    rows = [(k, "one two three four five six seven") for k in range(40)] + [(100, "six one four two seven three five"), (101, "a  b"), (102, None)]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].score > got[100].score + 1 and len({r.score for i, r in got.items() if i < 40}) == 1
    for i, text in rows:
        n_bytes = sum(len(w) + 1 for w in lm_score.tokens(text or ""))
        assert math.isclose(got[i].bits_per_byte, -got[i].score / math.log10(2) / n_bytes, rel_tol=1e-12)


def test_lm_chunks_agree_with_one(spark, monkeypatch):
    """The words of few chunks or of many, pairs in few rows or in many: same edges, same scores."""
    rng = np.random.default_rng(9)
    some = ["".join("abcdefé"[x] for x in rng.integers(0, 7, rng.integers(1, 9))) for _ in range(300)] + ["\x01", "a\x1b", "x" * 70]
    rows = [(k, " ".join(some[j] for j in rng.integers(0, 303, 40))) for k in range(150)] + [(None, "a b"), (7, None), (7, "abc abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "doc_id % 5 = 1 AS held_out").na.fill(False)
    found = []
    for chunk, flush, pairs, often in ((20_000, 2_000_000, 100_000, 1 << 40), (7, 500, 40, 30)):
        for name, n in (("CHUNK", chunk), ("FLUSH", flush), ("PAIRS", pairs), ("BUCKET", flush), ("HOT", pairs), ("FREQUENT", often)):
            monkeypatch.setattr(lm_score, name, n)
        edges = lm_score.inputs(lm_score.vocabulary(held)).collect()
        got = lm_score.score(docs).collect()
        found.append((Counter((r.parent, r.place, r.byte, r.c, bytes(r.f)) for r in edges),
                      sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in got)))
    assert found[0] == found[1] and len(found[0][1]) == len(rows)
    assert lm_score.score(docs.limit(0)).count() == 0


def test_lm_pair_scores_are_those_of_each_bit(spark):
    """The score of a text, bit by bit in plain Python, from the learned weights."""
    rng = np.random.default_rng(3)
    some = ["".join("abc"[x] for x in rng.integers(0, 3, rng.integers(1, 5))) for _ in range(40)]
    rows = [(k, " ".join(some[j] for j in rng.integers(0, 40, 12)), k % 5 == 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    known = lm_score.Vocabulary(lm_score.vocabulary(docs))
    weights, hits, worth = lm_score.learn(known.table, known.edges())
    first = weights, lm_score.refined(hits, worth)
    frequent = lm_score.Frequent(docs, lm_score.vocabulary(docs))
    table = lm_score.pair_paths(lm_score.pairs(docs, 3, frequent), known, frequent, 3)
    w2, hits, worth = lm_score.learn_pairs(table, known, *first)
    train = Counter((b, w) for _, text, held in rows if not held for b, w in zip([b"\n"] + lm_score.tokens(text), lm_score.tokens(text)))
    assert worth.sum() == 8 * sum(n * (len(w) + 1) for (_, w), n in train.items())
    refine = lm_score.refined(hits, worth)
    got = {r.doc_id: r for r in lm_score.text_sums(table, known, first, (w2, refine)).collect()}
    words_ = Counter()
    for (_, w), n in train.items():
        words_[w] += n

    def nodes(counts):
        out = Counter()
        for w, n in counts:
            for j, byte in enumerate(w + b" "):
                for k in range(8):
                    out[w[:j], k, byte >> (7 - k)] += n
        return out

    near = Counter()
    for w, n in words_.items():
        for j, byte in enumerate(w + b" "):
            for m in (1, 2, 3):
                for k in range(8):
                    near[m, w[max(j - m, 0):j], k, byte >> (7 - k)] += n
    whole, after = nodes(words_.items()), {b: nodes((w, n) for (x, w), n in train.items() if x == b) for b in {b for b, _ in train}}

    def mixed(s, gate, table):
        s = max(min(s, 12), -12)
        return 0.5 / (1 + math.exp(-s)) + 0.5 * table[gate, round((s + 12) * 32 / 24)]

    def sure(n):
        return (n > 0) + (n > 2) + (n > 12)

    for i, text, _ in rows[:10]:
        total, b = 0.0, b"\n"
        for w in lm_score.tokens(text):
            for j, byte in enumerate(w + b" "):
                for k in range(8):
                    bit, zero = byte >> (7 - k) & 1, byte >> (7 - k) & ~1
                    n = [[near[m, w[max(j - m, 0):j], k, zero | x] for x in (0, 1)] for m in (1, 2, 3)] + [[whole[w[:j], k, zero | x] for x in (0, 1)]]
                    x = [math.log((n1 + .4) / (n0 + .4)) for n0, n1 in n] + [1]
                    gate = min(j, 3) * 4 + sure(sum(n[3]))
                    p = mixed(float(np.dot(first[0][gate], x)), gate, first[1])
                    n0, n1 = [after.get(b, Counter())[w[:j], k, zero | x] for x in (0, 1)]
                    gate = min(j, 3) * 4 + sure(n0 + n1)
                    p = mixed(float(np.dot(w2[gate], [math.log(p / (1 - p)), math.log((n1 + .4) / (n0 + .4)), 1])), gate, refine)
                    total += math.log10(p if bit else 1 - p)
            b = w
        assert math.isclose(got[i].score, total, rel_tol=2e-3), (got[i].score, total)
