"""Ranked search, decontamination and token alignment against brute force in plain Python,
on odd rows: null ids and texts, repeated rows, ties, long texts, clashing columns, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabsmith.llm import align, decontaminate, ranked_search
from tabsmith.llm.common import scratch, tokenizer_path
from tabsmith.llm.words import split_words

DOCS = "doc_id long, text string, term string, n int, block int, item int, rank int, score string"
ITEMS = "item_id long, text string, doc_id long, window string, number int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)] + ["Été", "日本", "x-y"]
    out = [(k, " ".join(rng.choice(vocab[:rng.choice([8, 30, 63])]) for _ in range(rng.choice([3, 12, 40, 300])))) for k in range(120)]
    out += [(200, None), (201, ""), (202, " ,.;\n"), (203, out[3][1]), (203, out[4][1]), (5, out[5][1]), (None, out[6][1]),
            (204, "solo " * 5000 + " ".join(f"w{k}" for k in range(12))), (205, "W1,w2\tw3"), (206, "a" * 50_000)]
    return out


def bench(docs):
    rng = random.Random(6)
    found = [words(t) for _, t in docs if t and len(words(t)) > 20]
    out = [(k, " ".join(found[k][2:2 + n])) for k, n in enumerate([15, 10, 11, 3, 1, 18])]
    out += [(20, None), (21, "!?"), (22, "solo solo solo"), (23, "never seen words here"), (3, "w1 w2 w3"), (3, "w1 w2 w3"), (None, "w4 w5")]
    return out + [(30 + k, " ".join(rng.sample([f"w{j}" for j in range(60)], 6))) for k in range(4)]


def frames(spark, docs, items):
    return (spark.createDataFrame([(*r, "t", 1, 2, 3, 4, "s") for r in docs], DOCS),
            spark.createDataFrame([(*r, 7, "w", 8) for r in items], ITEMS))


def test_split_words_equals_the_pattern():
    import pyarrow as pa
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "Z", "é", "日", " ", "-", "\n", "\x00", "9", "\x7f", ""]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for part in (pa.array(texts), pa.array(texts).slice(7, 1000), pa.array(["", ""]), pa.array([], pa.string())):
        distinct, codes, upto = split_words(part)
        got = [distinct[int(c)].as_py() for c in codes]
        assert [got[i:j] for i, j in zip(upto, upto[1:])] == [words(t) for t in part.to_pylist()]


def test_ranked_search_equals_brute_force(spark):
    docs = corpus()
    items = bench(docs)
    rows = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_words = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    want = []
    for item, text in items:
        scored = []
        for i, c in rows:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(words(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        want += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:20], 1)]
    d, b = frames(spark, docs, items)
    got = [tuple(r) for r in ranked_search.search(d, b, top=20).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_bounds_hold_and_leave_out_documents(spark):
    """Sums over signatures never fall below scores, and queries in several blocks give the same rows."""
    docs = corpus()
    d, b = frames(spark, docs, bench(docs))
    whole = sorted(map(str, ranked_search.search(d, b, top=5).collect()))
    old = ranked_search.QUERY_ROWS
    try:
        ranked_search.QUERY_ROWS = 3
        assert sorted(map(str, ranked_search.search(d, b, top=5).collect())) == whole
    finally:
        ranked_search.QUERY_ROWS = old


def test_search_of_empty_tables(spark):
    docs, items = frames(spark, corpus(), bench(corpus()))
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    got = decontaminate.decontaminate(docs, items.limit(0)).collect()
    assert len(got) == len(corpus()) and not any(r.spans or r.items for r in got)


def item_windows(items, size=10):
    out = set()
    for item, text in items:
        w = words(text)
        out |= {(item, tuple(w[k:k + size])) for k in range(max(len(w) - size, 0) + 1) if w}
    return out


def test_decontamination_equals_brute_force(spark):
    docs = corpus()
    items = bench(docs)
    wanted = item_windows(items)
    want = []
    for i, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item, window in wanted:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k:k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    ids |= {item} - {None}
        want.append((i, len(w), sorted(hit), sorted(ids)))
    d, b = frames(spark, docs, items)
    got = [(r.doc_id, r.n_words, [k for s in r.spans for k in range(s.begin, s.end)], r.items) for r in decontaminate.decontaminate(d, b).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_phrase_and_proximity_matches(spark):
    docs = [(1, "x a b c y c b a z"), (2, "a q q c q b"), (3, "a b"), (4, None), (5, "a q q q q b c")]
    items = [(9, "a b c")]
    d, b = frames(spark, docs, items)
    path = scratch(spark, "test-positions")
    decontaminate.build_index(d, path)
    index, wanted = decontaminate.read_index(spark, path), decontaminate.windows(b)
    assert [tuple(r) for r in decontaminate.phrase_matches(index, wanted).collect()] == [(1, 9, 1, 4)]
    near = sorted(tuple(r) for r in decontaminate.proximity_matches(index, wanted, 5).collect())
    brute = []
    for i, text in docs:
        w = words(text)
        for s, first in enumerate(w):
            ends = [next((k for k in range(s, len(w)) if w[k] == t), None) for t in "abc"]
            if first in "abc" and None not in ends and max(ends) < s + 5:
                brute.append((i, 9, s, max(ends) + 1))
    assert near == sorted(brute) and {r[0] for r in near} == {1}
    assert {r[0] for r in decontaminate.proximity_matches(index, wanted, 6).collect()} == {1, 2}


def test_coalesce_groups_and_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        cuts = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, 9)), n)) for _ in range(2)]
        begins = [np.concatenate([[0], c[:-1]]) for c in cuts]
        group_a, group_b, a, b = align.coalesce(begins[0], cuts[0], begins[1], cuts[1])
        both = sorted(set(cuts[0]) & set(cuts[1]))
        assert [int(np.searchsorted(both, e)) for e in cuts[0]] == group_a.tolist()
        assert [int(np.searchsorted(both, e)) for e in cuts[1]] == group_b.tolist()
        assert list(zip(a, b)) == [(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1]))
                                   if max(begins[0][i], begins[1][j]) < min(cuts[0][i], cuts[1][j])]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    return align.load(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_chunks_give_the_tokens_of_whole_texts(tokenizers, library):
    rng = random.Random(3)
    odd = ["a", "the", "ing", " ", "  ", "\n", "\t", "̈", "É", "日本", "\x1c", "\x85", "<s>", "<|endoftext|>", "'s", "23", "!", "　", "ﬁ",
           "\x00", "\r\n", "<0x0A>", "🙂"]
    for text in ["".join(rng.choice(odd) for _ in range(rng.randint(1, 14))) for _ in range(4000)] + ["a" + " " * 20_000 + "b", "ab" * 20_000]:
        chunks = tokenizers.chunks(text)
        a, b, n_a, n_b = tokenizers.encode(chunks)
        assert " ".join(chunks) == text and len(n_a) == len(n_b) == len(chunks)
        assert a.tolist() == library[0].encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == library[1].encode(text)


def test_alignment_equals_brute_force(spark, tokenizers, library):
    docs = corpus()[:40] + corpus()[120:] + [(300, " two  blanks "), (301, " "), (302, "line\n\n next <s> <|endoftext|>"), (303, "naïve 🙂 ▁x")]
    piece_a = {k: t for t, k in tokenizers._table.items()}
    links, per_doc = Counter(), []
    for i, text in docs:
        if not text:
            per_doc.append((i, 0, 0, [], []))
            continue
        a, b = library[0].encode(" " + text, add_special_tokens=False).ids, library[1].encode(text)
        raw = [[piece_a[k] for k in a], [tokenizers.bytes_b[k] for k in b]]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            per_doc.append((i, 0, 0, [], []))
            continue
        ends = [np.cumsum(list(map(len, r))).tolist() for r in raw]
        groups, pairs, at = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            stop = [ends[0].index(e) + 1, ends[1].index(e) + 1]
            groups.append(",".join(map(str, a[at[0]:stop[0]])) + "|" + ",".join(map(str, b[at[1]:stop[1]])))
            pairs.append((a[stop[0] - 1], b[stop[1] - 1]))
            at = stop
        links.update(pairs)
        per_doc.append((i, len(a), len(b), groups, pairs))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    want = [(i, n_a, n_b, len(g), len(p), sum(links[x] == most[x[1]] for x in p), sum(links[x] for x in p),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, p in per_doc]
    d, _ = frames(spark, docs, [])
    aligned = align.align(d, tokenizers)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align.link_counts(aligned).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {(r.a, r.b): r.n for r in align.pair_counts(aligned).collect()} == dict(links)
    assert align.link_counts(align.align(d.limit(0), tokenizers)).count() == 0


def test_exact_dedup_query_with_repeated_ids(spark):
    """An id with two texts that nobody else has comes once for each text."""
    from tabsmith.llm.queries import QUERIES
    path = scratch(spark, "repeats")
    rows = [(1, "one text"), (1, "another, longer text"), (2, "shared  words"), (3, "shared words"), (3, "alone"), (None, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in QUERIES["op4_exact_dedup"](spark, path).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [("1", "1", 1, True, sha("one text")), ("1", "1", 1, True, sha("another, longer text")), ("2", "2", 2, True, sha("shared words")),
            ("3", "2", 2, False, sha("shared words")), ("3", "3", 1, True, sha("alone")), ("4", "4", 2, True, sha("")), ("None", "4", 2, False, sha(""))]
    assert got == sorted(want)


def test_encoding_time_of_long_words_is_linear():
    """Twice the letters take about twice the time, though every place is tried and given up."""
    import time

    from tabsmith.llm import bpe
    encoder = bpe.model_of(bpe.read_spec(tokenizer_path("word_bpe_49k.json")))
    encoder.encode("warm up")
    spent = []
    for n in (20_000, 40_000):
        start = time.process_time()
        encoder.encode("ab" * (n // 2))
        spent.append(time.process_time() - start)
    assert spent[1] < 3 * spent[0] + 0.05
