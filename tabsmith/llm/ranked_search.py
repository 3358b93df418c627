"""Ranked lexical search over bit-sliced Bloom signatures.

The index keeps documents in groups of similar size.  A group has one bitmap per signature bit,
with one bit per document: bit ``b`` of the bitmaps' ``d``-th column says that some key of
document ``d`` hashes to ``b``.  A key is a term together with a step of its frequency (the
steps are 1, 2, 3, 4, 6, 8, 12, 16, ...: a term found five times has the keys of 1, 2, 3 and 4),
so the bitmaps that a term's keys choose, ANDed, hold at least the documents with the term, and
the highest step found bounds its frequency from above.

The weights of the terms whose slices are set, summed per document with these bounds, are never
below the document's score.  The documents with the highest sums are scored exactly; the worst
score among the best of them is a threshold, and every document whose sum reaches it -- all that
are not provably excluded -- is scored exactly from its whole text.

Queries come in blocks of bounded size; each block is searched against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import batch_rows, cut, scratch, text_of
from tabsmith.llm.words import blocks, split_words, word_array

TOP = 50
SEEDS = 4 * TOP           # documents per query scored first
HASHES = 5
BITS_PER_KEY = 10
GROUP_BITS = 1 << 23      # bits of a group's bitmaps
QUERY_BYTES = 4 << 20     # words of a block of queries; one query may be longer
QUERY_ROWS = 2000
SUMMED_AT_ONCE = 1 << 21

SIGNATURE_SCHEMA = "n_bits long, doc_ids array<long>, lengths array<long>, slices binary"
COUNT_SCHEMA = "term string, df long"


def _steps() -> np.ndarray:
    """1, 2, then each power of two and the middle between it and the next."""
    powers = 1 << np.arange(1, 40, dtype=np.int64)
    return np.concatenate([[1], np.stack([powers, powers + powers // 2], axis=1).ravel()])


STEPS = _steps()


def _term_hash(terms: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(terms.to_pylist(), dtype=object), categorize=False) if len(terms) else np.zeros(0, np.uint64)


def _bit_rows(term_hash: np.ndarray, step: np.ndarray, n_bits: int) -> np.ndarray:
    """The HASHES slices of each key."""
    h = term_hash ^ (step.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(n_bits)).astype(np.int64)


def _frequencies(codes: np.ndarray, upto: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document and term in it, by document: document, term, occurrences."""
    doc = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    key, tf = np.unique(doc * max(n_terms, 1) + codes, return_counts=True)
    return key // max(n_terms, 1), key % max(n_terms, 1), tf


class _Group:
    """A row of the signature table, filled a document at a time."""

    def __init__(self, n_bits: int):
        self.n_bits, self.ids, self.lengths = n_bits, [], []
        self.room = max(8, min(GROUP_BITS // n_bits, 1024) // 8 * 8)
        self.slices = np.zeros((n_bits, self.room // 8), np.uint8)

    def add(self, doc_id: int | None, length: int, hashes: np.ndarray, steps: np.ndarray) -> bool:
        """Whether the group is full now."""
        d = len(self.ids)
        self.slices[_bit_rows(hashes, steps, self.n_bits).ravel(), d >> 3] |= np.uint8(1 << (d & 7))
        self.ids.append(doc_id), self.lengths.append(length)
        return d + 1 == self.room

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "n_bits": self.n_bits, "doc_ids": self.ids, "lengths": self.lengths, "term": None, "df": None,
            "slices": self.slices[:, :(len(self.ids) + 7) // 8].tobytes()}], schema=schema)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature rows, and the block's count of documents per term in a row of its own kind."""
    schema = pa.schema([("n_bits", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                        ("slices", pa.binary()), ("term", pa.string()), ("df", pa.int64())])
    filling: dict[int, _Group] = {}
    for _, block in blocks(batches, 1):
        terms, codes, upto = split_words(block.column(1))
        hashes = _term_hash(terms)
        doc, term, tf = _frequencies(codes, upto, len(terms))
        df = np.bincount(term, minlength=len(terms))
        for k in range(0, len(terms), 20_000):
            m = min(20_000, len(terms) - k)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, schema.field(j).type) for j in range(4)] +
                                             [terms.slice(k, m), pa.array(df[k:k + m], pa.int64())], schema=schema)
        # one key for each step that the frequency reaches
        n_keys = np.searchsorted(STEPS, tf, "right")
        step = np.arange(n_keys.sum()) - np.repeat(np.cumsum(n_keys) - n_keys, n_keys)
        key_hash, key_doc = hashes[np.repeat(term, n_keys)], np.repeat(doc, n_keys)
        at = np.searchsorted(key_doc, np.arange(len(upto)))
        ids = block.column(0).to_pylist()
        for d in np.flatnonzero(np.diff(upto)):
            keys = slice(at[d], at[d + 1])
            size = math.ceil(math.log(max(at[d + 1] - at[d], 4), 1.25))   # documents up to a quarter apart in size
            n_bits = math.ceil(BITS_PER_KEY * 1.25 ** size)
            group = filling.get(n_bits) or filling.setdefault(n_bits, _Group(n_bits))
            if group.add(ids[d], int(upto[d + 1] - upto[d]), key_hash[keys], step[keys]):
                yield filling.pop(n_bits).row(schema)
    for group in filling.values():
        yield group.row(schema)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write signatures and term counts of all rows and whole texts to ``path``; no shuffle.

    Documents without terms are not in the index.  Ids may be null or repeat: documents are rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with batch_rows(docs.sparkSession, 1000):
        rows.mapInArrow(_signatures, f"{SIGNATURE_SCHEMA}, {COUNT_SCHEMA}").write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SIGNATURE_SCHEMA}, {COUNT_SCHEMA}").parquet(path)


@dataclass
class Queries:
    """A block of queries: their terms with weights, and which query wants which term."""
    items: list          # numbers of the queries
    terms: list          # distinct terms
    weights: np.ndarray  # per term
    begin: np.ndarray    # per term, where its queries begin in ``wanting``
    wanting: np.ndarray  # queries (places in ``items``), by term
    n_docs: int
    n_words: int

    def middle(self, lengths: np.ndarray) -> np.ndarray:
        """m of each document, by its length."""
        return 50 + (50 * lengths * self.n_docs) // self.n_words

    def sums(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per document and query the sum over (document, term, frequency)."""
        tf = tf.astype(np.int64)
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * self.middle(lengths)[doc]))
        n = self.begin[term + 1] - self.begin[term]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(len(lengths) * len(self.items), np.int64)
        k = 0
        while k < len(doc):      # as many as make SUMMED_AT_ONCE entries, but one at least
            stop = max(k + 1, int(np.searchsorted(upto, upto[k] + SUMMED_AT_ONCE, "right")) - 1)
            some = n[k:stop]
            at = np.arange(some.sum()) + np.repeat(self.begin[term[k:stop]] - (upto[k:stop] - upto[k]), some)
            cell = np.repeat(doc[k:stop], some) * len(self.items) + self.wanting[at]
            # all integers here stay below 2 ** 53, so sums of doubles are exact
            out += np.bincount(cell, np.repeat(part[k:stop], some), minlength=len(out)).astype(np.int64)
            k = stop
        return out.reshape(len(lengths), len(self.items))


def _bounds(q: Queries, hashes: np.ndarray, n_bits: int, lengths: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Per document of a group and query a number that its score does not exceed."""
    docs, terms, bound = [], [], []
    per_doc = slices.shape[1] * 8
    for k in range(0, len(hashes), max(1, (1 << 21) // per_doc)):
        some = hashes[k:k + max(1, (1 << 21) // per_doc)]
        rows = _bit_rows(some, np.zeros(len(some), np.int64), n_bits)
        there = slices[rows[:, 0]]
        for j in range(1, HASHES):
            there &= slices[rows[:, j]]
        t, d = np.nonzero(np.unpackbits(there, axis=1, count=len(lengths), bitorder="little"))
        docs.append(d), terms.append(t + k)
    doc, term = np.concatenate(docs), np.concatenate(terms)
    high = np.zeros(len(doc), np.int64)      # the highest step found so far
    left = np.arange(len(doc))
    while len(left):
        d, step = doc[left], high[left] + 1
        rows = _bit_rows(hashes[term[left]], step, n_bits)
        bits = (slices[rows, (d >> 3)[:, None]] >> (d & 7).astype(np.uint8)[:, None]) & 1
        # a document of n words holds no term more than n times, whatever the bits say
        left = left[bits.all(axis=1) & (STEPS[step] <= lengths[d])]
        high[left] += 1
    bound = np.minimum(STEPS[high + 1] - 1, lengths[doc])
    return q.sums(doc, term, bound, lengths)


def _bound_rows(q: Queries, threshold: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, bound): the best SEEDS of each signature row, or all that reach the threshold."""
    hashes = _term_hash(pa.array(q.terms, pa.string()))
    for batch in batches:
        for k in range(batch.num_rows):
            row = [batch.column(j)[k] for j in range(4)]
            lengths = row[2].values.to_numpy(zero_copy_only=False)
            n_bits = row[0].as_py()
            slices = np.frombuffer(row[3].as_buffer(), np.uint8).reshape(n_bits, -1)
            sums = _bounds(q, hashes, n_bits, lengths, slices)
            if threshold is None:
                best = np.argsort(-sums, axis=0, kind="stable")[:SEEDS]
                keep = np.zeros(sums.shape, bool)
                np.put_along_axis(keep, best, True, axis=0)
                keep &= sums > 0
            else:
                keep = (sums >= threshold) & (sums > 0)
            doc, item = np.nonzero(keep)
            yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": row[1].values.take(pa.array(doc)),
                                              "bound": pa.array(sums[doc, item], pa.int64())})


def _exact_rows(q: Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score) above 0 of the queries that a document is a candidate of."""
    asked = pa.array(q.terms, pa.string())
    for _, block in blocks(batches, 1):
        terms, codes, upto = split_words(block.column(1))
        number = pc.index_in(terms, asked).fill_null(-1).to_numpy(zero_copy_only=False) if len(terms) else np.zeros(0, np.int64)
        lengths = np.diff(upto)
        doc, term, tf = _frequencies(codes, upto, len(terms))
        term = number[term].astype(np.int64)
        doc, tf, term = doc[term >= 0], tf[term >= 0], term[term >= 0]
        wanted = block.column(2)
        begin = np.frombuffer(wanted.buffers()[1], np.int32)[wanted.offset:wanted.offset + len(wanted) + 1]
        item = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), np.diff(begin))
        for k in range(0, len(lengths), 500):      # rows of the table of sums at a time
            stop = min(k + 500, len(lengths))
            part = slice(*np.searchsorted(doc, [k, stop]))
            sums = q.sums(doc[part] - k, term[part], tf[part], lengths[k:stop])
            at = slice(*np.searchsorted(row, [k, stop]))
            score = sums[row[at] - k, item[at]]
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item[at][score > 0], pa.int32()), "doc_id": block.column(0).take(pa.array(row[at][score > 0])),
                "score": pa.array(score[score > 0], pa.int64())})


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k best rows of each item as ``rank`` 1..k, equal ones by ascending doc_id, null ids last."""
    order = Window.partitionBy("item").orderBy(F.col(by).desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(docs: DataFrame, candidates: DataFrame, q: Queries) -> DataFrame:
    """Exact scores of the candidates (item, doc_id), from whole texts."""
    per_doc = candidates.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("item").alias("items"))
    rows = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "items")
    return rows.mapInArrow(partial(_exact_rows, q), "item int, doc_id long, score long")


def _query_blocks(queries: DataFrame, spark: SparkSession) -> Iterator[list[Row]]:
    """The queries (number, item_id, terms) in blocks of at most QUERY_BYTES of terms."""
    sized = queries.withColumn("_size", F.expr("aggregate(terms, 0L, (n, t) -> n + octet_length(t) + 8)"))
    block, size = [], 0
    for row in sized.toLocalIterator():
        if block and (size + row["_size"] > QUERY_BYTES or len(block) >= QUERY_ROWS):
            yield block
            block, size = [], 0
        block.append(row)
        size += row["_size"]
    if block:
        yield block


def _prepared(block: list[Row], index: DataFrame, n_docs: int, n_words: int) -> Queries:
    """Weights from the counts of the block's terms: bounded by the block."""
    spark = index.sparkSession
    terms = sorted({t for r in block for t in r["terms"]})
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    df = dict(index.where("term IS NOT NULL").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df")).collect())
    terms = [t for t in terms if t in df]
    number = {t: k for k, t in enumerate(terms)}
    pairs = sorted((number[t], k) for k, r in enumerate(block) for t in set(r["terms"]) if t in number)
    of = np.array([t for t, _ in pairs], np.int64)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms]
    return Queries([r["number"] for r in block], terms, np.array(weights, np.int64), np.searchsorted(of, np.arange(len(terms) + 1)),
                   np.array([k for _, k in pairs], np.int64), n_docs, n_words)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, index_path: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each query with a score above 0.

    Scores are the integer sums of the module's weights; equal ones come by ascending doc_id, null
    ids last.  A query without terms, or whose terms no document holds, has no rows, and a null
    text has no terms.  Query rows that repeat an id are queries of their own; documents that
    repeat an id are ranked each for itself.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if index_path is None:
        index_path = scratch(spark, "signatures")
        build_index(docs, index_path)
    index = read_index(spark, index_path)
    signatures = index.where("term IS NULL").select("n_bits", "doc_ids", "lengths", "slices")
    totals = signatures.agg(F.sum(F.size("doc_ids")).cast("long"),
                            F.sum(F.expr("aggregate(lengths, 0L, (a, b) -> a + b)"))).first()
    numbered = cut(queries.select(F.col(query_id).alias("item_id"), F.array_distinct(word_array(query_text)).alias("terms"))
                   .where(F.size("terms") > 0).withColumn("number", F.monotonically_increasing_id()))
    out = numbered.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                          F.lit(0).cast("long").alias("score")).where("false")
    if not totals[0]:
        return out
    for block in _query_blocks(numbered, spark):
        q = _prepared(block, index, totals[0], totals[1])
        if not q.terms:
            continue
        bounds = "item int, doc_id long, bound long"
        with batch_rows(spark, 16):
            seeds = cut(_best(signatures.mapInArrow(partial(_bound_rows, q, None), bounds), "bound", max(SEEDS, top)).select("item", "doc_id"))
        with batch_rows(spark, 1000):
            first = cut(_best(_scored(docs, seeds, q), "score", top))
        worst = {r["item"]: r["score"] for r in first.where(F.col("rank") == top).collect()}   # one row per query of the block
        threshold = np.array([worst.get(k, 0) for k in range(len(block))], np.int64)
        with batch_rows(spark, 16):
            left = cut(signatures.mapInArrow(partial(_bound_rows, q, threshold), bounds).select("item", "doc_id"))
        with batch_rows(spark, 1000):
            best = cut(_best(_scored(docs, left, q), "score", top))
        names = spark.createDataFrame([(k, r["number"]) for k, r in enumerate(block)], "item int, number long")
        found = best.join(names, "item").join(numbered.select("number", "item_id"), "number")
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
