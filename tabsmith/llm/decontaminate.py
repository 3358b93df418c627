"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores, per block of documents, one row for each of its terms with all its
positions, and one row (term null) with the block's documents.  Postings of a term thus lie in
as many rows as there are blocks: no term is ever gathered in one place, and a block's size
bounds what a task holds.

A search takes windows of benchmark words.  Corpus counts, summed from the index, give each
window's rarest term; its postings tell the blocks where the window can occur, and the window
goes to these only.  There the position lists, shifted by their place in the window, are
intersected from the rarest one on.  Proximity matches take the windows' terms in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import batch_rows, cut, scratch, text_of
from tabsmith.llm.words import blocks, split_words, word_array

WINDOW = 10
INDEX_SCHEMA = "block long, term string, n long, positions binary, doc_ids array<long>, n_words array<long>"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("positions", pa.binary()),
                        ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])
    for number, block in blocks(batches, 1):
        terms, codes, upto = split_words(block.column(1))
        counts = np.diff(upto)
        # a place between documents stays free, so that no window reaches over it
        place = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
        order = np.sort(codes.astype(np.int64) << 32 | place)
        ends = np.searchsorted(order, np.arange(len(terms) + 1, dtype=np.int64) << 32)
        places = (order & 0xFFFFFFFF).astype("<i4")
        held = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(places)])
        n = len(terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(1, number)), pa.nulls(1, pa.string()), pa.array([len(codes)], pa.int64()), pa.nulls(1, pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), block.column(0)),
             pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64()))], schema=schema)
        for k in range(0, n, 20_000):
            m = min(20_000, n - k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, number)), terms.slice(k, m), pa.array(np.diff(ends[k:k + m + 1]), pa.int64()), held.slice(k, m),
                 pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))], schema=schema)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the positional index of all rows and whole texts to ``path``; no shuffle.

    A null text has no words.  Null and repeated ids are kept as they are: documents are rows.
    An empty table writes an empty index."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with batch_rows(docs.sparkSession, 1000):
        rows.mapInArrow(_postings, INDEX_SCHEMA).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, window``: every run of ``size`` consecutive words of an item, once; all words
    of an item that has fewer; nothing of an item without words."""
    words = items.select(F.col(id_col).cast("long").alias("item_id"), word_array(text_col).alias("_w")).where("size(_w) > 0")
    runs = F.expr(f"transform(sequence(0, greatest(size(_w) - {int(size)}, 0)), i -> slice(_w, i + 1, {int(size)}))")
    return words.select("item_id", F.explode(runs).alias("window")).distinct()


def exact_starts(lists: list[np.ndarray]) -> np.ndarray:
    """Places where the first term is followed by all others in order: from the rarest list on,
    each list is shifted by its offset and what it does not confirm is dropped."""
    order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
    starts = lists[order[0]].astype(np.int64) - order[0]
    for j in order[1:]:
        at = np.searchsorted(lists[j], starts + j)
        at[at == len(lists[j])] = 0
        starts = starts[lists[j][at] == starts + j]
        if not len(starts):
            break
    return starts


def near_spans(lists: list[np.ndarray], within: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and last places of the spans of at most ``within`` words that hold each term:
    those that begin with one of the terms, each at its shortest."""
    lists = [p.astype(np.int64) for p in sorted(lists, key=len)]
    rare = lists[0]
    starts = np.unique(np.concatenate(lists))
    at = np.searchsorted(rare, starts)
    at[at == len(rare)] = len(rare) - 1
    starts = starts[(rare[at] >= starts) & (rare[at] < starts + within)]
    last = starts.copy()
    for p in lists:
        at = np.searchsorted(p, starts)
        found = at < len(p)
        starts, last, at = starts[found], last[found], at[found]
        last = np.maximum(last, p[at])
        found = last < starts + within
        starts, last = starts[found], last[found]
    return starts, last


def _block_matches(postings: pa.Table, wanted: pa.Table, within: int | None):
    """The block's documents (ids, word counts, first places) and its matches: document
    numbers, items, first and last places."""
    is_list = np.asarray(postings.column("term").is_null())
    docs = postings.filter(pa.array(is_list))
    ids = docs.column("doc_ids").combine_chunks().flatten()
    counts = docs.column("n_words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    base = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    terms = postings.filter(pa.array(~is_list))
    places = {t: np.frombuffer(p, "<i4") for t, p in zip(terms.column("term").to_pylist(), terms.column("positions").to_pylist())}
    by_window: dict[tuple, list] = {}
    for item, window in zip(wanted.column("item_id").to_pylist(), wanted.column("window").to_pylist()):
        by_window.setdefault(tuple(window), []).append(item)
    at_doc, at_item, first, last = [], [], [], []
    for window, items in by_window.items():
        lists = [places.get(t) for t in (window if within is None else set(window))]
        if any(p is None for p in lists):
            continue
        if within is None:
            starts = exact_starts(lists)
            stops = starts + len(window) - 1
        else:
            starts, stops = near_spans(lists, within)
            same = np.searchsorted(base, starts, "right") == np.searchsorted(base, stops, "right")
            starts, stops = starts[same], stops[same]
        if len(starts):
            doc = np.searchsorted(base, starts, "right") - 1
            for item in items:
                at_doc.append(doc), at_item.extend([item] * len(doc)), first.append(starts), last.append(stops)
    empty = [np.zeros(0, np.int64)]
    return ids, counts, base, np.concatenate(at_doc or empty), at_item, np.concatenate(first or empty), np.concatenate(last or empty)


def _match_rows(within: int | None, postings: pa.Table, wanted: pa.Table) -> pa.Table:
    ids, _, base, doc, item, first, last = _block_matches(postings, wanted, within)
    return pa.table({"doc_id": ids.take(pa.array(doc)), "item_id": pa.array(item, pa.int64()),
                     "begin": pa.array(first - base[doc], pa.int64()), "end": pa.array(last - base[doc] + 1, pa.int64())})


def _document_rows(within: int | None, postings: pa.Table, wanted: pa.Table) -> pa.Table:
    ids, counts, base, doc, item, first, last = _block_matches(postings, wanted, within)
    total = int(base[-1] + counts[-1] + 1) if len(counts) else 0
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + 1, -1)
    hit = np.cumsum(steps) > 0
    edges = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of = np.searchsorted(base, begins, "right") - 1
    runs = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(begins - base[of], pa.int64()), pa.array(ends - base[of], pa.int64())], ["begin", "end"])
    pairs = sorted({p for p in zip(doc.tolist(), item) if p[1] is not None})
    upto = np.searchsorted(np.array([d for d, _ in pairs], np.int64), np.arange(len(counts) + 1)).astype(np.int32)
    return pa.table({"doc_id": ids, "n_words": pa.array(counts, pa.int64()),
                     "spans": pa.ListArray.from_arrays(pa.array(runs), spans),
                     "items": pa.ListArray.from_arrays(pa.array(upto), pa.array([i for _, i in pairs], pa.int64()))})


def _search(index: DataFrame, wanted: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on each block with the postings of its windows' terms and the windows that can occur in it."""
    wanted = cut(wanted)
    each = wanted.select("window").distinct().select("window", F.explode(F.array_distinct("window")).alias("term"))
    terms = each.select("term").distinct()
    postings = index.where("term IS NOT NULL").join(terms, "term", "left_semi")
    counts = postings.groupBy("term").agg(F.sum("n").alias("_n"))
    rarest = (each.join(counts, "term", "left").groupBy("window")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("term").alias("t"))).alias("_r"))
              .where("_r.n > 0").select("window", F.col("_r.t").alias("term")))
    there = postings.select("block", "term").join(rarest, "term").select("block", "window")
    asked = there.join(wanted, "window").select(F.col("block").alias("_block"), "item_id", "window")
    held = postings.select(index.columns).unionByName(index.where("term IS NULL"))
    return held.groupBy("block").cogroup(asked.groupBy("_block")).applyInArrow(fn, schema)


def phrase_matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each place of each window as ``doc_id, item_id, begin, end``, in words, end excluded."""
    return _search(index, wanted, partial(_match_rows, None), "doc_id long, item_id long, begin long, end long")


def proximity_matches(index: DataFrame, wanted: DataFrame, within: int) -> DataFrame:
    """Spans of at most ``within`` words that hold all terms of a window, in any order, as
    ``doc_id, item_id, begin, end``: from each place of a term the shortest."""
    return _search(index, wanted, partial(_match_rows, int(within)), "doc_id long, item_id long, begin long, end long")


def judge(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    ``spans`` are the runs of words inside any occurrence of a window (begin, end, excluded, in
    words), ``items`` the ids of the items with an occurring window.  Windows of an item without
    an id mark words but name no item.  No windows: no spans."""
    return _search(index, wanted, partial(_document_rows, None),
                   "doc_id long, n_words long, spans array<struct<begin: long, end: long>>, items array<long>")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``judge`` for the windows of ``items`` over an index of ``docs`` in the shared folder."""
    spark = docs.sparkSession
    path = scratch(spark, "positions")
    build_index(docs, path)
    return judge(read_index(spark, path), windows(items, size))
