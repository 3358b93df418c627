"""Words of whole texts, split a block of documents at a time with array operations.

A word is a run of digits, letters a-z (A-Z are lowered) and characters beyond ASCII:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z.  In UTF-8 such a run is a run of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabsmith.llm.common import text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 8 << 20   # text of a block; one document may be longer
BLOCK_ROWS = 50_000


def word_array(text: str | Column) -> Column:
    """The words as an array, in order, in Spark."""
    low = F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), 1)


def _folded() -> np.ndarray:
    """Per byte what it becomes in a word, 0 where it separates words."""
    out = np.zeros(256, np.uint8)
    for kept in (np.arange(ord("0"), ord("9") + 1), np.arange(ord("a"), ord("z") + 1), np.arange(128, 256)):
        out[kept] = kept
    out[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return out


_FOLD = _folded()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, each occurrence's number among them, and per text how many words it
    and all texts before it have (one entry more than texts, the first 0)."""
    if len(texts) == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds -= bounds[0]
    folded = _FOLD[raw]
    inside = folded != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = inside[begins]
    stops = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[stops] = inside[stops]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first + 1, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(first, bounds)


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in blocks of about ``size`` bytes of column ``text``, each with a number
    that no other block has and that a repeated attempt gives again."""
    number = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    held, n_bytes, n_rows = [], 0, 0
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0)), dtype=np.int64)])
        begin = 0
        while begin < batch.num_rows:
            stop = int(np.searchsorted(upto, upto[begin] + size - n_bytes))
            stop = min(max(stop, begin + 1), batch.num_rows, begin + BLOCK_ROWS - n_rows)
            held.append(batch.slice(begin, stop - begin))
            n_bytes, n_rows, begin = n_bytes + int(upto[stop] - upto[begin]), n_rows + stop - begin, stop
            if n_bytes >= size or n_rows >= BLOCK_ROWS:
                yield number, pa.concat_batches(held)
                number, held, n_bytes, n_rows = number + 1, [], 0, 0
    if held:
        yield number, pa.concat_batches(held)
