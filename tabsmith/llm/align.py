"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes: A is byte-level BPE, B a sentencepiece model.  All tokens of a
block of documents, A's and B's, are sorted by start; the running maximum of their ends shows where
a start reaches it: no token reaches over that byte, so a group of tokens ends there.  Within a group
the sorted tokens expand to the pairs that share bytes: at each start, the latest A and B token.

Neither tokenizer merges over a blank that follows a character other than white space, so a text is
cut there, and each distinct chunk of a worker's texts is tokenised and coalesced once; documents
are put together from their chunks.

Corpus-wide counts of linked id pairs are summed per block first, so that a frequent pair has one row
a block; each block then gets the counts of its own pairs back.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import batch_rows, cut, text_of
from tabsmith.llm.words import blocks

BLOCK_BYTES = 2 << 20   # text encoded at once; one document may be longer
B_IDS = 1 << 20         # a pair of ids is one number, a * B_IDS + b; both ids are below
CHUNKS_AT_ONCE = 256    # chunks in one call of an encoder
KEPT_CHUNKS = 400_000   # distinct chunks a worker remembers

#: A blank and what follows up to the next blank after a character that is not white space;
#: white space at the end goes with the last chunk.
CHUNK = re.compile(r" (\s*+(?:\S++(?:[^\S ]\s*+)?)*+(?: \s*+\Z)?)")
ODD_SPACE = re.compile(r"[^\S ] ")   # without it and without blanks in a row, chunks are what blanks separate
LONG_SPACE = re.compile(r"\s{1000}")
ALIGNED_SCHEMA = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, "
                  "groups_sha256 string, pairs binary, times binary")


@dataclass
class Tokenizers:
    """The two vocabularies as the bytes of their files, opened once a worker."""
    ranks: bytes      # A: one base64 token and its id a line
    pattern: str      # A: how a text is cut before merging
    spec: bytes       # A: the same vocabulary for the tokenizers library
    model: bytes      # B: a sentencepiece model

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranks", "pattern", "spec", "model")}

    @cached_property
    def _table(self) -> dict[bytes, int]:
        return {base64.b64decode(t): int(k) for t, k in map(bytes.split, self.ranks.splitlines())}

    @cached_property
    def _fast_a(self):
        import tiktoken
        # no special tokens: their strings in a text are plain text
        return tiktoken.Encoding("a", pat_str=self.pattern, mergeable_ranks=self._table, special_tokens={})

    @cached_property
    def _patient_a(self):
        from tokenizers import Tokenizer
        out = Tokenizer.from_str(self.spec.decode("utf-8"))
        out.encode_special_tokens = True
        return out

    @cached_property
    def bytes_a(self) -> list[bytes]:
        out = [b""] * (max(self._table.values()) + 1)
        for token, k in self._table.items():
            out[k] = token
        return out

    @cached_property
    def _b(self):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def bytes_b(self) -> list[bytes]:
        sp = self._b
        return [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else
                sp.id_to_piece(k).replace("\u2581", " ").encode("utf-8") for k in range(sp.get_piece_size())]

    @cached_property
    def len_a(self) -> np.ndarray:
        return np.array(list(map(len, self.bytes_a)), np.int64)

    @cached_property
    def len_b(self) -> np.ndarray:
        return np.array(list(map(len, self.bytes_b)), np.int64)

    @cached_property
    def _whole_a(self) -> bool:
        """Whether A has every byte as a token, so that its tokens always give the bytes back."""
        return all(bytes([k]) in self._table for k in range(256))

    @cached_property
    def signs(self) -> list[str]:
        """Each id with each sign that can follow it."""
        return [f"{k}{c}" for k in range(max(len(self.bytes_a), len(self.bytes_b))) for c in ",|;"]

    @cached_property
    def _chunked(self) -> bool:
        """Whether no piece of B goes on with a blank, so that chunks are independent."""
        return not any(re.search(rb"[^ ] ", p) for p in self.bytes_b)

    def chunks(self, text: str) -> list[str]:
        """The chunks of blank + text, each without its first blank; none of an empty text."""
        if not text:
            return []
        if not self._chunked:
            return [text]
        parts = text.split(" ")
        return CHUNK.findall(" " + text) if "" in parts or ODD_SPACE.search(text) else parts

    def _ids_a(self, text: str) -> list[int]:
        if LONG_SPACE.search(text):     # tiktoken's regular expression steps back over white space and overflows
            return self._patient_a.encode(text, add_special_tokens=False).ids
        return self._fast_a.encode_ordinary(text)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, one chunk after another, and per chunk how many of each it has;
        none of either where one does not give the bytes back."""
        found = []
        for k in range(0, len(chunks), CHUNKS_AT_ONCE):
            some = chunks[k:k + CHUNKS_AT_ONCE]
            # chunks in a row keep their borders unless white space meets there
            together = None if any(c[-1:].isspace() for c in some) else self._both(some)
            none = np.zeros(0, np.int64)
            found += [together] if together else [self._both([c]) or (none, none, np.zeros(1, int), np.zeros(1, int)) for c in some]
        return tuple(map(np.concatenate, zip(*found)))

    def _both(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        text = " ".join(parts)
        raw = (" " + text).encode("utf-8")
        borders = np.cumsum(list(map(len, map(str.encode, parts)))) + np.arange(1, len(parts) + 1)
        ids_b = self._b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return None
        ids_a = self._ids_a(" " + text)
        if not self._whole_a and b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw:
            return None
        out = []
        for ids, sizes in ((np.array(ids_a, np.int64), self.len_a), (np.array(ids_b, np.int64), self.len_b)):
            ends = np.cumsum(sizes[ids])
            at = np.searchsorted(ends, borders)
            if not np.array_equal(ends[at], borders):
                return None
            out.append((ids, np.diff(at, prepend=-1)))
        return out[0][0], out[1][0], out[0][1], out[1][1]


def load(ranks_path: str, pattern: str, spec_path: str, model_path: str) -> Tokenizers:
    def read(path):
        with open(path, "rb") as f:
            return f.read()
    return Tokenizers(read(ranks_path), pattern, read(spec_path), read(model_path))


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each A and each B interval, and the pairs (A, B) that overlap.

    Both lists are in order and do not overlap in themselves.  Groups are numbered in order."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    kind = np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((kind, start))
    begins, reach = start[order], np.maximum.accumulate(end[order])
    group = np.concatenate([[0], np.cumsum(begins[1:] >= reach[:-1])])
    of = np.empty(len(order), np.int64)
    of[order] = group
    # the latest token of either kind at each start; pairs only where they share a byte
    last_a = np.maximum.accumulate(np.where(order < len(start_a), order, -1))
    last_b = np.maximum.accumulate(np.where(order >= len(start_a), order - len(start_a), -1))
    final = np.concatenate([begins[1:] != begins[:-1], [True]]) & (last_a >= 0) & (last_b >= 0)
    a, b, at = last_a[final], last_b[final], begins[final]
    both = (end_a[a] > at) & (end_b[b] > at)
    return of[:len(start_a)], of[len(start_a):], a[both], b[both]


def _group_texts(group_a: np.ndarray, group_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, owner: np.ndarray, n: int,
                 signs: list[str]) -> list[str]:
    """Per owner of groups ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    n_a, n_b = np.bincount(group_a, minlength=len(owner)), np.bincount(group_b, minlength=len(owner))
    ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.int64)
    place_a = np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]
    ids[place_a], ids[np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]] = ids_a, ids_b
    sign[place_a[np.cumsum(n_a) - 1]] = 1               # after a group's last A
    sign[np.cumsum(n_a + n_b) - 1] = 2                  # after its last B
    parts = list(map(signs.__getitem__, (ids * 3 + sign).tolist()))
    upto = np.concatenate([[0], np.cumsum(np.bincount(owner, n_a + n_b, minlength=n).astype(np.int64))]).tolist()
    return ["".join(parts[i:j])[:-1] for i, j in zip(upto, upto[1:])]


class Chunks:
    """The distinct chunks met so far, with what their alignment gives."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)     # a new chunk gets the next number
        self.texts: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)    # tokens of A and B, groups, overlaps; -1 where bytes differ
        self.pairs = np.zeros(0, np.int64)          # linked id pairs, chunk by chunk
        self.upto = np.zeros(1, np.int64)

    def add(self, new: list[str]) -> None:
        t = self.tokenizers
        ids_a, ids_b, n_a, n_b = t.encode(new)
        # chunks follow each other on one line of bytes; both tokenizers cut it at their borders
        end_a, end_b = np.cumsum(t.len_a[ids_a]), np.cumsum(t.len_b[ids_b])
        group_a, group_b, a, b = coalesce(end_a - t.len_a[ids_a], end_a, end_b - t.len_b[ids_b], end_b)
        chunk_a = np.repeat(np.arange(len(new)), n_a)
        owner = chunk_a[np.flatnonzero(np.diff(group_a, prepend=-1))]
        linked = end_a[a] == end_b[b]
        overlaps = np.bincount(chunk_a[a], minlength=len(new))
        a, b = a[linked], b[linked]
        counts = np.stack([n_a, n_b, np.bincount(owner, minlength=len(new)), overlaps], axis=1)
        counts[n_a == 0] = -1
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, ids_a[a] * B_IDS + ids_b[b]])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(np.bincount(chunk_a[a], minlength=len(new)))])
        self.texts += _group_texts(group_a, group_b, ids_a, ids_b, owner, len(new), t.signs)

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Per text its chunks' numbers; unknown chunks are added."""
        if len(self.number) > KEPT_CHUNKS:
            self.forget()
        before = len(self.number)
        out = [list(map(self.number.__getitem__, self.tokenizers.chunks(t))) for t in texts]
        if len(self.number) > before:
            self.add(list(islice(self.number, before, None)))
        return out


_OPEN: dict[str, Chunks] = {}


def _opened(t: Tokenizers) -> Chunks:
    """The worker's chunks, kept for later tasks."""
    key = hashlib.sha256(t.ranks + t.spec + t.model + t.pattern.encode()).hexdigest()
    return _OPEN.get(key) or _OPEN.setdefault(key, Chunks(t))


def _digest(texts: list[str], chunks: list[int]) -> str:
    out = hashlib.sha256()
    for k in range(0, len(chunks), 100_000):        # parts of a long document
        out.update((";" * (k > 0) + ";".join([texts[c] for c in chunks[k:k + 100_000]])).encode("ascii"))
    return out.hexdigest()


def _aligned(tokenizers: Tokenizers, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _opened(tokenizers)
    for number, block in blocks(batches, 1, BLOCK_BYTES):
        docs = known.numbers(block.column(1).to_pylist())
        n = len(docs)
        chunk = np.fromiter((c for d in docs for c in d), np.int64, sum(map(len, docs)))
        of = np.repeat(np.arange(n), list(map(len, docs)))
        bad = np.unique(of[known.counts[chunk, 0] < 0])             # documents whose bytes do not come back
        keep = ~np.isin(of, bad)
        chunk, of = chunk[keep], of[keep]
        sums = [np.bincount(of, known.counts[chunk, j], minlength=n).astype(np.int64) for j in range(4)]
        n_pairs = known.upto[chunk + 1] - known.upto[chunk]
        at = np.arange(n_pairs.sum()) + np.repeat(known.upto[chunk] - (np.cumsum(n_pairs) - n_pairs), n_pairs)
        key = np.sort(np.repeat(of, n_pairs) << 40 | known.pairs[at])
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.append(new, len(key)))
        doc, pair = key[new] >> 40, key[new] & ((1 << 40) - 1)
        upto = np.searchsorted(doc, np.arange(n + 1))
        held = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((upto * w).astype(np.int32)), pa.py_buffer(x.astype(f"<i{w}"))])
                for x, w in ((pair, 8), (times, 4))]
        empty = set(bad.tolist())
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(np.full(n, number)), "doc_id": block.column(0), "n_a": pa.array(sums[0]), "n_b": pa.array(sums[1]),
            "n_groups": pa.array(sums[2]), "n_overlaps": pa.array(sums[3]),
            "n_links": pa.array(np.bincount(doc, times, minlength=n).astype(np.int64)),
            "groups_sha256": pa.array([_digest(known.texts, d) if d and k not in empty else "" for k, d in enumerate(docs)], pa.string()),
            "pairs": held[0], "times": held[1]})


def align(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of tokens, groups, overlapping and linked pairs, the digest of its
    groups, and its linked id pairs (``pairs``: numbers a * B_IDS + b, ascending; ``times``: how often).

    A link is a pair of tokens that overlap and end together.  A null or empty text, and one whose
    tokens do not give blank + text back, has no tokens.  Documents are rows: null and repeated ids
    stay as they are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with batch_rows(docs.sparkSession, 500):
        return cut(rows.mapInArrow(partial(_aligned, tokenizers), ALIGNED_SCHEMA))


def _pairs_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of all linked pairs."""
    pairs = [np.frombuffer(p, "<i8") for p in table.column("pairs").to_pylist()]
    times = [np.frombuffer(p, "<i4") for p in table.column("times").to_pylist()]
    row = np.repeat(np.arange(len(pairs)), list(map(len, pairs)))
    return row, np.concatenate(pairs or [np.zeros(0, np.int64)]), np.concatenate(times or [np.zeros(0, np.int32)])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, a, b, n): the pairs of a block's documents summed, as far as they come together."""
    for batch in batches:
        block = np.asarray(batch.column("block"))
        for number in np.unique(block):
            part = batch.filter(pa.array(block == number))
            _, pair, times = _pairs_of(part)
            pair, at = np.unique(pair, return_inverse=True)
            n = np.bincount(at, times, minlength=len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(pair), number), pa.int64()), "a": pa.array(pair // B_IDS),
                                              "b": pa.array(pair % B_IDS), "n": pa.array(n)})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n``: how many links of the corpus hold each id pair."""
    return _partial_counts(aligned).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _partial_counts(aligned: DataFrame) -> DataFrame:
    return aligned.select("block", "pairs", "times").mapInArrow(_block_pairs, "block long, a long, b long, n long")


def _with_counts(docs: pa.Table, counts: pa.Table) -> pa.Table:
    row, pair, times = _pairs_of(docs)
    known = np.asarray(counts.column("a")) * B_IDS + np.asarray(counts.column("b"))
    order = np.argsort(known)
    at = order[np.searchsorted(known, pair, sorter=order)]
    n, best = np.asarray(counts.column("n"))[at], np.asarray(counts.column("best"))[at]
    # sums of integers, exact below 2 ** 53 each; documents are added up in integers
    total = np.zeros(docs.num_rows, np.int64)
    np.add.at(total, row, n * times)
    hits = np.zeros(docs.num_rows, np.int64)
    np.add.at(hits, row, np.where(best, times, 0))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256"]
    return pa.table([docs.column(c) for c in names] + [pa.array(hits), pa.array(total)], names=[*names, "n_best", "count_sum"])


def link_counts(aligned: DataFrame) -> DataFrame:
    """Per document of ``aligned`` also ``n_best`` (links whose pair is the most frequent of its B id,
    ties included) and ``count_sum`` (over its links, how often their pair is linked in the corpus)."""
    with batch_rows(aligned.sparkSession, 500):
        parts = cut(_partial_counts(aligned).groupBy("block", "a", "b").agg(F.sum("n").alias("n")))
    totals = parts.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = totals.groupBy("b").agg(F.max("n").alias("_most"))
    counts = totals.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))
    looked = parts.select(F.col("block").alias("_block"), "a", "b").join(counts, ["a", "b"])
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, "
              "n_best long, count_sum long")
    return aligned.groupBy("block").cogroup(looked.groupBy("_block")).applyInArrow(_with_counts, schema)
