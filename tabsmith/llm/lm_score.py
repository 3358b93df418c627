"""LM scoring by logistic mixing of context bit predictors.

A text is its words (A-Z as a-z) and one end; each token is coded byte by byte,
closed by a blank, and each byte bit by bit.  Four predictors, for the contexts of
the last one, two and three bytes and of the whole word so far, know how often 0 and
1 followed in the training texts.  A trie edge (prefix of a word, next byte) determines all
four contexts.  Words lie in order, ``CHUNK`` of them in a row of a table, so a task builds the
trie of its words by itself: counts of a prefix are sums of neighbours, and where other chunks
share a prefix their counts come with the chunk.  Counts of a byte after three others are few
and go to every task.

The log odds are combined by weights that a gate (place in the word, confidence of
the longest context) selects.  They are learned over all training documents: an edge
stands for all its occurrences, each of which is taken out of the counts that predict
it; tasks sum gradients and second derivatives by gate, for ``ROUNDS`` Newton steps.
A last table refines the result by what it was worth, again over all occurrences.

A second mixer takes that result and a fifth predictor, for the context of the
previous word with the word so far, in the same way.  Pairs of words meet by the first one, where
the trie of the words behind it is built; of a pair's path only the places where other words leave
it are kept.  With them the pair goes to the chunk of its second word, where the four predictors are
at hand.  No bit, edge or pair has a row of its own on disk.  The second mixer learns from cells of
like occurrences, made once.  Two tokens in a row are scored as a pair, so the order
of the words counts.  Weights are frozen for scoring; a pair takes the numbers of the texts that
have it along, and its score goes back to them.

``score`` is log10 of the probability of the token sequence, so ``-score / log10(2)``
are its total bits, and ``bits_per_byte`` divides them by the coded bytes (of all
tokens, each with its closing blank).

Base counts of tokens are exact.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import batch_rows, cut, small_batches, text_of

CONTEXTS = 4
ROUNDS = 4
GATES, BINS = 16, 33
KNOWN = 400_000  # a task's words before they are handed on
END = b"\n"

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_ODD_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def tokens(text: str) -> list[bytes]:
    """``bytes`` lower-cases A-Z only and splits at blank, tab .. carriage return."""
    out = text.encode("utf-8").lower().split()
    out.append(END)
    return out


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


def edge(parent: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """64-bit key of the trie edge that leaves the prefix ``parent`` by ``byte``."""
    return _mix(parent.view(np.uint64) ^ (byte.astype(np.uint64) + np.uint64(1)) * _MUL).view(np.int64)


class Places:
    """All bytes of some words, each with its contexts."""

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        ends = np.flatnonzero(raw == 32)  # words have no blanks
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.lengths = lengths = ends + 1 - starts
        self.byte = raw
        place = np.arange(len(raw)) - np.repeat(starts, lengths)
        self.last = np.zeros(len(raw), np.int32)  # the last three bytes of the word, the nearest lowest
        for j in range(3):
            before = np.zeros(len(raw), np.int32)
            before[j + 1:] = raw[:-(j + 1)] if len(raw) > j + 1 else raw[:0]
            before[place <= j] = 0
            self.last |= before << (8 * j)
        b = raw.astype(np.uint64)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw) - 1, _ODD)]), dtype=np.uint64)
        upto = np.concatenate([[np.uint64(0)], np.cumsum((b + np.uint64(1)) * power, dtype=np.uint64)])[:-1]
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw) - 1, _ODD_INVERSE)]), dtype=np.uint64)
        prefix = (upto - np.repeat(upto[starts], lengths)) * np.repeat(inverse[starts], lengths)
        self.parent = _mix(prefix + place.astype(np.uint64) * _ODD).view(np.int64)
        self.place = np.minimum(place, 3).astype(np.int32)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or a little more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``w, c``: bytes and training count (0 for held-out words) of all tokens of ``text, held_out``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])

        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist()):
                found = tokens(text.as_py())
                seen.update(dict.fromkeys(found, 0) if held else found)
                if len(seen) > KNOWN:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return cut(docs.select("text", "held_out").mapInArrow(run, "w binary, c long")
               .groupBy("w").agg(F.sum("c").alias("c")))


LEAD = np.array([8] + [7 - (x.bit_length() - 1) for x in range(1, 256)], np.int32)  # equal bits before the first that differs


def common_bits(raw: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits that words ``left`` and ``right`` have in common; no word is the beginning of another."""
    out, some, j = np.zeros(len(left), np.int32), np.arange(len(left)), 0
    a, b = start[left], start[right]
    while len(some):
        x = raw[a + j] ^ raw[b + j]
        other = x != 0
        out[some[other]] = 8 * j + LEAD[x[other]]
        some, a, b, j = some[~other], a[~other], b[~other], j + 1
    return out


def branches(c: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted words with counts ``c`` and bits ``common`` with the word before (-1: first of its group): the
    group's count, and wherever the trie leaves a word's path: word, bit of the path, count that leaves."""
    first = np.flatnonzero(common < 0)
    which = np.cumsum(common < 0) - 1
    total = np.add.reduceat(c, first)[which] if len(c) else c
    keep = np.diff(np.append(first, len(c)))[which] > 1
    some, l, w, n = np.flatnonzero(keep), common[keep], c[keep], total[keep]
    found, t = [], 0
    while len(some):
        new = l <= t
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        here = np.add.reduceat(w, first)[which]
        leaves = n - here
        at = np.flatnonzero(leaves)
        found.append((some[at], np.full(len(at), t, np.int32), leaves[at]))
        keep = np.diff(np.append(first, len(l)))[which] > 1
        some, l, w, n, t = some[keep], l[keep], w[keep], here[keep], t + 1
    return (total, *[np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ()))])


def on_paths(lengths: np.ndarray, total: np.ndarray, item: np.ndarray, t: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[place, bit]`` for all places of the words: count that takes the word's own bit, count that takes the other."""
    begin = np.cumsum(lengths) - lengths
    other = np.zeros(int(lengths.sum()) * 8, np.float64)
    other[8 * begin[item] + t] = leaves
    gone = np.cumsum(other)
    before = np.concatenate([[0.0], gone])[8 * begin]  # also of words without a place
    own = np.repeat(total + before, lengths)[:, None] - gone.reshape(-1, 8)
    return own, other.reshape(-1, 8)


def _ones(byte: np.ndarray) -> np.ndarray:
    return (byte[:, None] >> np.arange(7, -1, -1) & 1).astype(bool)


def _zero_one(byte: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``[place, bit, 0 or 1]``: how often 0 and 1 followed."""
    one = _ones(byte)
    return np.stack([np.where(one, other, own), np.where(one, own, other)], axis=2).astype("<f4")


class Near:
    """Counts of a byte after the last one, two and three bytes of its word."""

    def __init__(self, last: np.ndarray, byte: np.ndarray, c: np.ndarray):
        self.tables, self.keys, self.made = [], [], {}
        for mask in (0xFFFFFF, 0xFFFF, 0xFF):
            key, which = np.unique((last.astype(np.int64) & mask) << 8 | byte, return_inverse=True)
            n = np.bincount(which, c, len(key)).astype(np.int64)
            end = (key & 0xFF).astype(np.uint8)
            common = np.full(len(key), -1, np.int32)
            same = np.flatnonzero(key[1:] >> 8 == key[:-1] >> 8) + 1
            common[same] = LEAD[end[same] ^ end[same - 1]]
            if not self.tables:
                self.key = longest = key
            at = np.searchsorted(key, longest & (mask << 8 | 0xFF))  # of each longest context the shorter one
            self.keys.insert(0, key)
            self.tables.insert(0, (at, _zero_one(end, *on_paths(np.ones(len(key), np.int64), *branches(n, common)))))

    def __call__(self, last: np.ndarray, byte: np.ndarray) -> list[np.ndarray]:
        key = np.searchsorted(self.key, last.astype(np.int64) << 8 | byte)
        return [f[at[key]] for at, f in self.tables]

    def odds(self, last: np.ndarray, byte: np.ndarray, own: bool) -> list[np.ndarray]:
        """Log odds by context, ``[place, bit]``."""
        if own not in self.made:
            self.made[own] = [_odds(f, key & 0xFF, own) for key, (_, f) in zip(self.keys, self.tables)]
        key = np.searchsorted(self.key, last.astype(np.int64) << 8 | byte)
        return [x[at[key]] for (at, _), x in zip(self.tables, self.made[own])]


def _odds(f: np.ndarray, byte: np.ndarray, own: bool) -> np.ndarray:
    """Log odds of counts of 0 and 1 (last axis) at the bits (the one before) of the bytes (first axis).  ``own`` takes one
    occurrence out of the counts."""
    n0, n1 = f[..., 0], f[..., 1]
    if own:
        one = _ones(byte).reshape(len(byte), *[1] * (f.ndim - 3), 8)
        n0, n1 = np.maximum(n0 - ~one, 0), np.maximum(n1 - one, 0)
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


class Edges:
    """Trie edges: keys of their prefixes, places, bytes, training counts, ``x`` with the log odds of the four contexts (last byte, two
    bytes, three bytes, prefix) and a one, ``[bit, edge, context]``, and ``n`` with the counts of the prefix, ``[bit, edge]``."""

    def __init__(self, parent, place, byte, c, odds: list[np.ndarray], n: np.ndarray):
        self.parent, self.place, self.byte, self.c, self.n = parent, place, byte, c, np.ascontiguousarray(n.T)
        self.x = np.ones((8, len(byte), CONTEXTS + 1), np.float32)
        for k, x in enumerate(odds):
            self.x[:, :, k] = x.T

    @classmethod
    def rows(cls, batches: Iterator[pa.RecordBatch], own: bool = True) -> Iterator[Edges]:
        for batch in _gathered(batches):
            f = batch.column(4)
            begin, end = np.frombuffer(f.buffers()[1], np.int32)[[f.offset, f.offset + len(f)]]
            f = np.frombuffer(f.buffers()[2], "<f4", (end - begin) // 4, begin).reshape(-1, CONTEXTS, 8, 2)
            parent, place, byte, c = (batch.column(k).to_numpy() for k in range(4))
            yield cls(parent, place, byte, c, list(_odds(f, byte, own).transpose(1, 0, 2)), np.maximum(f[:, -1].sum(axis=2) - own, 0))


PAST = b"\xff"  # no byte of UTF-8: a beginning with it sorts after all words with that beginning
CHUNK = 20_000  # words in a row that follow each other in the order of all words


def _split(words: bytes) -> list[bytes]:
    return words.split(b" ")[:-1]


class Chunk:
    """Neighbours in the order of all words, each closed by a blank.  ``more`` are the beginnings, with their counts,
    at which other words leave the paths of the first and the last one: with them all counts are whole."""

    def __init__(self, words: list[bytes], c: np.ndarray, more: list[tuple[bytes, int]], before: bytes | None):
        low = sorted(x for x in more if x[0] < words[0])
        high = sorted(x for x in more if x[0] > words[0])
        every = [w for w, _ in low] + words + [w for w, _ in high]
        n = np.concatenate([[x for _, x in low], c, [x for _, x in high]]).astype(np.int64)
        lengths = np.array([len(w) for w in every], np.int64)
        raw, start = np.frombuffer(b"".join(every), np.uint8), np.cumsum(lengths) - lengths
        common = np.full(len(every), -1, np.int32)
        common[1:] = common_bits(raw, start, np.arange(len(every) - 1), np.arange(1, len(every)))
        own, other = on_paths(lengths, *branches(n, common))
        mine = slice(len(low), len(low) + len(words))
        at = slice(start[mine][0], start[mine][-1] + lengths[mine][-1])
        self.words, self.c, self.lengths = words, c, lengths[mine]
        self.start = start[mine] - at.start
        self.own, self.other = own[at], other[at]
        self.places = Places([w[:-1] for w in words])
        shared = 0  # edges of the first word that an earlier chunk has
        while before is not None and before[shared] == words[0][shared]:
            shared += 1
        place = np.arange(len(self.places.byte)) - np.repeat(self.start, self.lengths)
        begun = common[mine] >> 3  # bytes shared with the word before
        begun[0] = 0
        self.which, some, j = np.arange(len(place)), np.arange(len(words)), 0
        while len(some):  # an edge is the first word's that goes along it
            first = np.maximum.accumulate(np.where(begun[some] <= j, np.arange(len(some)), 0))
            self.which[self.start[some] + j] = self.start[some[first]] + j
            j += 1
            some = some[self.lengths[some] > j]
        new = self.which == np.arange(len(place))
        self.edge, self.which = np.flatnonzero(new), (np.cumsum(new) - 1)[self.which]
        self.earlier = (self.edge < self.lengths[0]) & (place[self.edge] < shared)

    def edges(self, near: Near, own: bool, all_edges: bool = False) -> Edges:
        """All edges, or those in training that no earlier chunk has."""
        at = self.edge if all_edges else self.edge[~self.earlier & (self.own[self.edge, 7] > 0)]
        x, byte = self.places, self.places.byte[at]
        n, other = self.own[at], self.other[at].astype(np.float32)
        one, c = _ones(byte), n[:, 7].astype(np.int64)
        n = (np.maximum(n - 1, 0) if own else n).astype(np.float32)
        y = np.log((n + np.float32(0.4)) / (other + np.float32(0.4)))
        return Edges(x.parent[at], x.place[at], byte.astype(np.int32), c, [*near.odds(x.last[at], byte, own), np.where(one, y, -y)], n + other)

    def paths(self, near: Near) -> tuple:
        """All edges that no earlier chunk has: prefix, place, byte, training count and how often 0 and 1 followed, by context."""
        at = self.edge[~self.earlier]
        x, byte = self.places, self.places.byte[at]
        f = np.stack([*near(x.last[at], byte), _zero_one(byte, self.own[at], self.other[at])], axis=1)
        return x.parent[at], x.place[at], byte.astype(np.int32), self.own[at, 7].astype(np.int64), f


class Vocabulary:
    """All words in order, a row for each ``CHUNK`` of them, and what their tasks need to know of the others."""

    def __init__(self, words: DataFrame):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n = TaskContext.get().partitionId(), 0
            for batch in _gathered(batches, CHUNK):
                for lo in range(0, batch.num_rows, CHUNK):
                    some = batch.slice(lo, CHUNK)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part << 24 | n]), pa.array([b"".join(some.column(0).to_pylist())], pa.binary()),
                         pa.array([some.column(1).to_numpy().astype(np.int64).tobytes()], pa.binary())], ["chunk", "words", "c"])
                    n += 1

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts of the bytes after each beginning of the first and of the last word."""
            for batch in batches:
                for chunk, text, c in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                    some, c = _split(text), np.frombuffer(c, np.int64)
                    some = [w + b" " for w in some]
                    upto = np.concatenate([[0], np.cumsum(c)])
                    out, done = {}, set()
                    for w in (some[0], some[-1]):
                        lo, hi = 0, len(some)
                        for j in range(len(w)):
                            lo = bisect.bisect_left(some, w[:j], lo, hi)
                            hi = bisect.bisect_left(some, w[:j] + PAST, lo, hi)
                            x = hi if w[:j] in done else lo
                            done.add(w[:j])
                            while x < hi:
                                y = bisect.bisect_left(some, some[x][:j + 1] + PAST, x, hi)
                                out[some[x][:j + 1]] = int(upto[y] - upto[x])
                                x = y
                    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())],
                                                     ["begin", "c"])

        def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, text, c in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                    last = text.rfind(b" ", 0, len(text) - 1) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([text[:text.index(b" ") + 1]], pa.binary()),
                                                      pa.array([text[last:]], pa.binary()), pa.array([int(np.frombuffer(c, np.int64).sum())])],
                                                     ["chunk", "first", "last", "tokens"])

        spark = words.sparkSession
        closed = words.select(F.concat("w", F.lit(b" ")).alias("w"), "c")
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = cut(closed.repartitionByRange(n, "w").sortWithinPartitions("w").mapInArrow(rows, "chunk long, words binary, c binary"))
        with batch_rows(spark, 4):
            self._neighbours(borders, ends)

    def _neighbours(self, borders, ends) -> None:
        got = sorted(tuple(r) for r in self.table.mapInArrow(borders, "chunk long, first binary, last binary, tokens long").collect())
        self.borders = [(k, bytes(a), bytes(b)) for k, a, b, _ in got]
        self.tokens = {k: n for k, _, _, n in got}
        counts = {bytes(r["begin"]): r["c"] for r in self.table.mapInArrow(ends, "begin binary, c long").groupBy("begin")
                  .agg(F.sum("c").alias("c")).collect()}
        after: dict[bytes, list[int]] = {}
        for x in counts:
            after.setdefault(x[:-1], []).append(x[-1])
        self.more = {}
        for k, first, last in self.borders:
            found = {first[:j] + bytes([b]) for j in range(len(first)) for b in after.get(first[:j], ()) if b < first[j]}
            found |= {last[:j] + bytes([b]) for j in range(len(last)) for b in after.get(last[:j], ()) if b > last[j]}
            self.more[k] = [(x, counts[x]) for x in found]
        self.before = {k: b for (k, _, _), b in zip(self.borders, [None, *[x[2] for x in self.borders]])}
        more, before = self.more, self.before

        def chunk(k: int, text: bytes, c: bytes) -> Chunk:
            return Chunk([w + b" " for w in _split(text)], np.frombuffer(c, np.int64), more[k], before[k])

        def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    x = Places(_split(text))
                    key, which = np.unique(x.last.astype(np.int64) << 8 | x.byte, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.bincount(which, np.repeat(np.frombuffer(c, np.int64), x.lengths), len(key)).astype(np.int64))],
                        ["key", "c"])

        got = self.table.mapInArrow(trigrams, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toPandas()
        key = got["key"].to_numpy(np.int64)
        self.grams = (key >> 8).astype(np.int32), (key & 0xFF).astype(np.uint8), got["c"].to_numpy(np.int64)
        self.chunk = chunk

    def make(self, made):
        """``made`` of each chunk of the table's rows."""
        grams, chunk = self.grams, self.chunk

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
            near = None
            for batch in batches:
                for row in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                    near = near or Near(*grams)
                    yield made(chunk(*row), near)

        return run

    def edges(self):
        """Turns rows of the table into edges in training, each of them once."""
        return self.make(lambda chunk, near: chunk.edges(near, True))


def inputs(words: DataFrame) -> DataFrame:
    """``parent, place, byte, c, f`` of each trie edge; ``f`` has the paths of its contexts,
    ``[context, bit, 0 or 1]``: last byte, two bytes, three bytes, prefix."""
    known = Vocabulary(words)
    paths = known.make(lambda chunk, near: chunk.paths(near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *columns, f in paths(batches):
            ends = pa.py_buffer((np.arange(len(f) + 1) * 256).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.Array.from_buffers(pa.binary(), len(f), [None, ends, pa.py_buffer(f.tobytes())])],
                ["parent", "place", "byte", "c", "f"])

    return known.table.mapInArrow(run, "parent long, place int, byte int, c long, f binary")


# Rows with many values travel as packed arrays: one row holds the pairs of some thousand texts or words.

FLUSH = 1_000_000  # tokens that a task puts in order together
BUCKET = 600_000  # training tokens whose tries are built together
FREQUENT = 1_000_000  # what follows a token with more occurrences is parted by its first two bytes
PAIRS = 500_000  # pairs in a row of the last table
SOME = 30_000  # pairs that are scored together
HOT = 8_000_000  # training tokens of a chunk whose pairs go to one task
PACKED = "words binary, each binary, c binary, n binary, k binary, t binary, leaves binary, refs binary, hi binary, lo binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _zip(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def _unzip(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0 up."""
    size = next(d for d in (1, 2, 4, 8) if d == 8 or x.max(initial=0) < 1 << 8 * d)
    return bytes([size]) + _zip(x.astype(f"<u{size}").tobytes())


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(_unzip(b[1:]), f"<u{b[0]}").astype(np.int64)


def _row(keys: dict[str, int], **packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in keys.values()]
                                      + [pa.array([packed.get(n)], pa.binary()) for n in NAMES], [*keys, *NAMES])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin[0], begin[0] + 1, ...``, ``n[0]`` of them, and so on."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Frequent:
    """Tokens with so many behind them that one task is not to build their trie.  What follows one of them lies in parts, by the two first
    bytes (a blank closes a word of one).  The beginning of the paths, alike in a part, comes from counts of the parts: ``n`` tokens in
    all, and ``k`` times others leave the path, ``leaves`` at bit ``t``."""

    def __init__(self, docs: DataFrame, words: DataFrame):
        found = [bytes(r["w"]) for r in words.where(F.col("c") > FREQUENT).select("w").collect()]
        self.hashes = np.sort(hashes(found)) if found else np.zeros(0, np.int64)
        number = {w: i for i, w in enumerate(found)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[int] = Counter()
            for batch in batches:
                for text, held in zip(batch.column(0), batch.column(1).to_pylist()):
                    ws = tokens(text.as_py())
                    at = [(i, w) for i, w in zip(map(number.get, [END, *ws]), ws) if i is not None]
                    keys = [i << 16 | x for (i, _), x in zip(at, _two([w for _, w in at]).tolist())]
                    seen.update(dict.fromkeys(keys, 0) if held else keys)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["k", "c"])

        key, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if found:
            got = docs.select("text", "held_out").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas().sort_values("k")
            key, c = got["k"].to_numpy(np.int64), got["c"].to_numpy(np.int64)
        common = np.full(len(key), -1, np.int32)
        same = np.flatnonzero(key[1:] >> 16 == key[:-1] >> 16) + 1
        x = key[same] ^ key[same - 1]
        common[same] = np.where(x >> 8 > 0, LEAD[x >> 8], 8 + LEAD[x & 0xFF])
        n, item, t, leaves = branches(c, common)
        part = edge(hashes(found)[key >> 16], key & 0xFFFF) if found else key
        order = np.argsort(part)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((t, place[item]))
        self.parts, self.n, self.k, self.t, self.leaves = (
            part[order], n[order], np.bincount(item, minlength=len(key))[order], t[by].astype(np.uint8), leaves[by])

    def begin(self, groups: np.ndarray, n: np.ndarray, item: np.ndarray, t: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, ...]:
        """``branches`` of pairs with the beginnings of those in parts."""
        if not len(self.parts):
            return n, item, t, leaves
        at = np.minimum(np.searchsorted(self.parts, groups), len(self.parts) - 1)
        mine = np.flatnonzero(self.parts[at] == groups)
        at = at[mine]
        n = n.copy()
        n[mine] = self.n[at]
        more = _spread((np.cumsum(self.k) - self.k)[at], self.k[at])
        return (n, np.concatenate([item, np.repeat(mine, self.k[at])]).astype(np.int64), np.concatenate([t, self.t[more]]).astype(np.int64),
                np.concatenate([leaves, self.leaves[more]]).astype(np.int64))


def _two(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([(w + b" ")[:2] for w in words]), ">u2").astype(np.int64)


def pairs(docs: DataFrame, n_buckets: int, frequent: Frequent) -> DataFrame:
    """Pairs of tokens in a row, by buckets of the first one (or of its part); ``c`` counts training, ``refs`` all texts that have
    the pair, ``lo`` names them (once for each time), with ``hi``.  Another kind of rows (2) has the texts themselves."""
    often = frequent.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flushes = TaskContext.get().partitionId(), 0
        every, lengths, sizes, ids, held = [], [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            hi, n = part << 12 | flushes, np.array(lengths, np.int64)
            yield _row({"bucket": hi % n_buckets, "kind": 2, "at": hi}, refs=_pack(n), n=_pack(np.array(sizes, np.int64)),
                       c=_pack(np.array(held, np.int64)), k=_pack(np.array([i is None for i in ids], np.int64)),
                       t=np.array([i or 0 for i in ids], np.int64).tobytes())
            seen: defaultdict[bytes, int] = defaultdict()
            seen.default_factory = seen.__len__  # numbers of new words
            w = np.fromiter(map(seen.__getitem__, every), np.int64, len(every))
            names = list(seen)
            b = np.empty_like(w)
            b[1:] = w[:-1]
            b[np.cumsum(n) - n] = seen[END]  # a text begins after an end
            h = hashes(names)
            at = np.flatnonzero(np.isin(h, often)[b])
            parts, which = np.unique(b[at] << 16 | _two(names)[w[at]], return_inverse=True)
            b[at] = len(names) + which
            h = np.concatenate([h, edge(h[parts >> 16], parts & 0xFFFF)])
            bucket = (h.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            by = np.lexsort((h, bucket))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            key = place[b] * len(names) + w
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            text = np.repeat(np.arange(len(n)), n)[order]
            c = np.add.reduceat(np.repeat(1 - np.array(held, np.int64), n)[order], first)
            refs = np.diff(np.append(first, len(key)))
            b, w = np.divmod(key[first], len(names))
            cuts = np.searchsorted(bucket[by[b]], np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[k], cuts[k + 1])
                some, which = np.unique(w[at], return_inverse=True)
                new = np.flatnonzero(np.concatenate([[True], b[at][1:] != b[at][:-1]]))
                yield _row({"bucket": int(k), "kind": 1, "at": hi}, words=_zip(b"".join([names[x] + b" " for x in some])), each=_pack(which),
                           t=h[by[b[at][new]]].tobytes(), n=_pack(np.diff(np.append(new, at.stop - at.start))), c=_pack(c[at]),
                           refs=_pack(refs[at]), lo=_pack(text[first[at.start]:first[at.start] + int(refs[at].sum())]))

        for batch in batches:
            for i, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = tokens(text.as_py())
                every += found
                lengths.append(len(found))
                sizes.append(sum(map(len, found)) + len(found))
                ids.append(i)
                held.append(int(out))
                if len(every) >= FLUSH or len(lengths) == 1 << 16:
                    yield from flush()
                    flushes += 1
                    for x in (every, lengths, sizes, ids, held):
                        x.clear()
        if lengths:
            yield from flush()

    return (docs.select("doc_id", "text", "held_out").mapInArrow(run, "bucket long, kind long, at long, " + PACKED)
            .repartition(n_buckets, "bucket").sortWithinPartitions("bucket"))


def _paths_of(rows: list[dict], borders: list[bytes], chunks: list[int], salts: list[int], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """A bucket's pairs by chunks of the second word: ``n`` tokens follow the first one, and ``k`` times other words leave
    the pair's path behind it, ``leaves`` of them at bit ``t``."""
    lists = [[w + b" " for w in _split(_unzip(r["words"]))] for r in rows]
    names = sorted(set().union(*lists))
    rank = {w: i for i, w in enumerate(names)}
    w = np.concatenate([np.fromiter(map(rank.__getitem__, ws), np.int64, len(ws))[_unpack(r["each"])] for ws, r in zip(lists, rows)])
    b = np.concatenate([np.repeat(np.frombuffer(r["t"], np.int64), _unpack(r["n"])) for r in rows])
    c, refs = (np.concatenate([_unpack(r[k]) for r in rows]) for k in ("c", "refs"))
    lo = np.concatenate([_unpack(r["lo"]).astype(np.uint16) for r in rows])
    hi = np.repeat(np.array([r["at"] for r in rows], np.uint32), [len(_unpack(r["each"])) for r in rows])
    order = np.lexsort((w, b))
    texts = _spread((np.cumsum(refs) - refs)[order], refs[order])
    w, b, c, refs, hi, lo = w[order], b[order], c[order], refs[order], np.repeat(hi[order], refs[order]), lo[texts]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (b[1:] != b[:-1])]))
    w, b, c, refs = w[first], b[first], np.add.reduceat(c, first), np.add.reduceat(refs, first)
    lengths = np.array([len(x) for x in names], np.int64)
    raw, start = np.frombuffer(b"".join(names), np.uint8), np.cumsum(lengths) - lengths
    common = np.full(len(w), -1, np.int32)
    same = np.flatnonzero(b[1:] == b[:-1]) + 1
    common[same] = common_bits(raw, start, w[same - 1], w[same])
    n, item, t, leaves = frequent.begin(b, *branches(c, common))
    order = np.argsort(w, kind="stable")
    place = np.empty(len(w), np.int64)
    place[order] = np.arange(len(w))
    k = np.bincount(item, minlength=len(w))[order]
    by = np.lexsort((t, place[item]))
    t, leaves = t[by], leaves[by]
    texts = _spread((np.cumsum(refs) - refs)[order], refs[order])
    w, c, n, refs, hi, lo = w[order], c[order], n[order], refs[order], hi[texts], lo[texts]
    k_end, ref_end = np.cumsum(k), np.cumsum(refs)
    cuts = np.searchsorted(w, [bisect.bisect_left(names, x) for x in borders[1:]])
    for j, (lo_, hi_) in enumerate(zip([0, *cuts], [*cuts, len(w)])):
        for x in range(lo_, hi_, PAIRS):
            y = min(x + PAIRS, hi_)
            ks, rs = slice(k_end[x] - k[x], k_end[y - 1]), slice(ref_end[x] - refs[x], ref_end[y - 1])
            some, which = np.unique(w[x:y], return_inverse=True)
            yield _row({"chunk": chunks[j], "salt": rows[0]["bucket"] % salts[j], "kind": 1},
                       words=_zip(b"".join([names[z] for z in some])), each=_pack(which), c=_pack(c[x:y]), n=_pack(n[x:y]), k=_pack(k[x:y]),
                       t=_pack(t[ks]), leaves=_pack(leaves[ks]), refs=_pack(refs[x:y]), hi=_pack(hi[rs]), lo=_pack(lo[rs]))


def pair_paths(all_pairs: DataFrame, known: Vocabulary, frequent: Frequent, n_parts: int) -> DataFrame:
    """Rows of at most ``PAIRS`` pairs or a little more, each with the chunk that its second words are in: the chunk's ``words``
    and their training counts ``hi`` of them, then as in ``_paths_of``."""
    chunks, borders = [k for k, *_ in known.borders], [first for _, first, _ in known.borders]
    salts = [1 + known.tokens[k] // HOT for k in chunks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in _rows(batches):
            if r["kind"] == 2:
                r["chunk"] = -1 - r["at"]
                yield _row({"chunk": r["chunk"], "salt": 0, "kind": 2}, **{n: r[n] for n in NAMES})
                continue
            if held and held[0]["bucket"] != r["bucket"]:
                yield from _paths_of(held, borders, chunks, salts, frequent)
                held = []
            held.append(r)
        if held:
            yield from _paths_of(held, borders, chunks, salts, frequent)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, chunk, at = [], 0, None, {}

        def out() -> pa.RecordBatch:
            def joined(name: str) -> bytes:
                return _pack(np.concatenate([_unpack(r[name]) for r in held]))

            return _row({"chunk": chunk["chunk"], "kind": 1, "at": 0}, words=_zip(chunk["words"]), each=_pack(np.concatenate([r["each"] for r in held])),
                        **{x: joined(x) for x in NAMES[2:]}) , chunk["c"]

        for r in _rows(batches):
            if r["kind"] != 1 and held:
                yield _with_counts(*out())
                held, n = [], 0
            if r["kind"] == 0:
                chunk, at = r, {w: i for i, w in enumerate(_split(r["words"]))}
            elif r["kind"] == 2:
                yield _with_counts(_row({"chunk": r["chunk"], "kind": 2, "at": -1 - r["chunk"]}, **{x: r[x] for x in NAMES}), None)
            else:
                where = np.fromiter(map(at.__getitem__, _split(_unzip(r["words"]))), np.int64)
                r["each"] = where[_unpack(r["each"])]
                held.append(r)
                n += len(r["each"])
                if n >= PAIRS:
                    yield _with_counts(*out())
                    held, n = [], 0
        if held:
            yield _with_counts(*out())

    keys = "chunk long, salt long, kind long, "
    found = all_pairs.mapInArrow(run, keys + PACKED)
    empty = [F.lit(None).cast("binary").alias(n) for n in NAMES if n not in ("words", "c")]
    salted = F.udf(lambda k, s=dict(zip(chunks, salts)): list(range(s[k])), "array<long>")
    words = known.table.select("chunk", F.explode(salted("chunk")).alias("salt"), F.lit(0).cast("long").alias("kind"), "words", "c", *empty)
    return cut(found.unionByName(words).repartition(n_parts, "chunk", "salt").sortWithinPartitions("chunk", "salt", "kind")
               .mapInArrow(merge, "chunk long, kind long, at long, " + PACKED + ", counts binary"))


def _with_counts(row: pa.RecordBatch, counts: bytes | None) -> pa.RecordBatch:
    return row.append_column("counts", pa.array([counts], pa.binary()))


class Scored:
    """Makes of a row of ``pair_paths``, some pairs at a time: the pairs, their places, and for these the place in the word, the bits,
    log odds of the four predictors, how often the own and the other bit followed the first token."""

    def __init__(self, known: Vocabulary, weights: np.ndarray, refine: np.ndarray, own: bool):
        self.grams, self.make, self.weights, self.refine, self.own, self.near = known.grams, known.chunk, weights, refine, own, None

    def chunk(self, r: dict) -> tuple[Chunk, np.ndarray]:
        self.near = self.near or Near(*self.grams)
        chunk = self.make(r["chunk"], _unzip(r["words"]), r["counts"])
        edges = chunk.edges(self.near, self.own, all_edges=True)
        mixed = np.empty((len(edges.c), 8), np.float32)
        for k, (_, _, gate, s) in enumerate(_bits(edges, self.weights)):
            p = _probability(gate, s, self.refine)
            mixed[:, k] = np.log(p / (1 - p))
        return chunk, mixed

    def pairs(self, r: dict, chunk: Chunk, mixed: np.ndarray, heads: np.ndarray) -> Iterator[tuple]:
        """Of each pair the first ``heads`` places, all after which no other word leaves its path or more."""
        w, n, k, t, leaves = (_unpack(r[x]) for x in ("each", "n", "k", "t", "leaves"))
        k_end = np.cumsum(k)
        for lo in range(0, len(w), SOME):
            some = slice(lo, lo + SOME)
            ks = slice(int(k_end[lo] - k[lo]), int(k_end[some][-1]))
            lengths = heads[some]
            at = _spread(chunk.start[w[some]], lengths)
            item = np.repeat(np.arange(len(lengths)), k[some])
            asked = lengths[item] > 0
            own, other = on_paths(lengths, n[some], item[asked], t[ks][asked], leaves[ks][asked])
            yield (some, lengths, chunk.places.place[at].astype(np.int64)[:, None], _ones(chunk.places.byte[at]), mixed[chunk.which[at]],
                   own.astype(np.float32), other.astype(np.float32))


def _heads(r: dict, chunk: Chunk, most: int) -> np.ndarray:
    """Places of each pair up to the last one where another word leaves its path; all of a pair with more than
    ``most`` occurrences.  The places after them are alike for all pairs of a word with the same count."""
    k, w, c = _unpack(r["k"]), _unpack(r["each"]), _unpack(r["c"])
    last = np.append(_unpack(r["t"]), 0)[np.cumsum(k) - 1]
    return np.where(c > most, chunk.lengths[w], np.where(k > 0, last // 8 + 1, 0))


STEPS = 193  # cells of log odds from -12 to 12


def learn_pairs(table: DataFrame, known: Vocabulary, weights: np.ndarray, refine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the second mixer, over all training occurrences of all pairs, each without itself.

    They are summed up once, in cells of gate, bit and both log odds (``STEPS`` for each); a cell counts as that many
    occurrences with its mean log odds."""
    scored, size = Scored(known, weights, refine, True), GATES * 2 * STEPS * STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, size))
        for r in _rows(batches):
            if r["kind"] != 1:
                continue
            c = _unpack(r["c"])
            if not c.any():
                continue
            chunk, mixed = scored.chunk(r)
            heads, w = _heads(r, chunk, 1), _unpack(r["each"])

            def add(times: np.ndarray, place: np.ndarray, one: np.ndarray, x: np.ndarray, y: np.ndarray, sure) -> None:
                cell = (((place * 4 + sure) * 2 + one) * STEPS + _step(x)) * STEPS + _step(y)
                cell, times = cell.ravel(), np.repeat(times, 8).astype(np.float64)
                out[0] += np.bincount(cell, times, size)
                out[1] += np.bincount(cell, times * x.ravel(), size)
                out[2] += np.bincount(cell, times * y.ravel(), size)

            # behind its head a pair that occurs once is told nothing by its other occurrences: summed up by edge
            once = np.flatnonzero(c == 1)
            tail = heads[once] < chunk.lengths[w[once]]
            begun = np.cumsum(np.bincount((chunk.start[w[once]] + heads[once])[tail], minlength=len(chunk.which)))
            begun -= np.repeat(np.concatenate([[0], begun])[chunk.start], chunk.lengths)
            times = np.bincount(chunk.which, begun)
            at = np.flatnonzero(times)
            first = chunk.edge[at]
            one = _ones(chunk.places.byte[first])
            add(times[at], chunk.places.place[first].astype(np.int64)[:, None], one, mixed[at], np.zeros_like(mixed[at]), 0)
            for some, lengths, place, one, x, own, other in scored.pairs(r, chunk, mixed, np.where(c > 0, heads, 0)):
                own -= 1
                y = np.log((own + np.float32(0.4)) / (other + np.float32(0.4)))
                add(np.repeat(c[some], lengths), place, one, x, np.where(one, y, -y), _sure(own + other))
        at = np.flatnonzero(out[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(v[at]) for v in out]], ["k", "c", "x", "y"])

    got = table.mapInArrow(run, "k long, c double, x double, y double").groupBy("k").agg(
        *[F.sum(n).alias(n) for n in "cxy"]).toPandas().sort_values("k")
    cell, c = got["k"].to_numpy(np.int64), got["c"].to_numpy(np.float64)
    x = np.stack([got["x"].to_numpy(np.float64) / c, got["y"].to_numpy(np.float64) / c, np.ones(len(c))], axis=1)
    gate, bit = cell // (2 * STEPS * STEPS), cell // (STEPS * STEPS) % 2
    start = np.tile((1.0, 0.3, 0.0), (GATES, 1))
    weights = start.copy()
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip((weights[gate] * x).sum(axis=1), -12, 12)))
        slopes = np.zeros((GATES, 4, 3))
        for g in np.unique(gate):
            at = np.flatnonzero(gate == g)
            slopes[g, 0] = (c[at] * (bit[at] - p[at])) @ x[at]
            slopes[g, 1:] = (x[at] * (c[at] * p[at] * (1 - p[at]))[:, None]).T @ x[at]
        weights = weights + _newton(slopes, weights - start)
    at = gate * BINS + _bin(np.clip((weights[gate] * x).sum(axis=1), -12, 12))
    hits, total = (np.bincount(at, v, GATES * BINS).reshape(GATES, BINS) for v in (c * bit, c))
    return weights.astype(np.float32), hits, total


def _step(x: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(x, -12, 12) + 12) * ((STEPS - 1) / 24)).astype(np.int64)


def text_sums(table: DataFrame, known: Vocabulary, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for each text: ``doc_id, held_out, n_tokens, n_bytes, n_known, base`` (log10 of the counts) and ``score``."""
    scored, (weights, refine) = Scored(known, *first, False), second

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score"]
        for r in _rows(batches):
            if r["kind"] == 2:
                n, none = _unpack(r["refs"]), _unpack(r["k"]).astype(bool)
                ids, zero = np.frombuffer(r["t"], np.int64), pa.array(np.zeros(len(n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["at"] << 16 | np.arange(len(n))), pa.array(ids, mask=none), pa.array(_unpack(r["c"]).astype(bool)), pa.array(n),
                     pa.array(_unpack(r["n"])), pa.array(np.zeros(len(n), np.int64)), zero, zero], names)
                continue
            chunk, mixed = scored.chunk(r)
            heads, w, c = _heads(r, chunk, 1), _unpack(r["each"]), _unpack(r["c"])

            def bits(place: np.ndarray, one: np.ndarray, x: np.ndarray, y: np.ndarray, sure) -> np.ndarray:
                gate = place * 4 + sure
                z = np.take(weights[:, 0], gate) * x
                z += np.take(weights[:, 1], gate) * y
                z += np.take(weights[:, 2], gate)
                p = _probability(gate, np.clip(z, -12, 12, out=z), refine)
                return np.log10(np.where(one, p, 1 - p)).sum(axis=1, dtype=np.float64)

            end, s = chunk.start + chunk.lengths, np.zeros(len(w))
            place, one = chunk.places.place[chunk.edge].astype(np.int64)[:, None], _ones(chunk.places.byte[chunk.edge])
            for n in (0, 1):  # behind their heads
                own = np.full(mixed.shape, np.log((n + 0.4) / 0.4), np.float32)
                upto = np.concatenate([[0.0], np.cumsum(bits(place, one, mixed, np.where(one, own, -own), int(n > 0))[chunk.which])])
                at = np.flatnonzero(c == n)
                s[at] = upto[end[w[at]]] - upto[chunk.start[w[at]] + heads[at]]
            for some, lengths, place, one, x, own, other in scored.pairs(r, chunk, mixed, heads):
                y = np.log((own + np.float32(0.4)) / (other + np.float32(0.4)))
                found = bits(place, one, x, np.where(one, y, -y), _sure(own + other))
                s[some] += np.bincount(np.repeat(np.arange(len(lengths)), lengths), found, len(lengths))
            refs, c = _unpack(r["refs"]), chunk.c[w]
            row, at = np.unique(_unpack(r["hi"]) << 16 | _unpack(r["lo"]), return_inverse=True)
            sums = [np.bincount(at, np.repeat(v, refs), len(row)) for v in ((c > 0).astype(np.float64), np.log10(c + 0.5), s)]
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), none, pa.nulls(len(row), pa.bool_()), none, none,
                                              pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names)

    found = table.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double")
    return cut(found.groupBy("row").agg(*[F.max(n).alias(n) for n in ("doc_id", "held_out", "n_tokens", "n_bytes")],
                                        *[F.sum(n).alias(n) for n in ("n_known", "base", "score")]))


def _sure(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int64) + (n > 2) + (n > 12)


def _bits(e: Edges, weights: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each of the 8 bits of the edges: the bit, log odds of the predictors and a one,
    gate, mixed log odds."""
    place = e.place.astype(np.int64) * 4
    for k in range(8):
        gate = place + _sure(e.n[k])
        yield (e.byte >> (7 - k) & 1).astype(np.float32), e.x[k], gate, np.clip(np.einsum("ij,ij->i", weights[gate], e.x[k]), -12, 12)


def _bin(s: np.ndarray) -> np.ndarray:
    return np.rint((s + 12) * ((BINS - 1) / 24)).astype(np.int64)


def _summed(table: DataFrame, run, size: int) -> np.ndarray:
    """Sums over all tasks of the ``size`` numbers that ``run`` makes of a task's batches."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(run(batches))], ["k", "v"])

    out = np.zeros(size)
    for r in table.mapInArrow(emit, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def learn(table: DataFrame, edges=Edges.rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixing weights, hits and totals by (gate, bin), over all training occurrences of the edges
    that ``edges`` makes of the table's rows."""
    first = (0.3,) * CONTEXTS + (0.0,)
    width = len(first)
    start = np.tile(first, (GATES, 1))
    weights, one = start.copy(), width * (width + 1)

    def slopes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((GATES, width + 1, width))
        for e in edges(batches):
            c = e.c.astype(np.float64)
            for bit, x, gate, s in _bits(e, weights.astype(np.float32)):
                p = 1 / (1 + np.exp(-s.astype(np.float64)))
                err, bend = c * (bit - p), c * p * (1 - p)
                for g in np.unique(gate):
                    at = np.flatnonzero(gate == g)
                    y = x[at].astype(np.float64)
                    out[g, 0] += err[at] @ y
                    out[g, 1:] += (y * bend[at, None]).T @ y
        return out.ravel()

    for _ in range(ROUNDS):
        got = _summed(table, slopes, GATES * one).reshape(GATES, width + 1, width)
        weights = weights + _newton(got, weights - start)

    def worth(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, GATES * BINS))
        for e in edges(batches):
            c = e.c.astype(np.float64)
            for bit, _, gate, s in _bits(e, weights.astype(np.float32)):
                at = gate * BINS + _bin(s)
                out[0] += np.bincount(at, c * bit, GATES * BINS)
                out[1] += np.bincount(at, c, GATES * BINS)
        return out.ravel()

    hits, total = _summed(table, worth, 2 * GATES * BINS).reshape(2, GATES, BINS)
    return weights.astype(np.float32), hits, total


def _newton(got: np.ndarray, away: np.ndarray) -> np.ndarray:
    """A step by gradients and second derivatives of each gate, drawn back to where the weights began."""
    step = np.linalg.solve(got[:, 1:] + np.eye(got.shape[2]), (got[:, 0] - away)[:, :, None])[:, :, 0]
    return np.clip(step, -0.5, 0.5)


def refined(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    centre = 1 / (1 + np.exp(-(np.arange(BINS) * 24 / (BINS - 1) - 12)))
    return ((hits + 20 * centre) / (total + 20)).astype(np.float32)


def _probability(gate: np.ndarray, s: np.ndarray, refine: np.ndarray) -> np.ndarray:
    return 0.5 / (1 + np.exp(-s)) + 0.5 * refine[gate, _bin(s)]


def edge_scores(table: DataFrame, weights: np.ndarray, refine: np.ndarray) -> DataFrame:
    """``e, s``: key and log10 probability of each edge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges in Edges.rows(batches, own=False):
            total = np.zeros(len(edges.c))
            for bit, _, gate, s in _bits(edges, weights):
                p = _probability(gate, s, refine)
                total += np.log10(np.where(bit > 0, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(edge(edges.parent, edges.byte)), pa.array(total)], ["e", "s"])

    return table.mapInArrow(run, "e long, s double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte``.

    Training documents are those whose crc32 of the id in decimal digits, modulo
    ``folds``, is not ``held_fold`` (a null id counts as the empty text).  A null text
    is empty and has its end as the only token.  Without training documents all counts
    are 0 and the predictors say one half.  Repeated rows come out repeated.
    """
    small_batches(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
                    (fold == held_fold).alias("held_out"))
    spark = docs.sparkSession
    words = vocabulary(d)
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    denominator = total + 0.5 * (kinds + 1)
    if words.isEmpty():  # no documents
        return d.select("doc_id", "held_out", *[F.lit(0).cast("long").alias(n) for n in ("n_tokens", "n_known", "train_tokens")],
                        *[F.lit(0.0).alias(n) for n in ("base_score", "score", "bits_per_byte")])
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET + 1)
    known = Vocabulary(words)
    with batch_rows(spark, 4):  # rows of packed arrays
        weights, hits, worth = learn(known.table, known.edges())
        first = weights, refined(hits, worth)
    frequent = Frequent(d, words)
    with batch_rows(spark, 32):
        table = pair_paths(pairs(d, n_parts, frequent), known, frequent, n_parts)
    with batch_rows(spark, 1):
        weights, hits, worth = learn_pairs(table, known, *first)
        rows = text_sums(table, known, first, (weights, refined(hits, worth)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(denominator))).alias("base_score"), "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
