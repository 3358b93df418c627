"""Token ids as one wavelet matrix per shard.

A wavelet matrix keeps a sequence of ids as bit-planes, the highest bit first.
Each plane moves the ids whose bit is 0 before those whose bit is 1, both in order,
so that rank and select on the planes reach any place of any plane below.  The
planes alone give access to a place, the count of an id up to a place, and the
place of its k-th occurrence; nothing else of the ids is stored.

A shard is a run of documents in ascending id order.  Its file is one Parquet file
with one row: document ids, where each document ends, and the planes with their
rank counts, compressed.  Parquet keeps the format readable through every store
that Spark can open.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsmith.llm.align import CHUNK, LONG_SPACE, ODD_SPACE
from tabsmith.llm.common import text_of

BLOCK = 512  # bits between stored rank counts
SHARD_BYTES = 16 << 20  # text a shard aims at
CACHE_ENTRIES = 600_000

#: The characters that ``\s`` stands for in the tokenizers' patterns.
SPACES = "\t-\r \x85\xa0  -     　"


class WaveletMatrix:
    """Succinct sequence of ids below ``2 ** bits``."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.bits = n, zeros, len(planes)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        ids = pa.array(np.ascontiguousarray(ids, np.uint32 if bits > 16 else np.uint16))
        zeros, planes, ranks, n = [], [], [], len(ids)
        for level in range(bits - 1, -1, -1):
            values = ids.to_numpy()
            packed = np.packbits(values & values.dtype.type(1 << level) != 0, bitorder="little")
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8)))).reshape(-1, BLOCK // 8)
            ranks.append(np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.int64))]).astype("<u4").tobytes())
            planes.append(packed.tobytes())
            low, high = (ids.filter(pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(mask)]))
                         for mask in (~packed, packed))
            zeros.append(len(low))
            ids = pa.concat_arrays([low, high])
        return cls(n, zeros, planes, ranks)

    def _rank1(self, level: int, at: int) -> int:
        """Ones of the plane before place ``at``."""
        block = at // BLOCK
        part = np.unpackbits(self.planes[level][block * BLOCK // 8:(at + 7) // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(part[:at - block * BLOCK].sum())

    def access(self, at: int) -> int:
        """The id at place ``at``."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][at // 8] >> (at % 8)) & 1
            ones = self._rank1(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, upto: int) -> tuple[int, int]:
        lo, hi = 0, min(upto, self.n)
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, upto: int) -> int:
        """How often ``value`` stands before place ``upto``."""
        lo, hi = self._range(value, upto)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``value``."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            at = self._select_bit(level, at - self.zeros[level] if value >> (self.bits - 1 - level) & 1 else at,
                                  value >> (self.bits - 1 - level) & 1)
        return at

    def _select_bit(self, level: int, k: int, bit: int) -> int:
        ones = self.ranks[level]
        if bit:
            block = int(np.searchsorted(ones, k, "right")) - 1
            k -= int(ones[block])
        else:
            blanks = np.minimum(np.arange(len(ones), dtype=np.int64) * BLOCK, self.n) - ones
            block = int(np.searchsorted(blanks, k, "right")) - 1
            k -= int(blanks[block])
        begin = block * BLOCK
        part = np.unpackbits(self.planes[level][begin // 8:begin // 8 + BLOCK // 8], bitorder="little")
        return begin + int(np.flatnonzero(part[:self.n - begin] == bit)[k])

    def sequence(self) -> np.ndarray:
        """All ids in order: undo the planes from the lowest bit up."""
        out = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], bitorder="little", count=self.n).astype(bool)
            above = np.empty_like(out)
            above[~bit] = out[:self.zeros[level]]
            above[bit] = out[self.zeros[level]:] | out.dtype.type(1 << (self.bits - 1 - level))
            out = above
        return out


#: The pattern of byte-level tokenizers that cut by their own regular expression.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for
    itself, all others in order from U+0100."""
    out, beyond = {}, 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out[chr(b if plain else beyond)] = b
        beyond += not plain
    return out


def ranked_encoder(spec: bytes):
    """A tiktoken encoder with the ids of a byte-level BPE specification, or None where merging by
    id would differ: another kind of model, other cutting, or merges out of id order."""
    import tiktoken
    told = json.loads(spec)
    model, cutter = told["model"], told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or told.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") \
            or not cutter.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, of = model["vocab"], _byte_alphabet()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    special = {t["content"] for t in told.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in token): k for token, k in vocab.items() if token not in special}
    if not all(bytes([b]) in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class CachedTokenizer:
    """A ``tokenizers`` tokenizer that encodes text piece by piece, each different piece once.

    A piece is a run of white space with the run of other characters after it.  No
    word of a byte-level pattern goes on from other characters into white space, nor
    from letters or digits into punctuation, so pieces, and their punctuation at the
    end, can be encoded for themselves.
    """

    def __init__(self, spec: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_str(spec.decode("utf-8"))
        self.lib.no_padding()
        self.lib.no_truncation()
        self.cut = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.pieces: dict[str, bytes] = {}
        self.bodies: dict[str, bytes] = {}

    @staticmethod
    def _parts(piece: str) -> tuple[str, str]:
        body = piece.rstrip(".,;:!?")
        if body and body[-1] < "\u0250" and body[-1].isalnum():
            return body, piece[len(body):]
        return piece, ""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        for cache in (self.pieces, self.bodies):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        cuts = [self.cut(t) for t in texts]
        found = [list(map(self.pieces.get, ps)) for ps in cuts]
        new = {p: self._parts(p) for ps, f in zip(cuts, found) if None in f for p, x in zip(ps, f) if x is None}
        bodies = self.bodies
        bodies[""] = b""
        unknown = list({b for bt in new.values() for b in bt if b not in bodies})
        for k in range(0, len(unknown), 4096):
            some = unknown[k:k + 4096]
            for b, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)):
                bodies[b] = array("I", e.ids).tobytes()
        fresh = {p: bodies[b] + bodies[t] for p, (b, t) in new.items()}
        out = [b"".join(f) if None not in f else b"".join([fresh[p] if x is None else x for p, x in zip(ps, f)])
               for ps, f in zip(cuts, found)]
        self.pieces.update((p, x) for p, x in fresh.items() if len(p) < 64)
        for b in unknown:
            if len(b) >= 64:
                del bodies[b]
        return out


SPACE_MEETS_BLANK = re.compile(r"\s(?: |\Z)")
SPACES_IN_A_ROW = re.compile(r"\s{4}")
ASCII_ODD_SPACES = [c + " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"]


def odd_space(text: str) -> bool:
    """Whether ``ODD_SPACE`` is in the text."""
    if text.isascii():
        return any(x in text for x in ASCII_ODD_SPACES)
    return ODD_SPACE.search(text) is not None


def long_space(text: str) -> bool:
    """Whether ``LONG_SPACE`` is in the text: of 1000 characters in a row, four stand at multiples of 250."""
    return len(text) >= 1000 and SPACES_IN_A_ROW.search(text[::250]) is not None and LONG_SPACE.search(text) is not None


class RankedTokenizer(CachedTokenizer):
    """The same ids for byte-level vocabularies, with each different chunk merged by tiktoken.

    A chunk is a blank and what follows up to the next blank after a character that is not white
    space; no word of the pattern reaches over its borders.  Texts with a special token or a very
    long run of white space go the library's way."""

    def __init__(self, spec: bytes, ranked):
        super().__init__(spec)
        self.ranked = ranked
        self.size = np.zeros(ranked.n_vocab, np.int64)
        for token, k in ranked._mergeable_ranks.items():
            self.size[k] = len(token)
        self.added = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.forget()

    def forget(self) -> None:
        self.numbers: tuple = tuple(defaultdict(count().__next__) for _ in range(2))   # of chunks at the start, and of others
        self.held = [(np.zeros(0, np.uint32), np.zeros(1, np.int64)) for _ in range(2)]
        self.uses = np.zeros(0, np.int64)       # of chunks that are not at the start

    def trim(self) -> None:
        """Forget chunks met once; if most were met more often, those below twice, four times as often."""
        names, (ids, upto), uses, least = list(self.numbers[1]), self.held[1], self.uses, 2
        while (uses >= least).sum() > CACHE_ENTRIES // 2:
            least *= 2
        kept = np.flatnonzero(uses >= least)
        self.forget()
        number = self.numbers[1]
        for k in kept.tolist():
            number[names[k]]
        n = upto[kept + 1] - upto[kept]
        at = np.arange(n.sum()) + np.repeat(upto[kept] - (np.cumsum(n) - n), n)
        self.held[1] = ids[at], np.concatenate([[0], np.cumsum(n)])
        self.uses = uses[kept]

    def _add(self, which: int, new: list[str]) -> None:
        lead = " " * which
        ids, counts = [], []
        for k in range(0, len(new) if which else 0, 256):
            some = new[k:k + 256]
            joined = " " + " ".join(some)
            if SPACE_MEETS_BLANK.search(joined):
                alone = [self.ranked.encode_ordinary(lead + c) for c in some]
                ids += alone
                counts += map(len, alone)
                continue
            mine = np.array(self.ranked.encode_ordinary(joined), np.int64)
            if joined.isascii():
                sizes = list(map(len, some))
            else:
                sizes = list(map(len, map(str.encode, some)))
            borders = np.cumsum(sizes) + np.arange(1, len(some) + 1)
            ids.append(mine)
            counts += np.diff(np.searchsorted(np.cumsum(self.size[mine]), borders), prepend=-1).tolist()
        if not which:
            ids = [self.ranked.encode_ordinary(c) for c in new]
            counts = list(map(len, ids))
        old, upto = self.held[which]
        flat = np.concatenate([np.asarray(i, np.uint32) for i in ids]) if ids else np.zeros(0, np.uint32)
        self.held[which] = np.concatenate([old, flat]), np.concatenate([upto, upto[-1] + np.cumsum(counts, dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {k for k, t in enumerate(texts) if any(a in t for a in self.added) or long_space(t)}
        slow = dict(zip(sorted(odd), super().encode([texts[k] for k in sorted(odd)]))) if odd else {}
        if sum(map(len, self.numbers)) > CACHE_ENTRIES:
            self.trim()
        first, other = self.numbers
        before = len(first), len(other)
        starts, codes = [], []
        for k, text in enumerate(texts):
            if not text or k in odd:
                starts.append(-1), codes.append(())
                continue
            parts = text.split(" ")
            if "" in parts or odd_space(text):
                parts = CHUNK.findall(" " + text)
            starts.append(first[parts[0]])
            codes.append(list(map(other.__getitem__, islice(parts, 1, None))))
        for which in (0, 1):
            if len(self.numbers[which]) > before[which]:
                self._add(which, list(islice(self.numbers[which], before[which], None)))
        sizes = list(map(len, codes))
        rest = np.fromiter(chain.from_iterable(codes), np.int64, sum(sizes))
        used = np.bincount(rest, minlength=len(other))
        used[:len(self.uses)] += self.uses
        self.uses = used
        ids, upto = self.held[1]
        n = upto[rest + 1] - upto[rest]
        flat = ids[np.arange(n.sum()) + np.repeat(upto[rest] - (np.cumsum(n) - n), n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes])]
        heads, at = self.held[0]
        out = []
        for k, c in enumerate(starts):
            if k in odd:
                out.append(slow[k])
            else:
                head = heads[at[c]:at[c + 1]].tobytes() if c >= 0 else b""
                out.append(head + flat[ends[k]:ends[k + 1]].tobytes())
        return out


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer_of(spec: bytes) -> CachedTokenizer:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        ranked = ranked_encoder(spec)
        _TOKENIZERS[key] = CachedTokenizer(spec) if ranked is None else RankedTokenizer(spec, ranked)
    return _TOKENIZERS[key]


SHARD_SCHEMA = ("shard int, n_ids long, n_docs long, doc_ids binary, doc_nulls binary, ends binary, "
                "zeros array<long>, planes array<binary>, ranks array<binary>")
TEXTS_AT_ONCE = 2 << 20


def write_shards(docs: DataFrame, path: str, spec: bytes, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, append ``end_id``, and write one wavelet matrix per shard to ``path``.

    Documents come in ascending id order, null ids first; rows that repeat an id come
    by text.  Null texts are empty, so they have the end id only.  An empty table
    writes no shard.  Memory of a task: its shard's ids and one document.
    """
    ids_in_use = Tokenizer.from_str(spec.decode("utf-8")).get_vocab_size(with_added_tokens=True)
    bits = max(ids_in_use, end_id + 1).bit_length()
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    n_shards = max(1, -(-size // shard_bytes))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(spec)
        width = np.uint32 if bits > 16 else np.uint16
        doc_ids, nulls, counts, runs, shard = [], [], [], [], None
        for batch in batches:
            shard = batch.column(2)[0].as_py() if shard is None and batch.num_rows else shard
            ids = batch.column(0)
            nulls.append(np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8))
            doc_ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            begin = 0
            lengths = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)))
            while begin < batch.num_rows:  # some texts at a time
                done = lengths[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(lengths, done + TEXTS_AT_ONCE)))
                for raw in tok.encode(batch.column(1).slice(begin, stop - begin).to_pylist()):
                    runs.append(np.append(np.frombuffer(raw, "<u4"), end_id).astype(width))
                    counts.append(len(runs[-1]))
                begin = stop
        if not counts:
            return
        matrix = WaveletMatrix.build(np.concatenate(runs), bits)
        del runs
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "n_ids": pa.array([matrix.n], pa.int64()),
            "n_docs": pa.array([len(counts)], pa.int64()),
            "doc_ids": [np.concatenate(doc_ids).tobytes()],
            "doc_nulls": [np.packbits(np.concatenate(nulls)).tobytes()],
            "ends": [np.cumsum(counts).astype("<i8").tobytes()],
            "zeros": pa.array([matrix.zeros], pa.list_(pa.int64())),
            "planes": pa.array([[p.tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
            "ranks": pa.array([[r.tobytes() for r in matrix.ranks]], pa.list_(pa.binary()))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    rows.mapInArrow(build, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _matrix(row) -> WaveletMatrix:
    return WaveletMatrix(row["n_ids"], row["zeros"], row["planes"], row["ranks"])


def open_shard(spark: SparkSession, path: str, shard: int) -> WaveletMatrix:
    """One shard's matrix, for lookups in the driver."""
    return _matrix(spark.read.parquet(path).where(F.col("shard") == shard).first())


def shard_starts(shards: DataFrame) -> DataFrame:
    """``shard, start``: ids in all shards before.  Running sums over blocks of 1024
    shards, then over the blocks' totals."""
    t = shards.select("shard", "n_ids", F.expr("shard div 1024").alias("_block"))
    inner = Window.partitionBy("_block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("_block").agg(F.sum("n_ids").alias("_n")).select(
        "_block", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_base"))
    return t.withColumn("_in", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(blocks, "_block").select(
        "shard", (F.col("_base") + F.col("_in")).alias("start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids`` (binary, unsigned
    32-bit), where ``start`` counts the ids of all documents before it."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seq = _matrix(row).sequence()
                ends = np.frombuffer(row["ends"], "<i8")
                begins = np.concatenate([[0], ends[:-1]])
                null = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8), count=row["n_docs"]).astype(bool)
                ids = np.frombuffer(row["doc_ids"], "<i8")
                for k in range(0, len(ends), 1000):
                    part = slice(k, k + 1000)
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([row["shard"]] * len(ends[part]), pa.int32()),
                        "doc_id": pa.array(ids[part], mask=null[part]),
                        "begin": pa.array(begins[part]), "n_tokens": pa.array((ends - begins)[part]),
                        "ids": pa.array([seq[b:e].astype("<u4").tobytes() for b, e in zip(begins[part], ends[part])],
                                        pa.binary())})

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    docs = shards.mapInArrow(expand, "shard int, doc_id long, begin long, n_tokens long, ids binary")
    return docs.join(F.broadcast(shard_starts(shards)), "shard").select(  # two numbers a shard: the ids stay where they are
        "doc_id", (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
