"""BPE encoding by backtracking, decoding by an offset table.

The encoder walks a word once.  An Aho-Corasick automaton over the vocabulary gives
the longest token at every place; a token may follow another only if the two are
compatible, that is if merging by rank would not have joined across the border.
Where they are not, the walk falls back to the next shorter token, and a border
that failed is never tried again, so the time is linear in the word.  The result
is that of applying the merges in order.

Normalising and cutting text into words is left to the tokenizer's own
specification, applied to each blank-separated piece of text once; pieces and words
repeat, so bounded caches hold their ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsmith.llm.common import small_batches, text_of

#: Entries a cache may hold; the results do not depend on it.
CACHE_ENTRIES = 250_000
#: Added to the code point of a word's last symbol when the vocabulary marks word ends.
END = 0x10000


class Recent:
    """A bounded cache of two halves.  New entries and those found in the older half go to the
    newer one; when that is full it becomes the older one, so what is met often stays."""

    def __init__(self) -> None:
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= CACHE_ENTRIES // 2:
            self.old, self.new = self.new, {}
        self.new[key] = value


class BpeModel:
    """A ``tokenizers`` specification of kind BPE, whose ids follow the order of its merges."""

    def __init__(self, spec: bytes):
        text = spec.decode("utf-8")
        d = json.loads(text)
        m = d["model"]
        if m["type"] != "BPE" or m.get("byte_fallback") or m.get("continuing_subword_prefix") or m.get("dropout"):
            raise ValueError("only plain BPE models are supported")
        lib = Tokenizer.from_str(text)
        self.normalizer, self.pre_tokenizer = lib.normalizer, lib.pre_tokenizer
        self.suffix = m.get("end_of_word_suffix") or ""
        self.ascii_words = self._ascii_words(d)
        self.ids = {self._inner(t): i for t, i in m["vocab"].items()}
        self._link(m)
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.special_mark = os.path.commonprefix(longest_first) if self.special else "\0" * 9
        self.words, self.pieces = Recent(), Recent()  # word -> ids (array), piece -> ids (bytes)
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _ascii_words(d: dict) -> regex.Pattern | None:
        """The pattern that cuts printable ASCII text in lower case into words, if the
        specification does nothing else to such text; then the library need not be asked."""
        steps = (d.get("normalizer") or {}).get("normalizers", [])
        cutters = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in steps], [x["type"] for x in cutters]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or cutters[1]["add_prefix_space"]:
            return None
        if steps[1]["pattern"] != {"Regex": "\\s+"} or cutters[1]["use_regex"]:
            return None
        if cutters[0]["behavior"] != "Removed" or not cutters[0]["invert"]:
            return None
        return regex.compile(cutters[0]["pattern"]["Regex"])

    def _inner(self, token: str) -> str:
        """The token as a string of symbols: a word-final symbol is one character of its own."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + END)
        return token

    def _link(self, m: dict) -> None:
        n = max(self.ids.values()) + 1
        base = n - len(m["merges"])
        self.left, self.right = list(range(n)), list(range(n))
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(m["merges"]):
            a, b = (pair.split(" ") if isinstance(pair, str) else pair)
            a, b = self._inner(a), self._inner(b)
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            if k != base + rank:
                raise ValueError("token ids do not follow the order of the merges")
            self.joined[i, j], self.left[k], self.right[k] = k, i, j
        self.shorter = [-1] * n  # the longest token that is a proper prefix of the token
        self.size = [0] * n
        self.matcher = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.size[i] = len(s)
            self.shorter[i] = next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), -1)
            self.matcher.add_word(s, i)
        self.matcher.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is what merging leaves: undo the merges inside
        both, the latest first, and see that none of the pairs met at the border
        would have been merged before the merges that are still to be undone."""
        x, y, before = a, b, len(self.left) + 1
        while True:
            k = self.joined.get((x, y))
            if k is not None and k < before:
                return False
            can_x, can_y = self.left[x] != x, self.left[y] != y
            if can_x and (x > y or not can_y):
                before, x = x, self.right[x]
            elif can_y:
                before, y = y + 1, self.left[y]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word given as symbols."""
        n = len(word)
        size, shorter, pairs = self.size, self.shorter, self.pairs
        longest = [-1] * n
        for end, i in self.matcher.iter(word):
            longest[end + 1 - size[i]] = i  # ends ascend, so the last is the longest
        dead = None
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                if dead is None or at + size[token] not in dead:
                    if last < 0:
                        break
                    key = last << 20 | token
                    fine = pairs.get(key)
                    if fine is None:
                        if len(pairs) > CACHE_ENTRIES:
                            pairs.clear()
                        pairs[key] = fine = self.compatible(last, token)
                    if fine:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                last = token
                token = longest[at] if at < n else -1
            else:  # nothing fits here: give up this place and shorten the token before it
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                if dead is None:
                    dead = set()
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def _word_ids(self, word: str) -> array:
        inner = word[:-1] + chr(ord(word[-1]) + END) if self.suffix else word
        ids = array("I", self.encode_word(inner))
        self.words.put(word, ids)
        return ids

    def _part_words(self, part: str) -> list[str]:
        if self.ascii_words and part.isascii() and part.isprintable():
            return self.ascii_words.findall(part.lower())
        text = self.normalizer.normalize_str(part) if self.normalizer else part
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece of text without blanks, special tokens in it included."""
        out = array("I")
        parts = self.special_pattern.split(piece) if self.special_mark in piece else [piece]
        known = self.words.get
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif part:
                for word in self._part_words(part):
                    out += known(word) or self._word_ids(word)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers.  Words never span
        blanks in the supported specifications with word ends."""
        pieces = text.replace("\n", " ").split(" ")
        cache = self.pieces
        out = list(map(cache.new.get, pieces))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            piece = pieces[k]
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece_ids(piece)
                if len(piece) < 256:
                    cache.put(piece, ids)
            out[k] = ids
        return b"".join(out)


class OffsetTable:
    """The bytes of all tokens in a row, and where each begins: decoding is one gather."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        m, special = d["model"], {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        kind = (d.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not supported")
        self.joins_with_blank = kind is None
        names = {i: t for t, i in m["vocab"].items()} | {i: t for t, i in special.items()}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        blobs = []
        for i in range(max(names) + 1):
            t = names.get(i, "")
            if self.joins_with_blank:
                blobs.append(b" " + t.encode("utf-8"))
            else:
                blobs.append(t.encode("utf-8") if t in special else bytes(byte_of[c] for c in t))
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text the ids stand for."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        upto = np.cumsum(length)
        where = np.repeat(start - (upto - length), length)
        where += np.arange(len(where))
        raw = self.blob[where].tobytes()
        if self.joins_with_blank:
            return raw[1:]
        return raw.decode("utf-8", "replace").encode("utf-8")


_MODELS: dict[str, BpeModel] = {}
_TABLES: dict[str, OffsetTable] = {}


def model_of(spec: bytes) -> BpeModel:
    """The model of a specification, built once in each Python worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = BpeModel(spec)
    return _MODELS[key]


def table_of(spec: bytes) -> OffsetTable:
    """The offset table of a specification, built once in each Python worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = OffsetTable(spec)
    return _TABLES[key]


def read_spec(path: str) -> bytes:
    """The tokenizer's file (a vocabulary, so of a fixed size); it travels with the tasks."""
    with open(path, "rb") as f:
        spec = f.read()
    if not json.loads(spec)["model"].get("end_of_word_suffix"):
        raise ValueError("this encoder cuts text at blanks, which needs a vocabulary with word ends")
    return spec


def encode(df: DataFrame, spec: bytes, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids as little-endian unsigned 32-bit integers (binary).

    Null and empty texts and texts of blanks have no ids.  Texts of any length are
    encoded whole.  All columns and rows stay as they are; ``out`` replaces a column
    of that name.
    """
    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        m = model_of(spec)
        return pd.Series([m.encode(t) for t in texts], dtype=object)

    return df.withColumn(out, ids(text_of(text_col)))


def decode(df: DataFrame, spec: bytes, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text that the ids stand for (null ids: empty)."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = table_of(spec)
        return pd.Series([m.decode(np.frombuffer(x, "<u4")).decode("utf-8") for x in ids], dtype=object)

    return df.withColumn(out, text(F.coalesce(F.col(ids_col), F.lit(b""))))


def n_tokens(ids_col: str = "ids") -> Column:
    return (F.octet_length(ids_col) / 4).cast("long")


def digest(docs: DataFrame, spec: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: its text encoded, its ids decoded."""
    small_batches(docs.sparkSession)
    d = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), spec)
    d = d.select("doc_id", "ids", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return decode(d, spec).select("doc_id", "n_tokens", "ids_sha256",
                                  F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
