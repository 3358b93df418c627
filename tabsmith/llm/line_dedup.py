"""Line dedup by an exact set-similarity join.

A line is the set of its words (lower case).  Words are ordered by rarity: counts of
2^20 word buckets, a table of fixed size, give each word a rarity class that becomes
the high bits of its 64-bit key, so sorting the keys puts the rarest words first.
Two lines of Jaccard similarity 0.8 or more share a word among their first few
(prefix filter); sizes and the place of the shared word must allow enough overlap
(length and positional filters), and so must the parities of their words by 64 or 128
bit places (each differing parity is a word that only one line has).  What is left is
verified on whole sets.  Lines of equal sets are one set throughout.  A line goes if
any earlier line, by document id and line number, matches it, whether or not that one
goes as well.

Near copies are not compared pair by pair.  Sets that share two neighbouring words of
their prefixes are compared with the earliest of them first; what a set then has found
bounds what it is still compared with: sets of documents not after that of its match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import WS, cut, marked, text_of

NUM, DEN = 4, 5  # similarity 0.8
BUCKETS = 1 << 20
ROW = 1 << 10  # buckets that are collected in one row
HASH_BITS = 57  # of a key; the six bits above hold the rarity class
WIDE = 60  # lines of more words carry 128 parities in place of 64
MARKS = 2  # neighbouring pairs of a prefix by which near copies meet


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_of(text_col), "\n")).alias("line_no", "line"))


def _words(line: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.col(line)), WS), "")
    return F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))


def _table(found: DataFrame) -> bytes:
    """The bytes ``k`` (below 128) of the buckets ``b``, one each: 1 MiB whatever the input."""
    rows = found.groupBy(F.floor(F.col("b") / ROW).alias("row")).agg(
        F.collect_list(F.struct(F.pmod("b", F.lit(ROW)).cast("int").alias("b"), F.col("k").cast("int").alias("k"))).alias("all"))
    table = bytearray(BUCKETS)
    for r in rows.select("row", "all.b", "all.k").collect():  # at most BUCKETS / ROW rows of ROW entries
        for bucket, k in zip(r["b"], r["k"]):
            table[r["row"] * ROW + bucket] = k
    return bytes(table)


def _byte(table: bytes, bucket: Column) -> Column:
    return F.ascii(F.substring(F.lit(table), bucket.cast("int") + 1, F.lit(1)).cast("string"))


def _classes(docs: DataFrame, text_col: str) -> bytes:
    """Rarity classes of the buckets."""
    words = docs.select(F.explode(F.split(F.lower(text_of(text_col)), WS)).alias("w"))
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return _table(counts.select("b", F.least(F.floor(F.log2(F.col("c") + 1) * 1.5), F.lit(62)).alias("k")))


def _keys(lines: DataFrame, classes: bytes) -> DataFrame:
    low = F.lit((1 << HASH_BITS) - 1)

    def key(w: Column) -> Column:
        of = _byte(classes, F.pmod(w, F.lit(BUCKETS)))
        return F.shiftleft(of.cast("long"), HASH_BITS).bitwiseOR(w.bitwiseAND(low))

    # out of an array of one: a column that the filter and the keys read, in place of splitting the line for each
    words = lines.select("doc_id", "line_no", F.explode(F.array(_words("line"))).alias("w")).where(F.size("w") > 0)
    return words.select("doc_id", "line_no", F.sort_array(F.transform("w", key)).alias("keys"))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per line its size, the identity of its set, 32-bit keys of its prefix and its parities."""
    n = F.size("keys")
    prefix = n - F.ceil(n * NUM / DEN).cast("int") + 1
    every = F.expr("aggregate(keys, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))")
    half = F.expr("aggregate(keys, 0L, (a, x) -> a ^ shiftleft((x >> 6) & 1L, cast(x & 63 as int)))")
    return _keys(_lines(docs, id_col, text_col), _classes(docs, text_col)).select(
        "doc_id", "line_no", n.alias("n"), F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"),
        F.transform(F.slice("keys", F.lit(1), prefix), lambda x: F.hash(x)).alias("prefix"),
        every.alias("every"), F.when(n > WIDE, half).alias("half"))


def _near() -> Column:
    """Whether sizes and parities allow the overlap."""
    fits = F.least("a_n", "b_n") * DEN >= F.greatest("a_n", "b_n") * NUM
    # overlap o of sets of x and y words needs o * (NUM + DEN) >= NUM * (x + y), so x + y - 2 * o
    # words that only one has are at most (x + y) * (DEN - NUM) / (NUM + DEN)
    every = F.col("a_every").bitwiseXOR(F.col("b_every"))
    half = F.col("a_half").bitwiseXOR(F.col("b_half"))
    differ = F.coalesce(F.bit_count(half) + F.bit_count(every.bitwiseXOR(half)), F.bit_count(every))
    return fits & (differ * (NUM + DEN) <= (F.col("a_n") + F.col("b_n")) * (DEN - NUM))


def _first_candidates(sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that pass the filters of sets with the earliest one that has a mark of theirs,
    a hash of two neighbours in the prefix: as many as marks at most."""
    marks = F.array(*[F.when(F.size("prefix") > i + 1, F.xxhash64(F.get("prefix", F.lit(i)), F.get("prefix", F.lit(i + 1))))
                      for i in range(MARKS)])
    cols = ("sid", "n", "every", "half")
    rows = sets.select("first", *cols, F.explode(F.array_compact(marks)).alias("mark"))
    heads = rows.groupBy("mark").agg(F.min(F.struct("first", *cols)).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    heads = heads.select("mark", *[F.col("h." + c).alias("a_" + c) for c in cols])
    both = heads.join(rows.select("mark", *[F.col(c).alias("b_" + c) for c in cols]), "mark")
    return both.where((F.col("a_sid") != F.col("b_sid")) & _near()).select(
        F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct()


def _candidates(sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of set numbers that pass all filters, each once, if one may be a match of the other
    that is earlier than what that has: in a document ``doc`` not after its ``upto`` (null: as ``doc``)."""
    posts = sets.select("sid", "n", "every", "half", "doc", "upto", F.posexplode("prefix").alias("at", "key"))
    cols = ("sid", "n", "every", "half", "at", "doc", "upto")
    p = posts.select("key", *[F.col(c).alias("a_" + c) for c in cols])
    q = posts.select("key", *[F.col(c).alias("b_" + c) for c in cols])
    most = 1 + F.least(F.col("a_n") - F.col("a_at") - 1, F.col("b_n") - F.col("b_at") - 1)
    reach = (most + F.least("a_at", "b_at")) * (NUM + DEN) >= (F.col("a_n") + F.col("b_n")) * NUM
    earlier = (F.col("a_doc") <= F.coalesce("b_upto", "b_doc")) | (F.col("b_doc") <= F.coalesce("a_upto", "a_doc"))
    both = (p.key == q.key) & (F.col("a_sid") < F.col("b_sid")) & _near() & reach & earlier
    return p.join(q, both).select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct()


def _whole(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, found: DataFrame,
           known: DataFrame | None = None) -> DataFrame:
    """``sid, at, w``: place and words of all sets in the pairs ``found``; of those in ``known`` from there.
    Only texts that may hold a wanted line are split, only lines that may be wanted into words."""
    ends = found.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    if known is not None:
        ends = ends.join(known.select("sid"), "sid", "left_anti")
    ends = cut(ends.join(sets.select("sid", "first"), "sid").select("sid", "first.*"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    again = marked(_lines(marked(texts, ends, "doc_id"), "doc_id", "t"), ends, "doc_id", "line_no")
    whole = again.select("doc_id", "line_no", _words("line").alias("w")).join(ends, ["doc_id", "line_no"])
    whole = cut(whole.select("sid", F.struct("doc_id", "line_no").alias("at"), "w"))
    return whole if known is None else known.unionByName(whole)


def _verified(found: DataFrame, whole: DataFrame) -> DataFrame:
    """``sid, m``: the sets that match an earlier one of their pairs, with the place of the earliest."""
    v = found.join(whole.select(F.col("sid").alias("a"), F.col("at").alias("a_at"), F.col("w").alias("a_w")), "a")
    v = v.join(whole.select(F.col("sid").alias("b"), F.col("at").alias("b_at"), F.col("w").alias("b_w")), "b")
    shared = F.size(F.array_intersect("a_w", "b_w"))
    v = v.where((shared * (NUM + DEN) >= (F.size("a_w") + F.size("b_w")) * NUM) & (F.col("a_at") != F.col("b_at")))
    later = F.when(F.col("a_at") > F.col("b_at"), F.col("a")).otherwise(F.col("b"))
    return cut(v.groupBy(later.alias("sid")).agg(F.min(F.least("a_at", "b_at")).alias("m")))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that go: ``doc_id, line_no, match_id, match_line`` with the earliest matching line."""
    narrow = cut(_narrow(docs, id_col, text_col))
    place = F.struct("doc_id", "line_no")
    same = [F.first(c).alias(c) for c in ("n", "prefix", "every", "half")]  # the same in all lines of a set
    sets = cut(narrow.groupBy("h1", "h2").agg(F.min(place).alias("first"), *same).withColumn(
        "sid", F.monotonically_increasing_id()))
    found = cut(_first_candidates(sets))
    whole = _whole(docs, id_col, text_col, sets, found)
    near = _verified(found, whole)
    bound = sets.join(near, "sid", "left").select(
        "sid", "n", "prefix", "every", "half", F.col("first.doc_id").alias("doc"),
        F.col("m.doc_id").alias("upto"))
    found = cut(_candidates(bound))
    rest = _verified(found, _whole(docs, id_col, text_col, sets, found, whole))
    best = near.unionByName(rest).groupBy("sid").agg(F.min("m").alias("m"))
    firsts = sets.select("sid", "h1", "h2", "first").join(best, "sid", "left").select(
        "h1", "h2", F.least("m", "first").alias("m"))
    out = narrow.select("doc_id", "line_no", "h1", "h2").join(firsts, ["h1", "h2"])
    return out.where(place > F.col("m")).select(
        "doc_id", "line_no", F.col("m.doc_id").alias("match_id"), F.col("m.line_no").alias("match_line"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, removed_lines`` (numbers from 0, ascending).

    Lines without a word never go.  A null text has one empty line.  Rows with a null
    id keep all lines.  Rows that repeat an id are one document: equal places do not
    remove each other.  Empty tables give empty results; other columns are ignored.
    """
    gone = matches(docs, id_col, text_col).groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_set("line_no")).alias("removed_lines"))
    d = docs.select(F.col(id_col).alias("doc_id"),
                    (F.length(text_of(text_col)) - F.length(F.replace(text_of(text_col), F.lit("\n"), F.lit(""))) + 1)
                    .cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return d.join(gone, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "n_lines", F.size(F.coalesce("removed_lines", none)).cast("long").alias("n_removed"),
        F.coalesce("removed_lines", none).alias("removed_lines"))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the matched lines taken out of the text."""
    from tabsmith.llm.common import free
    key, lines = free(docs, "_id", "_removed")
    gone = line_dedup(docs, id_col, text_col).where("n_removed > 0").select(
        F.col("doc_id").alias(key), F.col("removed_lines").alias(lines)).dropDuplicates([key])
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.coalesce(F.array_contains(lines, i), F.lit(False)))
    return docs.join(gone, F.col(id_col) == F.col(key), "left").withColumn(text_col, F.array_join(kept, "\n")).drop(key, lines)
