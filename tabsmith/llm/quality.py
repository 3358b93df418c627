"""Quality rules by distribution divergence.

Each document's histograms -- of character classes, and of the most common words of
its language -- are compared with those of all documents of the language by
Jensen-Shannon distance.  A document long enough to be judged that lies further
from its language than the limits fails; a few base rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import WORD, WS, cut, text_of

COMMON_WORDS = 16
MIN_WORDS, MIN_CHARS = 50, 200  # shorter documents are not judged by divergence
MAX_WORD_DISTANCE, MAX_CHAR_DISTANCE = 0.40, 0.30
#: Character classes in the order in which they are taken out of the text; the rest is the last class.
CLASSES = ("[a-z]+", WS, "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", r"[^\x00-\x7F]+")
BLANKS, SYMBOLS = 1, 4  # places of two of them


def language_key(c: str) -> Column:
    """A code of two or three letters, else ``und``: at most 18,253 different keys, so
    a table of one row per key is small enough to broadcast (about 8 MB)."""
    code = F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("und")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WS), "")


def _windows(h: str) -> Column:
    """Hashes of the 3-word windows of a column of word hashes."""
    n = F.size(h)
    pair = F.zip_with(F.slice(h, 1, n - 2), F.slice(h, 2, n - 2), lambda a, b: F.xxhash64(a, b))
    tri = F.zip_with(pair, F.slice(h, 3, n - 2), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= 3, tri).otherwise(F.array().cast("array<bigint>"))


def _placed(tri: str) -> Column:
    """Windows with their places, equal ones side by side; null where all differ."""
    placed = F.sort_array(F.transform(F.col(tri), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(tri)) < F.size(tri), placed)


def _covered(placed: str) -> Column:
    """Words inside windows that occur twice or more."""
    n = F.size(placed)
    same = F.zip_with(F.slice(placed, 1, n - 1), F.slice(placed, 2, n - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
    inside = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2))))
    return F.when(F.col(placed).isNotNull(), F.size(inside)).otherwise(0).cast("long")


def base_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Words, repeated lines, words in repeated windows; each array is a column of its own, as
    Spark evaluates what stands inside array functions once for each mention."""
    d = docs.select(F.col(id_col).alias("doc_id"), language_key(lang_col).alias("lang_key"),
                    text_of(text_col).alias("t"))
    d = d.withColumn("w", words_of(F.col("t"))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "lang_key", "t", F.size("w").cast("long").alias("n_words"), lines.alias("lines"),
                 _windows("h").alias("tri"))
    d = d.withColumn("placed", _placed("tri"))
    return d.select("doc_id", "lang_key", "t", "n_words",
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    _covered("placed").alias("n_repeat_words"))


def common_words(docs: DataFrame, text_col: str, lang_col: str, k: int = COMMON_WORDS) -> DataFrame:
    """Per language its ``k`` most frequent words (lower case, ties by word) and their
    shares of all its words, counted over all documents."""
    words = docs.select(language_key(lang_col).alias("lang_key"),
                        F.explode(words_of(F.lower(text_of(text_col)))).alias("word"))
    counts = cut(words.groupBy("lang_key", "word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("lang_key").agg(F.sum("n").alias("total"))
    best = (counts.withColumn("k", F.row_number().over(
        Window.partitionBy("lang_key").orderBy(F.desc("n"), "word"))).where(F.col("k") <= k))
    return (best.groupBy("lang_key").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
            .join(total, "lang_key").select(
                "lang_key", F.col("top.word").alias("common"),
                _shares(F.col("top.n"), F.col("total")).alias("word_ref")))


def _shares(counts: Column, total: Column) -> Column:
    """Shares of the counted classes and, last, of the rest."""
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(counts, F.array(rest)), lambda x: x / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 .. 1) of two share arrays."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            max_word: float = MAX_WORD_DISTANCE, max_char: float = MAX_CHAR_DISTANCE) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, word_distance, char_distance, kept``.

    A null text has no words and fails the base rules (fewer than 50 words, or more
    than half of them in repeated 3-word windows).  Null and unknown language codes
    form one language.  Distances are null where the document is too short to be
    judged.  Repeated rows and null ids come out as they went in.
    """
    refs = F.broadcast(cut(common_words(docs, text_col, lang_col)))  # one row per language_key: bounded
    d = base_counts(docs, id_col, text_col, lang_col).join(refs.drop("word_ref"), "lang_key", "left")
    spread = F.concat(F.lit("  "), F.regexp_replace(F.lower("t"), WS, "  "), F.lit("  "))
    d = d.withColumn("spread", spread)
    hits = []
    for k in range(COMMON_WORDS):
        probe = F.concat(F.lit(" "), F.get("common", F.lit(k)), F.lit(" "))
        gone = F.octet_length("spread") - F.octet_length(F.replace(F.col("spread"), probe, F.lit("")))
        hits.append(F.coalesce((gone / F.octet_length(probe)).cast("long"), F.lit(0).cast("long")))
    d = d.withColumn("hits", F.slice(F.array(*hits), 1, F.size(F.coalesce("common", F.array()))))
    sizes, rest = [], F.col("t")
    for k, pattern in enumerate(CLASSES):
        d = d.withColumn(f"r{k}", F.regexp_replace(rest, pattern, ""))
        sizes.append((F.length(rest) - F.length(f"r{k}")).cast("long"))
        rest = F.col(f"r{k}")
    narrow = cut(d.select("doc_id", "lang_key", "n_words", "n_dup_lines", "n_repeat_words", "hits",
                          F.array(*sizes).alias("classes"), F.length("t").cast("long").alias("n_chars")))
    narrow = narrow.withColumn("word_chars", F.col("n_chars") - F.col("classes")[BLANKS]).withColumn(
        "n_symbols", F.col("classes")[SYMBOLS])
    sums = [F.sum(F.col("classes")[k]) for k in range(len(CLASSES))]
    chars = narrow.groupBy("lang_key").agg(F.array(*sums).alias("c"), F.sum("n_chars").alias("n")).select(
        "lang_key", _shares(F.col("c"), F.col("n")).alias("char_ref"))
    out = narrow.join(refs.drop("common"), "lang_key", "left").join(F.broadcast(chars), "lang_key")
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(
        _shares(F.col("hits"), F.col("n_words")), F.col("word_ref"))))
    out = out.withColumn("char_distance", F.when(F.col("n_chars") >= MIN_CHARS, js_distance(
        _shares(F.col("classes"), F.col("n_chars")), F.col("char_ref"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.coalesce("word_distance", F.lit(0.0)) > max_word) | (F.coalesce("char_distance", F.lit(0.0)) > max_char)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), "word_distance", "char_distance", (~failed & ~far).alias("kept"))
