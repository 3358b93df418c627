"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the likelihood of the text under a
byte-trigram model of each language, the language the markup declares, and the
prior of the host, which is smoothed towards the prior of its address suffix, and
that towards the prior of the whole table.  Priors are sums of text posteriors by
host, suffix and table (grouped aggregation); a row's own share is taken out again
before it is judged.  A uniform model stands for any other language (``und``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import cut, free, text_of

LANGUAGES = ("de", "en", "es", "fr")
CODES = 1 << 16
EVIDENCE = 150  # trigrams that a text's likelihood counts for at most; trigrams of one text are not independent
DECLARED_RIGHT = 0.9  # how often declared languages are taken to be right
PSEUDO_HOST, PSEUDO_SUFFIX = 5.0, 50.0  # rows that the level above counts for
OTHER_PRIOR = 0.01
MIN_PROBABILITY = 0.5


def trigram_codes(text: str) -> np.ndarray:
    """Hashed byte trigrams; A-Z as a-z, runs of other ASCII characters as one blank."""
    b = np.frombuffer(b" " + text.encode("utf-8").lower() + b" ", np.uint8)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, 32).astype(np.uint32)
    b = b[letter | np.concatenate([[True], letter[:-1]])]
    if len(b) < 4:
        return np.zeros(0, np.int64)
    v = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (v * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Log probabilities of the trigram codes by language, from all labelled rows.

    A task adds up its own counts; the sums that reach the driver are one number for
    each code and language, whatever the size of the table."""
    names = list(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), CODES), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                total[names.index(lang.as_py())] += np.bincount(trigram_codes(text.as_py()), minlength=CODES)
        lang, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(code.astype(np.int32)),
                                          pa.array(total[lang, code])], ["lang", "code", "n"])

    labelled = docs.where(F.col(lang_col).isin(names)).select(text_of(text_col).alias("t"), F.col(lang_col).alias("l"))
    sums = labelled.mapInArrow(count, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), CODES))
    r = sums.toPandas()
    counts[r["lang"], r["code"]] = r["n"]
    counts += 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihood(model: np.ndarray):
    """A column function: text -> log likelihoods of the languages and of ``und``, then
    their posteriors with a flat prior."""
    table = np.concatenate([model, np.full((1, CODES), -np.log(CODES), np.float32)]).T.copy()
    flat = np.log(np.array([(1 - OTHER_PRIOR) / len(model)] * len(model) + [OTHER_PRIOR]))

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = trigram_codes(t)
            n = len(codes)
            ll = table[codes].sum(axis=0, dtype=np.float64) * (min(n, EVIDENCE) / n) if n else np.zeros(len(flat))
            e = np.exp(ll + flat - (ll + flat).max())
            out.append(np.concatenate([ll, e / e.sum()]))
        return pd.Series(out, dtype=object)

    return run


def identify(rows: DataFrame, model: np.ndarray, keys: Sequence[str], text_col: str = "text",
             declared_col: str = "declared", suffix_col: str = "suffix", host_col: str = "host",
             languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """Per input row ``keys``, ``language``, ``probability``, ``text_language``, ``declared``, ``accepted``.

    A null or empty text leaves the other evidence to decide; with no evidence at all
    the table's prior does.  A null host or suffix is a group of its own.  A declared
    language is read up to the first ``-`` or ``_``; unknown and null ones count for
    nothing.  ``und`` and languages below ``MIN_PROBABILITY`` are not accepted.  Ties
    go to the language that comes first by name.  Repeated rows come out repeated.
    """
    names = [*languages, "und"]
    key = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.lower(F.col(c))))
    d = rows.select(F.struct(*keys).alias("key"), key(suffix_col).alias("suffix"), key(host_col).alias("host"),
                    F.regexp_extract(F.lower(F.coalesce(F.col(declared_col), F.lit(""))), "^([a-z]*)", 1).alias("declared"),
                    likelihood(model)(text_of(text_col)).alias("ll"))
    d = cut(d)
    d = d.withColumns({f"p{k}": F.col("ll")[len(names) + k] for k in range(len(names))})
    sums = [F.sum(f"p{k}").alias(f"h{k}") for k in range(len(names))]
    hosts = cut(d.groupBy("suffix", "host").agg(*sums))
    suffixes = cut(hosts.groupBy("suffix").agg(*[F.sum(f"h{k}").alias(f"s{k}") for k in range(len(names))]))
    every = suffixes.agg(*[F.sum(f"s{k}") for k in range(len(names))]).first()
    base = [float(x or 0) + 1 / len(names) for x in every]
    base = [x / sum(base) for x in base]
    levels = hosts.join(suffixes, "suffix")
    j = d.join(levels, ["suffix", "host"])
    n_host = sum((F.col(f"h{k}") for k in range(1, len(names))), F.col("h0")) - 1
    n_suffix = sum((F.col(f"s{k}") for k in range(1, len(names))), F.col("s0")) - 1
    score = []
    for k, c in enumerate(names):
        of_suffix = (F.col(f"s{k}") - F.col(f"p{k}") + PSEUDO_SUFFIX * base[k]) / (n_suffix + PSEUDO_SUFFIX)
        of_host = (F.col(f"h{k}") - F.col(f"p{k}") + PSEUDO_HOST * of_suffix) / (n_host + PSEUDO_HOST)
        right = F.when(F.col("declared") == c, DECLARED_RIGHT).otherwise((1 - DECLARED_RIGHT) / (len(languages) - 1))
        said = F.when(F.col("declared").isin(list(languages)), F.log(right)).otherwise(0.0)
        score.append(F.col("ll")[k] + F.log(F.greatest(of_host, F.lit(1e-9))) + said)
    j = j.select("key", "declared", F.array(*score).alias("score"),
                 F.slice("ll", len(names) + 1, len(names)).alias("own"))
    j = j.withColumn("top", F.array_max("score"))
    first = lambda c, top: F.get(F.array(*map(F.lit, names)), F.array_position(c, top).cast("int") - 1)
    total = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    j = j.select("key.*", first(F.col("score"), F.col("top")).alias("language"), (1 / total).alias("probability"),
                 first(F.col("own"), F.array_max("own")).alias("text_language"),
                 F.nullif("declared", F.lit("")).alias("declared"))
    return j.withColumn("accepted", (F.col("language") != "und") & (F.col("probability") >= MIN_PROBABILITY))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> dict[str, Column]:
    """Text, declared language, suffix and host of web pages."""
    from tabsmith.llm.url_filter import host_of
    html = text_of(html_col)
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = host_of(url_col)
    return {"text": text, "declared": F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1),
            "suffix": F.element_at(F.split(host, r"\."), -1), "host": host}


def document_evidence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source") -> dict[str, Column]:
    """The same of documents: their source takes the host's place."""
    return {"text": F.col(text_col), "declared": F.col(lang_col), "suffix": F.lit(""), "host": F.col(source_col)}


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns unchanged."""
    model = train(docs, text_col, lang_col)
    e = document_evidence(docs, text_col, lang_col, source_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"),
                       *[c.alias(n) for n, c in e.items()])
    bad = identify(rows, model, ["id", "h"]).where("NOT accepted").select("id", "h").distinct()
    i, h = free(docs, "_id", "_h")
    bad = bad.toDF(i, h)
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text_col)) == F.col(h)), "left_anti")
