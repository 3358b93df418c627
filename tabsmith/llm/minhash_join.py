"""MinHash near-dedup by a chosen-path set similarity join.

Each document is a set of word shingles and carries a signature of minhash values.
Several independent trees start from all documents.  At each level a tree uses
``branching`` minhash functions; a document goes to the children (node, function,
value) that its values name, so that similar documents keep meeting.  A node chooses
its functions by its own hash among those not used on its path.  Simulated over 40,000
pairs that agree in each of the 64 functions with probability 0.8: one tree keeps 0.931
of them at depth 8 and 0.929 at depth 16, four trees keep 0.9998 and 0.9997.

A node is compared exhaustively as soon as that takes few comparisons for each of
its rows.  In the others every row is compared with one pivot, the smallest id:
a large group of near copies is then one labelled class, and only rows of different
classes still have to be compared.  So a node of one class is done, one with a large
class and few other rows is small, and no group is expanded into all its pairs.

A large node most of whose rows resemble its pivot without being linked (far copies of
one text) would not come apart by splitting.  Its rows are compared by blocks: two
blocks of bounded size meet in a task, which counts all intersections at once as a
matrix product of full sets and returns a spanning forest of the links found.

Candidates must agree in a 64-nibble sketch of the signature (a pair of similarity
0.8 fails with a probability below 1e-4) and in size, and are confirmed on the full
sets.  Documents of equal sets are one document throughout.

Texts are not shuffled: a bitmap of the wanted documents, of a fixed size, picks them
where they lie, and only the sets of those in a candidate pair move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import cut, marked, scratch, small_batches, text_of
from tabsmith.llm.components import components

FUNCTIONS = 64
TREES, BRANCHING = 4, 2
LEAF = 64  # comparisons for each row of a node that is compared exhaustively
MAX_LEVELS = 16
BLOCK_ROWS, BLOCK_SHINGLES = 1200, 1_500_000  # of a block; two blocks meet in a task
RESEMBLE = 40  # nibbles in which a row may differ from a pivot that it resembles (similarity about 1/3)
#: Nibbles (of 64) that may differ: similarity 0.8 gives 12 on average, deviation 3.1.
SKETCH_DIFFER = 25
WORDS_KNOWN = 300_000
SLOTS = 1 << 26  # bits that tell which documents are wanted: 8 MiB
LESS = 4  # texts are written anew when the wanted ones are fewer than those written by this factor

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z.  ``bytes`` lower-cases ASCII only
    and splits at blank, tab .. carriage return, which is the definition wanted."""
    words = text.encode("utf-8").lower().split()
    out = list(map(_words.get, words))
    if None in out:
        if len(_words) > WORDS_KNOWN:
            _words.clear()
        for k, h in enumerate(out):
            if h is None:
                out[k] = h = xxhash.xxh3_64_intdigest(words[k])
                if len(words[k]) < 64:
                    _words[words[k]] = h
    return np.array(out, np.uint64)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; a shorter text is one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w[j:len(w) - width + 1 + j])
    return np.unique(h)


def _signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):  # long documents in parts
        part = shingles[k:k + 4096, None] * _MULTIPLY[None, :] + _ADD[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


SIGNED = "doc_id long, n int, digest binary, sig array<int>, s0 long, s1 long, s2 long, s3 long"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Set size, digest of the set, signature and sketch of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                n, digest, sigs = [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_py(), k)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(_signature(s))
                sig = np.stack(sigs)
                nibble = ((sig >> np.uint32(11)) & np.uint32(15)).astype(np.uint64).reshape(len(sigs), 4, 16)
                sketch = (nibble << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)
                arrays = [part.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()),
                          pa.ListArray.from_arrays(np.arange(0, len(sigs) * FUNCTIONS + 1, FUNCTIONS, dtype=np.int32),
                                                   pa.array(sig.view(np.int32).ravel()))]
                arrays += [pa.array(np.ascontiguousarray(sketch[:, j]).view(np.int64)) for j in range(4)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "digest", "sig", "s0", "s1", "s2", "s3"])

    return docs.mapInArrow(run, SIGNED)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                sets = [shingle_set(t.as_py(), k) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))],
                    ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _differing(x: str, y: str) -> Column:
    """Nibbles in which two sketches differ."""
    total = F.lit(0)
    for j in range(4):
        v = F.col(f"{x}.s{j}").bitwiseXOR(F.col(f"{y}.s{j}"))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(v)
    return total


def _alike(x: str, y: str, num: int, den: int) -> Column:
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return ((F.least(a, b) * den >= F.greatest(a, b) * num) & (_differing(x, y) <= SKETCH_DIFFER))


POINT = ["id", "n", "s0", "s1", "s2", "s3"]
PLACE = ["tree", "node", "used"]  # ``used`` has a bit for each function on the path to the node


def _children(rows: DataFrame, sigs: DataFrame | None) -> DataFrame:
    """Rows of the next level: each row to ``branching`` children, by functions that the
    node's hash chooses among those not used on its path.  ``rows`` has the signature
    itself or gets it from ``sigs``."""
    if sigs is not None:
        rows = rows.join(marked(sigs.select("id", "sig"), rows, "id", slots=SLOTS), "id")
    rows = rows.withColumn("_free", F.expr(f"filter(sequence(0, {FUNCTIONS - 1}), f -> getbit(used, f) = 0)"))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("node"), F.size("_free")).cast("int"))
    for j in range(BRANCHING):
        f = F.get("_free", F.col("_at"))
        rows = rows.withColumn(f"_kid{j}", F.struct(
            F.xxhash64("node", f, F.get("sig", f)).alias("node"),
            F.col("used").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), f)).alias("used")))
        step = F.pmod(F.xxhash64("node", F.lit(j)), F.size("_free") - 1).cast("int") + 1
        rows = rows.withColumn("_at", F.pmod(F.col("_at") + step, F.size("_free")).cast("int"))
    rows = rows.withColumn("_kid", F.explode(F.array(*[f"_kid{j}" for j in range(BRANCHING)])))
    return rows.select("tree", "_kid.node", "_kid.used", *POINT)


def _near_labels(links: DataFrame) -> DataFrame:
    """``id, label``: two steps towards the smallest id around.  Equal labels mean linked by
    a path; the converse need not hold here, as labels only save comparisons."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"))
    two = one.select(F.col("id").alias("label"), F.col("label").alias("next"))
    return one.join(two, "label", "left").select("id", F.coalesce("next", "label").alias("label"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _stats(rows: DataFrame, own: bool = False) -> DataFrame:
    """Of nodes with rows of different labels: rows, comparisons left, largest class, pivot.
    ``own``: each row has a label of its own."""
    if own:
        per = rows.select("node", "label", F.lit(1).cast("long").alias("c"), F.col("id").alias("first"))
    else:
        per = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    return (per.groupBy("node").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("sq"),
                                    F.max(F.struct("c", "label")).alias("top"), F.min("first").alias("pivot"))
            .withColumn("work", (F.col("size") * F.col("size") - F.col("sq")) / 2).where("work > 0"))


def _pairs(x: DataFrame, y: DataFrame, num: int, den: int) -> DataFrame:
    j = x.alias("x").join(y.alias("y"), F.col("x.node") == F.col("y.node"))
    j = j.where((F.col("x.label") != F.col("y.label")) & _alike("x", "y", num, den))
    return j.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _leaf_pairs(rows: DataFrame, stats: DataFrame, num: int, den: int) -> DataFrame:
    """Rows against the rows outside the node's largest class (all rows, if none has the
    majority): at most ``4 * LEAF`` of them a node."""
    r = rows.join(stats.select("node", "size", "top"), "node")
    probes = r.where("2 * top.c <= size OR label <> top.label").select("node", "label", *POINT)
    return _pairs(r.select("node", "label", *POINT), probes, num, den)


def _pivot_pairs(rows: DataFrame, stats: DataFrame, num: int, den: int) -> DataFrame:
    pivots = rows.join(stats.select(F.col("node").alias("_n"), F.col("pivot").alias("_p")),
                       (F.col("node") == F.col("_n")) & (F.col("id") == F.col("_p"))).select("node", "label", *POINT)
    return _pairs(rows.select("node", "label", *POINT), pivots, num, den)


def _resembling(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Nodes at least half of whose rows resemble the pivot."""
    pivots = rows.join(stats.select(F.col("node").alias("_n"), F.col("pivot").alias("_p")),
                       (F.col("node") == F.col("_n")) & (F.col("id") == F.col("_p"))).select("node", *POINT)
    j = rows.alias("x").join(pivots.alias("y"), F.col("x.node") == F.col("y.node"))
    near = F.avg((_differing("x", "y") <= RESEMBLE).cast("int"))
    return j.groupBy(F.col("x.node").alias("node")).agg(near.alias("near")).where("near >= 0.5").select("node")


def _block_links(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside nodes by comparing every two blocks of a node on full sets."""
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    n = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("t") / BLOCK_SHINGLES)).cast("int")
    r = rows.select("node", "id", "n").join(size.select("node", n.alias("blocks")), "node")
    r = r.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    r = r.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id")
    r = r.join(sets.withColumnRenamed("doc_id", "id"), "id")

    def compare(part: pa.Table) -> pa.Table:
        ids, sets = part["id"].to_numpy(), part["shingles"].combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        flat = sets.flatten().to_numpy()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        del flat
        df = np.diff(begin, append=len(order))
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order][np.repeat(df > 1, df)]
        column = np.repeat(np.arange((df > 1).sum(), dtype=np.int32), df[df > 1])
        del order
        shared = np.zeros((len(ids), len(ids)), np.float32)
        width = 2048
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            m = np.zeros((len(ids), width), np.float32)
            m[row[a:b], column[a:b] - lo] = 1
            shared += m @ m.T
        linked = shared * (den + num) >= num * (sizes[:, None] + sizes[None, :])
        open_, links = np.ones(len(ids), bool), []
        for root in range(len(ids)):
            todo = [root] if open_[root] else []
            open_[root] = False
            while todo:
                u = todo.pop()
                new = np.flatnonzero(linked[u] & open_)
                open_[new] = False
                todo.extend(new.tolist())
                links.extend((u, v) for v in new.tolist())
        pairs = np.array(links, np.int64).reshape(-1, 2)
        x, y = ids[pairs[:, 0]], ids[pairs[:, 1]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return r.select("node", "i", "j", "id", "shingles").groupBy("node", "i", "j").applyInArrow(
        compare, "a long, b long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of ``wanted`` and few others, written."""
    path = scratch(docs.sparkSession, "near-texts")
    marked(docs, wanted, "doc_id", slots=SLOTS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def similarity_links(docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Confirmed links ``a, b`` between documents of different sets: between every two
    similar ones at least a path of links."""
    rows = _children(reps.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(TREES)])))
                     .withColumn("node", F.col("tree").cast("long")).withColumn("used", F.lit(0).cast("long")), None)
    links, labels, texts, held = None, None, docs, None
    for level in range(1, MAX_LEVELS + 1):
        last = level == MAX_LEVELS
        rows = cut(_labelled(rows, labels)) if level > 1 else _labelled(rows, labels)
        stats = cut(_stats(rows, level == 1))
        small = F.lit(True) if last else F.col("work") <= LEAF * F.col("size")
        heavy_stats = stats.where(~small)
        heavy = cut(rows.join(heavy_stats.select("node"), "node", "left_semi"))
        found = _leaf_pairs(rows, stats.where(small), num, den)
        found = cut(found.unionByName(_pivot_pairs(heavy, heavy_stats, num, den)).distinct())
        need = cut(found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct())
        wanted = cut(need.union(heavy.select("id")).distinct())  # later levels meet documents of heavy nodes only
        n = wanted.count()
        if held is None or n * LESS < held:
            texts, held = _texts(texts, wanted), n
        sets = cut(_sets(marked(texts, need, "doc_id", slots=SLOTS), k))
        both = (found.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
                .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"))
        shared = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - shared
        new = cut(both.where(shared * den >= union * num).select("a", "b"))
        links = new if links is None else links.unionByName(new)
        if heavy.isEmpty():
            return links
        labels = cut(_near_labels(links))
        left = cut(_labelled(heavy.drop("label"), labels))
        stats = cut(_stats(left))
        tight = cut(_resembling(left, stats.where(F.col("work") > LEAF * F.col("size"))))
        if not tight.isEmpty():
            rows = left.join(tight, "node", "left_semi")
            need = rows.select(F.col("id").alias("doc_id"))
            sets = cut(_sets(marked(texts, need, "doc_id", slots=SLOTS), k))
            links = links.unionByName(cut(_block_links(rows, sets, num, den)))
            left = left.join(tight, "node", "left_anti")
        light = left.join(stats.where(F.col("work") <= LEAF * F.col("size")).select("node"), "node", "left_semi")
        split = left.join(stats.where(F.col("work") > LEAF * F.col("size")).select("node"), "node", "left_semi")
        rows = light.select(*PLACE, *POINT).unionByName(_children(split.select(*PLACE, *POINT), reps))
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
               num: int = 4, den: int = 5) -> DataFrame:
    """One row per id and set: ``doc_id, n_shingles, component_id, kept``.

    Words are the runs between blanks, A-Z as a-z; a document's set holds its distinct
    ``k``-word shingles, the whole word sequence if it has fewer words.  Documents
    with ``den * intersection >= num * union`` are linked; ``component_id`` is the
    smallest id reachable, ``kept`` whether that is the document itself.

    Null, empty and blank texts have an empty set and are linked with nothing.  Rows
    that repeat id and set come out once.  Rows with a null id are linked with nothing
    either, have a null component and are kept.  Empty tables give empty results;
    other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    small_batches(docs.sparkSession)
    sig = cut(signed(d, k))
    able = sig.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    groups = cut(able.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    # an id that stands for several sets is compared with one of them
    one = groups.groupBy(F.col("rep").alias("_id")).agg(F.min("digest").alias("_d"))
    reps = cut(able.join(one, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_d")))
               .dropDuplicates(["doc_id", "digest"])
               .select(F.col("doc_id").alias("id"), "n", "sig", "s0", "s1", "s2", "s3"))
    links = similarity_links(d, reps, k, num, den)
    member = able.select("doc_id", "digest").distinct().join(groups, "digest").select("doc_id", "rep")
    # an id that stands for several sets ties their groups together
    links = links.unionByName(member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = components(links)
    return (sig.select("doc_id", "n", "digest").distinct()
            .join(labels.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document stays, all columns unchanged."""
    from tabsmith.llm.common import free
    (gone,) = free(docs, "_gone")
    out = near_dedup(docs, id_col, text_col, k).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, F.col(id_col) == F.col(gone), "left_anti")
