"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its word n-grams. Two sets whose Jaccard similarity reaches the
threshold share a member among the first |s| - ceil(t |s|) + 1 of each in any common order; here rare
n-grams come first. Documents with the same set are one class, classes with the same prefix and size one
group. Prefix members of the groups make buckets; those that more than one class shares are expanded to
classes, pairs of classes in a bucket pass on size and on the places of the shared member, and are verified on whole sets.

Rarity is the logarithm of the number of n-grams that fall into an n-gram's bucket, of 2**22, counted over all
documents; it only orders n-grams, so its coarseness costs candidates and never a link.

Words are compared as 64-bit hashes, n-grams as 64-bit mixes of these, sets as 128-bit hashes.

Defined results: a null, empty or blank text has no set, is linked with nothing and is its own component; a
text shorter than an n-gram has its whole sequence as one; rows that repeat an id with the same text are
one document, with different texts each text is linked for itself; a null id is never named as a component
unless nothing else is there; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.llm.common import column_name, drop_stored, pieces, stored, whole_text
from roadledger.llm.links import link_buckets

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Buckets whose n-grams are counted for their rarity, and the packed stretches in which counts travel.
SKETCH_BITS, STRETCHES = 22, 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit mix."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _weights(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams at each word of all texts joined, word hashes, and the number of words of each text."""
    words = [t.encode().translate(LOWER).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = word_hashes([w for t in words for w in t])
    grams = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    for i, weight in enumerate(_weights(n) if len(grams) else ()):
        grams += flat[i:len(flat) - n + 1 + i] * weight
    return mixed(grams), flat, sizes


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    grams, flat, sizes = _grams(texts, n)
    start = 0
    for size in sizes.tolist():
        if size >= n:
            found = np.sort(grams[start:start + size - n + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif size:  # another mix than that of any full n-gram
            whole = np.sum(flat[start:start + size] * _weights(size), dtype=np.uint64) + np.uint64(size)
            yield mixed(mixed(np.array([whole], np.uint64)))
        else:
            yield flat[:0]
        start += size


def rarity(docs: DataFrame, n: int, text: str = "text") -> np.ndarray:
    """Rarity class of each of 2**22 buckets of n-grams, in eighths of a power of two, from all documents.

    A task sends its counts as packed stretches of the buckets; they are added up in two steps, so that a
    stretch's task does not see one row of every first task.
    """
    def work(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in pieces(batches, "text"):
            grams, _, sizes = _grams(batch["text"].to_pylist(), n)
            whole = np.ones(len(grams), bool)
            for back in range(1, n):  # n-grams that would run into the next text
                at = np.cumsum(sizes) - back
                whole[at[(at >= 0) & (at < len(grams))]] = False
            counts += np.bincount((grams[whole] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        task = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(STRETCHES), pa.int32()), pa.array([task] * STRETCHES, pa.int32()),
             pa.array([zlib.compress(c.astype(_least_type(c)).tobytes(), 1) for c in np.split(counts, STRETCHES)], pa.binary())],
            names=["stretch", "task", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // STRETCHES, np.int64)
        for data in group["counts"].to_pylist():
            data = zlib.decompress(data)
            total += np.frombuffer(data, f"<u{len(data) // len(total)}").astype(np.int64)
        return pa.table({"stretch": group["stretch"][:1], "task": group["task"][:1], "counts": pa.array(
            [zlib.compress(total.astype(_least_type(total)).tobytes(), 1)], pa.binary())})

    schema = "stretch int, task int, counts binary"
    sent = docs.select(whole_text(text).alias("text")).mapInArrow(work, schema).groupBy("stretch", "task").applyInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    width = len(out) // STRETCHES
    for stretch, _, data in sent.groupBy("stretch").applyInArrow(add, schema).collect():  # STRETCHES rows, 32 MB at most
        data = zlib.decompress(data)
        counts = np.frombuffer(data, f"<u{len(data) // width}").astype(np.float64)
        out[stretch * width:(stretch + 1) * width] = np.minimum(8 * np.log2(counts + 1), 255)
    return out


def _least_type(counts: np.ndarray) -> str:
    most = int(counts.max(initial=0))
    return "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"


def _signed(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def prefixes(docs: DataFrame, n: int, percent: int, classes: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, c_hi, c_lo, g_hi, g_lo, prefix): set size, names of set and group, and prefix."""
    held = docs.sparkSession.sparkContext.broadcast(classes)  # 4 MB

    def work(batches):
        classes = held.value
        for batch in pieces(batches, "text"):
            size, whole, group, prefix = [], [], [], []
            for s in shingle_sets(batch["text"].to_pylist(), n):
                rare = classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = s[np.argsort(rare, kind="stable")[:len(s) + (-percent * len(s)) // 100 + 1]] if len(s) else s
                size.append(len(s))
                prefix.append(first.view(np.int64))
                whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                group.append(xxhash.xxh3_128_digest(len(s).to_bytes(8, "little") + first.tobytes()))
            w, g = _signed(whole), _signed(group)
            cuts = pa.array(np.cumsum([0, *map(len, prefix)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(size, pa.int64()), *[pa.array(c) for c in (w[:, 0], w[:, 1], g[:, 0], g[:, 1])],
                 pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(prefix)))],
                names=["doc_id", "n_shingles", "c_hi", "c_lo", "g_hi", "g_lo", "prefix"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(
        "n_shingles bigint, c_hi bigint, c_lo bigint, g_hi bigint, g_lo bigint, prefix array<bigint>").fields])
    return docs.select("doc_id", whole_text(text).alias("text")).mapInArrow(work, schema)


def _class_sets(docs: DataFrame, wanted: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(id, set) of the classes ``wanted`` (id, c_hi, c_lo), read off the document that names each.

    A document that is in the table twice gives its set twice, which does no harm to a join for links.
    """
    def work(batches):
        for batch in pieces(batches, "text"):
            sets = list(shingle_sets(batch["text"].to_pylist(), n))
            names = _signed([xxhash.xxh3_128_digest(s.tobytes()) for s in sets])
            right = np.flatnonzero((names[:, 0] == batch["c_hi"].to_numpy()) & (names[:, 1] == batch["c_lo"].to_numpy()))
            kept = [sets[i] for i in right]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(right)), pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, kept)]).astype(np.int32)), pa.array(np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)))],
                names=["id", "set"])

    rows = wanted.join(docs.select("doc_id", whole_text(text).alias("text")), F.col("id") == F.col("doc_id")).select("id", "c_hi", "c_lo", "text")
    return rows.mapInArrow(work, "id bigint, set array<bigint>")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, row_class) of every row; see the module for what links.

    row_class names the document's class: the smallest id of a document with the same set.
    """
    classes = rarity(docs, n, text)
    rows = stored(prefixes(docs, n, percent, classes, text), "prefixes")
    named = stored(rows.where("n_shingles > 0").groupBy("c_hi", "c_lo").agg(
        F.min("doc_id").alias("id"), F.first("g_hi").alias("g_hi"), F.first("g_lo").alias("g_lo"),
        F.first("n_shingles").alias("n")).where("id is not null"), "classes")
    groups = named.groupBy("g_hi", "g_lo").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("classes"))
    firsts = rows.join(groups.select("gid", "classes", F.col("g_hi").alias("hi"), F.col("g_lo").alias("lo")),
                       (F.col("doc_id") == F.col("gid")) & (F.col("g_hi") == F.col("hi")) & (F.col("g_lo") == F.col("lo")))
    listed = firsts.select("gid", "classes", "n_shingles", F.posexplode("prefix").alias("pos", "bucket"))
    # of a bucket alone no name of its group travels; a row that repeats its id only lets a bucket more through
    shared = listed.groupBy("bucket").agg(F.sum("classes").alias("held")).where("held > 1").select("bucket")
    group_entries = listed.join(shared, "bucket").select("bucket", "gid", F.col("n_shingles").alias("n"), F.col("pos").cast("long").alias("pos"))

    def near(x, y) -> Column:
        # both sizes allow the similarity, and so do the members from the shared one on, it being the first shared
        rest = F.least(x("n") - x("pos"), y("n") - y("pos"))
        return ((100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")))
                & ((100 + percent) * rest >= percent * (x("n") + y("n"))))

    members = named.join(groups.select("gid", "g_hi", "g_lo"), ["g_hi", "g_lo"]).select("gid", "id")
    entries = stored(group_entries.join(members, "gid").select("bucket", "id", "n", "pos"), "entries")

    def of(side):
        return lambda name: F.col(f"{side}.{name}")

    live = stored(entries.alias("x").join(entries.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") != F.col("y.id"))
                                          & near(of("x"), of("y")), "left_semi"), "live")
    drop_stored(entries)
    wanted = live.select("id").distinct().join(named.select("id", "c_hi", "c_lo"), "id")
    sets = stored(_class_sets(docs, wanted, n, text), "sets")

    heads = stored(wanted.select("id").join(members, "id").join(firsts.select("gid", F.col("n_shingles").alias("n"), "prefix"), "gid")
                   .select("id", "n", "prefix"), "heads")

    def verify(pairs: DataFrame) -> DataFrame:
        # of the prefix that ends first in the common order, all members but n - overlap are shared
        first = pairs.join(heads.toDF("a", "na", "pa"), "a").join(heads.toDF("b", "nb", "pb"), "b")
        both_n = F.col("na") + F.col("nb")
        overlap = F.ceil(percent * both_n / (100 + percent))
        least = F.least(F.size("pa") - F.col("na"), F.size("pb") - F.col("nb")) + overlap
        first = first.where(F.size(F.array_intersect("pa", "pb")) >= least).select("a", "b", "ra", "rb").distinct()
        both = first.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b", "ra", "rb")

    roots = link_buckets(live, ["n", "pos"], near, verify)
    top = named.join(roots, "id", "left").select("c_hi", "c_lo", F.col("id").alias("row_class"), F.coalesce("root", "id").alias("root"))
    return rows.drop("prefix", "g_hi", "g_lo").join(top, ["c_hi", "c_lo"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"), "row_class")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that name their component, one row of each, and those without words, with all columns."""
    found = jaccard_components(docs, n, percent)
    kept, size = column_name(docs, "kept_id"), column_name(docs, "set_size")
    # a row is kept by its id; of rows that repeat an id, those whose text is the one that names the component
    names = found.where("doc_id is null or n_shingles = 0 or doc_id = component_id").groupBy("doc_id").agg(F.max("n_shingles").alias(size))
    names = names.select(F.col("doc_id").alias(kept), size)
    joined = docs.join(names, docs["doc_id"].eqNullSafe(names[kept]))
    nth = column_name(docs, "nth_equal")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return joined.withColumn(nth, F.row_number().over(same)).where((F.col(nth) == 1) | (F.col(size) == 0)).select(*docs.columns)
