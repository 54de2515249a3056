"""Token ids in binary shards, with a minimal perfect hash index from document keys to their place.

``write_ids`` deals documents out by ranges of their key, so shards follow each other in ascending key
order, and each task writes one shard: a file of raw little-endian ids and a file of row offsets. The
index is cut by a hash of the key; each part is a minimal perfect hash over its keys (bit arrays by level:
keys that meet in a slot go on to the next level), with a fingerprint, shard, row and number of rows per
slot. A lookup reads one index part, tests a few bits, compares the fingerprint, and knows the bytes to read.

Files are written under a temporary name and moved, so a task that runs again leaves the same files.

Defined results: a null text is encoded as an empty one; rows that repeat a key lie together, ordered by
text, and the key finds them all; rows without a key come first and are read by row; a key that is not
there is found with probability 2**-32 at most and gives no row otherwise; an empty table gives an
empty store.
"""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.llm.chunks import ChunkCache
from roadledger.llm.common import new_folder, pieces, whole_text

#: Slots per key on each level of the hash.
SPREAD = 1.5


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of integer keys that differs by level; one to one on each level."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """Numbers distinct integer keys from 0 to n - 1; other keys get some number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, total = levels, [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            words = -(-max(64, int(SPREAD * len(keys))) // 64)
            slot = (mixed(keys, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(slot, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[slot]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            slot = mixed(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (slot // np.uint64(64)).astype(np.int64), slot % np.uint64(64)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[word] & (np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = ranks[word[hit]] + below[hit]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 40) >> np.uint64(32)).astype(np.uint32)


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_file(folder: str, name: str, data: bytes) -> None:
    """The file under its name once it is whole."""
    fs, path = _files(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    fs, path = _files(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def read_range(folder: str, name: str, start: int, size: int) -> bytes:
    fs, path = _files(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read_at(size, start)


@dataclass(frozen=True)
class IdStore:
    """A folder of shards and index parts; ``entries`` is the table of rows in it."""

    folder: str
    width: int
    parts: int
    entries: DataFrame

    @property
    def bases(self) -> DataFrame:
        """(shard, base): ids in all shards before; one row per shard."""
        sums = self.entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        return sums.select("shard", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("n")).alias("base"))


def write_ids(docs: DataFrame, encode: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], width: int,
              shards: int | None = None, key: str = "doc_id", text: str = "text") -> IdStore:
    """Encode the documents, write the shards and the index, and return the store.

    ``encode()`` is called once a task and gives a function from texts to (ids joined, ids per text).
    ``shards`` is the number of ranges of the key, by default that of shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "ids")
    dtype = f"<u{width}"

    def write(batches):
        shard, rows, at, encoder, payload, tables = TaskContext.get().partitionId(), 0, 0, None, io.BytesIO(), [np.zeros(1, "<i8")]
        for batch in pieces(batches, "text"):
            encoder = encoder or encode()
            ids, sizes = encoder(batch["text"].to_pylist())
            payload.write(ids.astype(dtype).tobytes())
            ends = at + np.cumsum(sizes)
            tables.append(ends.astype("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array([shard] * len(sizes), pa.int32()), pa.array(rows + np.arange(len(sizes))),
                 pa.array(ends - sizes), pa.array(sizes)], names=["key", "shard", "row", "at", "n_tokens"])
            rows, at = rows + len(sizes), int(ends[-1])
        if rows:
            write_file(folder, f"ids-{shard:06d}.bin", payload.getbuffer())
            write_file(folder, f"rows-{shard:06d}.bin", np.concatenate(tables).tobytes())

    ranged = (docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
              .repartitionByRange(shards, "key").sortWithinPartitions("key", "text"))
    schema = "key bigint, shard int, row bigint, at bigint, n_tokens bigint"
    ranged.mapInArrow(write, schema).write.parquet(f"{folder}/entries")
    entries = spark.read.schema(schema).parquet(f"{folder}/entries")
    store = IdStore(folder, width, shards, entries)
    _write_index(store)
    return store


def _part(store: IdStore):
    return F.pmod(F.xxhash64("key"), F.lit(store.parts)).cast("int").alias("part")


def _write_index(store: IdStore) -> None:
    folder = store.folder

    def build(group: pa.Table) -> pa.Table:
        keys = group["key"].to_numpy()
        perfect = PerfectHash.build(keys)
        slot = perfect(keys)
        arrays = {f"level{i}": w for i, w in enumerate(perfect.levels)}
        for name, kind in (("shard", np.int32), ("row", np.int64), ("n_rows", np.int64)):
            arrays[name] = np.empty(len(keys), kind)
            arrays[name][slot] = group[name].to_numpy()
        arrays["print"] = np.empty(len(keys), np.uint32)
        arrays["print"][slot] = fingerprints(keys)
        out = io.BytesIO()
        np.savez(out, **arrays)
        part = group["part"][0].as_py()
        write_file(folder, f"index-{part:06d}.npz", out.getvalue())
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    first = store.entries.where("key is not null").groupBy("key").agg(
        F.min(F.struct("shard", "row")).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    first = first.select("key", _part(store), "first.shard", "first.row", "n_rows")
    first.groupBy("part").applyInArrow(build, "part int, n bigint").write.format("noop").mode("overwrite").save()


@lru_cache(4)
def open_part(folder: str, part: int) -> tuple[PerfectHash, dict[str, np.ndarray]] | None:
    try:
        data = read_file(folder, f"index-{part:06d}.npz")
    except FileNotFoundError:
        return None  # no key fell to this part
    arrays = dict(np.load(io.BytesIO(data)))
    return PerfectHash([arrays[f"level{i}"] for i in range(sum(n.startswith("level") for n in arrays))]), arrays


def find(folder: str, part: int, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which of the keys the index part holds, and shard, row and n_rows of those."""
    opened = open_part(folder, part)
    if opened is None:
        return np.zeros(len(keys), bool), {n: np.zeros(0, np.int64) for n in ("shard", "row", "n_rows")}
    perfect, arrays = opened
    slot = perfect(keys)
    hit = (slot >= 0) & (arrays["print"][np.maximum(slot, 0)] == fingerprints(keys))
    return hit, {n: arrays[n][slot[hit]] for n in ("shard", "row", "n_rows")}


def look_up(store: IdStore, keys: DataFrame) -> DataFrame:
    """(key, shard, row, n_rows) of the distinct keys that the store's index holds; ``keys`` has column key."""
    folder = store.folder

    def work(group: pd.DataFrame) -> pd.DataFrame:
        k = group["key"].to_numpy()
        hit, found = find(folder, int(group["part"].iloc[0]), k)
        return pd.DataFrame({"key": k[hit], **found})

    asked = keys.select(F.col("key").cast("long").alias("key")).where("key is not null").distinct()
    return asked.select("key", _part(store)).groupBy("part").applyInPandas(work, "key bigint, shard int, row bigint, n_rows bigint")


def read_ids(store: IdStore, places: DataFrame, digest: bool = False) -> DataFrame:
    """Ids (or, with ``digest``, n_tokens and ids_crc32) of the rows at (key, shard, row, n_rows), with ``start``.

    The rows of a shard are read together in ascending order, a run of neighbouring rows at once.
    """
    folder, width = store.folder, store.width

    def read(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        base = group["base"][0].as_py()
        order = np.argsort(group["row"].to_numpy(), kind="stable")
        group = group.take(order)
        n_rows, row = group["n_rows"].to_numpy(), group["row"].to_numpy()
        rows = np.repeat(row - np.cumsum(n_rows) + n_rows, n_rows) + np.arange(n_rows.sum())
        keys = group["key"].take(np.repeat(np.arange(len(row)), n_rows))
        offsets = np.frombuffer(read_file(folder, f"rows-{shard:06d}.bin"), "<i8")
        start, stop = offsets[rows], offsets[rows + 1]
        values = []
        for cut in np.split(np.arange(len(rows)), np.flatnonzero(start[1:] != stop[:-1]) + 1):
            first, last = int(start[cut[0]]), int(stop[cut[-1]])
            ids = np.frombuffer(read_range(folder, f"ids-{shard:06d}.bin", first * width, (last - first) * width), f"<u{width}").astype("<u4")
            values += [ids[a - first:b - first] for a, b in zip(start[cut].tolist(), stop[cut].tolist())]
        out = {"key": keys, "start": pa.array(base + start), "n_tokens": pa.array(stop - start)}
        if digest:
            out["ids_crc32"] = pa.array([zlib.crc32(v.tobytes()) for v in values], pa.int64())
        else:
            out["ids"] = pa.array([v.astype(np.int32) for v in values], pa.list_(pa.int32()))
        return pa.table(out)

    with_base = places.join(store.bases, "shard")
    last = "ids_crc32 bigint" if digest else "ids array<int>"
    return with_base.groupBy("shard").applyInArrow(read, f"key bigint, start bigint, n_tokens bigint, {last}")


def keyless(store: IdStore) -> DataFrame:
    """Places of the rows without a key."""
    return store.entries.where("key is null").select("key", "shard", "row", F.lit(1).cast("long").alias("n_rows"))


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Texts of ASCII and Latin letters, whose words may be cut further where the tokenizer always cuts: between
#: letters and ASCII signs or digits. A word with an apostrophe stays whole, as 's and the like are pieces.
PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
RUNS = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\s]+")
RUNS_QUOTED = re.compile(rb"\S*'\S*|" + RUNS.pattern)


def word_chunks(text: str) -> list[bytes]:
    """Parts of a text that the word tokenizer encodes independently, A-Z lower-cased where it would be."""
    if "<|" in text or not PLAIN.fullmatch(text):
        return text.encode().split()  # cuts at ASCII white space only, all of it white space to the tokenizer too
    return (RUNS_QUOTED if "'" in text else RUNS).findall(text.encode().translate(LOWER))


@lru_cache(2)
def _word_cache(path: str, end: int) -> ChunkCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # an empty chunk stands for the end
    return ChunkCache(lambda chunks: [e.ids if c else [end] for c, e in zip(
        chunks, tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False))])


def word_encoder(path: str, end: int) -> Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]:
    """Encoder by a tokenizer file that lower-cases and drops white space; ``end`` ends each text.

    The library encodes each distinct chunk once a worker, up to a bound.
    """
    def encode():
        cache = _word_cache(path, end)
        return lambda texts: cache.encode_texts([[*word_chunks(t), b""] for t in texts])

    return encode
