r"""Byte-level BPE: encoding by prefix dynamic programming, and decoding.

Every prefix of a piece of text has exactly one last token in its encoding. It is the one token ending
there whose left neighbour, the last token of the prefix before it, may stand next to it; two tokens may
stand side by side if the merges, applied to their bytes alone, give back the two. ``PrefixEncoder``
stores that token for each prefix: the ids are read off backwards, ``append`` goes on from the stored
prefixes, and ``replace`` recomputes from the edit until the stored tokens repeat.

Texts are first cut where any match of the pattern must end, at the start of each white-space run, so
equal chunks are encoded once per worker (up to a bound).

Defined results: a null text encodes as an empty one, to no ids; special tokens are ordinary text;
repeated rows and ids are independent; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadledger.llm.chunks import ChunkCache
from roadledger.llm.common import column_name, pieces, ragged_take, whole_text

# Fixed value: Unicode white space, as the pattern's \s means it.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: Pieces that a worker remembers, in two halves: those not met again while the newer half filled up are forgotten.
REMEMBER = 1 << 18
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The merges of a rank table, and which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 1 << 20):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.adjacent = lru_cache(remember)(self._adjacent)

    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of a short byte string: the lowest-ranked pair is joined until none is left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _adjacent(self, left: bytes, right: bytes) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])


class PrefixEncoder:
    """Encoding of one byte string that grows by ``append`` and changes by ``replace``.

    last[i] is the length of the last token of the first i + 1 bytes.
    """

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def _token_ending(self, stop: int) -> int:
        data, last, ranks, adjacent = self.data, self.last, self.merges.ranks, self.merges.adjacent
        for start in range(max(0, stop - self.merges.longest), stop):
            token = data[start:stop]
            if token in ranks and adjacent(data[start - last[start - 1]:start] if start else b"", token):
                return stop - start
        raise ValueError("the ranks lack a byte")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        data = self.data = self.data + more
        last, ranks, adjacent, longest = self.last, self.merges.ranks, self.merges.adjacent, self.merges.longest
        for stop in range(at + 1, len(data) + 1):
            for start in range(stop - longest if stop > longest else 0, stop):
                token = data[start:stop]
                if token in ranks and adjacent(data[start - last[start - 1]:start] if start else b"", token):
                    last.append(stop - start)
                    break
            else:
                raise ValueError("the ranks lack a byte")

    def cut(self, size: int) -> None:
        """Keep the first ``size`` bytes."""
        self.data = self.data[:size]
        del self.last[size:]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:stop]; returns how many prefixes were recomputed.

        Once as many stored tokens in a row as the longest token has bytes come out as before, all later
        ones do: a prefix's token depends on nothing further back.
        """
        kept, old = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        same, done = 0, len(new)
        self.data += kept
        for i, was in enumerate(old):
            now = self._token_ending(len(self.last) + 1)
            self.last.append(now)
            done += 1
            same = same + 1 if now == was and now <= i + 1 else 0
            if same > self.merges.longest:
                self.last += old[i + 1:]
                break
        return done

    def tokens(self) -> list[bytes]:
        out, at = [], len(self.data)
        while at:
            out.append(self.data[at - self.last[at - 1]:at])
            at -= len(out[-1])
        return out[::-1]


class ByteBpe:
    """Ids of chunks of text by a rank file and a pattern, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.merges, self.pattern = Merges(self.ranks), regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.cache = ChunkCache(self.encode_chunks)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        size = np.zeros(tokens[-1][1] + 1, np.int64)
        size[[i for _, i in tokens]] = [len(t) for t, _ in tokens]
        self.sizes, self.starts = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)

    def _learn(self, texts: set[str]) -> None:
        """Encode new pieces in byte order: each goes on from the prefix that it shares with the one before."""
        if len(self.known) > REMEMBER // 2:
            self.older, self.known = self.known, {}
        missing = [t for t in texts if t not in self.known]
        self.known.update((t, self.older[t]) for t in missing if t in self.older)
        encoder = PrefixEncoder(self.merges)
        for data in sorted(t.encode() for t in missing if t not in self.known):
            if data in self.ranks:  # a piece that is a token is that token, reachable by merges or not
                ids = (self.ranks[data],)
            else:
                shared = len(os.path.commonprefix([data, encoder.data]))
                encoder.cut(shared)
                encoder.append(data[shared:])
                ids = tuple(map(self.ranks.__getitem__, encoder.tokens()))
            self.known[data.decode()] = ids

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(c) for c in chunks]
        self._learn({p for s in split for p in s})
        return [[i for p in s for i in self.known[p]] for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a worker process; its memory of chunks and pairs outlives a task."""
    return ByteBpe(path, pattern)


def encoded_batches(batches, text: str, path: str, pattern: str):
    """(batch, ids of all its texts, number of ids of each, tokenizer) for bounded pieces of the batches."""
    bpe = load(path, pattern)
    for batch in pieces(batches, text):
        ids, sizes = bpe.cache.encode_texts([CHUNK.findall(t) for t in batch[text].to_pylist()])
        yield batch, ids, sizes, bpe


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array column ``ids`` of its text's token ids; ids of every row of whole texts."""
    whole = column_name(df, "whole_text")
    rest = df.columns

    def work(batches):
        for batch, flat, sizes, _ in encoded_batches(batches, whole, path, pattern):
            values = pa.array(flat.astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], lists], names=[*rest, ids])

    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.withColumn(whole, whole_text(text)).mapInArrow(work, schema)


def encoding_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    def work(batches):
        for batch, flat, sizes, bpe in encoded_batches(batches, text, path, pattern):
            cuts = np.append(0, np.cumsum(sizes))
            data, byte_cuts = bpe.decode(flat), np.append(0, np.cumsum(bpe.sizes[flat]))[cuts]
            raw = memoryview(flat.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array(sizes, pa.int64()),
                 pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string()),
                 pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(byte_cuts, byte_cuts[1:])], pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string").fields])
    return df.select(key, whole_text(text).alias(text)).mapInArrow(work, schema)
