"""LM scoring by prediction by partial matching over bytes, with a word model as its base.

The model is a trie of byte contexts up to ``ORDER`` bytes with the symbols that followed them in the
training documents. A symbol is predicted in its longest context; one not seen there costs an escape,
t / (n + t) for t symbols seen n times, and is tried in the next shorter context, from whose counts the
symbols of the longer one are excluded; below the empty context all symbols not seen at all are equal.
The code length of a text adds up over its bytes and an end symbol.

Nothing of the size of the corpus is held in one place. Documents are packed into blocks of a few MB. A
block lists its distinct words and (context, symbol) grams with training counts, cut into parts by hash;
grams with the same last two context bytes fall into one part, so a part holds whole subtries. Each part
sums the counts over all blocks, computes each gram's log probability once, and sends every block the
values it asked for; only the statistics of contexts of one byte or none, at most 65,536 numbers, go to
all parts. Blocks then add up their documents. Moves are packed arrays, one row per (block, part).

A-Z are lower-cased. Words are known by 64-bit hashes. Start of text is four bytes 0xFE, its end one 0xFF;
neither occurs in UTF-8.

Defined results: a null text is empty and costs its end symbol; a null id counts as the empty id; repeated
rows count as often as they occur; without training documents all symbols are equal and no word is
known; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadledger.llm.common import pieces, stored, whole_text
from roadledger.llm.jaccard import LOWER, mixed, word_hashes

ORDER, START, END, SYMBOLS = 4, 0xFE, 0xFF, 256
BLOCK_BYTES, WINDOW = 4 << 20, 4 << 20


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, which are small or at least alike in their high bytes."""
    return pack(np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.copy())


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """Words and grams of some documents, in the order in which parts are asked for them."""

    def __init__(self, texts: list[str], parts: int):
        raw = [t.encode().translate(LOWER) for t in texts]
        words = [r.split() for r in raw]
        self.n_words = np.fromiter(map(len, words), np.int64, len(words))
        vocabulary: dict[bytes, int] = {}
        self.word = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in words for w in t), np.int64, int(self.n_words.sum()))
        hashes = word_hashes(list(vocabulary))
        self.words, self.word_parts, place = self._by_part(hashes, hashes, parts)
        self.word = place[self.word]
        head = bytes([START]) * ORDER
        self.bytes = np.frombuffer(b"".join(x for r in raw for x in (head, r, bytes([END]))), np.uint8)
        self.doc = np.repeat(np.arange(len(raw)), [len(r) + ORDER + 1 for r in raw])
        found = [np.unique(codes) for codes, _ in self.windows()]
        grams = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.grams, self.gram_parts, place = self._by_part(grams, grams >> np.uint64(8) & np.uint64(0xFFFF), parts)
        self._gram_index, self._gram_place = pd.Index(grams.view(np.int64)), place

    @staticmethod
    def _by_part(keys: np.ndarray, shared: np.ndarray, parts: int):
        """Keys by (part, key), where each part ends, and the new place of each key."""
        part = (mixed(shared) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((keys, part))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], np.searchsorted(part[order], np.arange(parts + 1)), place

    def windows(self):
        """(gram of each symbol, its document) over stretches of the bytes."""
        for start in range(ORDER, len(self.bytes), WINDOW):
            stop = min(start + WINDOW, len(self.bytes))
            code = np.zeros(stop - start, np.uint64)
            for back in range(ORDER, -1, -1):
                code = code << np.uint64(8) | self.bytes[start - back:stop - back]
            symbol = self.bytes[start:stop] != START
            yield code[symbol], self.doc[start:stop][symbol]

    def gram_numbers(self):
        """(place of each symbol's gram in ``grams``, its document) over stretches."""
        for code, doc in self.windows():
            yield self._gram_place[self._gram_index.get_indexer(code.view(np.int64))], doc


def pack_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of each block: one (part -1) with its documents, and one per part with keys and training counts.

    ``docs`` has doc_id, held_out and text.
    """
    def work(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", BLOCK_BYTES):
            block = Block(batch["text"].to_pylist(), parts)
            train = ~batch["held_out"].to_numpy(zero_copy_only=False)
            word_n = np.bincount(block.word[np.repeat(train, block.n_words)], minlength=len(block.words)).astype(np.uint32)
            gram_n, pair_n = np.zeros(len(block.grams), np.int64), np.zeros(1 << 16, np.int64)
            for gram, doc in block.gram_numbers():
                gram_n += np.bincount(gram[train[doc]], minlength=len(gram_n))
            np.add.at(pair_n, (block.grams & np.uint64(0xFFFF)).astype(np.int64), gram_n)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            pairs = np.flatnonzero(pair_n)
            rows = [{"block": number, "part": -1, "docs": sink.getvalue().to_pybytes(), "pairs": pairs.astype(np.int32), "pair_n": pair_n[pairs],
                     "train_words": int(block.n_words[train].sum()), "train_docs": int(train.sum())}]
            for p in range(parts):
                w, g = slice(*block.word_parts[p:p + 2]), slice(*block.gram_parts[p:p + 2])
                if w.stop > w.start or g.stop > g.start:
                    rows.append({"block": number, "part": p, "words": pack_sorted(block.words[w]), "word_n": pack(word_n[w]),
                                 "grams": pack_sorted(block.grams[g]), "gram_n": pack(gram_n[g].astype(np.uint32))})
            number += 1
            yield pa.RecordBatch.from_pylist(rows, schema=BLOCKS)

    return docs.mapInArrow(work, BLOCKS_DDL)


BLOCKS_DDL = """block bigint, part int, docs binary, pairs array<int>, pair_n array<bigint>, train_words bigint, train_docs bigint,
    words binary, word_n binary, grams binary, gram_n binary"""
BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("docs", pa.binary()), ("pairs", pa.list_(pa.int32())), ("pair_n", pa.list_(pa.int64())),
                    ("train_words", pa.int64()), ("train_docs", pa.int64()), ("words", pa.binary()), ("word_n", pa.binary()),
                    ("grams", pa.binary()), ("gram_n", pa.binary())])


def gram_log10(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after the others, from whole subtries.

    ``grams`` ascend and include, for every two-byte context among them, all that were seen in training;
    ``counts`` are their training counts, ``pairs[c, s]`` those of symbol s after byte c.
    """
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    last_byte = (grams >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
    symbol = (grams & np.uint64(0xFF)).astype(np.int64)
    single = pairs.sum(axis=0)

    def step(seen, n, t):
        nonlocal open_
        with np.errstate(divide="ignore", invalid="ignore"):
            hit, miss = open_ & (seen > 0), open_ & (seen == 0) & (n + t > 0)
            out[hit] += np.log10(seen[hit] / (n + t)[hit])
            out[miss] += np.log10(t[miss] / (n + t)[miss])
        open_ &= seen == 0

    # by order, longest first: count of the gram, its context's totals, and what its context takes from the next order
    below_n, below_t = np.zeros(len(grams)), np.zeros(len(grams))
    for order in range(ORDER, 1, -1):
        key, first, back = np.unique(grams & np.uint64((1 << 8 * (order + 1)) - 1), return_index=True, return_inverse=True)
        count = np.bincount(back, weights=counts, minlength=len(key))
        _, context = np.unique(key >> np.uint64(8), return_inverse=True)
        n, t = np.bincount(context, weights=count), np.bincount(context, weights=count > 0)
        step(count[back], n[context][back] - below_n, t[context][back] - below_t)
        if order > 2:
            shorter, at = np.unique(grams & np.uint64((1 << 8 * order) - 1), return_inverse=True)
            next_count = np.bincount(at, weights=counts, minlength=len(shorter))[at][first]
        else:
            next_count = pairs[last_byte[first], symbol[first]]
        taken = np.bincount(context, weights=np.where(count > 0, next_count, 0))
        below_n, below_t = taken[context][back], t[context][back]
    step(pairs[last_byte, symbol], pairs.sum(axis=1)[last_byte] - below_n, (pairs > 0).sum(axis=1)[last_byte] - below_t)
    below_n, below_t = ((pairs > 0) * single).sum(axis=1)[last_byte], (pairs > 0).sum(axis=1)[last_byte]
    step(single[symbol], single.sum() - below_n, (single > 0).sum() - below_t)
    out[open_] -= math.log10(max(1, SYMBOLS - (single > 0).sum()))
    return out


VALUES_DDL = "block bigint, part int, word_count binary, gram_log10 binary, distinct_words bigint"
VALUES = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("word_count", pa.binary()), ("gram_log10", pa.binary()), ("distinct_words", pa.int64())])


def part_values(blocks: DataFrame, pairs: np.ndarray) -> DataFrame:
    """For every (block, part): counts of its words over all training documents, and its grams' log10 probabilities."""
    def work(group: pa.Table) -> pa.Table:
        def summed(keys: str, n: str):
            lists = [unpack_sorted(x) for x in group[keys].to_pylist()]
            key, back = np.unique(np.concatenate(lists), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([unpack(x, np.uint32) for x in group[n].to_pylist()]), minlength=len(key))
            return key, count, np.split(back, np.cumsum([len(x) for x in lists])[:-1])

        _, word_n, word_at = summed("words", "word_n")
        grams, gram_n, gram_at = summed("grams", "gram_n")
        logs, word_n = gram_log10(grams, gram_n, pairs), word_n.astype(np.int64)
        rows = [{"block": b, "part": p, "word_count": pack(word_n[w]), "gram_log10": pack(logs[g]), "distinct_words": 0}
                for b, p, w, g in zip(group["block"].to_pylist(), group["part"].to_pylist(), word_at, gram_at)]
        rows[0]["distinct_words"] = int((word_n > 0).sum())
        return pa.Table.from_pylist(rows, schema=VALUES)

    return blocks.where("part >= 0").select("block", "part", "words", "word_n", "grams", "gram_n").groupBy("part").applyInArrow(work, VALUES_DDL)


def block_scores(blocks: DataFrame, values: DataFrame, parts: int, id_type: T.DataType) -> DataFrame:
    """(doc_id, held_out, n_words, n_known, log_counts, score) of the documents of all blocks."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = pa.ipc.open_stream(left["docs"][0].as_py()).read_all()
        block = Block(docs["text"].to_pylist(), parts)
        right = right.sort_by("part")
        none = [np.zeros(0)]
        count = np.concatenate([unpack(x, np.int64) for x in right["word_count"].to_pylist()] or none)
        logs = np.concatenate([unpack(x, np.float64) for x in right["gram_log10"].to_pylist()] or none)
        doc = np.repeat(np.arange(docs.num_rows), block.n_words)
        score = np.zeros(docs.num_rows)
        for gram, of in block.gram_numbers():
            score += np.bincount(of, weights=logs[gram], minlength=docs.num_rows)
        held = count[block.word]
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_words": block.n_words,
            "n_known": np.bincount(doc[held > 0], minlength=docs.num_rows).astype(np.int64),
            "log_counts": np.bincount(doc, weights=np.log10(held + 0.5), minlength=docs.num_rows), "score": score})

    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(
        "held_out boolean, n_words bigint, n_known bigint, log_counts double, score double").fields])
    return blocks.where("part = -1").select("block", "docs").groupBy("block").cogroup(
        values.select("block", "part", "word_count", "gram_log10").groupBy("block")).applyInArrow(work, schema)


def held_out(key: Column) -> Column:
    """Every document whose id, as text, has a CRC-32 of remainder 1 by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score_documents(docs: DataFrame, held: Column | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents.

    ``held`` marks the documents that are not learnt from. ``parts`` is the number of model parts, by
    default twice that of shuffle partitions.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = docs.select("doc_id", (held_out(F.col("doc_id")) if held is None else held).alias("held_out"), whole_text().alias("text"))
    blocks = stored(pack_blocks(marked, parts), "blocks")
    heads = blocks.where("part = -1")
    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    each = heads.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).groupBy("p.pairs").agg(F.sum("p.pair_n").alias("n"))
    for pair, n in each.collect():  # at most 65,536 rows
        pairs[pair >> 8, pair & 0xFF] = n
    values = stored(part_values(blocks, pairs), "values")
    totals = heads.agg(F.sum("train_words").alias("w"), F.sum("train_docs").alias("d")).first()
    distinct = values.agg(F.sum("distinct_words")).first()[0] or 0
    ends = totals["d"] or 0
    tokens, distinct = (totals["w"] or 0) + ends, distinct + (ends > 0)
    norm = math.log10(tokens + 0.5 * (distinct + 1))
    found = block_scores(blocks, values, parts, docs.schema["doc_id"].dataType)
    base = F.col("log_counts") + math.log10(ends + 0.5) - (F.col("n_words") + 1) * norm
    return found.select("doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"),
                        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
