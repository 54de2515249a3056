"""The queried form of the quality score by brute force, and chunk memory that turns over."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

from roadledger.llm import byte_bpe, chunks, quality
from roadledger.llm.queries import BYTE_RANKS


def grams(text):
    words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    single = [xxhash.xxh64_intdigest(w, 42) for w in words]

    def pair(a, b):
        first = xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)
        return xxhash.xxh64_intdigest(struct.pack("<Q", b), first)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    return [signed(x) for x in [*single, *[pair(a, b) for a, b in zip(single, single[1:])]]]


def test_score_with_prior_equals_brute_force(spark):
    rng = random.Random(5)
    good = ["alpha", "beta", "gamma", "été", "日本"]
    bad = ["zz", "qq", "x9"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "alpha " * 4000), (203, "one\ttwo\x0bthree\r\nfour"), (None, "alpha beta")]
    trusted = [i for i, _ in rows if i is not None and i % 3][:50]
    docs = spark.createDataFrame([(i, t, 1, "h", "p") for i, t in rows], "doc_id long, text string, score int, hashes string, pairs string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*trusted, trusted[0]]], "doc_id long")
    for buckets in (64, 100):
        every, own = Counter(), Counter()
        for i, t in rows:
            found = [g % buckets for g in grams(t)]
            every.update(found)
            own.update(found if i in trusted else [])
        share = sum(own.values()) / sum(every.values())
        ratio = [round(math.log((own[b] / share + 2.0) / (every[b] + 2.0)), 4) for b in range(buckets)]
        got = quality.quality_columns(docs, ids, ["doc_id"], buckets=buckets, prior=2.0, threshold=-0.05).collect()
        assert len(got) == len(rows)
        for r in got:
            text = next(t for i, t in rows if i == r["doc_id"])
            found = [g % buckets for g in grams(text)]
            want = sum(ratio[b] for b in found) / len(found) if found else 0.0
            assert math.isclose(r["score"], want, abs_tol=2e-4), (r["doc_id"], r["score"], want)
            assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.05)
    none = quality.quality_columns(docs, ids.where("false"), ["doc_id"], buckets=64, prior=2.0).collect()
    assert all(r["score"] == 0 for r in none)
    assert quality.quality_columns(docs.where("false"), ids, ["doc_id"], buckets=64, prior=2.0).collect() == []


def test_memory_that_turns_over_gives_the_same_ids(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé 日'1\n") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = ["".join(rng.choice(words[:40] if rng.random() < .7 else words) for _ in range(60)) for _ in range(80)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTE_RANKS), special_tokens={})
    monkeypatch.setattr(byte_bpe, "REMEMBER", 64)
    bpe = byte_bpe.ByteBpe(BYTE_RANKS, public_tokenizers.PATTERN)
    calls = []

    def counted(found):
        calls.extend(found)
        return bpe.encode_chunks(found)

    bpe.cache = chunks.ChunkCache(counted, remember=200)
    for i in range(0, len(texts), 4):
        ids, sizes = bpe.cache.encode_texts([byte_bpe.CHUNK.findall(t) for t in texts[i:i + 4]])
        cuts = np.append(0, np.cumsum(sizes))
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [library.encode_ordinary(t) for t in texts[i:i + 4]]
    often = Counter(c for t in texts for c in byte_bpe.CHUNK.findall(t)).most_common(5)
    assert all(calls.count(c) <= 2 for c, _ in often)  # common chunks are not learnt over and over
