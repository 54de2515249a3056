"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with a leading word mark. Under a unigram model over the pieces of a public
vocabulary, the best score of a prefix depends on nothing behind it, so pre-tokens with a common prefix
share it: each node of the trie stores the best forward score of its prefix and the number of pieces of
the segmentation that reaches it. A terminal's number is the token count of its pre-token; a document's
count is the sum over its words.

A piece's log probability follows Zipf's law of its rank in the vocabulary, in whole millionths so that
sums are exact. A character in no piece is spelt in bytes, each as unlikely as the last piece. Equal
scores go to the segmentation with fewer pieces.

Defined results: a null or blank text has no words and no tokens; repeated rows and ids are independent;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadledger.llm.common import pieces, whole_text

MARK = "▁"
#: Nodes of a task's trie; beyond, it starts afresh.
MOST_NODES = 1_500_000


def piece_scores(path: str) -> dict[str, int]:
    """Pieces of a vocabulary file with their log probability in millionths."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(names))))
    return {p: -round(1e6 * (math.log(r + 1) + norm)) for r, p in enumerate(names)}


class CountTrie:
    """Trie of pre-tokens; best[n] belongs to the prefix that ends at node n.

    A value is score * COUNTS - pieces, so the larger of two values has the better score, or the same
    score with fewer pieces, and values add up along a segmentation.
    """

    COUNTS = 1 << 24

    def __init__(self, scores: dict[str, int]):
        self.value = {p: s * self.COUNTS - 1 for p, s in scores.items()}
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) * self.COUNTS - 1
        self.next: dict[tuple[int, str], int] = {}
        self.best = [0]

    def insert(self, token: str) -> int:
        """The token count of ``token``; nodes that it shares with earlier ones are used as they are."""
        following, best, value, longest = self.next, self.best, self.value, self.longest
        node, path = 0, [0]
        for stop, c in enumerate(token, 1):
            at = following.get((node, c))
            if at is None:
                found = None if c in value else best[node] + len(c.encode()) * self.byte
                start = stop - longest if stop > longest else 0
                for before in path[start:]:
                    v = value.get(token[start:stop])
                    if v is not None:
                        v += best[before]
                        if found is None or v > found:
                            found = v
                    start += 1
                at = following[node, c] = len(best)
                best.append(found)
            path.append(at)
            node = at
        return -best[node] % self.COUNTS


class WordCounts:
    """Token counts of words, kept by a worker process; the trie starts afresh beyond MOST_NODES."""

    def __init__(self, path: str):
        self.scores = piece_scores(path)
        self.clear()

    def clear(self) -> None:
        self.trie, self.known = CountTrie(self.scores), {}

    def learn(self, words: set[str]) -> None:
        if len(self.trie.best) > MOST_NODES:
            self.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = self.trie.insert(MARK + w)


@lru_cache(2)
def load(path: str) -> WordCounts:
    return WordCounts(path)


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens) of every whole text."""
    def work(batches):
        counts = load(path)
        for batch in pieces(batches, text):
            words = [[w.decode() for w in t.encode().split()] for t in batch[text].to_pylist()]
            counts.learn({w for t in words for w in t})
            known = counts.known
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array(map(len, words), pa.int64()), pa.array([sum(map(known.__getitem__, t)) for t in words], pa.int64())],
                names=[key, "n_words", "n_tokens"])

    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("n_words bigint, n_tokens bigint").fields])
    return df.select(key, whole_text(text).alias(text)).mapInArrow(work, schema)
