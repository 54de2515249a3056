"""Phrase collocation mining over counting quotient filters.

1. Texts are cut into blocks. A block keeps its own list of words with counts and its text as places in that list.
2. The lists are added up. Words that occur often enough to be part of a candidate are numbered 1..n in order
   (every phrase is at most as frequent as each of its words, so the others only separate).
3. A block meets the numbers of its words, packs its n-grams of two words or more into one counting quotient filter
   and passes it on cut by range. The filters of a range are merged; keys that reach the least count are unpacked.
4. Cuts, scores, phrases inside longer ones and ranks are joins and aggregates over those phrases alone.

A shuffle carries words of a block once and n-grams of a block once, not tokens. The number of ranges grows with
the number of tokens, so a merge holds a bounded share of the keys. Scores are exact (decimals of 38 digits).

Defined results: a null text is empty, a null language ``und``; texts without words add nothing; repeated rows count
again; a language without candidates has no rows; an empty table gives none. Equal scores and counts are ordered
by the bytes of the phrase. Other columns are not read. One text is handled whole by one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadledger.llm.common import drop_stored, pieces, stored
from roadledger.llm.quotient import Packing
from roadledger.operators.ordered import dense_ids

#: The characters that end a piece; the blank and the tab separate words.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: A byte that UTF-8 never holds stands for the end of a piece.
END = b"\xff"
FOLD = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + END * len(ENDS) + b" ")
#: Bytes of text in a block, and bytes that are split at once.
BLOCK, STEP = 16 << 20, 2 << 20
#: Keys that one merge is meant to hold.
RANGE_KEYS = 1 << 18
#: Parts in which the best phrases of a language are first looked for.
SALTS = 64

BLOCK_SCHEMA = "block string, lang string, words array<binary>, counts array<long>, tokens binary"


def _block_rows(block: str, held: dict) -> pa.RecordBatch:
    rows = []
    for lang, (places, found) in held.items():
        ids = np.concatenate(found)
        counts = np.bincount(ids, minlength=len(places))
        words = sorted(places, key=places.__getitem__)
        rows.append((block, lang, words[1:], counts[1:], ids.astype("<u4").tobytes()))
    columns = list(zip(*rows))
    types = [pa.string(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "lang", "words", "counts", "tokens"])


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block and language: its words, their counts, and the text as places in them (0 ends a piece)."""
    task, number, size, held = TaskContext.get().partitionId(), 0, 0, {}
    for batch in pieces(batches, "text", STEP):
        texts = defaultdict(list)
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            texts[lang].append(text)
            size += len(text)
        for lang, some in texts.items():
            if lang not in held:
                places = defaultdict()
                places.default_factory = places.__len__
                held[lang] = (places, [np.zeros(places[END] + 1, np.uint32)])
            places, found = held[lang]
            tokens = END.join([*some, b""]).translate(FOLD).replace(END, b" " + END + b" ").split()
            ids = np.fromiter(map(places.__getitem__, tokens), np.uint32, len(tokens))
            found.append(ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))] if len(ids) else ids)
        if size >= BLOCK:
            yield _block_rows(f"{task}-{number}", held)
            number, size, held = number + 1, 0, {}
    if held:
        yield _block_rows(f"{task}-{number}", held)


def _block_filters(packing: Packing, left: pa.Table, right: pa.Table) -> pa.Table:
    """The n-grams of one block and language as filters, one per range."""
    out = []
    if left.num_rows and right.num_rows:
        places = np.frombuffer(left["tokens"][0].as_py(), "<u4")
        ids = np.zeros(int(places.max()) + 1, np.int64)
        ids[right["place"].to_numpy()] = right["id"].to_numpy()
        ids = ids[places]
        keys, full = [], ids > 0
        for m in range(2, packing.size + 1):
            full = full[:-1] & (ids[m - 1:] > 0)
            at = np.flatnonzero(full)
            words = [ids[at + i] for i in range(m)] + [np.zeros(len(at), np.int64)] * (packing.size - m)
            keys.append(packing.pack(words))
        hi, lo = (np.concatenate(x) for x in zip(*keys))
        out = packing.filters(*packing.counted(hi, lo))
    return pa.table({"range": pa.array([r for r, _ in out], pa.int32()), "cell": pa.array([c for _, c in out], pa.binary())})


def _merge_range(packing: Packing, least: int, number: int, table: pa.Table) -> pa.Table:
    """The n-grams of one range that occur ``least`` times or more in all blocks."""
    hi, lo, counts = packing.merged(number, table["cell"].to_pylist())
    often = counts >= least
    ids, counts = packing.unpack(hi[often], lo[often]), counts[often]
    return pa.table({"ids": pa.array([[x for x in row if x] for row in ids.tolist()], pa.list_(pa.int64())), "f": pa.array(counts, pa.int64())})


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id), phrases of two words or more (ids, f), each ``least`` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    blocks = stored(rows.mapInArrow(text_blocks, BLOCK_SCHEMA), "blocks")
    listed = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    sums = listed.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    totals = stored(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(
        F.sum("n").alias("n")), "totals")
    words = stored(dense_ids(sums.where(F.col("f") >= least), ["lang", "word"], "id"), "words")
    n_words, n_tokens = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_tokens * (longest - 1) // RANGE_KEYS)
    packing = Packing(longest, max(n_words.bit_length(), 1), (ranges - 1).bit_length())
    places = listed.select("block", "lang", (F.col("place") + 1).alias("place"), F.col("w.words").alias("word")).join(
        words.select("lang", "word", "id"), ["lang", "word"]).select(
        F.col("block").alias("in_block"), F.col("lang").alias("in_lang"), "place", "id")
    cells = blocks.select("block", "lang", "tokens").groupBy("block", "lang").cogroup(places.groupBy("in_block", "in_lang")).applyInArrow(
        lambda key, left, right: _block_filters(packing, left, right), "range int, cell binary")
    phrases = stored(cells.groupBy("range").applyInArrow(lambda key, table: _merge_range(packing, least, key[0].as_py(), table), "ids array<long>, f long"), "phrases")
    drop_stored(blocks)
    return words, phrases, totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    The score of a phrase is that of its weakest cut into a first and a second part; phrases that lie inside a
    longer candidate with at least ``inside_percent`` of their count are left out.
    """
    words, phrases, totals = frequent_phrases(docs, longest, least)
    counts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    sized = phrases.withColumn("size", F.size("ids"))
    cuts = sized.select("ids", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"),
                       F.slice("ids", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    scored = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(
        counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    scored = scored.withColumn("score", F.expr(
        "(1000000 * cast(a AS decimal(19,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    weakest = scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every run of words inside a longer phrase, with the count of the most frequent such phrase
    runs = sized.where("size > 2").select("f", F.explode(F.expr("""flatten(transform(sequence(2, size - 1), m ->
        transform(sequence(1, size - m + 1), s -> slice(ids, s, m))))""")).alias("ids"))
    held = runs.groupBy("ids").agg(F.max("f").alias("longer"))
    kept = weakest.join(held, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    named = kept.select("ids", "a", "cut", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    named = named.groupBy("ids", "a", "cut", "lang").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    named = named.select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    return salted.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    lists AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM lists, range(1, 4) t(m) WHERE len(w) >= m),
    freq AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE m = 1 GROUP BY lang),
    cand AS MATERIALIZED (SELECT * FROM freq WHERE m > 1 AND f >= 10),
    parts AS MATERIALIZED (SELECT lang, g, m, f AS a, k, g[1:k] AS head, g[k + 1:m] AS tail FROM cand JOIN range(1, 3) t(k) ON k < m),
    heads AS MATERIALIZED (SELECT p.*, x.f AS l FROM parts p JOIN freq x ON x.lang = p.lang AND x.g = p.head),
    cuts AS (SELECT h.lang, h.g, h.m, a, k, l, y.f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * y.f) AS score
      FROM heads h JOIN freq y ON y.lang = h.lang AND y.g = h.tail),
    weakest AS (SELECT lang, g, m, a, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'k': k}) AS cut FROM cuts GROUP BY ALL),
    longer AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM cand WHERE m = 3),
    held AS (SELECT lang, g, max(f) AS f FROM longer GROUP BY ALL),
    kept AS (SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, cut.l AS l, cut.r AS r, CAST(cut.score AS BIGINT) AS score
      FROM weakest w LEFT JOIN held h ON h.lang = w.lang AND h.g = w.g WHERE h.f IS NULL OR 100 * h.f < 50 * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
