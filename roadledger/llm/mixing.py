"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source is a line of its documents, shuffled by a hash of their ids and laid end to end; the line is
cut into blocks of ``block`` words and may be walked ``cap`` times. A golden-ratio sequence gives each
slot of the schedule a point in [0, 1); the cumulative targets turn the point into a source, the rank
of the slot among the slots of its source is the number of the block that it takes. The last block of
a source is cut at its target, so taken words meet targets to within one word.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that
repeat an id, or have none, are separate documents; a source without words has target 0; an empty table
gives an empty mix. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.llm.common import column_name, stored, word_count

#: Words in a block, slots numbered together, and cells of the unit interval that route points to sources.
BLOCK, CHUNK, CELLS = 64, 65_536, 2_048
#: Points lie on a grid of 2**31; GOLDEN is the odd number nearest to 2**31 / golden ratio.
GRID, GOLDEN = 1 << 31, 1_327_217_885
WEIGHTS = (3, 1, 2)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, rn, source_size, target, quota) from rows (source, size): one row per source.

    Weights repeat over the sources in code-point order, null last. Targets share ``share`` times all
    sizes by weight and stop at ``cap`` times the source's size; the excess goes to the others by weight
    until none is above. That is the water level at which the capped targets use up the total. The
    windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.partitionBy(F.lit(0))
    t = totals.select("*", F.row_number().over(order).alias("rn"))
    t = t.select("*", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
                 .cast("double").alias("w"), (F.col("source_size") * cap).cast("double").alias("most"),
                 (F.sum("source_size").over(full) * F.lit(share)).alias("total"))
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("w"), "rn")
    t = t.select("*", F.row_number().over(by_fill).alias("k"),
                 (F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")).alias("used"),
                 F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"))
    open_from = F.when(F.col("most") >= F.col("w") * (F.col("total") - F.col("used")) / F.col("open_w"),
                       F.struct("k", "used", "open_w"))
    t = t.select("*", F.min(open_from).over(full).alias("level"))
    target = F.when(F.col("level").isNull() | (F.col("k") < F.col("level.k")), F.col("most")).otherwise(
        F.col("w") * (F.col("total") - F.col("level.used")) / F.col("level.open_w"))
    return t.select("source", "rn", "source_size", target.alias("target"), F.floor(target).cast("long").alias("quota"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rn, block): the order in which blocks of the sources are read.

    Slots are ranked within (chunk of slots, source), and chunks are joined by running sums of their
    counts, so no task holds all slots of a source. A source that the sequence leaves a few slots short
    gets them at the end.
    """
    total = sources.agg(F.sum("quota").alias("total"))
    slots = (total.where("total > 0").select(F.ceil(F.col("total") / block).alias("slots"))
             .select("slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
             .repartition("chunk")
             .select("chunk", F.explode(F.sequence(
                 F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("slot")))
    slots = slots.select("chunk", "slot", ((F.col("slot") % GRID) * GOLDEN % GRID).alias("x"))
    upto = Window.partitionBy(F.lit(0)).orderBy("rn")
    ends = sources.select("rn", "quota", F.sum("quota").over(upto).alias("cum"),
                          F.sum("quota").over(Window.partitionBy(F.lit(0))).alias("all"))

    def edge(column: Column) -> Column:
        return F.floor(column.cast("double") * float(GRID) / F.col("all").cast("double")).cast("long")

    width = GRID // CELLS
    cells = (ends.where(F.col("all") > 0).select("rn", edge(F.col("cum") - F.col("quota")).alias("lo"), edge(F.col("cum")).alias("hi"))
             .where("hi > lo").select("*", F.explode(F.sequence(
                 F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell")))
    # runs of slots pack so well that their size misleads the choice of a broadcast: the big sides say merge
    hit = (slots.withColumn("cell", F.floor(F.col("x") / width)).hint("merge").join(cells, "cell")
           .where("x >= lo and x < hi").select("chunk", "slot", "rn"))
    counts = hit.groupBy("rn", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("rn", "chunk", (F.sum("n").over(Window.partitionBy("rn").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = hit.select("*", F.row_number().over(Window.partitionBy("chunk", "rn").orderBy("slot")).alias("nth"))
    ranked = ranked.hint("merge").join(before, ["rn", "chunk"]).select("slot", "rn", (F.col("base") + F.col("nth") - 1).alias("block"))
    need = sources.select("rn", F.ceil(F.col("quota") / block).alias("need"), F.sum("quota").over(Window.partitionBy(F.lit(0))).alias("all"))
    got = counts.groupBy("rn").agg(F.sum("n").alias("got"))
    tail = (need.join(got, "rn", "left").withColumn("got", F.coalesce("got", F.lit(0)))
            .where("need > got").select("rn", "all", "got", F.explode(F.sequence("got", F.col("need") - 1)).alias("block"))
            .select((F.ceil(F.col("all") / block) + (F.col("block") - F.col("got")) * 1_000_000 + F.col("rn")).alias("slot"),
                    "rn", "block"))
    return (ranked.join(need.select("rn", "need"), "rn").where("block < need").select("slot", "rn", "block")
            .unionByName(tail))


def document_lines(sized: DataFrame, sources: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, size, ...) with their place on the shuffled line of their source.

    ``at`` is the number of words before the document. The line is ordered by md5 of the id; running
    sums are taken within 4,096 stretches of it, which the source's totals by stretch then join.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = sized.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("key", key)
    d = d.withColumn("stretch", F.substring("key", 1, 3))
    line = Window.partitionBy("rn", "stretch").orderBy("key", "doc_id", "size")
    d = d.select("*", F.row_number().over(line).alias("nth"),
                 (F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("within"))
    sums = d.groupBy("rn", "stretch").agg(F.sum("size").alias("words"))
    sums = sums.select(F.col("rn").alias("b_rn"), F.col("stretch").alias("b_stretch"), (F.sum("words").over(
        Window.partitionBy("rn").orderBy("stretch")) - F.col("words")).alias("base"))
    return (d.join(sums, (d["rn"] == sums["b_rn"]) & (d["stretch"] == sums["b_stretch"]))
            .withColumn("at", F.col("base") + F.col("within")).drop("b_rn", "b_stretch", "base", "within", "key"))


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2,
        block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """(slot, rn, block, stretch, nth, doc_id, source, size, source_size, target, pass, words): the mix.

    One row for each part of a document in a block that the schedule takes, and one with a null slot
    for documents and passes that it leaves out. (rn, stretch, nth) names the document's row.
    """
    sources = stored(source_targets(sized.select("source", "size"), weights, share, cap), "sources")  # one row per source
    lines = document_lines(sized.select("doc_id", "source", "size"), sources.withColumnRenamed("source", "s_source"), seed)
    walks = lines.select("*", F.explode(F.array(*map(F.lit, range(cap)))).alias("pass"))
    start = F.least(F.col("quota"), F.col("pass") * F.col("source_size") + F.col("at"))
    stop = F.least(F.col("quota"), F.col("pass") * F.col("source_size") + F.col("at") + F.col("size"))
    walks = walks.select("doc_id", "source", "size", "source_size", "target", "rn", "stretch", "nth", "pass",
                         start.alias("a"), stop.alias("b"))
    blocks = F.when(F.col("b") > F.col("a"), F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)))
    parts = walks.select("*", F.explode_outer(blocks).alias("block"))
    words = F.least("b", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)
    parts = parts.select("*", words.alias("words")).drop("a", "b")
    return parts.join(schedule(sources, block).hint("merge"), ["rn", "block"], "left").withColumn(
        "words", F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes from each document."""
    parts = mix(sized_documents(docs), **options)
    return (parts.groupBy("rn", "stretch", "nth", "doc_id", "size", "source_size", "target")
            .agg(F.sum("words").cast("long").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all their columns, each as often as the mix walks over it.

    A walk that covers at least half of a document's words takes it whole, a lesser one not at all; only
    the document on which a source's target falls is concerned. Documents without words stay once.
    """
    names = docs.columns
    h, n = column_name(docs, "text_hash"), column_name(docs, "nth_equal")
    same = Window.partitionBy("doc_id", "source", h).orderBy("doc_id")
    rows = docs.withColumn(h, F.xxhash64("text"))
    rows = rows.withColumn(n, F.row_number().over(same))
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size"))
    slim = slim.select("source", "size", F.struct("doc_id", "h", F.row_number().over(
        Window.partitionBy("doc_id", "source", "h").orderBy("doc_id")).alias("n")).alias("doc_id"))
    parts = mix(slim, **options)
    walks = parts.groupBy("doc_id", "source", "pass", "size").agg(F.sum("words").alias("words"))
    copies = walks.groupBy("doc_id", "source", "size").agg(F.sum(F.when(
        F.col("words") * 2 >= F.col("size"), 1).otherwise(0)).alias("copies"))
    copies = copies.select(F.col("doc_id.doc_id").alias("c_id"), F.col("doc_id.h").alias("c_h"), F.col("doc_id.n").alias("c_n"),
                           F.col("source").alias("c_source"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("copies"))
    out = rows.join(copies, rows["doc_id"].eqNullSafe(copies["c_id"]) & rows["source"].eqNullSafe(copies["c_source"])
                    & (rows[h] == copies["c_h"]) & (rows[n] == copies["c_n"]))
    return out.where("copies > 0").select(
        *[rows[c] for c in names], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(column_name(docs, "copy"))).select(*names)


#: The same rows in SQL; documents and the line in md5 order as above. The schedule only orders blocks.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(rn - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS most,
      CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s),
f AS (SELECT *, row_number() OVER o AS k, sum(most) OVER o - most AS used,
      sum(w) OVER (ORDER BY most / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
      FROM w WINDOW o AS (ORDER BY most / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT k, used, open_w FROM f WHERE most >= w * (total - used) / open_w ORDER BY k LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN l.k IS NULL OR f.k < l.k THEN most ELSE f.w * (total - l.used) / l.open_w END AS target
      FROM f LEFT JOIN l ON true),
p AS (SELECT d.doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota, CAST(sum(size) OVER (PARTITION BY d.source
      ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, least(quota, place + size) - least(quota, place)
     + least(quota, source_size + place + size) - least(quota, source_size + place) AS taken FROM p
"""
