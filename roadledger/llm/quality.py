"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, with base rules.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials are counted
over the buckets, one from all trusted documents and one from all documents; a document's score is the
mean over its n-grams of log(p_trusted / p_raw), and documents below ``THRESHOLD`` are rejected. Every
step is a DataFrame function: the counts are one aggregate over (bucket), the log ratios reach the
documents as one constant array of ``BUCKETS`` numbers.

With a ``prior``, a bucket's ratio is log((trusted / share + prior) / (all + prior)), share being the trusted part
of all n-grams: a bucket as common in both has ratio 0 whatever the size of the corpus. Without one, each
multinomial has one count more in every bucket, which draws all ratios together on small data.

Defined results: a null text has no words; a document without n-grams has score 0 and fails the base
rule of ten words; with no trusted documents all ratios are 0; an empty table gives an empty result.
Other columns pass through ``quality_filter`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.llm.common import SPACE, SPACE_CLASS, column_name, whole_text, words_of

BUCKETS = 262_144
#: Counts that the queries add to both sides of a bucket.
PRIOR = 2.0
#: Documents whose mean log ratio is lower are rejected; equal scores are kept.
THRESHOLD = -0.25
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pair_hashes(hashes: Column) -> Column:
    """Hashes of all pairs of neighbouring words."""
    last = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), last), F.slice(hashes, F.lit(2), last), lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column, buckets: int) -> Column:
    # the same bucket by a cheaper step where their number is a power of two
    return F.pmod(h, F.lit(buckets).cast("long")) if buckets & buckets - 1 else h.bitwiseAND(F.lit(buckets - 1).cast("long"))


def _repeat_words(hashes: Column, pairs: Column) -> Column:
    """Words that lie in a window of five found twice or more in the text.

    Windows are 64-bit hashes compared within one text only, of two pairs and the last word. Where any
    repeats, (hash, place) pairs are sorted; a place whose neighbour has the same hash repeats, and covers the words up to
    the next such place or the window's end.
    """
    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            found = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return _let(_let(ordered, places), total)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))

    n = F.size(hashes) - (WINDOW - 1)
    windows = F.transform(F.slice(pairs, F.lit(1), n), lambda p, i: F.xxhash64(p, F.get(pairs, i + 2), F.get(hashes, i + 4)))
    return F.when(F.size(hashes) < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(windows, count))


def base_columns(text: Column, hashes: Column, pairs: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts, by the hashes of words and pairs."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE_CLASS.rstrip("+")))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(hashes, pairs),
    }


def gram_log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float | None = None) -> DataFrame:
    """One row: the log ratios of all buckets in order, joined by commas, from every n-gram there is.

    ``trusted`` holds the ids of the trusted documents. Each partition sums its own buckets first, so
    what meets is at most ``buckets`` rows a task. Ratios are rounded to four places.
    """
    ids = trusted.select(F.col("doc_id").alias("t_id")).distinct()
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("t_id"), "left")
    hashed = marked.select(F.col("t_id").isNotNull().cast("long").alias("good"), _word_hashes(words_of(F.col("text"))).alias("h"))
    grams = hashed.select("good", F.explode(F.concat("h", _pair_hashes(F.col("h")))).alias("h")).select("good", _bucket(F.col("h"), buckets).cast("int").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("all"))
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    counts = counts.select("bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "all")])
    sums = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "good", "all"))).alias("c"),
                      F.sum("good").alias("n_good"), F.sum("all").alias("n_all"))

    def rate(count: Column, total: str) -> Column:
        return (count + 1.0) / (F.col(total) + float(buckets))

    def quotient(x: Column) -> Column:
        if prior is None:
            return rate(x["good"], "n_good") / rate(x["all"], "n_all")
        return (x["good"] * F.col("n_all") / F.col("n_good") + prior) / (x["all"] + prior)

    return sums.select(F.array_join(F.transform("c", lambda x: F.when(F.col("n_good") == 0, F.lit(0.0)).otherwise(F.round(
        F.log(quotient(x)), 4)).cast("string")), ",").alias("ratios"))


def _mean_ratio(hashes: Column, pairs: Column, ratios: Column, buckets: int) -> Column:
    """Mean of the ratios at the buckets of all words and pairs; 0 without any."""
    def added(acc: Column, h: Column) -> Column:
        return acc + F.get(ratios, _bucket(h, buckets))

    total = F.aggregate(pairs, F.aggregate(hashes, F.lit(0.0), added), added)
    return F.coalesce(total / F.nullif(F.size(hashes) + F.size(pairs), F.lit(0)), F.lit(0.0))


def quality_columns(docs: DataFrame, trusted: DataFrame, columns: list[str], buckets: int = BUCKETS,
                    threshold: float = THRESHOLD, prior: float | None = None) -> DataFrame:
    """``columns`` of every document with the base columns, base_failed, score and kept."""
    # a constant of ``buckets`` numbers in the plan: subqueries may not stand in a lambda
    ratios = F.split(F.lit(gram_log_ratios(docs, trusted, buckets, prior).first()["ratios"]), ",").cast("array<double>")
    text, hashes, pairs = (column_name(docs, c) for c in ("whole_text", "hashes", "pairs"))
    d = docs.select(*columns, whole_text().alias(text))
    # each text is split and hashed once
    d = d.select("*", _word_hashes(words_of(F.col(text))).alias(hashes))
    d = d.select("*", _pair_hashes(F.col(hashes)).alias(pairs))
    base = base_columns(F.col(text), F.col(hashes), F.col(pairs))
    d = d.select(*columns, *[c.alias(n) for n, c in base.items()],
                 _mean_ratio(F.col(hashes), F.col(pairs), ratios, buckets).alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select("*", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"))


def quality_filter(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns."""
    work = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    judged = quality_columns(work, trusted, ["row"], **options)
    # a filter on a computed column is rewritten onto the text, every use of the hashes spelled out again; a place in the
    # same projection, which the filter reads, keeps it above
    placed = judged.select("row", "kept", F.monotonically_increasing_id().alias("place"))
    return placed.where("kept AND place >= 0").select("row.*")
