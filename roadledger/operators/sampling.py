"""Exact sampling and reproducible splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.operators.ordered import ordered, with_group_values
from roadledger.operators.selection import smallest


def hash_fraction(key: Column, salt: Column | str) -> Column:
    """Stable fraction in [0, 1): the first seven hex digits of md5(key_salt) over 16^7."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat_ws("_", key.cast("string"), salt))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(16**7)


def sample_n(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """The n first rows in hash order: the hash that ends the sample is selected, and the rows up to it stay in place."""
    digest = F.md5(F.concat_ws("_", F.col(id_col).cast("string"), F.lit(seed)))
    return smallest(df, F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), [digest, F.col(id_col)], n)


def allocate_strata(df: DataFrame, strata: list[str], n: int) -> DataFrame:
    """Rows to draw per stratum: floor of the proportional share, leftovers to the largest
    remainders (ties by stratum). Rows with a NULL stratum are left out."""
    rows = df.dropna(subset=strata)
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("population"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = sizes.withColumn("__raw", F.lit(n) * F.col("population") / total)
    sizes = sizes.withColumns({"__floor": F.floor("__raw"),
                               "__neg": F.floor("__raw") - F.col("__raw")})
    left = F.lit(n) - sizes.agg(F.sum("__floor").alias("f")).scalar()
    ranked = ordered(sizes, [], ["__neg", *strata], rank="__place",
                     split=F.floor(F.col("__neg") * 256))
    extra = (F.col("__place") <= left).cast("bigint")
    return ranked.select(*strata, "population", (F.col("__floor") + extra).alias("allocated"))


def stratified_sample(df: DataFrame, id_col: str, strata: list[str], n: int, seed: str) -> DataFrame:
    """Proportional sample without replacement; large strata are ranked in hash-range parts."""
    quota = allocate_strata(df, strata, n).select(*strata, "allocated")
    rows = df.withColumn("__h", F.md5(F.concat_ws("_", F.col(id_col).cast("string"), F.lit(seed))))
    rows = rows.join(quota.where("allocated > 0"), strata)
    part = F.conv(F.substring("__h", 1, 3), 16, 10).cast("bigint")
    ranked = ordered(rows, strata, ["__h", id_col], rank="__i", split=part)
    return ranked.where(F.col("__i") <= F.col("allocated")).drop("__i", "__h", "allocated")


def sample_summary(df: DataFrame, sample: DataFrame, strata: list[str], n: int) -> DataFrame:
    """Population, allocated and realised counts per stratum."""
    got = sample.groupBy(*strata).agg(F.count(F.lit(1)).alias("sampled"))
    out = allocate_strata(df, strata, n).join(got, strata, "left")
    return out.withColumn("sampled", F.coalesce("sampled", F.lit(0).cast("bigint")))


def cluster_split(df: DataFrame, cluster: str, salt: str, val_fraction: float,
                  strata: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """val / test label per row, decided once per cluster by its hash.

    With strata the cluster's first row (in ``order``) gives its stratum, which joins the salt.
    """
    if not strata:
        frac = hash_fraction(F.col(cluster), salt)
        return df.withColumn("split", F.when(frac < val_fraction, "val").otherwise("test"))
    at = F.struct(*order)
    label = F.concat_ws("|", *[F.col(s).cast("string") for s in strata])
    marked = with_group_values(df, [cluster], __s=F.min_by(label, at))
    frac = hash_fraction(F.col(cluster), F.concat_ws("_", F.lit(salt), F.col("__s")))
    return marked.withColumn("split", F.when(frac < val_fraction, "val").otherwise("test")).drop("__s")


def add_train(labelled: DataFrame, universe: DataFrame, id_col: str) -> DataFrame:
    """Label every id of the universe that has no val / test row as train."""
    rest = universe.select(id_col).distinct().join(labelled.select(id_col), id_col, "left_anti")
    return labelled.unionByName(rest.withColumn("split", F.lit("train")), allowMissingColumns=True)


def ids_by_list(records: DataFrame, id_col: str, list_col: Column, keys: DataFrame, key: str) -> DataFrame:
    """Distinct ids whose list holds any of the keys."""
    flat = records.select(id_col, F.explode(F.array_distinct(list_col)).alias(key))
    return flat.join(keys.select(key).distinct(), key, "left_semi").select(id_col).distinct()


def split_without_overlap(records: DataFrame, id_col: str, list_col: Column, val_keys: DataFrame,
                          test_keys: DataFrame, key: str) -> DataFrame:
    """val / test ids reached through list-valued keys; ids reached from both sides are dropped."""
    val = ids_by_list(records, id_col, list_col, val_keys, key).withColumn("__v", F.lit(1))
    test = ids_by_list(records, id_col, list_col, test_keys, key).withColumn("__t", F.lit(1))
    both = val.join(test, id_col, "full_outer")
    kept = both.where(F.col("__v").isNull() | F.col("__t").isNull())
    return kept.select(id_col, F.when(F.col("__v") == 1, "val").otherwise("test").alias("split"))
