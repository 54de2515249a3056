"""Resumable enrichment: rows with a stored result are reused, only the others are worked on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def pending(requests: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a stored result (keys include the provider's version)."""
    return requests.join(done.select(*keys), keys, "left_anti")


def enrich(requests: DataFrame, done: DataFrame, keys: list[str], provider: Provider,
           schema: str) -> DataFrame:
    """Stored results together with the provider's results for new requests, marked by origin.

    The provider is a ``mapInPandas`` function; a failing row should come back as a row with its
    error, so that one failure does not lose the batch.
    """
    fresh = pending(requests, done, keys).mapInPandas(provider, schema)
    wanted = done.join(requests.select(*keys).distinct(), keys, "left_semi")
    return wanted.withColumn("status", F.lit("reused")).unionByName(
        fresh.withColumn("status", F.lit("new")), allowMissingColumns=True)


def run_incremental(stream: DataFrame, results_path: str, checkpoint: str, keys: list[str],
                    provider: Provider, schema: str) -> None:
    """Process the files that arrived since the last run and append their results.

    Each micro-batch is written to a folder of its own, overwritten on a retry, so a batch that
    is run again after a failure leaves no duplicates.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            done = spark.read.parquet(results_path).where(F.col("batch") != number)
            new = pending(new, done, keys)
        except Exception as error:  # the first run has no results yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        new.mapInPandas(provider, schema).write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    query = (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
