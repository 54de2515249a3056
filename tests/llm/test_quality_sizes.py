"""Quality-0 documents are rejected and quality-1 documents kept at every size."""

import pytest
from pyspark.sql import functions as F

from roadledger.llm import quality, queries


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_quality_verdict_holds_over_sizes(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    labels = queries.read(spark, folder, "labels").select("doc_id", "quality")
    found = queries.op2_quality_rules(spark, folder).where("n_words >= 10").join(labels, "doc_id")
    rows = found.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < quality.THRESHOLD).alias("low")).collect()
    counts = {r.quality: r for r in rows}
    print(sf, counts)
    assert counts[0].low >= 0.98 * counts[0].n and counts[1].low <= 0.002 * counts[1].n, counts
