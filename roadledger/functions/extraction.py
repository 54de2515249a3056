"""Structured extraction records: contract, flattening, request text, quality and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger import dims
from roadledger.functions.text import clean_text, suppress_repeat

# The record contract. Enumerations list every allowed value; NULL is allowed too.
REF_FIELDS = """anchor_type string, mile_num double, exit_num int, feature_name string, rel_type string,
    rel_direction string, rel_dist double, rel_dist_unit string, rel_qualifier string"""
ENDPOINT = f"struct<reasoning: string, endpoint_cleaned: string, loc_refs: array<struct<{REF_FIELDS}>>>"
SCHEMA = f"""flags_reasoning string, statewide boolean, various_locs_unspecified boolean,
    multi_locs_specified boolean, source string, route_reasoning string, segment_length double,
    segment_length_unit string, segment_direction string,
    main_route struct<route_type: string, route_num: int, route_num_match_status: string, alt_names: string>,
    endpoint_a {ENDPOINT}, endpoint_b {ENDPOINT}"""
DIRECTIONS = "N S E W NE NW SE SW".split()
ENUMS = {
    "source": "title description both".split(),
    "segment_direction": DIRECTIONS,
    "main_route.route_type": "interstate us_route state_route local_road other".split(),
    "main_route.route_num_match_status": """matches_route_fpn concurrent_higher_class historical_renumbering
        vanity_or_alt_name spur_or_business_route other""".split(),
}
REF_ENUMS = {
    "anchor_type": list(dims.ANCHOR_PRECISION),
    "rel_type": "at offset side_of near".split(),
    "rel_direction": DIRECTIONS,
    "rel_qualifier": "exact approx".split(),
}
REQUIRED = ["statewide", "various_locs_unspecified", "multi_locs_specified"]
MAX_REFS = 3


def parse_records(df: DataFrame, column: str, out: str = "record") -> DataFrame:
    return df.withColumn(out, F.from_json(F.col(column), SCHEMA))


def record_is_valid(record: Column) -> Column:
    """Required flags present and every enumerated value allowed."""
    ok = record.isNotNull()
    for f in REQUIRED:
        ok = ok & record[f].isNotNull()
    for path, values in ENUMS.items():
        value = record
        for step in path.split("."):
            value = value[step]
        ok = ok & (value.isNull() | value.isin(*values))
    for side in ("endpoint_a", "endpoint_b"):
        refs = F.coalesce(record[side]["loc_refs"], F.array())
        for f, values in REF_ENUMS.items():
            ok = ok & F.forall(refs, lambda r: r[f].isNull() | r[f].isin(*values))
    return ok


def sorted_refs(refs: Column) -> Column:
    """Location references by falling precision (unusable ones last), original order on ties."""
    keyed = F.transform(refs, lambda r, i: F.struct(
        (-F.coalesce(dims.precision_of(r["anchor_type"]), F.lit(0))).alias("k"), i.alias("i"),
        dims.precision_of(r["anchor_type"]).alias("p"), r.alias("r")))
    return F.array_sort(keyed)


def _endpoint_columns(endpoint: Column, prefix: str, sorted_col: str) -> dict[str, Column]:
    refs = endpoint["loc_refs"]
    known = endpoint.isNotNull()
    names = [f.split()[0] for f in REF_FIELDS.split(",")]

    def first_named(kind: str) -> Column:
        hits = F.filter(refs, lambda r: r["anchor_type"] == kind)
        return F.try_element_at(hits, F.lit(1))["feature_name"]

    out = {
        f"{prefix}_reasoning": endpoint["reasoning"], f"{prefix}_cleaned": endpoint["endpoint_cleaned"],
        f"{prefix}_n_refs": F.when(known, F.when(refs.isNull(), 0).otherwise(F.size(refs))),
        f"{prefix}_max_precision": F.try_element_at(F.col(sorted_col), F.lit(1))["p"],
        f"{prefix}_city": first_named("city"), f"{prefix}_county": first_named("county")}
    for i in range(1, MAX_REFS + 1):
        slot = F.try_element_at(F.col(sorted_col), F.lit(i))
        out |= {f"{prefix}_ref{i}_{n}": slot["r"][n] for n in names}
        out[f"{prefix}_ref{i}_precision"] = slot["p"]
    return out


def flatten_records(df: DataFrame, record: str = "record") -> DataFrame:
    """One wide row per record: flags, main route, and three location slots per endpoint."""
    r = F.col(record)
    out = df.withColumns({"__a": sorted_refs(r["endpoint_a"]["loc_refs"]),
                          "__b": sorted_refs(r["endpoint_b"]["loc_refs"])})
    top = """flags_reasoning statewide various_locs_unspecified multi_locs_specified source route_reasoning
        segment_length segment_length_unit segment_direction""".split()
    cols = {c: r[c] for c in top}
    cols |= {f"main_{c}": r["main_route"][c] for c in
             ("route_type", "route_num", "route_num_match_status", "alt_names")}
    cols |= _endpoint_columns(r["endpoint_a"], "ep_a", "__a")
    cols |= _endpoint_columns(r["endpoint_b"], "ep_b", "__b")
    return out.withColumns(cols).drop("__a", "__b")


def build_request(title: Column, description: Column, state_fips: Column, state_name: Column,
                  county_fips: Column, county_name: Column, route: Column) -> Column:
    """Request JSON; the description only when it adds to the title."""
    t, d = clean_text(title), clean_text(description)
    return F.to_json(F.struct(
        t.alias("project_title"), suppress_repeat(d, t).alias("project_description"),
        F.lpad(state_fips.cast("string"), 2, "0").alias("state_fips"),
        F.coalesce(state_name, F.lit("")).alias("state_name"), county_fips.alias("county_fips"),
        F.coalesce(county_name, F.lit("")).alias("county_name"), route.cast("int").alias("route_fpn")),
        {"ignoreNullFields": "false"})


def adjusted_precision(df: DataFrame) -> DataFrame:
    """Endpoint precision lowered for offsets (4 to 3, 1 to 2), endpoint counts, min and max.

    Counts are 0 when any multi-location flag is set.
    """
    def adjust(side: str) -> Column:
        p, offset = F.col(f"ep_{side}_max_precision"), F.col(f"ep_{side}_ref1_rel_type") == "offset"
        return F.when(offset & (p == 4), 3).when(offset & (p == 1), 2).otherwise(p)

    flagged = (F.col("statewide") | F.col("various_locs_unspecified") | F.col("multi_locs_specified"))
    out = df.withColumns({"precision_a": adjust("a"), "precision_b": adjust("b")})
    count = sum((F.coalesce(F.col(f"ep_{s}_n_refs") > 0, F.lit(False)).cast("int") for s in ("a", "b")), F.lit(0))
    out = out.withColumn("n_endpoints", F.when(F.coalesce(flagged, F.lit(False)), 0).otherwise(count))
    return out.withColumns({
        "min_precision": F.when(F.col("n_endpoints") == 2, F.least("precision_a", "precision_b")),
        "max_precision": F.greatest("precision_a", "precision_b")})


def quality_class(n_endpoints: Column, low: Column, high: Column, good: int = 4, fair: int = 2) -> Column:
    """How well a title can be placed, from its endpoint count and lowest / highest precision.

    possible: two ends, both good; maybe: two ends, one good and one fair, or one good end;
    unlikely: ends that are only fair; impossible: all the rest.
    """
    two, one = n_endpoints == 2, n_endpoints == 1
    is_fair = lambda c: (c >= fair) & (c < good)
    return (F.when(two & (low >= good), "possible")
            .when((two & (high >= good) & is_fair(low)) | (one & (high >= good)), "maybe")
            .when((two & (low >= fair) & (high < good)) | (one & is_fair(high)), "unlikely")
            .otherwise("impossible"))


def quality_by_year(df: DataFrame, year: str, quality: str, amount: str) -> DataFrame:
    """Spend and share of spend by quality class and year."""
    from roadledger.operators.aggregates import with_share
    sums = df.groupBy(year, quality).agg(F.count(F.lit(1)).alias("n"),
                                         F.coalesce(F.sum(amount), F.lit(0.0)).alias("spend"))
    return with_share(sums, "spend", "share", within=[year])


def agreement(df: DataFrame, number: str, extracted: str, regex: list[str]) -> DataFrame:
    """Do project number, extraction and text search name the same route? NULL when one is silent."""
    any_regex = F.coalesce(*[F.col(c) for c in regex]).isNotNull()

    def among(value: Column) -> Column:
        hit = F.lit(False)
        for c in regex:
            hit = hit | F.coalesce(F.col(c) == value, F.lit(False))
        return F.when(value.isNotNull() & any_regex, hit)

    return df.withColumns({
        "number_vs_regex": among(F.col(number)), "extracted_vs_regex": among(F.col(extracted)),
        "number_vs_extracted": F.col(number) == F.col(extracted)})


def route_in_county(df: DataFrame, routes: DataFrame, county: str, route: str) -> DataFrame:
    """valid / invalid / unknown: whether the county has the route; unknown for counties without
    any listed route and for rows without county or route."""
    counties = routes.select(F.col(county).alias("__c")).distinct().withColumn("__has", F.lit(True))
    pairs = routes.select(F.col(county).alias("__c2"), F.col(route).alias("__r2")).distinct().withColumn(
        "__hit", F.lit(True))
    out = df.join(counties, F.col(county) == F.col("__c"), "left").join(
        pairs, (F.col(county) == F.col("__c2")) & (F.col(route) == F.col("__r2")), "left")
    state = (F.when(F.col("__hit"), "valid").when(F.col("__has") & F.col(route).isNotNull(), "invalid")
             .otherwise("unknown"))
    return out.withColumn("route_check", state).drop("__c", "__has", "__c2", "__r2", "__hit")


def run_summary(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
