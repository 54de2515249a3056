"""Flat document rows -> typed receipts -> projects -> deflated spending series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadledger import dims
from roadledger.functions import classify, dates, numeric, text
from roadledger.operators.aggregates import distinct_list, roll_up
from roadledger.operators.ordered import join_back

FUNDS = ["federal_funds", "state_funds", "local_funds", "private_funds", "nonmonetary_funds",
         "other_funds"]
_FUND_FIELDS = ["FederalFunds", "StateFunds", "LocalFunds", "PrivateFunds", "NonMonetaryFunds",
                "OtherFunds"]
DATES = """authsprdate authpedate authrowdate authconstdate authotherdate completedate finalvoucherdate
    latestpaymentdate projectenddate lastactiondate transactiondate detail_lastactiondate
    nepa_decision_date""".split()
GRAIN = ["recipientid", "federal_project_number", "detail_linenumber", "detail_programcode"]
TEXTS = ["projecttitle", "projectdescription", "recipientremarks", "divisionremarks", "gis_routeid",
         "gis_beginpoint", "gis_endpoint", "county_name"]


def receipts(flat: DataFrame, counties: DataFrame | None = None) -> DataFrame:
    """Typed receipt table from ``flatten_projects``: one row per recipient, project, line and
    program code, with the counties of all its breakdowns as a list.

    ``counties`` (county_fips STRING, county_name STRING) names the counties.
    """
    lower = flat.toDF(*[c.lower() for c in flat.columns])

    def num(c: str):
        return text.blank_to_null(F.col(c)).try_cast("double")

    def code(c: str):
        return text.blank_to_null(F.col(c)).try_cast("int")

    def pick(*columns):
        return F.coalesce(*columns)

    # rows are ordered by their place in the source, so projects that repeat in a file have no ties
    row_no = F.struct(*[c for c in ("source_file", "position", "detail_pos") if c in lower.columns])
    typed = lower.select(
        code("recipientid").alias("recipientid"),
        F.col("federalprojectnumber").alias("federal_project_number"),
        code("detail_linenumber").alias("detail_linenumber"),
        F.col("detail_programcode"), F.col("detail_prefix"),
        code("detail_improvementtype").alias("detail_improvementtype"),
        dims.recode(pick(code("gis_stateid"), code("nongis_stateid")), dims.STATE_RECODES).alias("state_fips"),
        pick(code("gisbreakdown_countyid"), code("nongis_countyid")).alias("countyid"),
        pick(code("nongis_urbanorrural"), code("gisbreakdown_urbanorrural")).alias("urban_rural"),
        pick(code("gisbreakdown_functionalsystem"), code("nongis_functionalsystem")).alias("functional_system"),
        pick(code("gisbreakdown_systemcode"), code("nongis_systemcode")).alias("system_code"),
        (pick(num("nongis_totalcost"), num("gis_totalcost")) / 1e6).alias("total_cost_mills"),
        *[pick(num(f"nongis_{f.lower()}"), num(f"gis_{f.lower()}")).alias(o)
          for f, o in zip(_FUND_FIELDS, FUNDS)],
        code("projectstatus").alias("projectstatus"), "projecttitle", "projectdescription",
        "recipientremarks", "divisionremarks", "gis_routeid",
        num("gis_beginpoint").alias("gis_beginpoint"), num("gis_endpoint").alias("gis_endpoint"),
        code("nepaclassofaction").alias("nepa_class"),
        F.col("nepaclassofactiondecisiondate").alias("nepa_decision_date"),
        *[F.col(d) for d in DATES if d != "nepa_decision_date"],
        dates.year_in_text(F.col("completedate"), anchored=True).alias("completion_year"),
        dates.year_in_text(F.col("finalvoucherdate")).alias("finalvoucher_year"),
        dates.year_in_text(F.col("latestpaymentdate")).alias("latestpayment_year"),
        dates.year_in_text(F.col("detail_lastactiondate")).alias("detaillastaction_year"),
        "gisbreakdown_index", row_no.alias("row_no"))
    typed = dates.parse_columns_mdy(typed, DATES)
    kind = F.col("detail_improvementtype")
    typed = typed.withColumns({
        "county_fips": text.padded_key([(F.col("state_fips"), 2), (F.col("countyid"), 3)]),
        **classify.work_flags(kind), "work_type": classify.work_type(kind),
        **classify.structure_flags(kind),
        "interstate_functional": classify.equals_code(F.col("functional_system"), 1),
        "interstate_syscode": classify.equals_code(F.col("system_code"), 1)})
    spark = flat.sparkSession
    typed = dims.decode(typed, "detail_programcode", dims.code_table(
        spark, dims.program_pairs(), "c", "l", numeric=False), "funding_program")
    typed = typed.withColumn("funding_program", F.coalesce("funding_program", F.lit("")))
    typed = dims.decode(typed, "recipientid", dims.code_table(spark, dims.region_pairs(), "c", "l"), "region")
    typed = typed.withColumn("region", F.coalesce("region", F.lit("")))

    lists = distinct_list(typed, GRAIN, "county_fips", ["row_no", "gisbreakdown_index"], "county_list")
    kept = typed.where(F.col("gisbreakdown_index").isNull() | (F.col("gisbreakdown_index") == 1))
    out = join_back(kept.drop("county_fips"), lists, GRAIN).withColumnRenamed("county_list", "county_fips")
    if counties is not None:
        names = typed.select(*GRAIN, "county_fips", "row_no", "gisbreakdown_index").join(
            counties, "county_fips")
        names = distinct_list(names, GRAIN, "county_name", ["row_no", "gisbreakdown_index"], "county_name")
        out = join_back(out, names, GRAIN)
    return out.drop("gisbreakdown_index")


def projects(receipt_rows: DataFrame) -> DataFrame:
    """Project table: summed money, first known attributes, flags that hold if any receipt has them."""
    keys = ["recipientid", "federal_project_number"]
    order = ["row_no", "detail_linenumber", "detail_programcode"]
    programs = {"fp_ic": "Interstate Construction", "fp_im": "Interstate Maintenance",
                "fp_imd": "Interstate Maintenance Discretionary",
                "fp_nhpp": "National Highway Performance Program"}
    rows = receipt_rows.withColumns({k: F.col("funding_program") == v for k, v in programs.items()})
    firsts = """region projectstatus projecttitle projectdescription authsprdate authpedate authrowdate
        authconstdate authotherdate completedate finalvoucherdate latestpaymentdate projectenddate
        lastactiondate transactiondate recipientremarks divisionremarks detail_prefix state_fips
        gis_routeid gis_beginpoint gis_endpoint urban_rural""".split()
    flags = {k: k for k in ["nepa_class", "nepa_decision_date", "interstate_functional",
                            "interstate_syscode", *programs]}
    flags |= {"has_new_construction": "new_construction", "has_reconstruction": "reconstruction",
              "has_rehabilitation": "rehabilitation", "has_maintenance": "maintenance",
              "has_construction": "is_construction"}
    rolled = roll_up(rows, keys, order, sums=["total_cost_mills", *FUNDS], firsts=firsts,
                     lasts=["completion_year"], maxima=flags, count="receipts")
    dim = dims.code_table(rows.sparkSession, dims.entries(dims.IMPROVEMENT_TYPES), "c", "l")
    types = distinct_list(dims.decode(rows, "detail_improvementtype", dim, "improv"), keys, "improv",
                          order, "proj_improv_types")
    flat = rows.select(*keys, *order[:1], *order[1:], F.posexplode("county_fips").alias("p", "fips"))
    counties = distinct_list(flat, keys, "fips", [*order, "p"], "county_fips")
    return rolled.join(types, keys, "left").join(counties, keys, "left")


def price_index(spark: SparkSession, rows: DataFrame, date: str = "observation_date",
                value: str = "cpiaucsl") -> DataFrame:
    """Yearly mean of a monthly price index with ISO dates."""
    return rows.groupBy(dates.iso_year(F.col(date)).alias("year")).agg(F.avg(value).alias("cpi"))


def deflate(df: DataFrame, index: DataFrame, year: str, columns: list[str], suffix: str = "_adjusted",
            scale: float = 1.0, keep_unmatched: bool = False) -> DataFrame:
    """Divide money columns by index/100 of the given year (the index is one row per year)."""
    idx = index.select(F.col("year").alias("__y"), F.col("cpi").alias("__cpi"))
    out = df.join(idx, F.col(year) == F.col("__y"), "left" if keep_unmatched else "inner")
    return out.withColumns({f"{c}{suffix}": F.col(c) / (F.col("__cpi") / 100.0) / scale
                            for c in columns}).drop("__y", "__cpi")


def title_table(project_rows: DataFrame, index: DataFrame) -> DataFrame:
    """Interstate-construction projects with deflated cost, route number, period and cost flags."""
    from roadledger.operators.aggregates import below_median
    ic = project_rows.where(F.col("fp_ic"))
    ic = deflate(ic, index, "completion_year", ["total_cost_mills"], suffix="_adj")
    out = ic.withColumns({
        "total_cost_bills_adjusted": F.col("total_cost_mills_adj") / 1000.0,
        "route_fpn": text.leading_route(F.col("federal_project_number")),
        "authconstyear": F.year("authconstdate")})
    out = out.withColumn("post_1970_auth", F.coalesce(F.col("authconstyear") >= 1970, F.lit(False)))
    return below_median(out, "total_cost_bills_adjusted", "below_median_cost")


def yearly_spend(df: DataFrame, year: str, columns: list[str]) -> DataFrame:
    return df.groupBy(year).agg(*[numeric.sum0(F.col(c)).alias(c) for c in columns])
