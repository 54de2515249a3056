from pyspark.sql import functions as F

from roadledger import dims
from roadledger.functions import classify, dates, designations, extraction, numeric, routes, text, titles
from tests.conftest import rows


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("r")).first()["r"]


def test_code_lists_are_complete(spark):
    assert len(dims.entries(dims.IMPROVEMENT_TYPES)) == 73 and len(dims.entries(dims.PROJECT_STATUSES)) == 14
    assert len(dims.entries(dims.STATES)) == 57 and len(dims.recipients()) == 59
    assert len(dims.program_pairs()) == 44 and len(dims.entries(dims.PROGRAM_NAMES)) == 32
    assert len(dims.MILEPOST_RULES) == 29 and len(dims.ANCHOR_PRECISION) == 25
    codes = [c for v in dims.REGIONS.values() for c in v]
    assert len(codes) == len(set(codes)) == 51


def test_small_expressions(spark):
    assert one(spark, text.clean_text(F.col("c")), c=" a\r\n\tb  c ") == "a b c"
    assert one(spark, text.clean_text(F.col("c")), c=None) == ""
    assert one(spark, text.has_token(F.col("c"), "15"), c="150; 215") is False
    assert one(spark, text.has_token(F.col("c"), "15"), c="150; 15") is True
    assert one(spark, text.list_size(F.col("c")), c="a;b") == 2
    assert one(spark, text.replace_first(F.col("c"), F.lit("ab"), "--"), c="xabab") == "x--ab"
    assert one(spark, dates.parse_mdy(F.col("c")), c="13/45/2000") is None
    assert str(one(spark, dates.parse_mdy(F.col("c")), c="on 02/29/2000 x")) == "2000-02-29"
    assert one(spark, dates.mmyy_to_yymm(F.col("c")), c=756.0) == 5607
    assert one(spark, classify.route_text(F.col("c")), c="03SW") == "35W"
    assert one(spark, classify.route_text(F.col("c")), c="0800") == "80"
    assert one(spark, numeric.block_label(F.lit(1960)), c="x") == "1960-1964"
    assert one(spark, numeric.parts_match_total([F.col("a"), F.col("b")], F.col("t")), a=1.0, b=2.0, t=3.5) is True


def test_rule_tables(spark):
    df = spark.createDataFrame([(18, "465", 25000.0, "x"), (18, "465", 500.0, "x"), (45, "526", 1.0, "1B1F"), (45, "526", 1.0, "1A1F"), (1, "1", 5.0, "x")],
                               "st int, rt string, mp double, g string")
    got = rows(classify.shift_mileposts(df, "st", "rt", "mp", "g"), "st", "mp")
    assert got == sorted([(18, 25000.0 - 10139 - 557), (18, 500.0), (45, 899.0), (45, 1.0), (1, 5.0)], key=repr)
    fixes = spark.createDataFrame([(5, "40", 109.134, 89), (5, "40", 109.2, 89)], "st int, rt string, mp double, yr int")
    assert rows(classify.fix_open_years(fixes, "st", "rt", "mp", "yr"), "mp", "yr") == [(109.134, 69), (109.2, 89)]


def test_route_references(spark):
    data = ["I-40 AND I 5", "IH10 IR-20 IN 95", "INTERSTATE 95 FAI-57", "VI-40 KY-31 I/S IN HOUSTON ITS", "I-70B I-94BL", None]
    df = spark.createDataFrame([(t,) for t in data], "t string")
    got = {r["t"]: r for r in routes.extract_routes(df, "t").collect()}
    assert [got[data[0]][f"route_{i}_int"] for i in (1, 2, 3)] == [40, 5, None]
    assert [got[data[1]][f"route_{i}_int"] for i in (1, 2, 3)] == [10, 20, 95]
    assert [got[data[2]][f"route_{i}_int"] for i in (1, 2)] == [95, 57]
    assert not got[data[3]]["has_route"] and not got[None]["has_route"]
    assert got[data[4]]["route_1"] == "70B" and got[data[4]]["route_1_has_char"] and got[data[4]]["route_2_int"] == 94


def test_segment_route(spark):
    data = {"BRIDGE ON I-55 OVER I-80": ("interstate", 55), "I-40/I-25 INTERCHANGE": ("multiple interstate", 40), "US 36 PAVING": ("non-interstate", None),
            "FROM I-5 TO I-90 ON I-405": ("interstate", 405), "MAIN ST": ("", None)}
    df = spark.createDataFrame([(t,) for t in data], "t string")
    got = {r["t"]: (r["route_type"], r["route_number"]) for r in routes.segment_route(df, "t").collect()}
    assert got == data


def test_title_cascade(spark):
    cases = {
        "CUY IR 480 05.40": ("CUY MP 05.40", "", 6, 0), "I-244,FROM 41ST ST.N.TO 21ST ST., STRUCTURES": ("41ST ST.N", "21ST ST", None, None),
        "I-95 between Route 288 and Route 10": ("ROUTE 288", "ROUTE 10", 5, 5), "I-24, BR ON WALDRON RD LM 2.17, WIDENING FOR BR": ("MP 2.17", "", 6, 0),
        "I-10 MP 5 TO MP 9.5": ("MP 5", "MP 9.5", 6, 6), "I 75@SASHABOW RD, DECK SURFACING": ("SASHABOW RD", "", 5, 0),
        "Mill and Overlay on I-35 in Coffey County": ("COFFEY COUNTY", "", 2, 0), "I-80, STATEWIDE": None, "": ("", "", 0, 0)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r for r in titles.parse_titles(df, "t").collect()}
    for t, want in cases.items():
        if want is None:
            continue
        a, b, pa, pb = want
        assert (got[t]["endpoint_a"], got[t]["endpoint_b"]) == (a, b), (t, got[t])
        if pa is not None:
            assert (got[t]["precision_a"], got[t]["precision_b"]) == (pa, pb), t
    df = spark.createDataFrame([("AT OAK RD", "I-5 FROM A ST TO B ST"), (None, "I-5 FROM A ST TO B ST"), ("nothing", "nothing")], "d string, t string")
    src = [r["location_source"] for r in titles.parse_with_fallback(df, "d", "t").collect()]
    assert src[:2] == ["title (b only)", "title"]


def test_extraction_contract(spark):
    good = """{"statewide": false, "various_locs_unspecified": false, "multi_locs_specified": false, "main_route": {"route_type": "interstate", "route_num": 5},
      "endpoint_a": {"loc_refs": [{"anchor_type": "city", "feature_name": "X"}, {"anchor_type": "milepost", "mile_num": 3.5}, {"anchor_type": "unknown"}, {"anchor_type": "tunnel"}]},
      "endpoint_b": {"loc_refs": [{"anchor_type": "highway", "rel_type": "offset"}]}}"""
    bad = good.replace('"interstate"', '"canal"')
    df = extraction.parse_records(spark.createDataFrame([("g", good), ("b", bad), ("n", "{}")], "id string, j string"), "j")
    assert rows(df.where(extraction.record_is_valid(F.col("record"))), "id") == [("g",)]
    r = extraction.adjusted_precision(extraction.flatten_records(df.where("id = 'g'"))).first()
    assert [r[f"ep_a_ref{i}_anchor_type"] for i in (1, 2, 3)] == ["milepost", "tunnel", "city"]
    assert (r["ep_a_max_precision"], r["ep_a_city"], r["ep_a_n_refs"], r["ep_a_ref1_mile_num"]) == (6, "X", 4, 3.5)
    assert (r["precision_b"], r["n_endpoints"], r["min_precision"], r["max_precision"]) == (3, 2, 3, 6)
    req = one(spark, extraction.build_request(F.col("t"), F.lit("i-5 PAVING"), F.lit(6), F.lit("California"), F.lit("06001"), F.lit(None).cast("string"), F.lit(5.0)), t="I-5  paving")
    assert '"project_description":null' in req and '"state_fips":"06"' in req


def test_designations(spark):
    df = spark.createDataFrame([("Adams-Brown County Line", "county_line", None, "Ohio", "Adams County"), ("Main Street", "road", "N", "Ohio", "Adams"),
                                ("Interstate 70", "highway", None, "Ohio", "Adams"), ("North Springfield City Limits", "city_limits", None, "Ohio", "Adams"),
                                ("Union Railroad", "railroad_crossing", None, "Ohio", "Adams")], "f string, a string, d string, s string, c string")
    got = {r["f"]: (r["feature_clean"], r["extracted_direction"]) for r in designations.normalise_reference(df, "f", "a", "d", "s", "c").collect()}
    assert got["Adams-Brown County Line"] == ("Brown", None) and got["Main Street"] == ("Main St", None)
    assert got["Interstate 70"][0] == "I- 70" and got["North Springfield City Limits"] == ("North Springfield", "north")
    assert got["Union Railroad"][0] == "Union RR"


def test_work_words_by_letters_cut_what_the_list_cuts(spark):
    words = titles.WORK_WORDS[3:-1]
    for a, b in ((r"\w*", "S"), (r"\w+", "LAND"), (r"\s+", "  "), (r"\s", " "), (r"\.?", "."), (r"[\.,\s]", ",")):
        words = words.replace(a, b)
    made = [(p + w + q,) for w in words.split("|") for p in ("", "OAK RD; ", "X", "oak , ") for q in ("", " ", "\n", "\u0085", "ED", " X")]
    plain = rf"(?i)\s*[,;]?\s*{titles.WORK_WORDS}\s*$"
    got = spark.createDataFrame(made, "t string").select(
        "t", F.regexp_replace("t", titles.WORK_END, "").alias("new"), F.regexp_replace("t", plain, "").alias("old")).collect()
    assert all(r["new"] == r["old"] for r in got) and sum(r["new"] != r["t"] for r in got) > len(got) / 2


def test_needed_letters_are_in_every_match(spark):
    texts = ["FROM OAK RD TO ELM AVE, PE", "BETWEEN A ST AND B ST", "BETWEEN A ST & B ST", "OAK-ELM", "SIGNING OVER OAK RD ON I-5", "AT X ON IH 5", "UNDER OAK",
             "NEAR OAK", "OVER OAK", "IN SPRING FIELD", "2.5 MI N OF US 36", "3 M N OF OAK", "EXIT 4", "JCT. US 5", "OAK INTERCHANGE", "FM OAK RD, PAVING", "FR. OAK"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, needed in titles.NEEDED.items():
        assert df.where(F.col("t").rlike(pattern) & ~F.col("t").contains(needed)).count() == 0
        assert df.where(F.col("t").rlike(pattern)).count() > 0


def test_pairs_of_one_number_are_spread_over_tasks(spark, tmp_path):
    from roadledger.queries import REGISTRY
    suppliers = [(2 * i, 3) for i in range(10)] + [(4, 3), (5, 3), (6, None), (None, 3)]
    parts = [(i, "Brand#3", "PROMO") for i in range(40)] + [(1, "Brand#3", "PROMO"), (None, "Brand#3", "SMALL"), (7, None, "PROMO"), (8, "Brand#3", None), (9, "Brand#4", "PROMO")]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    out = REGISTRY["numbered_route_join"].run(spark, str(tmp_path))
    kind = {s: "PROMO" if s is not None and s % 2 == 0 else "SMALL" for s, _ in suppliers}
    want = [(s, b, p) for s, no in suppliers for p, b, t in parts if no is not None and b == f"Brand#{no}" and t == kind[s]]
    assert rows(out) == sorted(want, key=repr)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
