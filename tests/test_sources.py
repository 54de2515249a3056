from pyspark.sql import functions as F

from roadledger.plans import receipts as rc
from roadledger.sources import documents as doc
from roadledger.sources import sheets, tables
from tests.conftest import rows

XML = """<Projects>
<Project><RecipientId>48</RecipientId><FederalProjectNumber>0351001</FederalProjectNumber><ProjectTitle> I-35
  FROM A\tTO B </ProjectTitle><CompleteDate>07/04/1998</CompleteDate>
 <RecipientProjectNumbers><RecipientProjectNumber>P1</RecipientProjectNumber><RecipientProjectNumber>P2</RecipientProjectNumber></RecipientProjectNumbers>
 <ProjectGroups><ProjectGroup><GroupCode>1</GroupCode></ProjectGroup><ProjectGroup><GroupCode> </GroupCode></ProjectGroup><ProjectGroup><GroupCode>3</GroupCode></ProjectGroup></ProjectGroups>
 <UserDefinedFields><UserDefinedField><FieldName>f</FieldName><ValueText/><ValueNumber>7</ValueNumber></UserDefinedField></UserDefinedFields>
 <Details>
  <Detail><LineNumber>1</LineNumber><ProgramCode>0420</ProgramCode><ImprovementType>1</ImprovementType>
   <Locations><GIS><StateId>75</StateId><TotalCost>2000000</TotalCost>
     <GISBreakdown><CountyId>3</CountyId></GISBreakdown><GISBreakdown><CountyId>1</CountyId></GISBreakdown><GISBreakdown><CountyId>3</CountyId></GISBreakdown></GIS></Locations></Detail>
  <Detail><LineNumber>2</LineNumber><ProgramCode>Z001</ProgramCode><ImprovementType>15</ImprovementType>
   <Locations><NonGIS><StateId>48</StateId><CountyId>999</CountyId><TotalCost>500000</TotalCost><FederalFunds>400000</FederalFunds></NonGIS></Locations></Detail>
  <Detail><LineNumber>3</LineNumber><ProgramCode>L010</ProgramCode><ImprovementType>150</ImprovementType><Locations><GIS><StateId>48</StateId></GIS></Locations></Detail>
  <Detail><LineNumber>4</LineNumber><ProgramCode>XXXX</ProgramCode></Detail>
 </Details></Project>
<Project><RecipientId>1</RecipientId><FederalProjectNumber>EMPTY</FederalProjectNumber></Project>
</Projects>"""


def flat(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "~$a.xml").write_text("lock")
    return doc.flatten_projects(doc.read_projects(spark, str(tmp_path)))


def test_nested_documents_flatten(spark, tmp_path):
    f = flat(spark, tmp_path)
    got = rows(f, "Detail_LineNumber", "GISBreakdown_index", "GIS_has_breakdown", "GISBreakdown_CountyId")
    assert got == sorted([("1", 1, "1", "3"), ("1", 2, "1", "1"), ("1", 3, "1", "3"), ("2", None, None, ""),
                          ("3", None, "0", ""), ("4", None, None, "")], key=repr)
    head = f.first()
    assert head["ProjectTitle"] == "I-35 FROM A TO B" and head["RecipientProjectNumber"] == "P1"
    assert head["GroupCode"] == "1; 3" and head["ProjUDF_Value"] == "7" and head["source_file"] == "a.xml"


def test_receipts_and_projects(spark, tmp_path):
    counties = spark.createDataFrame([("69003", "Three"), ("69001", "One")], "county_fips string, county_name string")
    r = rc.receipts(flat(spark, tmp_path), counties).cache()
    assert r.count() == 4
    one = r.where("detail_linenumber = 1").first()
    assert one["county_fips"] == ["69003", "69001"] and one["county_name"] == ["Three", "One"]
    assert one["new_construction"] and one["road"] and one["funding_program"] == "Interstate Construction"
    assert one["region"] == "South" and one["completion_year"] == 1998 and one["total_cost_mills"] == 2.0
    three = r.where("detail_linenumber = 3").first()
    assert not three["road"] and three["funding_program"] == "Interstate Maintenance"
    p = rc.projects(r)
    assert p.count() == 1
    p = p.first()
    assert p["receipts"] == 4 and p["total_cost_mills"] == 2.5 and p["fp_ic"] and p["fp_im"] and not p["fp_imd"]
    assert p["proj_improv_types"] == ["New Construction Roadway", "Preliminary Engineering"]
    assert p["county_fips"] == ["69003", "69001", "48999"]
    idx = rc.price_index(spark, spark.createDataFrame([("1998-01-01", 40.0), ("1998-02-01", 60.0)], "observation_date string, cpiaucsl double"))
    titles = rc.title_table(rc.projects(r), idx).first()
    assert titles["total_cost_mills_adj"] == 5.0 and titles["route_fpn"] == 35 and titles["below_median_cost"] is False


def test_delimited_and_json(spark, tmp_path):
    (tmp_path / "c.csv").write_text('code,label\n"01","a ""quoted"", name"\n"01","second"\n"02","two\nlines"\n')
    c = tables.read_crosswalk(spark, str(tmp_path / "c.csv"), ["code"], "label", ["label"], ["code", "label"])
    assert rows(c) == [("01", "a quoted, name"), ("02", "two\nlines")]
    (tmp_path / "s1.csv").write_text("1,1,40,,27,10,5,,,1A1F,0756,,,,,,,,\n")
    (tmp_path / "s2.csv").write_text("1,2,40,,27,15,5,,,1A1F,,,,,,,,,\n")
    t = tables.read_tagged(spark, {str(tmp_path / "s1.csv"): 0, str(tmp_path / "s2.csv"): 1})
    assert rows(t, "mpost", "date1", "is_new") == sorted([(10.0, 756, 0), (15.0, None, 1)], key=repr)
    (tmp_path / "r.json").write_text('{"a": 1, "other": 2}')
    from pyspark.sql import types as T
    assert rows(tables.read_results(spark, str(tmp_path / "r.json"), T.StructType([T.StructField("a", T.IntegerType())]))) == [(1,)]


def test_partitioned_sink_and_checks(spark, tmp_path):
    df = spark.createDataFrame([("01", 1, "t"), ("02", 2, "t")], "state string, v int, txt string")
    path = str(tmp_path / "out")
    tables.write_partitioned(df, path, ["state"])
    stored = spark.read.schema("v int, txt string, state string").parquet(path)
    expected = spark.createDataFrame([("01",), ("02",), ("03",)], "state string")
    assert rows(tables.missing_partitions(expected, stored, ["state"])) == [("03",)]
    assert tables.lite(df, ["txt"]).columns == ["state", "v"]
    assert [r[0] for r in tables.code_list(df, "state").collect()] == ["01", "02"]
    layer = str(tmp_path / "layer")
    first = tables.read_or_rebuild(spark, layer, ["a"], lambda: spark.range(2).withColumnRenamed("id", "a"))
    assert first.count() == 2
    again = tables.read_or_rebuild(spark, layer, ["a", "b"], lambda: spark.range(3).select(F.col("id").alias("a"), F.lit(1).alias("b")))
    assert again.count() == 3
    roads = spark.createDataFrame([(1, "A St", "S1100"), (2, None, "S1100"), (3, "B", "S9")], "tlid int, fullname string, mtfcc string")
    roads.write.parquet(str(tmp_path / "roads"))
    for named, want in ((True, [1]), (False, [2]), (None, [1, 2])):
        got = tables.read_roads(spark, str(tmp_path / "roads"), ["tlid"], ["S1100"], "mtfcc", "fullname", named)
        assert [r[0] for r in rows(got)] == want
    parts = spark.createDataFrame([("r", [[(0.0, 0.0)], []]), ("q", [])], "id string, parts array<array<struct<x: double, y: double>>>")
    assert rows(tables.explode_parts(parts, "parts", ["id"]), "id", "part", "eid") == [("r", 0, 1)]


def test_report_sheets(spark):
    cells = [("s", 0, ["title"]), ("s", 1, ["STATE", "TOTAL", "FUNDS"]), ("s", 2, ["", "SPENT", "LEFT"]), ("s", 3, ["Texas 2/", "1,000", "5"]),
             ("s", 4, ["Total", "$2,500", "7"])]
    df = spark.createDataFrame(cells, "sheet string, row int, cells array<string>")
    out = sheets.normalise_report(df, "STATE", 2, "spent", "Total")
    assert rows(out, "header", "amount") == [("TOTAL SPENT", 2500.0)]
    assert rows(sheets.normalise_report(df, "STATE", 2, "spent", "Texas"), "amount") == [(1000.0,)]
    layout = spark.createDataFrame([("s", 3, 4, 1999, "roads", "all", "state", 2)],
                                   "sheet string, row_from int, row_to int, year int, group string, subgroup string, agency string, col int")
    assert rows(sheets.melt_blocks(df, layout), "year", "agency", "amount") == [(1999, "state", 1000.0), (1999, "state", 2500.0)]
    assert sheets.slice_rows(df, 1, 4, drop=2).count() == 2
    assert rows(tables.union_by_name([spark.range(1).toDF("id"), spark.range(1).withColumn("b", F.lit(2))])) == sorted([(0, None), (0, 2)], key=repr)


def test_a_filter_on_records_does_not_parse_them_twice(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    plan = flat(spark, tmp_path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1
