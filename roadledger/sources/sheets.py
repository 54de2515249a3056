"""Report-style sheets exported to rows of ``sheet, row, cells[]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.functions.text import clean_text
from roadledger.operators.ordered import join_back


def normalise_report(sheets: DataFrame, sentinel: str, header_rows: int, word: str,
                     keep_label: str) -> DataFrame:
    """Amounts of one labelled row, under the columns whose joined header holds a word.

    The header starts at the first row whose first cell is the sentinel and spans several rows;
    footnote marks are stripped from labels.
    """
    first = clean_text(F.try_element_at("cells", F.lit(1)))
    marked = sheets.withColumn("__first", first)
    start = marked.where(F.upper("__first") == sentinel).groupBy("sheet").agg(F.min("row").alias("__top"))
    rows = join_back(marked, start, ["sheet"]).where(F.col("__top").isNotNull())
    cells = rows.select("sheet", "row", "__first", "__top", F.posexplode("cells").alias("col", "cell"))
    in_header = (F.col("row") >= F.col("__top")) & (F.col("row") < F.col("__top") + header_rows)
    # a header has at most ``header_rows`` cells per column
    heads = cells.where(in_header).groupBy("sheet", "col").agg(F.array_sort(
        F.collect_list(F.struct("row", clean_text(F.col("cell")).alias("t")))).alias("__h"))
    heads = heads.select("sheet", "col", F.array_join(F.filter(
        F.transform("__h", lambda h: h["t"]), lambda t: t != ""), " ").alias("header"))
    label = F.trim(F.regexp_replace("__first", r"\s*(\d/|\*+|\(\d+\))\s*$", ""))
    body = cells.where(F.col("row") >= F.col("__top") + header_rows).withColumn("label", label)
    body = body.where((F.col("label") == keep_label) & (F.col("col") > 0))
    named = body.join(heads.where(F.upper("header").contains(word.upper())), ["sheet", "col"])
    amount = F.regexp_replace(F.col("cell"), "[,$ ]", "").try_cast("double")
    return named.select("sheet", "col", "header", amount.alias("amount"))


def melt_blocks(sheets: DataFrame, layout: DataFrame) -> DataFrame:
    """Fixed-position blocks to year x group x subgroup x agency.

    ``layout`` (sheet, row_from, row_to, year, group, subgroup, agency, col) lists where each
    amount stands; it describes the report form, so it is a small table.
    """
    hit = (sheets["sheet"] == layout["sheet"]) & sheets["row"].between(layout["row_from"], layout["row_to"])
    amount = F.regexp_replace(F.try_element_at(sheets["cells"], layout["col"]), "[,$ ]", "").try_cast("double")
    return sheets.join(layout, hit).select(
        "year", "group", "subgroup", "agency", sheets["sheet"], sheets["row"], amount.alias("amount"))


def slice_rows(sheets: DataFrame, row_from: int, row_to: int, drop: int = 0) -> DataFrame:
    """A range of rows without its first ``drop`` interim header rows."""
    return sheets.where(F.col("row").between(row_from + drop, row_to))
