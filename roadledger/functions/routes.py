"""Route references in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadledger.functions.text import replace_first

# Ways an interstate is written, in order of preference.
REFERENCE_PATTERNS = [
    r"\bIH?[-\s]?\d{1,3}[A-Z]{0,2}\b",
    r"\bIR[-\s]?\d{1,3}[A-Z]{0,2}\b",
    r"\bIN[-\s]?\d{1,3}\b",
    r"\bINTERSTATE\s+\d{1,3}\b",
    r"\bFAI[-\s]?\d{1,3}\b",
]
# IR and IN stand before the bare I, so that the whole prefix is removed.
REFERENCE_PREFIX = r"^(INTERSTATE\s+|FAI[-\s]?|IR[-\s]?|IN[-\s]?|IH?[-\s]?)"
NUMBER_PATTERNS = [
    r"\bINTERSTATE\s+(\d{1,3})\b",
    r"\bIH\s*(\d{1,3})(?=[^0-9]|$)",
    r"\bFAI[\s-]*(\d{1,3})(?=[^0-9]|$)",
    r"\bIS\s+(\d{1,3})(?=[^0-9]|$)",
    r"\bIR[\s-]+(\d{1,3})(?=[^0-9]|$)",
    r"\bI[\s-]*(\d{1,3})(?=[^0-9]|$)",
]
# Numbers of other route systems, and two routes named together.
US_ROUTE = r"\b(?:US|U\.S\.)\s*(?:RT\.?\s*)?(\d{1,3})\b"
STATE_ROUTE = r"\b(?:SR|SH|RTE?|ROUTE)\s*[\s-]?(\d{1,4})\b"
CONCURRENT = r"I[\s-]*(\d{1,3})\s*[/&]\s*I?[\s-]*(\d{1,3})"
# Phrases that mention a route without being on it; {n} is the route number.
CROSS_REFERENCES = [
    r"(?:OVER|UNDER|OV|OVR)\s+I[\s-]*{n}(?=[^0-9]|$)",
    r"(?:OVER|UNDER|OV|OVR)\s+IH\s*{n}(?=[^0-9]|$)",
    r"\bTO\s+I[\s-]*{n}(?=[^0-9]|$)(?!\s*[-,])",
    r"\bAT\s+I[\s-]*{n}(?=[^0-9]|$)",
    r"@\s*I[\s-]*{n}(?=[^0-9]|$)",
]
# Phrases that end a project at a route, a route that leads the title, and any mention of one.
LIMIT_REFERENCES = [
    r"(?:FR(?:OM|\.)?|FM)\s+I[\s-]*{n}(?=[^0-9]|$)",
    r"\bTO\s+I[\s-]*{n}(?=[^0-9]|$)",
]
LEADING_REFERENCE = r"^(?:I[\s-]*{n}|IH\s*{n}|IR[\s-]*{n}|FAI\s*{n})"
RAW_REFERENCES = [r"INTERSTATE\s+{n}", r"IH\s*{n}", r"FAI[\s-]*{n}", r"IR[\s-]*{n}", r"IS\s+{n}",
                  r"I[\s-]*{n}[A-Za-z]?"]


def extract_routes(df: DataFrame, column: str, count: int = 3) -> DataFrame:
    """Up to three interstate references: text without prefix, letter-suffix flag, number.

    Each next reference is searched after the previous one's first occurrence in the text was
    blanked out.
    """
    anything = "|".join(f"(?:{p})" for p in REFERENCE_PATTERNS)
    out = df.withColumn("__t", F.upper(F.col(column)))
    for i in range(1, count + 1):
        out = out.withColumn(f"__m{i}", F.regexp_substr("__t", F.lit(anything)))
        out = out.withColumn("__t", replace_first(F.col("__t"), F.col(f"__m{i}"), "-----"))
    new = {"has_route": F.coalesce(F.col("__m1").isNotNull(), F.lit(False))}
    for i in range(1, count + 1):
        bare = F.regexp_replace(f"__m{i}", REFERENCE_PREFIX, "")
        new[f"route_{i}"] = bare
        new[f"route_{i}_has_char"] = bare.rlike("[A-Za-z]")
        new[f"route_{i}_int"] = F.nullif(F.regexp_replace(bare, "[A-Za-z]", ""), F.lit("")).try_cast("int")
    return out.withColumns(new).drop("__t", *[f"__m{i}" for i in range(1, count + 1)])


def all_routes(text: Column) -> Column:
    """Distinct positive route numbers, in the order of the patterns and of the text."""
    upper = F.upper(text)
    found = [F.regexp_extract_all(upper, F.lit(p), F.lit(1)) for p in NUMBER_PATTERNS]
    numbers = F.transform(F.concat(*found), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def _with_number(pattern: str, n: Column) -> Column:
    pieces = pattern.split("{n}")
    parts: list[Column] = [F.lit(pieces[0])]
    for p in pieces[1:]:
        parts += [n.cast("string"), F.lit(p)]
    return F.concat(*parts)


def _matches(text: Column, patterns: list[str], n: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, _with_number(p, n))
    return out


def _raw(text: Column, n: Column) -> Column:
    tries = [F.trim(F.regexp_substr(text, _with_number(p, n))) for p in RAW_REFERENCES]
    return F.coalesce(*tries, F.concat(F.lit("I-"), n.cast("string")))


def segment_route(df: DataFrame, column: str) -> DataFrame:
    """Route the segment lies on: raw text, number and class. Routes only crossed, reached or left
    do not count when another one remains."""
    t, routes = F.col("__t"), F.col("__all")
    out = df.withColumn("__t", F.coalesce(F.trim(F.upper(F.col(column))), F.lit("")))
    out = out.withColumn("__all", all_routes(F.col("__t")))

    def only_mentioned(n: Column) -> Column:
        limit = _matches(t, LIMIT_REFERENCES, n) & ~F.rlike(t, _with_number(LEADING_REFERENCE, n))
        return _matches(t, CROSS_REFERENCES, n) | limit

    out = out.withColumn("__on", F.when(F.size(routes) > 1, F.filter(routes, lambda n: ~only_mentioned(n))))
    us, st = F.regexp_substr(t, F.lit(US_ROUTE)), F.regexp_substr(t, F.lit(STATE_ROUTE))
    pair = F.regexp_substr(t, F.lit(CONCURRENT))
    one = F.element_at(F.when((F.size(routes) == 1) | (F.size("__on") == 0), routes).otherwise(F.col("__on")), 1)
    many = (F.size(routes) > 1) & (pair.isNotNull() | (F.size("__on") > 1))
    some = F.size(routes) > 0
    both = (F.size(routes) > 1) & pair.isNotNull()
    out = out.withColumn("__one", F.when(some, one))
    pair_no = F.regexp_extract(t, CONCURRENT, 1).try_cast("int")
    return out.withColumns({
        "route_raw": F.when(both, pair).when(some, _raw(t, F.col("__one"))).otherwise(
            F.coalesce(F.trim(us), F.trim(st), F.lit(""))),
        "route_number": F.when(both, pair_no).when(some, F.col("__one")),
        "route_type": F.when(many, "multiple interstate").when(some, "interstate")
        .when(us.isNotNull() | st.isNotNull(), "non-interstate").otherwise("")}).drop("__t", "__all", "__on", "__one")


def road_class(name: Column) -> Column:
    """Road class derived from a name: I, U, S, C or M (other)."""
    # Name patterns of each class.
    ladder = [
        ("I", r"(?i)^I-\s*\d"),
        ("U", r"(?i)^U\.?S\.?\s*(Hwy|Highway|Rte|Route)?\s*\d"),
        ("S", r"(?i)^State\s*(Hwy|Highway|Rte|Route|Rd)\s*\d"),
        ("S", r"(?i)^(SR|SH)\s*-?\s*\d"),
        ("S", r"(?i)^[A-Z]{2}\s*-\s*\d+$"),
        ("C", r"(?i)^(County|Co)\s*(Road|Rd|Hwy|Highway)\s*\d"),
        ("C", r"(?i)^CR\s*-?\s*\d"),
    ]
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for label, pattern in ladder:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise("M")
