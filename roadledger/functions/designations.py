"""Names prepared for matching against a road network: routes, references, suffixes, areas."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Route classes, abbreviations and area suffixes used by the network's names.
ROUTE_CLASS = {"interstate": "I", "us_route": "U", "state_route": "S", "local_road": "M"}
ROUTE_LABEL = {"I": "I- ", "U": "US Hwy ", "S": "State Hwy "}
SUFFIXES = {
    "River": "Riv", "Avenue": "Ave", "Street": "St", "Road": "Rd", "Creek": "Crk", "Brook": "Brk", "Lake": "Lk",
    "Highway": "Hwy", "Drive": "Dr", "Boulevard": "Blvd", "Lane": "Ln", "Court": "Ct", "Place": "Pl", "North": "N",
    "South": "S", "East": "E", "West": "W", "Northwest": "NW", "Southwest": "SW", "Northeast": "NE",
    "Southeast": "SE", "Parkway": "Pkwy", "Bayou": "Byu",
}
AREA_SUFFIX = (r"(?i)\s+(City and Borough|Census Area|Metropolitan Government|Municipality|Municipio|Borough|Parish|"
               r"County|CCD|CDP|township|village|town|city)$")
DIRECTIONAL_ANCHORS = ["county_line", "state_line", "city_limits"]
USABLE_ANCHORS = ["highway", "road", "waterway", "railroad_crossing", "county_line", "state_line", "city",
                  "city_limits", "county"]


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_area_suffix(name: Column) -> Column:
    """Area name without its legal suffix (County, Parish, CDP ...)."""
    return squish(F.regexp_replace(name, AREA_SUFFIX, ""))


def eligible(df: DataFrame, anchors: list[str] = USABLE_ANCHORS) -> DataFrame:
    """Flattened extraction rows the geocoder can place: no multi-location flag, one county, one
    reference per endpoint, usable anchor types, and a route match status."""
    flags = ~F.col("statewide") & ~F.col("various_locs_unspecified") & ~F.col("multi_locs_specified")
    refs = (F.col("ep_a_n_refs") == 1) & (F.col("ep_b_n_refs") == 1)
    known = F.col("ep_a_ref1_anchor_type").isin(*anchors) & F.col("ep_b_ref1_anchor_type").isin(*anchors)
    single = ~F.coalesce(F.col("county_name").contains(";"), F.lit(False))
    return df.where(flags & refs & known & single & F.col("main_route_num_match_status").isNotNull())


def route_designation(df: DataFrame) -> DataFrame:
    """Route class, network designation and whether the route is known by name only."""
    kind = F.lit("O")
    for long, short in ROUTE_CLASS.items():
        kind = F.when(F.col("main_route_type") == long, short).otherwise(kind)
    df = df.withColumn("route_class", kind)
    label = squish(F.col("main_alt_names"))
    for short, text in ROUTE_LABEL.items():
        numbered = (F.col("route_class") == short) & F.col("main_route_num").isNotNull()
        label = F.when(numbered, F.concat(F.lit(text), F.col("main_route_num").cast("string"))).otherwise(label)
    named = F.col("route_class").isin("M", "O") | F.col("main_route_num").isNull()
    return df.withColumns({"route_designation": label, "is_named": named})


class NameRule(NamedTuple):
    """Names of these anchors (of any, when empty) that match ``when`` are rewritten by ``edits`` (pattern, replacement)."""

    anchors: tuple[str, ...]
    when: str
    edits: tuple[tuple[str, str], ...]


# How a reference is written in a title and how the network writes it, the first rule that fits counts.
NAME_RULES = [
    NameRule(("county_line",), r"(?i)\s*County\s*Line", ((r"(?i)\s*County\s*Line|\s*County|-", ""),)),
    NameRule(("state_line",), r"(?i)State\s*Line", ((r"(?i)\s*State\s*Line|-", ""),)),
    NameRule(("city", "city_limits"), r"(?i)City\s*Limit|Town\s*Line", ((r"(?i)\s*City\s*Limits?\s*|\s*Town\s*Lines?\s*|\s*Limits?\s*|-", ""),)),
    NameRule(("county",), r"(?i)\bCounty\b", ((r"(?i)\s*County\b", ""),)),
    NameRule((), r"(?i)Rail\s*road|Railway|\bRR\b|\bRwy\b", ((r"(?i)\s*Rail\s*road", " RR"), (r"(?i)\s*Railway", " Rlwy"))),
    NameRule((), r"(?i)^Interstate\s+\S+", ((r"(?i)^Interstate\s+(\S+)", "I- $1"),)),
    NameRule((), r"(?i)^US\s+Route\s+\S+", ((r"(?i)^US\s+Route\s+(\S+)", "US Hwy $1"),)),
    NameRule((), r"(?i)^State\s+Route\s+\S+", ((r"(?i)^State\s+Route\s+(\S+)", "State Rte $1"),)),
    NameRule((), r"(?i)^State\s+Highway\s+\S+", ((r"(?i)^State\s+Highway\s+(\S+)", "State Hwy $1"),)),
]
# Boundary words, two names with a hyphen between them, and a direction as a word.
BOUNDARY_WORDS = r"(?i)\s*(State|County|Town)\s*Line"
HYPHENATED = r"\w+\s*-\s*\w+"
DIRECTION = r"(?i)(?<![A-Za-z])(North|South|East|West)(?![A-Za-z])"


def without_first(text: Column, part: Column) -> Column:
    """The text without the first occurrence of a part, in either case."""
    at = F.position(F.lower(part), F.lower(text))
    return F.when((F.length(part) > 0) & (at > 0), F.concat(
        F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def paired_boundary(feature: Column, state: Column, county: Column) -> Column:
    """The far side of a boundary named by both sides, such as 'Adams-Brown County Line'; NULL when it is not one.

    Sides that name the own state or county come last, the others keep their order, and the first one is taken.
    """
    sides = F.transform(F.split(F.regexp_replace(feature, BOUNDARY_WORDS, ""), "-"), squish)
    homes = F.array(F.lower(F.coalesce(state, F.lit(""))), F.lower(F.coalesce(county, F.lit(""))))
    ranked = F.array_sort(F.transform(F.filter(sides, lambda s: s != ""), lambda s, i: F.struct(
        F.array_contains(homes, F.lower(s)).alias("home"), i.alias("i"), s.alias("name"))))
    return F.when(feature.rlike(BOUNDARY_WORDS) & feature.rlike(HYPHENATED), F.get(ranked, 0)["name"])


def rule_number(name: Column, anchor: Column, rules: list[NameRule] = NAME_RULES) -> Column:
    """Place of the first rule that fits a name's anchor and text, NULL for none."""
    fits = [name.rlike(r.when) & (anchor.isin(*r.anchors) if r.anchors else F.lit(True)) for r in rules]
    return F.coalesce(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)])


def rewritten(name: Column, number: Column, rules: list[NameRule] = NAME_RULES) -> Column:
    """The name after the edits of the rule of that number."""
    edited = [reduce(lambda text, edit: F.regexp_replace(text, *edit), r.edits, name) for r in rules]
    return reduce(lambda out, i: F.when(number == i, squish(edited[i])).otherwise(out), range(len(rules)), name)


def abbreviate(name: Column) -> Column:
    """Trailing road words shortened the way the network writes them."""
    return squish(reduce(lambda text, word: F.regexp_replace(text, rf"(?i)\b{word}$", SUFFIXES[word]), SUFFIXES, name))


def normalise_reference(df: DataFrame, feature: str, anchor: str, direction: str, state: str,
                        county: str) -> DataFrame:
    """Direction named in the feature, and the feature text in the network's style."""
    # every step is a column of its own: written into one another, the early ones would be worked out hundreds of times a row
    kind, name, text = F.col(anchor), F.col("__name"), F.col("__text")
    d = df.withColumns({"__name": squish(F.col(feature)),
                        "__county": without_first(F.regexp_replace(F.col(county), r"(?i)\s+County", " County"), F.lit(" County"))})
    # the own county only goes from names of county lines
    own_line = (kind == "county_line") & name.rlike(NAME_RULES[0].when)
    d = d.withColumn("__text", F.when(own_line, without_first(name, F.coalesce("__county", F.lit("")))).otherwise(name))
    on_line = kind.isin(*DIRECTIONAL_ANCHORS)
    far_side = F.when(on_line, paired_boundary(name, F.col(state), F.col("__county")))
    d = d.withColumn("__rule", rule_number(text, kind))
    d = d.withColumn("__text", F.coalesce(far_side, rewritten(text, F.col("__rule"))))
    named = F.nullif(F.lower(F.regexp_extract(name, DIRECTION, 1)), F.lit(""))
    d = d.withColumns({"extracted_direction": F.when(on_line, F.coalesce(named, F.col(direction))), "feature_clean": abbreviate(text)})
    return d.drop("__name", "__county", "__rule", "__text")
