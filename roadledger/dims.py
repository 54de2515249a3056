"""Code lists and correction rules, and the small DataFrames built from them.

Everything under a "Fixed values" heading must equal the published code lists for results to be
right; it is stated as plain text, one ``code|label`` entry per line, in the order of the codes.
All of these tables have fewer than 100 rows, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Code lists.

IMPROVEMENT_TYPES = """
0|N/A
1|New Construction Roadway
2|4R - Reconstruction (Obsolete)
3|4R - Added Capacity
4|4R - No Added Capacity
5|4R - Maintenance Resurfacing
6|4R - Restoration & Rehabilitation
7|4R - Maintenance Relocation
8|Bridge New Construction
9|Bridge Replacement (Obsolete)
10|Bridge Replacement - Added Capacity
11|Bridge Replacement - No Added Capacity
12|Bridge Rehabilitation (Obsolete)
13|Bridge Rehabilitation - Added Capacity
14|Bridge Rehabilitation - No Added Capacity
15|Preliminary Engineering
16|Right of Way
17|Construction Engineering
18|Planning
19|Research
20|Environmental Only
21|Safety
22|Rail/Hwy Crossing
23|Transit
24|Traffic Management/Engineering - HOV
25|Vehicle Weight Enforcement Program
26|Ferry Boats
27|Administration
28|Facilities for Pedestrians and Bicycles
29|Acquisition of Scenic Easements and Scenic/Historic Sites
30|Scenic or Historic Highway Programs
31|Landscaping and Other Scenic Beautification
32|Historic Preservation
33|Rehabilitation/Operation of Historic Transportation Buildings etc.
34|Preservation of Abandoned Railway Corridors
35|Control and Removal of Outdoor Advertising
36|Archaeological Planning & Research
37|Mitigation of Water Pollution due to Highway Runoff
38|Safety and Education for Peds/Bicyclists
39|Establishment of Transportation Museums
40|Special Bridge
41|Youth Conservation Service
42|Training
43|Utilities
44|Other
45|Debt Service
46|Design-Build Contract (Obsolete)
47|Bridge Preventive Maintenance
48|Bridge Protection
49|Bridge Inspection and Bridge Related Training
50|New Tunnel
51|Tunnel Replacement
52|Tunnel Rehabilitation
53|Tunnel Preventive Maintenance
54|Tunnel Protection
55|Tunnel Inspection and Tunnel Related Training
56|Other Asset Inspection
57|Safety - Non Infrastructure
58|Freight
59|Bridge Resurfacing
60|Highway Infrastructure Preventive Maintenance
61|Routine Maintenance
62|Operations
63|Electric Vehicle & Charging Infrastructure
64|Other Alternative Fuel Vehicles & Infrastructure
65|Resilience Planning
66|Resilience Improvement - Highway Project
67|Resilience Improvement - Transit or Port Projects
68|Resilience Improvement - Natural Infrastructure
69|Community Resilience and Evacuation Routes
70|At-Risk Coastal Infrastructure - Highway Project
71|At-Risk Coastal Infrastructure - Transit or Port Projects
72|At-Risk Coastal Infrastructure - Natural Infrastructure
"""

PROJECT_STATUSES = """
1|State Certification Signature needed
2|Unsigned, State Certification Signature needed
3|State Recommendation Signature needed
4|State Authorization Signature needed
5|State Modification Signature needed
6|Division Review Signature needed
7|Division Recommendation Signature needed
8|Division Authorization Signature needed
10|Active
11|Closed
12|Closed Pending Expenditures
13|Withdrawn
14|Withdrawn Pending Expenditures
16|Rejected By Division
"""

FUNCTIONAL_SYSTEMS = """
0|No Functional System
1|Interstate
2|PA - Other Freeways & Expressways
3|PA - Other
4|Minor Arterial
5|Major Collector
6|Minor Collector
7|Local
"""

SYSTEM_CODES = """
0|Undefined
1|Interstate
2|NHS Non-Interstate
3|Other Federal-Aid Highway
4|Not on any Federal-Aid System
"""

NEPA_CLASSES = """
0|Undefined
1|Categorial Exclusions
2|Environmental Assessment
3|Environmental Impact Statement
"""

URBAN_RURAL = """
0|Statewide
1|Rural
2|Urban
"""

COUNTY_SPECIALS = """
0|unknown
999|statewide
"""

STATES = """
1|Alabama
2|Alaska
4|Arizona
5|Arkansas
6|California
8|Colorado
9|Connecticut
10|Delaware
11|District of Columbia
12|Florida
13|Georgia
15|Hawaii
16|Idaho
17|Illinois
18|Indiana
19|Iowa
20|Kansas
21|Kentucky
22|Louisiana
23|Maine
24|Maryland
25|Massachusetts
26|Michigan
27|Minnesota
28|Mississippi
29|Missouri
30|Montana
31|Nebraska
32|Nevada
33|New Hampshire
34|New Jersey
35|New Mexico
36|New York
37|North Carolina
38|North Dakota
39|Ohio
40|Oklahoma
41|Oregon
42|Pennsylvania
44|Rhode Island
45|South Carolina
46|South Dakota
47|Tennessee
48|Texas
49|Utah
50|Vermont
51|Virginia
53|Washington
54|West Virginia
55|Wisconsin
56|Wyoming
60|American Samoa
66|Guam
69|N Mariana
72|Puerto Rico
78|United States Virgin Islands
81|Canada
"""

# Recipients differ from the states in these entries only.
RECIPIENT_DIFFERENCES = """
0|Headquarters
11|District Of Columbia
75|N Mariana
91|Port Authority of NY and NJ
"""
RECIPIENTS_WITHOUT = (69,)

REGIONS = {
    "Northeast": [9, 23, 25, 33, 34, 36, 42, 44, 50],
    "Midwest": [17, 18, 19, 20, 26, 27, 29, 31, 38, 39, 46, 55],
    "South": [1, 5, 10, 11, 12, 13, 21, 22, 24, 28, 37, 40, 45, 47, 48, 51, 54],
    "West": [2, 4, 6, 8, 15, 16, 30, 32, 35, 41, 49, 53, 56],
}

FUNDING_PROGRAMS = {
    "Interstate Construction": """
        0420 0430 04C0 04P0 0500 0550 05C0 0590 17A0 1870 1880 8230 A510 EC20 EG20 X420""",
    "Interstate Maintenance": "04M0 04L0 Q010 Q440 0AB0 H010 L010 L01E L01R",
    "Interstate Maintenance Discretionary": "0560 31B0 31D0 Q020 H020 L020 L02E",
    "National Highway Performance Program": """
        Z0E1 Z0E2 Z51E Z53E Z001 Z002 Z510 Z530 M0E1 M0E2 M001 M002""",
}

PROGRAM_NAMES = """
0100|Federal-Aid - Consolidated Primary
0120|0120 (unknown program code)
0220|Federal-Aid - Secondary
0320|Urban Extensions
0420|Interstate Construction
0430|Interstate Construction, 100 percent
0440|Interstate 4R
04M0|Interstate Maintenance (ISTEA)
0540|Interstate Discretionary
0750|Federal-Aid - Rural Secondary
1140|1140 (unknown program code)
1170|1170 (unknown program code)
1180|1180 (unknown program code)
1390|Railway-Highway Crossing Hazard Elimination
3150|NHS-National Highway System (ISTEA)
33D0|STP-State Flexible
H010|Interstate Maintenance (TEA-21 Extensions FY2004-2005)
H050|NHS (TEA-21 Extensions FY2004-2005)
L010|Interstate Maintenance (SAFETEA-LU FY2006-2009)
L01E|Interstate Maintenance (SAFETEA-LU Extension)
L050|NHS (SAFETEA-LU FY2006-2009)
L05E|NHS (SAFETEA-LU Extension)
L240|STBG - STP FLEXIBLE (SAFETEA-LU)
M001|NHPP (MAP-21)
M0E1|NHPP (MAP-21 Extension)
M240|STBG - STP Flex (MAP-21)
Q010|Interstate Maintenance (TEA-21)
Q050|NHS (TEA-21)
Q240|STBG STP-FLEX (TEA-21)
W360|Federal-Aid Urban System
Z001|NHPP (FAST Act)
Z240|STBG - Flex
"""

WORK_TYPES = {
    "new_construction": [1, 7, 8, 50],
    "reconstruction": [2, 3, 4, 9, 10, 11, 51],
    "rehabilitation": [6, 12, 13, 14, 52],
    "maintenance": [5, 47, 48, 53, 54, 59, 60],
}
CONSTRUCTION_TYPES = ["new_construction", "reconstruction", "rehabilitation"]

STRUCTURES = {
    "road": [1, 2, 3, 4, 5, 6, 7, 60],
    "bridge": [8, 9, 10, 11, 12, 13, 14, 47, 48, 59],
    "tunnel": [50, 51, 52, 53, 54],
}

# Corrections of known typing errors.
STATE_RECODES = {75: 69}
STATUS_GROUP_TYPOS = {
    "1AIF": "1A1F", "2A1P": "2A1F", "6BI": "6B1", "BA2": "3A2", "IA3F": "1A3F", "IAIF": "1A1F",
}
GIS_END_TYPOS = {2801.0: 28.01, 15790.0: 1.579}
CHECK_ERRORS = {"ERROR": "0"}
# state, route, start mile-post, typed year, right year
OPEN_YEAR_FIXES = [
    (5, "40", 109.13, 89, 69),
    (5, "55", 67.31, 85, 65),
    (20, "70", 19.5, 88, 68),
    (20, "70", 143.75, 85, 65),
    (31, "80", 94.56, 89, 69),
]
# state, route, comparison, bound, offset, status group; applied in this order, so a later rule
# sees the mile-post an earlier one has already moved.
MILEPOST_RULES = [
    (27, "35E", None, None, -8827, None),
    (48, "35W", None, None, -37051, None),
    (48, "35E", None, None, -37051, None),
    (48, "27", None, None, -30121, None),
    (1, "20", None, None, 13010, None),
    (6, "80", None, None, -530, None),
    (18, "465", ">", 503, -10139, None),
    (18, "465", ">=", 14482, -557, None),
    (20, "435", ">=", 7580, -5546, None),
    (27, "494", ">", 2800, -3016, None),
    (28, "20", ">", 4400, 2520, None),
    (29, "29", None, None, 550, None),
    (29, "64", None, None, -1110, None),
    (34, "76", None, None, -2800, None),
    (39, "70", ">", 10121, -609, None),
    (39, "271", ">", 2070, 584, None),
    (39, "275", ">", 1000, 345, None),
    (39, "90", None, None, 14280, None),
    (41, "84", ">=", 1007, -232, None),
    (42, "79", ">", 6769, -555, None),
    (45, "526", None, None, 898, "1B1F"),
    (47, "65", ">", 8250, 100, None),
    (48, "44", None, None, -20000, None),
    (49, "80", ">", 12050, 331, None),
    (49, "84", ">", 4100, 3598, None),
    (47, "75", ">", 8400, 1960, None),
    (51, "64", ">", 5600, 3040, None),
    (51, "77", ">", 3200, 880, None),
    (42, "70", ">", 5864, 8722, None),
]

# Anchor type of a location reference -> precision (None: not usable).
ANCHOR_PRECISION = {
    "milepost": 6, "log_mile": 6, "slm": 6, "reference_post": 6, "km_post": 6,
    "ohio_coded_mp": 6, "station": 6,
    "exit_number": 5,
    "highway": 4, "road": 4, "named_junct_interchange": 4, "railroad_crossing": 4,
    "named_bridge": 4, "tunnel": 4, "county_line": 4, "state_line": 4, "waterway": 4,
    "city_limits": 4,
    "city": 1, "county": 1, "region": 1, "other_terrain": 1, "other_landmark": 1,
    "dot_district": None, "unknown": None,
}
# ---------------------------------------------------------------------------------------------


def entries(text: str) -> list[tuple[str, str]]:
    """``code|label`` lines to pairs."""
    return [tuple(line.strip().split("|", 1)) for line in text.strip().splitlines()]


def recipients() -> list[tuple[str, str]]:
    merged = dict(entries(STATES)) | dict(entries(RECIPIENT_DIFFERENCES))
    return sorted(((c, n) for c, n in merged.items() if int(c) not in RECIPIENTS_WITHOUT),
                  key=lambda e: int(e[0]))


def code_table(spark: SparkSession, pairs: list[tuple[str, str]], code: str, label: str,
               numeric: bool = True) -> DataFrame:
    """Small dimension table; numeric codes become INT."""
    rows = [((int(c) if numeric else c), name) for c, name in pairs]
    return spark.createDataFrame(rows, f"{code} {'int' if numeric else 'string'}, {label} string")


def decode(df: DataFrame, code: str, dim: DataFrame, label: str) -> DataFrame:
    """Add the label of a code (NULL for an unknown code) from a code table of this module."""
    dim = dim.toDF("__code", "__label")
    out = df.join(F.broadcast(dim), F.col(code) == F.col("__code"), "left")
    return out.withColumn(label, F.col("__label")).drop("__code", "__label")


def recode(c: Column, mapping: dict) -> Column:
    """Single-value recodes; other values pass through."""
    out = c
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)).otherwise(out)
    return out


def program_names(df: DataFrame, code: str, label: str) -> DataFrame:
    """Display name of a funding program; programs without one keep their own name."""
    names = code_table(df.sparkSession, entries(PROGRAM_NAMES), "c", "l", numeric=False)
    return decode(df, code, names, label).withColumn(label, F.coalesce(label, F.col(code)))


def repair_label(df: DataFrame, code: str, label: str, pairs: list[tuple[str, str]], width: int = 2) -> DataFrame:
    """A code read back as a number: its label decoded anew and the code padded to its width again."""
    dim = code_table(df.sparkSession, pairs, "c", "l")
    number = df.withColumn(code, F.trim(F.col(code).cast("string")).try_cast("int"))
    return decode(number, code, dim, label).withColumn(code, F.lpad(F.col(code).cast("string"), width, "0"))


def program_pairs() -> list[tuple[str, str]]:
    return [(c, name) for name, text in FUNDING_PROGRAMS.items() for c in text.split()]


def region_pairs() -> list[tuple[str, str]]:
    return [(str(c), name) for name, codes in REGIONS.items() for c in codes]


def precision_of(anchor: Column) -> Column:
    """Precision of an anchor type as a map lookup; NULL when the type has none."""
    known = {k: v for k, v in ANCHOR_PRECISION.items() if v is not None}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), anchor)
