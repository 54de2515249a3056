"""Location of a project from its free-text title: endpoints, mile-posts, precision.

Every rule is a column expression, so a title is parsed inside the scan's own stage. Rules are
tried in a fixed order and the first one that yields a usable location wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Patterns and word lists of the title language.
WORK_WORDS = (
    r"(?:PE|ROW|R/W|R-O-W|CONSTR\w*|RESURF\w*|OVERLAY|PAVING|PAVT|SIGN\w*|LIGHT\w*|GUARD\w*|FENCE|SEAL\w*|"
    r"LAND\w*|MAINT\w*|REHAB\w*|WIDEN\w*|REPL\w*|REPAIR\w*|SAFETY|UTIL\w*|ILLUM\w*|SURF\w*|DECK\w*|PAINT\w*|"
    r"PATCH\w*|MARK\w*|DRAIN\w*|STUDY|DESIGN|MISC|INCID\w*|INSTALL\w*|MODERN\w*|UPGRADE\w*|IMPROV\w*|MILL\w*|"
    r"MICRO\w*|PMS|HTP|HMA|PCC|BIT\w*|CONC\w*|SEED\w*|EROSI\w*|BARRIER|NOISE|MEDIAN|CLEAR\w*|DEMO\w*|SURVEY|"
    r"STRS|STRUCT\w*|ACQUI\w*|FENC\w*|DELINEAT\w*|MONUMENT\w*|RIGHT\w*|LANDSCAP\w*|ARCHAEO\w*|GRADING|"
    r"HIGH\s+TYPE|APPROACHES|SUBBASE|PAVEMENT|P\.?E\.?|PURCHASE\s+\w+|ARCHAEOLOGICAL|GR[\.,\s]|DR[\.,\s]|"
    r"G&D\w*|EMBANKMENT|EXCAVAT\w*|CHANNELIZ\w*|RUMBLE\w*|CABLE\w*|RECONST\w*|RECONSTRUCT\w*|REHABILITAT\w*|"
    r"PREVENTIVE|PREVENTATIVE|MOVE\s|ADD\s|NEW\s|WELD\w*|SLIDE\s|JOINT\w*|EPOXY|SCOUR|RIPRAP|RCI|CPR|HPP|HBP|"
    r"STP|HRRR|HSIP|CMAQ|NFA|NHPP|STBG)")
WORK_START = (
    r"^(?:PE\b|ROW\b|R/W|RESURFAC|REHAB|OVERLAY|PAVING|SIGNING|LIGHTING|GUARDRAIL|GRADING|MILLING|PATCHING|"
    r"SEEDING|LANDSCAPING|FENCING|DRAINAGE|WIDENING|CONSTRUCTION|PRELIMINARY|DESIGN|STUDY|MAINTENANCE|"
    r"SAFETY\s+IMPROV|EROSION|STRIPING|DELINEATION|ILLUMINATION|BARRIER|MEDIAN|CABLE|REPAIR|REPLACE|INSTALL|"
    r"NOISE|SURVEY|SEAL\s|CLEARING|DEMOLITION|PAVEMENT\s*MARK|RUMBLE|RECONST|WIDEN\s+FREEWAY|MOVE\s|ADD\s+LANE|"
    r"PREVENTIVE|PREVENTATIVE|BRIDGE\s+(?:REHAB|DECK|PAINT|REPLAC|WIDEN|REPAIR|MAINT|INSPECT)|MILL\s+AND|RCI\s|"
    r"CPR\s|HAZARD|HIGH\s+FRICTION|SURFACING|SHOULDER|SLIDE\s+REPAIR|RESURFACE|REHABILITAT|RIGHT\s+OF\s+WAY|"
    r"MODIFY|UPGRADE|IMPROVE)")
TYPE_AFTER_SEMICOLON = (
    r"(?i)(?:PE|ROW|CONSTR|RESURF|BRIDGE|SIGN|LIGHT|GUARD|PAVE|REHAB|WIDEN|REPAIR|SAFETY|UTIL|DESIGN|STUDY|MAINT|"
    r"INSTALL|OVERLAY|MILL|PATCH|MARK|DRAIN|SEED|LANDSCAPE|FENCE|GRAD|SURVEY|CONST|ENGINEER|PLANNING|PRELIMINARY|"
    r"RIGHT|ACQUI|EMERGENCY|RESTOR|DECK|PAINT|SUBSTRUCTURE|SUPERSTRUCTURE)")
TYPE_AFTER_COMMA = (
    r"(?i)(?:PE|ROW|R/W|CONSTR|RESURF|OVERLAY|PAV|BRIDGE|BR[\.\s]|SIGN|LIGHT|GUARD|FENCE|SEAL|GR[\.,\s]|DR[\.,\s]|"
    r"LAND|MAINT|REHAB|WIDEN|REPL|REPAIR|SAFE|UTIL|ILLUM|SURF|DECK|PAINT|PATCH|MARK|DRAIN|STUDY|DESIGN|MISC|INCID|"
    r"INSTALL|UPGRADE|IMPROV|MILL|MICRO|PMS|HTP|HMA|PCC|BIT|CONC|SEED|EROSI|BARRIER|NOISE|MEDIAN|CLEAR|DEMO|SURVEY|"
    r"STRS|STRUCT|ACQUI|FENC|DELINEAT|MONUMENT|RIGHT|LANDSCAP|ARCHAEO|LIGHTING|GRADING|CHANNELIZ|EMBANKMENT|"
    r"EXCAVAT|RECONST|SLIDE)")
PLACE_PATTERNS = [
    r"\b(?:ST|AVE|BLVD|RD|DR|LN|HWY|PKWY|PIKE|CREEK|RIVER|BRIDGE|BR\b|COUNTY|CO\.?|CITY|TOWN|TWP|JCT|JUNCTION|"
    r"INTERCHANGE|INTCH|EXIT|RAMP|STATE\s*LINE|S/?L|C/?L|I\.C|TUNNEL|OVERPASS|UNDERPASS)",
    r"\b(?:US|SR|SH|CR|FM|RT|RTE|NM|TH|CTH|CSAH)\s*\d",
    r"\bI[\s-]*\d{1,3}\b",
    r"\d+\s*MI",
    r"\bCOLI\b",
    r"\bCO\.\s*L",
    r"\b(?:RIVER|CREEK|LAKE)\b",
]
PLAIN_NAME = r"^[A-Z][A-Za-z\.' ]+$"
MILEPOST_SCORE = r"\b(?:MP|MM|MILEPOST|MILE\s*MARKER|MILEPOINT|LM)\s*\d"
OFFSET_MILES = r"(\d+\.?\d*)\s*MI\.?\s*([NSEW]\.?)\s*(?:OF\s+)?(.*)"
OFFSET_SHORT = r"(\d+\.?\d*)\s*M\s+([NSEW])\s+(?:OF\s+)?(.*)"
PRECISE_ANCHOR = [
    r"\b(?:SR|SH|US|CR|FM|RT|RTE)\s*[\s-]?\d", r"\bI[\s-]*\d{1,3}", r"\bJCT\b", r"\b(?:R\.?R\.|RR|RAILROAD)\b",
    r"\bSTATE\s*LINE\b", r"\bS/?L\b", r"\b[A-Z]+\s+COLI\b", r"\bCO\.\s*L", r"\bCO\s+L(?:INE)", r"\bCOUNTY\s*L",
    r"[A-Z]+\s+CO\.?\s*L\b", r"\b\w+\s+(?:ST|AVE|BLVD|RD|ROAD|DR|LN|WAY|PKWY|PIKE|HWY)\b", r"\bINTERCHANGE\b",
    r"\bINTCH\b", r"\bI\.C\.?\b", r"\bEXIT\s*\d",
]
PRECISE_ANCHOR_SHORT = [
    r"\b(?:SR|SH|US|CR|FM|RT|RTE)\s*[\s-]?\d", r"\bI[\s-]*\d",
    r"\b\w+\s+(?:ST|AVE|BLVD|RD|ROAD|DR|LN|WAY|PKWY|PIKE|HWY)\b",
]
CROSSING_SCORE = [
    r"\b(?:SR|SH|US|CR|FM|RT|RTE|NM|TH|CTH|CSAH|ROUTE)\s*[\s-]?\d{1,4}\b", r"\bI[\s-]*\d{1,3}\b",
    r"\b\w+\s+(?:ST(?:REET)?|AVE(?:NUE)?|BLVD|RD|ROAD|DR(?:IVE)?|LN|LANE|WAY|PKWY|PARKWAY|PIKE|HWY)\b",
    r"\bEXIT\s*\d", r"\bINTERCHANGE\b", r"\bINTCH\b", r"\bINTRCH\b", r"(?:\s|^)I\.C\.?(?:\s|$|[,;])",
    r"\s+IC\s*(?:$|[,;])", r"\bJCT\.?\s", r"\bJUNCTION\b", r"\bSTATE\s*LINE\b", r"\bS/?L\b", r"\bSTATE\s*L\b",
    r"\b[A-Z]+\s+COLI\b", r"\bCO\.\s*L(?:INE)?\.?\b", r"\bCO\s+LINE\b", r"\bCOUNTY\s*L(?:INE)?\b",
    r"[A-Z]+\s+CO\.?\s*L\b", r"\b(?:R\.R\.|RR|RAILROAD|RAIL\s*ROAD)\b", r"\b(?:RIVER|CREEK|CR\.)\b",
    r"\b(?:OVERPASS|UNDERPASS)\b", r"\b[A-Z]+\s+(?:FREEWAY|FWY|EXPWY|EXPRESSWAY)\b", r"\b(?:TUNNEL|BRIDGE)\b",
    r"\bT\.?H\.?\s*\d", r"\bLA\s+\d", r"\bKY\s+\d", r"\bIA\.?\s+\d", r"\bILL[\s-]*\d", r"\bSC\s+\d", r"\bNC\s+\d",
    r"\bGA\s+\d", r"\bCH[\s-]*\d", r"\bWV\s+\d", r"\bNJ\s+\d", r"\bVA[\s-]*\d", r"\bC/?L\b",
]
VAGUE_SCORE = r"\b(?:STATEWIDE|VARIOUS|DISTRICTWIDE|DIST\.?\s*WIDE|REGIONWIDE|MULTIPLE)\b"
ROUTE_PREFIXES = [
    r"^(?:(?:RT\.?\s+)?(?:INTERSTATE|IH|I|IR|FAI|IS)[\s-]*\d{1,3}[A-Za-z]?"
    r"(?:\s*[/&,]\s*(?:I|IH|IR|FAI)?[\s-]*\d{1,3}[A-Za-z]?)*)\s*[,;:]?\s*",
    r"^SR\s*\d+[A-Z]?\s*\(I-?\d+\)\s*[,;:]?\s*",
    r"^[A-Z]{2,3}\s+IR\s+\d{1,4}\s*",
    r"^US-I-\d{1,3}\s*[,;:]?\s*",
]
MILEPOST_PAIRS = [
    r"(?:MP|MM|MILEPOST|MILE\s*MARKER|MILEPOINT)\s*(\d+\.?\d*)\s*(?:TO|-|&|AND)\s*"
    r"(?:MP|MM|MILEPOST|MILE\s*MARKER|MILEPOINT)?\s*(\d+\.?\d*)",
    r"FR(?:OM|\.?)?\s*(?:MP|MM|MILEPOST)\s*(\d+\.?\d*)\s*TO\s*(?:MP|MM|MILEPOST)?\s*(\d+\.?\d*)",
    r"BETWEEN\s*(?:MP|MM)\s*(\d+\.?\d*)\s*[&]\s*(\d+\.?\d*)",
    r"(?:LM|LOGMILE)\s*(\d+\.?\d*)\s*(?:TO|-|&|AND)\s*(?:LM|LOGMILE)?\s*(\d+\.?\d*)",
]
MILEPOST_SINGLE = r"(?:MP|MM|MILEPOST|MILE\s*MARKER|LM)\s*(\d+\.?\d*)"
CODED_MILEPOST = r"^([A-Z]{2,3})\s+IR\s+\d{1,4}\s+(\d+\.?\d*)(?:\s*[/\s]\s*(\d+\.?\d*))?"
AFTER_ON = r"\bON\s+(?:I[\s-]*\d{1,3}|IH\s*\d{1,3})\s*[,;]?\s*(.*)"
ON_FROM_TO = r"(?:FR(?:OM|\.)?|FM)\s+(.+?)\s+TO\s+(.+?)(?:\s*[,;]|$)"
BETWEEN_AND_LOOSE = r"BETWEEN\s+(.+?)\s+AND\s+(.+?)(?:\s*[,;]|$)"
ON_PLACE = r"(?:IN|AT|NEAR|@|OVER|UNDER)\s+(.+?)(?:\s*[,;.]|$)"
OVER_ON = r"\bOVER\s+(.+?)\s+ON\s+(?:I[\s-]*\d|IH\s*\d)"
AT_ON = r"(?:\bAT\b|@)\s+(.+?)\s+ON\s+(?:I[\s-]*\d|IH\s*\d)"
FROM_TO = [r"(?:FR(?:OM|\.)?|FM)\s+(.+?)\s+TO\s+(.+?)(?:\s*[,;]\s*(?:[A-Z&]{2})|$)",
           r"(?:FR(?:OM|\.)?|FM)\s+(.+?)\s+TO\s+(.+)"]
FROM_WORK = rf"(?:FR(?:OM|\.)?|FM)\s+(.{{3,}}?)(?:\s*[,;]\s*{WORK_WORDS})"
FROM_END = r"(?:FR(?:OM|\.)?|FM)\s+(.{3,})"
BETWEEN_AND = [r"\bBETWEEN\s+(.+?)\s+AND\s+(.+?)(?:\s*[,;]|$)", r"\bBETWEEN\s+(.+?)\s*&\s*(.+?)(?:\s*[,;]|$)"]
A_TO_B = r"^(.+?)\s+TO\s+(.+?)(?:\s*[,;]\s*|\s*$)"
A_DASH_B = r"^(.+?)\s*[-]\s*(.+?)(?:\s*[,;]\s*|\s*$)"
PLACED_AT = [r"(?:\bAT\b|@)\s+(.+?)(?:\s*[,;(]\s*|\s*$)", r"\bUNDER\s+(.+?)(?:\s*[,;]\s*|\s*$)",
             r"\bNEAR\s+(.+?)(?:\s*[,;]\s*|\s*$)", r"\bOVER\s+(.+?)(?:\s*[,;]\s*|\s*$)",
             r"\bIN\s+([A-Z][A-Z\s\.']+?)(?:\s*[,;]\s*|\s*$)"]
PLACED_AT_FULL = [PLACED_AT[0], PLACED_AT[1], PLACED_AT[3]]
OFFSET_TEXT = [r"(\d+\.?\d*\s*MI\.?\s*[NSEW]\.?\s*(?:OF\s+)?(?:.+?))(?:\s*[,;]\s*|\s*$)",
               r"(\d+\.?\d*\s*M\s+[NSEW]\s+(?:OF\s+)?(?:.+?))(?:\s*[,;]\s*|\s*$)"]
LEADING_NAME = r"^([A-Z][A-Z\s\.'&/]+?)(?:\s*[,;:]\s*)"
ROAD_TEXT = r"(\b(?:US|SR|SH|CR|FM|RT|RTE)\s*[\s-]?\d{1,4})\b"
STREET_TEXT = r"(\b[A-Z]+\s+(?:ST|AVE|BLVD|RD|ROAD|DR|LN|HWY|PKWY)\b)"
EXIT_TEXT = r"(EXIT\s*\d+)"
JUNCTION_TEXT = r"(JCT\.?\s+\S+(?:\s+\S+)?)"
INTERCHANGE_TEXT = r"(\b\w+\s+INTERCHANGE\b)"
IN_CITY = r"\bIN\s+([A-Z][A-Z]+(?:\s+[A-Z]+)?)\b"
# ---------------------------------------------------------------------------------------------


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _by_letters(words: list[str]) -> str:
    """One alternative per leading letter, and so on letter by letter: the same words as joining them by ``|``.

    The alternatives are no longer tried in their order, so it suits patterns of which only start and end of the match count.
    """
    groups: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        plain = w[:1].isalpha() and w[1:2] not in ("?", "*", "+", "{")
        groups.setdefault(w[0] if plain else "", []).append(w[1:] if plain else w)
    return "(?:" + "|".join("|".join(rest) if not letter else letter + (rest[0] if len(rest) == 1 else _by_letters(rest))
                            for letter, rest in groups.items()) + ")"


#: Work words at the end of a text, as WORK_WORDS has them. A search tries them at each letter of the text.
WORK_END = rf"(?i)\s*[,;]?\s*{_by_letters(WORK_WORDS[3:-1].split('|'))}\s*$"


def _grab(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def starts_with_work(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)).rlike(WORK_START), F.lit(False))


def looks_like_place(text: Column) -> Column:
    t = F.trim(text)
    named = t.rlike(PLAIN_NAME) & (F.length(t) < 40)
    return F.coalesce(F.upper(text).rlike(_any(PLACE_PATTERNS)) | named, F.lit(False))


def clean_endpoint(text: Column) -> Column:
    """Endpoint without trailing work words and punctuation; a bare direction becomes NULL."""
    out = text
    for _ in range(3):
        out = F.regexp_replace(out, WORK_END, "")
        out = F.regexp_replace(F.trim(out), r"[.,;:\- ]+$", "")
    # inside a lambda nullif would work out all of the above twice
    return F.try_element_at(F.filter(F.array(F.regexp_replace(out, r"^[NSEW]\.?$", "")), lambda x: x != ""), F.lit(1))


def strip_route(text: Column) -> Column:
    """Text without its leading route designation; the text itself when nothing is left."""
    out = text
    for p in ROUTE_PREFIXES:
        out = F.trim(F.regexp_replace(out, p, ""))
    out = F.regexp_replace(out, r"^[-,;: ]+", "")
    return F.coalesce(F.nullif(out, F.lit("")), text)


def project_type(title: Column) -> Column:
    """Work description after the last semicolon, else after the last comma."""
    semi = F.trim(F.element_at(F.split(title, ";"), -1))
    comma = F.trim(F.element_at(F.split(title, ","), -1))
    by_semi = F.when(title.contains(";") & (F.length(semi) < 80) & semi.rlike(TYPE_AFTER_SEMICOLON), semi)
    by_comma = F.when(title.contains(",") & (F.length(comma) < 80) & comma.rlike(TYPE_AFTER_COMMA), comma)
    return F.coalesce(by_semi, by_comma, F.lit(""))


def precision_score(text: Column) -> Column:
    """0 nothing, 1 vague, 2 named place, 3/4 offset from a vague/precise anchor, 5 crossing, 6 mile-post."""
    u = F.upper(F.trim(text))
    miles, short = F.regexp_extract(u, OFFSET_MILES, 3), F.regexp_extract(u, OFFSET_SHORT, 3)
    return F.coalesce(
        F.when(u.isNull() | (F.length(u) < 2), 0).when(u.rlike(MILEPOST_SCORE), 6)
        .when(u.rlike(OFFSET_MILES), F.when(miles.rlike(_any(PRECISE_ANCHOR)), 4).otherwise(3))
        .when(u.rlike(OFFSET_SHORT), F.when(short.rlike(_any(PRECISE_ANCHOR_SHORT)), 4).otherwise(3))
        .when(u.rlike(_any(CROSSING_SCORE)), 5).when(u.rlike(VAGUE_SCORE), 1).otherwise(2), F.lit(0))


# How a match is accepted once it is cleaned: (source text, pattern, clean the first end, least
# length of the first end, check). Tried from top to bottom.
RULES = [
    ("on", ON_FROM_TO, True, 0, "always"),
    ("on", BETWEEN_AND_LOOSE, True, 0, "always"),
    ("on", ON_PLACE, True, 3, "any"),
    ("on", r"^(.*)$", True, 3, "not work"),
    ("work", OVER_ON, True, 3, "any"),
    ("work", AT_ON, True, 3, "any"),
    ("full", FROM_TO[0], True, 2, "any"),
    ("full", FROM_TO[1], True, 2, "any"),
    ("full", FROM_WORK, True, 2, "any"),
    ("full", FROM_END, True, 3, "any"),
    ("full", BETWEEN_AND[0], True, 2, "any"),
    ("full", BETWEEN_AND[1], True, 2, "any"),
    ("place", A_TO_B, True, 3, "place or not work"),
    ("place", A_DASH_B, False, 3, "two places"),
    *[("place", p, True, 3, "not work") for p in PLACED_AT],
    *[("full", p, True, 3, "not work") for p in PLACED_AT_FULL],
    *[("full", p, True, 6, "any") for p in OFFSET_TEXT],
    ("place", LEADING_NAME, False, 3, "short place"),
    *[("place", p, False, 1, "any") for p in (ROAD_TEXT, STREET_TEXT, EXIT_TEXT)],
    ("place", JUNCTION_TEXT, True, 1, "any"),
    ("place", INTERCHANGE_TEXT, False, 1, "any"),
    ("place", IN_CITY, False, 1, "not work"),
]
#: Letters that every match of a pattern holds: texts without them are not searched.
NEEDED = {ON_FROM_TO: "TO", BETWEEN_AND_LOOSE: "BETWEEN", OVER_ON: "OVER", AT_ON: "ON", FROM_TO[0]: "TO", FROM_TO[1]: "TO", FROM_WORK: "F", FROM_END: "F",
          BETWEEN_AND[0]: "BETWEEN", BETWEEN_AND[1]: "BETWEEN", A_TO_B: "TO", A_DASH_B: "-", PLACED_AT[1]: "UNDER", PLACED_AT[2]: "NEAR",
          PLACED_AT[3]: "OVER", PLACED_AT[4]: "IN", OFFSET_TEXT[0]: "MI", OFFSET_TEXT[1]: "M", EXIT_TEXT: "EXIT", JUNCTION_TEXT: "JCT",
          INTERCHANGE_TEXT: "INTERCHANGE", IN_CITY: "IN"}
_TWO_ENDED = {ON_FROM_TO, BETWEEN_AND_LOOSE, *FROM_TO, *BETWEEN_AND, A_TO_B, A_DASH_B}


#: Rules that are tried at once; later groups are only looked at for titles that the earlier ones leave open.
GROUPS = [RULES[:6], RULES[6:10], RULES[10:14], RULES[14:19], RULES[19:24], RULES[24:]]


def _candidates(texts: dict[str, Column], rules: list[tuple]) -> Column:
    """Array of what every rule finds, in order: raw ends, '' for none, and how to accept them."""
    found = []
    for source, pattern, clean, least, check in rules:
        text = texts[source]
        if pattern in NEEDED:
            text = F.when(text.contains(NEEDED[pattern]), text)
        second = F.regexp_extract(text, pattern, 2) if pattern in _TWO_ENDED else F.lit(None).cast("string")
        found.append(F.struct(F.regexp_extract(text, pattern, 1).alias("a"), second.alias("b"), F.lit(clean).alias("clean"),
                              F.lit(least).alias("least"), F.lit(check).alias("check")))
    return F.array(*found)


def _cleaned(c: Column) -> Column:
    first = F.when(c["clean"], clean_endpoint(c["a"])).otherwise(F.trim(c["a"]))
    return F.struct(first.alias("a"), clean_endpoint(c["b"]).alias("b"), c["least"].alias("least"), c["check"].alias("check"))


def _accepted(c: Column) -> Column:
    long_enough = F.coalesce(F.length(c["a"]) >= c["least"], F.lit(False))
    work, place, check = starts_with_work(c["a"]), looks_like_place(c["a"]), c["check"]
    return (F.when(check == "always", True).when(~long_enough, False).when(check == "any", True)
            .when(check == "not work", ~work).when(check == "place or not work", place | ~work)
            .when(check == "short place", place & ~work & (F.length(c["a"]) < 70))
            .otherwise(place & ~work & F.coalesce(F.length(c["b"]) > 2, F.lit(False)) & looks_like_place(c["b"])
                       & ~starts_with_work(c["b"])))


FIELDS = ["endpoint_a", "endpoint_b", "precision_a", "precision_b", "milepost_start", "milepost_end",
          "project_type"]


def parse_titles(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Add endpoints, precisions, mile-posts and project type parsed from a text column."""
    out = df.withColumn("__t", F.upper(F.trim(F.col(column))))
    norm = F.regexp_replace("__t", r"([NSEW])\.TO\s", "$1 TO ")
    out = out.withColumn("__n", F.regexp_replace(norm, r"([NSEW]),?\s*TO\s", "$1 TO "))
    out = out.withColumn("__loc", strip_route(F.col("__n")))
    t = F.col("__t")
    mile_pair = F.coalesce(*[F.when(t.rlike(p), F.struct(
        F.regexp_extract(t, p, 1).alias("a"), F.regexp_extract(t, p, 2).alias("b"))) for p in MILEPOST_PAIRS])
    mile_one = F.when(t.rlike(MILEPOST_SINGLE), F.struct(
        F.regexp_extract(t, MILEPOST_SINGLE, 1).alias("a"), F.lit(None).cast("string").alias("b")))
    coded = F.when(t.rlike(CODED_MILEPOST), F.struct(
        _grab(t, CODED_MILEPOST, 2).alias("a"), _grab(t, CODED_MILEPOST, 3).alias("b"),
        _grab(t, CODED_MILEPOST, 1).alias("area")))
    out = out.withColumns({"__mile": F.coalesce(mile_pair, mile_one), "__coded": coded})
    out = out.withColumn("__work", F.when(starts_with_work(t), F.col("__n")))
    out = out.withColumn("__on", _grab(F.col("__work"), AFTER_ON))
    texts = {"on": F.col("__on"), "work": F.col("__work"), "full": F.col("__n"), "place": F.col("__loc")}
    none = F.array().cast("array<struct<a: string, b: string, least: int, check: string>>")

    def first_of(rules: list[tuple]) -> Column:
        """The first accepted find of some rules; the cleaning and the test stand here once and stop at it."""
        found = F.filter(_candidates(texts, rules), lambda c: c["a"] != "")
        return F.try_element_at(F.aggregate(found, none, lambda acc, c: F.when(F.size(acc) > 0, acc).otherwise(
            F.filter(F.transform(F.array(c), _cleaned), _accepted))), F.lit(1))

    open_ends = F.col("__mile").isNull() & F.col("__coded").isNull()
    out = out.withColumn("__e", F.when(open_ends, F.coalesce(*map(first_of, GROUPS))))
    mile, code = F.col("__mile"), F.col("__coded")
    coded_b = code["b"].try_cast("double").cast("string")
    a = (F.when(mile.isNotNull(), F.concat(F.lit("MP "), mile["a"]))
         .when(code.isNotNull(), F.concat(code["area"], F.lit(" MP "), code["a"])).otherwise(F.col("__e.a")))
    b = (F.when(mile.isNotNull(), F.concat(F.lit("MP "), mile["b"]))
         .when(code.isNotNull(), F.concat(code["area"], F.lit(" MP "), coded_b)).otherwise(F.col("__e.b")))
    posted = mile.isNotNull() | code.isNotNull()
    out = out.withColumns({f"{prefix}endpoint_a": F.coalesce(a, F.lit("")),
                           f"{prefix}endpoint_b": F.coalesce(b, F.lit(""))})
    ea, eb = F.col(f"{prefix}endpoint_a"), F.col(f"{prefix}endpoint_b")
    out = out.withColumn("__p", F.transform(F.array(ea, eb), precision_score))
    out = out.withColumns({
        f"{prefix}precision_a": F.when(posted, 6).otherwise(F.col("__p")[0]),
        f"{prefix}precision_b": F.when(posted, F.when(eb != "", 6).otherwise(0)).otherwise(F.col("__p")[1]),
        f"{prefix}milepost_start": F.coalesce(mile["a"], code["a"]).try_cast("double"),
        f"{prefix}milepost_end": F.when(mile.isNotNull(), mile["b"]).otherwise(code["b"]).try_cast("double"),
        f"{prefix}project_type": F.coalesce(project_type(F.trim(F.col(column))), F.lit(""))})
    return out.drop("__t", "__n", "__loc", "__work", "__on", "__mile", "__coded", "__e", "__p")


def parse_with_fallback(df: DataFrame, description: str, title: str) -> DataFrame:
    """Parse the description; fill the endpoints it lacks from the title; record the source."""
    both = parse_titles(parse_titles(df, description, "d_"), title, "t_")
    no_a = F.col("d_precision_a") == 0
    no_b = F.col("d_precision_b") == 0
    out = {}
    for f in ("endpoint_a", "precision_a", "milepost_start"):
        out[f] = F.when(no_a, F.col(f"t_{f}")).otherwise(F.col(f"d_{f}"))
    for f in ("endpoint_b", "precision_b", "milepost_end"):
        out[f] = F.when(no_a | no_b, F.col(f"t_{f}")).otherwise(F.col(f"d_{f}"))
    out["project_type"] = F.when((no_a | no_b) & (F.col("d_project_type") == ""), F.col("t_project_type")
                                 ).otherwise(F.col("d_project_type"))
    parsed = both.withColumns(out)
    source = (F.when(F.col("precision_a") == 0, "none").when(no_a, "title")
              .when(no_b & (F.col("precision_b") > 0), "title (b only)").otherwise("description"))
    parsed = parsed.withColumn("location_source", source)
    return parsed.drop(*[f"{p}_{f}" for p in "dt" for f in FIELDS])
