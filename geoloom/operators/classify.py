"""Classification of tagged elements: ordered rules, ranks, codes and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag values that the rules know.
PAVED = ["asphalt", "paved", "concrete", "paving_stones", "sett", "cobblestone", "concrete:plates", "concrete:lanes", "chipseal"]
ROADS = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road",
]
WAYS = ["path", "footway", "steps", "bridleway", "cycleway", "track", "pedestrian"]
BASE_RANK = {3: ROADS[:8], 2: ["tertiary", "tertiary_link"], 1: ["unclassified", "residential", "living_street", "road"], 0: ["service"]}
PAVED_BUMP = ["residential", "unclassified", "living_street", "tertiary", "tertiary_link", "secondary", "secondary_link", "service", "road"]
LOCAL_BUMP = ["residential", "unclassified", "living_street", "road"]
MAJOR_PATH_SURFACES = ["compacted", "fine_gravel", "gravel", "pebblestone"]
LANE_CYCLEWAYS = ["sidewalk", "crossing", "lane", "share_busway", "track"]
WALKS = ["sidewalk", "footway", "path", "pedestrian", "cycleway", "cycleway_paved"]
ROAD_502_1_M, ROAD_502_M, WALK_505_M = 9.0, 5.0, 2.5


def tag(key: str, tags: str = "tags") -> Column:
    """A tag's value in lower case, '' where there is none."""
    return F.lower(F.coalesce(F.element_at(tags, key), F.lit("")))


def is_paved(surface: Column) -> Column:
    """Any part of a ;-list is a paved surface."""
    return F.exists(F.split(surface, ";"), lambda s: F.trim(s).isin(*PAVED))


def lanes_total(tags: str = "tags") -> Column:
    """Lanes, or forward and backward ones added up; null where none is a positive number."""
    number = lambda c: F.floor(F.try_to_number(F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"^\s*(\d+(?:\.\d+)?)\s*$", 1), F.lit("999999999.999"))).cast("int")
    both = [F.element_at(tags, k) for k in ("lanes:forward", "lanes:backward")]
    summed = reduce(lambda a, b: a + b, (F.coalesce(number(F.coalesce(x, F.lit(""))), F.lit(0)) for x in both))
    whole = number(F.coalesce(F.element_at(tags, "lanes"), F.lit("")))
    return F.coalesce(F.when(whole > 0, whole), F.when(summed > 0, summed))


def road_rank(highway: Column, lanes: Column, paved: Column) -> Column:
    """0 to 3: the class's base, one more for two lanes, or for a paved surface, or for classes that usually have one."""
    base = F.lit(1)
    for rank, names in BASE_RANK.items():
        base = F.when(highway.isin(*names), F.lit(rank)).otherwise(base)
    bump = F.when(F.coalesce(lanes, F.lit(0)) >= 2, 1).when(paved & highway.isin(*PAVED_BUMP), 1).when(highway.isin(*LOCAL_BUMP), 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(3), base + bump))


def refined_highway(tags: str = "tags") -> Column:
    """road_1..road_4, track_fast, track, track_slow, path_major, sidewalk, cycleway_paved, or the class itself."""
    hw, surface, lanes = tag("highway", tags), tag("surface", tags), lanes_total(tags)
    paved = is_paved(surface)
    track = F.when(paved & (F.coalesce(lanes, F.lit(0)) >= 2), "road_3").when(paved, "road_2").when(tag("tracktype", tags) == "grade1", "track_fast").when(tag("tracktype", tags).isin("grade4", "grade5"), "track_slow").otherwise("track")
    walk = (tag("footway", tags) == "sidewalk") | ((hw == "footway") & paved) | (hw == "pedestrian")
    return (
        F.when(hw.isin(*ROADS), F.concat(F.lit("road_"), (road_rank(hw, lanes, paved) + 1).cast("string")))
        .when(hw == "track", track)
        .when((hw == "path") & ~paved & (surface.isin(*MAJOR_PATH_SURFACES) | (tag("trail_visibility", tags) == "excellent")), "path_major")
        .when(walk, "sidewalk")
        .when((hw == "cycleway") & paved, "cycleway_paved")
        .otherwise(F.when(hw == "", "path").otherwise(hw))
    )


def skip_reason(tags: str = "tags", allow_sidewalk: bool = False) -> Column:
    """Why a way isn't drawn, null if it is."""
    hw = tag("highway", tags)
    out = F.when(tag("railway", tags).isin("subway", "subway_entrance"), "underground")
    if not allow_sidewalk:
        out = out.when(tag("footway", tags) == "sidewalk", "sidewalk")
    return (
        out.when(tag("cycleway", tags).isin(*LANE_CYCLEWAYS) & ~hw.isin(*ROADS), "cycle lane")
        .when(tag("area", tags) == "yes", "area")
        .when(tag("indoor", tags) == "yes", "indoor")
        .when(~hw.isin(*WAYS), "highway")
        .when((hw == "cycleway") & tag("foot", tags).isin("no", "private"), "cycleway without walkers")
    )


def width_code(highway: Column, width: Column, code: Column) -> Column:
    """The symbol by measured width; the tags' symbol where no rule holds."""
    road = highway.startswith("road_")
    return (
        F.when(width.isNull(), code)
        .when(road & (width >= ROAD_502_1_M), "502.1")
        .when(road & (width >= ROAD_502_M) & code.isin("503", "504"), "502")
        .when(highway.isin(*WALKS) & (code == "506") & (width >= WALK_505_M), "505")
        .otherwise(code)
    )


def max_voltage(raw: Column) -> Column:
    """The highest voltage of a list like '110000;22 kV', in volts."""
    parts = F.transform(F.split(F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit(","), F.lit(";")), ";"), lambda p: F.replace(F.trim(p), F.lit(" "), F.lit("")))
    number = lambda p: F.floor(F.regexp_extract(p, r"^(\d+(?:\.\d+)?)k?v?$", 1).try_cast("double") * F.when(p.endswith("kv"), 1000).otherwise(1)).cast("long")
    return F.array_max(F.filter(F.transform(parts, number), lambda v: v > 0))


def probe_kind(code: Column, error: Column, planned: Column) -> Column:
    """planned, persistent (ours to mend) or transient."""
    return (
        F.when(planned, "planned")
        .when((code >= 400) & (code < 500) & ~code.isin(408, 425, 429), "persistent")
        .when(code.isNull() & error.rlike("(?i)certificate|name or service|no such host"), "persistent")
        .otherwise("transient")
    )


def first_match(features: DataFrame, rules: list[tuple[int, str, str]], ident: str, tags: str = "tags") -> DataFrame:
    """Code of the first rule (rule_no, condition, code) that holds, as one expression; null where none does."""
    return by_rules(features, [(text, code) for _, text, code in sorted(rules)], tags).select(ident, "code")


def explain_lines(lines: DataFrame, rules: list[tuple[str, str, str, int]], text: str = "line") -> DataFrame:
    """Category, advice and severity of log lines by ordered patterns, as one expression: no join with the rules."""
    def pick(i):
        out = None
        for r in rules:
            c = F.col(text).rlike(r[0])
            out = F.when(c, F.lit(r[i])) if out is None else out.when(c, F.lit(r[i]))
        return out

    return lines.select("*", pick(1).alias("category"), pick(2).alias("advice"), pick(3).alias("severity"))


def extent(raw: Column) -> Column:
    """west, south, east, north from text, null where it isn't a valid extent."""
    v = F.transform(F.split(raw, ","), lambda p: F.trim(p).try_cast("double"))
    g = lambda i: F.try_element_at(v, F.lit(i))
    good = (F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & (g(1) < g(3)) & (g(2) < g(4)) & (g(1) >= -180) & (g(3) <= 180) & (g(2) >= -90) & (g(4) <= 90)
    return F.when(good, F.struct(g(1).alias("west"), g(2).alias("south"), g(3).alias("east"), g(4).alias("north")))


def condition(text: str, tags: str = "tags") -> Column:
    """A condition on tags: key=value, key!=value, key!= (any value) or key= (none), joined by &."""
    out = F.lit(True)
    for part in text.split("&"):
        key, sign, value = part.partition("!=") if "!=" in part else part.partition("=")
        have = F.coalesce(F.col(tags)[key.strip()], F.lit(""))
        out = out & ((have != value.strip()) if sign == "!=" else (have == value.strip()))
    return out


def by_rules(elements: DataFrame, rules: list[tuple[str, str]], tags: str = "tags") -> DataFrame:
    """``elements`` with the code of the first rule (condition, code) that holds: one expression, no join."""
    code = F.lit(None).cast("string")
    for text, value in reversed(rules):
        code = F.when(condition(text, tags), F.lit(value)).otherwise(code)
    return elements.withColumn("code", code)
