"""From a request to a search plan: parsing, location resolution, expansion, zones and grids."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basics import B0, B1, let, lookup
from ..functions.text import SYNONYMS
from .values import ABROAD, CATEGORIES, CHEAP, CITIES, CITY_NAMES, DEFAULT_FIELDS, EXPANSIONS, FIELDS, FIRST_FIELDS, NOISE, PREPOSITIONS, PRICE, RATING, RATING_ABOVE, UNSUPPORTED

#: A compact registry: alias -> city, and city -> (district, province).  Larger ones come as a table parameter.
CITY_ALIASES = {
    "lahore": "Lahore", "lhr": "Lahore", "karachi": "Karachi", "khi": "Karachi", "islamabad": "Islamabad", "isb": "Islamabad", "rawalpindi": "Rawalpindi", "pindi": "Rawalpindi", "faisalabad": "Faisalabad",
    "lyallpur": "Faisalabad", "multan": "Multan", "peshawar": "Peshawar", "quetta": "Quetta", "sialkot": "Sialkot", "gujranwala": "Gujranwala", "hyderabad": "Hyderabad", "sahiwal": "Sahiwal", "okara": "Okara",
}
REGISTRY = {
    "Lahore": ("Lahore", "Punjab"), "Karachi": ("Karachi", "Sindh"), "Islamabad": ("Islamabad", "Islamabad Capital Territory"), "Rawalpindi": ("Rawalpindi", "Punjab"), "Faisalabad": ("Faisalabad", "Punjab"),
    "Multan": ("Multan", "Punjab"), "Peshawar": ("Peshawar", "Khyber Pakhtunkhwa"), "Quetta": ("Quetta", "Balochistan"), "Sialkot": ("Sialkot", "Punjab"), "Gujranwala": ("Gujranwala", "Punjab"),
    "Hyderabad": ("Hyderabad", "Sindh"), "Sahiwal": ("Sahiwal", "Punjab"), "Okara": ("Okara", "Punjab"),
}
ZONES = {
    "lahore": ["Gulberg", "DHA Phase 5", "Johar Town", "Model Town", "Bahria Town", "Garden Town", "Wapda Town", "Cantt", "Township", "Iqbal Town", "Samanabad", "Faisal Town", "Anarkali", "Mall Road"],
    "karachi": ["Clifton", "DHA Phase 8", "Gulshan-e-Iqbal", "Saddar", "North Nazimabad", "Korangi", "Landhi", "Malir", "Bahadurabad", "Tariq Road"],
    "islamabad": ["F-6", "F-7", "F-8", "F-10", "G-9", "G-11", "I-8", "Blue Area", "Bahria Town"],
}
LEVELS = ["landmark", "chowk", "road", "street", "block", "phase", "sector", "housing_society", "village", "mouza", "basti", "union_council", "town", "area", "tehsil", "city", "district", "division", "province"]


@dataclass(frozen=True)
class SearchPlan:
    category: str
    location: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    fields: tuple[str, ...] = ()
    requested_result_count: int | None = None
    output: str | None = None


def _runs() -> list[str]:
    """Patterns that take the words of categories, fillers and numbers out of a place, to be applied in this order.

    Phrases go one by one, as a word that was taken out earlier no longer makes
    a phrase; neighbouring single words don't touch one another and go together.
    """
    words = [w for names in CATEGORIES.values() for w in names if w.isascii()]
    out: list[list[str]] = []
    for w in [*words, *NOISE]:
        if out and " " not in w and " " not in out[-1][-1]:
            out[-1].append(w)
        else:
            out.append([w])
    return [*[f"{B0}(?:{'|'.join(re.escape(w) if ' ' not in w else w for w in run)}){B1}" for run in out], f"{B0}[0-9]+{B1}"]


RUNS = _runs()


def _place(found: str) -> str:
    for pattern in RUNS:
        found = re.sub(pattern, "", found)
    return re.sub(r"[,\s]+", " ", found).strip()


def extract_location(q: str) -> str | None:
    """Words after the first preposition that leaves some, else before one at the end, else behind the last comma; without the words of categories, fillers and numbers."""
    after = [q.split(f" {p} ", 1)[1] for p in PREPOSITIONS if f" {p} " in q]
    before = [q[: -len(p) - 1] for p in PREPOSITIONS if q.endswith(f" {p}")]
    found = next((x for x in map(_place, after + before) if x), None)
    if not found and "," in q:
        found = _place(q.rsplit(",", 1)[1])
        found = found if len(found) > 1 else None
    return found


def _names(city: str) -> list[str]:
    return [city.lower(), *CITY_NAMES.get(city, [])]


def parse_query(request: str) -> dict:
    """Deterministic parse of one request: intent, category, city, location, filters, fields and keywords.

    A request without a place is to be clarified; one with a place but no
    category searches for any business.
    """
    q = request.lower().strip()
    out = {"intent": "unsupported", "category": None, "city": None, "country": None, "location": None, "fields": [], "max_price": None, "min_rating": None, "keywords": []}
    if any(p in q for p in UNSUPPORTED):
        return out | {"message": "Only searches for places are supported."}
    category = next((k for k, names in CATEGORIES.items() if any(n in q for n in names)), None)
    known = next((c for c in CITIES if any(n in q for n in _names(c))), None)
    city = known or extract_location(q)
    if not city:
        return out | {"intent": "clarify", "category": category, "message": f"Where should {category or 'what'} be searched?" if category else "What should be searched, and where?"}
    country = ABROAD.get(known or "", "Pakistan")
    price, rating = re.search(PRICE, q), re.search(RATING, q)
    above = re.search(RATING_ABOVE, q)
    found = [f for f, names in FIELDS.items() if any(n in q for n in names)]
    max_price = int(price.group(1)) if price else None
    words = [category] if category else []
    if not max_price and any(w in q for w in CHEAP):
        words.append("cheap")
    return out | {
        "intent": "search", "category": category or "business", "city": city, "country": country, "location": f"{city}, {country}", "fields": FIRST_FIELDS + (found or DEFAULT_FIELDS),
        "max_price": max_price, "min_rating": float(rating.group(1)) if rating else float(above.group(1)) if above else None, "keywords": words or ["directory"],
    }


def plan_from_query(request: str) -> SearchPlan:
    """The first whole number anywhere is the row limit; price and rating filters are not carried over."""
    p, q = parse_query(request), request.lower()
    n = re.search(rf"{B0}([0-9]+){B1}", request)
    output = "excel" if re.search(r"csv|xlsx|excel", q) else "pdf" if re.search(r"pdf|report", q) else None
    fields = tuple(dict.fromkeys([*p["fields"], "business_name", "address", "phone", "website"]))
    location = {"country": p["country"] or "Pakistan", "preposition": "in"} | ({"city": p["city"]} if p["city"] else {})
    return SearchPlan(p["category"] or "business", location, {}, fields, int(n.group(1)) if n else None, output)


def enrich_location(location: dict, registry: dict = REGISTRY, aliases: dict = CITY_ALIASES) -> dict:
    """Fills missing levels from the registry; a city alias overwrites the city."""
    out = dict(location)
    if out.get("city"):
        out["city"] = aliases.get(out["city"].lower(), out["city"])
    for level in LEVELS:
        entry = registry.get((out.get(level) or "").strip().title())
        if entry:
            out.setdefault("city", (out.get(level) or "").strip().title())
            for k, v in zip(("district", "province"), entry, strict=True):
                if not out.get(k):
                    out[k] = v
            break
    return out


def enrich_table(rows: DataFrame, registry: DataFrame, name: str = "location") -> DataFrame:
    """The same lookup for a table of locations: case-insensitive left join with a dimension table (name, district, province)."""
    r = registry.select(F.lower(F.trim("name")).alias("_k"), F.col("district").alias("reg_district"), F.col("province").alias("reg_province")).dropDuplicates(["_k"])
    return rows.join(r, F.lower(F.trim(F.col(name))) == F.col("_k"), "left").drop("_k")


def location_type(location: dict) -> str:
    return next((x for x in LEVELS if location.get(x)), "country")


def geocode_query(location: dict) -> str:
    return ", ".join([*[location[x] for x in LEVELS if location.get(x)][:4], location.get("country") or "Pakistan"])


def location_string(location: dict) -> str:
    seen: dict[str, str] = {}
    for x in LEVELS:
        if location.get(x):
            seen.setdefault(location[x].lower(), location[x])
    names = list(seen.values())[:3]
    return ", ".join([*names, location.get("country") or "Pakistan"]) if names else location.get("display") or location.get("country") or "Pakistan"


def confidence(value: float, missing_query: bool = False, failed: bool = False) -> float:
    return max(0.0, value - 0.2 * missing_query - 0.3 * failed)


def confidence_column(value: Column, missing_query: Column, failed: Column) -> Column:
    """``confidence`` over columns: nulls in the flags count as false."""
    off = lambda c, by: F.when(F.coalesce(c, F.lit(False)), by).otherwise(0.0)
    return F.greatest(F.lit(0.0), value - off(missing_query, 0.2) - off(failed, 0.3))


#: Levels of a location, and what a geocoder calls them in its answer.
GEOCODED = {
    "province": ["administrative_area_level_1"], "district": ["administrative_area_level_2"], "tehsil": ["administrative_area_level_3"], "city": ["locality"],
    "locality": ["sublocality", "sublocality_level_1"],
}


def geocode_join(rows: DataFrame, answers: DataFrame, query: str = "geocode_query") -> DataFrame:
    """Locations with the answer to their geocode query, asked once whatever its case: fills what is missing.

    ``answers(query, latitude, longitude, components map<string,string>)``; a
    hit sets the coordinates, fills the levels that are empty, and raises
    ``confidence`` by 0.1 up to 1; a row without one loses 0.2 if it has no
    query and 0.3 if the query has no answer, down to 0.
    """
    key = F.lower(F.trim(F.col(query)))
    a = answers.groupBy(F.lower(F.trim("query")).alias("_k")).agg(F.min(F.struct("latitude", "longitude")).alias("_at"), F.min_by("components", F.struct("latitude", "longitude")).alias("_c"))
    t = rows.join(a, key == F.col("_k"), "left")
    hit, asked = F.col("_at").isNotNull(), F.coalesce(key != "", F.lit(False))
    for level, kinds in GEOCODED.items():
        if level in rows.columns:
            t = t.withColumn(level, F.coalesce(F.nullif(F.col(level), F.lit("")), *[F.nullif(F.try_element_at("_c", F.lit(k)), F.lit("")) for k in kinds]))
    up = F.least(F.lit(1.0), F.col("confidence") + 0.1)
    t = t.withColumn("confidence", F.when(hit, up).otherwise(confidence_column(F.col("confidence"), ~asked, asked)))
    return t.withColumns({"latitude": F.coalesce("_at.latitude", "latitude"), "longitude": F.coalesce("_at.longitude", "longitude")}).drop("_k", "_at", "_c")


def needs_grid(n_zones: Column, latitude: Column, longitude: Column) -> Column:
    """A grid is searched where no zones are known but coordinates are."""
    return (F.coalesce(n_zones, F.lit(0)) == 0) & latitude.isNotNull() & longitude.isNotNull()


def page_cap(results: DataFrame, pages: int, size: int = 20, order: str = "rec_no") -> DataFrame:
    """The rows of the first so many result pages."""
    return results.orderBy(order).limit(pages * size)


def expand_category(category: str) -> list[str]:
    """Other words for a category: those of the expansion table, else its synonyms, else plural or singular and shop forms."""
    c = category.lower().strip()
    if EXPANSIONS.get(c) or SYNONYMS.get(c):
        return [category, *(EXPANSIONS.get(c) or SYNONYMS[c])]
    out = [category, c[:-1] if c.endswith("s") else f"{c}s"]
    if not any(w in c for w in ("shop", "store", "center")):
        out += [f"{c} shop", f"{c} store"]
    return list(dict.fromkeys(out))


def expand_queries(plan: SearchPlan, most: int = 4) -> list[str]:
    loc, cat = plan.location, plan.category.strip()
    terms = SYNONYMS.get(cat.lower()) or [cat]
    if plan.filters.get("ownership"):
        terms = [f"{plan.filters['ownership']} {t}" for t in terms]
    city, district = loc.get("city"), loc.get("district")
    out = [f"{t} in {location_string(loc)}" for t in terms[:2]]
    society = loc.get("housing_society")
    if society and city and society.lower() != city.lower():
        out.append(f"{cat} in {society}, {city}, Pakistan")
    for keys, parents in ((("village", "mouza", "basti"), ("tehsil", "city", "district")), (("chowk", "road", "landmark"), ("city", "district"))):
        place, parent = (next((loc[k] for k in ks if loc.get(k)), None) for ks in (keys, parents))
        if place and parent:
            out.append(f"{cat} near {place}, {parent}, Pakistan")
    if city:
        out.append(f"{cat} in {city}, Pakistan")
    elif district:
        out.append(f"{cat} in {district}, {loc.get('province') or 'Pakistan'}, Pakistan")
    if loc.get("sector") and city:
        out.append(f"{cat} in {loc.get('block') or loc['sector']} {city}, Pakistan")
    first: dict[str, str] = {}
    for q in out:
        first.setdefault(q.lower(), q)
    return list(first.values())[:most]


# ------------------------------------------------------------------ tables
def zones(spark: SparkSession, table: dict = ZONES) -> DataFrame:
    return spark.createDataFrame([(c, i, z) for c, zs in table.items() for i, z in enumerate(zs, 1)], "city_key string, zone_ord int, zone string")


def zone_limit(target: Column) -> Column:
    return F.when(target <= 50, 6).when(target <= 100, 12).when(target <= 200, 20).otherwise(1_000_000)


def zone_plan(requests: DataFrame, zone_table: DataFrame) -> DataFrame:
    """Zones of each request (city, target) by the city's key (``zone_lookup``), as many as its target takes."""
    on = ["city_key", "map_no"] if "map_no" in zone_table.columns else ["city_key"]
    return zone_lookup(requests, zone_table).join(zone_table, on).where(F.col("zone_ord") <= zone_limit(F.col("target")))


def zone_queries(plan: DataFrame) -> DataFrame:
    """Four phrasings for each zone."""
    c, z, city = F.col("category"), F.col("zone"), F.col("city")
    plural = F.when(c.endswith("s"), c).otherwise(F.concat(c, F.lit("s")))
    forms = F.array(F.concat(c, F.lit(" in "), z, F.lit(", "), city, F.lit(", Pakistan")), F.concat(plural, F.lit(" near "), z, F.lit(" "), city), F.concat(F.lit("best "), c, F.lit(" "), z, F.lit(" "), city), F.concat(c, F.lit(" near "), z))
    return plan.select("*", F.posexplode(forms).alias("form", "query"))


def geo_grid(centres: DataFrame) -> DataFrame:
    """Grid cells around (id, latitude, longitude, target): 2x2 to 5x5 by target."""
    t = F.col("target")
    n = F.when(t <= 50, 2).when(t <= 150, 3).when(t <= 300, 4).otherwise(5)
    km = F.when(t <= 50, 5.0).when(t <= 150, 10.0).when(t <= 300, 15.0).otherwise(20.0) * 2 / n
    g = centres.where("latitude is not null and longitude is not null").withColumn("n", n).withColumn("km", km)
    g = g.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda base, k, per: F.floor((base + (F.col(k) - F.col("n") / 2.0 + 0.5) * F.col("km") / per) * 10000.0 + 0.5) / 10000.0
    per_lng = F.lit(111.0) * F.cos(F.col("latitude") * math.pi / 180)
    return g.select("id", at(F.col("latitude"), "r", F.lit(111.0)).alias("cell_lat"), at(F.col("longitude"), "c", per_lng).alias("cell_lng"), F.concat(F.lit("Grid "), F.char(F.col("r") + 65), (F.col("c") + 1).cast("string")).alias("label"), F.greatest(F.lit(1500.0), F.least(F.lit(5000.0), F.col("km") * 500)).alias("radius_m"))


def grid_queries(cells: DataFrame, category: str, city: Column) -> DataFrame:
    return cells.select("*", F.explode(F.array(F.concat(F.lit(f"{category} near "), F.col("cell_lat").cast("string"), F.lit(","), F.col("cell_lng").cast("string")), F.concat(F.lit(f"{category} "), F.col("label"), F.lit(" "), city))).alias("query"))


def query_dedup(queries: DataFrame, query: str = "query", order: str = "ord") -> DataFrame:
    """First of each query text, ignoring case and outer spaces."""
    k = F.lower(F.trim(F.col(query)))
    return queries.groupBy(k.alias("_k")).agg(F.min_by(F.struct(*queries.columns), order).alias("r")).select("r.*")


# ------------------------------------------------------------------ the same steps over tables of requests and locations
def _any_of(q: Column, names: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda n: q.contains(n))


def parse_columns(q: Column) -> dict[str, Column]:
    """The detectors over a column of requests."""
    q = F.lower(F.trim(q))
    first = lambda table: F.coalesce(*[F.when(_any_of(q, names), F.lit(k)) for k, names in table.items()])
    number = F.regexp_extract(q, rf"{B0}([0-9]{{1,9}}){B1}", 1)
    return {
        "unsupported": _any_of(q, UNSUPPORTED), "category": first(CATEGORIES), "known": first({c: _names(c) for c in CITIES}),
        "found": F.array_compact(F.array(*[F.when(_any_of(q, names), F.lit(k)) for k, names in FIELDS.items()])),
        "cheap": _any_of(q, CHEAP), "first_number": F.nullif(number, F.lit("")).cast("int"),
    }


def location_column(q: Column) -> Column:
    """``extract_location`` over a column of lower-cased requests."""
    def place(x):
        for pattern in RUNS:
            x = F.regexp_replace(x, pattern, "")
        return F.trim(F.regexp_replace(x, r"[,\s]+", " "))

    preps = F.array(*[F.lit(p) for p in PREPOSITIONS])
    pad = lambda p: F.concat(F.lit(" "), p, F.lit(" "))
    after = F.transform(F.filter(preps, lambda p: q.contains(pad(p))), lambda p: F.substr(q, F.instr(q, pad(p)) + F.length(p) + 2))
    before = F.transform(F.filter(preps, lambda p: q.endswith(F.concat(F.lit(" "), p))), lambda p: F.substr(q, F.lit(1), F.length(q) - F.length(p) - 1))
    comma = F.when(q.contains(","), F.array(F.substring_index(q, ",", -1))).otherwise(F.array().cast("array<string>"))
    n = F.size(after) + F.size(before)
    every = F.transform(F.concat(after, before, comma), place)
    return let(F.struct(every.alias("e"), n.alias("n")), lambda v: F.get(F.filter(v["e"], lambda x, i: F.length(x) > F.when(i >= v["n"], 1).otherwise(0)), F.lit(0)))


def parse_table(requests: DataFrame, text: str = "q") -> DataFrame:
    """``parse_query`` for every row: adds ``intent, category, city, country, location, fields, max_price, min_rating, keywords, first_number``."""
    q = F.lower(F.trim(F.col(text)))
    some = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))
    t = requests.withColumns(parse_columns(F.col(text)))
    t = t.withColumn("city", F.when(~F.col("unsupported"), F.coalesce("known", F.when(F.col("known").isNull(), location_column(q)))))
    intent = F.when(F.col("unsupported"), "unsupported").when(F.col("city").isNull(), "clarify").otherwise("search")
    t = t.withColumn("intent", intent)
    search = F.col("intent") == "search"
    t = t.withColumn("country", F.when(search, F.coalesce(lookup(ABROAD, F.col("known")), F.lit("Pakistan"))))
    t = t.withColumn("max_price", F.when(search, some(PRICE).try_cast("long")))
    words = F.array_compact(F.array(F.col("category"), F.when(F.col("cheap") & (F.coalesce("max_price", F.lit(0)) == 0), F.lit("cheap"))))
    none = F.array().cast("array<string>")
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    t = t.withColumns({
        "keywords": F.when(search, F.when(F.size(words) > 0, words).otherwise(lits(["directory"]))).otherwise(none),
        "fields": F.when(search, F.concat(lits(FIRST_FIELDS), F.when(F.size("found") > 0, F.col("found")).otherwise(lits(DEFAULT_FIELDS)))).otherwise(none),
        "min_rating": F.when(search, F.coalesce(some(RATING), some(RATING_ABOVE)).try_cast("double")),
        "category": F.when(search, F.coalesce("category", F.lit("business"))).when(~F.col("unsupported"), F.col("category")),
        "location": F.concat("city", F.lit(", "), "country"),
    })
    return t.drop("unsupported", "known", "found", "cheap")


def plan_table(requests: DataFrame, text: str = "q") -> DataFrame:
    """``plan_from_query`` for every row: adds ``category, city, country, preposition, fields, requested_result_count, output``."""
    t, q = parse_table(requests, text), F.lower(F.col(text))
    fields = F.array_distinct(F.concat("fields", F.split(F.lit("business_name,address,phone,website"), ",")))
    return t.select(
        *[F.col(c) for c in requests.columns], F.coalesce("category", F.lit("business")).alias("category"), "city", F.coalesce("country", F.lit("Pakistan")).alias("country"),
        F.lit("in").alias("preposition"), fields.alias("fields"), F.col("first_number").alias("requested_result_count"),
        F.when(q.rlike("csv|xlsx|excel"), "excel").when(q.rlike("pdf|report"), "pdf").alias("output"),
    )


def _levels(rows: DataFrame) -> dict[str, Column]:
    """The location levels that a table has, most specific first; empty ones as null."""
    return {x: F.nullif(F.col(x), F.lit("")) for x in LEVELS if x in rows.columns}


def enrich_columns(rows: DataFrame, registry: dict = REGISTRY, aliases: dict = CITY_ALIASES) -> DataFrame:
    """``enrich_location`` for every row of a table with columns named like the levels (``city``, ``district``, ``province`` among them)."""
    city = F.coalesce(lookup(aliases, F.lower("city")), F.nullif("city", F.lit("")))
    t = rows.withColumn("city", city)
    known = {k: k for k in registry}
    name = F.coalesce(*[lookup(known, F.initcap(F.trim(c))) for c in _levels(t).values()])
    t = t.withColumn("_name", name).withColumn("city", F.coalesce("city", "_name"))
    for i, level in enumerate(("district", "province")):
        t = t.withColumn(level, F.coalesce(F.nullif(F.col(level), F.lit("")), lookup({k: v[i] for k, v in registry.items()}, F.col("_name"))))
    return t.drop("_name")


def location_columns(rows: DataFrame) -> dict[str, Column]:
    """``location_type``, ``geocode_query`` and ``location_string`` of every row."""
    levels = _levels(rows)
    optional = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    country = F.coalesce(optional("country"), F.lit("Pakistan"))
    names = F.array_compact(F.array(*levels.values()))
    first = F.filter(names, lambda x, i: F.array_position(F.transform(names, F.lower), F.lower(x)) == i + 1)
    comma = lambda a: F.array_join(F.concat(a, F.array(country)), ", ")
    return {
        "location_type": F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in levels.items()], F.lit("country")), "geocode_query": comma(F.slice(names, 1, 4)),
        "location_string": F.when(F.size(names) > 0, comma(F.slice(first, 1, 3))).otherwise(F.coalesce(optional("display"), country)),
    }


def _terms(key: Column, of: dict = SYNONYMS) -> Column:
    table = F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return F.try_element_at(table, key)


def expand_category_column(category: Column) -> Column:
    """``expand_category`` over a column."""
    c = F.lower(F.trim(category))
    other = F.when(c.endswith("s"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(F.concat(c, F.lit("s")))
    shops = F.when(c.rlike("shop|store|center"), F.array().cast("array<string>")).otherwise(F.array(F.concat(c, F.lit(" shop")), F.concat(c, F.lit(" store"))))
    return F.coalesce(F.concat(F.array(category), _terms(c, EXPANSIONS)), F.concat(F.array(category), _terms(c)), F.array_distinct(F.concat(F.array(category, other), shops)))


def expand_queries_column(rows: DataFrame, most: int = 4) -> Column:
    """``expand_queries`` for every row of a table with ``category``, optionally ``ownership``, and location levels."""
    lv = _levels(rows)
    none = F.lit(None).cast("string")
    get = lambda *ks: F.coalesce(none, *[lv[k] for k in ks if k in lv])
    cat, place = F.trim("category"), location_columns(rows)["location_string"]
    terms = F.coalesce(_terms(F.lower(cat)), F.array(cat))
    if "ownership" in rows.columns:
        own = F.nullif("ownership", F.lit(""))
        terms = F.transform(terms, lambda t: F.concat_ws(" ", own, t))
    city, district = get("city"), get("district")
    society, village, micro = get("housing_society"), get("village", "mouza", "basti"), get("chowk", "road", "landmark")
    end = F.lit(", Pakistan")
    more = [
        F.when(F.lower(society) != F.lower(city), F.concat(cat, F.lit(" in "), society, F.lit(", "), city, end)), F.concat(cat, F.lit(" near "), village, F.lit(", "), get("tehsil", "city", "district"), end),
        F.concat(cat, F.lit(" near "), micro, F.lit(", "), get("city", "district"), end),
        F.coalesce(F.concat(cat, F.lit(" in "), city, end), F.concat(cat, F.lit(" in "), district, F.lit(", "), F.coalesce(get("province"), F.lit("Pakistan")), end)),
        F.when(get("sector").isNotNull(), F.concat(cat, F.lit(" in "), get("block", "sector"), F.lit(" "), city, end)),
    ]
    every = F.concat(F.transform(F.slice(terms, 1, 2), lambda t: F.concat(t, F.lit(" in "), place)), F.array_compact(F.array(*more)))
    return F.slice(F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1), 1, most)


def zone_lookup(requests: DataFrame, zone_table: DataFrame, city: str = "city") -> DataFrame:
    """Adds ``city_key`` (and ``map_no``, if the zone table has it): the key of the zones that a request's city has, null for none.

    The maps are tried in order, in each the city's name with spaces and then
    with underscores.  The keys are a dimension table: it is joined as it is,
    and Spark broadcasts it where its size allows.
    """
    no = F.col("map_no") if "map_no" in zone_table.columns else F.lit(0)
    keys = zone_table.select(F.col("city_key").alias("_k"), no.alias("_m")).distinct()
    asked = requests.select(F.col(city).alias("_city")).where("_city is not null").distinct()
    key = F.lower(F.trim("_city"))
    ways = F.array(F.struct(F.lit(0).alias("way"), key.alias("k")), F.struct(F.lit(1).alias("way"), F.regexp_replace(key, r"\s+", "_").alias("k")))
    asked = asked.select("_city", F.explode(ways).alias("t"))
    found = asked.join(keys, F.col("t.k") == F.col("_k")).groupBy("_city").agg(F.min(F.struct("_m", "t.way", "_k")).alias("f"))
    t = requests.join(found, F.col(city) == F.col("_city"), "left").withColumn("city_key", F.col("f._k"))
    if "map_no" in zone_table.columns:
        t = t.withColumn("map_no", F.col("f._m"))
    return t.drop("_city", "f")


def city_sweeps(requests: DataFrame, zoned: Column) -> DataFrame:
    """City-level queries (ord, query) beside those of zones: up to three other words for the category, then three broad ones; without zones two other words."""
    c = F.col("category")
    named = [F.nullif(F.col(x), F.lit("")) for x in ("city", "district") if x in requests.columns]
    place, end = F.coalesce(*named, F.lit("Pakistan")), F.lit(", Pakistan")
    others = F.transform(F.slice(expand_category_column(c), F.lit(2), F.when(zoned, 3).otherwise(2)), lambda t: F.concat(t, F.lit(" in "), place, end))
    broad = F.array(F.concat(c, F.lit(" in "), place, end), F.concat(c, F.lit("s near "), place, F.lit(" Pakistan")), F.concat(F.lit("best "), c, F.lit(" "), place))
    every = F.concat(others, F.when(zoned, broad).otherwise(F.array().cast("array<string>")))
    return requests.select("*", F.posexplode(every).alias("ord", "query"))
