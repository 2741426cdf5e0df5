"""Registered queries for request parsing, location planning, projections, probes and export details, beside their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, geo, quality
from ..functions.basics import lookup
from ..operators import dedup, export, ranking
from ..operators.tables import materialize
from ..sources import places as src
from . import oracle as o
from . import planner
from .catalog import _CLASS, _prepared, _resolved, query, scalar

C = F.col
places, fuzzy_places = src.places, src.fuzzy_places

#: Portable SQL: requests, and locations with levels missing here and there.
_DEFAULT = "business_name,category,phone,website,rating,address,city"
#: Requests beside what a reading of the rules by hand gives: intent, category, city, country, fields, highest price, lowest rating, keywords, first number, output.
EXPECTED = [
    ("Best restaurants in Lahore with phone", "search", "restaurant", "Lahore", "Pakistan", "business_name,category,phone", None, None, "restaurant", None, None),
    ("25 hotels near karachi with website and rating", "search", "hotel", "Karachi", "Pakistan", "business_name,category,website,rating", None, None, "hotel", 25, None),
    ("write a poem", "unsupported", None, None, None, "", None, None, "", None, None),
    ("pharmacy in DHA Phase 6 isb", "search", "pharmacy", "dha phase isb", "Pakistan", _DEFAULT, None, None, "pharmacy", 6, None),
    ("gyms please", "clarify", "gym", None, None, "", None, None, "", None, None),
    ("cheap cafes under rs. 500 within Clifton block 5 as csv", "search", "cafe", "clifton block as csv", "Pakistan", _DEFAULT, 500, None, "cafe", 500, "excel"),
    ("schools, model town", "search", "school", "model town", "Pakistan", _DEFAULT, None, None, "school", None, None),
    ("dentists rating above 4.5 near Saddar, report", "search", "dentist", "saddar report", "Pakistan", "business_name,category,rating", None, 4.5, "dentist", 4, "pdf"),
    ("4 star hotels at Murree", "search", "hotel", "Murree", "Pakistan", "business_name,category,rating", None, None, "hotel", 4, None),
    ("eatery in lahore", "search", "restaurant", "Lahore", "Pakistan", _DEFAULT, None, None, "restaurant", None, None),
    ("okara main hospital dhundo", "search", "hospital", "Okara", "Pakistan", _DEFAULT, None, None, "hospital", None, None),
    ("gulberg greens mein cafes batao", "clarify", "cafe", None, None, "", None, None, "", None, None),
    ("lahore mein ریسٹورنٹ ka نمبر", "search", "restaurant", "Lahore", "Pakistan", "business_name,category,phone", None, None, "restaurant", None, None),
    ("gym in hair salon street 12", "search", "gym", "hair street", "Pakistan", "business_name,category,address", None, None, "gym", 12, None),
    ("coffee, dg khan road", "search", "cafe", "Dera Ghazi Khan", "Pakistan", _DEFAULT, None, None, "cafe", None, None),
    ("25 rupai wali bakery new delhi", "search", "bakery", "Delhi", "India", "business_name,category,price", None, None, "bakery", 25, None),
    ("budget hotels multan", "search", "hotel", "Multan", "Pakistan", _DEFAULT, None, None, "hotel,cheap", None, None),
    ("florists near tower mein", "search", "business", "tower mein", "Pakistan", _DEFAULT, None, None, "directory", None, None),
    ("clinics satellite town mein", "search", "clinic", "satellite town", "Pakistan", _DEFAULT, None, None, "clinic", None, None),
]
_TEXTS = [e[0] for e in EXPECTED]
REQUESTS = f"SELECT c_custkey AS id, CASE c_custkey % {len(_TEXTS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + " END AS q FROM customer"
LOCATIONS = """SELECT rec_no, CASE rec_no % 4 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'Coffee Shop' WHEN 2 THEN 'Machinery' ELSE 'florist' END AS category,
 CASE WHEN rec_no % 9 = 0 THEN 'government' END AS ownership, CASE WHEN rec_no % 7 = 0 THEN 'Chak 9' END AS village, CASE WHEN rec_no % 6 = 0 THEN 'G-9' END AS sector, CASE WHEN rec_no % 3 = 0 THEN 'DHA Phase 5' END AS housing_society,
 CASE WHEN rec_no % 8 = 1 THEN 'Mall Road' END AS road, CASE WHEN rec_no % 13 = 0 THEN NULL WHEN rec_no % 2 = 0 THEN area END AS area,
 CASE rec_no % 13 WHEN 0 THEN NULL WHEN 1 THEN 'LHR' WHEN 2 THEN 'pindi' WHEN 3 THEN NULL ELSE city END AS city, CASE rec_no % 13 WHEN 0 THEN NULL WHEN 3 THEN 'multan' WHEN 4 THEN lower(city) END AS district,
 CASE WHEN rec_no % 5 = 0 AND rec_no % 13 > 0 THEN province END AS province FROM places"""


def _requests(spark, sf_dir):
    src.register(spark, sf_dir)
    return spark.sql(REQUESTS)


def _locations(spark, sf_dir):
    places(spark, sf_dir).createOrReplaceTempView("places")
    return spark.sql(LOCATIONS)


# ------------------------------------------------------------------ requests
def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_PARSED = f"""WITH rq AS ({REQUESTS}), x(q, intent, category, city, country, fields, max_price, min_rating, keywords, first_number, output) AS (VALUES
  {", ".join("(" + ", ".join(map(_literal, e)) + ")" for e in EXPECTED)}
), p AS (SELECT id, x.* FROM rq JOIN x USING (q)) """


def _parsed(name: str, sql: str, *columns) -> None:
    def run(spark, sf_dir):
        t = planner.parse_table(_requests(spark, sf_dir))
        return t.withColumns({c: F.array_join(c, ",") for c in ("fields", "keywords")}).select("id", *columns)

    query(name, f"{_PARSED} SELECT id, {sql} FROM p")(run)


_parsed("parse_intent", "intent", "intent")
_parsed("parse_category", "category", "category")
_parsed("parse_city", "city, country", "city", "country")
_parsed("parse_location", "city || ', ' || country AS location", "location")
_parsed("parse_filters", "max_price::BIGINT AS max_price, min_rating::DOUBLE AS min_rating", "max_price", "min_rating")
_parsed("parse_fields", "fields", "fields")
_parsed("parse_queries", "intent, category, city, keywords, first_number::INTEGER AS first_number", "intent", "category", "city", "keywords", "first_number")


@query("plan_from_query", _PARSED + """SELECT id, coalesce(category, 'business') AS category, city, coalesce(country, 'Pakistan') AS country, 'in' AS preposition, first_number::INTEGER AS requested_result_count, output,
 array_to_string(list_filter(string_split(fields, ',') || list_filter(['business_name', 'address', 'phone', 'website'], lambda f: NOT list_contains(string_split(fields, ','), f)), lambda f: f <> ''), ',') AS fields FROM p""")
def plan_from_query(spark, sf_dir):
    return planner.plan_table(_requests(spark, sf_dir)).withColumn("fields", F.array_join("fields", ",")).drop("q")


# ------------------------------------------------------------------ locations
def _values(table: dict) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in (k, *(v if isinstance(v, tuple) else (v,)))) + ")" for k, v in table.items())


_LOC = f"WITH {o.PLACES}, loc AS ({LOCATIONS}) "
_ORDER = [x for x in planner.LEVELS if x in ("village", "sector", "housing_society", "road", "area", "city", "district", "province")]
_NAMES = f"list_filter([{', '.join(_ORDER)}], lambda x: x IS NOT NULL)"
_STRING = f"array_to_string(CASE WHEN len({_NAMES}) > 0 THEN list_filter({_NAMES}, lambda x, i: list_position(list_transform({_NAMES}, lambda y: lower(y)), lower(x)) = i)[1:3] ELSE [] END || ['Pakistan'], ', ')"
_ENRICHED = f"""WITH {o.PLACES}, loc AS ({LOCATIONS}), al(a, c) AS (VALUES {_values(planner.CITY_ALIASES)}), rg(n, d, p) AS (VALUES {_values(planner.REGISTRY)}),
 x AS (SELECT loc.* REPLACE (coalesce(al.c, city) AS city) FROM loc LEFT JOIN al ON al.a = lower(loc.city)),
 y AS (SELECT *, list_filter([{", ".join(_ORDER)}], lambda v: lower(v) IN ({", ".join(f"'{k.lower()}'" for k in planner.REGISTRY)}))[1] AS hit FROM x) """


@query("enrich_location", _ENRICHED + "SELECT rec_no, coalesce(city, rg.n) AS city, coalesce(district, rg.d) AS district, coalesce(province, rg.p) AS province FROM y LEFT JOIN rg ON lower(rg.n) = lower(hit)")
def enrich_location(spark, sf_dir):
    return planner.enrich_columns(_locations(spark, sf_dir)).select("rec_no", "city", "district", "province")


@query("alias_lookup", f"{_LOC}, al(a, c) AS (VALUES {_values(planner.CITY_ALIASES)}) SELECT rec_no, city, al.c AS canonical FROM loc LEFT JOIN al ON al.a = lower(city)")
def alias_lookup(spark, sf_dir):
    return _locations(spark, sf_dir).select("rec_no", "city", lookup(planner.CITY_ALIASES, F.lower("city")).alias("canonical"))


def _located(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        rows = _locations(spark, sf_dir)
        return rows.select("rec_no", planner.location_columns(rows)[name].alias(name))

    query(name, f"{_LOC} SELECT rec_no, {sql} AS {name} FROM loc")(run)


_located("location_type", "CASE " + " ".join(f"WHEN {x} IS NOT NULL THEN '{x}'" for x in _ORDER) + " ELSE 'country' END")
_located("geocode_query", f"array_to_string({_NAMES}[1:4] || ['Pakistan'], ', ')")
_located("location_string", _STRING)

_SYNONYMS = "sy(k, v) AS (VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in planner.SYNONYMS.items()) + ")"


_CATEGORIES = {
    "restaurant": "restaurant|food|dining|eatery|diner|food restaurant", "Coffee Shop": "Coffee Shop|coffee shops", "Machinery": "Machinery|machinerys|machinery shop|machinery store",
    "florist": "florist|florists|florist shop|florist store", "Gyms": "Gyms|fitness centers|fitness gyms|health clubs", "mosque": "mosque|mosques|masjids|masjid", "BANK": "BANK|banks",
}
_CATEGORY_ROWS = "SELECT c_custkey AS id, CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES)) + " END AS category FROM customer"


@query("expand_category", f"WITH c AS ({_CATEGORY_ROWS}), x(category, terms) AS (VALUES {_values(_CATEGORIES)}) SELECT id, terms FROM c JOIN x USING (category)")
def expand_category(spark, sf_dir):
    src.register(spark, sf_dir)
    return spark.sql(_CATEGORY_ROWS).select("id", F.array_join(planner.expand_category_column(C("category")), "|").alias("terms"))


#: A city of the second map alone, one of both, and keys with spaces and underscores.
_MAPS = [("lahore", 0), ("rahim_yar_khan", 0), ("lahore", 1), ("lower dir", 1), ("mandi_bahauddin", 1)]
_CITY_OF = ["' Lahore '", "'karachi'", "'Lower  Dir'", "'LOWER DIR'", "'Rahim Yar  Khan'", "'mandi bahauddin'", "NULL", "''"]


@query("zone_lookup", f"""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 8 {" ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CITY_OF))} END AS city FROM customer), x(city, city_key, map_no) AS (VALUES
  (' Lahore ', 'lahore', 0), ('LOWER DIR', 'lower dir', 1), ('Rahim Yar  Khan', 'rahim_yar_khan', 0), ('mandi bahauddin', 'mandi_bahauddin', 1)) SELECT id, city_key, map_no FROM c LEFT JOIN x USING (city)""")
def zone_lookup(spark, sf_dir):
    src.register(spark, sf_dir)
    rows = spark.sql("SELECT c_custkey AS id, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CITY_OF)) + " END AS city FROM customer")
    table = spark.createDataFrame([(k, m, 1, "Centre") for k, m in _MAPS], "city_key string, map_no int, zone_ord int, zone string")
    return planner.zone_lookup(rows, table).select("id", "city_key", "map_no")


@query("city_sweeps", f"""WITH c AS ({_CATEGORY_ROWS}), x(category, terms) AS (VALUES {_values(_CATEGORIES)}), r AS (SELECT id, category, CASE WHEN id % 5 = 0 THEN NULL ELSE 'City ' || id % 9 END AS city, string_split(terms, '|') AS t, id % 3 > 0 AS zoned FROM c JOIN x USING (category)
), y AS (SELECT id, list_transform(t[2:CASE WHEN zoned THEN 4 ELSE 3 END], lambda w: w || ' in ' || coalesce(city, 'Pakistan') || ', Pakistan')
  || CASE WHEN zoned THEN [category || ' in ' || coalesce(city, 'Pakistan') || ', Pakistan', category || 's near ' || coalesce(city, 'Pakistan') || ' Pakistan', 'best ' || category || ' ' || coalesce(city, 'Pakistan')] ELSE [] END AS qs FROM r)
SELECT id, unnest(qs) AS query, generate_subscripts(qs, 1)::INTEGER - 1 AS ord FROM y""")
def city_sweeps(spark, sf_dir):
    src.register(spark, sf_dir)
    rows = spark.sql(_CATEGORY_ROWS).withColumn("city", F.when(C("id") % 5 > 0, F.concat(F.lit("City "), (C("id") % 9).cast("string"))))
    return planner.city_sweeps(rows, C("id") % 3 > 0).select("id", "query", "ord")


_GEO = """loc AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE ' Place ' || c_custkey % 40 || ', Pakistan' END AS geocode_query, CASE WHEN c_custkey % 3 = 0 THEN 'Known' END AS province, CAST(NULL AS STRING) AS city,
 CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CAST(0.8 AS DOUBLE) + CAST(c_custkey % 4 AS DOUBLE) / 20 AS confidence FROM customer)"""


@query("geocode_merge", f"""WITH {_GEO}, a AS (SELECT 'place ' || i || ', pakistan' AS k, 30 + i / 100.0::DOUBLE AS lat, 70 + i / 100.0::DOUBLE AS lng, 'Province ' || i AS p, 'City ' || i AS c FROM range(0, 30) t(i))
SELECT id, coalesce(province, p) AS province, coalesce(city, c) AS city, lat AS latitude, lng AS longitude, round(CASE WHEN k IS NOT NULL THEN least(1, confidence + 0.1::DOUBLE) WHEN coalesce(geocode_query, '') = '' THEN greatest(0, confidence - 0.2::DOUBLE) ELSE greatest(0, confidence - 0.3::DOUBLE) END, 6) AS confidence
FROM loc LEFT JOIN a ON a.k = lower(trim(geocode_query))""")
def geocode_merge(spark, sf_dir):
    src.register(spark, sf_dir)
    rows = spark.sql(f"WITH {_GEO} SELECT * FROM loc")
    i = C("id").cast("string")
    answers = spark.range(30).select(F.concat(F.lit("PLACE "), i, F.lit(", Pakistan ")).alias("query"), (C("id") / 100 + 30).alias("latitude"), (C("id") / 100 + 70).alias("longitude"),
                                     F.create_map(F.lit("administrative_area_level_1"), F.concat(F.lit("Province "), i), F.lit("locality"), F.concat(F.lit("City "), i)).alias("components"))
    return planner.geocode_join(rows, answers).select("id", "province", "city", "latitude", "longitude", F.round("confidence", 6).alias("confidence"))


scalar("needs_grid", lambda: planner.needs_grid(F.when(C("rec_no") % 4 > 0, C("rec_no") % 3), C("latitude"), C("longitude")), "(coalesce(CASE WHEN rec_no % 4 > 0 THEN rec_no % 3 END, 0) = 0 AND latitude IS NOT NULL AND longitude IS NOT NULL)")
scalar("bounds_changed", lambda: ranking.bounds_changed(F.lit(31.5), F.lit(74.5), C("latitude"), C("longitude")), "(abs(latitude - 31.5::DOUBLE) > 0.01::DOUBLE OR abs(longitude - 74.5::DOUBLE) > 0.01::DOUBLE)")


@query("page_cap", f"WITH {o.PLACES} SELECT rec_no FROM places ORDER BY rec_no LIMIT 60")
def page_cap(spark, sf_dir):
    return planner.page_cap(places(spark, sf_dir), 3).select("rec_no")


@query("expand_queries", f"""{_LOC}, {_SYNONYMS}, e AS (SELECT loc.*, {_STRING} AS place, list_transform(coalesce(v, [category])[1:2], lambda t: coalesce(ownership || ' ', '') || t) AS terms FROM loc LEFT JOIN sy ON k = lower(category)
), f AS (SELECT rec_no, list_transform(terms, lambda t: t || ' in ' || place) || list_filter([CASE WHEN lower(housing_society) <> lower(city) THEN category || ' in ' || housing_society || ', ' || city || ', Pakistan' END,
 category || ' near ' || village || ', ' || coalesce(city, district) || ', Pakistan', category || ' near ' || road || ', ' || coalesce(city, district) || ', Pakistan',
 coalesce(category || ' in ' || city || ', Pakistan', category || ' in ' || district || ', ' || coalesce(province, 'Pakistan') || ', Pakistan'), category || ' in ' || sector || ' ' || city || ', Pakistan'], lambda x: x IS NOT NULL) AS qs FROM e)
SELECT rec_no, array_to_string(list_filter(qs, lambda x, i: list_position(list_transform(qs, lambda y: lower(y)), lower(x)) = i)[1:4], '|') AS queries FROM f""")
def expand_queries(spark, sf_dir):
    rows = _locations(spark, sf_dir)
    return rows.select("rec_no", F.array_join(planner.expand_queries_column(rows), "|").alias("queries"))


@query("grid_queries", f"WITH {o.PLACES}, c AS (SELECT rec_no AS id, latitude, longitude FROM places WHERE latitude IS NOT NULL), g AS (SELECT id, floor((latitude + (r.range - 0.5) * 5 / 111.0::DOUBLE) * 10000 + 0.5) / 10000 AS cell_lat, floor((longitude + (k.range - 0.5) * 5 / (111.0::DOUBLE * cos(latitude * pi() / 180))) * 10000 + 0.5) / 10000 AS cell_lng, 'Grid ' || chr((65 + r.range)::INTEGER) || (k.range + 1) AS label FROM c, range(2) r, range(2) k) SELECT id, unnest(['cafe near ' || cell_lat || ',' || cell_lng, 'cafe ' || label || ' Lahore']) AS query FROM g")
def grid_queries(spark, sf_dir):
    cells = planner.geo_grid(places(spark, sf_dir).select(C("rec_no").alias("id"), "latitude", "longitude", F.lit(40).alias("target")))
    return planner.grid_queries(cells, "cafe", F.lit("Lahore")).select("id", "query")


# ------------------------------------------------------------------ projections
_PHONE = "coalesce(nullif(phone, ''), '+92 300 1')"


def _raw(spark, sf_dir):
    p = places(spark, sf_dir)
    null = F.lit(None).cast("string")
    return p.select(
        C("place_id").alias("id"), F.struct(F.when(C("rec_no") % 17 > 0, C("business_name")).alias("text")).alias("displayName"), C("address").alias("formattedAddress"), F.array(F.lit("store")).alias("types"), null.alias("googleMapsUri"),
        C("phone").alias("nationalPhoneNumber"), F.lit("+92 300 1").alias("internationalPhoneNumber"), C("website").alias("websiteUri"), F.struct("latitude", "longitude").alias("location"), "rating", C("review_count").alias("userRatingCount"),
        F.lit("OPERATIONAL").alias("businessStatus"), null.alias("_retrieved_at"), C("rec_no").alias("seq"), F.lit(0).alias("batch_no"), F.lit(0).alias("query_no"),
    )


_NAME = "CASE WHEN rec_no % 17 > 0 THEN business_name ELSE 'Unknown' END"
_PROJECTED = ["rec_no", "place_id", "business_name", "category", "area", "city", "phone", "website", "data_completeness"]


def _projected(name: str, normalise: bool, business_name: str, phone: str, website: str) -> None:
    filled = o.points(("true", 1), (f"coalesce({phone}, '') <> ''", 1), (o.truthy("website"), 1), (o.truthy("address"), 1), ("latitude IS NOT NULL", 1))
    sql = f"WITH {o.PLACES} SELECT rec_no, place_id, {business_name} AS business_name, 'cafe' AS category, trim(string_split(address, ',')[-3]) AS area, 'Lahore' AS city, {phone} AS phone, {website} AS website, CASE WHEN {filled} >= 4 THEN 'FULL' ELSE 'PARTIAL' END AS data_completeness FROM places"
    query(name, sql)(lambda spark, sf_dir: src.project(_raw(spark, sf_dir), category="cafe", city="Lahore", normalise=normalise).select(*_PROJECTED))


_projected("place_project", False, _NAME, _PHONE, "website")
_projected("place_normalize", True, o.squeeze(_NAME), o.phone(_PHONE), o.website_norm("website"))


@query("to_business", f"WITH {o.PLACES} SELECT rec_no, coalesce(nullif(place_id, ''), 'record-' || rec_no) AS id, 'Pakistan' AS country, coalesce({o.phone('phone')}, '') AS phones, coalesce({o.canonical('website')}, '') AS websites FROM places")
def to_business(spark, sf_dir):
    return src.as_business(places(spark, sf_dir)).select("rec_no", "id", "country", F.array_join("phones", "|").alias("phones"), F.array_join("websites", "|").alias("websites"))


_SCORE = o.points((o.truthy("place_id"), 15), (o.truthy("phone"), 25), (o.truthy("website"), 25), (o.truthy("address"), 15), ("latitude IS NOT NULL", 10), ("rating <> 0", 5), ("review_count > 0", 5))


@query("save_project", f"WITH {o.PLACES} SELECT rec_no, coalesce(nullif(business_name, ''), 'Unknown') AS name, coalesce(nullif(city, ''), 'Lahore') AS city, 'Pakistan' AS country, nullif(phone, '') AS phone, nullif(website, '') AS website, nullif(rating, 0) AS rating, nullif(review_count, 0) AS review_count, {_SCORE} AS quality_score, coalesce({_CLASS}, 'PARTIAL') AS extra_completeness FROM places")
def save_project(spark, sf_dir):
    null = F.lit(None).cast("string")
    own = quality.completeness_class(*[C(c) for c in ("business_name", "phone", "website", "address", "latitude", "longitude")])
    p = places(spark, sf_dir).withColumns({"country": null, "maps_url": null, "business_status": null, "distance_km": F.lit(0.0), "data_completeness": own})
    return src.save_rows(p, "Lahore").select("rec_no", "name", "city", "country", "phone", "website", "rating", "review_count", "additional_data.quality_score", C("additional_data.data_completeness").alias("extra_completeness"))


# ------------------------------------------------------------------ measures and probes
scalar("record_quality", lambda: quality.record_quality(C("business_name"), C("phone"), contact.phones_all(C("phone")), C("website"), contact.websites_all(C("website")), C("address"), C("area"), C("city"), C("latitude"), C("longitude"), C("place_id"), C("rating"), C("review_count"), C("category")),
       o.points(*[(o.truthy(c), n) for c, n in (("business_name", 10), ("phone", 20), ("website", 20), ("address", 15), ("area", 5), ("city", 5), ("place_id", 10), ("category", 5))], (f"{o.phone('phone')} IS NOT NULL", 5), (f"{o.canonical('website')} IS NOT NULL", 5), ("latitude IS NOT NULL", 10), ("rating <> 0", 5), ("review_count <> 0", 5)))
_FILLED = ("business_name", "phone", "website", "address", "area", "city", "category", "place_id")
scalar("completeness_pct", lambda: quality.completeness_pct(*[C(c).isNotNull() & (C(c) != "") for c in _FILLED], C("latitude").isNotNull(), C("rating").isNotNull(), C("review_count").isNotNull()),
       f"floor({o.points(*[(o.truthy(c), 1) for c in _FILLED], ('latitude IS NOT NULL', 1), ('rating IS NOT NULL', 1), ('review_count IS NOT NULL', 1))}::DOUBLE / 11 * 100 + 0.5)::BIGINT")
_NORTH_EAST = o.km("latitude", "longitude", "(latitude + (rec_no % 40)::DOUBLE / 10000)", "(longitude + 0.0005::DOUBLE)") + " * 1000"
scalar("viewport_radius", lambda: F.round(geo.viewport_radius(C("latitude"), C("longitude"), C("latitude") + C("rec_no") % 40 / 10000, C("longitude") + F.lit(0.0005)), 4), f"CASE WHEN {_NORTH_EAST} > 100 THEN round({_NORTH_EAST}, 4) END")
scalar("export_filename", lambda: F.concat_ws(" ", export.legacy_file_name(C("address")), export.file_name_column(C("category"), F.when(C("rec_no") % 3 > 0, F.array(C("area"), C("city"))).otherwise(F.array().cast("array<string>")))),
       "substr(regexp_replace(lower(address), '[^a-z0-9]', '_', 'g'), 1, 40) || ' places_' || CASE WHEN rec_no % 3 > 0 THEN regexp_replace(area || '_' || city, '[^a-zA-Z0-9_]', '_', 'g') ELSE 'All' END || coalesce('_' || regexp_replace(nullif(category, ''), '[^a-zA-Z0-9_]', '_', 'g'), '') || '.xlsx'")


@query("geo_same_place", f"WITH {o.FUZZY} SELECT a.rec_no, coalesce({o.km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} * 1000 <= 50, false) AS same FROM fuzzy a JOIN fuzzy b ON b.rec_no = a.rec_no + 1000000")
def geo_same_place(spark, sf_dir):
    f = fuzzy_places(spark, sf_dir)
    b = f.select((C("rec_no") - 1000000).alias("rec_no"), C("latitude").alias("lat"), C("longitude").alias("lng"))
    return f.join(b, "rec_no").select("rec_no", geo.same_place(geo.haversine_km(C("latitude"), C("longitude"), C("lat"), C("lng")) * 1000).alias("same"))


_KEY = "nullif(array_to_string(list_sort(list_filter(string_split(name, ' '), lambda x: x <> '')[1:2]), '|'), '')"


@query("block_probe", f"WITH {o.FUZZY}, n AS (SELECT *, {o.name('business_name')} AS name FROM fuzzy), k AS (SELECT rec_no, {o.phone('phone')} AS ph, {o.canonical('website')} AS web, floor(latitude / 2) AS x, floor(longitude / 2) AS y, {_KEY} AS nk, lower(trim(city)) AS ck FROM n) SELECT a.rec_no AS probe, b.rec_no AS candidate FROM k a JOIN k b ON a.rec_no % 20 = 0 AND a.rec_no <> b.rec_no AND (a.ph = b.ph OR a.web = b.web OR (a.x = b.x AND a.y = b.y) OR a.nk = b.nk OR a.ck = b.ck)")
def block_probe(spark, sf_dir):
    """A search: every twentieth record against all records."""
    r = materialize(_prepared(spark, sf_dir), "prepared")
    return dedup.block_probe(r, r.where("rec_no % 20 = 0"))


@query("export_info", o.ER + """, s AS (SELECT (SELECT count(*) FROM fuzzy) AS u, (SELECT count(*) FROM fuzzy WHERE rating >= 4) AS f, (SELECT count(*) FROM grp) AS g)
SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) AS ord, unnest(['Search Query', 'Export Scope', 'Selected Area(s)', 'Export Date', 'Raw Result Count', 'Duplicates Removed', 'Unique Result Count', 'Final Export Count', 'Duplicate Groups', 'Filters Applied']) AS field,
 unnest(['cafes', 'all', 'All', '2024-01-01', (u + 10)::VARCHAR, '10', u::VARCHAR, f::VARCHAR, g::VARCHAR, 'Rating 4+']) AS value FROM s""")
def export_info(spark, sf_dir):
    p = fuzzy_places(spark, sf_dir)
    totals = export.summary(10, p, ranking.view_filter(p, min_rating=4), ["Rating 4+"]).withColumns({"raw": C("unique") + 10, "removed": F.lit(10)})
    return export.info_rows(totals, "cafes", "all", [], _resolved(spark, sf_dir)["groups"], F.lit("2024-01-01"))
