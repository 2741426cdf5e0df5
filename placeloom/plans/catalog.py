"""The registered queries: each runs an operator over the derived place tables or driver tables, beside its SQL form."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, geo, quality, similarity, text
from ..operators import dedup, export, ranking, store
from ..operators.tables import materialize
from ..sources.places import fuzzy_places, places
from ..streaming import adaptive
from . import oracle as o
from . import planner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C = F.col
CENTRE = {"city": "NATION_10", "latitude": 31.4, "longitude": 74.3, "preposition": "inside", "radius_km": 20}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def scalar(name: str, spark_of, sql: str, source: str = "places", key: str = "rec_no") -> None:
    """A one-column query over places, pages or the near-copies."""
    def run(spark, sf_dir):
        df = places(spark, sf_dir) if source == "places" else spark.read.parquet(f"{sf_dir}/{source}.parquet")
        return df.select(key, spark_of().alias("v"))

    QUERIES[name] = run
    ORACLE[name] = (f"WITH {o.PLACES} " if source == "places" else "") + f"SELECT {key}, {sql} AS v FROM {source}"


# ------------------------------------------------------------------ scalars
scalar("phone_norm", lambda: contact.phone_norm(C("phone")), o.phone("phone"))
scalar("phone_national", lambda: contact.phone_national(C("phone")), o.national("phone"))
scalar("phone_legacy", lambda: contact.phone_legacy(C("phone")), o.phone_legacy("phone"))
scalar("phone_valid", lambda: contact.phone_valid(C("phone")), f"coalesce(regexp_matches({o.phone('phone')}, '^[+]923[0-9]{{9}}$|^[+]92[0-9]{{9,10}}$'), false)")
scalar("phones_all", lambda: F.array_join(contact.phones_all(C("phone"), F.concat(F.lit("0"), F.substr("phone", F.lit(2))), C("phone")), "|"), f"array_to_string(list_filter(CASE WHEN {o.phone('phone')} IS NOT DISTINCT FROM {o.phone("('0' || substr(phone, 2))")} THEN [{o.phone('phone')}] ELSE [{o.phone('phone')}, {o.phone("('0' || substr(phone, 2))")}] END, lambda x: x IS NOT NULL), '|')")
scalar("website_norm", lambda: contact.website_norm(F.regexp_replace("url", "^http://", "")), o.website_norm("regexp_replace(url, '^http://', '')"), "pages", "page_id")
scalar("website_domain", lambda: contact.website_domain(C("url")), o.domain("url"), "pages", "page_id")
scalar("website_canonical", lambda: contact.website_canonical(C("url")), o.canonical("url"), "pages", "page_id")
scalar("websites_all", lambda: F.array_join(contact.websites_all(C("url"), C("url")), "|"), f"coalesce({o.canonical('url')}, '')", "pages", "page_id")
scalar("website_legacy", lambda: contact.website_legacy(C("url")), o.website_legacy("url"), "pages", "page_id")
scalar("text_norm", lambda: contact.text_norm(F.concat(F.lit("  "), F.replace("address", F.lit(","), F.lit(" ,\t ")), F.lit(" "))), o.squeeze("('  ' || replace(address, ',', ' ,' || chr(9) || ' ') || ' ')"))
scalar("name_clean", lambda: text.name_clean(C("business_name")), o.name_clean("business_name"))
scalar("name_norm", lambda: text.name_norm(C("business_name")), o.name("business_name"))
scalar("abbrev_expand", lambda: text.expand(C("address"), text.ABBREVIATIONS), o.expand("address", text.ABBREVIATIONS))
scalar("address_norm", lambda: text.address_norm(C("address")), o.address("address"))
scalar("roman_digits", lambda: text.roman_digits(F.lower("address")), o.roman("lower(address)"))
scalar("area_canonical", lambda: text.area_canonical(C("area")), o.area("area"))
scalar("area_tokens", lambda: F.array_join(text.area_tokens(F.concat(C("business_name"), F.lit(", "), C("address"))), "|"), o.area_tokens("(business_name || ', ' || address)"))
scalar("area_extract", lambda: text.area_extract(C("address")), "trim(string_split(address, ',')[-3])")
scalar("category_norm", lambda: text.category_norm(C("category")), o.category("category"))
scalar("full_address", lambda: text.full_address(C("address"), C("area"), C("city"), F.lit("Lahore"), C("province"), F.lit("Pakistan")), "address || ', Lahore'")
scalar("geo_cell", lambda: geo.coarse_cell(C("latitude"), C("longitude")), "floor(latitude / 2)::BIGINT::VARCHAR || '_' || floor(longitude / 2)::BIGINT::VARCHAR")
scalar("haversine", lambda: F.round(geo.haversine_km(C("latitude"), C("longitude"), F.lit(24.8607), F.lit(67.0011)), 6), f"round({o.km('latitude', 'longitude', '24.8607::DOUBLE', '67.0011::DOUBLE')}, 6)")
scalar("quality_score", lambda: quality.quality_score(C("place_id"), C("phone"), C("website"), C("address"), C("latitude"), C("longitude"), C("rating"), C("review_count")), o.points((o.truthy("place_id"), 15), (o.truthy("phone"), 25), (o.truthy("website"), 25), (o.truthy("address"), 15), ("latitude IS NOT NULL", 10), ("rating <> 0", 5), ("review_count > 0", 5)))
_FULL = o.points(*[(o.truthy(c), 1) for c in ("business_name", "phone", "website", "address")], ("latitude IS NOT NULL", 1))
_CLASS = f"CASE WHEN {_FULL} >= 4 THEN 'FULL' WHEN {_FULL} >= 1 THEN 'PARTIAL' ELSE 'NAME_ONLY' END"


def _class():
    return quality.completeness_class(*[C(c) for c in ("business_name", "phone", "website", "address", "latitude", "longitude")])


scalar("completeness_class", _class, _CLASS)
scalar("geo_match_score", lambda: F.round(geo.location_score(geo.haversine_km(C("latitude"), C("longitude"), F.lit(31.5), F.lit(74.5)), F.lit(40.0), F.lit(0.5)), 6), "round(CASE WHEN latitude IS NULL THEN 0.3 WHEN {k} <= 40 THEN greatest(0.5, 1 - {k} / 80) ELSE greatest(0, 0.5 - ({k} - 40) / 160) END::DOUBLE, 6)".format(k=o.km("latitude", "longitude", "31.5::DOUBLE", "74.5::DOUBLE")))
scalar("effective_radius", lambda: F.lit(geo.effective_radius({"city": "x", "housing_society": "y"})) + F.lit(geo.effective_radius({"province": "p"})), "203.0::DOUBLE")
scalar("addr_token_score", lambda: geo.address_token_score(C("address"), ["Gulberg", "NATION_10", "Pakistan"]), "(2 + CASE WHEN contains(lower(address), 'nation_10') THEN 1 ELSE 0 END)::DOUBLE / 3")
scalar("progress_pct", lambda: adaptive.progress_pct(C("rec_no") % 10, F.lit(10)), "least(84, 35 + floor((rec_no % 10)::DOUBLE / 10 * 50))::INTEGER")
scalar("stage_index", lambda: adaptive.stage_index(F.element_at(F.array(*[F.lit(s) for s in (*adaptive.STAGES, "OTHER")]), (C("rec_no") % 10 + 1).cast("int"))), "CASE WHEN rec_no % 10 = 9 THEN 0 ELSE rec_no % 10 END::INTEGER")

_SPLIT = f"WITH {o.PLACES}, w AS (SELECT rec_no, {o.name('business_name')} AS name FROM places), x AS (SELECT *, string_split(name, ' ') AS w FROM w), y AS (SELECT *, {o.branch_at('w')} AS cut FROM x) "


@query("branch_split", _SPLIT + "SELECT rec_no, CASE WHEN cut > 1 THEN array_to_string(w[1:cut - 1], ' ') ELSE name END AS core, CASE WHEN cut > 1 THEN array_to_string(w[cut:], ' ') ELSE '' END AS qualifier FROM y")
def branch_split(spark, sf_dir):
    return places(spark, sf_dir).select("rec_no", text.branch_split(text.name_norm(C("business_name"))).alias("b")).select("rec_no", "b.core", "b.qualifier")


def _pairs(spark, sf_dir):
    """Each record beside the next one of its city's rank order: name pairs for the similarity measures."""
    p = places(spark, sf_dir).select("rec_no", text.name_norm(C("business_name")).alias("a"), "category")
    b = p.select((C("rec_no") - 4).alias("rec_no"), C("a").alias("b"), C("category").alias("category_b"))
    return p.join(b, "rec_no")


_PAIRS = f"WITH {o.PLACES}, n AS (SELECT rec_no, {o.name('business_name')} AS a, category FROM places), p AS (SELECT n.rec_no, n.a, m.a AS b, n.category, m.category AS category_b FROM n JOIN n m ON m.rec_no = n.rec_no + 4) "
for _name, _f, _sql in (
    ("levenshtein", lambda a, b: F.levenshtein(a, b), "levenshtein(a, b)"), ("lev_sim", similarity.levenshtein_similarity, o.lev("a", "b")), ("jaro_winkler", similarity.jaro_winkler, o.winkler("a", "b")),
    ("token_jaccard", similarity.token_jaccard, o.jaccard("a", "b")), ("token_sort_sim", similarity.token_sort_similarity, o.token_sort("a", "b")), ("bigram_dice", similarity.bigram_dice, o.dice("a", "b")),
    ("name_sim", similarity.name_similarity, o.name_sim("a", "b")),
):
    QUERIES[_name] = functools.partial(lambda f, spark, sf_dir: _pairs(spark, sf_dir).select("rec_no", f(C("a"), C("b")).alias("v")), _f)
    ORACLE[_name] = _PAIRS + f"SELECT rec_no, {_sql} AS v FROM p"


@query("category_sim", _PAIRS + f", q AS (SELECT rec_no, category, CASE WHEN rec_no % 3 = 0 THEN 'coffee shop' WHEN rec_no % 3 = 1 THEN 'dining' ELSE category_b END AS other, CASE WHEN rec_no % 2 = 0 THEN 'restaurant' ELSE 'shop' END AS mine FROM p), r AS (SELECT *, {o.category('mine')} AS na, {o.category('other')} AS nb FROM q) SELECT rec_no, {o.category_sim('mine', 'other', 'na', 'nb')} AS v FROM r")
def category_sim(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    other = F.when(C("rec_no") % 3 == 0, "coffee shop").when(C("rec_no") % 3 == 1, "dining").otherwise(C("category_b"))
    q = p.select("rec_no", F.when(C("rec_no") % 2 == 0, "restaurant").otherwise("shop").alias("m"), other.alias("o"))
    q = q.withColumns({"na": text.category_norm(C("m")), "nb": text.category_norm(C("o"))})
    return q.select("rec_no", similarity.category_similarity(C("m"), C("o"), C("na"), C("nb"), text.category_group(C("na")), text.category_group(C("nb"))).alias("v"))


@query("set_compare", f"WITH {o.PLACES} SELECT a.rec_no, CASE WHEN {o.phone('a.phone')} IS NULL OR {o.phone('b.phone')} IS NULL THEN -1 WHEN {o.phone('a.phone')} = {o.phone('b.phone')} THEN 1 ELSE 0 END AS v FROM places a JOIN places b ON b.rec_no = a.rec_no + 700")
def set_compare(spark, sf_dir):
    p = places(spark, sf_dir).select("rec_no", contact.phones_all(C("phone")).alias("a"))
    return p.join(p.select((C("rec_no") - 700).alias("rec_no"), C("a").alias("b")), "rec_no").select("rec_no", contact.set_compare(C("a"), C("b")).alias("v"))


@query("geo_score", f"WITH {o.FUZZY}, d AS (SELECT a.rec_no, {o.km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} * 1000 AS d FROM fuzzy a JOIN fuzzy b ON b.rec_no = a.rec_no + 1000000) SELECT rec_no, round(d, 4) AS metres, CASE WHEN d IS NULL THEN -1 WHEN d < 20 THEN 100 WHEN d <= 50 THEN 80 WHEN d <= 150 THEN 50 ELSE 10 END AS v FROM d")
def geo_score(spark, sf_dir):
    f = fuzzy_places(spark, sf_dir)
    b = f.select((C("rec_no") - 1000000).alias("rec_no"), C("latitude").alias("lat"), C("longitude").alias("lng"))
    d = f.join(b, "rec_no").select("rec_no", (geo.haversine_km(C("latitude"), C("longitude"), C("lat"), C("lng")) * 1000).alias("d"))
    return d.select("rec_no", F.round("d", 4).alias("metres"), geo.geo_score(C("d")).alias("v"))


# ------------------------------------------------------------------ views and ranking
COLS = ["rec_no", "business_name", "city", "rating"]
_ROWS = ", ".join(COLS)


def view(name: str, f, where: str = "", tail: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: f(places(spark, sf_dir)).select(*COLS)
    ORACLE[name] = f"WITH {o.PLACES} SELECT {_ROWS} FROM places {where and 'WHERE ' + where} {tail}"


view("view_text_search", lambda p: ranking.text_search(p, "  Nation_1 "), "contains(lower(business_name), 'nation_1') OR contains(lower(category), 'nation_1') OR contains(lower(address), 'nation_1') OR contains(lower(website), 'nation_1') OR contains(lower(city), 'nation_1') OR contains(phone, 'nation_1')")
view("view_filter", lambda p: ranking.view_filter(p, city="NATION_10", min_rating=2.0, has_phone=True, has_website=True), "city = 'NATION_10' AND rating >= 2.0 AND phone <> '' AND website <> ''")
view("view_sort", lambda p: ranking.view_sort(p, "rating", descending=True), "", "ORDER BY rating DESC NULLS FIRST, rec_no")
view("view_page", lambda p: ranking.page(ranking.view_sort(p, "rating"), 3, 20), "", "ORDER BY rating ASC NULLS LAST, rec_no LIMIT 20 OFFSET 40")
view("export_filter", lambda p: export.export_filter(p, category="Machinery", min_rating=3, has_phone=True), "(contains(coalesce(lower(category), ''), 'machinery') OR contains('machinery', coalesce(lower(category), ''))) AND rating >= 3 AND phone <> ''")
_AREA = "CASE rec_no % 3 WHEN 0 THEN area WHEN 1 THEN 'Phase-' || substr(city, 8) ELSE NULL END"
view(
    "scope_area", lambda p: export.scope(p.withColumn("area", F.expr(_AREA)), "multiple_areas", ["Gulberg 3", "phase 1"]),
    f"contains({o.area(_AREA)}, 'gulberg 3') OR contains({o.area(_AREA)}, 'phase 1') OR ({o.area(_AREA)} <> '' AND (contains('gulberg 3', {o.area(_AREA)}) OR contains('phase 1', {o.area(_AREA)}))) OR contains(lower(address), 'gulberg 3') OR contains(lower(address), 'phase 1')",
)
view("scope_selected", lambda p: export.scope(p, "selected", selected=p.where("rec_no % 7 = 0").select("rec_no")), "rec_no % 7 = 0")
view("geo_bbox_prefilter", lambda p: p.where(geo.bbox(C("latitude"), C("longitude"), 31.4, 74.3, 15)).where(geo.haversine_km(C("latitude"), C("longitude"), F.lit(31.4), F.lit(74.3)) <= 15), f"{o.km('latitude', 'longitude', '31.4::DOUBLE', '74.3::DOUBLE')} <= 15")

_RANK = f"""WITH {o.PLACES}, d AS (SELECT *, {o.km('31.4::DOUBLE', '74.3::DOUBLE', 'latitude', 'longitude')} AS d FROM places
), s AS (SELECT *, floor(d * 1000 + 0.5) / 1000 AS distance_km, floor(CASE WHEN d IS NULL THEN 0.6 * CASE WHEN contains(lower(address), 'nation_10') THEN 1 ELSE 0 END WHEN d <= 20 THEN greatest(0.5, 1 - d / 40) ELSE greatest(0, 0.5 - (d - 20) / 80) END::DOUBLE * 1000 + 0.5) / 1000 AS location_match_score FROM d
), n AS (SELECT count(*) AS a, count(*) FILTER (WHERE distance_km IS NULL OR distance_km <= 30) AS k FROM s), f AS (SELECT s.* FROM s, n WHERE distance_km IS NULL OR distance_km <= 30 OR k < least(10, 0.3 * a)) """


@query("geo_filter_relaxed", _RANK + "SELECT rec_no, distance_km FROM f")
def geo_filter_relaxed(spark, sf_dir):
    return ranking.relaxed_radius_filter(ranking.with_location_score(places(spark, sf_dir), CENTRE), 20.0, "inside").select("rec_no", "distance_km")


@query("geo_rank", _RANK + "SELECT rec_no, distance_km, location_match_score FROM f")
def geo_rank(spark, sf_dir):
    return ranking.filter_and_rank(places(spark, sf_dir), CENTRE).select("rec_no", "distance_km", "location_match_score")


@query("top_k", _RANK + f"SELECT rec_no, business_name, distance_km, location_match_score, {_CLASS} AS completeness FROM f ORDER BY location_match_score DESC, coalesce(distance_km, 9999), rec_no LIMIT 50")
def top_k(spark, sf_dir):
    return ranking.filter_and_rank(places(spark, sf_dir).withColumn("completeness", _class()), CENTRE, 50).select("rec_no", "business_name", "distance_km", "location_match_score", "completeness")


for _c in ("city", "category"):
    QUERIES[f"facet_{_c}"] = functools.partial(lambda c, spark, sf_dir: ranking.facet(places(spark, sf_dir), C(c)), _c)
    ORACLE[f"facet_{_c}"] = f"WITH {o.PLACES} SELECT DISTINCT {_c} AS value FROM places WHERE {_c} <> ''"


@query("facet_area", f"WITH {o.PLACES} SELECT DISTINCT {o.area("(area || ' ' || substr(city, 8))")} AS value FROM places")
def facet_area(spark, sf_dir):
    return ranking.facet(places(spark, sf_dir), text.area_canonical(F.concat(C("area"), F.lit(" "), F.substr("city", F.lit(8)))))


@query("view_kpis", f"WITH {o.PLACES}, c AS (SELECT {_CLASS} AS k FROM places) SELECT count(*) AS total, count(*) FILTER (WHERE k = 'FULL') AS full, count(*) FILTER (WHERE k = 'PARTIAL') AS partial, count(*) FILTER (WHERE k NOT IN ('FULL', 'PARTIAL')) AS name_only, floor(count(*) FILTER (WHERE k = 'FULL') * 100.0 / greatest(count(*), 1) + 0.5)::BIGINT AS quality_pct FROM c")
def view_kpis(spark, sf_dir):
    return ranking.view_kpis(places(spark, sf_dir).withColumn("data_completeness", _class()))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS {c}" for k, c in (("FULL", "\"full\""), ("PARTIAL", "partial"), ("NAME_ONLY", "name_only")))


@query("search_stats", f"WITH {o.PLACES}, c AS (SELECT {_CLASS} AS k FROM places) SELECT count(*) AS final, {_COUNTS}, 7::BIGINT AS zones, 28::BIGINT AS queries, 40::BIGINT AS removed, 63::BIGINT AS requests, CASE WHEN count(*) >= 250 THEN 'COMPLETED' ELSE 'LIMIT_REACHED' END AS status FROM c")
def search_stats(spark, sf_dir):
    return ranking.search_stats(places(spark, sf_dir).withColumn("data_completeness", _class()), 250, 7, 28, 40, 63)


@query("view_page_count", f"WITH {o.PLACES} SELECT greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM places WHERE rating >= 3")
def view_page_count(spark, sf_dir):
    return ranking.page_count(ranking.view_filter(places(spark, sf_dir), min_rating=3), 20)


@query("geo_bounds", f"WITH {o.PLACES} SELECT count(*) AS n, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, CASE WHEN count(*) = 1 THEN 15 END AS zoom, count(*) >= 50 AS clustered FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def geo_bounds(spark, sf_dir):
    return ranking.geo_bounds(places(spark, sf_dir))


# ------------------------------------------------------------------ entity resolution
@query("dedup_place_key", f"WITH {o.PLACES} SELECT min(rec_no) AS rec_no FROM places GROUP BY CASE WHEN place_id <> '' THEN 'id|' || place_id ELSE 'na|' || coalesce(business_name, '') || '|' || coalesce(address, '') END")
def dedup_place_key(spark, sf_dir):
    return dedup.dedup_in_flight(places(spark, sf_dir)).select("rec_no")


def _plain(x):
    return f"coalesce({o.sub(f'lower({x})', '[^a-z0-9]')}, '')"


_KEYS = [_plain("business_name"), _plain(o.phone("phone")), _plain(o.domain("website")), _plain("address")]


@query("dedup_simple", f"WITH {o.PLACES}, a AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY rec_no) AS rn FROM places), b AS (SELECT * FROM a WHERE place_id IS NULL OR rn = 1), c AS (SELECT rec_no, {', '.join(f'{k} AS k{i}' for i, k in enumerate(_KEYS))} FROM b) SELECT min(rec_no) AS rec_no FROM c GROUP BY k0, k1, k2, k3")
def dedup_simple(spark, sf_dir):
    return dedup.dedup_simple(places(spark, sf_dir)).select("rec_no")


@query("dedup_exact", f"WITH RECURSIVE {o.EXACT} SELECT rec_no FROM exact")
def dedup_exact(spark, sf_dir):
    return dedup.dedup_exact(places(spark, sf_dir)).select("rec_no")


@query("block_city_counts", f"WITH {o.PLACES} SELECT lower(trim(city)) AS city_key, count(*) AS n FROM places GROUP BY 1")
def block_city_counts(spark, sf_dir):
    return dedup.city_counts(places(spark, sf_dir).select(F.lower(F.trim("city")).alias("city_key")))


def _prepared(spark, sf_dir):
    return dedup.prepare(fuzzy_places(spark, sf_dir))


def _scores(spark, sf_dir):
    """All pairs that share a phone or website or lie at most 150 m apart."""
    return dedup.contact_scores(materialize(_prepared(spark, sf_dir), "prepared"))


def _edges(spark, sf_dir):
    return dedup.pruned_edges(materialize(_prepared(spark, sf_dir), "prepared"))


@query("block_pairs", o.PARITY_SQL)
def block_pairs(spark, sf_dir):
    """Every pair that shares a phone, website, coarse cell, name key or small city."""
    r = _prepared(spark, sf_dir).select("rec_no", "phones", "websites", "cell", "name_key", "city_key")
    return dedup.block_pairs(materialize(r, "prepared"), "parity").select("i", "j", "key_type")


@query("block_pairs_contact", o.ER + " SELECT i, j, key_type FROM pairs")
def block_pairs_contact(spark, sf_dir):
    return dedup.block_pairs(materialize(_prepared(spark, sf_dir), "prepared"), "contact").select("i", "j", "key_type")


@query("pair_signals", o.ER + " SELECT i, j, name_sim, phone_sim, website_sim, address_sim, geo_score, round(d, 4) AS geo_distance_m, category_sim FROM sc")
def pair_signals(spark, sf_dir):
    return _scores(spark, sf_dir).select("i", "j", "name_sim", "phone_sim", "website_sim", "address_sim", "geo_score", F.round("geo_distance_m", 4).alias("geo_distance_m"), "category_sim")


@query("pair_scores", o.ER + " SELECT i, j, score FROM sc")
def pair_scores(spark, sf_dir):
    return dedup.contact_verdicts(materialize(_prepared(spark, sf_dir), "prepared"))


@query("branch_conflict", o.ER + " SELECT i, j, cap::DOUBLE AS cap FROM sc WHERE cap IS NOT NULL")
def branch_conflict(spark, sf_dir):
    return dedup.contact_verdicts(materialize(_prepared(spark, sf_dir), "prepared"), caps=True)


_REASONS = """array_to_string(list_filter([CASE WHEN phone_sim = 1 THEN 'Same phone number' END, CASE WHEN website_sim = 1 THEN 'Same website domain' END, CASE WHEN name_sim >= 90 THEN 'Name similarity ' || name_sim::INTEGER || '%' END,
 CASE WHEN d <= 50 THEN floor(d + 0.5)::BIGINT || 'm geographic distance' END, CASE WHEN address_sim >= 80 THEN 'Address similarity ' || address_sim::INTEGER || '%' END, CASE WHEN category_sim >= 80 THEN 'Same category' END, CASE WHEN other_city THEN 'Different cities' END,
 CASE WHEN cap IS NOT NULL THEN 'Same brand, different branch locations' END, CASE WHEN by_phone THEN 'Strong phone + name + location match' END, CASE WHEN by_web THEN 'Strong website + name + address match' END,
 CASE WHEN by_place THEN 'Very close coordinates + similar name + same category' END], lambda x: x IS NOT NULL), '; ')"""


@query("pair_reasons", o.ER + f" SELECT i, j, {_REASONS} AS reasons FROM sc")
def pair_reasons(spark, sf_dir):
    return _scores(spark, sf_dir).select("i", "j", F.array_join("reasons", "; ").alias("reasons"))


@query("pair_decision", o.ER + " SELECT i, j, score, CASE WHEN score >= 60 THEN 'MERGED' ELSE 'KEEP_SEPARATE' END AS decision FROM sc")
def pair_decision(spark, sf_dir):
    return dedup.pair_decision(dedup.contact_verdicts(materialize(_prepared(spark, sf_dir), "prepared")))


@query("dup_edges", o.ER + " SELECT i, j, score FROM e")
def dup_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("i", "j", "score")


@query("dup_components", o.ER + " SELECT node, component FROM comp")
def dup_components(spark, sf_dir):
    return dedup.connected(dedup.forest(_edges(spark, sf_dir).select(C("i").alias("a"), C("j").alias("b"))))


def _resolved(spark, sf_dir):
    return dedup.smart_dedup(fuzzy_places(spark, sf_dir), exact=False)


@query("dup_master", o.ER + " SELECT group_id, master, master_quality FROM grp")
def dup_master(spark, sf_dir):
    return _resolved(spark, sf_dir)["groups"].select("group_id", "master", "master_quality")


_RECORD = ["place_id", "business_name", "category", "address", "area", "city", "province", "phone", "website"]


def _merged_sql() -> str:
    """Survivorship of every column: the master's value, else the first in member order."""
    first = ", ".join(f"arg_min({c}, k) FILTER ({c} <> '') AS {c}" for c in _RECORD)
    pair = ", ".join(f"arg_min({c}, k) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS {c}" for c in ("latitude", "longitude"))
    union = lambda c: f"list_filter(list({c} ORDER BY k), lambda x: x IS NOT NULL)"
    once = lambda c: f"array_to_string(list_filter({union(c)}, lambda x, i: list_position({union(c)}, x) = i), '|')"
    filled = o.points(*[(o.truthy(c), 1) for c in ("business_name", "phone", "website", "address", "area", "city", "place_id", "category")], ("latitude IS NOT NULL", 1), ("rating IS NOT NULL", 1), ("review_count IS NOT NULL", 1))
    return f""", ranked AS (
  SELECT m.*, g.group_id, g.master, g.group_score, g.n_members, g.master_quality, {o.phone('m.phone')} AS ph, {o.canonical('m.website')} AS web, row_number() OVER (PARTITION BY m.component ORDER BY m.rec_no <> g.master, m.rec_no) AS k
  FROM mem m JOIN grp g USING (component)
), merged0 AS (
  SELECT group_id, any_value(component) AS component, any_value(master) AS rec_no, any_value(n_members) AS merged_record_count, array_to_string(list_sort(list(rec_no)), ',') AS merged_from, {first.replace("FILTER (", "FILTER (WHERE ")}, {pair.replace("FILTER (", "FILTER (WHERE ")},
    max(rating) AS rating, max(review_count) AS review_count, {once('ph')} AS phones, {once('web')} AS websites, any_value(group_score) AS duplicate_score, any_value(master_quality) AS master_quality FROM ranked GROUP BY group_id
), merged AS (
  SELECT * REPLACE (coalesce(phone, nullif(string_split(phones, '|')[1], '')) AS phone, coalesce(website, nullif(string_split(websites, '|')[1], '')) AS website),
    floor(round(0.6 * duplicate_score + 0.4 * master_quality, 9) + 0.5)::BIGINT AS confidence FROM merged0
), done AS (SELECT *, floor({filled}::DOUBLE / 11 * 100 + 0.5)::BIGINT AS completeness_pct FROM merged)"""


_GROUP_REASONS = """, said AS (
  SELECT component, reason, min((key_type, i, j, pos)) AS earliest FROM (
    SELECT c.component, s.key_type, s.i, s.j, unnest(string_split(s.reasons, '; ')) AS reason, generate_subscripts(string_split(s.reasons, '; '), 1) AS pos FROM (SELECT i, j, key_type, {} AS reasons FROM sc WHERE score >= 60) s JOIN comp c ON c.node = s.i WHERE s.reasons <> ''
  ) GROUP BY component, reason
), reasons AS (SELECT component, string_agg(reason, '; ' ORDER BY earliest) AS reasons FROM said GROUP BY component)""".format(_REASONS)
_MERGED_COLS = ["group_id", "rec_no", "merged_record_count", "merged_from", *_RECORD, "latitude", "longitude", "rating", "review_count", "phones", "websites", "duplicate_score", "deduplication_reason", "completeness_pct", "confidence"]


@query("dup_merged", o.ER + _merged_sql() + _GROUP_REASONS + f" SELECT {', '.join('coalesce(reasons, chr(45)) AS deduplication_reason' if c == 'deduplication_reason' else c for c in _MERGED_COLS)} FROM done LEFT JOIN reasons USING (component)")
def dup_merged(spark, sf_dir):
    m = _resolved(spark, sf_dir)["merged"]
    m = m.withColumns({"merged_from": F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ","), **{c: F.array_join(c, "|") for c in ("phones", "websites")}})
    return m.withColumn("deduplication_reason", F.coalesce(F.nullif(F.array_join("deduplication_reason", "; "), F.lit("")), F.lit("-"))).select(*_MERGED_COLS)


_UNIQUE = ", uniq AS (SELECT master AS rec_no, true AS from_group FROM grp UNION ALL SELECT rec_no, false FROM fuzzy WHERE rec_no NOT IN (SELECT node FROM comp))"


@query("dup_groups", o.ER + _GROUP_REASONS + " SELECT group_id, n_members, group_score, coalesce(reasons, chr(45)) AS reasons FROM grp LEFT JOIN reasons USING (component)")
def dup_groups(spark, sf_dir):
    g = _resolved(spark, sf_dir)["groups"]
    return g.select("group_id", "n_members", "group_score", F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("-")).alias("reasons"))


@query("dedup_unique", o.ER + _UNIQUE + " SELECT rec_no, from_group FROM uniq")
def dedup_unique(spark, sf_dir):
    return _resolved(spark, sf_dir)["unique"].select("rec_no", "from_group")


@query("dedup_stats", o.ER + _UNIQUE + ' SELECT (SELECT count(*) FROM fuzzy) AS raw, (SELECT count(*) FROM uniq) AS "unique", (SELECT count(*) FROM fuzzy) - (SELECT count(*) FROM uniq) AS removed, (SELECT count(*) FROM grp) AS groups')
def dedup_stats(spark, sf_dir):
    return _resolved(spark, sf_dir)["stats"]


_UNIQUE_COLS = ["rec_no", *_RECORD, "latitude", "longitude", "rating", "review_count"]


@query("smart_dedup", o.er("exact", o.EXACT) + _merged_sql() + f" SELECT {', '.join(_UNIQUE_COLS)}, true AS from_group FROM done UNION ALL SELECT {', '.join(_UNIQUE_COLS)}, false FROM exact WHERE rec_no NOT IN (SELECT node FROM comp)")
def smart_dedup(spark, sf_dir):
    return dedup.smart_dedup(places(spark, sf_dir))["unique"].select(*_UNIQUE_COLS, "from_group")


_LEGACY = f"""WITH {o.PLACES}, l AS (
  SELECT rec_no, {o.phone_legacy('phone')} AS ph, {o.website_legacy('website')} AS web, {o.name_clean('business_name')} AS nm, lower(trim(city)) AS ct, lower(trim(address)) AS ad FROM places
) SELECT a.rec_no AS i, b.rec_no AS j FROM l a JOIN l b ON a.rec_no < b.rec_no
WHERE coalesce(a.ph = b.ph, false) OR coalesce(a.web = b.web, false)
  OR coalesce(a.nm = b.nm AND a.ct = b.ct AND (contains(a.ad, b.ad) OR contains(b.ad, a.ad) OR coalesce(a.ad, '') = '' OR coalesce(b.ad, '') = ''), false)"""


@query("legacy_is_duplicate", _LEGACY)
def legacy_is_duplicate(spark, sf_dir):
    return dedup.legacy_pairs(places(spark, sf_dir))


# ------------------------------------------------------------------ plans
@query("geo_grid", f"WITH {o.PLACES}, c AS (SELECT rec_no AS id, latitude, longitude, CASE rec_no % 4 WHEN 0 THEN 40 WHEN 1 THEN 100 WHEN 2 THEN 250 ELSE 400 END AS target FROM places WHERE latitude IS NOT NULL), n AS (SELECT *, CASE WHEN target <= 50 THEN 2 WHEN target <= 150 THEN 3 WHEN target <= 300 THEN 4 ELSE 5 END AS n, CASE WHEN target <= 50 THEN 5.0 WHEN target <= 150 THEN 10.0 WHEN target <= 300 THEN 15.0 ELSE 20.0 END::DOUBLE AS km0 FROM c), g AS (SELECT *, km0 * 2 / n AS km, r.range AS r, k.range AS k FROM n, range(5) r, range(5) k WHERE r.range < n AND k.range < n) SELECT id, floor((latitude + (r - n / 2.0::DOUBLE + 0.5) * km / 111.0::DOUBLE) * 10000 + 0.5) / 10000 AS cell_lat, floor((longitude + (k - n / 2.0::DOUBLE + 0.5) * km / (111.0::DOUBLE * cos(latitude * pi() / 180))) * 10000 + 0.5) / 10000 AS cell_lng, 'Grid ' || chr((65 + r)::INTEGER) || (k + 1) AS label, greatest(1500.0, least(5000.0, km * 500))::DOUBLE AS radius_m FROM g")
def geo_grid(spark, sf_dir):
    t = F.when(C("rec_no") % 4 == 0, 40).when(C("rec_no") % 4 == 1, 100).when(C("rec_no") % 4 == 2, 250).otherwise(400)
    return planner.geo_grid(places(spark, sf_dir).select(C("rec_no").alias("id"), "latitude", "longitude", t.alias("target")))


_ZONES = "z(city_key, zone_ord, zone) AS (VALUES " + ", ".join(f"('{c}', {i}, '{z}')" for c, zs in planner.ZONES.items() for i, z in enumerate(zs, 1)) + "), rq AS (SELECT rec_no, category, (['Lahore', 'Karachi', 'Islamabad', 'Multan'])[(rec_no % 4 + 1)::INTEGER] AS city, (rec_no % 5) * 50 AS target FROM places)"
_ZPLAN = f"WITH {o.PLACES}, {_ZONES}, zp AS (SELECT rq.*, zone_ord, zone FROM rq JOIN z ON city_key = lower(city) WHERE zone_ord <= CASE WHEN target <= 50 THEN 6 WHEN target <= 100 THEN 12 WHEN target <= 200 THEN 20 ELSE 1000000 END) "


def _zone_plan(spark, sf_dir):
    city = F.element_at(F.array(*[F.lit(x) for x in ("Lahore", "Karachi", "Islamabad", "Multan")]), (C("rec_no") % 4 + 1).cast("int"))
    return planner.zone_plan(places(spark, sf_dir).select("rec_no", "category", city.alias("city"), (C("rec_no") % 5 * 50).alias("target")), planner.zones(spark))


@query("zone_plan", _ZPLAN + "SELECT rec_no, city, zone_ord, zone FROM zp")
def zone_plan(spark, sf_dir):
    return _zone_plan(spark, sf_dir).select("rec_no", "city", "zone_ord", "zone")


@query("zone_queries", _ZPLAN + "SELECT rec_no, zone, unnest([category || ' in ' || zone || ', ' || city || ', Pakistan', CASE WHEN ends_with(category, 's') THEN category ELSE category || 's' END || ' near ' || zone || ' ' || city, 'best ' || category || ' ' || zone || ' ' || city, category || ' near ' || zone]) AS query FROM zp")
def zone_queries(spark, sf_dir):
    return planner.zone_queries(_zone_plan(spark, sf_dir)).select("rec_no", "zone", "query")


@query("query_dedup", f"WITH {o.PLACES} SELECT min(rec_no) AS ord, arg_min(business_name, rec_no) AS query FROM places GROUP BY lower(trim(business_name))")
def query_dedup(spark, sf_dir):
    return planner.query_dedup(places(spark, sf_dir).select(C("rec_no").alias("ord"), C("business_name").alias("query")))


@query("registry_lookup", "WITH r AS (SELECT c_custkey AS id, '  ' || upper(n_name) AS location FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT id, n.n_name AS reg_district, g.r_name AS reg_province FROM r LEFT JOIN nation n ON lower(trim(n.n_name)) = lower(trim(r.location)) AND n.n_nationkey < 20 LEFT JOIN region g ON g.r_regionkey = n.n_regionkey")
def registry_lookup(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = t("customer").join(t("nation"), C("c_nationkey") == C("n_nationkey")).select(C("c_custkey").alias("id"), F.concat(F.lit("  "), F.upper("n_name")).alias("location"))
    registry = t("nation").where("n_nationkey < 20").join(t("region"), C("n_regionkey") == C("r_regionkey")).select(C("n_name").alias("name"), C("n_name").alias("district"), C("r_name").alias("province"))
    return planner.enrich_table(rows, registry).select("id", "reg_district", "reg_province")


# ------------------------------------------------------------------ store
_SN = "st AS (SELECT * FROM places WHERE rec_no % 2 = 0), nw AS (SELECT * FROM places WHERE rec_no % 2 = 1)"
_MATCH = f"WITH {o.PLACES}, {_SN}, m AS (SELECT n.rec_no AS new_no, s.rec_no AS stored_no, CASE WHEN n.phone <> '' AND n.phone = s.phone THEN 1 WHEN n.website <> '' AND n.website = s.website THEN 2 ELSE 3 END AS rule FROM nw n JOIN st s ON (n.phone <> '' AND n.phone = s.phone) OR (n.website <> '' AND n.website = s.website) OR (n.business_name = s.business_name AND n.city = s.city)), best AS (SELECT new_no, arg_min(stored_no, rule * 10000000 + stored_no) AS stored_no, min(rule) AS rule FROM m GROUP BY new_no) "


@query("upsert_match", _MATCH + "SELECT new_no, stored_no, rule FROM best")
def upsert_match(spark, sf_dir):
    p = places(spark, sf_dir)
    return store.upsert_match(p.where("rec_no % 2 = 0"), p.where("rec_no % 2 = 1"))


_UPSERT = _MATCH.replace("WITH ", "WITH RECURSIVE ", 1) + """, lf AS (
  SELECT *, row_number() OVER (ORDER BY rec_no) AS n, nullif(phone, '') AS kp, nullif(website, '') AS kw, business_name || chr(1) || city AS kn FROM nw WHERE rec_no NOT IN (SELECT new_no FROM best)
), replay(n, ps, ws, ns, kept) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], NULL::BIGINT
  UNION ALL
  SELECT n, CASE WHEN ok AND kp IS NOT NULL THEN list_append(ps, kp) ELSE ps END, CASE WHEN ok AND kw IS NOT NULL THEN list_append(ws, kw) ELSE ws END, CASE WHEN ok AND kn IS NOT NULL THEN list_append(ns, kn) ELSE ns END, CASE WHEN ok THEN rec_no END
  FROM (SELECT l.n, l.rec_no, l.kp, l.kw, l.kn, r.ps, r.ws, r.ns, NOT coalesce(list_contains(r.ps, l.kp), false) AND NOT coalesce(list_contains(r.ws, l.kw), false) AND NOT coalesce(list_contains(r.ns, l.kn), false) AS ok
    FROM replay r JOIN lf l ON l.n = r.n + 1)
), fr AS (SELECT * FROM lf WHERE rec_no IN (SELECT kept FROM replay WHERE kept IS NOT NULL)
), am AS (
  SELECT l.rec_no AS new_no, s.rec_no AS target, CASE WHEN l.kp = s.kp THEN 1 WHEN l.kw = s.kw THEN 2 ELSE 3 END AS rule FROM lf l JOIN fr s ON l.rec_no NOT IN (SELECT rec_no FROM fr) AND (l.kp = s.kp OR l.kw = s.kw OR l.kn = s.kn)
), tg AS (SELECT new_no, stored_no AS target FROM best UNION ALL SELECT new_no, arg_min(target, rule * 10000000 + target) FROM am GROUP BY new_no
), lt AS (
  SELECT target, arg_max(rating, new_no) FILTER (WHERE rating IS NOT NULL) AS rating, arg_max(phone, new_no) FILTER (WHERE phone IS NOT NULL) AS phone, arg_max(website, new_no) FILTER (WHERE website IS NOT NULL) AS website,
    arg_max(address, new_no) FILTER (WHERE address IS NOT NULL) AS address FROM tg JOIN nw ON nw.rec_no = new_no GROUP BY target
), al AS (SELECT rec_no, rating, phone, website, address FROM st UNION ALL SELECT rec_no, rating, phone, website, address FROM fr)
SELECT al.rec_no, coalesce(lt.rating, al.rating) AS rating, coalesce(lt.phone, al.phone) AS phone, coalesce(lt.website, al.website) AS website, coalesce(lt.address, al.address) AS address FROM al LEFT JOIN lt ON lt.target = al.rec_no"""


def _batch(spark, sf_dir):
    """Every second place as stored rows, the others as a batch; contacts are rarer than in the table, so that rows are inserted and meet one another."""
    p = places(spark, sf_dir)
    return p.where("rec_no % 2 = 0 and rec_no % 5 > 1"), p.where("rec_no % 2 = 1 or rec_no % 5 < 2")


@query("upsert_result", _UPSERT.replace("st AS (SELECT * FROM places WHERE rec_no % 2 = 0), nw AS (SELECT * FROM places WHERE rec_no % 2 = 1)", "st AS (SELECT * FROM places WHERE rec_no % 2 = 0 AND rec_no % 5 > 1), nw AS (SELECT * FROM places WHERE rec_no % 2 = 1 OR rec_no % 5 < 2)"))
def upsert_result(spark, sf_dir):
    stored, new = (materialize(x, "upsert") for x in _batch(spark, sf_dir))
    return store.upsert(stored, new).select("rec_no", "rating", "phone", "website", "address")


@query("upsert_match_any", f"""WITH {o.PLACES}, {_SN} SELECT n.rec_no AS new_no, min(s.rec_no) AS stored_no FROM nw n JOIN st s
  ON (n.phone <> '' AND n.phone = s.phone) OR (n.website <> '' AND n.website = s.website) OR (lower(n.business_name) = lower(s.business_name) AND lower(n.city) = lower(s.city)) GROUP BY n.rec_no""")
def upsert_match_any(spark, sf_dir):
    p = places(spark, sf_dir)
    return store.upsert_match_any(p.where("rec_no % 2 = 0"), p.where("rec_no % 2 = 1"))


@query("link_insert", "SELECT DISTINCT l_suppkey AS job_id, l_partkey AS business_id FROM lineitem")
def link_insert(spark, sf_dir):
    links = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(C("l_suppkey").alias("job_id"), C("l_partkey").alias("business_id"), "l_linenumber")
    old = links.where("l_linenumber = 1").drop("l_linenumber").distinct()
    return store.link_once(old, links.where("l_linenumber > 1").drop("l_linenumber"))


@query("job_totals", "SELECT s_suppkey AS job_id, n AS total_results FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_suppkey = s_suppkey")
def job_totals(spark, sf_dir):
    jobs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(C("s_suppkey").alias("job_id"))
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 1").select(C("l_suppkey").alias("job_id"))
    return store.with_totals(jobs, done)


def _jobs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(C("o_orderkey").alias("job_id"), F.when(C("o_custkey") % 3 > 0, C("o_custkey")).alias("user_id"), C("o_orderdate").alias("created_at"), C("o_orderstatus").alias("status"))


_JOBS = "WITH jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS user_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders) "


@query("job_history", _JOBS + "SELECT job_id, created_at FROM jobs WHERE user_id = 7")
def job_history(spark, sf_dir):
    return store.job_history(_jobs(spark, sf_dir), F.lit(7)).select("job_id", "created_at")


@query("job_lookup", _JOBS + "SELECT * FROM jobs WHERE job_id = 33")
def job_lookup(spark, sf_dir):
    return _jobs(spark, sf_dir).where("job_id = 33")


@query("job_visible", _JOBS + "SELECT job_id, user_id FROM jobs WHERE user_id IS NULL OR user_id = 7")
def job_visible(spark, sf_dir):
    return store.job_visible(_jobs(spark, sf_dir), 7).select("job_id", "user_id")


@query("job_results_join", "SELECT p_partkey AS business_id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 5)")
def job_results_join(spark, sf_dir):
    links = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(C("l_suppkey").alias("job_id"), C("l_partkey").alias("business_id"))
    return store.job_results(spark.read.parquet(f"{sf_dir}/part.parquet").select(C("p_partkey").alias("business_id"), "p_name"), links, 5)


# ------------------------------------------------------------------ exports
_STORED = f"""{o.PLACES}, st0 AS (
  SELECT *, row_number() OVER (ORDER BY rec_no) AS row_no, coalesce(business_name, '') || '"' AS n, 'Pakistan' AS country, {o.national('phone')} AS phone_national, 'https://maps.example.com/' || rec_no AS maps_url,
    CASE WHEN rec_no % 3 = 0 THEN 'OPERATIONAL' END AS business_status, {_CLASS} AS data_completeness, 'places' AS source FROM places
), stored AS (
  SELECT row_no, n AS business_name, coalesce(category, '') AS category, coalesce(address, '') AS address, coalesce(area, '') AS area, coalesce(city, '') AS city, country, coalesce(phone, '') AS phone,
    coalesce(phone_national, '') AS phone_national, '' AS email, coalesce(website, '') AS website, {o.shown('rating')} AS rating, {o.shown('review_count')} AS review_count, coalesce(business_status, '') AS business_status,
    maps_url, '' AS price, '' AS opening_hours, data_completeness, source, {o.shown('latitude')} AS latitude, {o.shown('longitude')} AS longitude FROM st0
)"""


def _stored(spark, sf_dir):
    p = places(spark, sf_dir).withColumns({
        "business_name": F.concat("business_name", F.lit('"')), "country": F.lit("Pakistan"), "phone_national": contact.phone_national(C("phone")),
        "maps_url": F.concat(F.lit("https://maps.example.com/"), C("rec_no").cast("string")), "business_status": F.when(C("rec_no") % 3 == 0, "OPERATIONAL"),
        "data_completeness": quality.completeness_class(F.concat("business_name", F.lit('"')), *[C(c) for c in ("phone", "website", "address", "latitude", "longitude")]), "source": F.lit("places"),
    })
    return ranking.numbered(p)


def _csv(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[,\"\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


_CSV = ["business_name", "category", "address", "area", "city", "country", "phone", "phone_national", "email", "website", "maps_url", "rating", "review_count", "business_status", "price", "opening_hours", "data_completeness", "source", "latitude", "longitude"]


@query("export_csv_rows", f"WITH {_STORED} SELECT row_no, row_no || ',' || {chr(10).join((' || chr(44) || ' if i else '') + _csv(c) for i, c in enumerate(_CSV))} AS line FROM stored")
def export_csv_rows(spark, sf_dir):
    return export.csv_rows(_stored(spark, sf_dir))


@query("export_rows_legacy", f"WITH {_STORED} SELECT * FROM stored")
def export_rows_legacy(spark, sf_dir):
    return export.legacy_rows(_stored(spark, sf_dir))


@query("export_table_rows", f"WITH {_STORED} SELECT row_no, business_name, category, city, phone, website, CASE WHEN rating = '' THEN '-' ELSE rating END AS rating, CASE WHEN review_count = '' THEN '-' ELSE review_count END AS review_count, address, maps_url FROM stored")
def export_table_rows(spark, sf_dir):
    return export.table_rows(_stored(spark, sf_dir))


@query("export_records", f"WITH {o.PLACES} SELECT rec_no, business_name, category, address, area, city, phone, website, place_id, city AS district, 'Pakistan' AS country, latitude, rating FROM places")
def export_records(spark, sf_dir):
    return export.to_export(places(spark, sf_dir)).select("rec_no", "business_name", "category", "address", "area", "city", "phone", "website", "place_id", "district", "country", "latitude", "rating")


def _address_sql(p: str = "") -> str:
    """Parts in order, each only where no earlier one that was added contains it: the records' addresses hold area, city and province."""
    a, r, c, v = (f"coalesce({p}{x}, '')" for x in ("address", "area", "city", "province"))
    step = lambda acc, x: f"CASE WHEN {x} = '' OR len(list_filter({acc}, lambda y: contains(lower(y), lower({x})))) > 0 THEN {acc} ELSE list_append({acc}, {x}) END"
    return f"array_to_string(list_reduce([[{r}], [{c}], [{v}], ['Pakistan']], lambda acc, x: {step('acc', 'x[1]')}, CASE WHEN {a} = '' THEN []::VARCHAR[] ELSE [{a}] END), ', ')"


_BUSINESS = ["row_no", "business_name", "category", "full_address", "address", "area", "city", "district", "province", "phone", "more_phones", "website", "more_websites", "rating", "review_count", "latitude", "longitude", "completeness", "confidence", "group_id", "merged_records"]
_MORE = "array_to_string(list_filter(string_split({0}, '|'), lambda x: x <> '' AND x IS DISTINCT FROM {1}), ', ')"
_SHEET = f"""{_merged_sql()}, every AS (
  SELECT rec_no, business_name, category, address, area, city, province, phone, phones, website, websites, rating, review_count, latitude, longitude, completeness_pct, confidence, group_id, merged_record_count FROM done
  UNION ALL SELECT rec_no, business_name, category, address, area, city, province, phone, coalesce({o.phone('phone')}, ''), website, coalesce({o.canonical('website')}, ''), rating, review_count, latitude, longitude, NULL, NULL, NULL, NULL FROM fuzzy WHERE rec_no NOT IN (SELECT node FROM comp)
) SELECT row_number() OVER (ORDER BY rec_no) AS row_no, coalesce(business_name, '') AS business_name, coalesce(category, '') AS category, {_address_sql()} AS full_address, coalesce(address, '') AS address, coalesce(area, '') AS area,
  coalesce(city, '') AS city, '' AS district, coalesce(province, '') AS province, coalesce(phone, '') AS phone, {_MORE.format('phones', 'phone')} AS more_phones, coalesce(website, '') AS website, {_MORE.format('websites', 'website')} AS more_websites,
  {", ".join(f"coalesce({o.num(c)}, '') AS {c}" for c in ("rating", "review_count", "latitude", "longitude"))}, coalesce(completeness_pct || '%', '') AS completeness, coalesce(confidence || '%', '') AS confidence, coalesce(group_id, '') AS group_id,
  coalesce(merged_record_count::VARCHAR, '') AS merged_records FROM every"""


@query("export_businesses", o.ER + _SHEET)
def export_businesses(spark, sf_dir):
    x = _resolved(spark, sf_dir)
    alone = x["rows"].join(x["members"].select("rec_no"), "rec_no", "left_anti")
    alone = alone.withColumns({"phones": contact.phones_all(C("phone")), "websites": contact.websites_all(C("website"))})
    every = x["merged"].unionByName(alone, allowMissingColumns=True).withColumn("country", F.lit("Pakistan"))
    return export.business_rows(ranking.numbered(every)).select(*_BUSINESS)


@query("export_report_rows", f"WITH {o.PLACES} SELECT row_number() OVER (ORDER BY rec_no) AS row_no, business_name, coalesce(category, '') AS category, {_address_sql()} AS full_address, coalesce(phone, '') AS phone, coalesce(website, '') AS website, coalesce(printf('%.1f', rating), '-') AS rating FROM places")
def export_report_rows(spark, sf_dir):
    return export.report_rows(ranking.numbered(places(spark, sf_dir)).withColumn("country", F.lit("Pakistan")))


_GROUP_SHEET = " SELECT group_id, f.business_name AS master_business, {} AS merged_records, {} AS score, coalesce(reasons, '') AS reason FROM grp LEFT JOIN reasons USING (component) JOIN fuzzy f ON f.rec_no = master WHERE component IN (SELECT component FROM mem WHERE rating >= 4)"


def _relevant(spark, sf_dir):
    x = _resolved(spark, sf_dir)
    return export.relevant_groups(x["groups"], x["members"], x["members"].where("rating >= 4")), x["members"]


@query("export_groups", o.ER + _GROUP_REASONS + _GROUP_SHEET.format("n_members::VARCHAR", o.num("group_score")))
def export_groups(spark, sf_dir):
    return export.group_rows(*_relevant(spark, sf_dir))


@query("export_report_groups", o.ER + _GROUP_REASONS + _GROUP_SHEET.format("n_members || ' records'", "group_score::BIGINT || '%'"))
def export_report_groups(spark, sf_dir):
    return export.group_rows(*_relevant(spark, sf_dir), report=True)


@query("export_merged", o.ER + _GROUP_REASONS + f""" SELECT g.group_id, m.rec_no, f.business_name AS master_business, coalesce(m.business_name, '') AS business_name, {_address_sql('m.')} AS full_address, coalesce(m.address, '') AS address, coalesce(m.phone, '') AS phone,
 coalesce(m.website, '') AS website, coalesce(m.category, '') AS category, coalesce({o.num('m.latitude')}, '') AS latitude, coalesce({o.num('m.longitude')}, '') AS longitude, {o.num('g.group_score')} AS score, coalesce(r.reasons, '') AS reason, 'places' AS source
 FROM mem m JOIN grp g USING (component) LEFT JOIN reasons r USING (component) JOIN fuzzy f ON f.rec_no = g.master""")
def export_merged(spark, sf_dir):
    x = _resolved(spark, sf_dir)
    return export.merged_rows(x["groups"], x["members"].withColumns({"source": F.lit("places"), "country": F.lit("Pakistan")}))


@query("export_pdf_detail", o.ER + f""", top AS (SELECT component, group_id FROM grp ORDER BY length(group_id), group_id LIMIT 50)
SELECT group_id, (row_number() OVER (PARTITION BY group_id ORDER BY m.rec_no))::INTEGER AS no, coalesce(business_name, '') AS business_name, {_address_sql()} AS full_address, coalesce(phone, '') AS phone, coalesce(website, '') AS website, coalesce(area, '') AS area,
 coalesce(printf('%.5f', latitude), '') AS latitude, coalesce(printf('%.5f', longitude), '') AS longitude FROM mem m JOIN top USING (component)""")
def export_pdf_detail(spark, sf_dir):
    x = _resolved(spark, sf_dir)
    return export.pdf_detail(x["groups"], x["members"].withColumn("country", F.lit("Pakistan")))


@query("export_summary", f"WITH {o.PLACES}, u AS (SELECT min(rec_no) AS rec_no FROM places GROUP BY CASE WHEN place_id <> '' THEN 'id|' || place_id ELSE 'na|' || coalesce(business_name, '') || '|' || coalesce(address, '') END), r AS (SELECT count(*) AS raw FROM places) SELECT raw, raw - count(*) AS removed, count(*) AS \"unique\", count(*) FILTER (WHERE rating >= 4) AS filtered, 'Rating 4+' AS filters FROM places JOIN u USING (rec_no), r GROUP BY raw")
def export_summary(spark, sf_dir):
    p = places(spark, sf_dir)
    unique = dedup.dedup_in_flight(p)
    return export.summary(p.agg(F.count("*").alias("raw")), unique, ranking.view_filter(unique, min_rating=4), ["Rating 4+"])


# ------------------------------------------------------------------ adaptive and streaming
@query("adaptive_stop", "WITH b0 AS (SELECT event_id // 500 AS batch_no, user_id FROM events), f AS (SELECT user_id, min(batch_no) AS batch_no FROM b0 GROUP BY 1), n AS (SELECT batch_no, count(*) AS new FROM f GROUP BY 1), b AS (SELECT b0.batch_no, count(*) AS raw, coalesce(any_value(n.new), 0) AS new FROM b0 LEFT JOIN n USING (batch_no) GROUP BY 1), c AS (SELECT *, sum(new) OVER (ORDER BY batch_no)::BIGINT AS total_unique, row_number() OVER (ORDER BY batch_no) AS no FROM b), d AS (SELECT *, CASE WHEN no > 1 AND new::DOUBLE / raw < 0.02 THEN 1 ELSE 0 END AS low FROM c), e AS (SELECT *, no - max(CASE WHEN low = 0 THEN no ELSE 0 END) OVER (ORDER BY batch_no) AS streak FROM d), g AS (SELECT *, CASE WHEN total_unique >= 5000 THEN 'UNIQUE' WHEN no * 20 >= 250 THEN 'PAGES' WHEN streak >= 3 THEN 'LOW_YIELD' END AS stop FROM e) SELECT batch_no, raw, new, total_unique, stop, coalesce(max(CASE WHEN stop IS NOT NULL THEN 1 ELSE 0 END) OVER (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM g")
def adaptive_stop(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(C("event_id") / 500).alias("batch_no"), "user_id")
    return adaptive.adaptive_stop(e, "user_id", 1000).select("batch_no", "raw", "new", "total_unique", "stop", "ran")


@query("job_payload_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def job_payload_json(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))

