"""Place tables: the schema of raw landings, their projection, and the view derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, quality, text

RAW_SCHEMA = (
    "id string, displayName struct<text:string>, formattedAddress string, types array<string>, googleMapsUri string, nationalPhoneNumber string, internationalPhoneNumber string, "
    "websiteUri string, location struct<latitude:double,longitude:double>, rating double, userRatingCount bigint, businessStatus string, _retrieved_at string, seq bigint, batch_no int, query_no int"
)
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()

#: Portable SQL: the same text runs on Spark and on the oracle.
PLACES_SQL = """
WITH n AS (SELECT count(*) AS np FROM pages), m AS (SELECT count(*) AS nt FROM part),
oc AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey)
SELECT c.c_custkey AS rec_no,
 CASE WHEN c.c_custkey % 10 = 9 THEN NULL ELSE concat('P', lpad(CAST(c.c_custkey - CASE WHEN c.c_custkey % 10 = 4 THEN 1 ELSE 0 END AS STRING), 9, '0')) END AS place_id,
 concat(p.p_name, CASE c.c_custkey % 4 WHEN 1 THEN ' (Pvt) Ltd.' WHEN 2 THEN ' Gulberg' WHEN 3 THEN ' DHA Phase-5' ELSE '' END) AS business_name,
 c.c_mktsegment AS category,
 concat('Shop ', CAST(c.c_custkey % 40 AS STRING), ', Main Rd., Gulberg III, ', na.n_name, ', ', r.r_name, ', Pakistan') AS address,
 'Gulberg III' AS area, na.n_name AS city, r.r_name AS province,
 CASE c.c_custkey % 5 WHEN 0 THEN concat('0300-', lpad(CAST(c.c_custkey % 700 AS STRING), 7, '0')) WHEN 1 THEN concat('+92 300 ', lpad(CAST(c.c_custkey % 700 AS STRING), 7, '0')) WHEN 2 THEN concat('(042) 3', lpad(CAST(c.c_custkey % 700 AS STRING), 7, '0')) WHEN 3 THEN '12345' ELSE NULL END AS phone,
 CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE pg.url END AS website,
 CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(31 AS DOUBLE) + CAST((c.c_custkey * 37) % 997 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude,
 CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(74 AS DOUBLE) + CAST((c.c_custkey * 53) % 997 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS longitude,
 CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE CAST(10 + (c.c_custkey * 13) % 41 AS DOUBLE) / CAST(10 AS DOUBLE) END AS rating,
 oc.c AS review_count
FROM customer c JOIN nation na ON na.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = na.n_regionkey
CROSS JOIN n CROSS JOIN m JOIN part p ON p.p_partkey = c.c_custkey % m.nt JOIN pages pg ON pg.page_id = c.c_custkey % n.np
LEFT JOIN oc ON oc.o_custkey = c.c_custkey
"""
#: The same rows for Spark: the counts are scalars below the joins, so that every join has an equality of its own.  In the text
#: above a filter over columns of several tables, once pushed into the joins, reorders them to products of customers and parts.
_KEYED = """FROM (SELECT x.*, x.c_custkey % (SELECT nullif(nt, 0) FROM m) AS part_no, x.c_custkey % (SELECT nullif(np, 0) FROM n) AS page_no FROM customer x) c
JOIN nation na ON na.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = na.n_regionkey JOIN part p ON p.p_partkey = c.part_no JOIN pages pg ON pg.page_id = c.page_no
LEFT JOIN oc ON oc.o_custkey = c.c_custkey
"""
PLACES_SPARK = PLACES_SQL[: PLACES_SQL.index("FROM customer c")] + _KEYED
#: Places with distinct ids and near-copies of every eighth one.
FUZZY_SQL = """
SELECT rec_no, concat('Q', CAST(rec_no AS STRING)) AS place_id, business_name, category, address, area, city, province, phone, website, latitude, longitude, rating, review_count FROM places
UNION ALL SELECT rec_no + 1000000, concat('Q', CAST(rec_no + 1000000 AS STRING)), concat(substr(business_name, 1, 2), 'x', substr(business_name, 4)), category, address, area, city, province,
 phone, website, latitude + CAST(0.0001 AS DOUBLE), longitude, rating, review_count FROM places WHERE rec_no % 8 = 0
"""


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(PLACES_SPARK)


def fuzzy_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    places(spark, sf_dir).createOrReplaceTempView("places")
    return spark.sql(FUZZY_SQL)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Raw place JSON; malformed records become nulls."""
    return spark.read.schema(RAW_SCHEMA).option("mode", "PERMISSIVE").json(path)


def read_table(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """A stored table: parquet, orc, csv, json (one document for each file with multiLine) or jdbc."""
    return spark.read.format(form).options(**options).load(path) if path else spark.read.format(form).options(**options).load()


def read_json_document(spark: SparkSession, path: str, schema: str, dates: tuple[str, ...] = ()) -> DataFrame:
    """A stored JSON document (an array of rows); one that is broken counts as empty, ISO dates become timestamps."""
    fields = ", ".join(f"{n}: {t}" for n, t in (c.strip().split(" ", 1) for c in schema.split(",")))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{fields}>>")).alias("r")).select("r.*")
    return rows.withColumns({c: F.try_to_timestamp(F.col(c)) for c in dates}) if dates else rows


def project(raw: DataFrame, category: str | None = None, city: str | None = None, district: str | None = None, province: str | None = None, country: str = "Pakistan", normalise: bool = False) -> DataFrame:
    """Raw landing -> place rows; what the plan knows (category, city, ...) comes from the plan."""
    phone = F.coalesce(F.nullif("nationalPhoneNumber", F.lit("")), F.nullif("internationalPhoneNumber", F.lit("")))
    name = F.coalesce(F.nullif(F.col("displayName.text"), F.lit("")), F.lit("Unknown"))
    web = F.col("websiteUri")
    if normalise:
        phone, name, web = contact.phone_norm(phone), contact.text_norm(name), contact.website_norm(web)
    lat, lng, adr = F.col("location.latitude"), F.col("location.longitude"), F.col("formattedAddress")
    lit = lambda v: F.lit(v).cast("string")
    return raw.select(
        F.col("seq").alias("rec_no"), F.col("id").alias("place_id"), name.alias("business_name"), lit(category).alias("category"), adr.alias("address"), text.area_extract(adr).alias("area"),
        lit(city).alias("city"), lit(district).alias("district"), lit(province).alias("province"), lit(country).alias("country"), phone.alias("phone"), contact.phone_national(phone).alias("phone_national"),
        web.alias("website"), F.col("googleMapsUri").alias("maps_url"), lat.alias("latitude"), lng.alias("longitude"), "rating", F.col("userRatingCount").alias("review_count"),
        F.col("businessStatus").alias("business_status"), F.col("_retrieved_at").alias("retrieved_at"), quality.completeness_class(name, phone, web, adr, lat, lng).alias("data_completeness"),
    )


def as_business(p: DataFrame, country: str = "Pakistan") -> DataFrame:
    """Place rows -> business records with ``id``, ``phones`` and ``websites``."""
    own: Column = F.coalesce(F.nullif("place_id", F.lit("")), F.concat(F.lit("record-"), F.col("rec_no").cast("string")))
    return p.select("*", own.alias("id"), F.lit(country).alias("country"), contact.phones_all(F.col("phone")).alias("phones"), contact.websites_all(F.col("website")).alias("websites"))


def save_rows(p: DataFrame, city: str | None = None) -> DataFrame:
    """Place rows -> rows to store: defaults, empty and zero as null, and what has no column of its own in ``additional_data``."""
    text_of = lambda c: F.nullif(F.col(c), F.lit(""))
    number = lambda c: F.when(F.col(c) != 0, F.col(c))
    score = quality.quality_score(*[F.col(c) for c in ("place_id", "phone", "website", "address", "latitude", "longitude", "rating", "review_count")])
    extra = F.struct(text_of("maps_url").alias("maps_url"), text_of("business_status").alias("business_status"), number("review_count").alias("review_count"), score.alias("quality_score"), number("distance_km").alias("distance_km"), F.coalesce(text_of("data_completeness"), F.lit("PARTIAL")).alias("data_completeness"))
    return p.select(
        "rec_no", F.coalesce(text_of("business_name"), F.lit("Unknown")).alias("name"), *[text_of(c).alias(c) for c in ("category", "address", "area")], F.coalesce(text_of("city"), F.lit(city).cast("string")).alias("city"),
        F.coalesce(text_of("country"), F.lit("Pakistan")).alias("country"), *[text_of(c).alias(c) for c in ("phone", "website")], number("rating").alias("rating"), number("review_count").alias("review_count"),
        number("latitude").alias("latitude"), number("longitude").alias("longitude"), text_of("place_id").alias("place_id"), text_of("data_completeness").alias("data_completeness"), extra.alias("additional_data"),
    )


def as_places(b: DataFrame) -> DataFrame:
    """Business records -> place rows: the record's own columns without ``id``, ``phones`` and ``websites``."""
    return b.drop("id", "phones", "websites")
