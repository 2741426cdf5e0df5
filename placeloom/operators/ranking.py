"""Geo ranking, view operators and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.basics import rounded, truthy
from . import tables

RADIUS_FACTOR = {"inside": 1.5, "in": 2.5, "near": 5.0}


def with_location_score(df: DataFrame, location: dict) -> DataFrame:
    """Adds ``distance_km`` and ``location_match_score``, both to three places."""
    lat, lng = location.get("latitude"), location.get("longitude")
    d = geo.haversine_km(F.lit(float(lat)), F.lit(float(lng)), F.col("latitude"), F.col("longitude")) if lat is not None and lng is not None else F.lit(None).cast("double")
    names = [v for k, v in location.items() if isinstance(v, str) and k not in ("preposition",)]
    score = geo.location_score(d, F.lit(geo.effective_radius(location)), geo.address_token_score(F.col("address"), names))
    return df.withColumn("distance_km", rounded(d, 3)).withColumn("location_match_score", rounded(score, 3))


def relaxed_radius_filter(df: DataFrame, radius_km: float, preposition: str = "in") -> DataFrame:
    """Rows within the radius; all rows if fewer than min(10, 30 %) would stay.

    The two counts are a one-row aggregate joined back, not a window over everything.
    """
    most = radius_km * RADIUS_FACTOR.get(preposition, 4.0)
    inside = F.col("distance_km").isNull() | (F.col("distance_km") <= most)
    n = df.agg(F.count("*").alias("_all"), F.count_if(inside).alias("_kept"))  # one row
    return df.crossJoin(F.broadcast(n)).where(inside | (F.col("_kept") < F.least(F.lit(10.0), F.col("_all") * 0.3))).drop("_all", "_kept")


def ranking() -> list[Column]:
    return [F.desc("location_match_score"), F.coalesce("distance_km", F.lit(9999.0)).asc(), F.col("rec_no").asc()]


def filter_and_rank(df: DataFrame, location: dict, top: int | None = None) -> DataFrame:
    """Scored, filtered and ordered; with ``top`` a distributed top-k."""
    out = with_location_score(df, location)
    if location.get("latitude") is not None and location.get("longitude") is not None:
        out = relaxed_radius_filter(out, geo.effective_radius(location), location.get("preposition", "in"))
    out = out.orderBy(*ranking())
    return out.limit(top) if top else out


# ------------------------------------------------------------------ views
def text_search(df: DataFrame, needle: str) -> DataFrame:
    q = needle.strip().lower()
    if not q:
        return df
    fields = [F.lower(c) for c in ("business_name", "category", "address", "website", "city")] + [F.col("phone")]
    test = F.lit(False)
    for f in fields:
        test = test | F.coalesce(f.contains(q), F.lit(False))
    return df.where(test)


def view_filter(df: DataFrame, city: str = "all", category: str = "all", min_rating: float = 0, has_phone: bool = False, has_website: bool = False) -> DataFrame:
    for c, v in (("city", city), ("category", category)):
        if v != "all":
            df = df.where(F.col(c) == v)
    if min_rating > 0:
        df = df.where(F.col("rating") >= min_rating)
    for on, c in ((has_phone, "phone"), (has_website, "website")):
        if on:
            df = df.where(truthy(F.col(c)))
    return df


def view_sort(df: DataFrame, column: str, descending: bool = False, key: str = "rec_no") -> DataFrame:
    """Nulls last when ascending, first when descending; texts in the order of the root locale, numbers by value."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.collate(c, "UNICODE")
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col(key))


def page(df: DataFrame, number: int, size: int = 10) -> DataFrame:
    return df.offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    """(pages): as many as the rows need, one at least."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("long").alias("pages"))


def facet(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.select(value.alias(name)).where(truthy(F.col(name))).distinct().orderBy(name)


def geo_bounds(df: DataFrame) -> DataFrame:
    d = df.where("latitude is not null and longitude is not null")
    b = d.agg(F.count("*").alias("n"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))
    return b.select("*", F.when(F.col("n") == 1, 15).alias("zoom"), (F.col("n") >= 50).alias("clustered"))


def bounds_changed(north: Column, east: Column, new_north: Column, new_east: Column) -> Column:
    return (F.abs(new_north - north) > 0.01) | (F.abs(new_east - east) > 0.01)


def search_stats(final: DataFrame, target: int, zones: int = 0, queries: int = 0, removed: int = 0, requests: int = 0, completeness: str = "data_completeness") -> DataFrame:
    """The statistics row of a search: counts of the final rows, what the search did, and whether it reached its target."""
    n = F.count("*")
    of = lambda k: F.count_if(F.col(completeness) == k)
    lit = lambda v: F.lit(v).cast("long")
    return final.agg(
        n.alias("final"), of("FULL").alias("full"), of("PARTIAL").alias("partial"), of("NAME_ONLY").alias("name_only"), lit(zones).alias("zones"), lit(queries).alias("queries"),
        lit(removed).alias("removed"), lit(requests).alias("requests"), F.when(n >= target, "COMPLETED").otherwise("LIMIT_REACHED").alias("status"),
    )


def view_kpis(df: DataFrame, completeness: str = "data_completeness") -> DataFrame:
    full, part, n = F.count_if(F.col(completeness) == "FULL"), F.count_if(F.col(completeness) == "PARTIAL"), F.count("*")
    return df.agg(n.alias("total"), full.alias("full"), part.alias("partial"), (n - full - part).alias("name_only"), F.floor(full * 100.0 / F.greatest(n, F.lit(1)) + 0.5).alias("quality_pct"))


def numbered(df: DataFrame, key: str = "rec_no") -> DataFrame:
    """1-based ordinals in key order without one big window: ranks inside range partitions plus the partitions' offsets.

    The placed rows are written once, as a table in the shared folder, and the
    counts come from that table: a range partitioning that is evaluated twice
    samples other bounds each time.  Rows with equal keys get consecutive
    numbers in any order; null keys come first.
    """
    at = F.monotonically_increasing_id()  # partition number and place in it
    d = tables.materialize(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", at), "numbered")
    d = d.withColumn("_p", F.shiftright("_at", 33)).withColumn("_r", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    base = d.groupBy("_p").agg(F.count("*").alias("_c"))
    base = base.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_p", "_b")  # one row for each partition
    return d.join(F.broadcast(base), "_p").withColumn("row_no", F.col("_r") + F.col("_b")).drop("_at", "_p", "_r", "_b")
