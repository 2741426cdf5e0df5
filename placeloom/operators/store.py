"""Jobs, links and upserts as joins over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import truthy
from .dedup import first_in_sequence
from .tables import materialize


def job_history(jobs: DataFrame, user: Column | None = None, user_column: str = "user_id", created: str = "created_at", key: str = "job_id") -> DataFrame:
    j = jobs if user is None else jobs.where(F.col(user_column) == user)
    return j.orderBy(F.desc(created), key)


def job_visible(jobs: DataFrame, user, user_column: str = "user_id") -> DataFrame:
    """Row-level security: jobs without an owner are public."""
    return jobs.where(F.col(user_column).isNull() | (F.col(user_column) == user))


def job_results(businesses: DataFrame, links: DataFrame, job, job_column: str = "job_id", key: str = "business_id") -> DataFrame:
    return businesses.join(links.where(F.col(job_column) == job).select(key), key, "left_semi")


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keyed partial update: columns of ``changes`` that are not null win."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    return table.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if f"_{x}" in c.columns else F.col(x) for x in table.columns])


def upsert_match(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(new_no, stored_no, rule): the match of each new row by phone (1), else website (2), else name and city (3); the lowest stored row of the best rule."""
    n, s = new.alias("n"), stored.alias("s")
    rules = [
        (1, truthy(F.col("n.phone")) & (F.col("n.phone") == F.col("s.phone"))),
        (2, truthy(F.col("n.website")) & (F.col("n.website") == F.col("s.website"))),
        (3, (F.col("n.business_name") == F.col("s.business_name")) & (F.col("n.city") == F.col("s.city"))),
    ]
    found = None
    for rule, on in rules:
        # The lowest stored row per key first: a key shared by many stored rows yields one candidate.
        key = {1: ["phone"], 2: ["website"], 3: ["business_name", "city"]}[rule]
        low = s.groupBy(*key).agg(F.min("rec_no").alias("rec_no")).alias("s")
        m = n.join(low, on).select(F.col("n.rec_no").alias("new_no"), F.col("s.rec_no").alias("stored_no"), F.lit(rule).alias("rule"))
        found = m if found is None else found.unionByName(m)
    return found.groupBy("new_no").agg(F.min(F.struct("rule", "stored_no")).alias("m")).select("new_no", "m.stored_no", "m.rule")


def upsert_match_any(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(new_no, stored_no): the lowest stored row that shares the phone, the website, or name and city whatever their case."""
    def keys(df):
        name = F.concat_ws("|", F.lower("business_name"), F.lower("city"))
        named = F.when(F.col("business_name").isNotNull() & F.col("city").isNotNull(), F.concat(F.lit("n|"), name))
        every = F.array_compact(F.array(F.concat(F.lit("p|"), F.nullif("phone", F.lit(""))), F.concat(F.lit("w|"), F.nullif("website", F.lit(""))), named))
        return df.select("rec_no", F.explode(every).alias("k"))

    low = keys(stored).groupBy("k").agg(F.min("rec_no").alias("stored_no"))
    return keys(new).join(low, "k").groupBy(F.col("rec_no").alias("new_no")).agg(F.min("stored_no").alias("stored_no"))


def _targets(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new_no, target) of the new rows that update a row, a stored one or one inserted before them in the batch, and the rows to insert."""
    found = materialize(upsert_match(stored, new).select("new_no", F.col("stored_no").alias("target")), "matches")
    left = new.join(found.select(F.col("new_no").alias("rec_no")), "rec_no", "left_anti")
    named = F.when(F.col("business_name").isNotNull() & F.col("city").isNotNull(), F.concat_ws("\u0001", "business_name", "city"))
    keys = left.select("rec_no", F.nullif("phone", F.lit("")).alias("p"), F.nullif("website", F.lit("")).alias("w"), named.alias("n"))
    firsts = materialize(first_in_sequence(keys.select("rec_no", "p", "w", F.col("n").alias("m")), ["p", "w", "m"]), "inserts")
    fresh = left.join(firsts, "rec_no", "left_semi")
    again = upsert_match(fresh, left.join(firsts, "rec_no", "left_anti")).select("new_no", F.col("stored_no").alias("target"))
    return found.unionByName(again), fresh


def upsert(stored: DataFrame, new: DataFrame, extra: str = "replace", columns: tuple[str, ...] = ("rating", "phone", "website", "address")) -> DataFrame:
    """Stored rows with their matches' values, and the new rows that match nothing before them.

    New rows are taken in the order of ``rec_no``: one that matches an earlier
    new row updates what that row inserted.  Of several matches the last value
    that is not null wins, column by column; rows match by the values they come
    with.  ``extra`` chooses what happens to a map column ``additional``:
    replaced or merged.
    """
    targets, fresh = _targets(stored, new)
    more = ("additional",) if "additional" in new.columns and "additional" in stored.columns else ()
    m = targets.join(new, targets["new_no"] == new["rec_no"])
    last = m.groupBy("target").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("new_no"))).alias(f"_{c}") for c in (*columns, *more)])
    every = stored.unionByName(fresh, allowMissingColumns=True).select(*stored.columns)
    j = every.join(last, every["rec_no"] == last["target"], "left")
    cols = []
    for c in stored.columns:
        if c in columns:
            cols.append(F.coalesce(f"_{c}", c).alias(c))
        elif c in more:
            both = F.map_concat(F.map_filter("additional", lambda k, v: ~F.map_contains_key("_additional", k)), "_additional")
            cols.append(F.coalesce(both if extra == "merge" else F.col("_additional"), F.col("_additional"), F.col("additional")).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def link_once(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with the new ones that are absent; rows of other columns keep theirs, new ones have null there."""
    fresh = new.dropDuplicates(["job_id", "business_id"]).join(links, ["job_id", "business_id"], "left_anti")
    return links.dropDuplicates(["job_id", "business_id"]).unionByName(fresh, allowMissingColumns=True)


def with_totals(jobs: DataFrame, processed: DataFrame, total: str = "total_results") -> DataFrame:
    """Jobs with ``total`` set to the number of rows processed for them (job_id, ...); other jobs keep theirs."""
    n = processed.groupBy("job_id").agg(F.count("*").alias("_n"))
    old = F.col(total) if total in jobs.columns else F.lit(None).cast("long")
    rest = [F.col(c) for c in jobs.columns if c != total]
    return jobs.join(n, "job_id", "left").select(*rest, F.coalesce("_n", old).alias(total))


def create_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with the new ones appended; a new job whose id is there already changes nothing."""
    return jobs.unionByName(new.dropDuplicates(["job_id"]).join(jobs, "job_id", "left_anti"), allowMissingColumns=True)
