"""Mixing sources to target weights.

Tokens per source are aggregated, repetition rates derived, and each document
is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction.

Defined cases: a null text has size 0; a null source is a source of its own
and comes last; a document of size 0 may be repeated but takes no words; equal
rows get equal decisions; an empty table gives an empty mix.  ``emit`` returns
the input's columns whatever their names; ``mix`` adds columns with the prefix
``_mix_``, which replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import WORD, discard, materialize, read

#: A table of sources with at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000
DEFAULT_WEIGHTS = (5.0, 2.0, 1.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=DEFAULT_WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Water-filling: ``sizes(src, source_size)`` -> also ``target``.

    A source is capped where the water level times its weight is above ``cap``
    times its size.  The level rises from that without caps: each round sums
    what the capped ones take and the weights of the others, until it stays.
    Sources are numbered by range partitions, so as many as there are hosts are
    no single task's sort; the driver sees a few sums.
    """
    s = materialize(sizes, "sources")
    named = numbered(s.where("src is not null").withColumn("_key", F.col("src").cast("binary")), "_key").drop("_key")
    last = F.lit(s.count()).cast("long")
    x = named.unionByName(s.where("src is null").withColumn("row_no", last))
    w = F.element_at(F.array(*[F.lit(float(v)) for v in weights]), (F.pmod(F.col("row_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    x = materialize(x.select("src", "source_size", w.alias("_w"), (F.lit(float(cap)) * F.col("source_size")).alias("_cap")), "weights")
    whole = x.agg(F.sum("source_size").alias("n"), F.sum("_w").alias("w")).first()
    level = None
    if whole["w"]:
        budget = float(share) * whole["n"]
        level, capped = budget / whole["w"], 0
        while True:
            full = F.col("_cap") <= F.lit(level) * F.col("_w")
            r = x.agg(F.sum(F.when(full, F.col("_cap"))).alias("cap"), F.sum(F.when(~full, F.col("_w"))).alias("w"), F.count_if(full).alias("n")).first()
            if r["n"] == capped or not r["w"]:
                level = level if r["w"] else None
                break
            level, capped = (budget - r["cap"]) / r["w"], r["n"]
    discard(s)
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return x.select("src", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=DEFAULT_WEIGHTS,
    share: float = 1.5, cap: float = 2.0, seed: str = "mix-1",
) -> DataFrame:
    """Adds ``_mix_size, _mix_source_size, _mix_target, _mix_copies`` to every row of ``docs``.

    The coin of a document is md5(seed|key|text hash) read as 52 bits, so a
    rerun on any cluster tosses it the same way and repeated ids with other
    texts toss another one.
    """
    d = docs.drop(*[c for c in docs.columns if c.startswith("_mix_")]).withColumn("_mix_size", size_of(F.col(text)))
    sizes = d.groupBy(F.col(source).alias("src")).agg(F.sum("_mix_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    n_sources = docs.select(source).distinct().limit(BROADCAST_SOURCES + 1).count()
    t = targets.select(F.col("src").alias("_mix_src"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    if n_sources <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    j = d.join(t, d[source].eqNullSafe(t["_mix_src"]), "left").drop("_mix_src")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    coin_of = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    coin = F.conv(F.substring(F.md5(coin_of.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")
    return j.withColumn("_mix_copies", copies.cast("long"))


def emit(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with its own columns only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    m = mix(docs.select(whole, *[F.col(f"`{c}`").alias(n) for c, n in ((text, "text"), (source, "source"), (key, "doc_id"))]), **options).where("_mix_copies > 0")
    return m.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(read(spark, sf_dir, "documents"))
    return m.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


#: The same in DuckDB: the level is found by trying every prefix of capped sources.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s
), r AS (
  SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, encode(source) NULLS LAST) AS rn FROM w
), k AS (
  SELECT a.*, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce((SELECT sum(b.cap) FROM r b WHERE b.rn < a.rn), 0))
    / (SELECT sum(b.w) FROM r b WHERE b.rn >= a.rn) AS level FROM r a
), l AS (
  SELECT level FROM k WHERE ratio > level ORDER BY rn LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * w) END AS target FROM r
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
