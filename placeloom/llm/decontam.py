"""Benchmark decontamination by size-partitioned containment MinHash.

An item's sketch holds its k smallest shingle hashes (a bottom-k MinHash); a
document's own set, possibly thousands of times larger, is probed with them,
which estimates containment without the dilution that Jaccard MinHash suffers
in long documents.  Documents fall into partitions by set size: a partition
only knows the items that can fit its documents.  k is at least the number of
shingles an item may miss plus one, so every document that contains 75 % of an
item is a candidate (pigeonhole), and candidates need as many sketch hits as
that argument grants.  Candidates are then verified by exact containment of
the item's distinct five-word shingles, held as 64-bit hashes (as is the
identity of a text among the rows of one id).

Words are runs of letters and digits of the lower-cased text, so changed
punctuation or spacing doesn't hide an item.  Built-in functions only.

Defined cases: null, empty and word-less texts contain nothing and are
contained in nothing; with fewer than five words the whole sequence is one
shingle, so such an item only matches documents that consist of it; repeated
documents or items each get their own result; ties between items go to the
smallest item id; empty tables give no match; extra columns are carried along
by ``decontaminate`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, read

WIDTH = 5


def shingle_list(text: Column) -> Column:
    """64-bit hashes of the five-word shingles, repeats included (null for null texts).

    Words are hashed first, so a shingle costs one hash of five longs.  Arrays
    are bound to lambda variables: as plain expressions they would be evaluated
    again for every shingle.  Past the end ``get`` gives null, which the hash
    skips: the first entry of a short text is the hash of all its words.
    """
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    each = F.transform(
        F.array(F.transform(words, lambda w: F.xxhash64(w))),
        lambda h: F.slice(
            F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4))), 1, F.greatest(F.size(h) - (WIDTH - 1), F.lit(1))
        ),
    )
    return F.when(text.isNotNull(), F.element_at(each, 1))


def shingles(text: Column) -> Column:
    return F.array_distinct(shingle_list(text))


def partition_of(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 2).cast("int")


def _items(items: DataFrame, text: str, key: str, percent: int, least_k: int) -> DataFrame:
    x = items.select(F.col(key).alias("item_id"), F.sort_array(shingles(F.col(text))).alias("hs")).where("size(hs) > 0").withColumn("q", F.size("hs"))
    x = x.withColumn("need", F.ceil(F.col("q") * percent / F.lit(100)).cast("int"))
    x = x.withColumn("k", F.least("q", F.greatest(F.lit(least_k), F.col("q") - F.col("need") + 1)))
    return x.withColumn("hits_needed", F.greatest(F.lit(1), F.col("k") - (F.col("q") - F.col("need"))))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", percent: int = 75, least_k: int = 16) -> DataFrame:
    """(doc_id, text_key, item_id, shared, item_size) for every document that contains ``percent`` of an item's shingles."""
    it = materialize(_items(items, item_text, item_key, percent, least_k), "items")
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    largest = 16  # 4 ** 16 shingles
    probe = it.select("item_id", "need", "hits_needed", F.explode(F.slice("hs", 1, F.col("k"))).alias("h"))
    probe = probe.withColumn("part", F.explode(F.sequence(partition_of(F.col("need")), F.lit(largest))))
    probe = broadcast_if_small(materialize(probe, "sketches"))
    s = d.select("doc_id", "text_key", shingle_list(F.col("t")).alias("hs"))
    s = s.select("doc_id", "text_key", F.size("hs").alias("n"), F.least(partition_of(F.size("hs")), F.lit(largest)).alias("part"), F.explode("hs").alias("h"))
    hit = s.join(probe, ["part", "h"]).where("need <= n").groupBy("doc_id", "text_key", "item_id").agg(F.count_distinct("h").alias("hits"), F.first("hits_needed").alias("hits_needed"))
    cand = materialize(hit.where("hits >= hits_needed").select("doc_id", "text_key", "item_id").distinct(), "candidates")
    c = cand.select(F.col("doc_id").alias("cd"), F.col("text_key").alias("ct")).distinct()
    chosen = d.join(broadcast_if_small(c), F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("text_key") == F.col("ct")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    mine = chosen.select("doc_id", "text_key", F.explode(shingles(F.col("t"))).alias("h"))
    whole = it.dropDuplicates(["item_id", "hs"]).select("item_id", "q", "need", F.xxhash64("hs").alias("item_set"), F.explode("hs").alias("h"))
    found = mine.join(broadcast_if_small(whole), "h")
    found = found.groupBy("doc_id", "text_key", "item_id", "item_set").agg(F.count("*").alias("shared"), F.first("q").alias("item_size"), F.first("need").alias("need"))
    return found.where("shared >= need").select("doc_id", "text_key", "item_id", F.col("shared").cast("long"), F.col("item_size").cast("long"))


def flag(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each contaminated document: the item it contains most of and the number of items."""
    m = matches(docs, items, **options)
    best = F.max(F.struct((F.col("shared") / F.col("item_size")).alias("c"), (-F.col("item_id")).alias("i")))
    return m.groupBy("doc_id", "text_key").agg(best.alias("b"), F.count_distinct("item_id").alias("n_items")).select("doc_id", "text_key", (-F.col("b.i")).alias("item_id"), F.round("b.c", 6).alias("containment"), "n_items")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    bad = materialize(flag(docs, items, text=text, key=key, **options).select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_text")), "contaminated")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(whole, F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    return packed.join(broadcast_if_small(bad), F.col("id").eqNullSafe(F.col("_bad_id")) & (F.col("mark") == F.col("_bad_text")), "left_anti").select("row.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document."""
    return flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


#: Exact containment of every pair that shares a shingle.
OP7_SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL
), n AS (
  SELECT kind, id, ws, len(ws) AS n, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') || CASE WHEN n < 5 THEN ' #' || n ELSE '' END AS g FROM n
), q AS (
  SELECT id AS item_id, count(*) AS q FROM s WHERE kind = 1 GROUP BY 1
), m AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2
), f AS (
  SELECT m.*, q.q, row_number() OVER (PARTITION BY doc_id ORDER BY shared::DOUBLE / q.q DESC, m.item_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS n_items
  FROM m JOIN q USING (item_id) WHERE 100 * shared >= 75 * q.q
)
SELECT doc_id, item_id, round(shared::DOUBLE / q, 6) AS containment, n_items FROM f WHERE rn = 1
"""
