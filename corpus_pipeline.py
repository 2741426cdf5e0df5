"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it for the next stage.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import common, decontam, langid, mix, ngram_join, tokens


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not ambiguous.

    Null, empty and letterless texts go (``und``), as does every document where
    no label teaches a language; copies are judged alike; the columns of
    ``docs``, whatever their names, come back as they are.
    """
    model = langid.train(langid.learnable(docs))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    guessed = langid.predict(rows, model, "_text")
    return guessed.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("_row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the smallest id, of rows with this id that with the smallest hash of its text.

    Groups go by text: rows of one id with texts that don't link are different
    documents and stay; a null id comes after all others.  Texts without words
    link with nothing and stay, repeated ones too.
    """
    g = ngram_join.groups(docs.select("doc_id", "text")).where("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    best = g.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    rows = g.groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    rows = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    # Only what goes, and the few rows that are there several times, meet the texts again.
    fates = rows.where("_mark is null or n > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("_mark").isNotNull().alias("_again"))
    fates = common.materialize(fates, "fates")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    packed = docs.select(whole, F.col("doc_id").alias("_doc"), ngram_join.mark_of("text").alias("_text"))
    met = packed.join(common.broadcast_if_small(fates), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark")), "left")
    once = met.where("_again").dropDuplicates(["_id", "_mark"])
    return met.where("_again is null").unionByName(once).select("_row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (at least 75 % of its shingles); rows without text hold none and stay, copies share their fate."""
    return decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: up to twice, or not at all; equal rows alike, a null source is one of its own."""
    return mix.emit(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row for each sequence of the shards written; a text that is null or empty is an end-of-text id alone, no documents give no row."""
    return tokens.materialise(docs, common.new_folder(spark, "shards"), keep_tokens=False)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("mix_sources", mixed),
    ("token_shards", token_shards),
]

#: Training, similarity groups and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted when the next one has been written."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    common.discard(docs)
    return out
