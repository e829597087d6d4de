"""A training corpus from raw documents: the stages in order, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the
columns of documents, the last one its encoded texts. Repeated rows are rows of their own.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import line_dedup, mixing, near_dedup, piece_sampling, toxicity
from .common import read, remove, shared_folder, split_join, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express the string-kernel machine of the first stage, so the stages are tested one by one against brute force.
ORACLE_SQL = None


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go. The machine is trained on sf_dir's labelled documents.

    Scores depend on a row's text only, so each row goes or stays by itself.
    """
    machine = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    struct = docs.select(F.struct(*COLUMNS).alias("id"), "text")
    scored = toxicity.toxicity(struct, machine, "id", "text")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("id.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has as well go; the documents stay."""
    return _columns(line_dedup.repeated_lines(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id: five-word shingles, similarity 0.8.

    Documents without an id or without words stay. Of rows that repeat the smallest id with
    other texts one stays; rows that repeat an id and a text stay or go together.
    """
    found = near_dedup.near_duplicates(docs, with_key=True).where("group is not null")
    first = found.groupBy("group").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = split_join(found, first, ["group"]).where("key <> first.key").select(F.col("id").alias("doc_id"), "key").distinct()
    keyed = docs.select(*COLUMNS, near_dedup.row_key("doc_id", "text").alias("key"))
    return keyed.join(gone, ["doc_id", "key"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's stream is repeated, and cut to the words taken where the mix ends in it.

    Documents that the mix does not reach, or that have no words, are not in it.
    """
    keyed = docs.select(*COLUMNS)
    plan = mixing.mixed(keyed).where("taken > 0").groupBy(F.col("id").alias("p_id"), F.col("h").alias("p_h"), F.col("source").alias("p_source")).agg(F.sort_array(F.collect_list(F.struct("cycle", "taken")), False).alias("uses"), F.count_if(F.col("cycle") > 0).alias("after_0"), F.count_if(F.col("cycle") > 1).alias("after_1"), F.first("size").alias("size"))
    # rows with equal id, text and source share their plans, and each has at most one use in a cycle; a document is used at most three times
    copies = keyed.groupBy("doc_id", "text", "source").agg(F.sort_array(F.collect_list(F.struct("lang"))).alias("rows")).withColumn("h", F.xxhash64(F.lit(0), "doc_id", "text"))
    joined = copies.join(plan, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & F.col("source").eqNullSafe(F.col("p_source")))
    # the uses come from the last cycle to the first; those of one cycle go to the rows in order
    begin = lambda u: F.when(u["cycle"] == 0, F.col("after_0")).when(u["cycle"] == 1, F.col("after_1")).otherwise(0).cast("int")
    each = F.transform("uses", lambda u, i: F.struct(u["taken"].alias("taken"), F.get("rows", i - begin(u))["lang"].alias("lang")))
    used = joined.withColumn("each", each).select("doc_id", "text", "source", "size", F.explode("each").alias("use")).withColumn("lang", F.col("use.lang"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut_text = F.when(F.col("use.taken") >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("use.taken").cast("int")), " "))
    return _columns(used.withColumn("text", cut_text))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every text, with their inclusion scores; pieces, their digest, and whether they decode to the text."""
    return piece_sampling.encode_and_decode(docs, tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder, read again, and removed once the next one stands."""
    docs = read(spark, sf_dir, "documents")
    folder = posixpath.join(shared_folder(spark), f"stages-{uuid.uuid4().hex}")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := posixpath.join(folder, f"{k}-{name}"))
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs
