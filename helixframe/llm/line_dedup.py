"""Lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, split_join

_SPACES = " \t\n\x0b\x0c\r"


def line_key(line):
    """The line without spaces at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(_SPACES)))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """All columns of docs with text_col without its repeated lines, and n_lines, n_dropped.

    Texts are split at \\n (null or empty: one empty line). A line's key is line_key(line).
    Keys of at least least_chars code points that at least least_docs documents hold lose all
    their lines but those in the smallest id that holds them; within one document repeats
    stay. The others are joined by \\n again. A row with a null id keeps its lines and counts
    for none; rows that repeat an id count as one document, and a place dropped in one is
    dropped in all. Columns of docs named n_lines or n_dropped are replaced; names that begin
    with __ld_ are taken.

    Lines travel as two 64-bit hashes, a row number and a position; their documents are
    counted with partial aggregation and the hot lines' join can be split. Texts are
    shuffled once, to meet the positions they lose.
    """
    lines_of = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    exploded = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__ld_id"), F.posexplode(lines_of).alias("__ld_pos", "__ld_line"))
    keyed = exploded.withColumn("__ld_key", line_key(F.col("__ld_line"))).where(F.char_length("__ld_key") >= least_chars)
    lines = keyed.select("__ld_id", "__ld_pos", F.xxhash64("__ld_key").alias("__ld_a"), F.xxhash64(F.lit(1), "__ld_key").alias("__ld_b"))
    if least_docs <= 2:
        # two documents hold a line exactly if its smallest and largest ids differ
        held = lines.groupBy("__ld_a", "__ld_b").agg(F.min("__ld_id").alias("__ld_lo"), F.max("__ld_id").alias("__ld_hi")).where("__ld_lo < __ld_hi")
    else:
        each = lines.select("__ld_a", "__ld_b", "__ld_id").distinct()
        held = each.groupBy("__ld_a", "__ld_b").agg(F.min("__ld_id").alias("__ld_lo"), F.count("*").alias("__ld_n")).where(F.col("__ld_n") >= least_docs)
    gone = split_join(lines, held.select("__ld_a", "__ld_b", "__ld_lo"), ["__ld_a", "__ld_b"]).where("__ld_id > __ld_lo")
    gone = gone.groupBy("__ld_id").agg(F.collect_set("__ld_pos").alias("__ld_gone"))
    out = docs.join(gone, docs[id_col] == gone["__ld_id"], "left").drop("__ld_id").withColumn("__ld_lines", lines_of)
    places = F.sequence(F.lit(0), F.size("__ld_lines") - 1)
    kept = F.when(F.col("__ld_gone").isNull(), F.col("__ld_lines")).otherwise(F.transform(F.array_except(places, F.coalesce("__ld_gone", F.array().cast("array<int>"))), lambda i: F.get("__ld_lines", i)))
    out = out.withColumn("n_lines", F.size("__ld_lines").cast("long"))
    out = out.withColumn("n_dropped", F.greatest(F.lit(0), F.size(F.array_intersect(places, F.coalesce("__ld_gone", F.array().cast("array<int>"))))).cast("long"))
    return out.withColumn(text_col, F.array_join(kept, "\n")).drop("__ld_lines", "__ld_gone")
