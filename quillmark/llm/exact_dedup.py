"""Exact deduplication by progressive refinement: length, then a hash of a prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, ascii_lower, read_table, with_group_totals

#: Characters of the prefix in the second refinement.
PREFIX_CHARS = 256
#: Survivors of a refinement are sent out as a map of 2^26 bits, 64 to a row: 2^20 rows, 32 MB or so, at any size.
MAP_BITS = 26


def _place(keys: list[str]) -> tuple[Column, Column]:
    """Row and bit of the map that stand for these keys."""
    cell = F.shiftrightunsigned(F.xxhash64(*keys), 64 - MAP_BITS)
    return F.shiftright(cell, 6), cell.bitwiseAND(F.lit(63)).cast("int")


def mark_survivors(rows: DataFrame, counted: DataFrame, keys: list[str], ws: Workspace) -> DataFrame:
    """``rows`` with _again: false only where no two rows of ``counted`` have the row's keys.

    Keys that two rows have are set in a map of fixed size, which is broadcast. A key that only shares its bit with one of
    them is marked too, and costs no more than the hash of a text; so the larger the corpus, the more texts are
    hashed, and nothing else changes."""
    word, bit = _place(keys)
    found = counted.groupBy(*keys).count().filter("count > 1").select(word.alias("_word"), bit.alias("_bit"))
    bits = ws.keep(found.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")))
    joined = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word", "left")
    return joined.withColumn("_again", F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1 = 1"), F.lit(False))).drop("_word", "_bit", "_bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, from texts equal after lower-casing A-Z.

    Rows are refined in the scan: those whose length no other row has are done; of the rest, those whose length and
    prefix hash no other row has are done; only the rest have their whole text hashed (all rows with ``hash_all``, for
    callers that want the digest; grouping is unchanged). Only ids, lengths and hashes are shuffled, never texts.
    Which keys survive a refinement is broadcast as a bit map of fixed size, so the same refinements run at any size.

    The largest id of a group stays. Null text counts as empty. A repeated row (same id, same text) is the same
    document: each gets the same decision. A null id never stays if its group has others; kept is then false, and
    keep_id is null only if all ids of the group are. An empty table gives an empty result. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "exact")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    by_length = mark_survivors(rows.withColumn("_len", F.octet_length("_text")), docs.select(size.alias("_len")), ["_len"], ws)
    head = F.when(F.col("_again"), F.xxhash64(F.substring("_text", 1, PREFIX_CHARS)))
    by_prefix = by_length.withColumn("_head", head).withColumnRenamed("_again", "_more")
    second = mark_survivors(by_prefix, by_prefix.filter("_more").select("_len", "_head"), ["_len", "_head"], ws)
    second = second.withColumn("_again", F.col("_again") & F.col("_more"))
    hashed = second.select("_id", "_again", F.when(F.lit(hash_all) | F.col("_again"), F.sha2("_text", 256)).alias("text_sha256"))
    narrow = ws.keep(hashed)
    groups = with_group_totals(narrow.filter("_again"), ["text_sha256"], "_id", keep_id=("max", "_id"), group_size=("sum", "1L"))
    alone = narrow.filter("NOT _again").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long")})
    out = groups.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), hash_all=True)


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
), g AS (
  SELECT doc_id, h, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, h AS text_sha256 FROM g
"""
