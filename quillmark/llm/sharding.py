"""Sharding by jump consistent hashing, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import read_table, with_rank

#: Fixed value of the published algorithm (Lamping and Veach, 2014): the multiplier of its generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on 32-bit halves; no product leaves a signed 64-bit long, so ANSI mode holds."""
    m_hi, m_1, m_0 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
    upper = lo * F.lit(m_1)
    low = lo * F.lit(m_0) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    high = carry + lo * F.lit(m_hi) + hi * F.lit(m_0) + F.shiftleft((hi * F.lit(m_1)).bitwiseAND(F.lit(0xFFFF)), 16)
    return high.bitwiseAND(F.lit(LOW)), low.bitwiseAND(F.lit(LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key. A null key counts as -1."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(acc: Column, _: Column) -> Column:
        hi, lo = _step(acc.hi, acc.lo)
        j = F.floor((acc.j + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(acc.j < shards, F.struct(hi.alias("hi"), lo.alias("lo"), acc.j.alias("b"), j.cast("long").alias("j"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda acc: acc.b).cast("int")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (the shard were there one more).

    Ids are integers, or text that Spark casts to them; other text raises an error where ANSI mode is on, as by default.
    The id and the number of shards decide alone; equal ids, as in repeated rows, share a shard. Slots number a shard's
    rows from 0, in an order that depends on the rows' values only. Null text has size 8 and checksum 0; a null id
    counts as -1. Texts aren't shuffled; a shard's rows are numbered in 256 or more parts, so that few shards or one hot id
    do not gather in a task. Other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"), F.lit("key").alias("law"), jump_hash(F.col(id_col), shards).alias("shard"), jump_hash(F.col(id_col), shards + 1).alias("grown_shard"))
    ranked = with_rank(rows, "shard", [id_col, "size", "text_crc32"], out="slot", base_rows=shards)
    return ranked.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), 24)
