"""A corpus pipeline of four stages: language ID, exact deduplication, near-deduplication, packing.

Each stage works on all that the one before kept. Stages but the last return the columns of documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.bpe import tokenizer_path
from quillmark.llm.common import BROADCAST_ROWS, Workspace, read_table
from quillmark.llm.exact_dedup import exact_dedup
from quillmark.llm.language_id import UNDETERMINED, has_letter, identify, train
from quillmark.llm.minhash import near_duplicates
from quillmark.llm.packing import pack_documents


def keyed(docs: DataFrame, ws: Workspace, nulls_last: bool) -> DataFrame:
    """``docs`` with _row, a number that no two rows share and that orders them as doc_id does, so that a decision holds
    for its own row. It is doc_id itself if a count shows none that is null or shared; else rows are numbered by doc_id,
    null ones first or last, and by the digest of their text."""
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    fixed = ws.keep(docs.withColumn("_at", F.monotonically_increasing_id()))
    by = F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first()
    narrow = fixed.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"), "_at")
    numbers = ws.keep(narrow.orderBy(by, "_digest", "_at").select("_at", F.monotonically_increasing_id().alias("_row")))
    out = ws.keep(fixed.join(F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers, "_at").select(*docs.columns, "_row"))
    ws.drop(fixed, numbers)
    return out


def without(docs: DataFrame, dropped: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` less the rows whose _row is in ``dropped``, which is broadcast when a count shows that it is small."""
    dropped = ws.keep(dropped.select("_row"))
    left = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, "_row", "left_anti")
    return left.select(*[c for c in docs.columns if c != "_row"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be determined go: null text, and text without letters; so also where no document
    has a language to learn from. No prediction of the model rejects a document."""

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([has_letter(t) for t in texts], dtype=bool)

    model = train(docs)
    return identify(docs, model).filter(F.col("lang_pred") != UNDETERMINED).select(*docs.columns) if model.langs else docs.filter(lettered("text"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts that with the largest doc_id stays, one without id only if none has any. Documents
    that only share an id are not copies."""
    ws = Workspace(spark, "exact_stage")
    rows = keyed(docs, ws, nulls_last=False)
    return without(rows, exact_dedup(rows, id_col="_row").filter("NOT kept"), ws)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more connect that with the smallest doc_id stays, one without id only if none
    has any. Documents that only share an id are not linked by it."""
    ws = Workspace(spark, "near_stage")
    rows = keyed(docs, ws, nulls_last=True)
    return without(rows, near_duplicates(rows, percent=80, id_col="_row").filter("NOT kept"), ws)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequence_id and offset, in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: Neither language ID by a fitted model nor packing can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.keep(docs)
            ws.drop(before)
    return docs
