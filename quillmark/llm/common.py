"""Helpers that the training-data operators share.

Working tables live under the folder that the session names in ``spark.checkpoint.dir``; a folder of our own is set
only where that is unset (tests, a laptop). Nothing is cached with localCheckpoint, so a lost executor costs a re-read.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A join side of at most this many narrow rows (an id or a small key) is broadcast after its rows were counted.
BROADCAST_ROWS = 500_000
#: Into how many parts the rows of one group are dealt before its totals are formed.
SALTS = 256
#: Rows of a part that is numbered by one task, about, were they all of one key.
PART_ROWS = 1_000_000
#: Rows and bytes of a batch that goes to a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Where none is named, a temporary one is made, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not found:
        found = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillmark/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working table, wherever the shared folder is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession) -> None:
    """Keep batches to Python workers small, as texts may be long: an executor holds several copies of one for each
    core, outside its heap. Rows and bytes that the session sets itself stand. The settings stay, as results are computed
    after this returns."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: Folders of working tables that this process made.
_MADE: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete all working tables that this process made. Call it once results have been written: they read these tables."""
    while _MADE:
        remove(spark, _MADE.pop())


class Workspace:
    """Working tables of one operator call; ``drop`` deletes those that no later read needs, ``clean`` the others."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark, self.root, self.n = spark, new_path(spark, label), 0
        self.paths: dict[int, str] = {}
        _MADE.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the table and read it back: cuts lineage, survives lost executors, and forgets the layout of the rows
        so that later joins exchange both sides and skewed partitions can be split."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                remove(self.spark, path)


def whole_id(docs: DataFrame, id_col: str) -> tuple[Column, str, str]:
    """An id as a column that Python workers get whole, with its own type and the type it is sent in. Pandas holds
    integers beside nulls as floats, which have 53 bits, so integers are sent as strings."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    sent = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    return F.col(id_col).cast(sent).alias("id"), kind, sent


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def salt(by: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")


def with_group_totals(rows: DataFrame, keys: Sequence[str], by: str, salts: int = SALTS, **totals: tuple[str, str]) -> DataFrame:
    """Give each row totals of its group, in columns named by ``totals``: {"size": ("sum", "1"), "top": ("max", "doc_id")}.

    A group's rows are dealt to ``salts`` parts by a hash of ``by``; parts are totalled first, then at most ``salts``
    parts meet for each group, and rows join their own part. No task gets a whole group. ``rows`` is read twice, so
    pass a table that is kept. Keys must not be null.
    """
    rows = rows.withColumn("_part", salt(F.col(by), salts))
    parts = rows.groupBy(*keys, "_part").agg(*[F.expr(f"{fn}({what})").alias(name) for name, (fn, what) in totals.items()])
    group = Window.partitionBy(*keys)
    parts = parts.select(*keys, "_part", *[F.expr(f"{fn}({name})").over(group).alias(name) for name, (fn, _) in totals.items()])
    return rows.join(parts, [*keys, "_part"]).drop("_part")


def with_rank(rows: DataFrame, key: str, order: Sequence[str], counts: DataFrame | None = None, salts: int | None = None, out: str = "rank", base_rows: int | None = None) -> DataFrame:
    """Number the rows of each key gaplessly from 0 without gathering a key in one task.

    Rows of a key are dealt to parts by a hash of ``order``; a part is numbered by its own window, and starts where the
    parts before it end. ``counts`` may name a cheaper table with the same key and order columns to count from;
    ``base_rows`` bounds the number of keys, and lets the starts be broadcast.
    """
    salts = salts or max(SALTS, math.ceil(rows.count() / PART_ROWS))
    part = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    rows = rows.withColumn("_part", part)
    sizes = (counts.withColumn("_part", part) if counts is not None else rows).groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if base_rows is not None and base_rows * salts <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    return numbered.join(starts, [key, "_part"]).withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_part", "_rn", "_start")
