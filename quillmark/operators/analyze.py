"""Fingerprints of scripts: one Python stage over distinct sources, everything else in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillmark.functions.hashes import PREFIX
from quillmark.jsfront.lexer import JsSyntaxError
from quillmark.jsfront.roots import DEFAULT_MIN, Lines, analyze

_FUNCTION = "hash string, name string, start_line long, start_column long, end_line long, end_column long, stmt_count long, units long, span_start long, span_end long, canonical string"
_RESULT = f"error string, file_hash string, file_canonical string, tokens array<string>, functions array<struct<{_FUNCTION}>>"


def analyze_source(source: str | None, least: int = DEFAULT_MIN, detailed: bool = False, tokens: bool = False) -> tuple:
    """Error, file hash, canonical text, tokens and roots of one source."""
    if source is None:
        return "no source", None, None, None, []
    try:
        found = analyze(source, least)
    except (JsSyntaxError, RecursionError, ValueError) as e:
        return str(e) or type(e).__name__, None, None, None, []
    lines = Lines(source)
    roots = [(PREFIX + r.digest, r.name, *lines.at(r.start), *lines.at(r.end), r.stmt_count, r.units, r.start, r.end, r.canonical if detailed else None) for r in found.roots]
    return None, PREFIX + found.digest, found.canonical if detailed else None, found.tokens if tokens else None, roots


def scripts_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(script_id, seq, source): inline scripts of html pages, in order."""
    bodies = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>"), F.lit(1))
    return pages.select(F.col(id_col).alias("script_id"), F.posexplode(bodies).alias("seq", "source"))


def analyze_scripts(scripts: DataFrame, least: int = DEFAULT_MIN, source_col: str = "source", detailed: bool = False, tokens: bool = False, distinct: bool = True) -> DataFrame:
    """``scripts`` with error, file_hash, file_canonical, tokens and functions in place of the source.

    With ``distinct`` each different source is parsed once: sources are grouped by SHA-256 and results joined back, so a
    library that most pages carry costs one parse. Sources that can't be parsed have an error and no functions.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [analyze_source(s, least, detailed, tokens) for s in batch["source"]]
            out = pd.DataFrame(rows, columns=["error", "file_hash", "file_canonical", "tokens", "functions"])
            out["functions"] = [[dict(zip(_NAMES, r, strict=True)) for r in f] for f in out["functions"]]
            out.insert(0, "_key", batch["_key"].to_numpy())
            yield out

    keyed = scripts.withColumn("_key", F.sha2(F.coalesce(F.col(source_col), F.lit("\0null")), 256))
    if not distinct:
        # ids aren't unique here, so a row is carried by its number within the task
        rest = [c for c in scripts.columns if c != source_col]

        def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = next(work(iter([batch.rename(columns={source_col: "source"}).assign(_key="")]))).drop(columns="_key")
                yield pd.concat([batch[rest].reset_index(drop=True), own], axis=1)

        kinds = ", ".join(f"`{c}` {t}" for c, t in scripts.dtypes if c in rest)
        return scripts.mapInPandas(along, f"{kinds}, {_RESULT}")
    sources = keyed.groupBy("_key").agg(F.first(source_col).alias("source"))
    results = sources.mapInPandas(work, f"_key string, {_RESULT}")
    return keyed.drop(source_col).join(results, "_key").drop("_key")


_NAMES = [x.split()[0] for x in _FUNCTION.split(", ")]


def functions_of(analyzed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per eligible root: keys, seq (parents first), and its columns."""
    return analyzed.select(*keys, F.posexplode("functions").alias("seq", "f")).select(*keys, "seq", "f.*")


def extract_hashes(scripts: DataFrame, least: int = DEFAULT_MIN) -> DataFrame:
    return analyze_scripts(scripts, least).drop("file_canonical", "tokens")


def extract_detailed_hashes(scripts: DataFrame, least: int = DEFAULT_MIN) -> DataFrame:
    return analyze_scripts(scripts, least, detailed=True).drop("tokens")


def extract_ir(scripts: DataFrame) -> DataFrame:
    """``scripts`` with one row per program token: seq, token."""
    found = analyze_scripts(scripts, tokens=True)
    keys = [c for c in scripts.columns if c != "source"]
    return found.select(*keys, F.posexplode("tokens").alias("seq", "token"))


@udtf(returnType="seq int, token string")
class Tokens:
    """SQL: SELECT * FROM scripts, LATERAL tokens(source)."""

    def eval(self, source: str):
        for i, token in enumerate(analyze_source(source, tokens=True)[3] or []):
            yield i, token


def register(spark: SparkSession) -> None:
    """Make ``tokens(source)`` and ``file_hash(source)`` callable from SQL."""
    spark.udtf.register("tokens", Tokens)

    @F.pandas_udf("string")
    def file_hash(sources: pd.Series) -> pd.Series:
        return pd.Series([analyze_source(s)[1] for s in sources], dtype="object")

    spark.udf.register("file_hash", file_hash)


def eligible(stmt_count: Column, units: Column, least: int) -> Column:
    return (stmt_count >= least) | (units >= max(0, 2 * least - 1))
