"""Matching analysed scripts with a catalog, and rendering what was found.

A script's file digest and those of its roots are rows of one table that is joined with the catalog once, so scripts
are parsed once however many kinds of results are asked for. All that follows is windows and groups of one script.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.hashes import parse_hash
from quillmark.operators.catalog import Catalog
from quillmark.sources.catalog_file import bloom_may_contain

_PLACE = ["start_line", "start_column", "end_line", "end_column"]
_ROW = "struct<kind:int,seq:int,hash:string,name:string,start_line:bigint,start_column:bigint,end_line:bigint,end_column:bigint,span_end:bigint>"
FILE, FUNCTION = 0, 1


def _gate(catalog: Catalog):
    """Whether the catalog's own filter lets a digest through, as a column function."""
    bloom, hashes = catalog.bloom, catalog.bloom_hashes

    @F.pandas_udf("boolean")
    def passes(digests: pd.Series) -> pd.Series:
        return pd.Series([d is not None and bloom_may_contain(bloom, hashes, bytes(d)) for d in digests], dtype=bool)

    return passes


def _digests(analyzed: DataFrame) -> DataFrame:
    """One row per script, of kind FILE, and one per root, of kind FUNCTION, with their digests."""
    nothing = F.lit(None)
    file = F.struct(F.lit(FILE), F.lit(-1), "file_hash", *[nothing] * 6).cast(_ROW)
    roots = F.transform("functions", lambda f, i: F.struct(F.lit(FUNCTION), i, f["hash"], f["name"], *[f[c] for c in _PLACE], f["span_end"]).cast(_ROW))
    rows = analyzed.select("script_id", F.explode(F.concat(F.array(file), F.coalesce(roots, F.array().cast(f"array<{_ROW}>")))).alias("r"))
    return rows.select("script_id", "r.*").withColumn("digest", parse_hash(F.col("hash")))


def hits(analyzed: DataFrame, catalog: Catalog, prune: bool = True, every: bool = False, strict: bool = False) -> DataFrame:
    """One row per file or root and record of its digest: script_id, kind, seq, name, place, ord, lib, version.

    A script that matches as a whole has no rows of functions. With ``prune`` a root within a matched one is left out:
    roots come parents first, so it is one that ends no later than a matched root before it. With ``every`` each script
    has a row of its file, matched or not. With ``strict`` a root that the catalog's Bloom filter denies doesn't match,
    as it is for readers that ask the filter first; with a sound filter that changes nothing.
    """
    rows = _digests(analyzed)
    if strict and catalog.bloom:
        rows = rows.filter((F.col("kind") == FILE) | _gate(catalog)("digest"))
    rows = rows.join(catalog.records(), ["kind", "digest"], "left" if every else "inner")
    matched, function = F.col("ord").isNotNull(), F.col("kind") == FUNCTION
    script = Window.partitionBy("script_id")
    rows = rows.withColumn("_whole", F.max(~function & matched).over(script)).filter(~function | ~F.col("_whole"))
    if prune:
        before = script.orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_end", F.max(F.when(function & matched, F.col("span_end"))).over(before))
        rows = rows.filter(~function | F.col("_end").isNull() | (F.col("span_end") > F.col("_end"))).drop("_end")
    return rows.filter(~function | matched).select("script_id", "kind", "seq", "name", *_PLACE, "ord", "lib", "version")


def whole_file_matches(analyzed: DataFrame, catalog: Catalog) -> DataFrame:
    """(script_id, ord, lib, version): all records of a script's file digest, repeated ones too."""
    return hits(analyzed, catalog).filter(F.col("kind") == FILE).select("script_id", "ord", "lib", "version")


def function_matches(analyzed: DataFrame, catalog: Catalog, prune: bool = True, strict: bool = False) -> DataFrame:
    """Rows of ``hits`` of functions."""
    return hits(analyzed, catalog, prune, strict=strict).filter(F.col("kind") == FUNCTION).drop("kind")


def check_scripts(analyzed: DataFrame, catalog: Catalog) -> DataFrame:
    """(script_id, whole_file, functions) of every script; both are empty for what can't be parsed or isn't known."""
    lib = F.when(F.col("ord").isNotNull(), F.struct("ord", "lib", "version"))
    strip = F.transform(F.array_sort(F.collect_list(lib)), lambda x: F.struct(x["lib"].alias("lib"), x["version"].alias("version")))
    found = hits(analyzed, catalog, every=True).groupBy("script_id", "kind", "seq", "name", *_PLACE).agg(strip.alias("libs"))
    one = F.struct("seq", "libs", F.col("name").alias("function_name"), *_PLACE)
    whole = F.flatten(F.collect_list(F.when(F.col("kind") == FILE, F.col("libs"))))
    funcs = F.array_sort(F.collect_list(F.when(F.col("kind") == FUNCTION, one)))
    return found.groupBy("script_id").agg(whole.alias("whole_file"), F.transform(funcs, lambda f: f.dropFields("seq")).alias("functions"))


def report_lines(analyzed: DataFrame, catalog: Catalog) -> DataFrame:
    """(script_id, kind, seq, ord, line): tab-separated lines. In order of these columns whole files come first."""
    at = F.concat_ws("@", "lib", "version")
    span = F.concat(F.concat_ws(":", "start_line", "start_column"), F.lit("-"), F.concat_ws(":", "end_line", "end_column"))
    line = F.when(F.col("kind") == FILE, F.concat_ws("\t", F.lit("whole-file"), at)).otherwise(F.concat_ws("\t", F.lit("function"), span, F.coalesce("name", F.lit("<anonymous>")), at))
    return hits(analyzed, catalog).select("script_id", "kind", "seq", "ord", line.alias("line"))


def write_report(analyzed: DataFrame, catalog: Catalog, path: str) -> None:
    """The lines as text files in ``path``, in the order of their scripts within and across files."""
    report_lines(analyzed, catalog).orderBy("script_id", "kind", "seq", "ord").select("line").write.mode("overwrite").text(path)
