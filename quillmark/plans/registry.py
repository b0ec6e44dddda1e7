"""Queries of the engine by name, and the SQL that checks them.

Scripts are made by SQL templates from the tables, so that their token streams are templates too, and an independent
engine can digest them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.hashes import PREFIX, format_hash, parse_hash
from quillmark.operators import analyze as an
from quillmark.operators.catalog import HASHES, Catalog, build, from_bytes, numbered
from quillmark.operators.match import check_scripts, function_matches, report_lines, whole_file_matches
from quillmark.plans import syntax
from quillmark.sources.catalog_file import bloom_build
from quillmark.streaming.scripts import match_stream


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- templates: source, and stream as SQL with {n} for the number
FILE_STREAM = "'Program,VariableDeclaration,VariableDeclarator,Identifier,L0,StringLiteral,S:</p>,ExpressionStatement,CallExpression,Identifier,F0,NumericLiteral,N:' || page_id"
INNER_STREAM = "'Identifier,L0,BlockStatement,VariableDeclaration,VariableDeclarator,Identifier,L1,BinaryExpression,+,Identifier,L0,NumericLiteral,N:' || p_size || ',VariableDeclaration,VariableDeclarator,Identifier,L2,BinaryExpression,*,Identifier,L1,NumericLiteral,N:2,ReturnStatement,Identifier,L2'"
OUTER_STREAM = f"'Identifier,L0,Identifier,L1,BlockStatement,VariableDeclaration,VariableDeclarator,Identifier,L2,BinaryExpression,+,Identifier,L0,Identifier,L1,VariableDeclaration,VariableDeclarator,Identifier,L3,BinaryExpression,*,Identifier,L2,NumericLiteral,N:' || p_size || ',FunctionDeclaration,Identifier,L4,' || {INNER_STREAM} || ',ReturnStatement,Identifier,L3'"
NESTED = "concat('function f(a,b){var c=a+b;var d=c*', p_size, ';function g(x){var y=x+', p_size, ';var z=y*2;return z}return d;}')"


def part_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("script_id"), F.expr(NESTED).alias("source"))


def page_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.analyze_scripts(an.scripts_of(_table(spark, sf_dir, "pages")), 1)


def page_file_hash(spark, sf_dir):
    return page_analysis(spark, sf_dir).select("script_id", "file_hash")


def page_tokens(spark, sf_dir):
    rows = an.extract_ir(an.scripts_of(_table(spark, sf_dir, "pages")).drop("seq"))
    return rows.select("script_id", "seq", "token")


def part_function_hash(spark, sf_dir):
    found = an.functions_of(an.analyze_scripts(part_scripts(spark, sf_dir), 3), ["script_id"])
    return found.select("script_id", "seq", "name", "hash", "stmt_count")


def doc_literal_escape(spark, sf_dir):
    text = F.col("text")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    scripts = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("script_id"), F.concat(F.lit('x("'), text, F.lit('");')).alias("source"))
    return an.analyze_scripts(scripts, distinct=False).select("script_id", "file_hash")


def minified_pairs(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("concat('function add(left, right) {\n  // sum\n  var total = left + right;\n  return total * ', p_size, ';\n}\nadd(1, 2);')").alias("a"),
        F.expr("concat('function q(e,t){var n=e+t;return n*', p_size, '}q(1,2)')").alias("b"),
    )
    sides = [an.analyze_scripts(rows.select("p_partkey", F.col(c).alias("source"))).select("p_partkey", F.col("file_hash").alias(f"hash_{c}")) for c in "ab"]
    return sides[0].join(sides[1], "p_partkey").select("p_partkey", (F.col("hash_a") == F.col("hash_b")).alias("same"))


def eligibility(spark, sf_dir):
    """How many roots of a script with p_size % 5 statements of two units pass thresholds 0 to 6."""
    scripts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("script_id"), F.expr("concat('function f(){', repeat('a();', p_size % 5), '}')").alias("source"))
    every = an.functions_of(an.analyze_scripts(scripts, 0), ["script_id"])
    swept = every.withColumn("least", F.explode(F.sequence(F.lit(0), F.lit(6))))
    passed = F.lit(False)
    for least in range(7):
        passed = F.when(F.col("least") == least, an.eligible(F.col("stmt_count"), F.col("units"), least)).otherwise(passed)
    return swept.filter(passed).groupBy("least").agg(F.count(F.lit(1)).alias("n"))


def positions(spark, sf_dir):
    scripts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("script_id"), F.expr("concat('/*é😀*/', repeat('\n', p_size), ' function f(){a();b();c()}')").alias("source"))
    found = an.functions_of(an.analyze_scripts(scripts), ["script_id"])
    return found.select("script_id", "start_line", "start_column", "end_line", "end_column")


def parse_hash_query(spark, sf_dir):
    h = F.expr("CASE p_size % 4 WHEN 0 THEN concat('slh1-', sha2(p_name, 256)) WHEN 1 THEN concat('slh1-', upper(sha2(p_name, 256))) WHEN 2 THEN concat('slh1-', substring(sha2(p_name, 256), 2)) ELSE concat('slh2-', sha2(p_name, 256)) END")
    return _table(spark, sf_dir, "part").select("p_partkey", F.lower(F.hex(parse_hash(h))).alias("digest"))


def format_hash_query(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", format_hash(F.unhex(F.sha2("p_name", 256))).alias("hash"))


_CATALOGS: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of a folder of tables, made once in a session and kept by its executors."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        _CATALOGS[key] = _catalog(spark, sf_dir).__enter__()
    return _CATALOGS[key]


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Libraries are brands, each with versions 1.0 and 2.0. Whole files: every seventh page's script, for the brand of
    rank page_id % 5. Functions: the outer one of even sizes and the inner one of sizes divisible by three, for each
    brand that has a part of the size."""
    part = _table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct()
    libs = brands.select((F.expr("row_number() OVER (ORDER BY p_brand)") - 1).cast("int").alias("lib_id"), F.col("p_brand").alias("name"), F.array(F.lit("1.0"), F.lit("2.0")).alias("versions"))
    pages = _table(spark, sf_dir, "pages").filter("page_id % 7 = 0")
    files = pages.select(F.unhex(F.sha2(F.expr(FILE_STREAM), 256)).alias("digest"), (F.col("page_id") % 5).cast("int").alias("lib_id"), F.lit(0).alias("version_index"))
    sized = part.select("p_size", F.col("p_brand").alias("name")).distinct().join(F.broadcast(libs), "name")
    kinds = [sized.filter(where).select(F.unhex(F.sha2(F.expr(stream), 256)).alias("digest"), "lib_id", (F.col("p_size") % 2).cast("int").alias("version_index")) for where, stream in (("p_size % 2 = 0", OUTER_STREAM), ("p_size % 3 = 0", INNER_STREAM))]
    return Catalog(libs, numbered(files), numbered(kinds[0].unionByName(kinds[1])))


def catalog_libs(spark, sf_dir):
    return catalog(spark, sf_dir).list_libs().select("lib_id", "name", F.posexplode("versions").alias("version_index", "version"))


def catalog_dump(spark, sf_dir):
    both = [catalog(spark, sf_dir).dump(files=files).withColumn("kind", F.lit("file" if files else "function")) for files in (True, False)]
    return both[0].unionByName(both[1]).select("kind", "ord", "hash", "lib", "version")


def _broken(spark: SparkSession, sf_dir: str) -> Catalog:
    base = catalog(spark, sf_dir)
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.unhex(F.sha2(F.col("p_size").cast("string"), 256)).alias("digest"), (F.col("p_partkey") % 30).cast("int").alias("lib_id"), (F.col("p_size") % 3).cast("int").alias("version_index"))
    return Catalog(base.libs, rows, spark.createDataFrame([], HASHES))


def catalog_sorted(spark, sf_dir):
    return _broken(spark, sf_dir).unsorted().select("ord")


def catalog_dangling(spark, sf_dir):
    return _broken(spark, sf_dir).dangling().select("ord", "lib_id", "version_index")


def catalog_limits(spark, sf_dir):
    libs = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("lib_id"), F.expr("repeat('é', p_size * 4)").alias("name"), F.array(F.expr("repeat('v', p_size * 7)")).alias("versions"))
    return Catalog(libs, spark.createDataFrame([], HASHES), spark.createDataFrame([], HASHES)).over_limits()


def lookup_file(spark, sf_dir):
    return whole_file_matches(page_analysis(spark, sf_dir), catalog(spark, sf_dir)).select("script_id", "lib", "version")


def lookup_func(spark, sf_dir):
    found = function_matches(an.analyze_scripts(part_scripts(spark, sf_dir)), catalog(spark, sf_dir), prune=False)
    return found.select("script_id", "seq", "lib", "version")


def match_prune(spark, sf_dir):
    found = function_matches(an.analyze_scripts(part_scripts(spark, sf_dir)), catalog(spark, sf_dir))
    return found.select("script_id", "seq", "name", "lib", "version")


def _with_whole(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog, with the scripts of the parts divisible by 97 as whole files of library 0 too."""
    base, part = catalog(spark, sf_dir), _table(spark, sf_dir, "part")
    stream = F.expr(f"concat('Program,FunctionDeclaration,Identifier,L0,', {OUTER_STREAM})")
    whole = part.filter("p_partkey % 97 = 0").select(F.unhex(F.sha2(stream, 256)).alias("digest"), F.lit(0).alias("lib_id"), F.lit(1).alias("version_index")).distinct()
    return Catalog(base.libs, numbered(whole), base.funcs)


def match_file_shortcircuit(spark, sf_dir):
    """Function matches where some scripts are whole files of the catalog."""
    return function_matches(an.analyze_scripts(part_scripts(spark, sf_dir)), _with_whole(spark, sf_dir)).select("script_id", "seq", "lib", "version")


def match_nested_result(spark, sf_dir):
    found = check_scripts(an.analyze_scripts(part_scripts(spark, sf_dir)), _with_whole(spark, sf_dir))
    libs = F.aggregate("functions", F.lit(0), lambda n, f: n + F.size(f["libs"]))
    return found.select("script_id", F.size("whole_file").cast("long").alias("n_whole"), F.size("functions").cast("long").alias("n_functions"), libs.cast("long").alias("n_libs"))


def match_errors(spark, sf_dir):
    """Scripts of which every third can't be parsed and every fifth has no source have empty results, and are there."""
    scripts = part_scripts(spark, sf_dir).withColumn("source", F.expr("CASE WHEN script_id % 5 = 0 THEN NULL WHEN script_id % 3 = 0 THEN concat(source, '(') ELSE source END"))
    found = check_scripts(an.analyze_scripts(scripts), catalog(spark, sf_dir))
    return found.select("script_id", F.size("whole_file").cast("long").alias("n_whole"), F.size("functions").cast("long").alias("n_functions"))


def report(spark, sf_dir):
    """Report lines with their place in a script's report."""
    lines = report_lines(an.analyze_scripts(part_scripts(spark, sf_dir)), _with_whole(spark, sf_dir))
    place = F.dense_rank().over(Window.partitionBy("script_id").orderBy("kind", "seq"))
    return lines.select("script_id", place.alias("place"), "line")


def catalog_roundtrip(spark, sf_dir):
    """Records of the catalog built from hash strings, written to its file form and read back."""
    base = catalog(spark, sf_dir)
    tables = [t.select(format_hash(F.col("digest")).alias("hash"), "lib_id", "version_index") for t in (base.files, base.funcs)]
    back = from_bytes(spark, build(base.libs, *tables).to_bytes())
    both = [back.dump(files=files).withColumn("kind", F.lit("file" if files else "function")) for files in (True, False)]
    return both[0].unionByName(both[1]).select("kind", "ord", "hash", "lib", "version")


def bloom_gate(spark, sf_dir):
    """Function matches through the filter of the catalog's file form. A sound filter denies no known digest; one whose
    bits are all 0 denies all."""
    base = catalog(spark, sf_dir)
    read = from_bytes(spark, base.to_bytes())
    analyzed = an.analyze_scripts(part_scripts(spark, sf_dir))
    sound = function_matches(analyzed, read, strict=True).select("script_id", "seq", "lib", "version", F.lit("sound").alias("filter"))
    read = from_bytes(spark, base.to_bytes())
    read.bloom = bytes(len(read.bloom))
    return sound.unionByName(function_matches(analyzed, read, strict=True).select("script_id", "seq", "lib", "version", F.lit("empty").alias("filter")))


def bloom_filter(spark, sf_dir):
    """The bits that ``bloom_build`` sets for the digests of functions. The file form has at most 2^32 of them."""
    funcs = catalog(spark, sf_dir).funcs.orderBy("digest")
    bits, hashes = bloom_build([bytes(r.digest) for r in funcs.select("digest").toLocalIterator()])
    return spark.createDataFrame([(i, hashes) for i in range(8 * len(bits)) if bits[i >> 3] >> (i & 7) & 1], "bit long, probes int")


def stream(spark, sf_dir):
    """Lines of ``match_stream`` over the scripts of parts, written and then read as they arrive."""
    base = new_folder(spark)
    part_scripts(spark, sf_dir).write.parquet(f"{base}/in")
    source = spark.readStream.schema("script_id long, source string").parquet(f"{base}/in")
    out = lambda rows, number: rows.select("script_id", "line").write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    match_stream(source, _with_whole(spark, sf_dir), out, f"{base}/state").awaitTermination()
    return spark.read.schema("script_id long, line string").parquet(f"{base}/out").select("script_id", "line")


def new_folder(spark: SparkSession) -> str:
    """A folder that all executors see: within ``spark.checkpoint.dir``, or a temporary one where that is unset, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/quillmark/stream-{uuid.uuid4().hex}"


def bloom_bits(spark, sf_dir):
    """Places of the seven probes of each function digest, modulo the filter's bits, in DECIMAL arithmetic."""
    digests = catalog(spark, sf_dir).funcs.select("digest")
    bits = digests.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * 10 / 8)).cast("decimal(38,0)").alias("bytes"))
    word = lambda at: F.conv(F.hex(F.reverse(F.substring("digest", at, 8))), 16, 10).cast("decimal(20,0)")
    rows = digests.distinct().withColumns({"h1": F.expr("conv(hex(unhex(concat_ws('', reverse(regexp_extract_all(hex(substring(digest, 1, 8)), '(..)'))))), 16, 10)").cast("decimal(20,0)"), "h2": F.expr("conv(hex(unhex(concat_ws('', reverse(regexp_extract_all(hex(substring(digest, 9, 8)), '(..)'))))), 16, 10)").cast("decimal(20,0)")})
    probes = rows.crossJoin(F.broadcast(bits)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6))))
    place = F.expr("((h1 + cast(i AS decimal(2,0)) * h2) % 18446744073709551616BD) % (bytes * 8BD)").cast("long")
    return probes.select(F.lower(F.hex("digest")).alias("digest"), "i", place.alias("bit"))


QUERIES = {
    "page_file_hash": page_file_hash,
    "page_tokens": page_tokens,
    "part_function_hash": part_function_hash,
    "doc_literal_escape": doc_literal_escape,
    "minified_pairs": minified_pairs,
    "eligibility": eligibility,
    "positions": positions,
    "parse_hash": parse_hash_query,
    "format_hash": format_hash_query,
    "catalog_libs": catalog_libs,
    "catalog_dump": catalog_dump,
    "catalog_sorted": catalog_sorted,
    "catalog_dangling": catalog_dangling,
    "catalog_limits": catalog_limits,
    "lookup_file": lookup_file,
    "lookup_func": lookup_func,
    "match_prune": match_prune,
    "match_file_shortcircuit": match_file_shortcircuit,
    "match_nested_result": match_nested_result,
    "report_lines": report,
    "bloom_bits": bloom_bits,
    "bloom_filter": bloom_filter,
    "bloom_gate": bloom_gate,
    "catalog_roundtrip": catalog_roundtrip,
    "match_errors": match_errors,
    "match_stream": stream,
} | syntax.QUERIES

# ---- SQL
_HASH = f"'{PREFIX}' || sha256({{}})"
_LIBS = "libs AS (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS lib_id, p_brand AS lib FROM (SELECT DISTINCT p_brand FROM part))"
_FUNCS = f"""{_LIBS}, sized AS (SELECT DISTINCT p_size, p_brand AS lib FROM part), funcs AS (
  SELECT 0 AS seq, p_size, lib, sha256({OUTER_STREAM}) AS d, CASE p_size % 2 WHEN 0 THEN '1.0' ELSE '2.0' END AS version FROM sized WHERE p_size % 2 = 0
  UNION ALL
  SELECT 1 AS seq, p_size, lib, sha256({INNER_STREAM}) AS d, CASE p_size % 2 WHEN 0 THEN '1.0' ELSE '2.0' END AS version FROM sized WHERE p_size % 3 = 0
)"""
_ROOTS = f"""roots AS (
  SELECT p_partkey AS script_id, p_size, 0 AS seq, 'f' AS name, sha256({OUTER_STREAM}) AS d FROM part
  UNION ALL
  SELECT p_partkey, p_size, 1, 'g', sha256({INNER_STREAM}) FROM part
), hits AS (SELECT r.*, f.lib, f.version FROM roots r JOIN funcs f USING (d))"""
_PRUNED = "pruned AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits p WHERE p.script_id = h.script_id AND p.seq < h.seq))"
_TOKENS = "['Program','VariableDeclaration','VariableDeclarator','Identifier','L0','StringLiteral','S:</p>','ExpressionStatement','CallExpression','Identifier','F0','NumericLiteral','N:' || page_id]"
_PARTS = f"WITH {_FUNCS}, {_ROOTS}, {_PRUNED} "
_WORD = "(" + " + ".join(f"('0x' || substr(digest, {{0}} + {2 * k}, 2))::UTINYINT::HUGEINT * {256**k}::HUGEINT" for k in range(8)) + ")"

_DUMP = f"""WITH {_FUNCS}, files AS (
  SELECT sha256({FILE_STREAM}) AS d, lib, '1.0' AS version FROM pages JOIN libs ON lib_id = page_id % 5 WHERE page_id % 7 = 0
), both_kinds AS (SELECT 'file' AS kind, d, lib, version FROM files UNION ALL SELECT 'function', d, lib, version FROM funcs)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY d, lib, version) - 1 AS ord, '{PREFIX}' || d AS hash, lib, version FROM both_kinds"""
_WHOLE = "whole AS (SELECT p_partkey AS script_id FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_partkey % 97 = 0))"
_LINE = "'function' || chr(9) || '1:' || CASE name WHEN 'f' THEN 0 ELSE 35 + len(CAST(p_size AS VARCHAR)) END || '-1:' || (CASE name WHEN 'f' THEN 87 ELSE 77 END + 2 * len(CAST(p_size AS VARCHAR))) || chr(9) || name || chr(9) || lib || '@' || version"
_REPORT = f"""WITH {_FUNCS}, {_ROOTS}, {_PRUNED}, {_WHOLE}, lines AS (
  SELECT script_id, -1 AS seq, 'whole-file' || chr(9) || lib || '@2.0' AS line FROM whole, libs WHERE lib_id = 0
  UNION ALL
  SELECT script_id, seq, {_LINE} FROM pruned WHERE script_id NOT IN (SELECT script_id FROM whole)
) """
_BITS = f"WITH {_FUNCS}, n AS (SELECT greatest(1, ceil(count(*) * 10 / 8))::HUGEINT AS bytes FROM funcs), g AS (SELECT DISTINCT d AS digest FROM funcs), bits AS (SELECT digest, CAST(i AS INTEGER) AS i, CAST((({_WORD.format(1)} + i * {_WORD.format(17)}) % 18446744073709551616::HUGEINT) % (bytes * 8) AS BIGINT) AS bit FROM g, n, range(0, 7) t(i)) "

ORACLE_SQL = {
    "page_file_hash": f"SELECT page_id AS script_id, {_HASH.format(FILE_STREAM)} AS file_hash FROM pages",
    "page_tokens": f"SELECT page_id AS script_id, CAST(i - 1 AS INTEGER) AS seq, {_TOKENS}[i] AS token FROM pages, range(1, 14) t(i)",
    "part_function_hash": f"SELECT p_partkey AS script_id, 0 AS seq, 'f' AS name, {_HASH.format(OUTER_STREAM)} AS hash, CAST(4 AS BIGINT) AS stmt_count FROM part UNION ALL SELECT p_partkey, 1, 'g', {_HASH.format(INNER_STREAM)}, 3 FROM part",
    "doc_literal_escape": rf"SELECT doc_id AS script_id, {_HASH.format(chr(39) + 'Program,ExpressionStatement,CallExpression,Identifier,F0,StringLiteral,S:' + chr(39) + ' || replace(replace(text, ' + chr(39) + chr(92) + chr(39) + ', ' + chr(39) + chr(92) * 2 + chr(39) + '), ' + chr(39) + ',' + chr(39) + ', ' + chr(39) + chr(92) + ',' + chr(39) + ')')} AS file_hash FROM documents WHERE text IS NOT NULL",
    "minified_pairs": "SELECT p_partkey, true AS same FROM part",
    "eligibility": "SELECT CAST(l AS INTEGER) AS least, count(*) AS n FROM part, range(0, 7) t(l) WHERE p_size % 5 >= l OR 2 * (p_size % 5) >= greatest(2 * l - 1, 0) GROUP BY 1",
    "positions": "SELECT p_partkey AS script_id, CAST(p_size + 1 AS BIGINT) AS start_line, CAST(CASE p_size WHEN 0 THEN 7 ELSE 1 END AS BIGINT) AS start_column, CAST(p_size + 1 AS BIGINT) AS end_line, CAST(CASE p_size WHEN 0 THEN 7 ELSE 1 END + length('function f(){a();b();c()}') AS BIGINT) AS end_column FROM part",
    "parse_hash": "SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN sha256(p_name) END AS digest FROM part",
    "format_hash": f"SELECT p_partkey, {_HASH.format('p_name')} AS hash FROM part",
    "catalog_libs": f"WITH {_LIBS} SELECT CAST(lib_id AS INTEGER) AS lib_id, CAST(i AS INTEGER) AS version_index, lib AS name, CASE i WHEN 0 THEN '1.0' ELSE '2.0' END AS version FROM libs, range(0, 2) t(i)",
    "catalog_dump": _DUMP,
    "catalog_roundtrip": _DUMP,
    "catalog_sorted": "SELECT ord FROM (SELECT p_partkey AS ord, sha256(CAST(p_size AS VARCHAR)) AS d, lag(sha256(CAST(p_size AS VARCHAR))) OVER (ORDER BY p_partkey) AS b FROM part) WHERE b > d",
    "catalog_dangling": f"WITH {_LIBS} SELECT p_partkey AS ord, CAST(p_partkey % 30 AS INTEGER) AS lib_id, CAST(p_size % 3 AS INTEGER) AS version_index FROM part WHERE p_partkey % 30 NOT IN (SELECT lib_id FROM libs) OR p_size % 3 > 1",
    "catalog_limits": "SELECT CAST(p_partkey AS INTEGER) AS lib_id, CASE WHEN 8 * p_size > 255 THEN 'name' ELSE 'version' END AS problem FROM part WHERE 8 * p_size > 255 OR 7 * p_size > 255",
    "lookup_file": f"WITH {_LIBS} SELECT page_id AS script_id, lib, '1.0' AS version FROM pages JOIN libs ON lib_id = page_id % 5 WHERE page_id % 7 = 0",
    "lookup_func": f"{_PARTS} SELECT script_id, CAST(seq AS INTEGER) AS seq, lib, version FROM hits",
    "match_prune": f"{_PARTS} SELECT script_id, CAST(seq AS INTEGER) AS seq, name, lib, version FROM pruned",
    "match_file_shortcircuit": f"{_PARTS} SELECT script_id, CAST(seq AS INTEGER) AS seq, lib, version FROM pruned WHERE p_size NOT IN (SELECT p_size FROM part WHERE p_partkey % 97 = 0)",
    "match_nested_result": f"WITH {_FUNCS}, {_ROOTS}, {_PRUNED}, {_WHOLE} SELECT p.p_partkey AS script_id, CASE WHEN w.script_id IS NULL THEN CAST(0 AS BIGINT) ELSE 1 END AS n_whole, count(DISTINCT r.seq) FILTER (w.script_id IS NULL) AS n_functions, count(r.lib) FILTER (w.script_id IS NULL) AS n_libs FROM part p LEFT JOIN pruned r ON r.script_id = p.p_partkey LEFT JOIN whole w ON w.script_id = p.p_partkey GROUP BY p.p_partkey, w.script_id",
    "match_errors": f"{_PARTS} SELECT p_partkey AS script_id, CAST(0 AS BIGINT) AS n_whole, count(DISTINCT seq) AS n_functions FROM part LEFT JOIN pruned ON script_id = p_partkey AND script_id % 5 <> 0 AND script_id % 3 <> 0 GROUP BY 1",
    "report_lines": f"{_REPORT} SELECT script_id, CAST(dense_rank() OVER (PARTITION BY script_id ORDER BY seq) AS INTEGER) AS place, line FROM lines",
    "match_stream": f"{_REPORT} SELECT script_id, line FROM lines",
    "bloom_bits": f"{_BITS} SELECT digest, i, bit FROM bits",
    "bloom_filter": f"{_BITS} SELECT DISTINCT bit, CAST(7 AS INTEGER) AS probes FROM bits",
    "bloom_gate": f"{_PARTS} SELECT script_id, CAST(seq AS INTEGER) AS seq, lib, version, 'sound' AS filter FROM pruned",
} | syntax.ORACLE_SQL
