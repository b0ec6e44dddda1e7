"""The engine's queries against DuckDB, and the front end against worked examples and pairs of sources."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark.jsfront.lexer import JsSyntaxError
from quillmark.jsfront.roots import analyze
from quillmark.operators import analyze as an
from quillmark.operators.catalog import build, from_bytes, load_parquet
from quillmark.operators.match import check_scripts, function_matches
from quillmark.plans.registry import ORACLE_SQL, QUERIES
from quillmark.sources.catalog_file import CatalogError, bloom_may_contain, decode, encode

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_worked_examples():
    assert analyze('var t="</p>";track(0);').digest == "d84479cf09807c03481f7d73184483ee48047fb5d832e065e4de9fd1247aae89"
    assert analyze("function f(a,b){var c=a+b;var d=c*7;return d;}").roots[0].digest == "451385b1c0f4f4847c53daa293c27b2b3590ba7629d5efa8912403939efc1e22"
    assert analyze('$("h1, h2");').digest == "7d995c85b25d5c49e7fc51a9a55a0b38b033ba9fb21a159ede5925a1261b5474"


SAME = [("x = true", "x = !0"), ("x = void 0", "x = undefined"), ("o = {a: 1, b: 2}", "o = {b: 2, a: 1}"), ("++x", "x++"), ("f(1)", "g(1)"), ("let a = 1", "var b = 1"), ("o['k']", "o.k"), ("x => x", "y => { return y }"), ("[,a]", "[a]"), ("a\n/* c */ + b", "a+b"), ("function f(p) { return void 0 }", "function f(q) { return }")]
DIFFER = [("x = typeof 0", "x = true"), ('f("a, b")', 'f("a"); f("b")'), ("x + 1", "x - 1"), ("o.a", "o.b"), ("`\\n`", '"\\n"'), ("a?.b", "a.b"), ("x = 1", "x = 2")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert analyze(a).digest == analyze(b).digest


@pytest.mark.parametrize(("a", "b"), DIFFER)
def test_differ(a, b):
    assert analyze(a).digest != analyze(b).digest


def test_roots():
    assert [r.name for r in analyze("function pick(){ return go(), stop(), wait() }").roots] == ["pick"]
    assert analyze("function pick(){ return shop.price }").roots == []
    assert "deep" in [r.name for r in analyze("+function(){ function deep(n){ let m=n; m--; return m } }()").roots]
    assert analyze("class A { m() { a(); b(); c() } }", 9).roots == []
    with pytest.raises(JsSyntaxError):
        analyze("var = 1")


def _catalog_bytes(**x):
    return encode(3, x.get("libs", [("a", ["1", "2"]), ("b", ["1"])]), x.get("files", [(b"\2" * 32, 0, 1), (b"\1" * 32, 1, 0)]), x.get("funcs", [(bytes([i]) * 32, 0, 0) for i in range(20)]))


def test_catalog_file(spark):
    data = _catalog_bytes()
    c = decode(data)
    assert [r[0][0] for r in c.file_hashes] == [1, 2] and len(c.bloom) == 25 and c.bloom_hashes == 7
    assert all(bloom_may_contain(c.bloom, 7, r[0]) for r in c.func_hashes)
    table = from_bytes(spark, data)
    assert table.to_bytes() == data and [r.lib for r in table.dump().collect()] == ["b", "a"] and table.dangling().isEmpty()
    tables = len(data) - 5 - 25
    for cut in (*range(17), *range(17, tables)):
        with pytest.raises(CatalogError):
            decode(data[:cut])
    for n in range(5):
        decode(data[: tables + n])
    decode(data + b"more")
    for bad in (b"XXX" + data[3:], data[:3] + b"\2" + data[4:]):
        with pytest.raises(CatalogError):
            decode(bad)
    with pytest.raises(CatalogError):
        _catalog_bytes(files=[(b"\0" * 32, 7, 0)])
    with pytest.raises(CatalogError):
        _catalog_bytes(libs=[("x" * 256, [])])


def test_matching(spark):
    src = "function outer(a){ var b=a+1; function inner(c){ var d=c*2; var e=d+1; return e } return inner(b) }"
    scripts = spark.createDataFrame([(1, src), (2, "var = "), (3, "x()"), (4, None)], "script_id long, source string")
    analyzed = an.analyze_scripts(scripts)
    outer, inner = [r.hash for r in an.functions_of(analyzed, ["script_id"]).filter("script_id = 1").orderBy("seq").collect()]
    libs = spark.createDataFrame([(0, "one", ["1"]), (1, "two", ["1"])], "lib_id int, name string, versions array<string>")
    table = lambda rows: spark.createDataFrame(rows, "hash string, lib_id int, version_index int")
    both = build(libs, table([]), table([(outer, 0, 0), (outer, 1, 0), (inner, 0, 0)]))
    assert [(r.name, r.lib) for r in function_matches(analyzed, both).orderBy("ord").collect()] == [("outer", "one"), ("outer", "two")]
    only = build(libs, table([]), table([(inner, 0, 0)]))
    assert [r.name for r in function_matches(analyzed, only).collect()] == ["inner"]
    whole = build(libs, table([(analyzed.filter("script_id = 1").head().file_hash, 1, 0)]), table([(outer, 0, 0)]))
    rows = {r.script_id: r for r in check_scripts(analyzed, whole).collect()}
    assert len(rows) == 4 and rows[1].whole_file[0].lib == "two" and not rows[1].functions and not rows[2].whole_file
    with pytest.raises(CatalogError):
        build(libs, table([("slh1-zz", 0, 0)]), table([]))


def test_prune_equals_list_scan():
    rng = random.Random(1)
    for _ in range(300):
        spans = []

        def nest(lo, hi):
            while hi - lo > 2 and rng.random() < 0.7:
                a = rng.randrange(lo, hi - 1)
                b = rng.randrange(a + 1, hi)
                spans.append((a, b))
                nest(a + 1, b)
                lo = b + 1

        nest(0, 60)
        hit = [s for s in spans if rng.random() < 0.5]
        kept, seen, top = [], [], -1
        for a, b in hit:
            if not any(x <= a and b <= y for x, y in kept):
                kept.append((a, b))
            if b > top:
                seen.append((a, b))
            top = max(top, b)
        assert kept == seen


def _mangled(source, rng):
    """The source with other white space, and each name of its own replaced by another."""
    fresh = iter(rng.sample([f"v{i}" for i in range(100)], 100))
    names = {n: next(fresh) for n in ("first", "second", "total", "count", "item")}
    out = re.sub(r"\b(first|second|total|count|item)\b", lambda m: names[m[0]], source)
    return re.sub(r" +", lambda m: rng.choice([" ", "\t", "  /* x */ "]), out)


LIBRARY = "var total = 0 ; function add ( first , second ) { var count = first + second ; total += count ; if ( count > 10 ) { throw 'many' ; } return total ; } class Box { put ( item ) { this.held = item ; add ( item , 1 ) ; return this.held ; } }"
MUTATIONS = [("+ second", "- second"), ("> 10", "> 11"), ("'many'", "'much'"), ("this.held = item", "this.kept = item"), ("return total", "return count"), ("throw", "return"), ("put ( item )", "put ( item , item2 )"), ("total += count ;", "total += count ; add ( ) ;"), ("class Box", "class Box extends add"), (" } }", " } } add ( )")]


def test_mangling_is_stable():
    rng = random.Random(7)
    want = analyze(LIBRARY, 1)
    for _ in range(30):
        got = analyze(_mangled(LIBRARY, rng), 1)
        assert got.digest == want.digest and [r.digest for r in got.roots] == [r.digest for r in want.roots]


@pytest.mark.parametrize(("old", "new"), MUTATIONS)
def test_mutations_show(old, new):
    assert LIBRARY.count(old) >= 1 and analyze(LIBRARY.replace(old, new, 1)).digest != analyze(LIBRARY).digest


def test_cli_end_to_end(spark, tmp_path, capsys):
    from quillmark import cli
    from quillmark.operators.catalog import load
    from quillmark.operators.match import write_report

    known, other = "function go(a){ var b=a*2; b+=3; return b }", "(function(){ go(1); function go(a){ var b=a*2; b+=3; return b } })()"
    scripts = spark.createDataFrame([("1", known), ("2", other)], "script_id string, source string")
    analyzed = an.analyze_scripts(scripts)
    one = an.functions_of(analyzed.filter("script_id = '1'"), ["script_id"]).head().hash
    libs = spark.createDataFrame([(0, "lib", ["1.0"])], "lib_id int, name string, versions array<string>")
    rows = lambda h: spark.createDataFrame([(h, 0, 0)], "hash string, lib_id int, version_index int")
    catalog = build(libs, rows(analyzed.filter("script_id = '1'").head().file_hash), rows(one))
    (tmp_path / "c.slhdb").write_bytes(catalog.to_bytes())
    (tmp_path / "a.js").write_text(known)
    (tmp_path / "b.js").write_text(other)
    (tmp_path / "bad.js").write_bytes(b"\xff")
    run = lambda *args: (cli.main(["check", "--db", f"{tmp_path}/c.slhdb", "--script", *args]), capsys.readouterr())
    code, said = run(f"{tmp_path}/a.js")
    assert code == 0 and said.out == "whole-file\tlib@1.0\n"
    code, said = run(f"{tmp_path}/[ab].js")
    assert code == 0 and said.out == "whole-file\tlib@1.0\nfunction\t1:20-1:63\tgo\tlib@1.0\n"
    code, said = run(f"{tmp_path}/bad.js")
    assert code == 1 and "UTF-8" in said.err
    assert cli.main([]) == 0 and cli.main(["nonsense"]) == 1
    write_report(analyzed, load(spark, f"{tmp_path}/c.slhdb"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["whole-file\tlib@1.0", "function\t1:20-1:63\tgo\tlib@1.0"]
    with catalog as held:
        assert [r.name for r in held.list_libs().collect()] == ["lib"]
    with pytest.raises(CatalogError):
        build(libs, rows(one), rows(one), 256)
    with pytest.raises(CatalogError):
        build(spark.createDataFrame([(65536, "x", ["1"])], libs.schema), rows(one), rows(one))
    catalog.write_parquet(f"{tmp_path}/p")
    assert load_parquet(spark, f"{tmp_path}/p").to_bytes() == catalog.to_bytes()


def test_limits_of_many_libraries(spark, tmp_path):
    """A library's own limits don't depend on its number, as in the SQL; that there are too many is refused when building."""
    db = duckdb.connect()
    db.execute("CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, s::INTEGER AS p_size FROM (VALUES (1, 1), (2, 50), (65535, 34), (65536, 1), (65537, 50), (1200000, 34), (1200001, 31), (1200002, NULL)) t(k, s)")
    db.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    want = db.execute(ORACLE_SQL["catalog_limits"]).fetchall()
    got = QUERIES["catalog_limits"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 4
    known = [spark.createDataFrame([], "hash string, lib_id int, version_index int")] * 2
    libs = spark.createDataFrame([(i, "x", ["1"]) for i in (0, 65535)], "lib_id int, name string, versions array<string>")
    assert build(libs, *known).beyond() is None and build(libs.limit(0), *known).beyond() is None
    with pytest.raises(CatalogError, match="too many libraries"):
        build(libs.withColumn("lib_id", F.col("lib_id") + 1), *known)


def test_scripts_are_parsed_once(spark):
    """One Python stage over sources in the plan of each kind of result, and no window over a whole table."""
    from quillmark.operators.match import report_lines
    from quillmark.plans.registry import catalog, part_scripts

    analyzed, known = an.analyze_scripts(part_scripts(spark, SF)), catalog(spark, SF)
    for found in (check_scripts(analyzed, known), report_lines(analyzed, known), function_matches(analyzed, known)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1 and "Window [" in plan and "SinglePartition" not in plan.split("InMemoryRelation")[0]


def test_cli():
    from quillmark.cli import UsageError, parse_check

    assert parse_check(["--db", "a", "--script", "b"]) == ("a", "b") == parse_check(["a", "b"])
    assert parse_check(["-h"]) is None
    for bad in (["--db"], ["a"], ["--x"], ["--db", "a"]):
        with pytest.raises(UsageError):
            parse_check(bad)


def test_stream(spark, tmp_path):
    from quillmark.streaming.scripts import match_stream

    scripts = spark.createDataFrame([(1, "a(1)"), (2, "b.c")], "script_id long, source string")
    libs = spark.createDataFrame([(0, "one", ["1"])], "lib_id int, name string, versions array<string>")
    known = an.analyze_scripts(scripts).filter("script_id = 1").select(F.col("file_hash").alias("hash"), F.lit(0).alias("lib_id"), F.lit(0).alias("version_index"))
    catalog = build(libs, known, known.limit(0))
    scripts.write.parquet(f"{tmp_path}/in")
    got = []
    match_stream(spark.readStream.schema(scripts.schema).parquet(f"{tmp_path}/in"), catalog, lambda rows, _: got.extend(r.line for r in rows.collect()), f"{tmp_path}/cp").awaitTermination()
    assert got == ["whole-file\tone@1"]
