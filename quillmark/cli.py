"""``python -m quillmark.cli check --db FILE --script FILE``: what is known of a script, as tab-separated lines. The
script may be a glob, and files may be in any store that Spark reads."""

from __future__ import annotations

import sys

USAGE = "usage: quillmark check --db FILE --script FILE\n       quillmark check FILE FILE\n       quillmark help"


class UsageError(ValueError):
    pass


def parse_check(args: list[str]) -> tuple[str, str] | None:
    """(catalog, script), or None for help."""
    db = script = None
    rest, it = [], iter(args)
    for a in it:
        if a in ("--db", "--script"):
            value = next(it, None)
            if value is None:
                raise UsageError(f"{a} needs a value")
            db, script = (value, script) if a == "--db" else (db, value)
        elif a in ("-h", "--help"):
            return None
        elif a.startswith("-"):
            raise UsageError(f"no such option: {a}\n\n{USAGE}")
        else:
            rest.append(a)
    if db is None and script is None and len(rest) == 2:
        return rest[0], rest[1]
    if rest:
        raise UsageError(f"more arguments than expected: {' '.join(rest)}\n\n{USAGE}")
    for name, value in (("--db", db), ("--script", script)):
        if value is None:
            raise UsageError(f"{name} is needed\n\n{USAGE}")
    return db, script


def check(spark, db: str, script: str) -> list[str]:
    from pyspark.sql import functions as F

    from quillmark.operators.analyze import analyze_scripts
    from quillmark.operators.catalog import load
    from quillmark.operators.match import report_lines

    catalog = load(spark, db)
    files = spark.read.format("binaryFile").load(script).select(F.col("path").alias("script_id"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("source"))
    if bad := files.filter("source IS NULL").head():
        raise ValueError(f"{bad.script_id} is not UTF-8")
    lines = report_lines(analyze_scripts(files, catalog.min_statements), catalog)
    return [r.line for r in lines.orderBy("script_id", "kind", "seq", "ord").toLocalIterator()]


def main(argv: list[str]) -> int:
    try:
        if not argv or argv[0] in ("help", "-h", "--help"):
            print(USAGE)
            return 0
        if argv[0] != "check":
            raise UsageError(f"no such command: {argv[0]}\n\n{USAGE}")
        asked = parse_check(argv[1:])
        if asked is None:
            print(USAGE)
            return 0
        from pyspark.sql import SparkSession

        for line in check(SparkSession.builder.getOrCreate(), *asked):
            print(line)
        return 0
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
