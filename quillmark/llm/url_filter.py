"""Filtering URLs: rules by host and path first, and for the rest the ratio of two smoothed variable-order Markov
models of characters, one of accepted and one of rejected URLs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import BROADCAST_ROWS, Workspace, ascii_lower, read_table

#: Characters of context at most; a context and the next character, with their number, fit in 64 bits up to 6.
ORDER = 5
#: At most so many grams are sent to all executors, the most frequent ones; the others are joined.
HEAD_GRAMS = BROADCAST_ROWS
#: Weight of the shorter context against counts of the longer one.
BACK_OFF = 2.0
ALPHABET = 256
#: Units of a difference of logarithms.
UNIT = float(1 << 32)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. A rule ``host/path`` fits its host and all subdomains, if the path
    starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        of, _, rest = name.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(urls: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of each URL and its end: the number of the URL, and its gram, which is the character after
    as much context as there is. A gram is a long: its bytes, the last one lowest, and above them how many there are."""
    parts = [u.encode("utf-8", "surrogatepass") + b"\0" if u else b"" for u in urls]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64)
    at = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = raw | (np.minimum(at, ORDER) + 1) << 8 * (ORDER + 1)
    for k in range(1, ORDER + 1):
        gram[k:] |= np.where(at[k:] >= k, raw[: max(len(raw) - k, 0)], 0) << 8 * k
    return np.repeat(np.arange(len(parts)), sizes), gram


def _count(rows: DataFrame) -> DataFrame:
    """(gram, seen, allow, block) from rows (url, verdict): how often in all of them, and in those of each verdict."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of, gram = _grams(batch["url"])
            code = batch["verdict"].map({"allow": 1, "block": 2}).fillna(0).to_numpy(np.int64)
            found, n = np.unique(gram << 2 | code[of], return_counts=True)
            yield pd.DataFrame({"gram": found >> 2, "seen": n, "allow": np.where(found & 3 == 1, n, 0), "block": np.where(found & 3 == 2, n, 0)})

    sums = [F.sum(c).alias(c) for c in ("seen", "allow", "block")]
    return rows.mapInPandas(count, "gram long, seen long, allow long, block long").groupBy("gram").agg(*sums)


def _worths(grams: DataFrame, ws: Workspace) -> DataFrame:
    """(gram, seen, worth) of each gram of a URL: the logarithm of its probability by the model of accepted URLs less
    that by the model of rejected ones, in units of 2^-32, so that sums don't depend on their order.

    A model interpolates from order 0 up: p_k = (count(context, character) + BACK_OFF * p_(k-1)) / (count(context) +
    BACK_OFF). Counts of an order are summed from those of the next one, which has at most 256 rows for each, and
    from the grams at the start of URLs, which have no more context. Likewise a context has at most 256 characters.
    """
    bits = 8 * (ORDER + 1)
    parts = grams.withColumns({"size": F.shiftright("gram", bits), "value": F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))})
    orders: list[DataFrame] = []
    for k in range(ORDER, -1, -1):
        own = parts.filter(F.col("size") == k + 1).select("value", "seen", "allow", "block")
        if orders:
            longer = orders[-1].select(F.col("value").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("value"), F.lit(0).cast("long").alias("seen"), "allow", "block")
            own = own.unionByName(longer).groupBy("value").agg(*[F.sum(c).alias(c) for c in ("seen", "allow", "block")])
        orders.append(ws.keep(own))
    after = Window.partitionBy(F.shiftright("value", 8))
    shorter, out = None, None
    for k, own in enumerate(reversed(orders)):
        rows = own.withColumns({f"{c}_context": F.sum(c).over(after) for c in ("allow", "block")})
        if shorter is None:
            rows = rows.withColumns({f"{c}_p": F.lit(1.0 / ALPHABET) for c in ("allow", "block")})
        else:
            rows = rows.withColumn("_shorter", F.col("value").bitwiseAND(F.lit((1 << 8 * k) - 1)))
            rows = rows.join(shorter.select(F.col("value").alias("_shorter"), "allow_p", "block_p"), "_shorter")
        p = {f"{c}_p": F.least((F.col(c) + BACK_OFF * F.col(f"{c}_p")) / (F.col(f"{c}_context") + BACK_OFF), F.lit(1.0)) for c in ("allow", "block")}
        shorter = ws.keep(rows.withColumns(p).select("value", "seen", "allow_p", "block_p"))
        worth = F.round((F.log("allow_p") - F.log("block_p")) * UNIT).cast("long")
        part = shorter.filter("seen > 0").select(F.col("value").bitwiseOR(F.lit((k + 1) << bits)).alias("gram"), "seen", worth.alias("worth"))
        out = part if out is None else out.unionByName(part)
    found = ws.keep(out)
    ws.drop(*orders)
    return found


def _rate(rows: DataFrame, worths: DataFrame, ws: Workspace) -> DataFrame:
    """``rows``, kept, with ratio from their url: the mean worth of its grams, 0 for a null or empty one.

    The most frequent grams are sent out and summed in the scan. Where there are more than HEAD_GRAMS, the rest of a
    row's grams are joined, each of them a less frequent one; results don't depend on which are.
    """
    power = F.floor(F.log2("seen")).cast("int")
    total, least = 0, 64
    for r in sorted(worths.groupBy(power.alias("power")).count().collect(), reverse=True):
        total += r["count"]
        if total > HEAD_GRAMS:
            break
        least = r.power
    head = worths.filter(power >= least).select("gram", "worth").toPandas().sort_values("gram")
    rest = worths.filter(power < least).select("gram", "worth")
    shared = rows.sparkSession.sparkContext.broadcast((head["gram"].to_numpy(np.int64), head["worth"].to_numpy(np.int64)))

    @F.pandas_udf("sum long, rest array<long>")
    def part(urls: pd.Series) -> pd.DataFrame:
        known, worth = shared.value
        of, gram = _grams(urls)
        sums, others = np.zeros(len(urls), np.int64), [[]] * len(urls)
        if len(gram):
            place = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
            hit = known[place] == gram if len(known) else np.zeros(len(gram), bool)
            np.add.at(sums, of[hit], worth[place[hit]])
            if not hit.all():
                cuts = np.searchsorted(of[~hit], np.arange(len(urls) + 1))
                others = [gram[~hit][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"sum": sums, "rest": others})

    found = ws.keep(rows.withColumn("_part", part("url")).withColumn("_row", F.monotonically_increasing_id()))
    total = F.col("_part.sum")
    if total_rest := worths.count() - len(head):
        joined = found.select("_row", F.explode("_part.rest").alias("gram")).join(rest, "gram").groupBy("_row").agg(F.sum("worth").alias("_rest"))
        found, total = found.join(joined, "_row", "left"), total + F.coalesce("_rest", F.lit(0))
    mean = F.coalesce(total / UNIT / (F.octet_length("url") + 1), F.lit(0.0))
    out = found.withColumn("ratio", mean).drop("_part", "_row", "_rest")
    return ws.keep(out) if total_rest else out


#: Ratios are calibrated on a histogram of so many cells over [-SPAN, SPAN].
CELLS, SPAN = 4000, 10.0


def _threshold(rated: DataFrame) -> float:
    """Where the share of accepted URLs below it and the share of rejected ones above it sum to the least, next to 0 in
    ties, from a histogram of rows (verdict, ratio). With only one kind of rows, or none, it is 0."""
    cells = rated.select("verdict", F.least(F.greatest(F.floor((F.col("ratio") / (2 * SPAN) + 0.5) * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int").alias("cell"))
    hist = {"allow": np.zeros(CELLS), "block": np.zeros(CELLS)}
    for r in cells.groupBy("verdict", "cell").count().collect():
        hist[r.verdict][r.cell] = r["count"]
    if not (hist["allow"].sum() and hist["block"].sum()):
        return 0.0
    below = np.concatenate([[0], np.cumsum(hist["allow"])]) / hist["allow"].sum()
    above = 1 - np.concatenate([[0], np.cumsum(hist["block"])]) / hist["block"].sum()
    edges = (np.arange(CELLS + 1) / CELLS - 0.5) * 2 * SPAN
    return float(min(zip(np.round(below + above, 9), np.abs(edges), edges, strict=True))[2])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, ratio, verdict.

    Models learn from three quarters of the URLs that a rule decides, as given; a rule's verdict always stands. A hash
    of the url sets the other quarter apart: it is never counted and sets the threshold. Null and malformed URLs have
    empty host and path; a null one has ratio 0, and the verdict the threshold gives it. Repeated rows get equal
    verdicts, a null id is passed on, an empty table gives an empty result. Counts are exact, in tables that grow with
    the number of distinct grams; they are summed before they are shuffled, so no host is gathered in a task.
    """
    ws = Workspace(pages.sparkSession, "urls")
    url = F.col(url_col)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"rule": rule, "ruled": verdict})
    apart = F.pmod(F.xxhash64("url"), F.lit(4)) == 3
    grams = ws.keep(_count(rows.select("url", F.when(~apart, F.col("ruled")).alias("verdict"))))
    rated = _rate(rows, _worths(grams, ws), ws)
    threshold = _threshold(rated.filter(apart & F.col("ruled").isin("allow", "block")).select(F.col("ruled").alias("verdict"), "ratio"))
    judged = F.coalesce("ruled", F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    return rated.select(id_col, "host", "path", "rule", "ratio", judged.alias("verdict"))


#: The rules of the query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")
