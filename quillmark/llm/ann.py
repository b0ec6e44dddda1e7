"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables, and exact reranking. Lists and codes rule out by bounds, so nothing near is missed."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import Workspace, read_table, salt

#: Vectors that centroids and codebooks are fitted on at most; all vectors are indexed.
SAMPLE = 20_000
#: Coarse lists at most, and parts and codes of the product quantiser.
MAX_LISTS, PARTS, CODES = 4_096, 16, 256
#: Vectors of a list that are scored together at most, and numbers in them at most.
PIECE, PIECE_NUMBERS = 8_192, 1 << 20
#: Vectors that a task holds, about, and numbers in them, about.
HELD, HELD_NUMBERS = 65_536, 1 << 22
#: Tasks of a search at least.
TASKS = 8
#: Queries that are compared with a piece together.
TOGETHER = 128
#: Vectors of the sample that tell a query what to reach, at most, and an eighth of the sample at most.
FIRST = 2_048


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Index:
    """What is fitted: centroids, and codebooks of residuals; some vectors of the sample, where queries start; and, once
    all vectors are in their lists, what bounds the inner products of a list, and which task holds it."""

    def __init__(self, sample: np.ndarray, vectors: int, k: int, seed: int = 7):
        self.first = sample[: min(len(sample), max(k + 1, min(FIRST, len(sample) // 8)))]
        lists = max(1, min(MAX_LISTS, round(math.sqrt(vectors)), len(sample)))
        self.centres = _kmeans(sample, lists, 8, seed)
        dim = sample.shape[1]
        parts = min(PARTS, dim)
        self.cuts = np.linspace(0, dim, parts + 1).astype(int)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [_kmeans(np.ascontiguousarray(rest[:, a:b]), min(CODES, len(rest)), 6, seed + 1 + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]
        #: Rounding of an inner product, as a share of the lengths of what is multiplied.
        self.rounding = 4 * (dim + 64) * np.finfo(float).eps
        self.piece = max(1, min(PIECE, PIECE_NUMBERS // dim))

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.centres[own]
        return np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def settle(self, sizes: np.ndarray, far: np.ndarray, longest: np.ndarray) -> None:
        """Take in how many vectors each list has, how far they are from its centroid at most, and how long at most; and deal
        the lists to tasks, near lists to the same one. Long lists are cut into pieces, which may go to several tasks."""
        self.far, self.scale = far, _norm(self.centres) + far + longest
        self.longest = longest
        self.order = np.array([x for x in _halved(self.centres, np.arange(len(sizes))) if sizes[x]], np.int64)
        self.pieces = np.maximum(1, -(-sizes // self.piece))
        pieces = self.pieces[self.order]
        self.base = np.zeros(len(sizes), np.int64)
        self.base[self.order] = np.cumsum(pieces) - pieces
        load = np.repeat(sizes[self.order] / pieces, pieces)
        most = min(HELD, HELD_NUMBERS // self.centres.shape[1] + 1, sizes.sum() / TASKS)
        self.task_of = np.unique(((np.cumsum(load) - load / 2) / most).astype(np.int64), return_inverse=True)[1]
        self.tasks = int(self.task_of[-1]) + 1
        listed = np.repeat(np.arange(len(self.order)), pieces)
        self.lo, self.hi = (np.array([f(listed[self.task_of == t]) for t in range(self.tasks)]) for f in (np.min, np.max))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no inner product of a query with a vector of a list exceeds: that with the centroid and the query's length
        times how far vectors are from it, or the query's length times theirs."""
        length = _norm(queries)[:, None]
        return np.minimum(queries @ self.centres.T + length * self.far, length * self.longest) + length * self.scale * self.rounding

    def start(self, queries: np.ndarray, k: int) -> np.ndarray:
        """What each query reaches at least: the k-th best inner product of the first vectors of the sample, if there are k."""
        if len(self.first) < k:
            return np.full(len(queries), -np.inf)
        hit = np.argpartition(-(queries @ self.first.T), k - 1, axis=1)[:, :k]
        return exact(self.first[hit], queries[:, None, :]).min(axis=1)

    def sent(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which tasks (columns) each query goes to: those holding a list whose bound reaches ``least``."""
        go = ~(self.bounds(queries)[:, self.order] < least[:, None])
        before = np.concatenate([np.zeros((len(queries), 1), np.int64), np.cumsum(go, axis=1)], axis=1)
        return before[:, self.hi + 1] > before[:, self.lo]

    def hold(self, own: np.ndarray, cids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> list[tuple]:
        """A task's vectors by list, in pieces: list, ids, vectors, codes, how far codes are off, and lengths."""
        out, order = [], np.argsort(own, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            for at in range(0, len(rows), self.piece):
                r = rows[at : at + self.piece]
                where = int(own[r[0]])
                out.append((where, cids[r], x[r], codes[r], _norm(x[r] - self.centres[where] - self.decode(codes[r])), _norm(x[r])))
        return out

    def search(self, held: list[tuple], queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query its k best of the pieces that a task holds and that reach ``least``: number of the query, id, inner product.

        A list is passed over if its bound is below what the query has reached, and so is a vector, by distance tables of
        the query over the codes and how far its code is off; the others are scored by one matrix product, and those that
        may be among the k best exactly. Comparisons let through what isn't a number.
        """
        n, length, most = len(queries), _norm(queries), self.bounds(queries)
        of, near, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), least.copy()
        gain = np.nan_to_num(most.max(axis=0))
        for where, cids, x, codes, off, size in sorted(held, key=lambda h: -gain[h[0]]):
            ask = np.flatnonzero(~(most[:, where] < floor))
            if not len(ask):
                continue
            q, slack = queries[ask], length[ask] * self.scale[where] * self.rounding
            rough = np.tile(q @ self.centres[where], (len(x), 1))
            for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
                rough += np.take(book @ q[:, a:b].T, codes[:, i], axis=0)
            rough += off[:, None] * length[ask]
            may = ~(np.minimum(rough, size[:, None] * length[ask], out=rough) + slack < floor[ask])
            rows = np.flatnonzero(may.any(axis=1))
            if not len(rows):
                continue
            score_of = np.where(may[rows], x[rows] @ q.T, -np.inf)
            reach = floor[ask]
            if len(rows) > k:
                reach = np.fmax(reach, np.partition(score_of, -k, axis=0)[-k] - slack)
            j, i = np.nonzero(may[rows] & ~(score_of + slack < reach))
            block = max(1, PIECE_NUMBERS // x.shape[1])
            found = np.concatenate([exact(x[rows[j[at : at + block]]], q[i[at : at + block]]) for at in range(0, len(j), block)] or [np.zeros(0)])
            of, near, score = np.concatenate([of, ask[i]]), np.concatenate([near, cids[rows[j]]]), np.concatenate([score, found])
            order = np.lexsort((near, -score, of))
            counts = np.bincount(of, minlength=n)
            ends = np.cumsum(counts)
            order = order[np.arange(len(order)) - np.repeat(ends - counts, counts) < k]
            of, near, score = of[order], near[order], score[order]
            full = np.flatnonzero(counts >= k)
            floor[full] = np.fmax(least[full], score[np.cumsum(np.minimum(counts, k))[full] - 1])
        good = ~(score < least[of])
        return of[good], near[good], score[good]


def _halved(x: np.ndarray, at: np.ndarray) -> list[int]:
    """Points in an order that keeps near ones together: halves across the widest direction, and halves of these."""
    if len(at) < 2:
        return at.tolist()
    at = at[np.argsort(x[at, np.argmax(x[at].std(axis=0))], kind="stable")]
    return _halved(x, at[: len(at) // 2]) + _halved(x, at[len(at) // 2 :])


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=-1))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products, summed in the same order wherever they are formed."""
    return (x * y).sum(axis=-1)


def _matrix(v) -> np.ndarray:
    return np.frombuffer(b"".join(v), "<f8").reshape(len(v), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows whose vector takes part: with an id, not null, no null, NaN or infinity in it, not all zero."""
    v = F.col(vec_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): of each row that ``is_query`` holds for, the k nearest other rows.

    Nearness is the largest inner product in double precision; ties go to the smaller id. Equal vectors form a class
    that is indexed once with its k + 1 smallest ids, which are all that any answer can name; so one very common vector
    is neither gathered nor scored again. The index is fitted on up to 20,000 classes chosen by a hash; every class is
    indexed. The fit decides how much work is spared, not what is found: lists and codes are passed over only by what
    bounds their inner products, however queries and other rows are spread. Each task holds about 65,536 vectors of near
    lists (fewer, if long), and the queries that may find something there stream past; it returns at most k + 1 rows of
    a query. Where lists don't bound well, as of vectors without clusters, every query meets every task, and work grows
    with the square of the rows. The driver gets the sample and one row a list.

    Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows without id; such
    queries have no rows. Inner products need equal lengths: each length is a table of its own, with an index of its
    own. Repeated rows (same id and vector) count once. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    rows = usable(vectors, id_col, vec_col)
    out = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    for r in sorted(rows.select(F.size("v").alias("d")).distinct().collect()):
        out = out.unionByName(_nearest_of(rows.filter(F.size("v") == r.d), is_query, k, ws))
    return out


def _nearest_of(vectors: DataFrame, is_query, k: int, ws: Workspace) -> DataFrame:
    """The same, for rows (id, v) of one length."""
    spark = vectors.sparkSession

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [(np.asarray(v, dtype="<f8") + 0.0).tobytes() for v in b["v"]]
            yield pd.DataFrame({"id": b["id"], "q": b["q"], "v": raw, "key": [hashlib.blake2b(r, digest_size=16).digest() for r in raw]})

    schema = "id long, q boolean, v binary, key binary"
    rows = ws.keep(vectors.withColumn("q", is_query(F.col("id"))).mapInPandas(digest, schema))
    narrow = rows.select("key", "id").distinct().withColumn("_part", salt(F.col("id")))
    first = narrow.withColumn("_rn", F.row_number().over(Window.partitionBy("key", "_part").orderBy("id"))).filter(F.col("_rn") <= k + 1)
    first = first.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("_rn") <= k + 1)
    ids = ws.keep(first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.element_at("ids", 1)))
    heads = ids.select("key", "cid", F.col("cid").alias("id"))
    classes = ws.keep(rows.join(heads, ["key", "id"]).groupBy("cid", "key").agg(F.first("v").alias("v")))
    n = classes.count()
    empty = "query_id long, rank int, id long, score double"
    asked = ws.keep(rows.filter("q").select("key", F.col("id").alias("query_id")).distinct())
    if not n or asked.isEmpty():
        return spark.createDataFrame([], empty)
    sample = classes.select("v", F.xxhash64("key").alias("h"), "cid").orderBy("h", "cid").limit(SAMPLE).collect()
    index = Index(_matrix([r.v for r in sample]), n, k)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                own = _nearest(x, shared.value.centres)
                yield pd.DataFrame({"cid": b["cid"], "v": b["v"], "list": own, "code": [c.tobytes() for c in shared.value.encode(x, own)], "far": _norm(x - shared.value.centres[own]), "size": _norm(x)})

    placed = ws.keep(classes.mapInPandas(place, "cid long, v binary, list long, code binary, far double, size double"))
    sizes, far, longest = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres)), np.zeros(len(index.centres))
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("size").alias("size")).collect():
        sizes[r["list"]], far[r["list"]], longest[r["list"]] = r["n"], r["far"], r["size"]
    index.settle(sizes, far, longest)
    settled = spark.sparkContext.broadcast(index)
    queries = classes.join(asked.select("key").distinct(), "key", "left_semi").select("cid", "v")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row of a query for each task it goes to, with the score to reach and its own list, so that queries of a list meet."""
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b[at : at + TOGETHER]
                q = _matrix(part["v"])
                least = settled.value.start(q, k + 1)
                i, task = np.nonzero(settled.value.sent(q, least))
                own = _nearest(q, settled.value.centres)
                yield pd.DataFrame({"task": task, "list": own[i], "asks": True, "cid": part["cid"].to_numpy()[i], "v": part["v"].to_numpy()[i], "code": None, "score": least[i]})

    @F.pandas_udf("long")
    def task_of(name: pd.Series, h: pd.Series) -> pd.Series:
        at, name = settled.value, name.to_numpy()
        return pd.Series(at.task_of[at.base[name] + h.to_numpy() % at.pieces[name]])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spot, parts, held = None, [], None
        for b in batches:
            for (task, asks), part in b.groupby(["task", "asks"], sort=False):
                if task != spot:
                    spot, parts, held = task, [], None
                if not asks:
                    parts.append((part["list"].to_numpy(np.int64), part["cid"].to_numpy(np.int64), _matrix(part["v"]), np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)))
                    continue
                if not parts and held is None:
                    continue
                if held is None:
                    held, parts = settled.value.hold(*(np.concatenate(c) for c in zip(*parts, strict=True))), []
                for at in range(0, len(part), TOGETHER):
                    some = part[at : at + TOGETHER]
                    of, near, score = settled.value.search(held, _matrix(some["v"]), some["score"].to_numpy(np.float64), k + 1)
                    yield pd.DataFrame({"cid": some["cid"].to_numpy(np.int64)[of], "near": near, "score": score})

    form = "task long, list long, asks boolean, cid long, v binary, code binary, score double"
    held = placed.withColumn("task", task_of("list", F.shiftrightunsigned(F.xxhash64("cid"), 1)))
    both = held.select("task", "list", F.lit(False).alias("asks"), "cid", "v", "code", F.lit(0.0).alias("score")).unionByName(queries.mapInPandas(send, form))
    both = both.repartitionById(index.tasks, F.col("task").cast("int")).sortWithinPartitions("task", "asks", "list")
    met = both.mapInPandas(meet, "cid long, near long, score double")
    order = [F.desc("score"), F.asc("near")]
    best = met.withColumn("_rn", F.row_number().over(Window.partitionBy("cid").orderBy(*order))).filter(F.col("_rn") <= k + 1)
    named = best.join(ids.select(F.col("cid").alias("near"), "ids"), "near").select("cid", "score", F.explode("ids").alias("id"))
    ranked = named.withColumn("_rn", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), F.asc("id")))).filter(F.col("_rn") <= k + 1)
    answers = ws.keep(ranked.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "id", "score"))), lambda s: F.struct(s["id"].alias("id"), s["score"].alias("score"))).alias("near")))
    of_key = ws.keep(ids.select("key", "cid").join(answers, "cid").select("key", "near"))
    own = asked.join(of_key, "key").select("query_id", F.slice(F.filter("near", lambda s: s["id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "s")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.id").alias("id"), F.col("s.score").alias("score"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
