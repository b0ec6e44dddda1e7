"""Packing documents into sequences: Martello-Toth dominance reduction on the histogram of lengths, then best fit.

A sequence's filling depends on lengths only, and there are at most as many lengths as a sequence has places. So the
packing is found on the driver from one count per length, and rows look their place up by rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.bpe import tokenizer_path, whole_texts
from quillmark.llm.common import Workspace, read_table, whole_id, with_rank

CAPACITY = 2048


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Fix sets of at most three lengths that dominate all other sets with their longest one.

    Returns (how many sequences, lengths) of what is fixed, and the counts of the rest. A set dominates another if the
    other's lengths can be grouped so that each group fits into the place of a different length of the set; then some
    best packing has the set. All copies that allow the same step take it at once.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[tuple[int, list[int]]] = []
    for j in sorted(left, reverse=True):
        while left.get(j, 0) > 0:
            room = capacity - j
            left[j] -= 1  # one copy is the one we place; the others are lengths like any other
            lens = sorted(w for w, n in left.items() if n > 0)
            fit = lens[: bisect_right(lens, room)]
            small = [w for w in lens[:3] for _ in range(min(3, left[w]))][:3]
            left[j] += 1
            step = None
            if not fit:
                step = []
            elif fit[-1] == room or len(small) < 2 or small[0] + small[1] > room:
                step = [fit[-1]]
            elif len(small) < 3 or sum(small) > room:  # at most two fit beside it
                step = _two_beside(fit, {w: left[w] - (w == j) for w in fit}, room)
            if step is None:
                break
            group = [j, *step]
            times = min(left[w] // group.count(w) for w in group)
            for w in group:
                left[w] -= times
            fixed.append((times, group))
    return fixed, {w: n for w, n in left.items() if n > 0}


def _two_beside(fit: list[int], have: dict[int, int], room: int) -> list[int] | None:
    top = fit[-1]
    best, lo, hi = 0, 0, len(fit) - 1
    while lo <= hi:  # the fullest pair
        if fit[lo] + fit[hi] > room or (lo == hi and have[fit[lo]] < 2):
            hi -= 1
        else:
            best = max(best, fit[lo] + fit[hi])
            lo += 1
    if best <= top:
        return [top]
    beside = [w for w in fit if w <= room - top and (w != top or have[w] > 1)]
    if not beside:
        return None
    b = beside[-1]
    over = [w for w in fit if w > b for _ in range(min(2, have[w]))][:2]  # a pair of longer ones would not be covered
    return [top, b] if len(over) < 2 or sum(over) > room else None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on counts: (how many sequences, [(length, copies), ...])."""
    open_by: dict[int, list[list]] = {}  # room -> [how many, filling]
    rooms: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(n: int, room: int, filling: list[tuple[int, int]]) -> None:
        if not n:
            return
        if not room:
            done.append((n, filling))
            return
        if room not in open_by:
            open_by[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_by[room].append([n, filling])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = min(capacity // w, n)
                put(n // each, capacity - each * w, [(w, each)])
                n -= n // each * each
                continue
            room = rooms[at]
            group = open_by[room]
            m, filling = group.pop()
            if not group:
                del open_by[room]
                rooms.pop(at)
            each = min(room // w, n)  # after one more piece the same sequence is the fullest that takes the next
            used = min(m, n // each)
            put(m - used, room, filling)
            put(used, room - each * w, [*filling, (w, each)])
            n -= used * each
    return done + [(n, filling) for room in rooms for n, filling in open_by[room]]


class Plan:
    """Where the k-th piece of a length goes: flat arrays, sorted by length and first rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        if any(not 0 < w <= capacity for w in counts):
            raise ValueError("lengths must be between 1 and the capacity")
        fixed, rest = reduce_by_dominance(counts, capacity)
        self.fixed = sum(n for n, _ in fixed)
        groups = [(n, [(w, g.count(w)) for w in dict.fromkeys(g)]) for n, g in fixed] + best_fit(rest, capacity)
        rank: dict[int, int] = {}
        entries, first = [], 0
        for n, filling in groups:
            offset = 0
            for w, copies in filling:
                entries.append((w, rank.get(w, 0), first, offset, copies))
                rank[w] = rank.get(w, 0) + n * copies
                offset += w * copies
            first += n
        self.sequences = first
        table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
        self.length, self.start, self.first, self.offset, self.copies = table.T.copy()
        self.key = self.length << 48 | self.start

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        over = rank - self.start[at]
        return self.first[at] + over // self.copies[at], self.offset[at] + length * (over % self.copies[at])


def pack_lengths(rows: DataFrame, order: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``rows`` with sequence_id and offset. ``rows`` is read twice; lengths are longs from 1 to ``capacity``; ``order``
    names columns that tell rows apart (rows alike in all of them take any of their places)."""
    counts = {r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}
    if not counts:
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).limit(0)
    plan = rows.sparkSession.sparkContext.broadcast(Plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, offset = plan.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": seq, "offset": offset})

    ranked = with_rank(rows, length_col, order, out="_rank", base_rows=None)
    return ranked.withColumn("_at", place(F.col(length_col).cast("long"), "_rank")).select(*rows.columns, "_at.sequence_id", "_at.offset")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids (binary). A document ends with id 0. Of a
    longer one the first piece takes what whole pieces leave. Null text counts as empty: a piece with id 0 alone."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = whole_texts(path)
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                ids = (enc.encode(text) if text else b"") + bytes(4)
                start, end = 0, (len(ids) // 4 - 1) % capacity + 1
                for piece in range((len(ids) // 4 + capacity - 1) // capacity):
                    out.append((key, piece, start, end - start, ids[4 * start : 4 * end]))
                    start, end = end, end + capacity
            yield pd.DataFrame(out, columns=[id_col, "piece", "start", "length", "ids"])

    key, kind, sent = whole_id(docs, id_col)
    return docs.select(key, F.col(text_col).alias("text")).mapInPandas(cut, f"`{id_col}` {sent}, piece int, start long, length long, ids binary").withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids unless ``digest_only``), sequence_id, offset.

    Tokens don't move if only their digest is asked for; what is shuffled is a few numbers a piece. The driver gets one
    count per length, at most ``capacity`` of them. Pieces of one length are ranked in 256 or more parts, so that a length that
    a third of all pieces have doesn't gather in a task. Null ids are passed on; repeated rows are packed each; an
    empty table gives an empty result. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "packing")
    pieces = token_pieces(docs, path, capacity, id_col, text_col).withColumn("ids_crc32", F.crc32("ids").cast("long"))
    columns = [id_col, "piece", "start", "length", "ids_crc32", *([] if digest_only else ["ids"])]
    return pack_lengths(ws.keep(pieces.select(*columns)), [id_col, "piece", "ids_crc32"], capacity).select(*columns, "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
