"""Connected components by repeated contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace


def _roots(image: DataFrame, ws: Workspace) -> DataFrame:
    """(id, to) with each ``to`` followed to its end. It never grows along the way, so there are no cycles; the way left
    halves in each pass."""
    while True:
        further = image.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        found = ws.keep(image.join(further, "to", "left").select("id", "to", F.coalesce("_next", "to").alias("_next")))
        ws.drop(image)
        image = found.select("id", F.col("_next").alias("to"))
        if found.filter("to <> _next").isEmpty():
            return image


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); the component is its smallest id.

    Each level maps a node to the smallest of its neighbours and itself, follows these maps to their ends, and goes on
    with the edges between the ends. A node that is smaller than all its neighbours is an end; if it has edges left
    it has a smaller neighbour on the next level. So ends at least halve in two levels, and the passes of a level are
    logarithmic in the length of its ways: a chain of 1,000 takes one level of 11 passes. Minima are formed before the
    shuffle, and the joins read written tables, so a node with very many edges is split by AQE.
    """
    left = ws.keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    while not left.isEmpty():
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        image = ws.keep(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to")))
        image = _roots(image, ws)
        levels.append(image)
        one = image.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        two = image.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        across = left.join(one, "a").join(two, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        smaller = ws.keep(across)
        ws.drop(left)
        left = smaller
    if not levels:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = levels[0]
    for image in levels[1:]:
        nxt = image.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        found = found.join(nxt, "to", "left").select("id", F.coalesce("_next", "to").alias("to"))
    out = ws.keep(found.withColumnRenamed("to", "component"))
    ws.drop(left)
    return out
