"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full shingle sets, and components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import BROADCAST_ROWS, Workspace, read_table, with_group_totals
from quillmark.llm.components import connected_components

#: Words in a shingle.
WORDS = 5
#: A pair at the threshold escapes all bands with at most this probability.
MISS = 1e-6
#: Bands at most.
BANDS = 40
#: Words of 64 bits in the widest sketch by which pairs are ruled out before their texts are read.
SKETCH = 16
#: Members of a bucket that are paired as they are; larger ones are cut first. Rows that a part of a bucket is paired with at
#: a time, and others that are compared with one reading of a document.
FEW, PART, OTHERS = 64, 4_096, 512
#: Items of sets, about, that are dealt together.
ROUND = 4_096
_MEMO_WORDS = 150_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)
_R = np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * _R
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of the text with A-Z lower-cased. Words are separated by the
    characters U+0009 to U+000D and U+0020 (as in bytes.split); a text with fewer words has one shingle of all of them."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(h))
    key = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        key = (key ^ h[i : len(h) - k + 1 + i]) * _P
        key ^= key >> np.uint64(32)
    return np.unique(_mix(key))


def _deal(items: np.ndarray, level: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An item's random fraction on a level, and which of the places left it draws."""
    z = _mix(items ^ _mix(np.atleast_1d(level) + _P))
    return (z >> np.uint64(32)).astype(np.float64) * 2.0**-32, (level + ((z & np.uint64(0xFFFFFFFF)) * places >> np.uint64(32))).astype(np.int64)


def _superminhash_few(items: np.ndarray, size: int) -> np.ndarray:
    """The same, item by item, for sets that need many levels."""
    levels = np.arange(size, dtype=np.uint64)
    fractions, picks = _deal(items[:, None], levels[None, :], np.uint64(size) - levels[None, :])
    h = [math.inf] * size
    for fraction, pick in zip((fractions + levels[None, :]).tolist(), picks.tolist(), strict=True):
        order = list(range(size))
        for j, k in enumerate(pick):
            place, order[k] = order[k], order[j]
            if fraction[j] < h[place]:
                h[place] = fraction[j]
    return np.array(h)


def superminhash(items: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash (Ertl, 2017): every item deals the ranks 0 to size - 1 to the places by a random permutation of its
    own, each with a random fraction; a place keeps its least value. Items deal one rank per level, all at once; once
    every place holds a value below the next level, no later rank can change it."""
    h = np.full(size, np.inf)
    if len(items) <= 16:
        return _superminhash_few(items, size)
    order = None
    for j in range(size):
        fraction, pick = _deal(items, np.uint64(j), np.uint64(size - j))
        if order is None:
            place = pick
        else:
            row = np.arange(len(items))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, j]
        np.minimum.at(h, place, fraction + j)
        if h.max() < j + 1:
            break
        if order is None:
            order = np.tile(np.arange(size, dtype=np.uint16), (len(items), 1))
            order[np.arange(len(items)), pick] = 0
    return h


def superminhash_all(sets: list[np.ndarray], size: int) -> np.ndarray:
    """``superminhash`` of each set, a row a set. Sets of about the same number of items, ROUND together, are dealt in one
    go, level by level; a set leaves once no later rank can change it."""
    out = np.full((len(sets), size), np.inf)
    lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    order = np.argsort(lengths, kind="stable")
    few = int(np.searchsorted(lengths[order], 16, side="right"))
    for i in order[:few]:
        out[i] = _superminhash_few(sets[i], size)
    order = order[few:]
    rounds = np.cumsum(lengths[order]) // ROUND
    for group in np.split(order, np.flatnonzero(np.diff(rounds)) + 1):
        if len(group):
            out[group] = _superminhash_round([sets[i] for i in group], size)
    return out


def _superminhash_round(sets: list[np.ndarray], size: int) -> np.ndarray:
    h = np.full((len(sets), size), np.inf)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    left = None
    for j in range(size):
        fraction, pick = _deal(items, np.uint64(j), np.uint64(size - j))
        row = np.arange(len(items))
        place = pick if left is None else left[row, pick].astype(np.int64)
        np.minimum.at(h.reshape(-1), owner * size + place, fraction + j)
        going = h.max(axis=1) >= j + 1
        if not going.any():
            break
        if left is None:
            stay = going[owner]
            items, owner, pick = items[stay], owner[stay], pick[stay]
            row = np.arange(len(items))
            left = np.tile(np.arange(size, dtype=np.uint16), (len(items), 1))
            left[row, pick] = 0
        else:
            left[row, pick] = left[row, j]
            stay = going[owner]
            if 4 * np.count_nonzero(stay) < 3 * len(stay):
                items, owner, left = items[stay], owner[stay], left[stay]
    return h


def banding(threshold: float) -> tuple[int, int]:
    """Rows per band and bands: as many rows as leave pairs at the threshold a chance of at most MISS to escape."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(MISS) / math.log1p(-min(threshold**rows, 1 - 1e-9))))
        if bands <= BANDS:
            best = (rows, bands)
    return best


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The keys of a signature's bands, or of several signatures, a row each."""
    part = signature.view(np.uint64).reshape(*signature.shape[:-1], bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _Q
    for i in range(rows):
        key = _mix((key ^ part[..., i]) * _P)
    return key.view(np.int64)


def sketch(items: np.ndarray) -> np.ndarray:
    """Bits that tell whether an even or odd number of the items falls on each of 64 * SKETCH places. Every item that
    only one of two sets has turns one bit of one sketch, so sketches differ in at most as many bits as sets in items."""
    odd = np.bincount((items >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def narrow(full: np.ndarray, n: int) -> np.ndarray:
    """The sketch of a set of n items folded to 1, 2, 4, 8 or 16 words, so that it has a bit an item if it can: words that
    fold onto one another are added bit by bit, as are their items' turns, so the bound of ``sketch`` holds here too."""
    words = min(SKETCH, 1 << max(0, math.ceil(n / 64) - 1).bit_length())
    return np.bitwise_xor.reduce(full.reshape(-1, words), axis=0)


def _folded(x: Column, words: Column) -> Column:
    """``narrow`` of a narrowed sketch, to so many words."""
    return F.transform(F.sequence(F.lit(1), words), lambda i: F.aggregate(F.sequence(i, F.size(x), words), F.lit(0).cast("long"), lambda bits, j: bits.bitwiseXOR(F.element_at(x, j))))


def turned(x: Column, y: Column) -> Column:
    """In how many bits two narrowed sketches differ, the wider one being folded to the other's width."""
    words = F.least(F.size(x), F.size(y))
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, bits: n + bits)
    return F.when(F.size(x) == F.size(y), differ(x, y)).otherwise(differ(_folded(x, words), _folded(y, words)))


def signatures(docs: DataFrame, threshold: float, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, set_id, bands, sketch) of each row: size and digest of its shingle set, its band keys, and its sketch."""
    rows, bands = banding(threshold)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch["text"]]
            out = pd.DataFrame({"id": pd.arrays.IntegerArray(batch["id"].to_numpy("int64"), batch["null"].to_numpy("bool")), "n": [len(s) for s in sets]})
            out["set_id"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(superminhash_all(full, rows * bands), rows, bands) if full else ())
            out["bands"] = [next(keys) if len(s) else None for s in sets]
            out["sketch"] = [narrow(sketch(s), len(s)) if len(s) else None for s in sets]
            yield out

    key = F.col(id_col).cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("null"), F.col(text_col).alias("text")).mapInPandas(sign, "id long, n long, set_id binary, bands array<long>, sketch array<long>")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a kept narrow table if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, docs: DataFrame, percent: int, words: int, ws: Workspace) -> DataFrame:
    """(a, b) of those kept pairs (a, b) that are linked, by the full sets of docs (id, text).

    Only texts in pairs move: that of b once a pair, that of a once for at most about OTHERS of its pairs, which meet in
    one place. There one set of a is held, and the others stream past. If several rows share an id, any of them links."""
    many = ws.keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / OTHERS).cast("int").alias("parts")))
    dealt = ws.keep(pairs.join(_small(many), "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")))
    asked = dealt.select("a", "part", F.lit(False).alias("other"), F.col("a").alias("id")).distinct().unionAll(dealt.select("a", "part", F.lit(True), "b"))
    asked = ws.keep(asked)
    rows = docs.join(_small(asked), "id").select("a", "part", "other", "id", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "other")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spot, own = None, []
        for batch in batches:
            found = []
            for a, part, other, key, text in zip(batch["a"], batch["part"], batch["other"], batch["id"], batch["text"], strict=True):
                if (a, part) != spot:
                    spot, own = (a, part), []
                s = shingle_set(text, words)
                if not other:
                    own.append(s)
                    continue
                for x in own:
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(s) - both):
                        found.append((a, key))
                        break
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    out = ws.keep(rows.mapInPandas(compare, "a long, b long"))
    ws.drop(many, dealt, asked)
    return out


class Linker:
    """Compares members of buckets until no comparison can join two components any more.

    ``sketches`` (id, sketch) are those of the classes' documents, ``docs`` (id, text) all documents."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, percent: int, words: int, ws: Workspace):
        self.docs, self.sketches, self.percent, self.words, self.ws = docs, sketches, percent, words, ws
        self.links = self.comps = None

    def unresolved(self, members: DataFrame) -> DataFrame:
        """Members of buckets that span components, with their component."""
        members = members.drop("comp")
        placed = members.join(_small(self.comps), "id", "left") if self.comps is not None else members.withColumn("component", F.lit(None).cast("long"))
        placed = self.ws.keep(placed.withColumn("comp", F.coalesce("component", "id")).drop("component"))
        split = self.ws.keep(placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key"))
        out = self.ws.keep(placed.join(_small(split), "key", "left_semi"))
        self.ws.drop(placed, split)
        return out

    def _may(self, one: str, two: str) -> Column:
        """Whether rows of two members can be linked and would join components, as far as their sizes tell. ``most`` bounds
        what a member can have in common with any other of the bucket."""
        n, m = F.col(f"{one}.n"), F.col(f"{two}.n")
        enough = F.least(f"{one}.most", f"{two}.most") * (100 + self.percent) >= self.percent * (n + m)
        return (F.col(f"{one}.comp") != F.col(f"{two}.comp")) & (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & enough

    def link(self, pairs: DataFrame) -> None:
        """Verify the pairs (a, b, total), total being the sum of their sizes, and take the links into the components.
        First, pairs go whose sketches differ more than the sets of linked documents can."""
        kinds = [self.sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"_{x}")) for x in "ab"]
        differ = turned(F.col("_a"), F.col("_b"))
        near = pairs.distinct().join(kinds[0], "a").join(kinds[1], "b").filter(differ * (100 + self.percent) <= (100 - self.percent) * F.col("total"))
        near = self.ws.keep(near.select("a", "b").distinct())
        if near.isEmpty():
            return
        news = verify(near, self.docs, self.percent, self.words, self.ws)
        self.ws.drop(near)
        if not news.isEmpty():
            self.links = self.ws.keep(news if self.links is None else self.links.unionAll(news))
            self.comps = connected_components(self.links, self.ws)

    def stars(self, members: DataFrame) -> None:
        """Compare of each bucket the member that meets most others with the rest of it: as many pairs as members."""
        best = F.max(F.struct("met", (-F.col("id")).alias("minus"), "n", "comp", "most")).alias("b")
        heads = members.groupBy("key").agg(best).select("key", (-F.col("b.minus")).alias("id"), "b.n", "b.comp", "b.most")
        heads = self.ws.keep(heads)
        met = members.alias("y").join(_small(heads).alias("x"), "key").filter((F.col("x.id") != F.col("y.id")) & self._may("x", "y"))
        self.link(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.n") + F.col("y.n")).alias("total")))

    def pairs(self, members: DataFrame) -> None:
        """Compare all members of a bucket that sizes and sketches don't rule out, within the join. Members of a large
        bucket are dealt to parts, and each part meets copies of all of them, so no task gets a whole bucket."""
        sized = with_group_totals(members, ["key"], "id", size=("sum", "1L")).withColumn("parts", F.ceil(F.col("size") / PART))
        sized = self.ws.keep(sized)
        x = sized.withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        y = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = x.alias("x").join(y.alias("y"), ["key", "part"]).filter((F.col("x.id") < F.col("y.id")) & self._may("x", "y"))
        self.link(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.col("x.n") + F.col("y.n")).alias("total")))
        self.ws.drop(sized)

    def finish(self, members: DataFrame, banded: DataFrame) -> None:
        """Compare members of the buckets of rare shingles, ``members``, until each bucket is within one component.

        Small buckets are paired. Large ones are compared as stars first; what still spans components is cut by
        bands: two linked documents share a rare shingle, and also a band of ``banded`` (key, id), so they share a
        bucket of both. Members of these are paired."""
        members = self.unresolved(members)
        if members.isEmpty():
            return
        sized = self.ws.keep(with_group_totals(members, ["key"], "id", size=("sum", "1L")))
        self.pairs(sized.filter(F.col("size") <= FEW).drop("size"))
        large = sized.filter(F.col("size") > FEW).drop("size")
        large = self.unresolved(large)
        if large.isEmpty():
            return
        self.stars(large)
        large = self.unresolved(large)
        cut = large.join(banded.select("id", F.col("key").alias("_band")), "id").withColumn("key", F.xxhash64("key", "_band")).drop("_band")
        self.pairs(self.unresolved(self.ws.keep(cut)))

    def rare_buckets(self, ids: DataFrame) -> DataFrame:
        """Buckets by prefix filtering: two documents that could be linked share one of the rarest shingles of each.

        Shingles are ordered by how many of these documents have them. A document of n shingles that shares fewer than
        percent of them with another isn't linked with it, so a linked one shares one of the n - ceil(percent of n) + 1
        rarest. Those that no other document has come first and make no bucket. In the bucket of the first shingle that
        both have, they have at most in common what is left of each from there on: ``most``."""
        texts, words = self.docs.join(_small(ids), "id", "left_semi"), self.words

        def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, text in zip(batch["id"], batch["text"], strict=True):
                    s = shingle_set(text, words)
                    yield pd.DataFrame({"id": key, "n": len(s), "key": s.view(np.int64)})

        rows = self.ws.keep(texts.mapInPandas(explode, "id long, n long, key long").dropDuplicates(["id", "key"]))
        common = self.ws.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        rows = rows.join(_small(common), "key")
        own = Window.partitionBy("id")
        prefix = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1 - (F.col("n") - F.col("most"))
        rows = rows.withColumns({"most": F.count(F.lit(1)).over(own), "_rn": F.row_number().over(own.orderBy("size", "key"))}).filter(F.col("_rn") <= prefix)
        return self.ws.keep(rows.select("key", "id", "n", F.sum("size").over(own).alias("met"), (F.col("most") - F.col("_rn") + 1).alias("most")))


def link_buckets(members: DataFrame, docs: DataFrame, sketches: DataFrame, percent: int, words: int, ws: Workspace) -> DataFrame | None:
    """(id, component) of all ids with a verified link, from members (key, id, n, met, most) of the bands' buckets.

    First the member of each bucket that meets most others is compared with the rest of it: for copies of one text
    these are as many pairs as members. Documents whose buckets still span components, such as those made from one
    template with a good part of their own, are bucketed anew by their rarest shingles, and there compared until no
    pair is left that could join components. Nothing is capped.
    """
    linker = Linker(docs, sketches, percent, words, ws)
    members = linker.unresolved(members)
    if members.isEmpty():
        return None
    met = ws.keep(members.select("id").distinct())
    linker.sketches = ws.keep(sketches.join(_small(met), "id", "left_semi"))
    linker.stars(members)
    left = linker.unresolved(members)
    if not left.isEmpty():
        linker.finish(linker.rare_buckets(ws.keep(left.select("id").distinct())), left.select("key", "id"))
    return linker.comps


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= ``percent`` * union are linked; a component is what links
    connect, its id the smallest id in it, and that document stays. Candidates share a band of their SuperMinHash
    signatures; a pair at the threshold shares none with a probability of at most 1e-6. Links are confirmed on full
    sets. Documents with equal sets form a class first, and its smallest id stands for it.

    Null or empty text and text without words have no shingles and are linked with nothing. Rows with
    equal ids count as one document in linking. Ids are integers; a row with a null id has a null component and isn't
    kept, nor does it link others. An empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "near")
    own = ws.keep(signatures(docs, percent / 100, words, id_col, text_col))
    full = own.filter("n > 0 AND id IS NOT NULL")
    empty = own.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("class_id"), F.lit(None).cast("array<long>").alias("bands"))
    classed = with_group_totals(full, ["set_id"], "id", class_id=("min", "id")).select("id", "n", "class_id", F.when(F.col("id") == F.col("class_id"), F.col("bands")).alias("bands"))
    classes = ws.keep(classed.unionByName(empty))
    entries = classes.filter("bands IS NOT NULL").select("id", "n", F.explode("bands").alias("key"))
    shared = ws.keep(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    met = ws.keep(entries.join(_small(shared), "key"))
    popular = met.groupBy("id").agg(F.sum("size").alias("met"))
    members = ws.keep(met.select("key", "id", "n").join(popular, "id").select("key", "id", "n", "met", F.col("n").alias("most")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = own.filter("sketch IS NOT NULL AND id IS NOT NULL").select("id", "sketch")
    comps = link_buckets(members, texts, sketches, percent, words, ws)
    out = classes.select("id", "n", "class_id")
    if comps is None:
        out = out.withColumn("component_id", F.col("class_id"))
    else:
        out = out.join(_small(comps.select(F.col("id").alias("class_id"), "component")), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT doc_id, doc_id AS z FROM documents
  UNION
  SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.z AS component_id, d.doc_id = m.z AS kept
FROM documents d JOIN (SELECT doc_id, min(z) AS z FROM r GROUP BY doc_id) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
