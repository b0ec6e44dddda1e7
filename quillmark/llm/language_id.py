"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import bound_batches, read_table

#: n-grams of one to this many characters.
MAX_N = 4
#: Number of hashed features; with the number of languages it bounds what is gathered and broadcast.
FEATURES = 1 << 16
#: About so many labelled documents of each language are learned from, chosen by a hash of their ids.
SAMPLE_PER_LANGUAGE = 2_000
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Languages learned at most, the most frequent ones; with FEATURES it bounds the matrix.
MAX_LANGUAGES = 500
#: Characters scored together at most; bounds memory for texts of any length.
BLOCK = 1 << 18
#: Log-probabilities are held in units of 2^-24, so that sums don't depend on how texts are batched.
UNIT = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(texts: Sequence[str], most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, lower-cased, as character codes of at most ``most`` characters together: codes, and for each part of a text in
    them the number of its text, its size, and how many characters it repeats from the part before. White space counts
    as one kind."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    known: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, ...]:
        codes = np.concatenate(parts).astype(np.uint64)
        codes[codes <= 32] = 32
        return codes, np.array(rows), np.array([len(p) for p in parts]), np.array(known)

    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = 0
        while at < len(codes):
            begin = max(0, at - MAX_N + 1)
            end = min(len(codes), at + most - size)
            rows.append(i), parts.append(codes[begin:end]), known.append(at - begin)
            size, at = size + end - at, end
            if size >= most:
                yield together()
                rows, parts, known, size = [], [], [], 0
    if parts:
        yield together()


def features(codes: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, feature numbers of the n-grams of all parts, one part after another, and how many each part has.
    Grams that end within what a part repeats were its predecessor's."""
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known_at = np.repeat(known, sizes)
    key = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            return
        key = (key[:-1] if n > 1 else key) * _MIX + codes[n - 1 :] + np.uint64(n)  # grams across parts are left out below
        mixed = (key ^ (key >> np.uint64(29))) * _MIX
        own = at[n - 1 :] >= np.maximum(known_at[n - 1 :], n - 1)
        yield (mixed[own] >> np.uint64(48)).astype(np.int64) & (FEATURES - 1), np.maximum(0, sizes - np.maximum(known, n - 1))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Log-probabilities, one row per feature and one column per language."""

    def __init__(self, langs: list[str], counts: np.ndarray, documents: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.logp = np.ascontiguousarray(np.rint(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T * UNIT).astype(np.int32))
        self.prior = np.rint(np.log((documents + 1.0) / (documents + 1.0).sum()) * UNIT).astype(np.int64)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: posterior of the best one, evidence counted as the square root of the number
        of grams, as neighbouring grams are not independent. ``und`` and 0 for text without letters, and if nothing was
        learned. Grams of all texts together are the rows of a sparse matrix, which is multiplied by the log-probabilities."""
        found, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        asked = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        if not asked:
            return found, score
        total, grams = np.zeros((len(asked), len(self.langs)), np.int64), np.zeros(len(asked), np.int64)
        for codes, rows, sizes, known in chunks([texts[i] for i in asked], max(1 << 12, BLOCK // max(1, len(self.langs) // 8))):
            for feature, many in features(codes, sizes, known):
                some = many > 0
                if some.any():
                    starts = np.cumsum(many[some]) - many[some]
                    np.add.at(total, rows[some], np.add.reduceat(self.logp[feature], starts, axis=0, dtype=np.int64))
                    np.add.at(grams, rows[some], many[some])
        total += self.prior
        best = np.argmax(total, axis=1)
        z = (total - total.max(axis=1, keepdims=True)) / UNIT / np.sqrt(np.maximum(1, grams))[:, None]
        for i, b in zip(asked, best.tolist(), strict=True):
            found[i] = self.langs[b]
        score[asked] = 1 / np.exp(z).sum(axis=1)
        return found, score


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_by: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from ``docs``: rows without language, text or letters teach nothing. Where a language has more than
    ``per_language`` rows, about so many are chosen by a hash of ``sample_by``; of these, whole texts are counted. Of
    more than MAX_LANGUAGES languages the most frequent are learned."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(sample_by).cast("string")).alias("h")).filter("lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, FEATURES)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, per_language / sizes[lang]) * 1_000_000))])
    chosen = rows.filter(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                own = sums.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))
                for codes, _, sizes, known in chunks([t for t in part["text"] if has_letter(t)]):
                    for feature, _ in features(codes, sizes, known):
                        own += np.bincount(feature, minlength=FEATURES)
        for lang, own in sums.items():
            hit = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "feature": hit, "n": own[hit]})

    counts = np.zeros((len(langs), FEATURES))
    index = {lang: i for i, lang in enumerate(langs)}
    found = chosen.mapInPandas(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts[found["lang"].map(index).to_numpy(np.int64), found["feature"].to_numpy(np.int64)] = found["n"]
    return Model(langs, counts, np.array([sizes[x] for x in langs], dtype=np.float64))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, predicted from whole texts alone, in one pass without a shuffle.

    Null text, empty text and text without letters are ``und`` with score 0. Ties go to the language that sorts first.
    Repeated rows get equal predictions; an empty table gives an empty result. Columns of ``docs`` called lang_pred
    or score are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lang_pred", "score"), shared.value.predict(texts.tolist()), strict=True)))

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_found", predict(F.col(text_col))).select(*rest, "_found.lang_pred", "_found.score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_table(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), train_on_table(docs)).select("doc_id", "held_out", "lang_pred", "score")
