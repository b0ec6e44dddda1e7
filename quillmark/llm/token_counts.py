"""Counting the tokens of a unigram tokenizer without making them: Aho-Corasick finds the vocabulary's matches, and a
Viterbi pass carries, for each place, the best score and the number of pieces on the way to it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import read_table, whole_id

#: Stands for a space in pieces.
MARK = "▁"
#: What an unknown character costs below the lowest score; fixed value of the public tokenizer libraries.
UNKNOWN_PENALTY = 10.0
#: How many words a worker remembers before it starts afresh, and how long they are at most.
MEMO_WORDS, MEMO_CHARS = 250_000, 64
#: Words of texts of so many characters are taken one by one, not as a list.
LONG_TEXT = 1 << 20


def read_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores of a sentencepiece model file, by id, and the id of the unknown piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class UnigramCounter:
    """Piece counts of a unigram model with byte fallback.

    Tie rules of the tokenizers library's unigram model: scores are doubles; starts are taken from left to right and
    matches at a start from short to long; a way replaces the one known to a place only if its score is greater. A
    character that no piece of one character matches may also be unknown. Adjacent unknown characters are one token,
    which becomes one token per UTF-8 byte if the vocabulary has all bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int):
        import ahocorasick

        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unk_count = 1
        self.auto = ahocorasick.Automaton()
        score = {}
        for p, s in pieces:
            if p:
                score[p] = s  # of equal pieces the last counts, as in a map that is filled in order
        for p, s in score.items():
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.longest = max(map(len, score), default=1)
        self.single = {p for p in score if len(p) == 1}
        # Texts may be cut wherever no piece spans the cut: before a mark that follows another character, and before a
        # line feed, if no piece has such a place.
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in score)
        self.cuts = not inner and not any("\n" in p for p in score)
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if self.cuts else r"(?s).+")
        self.memo: dict[str, int] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of tokens of the best way through ``text``. Matches come by their ends, at an end from the
        farthest start to the nearest, as ties ask; only places within the longest piece of here are held."""
        n = len(text)
        if not n:
            return 0.0, 0
        none = -math.inf
        room = min(n, self.longest) + 1
        score_at, count_at, unk_at = [none] * room, [0] * room, [False] * room
        score_at[0] = 0.0
        single, bytes_known, unknown = self.single, self.bytes_known, self.unknown
        matches = self.auto.iter(text)
        end, match = next(matches, (n, None))
        for i in range(n):
            best, count, unk = none, 0, False
            while end == i:
                size, s = match
                at = (i + 1 - size) % room
                if score_at[at] + s > best:
                    best, count = score_at[at] + s, count_at[at] + 1
                end, match = next(matches, (n, None))
            if text[i] not in single and score_at[i % room] + unknown > best:
                at = i % room
                best, unk = score_at[at] + unknown, True
                count = count_at[at] + (len(text[i].encode("utf-8", "surrogatepass")) if bytes_known else 0 if unk_at[at] else 1)
            at = (i + 1) % room
            score_at[at], count_at[at], unk_at[at] = best, count, unk
        return score_at[n % room], count_at[n % room]

    def _segment(self, segment: str) -> int:
        n = self.best(segment)[1]
        if len(segment) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[segment] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text: a space is put before it and spaces become marks. Null and empty text have none."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.cuts or not self.bytes_known:  # adjacent unknown characters may be one token across a cut
            return self.best(text)[1]
        memo = self.memo
        parts = self.split.findall(text) if len(text) < LONG_TEXT else (m.group() for m in self.split.finditer(text))
        return sum(memo.get(p) or self._segment(p) for p in parts)


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(*read_pieces(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, over whole texts, in one pass without a shuffle.

    ``path`` names a sentencepiece model file whose pieces and scores are taken as a unigram vocabulary. Null and
    empty text have 0 tokens; repeated rows are counted each; a null id is passed on; an empty table gives an empty
    result; other columns are ignored. A text of any length, with or without spaces, costs its own copies and a window as
    wide as the longest piece. Words are counted once per worker as long as its memo has them; where the
    vocabulary has pieces that span words, whole texts go through the Viterbi pass.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for batch in batches:
            yield pd.DataFrame({id_col: batch["id"], "n_tokens": [c.count(t) for t in batch["text"]]}).astype({"n_tokens": "int64"})

    key, kind, sent = whole_id(docs, id_col)
    return docs.select(key, F.col(text_col).alias("text")).mapInPandas(count, f"`{id_col}` {sent}, n_tokens long").withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), pieces_path())
