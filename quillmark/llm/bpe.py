"""Exact byte-level BPE encoding and decoding.

Frequent words of the corpus, as they stand between spaces, are compiled with their ids into a minimal acyclic
transducer that workers map into memory; words outside it are merged exactly, neighbouring ones together. Each worker
remembers a bounded number of words that it met.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, bound_batches, read_table, whole_id
from quillmark.llm.transducer import Transducer, compile_words

#: How many of the corpus' most frequent words the lexicon takes at most; bounds what the driver gathers and broadcasts.
LEXICON_WORDS = 100_000
#: Bytes of a word of the lexicon at most.
WORD_BYTES = 64
#: Cells for each doubling of a count in the histogram that the lexicon's least count is read from.
CELLS = 64
#: Characters of texts that a worker encodes together.
GROUP_CHARS = 1 << 20
#: Texts of at least so many characters are searched for runs of white space that long, and cut there.
LONG_RUN = 100_000

#: White space as the tokenizer's pattern has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts with any of these, or with two white spaces in a row, are split by the whole pattern.
_ODD_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A piece with white space after its first character, or that is white space but a space or line feed before others.
_SPACE_AFTER = re.compile(rf"(?s).+[{_SPACE}]|[{_SPACE}]\Z|(?![ \n])[{_SPACE}]")
_LONG_SPACE = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")


def pattern_text() -> str:
    """The tokenizer's pattern, which cuts texts into words."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def word_pattern():
    import regex

    return regex.compile(pattern_text())


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the tokenizer's files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeModel:
    """Vocabulary and merges of a tokenizers file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, vocab = told["model"], told["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.of_byte = [vocab[chars[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.text_of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        self.text_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = word_pattern()
        self.fast = self._fast()

    def _fast(self):
        """tiktoken's encoding with these ids. It ranks pairs by the id they make, which is the same as ranking merges if
        their order is that of the ids, each made by one merge only; else None, and merging is done here."""
        made = [new for _, new in sorted(self.merges.values())]
        if made != sorted(set(made)) or sorted([*self.of_byte, *made]) != list(range(len(made) + 256)) or made[:1] != [256]:
            return None
        import tiktoken

        ranks = {self.text_of[i]: i for i in [*self.of_byte, *made]}
        pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern_text())  # in the words of its expressions
        return tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: lowest rank first, leftmost first, one pair at a time."""
        return self.fast._core_bpe.encode_single_piece(word) if self.fast else self.merge_here(word)

    def merge_here(self, word: bytes) -> list[int]:
        ids = [self.of_byte[b] for b in word]
        return self._merge_long(ids) if len(ids) > 48 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        merges = self.merges
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                found = merges.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if f := merges.get((new, ids[k])):
                    heapq.heappush(queue, (f[0], i, new, ids[k], f[1]))
            if (h := before[i]) >= 0 and (f := merges.get((ids[h], new))):
                heapq.heappush(queue, (f[0], h, ids[h], new, f[1]))
        return [x for x in ids if x >= 0]


def simple_segments(text: str) -> list[str] | None:
    """The text split before each white space, if all of it is single spaces and line feeds between other characters;
    then word boundaries of the pattern fall on all these places. Segments but the first lack their space; those after
    a line feed begin with it. None for any other text."""
    if not text or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n" or _ODD_SPACE.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


def blocks(text: str) -> Iterator[str]:
    """The text in blocks of about GROUP_CHARS characters, each but the first beginning with a single space."""
    at = 0
    while len(text) - at > GROUP_CHARS and (cut := _SINGLE_SPACE.search(text, at + GROUP_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def split_specials(model: BpeModel, text: str) -> list[str]:
    """The text cut at special tokens, which are parts of their own."""
    return [p for p in model.special_pattern.split(text) if p] if model.special and any(t in text for t in model.special) else [text]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the tokenizers library does with the same file."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        self.model = BpeModel(path)
        self.lexicon = Transducer(lexicon) if lexicon else None
        self.memo: dict[str, bytes] = {}  # words of the lexicon that were met, so no more than it has
        self.newline = self.model.of_byte[10]

    def _keys(self, text: str) -> list[str]:
        """The text cut where words begin, at all such places or only at white space."""
        if (parts := simple_segments(text)) is None:
            return self.model.pattern.findall(text)
        return [parts[0], *[p if p[0] == "\n" else " " + p for p in parts[1:]]]

    def _merge(self, piece: str) -> bytes:
        ids = [i for w in self.model.pattern.findall(piece) for i in self.model.merge(w.encode("utf-8", "surrogatepass"))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _resolve(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't remembered. Those of the lexicon are remembered from now on. The others are merged,
        all together, with line feeds between them: white space before anything but a space or white space is a word of
        its own, so none of them reaches into the next one."""
        if self.lexicon:
            raw = [p.encode("utf-8", "surrogatepass") for p in missing]
            accepted = self.lexicon.accepts(raw).tolist()
            for piece, word, known in zip(missing, raw, accepted, strict=True):
                if known:
                    ids = self.lexicon.get(word)
                    self.memo[piece] = struct.pack(f"<{len(ids)}I", *ids)
            missing = [p for p, known in zip(missing, accepted, strict=True) if not known]
        own: dict[str, bytes] = {}
        alone = [p for p in missing if _SPACE_AFTER.match(p)] if self.model.fast else missing
        for piece in alone:
            own[piece] = self._merge(piece)
        together = [p for p in missing if p not in own]
        if together:
            bare = [p.removeprefix("\n") for p in together]
            ids = self.model.fast.encode_to_numpy("\n".join(bare), disallowed_special=()).astype("<u4")
            ends = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)]
            raw, start, feed = ids.tobytes(), 0, self.newline.to_bytes(4, "little")
            for piece, end in zip(together, ends, strict=True):
                own[piece] = feed + raw[4 * start : 4 * end] if piece[0] == "\n" else raw[4 * start : 4 * end]
                start = end + 1
        return own

    def _group(self, texts: list[str]) -> list[bytes]:
        keys = [self._keys(t) for t in texts]
        own = self._resolve(list(set(chain.from_iterable(keys)).difference(self.memo)))
        get = self.memo.get
        return [b"".join([get(k) or own[k] for k in ks]) for ks in keys]

    def encode_many(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text. Pieces that aren't remembered are looked up and merged together for about GROUP_CHARS
        characters of the texts; longer texts are cut before single spaces, where words begin."""
        special, out, group, where, size = self.model.special, [], [], [], 0

        def flush() -> None:
            nonlocal size
            for (i, j), ids in zip(where, self._group(group), strict=True):
                out[i][j] = ids
            group.clear(), where.clear()
            size = 0

        for i, text in enumerate(texts):
            out.append([])
            for part in split_specials(self.model, text):
                if part in special:
                    out[i].append(special[part].to_bytes(4, "little"))
                    continue
                for block in blocks(part):
                    where.append((i, len(out[i])))
                    out[i].append(b"")
                    group.append(block)
                    size += len(block)
                    if size >= GROUP_CHARS:
                        flush()
        if group:
            flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of these ids; what isn't UTF-8 becomes U+FFFD. Special tokens stay."""
        numbers = memoryview(ids).cast("I")
        raw = self.model.fast.decode_bytes(numbers.tolist()) if self.model.fast else b"".join(map(self.model.text_of.__getitem__, numbers))
        return raw.decode("utf-8", "replace").encode("utf-8", "replace")


class WholeTexts:
    """Ids of whole texts by tiktoken, where it ranks merges as the file does, else as in Encoder. For callers that need
    ids only, as it beats a lexicon."""

    def __init__(self, path: str):
        own = Encoder(path)
        self.model = own.model
        self.encode = self._fast if own.model.fast else own.encode

    def _ids(self, text: str) -> bytes:
        return self.model.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()

    def _fast(self, text: str) -> bytes:
        if len(text) < LONG_RUN or not _LONG_SPACE.search(text):
            return self._ids(text)
        return b"".join(x for p in split_specials(self.model, text) for x in self._around_runs(p))

    def _around_runs(self, text: str) -> Iterator[bytes]:
        """The pattern can't be matched on a very long run of white space. Such a run begins a word, of all of it but its
        last character if others follow, as that may belong to the next word; so it is merged as that word."""
        at = 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            yield self._ids(text[at : run.start()])
            found = self.model.merge(text[run.start() : end].encode())
            yield struct.pack(f"<{len(found)}I", *found)
            at = end
        yield self._ids(text[at:])


_ENCODERS: dict = {}


def whole_texts(path: str) -> WholeTexts:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WholeTexts(path)
    return _ENCODERS[path]


def encoder(path: str, lexicon: bytes | None = None) -> Encoder:
    """This worker's encoder; one is kept, with its memo, from task to task."""
    key = (path, hashlib.sha256(lexicon).digest() if lexicon else None)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, lexicon)
    return _ENCODERS[key]


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The corpus' most frequent words as they stand between spaces, with the space before them, or the line feed.

    Counts cover all texts; the first word of a text counts as one after a space. They are formed in the JVM and summed
    before the shuffle. The driver gets a histogram of the counts, of fixed size, and the words of its upper cells, as
    many cells as hold at most ``limit`` words. A word that occurs once, or is long, is not among them."""
    ws = Workspace(docs.sparkSession, "words")
    pieces = docs.select(F.explode(F.split(F.replace(F.col(text_col), F.lit("\n"), F.lit(" \n")), " ")).alias("word"))
    counts = pieces.filter(F.octet_length("word").between(1, WORD_BYTES)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = ws.keep(counts.filter("n > 1").withColumn("cell", F.floor(F.log2("n") * CELLS).cast("int")))
    total, least = 0, None
    for r in sorted(counts.groupBy("cell").count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        least = r.cell
    found = [] if least is None else [r.word for r in counts.filter(F.col("cell") >= least).select("word").collect()]
    ws.drop(counts)
    return [w if w[0] == "\n" else " " + w for w in found]


def build_lexicon(words: list[str], path: str) -> bytes:
    words = sorted(set(words))
    return compile_words((w.encode(), tuple(memoryview(ids).cast("I"))) for w, ids in zip(words, Encoder(path).encode_many(words), strict=True))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, ids (binary, little-endian unsigned 32-bit), decoded (string).

    ``path`` names a tokenizers file of byte-level BPE that each executor can open. Whole texts are encoded, special
    tokens in them as such. Null and empty text give no ids and an empty decoded text, repeated rows the same ids, an
    empty table no rows. A null id is passed on. A text of any length is encoded in one piece; words of any length are
    merged in n log n time. Other columns are ignored. The driver gets and broadcasts at most ``lexicon_words`` words of
    at most 64 bytes, whatever the corpus.
    """
    bound_batches(docs.sparkSession)
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(frequent_words(docs, text_col, lexicon_words), path))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, lexicon.value)
        for batch in batches:
            ids = enc.encode_many(t or "" for t in batch["text"])
            yield pd.DataFrame({id_col: batch["id"], "ids": ids, "decoded": [enc.decode(i).decode() for i in ids]})

    key, kind, sent = whole_id(docs, id_col)
    return docs.select(key, F.col(text_col).alias("text")).mapInPandas(encode, f"`{id_col}` {sent}, ids binary, decoded string").withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
