"""Token counts of a word-level BPE vocabulary, without emitting tokens.

A word of n byte symbols that undergoes m merges has n - m tokens, so the count needs no
identifiers. Merges of a word are taken from a heap of adjacent pairs by (rank, position)
over a linked list of symbols.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import utf8

#: Words remembered by a Python worker: two generations of at most so many.
REMEMBERED = 250_000

# White space of Unicode, which str.split() exceeds by the four ASCII separators.
SPACE = "\t-\r \x85\xa0  -     　"
NOT_SPACE = re.compile(f"[^{SPACE}]+")
ASCII_SEPARATORS = re.compile("[\x1c-\x1f]")


class Remembered(dict):
    """A function's values by argument, with bounded memory.

    When full, the older of two generations is forgotten; what is asked for again
    moves into the younger one. Hits cost one dictionary look-up.
    """

    def __init__(self, function, size: int = REMEMBERED):
        super().__init__()
        self.function, self.size, self.older = function, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes take the code
    points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """Counts tokens as a ``tokenizers`` BPE file with word ends would give them.

    Understands files that normalise by NFC, white space and lower case, split into words
    by a pattern, write bytes as letters and mark word ends by a suffix. Strings of added
    tokens inside a text count one token each.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is no lower-casing word-level BPE")
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.word_count = Remembered(self.count_word)
        self.chunk_count = Remembered(self.count_chunk)

    def count_word(self, word: str) -> int:
        """Symbols left after all merges of one word."""
        symbols: list[str | None] = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        n = len(symbols)
        rank, merges = self.rank, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j == n or rank.get((symbols[i], symbols[j])) != r:
                continue  # a neighbour has been merged meanwhile
            symbols[i], symbols[j] = symbols[i] + symbols[j], None
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def count_chunk(self, chunk: str) -> int:
        """Tokens of a stretch without white space."""
        if self.added and "<" in chunk and (found := self.added.findall(chunk)):
            return len(found) + sum(self.count_chunk(part) for part in self.added.split(chunk) if part)
        if not chunk.isascii():
            # Letter by letter: a word's last sigma has no form of its own here.
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return sum(map(self.word_count.__getitem__, self.words.findall(chunk.lower())))

    def count(self, text: str) -> int:
        chunks = NOT_SPACE.findall(text) if ASCII_SEPARATORS.search(text) else text.split()
        return sum(map(self.chunk_count.__getitem__, chunks))


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def token_count(text: str | Column, path: str) -> Column:
    """Tokens of each text (null: 0) by the vocabulary file at ``path`` on every executor."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = word_bpe(path)
        for batch in batches:
            yield pa.array([bpe.count(t.as_py().decode("utf-8", "replace")) if t.is_valid else 0 for t in batch], pa.int64())

    return counted(utf8(text))


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row.

    Null and empty texts have 0 of both; repeated rows and null ids stay as they are;
    other columns are ignored. One pass, no shuffle.
    """
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(text, path).alias("n_tokens"),
    )
