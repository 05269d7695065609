"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language knows every substring of that text. A
document is parsed greedily into longest matches with each automaton; the language whose
text explains it in the fewest phrases, times the bits that point at a phrase, wins.

The automata run as sparse transition tables over many stretches of text at a time. Phrases
end at the ends of stretches, which lie at the same places for all languages. What is learned
of a language does not depend on how many there are, and all letters of the labelled texts
are told apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded, offsets, ranges, resident, utf8

#: What is learned of each language: so many texts, and so many characters of each.
SAMPLE_TEXTS = 128
SAMPLE_CHARS = 256

#: Languages parsed side by side.
SIDE_BY_SIDE = 64

#: Symbols parsed in one stretch, and bytes of text parsed at a time.
STRETCH = 512
PART_BYTES = 2_000_000

UNDETERMINED = "und"

#: Phrases a symbol beyond which a text resembles no learned language.
MOST_PHRASES = 0.55


def training_texts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    where: Column | None = None,
    sample_texts: int = SAMPLE_TEXTS,
    sample_chars: int = SAMPLE_CHARS,
) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts: (language, text), fixed by the texts alone. Of each
    language ``sample_texts`` texts at most and ``sample_chars`` characters of each, all of
    which are learned.

    Texts fall into ``sample_texts`` cells of each language by their hash and the one of the
    smallest hash represents its cell, so repeated texts come in once. One aggregation.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.substring(text, 1, sample_chars).alias("text"), F.xxhash64(text).alias("hash"))
    cells = rows.groupBy("lang", F.pmod("hash", F.lit(sample_texts)).alias("cell")).agg(F.min_by(F.struct("text", "hash"), "hash").alias("first"))
    found = cells.select("lang", "first.text", "first.hash").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["hash"]))
    return [(r["lang"], r["text"]) for r in found]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Next states of each state, by symbol; state 0 is the first."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(link)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


class Automaton:
    """Suffix automaton of a sequence of symbols, its rows of next states laid over one another.

    The transition of a state by a symbol lies at slot ``base[state] + symbol``; ``owner`` of
    the slot tells whether it is this state's, ``target`` where it leads. The first state has
    its next states in ``first`` (itself where there is none) and owns no slot.
    """

    #: Tries after which rows of several transitions leave the holes to rows of one.
    TRIES = 16

    def __init__(self, symbols: list[int], width: int):
        follow = suffix_automaton(symbols)
        self.symbols, self.states = len(symbols), len(follow)
        self.first = np.zeros(width, np.int32)
        self.first[list(follow[0])] = list(follow[0].values())
        self.base = np.zeros(self.states, np.int32)
        taken = bytearray(width)
        owner, target, at = [], [], []
        free = hint = 0
        for state in sorted(range(1, self.states), key=lambda s: -len(follow[s])):
            row = follow[state]
            if not row:
                continue
            low, tries = min(row), 0
            slot = (hint if len(row) > 1 else free) - 1
            while True:
                slot = taken.find(0, max(slot + 1, low))
                if slot < 0 or slot + width > len(taken):
                    slot = len(taken) if slot < 0 else slot
                    taken.extend(bytes(len(taken) + width))
                begin = slot - low
                if not any(taken[begin + c] for c in row):
                    break
                tries += 1
                if tries > self.TRIES:
                    hint, tries = slot, 0
            self.base[state] = begin
            for c, to in row.items():
                taken[begin + c] = 1
                owner.append(state)
                target.append(to)
                at.append(begin + c)
            free = taken.find(0, free)
        slots = max(at, default=0) + width + 1
        self.owner, self.target = np.full(slots, -1, np.int32), np.zeros(slots, np.int32)
        self.owner[at], self.target[at] = owner, target


class Guess(NamedTuple):
    lang: str
    score: float
    #: Phrases after the first, a symbol, in the winning language.
    rate: float


class Languages:
    """Automata of all languages over one alphabet: 0 unknown letter, 1 between letters."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        by: dict[str, str] = {}
        for lang, text in texts:
            by[lang] = f"{by.get(lang, '')} {text}"
        counts: dict[str, int] = {}
        for text in by.values():
            for c in text.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        number = {c: i + 2 for i, c in enumerate(letters)}
        self.symbol_of = np.array(
            [number.get(c if len(low := c.lower()) != 1 else low, 0) if c.isalpha() else 1 for c in map(chr, range(0x110000))],
            np.min_scalar_type(len(letters) + 1),
        )
        self.width = len(letters) + 2
        self.names = sorted(lang for lang, text in by.items() if any(c.isalpha() for c in text))
        automata = [Automaton(self.symbols(by[lang]).tolist(), self.width) for lang in self.names]
        # States and slots of a language follow those of the one before; a slot holds its state
        # and the next one side by side.
        states = offsets(np.array([a.states for a in automata], np.int64))
        slots = offsets(np.array([len(a.owner) for a in automata], np.int64))
        self.start = states[:-1].astype(np.int64)
        self.base = np.zeros(states[-1], np.int64)
        self.slots = np.full(slots[-1], -1, np.int64)
        self.first = np.zeros((len(automata), self.width), np.int64)
        for i, (a, state, slot) in enumerate(zip(automata, states, slots, strict=False)):
            self.base[state : state + a.states] = a.base + slot
            owned = a.owner >= 0
            part = self.slots[slot : slot + len(owned)]
            part[owned] = (a.owner[owned] + state) << 32 | (a.target[owned] + state)
            self.first[i] = a.first + state
        self.bits = np.array([math.log2(a.symbols + 1) for a in automata])

    def symbols(self, text: str) -> np.ndarray:
        """Letters by number, and one mark between words."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        found = self.symbol_of[codes]
        gap = found == 1
        return found[~(gap & np.append(True, gap[:-1]))] if len(found) else found

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        size = np.array([len(t) for t in texts], np.int64)
        joined, base = np.concatenate([*texts, np.zeros(0, self.symbol_of.dtype)]), offsets(size)
        pieces = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = ranges(np.zeros(len(texts), np.int64), pieces)
        length = np.minimum(STRETCH, size[owner] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, nth, length = owner[order], nth[order], length[order]
        begin = base[owner] + nth * STRETCH
        total = np.zeros((len(texts), len(self.names)))
        for g in range(0, len(self.names), SIDE_BY_SIDE):
            group = slice(g, g + SIDE_BY_SIDE)
            first = self.first[group]
            at = np.repeat(self.start[group, None], len(owner), axis=1)
            count = np.zeros(at.shape, np.int32)
            active = len(owner)
            for t in range(int(length[0]) if len(length) else 0):
                while length[active - 1] <= t:
                    active -= 1
                symbol, now = joined[begin[:active] + t], at[:, :active]
                slot = self.slots[self.base[now] + symbol]
                ends = slot >> 32 != now
                count[:, :active] += ends
                at[:, :active] = np.where(ends, first[:, symbol], slot & 0xFFFFFFFF)
            np.add.at(total[:, group], owner, count.T)
        return total

    def guess(self, texts: list[str]) -> list[Guess]:
        nothing = Guess(UNDETERMINED, 0.0, 1.0)
        symbols = [self.symbols(t) for t in texts]
        if not self.names:
            return [nothing] * len(texts)
        cost = self.phrases(symbols)
        out = []
        for own, phrases in zip(symbols, cost, strict=True):
            if not len(own) or (own == 1).all():
                out.append(nothing)
                continue
            bits = phrases * self.bits
            best = int(np.argmin(bits))  # equal costs: the first language by name
            rest = np.delete(bits, best).min() if len(bits) > 1 else np.inf
            out.append(Guess(self.names[best], float(1 - bits[best] / rest), float((phrases[best] - 1) / len(own))))
        return out


def languages(texts: tuple[tuple[str, str], ...]) -> Languages:
    return resident(("languages", texts), lambda: Languages(texts))


def language(text: str | Column, texts: list[tuple[str, str]]) -> Column:
    """lang, score and phrase rate of each text, by automata of the given labelled texts.

    Executors get the bounded texts and build the automata once per Python worker.
    """
    learned = tuple(texts)

    @F.arrow_udf("struct<lang:string,score:double,rate:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = languages(learned)
        for batch in batches:
            found: list[Guess] = []
            for part in bounded((t.as_py() or b"" for t in batch), PART_BYTES):
                found += own.guess([t.decode("utf-8", "replace") for t in part])
            lang, score, rate = zip(*found, strict=True) if found else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["lang", "score", "rate"]
            )

    return identify(utf8(text))


def in_training(doc_id: str) -> Column:
    """crc32 of the id as text leaves another remainder by 4 than 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    *,
    sample_texts: int = SAMPLE_TEXTS,
    sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate of every row.

    Learns from the rows ``in_training``: of each language ``sample_texts`` texts at most and
    ``sample_chars`` characters of each, whatever the number of languages. Texts are parsed
    whole, however long; other columns are ignored. Null texts and texts without a letter, and all
    texts if nothing could be learned, are ``und`` with score 0. Rows with a null id are
    not learned from and not held out. Repeated rows stay. Score: by which part fewer bits
    the winner needs than the next language (1 with one language alone).
    """
    texts = training_texts(docs, text, lang, in_training(doc_id), sample_texts, sample_chars)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), language(text, texts).alias("guess"))
    return rows.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), "guess.score", "guess.rate")
