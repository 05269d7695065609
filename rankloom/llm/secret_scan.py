"""Secrets in texts, found through a trigram index.

From every rule's pattern a Boolean query over trigrams is derived: what any match must
contain. Each shard of documents (part of an Arrow batch) gets an inverted index of the trigrams
in question, postings are intersected and united as the query says, and only candidate
texts meet the pattern itself. A rule without mandatory trigrams meets every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import FOLD, bounded, utf8


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Group whose length decides, and its least length.
    group: int
    least: int


# The base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds: private keys and tokens whose issuers give them a prefix.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE

#: Alternatives of a query beyond which a part of a pattern counts as unknown.
MOST_STRINGS = 64

#: Text of one inverted index.
SHARD_BYTES = 8_000_000

# A query: True (no demand), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple


def both(kind: str, parts: list[Query]) -> Query:
    """Conjunction or disjunction, simplified."""
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def of_string(text: bytes) -> Query:
    """All trigrams of a mandatory string, in lower case."""
    text = text.translate(FOLD)
    return both("and", [text[i : i + 3] for i in range(len(text) - 2)])


def trigram_query(pattern: str) -> Query:
    """What every match of a pattern contains, by its parse tree.

    Adjoining parts with few possible strings are joined before trigrams are taken, so
    trigrams that cross from one part to the next count as well.
    """

    def strings(node) -> list[bytes] | None:
        """All strings a node may match, if few."""
        kind, value = node
        if kind is op.LITERAL:
            return [chr(value).lower().encode()]
        if kind is op.IN and all(k is op.LITERAL for k, _ in value):
            return sorted({chr(v).lower().encode() for _, v in value})
        if kind is op.SUBPATTERN:
            return sequence_strings(value[3])
        if kind is op.BRANCH:
            found = [sequence_strings(branch) for branch in value[1]]
            return None if None in found else sorted({s for f in found for s in f})
        if kind is op.MAX_REPEAT and value[1] <= 2:
            one = sequence_strings(value[2])
            if one is None:
                return None
            out = {b""} if value[0] == 0 else set()
            grown = [b""]
            for times in range(1, value[1] + 1):
                grown = [g + s for g in grown for s in one]
                out |= set(grown) if times >= value[0] else set()
            return sorted(out) if len(out) <= MOST_STRINGS else None
        return None

    def sequence_strings(nodes) -> list[bytes] | None:
        grown = [b""]
        for node in nodes:
            found = strings(node)
            if found is None or len(grown) * len(found) > MOST_STRINGS:
                return None
            grown = [g + s for g in grown for s in found]
        return grown

    def inside(node) -> Query:
        kind, value = node
        if kind is op.SUBPATTERN:
            return sequence(value[3])
        if kind is op.BRANCH:
            return both("or", [sequence(branch) for branch in value[1]])
        if kind is op.MAX_REPEAT and value[0] >= 1:
            return sequence(value[2])
        return True

    def sequence(nodes) -> Query:
        demands, grown = [], [b""]

        def close():
            nonlocal grown
            demands.append(both("or", [of_string(g) for g in grown]))
            grown = [b""]

        for node in nodes:
            found = strings(node)
            if found is None:
                close()
                demands.append(inside(node))
            elif len(grown) * len(found) > MOST_STRINGS:
                close()
                grown = found
            else:
                grown = [g + s for g in grown for s in found]
        close()
        return both("and", demands)

    return sequence(parser.parse(pattern))


def trigrams_in(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams_in, query[1])) if isinstance(query, tuple) else set()


class Scanner:
    """Rules with their patterns, queries and the trigrams these ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        # Letters mean ASCII letters only, in either case where a rule says so.
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.trigrams = sorted(set().union(*map(trigrams_in, self.queries)))
        self.number = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(self.trigrams):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """For each trigram in question the numbers of the texts that hold it, ascending."""
        joined = np.frombuffer(b"\0\0".join(texts).translate(FOLD), np.uint8)
        if len(joined) < 3:
            return dict.fromkeys(self.trigrams, np.zeros(0, np.int64))
        code = joined[:-2].astype(np.int32) << 16
        code |= joined[1:-1].astype(np.int32) << 8
        code |= joined[2:]
        number = self.number[code]
        at = np.flatnonzero(number)
        ends = np.cumsum([len(t) + 2 for t in texts])
        cells = np.unique(number[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        which, text = np.divmod(cells, len(texts))
        edges = np.searchsorted(which, np.arange(1, len(self.trigrams) + 2))
        return {t: text[edges[i] : edges[i + 1]] for i, t in enumerate(self.trigrams)}

    def candidates(self, query: Query, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
        if query is True:
            return everything
        if isinstance(query, bytes):
            return postings[query]
        parts = sorted((self.candidates(q, postings, everything) for q in query[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, kind number, end) of all secrets, in that order, in code points."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return found
        postings, everything = self.postings(texts), np.arange(len(texts))
        decoded: dict[int, str] = {}
        for kind, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries, strict=True)):
            for k in self.candidates(query, postings, everything).tolist():
                text = decoded.get(k)
                if text is None:
                    text = decoded[k] = texts[k].decode("utf-8", "replace")
                for m in pattern.finditer(text):
                    if len(m[rule.group]) >= rule.least:
                        found[k].append((m.start(), kind, m.end()))
        for own in found:
            own.sort()
        return found


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(text: str | Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of secrets in each text by start, then kind as listed; null: none."""

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = scanner(rules)
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch)
            found = [one for part in bounded(texts, SHARD_BYTES) for one in own.scan(part)]
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in one] for one in found]
            yield pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return scan(utf8(text))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans of every row.

    Null and empty texts have no spans; repeated rows and null ids stay as they are; other
    columns are ignored. No shuffle.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), secret_spans(text, rules).alias("spans"))
