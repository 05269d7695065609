"""Removal of word sequences that occur earlier in the corpus.

A window of ``WINDOW`` words is removed where the same words also start earlier. Documents
are dealt into shards by id, those of an id with much text one by one, and the work goes in
four moves over the same shards:

1. Every shard names the anchors of its windows: the 8-word phrase of least hash in each
   window. Equal windows have equal anchors, so a window whose anchor occurs once in the
   corpus is new. Anchors meet in buckets by hash, and those that recur are sent back to
   the shards that hold them.
2. A shard cuts the words of its recurring anchors, compiles them into an Aho-Corasick
   automaton and streams its documents through. Where phrases occur is known from the
   automaton alone, word by word; only windows around a located phrase go on.
3. The first of equal windows in each shard meet in buckets by hash; all but the earliest
   of the corpus are sent back, with the later ones of the shard itself.
4. A shard drops the words under those windows.

Between moves go packed arrays, one row per shard and bucket: a phrase that a third of all
documents contain appears once per shard, not once per document. Windows of different shards
are told apart by 96 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import keep, offsets, pieces_of, ranges, runs_of, utf8

WINDOW = 20
PHRASE = 8

#: Text of one shard, and text whose anchors and windows meet in one bucket.
SHARD_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000

#: Bits of a word's number that one letter of an automaton's text stands for.
LETTER_BITS = 5

#: Odd multipliers of two rolling hashes modulo 2**64, and a seed.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEED = 9

#: Rows without an id come after all others.
NO_ID = np.iinfo(np.int64).max

#: Bytes by which texts of one id are dealt into ranges of their order.
RANGE_BYTES = 256


class WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def rolling(hashes: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Hash of every ``width`` adjoining values: a polynomial in an odd multiplier."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up = np.full(n, multiplier, np.uint64)
    up[0] = 1
    down = np.full(n - width + 1, pow(multiplier, -1, 2**64), np.uint64)
    down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * np.cumprod(up), out=sums[1:])
    return (sums[width:] - sums[:-width]) * np.cumprod(down)


class Shard:
    """Documents of one shard in the order of the corpus, their words side by side."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].to_pylist()
        texts = [t or b"" for t in table["text"].to_pylist()]
        ranks = table["rank"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, ranks[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.ranks = np.array([ranks[i] for i in order], np.int64)
        self.words = [texts[i].split() for i in order]
        self.base = offsets(np.array([len(w) for w in self.words], np.int64))

    def hash_words(self) -> None:
        own = WordNumbers()
        words = chain.from_iterable(self.words)
        self.symbols = np.fromiter(map(own.__getitem__, words), np.int32, int(self.base[-1]))
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in own), np.uint64, len(own))[self.symbols]

    def window_starts(self) -> np.ndarray:
        """Places where a window fits into its document."""
        sizes = np.maximum(np.diff(self.base) - WINDOW + 1, 0)
        return ranges(self.base[:-1], sizes)

    def anchors(self, starts: np.ndarray, phrases: np.ndarray) -> np.ndarray:
        """Place of the phrase of least hash, the first of equals, in each window."""
        span = WINDOW - PHRASE + 1
        found = np.zeros(len(starts), np.int64)
        for at in range(0, len(starts), 200_000):
            some = starts[at : at + 200_000]
            best, least = np.zeros(len(some), np.int64), phrases[some]
            for i in range(1, span):
                value = phrases[some + i]
                lower = value < least
                best[lower] = i
                least = np.where(lower, value, least)
            found[at : at + 200_000] = some + best
        return np.unique(found)


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpack(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of each bucket that has any."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


ANCHORS = "bucket int, shard int, anchors binary, repeated binary"


def _name_anchors(buckets: int):
    def name(key: tuple, table: pa.Table) -> pa.Table:
        shard = Shard(table)
        shard.hash_words()
        phrases = rolling(shard.hashes, PHRASE, MULTIPLIERS[0])
        found, n = np.unique(phrases[shard.anchors(shard.window_starts(), phrases)], return_counts=True)
        rows = [(b, key[0].as_py(), pack(found[at]), pack(n[at] > 1)) for b, at in by_bucket(found, buckets)]
        return _rows(rows, [("bucket", pa.int32()), ("shard", pa.int32()), ("anchors", pa.binary()), ("repeated", pa.binary())])

    return name


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, columns, strict=True)})


def by_shard(shard: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each shard that has any."""
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(values[order], first[1:]), strict=False):
        yield name, part


def _owner(table: pa.Table, column: str, width: int) -> np.ndarray:
    """Row of each packed value."""
    return np.repeat(np.arange(len(table)), [len(v) // width for v in table[column].to_pylist()])


def recurring_anchors(table: pa.Table) -> pa.Table:
    """Anchors of one bucket that occur more than once, for each shard that holds them."""
    anchors, repeated = unpack(table["anchors"], np.uint64), unpack(table["repeated"], np.bool_)
    shard = table["shard"].to_numpy()[_owner(table, "anchors", 8)]
    _, which, n = np.unique(anchors, return_inverse=True, return_counts=True)
    recurs = n > 1
    recurs[which[repeated]] = True
    chosen = recurs[which]
    rows = [(s, pack(some)) for s, some in by_shard(shard[chosen], anchors[chosen])]
    return _rows(rows, [("shard", pa.int32()), ("anchors", pa.binary())])


WINDOWS = "bucket int, shard int, hashes binary, checks binary, docs binary, ranks binary, places binary, later binary"
WINDOW_FIELDS = [("bucket", pa.int32()), ("shard", pa.int32())] + [(n, pa.binary()) for n in ("hashes", "checks", "docs", "ranks", "places", "later")]


def as_letters(symbols: np.ndarray) -> tuple[str, int]:
    """Numbers written with equally many letters each, and how many. A first letter is none
    of the others, so a phrase is found at whole numbers only; few letters keep the nodes of
    an automaton narrow."""
    width = max(1, -(-int(symbols.max(initial=0)).bit_length() // LETTER_BITS))
    letters = np.empty((len(symbols), width), np.uint8)
    for i in range(width):
        letters[:, i] = 48 + ((symbols >> LETTER_BITS * i) & ((1 << LETTER_BITS) - 1))
    letters[:, 0] += 1 << LETTER_BITS
    return letters.tobytes().decode("latin-1"), width


def occurrences(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """All places of the phrases that start at the given ones."""
    text, width = as_letters(symbols)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for place in places.tolist():
        automaton.add_word(text[width * place : width * (place + PHRASE)])
    automaton.make_automaton()
    ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
    return (ends + 1) // width - PHRASE


def _locate_windows(buckets: int):
    def locate(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        """Windows around recurring phrases: the first of equals, and where later ones are."""
        if not len(replies) or not len(table):
            return _rows([], WINDOW_FIELDS)
        shard = Shard(table)
        shard.hash_words()
        phrases = rolling(shard.hashes, PHRASE, MULTIPLIERS[0])
        recurring = np.unique(unpack(replies["anchors"], np.uint64))
        anchors = shard.anchors(shard.window_starts(), phrases)
        cut = anchors[np.isin(phrases[anchors], recurring)]
        places = occurrences(shard.symbols, cut)
        # Words of two documents make no phrase.
        doc = np.searchsorted(shard.base, places, side="right")
        start, end = shard.base[doc - 1], shard.base[doc]
        inside = (places + PHRASE <= end) & (end - start >= WINDOW)
        places, start, end = places[inside], start[inside], end[inside]
        change = np.zeros(int(shard.base[-1]) + 1, np.int32)
        np.add.at(change, np.maximum(places - (WINDOW - PHRASE), start), 1)
        np.add.at(change, np.minimum(places, end - WINDOW) + 1, -1)
        near = np.cumsum(change) > 0
        starts = shard.window_starts()
        starts = starts[near[starts]]
        hashes = rolling(shard.hashes, WINDOW, MULTIPLIERS[0])[starts]
        checks = (rolling(shard.hashes, WINDOW, MULTIPLIERS[1])[starts] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((starts, checks, hashes))
        h, c = hashes[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        own = np.sort(order[new])
        later = starts[order[~new]].astype(np.uint32)
        name = key[0].as_py()
        ids = np.array([NO_ID if i is None else i for i in shard.ids], np.int64)
        of = np.searchsorted(shard.base, starts, side="right") - 1
        docs, ranks = ids[of], shard.ranks[of]
        rows = []
        for b, some in by_bucket(hashes[own], buckets):
            some = own[some]
            # Ranks are sent where there are any.
            rank = pack(ranks[some]) if ranks[some].any() else b""
            rows.append((b, name, pack(hashes[some]), pack(checks[some]), pack(docs[some]), rank, pack(starts[some].astype(np.uint32)), b""))
        if len(later):
            rows.append((name % buckets, name, b"", b"", b"", b"", b"", pack(np.sort(later))))
        return _rows(rows, WINDOW_FIELDS)

    return locate


def repeated_windows(table: pa.Table) -> pa.Table:
    """Places of all windows of one bucket but the earliest of equals, by shard."""
    hashes, checks = unpack(table["hashes"], np.uint64), unpack(table["checks"], np.uint32)
    docs, places = unpack(table["docs"], np.int64), unpack(table["places"], np.uint32)
    shard = table["shard"].to_numpy()[_owner(table, "hashes", 8)]
    sent = zip(table["docs"].to_pylist(), table["ranks"].to_pylist(), strict=True)
    ranks = np.frombuffer(b"".join(r or bytes(len(d)) for d, r in sent), np.int64)
    # A shard sends the first of its equal windows only; equal ranks of an id are equal texts.
    order = np.lexsort((shard, ranks, docs, checks, hashes))
    h, c = hashes[order], checks[order]
    again = np.zeros(len(order), bool)
    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    again = order[again]
    rows = [(s, pack(some)) for s, some in by_shard(shard[again], places[again])]
    rows += [(s, later) for s, later in zip(table["shard"].to_pylist(), table["later"].to_pylist(), strict=True) if later]
    return _rows(rows, [("shard", pa.int32()), ("places", pa.binary())])


KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def drop_words(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
    """Documents without the words under the given windows."""
    shard = Shard(table)
    change = np.zeros(int(shard.base[-1]) + 1, np.int32)
    if len(replies):
        places = unpack(replies["places"], np.uint32).astype(np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + WINDOW, -1)
    removed = np.cumsum(change[:-1]) > 0
    rows = []
    for doc_id, words, start, end in zip(shard.ids, shard.words, shard.base[:-1], shard.base[1:], strict=True):
        gone = removed[start:end]
        spans = []
        if gone.any():
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(*runs_of(gone), strict=True)]
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        else:
            kept = b" ".join(words)
        rows.append((doc_id, len(words), int(gone.sum()), kept.decode("utf-8", "replace"), spans))
    return _rows(rows, [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(SPAN))])


def in_shards(rows: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """doc_id, text, shard and rank of the rows (doc_id, text). sizes: doc_id, bytes of all ids.

    Rows of one id share a shard and are ordered by text there (rank 0). An id of more text
    than a shard holds, null included, is dealt out row by row, equal rows too; the rank of a
    text among those of its id then gives the order across shards. Ranks are places in a sort
    by ranges of the texts' first bytes, in which equal texts count once.
    """
    crowd = keep(sizes.where(F.col("bytes") > SHARD_BYTES).select(F.col("doc_id").alias("id")), "crowd")
    same = rows["doc_id"].eqNullSafe(crowd["id"])
    usual = rows.join(crowd, same, "left_anti").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    # Numbers of rows in files: a task that runs again deals alike.
    busy = keep(rows.join(crowd, same, "left_semi"), "crowded")
    number = F.xxhash64(F.monotonically_increasing_id())
    dealt = busy.select("doc_id", "text", F.pmod(number, F.lit(shards)).cast("int").alias("shard"), F.sha2("text", 256).alias("sha"))
    texts = busy.select("doc_id", "text").distinct()
    texts = texts.repartitionByRange(shards, "doc_id", F.substring("text", 1, RANGE_BYTES)).sortWithinPartitions("text")
    ranks = keep(texts.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("of"), F.monotonically_increasing_id().alias("rank")), "ranks")
    found = dealt["doc_id"].eqNullSafe(ranks["id"]) & dealt["sha"].eqNullSafe(ranks["of"])
    ranked = keep(dealt.join(ranks, found, "left").select("doc_id", "text", "shard", "rank"), "ranked")
    return usual.withColumn("rank", F.lit(0).cast("long")).unionByName(ranked)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text left, words joined by a space) and removed
    spans (in words, end exclusive) of every row.

    Earlier means a smaller id, or an earlier place in the same document. Rows that share
    an id are documents of their own, ordered by text, however many they are; rows without
    an id come last. Texts of fewer than WINDOW words, empty and null ones lose nothing. An empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    facts = sizes.agg(F.sum("bytes").alias("all"), F.max("bytes").alias("most")).first()
    shards, buckets = pieces_of(facts["all"] or 0, SHARD_BYTES), pieces_of(facts["all"] or 0, BUCKET_BYTES)
    if (facts["most"] or 0) > SHARD_BYTES:
        rows = in_shards(rows, sizes, shards)
    else:
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("rank", F.lit(0).cast("long"))
    # The same shuffled shards feed three of the moves: Spark reuses the exchange.
    rows = rows.groupBy("shard")
    anchors = rows.applyInArrow(_name_anchors(buckets), ANCHORS)
    recurring = anchors.groupBy("bucket").applyInArrow(recurring_anchors, "shard int, anchors binary")
    windows = rows.cogroup(recurring.groupBy("shard")).applyInArrow(_locate_windows(buckets), WINDOWS)
    repeated = windows.groupBy("bucket").applyInArrow(repeated_windows, "shard int, places binary")
    return rows.cogroup(repeated.groupBy("shard")).applyInArrow(drop_words, KEPT)
