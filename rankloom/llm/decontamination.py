"""Occurrences of benchmark phrases in training documents.

Every shard of documents (an Arrow batch) gets an FM-index over its words. All benchmark
windows are searched backwards in it at once, occurrences are located by sampled suffix
positions, and overlapping occurrences of a document merge into spans.

The alphabet of the index is the words of the benchmark. No occurrence reaches over another
word, so stretches between other words that are shorter than the shortest window are left
out of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import FOLD_WORDS, offsets, ranges, release, runs_of, utf8
from rankloom.llm.fm_index import FmIndex

WINDOW = 13

#: Benchmark text sent to the executors at a time; a larger benchmark takes several passes.
BLOCK_BYTES = 4_000_000

#: Words of one index, and located occurrences held at a time.
SHARD_WORDS = 2_000_000
LOCATED = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: letters and digits of ASCII, and everything beyond ASCII."""
    return text.translate(FOLD_WORDS).split() if text else []


class Benchmark:
    """Windows of the items of one block, grouped by length, with the items they are from."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        names: dict[str, int] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            width = min(WINDOW, len(ids))
            for i in range(len(ids) - width + 1 if ids else 0):
                owners = windows.setdefault(tuple(ids[i : i + width]), set())
                if name is not None:
                    owners.add(names.setdefault(name, len(names)))
        self.names = list(names)
        self.shortest = min(map(len, windows), default=0)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in sorted(set(map(len, windows))):
            same = [w for w in windows if len(w) == width]
            owners = [sorted(windows[w]) for w in same]
            self.groups.append(
                (np.array(same, np.int64), offsets(np.array([len(o) for o in owners])), np.array([i for o in owners for i in o], np.int64))
            )


class Screened(NamedTuple):
    n_words: np.ndarray
    spans: list[list[tuple[int, int]]]
    items: list[list[str]]


def screen(texts: list[bytes | None], benchmark: Benchmark) -> Screened:
    """Hit spans (in words, end exclusive) and occurring items of each text of one shard."""
    lookup, shortest = benchmark.vocabulary.get, benchmark.shortest
    n_words = np.zeros(len(texts), np.int64)
    kept, kept_at, size, total = [], [], 0, 0
    hit_start, hit_length, pairs = [], [], []

    def search_shard() -> None:
        if kept:
            _search(benchmark, np.concatenate(kept), np.concatenate(kept_at), offsets(n_words), hit_start, hit_length, pairs)

    for k, text in enumerate(texts):
        words = words_of(text)
        n_words[k] = len(words)
        if benchmark.groups:
            ids = np.fromiter(map(lookup, words, repeat(0)), np.int64, len(words))
            start, end = runs_of(ids > 0)
            long = end - start >= shortest
            for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True):
                kept.append(np.append(ids[i:j], 0))  # 0 ends the stretch
                kept_at.append(np.arange(i, j + 1) + total)
                size += j - i + 1
        total += len(words)
        if size >= SHARD_WORDS:
            search_shard()
            kept, kept_at, size = [], [], 0
    search_shard()
    base = offsets(n_words)
    change = np.zeros(base[-1] + 1, np.int32)
    for start, length in zip(hit_start, hit_length, strict=True):
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    hit = np.cumsum(change[:-1]) > 0
    for doc in np.unique(np.searchsorted(base, np.flatnonzero(hit), side="right") - 1):
        for start, end in zip(*runs_of(hit[base[doc] : base[doc + 1]]), strict=True):
            spans[doc].append((int(start), int(end)))
    if pairs:
        for code in np.unique(np.concatenate(pairs)):
            doc, item = divmod(int(code), len(benchmark.names))
            items[doc].append(benchmark.names[item])
    return Screened(n_words, spans, items)


def _search(benchmark, text, text_at, base, hit_start, hit_length, pairs) -> None:
    """Index one shard's stretches and collect where the windows occur."""
    index = FmIndex(text)
    for windows, owner_start, owners in benchmark.groups:
        start, end = index.search(windows)
        found = np.flatnonzero(end > start)
        sizes = end[found] - start[found]
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // LOCATED)) + 1
        for some in np.split(np.arange(len(found)), cut):
            if not len(some):
                continue
            which = np.repeat(found[some], sizes[some])
            position = text_at[index.locate(ranges(start[found[some]], sizes[some]))]
            hit_start.append(np.unique(position))
            hit_length.append(windows.shape[1])
            doc = np.searchsorted(base, position, side="right") - 1
            owner_count = np.diff(owner_start)[which]
            item = owners[ranges(owner_start[which], owner_count)]
            if len(item):
                pairs.append(np.unique(np.repeat(doc, owner_count) * len(benchmark.names) + item))


SCREENED = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def screened(text: str | Column, items: list[tuple[str | None, bytes | None]]) -> Column:
    """Word count, hit spans and occurring items of each text, for one block of items."""

    @F.arrow_udf(SCREENED)
    def screen_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        benchmark = Benchmark(items)
        for batch in batches:
            found = screen(batch.to_pylist(), benchmark)
            spans = [[{"start": s, "end": e} for s, e in own] for own in found.spans]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(found.n_words, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(found.items, pa.list_(pa.string())),
                ],
                ["n_words", "spans", "items"],
            )

    return screen_batches(utf8(text))


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The benchmark in blocks of bounded size; one block, maybe empty, at least."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("name"), utf8(text).alias("text"))
    for row in rows.toLocalIterator():
        block.append((row["name"], None if row["text"] is None else bytes(row["text"])))
        size += len(row["text"] or b"")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def with_hits(docs: DataFrame, benchmark: DataFrame, into: str, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, spans, items.

    Null texts have no words; a null item id names no item, but its words still hit;
    items without words have no window; repeated rows count each for themselves. An item
    id that stands in several rows is one item with the windows of all. An existing column
    ``into`` is replaced. No shuffle.
    """
    blocks = list(item_blocks(benchmark, item_id, item_text))
    parts = [f"__{into}_{i}" for i in range(len(blocks))]
    rows = docs.withColumns({p: screened(text, b) for p, b in zip(parts, blocks, strict=True)})
    spans, items = F.col(f"`{parts[0]}`.spans"), F.col(f"`{parts[0]}`.items")
    if len(parts) > 1:
        spans = merge_spans(F.array_sort(F.flatten(F.array(*(F.col(f"`{p}`.spans") for p in parts)))))
        items = F.flatten(F.array(*(F.col(f"`{p}`.items") for p in parts)))
    length = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    found = F.struct(
        F.col(f"`{parts[0]}`.n_words").alias("n_words"),
        length.alias("n_hit"),
        spans.alias("spans"),
        F.array_sort(F.array_distinct(items)).alias("items"),
    )
    return rows.withColumn(into, found).drop(*parts)


def merge_spans(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        spans,
        empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def contaminated(hits: str) -> Column:
    """One word in twenty, or more, stands in a benchmark window."""
    n_hit, n_words = F.col(f"{hits}.n_hit"), F.col(f"{hits}.n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, contaminated of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = with_hits(rows, benchmark, "hits", "text", item_id, item_text)
    return rows.select("doc_id", "hits.*", contaminated("hits").alias("contaminated"))
