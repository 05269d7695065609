"""Near-duplicates by SimHash, linked through binary tries.

A fingerprint has 64 bits; two documents link when at most ``distance`` of them differ.
Distinct fingerprints are joined with themselves in as many tries as one more than
``distance``, each reading another block of bits first: two fingerprints within the
distance agree on one block whole (pigeonhole), so each trie starts below that block.
There pairs of nodes are traversed together, differing bits add up, and a pair of nodes
over the budget is left with all that lies below it.

A task reports links that span its part of the graph, not all pairs; components are found
over those by alternating star contractions in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import FOLD, keep, release, utf8

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42

#: Fingerprints below one block of a trie beyond which its join is dealt out to several
#: tasks, every two parts meeting in one of them.
TRIE_ROWS = 4_096

#: Nodes no larger than this are compared fingerprint by fingerprint.
LEAF = 16

#: Comparisons held at a time.
HELD = 1_000_000


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash over shingles of words, repeats included; 0 without words."""
    words = (text or b"").translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = min(shingle, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    view, h = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([h(view[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):  # of a very long text, part by part
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprint(text: str | Column, shingle: int = SHINGLE) -> Column:
    """64-bit fingerprint as a (signed) long; a null text has none of the words, so 0."""

    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for batch in batches:
            values = np.array([fingerprint_of(t.as_py(), shingle) for t in batch], np.uint64)
            yield pa.array(values.view(np.int64), pa.int64())

    return hashed(utf8(text))


def as_text(fp: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_edges(distance: int) -> list[tuple[int, int]]:
    """Bit positions, from the highest, of ``distance + 1`` blocks of nearly equal width."""
    cuts = [BITS * i // (distance + 1) for i in range(distance + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def rotated(prints: np.ndarray, first: int) -> np.ndarray:
    """Fingerprints with their bits read from position ``first`` on, cyclically."""
    if not first:
        return prints
    return (prints << np.uint64(first)) | (prints >> np.uint64(BITS - first))


class Forest:
    """Union of numbered nodes, the smallest number as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join each left with its right, all at once: roots hook onto smaller roots."""
        root = self.root
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                return
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def trie_join(prints: np.ndarray, skip: int, distance: int, part: np.ndarray | None = None) -> np.ndarray:
    """Root (a row number) of each fingerprint in the graph of links among them.

    prints: ascending and distinct, equal in their first ``skip`` bits. With ``part``, only
    pairs of different parts count.
    """
    forest = Forest(len(prints))
    # Pairs of nodes: both as ranges of rows, depth, bits that differ so far.
    stack = [(np.array([[0, len(prints), 0, len(prints)]], np.int64), skip, np.zeros(1, np.int64))]
    while stack:
        pairs, depth, differ = stack.pop()
        small = (pairs[:, 1] - pairs[:, 0] <= LEAF) & (pairs[:, 3] - pairs[:, 2] <= LEAF)
        if depth == BITS:
            small[:] = True
        _compare(prints, pairs[small], distance, part, forest)
        pairs, differ = pairs[~small], differ[~small]
        if not len(pairs):
            continue
        mark = np.uint64(1 << (BITS - 1 - depth))
        # Rows of a node share all bits above, so its two children meet where the bit sets in.
        zeros = np.concatenate([[0], np.cumsum((prints & mark) == 0)])
        split = np.stack([pairs[:, i] + zeros[pairs[:, i + 1]] - zeros[pairs[:, i]] for i in (0, 2)], axis=1)
        same = pairs[:, 0] == pairs[:, 2]
        children, costs = [], []
        for x in (0, 1):
            for y in (0, 1):
                a = np.stack([split[:, 0], pairs[:, 1]] if x else [pairs[:, 0], split[:, 0]], axis=1)
                b = np.stack([split[:, 1], pairs[:, 3]] if y else [pairs[:, 2], split[:, 1]], axis=1)
                cost = differ + (x != y)
                real = (a[:, 0] < a[:, 1]) & (b[:, 0] < b[:, 1]) & (cost <= distance)
                if x > y:  # of a node with itself: the mirror image of the other mixed pair
                    real &= ~same
                children.append(np.concatenate([a, b], axis=1)[real])
                costs.append(cost[real])
        pairs, differ = np.concatenate(children), np.concatenate(costs)
        for at in range(0, len(pairs), HELD // 8):
            stack.append((pairs[at : at + HELD // 8], depth + 1, differ[at : at + HELD // 8]))
    return forest.root


def _compare(prints: np.ndarray, pairs: np.ndarray, distance: int, part: np.ndarray | None, forest: Forest) -> None:
    """Link all fingerprints of paired nodes that are close enough."""
    wide = pairs[:, 3] - pairs[:, 2]
    work = np.cumsum((pairs[:, 1] - pairs[:, 0]) * wide)
    for some in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(work // HELD)) + 1):
        if not len(some):
            continue
        p, w = pairs[some], wide[some]
        n = (p[:, 1] - p[:, 0]) * w
        owner = np.repeat(np.arange(len(some)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        left, right = p[owner, 0] + nth // w[owner], p[owner, 2] + nth % w[owner]
        close = (np.bitwise_count(prints[left] ^ prints[right]) <= distance) & (left != right)
        if part is not None:
            close &= part[left] != part[right]
        forest.join(left[close], right[close])


def _trie_links(distance: int):
    edges = block_edges(distance)

    def links(key: tuple, table: pa.Table) -> pa.Table:
        """Links that span one unit: node to the first node of its part of the graph."""
        block, left, right = (k.as_py() for k in (key[0], key[2], key[3]))
        prints = table["fp"].to_numpy().view(np.uint64)
        first, end = edges[block]
        turned = rotated(prints, first)
        order = np.argsort(turned)
        part = None if left == right else table["part"].to_numpy()[order]
        root = trie_join(turned[order], end - first, distance, part)
        nodes = table["node"].to_numpy()[order]
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": pa.array(nodes[linked]), "v": pa.array(nodes[root[linked]])})

    return links


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) that connect whatever lies within the distance.

    prints: node, fp; fingerprints distinct. Each fingerprint goes to one trie per block,
    keyed by the block's bits. Crowded keys are dealt out in parts.
    """
    blocks = block_edges(distance)
    keys = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", a), BITS - (b - a)).alias("bits")) for i, (a, b) in enumerate(blocks)
    ]
    rows = prints.select("node", "fp", F.inline(F.array(*keys)))
    crowded = rows.groupBy("block", "bits").count().where(F.col("count") > TRIE_ROWS)
    parts = crowded.select("block", "bits", F.ceil(F.col("count") / TRIE_ROWS).cast("int").alias("parts"))
    rows = rows.join(parts, ["block", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # Part i meets part j in the unit (i, j), i <= j; each row goes to all units of its part.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    units = rows.select("block", "bits", "node", "fp", "part", other).select(
        "block", "bits", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "node", "fp", "part"
    )
    return units.groupBy("block", "bits", "left", "right").applyInArrow(_trie_links(distance), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the smallest node it can reach.

    Large-star and small-star contractions in turn: every node hands its larger, then its
    smaller neighbours the smallest node it knows of. Each turn is one sum-like aggregation
    and one join on narrow rows, and is kept in the shared folder. Turns end when one changes
    nothing.
    """
    edges = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # From here on u > v in every row.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        edges = keep(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def groups(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, component and first of every distinct fingerprint of rows (doc_id, fp): the
    smallest fingerprint reachable over links, and the smallest id of the component's rows
    (null if none has one).

    The fingerprints themselves are the nodes, so rows need no ids and may repeat them.
    """
    prints = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("own")), "prints")
    found = components(links(prints.select(F.col("fp").alias("node"), "fp"), distance)).withColumnRenamed("node", "fp")
    named = keep(prints.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "own"), "named")
    first = named.groupBy("component").agg(F.min("own").alias("first"))
    return named.join(first, "component").select("fp", "component", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every row.

    component_id is the smallest id reachable over links, the own id included. Texts
    without words, null ones too, share fingerprint 0 and link like others. Repeated rows
    stay, and rows of one id link by their texts only. Rows with a null id link like others
    (component_id is null if no row they reach has an id). An empty table gives no rows;
    other columns are ignored.
    """
    rows = keep(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text, shingle).alias("fp")), "fingerprints")
    out = rows.join(groups(rows, distance), "fp", "left")
    return out.select("doc_id", as_text(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id"))
