"""How document filters interact: what each removes, at every step of every order.

Every document gets the mask of the filters it fails. Documents are counted by part and mask
(at most 2**filters rows a part, whatever the size of the table), and the counts of a part
become a zero-suppressed decision diagram: one variable per filter, a pass and a fail branch,
and at each node the documents below it. The orders of the filters are visited by swaps of two
adjacent levels; in each order the path on which every filter is passed gives the steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the audit's filters.
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"

#: All orders are listed, so the filters must be few: 7 have 5,040 orders, 8 have 40,320.
MOST_FILTERS = 7

#: What is counted at every node: documents, good ones, toxic ones.
Weight = tuple[int, int, int]
NOTHING: Weight = (0, 0, 0)

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by filter: few words, repetitive words, capitals, symbols."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


class Diagram:
    """Zero-suppressed decision diagram of weights over sets of failed filters.

    Nodes are shared: one node per variable and pair of branches. A node whose fail branch is
    empty is left out. ``order`` lists the variables from the top.
    """

    def __init__(self, weights: Mapping[int, Weight], variables: int):
        self.order = list(range(variables))
        self.var: list[int | None] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.total: list[Weight] = []
        self.leaves: dict[Weight, int] = {}
        self.unique: dict[tuple[int, int, int], int] = {}
        self.empty = self.leaf(NOTHING)
        self.root = self._build(0, {m: w for m, w in weights.items() if w != NOTHING})

    def _build(self, level: int, weights: Mapping[int, Weight]) -> int:
        if not weights:
            return self.empty
        if level == len(self.order):
            return self.leaf(next(iter(weights.values())))
        bit = 1 << self.order[level]
        low = self._build(level + 1, {m: w for m, w in weights.items() if not m & bit})
        high = self._build(level + 1, {m: w for m, w in weights.items() if m & bit})
        return self.node(self.order[level], low, high)

    def _add(self, var: int | None, low: int, high: int, total: Weight) -> int:
        for column, value in ((self.var, var), (self.low, low), (self.high, high), (self.total, total)):
            column.append(value)
        return len(self.var) - 1

    def leaf(self, weight: Weight) -> int:
        if weight not in self.leaves:
            self.leaves[weight] = self._add(None, -1, -1, weight)
        return self.leaves[weight]

    def node(self, var: int, low: int, high: int) -> int:
        if high == self.empty:
            return low
        key = var, low, high
        if key not in self.unique:
            total = tuple(a + b for a, b in zip(self.total[low], self.total[high], strict=True))
            self.unique[key] = self._add(var, low, high, total)
        return self.unique[key]

    def branches(self, node: int, var: int) -> tuple[int, int]:
        """Where a node leads when ``var`` is passed and when it is failed."""
        return (self.low[node], self.high[node]) if self.var[node] == var else (node, self.empty)

    def swap(self, level: int) -> None:
        """Exchange the variables at ``level`` and below it.

        Only nodes of the upper variable that lead to the lower one change, in place: they
        stand for the same weights, so what leads to them stays as it is.
        """
        upper, lower = self.order[level], self.order[level + 1]
        for at in range(len(self.var)):
            if self.var[at] != upper:
                continue
            low, high = self.low[at], self.high[at]
            if lower not in (self.var[low], self.var[high]):
                continue
            low_pass, low_fail = self.branches(low, lower)
            high_pass, high_fail = self.branches(high, lower)
            del self.unique[upper, low, high]
            self.var[at] = lower
            self.low[at] = self.node(upper, low_pass, high_pass)
            self.high[at] = self.node(upper, low_fail, high_fail)
            self.unique[lower, self.low[at], self.high[at]] = at
        self.order[level], self.order[level + 1] = lower, upper

    def passing(self) -> Iterator[tuple[int, Weight, Weight]]:
        """Along the path that passes every filter: variable, weight kept, weight removed."""
        node = self.root
        for var in self.order:
            node, failed = self.branches(node, var)
            yield var, self.total[node], self.total[failed]

    def only(self, failed: int) -> Weight:
        """Weight of what fails this variable and no other."""
        node = self.root
        for var in self.order:
            node = self.branches(node, var)[var == failed]
        return self.total[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap one after another, so that all n! orders are met once.

    The last element runs from end to end; at each end the others make one step of theirs.
    """
    if n < 2:
        return
    others, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(others, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def audit_steps(weights: Mapping[int, Weight], names: Sequence[str]) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of all orders of the filters."""
    diagram = Diagram(weights, len(names))
    failing = [sum(w[0] for m, w in weights.items() if m >> v & 1) for v in range(len(names))]
    alone = [diagram.only(v)[0] for v in range(len(names))]
    shapley, found = [0] * len(names), []
    for swap in (None, *adjacent_swaps(len(names))):
        if swap is not None:
            diagram.swap(swap)
        order = "".join(names[v] for v in diagram.order)
        for step, (v, kept, removed) in enumerate(diagram.passing(), 1):
            shapley[v] += removed[0]
            found.append((v, order, step, kept[0], removed[0], failing[v] - removed[0], alone[v], removed[1], removed[2]))
    return [(*row, shapley[v]) for v, *row in found]


def _part_steps(names: Sequence[str]):
    columns = [c.split()[0] for c in STEPS.split(", ")]

    def steps(key: tuple, table: pa.Table) -> pa.Table:
        rows = zip(*(table[c].to_pylist() for c in ("mask", "n", "good", "toxic")), strict=True)
        found = audit_steps({m: tuple(w) for m, *w in rows}, names)
        part = pa.array([key[0].as_py()] * len(found), pa.string())
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        values = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.table([part, *values], names=columns)

    return steps


def masks(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters.

    ``filters`` are failure conditions on the text, the column ``text``; one more filter is
    appended: the text is that of a smaller id. Texts are compared by length and SHA-256 and
    counted by text first, so many copies of one text are one row a task before any shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    filters = text_filters(body) if filters is None else filters
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.octet_length(body).alias("size"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        sum(bits, F.lit(0)).cast("int").alias("mask"),
    )
    one = ["size", "digest"]
    copies = rows.groupBy(*one, "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    is_one = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*is_one).withColumn("spread", F.lit(0).cast("bigint"))
    # Rows without an id have no label; the second key deals them out.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint"))
    judged = copies.withColumn("spread", spread).join(known, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    counted = judged.groupBy(*one, "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless"),
    )
    # From here on a text has a row per part, mask and label.
    counted = counted.withColumn("smallest", F.min("first").over(Window.partitionBy(*one)))
    original = F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0) + F.col("n_nameless")
    copy_bit = 1 << len(filters)
    both = F.array(
        F.struct(F.col("mask"), original.alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - original).alias("n")),
    )
    split = counted.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    copies: str = "E",
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``filters`` maps one-letter names to failure conditions (the five of the audit by default),
    ``copies`` names the filter of repeated texts, which comes last.

    kept and removed count the documents after and at the step; redundant fail its filter but
    went before, unique_fails fail no other filter; good_lost and toxic_lost are removed here
    and labelled quality or toxic 1; shapley sums removed over all orders.

    A null text is empty, a null part the empty string. Texts are taken whole, however long.
    Every row counts, repeated ones too; a row repeats a text only if a smaller id has it, so
    rows that share an id and a text do not make each other copies, and rows with a null id
    neither are copies nor make any. Several labels of one id count if any of them is 1; labels
    with a null id or of unknown documents count nowhere. Other columns, of whatever name, are
    ignored. An empty table has no parts and gives no rows.
    """
    names = [*(filters if filters is not None else text_filters(F.lit(""))), copies]
    if len(names) > MOST_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < len(names):
        raise ValueError(f"at most {MOST_FILTERS} filters with different one-letter names, not {names}")
    found = masks(docs, labels, filters, doc_id=doc_id, text=text, part=part)
    return found.groupBy("part").applyInArrow(_part_steps(names), STEPS)
