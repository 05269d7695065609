"""Sampling of items a user has not touched: training negatives and ranking candidates.

Every user walks through the catalogue in an order of their own: a keyed Feistel network
maps the steps of the walk to items, one to one. The first ``want`` items on the walk that
are not excluded are the sample. Draws are distinct by construction and nothing is rejected
and redrawn. The inverse network tells at which step each excluded item is met, so the
sample is read off as the gaps between those steps: the drawn rows are generated in place
and never shuffled, joined or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import (
    EVAL_NEGATIVES,
    EXPLODE_CHUNK,
    MAX_GROUP_ROWS,
    NEGATIVES_TRAIN,
    NEGATIVES_VAL,
    SEED,
    TRAIN_FRACTION,
)
from rankloom.functions.hashing import PRIME_A, seeded_hash, seeded_hash_sql
from rankloom.operators.ordering import CELL_ROWS
from rankloom.sources.staging import broadcast_if_small, is_small, stage

# Bits of the hash, and how many of them a count of a sample takes at a time.
KEY_BITS, DIGIT_BITS = 31, 15
# Rounds of the network, and how far beyond the catalogue its domain may reach.
WALK_ROUNDS = 6
WALK_SPARE = 24
# Groups by hash in which users with very many rows are looked for.
USER_GROUPS = 4_096


def walk_shape(n_items: int) -> tuple[int, int]:
    """Two factors, as alike as can be, of a number from ``n_items`` to WALK_SPARE above it."""
    best = (1, n_items)
    for size in range(n_items, n_items + WALK_SPARE + 1):
        low = isqrt(size)
        while size % low:
            low -= 1
        if low > best[0]:
            best = (low, size // low)
    return best


class Walk:
    """The per-user permutation of [0, size) as DataFrame steps, size = left * right >= n_items.

    A place is (l, r) = (place div right, place mod right). Rounds add a seeded hash of the
    user and one half to the other half in turn. Places from n_items on are no items.
    """

    def __init__(self, n_items: int, seed: int):
        if n_items < 1:
            raise ValueError("n_items must be positive")
        self.left, self.right = walk_shape(n_items)
        self.size, self.seed = self.left * self.right, seed

    def _through(self, df: DataFrame, place: Column, into: str, sign: int) -> DataFrame:
        """One projection per round keeps the expressions small."""
        df = df.withColumns({"_l": F.floor(place / self.right), "_r": place % self.right})
        for i in range(WALK_ROUNDS)[::sign]:
            half, other, modulus = ("_l", "_r", self.left) if i % 2 == 0 else ("_r", "_l", self.right)
            key = seeded_hash_sql(self.seed + i, "user_idx", other)
            df = df.withColumn(half, F.expr(f"pmod({half} {'+' if sign > 0 else '-'} {key}, {modulus}L)"))
        # Never null, so that no null check is inferred: pushed below the rounds it would
        # spell them all out in one expression.
        place = F.coalesce(F.col("_l") * self.right + F.col("_r"), F.lit(0).cast("bigint"))
        return df.withColumn(into, place).drop("_l", "_r")

    def with_item(self, df: DataFrame, step: str, into: str = "item_idx") -> DataFrame:
        """Add the place met at each step of the row's user."""
        return self._through(df, F.col(step).cast("bigint"), into, 1)

    def with_step(self, df: DataFrame, item: str = "item_idx", into: str = "_step") -> DataFrame:
        """Add the step at which the row's user meets the place."""
        return self._through(df, F.col(item).cast("bigint"), into, -1)


def distinct_pairs(interactions: DataFrame) -> DataFrame:
    """(user_idx, item_idx) without repeats; copies of a pair collapse before the shuffle."""
    return interactions.select("user_idx", "item_idx").dropna().distinct()


def distinct_by(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows, brought together by ``keys``: what follows by these moves no row again."""
    return pairs.repartition(*keys).distinct()


def seen_pairs(*splits: DataFrame) -> DataFrame:
    """Pairs a user may not be offered as new: the union of the given splits."""
    return distinct_pairs(reduce(DataFrame.unionByName, [s.select("user_idx", "item_idx") for s in splits]))


def sample_unseen(
    excluded: DataFrame,
    demand: DataFrame,
    n_items: int,
    seed: int = SEED,
    max_group_rows: int = MAX_GROUP_ROWS,
    keys: Sequence[str] = ("user_idx",),
) -> DataFrame:
    """Draw ``want`` items per user outside the user's excluded ones.

    ``excluded`` holds distinct (user_idx, item_idx) with 0 <= item_idx < n_items;
    ``demand`` holds (user_idx, n_excluded, want) once per user. ``want`` is cut to
    what the catalogue has left. Returns distinct (user_idx, item_idx). ``keys`` may
    add columns to user_idx: every combination is then sampled on its own.
    """
    walk = Walk(n_items, seed)
    demand = demand.withColumn("want", F.least(F.col("want"), F.lit(n_items) - F.col("n_excluded")))
    # Places beyond the catalogue are skipped like excluded items. The walk cannot be longer
    # than this; what is met later does not matter.
    demand = demand.where("want > 0").withColumn("_end", F.col("want") + F.col("n_excluded") + (walk.size - n_items))
    met = walk.with_step(excluded.select(*keys, "item_idx")).join(demand, list(keys)).where(F.col("_step") < F.col("_end"))
    own = _placed(demand.select(*keys, "want", "_end", F.explode(F.array(*_every_place(walk, n_items))).alias("item_idx")), walk, keys)
    # Stored, as the planner takes a union for partitioned by user where its parts are cut into
    # unlike numbers of partitions, and then fails or gives wrong rows.
    stops = stage(met.select(*keys, "want", "_step").unionByName(own), "stops")
    return _between(stops, walk, n_items, max_group_rows, keys)


def _every_place(walk: Walk, n_items: int) -> list[Column]:
    """Places at which every user stops: those beyond the catalogue, which are few by
    construction, and null for the end of the walk."""
    return [*[F.lit(i) for i in range(n_items, walk.size)], F.lit(None).cast("int")]


def _placed(rows: DataFrame, walk: Walk, keys: Sequence[str]) -> DataFrame:
    """Stops at the places of ``rows`` (keys, want, _end, item_idx).

    What is met after the end counts as the end: a stop there again leaves no gap. A filter
    would be pushed below the rounds and spell them all out.
    """
    met = walk.with_step(rows.withColumn("_at", F.coalesce("item_idx", F.lit(0))), "_at")
    step = F.when(F.col("item_idx").isNull(), F.col("_end")).otherwise(F.least("_step", "_end")).cast("bigint")
    return met.select(*keys, "want", step.alias("_step"))


def long_users(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """Key values with more than ``most`` of the ``rows``, staged; ``None`` if there are none.

    Rows are counted by a hash first, which sums up map-side; single users are counted only in
    groups that hold as many rows.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(USER_GROUPS)).cast("int")
    # At most USER_GROUPS rows.
    crowded = [r["g"] for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]
    if not crowded:
        return None
    counted = rows.where(group.isin(crowded)).groupBy(*keys).agg(F.count("*").alias("_n"))
    found = stage(counted.where(F.col("_n") > most).select(*keys), "long-users")
    return None if found.isEmpty() else found


def sample_in_proportion(
    pairs: DataFrame, ratio: Column, n_items: int, seed: int = SEED, max_group_rows: int = MAX_GROUP_ROWS, keys: Sequence[str] = ("user_idx",),
    *, at_least: int = 0, rows: DataFrame | None = None,
) -> DataFrame:
    """:func:`sample_unseen` with ``ratio`` draws per excluded pair, ``at_least`` so many, which
    need no demand table.

    Pairs that :func:`distinct_by` brought together stay where they are: their number is a
    window count, and a user's first row brings the stops that every user has. Only users who have
    more than ``max_group_rows`` stops go the long way, with the same result. Where the catalogue
    is long enough for such users they are looked for in ``rows``, which hold every pair at least
    once and are cheaper to read.
    """
    walk, group = Walk(n_items, seed), Window.partitionBy(*keys)
    far = None
    if n_items + WALK_SPARE >= max_group_rows:
        # Every user stops at the places of _every_place as well.
        long = long_users(pairs if rows is None else rows, keys, max(0, max_group_rows - WALK_SPARE - 1))
        if long is not None:
            named = broadcast_if_small(long)
            own = stage(pairs.join(named, list(keys), "left_semi").select(*keys, "item_idx"), "long-pairs")
            demand = own.groupBy(*keys).agg(F.count("*").alias("n_excluded"))
            demand = demand.withColumn("want", F.greatest(F.col("n_excluded") * ratio, F.lit(at_least)))
            far = sample_unseen(own, demand, n_items, seed, max_group_rows, keys)
            pairs = pairs.join(named, list(keys), "left_anti")
    n = F.count("*").over(group)
    sized = pairs.select(*keys, "item_idx", n.alias("n_excluded"), F.row_number().over(group.orderBy("item_idx")).alias("_nth"))
    sized = sized.withColumn("want", F.least(F.greatest(F.col("n_excluded") * ratio, F.lit(at_least)), F.lit(n_items) - F.col("n_excluded"))).where("want > 0")
    sized = sized.withColumn("_end", F.col("want") + F.col("n_excluded") + (walk.size - n_items))
    places = F.when(F.col("_nth") == 1, F.array("item_idx", *_every_place(walk, n_items))).otherwise(F.array("item_idx"))
    stops = _placed(sized.select(*keys, "want", "_end", F.explode(places).alias("item_idx")), walk, keys)
    # No user left has more stops than a task may order.
    usual = _between(stops, walk, n_items, None, keys)
    return usual if far is None else usual.unionByName(far)


def _between(stops: DataFrame, walk: Walk, n_items: int, max_group_rows: int | None, keys: Sequence[str]) -> DataFrame:
    """The items that lie between stops, as many as are wanted from the start of the walk."""
    gaps = _gaps(stops, n_items, max_group_rows, keys)
    free_before = F.col("_previous") + 1 - F.col("_met")
    length = F.least(F.col("_step") - F.col("_previous") - 1, F.col("want") - free_before)
    runs = (
        gaps.select(*keys, (F.col("_previous") + 1).alias("_from"), length.alias("_length"))
        .where("_length > 0")
        .withColumn("_to", F.col("_from") + F.col("_length") - 1)
    )
    pieces = runs.withColumn("_start", F.expr(f"explode(sequence(_from, _to, {EXPLODE_CHUNK}L))"))
    steps = pieces.withColumn(
        "_k", F.expr(f"explode(sequence(_start, least(_to, _start + {EXPLODE_CHUNK - 1}L)))")
    )
    return walk.with_item(steps.select(*keys, "_k"), "_k").select(*keys, F.col("item_idx").cast("int").alias("item_idx"))


def _gaps(stops: DataFrame, n_items: int, max_group_rows: int | None, keys: Sequence[str]) -> DataFrame:
    """Add the previous stop (-1 at first) and the number of stops met before each one.

    A user has at most about ``n_items`` stops. When that is more than one task should
    order, the walk is cut into stretches that are ordered apart and joined to the
    totals of the stretches before them. Without ``max_group_rows`` a task may order them all.
    """
    if max_group_rows is None or n_items + WALK_SPARE < max_group_rows:
        order = Window.partitionBy(*keys).orderBy("_step")
        return stops.withColumns(
            {
                "_previous": F.lag("_step", 1, -1).over(order),
                "_met": F.row_number().over(order) - 1,
            }
        )
    stops = stops.withColumn("_stretch", F.floor(F.col("_step") / max_group_rows))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        stops.groupBy(*keys, "_stretch")
        .agg(F.count("*").alias("_n"), F.max("_step").alias("_last"))
        .select(
            *keys,
            "_stretch",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_met_earlier"),
            F.coalesce(F.max("_last").over(earlier), F.lit(-1)).alias("_last_earlier"),
        )
    )
    order = Window.partitionBy(*keys, "_stretch").orderBy("_step")
    return stops.join(carried, [*keys, "_stretch"]).withColumns(
        {
            "_previous": F.coalesce(F.lag("_step").over(order), F.col("_last_earlier")),
            "_met": F.col("_met_earlier") + F.row_number().over(order) - 1,
        }
    )


def _labelled(
    interactions: DataFrame,
    n_items: int,
    ratio: Column,
    seed: int,
    max_group_rows: int,
    keys: Sequence[str],
) -> DataFrame:
    """Positives as they come, and ``ratio`` negatives per distinct positive of every key."""
    rows = interactions.select(*keys, "item_idx")
    known = rows.dropna()
    negatives = sample_in_proportion(distinct_by(known, keys), ratio, n_items, seed, max_group_rows, keys, rows=known)
    positives = rows.withColumn("label", F.lit(1.0).cast("float"))
    return positives.unionByName(negatives.withColumn("label", F.lit(0.0).cast("float")))


def negative_samples(
    interactions: DataFrame,
    n_items: int,
    ratio: int = NEGATIVES_TRAIN,
    seed: int = SEED,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Positives (label 1, repeats kept) and ``ratio`` unseen items per distinct positive (label 0)."""
    return _labelled(interactions, n_items, F.lit(ratio), seed, max_group_rows, ["user_idx"])


def labelled_splits(
    interactions: DataFrame,
    n_items: int,
    train_ratio: int = NEGATIVES_TRAIN,
    val_ratio: int = NEGATIVES_VAL,
    seed: int = SEED,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Labelled training and validation pairs, each sampled against its own positives.

    Both splits go through the same pass, with the split as part of the key.
    """
    ratio = F.when(F.col("split") == "train", train_ratio).otherwise(val_ratio)
    wanted = interactions.where("split IN ('train', 'val')")
    return _labelled(wanted, n_items, ratio, seed, max_group_rows, ["split", "user_idx"])


def pick_users(users: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` distinct users in seeded order: a top-k, not a full sort."""
    return users.select("user_idx").distinct().orderBy(seeded_hash(seed, "user_idx"), "user_idx").limit(limit)


def first_test_item(test: DataFrame) -> DataFrame:
    """Each user's earliest test item, the smaller index where times tie."""
    return test.groupBy("user_idx").agg(
        F.min(F.struct("timestamp", "item_idx"))["item_idx"].alias("item_idx")
    )


def eval_candidates(
    interactions: DataFrame,
    n_items: int,
    n_negatives: int = EVAL_NEGATIVES,
    max_users: int | None = None,
    seed: int = SEED,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """One held-out item and ``n_negatives`` unseen items per evaluated user.

    Train and validation items and the held-out item are excluded; other test items
    of the user may be drawn. All users with a test item are evaluated unless ``max_users``
    says how many, chosen by a seeded hash.
    """
    test = interactions.where("split = 'test'")
    held_out = first_test_item(test)
    if max_users is not None:
        held_out = held_out.orderBy(seeded_hash(seed, "user_idx"), "user_idx").limit(max_users)
    # Read several times below; with a cap it has at most max_users rows.
    held_out = stage(held_out, "held-out")
    history = interactions.where("split IN ('train', 'val')")
    if is_small(held_out):
        history = history.join(F.broadcast(held_out.select("user_idx")), "user_idx", "left_semi")
    # Pairs come together by user once; users without a held-out item are known there.
    marked = history.select("user_idx", "item_idx", F.lit(0).alias("_held"))
    marked = marked.unionByName(held_out.select("user_idx", "item_idx", F.lit(1).alias("_held"))).where("user_idx IS NOT NULL")
    pairs = marked.repartition("user_idx").groupBy("user_idx", "item_idx").agg(F.max("_held").alias("_held"))
    pairs = pairs.withColumn("_held", F.max("_held").over(Window.partitionBy("user_idx")))
    excluded = pairs.where("_held = 1 AND item_idx IS NOT NULL").select("user_idx", "item_idx")
    negatives = sample_in_proportion(excluded, F.lit(0), n_items, seed, max_group_rows, at_least=n_negatives, rows=marked)
    return held_out.select("user_idx", "item_idx", F.lit(True).alias("is_positive")).unionByName(
        negatives.withColumn("is_positive", F.lit(False))
    )


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exactly ``n`` rows of ``df`` (all when it has fewer), chosen by a seeded hash.

    ``keys`` are integer columns that identify a row. Rows are counted by the leading digit of
    their hash; digits below the cut are taken whole and the cut digit is counted by the next
    one, until it holds no more than ``cell_rows`` rows or the hash has no digits left. Only
    those few are ordered, so ``n`` and the table may be of any size. ``df`` is read once per
    digit.
    """
    key, floor, width, left, size = seeded_hash(seed, *keys), 0, KEY_BITS, n, None
    whole = F.lit(False)
    while width and (size is None or size > cell_rows):
        digits = min(width, DIGIT_BITS)
        inside = F.shiftright(key, width) == floor >> width
        digit = F.shiftright(key, width - digits)
        # At most 2**DIGIT_BITS rows.
        counts = df.where(inside).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
        cut = None
        for row in counts:
            if row["n"] >= left:
                cut = row
                break
            left -= row["n"]
        if cut is None:
            return df
        width -= digits
        whole = whole | (inside & (digit < cut["d"]))
        floor, size = cut["d"] << width, cut["n"]
    rest = df.where(F.shiftright(key, width) == floor >> width).orderBy(key, *keys).limit(left)
    return df.where(whole).unionByName(rest)


def random_split(df: DataFrame, keys: Sequence[str], fraction: float = TRAIN_FRACTION, seed: int = SEED) -> DataFrame:
    """Add ``split``: each row is 'train' with probability ``fraction``, otherwise 'val'. No shuffle."""
    below = seeded_hash(seed, *keys) < F.lit(int(fraction * PRIME_A))
    return df.withColumn("split", F.when(below, "train").otherwise("val"))
