"""Language-model scores by a hierarchical Pitman-Yor model over pairs of words.

Every preceding word is a restaurant whose customers are the words that follow it, and all of
these restaurants share one parent, whose customers are their tables; the parent's own base is
uniform over the known words and one unknown word. Seatings are sampled by sweeps: all customers
of a dish leave and sit down again in turn, at a table in proportion to its customers less the
discount, or at a new one in proportion to what the parent predicts. Scores are averages over
the sampled seatings of the predicted probabilities.

Documents are dealt out in batches. A batch asks for its distinct word pairs at shards of
restaurants, whole but for the few crowded ones; shards seat their restaurants against a copy
of the parent made from their own tables, and send the parent one sum of tables per word; from
the merged parent they answer the batches, which add up their documents. Texts and questions
are shuffled once and read twice: Spark reuses the exchange. Nothing but crowded contexts
(8 a shard at most) goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import FOLD, keep, offsets, pieces_of, release, text_bytes, utf8

#: UTF-8 bytes of text behind a batch and behind a shard.
BATCH_BYTES = 24 << 20

#: Parameters of the restaurants of one preceding word and of their parent.
DISCOUNT, CONCENTRATION = 0.75, 1.0
PARENT_DISCOUNT, PARENT_CONCENTRATION = 0.75, 1.0

#: Seatings that are averaged, and sweeps over all customers of every dish before each of them.
SAMPLES, STEPS = 3, 3

#: Customers up to which a dish's tables are drawn from their exact chances, numbers weighed at a
#: time, and new seatings offered to every larger dish in a sweep.
ENUMERATED, SEATS, TRIES = 256, 1 << 20, 4

#: Words are told apart by 56 bits of XXH3: among V words the expected number of pairs that
#: share them is V * V / 2**57, 0.0001 for 4 million words.
WORD_BYTES = 7
END, START = 0, 1

#: A score travels to its batch in units of 2**-20.
SCORE_BITS = 20

#: Dishes seated side by side.
DISHES = 65_536

QUESTIONS = "shard int, batch int, v binary, n binary, w binary, m binary"
TABLES = "dest int, shard int, hot boolean, keys binary, counts binary, tables binary"
PARENTS = "shard int, dest int, hot boolean, numbers binary, stats array<double>"
ANSWERS = "batch int, shard int, scores binary, customers binary, stats array<double>"


class WordIds(dict):
    """Identifiers of words, computed once each."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = max(xxhash.xxh3_64_intdigest(word) >> 64 - 8 * WORD_BYTES, START + 1)
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(FOLD).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    ids = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
    ids[:, :WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, WORD_BYTES)
    return ids.view(np.uint64).ravel()


def squeezed(numbers: np.ndarray) -> bytes:
    """Mostly small numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def loosened(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    parts = [loosened(d, kind) for d in table[column].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def fixed_point(scores: np.ndarray) -> bytes:
    """Negative logarithms in three bytes each; a probability below 1e-16 counts as that."""
    units = np.minimum(np.rint(-scores * (1 << SCORE_BITS)), (1 << 24) - 1).astype(np.uint32)
    return units.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def from_fixed_point(data: bytes) -> np.ndarray:
    units = np.zeros((len(data) // 3, 4), np.uint8)
    units[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return units.view(np.uint32).ravel() * (-1.0 / (1 << SCORE_BITS))


def spread(ids: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """Which of several parts an identifier falls to."""
    mixed = ids * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(20)) % np.asarray(parts).astype(np.uint64)


class Pairs:
    """Distinct pairs in ascending order (first word, second word).

    names: distinct first words; first: their number per pair; second; of: pair per row given.
    """

    def __init__(self, v: np.ndarray, w: np.ndarray):
        self.names, number = np.unique(v, return_inverse=True)
        number = number.astype(np.int32)
        bits = max(1, len(self.names).bit_length())
        free = 64 - bits
        keys = number.astype(np.uint64) << np.uint64(free)
        keys |= w >> np.uint64(max(0, 8 * WORD_BYTES - free))
        order = np.argsort(keys).astype(np.int32)
        keys, second = keys[order], w[order]
        same = keys[1:] == keys[:-1]
        del keys
        if (same & (second[1:] != second[:-1])).any():
            order = np.lexsort((w, number)).astype(np.int32)
            second = w[order]
            same = (second[1:] == second[:-1]) & (number[order][1:] == number[order][:-1])
        new = np.ones(len(order), bool)
        new[1:] = ~same
        self.starts = np.flatnonzero(new).astype(np.int32)
        self.order = order
        self.first, self.second = number[order[self.starts]], second[self.starts]
        self.of = np.empty(len(order), np.int32)
        self.of[order] = np.cumsum(new, dtype=np.int32) - 1

    def __len__(self) -> int:
        return len(self.starts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.starts) if len(self) else values[:0]


class Crowded:
    """Contexts too frequent for one shard, and over how many parts each is dealt."""

    def __init__(self, parts: dict[int, int], shards: int):
        self.shards = shards
        self.ids = np.array(sorted(parts), np.uint64)
        self.parts = np.array([parts[i] for i in sorted(parts)], np.int64)

    def parts_of(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.ones(len(contexts), np.int64)
        at = np.minimum(np.searchsorted(self.ids, contexts), len(self.ids) - 1)
        return np.where(self.ids[at] == contexts, self.parts[at], 1)

    def shard_of(self, pairs: Pairs) -> np.ndarray:
        home = spread(pairs.names, self.shards)[pairs.first]
        part = spread(pairs.second, self.parts_of(pairs.names)[pairs.first])
        return ((home + part) % np.uint64(self.shards)).astype(np.int64)


class Batch:
    """The tokens of a batch of documents as pairs, dealt to shards."""

    def __init__(self, texts: list[bytes | None], crowded: Crowded):
        ids, end = WordIds(), np.array([END], np.uint64)
        tokens = np.concatenate([part for t in texts for part in (ids.of(t), end)])
        del ids
        self.ends = np.flatnonzero(tokens == END)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], self.ends[:-1] + 1])] = START
        self.pairs = Pairs(before, tokens)
        del before, tokens
        shard = crowded.shard_of(self.pairs)
        # Pairs by shard, and inside a shard in their order.
        self.dealt = np.argsort(shard, kind="stable")
        self.edges = np.searchsorted(shard[self.dealt], np.arange(crowded.shards + 1))
        first = self.pairs.first[self.dealt]
        # A run: the pairs of one context in one shard.
        new = np.ones(len(first), bool)
        new[1:] = first[1:] != first[:-1]
        new[self.edges[:-1][self.edges[:-1] < len(first)]] = True
        self.runs = np.flatnonzero(new)
        self.run_context = first[self.runs]

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.concatenate([[0], self.ends[:-1] + 1]))


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _ask(crowded: Crowded):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        """Per shard the batch's pairs and how often each stands in a training document."""
        release()
        batch = Batch(table["text"].to_pylist(), crowded)
        length = np.diff(batch.ends, prepend=-1)
        trains = np.repeat(table["trains"].to_numpy().astype(np.uint32), length)
        m, w = batch.pairs.sums(trains)[batch.dealt], batch.pairs.second[batch.dealt]
        size = np.diff(batch.runs, append=len(w)).astype(np.uint32)
        run_edges = np.searchsorted(batch.runs, batch.edges)
        names, rows = batch.pairs.names[batch.run_context], []
        for s in np.flatnonzero(np.diff(batch.edges)):
            some, runs = slice(*batch.edges[s : s + 2]), slice(*run_edges[s : s + 2])
            rows.append((int(s), key[0].as_py(), packed(names[runs]), squeezed(size[runs]), packed(w[some]), squeezed(m[some].astype(np.uint32))))
        return table_of(rows, QUESTIONS)

    return ask


def reseated(customers: np.ndarray, weight: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """One customer of every dish leaves and sits down again: the plain step whose chances
    :class:`Sittings` keeps with whole sweeps.

    customers: per dish, two at least; weight: of a new table; tables: customers at each table,
    0 for none, changed in place. Returns the number of tables.
    """
    out = np.empty(len(customers), np.int64)
    for at in range(0, len(customers), DISHES):
        some, n = tables[at : at + DISHES], customers[at : at + DISHES]
        row = np.arange(len(n))
        leaves = rng.random(len(n)) * n
        some[row, (np.cumsum(some, axis=1) <= leaves[:, None]).sum(axis=1)] -= 1
        taken = some > 0
        seats = np.cumsum(np.where(taken, some - discount, 0), axis=1)
        drawn = rng.random(len(n)) * (seats[:, -1] + weight[at : at + DISHES])
        seat = np.where(drawn >= seats[:, -1], (~taken).argmax(axis=1), (seats <= drawn[:, None]).sum(axis=1))
        some[row, seat] += 1
        out[at : at + DISHES] = (some > 0).sum(axis=1)
    return out


@cache
def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the weights with which n customers sit at t tables, n and t up to ENUMERATED."""
    size = ENUMERATED + 1
    out = np.full((size, size), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, size)
    for n in range(1, size - 1):
        free = np.log(np.where(n > discount * t, n - discount * t, 1.0))
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.where(t <= n, out[n, 1:] + free, -np.inf))
    return out


class Sittings:
    """Sampled numbers of tables of many dishes, which start with one table each.

    A sweep seats all customers of every dish again. Dishes of up to ENUMERATED customers draw
    their number of tables from its exact chances. Larger ones draw what a new seating would be:
    as many further tables as a Poisson variable of mean weight / discount says, each of a size
    after Sibuya's law, thinned by size, and the rest of the customers at the largest table; a
    Metropolis-Hastings step takes it or not, which keeps the exact chances.
    """

    def __init__(self, customers: np.ndarray, discount: float):
        self.customers, self.discount = customers, discount
        self.tables = np.ones(len(customers), np.int64)
        order = np.argsort(customers, kind="stable")
        few, self.large = np.split(order, [np.searchsorted(customers[order], ENUMERATED, "right")])
        sizes = customers[few]
        edges = np.append(np.flatnonzero(np.diff(sizes, prepend=0)), len(few))
        #: Dishes with the same number of customers, in parts of bounded size.
        self.alike = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step = max(1, SEATS // int(sizes[a]))
            self.alike += [few[i : min(i + step, b)] for i in range(a, b, step)]
        #: Per large dish: customers at the largest table, and other tables as large.
        self.largest, self.ties = customers[self.large].astype(float), np.zeros(len(self.large))

    def sweep(self, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """All customers leave and sit down again; the number of tables of every dish.

        weight: of a new table, for each dish.
        """
        for some in self.alike:
            n = int(self.customers[some[0]])
            chances = log_stirling(self.discount)[n, 1 : n + 1] + np.log(weight[some])[:, None] * np.arange(1, n + 1)
            chances = np.cumsum(np.exp(chances - chances.max(axis=1, keepdims=True)), axis=1)
            drawn = rng.random(len(some)) * chances[:, -1]
            self.tables[some] = np.minimum((chances <= drawn[:, None]).sum(axis=1), n - 1) + 1
        mean = weight[self.large] / self.discount
        ends = np.flatnonzero(np.diff(np.cumsum(mean + 1) // SEATS, append=-1)) + 1
        for a, b in zip(np.append(0, ends), ends, strict=False):
            for _ in range(TRIES):
                self._seat_large(slice(a, b), mean[a:b], rng)
        return self.tables.copy()

    def _seat_large(self, part: slice, mean: np.ndarray, rng: np.random.Generator) -> None:
        dish, largest, ties = self.large[part], self.largest[part], self.ties[part]
        d, n = self.discount, self.customers[dish].astype(float)
        # Sizes are thinned by a power of 1 - e, which no chance given their sum depends on, so
        # that the rest is about 1 / e, as large as the largest of the others.
        low, high = np.full(len(dish), -45.0), np.zeros(len(dish))
        for _ in range(40):
            e = np.exp((low + high) / 2)
            over = mean * d * (1 - e) * e ** (d - 1) + 1 / e > n
            low, high = np.where(over, np.log(e), low), np.where(over, high, np.log(e))
        thin = np.log1p(-np.minimum(np.exp(high), 1 - 1e-9))
        more = rng.poisson(mean)
        # Sibuya's law: trials up to the first success, whose chance is a beta variable.
        chance = np.clip(rng.beta(d, 1 - d, int(more.sum())), 1e-15, 1 - 1e-15)
        size = np.maximum(np.ceil(np.log1p(-rng.random(len(chance))) / np.log1p(-chance)), 1.0)
        of = np.repeat(np.arange(len(dish)), more)
        stays = np.log1p(-rng.random(len(size))) < size * thin[of]
        of, size = of[stays], size[stays]
        rest = n - np.bincount(of, size, len(dish))
        larger = np.bincount(of, size > rest[of], len(dish))
        as_large = np.bincount(of, size == rest[of], len(dish))
        # The rest sits at the largest table. Its size was not drawn: the chance of that is what
        # a seating has over the others; Sibuya's is this power within 1 / size**2.
        possible = (rest >= 1) & (larger == 0)

        def merit(largest, ties):
            return -(1 + d) * np.log(largest - d / 2) + largest * thin - np.log1p(ties)

        new = np.where(possible, rest, 1.0)
        moved = possible & (np.log1p(-rng.random(len(dish))) < merit(new, as_large) - merit(largest, ties))
        self.tables[dish[moved]] = 1 + np.bincount(of, minlength=len(dish))[moved]
        largest[moved], ties[moved] = rest[moved], as_large[moved]


def shrunk(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Customers less the discount of every table; 0 for what was never served."""
    return np.where(customers > 0, customers - discount * tables, 0.0)


class Seating:
    """The restaurants of one shard: their customers, and sampled numbers of tables."""

    def __init__(self, shard: int, table: pa.Table, crowded: Crowded):
        runs = np.repeat(unpacked(b"".join(table["v"].to_pylist())), joined(table, "n", np.uint32))
        self.pairs = Pairs(runs, unpacked(b"".join(table["w"].to_pylist())))
        del runs
        self.customers = self.pairs.sums(joined(table, "m", np.uint32).astype(np.int64))
        self.words, word = np.unique(self.pairs.second, return_inverse=True)
        self.word = word.astype(np.int32)
        del word
        n = len(self.pairs.names)
        self.guests = np.bincount(self.pairs.first, self.customers, n)
        self.parts = crowded.parts_of(self.pairs.names)
        served = self.customers > 0
        dish = np.flatnonzero(self.customers > 1)
        # The shard's copy of the parent: a table of every dish is a customer.
        known = np.bincount(self.word[served], minlength=len(self.words))
        base = (PARENT_CONCENTRATION + PARENT_DISCOUNT * (known > 0).sum()) / ((known > 0).sum() + 1)
        parent = (shrunk(known, known > 0, PARENT_DISCOUNT) + base) / (PARENT_CONCENTRATION + known.sum())
        rng = np.random.Generator(np.random.Philox(key=shard))
        sittings = Sittings(self.customers[dish], DISCOUNT)
        tables = served.astype(np.int64)
        self.tables = np.zeros((SAMPLES, len(self.pairs)), np.uint32)
        for sample in range(SAMPLES):
            for _ in range(STEPS):
                room = np.bincount(self.pairs.first, tables, n) * self.parts
                weight = (CONCENTRATION + DISCOUNT * room[self.pairs.first[dish]]) * parent[self.word[dish]]
                tables[dish] = sittings.sweep(weight, rng)
            self.tables[sample] = tables
        #: Per sample and restaurant.
        self.rooms = np.stack([np.bincount(self.pairs.first, t, n) for t in self.tables])
        self.hot = np.flatnonzero(self.parts > 1)

    def destinations(self, dests: int) -> Iterator[tuple[int, bool, np.ndarray]]:
        """Where to send words (and crowded contexts), and which: in one fixed order."""
        for hot, ids in ((False, self.words), (True, self.pairs.names[self.hot])):
            dest = spread(ids, dests).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            edges = np.searchsorted(dest[order], np.arange(dests + 1))
            for d in np.flatnonzero(np.diff(edges)):
                yield int(d), hot, order[edges[d] : edges[d + 1]]


def _seat(crowded: Crowded):
    def seat(key: tuple, table: pa.Table) -> pa.Table:
        """Tables that the shard sends to the parent, by word."""
        shard = key[0].as_py()
        own = Seating(shard, table, crowded)
        count = np.bincount(own.word, own.customers, len(own.words)).astype(np.int64)
        tables = np.stack([np.bincount(own.word, t, len(own.words)) for t in own.tables]).astype(np.uint32)
        rows = []
        for dest, hot, some in own.destinations(crowded.shards):
            if hot:
                at = own.hot[some]
                values = own.pairs.names[at], own.guests[at].astype(np.int64), own.rooms[:, at].astype(np.uint32)
            else:
                values = own.words[some], count[some], tables[:, some]
            rows.append((dest, shard, hot, packed(values[0]), squeezed(values[1]), squeezed(values[2].T)))
        return table_of(rows, TABLES)

    return seat


def parent_tables(dest: int, customers: np.ndarray) -> np.ndarray:
    """Sampled tables of the parent's dishes. As nearly every word has a table there, a new
    one weighs about the discount under the uniform base."""
    rng = np.random.Generator(np.random.Philox(key=dest))
    tables, dish = (customers > 0).astype(np.int64), np.flatnonzero(customers > 1)
    sittings = Sittings(customers[dish], PARENT_DISCOUNT)
    for _ in range(STEPS):
        tables[dish] = sittings.sweep(np.full(len(dish), PARENT_DISCOUNT), rng)
    return tables


def merge_parents(key: tuple, table: pa.Table) -> pa.Table:
    """The parent's dishes of one destination, back to every shard that asked; one more row
    with tokens, known words, customers and tables per sample."""
    dest, rows = key[0].as_py(), []
    stats = np.zeros(2 + 2 * SAMPLES)
    for hot in (False, True):
        some = table.filter(pc.equal(table["hot"], hot))
        if not len(some):
            continue
        asked = [unpacked(k) for k in some["keys"].to_pylist()]
        ids, at = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.bincount(at, joined(some, "counts", np.int64), len(ids)).astype(np.int64)
        tables = joined(some, "tables", np.uint32).reshape(-1, SAMPLES)
        sums = np.stack([np.bincount(at, tables[:, s], len(ids)) for s in range(SAMPLES)]).astype(np.int64)
        if hot:
            numbers = np.vstack([count, sums])
        else:
            seated = np.stack([parent_tables(dest * SAMPLES + s, sums[s]) for s in range(SAMPLES)])
            numbers = np.vstack([sums, seated])
            stats += np.concatenate([[count.sum(), (count > 0).sum()], sums.sum(axis=1), seated.sum(axis=1)])
        base = offsets(np.array([len(a) for a in asked]))
        for shard, a, b in zip(some["shard"].to_pylist(), base[:-1], base[1:], strict=True):
            rows.append((shard, dest, hot, squeezed(numbers[:, at[a:b]]), None))
    return table_of([*rows, (-1, dest, False, b"", stats.tolist())], PARENTS)


def _answer(crowded: Crowded):
    def answer(key: tuple, table: pa.Table, parents: pa.Table) -> pa.Table:
        """Scores of the pairs that each batch asked for, and customers of their contexts."""
        if not len(table) or not len(parents):
            return table_of([], ANSWERS)
        own = Seating(key[0].as_py(), table, crowded)
        replies = {(d, h): n for d, h, n in zip(parents["dest"].to_pylist(), parents["hot"].to_pylist(), parents["numbers"].to_pylist(), strict=True)}
        stats = np.array(parents["stats"][0].as_py())
        served = np.zeros((SAMPLES, len(own.words)))
        guests, rooms = own.guests.copy(), own.rooms.astype(float)
        for dest, hot, some in own.destinations(crowded.shards):
            if hot:
                numbers = loosened(replies[dest, hot], np.int64).reshape(1 + SAMPLES, -1)
                guests[own.hot[some]], rooms[:, own.hot[some]] = numbers[0], numbers[1:]
            else:
                numbers = loosened(replies[dest, hot], np.int64).reshape(2, SAMPLES, -1)
                served[:, some] = shrunk(*numbers, PARENT_DISCOUNT)
        total = np.zeros(len(own.pairs))
        for sample in range(SAMPLES):
            customers, tables = stats[2 + sample], stats[2 + SAMPLES + sample]
            base = (PARENT_CONCENTRATION + PARENT_DISCOUNT * tables) / (stats[1] + 1)
            parent = (served[sample] + base) / (PARENT_CONCENTRATION + customers)
            share = (CONCENTRATION + DISCOUNT * rooms[sample])[own.pairs.first]
            total += shrunk(own.customers, own.tables[sample], DISCOUNT) + share * parent[own.word]
        scores = np.log10(total / SAMPLES / (CONCENTRATION + guests[own.pairs.first]))
        rows, pair = [], 0
        for batch, n in zip(table["batch"].to_pylist(), table["n"].to_pylist(), strict=True):
            base = offsets(loosened(n, np.uint32)) + pair
            pair = int(base[-1])
            asked = own.pairs.of[base[0] : pair]
            customers = guests[own.pairs.first[own.pairs.of[base[:-1]]]].astype(np.int64)
            rows.append((batch, key[0].as_py(), fixed_point(scores[asked]), squeezed(customers), stats[:2].tolist()))
        return table_of(rows, ANSWERS)

    return answer


def _score(crowded: Crowded):
    def score(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Sums over the tokens of every document of the batch."""
        batch = Batch(table["text"].to_pylist(), crowded) if len(table) else None
        if batch is None:
            return pa.table([table["doc_id"], *[pa.array([], t) for _, t in SCORE_FIELDS]], names=["doc_id", *[n for n, _ in SCORE_FIELDS]])
        answers = answers.sort_by("shard")
        tokens, words = answers["stats"][0].as_py()
        by_pair = np.empty(len(batch.pairs))
        by_pair[batch.dealt] = from_fixed_point(b"".join(answers["scores"].to_pylist()))
        customers = np.zeros(len(batch.pairs.names))
        customers[batch.run_context] = joined(answers, "customers", np.int64)
        # A word stands before the next token; the end of a text is met as often as its start.
        count = np.empty(len(batch.pairs.of))
        count[:-1] = customers[batch.pairs.first[batch.pairs.of[1:]]]
        count[batch.ends] = customers[np.searchsorted(batch.pairs.names, np.uint64(START))]
        known = batch.per_document((count > 0).astype(np.int32))
        count += 0.5
        base = np.log10(count, out=count)
        base -= np.log10(tokens + 0.5 * (words + 1))
        base = batch.per_document(base)
        del count
        values = (
            np.diff(batch.ends, prepend=-1),
            known,
            np.full(len(table), int(tokens)),
            base,
            batch.per_document(by_pair[batch.pairs.of]),
        )
        columns = [pa.array(v, t) for v, (_, t) in zip(values, SCORE_FIELDS[1:], strict=True)]
        return pa.table([table["doc_id"], table["held_out"], *columns], names=["doc_id", *[n for n, _ in SCORE_FIELDS]])

    return score


SCORE_FIELDS = [
    ("held_out", pa.bool_()),
    ("n_tokens", pa.int64()),
    ("n_known", pa.int64()),
    ("train_tokens", pa.int64()),
    ("base_score", pa.float64()),
    ("score", pa.float64()),
]


def _frequent(shards: int):
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts that hold a part of 1 / (8 * shards) of some batch, and all tokens as -1.

        A context over twice that part of all tokens has at least half of them in such batches.
        """
        for batch in batches:
            ids = WordIds()
            texts = [ids.of(t) for t in batch["text"].to_pylist()]
            total = sum(map(len, texts)) + len(texts)
            names, n = np.unique(np.concatenate([*texts, np.full(len(texts), START, np.uint64)]), return_counts=True)
            some = n * 8 * shards >= total
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(names[some].astype(np.int64), -1)), pa.array(np.append(n[some], total))], ["id", "n"]
            )

    return frequent


def crowded_contexts(rows: DataFrame, shards: int) -> Crowded:
    """Contexts dealt over several shards: those over a quarter of a shard's share of tokens.

    At most ``8 * shards`` contexts come back.
    """
    if shards == 1:
        return Crowded({}, 1)
    counts = keep(rows.select("text").mapInArrow(_frequent(shards), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "contexts")
    total = counts.where("id = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where((F.col("id") >= 0) & (F.col("n") * 8 * shards >= total)).collect()
    return Crowded({r["id"]: 1 + r["n"] * 4 * shards // total for r in hot}, shards)


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text leaves 1 by 5; false for a null id."""
    return F.coalesce(remainder(doc_id, 5) == 1, F.lit(False))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: Column | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows that are not held out. Tokens are lower-cased words and one end of
    text. ``base_score`` is the log10 probability under smoothed word counts, ``score`` that
    of the model. A null or empty text is an end of text alone. Texts are scored whole; a text
    longer than a batch makes a batch as long. Repeated rows are scored and learned from each;
    rows with a null id are learned from. With nothing to learn from every token is the unknown
    word and certain. Other columns are ignored; an empty table gives no rows.

    ``docs`` must give the same rows in the same order when a task is run again, as stored
    tables do. With the same table and batches the result is the same in every run.
    """
    spark = docs.sparkSession
    batches = pieces_of(text_bytes(docs, text), batch_bytes)
    held = held_out(doc_id) if held is None else held
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), utf8(text).alias("text"))
    crowded = crowded_contexts(rows, batches)
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id"), F.lit(batches)).cast("int")
    dealt = rows.withColumn("trains", (~F.col("held_out")).cast("int")).withColumn("batch", deal).groupBy("batch")
    questions = dealt.applyInArrow(_ask(crowded), QUESTIONS).groupBy("shard")
    merged = questions.applyInArrow(_seat(crowded), TABLES).groupBy("dest").applyInArrow(merge_parents, PARENTS)
    sums = [F.sum(F.col("stats")[i]) for i in range(2 + 2 * SAMPLES)]
    totals = merged.where("shard = -1").agg(F.array(*sums).alias("stats"))
    parents = merged.where("shard >= 0").drop("stats").crossJoin(F.broadcast(totals))
    answers = questions.cogroup(parents.groupBy("shard")).applyInArrow(_answer(crowded), ANSWERS)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.cogroup(answers.groupBy("batch")).applyInArrow(_score(crowded), out)
