"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is an agenda of adjacent symbol pairs: the pair with the best score, leftmost
among equals, is joined until no pair is a piece. What is left and is no piece falls back
to byte pieces. Texts are cut first at places that no piece of the vocabulary spans; a cut
text has the same merges, and a stretch met before is not encoded again.

Each newly met stretch is also checked, a batch at a time, against the ``sentencepiece``
library. Where the two disagree the library's identifiers are taken and the disagreement
is counted in the result.
"""

from __future__ import annotations

import heapq
import re
import string
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from rankloom.llm.common import bounded, offsets, resident, utf8

SPACE_MARK = "▁"

#: Stretches remembered by a Python worker.
REMEMBERED = 150_000

#: Stretches merged side by side.
MANY = 8_000

#: Longer stretches are merged one by one with a heap, shorter ones many at a time.
SHORT = 60

#: Piece types of the model file: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class PieceModel:
    """Encodes as ``sentencepiece`` does with a BPE model without text normalisation."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trained, norm = proto.trainer_spec, proto.normalizer_spec
        types = {p.type for p in proto.pieces}
        if (
            trained.model_type != BPE
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.escape_whitespaces
            or not norm.add_dummy_prefix
            or trained.treat_whitespace_as_suffix
            or not trained.byte_fallback
            or types & {USER_DEFINED, UNUSED}
        ):
            raise ValueError(f"{path} is no plain byte-fallback BPE model")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.library.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        # The heap takes the smallest first.
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stretches = self._stretches()
        self._tables()

    def _stretches(self) -> re.Pattern:
        """Cuts before a space mark that follows another character, and around line ends,
        as far as no piece has such a place inside."""
        long = [p for p in self.ids if len(p) > 1]
        before_mark = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in long)
        lines = not any("\n" in p for p in long)
        if not (before_mark and lines):
            return re.compile(r"(?s:.+)")
        # Punctuation after a letter starts a stretch of its own, for marks where no piece differs.
        marks = "".join(c for c in string.punctuation if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in long if c in p))
        words = rf"{SPACE_MARK}*[^\W\d_]+(?=[{re.escape(marks)}])|" if marks else ""
        return re.compile(rf"{words}{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")

    def merge(self, stretch: str) -> bytes:
        """Identifiers (32-bit) of one stretch, its space marks already written."""
        symbols: list[str | None] = list(stretch)
        n, cost = len(symbols), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(c, i, pair) for i in range(n - 1) if (c := cost.get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j == n or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue  # one of the two has grown meanwhile
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(joined := pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (c, i, joined))
            if (h := before[i]) >= 0 and (c := cost.get(joined := symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (c, h, joined))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (found := self.ids.get(s)) is not None:
                out.append(found)
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return pack(out)

    def _tables(self) -> None:
        """Arrays for ``merge_many``: every two symbols that join to a piece, by their ids."""
        self.of_char = np.full(0x110000, -1, np.int32)
        keys, costs, joined = [], [], []
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    costs.append(self.cost[piece])
                    joined.append(i)
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.costs, self.joined = np.array(costs)[order], np.array(joined, np.int64)[order]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of joining two symbols (infinite: no piece) and the joined symbol."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.costs[at], np.inf), self.joined[at]

    def merge_many(self, stretches: list[str]) -> list[bytes]:
        """``merge`` for many short stretches of known characters.

        The agendas of all stretches lie side by side in arrays. Each round takes the top
        of every agenda, joins that pair and renews the entries of its two neighbours.
        """
        lengths = np.array([len(s) for s in stretches], np.int64)
        symbol = self.of_char[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(stretches)), lengths)
        out = [b""] * len(stretches)

        def entries(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Agenda entries of the symbols at ``at`` with what follows in their stretch."""
            after = np.minimum(at + 1, len(symbol) - 1)
            cost, joined = self.pairs(symbol[at], symbol[after])
            return np.where((after > at) & (owner[after] == owner[at]), cost, np.inf), joined

        cost, joined = entries(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            top = np.minimum.reduceat(cost, first)
            sizes = np.diff(np.append(first, len(symbol)))
            if not np.isfinite(top).all():
                done = np.repeat(~np.isfinite(top), sizes)
                ends = (4 * np.cumsum(sizes[~np.isfinite(top)])).tolist()
                values, start = symbol[done].astype(np.int32).tobytes(), 0
                for who, end in zip(owner[first[~np.isfinite(top)]].tolist(), ends, strict=True):
                    out[who] = values[start:end]
                    start = end
                symbol, owner, cost, joined = symbol[~done], owner[~done], cost[~done], joined[~done]
                continue
            best = np.flatnonzero(cost == np.repeat(top, sizes))
            best = best[np.concatenate([[True], owner[best[1:]] != owner[best[:-1]]])]  # the leftmost
            symbol[best] = joined[best]
            stays = np.ones(len(symbol), bool)
            stays[best + 1] = False
            best -= np.arange(len(best))  # one symbol goes in every stretch before it
            symbol, owner, cost, joined = symbol[stays], owner[stays], cost[stays], joined[stays]
            for at in (best, best[best > 0] - 1):
                cost[at], joined[at] = entries(at)
        return out

    def learn(self, stretches: set[str]) -> int:
        """Encode new stretches and check them against the library; disagreements found."""
        fresh = []
        for s in stretches:
            if (found := self.older.get(s)) is not None:
                self.known[s] = found
            else:
                fresh.append(s)
        usual = re.compile(f"{SPACE_MARK}[^{SPACE_MARK}\n]{{1,{SHORT}}}").fullmatch
        short, rare = [], []
        for s in fresh:
            (short if usual(s) else rare).append(s)
        codes = np.frombuffer("".join(short).encode("utf-32-le"), np.uint32)
        if (self.of_char[codes] < 0).any():
            strange = [not all(self.of_char[ord(c)] >= 0 for c in s) for s in short]
            rare += [s for s, odd in zip(short, strange, strict=True) if odd]
            short = [s for s, odd in zip(short, strange, strict=True) if not odd]
        mine = [ids for start in range(0, len(short), MANY) for ids in self.merge_many(short[start : start + MANY])]
        mine += map(self.merge, rare)
        # The library writes a space mark of its own before each text: a stretch that has
        # one is handed over without it, another is led in by a line end where cuts allow.
        lead = len(self.library.encode("\n"))
        texts = [s[1:] if s[0] == SPACE_MARK else "\n" + s for s in chain(short, rare)]
        theirs = self.library.encode(texts, num_threads=1)
        wrong = 0
        for s, ids, checked in zip(chain(short, rare), mine, theirs, strict=True):
            if s[0] != SPACE_MARK:
                checked = checked[lead:]
            if ids != pack(checked) and s != SPACE_MARK:  # the mark alone: the library adds none to an empty text
                wrong += 1
                ids = pack(checked)
            self.known[s] = ids
        return wrong

    def encode(self, texts: list[str]) -> tuple[list[bytes], int]:
        """32-bit identifiers of each text with an end identifier, and disagreements met."""
        cut = [self.stretches.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) if t else [] for t in texts]
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        wrong = self.learn(set().union(*cut).difference(self.known))
        end = pack([self.end])
        return [b"".join(map(self.known.__getitem__, stretches)) + end for stretches in cut], wrong


def piece_model(path: str) -> PieceModel:
    return resident(("pieces", path), lambda: PieceModel(path))


#: Characters handed to the model at a time.
BATCH_CHARS = 1_000_000


CODED = "struct<ids:array<int>,decoded:string,disagreements:int>"


CODED_TYPE = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("disagreements", pa.int32())])


def coded_part(model: PieceModel, texts: list[str]) -> pa.StructArray:
    """Texts encoded and decoded; the disagreements of all stand on the first row."""
    ids, wrong = model.encode(texts)
    decoded = model.library.decode([np.frombuffer(i, np.int32).tolist() for i in ids], num_threads=1)
    starts = pa.array(offsets(np.array([len(i) // 4 for i in ids], np.int64)), pa.int32())
    lists = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(b"".join(ids), np.int32)))
    counts = [wrong] + [0] * (len(ids) - 1)
    return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string()), pa.array(counts, pa.int32())], fields=list(CODED_TYPE))


def coded(text: str | Column, path: str) -> Column:
    """ids (end id included), decoded text and disagreements with the library, per text."""

    @F.arrow_udf(CODED)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = piece_model(path)
        for batch in batches:
            texts = (t.as_py().decode("utf-8", "replace") if t.is_valid else "" for t in batch)
            done = [coded_part(model, part) for part in bounded(texts, BATCH_CHARS)]
            yield pa.concat_arrays(done) if done else pa.array([], CODED_TYPE)

    return code(utf8(text)).alias("coded")


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded, disagreements of every row, encoded with an end identifier.

    Null and empty texts give the end identifier alone and decode to an empty text;
    repeated rows and null ids stay as they are; other columns are ignored. No shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), coded(text, path).alias("coded"))
    return rows.select("doc_id", "coded.ids", "coded.decoded", "coded.disagreements")
