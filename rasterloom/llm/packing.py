"""Best-fit packing of documents into training sequences of several permitted lengths.

``best_fit_packing`` plans: a document takes as many positions as its column ``length`` says, or one for
each word and one for its end. ``packed_sequences`` packs tokens: a document is its SentencePiece ids with
begin and end, and the result are the sequences themselves. Documents longer than the largest
permitted length are cut into pieces of it. Pieces are dealt by a hash of their place
into groups of about ``group_pieces``; a group is packed by itself, so work is spread evenly
whatever the sources, and only a group's last bins are worse than those of one global packing.

In a group, pieces come in order of falling length. A piece goes into the open bin that it
leaves with the least room. Where none has room, a bin is opened: of the permitted lengths that
hold the piece, the one whose cost is least for the positions that it can be filled with, given
what remains to be packed. At the end every bin is downsized to the cheapest permitted length
that holds its contents. The lengths are chosen jointly: a group is packed once with all
permitted lengths, once without opening the least, and so on, and the cheapest packing is kept.

Best fit is by group: a piece isn't compared with other groups' bins.

Edge cases: null and empty texts have no words and take one position, or two tokens; a null or
negative ``length`` counts as 0 and gives no piece. Null ``doc_id``s and repeated rows are packed as they
come, each row once; ties in length are broken by ``doc_id`` (nulls last), text and piece. Extra
columns are ignored; an empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, flat_list, materialize, tidy
from .sentencepiece_codec import codec
from .shingles import words_of

_PIECES = "doc_id long, text_key long, n_tokens long, piece int, start long, length int"
_ORDER = [("length", "descending"), ("doc_id", "ascending"), ("text_key", "ascending"), ("piece", "ascending")]
_TEXT_AT_ONCE = 4 << 20
_PACKED = "doc_id long, piece int, start long, length int, bin_group int, bin int, capacity int, position int"


def default_cost(capacity: int) -> float:
    """Positions to be computed, attention among them, and a fixed share for each sequence."""
    return capacity + capacity * capacity / 8192 + 16.0


class Packer:
    """Bins of one group; none is opened with less than ``least`` positions."""

    def __init__(self, capacities: tuple[int, ...], cost: Callable[[int], float], least: int):
        self.capacities = tuple(sorted(set(capacities)))
        self.cost = {c: cost(c) for c in self.capacities}
        self.least = least
        self.room_of: list[int] = []
        self.size_of: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(self.capacities[-1] + 1)]
        self.rooms = 0  # bit r: some bin has room r

    def _put(self, at: int, room: int) -> None:
        self.by_room[room].append(at)
        self.rooms |= 1 << room

    def add(self, length: int, remaining: int) -> tuple[int, int]:
        """Place a piece; ``remaining`` positions, its own included, are yet to be packed. (bin, position in it)."""
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = self.by_room[room]
            at = own.pop()
            if not own:
                self.rooms &= ~(1 << room)
        else:
            room = min((c for c in self.capacities if c >= max(length, self.least)), key=lambda c: (self.cost[c] / min(c, remaining), c))
            at = len(self.size_of)
            self.size_of.append(room)
            self.room_of.append(room)
        position = self.size_of[at] - room
        self.room_of[at] = room - length
        if room > length:
            self._put(at, room - length)
        return at, position

    def downsized(self) -> list[int]:
        """The cheapest permitted length that holds each bin's contents."""
        return [min((c for c in self.capacities if c >= size - room), key=lambda c: (self.cost[c], c)) for size, room in zip(self.size_of, self.room_of, strict=True)]


def pack(lengths: np.ndarray, capacities: tuple[int, ...], cost: Callable[[int], float] = default_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, its final capacity and the position in it of each length; lengths must fall."""
    best = None
    for least in sorted(set(capacities)):
        packer, left, places = Packer(capacities, cost, least), int(lengths.sum()), []
        for length in lengths.tolist():
            places.append(packer.add(length, left))
            left -= length
        sizes = packer.downsized()
        total = sum(packer.cost[c] for c in sizes)
        if best is None or total < best[0]:
            best = total, places, sizes
    _, places, sizes = best
    bins, positions = np.array(places, np.int32).reshape(-1, 2).T
    return bins, np.array(sizes, np.int32)[bins], positions


def _key(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1


def _spread(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of each piece of documents of some sizes."""
    count = -(-sizes // longest)
    row = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * longest
    return row, piece.astype(np.int32), start, np.minimum(longest, sizes[row] - start).astype(np.int32)


def _cut(longest: int, given: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            texts = texts.to_pylist()
            if given:
                sizes = np.maximum(columns(batch, "length")[0].fill_null(0).to_numpy(zero_copy_only=False), 0)
            else:
                sizes = np.array([len(words_of(t)) + 1 for t in texts], np.int64)
            keys = np.array([_key(t) for t in texts], np.int64)
            row, piece, start, length = _spread(sizes, longest)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(keys[row]), pa.array(sizes[row]), pa.array(piece), pa.array(start), pa.array(length)], [f.split()[0] for f in _PIECES.split(", ")])

    return cut


_TOKENS = "doc_id long, text_key long, piece int, start long, length int, ids array<int>"
_SEQUENCES = "bin_group int, bin int, capacity int, ids array<int>, doc_ids array<long>, pieces array<int>, starts array<long>, positions array<int>"


def _tokens(model: str, longest: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of texts' ids; texts are encoded some megabytes at once."""
        tidy()
        own = codec(model)
        for batch in batches:
            docs, column = columns(batch, "doc_id", "text")
            texts = [t or "" for t in column.to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and held < _TEXT_AT_ONCE:
                    held += len(texts[end])
                    end += 1
                raw = own.encode_many(texts[at:end])
                row, piece, start, length = _spread(np.array([len(x) // 4 for x in raw], np.int64), longest)
                keys = np.array([_key(t) for t in texts[at:end]], np.int64)
                ids = flat_list(np.frombuffer(b"".join(raw), "<i4"), length, pa.int32())
                yield pa.RecordBatch.from_arrays([docs.slice(at, end - at).take(pa.array(row)), pa.array(keys[row]), pa.array(piece), pa.array(start), pa.array(length), ids], [f.split()[0] for f in _TOKENS.split(", ")])
                at = end
        own.forget()  # the worker process goes on to other stages

    return tokens


def _fill_group(capacities: tuple[int, ...], cost: Callable[[int], float]):
    def fill_group(group: pa.Table) -> pa.Table:
        tidy()
        group = group.combine_chunks().sort_by(_ORDER)
        bins, capacity, position = pack(group.column("length").to_numpy(), capacities, cost)
        order = np.lexsort((position, bins))
        group, bins, capacity, position = group.take(pa.array(order)), bins[order], capacity[order], position[order]
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        pieces = np.diff(np.append(first, len(bins)))
        tokens = np.add.reduceat(group.column("length").to_numpy().astype(np.int64), first) if len(first) else pieces
        ids = group.column("ids").combine_chunks().flatten()
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets(pieces), x) for x in (*(group.column(c).combine_chunks() for c in ("doc_id", "piece", "start")), pa.array(position, pa.int32()))]
        columns = [group.column("bin_group").combine_chunks().take(pa.array(first)), pa.array(bins[first], pa.int32()), pa.array(capacity[first], pa.int32()), pa.ListArray.from_arrays(offsets(tokens), ids), *lists]
        return pa.Table.from_arrays(columns, [f.split()[0] for f in _SEQUENCES.split(", ")])

    return fill_group


def _pack_group(capacities: tuple[int, ...], cost: Callable[[int], float]):
    def pack_group(group: pa.Table) -> pa.Table:
        group = group.sort_by(_ORDER)
        bins, capacity, position = pack(group.column("length").to_numpy(), capacities, cost)
        return group.select(["doc_id", "piece", "start", "length", "bin_group"]).append_column("bin", pa.array(bins, pa.int32())).append_column("capacity", pa.array(capacity, pa.int32())).append_column("position", pa.array(position, pa.int32()))

    return pack_group


def _dealt(pieces: DataFrame, group_pieces: int) -> DataFrame:
    groups = max(1, -(-pieces.count() // group_pieces))
    return pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "text_key", "piece"), F.lit(groups)).cast("int"))


def best_fit_packing(docs: DataFrame, *, length: Column | None = None, capacities: tuple[int, ...] = (512, 1024, 2048), cost: Callable[[int], float] = default_cost, group_pieces: int = 20_000) -> DataFrame:
    """One row for each piece of each row of ``docs``.

    doc_id, piece (from 0), start (first of its document's positions), length, bin_group and bin
    (together the sequence), capacity (the sequence's final length), position (in the sequence).
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if length is None else [length.cast("long").alias("length")]))
    pieces = materialize(own.mapInArrow(_cut(max(capacities), length is not None), _PIECES), "pieces")
    return _dealt(pieces, group_pieces).groupBy("bin_group").applyInArrow(_pack_group(tuple(capacities), cost), _PACKED)


def packed_sequences(docs: DataFrame, model: str, *, capacities: tuple[int, ...] = (512, 1024, 2048), cost: Callable[[int], float] = default_cost, group_pieces: int = 4096) -> DataFrame:
    """One row for each training sequence of the tokens of ``docs``.

    bin_group and bin (together the sequence's name), capacity (its permitted length, the rest of which
    is left empty), ids, and for each piece in it doc_id, number, first of its document's tokens, and place.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(own.mapInArrow(_tokens(model, max(capacities)), _TOKENS), "token-pieces")
    return _dealt(pieces, group_pieces).groupBy("bin_group").applyInArrow(_fill_group(tuple(capacities), cost), _SEQUENCES)
