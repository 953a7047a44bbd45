"""Exact Jaccard similarity classes of word-shingle sets by a parity-sketch join.

Sketch. Each shingle flips one bit of a bit sketch (XOR), so the Hamming distance of two
sketches never exceeds the symmetric difference of the sets. For sets of sizes a and b with a
similarity of at least t, the symmetric difference is at most ``(a + b)(1 - t)/(1 + t)``.

Pigeonhole. Sizes fall into bands ``[2**k, 2**(k+1))``. In a band the sketch is cut into p
pieces, and at most ``d`` (the bound above) of them differ, so at least ``p - d`` are equal. Two
documents with p pieces each and that many in common share one of their first ``d + 1`` pieces
in any order of all pieces. The order used puts pieces with rare and many bits first, so that
empty pieces and pieces of a common passage are hardly ever used; any order gives the same
result. A document whose possible larger partners reach the next band is entered there too.
The sketch has ``2**64`` bits and is kept sparsely; a piece's signature is the XOR of its
positions' hashes.

Verification. Pieces that several documents share make buckets. Equal sets are one node, the first
of them, and only such nodes are compared. A first round verifies each node against the leader of
the bucket kind it shares most, which links most of what belongs together with one comparison a
node. Further rounds take the buckets that still hold several components. There, nodes outside the
bucket's largest component visit all of its nodes, dealt in blocks of a bounded size, and folded
sketches are compared as matrices. Of the pairs whose Hamming distance allows a link, each component
of a block sends its nearest few to be verified on the shingle sets; what links leaves no more to
do inside a component. A bucket that held pairs back comes again in the next round and sends eight
times as many; one that held none back is done. So a pair across components is never skipped, and
large groups of near copies grow together without all their pairs.

Scratch tables are deleted as soon as they have been read for the last time. A text is read twice,
and shuffled once, where its set is needed for verification; sets never come to the driver.

Edge cases: a null or blank text has no shingles and its own class. Null ``doc_id``s take part;
a class is named by its least non-null id. Rows repeated with one ``doc_id`` are separate
documents. Extra columns are ignored by ``similar_classes`` and kept by ``keep_one_of_each``.
An empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, flat_list, materialize, mix, tidy, with_keys, without
from .components import components
from .shingles import WordHashes, shingle_runs, shingle_set, words_of

_SLOT_BITS = 22
_SLOTS = 1 << _SLOT_BITS
_SLOT_SHIFT = np.uint64(64 - _SLOT_BITS)
_BLOCK = 512  # nodes of a bucket that are compared at once
_VISITORS = 1024  # and others that visit them
_PAIRS = 1 << 20
_TEXTS = 2000  # of an Arrow batch
_EMPTY = np.uint64(0xA24BAED4963EE407)


class Threshold:
    """Similarity ``num/den`` in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def difference(self, total: int) -> int:
        """The largest symmetric difference of two sets of ``total`` elements together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def partner(self, size: int) -> int:
        """The largest size that a partner of a set of ``size`` can have."""
        return size * self.den // self.num

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both) and both > 0


def _pieces(shingles: np.ndarray, band: int, heavy: np.ndarray, limit: Threshold) -> np.ndarray:
    """The signatures of the pieces by which a document is entered in a band."""
    size, high = len(shingles), (1 << (band + 1)) - 1
    most = limit.difference(2 * high) + 1
    p = most + most // 2 + 1
    take = limit.difference(size + min(high, limit.partner(size))) + 1
    piece = (((shingles >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)).astype(np.int64)  # rises: shingles are sorted
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    bits = np.diff(np.append(starts, size))
    value = mix(np.bitwise_xor.reduceat(mix(shingles), starts) + np.uint64(band))
    rare = np.minimum.reduceat(heavy[(shingles >> _SLOT_SHIFT).astype(np.int64)], starts)
    rank = np.lexsort((value, -bits, rare))[:take]
    out = value[rank]
    if len(out) < take:  # all filled pieces are in; the empty ones follow
        empty = np.setdiff1d(np.arange(p), piece[starts])[: take - len(out)]
        out = np.concatenate([out, mix(_EMPTY + (empty.astype(np.uint64) << np.uint64(8)) + np.uint64(band))])
    return out


def _folded(shingles: np.ndarray, band: int) -> bytes:
    """The sketch folded to 4 bits for each element of the band's least size."""
    bits = 1 << max(6, band + 2)
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _heavy_slots(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slots of the hashed shingles that are far more used than the mean, in this task."""
        tidy()
        total, hashes = np.zeros(_SLOTS, np.int64), WordHashes()
        for batch in batches:
            parts = []
            for text in batch.column(0).to_pylist():
                parts.append(shingle_runs(words_of(text), hashes, width) >> _SLOT_SHIFT)
                hashes.trim()
            if parts:
                total += np.bincount(np.concatenate(parts).astype(np.int64), minlength=_SLOTS)
        at = np.flatnonzero(total > 2 * total.mean() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    return count


def _heavy(texts: DataFrame, width: int) -> np.ndarray:
    """For each slot of hashed shingles a byte that rises with its use; 0 for those used like most.

    Its size is fixed. It only orders pieces, so leaving slots out costs candidates, never a link.
    """
    slots = materialize(texts.mapInArrow(_heavy_slots(width), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots", batch=_TEXTS)
    total = slots.agg(F.sum("n")).first()[0] or 0
    used = slots.filter(F.col("n") > 4 * total / _SLOTS).select("slot", F.ceil(F.log2(F.col("n") + 1)).cast("tinyint").alias("level")).toArrow()
    discard(slots)
    heavy = np.zeros(_SLOTS, np.uint8)
    heavy[used["slot"].to_numpy()] = used["level"].to_numpy()
    return heavy


_SKETCHED = "uid long, doc_id long, key1 long, key2 long, n_shingles int, set_key binary, folded binary, pieces array<long>"


def _sketch(width: int, heavy, limit: Threshold):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        uid, hashes, seen = TaskContext.get().partitionId() << 33, WordHashes(), set()
        used: np.ndarray = heavy.value
        for batch in batches:
            ids, key1, key2, texts = columns(batch, "doc_id", "key1", "key2", "text")
            sizes, keys, folds, parts, lengths = [], [], [], [], []
            for text in texts.to_pylist():
                own = shingle_set(words_of(text), hashes, width)
                hashes.trim()
                key = xxhash.xxh3_128_digest(own) if len(own) else None
                sizes.append(len(own))
                keys.append(key)
                if not len(own) or key in seen:  # copies within the task need no pieces of their own
                    lengths.append(0)
                    folds.append(None)
                    continue
                seen.add(key)
                band = len(own).bit_length() - 1
                got = [_pieces(own, band, used, limit)]
                if limit.partner(len(own)) >= 2 << band:
                    got.append(_pieces(own, band + 1, used, limit))
                parts += got
                lengths.append(sum(map(len, got)))
                folds.append(_folded(own, band))
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), ids, key1, key2, pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(folds, pa.binary()), flat_list(flat, lengths, pa.int64())], [f.split()[0] for f in _SKETCHED.split(", ")])
            uid += n

    return sketch


_SHARED = "piece long, uid long, n int, leader long, leader_n int, members long"


def _shared_batch(piece, uid, n, leader, leader_n, members) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
    values = (pa.array(v, t) if v is not None else pa.nulls(len(piece), t) for v, t in zip((piece, uid, n, leader, leader_n, members), kinds, strict=True))
    return pa.RecordBatch.from_arrays(list(values), [f.split()[0] for f in _SHARED.split(", ")])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (piece, uid, n), sorted: the buckets, which are the pieces with several rows.

    A bucket gives its rows, each with the bucket's first row as its leader, and at its end one
    row without uid that has the number of rows in ``n`` and a digest of them in ``members``. Rows
    are passed on as they come, so a bucket may be of any size.
    """
    tail = leader = None  # the last row, not yet emitted; the first row of its run
    digest, count = np.uint64(0), 0  # of the run's rows before the tail
    for batch in batches:
        piece, uid, n = (x.to_numpy() for x in columns(batch, "piece", "uid", "n"))
        if not len(piece):
            continue
        if tail is None:
            leader = piece[0], uid[0], n[0]
        else:
            piece, uid, n = (np.concatenate([[t], x]) for t, x in zip(tail, (piece, uid, n), strict=True))
        new = np.ones(len(piece), bool)
        new[1:] = piece[1:] != piece[:-1]
        starts = np.flatnonzero(new)
        first = np.repeat(starts, np.diff(np.append(starts, len(piece))))
        lead, lead_n = uid[first], n[first]
        lead[first == 0], lead_n[first == 0] = leader[1], leader[2]
        hashed = mix(uid.view(np.uint64))
        digests, counts = np.bitwise_xor.reduceat(hashed, starts), np.diff(np.append(starts, len(piece)))
        digests[0] ^= digest
        counts[0] += count
        several = np.repeat(counts > 1, np.diff(np.append(starts, len(piece))))[:-1]
        yield _shared_batch(*(x[:-1][several] for x in (piece, uid, n, lead, lead_n)), None)
        done = np.flatnonzero(counts[:-1] > 1)
        yield _shared_batch(piece[starts[done]], None, np.minimum(counts[done], 1 << 30), lead[starts[done]], None, digests[done].view(np.int64))
        tail, leader = (piece[-1], uid[-1], n[-1]), (piece[-1], lead[-1], lead_n[-1])
        digest, count = digests[-1] ^ hashed[-1], int(counts[-1]) - 1
    if tail is not None and count:
        one = [np.array([x]) for x in (*tail, *leader[1:])]
        yield _shared_batch(*one, None)
        digest ^= mix(one[1].view(np.uint64))[0]
        yield _shared_batch(one[0], None, [min(count + 1, 1 << 30)], one[3], None, np.array([digest]).view(np.int64))


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingle sets of rows (uid, text); a row that is there again under the same uid is left out."""
        tidy()
        hashes, done = WordHashes(), set()
        for batch in batches:
            uid, text = columns(batch, "uid", "text")
            ids, out = [], []
            for u, t in zip(uid.to_pylist(), text.to_pylist(), strict=True):
                if u not in done:
                    done.add(u)
                    ids.append(u)
                    out.append(shingle_set(words_of(t), hashes, width).tobytes())
            hashes.trim()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["uid", "shingles"])

    return sets


def _verify(limit: Threshold):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, salt, b, shingles) sorted so that a's own set (b null) precedes its partners'."""
        owner, own = None, None
        for batch in batches:
            a, b, shingles = columns(batch, "a", "b", "shingles")
            left, right = [], []
            for x, y, raw in zip(a.to_pylist(), b.to_pylist(), shingles, strict=True):
                got = np.frombuffer(raw.as_buffer(), np.uint64)
                if y is None:
                    owner, own = x, got
                    continue
                if x != owner:
                    raise ValueError("a pair without the first one's set")
                small, large = (got, own) if len(got) < len(own) else (own, got)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                if limit.linked(int(np.count_nonzero(large[at] == small)), len(own), len(got)):
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return verify


class _Sets:
    """Shingle sets of the nodes asked for so far; texts are read again only for others."""

    def __init__(self, docs: DataFrame, sketched: DataFrame, width: int):
        self._docs, self._sketched, self._width = docs, sketched, width
        self._parts: list[DataFrame] = []

    def of(self, pairs: DataFrame) -> DataFrame:
        """The sets, those of ``pairs(a, b)`` among them."""
        wanted = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
        for part in self._parts:
            wanted = wanted.join(part.select("uid"), "uid", "left_anti")
        keyed = materialize(self._sketched.join(wanted, "uid", "left_semi").select("uid", "key1", "key2"), "wanted")
        if not keyed.isEmpty():
            found = self._docs.select("key1", "key2", "text").join(keyed.hint("shuffle_hash"), ["key1", "key2"]).select("uid", "text")
            self._parts.append(materialize(found.mapInArrow(_sets(self._width), "uid long, shingles binary"), "sets", batch=_TEXTS))
        discard(keyed)
        out = self._parts[0]
        for part in self._parts[1:]:
            out = out.union(part)
        return out

    def discard(self) -> None:
        discard(*self._parts)


def _links(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough; a hub's partners are dealt out by salt."""
    degree = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("salts")), "degrees")
    hubs = degree.join(sets, degree["a"] == sets["uid"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    members = pairs.join(degree, "a").join(sets, F.col("b") == F.col("uid")).select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b", "shingles")
    dealt = hubs.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    links = materialize(dealt.mapInArrow(_verify(limit), "a long, b long"), "links")
    discard(degree)
    return links


class _Sketches:
    """The folded sketches of some rows, as one matrix for each width."""

    def __init__(self, folded: pa.Array):
        self.width = pc.binary_length(folded).to_numpy(zero_copy_only=False).astype(np.int64)
        self.place = np.zeros(len(self.width), np.int64)
        self._own: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self._own[w] = np.frombuffer(b"".join(folded.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, w)

    def _rows(self, width: int, to: int, at: np.ndarray) -> np.ndarray:
        rows = self._own[width][self.place[at]]
        while rows.shape[1] > to:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        return rows

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Hamming distances of the sketches of rows ``x`` and ``y``, the wider folded to the narrower."""
        out = np.zeros(len(x), np.int64)
        kinds = self.width[x] << 32 | self.width[y]
        for kind in np.unique(kinds).tolist():
            w, v = kind >> 32, kind & 0xFFFFFFFF
            to = min(w, v)
            at = np.flatnonzero(kinds == kind)
            step = max(1, (1 << 23) // max(w, v))
            for k in range(0, len(at), step):
                own = at[k : k + step]
                differ = self._rows(w, to, x[own]) ^ self._rows(v, to, y[own])
                out[own] = np.bitwise_count(differ.view(np.uint64)).sum(axis=1)
        return out


_NEAR = "a long, b long, held long"


def _near(limit: Threshold, most: int):
    over, under = limit.den - limit.num, limit.den + limit.num

    def compared(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The near pairs of whole runs: of each visitor with the nodes of its run from other components.

        At most ``most`` for each component and run, the nearest; ``held`` names the pieces that hold back others.
        """
        piece, block, group, n, uid, component, main, visits, stays = (x.to_numpy(zero_copy_only=False) for x in columns(rows, "piece", "i", "j", "n", "uid", "component", "main", "visits", "stays"))
        n = n.astype(np.int64)
        new = (np.diff(piece, prepend=piece[0] ^ 1) != 0) | (np.diff(block, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0)
        run = np.cumsum(new) - 1
        sketches = _Sketches(columns(rows, "folded")[0])
        home, guest = np.flatnonzero(stays), np.flatnonzero(visits)
        homes = np.bincount(run[home], minlength=run[-1] + 1)
        first = np.cumsum(homes) - homes
        pairs = homes[run[guest]]
        parts = np.cumsum(pairs) // _PAIRS
        for part in np.unique(parts):
            own = guest[parts == part]
            count = homes[run[own]]
            x = np.repeat(own, count)
            y = home[np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[run[own]], count)]
            once = (component[y] == main[y]) | (uid[x] < uid[y])  # two visitors meet twice
            good = once & (component[x] != component[y]) & (limit.den * np.minimum(n[x], n[y]) >= limit.num * np.maximum(n[x], n[y]))
            x, y = x[good], y[good]
            apart = sketches.apart(x, y)
            good = apart * under <= (n[x] + n[y]) * over
            x, y, apart = x[good], y[good], apart[good]
            if not len(x):
                continue
            pair = np.tile(np.arange(len(x)), 2)
            side = np.concatenate([component[x], component[y]])
            order = np.lexsort((uid[y][pair], uid[x][pair], (apart / (n[x] + n[y]))[pair], side, run[x][pair]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (side[order][1:] != side[order][:-1]) | (run[x][pair][order][1:] != run[x][pair][order][:-1])
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            sent = np.zeros(len(x), bool)
            sent[pair[order][place < most]] = True
            held = np.unique(piece[x[~sent]])
            a, b = np.minimum(uid[x], uid[y])[sent], np.maximum(uid[x], uid[y])[sent]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "held"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()), pa.array(held)], ["a", "b", "held"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows sorted by (piece, i, j); the last run of a batch waits for the next."""
        tidy()
        waiting: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([x.to_numpy().astype(np.int64) for x in columns(batch, "piece", "i", "j")], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if waiting and (keys[0] != key).any():
                yield from compared(pa.concat_batches(waiting))
                waiting = []
            if len(cut):
                yield from compared(pa.concat_batches([*waiting, batch.slice(0, int(cut[-1]) + 1)]))
                waiting, batch = [], batch.slice(int(cut[-1]) + 1)
            waiting.append(batch)
            key = keys[-1]
        if waiting:
            yield from compared(pa.concat_batches(waiting))

    return near


def _met(members: DataFrame, owner: DataFrame, folded: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, dealt so that every visitor meets every node.

    ``i`` numbers the blocks of a bucket's nodes, ``j`` the groups of its visitors. In a bucket of one
    block and one group a row has both parts.
    """
    placed = members.join(owner, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    parts = placed.groupBy("piece", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = parts.groupBy("piece").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.max_by("component", F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    mixed = materialize(mixed.select("piece", "main", F.ceil(F.col("rows") / _BLOCK).cast("int").alias("blocks"), F.ceil((F.col("rows") - F.col("most")) / _VISITORS).cast("int").alias("groups")), "mixed")
    rows = materialize(placed.join(mixed, "piece").join(folded, "uid"), "open-buckets")
    discard(mixed)
    block, group = F.pmod(F.xxhash64("uid"), "blocks").cast("int"), F.pmod(F.xxhash64("uid", F.lit(1)), "groups").cast("int")
    at = lambda i, j, visits, stays: F.struct(i.alias("i"), j.alias("j"), visits.alias("visits"), stays.alias("stays"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    strange, yes, no = F.col("component") != F.col("main"), F.lit(True), F.lit(False)
    stay = F.transform(each(F.col("groups")), lambda j: at(block, j, no, yes))
    visit = F.when(strange, F.transform(each(F.col("blocks")), lambda i: at(i, group, yes, no))).otherwise(F.slice(F.array(at(block, group, no, no)), 1, 0))
    places = F.when((F.col("blocks") == 1) & (F.col("groups") == 1), F.array(at(F.lit(0), F.lit(0), strange, yes))).otherwise(F.concat(stay, visit))
    return rows, rows.withColumn("at", F.explode(places)).select("piece", "at.*", "n", "uid", "component", "main", "folded")


def _classes(docs: DataFrame, width: int, limit: Threshold) -> DataFrame:
    """A table ``uid, doc_id, key1, key2, n_shingles, component``: a row's class, null for rows linked with nothing.

    ``docs``: doc_id, text and two keys of both.
    """
    spark = docs.sparkSession
    heavy = spark.sparkContext.broadcast(_heavy(docs.select("text"), width))
    wide = materialize(docs.mapInArrow(_sketch(width, heavy, limit), _SKETCHED), "sketches", batch=_TEXTS)
    heavy.unpersist()
    entered = wide.select(F.explode("pieces").alias("piece"), "uid", F.col("n_shingles").alias("n")).repartition("piece").sortWithinPartitions("piece", "uid")
    buckets = materialize(entered.mapInArrow(_shared, _SHARED), "buckets")
    sketched = materialize(wide.drop("pieces"), "documents")
    discard(wide)

    # Equal sets: the first row stands for all.
    same = materialize(sketched.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("set_key", "node"), "equal-sets")
    copies = materialize(sketched.select("uid", "set_key").join(same, "set_key").select("uid", "node"), "copies")
    discard(same)
    node_of = copies.filter("uid <> node")

    # The first round: everything with the leader that it shares most pieces with.
    shared = buckets.filter("uid IS NOT NULL").drop("members")
    fits = limit.den * F.least("n", "leader_n") >= limit.num * F.greatest("n", "leader_n")
    led = shared.filter((F.col("uid") != F.col("leader")) & fits).groupBy("uid", "leader").agg(F.count(F.lit(1)).alias("times"))
    led = led.groupBy("uid").agg(F.max(F.struct("times", (-F.col("leader")).alias("l"))).alias("x")).select(F.col("uid").alias("b"), (-F.col("x.l")).alias("a"))
    for end in ("a", "b"):
        led = led.join(node_of.select(F.col("uid").alias(end), "node"), end, "left").withColumn(end, F.coalesce("node", end)).drop("node")
    first = materialize(led.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first-pairs")

    # Buckets with the same members are one; of a bucket's equal sets one is enough.
    whole = buckets.filter("uid IS NULL").groupBy("members", "n", "leader").agg(F.min("piece").alias("piece")).select("piece")
    members = shared.select("piece", "uid", "n").join(materialize(whole, "whole"), "piece").join(node_of, "uid", "left")
    members = materialize(members.select("piece", F.coalesce("node", "uid").alias("uid"), "n").distinct(), "members")
    discard(buckets)

    sets = _Sets(docs, sketched, width)
    tested, most = [first], 1
    edges = [] if first.isEmpty() else [_links(first, sets.of(first), limit)]
    classes = _grown(spark, edges)
    folded = sketched.select("uid", "folded").filter("folded IS NOT NULL")
    while True:
        rows, met = _met(members, classes.select(F.col("node").alias("uid"), "component"), folded)
        near = materialize(met.repartition("piece", "i", "j").sortWithinPartitions("piece", "i", "j").mapInArrow(_near(limit, most), _NEAR).distinct(), "near-pairs")
        discard(rows)
        more = near.filter("held IS NULL").select("a", "b")
        for pairs in tested:
            more = more.join(pairs, ["a", "b"], "left_anti")
        more = materialize(more, "more-pairs")
        held = materialize(near.filter("held IS NOT NULL").select(F.col("held").alias("piece")), "held")
        if not more.isEmpty():
            tested.append(more)
            edges.append(_links(more, sets.of(more), limit))
            if not edges[-1].isEmpty():
                discard(classes)
                classes = _grown(spark, edges)
        again = None if held.isEmpty() else materialize(members.join(held, "piece", "left_semi"), "members")
        discard(near, held, members)
        if again is None:
            break
        members, most = again, most * 8
    sets.discard()
    discard(*tested, *edges)

    named = classes.select("node", "component")
    linked = copies.join(named, "node", "left").select("uid", F.coalesce("component", "node").alias("component"))
    linked = linked.union(named.join(copies.select(F.col("uid").alias("node")), "node", "left_anti").select("node", "component"))
    rows = materialize(sketched.select("uid", "doc_id", "key1", "key2", "n_shingles").join(linked, "uid", "left"), "class-rows")
    discard(sketched, copies, classes)
    return rows


def _grown(spark, edges: list[DataFrame]) -> DataFrame:
    found = spark.createDataFrame([], "a long, b long")
    for part in edges:
        found = found.union(part)
    return components(found)


def _keyed(docs: DataFrame) -> DataFrame:
    return with_keys(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")).select("row.doc_id", "row.text", "key1", "key2")


def similar_classes(docs: DataFrame, *, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    ``width`` words make a shingle; ``similarity`` is a fraction (of at least a half).
    """
    rows = _classes(_keyed(docs), width, Threshold(*similarity))
    size = F.col("n_shingles").cast("long").alias("n_shingles")
    linked = rows.filter("component IS NOT NULL")
    names = materialize(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "class-names")
    alone = rows.filter("component IS NULL").select("doc_id", size, F.col("doc_id").alias("component_id"))
    return linked.join(names, "component").select("doc_id", size, "component_id").union(alone)


def keep_one_of_each(docs: DataFrame, *, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each class of ``docs``, with all its columns: that of the smallest ``doc_id``, nulls last.

    Rows that repeat this id within the class are told apart by a hash of their texts; of equal ones one
    stays. Rows without words stay.
    """
    rows = _classes(_keyed(docs), width, Threshold(*similarity))
    linked = rows.filter("component IS NOT NULL")
    best = materialize(linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key1", "key2")).alias("best")), "class-best")
    kept = (F.col("key1") == F.col("best.key1")) & (F.col("key2") == F.col("best.key2"))
    decided = materialize(linked.join(best, "component").select("key1", "key2", kept.alias("kept")), "class-decided")
    discard(rows, best)
    return without(with_keys(docs), decided)
