"""Substring deduplication by sliding spans of sentences.

Texts are cut into sentences after ``.``, ``!``, ``?`` with white space and at line ends, and
every sentence is cut again after each word whose hash is the least of some ``window`` words in
a row of the sentence. So no unit passes ``window`` words, and a cut depends on fewer than
``window`` words to each side: a passage is cut alike wherever it stands, but for at most
``window`` words at its begin and ``window - 1`` at its end. For every unit two spans are hashed:
the shortest run of units that begins with it, and the shortest that ends with it, of at least
``min_sentences`` units and ``min_words`` words. Inside a repeated passage every unit lies in
such a span, whatever surrounds it. Spans meet globally by the 128-bit hash of their units; in
document order the first occurrence stays, and the units that any other occurrence covers are
removed. Words compare with A-Z in lower case. Units are what ``n_sentences`` counts.

Occurrences that some megabytes of texts in a row already show to be later ones are decided there, so
of a hot span at most one occurrence for each such stretch reaches the global comparison.

Edge cases: null stays null and an empty text empty; both have no sentences. ``doc_id`` gives
the order of documents, nulls last. Rows repeated with one ``doc_id`` and one text are one
document and get equal results; with one ``doc_id`` and several texts they are several
documents. A text whose sentences are all removed becomes empty. Columns beyond ``doc_id`` and
``text`` are ignored by ``span_dedup`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, columns, materialize, mix, tidy

_SPACE, _LINE, _STOP = (np.isin(np.arange(256), list(x)) for x in (SPACE_BYTES, b"\n\x0b\x0c\r", b".!?"))
#: ``at`` is the first unit and the number of units, all bits turned where the batch has an earlier occurrence.
_SPANS = "key1 long, key2 long, doc_id long, text_key long, at long"
_CLEANED = "text string, n_sentences long, n_removed long, removed_bytes long"
_STEPS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)
_NO_ID = (1 << 63) - 1
_PART = 1 << 19  # bytes of texts that are cut at once
_SLICE = 1 << 23  # and whose spans are compared with each other before the shuffle
_ROWS = 1 << 18  # rows of an Arrow batch of spans


@dataclass
class Units:
    """The units of some texts, one text after another.

    ``bounds`` has each text's first unit, and the number of all; ``first`` and ``start`` each unit's
    first word and first byte within its text's; ``hashes`` two a word.
    """

    bounds: np.ndarray
    first: np.ndarray
    start: np.ndarray
    hashes: np.ndarray


def _units(raws: list[bytes], window: int) -> Units:
    """White space belongs to the unit before it, or to a text's first unit; texts without words have none."""
    joined = b"\n".join(raws)
    words = joined.lower().split()
    size = np.array([len(x) + 1 for x in raws], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    n = len(words)
    if not n:
        return Units(np.zeros(len(raws) + 1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64))
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(w) for w in words]), np.uint64).reshape(-1, 2)
    byte = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[byte], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    lines = np.searchsorted(np.flatnonzero(_LINE[byte]), ends)  # line ends before each word's end
    cut = np.ones(n, bool)  # after each word; texts are parted by a line end
    cut[:-1] = _STOP[byte[ends[:-1] - 1]] | (lines[1:] > lines[:-1])
    sentence = np.cumsum(cut) - cut
    if n >= window:
        m = n - window + 1
        least, place = hashes[:m, 0], np.arange(m)
        for k in range(1, window):
            other = hashes[k : k + m, 0]
            place = np.where(other <= least, np.arange(k, k + m), place)
            least = np.minimum(least, other)
        cut[place[sentence[:m] == sentence[window - 1 :]]] = True
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    text = np.searchsorted(begin, starts[first[:-1]], side="right") - 1
    bounds = np.searchsorted(text, np.arange(len(raws) + 1))
    start = starts[first[:-1]] - begin[text]
    start[bounds[:-1][bounds[1:] > bounds[:-1]]] = 0
    return Units(bounds, first, start, hashes)


def sentences(raw: bytes, window: int = 6) -> tuple[list[int], list[int], list[bytes]]:
    """A text's units: where each begins, its number of words and its digest.

    A unit takes the white space after it; the digest is of its words in lower case.
    """
    u = _units([raw], window)
    if not len(u.start):
        return ([0], [0], [xxhash.xxh3_128_digest(b"")]) if raw else ([], [], [])
    own = [xxhash.xxh3_128_digest(u.hashes[a:b].tobytes()) for a, b in zip(u.first, u.first[1:])]
    return u.start.tolist(), np.diff(u.first).tolist(), own


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the steps and of their inverses modulo 2**64."""
    if len(_POWERS[0]) < n:
        inverse = np.array([pow(int(x), -1, 1 << 64) for x in _STEPS], np.uint64)
        for k, x in enumerate((_STEPS, inverse)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones((1, 2), np.uint64), np.broadcast_to(x, (2 * n, 2))]), axis=0)
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS = [np.zeros((0, 2), np.uint64), np.zeros((0, 2), np.uint64)]


def _of_runs(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two hashes of each run of rows of ``hashes``: a polynomial, from sums up to its begin and its end."""
    power, inverse = _powers(len(hashes))
    sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(hashes * inverse, axis=0, dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * power[start])


def spans(u: Units, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes a row, text, first unit, unit after the last) of the shortest runs from and to each unit of its text."""
    n, total = len(u.start), u.first
    text = np.repeat(np.arange(len(u.bounds) - 1), np.diff(u.bounds))
    at = np.arange(n + 1)
    low, high = u.bounds[text], u.bounds[text + 1]
    fore = np.maximum(at + min_sentences, np.searchsorted(total, total + min_words))[:-1]  # least j for each i
    back = np.minimum(at - min_sentences, np.searchsorted(total, total - min_words, side="right") - 1)[1:]  # greatest i for each j
    a, b = fore <= high, back >= low
    run = np.unique(np.concatenate([at[:-1][a] * np.int64(n + 1) + fore[a], back[b] * np.int64(n + 1) + at[1:][b]]))
    i, j = run // (n + 1), run % (n + 1)
    own = text[i]
    return _of_runs(_of_runs(u.hashes, total[:-1], total[1:]), i, j), own, i - u.bounds[own], j - u.bounds[own]


def _parts(raws: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of about ``_PART`` bytes at once; null as empty."""
    at, held, size = 0, [], 0
    for k, raw in enumerate(raws):
        held.append(raw or b"")
        size += len(held[-1])
        if size >= _PART or k + 1 == len(raws):
            yield at, held
            at, held, size = k + 1, [], 0


def _text_key(text: Column) -> Column:
    """63 bits of a hash of the text's bytes; -1 for null."""
    return F.when(text.isNull(), F.lit(-1)).otherwise(F.shiftrightunsigned(F.xxhash64(text.cast("binary")), 1))


def _raws(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def _cuts(texts: pa.Array) -> list[int]:
    """Where slices of about ``_SLICE`` bytes of texts begin, and the number of texts."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return [0, *(np.flatnonzero(np.diff(np.cumsum(size) // _SLICE)) + 1).tolist(), len(size)]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``_SLICE`` bytes of texts, whose spans are held at once."""
    for a, b in pairwise(_cuts(columns(batch, "text")[0])):
        if a < b or not batch.num_rows:
            yield batch.slice(a, b - a)


def _find(window: int, min_sentences: int, min_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All spans; those that the batch itself has earlier are known to be later ones.

        They keep nothing to be compared: their key is set to their document's, so that they
        spread out, and a span costs one comparable row a batch however common it is.
        """
        tidy()
        for batch in chain.from_iterable(map(_slices, batches)):
            ids, texts, keys = columns(batch, "doc_id", "text", "text_key")
            none = np.zeros(0, np.int64)
            parts = [(np.zeros((0, 2), np.uint64), none, none, none)]
            for at, held in _parts(_raws(texts)):
                found = spans(_units(held, window), min_sentences, min_words)
                parts.append((found[0], found[1] + at, *found[2:]))
            hashes, row = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            start, end = (np.concatenate([x[k] for x in parts]).astype(np.int32) for k in (2, 3))
            del parts
            text_key = keys.to_numpy(zero_copy_only=False)[row]
            absent = ids.is_null().to_numpy(zero_copy_only=False)[row]
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)[row]
            key1, key2 = hashes[:, 0].view(np.int64).copy(), hashes[:, 1].view(np.int64).copy()
            order = np.argsort(key1)
            same = np.zeros(len(order) + 1, bool)
            same[1:-1] = key1[order][1:] == key1[order][:-1]
            order = order[same[1:] | same[:-1]]  # only spans of which there are several
            order = order[np.lexsort([x[order] for x in (start, text_key, doc, absent, key2, key1)])]
            again = np.zeros(len(order), bool)
            again[1:] = (key1[order][1:] == key1[order][:-1]) & (key2[order][1:] == key2[order][:-1])
            known = np.zeros(len(row), bool)
            known[order] = again
            # repeated rows of one text are one document: its own first spans stay comparable
            one = known & np.isin(row, _repeated(doc, absent, text_key, row))
            known &= ~one
            key1[known], key2[known] = doc[known], start[known]
            place = start.astype(np.int64) << 31 | (end - start)
            out = pa.RecordBatch.from_arrays([pa.array(key1), pa.array(key2), pa.array(doc, mask=absent), pa.array(text_key), pa.array(np.where(known, ~place, place))], ["key1", "key2", "doc_id", "text_key", "at"])
            for at in range(0, max(1, len(row)), _ROWS):
                yield out.slice(at, _ROWS)

    return find


def _repeated(doc: np.ndarray, absent: np.ndarray, text_key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Rows of a batch whose document is there more than once."""
    at = np.flatnonzero(np.diff(row, prepend=-1))
    names = np.stack([doc[at], absent[at], text_key[at]], axis=1)
    _, back, times = np.unique(names, axis=0, return_inverse=True, return_counts=True)
    return row[at][times[back.ravel()] > 1]


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by span and place: those that aren't of their span's first place."""
    last = None  # the current span and its first place
    for batch in batches:
        key1, key2, known, doc, text_key, at = (x.to_numpy(zero_copy_only=False) for x in columns(batch, "key1", "key2", "known", "at_id", "text_key", "at"))
        if not len(key1):
            continue
        run = np.where(known, ~at, at)
        place = np.stack([key1, key2, known, doc, text_key, run >> 31], axis=1).astype(np.int64)
        if last is not None:
            place = np.concatenate([last[None], place])
        new = np.ones(len(place), bool)
        new[1:] = (place[1:, :3] != place[:-1, :3]).any(axis=1)
        first = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        later = (place[:, 3:] != place[first, 3:]).any(axis=1) | (place[:, 2] == 1)
        if last is not None:
            later = later[1:]
        last = place[first[-1]]
        keep = pa.array(later)
        a = run[later] >> 31
        b = a + (run[later] & (1 << 31) - 1)
        yield pa.RecordBatch.from_arrays([*(x.filter(keep) for x in columns(batch, "doc_id", "text_key")), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "text_key", "a", "b"])


def _cleaned(window: int):
    def cleaned(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """The text without the units in ``ranges``, and the numbers; of some megabytes of texts at once."""
        tidy()
        for texts, ranges in parts:
            done = [_without(window, texts[a:b], ranges[a:b]) for a, b in pairwise(_cuts(texts)) if a < b or not len(texts)]
            yield pa.concat_arrays(done)

    return F.arrow_udf(cleaned, _CLEANED)


def _without(window: int, texts: pa.Array, ranges: pa.Array) -> pa.StructArray:
    out, found = _raws(texts), ranges.to_pylist()
    counts, removed, lost = [], [0] * len(out), [0] * len(out)
    for at, held in _parts(out):
        u = _units(held, window)
        counts += [max(int(n), int(len(x) > 0)) for n, x in zip(np.diff(u.bounds), held, strict=True)]
        for k, raw in enumerate(held, at):
            if not found[k]:
                continue
            start = np.append(u.start[u.bounds[k - at] : u.bounds[k - at + 1]], len(raw))
            gone = np.zeros(len(start) + 1, np.int8)
            for r in found[k]:
                gone[r["a"] + 1 : r["b"] + 1] = 1
            edges = np.diff(gone)  # of the removed stretches
            a, b = start[np.flatnonzero(edges == 1)], start[np.flatnonzero(edges == -1)]
            out[k] = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)]))
            removed[k], lost[k] = int(gone.sum()), int((b - a).sum())
    numbers = [pa.array(x, pa.int64()) for x in (counts, removed, lost)]
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()).view(pa.string()), *numbers], ["text", "n_sentences", "n_removed", "removed_bytes"])


def repeated_ranges(docs: DataFrame, *, min_sentences: int = 2, min_words: int = 20, window: int = 6) -> DataFrame:
    """(doc_id, text_key, ranges): the sentence ranges of each document that repeat an earlier one."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key"))
    found = own.mapInArrow(_find(window, min_sentences, min_words), _SPANS)
    placed = found.repartition("key1").withColumns({"at_id": F.coalesce("doc_id", F.lit(_NO_ID)), "known": F.col("at") < 0}).sortWithinPartitions("key1", "key2", "known", "at_id", "text_key", "at")
    later = placed.mapInArrow(_later, "doc_id long, text_key long, a int, b int")
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def _apply(docs: DataFrame, window: int, **options) -> DataFrame:
    """(row, ranges); ``row`` is the whole row as it was, ``ranges`` null where nothing repeats.

    Rows are kept together as one value, so that no column of theirs can clash with one of ours; they
    have each text once, and don't pass through Python.
    """
    ranges = materialize(repeated_ranges(docs, window=window, **options), "repeats", batch=4000)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs["text"]).alias("text_key"))
    return keyed.join(ranges, keyed["doc_id"].eqNullSafe(ranges["doc_id"]) & (keyed["text_key"] == ranges["text_key"]), "left").select("row", "ranges")


def span_dedup(docs: DataFrame, *, min_sentences: int = 2, min_words: int = 20, window: int = 6) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the cleaned text, n_sentences, n_removed, removed_bytes."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _apply(own, window, min_sentences=min_sentences, min_words=min_words)
    return found.select("row.doc_id", _cleaned(window)("row.text", "ranges").alias("cleaned")).select("doc_id", "cleaned.*")


def remove_repeats(docs: DataFrame, *, min_sentences: int = 2, min_words: int = 20, window: int = 6) -> DataFrame:
    """The rows of ``docs``, all their columns, with repeated sentences removed from ``text``."""
    found = _apply(docs, window, min_sentences=min_sentences, min_words=min_words)
    text = F.col("row")["text"]
    cleaned = _cleaned(window)(F.when(F.col("ranges").isNotNull(), text), "ranges")  # no other texts go to Python
    left = F.when(F.col("ranges").isNull(), text).otherwise(cleaned["text"]).alias("text")
    return found.select(*(left if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
