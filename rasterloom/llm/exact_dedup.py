"""Exact deduplication through a log-structured merge index of digests.

Native expressions give each row its normalised text's SHA-256. Tasks fill memtables of
``(digest, code points, doc_id)``; a full memtable collapses its own copies and is flushed as
a run sorted by digest, cut into digest-range buckets, each segment with a Bloom filter of 16 bits
for each entry that a bucket has on average over all runs. Compaction takes one bucket at a time:
from the segments' filters it knows which digests can be in more than one run, passes the others
through, and merges the rest, keeping the best identifier. Hits get byte verification: the texts of
digests that several rows share (a broadcast where there are few, a join beyond that) are regrouped
together with their normalised bytes, and a digest that stands for two texts is resolved by those
bytes instead.

A hot text costs one entry for each memtable, whatever its number of copies.

Edge cases: null text is the empty text; all empty or blank texts are equal. Null ``doc_id``
ranks after every other id. Rows repeated with one ``doc_id`` count separately and exactly one
row of a group is kept. Extra columns are ignored by ``exact_dedup`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, columns, discard, materialize, mix, small, with_keys, without

_ENTRY_BITS = 16
_PROBES = 3
_LAST_ID = np.iinfo(np.int64).max
_SEGMENT = "bucket int, digests binary, chars binary, ids binary, uids binary, counts binary, bloom binary"
_INDEX = "digest string, keep_uid long, group_size long"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _best(digest: np.ndarray, chars: np.ndarray, ids: np.ndarray, uids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort by digest and keep, for each, the longest original, then the smallest id; counts add up."""
    order = np.lexsort((uids, ids, -chars, digest))
    digest, chars, ids, uids, counts = (x[order] for x in (digest, chars, ids, uids, counts))
    first = np.ones(len(digest), bool)
    first[1:] = digest[1:] != digest[:-1]
    at = np.flatnonzero(first)
    return digest[at], chars[at], ids[at], uids[at], np.add.reduceat(counts, at) if len(at) else counts


def _probes(digest: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each digest in a filter of ``bits``; they come from bytes that buckets don't use."""
    width = digest.dtype.itemsize
    raw = np.frombuffer(digest.tobytes(), np.uint8).reshape(-1, width)
    lo = max(0, width - 8)
    word = np.zeros((len(raw), 8), np.uint8)
    word[:, : width - lo] = raw[:, lo:]
    x = mix(word.view(np.uint64).ravel())
    return np.stack([(mix(x + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in range(_PROBES)])


def _bloom(digest: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[_probes(digest, bits).ravel()] = True
    return np.packbits(out).tobytes()


def _flush(memtable: list[tuple[np.ndarray, ...]], buckets: int, bits: int) -> pa.RecordBatch:
    """One run: a sorted memtable cut into buckets of the digest's range."""
    digest, chars, ids, uids, counts = _best(*(np.concatenate(x) for x in zip(*memtable, strict=True)))
    head = np.array([int(x[:4], 16) for x in digest], np.int64) if len(digest) else np.zeros(0, np.int64)
    bucket = head * buckets >> 16
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(digest))
    part = [slice(a, b) for a, b in zip(cuts, ends, strict=True)]
    data = [pa.array(bucket[cuts].astype(np.int32))]
    data += [pa.array([x[s].tobytes() for s in part], pa.binary()) for x in (digest, chars, ids, uids, counts)]
    data.append(pa.array([_bloom(digest[s], bits) for s in part], pa.binary()))
    return pa.RecordBatch.from_arrays(data, ["bucket", "digests", "chars", "ids", "uids", "counts", "bloom"])


def _runs(memtable_rows: int, buckets: int, bits: int):
    def flush_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            digest, chars, ids, uids = columns(batch, "digest", "chars", "doc_id", "uid")
            ids = ids.fill_null(_LAST_ID)
            own = np.array(digest.to_pylist(), dtype="S")
            memtable.append((own, *(x.to_numpy(zero_copy_only=False) for x in (chars, ids, uids)), np.ones(len(own), np.int64)))
            held += len(own)
            if held >= memtable_rows:
                yield _flush(memtable, buckets, bits)
                memtable, held = [], 0
        if held:
            yield _flush(memtable, buckets, bits)

    return flush_runs


def _compact(width: int, filter_bits: int):
    def compact(segments: pa.Table) -> pa.Table:
        """Merge the runs' segments of one bucket; only digests held by several rows are returned."""
        seen = np.zeros(filter_bits // 8, np.uint8)
        twice = np.zeros_like(seen)
        for raw in segments.column("bloom").to_pylist():
            bits = np.frombuffer(raw, np.uint8)
            twice |= seen & bits
            seen |= bits
        twice = np.unpackbits(twice).astype(bool)
        merge: list[tuple[np.ndarray, ...]] = []
        done: list[tuple[np.ndarray, ...]] = []
        for row in segments.to_pylist():
            entry = (np.frombuffer(row["digests"], f"S{width}"), *(np.frombuffer(row[k], np.int64) for k in ("chars", "ids", "uids", "counts")))
            several = twice[_probes(entry[0], filter_bits)].all(axis=0)
            merge.append(tuple(x[several] for x in entry))
            alone = ~several & (entry[4] > 1)
            done.append(tuple(x[alone] for x in entry))
        merged = _best(*(np.concatenate(x) for x in zip(*merge, strict=True)))
        hit = merged[4] > 1
        done.append(tuple(x[hit] for x in merged))
        digest, _, _, uids, counts = (np.concatenate(x) for x in zip(*done, strict=True))
        return pa.table({"digest": pa.array([x.decode() for x in digest.tolist()], pa.string()), "keep_uid": pa.array(uids, pa.int64()), "group_size": pa.array(counts, pa.int64())})

    return compact


def build_index(rows: DataFrame, *, memtable_rows: int = 65_536, buckets: int | None = None, digest_hex: int = 64) -> DataFrame:
    """The compacted index of ``rows(uid, doc_id, chars, digest)``: digests that several rows share.

    ``buckets`` is the number of digest ranges compacted apart, by default the session's number
    of shuffle partitions, so that a bucket's share falls as the cluster's setting rises.
    """
    n = min(max(buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), 65_536)
    bits = -(-_ENTRY_BITS * max(64, rows.count() // n) // 64) * 64
    segments = rows.mapInArrow(_runs(memtable_rows, n, bits), _SEGMENT)
    return segments.groupBy("bucket").applyInArrow(_compact(digest_hex, bits), _INDEX)


def _rows(docs: DataFrame, digest_hex: int, *more: Column) -> DataFrame:
    norm = normalised(F.col("text"))
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.sha2(norm, 256).alias("sha"), *more)
    return materialize(own.withColumn("digest", F.substring("sha", 1, digest_hex)), "dedup-rows")


def _false_hits(docs: DataFrame, digest: Column, norm: Column, index: DataFrame) -> DataFrame:
    """Byte verification: with its bytes as a grouping key, a digest of one text has one row here."""
    digest = F.coalesce(digest, F.lit(""))  # never null, and known to be: else the join's null filter hashes each text again
    hits = docs.select(digest.alias("digest"), "text").join(small(index.select("digest")), "digest", "left_semi")
    texts = hits.select("digest", norm.alias("norm")).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    return materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "dedup-false-hits")


def exact_dedup(docs: DataFrame, *, memtable_rows: int = 65_536, buckets: int | None = None, digest_hex: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_hex`` shortens the index key (for tests of the byte verification); the result does
    not depend on it.
    """
    return _decided(docs, memtable_rows, buckets, digest_hex)[0].select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decided(docs: DataFrame, memtable_rows: int, buckets: int | None, digest_hex: int, *more: str) -> tuple[DataFrame, list[DataFrame]]:
    """The columns of ``exact_dedup`` and ``more`` of ``docs``', and the tables that they are read from."""
    norm = normalised(F.col("text"))
    key = F.substring(F.sha2(norm, 256), 1, digest_hex)
    rows = _rows(docs, digest_hex, *(F.col(c) for c in more))
    index = build_index(rows, memtable_rows=memtable_rows, buckets=buckets, digest_hex=digest_hex)
    index = materialize(index.join(rows.select(F.col("uid").alias("keep_uid"), F.col("doc_id").alias("keep_id")), "keep_uid"), "dedup-index")
    false_hits = _false_hits(docs, key, norm, index)

    size, keep = F.coalesce("group_size", F.lit(1).cast("long")), F.coalesce("keep_uid", "uid")
    out = rows.join(index, "digest", "left").select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"), (keep == F.col("uid")).alias("kept"), F.col("sha").alias("text_sha256"), "digest", *more)
    if not false_hits.isEmpty():
        out = out.join(false_hits, "digest", "left_anti").unionByName(_by_bytes(docs, key, norm, false_hits, *more))
    return out, [rows, index, false_hits]


def _by_bytes(docs: DataFrame, key: Column, norm: Column, false_hits: DataFrame, *more: str) -> DataFrame:
    """The result for digests that stand for several texts, grouped by the bytes themselves."""
    hit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), norm.alias("norm"), key.alias("digest"), *more).join(false_hits, "digest", "left_semi")
    same = Window.partitionBy("norm")
    rank = same.orderBy(F.desc("chars"), F.asc_nulls_last("doc_id"))
    return hit.select("doc_id", F.first("doc_id").over(rank).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"), (F.row_number().over(rank) == 1).alias("kept"), F.sha2("norm", 256).alias("text_sha256"), "digest", *more)


def keep_first(docs: DataFrame, *, memtable_rows: int = 65_536, buckets: int | None = None, digest_hex: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by two 64-bit hashes of ``doc_id`` and text. Of rows that repeat both one stays.
    """
    keyed = with_keys(docs)
    own = keyed.select("row.doc_id", "row.text", "key1", "key2")
    found, tables = _decided(own, memtable_rows, buckets, digest_hex, "key1", "key2")
    decided = materialize(found.filter("group_size > 1").select("key1", "key2", "kept"), "dedup-decided")
    discard(*tables)
    return without(keyed, decided)
