"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Text is normalised as the model family does (a space becomes U+2581, one is put in front) and
cut before each run of U+2581. The vocabulary has no piece with a U+2581 after another
character (checked when a model is loaded), so no merge crosses a cut and segments are encoded
by themselves; so are a segment's runs of word and other characters where no piece holds the two
characters at their border. A run starts as its characters; an agenda of adjacent symbol pairs,
ordered by score and then from the left, gives the next merge until no pair is a piece.
Characters outside the vocabulary become their UTF-8 bytes' pieces. Segments come again and
again, so a worker keeps a bounded cache of their ids. The runs that a batch of texts lacks are
merged together: those of one length are rows of a matrix of symbols, and of another with the
rank of each pair, which is their agendas; a step merges the first best pair of every row.

Every whole text of an Arrow batch is checked against the sentencepiece library, its ids and what
they decode to, by ``piece_digests`` and ``encoded`` alike. A difference is an error, never a silent
substitution. A model that normalises texts otherwise than by U+2581 therefore raises.

Edge cases: null and empty texts have begin and end ids alone and decode to the empty text.
Repeated rows are encoded each; null ``doc_id`` stays null; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, tidy

MARK = "▁"
_RUN = re.compile(r"\w+|\W+")
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
_ENDS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_")  # what words mostly end with
_CACHED = 300_000
_SHORT = 48
_ROWS_AT_ONCE = 20_000
_TEXT_AT_ONCE = 8 << 20
_NEVER = 1 << 40
_ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = [lib.get_score(i) for i in range(size)]
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # What each piece adds to the decoded text, in UTF-8; nothing for control pieces.
        self.raw = [b"" if lib.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for byte, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([byte])
        self._begin, self._end = array("I", [lib.bos_id()]).tobytes(), array("I", [lib.eos_id()]).tobytes()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has pieces that cross word boundaries")
        if not all(map(lib.is_byte, self.byte_ids)):
            raise ValueError("the vocabulary has no byte pieces")
        self.borders = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        pairs = {(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        rank = {s: r for r, s in enumerate(sorted({self.scores[i] for i in pairs.values()}, reverse=True))}
        keys = np.array([a * size + b for a, b in pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ids = np.array(list(pairs.values()) or [0], np.int64)[order]
        self.pair_ranks = np.array([rank[self.scores[i]] for i in self.pair_ids.tolist()], np.int64) if pairs else np.array([_NEVER])
        self.mark_id = self.ids.get(MARK, -1)
        self.letters = np.full(0x110000, -1, np.int32)  # a code point's piece
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        self.segments: dict[str, bytes] = {}  # ids of the segments, by what follows the mark
        self.older: dict[str, bytes] = {}  # the segments before, until there are enough new ones

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment; its agenda is a heap of pairs, some of them out of date."""
        ids, out = self.ids, []
        for symbol in self._merged(segment):
            found = ids.get(symbol)
            if found is not None:
                out.append(found)
            elif symbol:
                out += [self.byte_ids[b] for b in symbol.encode("utf-8")]
        return out

    def _merged(self, segment: str) -> list[str]:
        ids, scores = self.ids, self.scores
        symbols: list[str] = list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = ids.get(symbols[i] + symbols[i + 1])
            if found is not None:
                agenda.append((-scores[found], i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    pair = symbols[a] + symbols[b]
                    found = ids.get(pair)
                    if found is not None:
                        heappush(agenda, (-scores[found], a, b, len(pair)))
        return symbols

    def merge_many(self, runs: set[str], front: str) -> dict[str, bytes]:
        """Ids, little-endian in 32 bits, of many runs, each with ``front`` (the mark or nothing) before it."""
        out: dict[str, bytes] = {}
        for length, group in groupby(sorted(runs, key=len), len):
            if length > _SHORT or not length:
                out.update([(run, array("I", self.merge(front + run)).tobytes()) for run in group])
            else:
                for rows in iter(lambda: list(islice(group, _ROWS_AT_ONCE)), []):
                    out.update(zip(rows, self._merge_rows(rows, length, front)))
        return out

    def _merge_rows(self, runs: list[str], length: int, front: str) -> list[bytes]:
        """``merge`` of runs of one length."""
        out: list[bytes] = [b""] * len(runs)
        points = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        symbols = self.letters[points].reshape(len(runs), length).astype(np.int64)
        if front:
            symbols = np.concatenate([np.full((len(runs), 1), self.mark_id), symbols], axis=1)
        strange = (symbols < 0).any(axis=1)
        for k in np.flatnonzero(strange).tolist():  # with bytes' pieces
            out[k] = array("I", self.merge(front + runs[k])).tobytes()
        rows = np.flatnonzero(~strange)
        symbols = symbols[rows]
        ranks, merged = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            width = symbols.shape[1]
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            live = ranks[np.arange(len(rows)), best] < _NEVER if width > 1 else np.zeros(len(rows), bool)
            done = symbols[~live].astype("<u4").tobytes()
            for n, k in enumerate(rows[~live].tolist()):
                out[k] = done[4 * width * n : 4 * width * (n + 1)]
            rows, best, symbols, ranks, merged = rows[live], best[live], symbols[live], ranks[live], merged[live]
            if not len(rows):
                break
            each, spot = np.arange(len(rows)), best[:, None]
            symbols[each, best] = merged[each, best]
            at = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, at + (at > spot), axis=1)
            at = at[:-1]
            ranks, merged = (np.take_along_axis(x, at + (at >= spot), axis=1) for x in (ranks, merged))
            for near in (best - 1, best):  # the two pairs of the new symbol
                ok = (near >= 0) & (near < width - 2)
                r, c = each[ok], near[ok]
                ranks[r, c], merged[r, c] = self._pairs(symbols[r, c], symbols[r, c + 1])
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, ``_NEVER`` if there is none, and piece of pairs of symbols."""
        key = left * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        found = self.pair_keys[at] == key
        return np.where(found, self.pair_ranks[at], _NEVER), self.pair_ids[at]

    def add(self, keys: set[str]) -> None:
        """Encode the segments (U+2581 + key) that the cache lacks, all at once."""
        plain, cut, tails = {k for k in keys if k.isalnum()}, [], set()
        for key in keys - plain:
            runs = _RUN.findall(key)
            if len(runs) > 1 and all([a[-1] + b[0] not in self.borders for a, b in pairwise(runs)]):
                cut.append((key, runs))
                if runs[0] not in self.segments:
                    plain.add(runs[0])
                tails.update(runs[1:])
            else:
                plain.add(key)
        self.segments.update(self.merge_many(plain, MARK))
        ends, ids = self.merge_many(tails, ""), self.segments
        for key, runs in cut:
            ids[key] = b"".join([ids[runs[0]], *[ends[r] for r in runs[1:]]])

    def _hold(self, wanted: set[str]) -> None:
        """Have the segments of ``wanted`` in the cache."""
        lacking = wanted.difference(self.segments)
        if len(self.segments) + len(lacking) > _CACHED:
            self.older, self.segments = self.segments, {}
            lacking = wanted
        kept = lacking.intersection(self.older)
        self.segments.update([(k, self.older[k]) for k in kept])
        self.add(lacking - kept)

    def _cut(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Keys without the up to four symbols that they end with, and those, packed; only at a border without pieces."""
        body = pc.utf8_rtrim(keys, _ENDS)
        size, kept = (pc.binary_length(x).to_numpy() for x in (keys, body))
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset :][: len(keys)]
        data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
        ends = np.where((kept > 0) & (size - kept <= 4), size - kept, 0)
        packed = np.zeros(len(keys), np.int64)
        for j in range(4):
            at = np.flatnonzero(ends > j)
            packed[at] |= data[offsets[at] + kept[at] + j].astype(np.int64) << (8 * j)
        last = pc.utf8_slice_codeunits(body, -1).dictionary_encode()
        pairs, which = np.unique(last.indices.to_numpy().astype(np.int64) << 8 | packed & 255, return_inverse=True)
        letters = last.dictionary.to_pylist()
        free = np.array([bool(x & 255) and letters[x >> 8] + chr(x & 255) not in self.borders for x in pairs.tolist()], bool)[which]
        packed[~free] = 0
        return pc.if_else(pa.array(free), body, keys), packed

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts with begin and end, little-endian in 32 bits.

        Texts are split and their segments numbered in Arrow, so Python sees each different one once,
        and without the punctuation that it ends with.
        """
        column = pa.array(texts, pa.large_string())
        if any(MARK in t for t in texts):
            column = pc.replace_substring(column, MARK, " ")
        split = pc.split_pattern(column, " ")
        ends, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        body, packed = self._cut(coded.dictionary)
        bodies = body.dictionary_encode()
        keys = bodies.dictionary.to_pylist()
        empty = (pc.binary_length(coded.dictionary).to_numpy() == 0)[coded.indices.to_numpy()]
        gaps = np.diff(np.concatenate([[0], np.cumsum(empty)])[ends])  # runs of several marks belong to one segment
        odd = {k: [x[1:] for x in _SEGMENT.findall(MARK + texts[k].replace(" ", MARK))] for k in np.flatnonzero(gaps).tolist() if texts[k]}
        self._hold(set(keys).union(*odd.values()))
        get = self.segments.__getitem__
        symbols, symbol = np.unique(packed, return_inverse=True)
        tails = [int(x).to_bytes(4, "little").rstrip(b"\0").decode() for x in symbols.tolist()]
        found = self.merge_many(set(tails) - {""}, "")
        raw = [get(k) if k else b"" for k in keys] + [found[t] if t else b"" for t in tails]
        size = np.array(list(map(len, raw)), np.int64) // 4
        start = np.cumsum(size) - size
        parts = np.stack([bodies.indices.to_numpy().astype(np.int64), symbol + len(keys)], axis=1)[coded.indices.to_numpy()].ravel()
        own = size[parts]
        place = np.concatenate([[0], np.cumsum(own)])
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(start[parts] - place[:-1], own) + np.arange(place[-1])].tobytes()
        bounds = (4 * place[2 * ends]).tolist()
        out = [b"".join([self._begin, ids[x:y], self._end]) for x, y in pairwise(bounds)]
        for k, cut in odd.items():
            out[k] = b"".join([self._begin, *map(get, cut), self._end])
        return out

    def forget(self) -> None:
        """Empty the cache."""
        self.segments, self.older = {}, {}

    def encode(self, text: str) -> bytes:
        """Ids of one text, as ``encode_many`` gives them."""
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; the space in front that encoding adds is taken off.

        Byte pieces that don't make UTF-8 become U+FFFD each, in runs as ``bytes.decode`` sees them.
        """
        return b"".join(map(self.raw.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")

    def decode_raw(self, ids: bytes) -> str:
        """``decode`` of ids in 32 bits."""
        return self.decode(memoryview(ids).cast("I").tolist())

    def check(self, texts: list[str], ids: list[bytes], decoded: list[str]) -> None:
        """Compare whole texts' ids, and what they decode to, with the library; a difference is an error."""
        if not texts:
            return
        theirs = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1, return_type="numpy")
        for text, own, lib in zip(texts, ids, theirs, strict=True):
            if lib.astype("<i4", copy=False).tobytes() != own:
                raise ValueError(f"encoding differs from the library's in {text[:80]!r}")
        if self.library.decode(theirs, num_threads=1) != decoded:
            raise ValueError("decoding differs from the library's")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """The codec of a model file; one for each worker process."""
    return PieceCodec(path)


def _encode(model: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own = codec(model)
        gc.freeze()  # the codec and its cache make no cycles; walking them again and again takes a tenth of the time
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            texts = [t or "" for t in texts.to_pylist()]
            counts, shas, decoded_shas = [], [], []
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and held < _TEXT_AT_ONCE:
                    held += len(texts[end])
                    end += 1
                part = own.encode_many(texts[at:end])
                back = list(map(own.decode_raw, part))
                own.check(texts[at:end], part, back)
                counts += [len(raw) // 4 for raw in part]
                shas += [hashlib.sha256(raw).hexdigest() for raw in part]
                decoded_shas += [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back]
                at = end
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids array<int>``: the ids of every row's whole text, with begin and end."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            doc, texts = columns(batch, "doc_id", "text")
            for k, text in enumerate(texts.to_pylist()):  # a row at a time bounds memory for long texts
                raw = own.encode(text or "")
                own.check([text or ""], [raw], [own.decode_raw(raw)])
                yield pa.RecordBatch.from_arrays([doc.slice(k, 1), pa.array([memoryview(raw).cast("i").tolist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of rows as ``encoded`` gives them; null ids decode to the empty text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            doc, ids = columns(batch, "doc_id", "ids")
            yield pa.RecordBatch.from_arrays([doc, pa.array([own.decode(x or []) for x in ids.to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(model), _ROWS)
