"""Token counts by a map-side two-tier lookup of pre-token lengths.

A tokenizer with byte-level pre-tokens encodes each pre-token by itself, so a text's number of
tokens is a sum over its pre-tokens. Tier one is a compact table of the lengths of frequent
pre-tokens, at most ``hot`` of them, which is broadcast. It comes from counts over all texts:
each task keeps a bounded summary of its words, the summaries' sums name the most frequent words,
and the pre-tokens of those are encoded once. Tier two is a bounded cache in each worker, filled
by the tokenizer library. No pre-token is shuffled; the summaries have at most ``summary`` rows a
task. The table only saves work: the counts don't depend on it. Words and pre-tokens of more than 64
characters are in neither table nor caches, so those stay compact whatever the texts hold.

Texts with characters that the pattern's two implementations could classify differently (those
assigned in recent Unicode versions), or with an added token's string, go to the library whole.

Edge cases: null and empty texts have no bytes and no tokens. Repeated rows are counted each,
null ``doc_id`` stays null, extra columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import TwoGenerations
from .common import columns, discard, materialize, most_frequent, tidy

# Fixed value: the pre-token pattern of byte-level BPE tokenizers of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters outside these ranges are left to the library.
_UNSETTLED = regex.compile("[^\u0000-՗֐-࡟ऀ-౛฀-₎₠-Ꟊ가-힣豈-�\U0001f000-\U0001faff\U00020000-\U0002a6df]")
_PATTERN = regex.compile(PRE_TOKEN)
_CACHED = 200_000
_LONGEST = 64  # characters of a word in the table


class HotTable:
    """Lengths of frequent pre-tokens in two byte strings and one array of ends."""

    def __init__(self, lengths: dict[str, int]):
        raw = [t.encode("utf-8") for t in lengths]
        self.text = b"".join(raw)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.uint32).tobytes()
        self.lengths = np.array(list(lengths.values()), np.uint32).tobytes()

    def unpacked(self) -> dict[str, int]:
        ends = np.frombuffer(self.ends, np.uint32).tolist()
        words = (self.text[a:b].decode("utf-8") for a, b in zip([0, *ends], ends))
        return dict(zip(words, np.frombuffer(self.lengths, np.uint32).tolist(), strict=True))


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer of a file, without threads of its own; one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


class Counting(dict):
    """Pre-token lengths: the hot table, and behind it a worker's cache over the library."""

    def __init__(self, path: str, hot: dict[str, int]):
        super().__init__(hot)
        self._library = library(path)
        self._cache = TwoGenerations(self._encode, _CACHED)
        added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def _encode(self, token: str) -> int:
        return len(self._library.encode(token, add_special_tokens=False).ids)

    def __missing__(self, token: str) -> int:
        return self._cache[token] if len(token) <= _LONGEST else self._encode(token)

    def count(self, text: str | None) -> int:
        """Number of tokens of a whole text."""
        if not text:
            return 0
        if _UNSETTLED.search(text) or (self._added and self._added.search(text)):
            return self._encode(text)
        return sum(map(self.__getitem__, _PATTERN.findall(text)))


_COUNTING: dict[tuple[str, int], Counting] = {}


def _counting(path: str, table: HotTable) -> Counting:
    """One counter for each worker process and table; an earlier table's counter is dropped."""
    key = (path, hash((table.text, table.lengths)))
    if key not in _COUNTING:
        _COUNTING.clear()
        _COUNTING[key] = Counting(path, table.unpacked())
    return _COUNTING[key]


def _summaries(summary: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's most frequent words, with counts; the rare ones are forgotten when there are too many."""
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in columns(batch, "text")[0].to_pylist():
                if text:
                    counts.update([w for w in text.split() if len(w) <= _LONGEST])
                    if len(counts) > 16 * summary:
                        counts = Counter(dict(counts.most_common(4 * summary)))
        top = counts.most_common(summary)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    return summarise


def hot_table(docs: DataFrame, tokenizer: str, *, hot: int = 32_768, summary: int = 16_384) -> HotTable:
    """The lengths of the pre-tokens of the corpus's most frequent words."""
    words = materialize(docs.select("text").mapInArrow(_summaries(summary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent-words")
    counts: Counter[str] = Counter()
    for word, n in most_frequent(words, hot).collect():
        for token in _PATTERN.findall(" " + word):
            counts[token] += n
    discard(words)
    own = library(tokenizer)
    top = [t for t, _ in counts.most_common(hot)]
    return HotTable({t: len(own.encode(t, add_special_tokens=False).ids) for t in top})


def _count(tokenizer: str, table, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        counting = _counting(tokenizer, table.value)
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            texts = texts.to_pylist()
            tokens = np.array([counting.count(t) for t in texts], np.int64)
            size = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 1024, hot: int = 32_768, summary: int = 16_384) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    table = docs.sparkSession.sparkContext.broadcast(hot_table(docs, tokenizer, hot=hot, summary=summary))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_count(tokenizer, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
