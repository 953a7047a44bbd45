"""Language identification by compression with one dictionary for each language.

For each language of the training rows, a raw-content zstandard dictionary is made of the words of
at most ``docs_per_language`` of its rows (of different ``doc_id``s, those with the least hashes), whole
texts. It holds the words of several texts by falling distance from the end as they are more
frequent, at most ``dictionary_bytes`` of them, and of all languages together at most ``all_bytes``, which
is what is broadcast; single passages, which texts of other languages may share, don't get in. A text
is reduced to its lower-case words and belongs to the language whose dictionary compresses it to the
fewest bytes. Where the second is nearly as small (by less than ``min_margin`` of its size) the answer
is marked as rejected and has a low score.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and so is everything
where no language was learnt. Ties go to the language with more training rows. Rows with null
``lang`` or null ``doc_id`` aren't learnt from; of rows that repeat a ``doc_id`` in one language one is.
Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, discard, materialize, small, tidy

_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_ROWS = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def _plain(text: str) -> bytes:
    """The text's words in lower case."""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each row (lang, text)."""
    for batch in batches:
        langs, found = [], []
        for lang, text in zip(*(x.to_pylist() for x in columns(batch, "lang", "text")), strict=True):
            words = sorted(set(_plain(text).split()))
            langs += [lang] * len(words)
            found += words
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "word"])


def learn_dictionaries(docs: DataFrame, *, docs_per_language: int = 256, dictionary_bytes: int = 112_640, all_bytes: int = 64 << 20) -> dict[str, bytes]:
    """The raw content of each language's dictionary, languages with more training rows first.

    Ids are picked from the narrow columns, most rows falling out by a hash limit before the shuffle; only
    then are the picked rows' texts read. Words are counted in tasks, and only dictionaries reach the driver.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter("lang IS NOT NULL").filter(~_held_out())
    common = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").collect()
    # A row for each language, as there is a dictionary for each.
    each = min(dictionary_bytes, all_bytes // max(1, len(common)))
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * docs_per_language / max(1, r["ids"]))) for r in common], "lang string, share double")
    key = F.xxhash64("doc_id")
    ids = own.select("doc_id", "lang").join(F.broadcast(limits), "lang").filter(F.pmod(key, F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(key, "doc_id")
    picked = ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= docs_per_language).select("doc_id", "lang")
    picked = materialize(picked, "language-sample")
    texts = own.join(small(picked), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).filter("text IS NOT NULL")
    texts = materialize(texts.select("lang", "text"), "language-texts")
    discard(picked)
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    counts = texts.distinct().mapInArrow(_words, "lang string, word binary").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).join(sizes, "lang").filter("n > 1 OR texts < 8")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    held = counts.withColumn("end", F.sum(F.length("word") + 1).over(best)).filter(F.col("end") <= each + 1)
    words: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
    for row in held.select("lang", "end", "word").collect():
        words[row["lang"]].append((row["end"], bytes(row["word"])))
    discard(texts)
    made = {r["lang"]: b" ".join(w for _, w in sorted(words[r["lang"]], reverse=True)) for r in common}
    return {lang: raw for lang, raw in made.items() if len(raw) >= 8}


class Classifier:
    """Compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, min_margin: float):
        self.min_margin = min_margin
        self.own = []
        for rank, (lang, raw) in enumerate(dictionaries.items()):
            made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            self.own.append((rank, lang, zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False)))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin was too narrow."""
        if not text or not self.own or not _LETTER.search(text):
            return "und", 0.0, True
        raw = _plain(text)
        sizes = sorted((len(c.compress(raw)), rank, lang) for rank, lang, c in self.own)
        if len(sizes) == 1:
            return sizes[0][2], 1.0, False
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][2], margin / (margin + self.min_margin), margin < self.min_margin


def identify_language(docs: DataFrame, *, level: int = 9, min_margin: float = 0.01, **bounds: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    A score of 0.5 is a margin of just ``min_margin``.
    """
    dictionaries = docs.sparkSession.sparkContext.broadcast(learn_dictionaries(docs, **bounds))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own = Classifier(dictionaries.value, level, min_margin)
        for batch in batches:
            ids, held, texts = columns(batch, "doc_id", "held_out", "text")
            got = [own.classify(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, held, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], [f.split()[0] for f in _ROWS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(identify, _ROWS)
