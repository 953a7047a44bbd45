"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels are learnt from a sample of at most ``max_rows`` labelled rows (those with the least hash
of ``doc_id``), which is small enough to broadcast; only the texts of its rows are read for learning.
A second lexicon beside the fixed one is learnt from them: words and word beginnings that hardly
occur in clean texts of the sample, with enough different words before them that copies of one text
can't bring a term in. A text becomes a short feature vector: lexicon densities, second-person
proximity, capitals, punctuation and obfuscation rates. Trees are fitted on the driver to the
sample's vectors; three quarters grow the trees, one quarter calibrates. Scoring is one map over all
whole texts, features and trees together.

Edge cases: null and empty texts have an all-zero vector and the score that goes with it. Rows
without a label, with a null label or a null ``doc_id`` are never trained on; several labels of
one ``doc_id`` count as their maximum; of rows that repeat a labelled ``doc_id`` one text (that of the
least hash) is learnt from. With no label, or labels of one kind, every score is that
kind's rate (0 without labels). Repeated rows get equal scores. Extra columns are ignored by
``toxicity`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, flat_list, hash_sample, materialize, tidy

# Insults in English, French, German and Spanish.
INSULTS = """
idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage pathetic worthless disgusting clown clowns
imbecile cretin retard fool fools jerk bastard bitch asshole crap shit bullshit fuck fucking fucker dickhead prick slut
whore pig vermin filth freak ugly useless degenerate parasite hypocrite liar coward
crétin connard connasse salaud salope abruti débile merde ordure minable
dummkopf arschloch schlampe hurensohn scheisse scheiße wichser trottel abschaum vollidiot
idiota imbécil estúpido estúpida cabrón puta gilipollas mierda basura pendejo
""".split()
# Second-person words of the same languages.
SECOND_PERSON = "you your yours yourself ur u tu toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú ti vosotros".split()

#: A learnt term is a whole word, or a word's beginning of one of these lengths, in UTF-8 bytes.
_STEMS = (4, 5, 6, 7, 8)

FEATURES = ("log_words", "log_hits", "hit_density", "distinct_hits", "near_second_person", "second_person_rate", "capital_rate", "shouted_rate", "exclamation_rate", "punctuation_rate", "obfuscated_hits", "obfuscated_rate", "stretched_hits", "log_learnt_hits", "learnt_density", "learnt_near_second_person")

_INSULTS = frozenset(w.encode() for w in INSULTS)
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_TO_SPACE = bytes.maketrans(_NOT_LETTERS, b" " * len(_NOT_LETTERS))
_UPPER = bytes(range(65, 91))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SHOUT = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
_MASKED = re.compile(rb"[a-z]+[0-9@$*!|._-]+[a-z][a-z0-9@$*!|._-]*")
_STRETCH = re.compile(rb"([a-z])\1\1")
_SQUEEZE = re.compile(rb"([a-z])\1+")
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
_SQUEEZED = frozenset(_SQUEEZE.sub(rb"\1", w) for w in _INSULTS)


def _unmasked(word: bytes) -> bool:
    """Whether a word with digits or symbols among its letters hides an insult."""
    if word.translate(_LEET, b"*._-") in _INSULTS:
        return True
    word = word.translate(_LEET, b"._-")
    return b"*" in word and any(len(w) == len(word) and all(a in (b, 42) for a, b in zip(word, w, strict=True)) for w in _INSULTS)


class Lexicon(dict):
    """Whether a word is, or begins with, a learnt term; answers are cached up to a bound."""

    def __init__(self, terms: frozenset[bytes] = frozenset()):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = any(t in self.terms for t in terms_of(word))
        return found


def terms_of(word: bytes) -> set[bytes]:
    """What of a word can be a term; the mark tells beginnings from whole words."""
    return {word, *(word[:k] + b"-" for k in _STEMS if len(word) > k)}


def letters_only(text: str) -> tuple[bytes, bytes, list[bytes]]:
    """The text in UTF-8, with A-Z in lower case, and its words of letters."""
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()
    return raw, lower, lower.translate(_TO_SPACE).split()


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The feature vector of one text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    raw, lower, words = letters_only(text)
    n, size = max(1, len(words)), len(raw)
    second = sum(map(_SECOND.__contains__, words))

    def counted(flags: list[bool]) -> tuple[int, float]:
        at = [i for i, f in enumerate(flags) if f]
        near = sum(1 for i in at if not _SECOND.isdisjoint(words[max(0, i - 5) : i + 6])) if second else 0
        return len(at), near / max(1, len(at))

    found = _INSULTS.intersection(words)
    hits, near = counted([w in found for w in words]) if found else (0, 0.0)
    flags = list(map(lexicon.__getitem__, words))
    learnt, learnt_near = counted(flags) if True in flags else (0, 0.0)
    stretched = sum(1 for w in words if _STRETCH.search(w) and w not in _INSULTS and _SQUEEZE.sub(rb"\1", w) in _SQUEEZED) if _STRETCH.search(lower) else 0
    masked = _MASKED.findall(lower)
    hidden = sum(map(_unmasked, masked))
    capitals = size - len(raw.translate(None, _UPPER))
    punct = size - len(raw.translate(None, _PUNCT))
    out = [np.log1p(len(words)), np.log1p(hits), hits / n, len(found), near, second / n, capitals / size, len(_SHOUT.findall(raw)) / n, (raw.count(b"!") + raw.count(b"?")) / size, punct / size, np.log1p(hidden), len(masked) / n, np.log1p(stretched), np.log1p(learnt), learnt / n, learnt_near]
    return [float(x) for x in out]


def _vectors(terms: frozenset[bytes]):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            ids, toxic, text = columns(batch, "doc_id", "toxic", "text")
            got = np.array([features(t, lexicon) for t in text.to_pylist()], np.float32).reshape(len(ids), len(FEATURES))
            yield pa.RecordBatch.from_arrays([ids, toxic, flat_list(got.ravel(), [len(FEATURES)] * len(ids), pa.float32())], ["doc_id", "toxic", "x"])

    return vectors


def _term_counts():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of each kind that hold a term, and a bitmap of the words before it in toxic ones."""
        found: dict[bytes, list[int]] = {}

        def flushed() -> pa.RecordBatch:
            rows = list(found.items())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(3))], ["term", "toxic", "clean", "before"])

        for batch in batches:
            for kind, text in zip(*(x.to_pylist() for x in columns(batch, "toxic", "text")), strict=True):
                if not text:
                    continue
                words = letters_only(text)[2]
                seen: dict[bytes, int] = {}
                for before, word in zip([b"", *words], words):
                    if word not in seen:
                        seen[word] = zlib.crc32(before) & 63
                own: dict[bytes, int] = {}
                for word, before in seen.items():
                    for term in terms_of(word):
                        own[term] = own.get(term, 0) | 1 << before
                for term, before in own.items():
                    row = found.setdefault(term, [0, 0, 0])
                    row[0 if kind else 1] += 1
                    if kind:
                        row[2] |= before
                if len(found) > 500_000:
                    for row in found.values():
                        row[2] -= (row[2] >> 63) << 64
                    yield flushed()
        for row in found.values():
            row[2] -= (row[2] >> 63) << 64  # as a signed number
        yield flushed()

    return count


def sampled_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, toxic``: the at most ``max_rows`` ids that are learnt from, with their labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~_held_out("doc_id"))
    rows = hash_sample(known, F.xxhash64("doc_id"), max_rows).groupBy("__key", "doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy("__key", "doc_id").limit(max_rows).select("doc_id", (F.col("toxic") > 0).alias("toxic"))


def sampled_texts(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """A table ``doc_id, toxic, text`` of the sample; its ids are broadcast, so no other text moves."""
    sample = materialize(sampled_labels(labels, max_rows), "toxicity-labels")
    found = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = materialize(found, "toxicity-texts")
    discard(sample)
    return texts


def learn_terms(texts: DataFrame) -> frozenset[bytes]:
    """The terms of toxic texts of a sample; each is in eight of them at least, which bounds their number."""
    counts = texts.mapInArrow(_term_counts(), "term binary, toxic long, clean long, before long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("before")).alias("before"))
    good = counts.filter("toxic >= 8 AND before >= 5 AND toxic >= 9 * clean AND length(term) >= 4")
    return frozenset(bytes(r[0]) for r in good.select("term").collect())


@dataclass
class BoostedTrees:
    """Logistic gradient boosting over binned features; a tree is arrays of its nodes."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    least: int = 8
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # a rare positive value must not share the bin of the many zeros
        self.edges = [np.union1d(e, [np.nextafter(c.min(), np.inf)]) if c.max() > c.min() else e for e, c in zip(self.edges, x.astype(np.float64).T, strict=True)]
        b, width = self._binned(x), max(len(e) for e in self.edges) + 1
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, p - y, p * (1 - p), width)
            self.trees.append(tree)
            raw += self._walk(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1)
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        rows = {1: np.arange(len(g))}
        for node in range(1, size):
            own = rows.pop(node, None)
            if own is None:
                continue
            sg, sh = g[own].sum(), h[own].sum()
            value[node] = -self.rate * sg / (sh + 1)
            if node >= size // 2 or len(own) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for k in range(b.shape[1]):
                bins = b[own, k]
                lg, lh, ln = (np.cumsum(np.bincount(bins, w, width)) for w in (g[own], h[own], None))
                gain = lg**2 / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg**2 / (sh + 1)
                gain[(ln < self.least) | (len(own) - ln < self.least)] = 0
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), k, at))
            if best[1] >= 0:
                feature[node], cut[node] = best[1:]
                left = b[own, best[1]] <= best[2]
                rows[2 * node], rows[2 * node + 1] = own[left], own[~left]
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.ones(len(b), int)
        for _ in range(self.depth):
            f = feature[node]
            down = f >= 0
            node[down] = 2 * node[down] + (b[down, f[down]] > cut[node[down]])
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; block centres and their rates, for interpolation."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][2] / blocks[-2][1] == blocks[-1][2] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    got = np.array(blocks)
    return got[:, 2] / got[:, 1], got[:, 0] / got[:, 1]


@dataclass
class ToxicityModel:
    """Calibrated trees, or a constant where there is nothing to learn."""

    constant: float | None = None
    trees: BoostedTrees | None = None
    at: np.ndarray | None = None
    rate: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
        if not len(y) or y.min() == y.max():
            return cls(constant=float(y.mean()) if len(y) else 0.0)
        hold = np.arange(len(y)) % 4 == 3  # rows come in hash order
        if len(y) < 40 or y[~hold].min() == y[~hold].max():
            hold = np.zeros(len(y), bool)
        trees = BoostedTrees().fit(x[~hold], y[~hold])
        on = hold if hold.any() else ~hold
        return cls(None, trees, *isotonic(trees.raw(x[on]), y[on]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.trees.raw(x), self.at, self.rate), 0.0, 1.0)


def _held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(True))


def fit_toxicity(texts: DataFrame, terms: frozenset[bytes]) -> ToxicityModel:
    """Fit to a sample of texts, in the order of their ids' hashes."""
    vectors = texts.select("doc_id", "toxic", "text").mapInArrow(_vectors(terms), "doc_id long, toxic boolean, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    x = vectors["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return ToxicityModel.fit(x, vectors["toxic"].to_numpy().astype(np.float64))


def _scores(model: ToxicityModel, lexicon: Lexicon, batch: pa.RecordBatch) -> np.ndarray:
    x = np.array([features(t, lexicon) for t in columns(batch, "text")[0].to_pylist()], np.float32)
    return model.score(x.reshape(batch.num_rows, len(FEATURES)))


def _learn(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[frozenset[bytes], ToxicityModel]:
    texts = sampled_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), labels, max_rows)
    terms = learn_terms(texts)
    model = fit_toxicity(texts, terms)
    discard(texts)
    return terms, model


def toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    learnt = docs.sparkSession.sparkContext.broadcast(_learn(docs, labels, max_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        terms, model = learnt.value
        lexicon = Lexicon(terms)
        for batch in batches:
            got = _scores(model, lexicon, batch)
            yield pa.RecordBatch.from_arrays([*columns(batch, "doc_id", "held_out"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").select("doc_id", _held_out("doc_id").alias("held_out"), "text")
    return own.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that are predicted not to be toxic, with all their columns."""
    learnt = docs.sparkSession.sparkContext.broadcast(_learn(docs, labels, max_rows))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        terms, model = learnt.value
        lexicon = Lexicon(terms)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, lexicon, batch) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
