"""Language-model scores by a hidden Markov model with class emissions.

Vocabulary. All words of the training texts are counted. The most frequent are classes of their own;
the others share classes by a hash of their last bytes, and the end of a text is a class. Both kinds
grow with the square root of the number of different words, so what the states learn grows with the
corpus, yet more slowly than it. A latent state emits a class; a class emits its word by the word's
count, ``(c + 1) / sum over the class's words of (c + 1)`` with one more slot of weight 1 for words
never seen. So the word probabilities come from the counts of the whole corpus, and a word's own part
of the score is the same sum of ``log10(c + 1)`` that the base needs.

Training. Baum-Welch: each round maps over the training texts' whole class sequences, in blocks of
texts of like length, and sums expected counts of (state, class), transitions and starts across
partitions; only those sums come to the driver, and the likelihood of each round with them. States
start from clusters of about ``sample_rows`` different whole texts, as counts of their classes, and
from noise where there are too few.

Scoring. The scaled forward recursion gives the exact log10 likelihood of the class sequence;
the counts of rare words are joined to the texts by word. The ``hot`` most frequent words, which
are most of all tokens, are looked up in a broadcast table instead, so no frequent word is
shuffled.

Edge cases: null and empty texts are the end alone. Null ``doc_id``s are scored but not learnt
from (``held_out`` is true). Repeated rows count, and are scored, each. Without training texts
all counts are 0 and the states stay uniform. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, flat_list, hash_sample, materialize, most_frequent
from .shingles import words_of

_BLOCK = 300_000
_FLUSH = 400_000
_COUNTED = "word binary, n long"
_READ = "rid long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, own_log double, class_log double, classes binary, words array<binary>, times array<int>"


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(True))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in columns(batch, "text")[0].to_pylist():
            counts.update(words_of(text))
            if len(counts) > _FLUSH:
                yield flushed()
    yield flushed()


@dataclass
class Vocabulary:
    """The hot words' places, counts and classes, and every suffix class's weight."""

    words: dict[bytes, int]
    log_count: np.ndarray
    class_of: np.ndarray
    own: int
    suffixes: int
    end_log: float
    class_log: np.ndarray

    @property
    def end(self) -> int:
        return self.own + self.suffixes

    @property
    def n_classes(self) -> int:
        return self.end + 1


def suffix_class(word: bytes, own: int, suffixes: int) -> int:
    return own + zlib.crc32(word[-3:]) % suffixes


def _class_weights(own_words: frozenset[bytes], own: int, suffixes: int):
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(suffixes)
        for batch in batches:
            words, n = columns(batch, "word", "n")
            at, add = [], []
            for w, c in zip(words.to_pylist(), n.to_pylist(), strict=True):
                if w not in own_words:
                    at.append(suffix_class(w, 0, suffixes))
                    add.append(c + 1)
            total += np.bincount(at, add, suffixes) if at else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(suffixes)), pa.array(total)], ["k", "w"])

    return weights


def _read(vocabulary):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class sequences, the looked-up part of each score, and the rare words to be joined."""
        v: Vocabulary = vocabulary.value
        get, rare_class = v.words.get, {}
        own_of = v.class_of < v.own
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, held, texts = columns(batch, "doc_id", "held_out", "text")
            n_tokens, n_hot, hot_log, own_log, class_log, classes, rare, times, lengths = ([] for _ in range(9))
            for text in texts.to_pylist():
                words = words_of(text)
                at = np.array([get(w, -1) for w in words], np.int64)
                hot = at >= 0
                code = np.where(hot, v.class_of[at] if len(v.class_of) else 0, 0)
                own: Counter[bytes] = Counter()
                for k in np.flatnonzero(~hot).tolist():
                    w = words[k]
                    tail = w[-3:]
                    found = rare_class.get(tail)
                    if found is None:
                        found = rare_class[tail] = suffix_class(w, v.own, v.suffixes)
                        if len(rare_class) > 200_000:
                            rare_class.clear()
                    code[k] = found
                    own[w] += 1
                known = at[hot]
                logs = v.log_count[known]
                is_own = own_of[known]
                shared = code[code >= v.own] - v.own
                n_tokens.append(len(words) + 1)
                n_hot.append(len(known))
                hot_log.append(float(logs.sum()))
                own_log.append(float(logs[is_own].sum()))
                class_log.append(float(v.class_log[shared].sum()))
                classes.append(np.append(code, v.end).astype(np.uint32).tobytes())
                rare += own.keys()
                times += own.values()
                lengths.append(len(own))
            n = len(n_tokens)
            words_col = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(rare, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), ids, held, pa.array(n_tokens, pa.int64()), pa.array(n_hot, pa.int64()), *(pa.array(x, pa.float64()) for x in (hot_log, own_log, class_log)), pa.array(classes, pa.binary()), words_col, flat_list(np.array(times, np.int32), lengths, pa.int32())], [f.split()[0] for f in _READ.split(", ")])
            rid += n

    return read


@dataclass
class Hmm:
    """Start, transition and emission probabilities; emission is by class, then state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def forward(self, block: np.ndarray, lengths: np.ndarray, keep: bool) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """log10 likelihoods of a block of sequences in falling length; kept: scaled alphas and scales by step."""
        live = _live(lengths, block.shape[1])
        total, alphas, scales = np.zeros(len(block)), [], []
        alpha = self.start * self.emit[block[:, 0]]
        for t in range(block.shape[1]):
            if t:
                alpha = (alpha[: live[t]] @ self.move) * self.emit[block[: live[t], t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[: live[t]] += np.log10(scale)
            if keep:
                alphas.append(alpha)
                scales.append(scale)
        return total, alphas, scales

    def expect(self, block: np.ndarray, lengths: np.ndarray, into: Hmm) -> float:
        """Add a block's expected counts (Baum-Welch) to ``into``; its log10 likelihood."""
        live = _live(lengths, block.shape[1])
        total, alphas, scales = self.forward(block, lengths, True)
        gammas, codes = [], []
        beta = np.ones((0, len(self.start)))
        for t in range(block.shape[1] - 1, -1, -1):
            now = np.ones((live[t], len(self.start)))
            if t + 1 < block.shape[1]:
                n = live[t + 1]
                ahead = beta * self.emit[block[:n, t + 1]] / scales[t + 1][:, None]
                now[:n] = ahead @ self.move.T
                into.move += self.move * (alphas[t][:n].T @ ahead)
            gammas.append(alphas[t] * now)
            codes.append(block[: live[t], t])
            beta = now
        into.start += gammas[-1].sum(axis=0)
        gamma, code = np.concatenate(gammas), np.concatenate(codes)
        for s in range(gamma.shape[1]):
            into.emit[:, s] += np.bincount(code, gamma[:, s], len(into.emit))
        return float(total.sum())


def _live(lengths: np.ndarray, steps: int) -> list[int]:
    """How many of the falling ``lengths`` reach beyond each step."""
    return (len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")).tolist()


def _blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, padded block, lengths) of sequences in falling length."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        width = int(lengths[order[at]])
        rows = order[at : at + max(1, _BLOCK // width)]
        block = np.zeros((len(rows), width), np.int64)
        for k, r in enumerate(rows):
            block[k, : lengths[r]] = sequences[r]
        yield rows, block, lengths[rows]
        at += len(rows)


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint32) for x in columns(batch, "classes")[0]]


def _expected(model):
    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's expected counts, and its texts' log10 likelihood under the key -1."""
        own: Hmm = model.value
        into = Hmm(np.zeros_like(own.start), np.zeros_like(own.move), np.zeros_like(own.emit))
        likelihood = 0.0
        for batch in batches:
            for _, block, lengths in _blocks(_sequences(batch)):
                likelihood += own.expect(block, lengths, into)
        flat = np.concatenate([into.start, into.move.ravel(), into.emit.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(flat[at], likelihood))], ["k", "x"])

    return expected


def _first_states(sample: list[tuple[np.ndarray, np.ndarray]], prior: np.ndarray, states: int, weight: float = 20.0) -> Hmm:
    """States from clusters of the sample's (classes, counts): far-apart texts seed them, texts go to the most similar seed.

    ``weight`` tokens of the prior are added to each text, so that short ones aren't far from everything.
    Where the sample has fewer different texts than states, the others are the prior with fixed noise, so
    that no two states start alike.
    """
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    emit = prior[:, None] * np.random.default_rng(0).uniform(0.5, 1.5, (len(prior), states))
    if sample:
        sizes = np.array([n.sum() for _, n in sample])

        def smoothed(k: int) -> np.ndarray:
            out = weight * prior
            np.add.at(out, sample[k][0], sample[k][1])
            return np.sqrt(out / (sizes[k] + weight))

        seeds, alike = [], []
        near = np.full(len(sample), -1.0)
        while len(seeds) < states and near.min() < 1 - 1e-9:
            seeds.append(int(near.argmin()))
            seed = smoothed(seeds[-1])
            alike.append(np.array([seed @ smoothed(k) for k in range(len(sample))]))
            near = np.maximum(near, alike[-1])
        own = np.argmax(alike, axis=0)
        for s in range(len(seeds)):
            mass = np.zeros(len(prior))
            for k in np.flatnonzero(own == s).tolist():
                np.add.at(mass, sample[k][0], sample[k][1] / sizes[k])
            emit[:, s] = 0.5 * prior + 0.5 * mass / mass.sum()
    return Hmm(start, move, emit / emit.sum(axis=0))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(s, return_counts=True) for s in _sequences(batch)]
        lengths = [len(k) for k, _ in found]
        lists = [flat_list(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]).astype(np.int64), lengths, pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns(batch, "__key"), *lists], ["text", "class", "n"])


def _sample(sequences: DataFrame, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes, counts) of ``rows`` different texts: those of the least hashes, each once however many copies it has."""
    texts = hash_sample(sequences.select("classes"), F.xxhash64("classes"), rows).dropDuplicates(["__key"])
    found = texts.mapInArrow(_class_counts, "text long, class array<long>, n array<long>").orderBy("text").limit(rows).toArrow()
    return [(np.array(k), np.array(n, np.float64)) for k, n in zip(found["class"].to_pylist(), found["n"].to_pylist(), strict=True)]


def train(sequences: DataFrame, prior: np.ndarray, *, states: int, rounds: int, sample_rows: int, weight: float = 50.0) -> tuple[Hmm, list[float]]:
    """Baum-Welch over ``sequences(classes)``: the model, and the log10 likelihood before each round.

    ``weight`` is the prior's share in each state's emissions.
    """
    context = sequences.sparkSession.sparkContext
    model, likelihoods = _first_states(_sample(sequences, sample_rows), prior, states), []
    for _ in range(rounds):
        shared = context.broadcast(model)
        sums = sequences.select("classes").mapInArrow(_expected(shared), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
        shared.unpersist()
        k, x = (sums[c].to_numpy() for c in ("k", "x"))
        likelihoods.append(float(x[k < 0].sum()))
        flat = np.zeros(states + states * states + states * len(prior))
        flat[k[k >= 0]] = x[k >= 0]
        if not flat.any():
            break
        start, move, emit = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(-1, states)
        start, move, emit = start + 1, move + 1, emit + weight * prior[:, None]
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model, likelihoods


def _likelihood(model):
    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Hmm = model.value
        names = ("rid", "doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "own_log", "class_log")
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for rows, block, lengths in _blocks(_sequences(batch)):
                score[rows] = own.forward(block, lengths, False)[0]
            yield pa.RecordBatch.from_arrays([*columns(batch, *names), pa.array(score)], [*names, "class_score"])

    return likelihood


def hmm_scores(docs: DataFrame, *, states: int = 8, rounds: int = 3, own: float = 4.0, suffixes: float = 2.0, hot: int = 200_000, sample_rows: int = 512, report: list[float] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``own`` and ``suffixes`` times the square root of the number of different training words are the numbers of
    the two kinds of classes. The log10 likelihood of the training texts' classes before each round is put
    into ``report``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", _held_out().alias("held_out"), "text")
    training = rows.filter(~F.col("held_out"))
    counts = materialize(training.select("text").mapInArrow(_word_counts, _COUNTED).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    ends = training.count()
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    types, tokens = distinct + (ends > 0), total + ends

    top = sorted(most_frequent(counts, hot).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    words = {bytes(r["word"]): k for k, r in enumerate(top)}
    number = np.array([r["n"] for r in top], np.float64)
    n_own, n_shared = (int(x * types**0.5) + 1 for x in (own, suffixes))
    n_own = min(n_own, len(top))
    class_of = np.array([k if k < n_own else suffix_class(w, n_own, n_shared) for w, k in words.items()], np.int64)
    weights = np.ones(n_shared)  # the slot of unseen words
    for k, w in counts.mapInArrow(_class_weights(frozenset(list(words)[:n_own]), n_own, n_shared), "k long, w double").groupBy("k").agg(F.sum("w").alias("w")).collect():
        weights[k] += w
    prior = np.concatenate([number[:n_own], weights, [ends + 1.0]])
    vocabulary = Vocabulary(words, np.log10(number + 1), class_of, n_own, n_shared, float(np.log10(ends + 1)), np.log10(weights))
    read = materialize(rows.mapInArrow(_read(spark.sparkContext.broadcast(vocabulary)), _READ), "sequences")
    model, likelihoods = train(read.filter(~F.col("held_out")).select("classes"), prior / prior.sum(), states=states, rounds=rounds, sample_rows=sample_rows)
    if report is not None:
        report += likelihoods

    rare = read.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    seen = materialize(rare.join(counts, "word").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_log"), F.sum(F.col("times").cast("long")).alias("rare_known")), "rare-words")
    scored = materialize(read.mapInArrow(_likelihood(spark.sparkContext.broadcast(model)), "rid long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_log double, own_log double, class_log double, class_score double"), "class-scores")
    discard(counts, read)
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("hot_log") + F.lit(vocabulary.end_log) + rare_log - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))
    score = F.col("class_score") + F.col("hot_log") - F.col("own_log") + rare_log - F.col("class_log")
    known = F.col("n_hot") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))
    return scored.join(seen, "rid", "left").select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
