"""Operators of the subpackage against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rasterloom.llm.exact_dedup import exact_dedup, keep_first
from rasterloom.llm.hmm_score import hmm_scores
from rasterloom.llm.jaccard_join import keep_one_of_each, similar_classes
from rasterloom.llm.language_id import identify_language
from rasterloom.llm.multi_index import nearest_neighbours, recall
from rasterloom.llm.packing import best_fit_packing, default_cost, pack, packed_sequences
from rasterloom.llm.sentencepiece_codec import codec, decoded, encoded, piece_digests
from rasterloom.llm.span_dedup import remove_repeats, sentences, span_dedup
from rasterloom.llm.token_counts import token_counts
from rasterloom.llm.toxicity import drop_toxic, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, row string, digest string, piece long, ranges string, __id long"
SMALL = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "r", "d", 2, "x", 3) for i, t in rows], DOCS).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def edge_rows():
    long = words(random.Random(0), 30_000, 5000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four five six."), (5, "One two three four five six."), (5, "One two three four five six."), (6, long), (7, long + " end"), (None, "One two three four five six."), (None, None), (8, "Ünïcode 日本語 🎉 <|endoftext|> ▁ x\x00y"), (9, "One  two three\nfour five six."), (10, "!!! 123"), (-20, "x" * 5000)]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("options", [{}, {"digest_hex": 4, "memtable_rows": 7, "buckets": 5}])
def test_exact_dedup(spark, edge_rows, options):
    rng = random.Random(1)
    rows = edge_rows + [(100 + k, rng.choice(["a b", "ab", "a  b", "c", "cc", "d" * rng.randrange(1, 400)])) for k in range(600)]
    got = exact_dedup(frame(spark, rows), **options).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows)
    kept = Counter()
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        group = by[r.text_sha256]
        best = min(group)
        assert r.group_size == len(group) and r.keep_id == (None if best[1] else best[2])
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    stay = keep_first(frame(spark, rows), **options)
    assert stay.count() == len(groups) and stay.columns == frame(spark, rows).columns


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).collect() == []
    assert keep_first(frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op8_jaccard_join"])
def test_oracles(spark, name):
    import duckdb

    from rasterloom.llm import queries

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.execute(queries.ORACLES[name]).fetchdf().to_dict("records")
    assert Counter(tuple(r.asDict()[c] for c in sorted(got.columns)) for r in got.collect()) == Counter(tuple(r[c] for c in sorted(r)) for r in want)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    name = {c: min((i for i in m if i is not None), default=None) for c, m in members.items()}
    return Counter((rows[k][0], len(sets[k]), name[find(k)]) for k in range(len(rows)))


def test_jaccard_join(spark, edge_rows):
    rng = random.Random(2)
    rows = list(edge_rows)
    common = words(rng, 60)
    for k in range(60):
        base = words(rng, rng.choice([3, 5, 8, 12, 30, 80, 200]), 100_000).split()
        if k % 3 == 0:
            base += common.split()
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((1000 + len(rows), " ".join(copy[rng.randrange(2) :])))
    got = Counter(map(tuple, similar_classes(frame(spark, rows)).collect()))
    assert got == brute_classes(rows)


def test_jaccard_join_of_large_buckets(spark, monkeypatch):
    """A chain of near copies: neighbours link, ends don't; blocks smaller than the buckets."""
    from rasterloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "_BLOCK", 8)
    rng = random.Random(3)
    text = words(rng, 120, 100_000).split()
    rows = []
    for k in range(60):
        text[rng.randrange(len(text))] = f"step{k}"
        rows.append((k, " ".join(text)))
    rng.shuffle(rows)
    assert Counter(map(tuple, similar_classes(frame(spark, rows)).collect())) == brute_classes(rows)


def test_keep_one_of_each(spark, edge_rows):
    stay = keep_one_of_each(frame(spark, edge_rows))
    assert stay.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == [-20, 1, 2, 3, 4, 6, 8, 10]
    assert similar_classes(frame(spark, [])).collect() == []


def test_keep_one_of_each_by_row(spark):
    """Near copies go even where another text has their id; equal rows leave one."""
    rng = random.Random(8)
    a, c, d = (words(rng, 200, 100_000).split() for _ in range(3))
    near = [" ".join([*a[:k], f"x{k}", *a[k + 1 :]]) for k in (10, 40, 70)]
    rows = [(3, near[0]), (5, near[1]), (5, " ".join(c)), (None, near[2]), (None, " ".join(d)), (3, near[0]), (9, None), (9, None)]
    stay = keep_one_of_each(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in stay) == Counter([(3, near[0]), (5, " ".join(c)), (None, " ".join(d)), (9, None), (9, None)])
    got = keep_first(frame(spark, [(1, "a b"), (1, "ab "), (1, "a b"), (1, "c"), (2, "a b"), (None, "c"), (None, None), (None, None)])).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "a b"), (1, "c"), (None, None)]) or Counter((r.doc_id, r.text) for r in got) == Counter([(1, "ab "), (1, "c"), (None, None)])


def test_span_dedup_removes_later_passages(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(n) for n in (12, 3, 26, 2, 9, 4))
    one = sentence(60)
    docs = {k: [sentence(rng.randrange(3, 12)) for _ in range(12)] for k in range(40)}
    clean = {k: " ".join(v) for k, v in docs.items()}
    rows = []
    for k, parts in docs.items():
        middle = {0: passage, 1: one}.get(k % 4, "")
        rows.append((k, " ".join(filter(None, [*parts[:6], middle, *parts[6:]]))))
    got = {r.doc_id: r for r in span_dedup(frame(spark, rows)).collect()}
    for k, text in rows:
        if k in (0, 1) or k % 4 > 1:
            assert got[k].text == text and got[k].n_removed == 0
        elif k % 4 == 0:
            assert got[k].text == clean[k]
        else:
            left = len(set(got[k].text.split()) & set(one.split()))
            assert left <= 20


def brute_spans(rows, min_sentences=2, min_words=20):
    docs = []
    for i, t in rows:
        raw = (t or "").encode()
        starts, counts, digests = sentences(raw) if raw else ([], [], [])
        docs.append(((i is None, i or 0), raw, [*starts, len(raw)], counts, digests))
    first = {}
    runs = []
    for place, raw, starts, counts, digests in docs:
        n, found = len(counts), set()
        for a in range(n):
            for b in range(a + min_sentences, n + 1):
                if sum(counts[a:b]) >= min_words:
                    found.add((a, b))
                    break
            for c in range(a + 1 - min_sentences, -1, -1):
                if sum(counts[c : a + 1]) >= min_words:
                    found.add((c, a + 1))
                    break
        runs.append(found)
        for a, b in found:
            key = tuple(digests[a:b])
            first[key] = min(first.get(key, (place, a)), (place, a))
    out = Counter()
    for (place, raw, starts, counts, digests), found in zip(docs, runs):
        gone = set()
        for a, b in found:
            if first[tuple(digests[a:b])] != (place, a):
                gone.update(range(a, b))
        text = b"".join(raw[starts[k] : starts[k + 1]] for k in range(len(counts)) if k not in gone).decode()
        out[None if place[0] else place[1], text, len(counts), len(gone)] += 1
    return out


def test_span_dedup(spark):
    rng = random.Random(5)
    pool = [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) + rng.choice([". ", "! ", "\n", ".\n\n"]) for _ in range(40)]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for k in range(120)]
    rows += [(500, rows[3][1]), (501, "No end " * 300), (None, rows[5][1]), (502, "")]
    got = Counter((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in span_dedup(frame(spark, rows)).collect())
    assert got == brute_spans(rows)


def test_span_dedup_of_unaligned_passages(spark):
    """Passages of 51 words that begin and end within sentences, against the words of the later texts' own."""
    rng = random.Random(8)

    def prose(n):
        return " ".join(f"u{rng.randrange(10**7)}" + rng.choice([""] * 14 + [".", ","]) for _ in range(n)).split()

    rows, own = [], {}
    for k in range(60):
        passage = prose(51)
        for doc in (k, 1000 + k):
            before, after = prose(60), prose(60)
            rows.append((doc, " ".join([*before, *passage, *after])))
            own[doc] = before, passage, after
    got = {r.doc_id: r.text for r in span_dedup(frame(spark, rows)).collect()}
    for doc, text in rows:
        before, passage, after = own[doc]
        if doc < 1000:
            assert got[doc] == text
        else:
            left = got[doc].split()
            assert left[: len(before)] == before and left[-len(after) :] == after
            assert len(left) - len(before) - len(after) <= 11


def test_units_are_short_and_local():
    rng = random.Random(9)
    passage = words(rng, 200, 10**6)
    cuts = []
    for _ in range(20):
        before, after = words(rng, 50, 10**6) + " ", " " + words(rng, 50, 10**6)
        starts, counts, digests = sentences((before + passage + after).encode())
        assert max(counts) <= 6 and len(starts) == len(counts) == len(digests)
        cuts.append({x - len(before) for x in starts if 0 <= x - len(before) < len(passage)})
    inner = passage.split(" ")
    low, high = len(" ".join(inner[:6])) + 1, len(" ".join(inner[:-5]))
    assert len({frozenset(x for x in c if low <= x <= high) for c in cuts}) == 1
    assert sentences(b" \n ") == ([0], [0], sentences(b" ")[2]) and sentences(b"") == ([], [], [])


def test_span_dedup_edges(spark, edge_rows):
    got = span_dedup(frame(spark, edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert Counter(r.text for r in got)[None] == 2
    kept = remove_repeats(frame(spark, edge_rows))
    assert kept.columns == frame(spark, []).columns and kept.count() == len(edge_rows)
    assert span_dedup(frame(spark, [])).collect() == []
    twice = [(1, "A b c d e f g h i j k l. m n o p q r s t u v w x y z."), (1, "A b c d e f g h i j k l. m n o p q r s t u v w x y z.")]
    assert [r.n_removed for r in span_dedup(frame(spark, twice)).collect()] == [0, 0]


def test_packing(spark, edge_rows, real):
    for docs, n in ((frame(spark, edge_rows), len(edge_rows)), (real, real.count())):
        rows = best_fit_packing(docs, group_pieces=50).collect()
        lengths = Counter()
        bins = {}
        for r in rows:
            lengths[r.doc_id] += r.length
            bins.setdefault((r.bin_group, r.bin), []).append(r)
        assert sum(1 for r in rows if r.piece == 0) == n
        expected = Counter()
        for d in docs.collect():
            expected[d.doc_id] += len((d.text or "").encode().lower().split()) + 1
        assert lengths == expected
        for own in bins.values():
            own.sort(key=lambda r: r.position)
            at = 0
            for r in own:
                assert r.position == at
                at += r.length
            assert at <= own[0].capacity and len({r.capacity for r in own}) == 1
            assert own[0].capacity == min(c for c in (512, 1024, 2048) if c >= at)
    assert best_fit_packing(frame(spark, [])).collect() == []


def plain_best_fit(lengths, capacities, cost):
    """Best fit by looking at every open bin: the fullest that fits, of like ones the one changed last."""
    best = None
    for least in capacities:
        bins, left, places = [], sum(lengths), []  # a bin: size, filled, last change
        for now, n in enumerate(lengths):
            fitting = [k for k, (size, filled, _) in enumerate(bins) if size - filled >= n]
            if fitting:
                k = min(fitting, key=lambda k: (bins[k][0] - bins[k][1], -bins[k][2]))
            else:
                bins.append([min((c for c in capacities if c >= max(n, least)), key=lambda c: (cost(c) / min(c, left), c)), 0, now])
                k = len(bins) - 1
            places.append((k, bins[k][1]))
            bins[k][1:] = bins[k][1] + n, now
            left -= n
        sizes = [min((c for c in capacities if c >= filled), key=lambda c: (cost(c), c)) for _, filled, _ in bins]
        if best is None or sum(map(cost, sizes)) < best[0]:
            best = sum(map(cost, sizes)), places, sizes
    return [(k, best[2][k], at) for k, at in best[1]]


def test_pack_is_plain_best_fit():
    import numpy as np

    rng = random.Random(9)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(1, 120))), reverse=True)
        bins, capacity, position = pack(np.array(lengths), (16, 32, 64))
        assert list(zip(bins.tolist(), capacity.tolist(), position.tolist())) == plain_best_fit(lengths, (16, 32, 64), default_cost)


def test_packed_sequences(spark, edge_rows, real):
    """Each document's ids, put together again from the sequences, are those that it is encoded to."""
    rows = [(r.doc_id, r.text) for r in real.collect()] + [(1000 + k, t) for k, (_, t) in enumerate(edge_rows)]
    docs = frame(spark, rows)
    found = {}
    for r in packed_sequences(docs, PIECES, capacities=(64, 128, 256), group_pieces=100).collect():
        ends = [*r.positions[1:], len(r.ids)]
        assert r.positions[0] == 0 and len(r.ids) <= r.capacity and r.capacity in (64, 128, 256)
        assert min([c for c in (64, 128, 256) if c >= len(r.ids)], key=default_cost) == r.capacity
        for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.positions, ends, strict=True):
            assert start == 256 * piece
            found.setdefault(doc, {})[piece] = r.ids[a:b]
    want = {r.doc_id: list(r.ids) for r in encoded(docs, PIECES).collect()}
    assert {d: [x for k in sorted(p) for x in p[k]] for d, p in found.items()} == want
    assert sum(r.length for r in best_fit_packing(docs, length=F.lit(300)).collect()) == 300 * len(rows)
    assert packed_sequences(frame(spark, []), PIECES).collect() == []


def test_pack_is_no_dearer_than_one_length():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 2049, 300))[::-1]
        bins, capacity, _ = pack(lengths, (512, 1024, 2048))
        cost = sum(default_cost(int(capacity[bins == b][0])) for b in set(bins.tolist()))
        single, one, _ = pack(lengths, (2048,))
        assert cost <= len(set(single.tolist())) * default_cost(2048)
        assert lengths.sum() <= sum(int(capacity[bins == b][0]) for b in set(bins.tolist()))


def test_sentencepiece(spark, edge_rows, real):
    lib = codec(PIECES).library
    rows = [(r.doc_id, r.text) for r in real.collect()] + edge_rows
    got = Counter(map(tuple, piece_digests(frame(spark, rows), PIECES).collect()))
    expected = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        expected[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert got == expected
    back = decoded(encoded(frame(spark, edge_rows), PIECES), PIECES).collect()
    assert Counter(r.text for r in back) == Counter(lib.decode(lib.encode(t or "")) for _, t in edge_rows)
    assert piece_digests(frame(spark, []), PIECES).collect() == []


def test_merging_many_runs_is_merging_each():
    own, rng = codec(PIECES), random.Random(6)
    runs = {"".join(rng.choice("▁abcdeinorstéß日\n.") for _ in range(rng.randrange(1, 70))) for _ in range(2000)}
    for front in ("", "▁"):
        many = own.merge_many(runs, front)
        assert all(memoryview(many[r]).cast("I").tolist() == own.merge(front + r) for r in runs)


def test_sentencepiece_of_odd_texts():
    own, rng = codec(PIECES), random.Random(16)
    texts = ["", " ", "  ", "a  b", " a", "a ", "▁", "a▁ b", "...", "a.,;:!", "é.", "日本. 語,", "x\x00.", "don't.", "«a».", "tab\t.\n."]
    texts += ["".join(rng.choice("ab é.,!▁ \n日-'") for _ in range(rng.randrange(40))) for _ in range(3000)]
    many = own.encode_many(texts)
    own.check(texts, many, [own.decode_raw(x) for x in many])


def test_sentencepiece_difference_is_an_error():
    own = codec(PIECES)
    with pytest.raises(ValueError):
        own.check(["abc"], [own.encode("abd")], ["abc"])


def test_sentencepiece_checks_every_text(monkeypatch):
    """A difference in any text of a part is an error, not only in its first."""
    import pyarrow as pa

    from rasterloom.llm.sentencepiece_codec import PieceCodec, _encode

    right, other = PieceCodec.encode_many, codec(PIECES).encode("other")
    monkeypatch.setattr(PieceCodec, "encode_many", lambda self, texts: [*right(self, texts)[:-1], other])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["one", "two", "three"])], ["doc_id", "text"])
    with pytest.raises(ValueError):
        list(_encode(PIECES)(iter([batch])))


def test_token_counts(spark, edge_rows, real):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    rows = [(r.doc_id, r.text) for r in real.collect()] + edge_rows + [(901, "x" * 200_000 + " end"), (902, "ab" * 70_000), (900, "a֋b քx՘ \U0001df90 don't  <|endoftext|>\x1c y\u0085z")]
    got = Counter(map(tuple, token_counts(frame(spark, rows), BYTES, hot=500, summary=100).collect()))
    expected = Counter()
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        expected[i, len((t or "").encode()), n, n > 1024] += 1
    assert got == expected
    assert token_counts(frame(spark, []), BYTES).collect() == []


def test_language_id(spark, edge_rows, real):
    got = {r.doc_id: r for r in identify_language(real).collect()}
    truth = {r.doc_id: r.lang for r in real.collect()}
    held = [k for k, r in got.items() if r.held_out]
    assert all((zlib.crc32(str(k).encode()) % 4 == 2) == r.held_out for k, r in got.items())
    assert sum(got[k].lang_pred == truth[k] for k in held) / len(held) > 0.85
    edge = identify_language(frame(spark, edge_rows)).collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 for r in edge)
    assert {r.lang_pred for r in edge if r.doc_id in (1, 2, 3, 10)} == {"und"}
    assert identify_language(frame(spark, [])).collect() == []
    assert {r.lang_pred for r in identify_language(frame(spark, edge_rows).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_dictionaries_and_sizes(spark, real):
    """Dictionaries from plain counts, and every answer from compressing each text with each dictionary."""
    import zstandard

    from rasterloom.llm.language_id import learn_dictionaries

    made = learn_dictionaries(real)
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower()).strip()
    texts = {}
    for r in real.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            texts.setdefault(r.lang, set()).add(r.text)
    assert set(made) == set(texts)
    for lang, own in texts.items():
        found = Counter(w.encode() for t in own for w in set(plain(t).split()))
        words = sorted((w for w, n in found.items() if n > 1 or len(own) < 8), key=lambda w: (-found[w], w))
        whole = b" ".join(reversed(words))
        assert whole.endswith(made[lang]) and (made[lang] == whole or 112_640 - 200 < len(made[lang]) <= 112_640)
    coders = [(rank, lang, zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for rank, (lang, raw) in enumerate(made.items())]
    got = {r.doc_id: r for r in identify_language(real).collect()}
    for r in real.collect():
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        sizes = sorted((len(c.compress(plain(r.text).encode())), rank, lang) for rank, lang, c in coders)
        margin = 1 - sizes[0][0] / sizes[1][0]
        assert got[r.doc_id].lang_pred == sizes[0][2] and got[r.doc_id].rejected == (margin < 0.01)
        assert abs(got[r.doc_id].score - margin / (margin + 0.01)) < 1e-12


def test_language_of_repeated_ids(spark):
    """An id that many rows repeat counts once, in the sample and in the dictionary."""
    from rasterloom.llm.language_id import learn_dictionaries

    rows = [(1, f"uno dos tres {'cuatro' if k == 7 else ''}", "es") for k in range(500)] + [(k, f"one two three {k}", "en") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn_dictionaries(docs) == {"es": b"uno tres dos", "en": b"two three one"}


@pytest.mark.parametrize(("scale", "options"), [("sf0.001", {"block_rows": 64, "block_queries": 8}), ("sf0.01", {}), ("sf0.1", {})])
def test_multi_index(spark, scale, options):
    vectors = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    found = nearest_neighbours(vectors, **options).cache()
    assert found.count() == 20 * vectors.filter("vec_id % 20 = 0").count()
    assert recall(found, vectors) >= 0.9


def test_multi_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (40, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    rows += [(k, [1.0, 0.0]) for k in range(101, 400, 2)]
    vectors = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, cell int, score double")
    got = {}
    for r in nearest_neighbours(vectors, k=4, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    twice = [(1, 0, 1.0)] + [(k + 2, 101 + 2 * k, 1.0) for k in range(3)]  # rows that repeat an id find each other
    assert got == {0: sorted(twice * 2), 20: [(1, 0, 0.5), (2, 0, 0.5), (3, 101, 0.5), (4, 103, 0.5)]}
    assert nearest_neighbours(vectors.limit(0)).collect() == []
    one = spark.createDataFrame([(k, [float(k % 50 + 1)]) for k in range(100)], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest_neighbours(one, k=3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 49, 50.0), (0, 2, 99, 50.0), (0, 3, 48, 49.0)] and len(got) == 15
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest_neighbours(few).collect()] == [(0, 1, 1, 4.0)]


def test_multi_index_of_mostly_equal_vectors(spark):
    """Every query gets 20 rows, those of the brute force, although nearly all vectors are one."""
    import numpy as np

    rng = np.random.default_rng(3)
    same = rng.normal(size=8)
    vectors = [same if k % 100 else rng.normal(size=8) for k in range(4000)]
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(frame).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = np.array(vectors)
    found = 0
    for q in range(0, 4000, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(4000), -score))[:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(got[q][n][1] == (x[got[q][n][0]] * x[q]).sum() for n in got[q])
        found += len({v for v, _ in got[q].values()} & set(best.tolist()))
    assert found >= 0.9 * 20 * 200


def test_toxicity(spark, edge_rows):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    english = {r.doc_id for r in docs.filter("lang = 'en'").collect()}
    held = [k for k in truth if k in got and got[k].held_out and k in english]
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) == r.held_out for k, r in got.items())
    assert sum(got[k].predicted == truth[k] for k in held) / len(held) > 0.95
    stay = drop_toxic(docs, labels)
    assert stay.count() == sum(r.predicted == 0 for r in got.values()) and stay.columns == docs.columns
    edge = toxicity(frame(spark, edge_rows), labels).collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in edge)
    nothing = labels.limit(0)
    assert {r.score for r in toxicity(frame(spark, edge_rows), nothing).collect()} == {0.0}
    assert toxicity(frame(spark, []), labels).collect() == []
    assert drop_toxic(frame(spark, edge_rows), nothing).count() == len(edge_rows)


def test_trees_against_a_plain_walk():
    """Raw scores by walking each tree node by node, calibration by hand."""
    import numpy as np

    from rasterloom.llm.toxicity import BoostedTrees, ToxicityModel

    rng = np.random.default_rng(1)
    x = rng.random((400, 4)).astype(np.float32)
    x[:, 3] = x[:, 3] > 0.9
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 3] > 0)).astype(float)
    model = ToxicityModel.fit(x, y)
    trees: BoostedTrees = model.trees
    for row in x[:50]:
        raw = trees.base
        for feature, cut, value in trees.trees:
            node = 1
            while feature[node] >= 0:
                k = feature[node]
                place = sum(1 for e in trees.edges[k] if e <= row[k])
                node = 2 * node + (place > cut[node])
            raw += value[node]
        assert abs(raw - trees.raw(row[None])[0]) < 1e-9
        right = next((i for i, a in enumerate(model.at) if a >= raw), len(model.at))
        if right in (0, len(model.at)):
            want = model.rate[min(right, len(model.at) - 1)]
        else:
            share = (raw - model.at[right - 1]) / (model.at[right] - model.at[right - 1])
            want = model.rate[right - 1] + share * (model.rate[right] - model.rate[right - 1])
        assert abs(model.score(row[None])[0] - want) < 1e-9
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.97 and all(a <= b for a, b in zip(model.rate, model.rate[1:]))


def test_toxicity_of_repeated_ids(spark):
    """Rows that repeat a labelled id are learnt from once, and scored each alike."""
    rng = random.Random(11)
    rows = [(k, ("you idiot moron trash " if k % 2 else "") + words(rng, 30)) for k in range(1, 400)]
    rows += [(1, rows[0][1])] * 300 + [(None, rows[0][1])]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 400)] + [(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.doc_id or 1) % 2 for r in got)


def test_hmm_base_and_counts(spark, edge_rows, real):
    rows = [(r.doc_id, r.text) for r in real.collect()] + edge_rows
    got = hmm_scores(frame(spark, rows), own=0.5, suffixes=0.3, hot=200, rounds=2).collect()
    counts, texts = Counter(), []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        held = i is None or zlib.crc32(str(i).encode()) % 7 == 2
        texts.append((i, held, w))
        if not held:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    rounded = lambda x: float(f"{x:.8g}")
    expected = Counter((i, held, len(w), sum(counts[x] > 0 for x in w), total, rounded(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))) for i, held, w in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, rounded(r.base_score)) for r in got) == expected
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_edges(spark, edge_rows):
    assert hmm_scores(frame(spark, [])).collect() == []
    untrained = hmm_scores(frame(spark, [(None, "a b"), (None, None)])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in untrained} == {(3, 0, 0), (1, 0, 0)}
    assert all(math.isfinite(r.score) for r in hmm_scores(frame(spark, edge_rows)).collect())


@pytest.mark.parametrize("others", [0, 3, 7, 40])
def test_hmm_of_many_copies(spark, others):
    """Copies of one long text start one state, however they fill the sample by rows."""
    rng = random.Random(7)
    copied = words(rng, 30)
    rows = [(k, copied) for k in range(20)] + [(100 + k, words(rng, 30)) for k in range(others)]
    got = hmm_scores(frame(spark, rows), sample_rows=16).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)


def test_hmm_sample_and_first_states(spark):
    import numpy as np

    from rasterloom.llm.hmm_score import _first_states, _sample

    texts = [np.full(30, 1, np.uint32)] * 200 + [np.array([k % 5, k, 9], np.uint32) for k in range(9)]
    table = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "classes binary")
    assert len({(tuple(k), tuple(n)) for k, n in _sample(table, 10)}) == len(_sample(table, 10)) == 10
    prior = np.full(10, 0.1)
    counts = [np.unique(t, return_counts=True) for t in texts]
    for sample in (counts[:20], counts[200:], counts[200:203], []):
        emit = _first_states(sample, prior, 8).emit
        assert np.isfinite(emit).all() and np.allclose(emit.sum(axis=0), 1)
        assert all(abs(emit[:, a] - emit[:, b]).max() > 1e-3 for a in range(8) for b in range(a))


def test_hmm_score_by_hand(spark, real, monkeypatch):
    """Scores recomputed text by text from the trained states, and a likelihood that rises by round."""
    import numpy as np

    from rasterloom.llm import hmm_score

    kept, report = {}, []
    trained = hmm_score.train
    monkeypatch.setattr(hmm_score, "train", lambda *a, **o: kept.setdefault("model", trained(*a, **o)))
    rows = [(r.doc_id, r.text) for r in real.collect()]
    got = {r.doc_id: r.score for r in hmm_scores(frame(spark, rows), rounds=4, hot=300, report=report).collect()}
    assert len(report) == 4 and all(a < b for a, b in zip(report, report[1:]))
    model = kept["model"][0]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in (t or "").encode().lower().split())
    n_shared = int(2 * (len(counts) + 1) ** 0.5) + 1
    n_own = len(model.emit) - n_shared - 1
    own = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:n_own])}
    weight = np.ones(n_shared)
    for w, c in counts.items():
        if w not in own:
            weight[zlib.crc32(w[-3:]) % n_shared] += c + 1
    for i, t in rows[:60]:
        alpha, total = None, 0.0
        for w in [*(t or "").encode().lower().split(), None]:
            share = 1.0
            if w is None:
                k = len(model.emit) - 1
            elif w in own:
                k = own[w]
            else:
                slot = zlib.crc32(w[-3:]) % n_shared
                k, share = n_own + slot, (counts[w] + 1) / weight[slot]
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[k]
            total += math.log10(alpha.sum()) + math.log10(share)
            alpha = alpha / alpha.sum()
        assert abs(total - got[i]) < 1e-6 * max(1, abs(total)), i


def test_forward_is_the_sum_over_all_paths():
    import itertools

    import numpy as np

    from rasterloom.llm.hmm_score import Hmm, _blocks

    rng = np.random.default_rng(0)
    model = Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 5, 5, 3)]
    for places, block, lengths in _blocks(sequences):
        for k, score in zip(places, model.forward(block, lengths, False)[0]):
            s, total = sequences[k], 0.0
            for path in itertools.product(range(3), repeat=len(s)):
                p = model.start[path[0]] * model.emit[s[0], path[0]]
                for t in range(1, len(s)):
                    p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
                total += p
            assert abs(score - math.log10(total)) < 1e-9
    into = Hmm(np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
    for _, block, lengths in _blocks(sequences):
        model.expect(block, lengths, into)
    assert abs(into.emit.sum() - sum(map(len, sequences))) < 1e-9 and abs(into.start.sum() - 5) < 1e-9
    assert abs(into.move.sum() - sum(len(s) - 1 for s in sequences)) < 1e-9


def test_remove_repeats_passes_to_python_repeats_only(spark):
    """Texts without repeats, and other columns, stay in the JVM; others are cut as by ``span_dedup``."""
    rng = random.Random(12)
    pool = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + ". " for _ in range(30)]
    rows = [(k, "".join(rng.sample(pool, 3))) for k in range(40)] + [(50, None), (51, ""), (52, "é 中 once"), (None, pool[0] * 3)]
    docs = frame(spark, rows).withColumns({"ranges": F.lit("own"), "row": F.col("doc_id") + 1})
    kept = remove_repeats(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    got = kept.collect()
    assert kept.columns == docs.columns and {r.ranges for r in got} == {"own"}
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in span_dedup(docs).collect())
