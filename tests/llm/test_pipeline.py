"""The pipeline's stages against the operators' brute force, each on its own input."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from rasterloom.llm import queries
from rasterloom.llm.common import table
from rasterloom.llm.sentencepiece_codec import codec

from .test_operators import brute_classes, brute_spans, norm

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "span_dedup", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        before, docs = docs, stage(spark, docs, SMALL)
        if name != "packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    toxic = {i for i, _ in kept["toxicity"]} - {i for i, _ in kept["exact_dedup"]}
    assert len(toxic) < 0.2 * len(kept["toxicity"])
    best = {}
    for i, t in kept["exact_dedup"]:
        best[norm(t)] = min(best.get(norm(t), (0, 1 << 60)), (-len(t), i))
    assert sorted(i for _, i in best.values()) == sorted(i for i, _ in kept["jaccard_join"])
    assert sorted(i for i, _, c in brute_classes(kept["jaccard_join"]) if i == c) == sorted(i for i, _ in kept["span_dedup"])
    assert sorted((i, t) for i, t, _, _ in brute_spans(kept["span_dedup"]).elements()) == sorted(kept["packing"])
    packed = docs.collect()
    lib = codec(public_tokenizers.path("piece_bpe_32k.model")).library
    assert {i for r in packed for i in r.doc_ids} == {i for i, _ in kept["packing"]}
    assert sum(len(r.ids) for r in packed) == sum(len(lib.encode(t, add_bos=True, add_eos=True)) for _, t in kept["packing"])
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter(map(str, whole.collect())) == Counter(map(str, packed))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key1 long, component string, kept string"


def test_stages_of_odd_tables(spark):
    """Null and repeated ids, empty texts and clashing columns go through every stage; so does an empty table."""
    rng = random.Random(5)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (None, a + " end"), (None, None), (2, ""), (2, " "), (None, b), (3, "x " * 5000)]
    for given in (rows, []):
        docs = spark.createDataFrame([(i, t, "en", "s", 1, "r", 7, "c", "k") for i, t in given], COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SMALL)
            if name == "packing":
                assert {i for r in docs.collect() for i in r.doc_ids} == {r.doc_id for r in before.collect()}
            else:
                assert docs.columns == before.columns
                docs = spark.createDataFrame(docs.collect(), docs.schema)
                if name == "jaccard_join" and given:
                    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter([(1, a), (1, b), (2, " "), (3, "x " * 5000)])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
