"""Every stage against a plain version of what it promises, on the rows the stage before it kept."""

import hashlib
from collections import Counter

import numpy as np
from tests.llm.brute import brute_components, brute_taken

import corpus_pipeline
from tickloom.llm import langid, pii
from tickloom.llm.bpe import loaded


def test_stages_follow_from_each_other(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    step = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        step[name] = now.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    first = docs.toPandas()
    model = langid.train(langid.sample(docs))
    p, known = model.scores(first.text.tolist())
    kept = (p.max(1) >= model.threshold) & (known >= model.seen_threshold) & first.text.map(langid.has_letter)
    assert set(step["language_id"].doc_id) == set(first.doc_id[kept]) and len(step["language_id"]) >= 0.98 * len(first)
    rows = list(zip(step["language_id"].doc_id, step["language_id"].text, strict=True))
    assert sorted(step["jaccard_join"].doc_id) == sorted(d for d, n, c in brute_components(rows, 5, 80) if d == c)
    before = step["jaccard_join"].set_index("doc_id").text
    after = step["pii_pseudonyms"].set_index("doc_id").text
    assert {d: pii.pseudonymise(t)[0] for d, t in before.items()} == after.to_dict()
    taken = brute_taken(step["pii_pseudonyms"])
    mixed = step["mix_sources"]
    got = Counter()
    for d, t in zip(mixed.doc_id, mixed.text, strict=True):
        got[d] += len(t.encode().split())
    assert got == Counter({d: n for d, n in taken.items() if n})
    bpe = loaded("byte_bpe_50k.tiktoken")
    want = Counter((d, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in zip(mixed.doc_id, mixed.text, strict=True) for x in bpe.encode([t]))
    assert want == Counter(zip(step["byte_bpe"].doc_id, step["byte_bpe"].ids_sha256, step["byte_bpe"].decoded_sha256, strict=True))
    assert all(len(x) == 4 * n for x, n in zip(step["byte_bpe"].ids, step["byte_bpe"].n_tokens, strict=True))
    assert corpus_pipeline.run(spark, sf).count() == len(mixed) and np.all(step["byte_bpe"].n_tokens > 0)
