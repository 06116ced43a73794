"""Every stage on nulls, empty texts, repeated rows, clashing names and an empty table; language ID against a plain sum."""

import numpy as np
import pytest

import corpus_pipeline
from tickloom.llm import langid

CLASHES = ("file", "row", "c0", "c1", "score", "rejected", "lang_pred", "sid", "cid", "size", "words", "shard", "place", "draws", "pass", "digest", "number", "n_tokens", "n_ip", "ids")


def _docs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, None, None, None, None), (None, "a b c", "en", None, 5), (90_001, "", "en", "", 0), (90_002, "x y z", None, "s", 5), (90_002, "x y z", None, "s", 5)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    return docs.selectExpr("*", *[f"n_chars AS {c}" for c in CLASHES])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = _docs(spark)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert len(rows) > 100 and all(r.score == r.file == r.shard for r in rows)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_last_stage_on_odd_rows(spark):
    name, stage = corpus_pipeline.STAGES[-1]
    docs = _docs(spark).drop("ids", "n_tokens")
    assert stage(spark, docs, "").count() == docs.count() and stage(spark, docs.limit(0), "").count() == 0


def test_predictions_against_a_plain_sum(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL").collect()]
    model = langid.train(rows)
    texts = [t for t, _ in rows[:40]] + ["é", "abc", "a" * 5000]
    p, known = model.scores(texts)
    for i, t in enumerate(texts):
        data = b" " + t.lower().encode().translate(langid._FOLD) + b" "
        want, n, seen = np.zeros(len(model.langs)), 0, 0
        for order in langid.ORDERS:
            for k in range(len(data) - order + 1):
                g = data[k : k + order]
                if b" " in g[1:-1] or g[:1] == g[-1:] == b" ":
                    continue
                b = (int.from_bytes(g, "big") * langid.MULTIPLIERS[order] & 0xFFFFFFFF) >> (32 - langid.BITS)
                want, n, seen = want + model.table[b], n + 1, seen + int(model.seen[b])
        z = (want / langid.UNIT / n + model.bias) / model.temperature
        z = np.exp(z - z.max())
        assert np.allclose(p[i], z / z.sum(), atol=1e-9) and abs(known[i] - seen / n) < 1e-12
    assert (model.scores(texts[3:9])[0] == p[3:9]).all()
