import math
import re
import zlib
from collections import Counter

import numpy as np

from tickloom.llm import lattice as L


def test_marginal_is_the_sum_over_all_segmentations():
    v = L.loaded()
    index = {p: i for i, p in enumerate(v.pieces)}
    logp = np.log(v.first)

    def brute(word):
        x = b" " + word

        def total(i):
            return 1.0 if i == len(x) else sum(math.exp(logp[index[x[i:j]]]) * total(j) for j in range(i + 1, len(x) + 1) if x[i:j] in index)

        return math.log(total(0)) + logp[-1]

    words = [b"the", b"thntblere", "éreaux".encode(), b"a", "日本".encode(), b"\x00x", "ñ🙂".encode()]
    got = L.Lattices(v, words).marginals(logp)
    assert np.allclose(got, [brute(w) for w in words])
    assert np.isfinite(L.Lattices(v, [b"q" * 5000]).marginals(logp)).all()
    e = L.Lattices(v, words).expected(logp, np.ones(len(words)), v.end + 1)
    used = sum(e[i] * len(v.pieces[i]) for i in range(v.end))
    assert np.isclose(used, sum(len(w) + 1 for w in words))  # every byte is covered once


def test_counts_and_base_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "The the THE zzzqqq"), (1002, "The the THE zzzqqq"), (None, " \n")], docs.schema)
    docs = docs.union(odd)
    rows = [(r.doc_id, [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))]) for r in docs.collect()]
    fold = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5
    c = Counter()
    for d, ws in rows:
        if fold(d) != 1:
            c.update([*ws, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), fold(d) == 1, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 6)) for d, ws in rows)
    got = L.op1_lattice_score(docs).collect()
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    held = [r for r in got if r.held_out]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # the base gives every unseen word one shared class, the model spells it out; known texts tell them apart little
    assert sum(r.score for r in held) > 1.5 * sum(r.base_score for r in held)
    assert L.op1_lattice_score(docs.limit(0)).count() == 0


def test_probabilities_of_all_words_and_the_end_sum_to_one(spark):
    """Over a small training table, the pieces' mass for words of up to two letters stays below what is left for spelled paths."""
    v = L.loaded()
    p = v.first
    assert np.isclose(p[v.opens].sum(), 1) and np.isclose(p[~v.opens].sum(), 1)
    words = [bytes([a]) for a in range(97, 123)] + [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]
    assert np.exp(L.Lattices(v, words).marginals(np.log(p))).sum() < 1
