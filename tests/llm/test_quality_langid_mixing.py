import math
import re
from collections import Counter

import numpy as np

from tests.llm.brute import brute_taken
from tickloom.llm import langid, mixing, quality

ODD = [(10_001, None, "en", "s"), (10_002, "", None, None), (10_003, "7 8 !!", "xx", None), (10_003, "7 8 !!", "xx", None), (None, "un deux " * 60, "fr", "\U0001f642"), (10_004, ("a b c d e f g h\n" * 12) + " \n\n x", "en", "￿")]


def _docs(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    return d.union(spark.createDataFrame(ODD, d.schema))


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def test_base_rules_against_brute_force(spark):
    docs = _docs(spark)
    want = Counter((r.doc_id, *_base(r.text)) for r in docs.collect())
    got = quality.op2_quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and sum(r.kept for r in got) > 0.7 * len(got)
    assert quality.op2_quality_rules(docs.limit(0)).count() == 0


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(4)
    text = [" ".join("".join(rng.choice(list("abc"), 3)) for _ in range(400)).encode()]
    tri, _ = quality.codes(text)
    codes, counts = np.unique(tri, return_counts=True)
    model = quality.kneser_ney(codes, counts)
    for context in {int(c) >> 6 for c in codes}:
        p = np.exp(model.logprob(np.array([(context << 6) | s for s in range(64)])))
        assert math.isclose(p.sum(), 1, rel_tol=1e-6)


def test_held_out_accuracy_and_edges(spark):
    docs = _docs(spark)
    got = langid.op9_language_id(docs)
    rows = {r.doc_id: r for r in got.collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 10000").collect()}
    held = [d for d in truth if rows[d].held_out]
    assert sum(rows[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held) > 0
    assert rows[10_001].lang_pred == rows[10_002].lang_pred == rows[10_003].lang_pred == "und" and got.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.op9_language_id(docs.limit(0)).count() == 0


def test_mix_against_brute_force(spark):
    docs = _docs(spark).where("doc_id IS NOT NULL AND doc_id <> 10003")
    got = mixing.op5_mix_sources(docs).toPandas()
    want = brute_taken(docs.toPandas())
    assert {d: t for d, t in zip(got.doc_id, got.taken, strict=True) if t} == {d: t for d, t in want.items() if t}
    assert (got.taken <= 2 * got["size"]).all() and abs(got.taken.sum() - 1.5 * got["size"].sum()) <= got.source_size.nunique() + 1
    assert mixing.op5_mix_sources(docs.limit(0)).count() == 0
    everything = mixing.op5_mix_sources(_docs(spark))
    assert everything.count() == _docs(spark).count()


def test_tree_gives_every_block_once(spark):
    quotas = {(1, 0): 500, (1, 1): 200, (2, 0): 30}
    rows = mixing.drawn_blocks(spark, quotas, 37, 5).collect()
    seen = Counter((r.number, r["pass"], r.nth) for r in rows)
    assert set(seen.values()) == {1} and set(seen) == {(n, e, k) for (n, e), q in quotas.items() for k in range(q)}
    shards = Counter(r.shard for r in rows)
    assert len(shards) == 37 and max(shards.values()) - min(shards.values()) <= 2
    other = Counter((r.number, r["pass"], r.shard) for r in mixing.drawn_blocks(spark, quotas, 37, 6).collect())
    assert other != Counter((r.number, r["pass"], r.shard) for r in rows)


def test_draws_follow_the_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.placed(docs, "doc_id", "source", "text")
    whole, few = (mixing.mix(rows, shard_words=w)[1].collect() for w in (1 << 30, 20_000))
    assert {(r.row, r["pass"]): r.words for r in whole} == {(r.row, r["pass"]): r.words for r in few}
    assert {r.shard for r in whole} == {0} and len({r.shard for r in few}) > 5
    for got in (whole, few):
        for shard in {r.shard for r in got}:
            places = sorted(r.place for r in got if r.shard == shard)
            assert places == list(range(1, len(places) + 1))
    words = Counter()
    for r in few:
        words[r.shard] += r.words
    assert max(words.values()) < 2 * 20_000 + 20_000
