import random

import numpy as np
import pytest
from tests.llm.brute import brute_components

from tickloom.llm import jaccard as J
from tickloom.llm.components import components


def _made(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 4, 5, 8, 9, 12, 20, 40, 90, 200, 500]))]
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                if w:
                    k = rnd.randrange(len(w))
                    w[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1)
            rows.append(" ".join(w).replace("w1", "W1"))
    template = [rnd.choice(vocabulary) for _ in range(60)]
    rows += [" ".join(template + [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 30))]) for _ in range(120)]
    return list(enumerate(rows))


@pytest.mark.parametrize(("frequent", "small", "levels", "rule"), [(64, 8, 6, J.QUERY), (3, 2, 6, J.QUERY), (64, 2, 6, J.STAGE), (3, 2, 0, J.QUERY)])
def test_components_against_brute_force(spark, monkeypatch, frequent, small, levels, rule):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "LEVELS", levels)
    rows = _made(5) + [(None, None), (5000, None), (5000, ""), (5001, "a b c d e f"), (5001, "a b c d e f"), (None, "a b c d e f"), (5002, "x\x00y Z")]
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, n string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.op10_jaccard_join(df, frequent, rule).collect())
    assert got == sorted((str(d), n, str(c)) for d, n, c in brute_components(rows, rule.shingle, rule.percent))


def test_empty_table(spark):
    assert J.op10_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pigeonhole_holds_for_every_allocation():
    rng = np.random.default_rng(3)
    for rule in (J.QUERY, J.STAGE):
        for n_sets in (10, 10_000, 10_000_000):
            for size in (6, 11, 17, 60, 400):
                k = len(J.edges(size, rule)) - 1
                bands = J.band_table({k: n_sets}, size, rule)
                b = bands[k]
                assert b.low <= size <= b.high
                for _ in range(20):
                    x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                    d = rule.differences(size)
                    gone = int(rng.integers(0, d + 1))
                    y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, d - gone, dtype=np.uint64)]))
                    a, ea = J.signatures(x, k, b)
                    c, _ = J.signatures(y, k, b)
                    shared = np.isin(a, c)
                    assert shared[ea].sum() + 2 * shared[~ea].any() >= 1
                    if not b.double:
                        assert shared.sum() >= b.slack + 1


def test_prefixes_of_differences_meet_for_every_link():
    rng = np.random.default_rng(4)
    met = apart = 0
    for _ in range(6000):
        rule = (J.QUERY, J.STAGE)[int(rng.integers(2))]
        size = int(rng.integers(5, 90))
        base = rng.permutation(400)[:size].astype(np.uint64)

        def moved(of, most, rng=rng):
            gone = int(rng.integers(0, most + 1))
            return np.unique(np.concatenate([of[rng.permutation(len(of))[gone:]], rng.integers(0, 400, int(rng.integers(0, most + 1))).astype(np.uint64)]))

        c, x = np.unique(base), moved(base, size // 3)
        m = moved(x, 1 + size // 12) if rng.integers(2) else moved(c, size // 3)
        if not (len(x) and len(m)) or np.array_equal(x, m) or np.array_equal(x, c) or np.array_equal(m, c):
            continue

        def link(a, b, rule=rule):
            return rule.links(len(np.intersect1d(a, b)), len(a) + len(b))

        common = (np.unique(rng.integers(0, 400, 30).astype(np.uint64)), rng.integers(2, 9, 30))
        (px, ix), (pm, im) = (J.prefixes(c, y, rule, common) for y in (x, m))
        found = len(np.intersect1d(px[:ix], pm)) or len(np.intersect1d(px, pm[:im]))
        if link(x, m) and not (link(x, c) and link(m, c)):
            assert found
            met += 1
        apart += not link(x, m) and not found
    assert met > 300 and apart > 300


def test_a_shared_passage_makes_no_pairs_of_all(spark, monkeypatch):
    rnd = random.Random(2)
    passage = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join(passage + [f"o{rnd.randrange(10**6)}" for _ in range(60)])) for i in range(400)]
    rows += [(1000 + i, " ".join(rows[i][1].split()[:-3])) for i in range(50)]
    tried = []
    whole = J.verified

    def counted(pairs, texts, rule):
        tried.append(pairs.count())
        return whole(pairs, texts, rule)

    monkeypatch.setattr(J, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.op10_jaccard_join(df).collect()}
    assert got == {d: d % 1000 for d, _ in rows}
    assert sum(tried) < 10 * len(rows)


def test_stage_keeps_one_row_of_each_component(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long, 1), (3, long, 2), (None, long, 3), (None, long + " x", 4), (5, None, 5), (5, "", 6), (6, "a b", 7), (6, "a b", 8), (7, "c d", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file int").selectExpr("doc_id", "text", "file", "file AS row", "file AS c1", "file AS sid", "file AS kept")
    out = J.stage(spark, df, "")
    assert out.columns == df.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(3, long), (5, ""), (5, None), (6, "a b"), (7, "c d")}
    assert out.count() == 5
    assert J.stage(spark, df.limit(0), "").count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(8)
    for size in (1, 5, 40, 63, 64, 65, 530, 2040, 2100, 5000):
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        d = J.QUERY.differences(len(x))
        for gone in {0, d // 2, d}:
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, d - gone, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert J._may_link(J._sketch(x), J._sketch(y), len(x) + len(y)) and J._may_link(J._sketch(y), J._sketch(x), len(x) + len(y))
        z = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        assert size < 40 or not J._may_link(J._sketch(x), J._sketch(z), len(x) + len(z))


def test_buckets_that_share_a_centre_are_settled_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    common = [f"c{i}" for i in range(320)]
    texts = [" ".join(common + [f"d{k}x{i}" for i in range(110)]) for k in range(40)]
    texts.append(" ".join(texts[7].split()[:-3]))  # the one that links
    docs = spark.createDataFrame([(int(i), texts[i]) for i in rng.permutation(len(texts))], "doc_id long, text string")
    made, pairs = [], J._pairs
    monkeypatch.setattr(J, "_pairs", lambda rows, rule: made.append(rows.agg({"strays": "sum"}).first()[0] or 0) or pairs(rows, rule))
    got = {r.doc_id: r.component_id for r in J.op10_jaccard_join(docs, rule=J.STAGE).collect()}
    assert got == {i: 7 if i == 40 else i for i in range(41)}
    assert sum(made) <= 2 * 41 * 110  # about the rows that index all sets anew under two centres; buckets that decided alone made 21754 pairs
