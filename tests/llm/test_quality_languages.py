"""Every language has its own model and band, however many there are."""

import math
import random

from pyspark.sql import functions as F

from tickloom.llm import quality


def _many(spark, langs):
    rng = random.Random(3)
    rows = []
    for k in range(langs):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        words = ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(30)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=40)), f"l{k:02d}") for i in range(12)]
        rows.append((100 * k + 99, "".join(rng.choices("#*$%&|<> qxzj0123456789", k=600)) + " w" * 30, f"l{k:02d}"))
    rows += [(9_000_000 + i, " ".join(rng.choices(["no", "lang", "here", "at", "all"], k=40)), None) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def _rows(df):
    return {r.doc_id: tuple(r) for r in df.collect()}


def _same(got, want):
    """Equal but for the last bits of doubles: their sums depend on where a text stands in its batch."""
    near = lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b
    return got.keys() == want.keys() and all(near(a, b) for d in want for a, b in zip(got[d], want[d], strict=True))


def test_a_verdict_does_not_depend_on_other_languages(spark):
    docs = _many(spark, 45)
    whole = _rows(quality.judge(docs))
    assert len(whole) == docs.count()
    for lang in ("l00", "l40", "l44"):
        alone = _rows(quality.judge(docs.where(F.col("lang") == lang)))
        assert len(alone) == 13 and _same(alone, {d: whole[d] for d in alone})
    none = _rows(quality.judge(docs.where("lang IS NULL")))
    assert len(none) == 12 and _same(none, {d: whole[d] for d in none})


def test_models_that_travel_with_texts_give_the_same(spark, monkeypatch):
    docs = _many(spark, 40)
    want = _rows(quality.judge(docs))
    monkeypatch.setattr(quality, "SLOT_BYTES", 500)
    assert _same(_rows(quality.judge(docs, broadcast_bytes=0)), want)


def test_other_letters_of_a_script_are_no_prose(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("абвгдежзий", k=rng.randint(2, 7))) for _ in range(60)]
    prose = [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    # the same bytes but for bits that classes of bytes leave out, the letters in another order
    junk = [t.translate({ord(c): ord(c) - 16 for c in "абвгдежзий"}) for t in prose[:1]]
    shuffled = ["".join(rng.sample(t, len(t))) for t in prose[1:2]]
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(prose + junk + shuffled)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept for i in range(40)) and not got[40].kept and not got[41].kept
    assert got[40].log_perplexity > got[0].log_perplexity + 0.5


def test_n_grams_are_whole_code_points():
    low, high, size = quality.grams(["AЖ\t\n中--𝄞1".encode(), b"", "ж".encode()])
    points = [0, 0, 0, 0, *map(ord, "aЖ 中-𝄞1 "), 0, 0, 0, 0, 32, 0, 0, 0, 0, ord("ж"), 32]
    want = [points[i : i + 5] for i in (*range(8), 12, 17, 18)]
    got = [[int(h) >> 21, int(h) & 0x1FFFFF, int(x) >> 42, int(x) >> 21 & 0x1FFFFF, int(x) & 0x1FFFFF] for x, h in zip(low, high, strict=True)]
    assert got == want and size.tolist() == [8, 1, 2]
