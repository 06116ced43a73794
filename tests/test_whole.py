"""Queries over all rows against plain loops over all rows."""

import random

import pytest

from tickloom.llm import licences
from tickloom.operators import amm, replay
from tickloom.plans import catalogue
from tickloom.sources import domain

SF = "/root/testdata/sf0.001"


def test_every_trade_is_matched_as_an_order(spark):
    by: dict = {}
    for t in domain.trades(spark, SF).select("instrument", "ts", "seq", "price").orderBy("ts", "seq").collect():
        by.setdefault(t.instrument, []).append(t)
    want = {}
    for trades in by.values():
        for i, o in enumerate(trades):
            falls, price = (o.seq % 3 == 0) == (o.seq % 2 == 0), o.price + 30
            hit = next((t for t in trades[i + 1 :] if t.ts > o.ts and (t.price <= price if falls else t.price >= price)), None)
            if hit is not None:
                want[o.instrument, o.seq] = hit.ts, round(hit.price, 6)
    got = catalogue.QUERIES["match_first_trigger"](spark, SF).collect()
    assert {(r.instrument, r.order_id): (r.trigger_ts, r.trigger_px) for r in got} == want and len(got) == len(want)


def test_intervals_cover_every_trade(spark):
    got = {(r.instrument, r.file): (r.start, r.end) for r in catalogue.QUERIES["catalog_intervals"](spark, SF).collect()}
    half = 12 * 3600 * 10**9
    trades = domain.trades(spark, SF).collect()
    assert all(got[t.instrument, t.ts // half][0] <= t.ts <= got[t.instrument, t.ts // half][1] for t in trades)
    assert set(got) == {(t.instrument, t.ts // half) for t in trades}


def test_all_own_buys_leave_the_book(spark):
    left = catalogue.QUERIES["book_without_own"](spark, SF).collect()
    assert left and {r.side for r in left} == {"SELL"}
    open_ids = {r.order_id for r in catalogue.QUERIES["book_open_orders"](spark, SF).collect()}
    assert {r.order_id for r in catalogue.QUERIES["book_audit_open"](spark, SF).collect()} == open_ids


def test_pool_events_other_than_burns_take_no_liquidity():
    pool = amm.Pool(amm.Q96)
    pool.step(("mint", -600, 600, "1000000000000000000", "0", False))
    before = pool.price, pool.tick, pool.liquidity, dict(pool.net)
    row = pool.step(("flash", -600, 600, "1000000000000000000", "1001", True))[0]
    assert row[3:] == ("1005", "1001", "4") and (pool.price, pool.tick, pool.liquidity, pool.net) == before
    for kind in ("collect", "Burn", None):
        with pytest.raises(ValueError):
            pool.step((kind, -600, 600, "1000000000000000000", "0", False))
    assert (pool.price, pool.tick, pool.liquidity, pool.net) == before
    pool.step(("burn", -600, 600, "1000000000000000000", "0", False))
    assert pool.liquidity == 0


def test_long_licence_expressions_are_read_whole():
    a = licences.automaton()
    long = b"SPDX-License-Identifier: " + b" OR ".join([b"MIT"] * 100) + b" OR (GPL-2.0-only AND MPL-2.0)"
    got = licences.scan(long + b"\nmore text", a)
    assert got["labels"] == "gpl,mit,mpl" and got["score"] == 1.0
    far = licences.scan(b"SPDX-License-Identifier: MIT " + b"word " * 100 + b"SPDX-License-Identifier: MPL-2.0", a)
    assert far["labels"] == "mit,mpl" and len(far["expressions"]) == 2


def test_triggers_are_found_without_meeting_all_prices(spark, monkeypatch):
    rng, names, nan = random.Random(6), ["a", "b", None], float("nan")
    value = lambda: rng.choice([rng.uniform(0, 100), rng.uniform(0, 100), 50.0, -0.0, 0.0, nan, None])
    prices = [(rng.choice(names), rng.choice([rng.randint(-900, 3000), 7, None]), i, value()) for i in range(1500)]
    orders = [(rng.choice(names), i % 700, rng.choice([rng.randint(-900, 3000), 7, None]), rng.choice([1, -1, None]), rng.choice(["LIMIT", "STOP", None]), value()) for i in range(900)]
    orders += [("a", 1000 + i, i, 1, "LIMIT", -5.0) for i in range(50)]  # never reached

    def up(x):
        return 1e300 if x != x else x  # NaN is above all

    want: dict = {}
    for name, order_id, ts, side, kind, level in orders:
        if None in (name, ts, level):
            continue
        falls = None not in (side, kind) and (kind == "LIMIT") == (side == 1)
        hit = [(t, seq, up(x)) for n, t, seq, x in prices if n == name and None not in (t, x) and t > ts and (up(x) <= up(level) if falls else up(x) >= up(level))]
        if hit:
            want[name, order_id] = min(hit + [want[name, order_id]] if (name, order_id) in want else hit)
    o = spark.createDataFrame(orders, "instrument string, order_id long, ts long, side int, kind string, price double")
    p = spark.createDataFrame(prices, "instrument string, ts long, seq long, price double")
    for bucket, held in ((10**6, 10**6), (1000, 30), (90, 7)):
        monkeypatch.setattr(replay, "HELD", held)
        found = replay.first_triggers(o, p, bucket)
        assert {(r.instrument, r.order_id): (r.trigger_ts, up(r.trigger_px)) for r in found.collect()} == {k: (t, x) for k, (t, _, x) in want.items()}
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
