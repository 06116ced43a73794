"""Operators against plain versions, and streams against batches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import pricing, text
from tickloom.operators import amm, bars, book, folds, replay, wrangle
from tickloom.sources import catalog, loaders
from tickloom.streaming import bars as stream


def _trades(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [("ab"[rnd.randrange(2)], round(rnd.uniform(10, 60), 2), float(rnd.randrange(6)), i * 7 * 10**9 + rnd.randrange(5), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "instrument string, price double, size double, ts long, seq long")


def test_volume_bars_against_a_loop(spark):
    rows, df = _trades(spark)
    want = []
    for k in "ab":
        room, cur = 25.0, []
        for _, price, size, _, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[3], r[4])):
            while size > 0:
                part = min(size, room)
                cur.append((price, part))
                size, room = size - part, room - part
                if room == 0:
                    ps = [p for p, _ in cur]
                    want.append((k, ps[0], max(ps), min(ps), ps[-1], 25.0))
                    room, cur = 25.0, []
    got = [(r.instrument, r.open, r.high, r.low, r.close, r.volume) for r in bars.volume_bars(df, 25.0).orderBy("instrument", "bar").collect()]
    assert got == want


def test_renko_and_folds_drop_nothing(spark):
    rows, df = _trades(spark)
    got = folds.fold(df, lambda: folds.Renko(5.0), ["instrument"], ["ts", "seq"], ["price", "size"], "open double, high double, low double, close double, volume double").collect()
    for k in "ab":
        own = sorted((r for r in got if r.instrument == k), key=lambda r: (r.ts, r.seq))
        assert own and all(abs(abs(r.close - r.open) - 5) < 1e-6 for r in own)
    assert folds.fold(df.limit(0), lambda: folds.Ema(3), ["instrument"], ["ts", "seq"], ["price"], "v double, ready boolean").count() == 0


def test_position_flips_and_flats():
    p = folds.Position()
    assert p.step((1, 10.0, 100.0, 1.0))[0][:4] == (10.0, 100.0, 0.0, -1.0)
    assert p.step((1, 10.0, 110.0, 1.0))[0][:2] == (20.0, 105.0)
    qty, open_px, _, pnl, _, episode, peak, total = p.step((-1, 30.0, 120.0, 3.0))[0]
    assert (qty, open_px, episode, peak) == (-10.0, 120.0, 2, 10.0) and math.isclose(total, -2 + 20 * 15 - 3) and math.isclose(pnl, -1.0)
    assert p.step((1, 10.0, 100.0, 0.0))[0][0] == 0.0
    inverse = folds.Position(inverse=True)
    inverse.step((1, 100.0, 50.0, 0.0))
    assert math.isclose(inverse.step((-1, 100.0, 100.0, 0.0))[0][3], 100 * (1 / 50 - 1 / 100))


def test_bet_position():
    b = folds.BetPosition()
    assert b.step((1, 2.0, 100.0))[0] == (2.0, 200.0, 0.0)
    price, exposure, pnl = b.step((-1, 4.0, 50.0))[0]
    assert exposure == 0.0 and math.isclose(pnl, 50.0 - 100.0) and price == 0.0 or pnl


def test_book_lifecycle(spark):
    rows = [
        ("x", "ADD", "BUY", 10.0, 5.0, 1, 1, 1), ("x", "UPDATE", "BUY", 10.0, 7.0, 1, 2, 2), ("x", "DELETE", "BUY", 10.0, 0.0, 1, 3, 3), ("x", "UPDATE", "BUY", 10.0, 9.0, 1, 4, 4),
        ("x", "ADD", "SELL", 12.0, 3.0, 2, 5, 5), ("y", "ADD", "BUY", 9.0, 1.0, 3, 1, 6), ("y", "CLEAR", None, None, None, None, 2, 7), ("y", "ADD", "BUY", 8.0, 2.0, 4, 3, 8), ("y", "ADD", "SELL", 7.0, 2.0, 5, 4, 9),
    ]
    d = spark.createDataFrame(rows, "instrument string, action string, side string, price double, size double, order_id long, ts long, seq long")
    o = book.open_orders(d)
    assert {(r.instrument, r.order_id, r.size) for r in o.collect()} == {("x", 2, 3.0), ("y", 4, 2.0), ("y", 5, 2.0)}
    assert {(r.instrument, r.order_id) for r in book.open_orders(d, at=2).collect()} == {("x", 1)}
    assert book.uncrossed(book.levels(o)).count() == 1 and not book.integrity(book.levels(o)).where("instrument = 'y'").first().uncrossed
    assert book.grouped(book.levels(o), 0).count() == 0


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    df = lambda ts, k="a": spark.createDataFrame([(k, t, float(t)) for t in ts], "identifier string, ts_init long, price double")
    c.write("bars", df([1, 2]))
    c.write("bars", df([5, 6]))
    assert c.intervals("bars", "a") == [(1, 2), (5, 6)] and c.missing_intervals("bars", "a", 0, 10) == [(0, 0), (3, 4), (7, 10)]
    with pytest.raises(catalog.Overlap):
        c.write("bars", df([2, 3]))
    c.write("bars", df([3], "b"))
    assert [r.ts_init for r in c.query("bars", ["a"], 2, 5).collect()] == [2, 5] and c.last_timestamp("bars", "a") == 6 and c.kinds() == ["bars"]
    c.consolidate("bars")
    assert c.intervals("bars", "a") == [(1, 6)]
    c.delete_range("bars", "a", 2, 5)
    assert [r.ts_init for r in c.query("bars").collect()] == [1, 3, 6]
    assert c.missing_intervals("none", "a", 0, 1) == [(0, 1)]


def test_streams_equal_batches(spark, tmp_path):
    rows, df = _trades(spark)
    df.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.folded(source, lambda: folds.Ema(10), "instrument", ["ts", "seq"], ["price"], "ema double, ready boolean").writeStream.format("memory").queryName("ema").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    batch = folds.fold(df, lambda: folds.Ema(10), ["instrument"], ["ts", "seq"], ["price"], "ema double, ready boolean")
    got = spark.table("ema").collect()
    assert len({r.seq for r in got}) == len(got) > 0 and {tuple(r) for r in got} <= {tuple(r) for r in batch.collect()} or len(got) == len(rows)
    q = stream.to_catalog(stream.time_bars(source, "1 minute"), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination()
    closed = {(r.instrument, r.ts, r.open, r.close, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    left = {(r.instrument, r.ts, r.open, r.close, r.n) for r in bars.time_bars(df, bars.MINUTE, closed="left").collect()}
    assert closed and closed <= left


def test_greeks_against_the_error_function(spark):
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    xs = [i / 7 for i in range(-60, 61)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", pricing.norm_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - cdf(r.x)) < 1e-13 for r in got)


def test_curve_and_sizing(spark):
    row = spark.range(1).select(pricing.curve_rate(F.lit(0.75), [0.25, 0.5, 1.0, 2.0], [0.05, 0.045, 0.042, 0.04]).alias("r"), pricing.fixed_risk_size(F.lit(10.0), F.lit(10.0), F.lit(1.0), 0.1, 0.0, 0.1).alias("z")).first()
    assert 0.042 < row.r < 0.045 and row.z == 0.0


def test_pool_maths():
    assert amm.sqrt_price_at(0) == amm.Q96
    for t in (-887_272, -50_000, -1, 1, 12_345, 887_272):
        p = amm.sqrt_price_at(t)
        assert amm.tick_at(p) == t and abs(p / amm.Q96 / 1.0001 ** (t / 2) - 1) < 1e-9
    pool = amm.Pool(amm.Q96)
    pool.position(-600, 600, 10**18)
    pool.position(-60, 60, 5 * 10**18)
    paid, got, fee = pool.swap(10**16, True)
    assert paid == 10**16 and 0 < got < paid and fee >= paid * 3 // 1000 and pool.price < amm.Q96
    before = pool.price
    pool.swap(3 * 10**17, False)
    assert pool.price > before and pool.liquidity in (10**18, 6 * 10**18, 0)
    x, y = pool.position(-600, 600, -(10**18))
    assert x <= 0 and y <= 0


def test_loaders(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,bid_price,ask_price,bid_size,ask_size\n2024-01-01T00:00:01Z,1.0,1.1,5,6\nnot a time,1,1,1,1\n")
    rows = loaders.csv_ticks(spark, str(tmp_path / "t.csv")).collect()
    assert rows[0].ts == 1704067201 * 10**9 and rows[1].ts is None
    (tmp_path / "d.csv").write_text("exchange,symbol,timestamp,local_timestamp,is_snapshot,side,price,amount\nx,BTC,1,2,true,bid,10,1\nx,BTC,3,4,false,ask,11,0\n")
    assert [(r.action, r.side) for r in loaders.vendor_deltas(spark, str(tmp_path / "d.csv")).orderBy("ts").collect()] == [("ADD", "BUY"), ("DELETE", "SELL")]
    (tmp_path / "s.csv").write_text("exchange,symbol,timestamp,local_timestamp," + ",".join(f"{s}[{i}].{c}" for i in range(2) for s in ("asks", "bids") for c in ("price", "amount")) + "\nx,BTC,1,2,11,1,10,2,12,1,,\n")
    r = loaders.vendor_snapshots(spark, str(tmp_path / "s.csv"), 2).first()
    assert len(r.bids) == 1 and len(r.asks) == 2
    (tmp_path / "r.xml").write_text("<a><Obs><LOCATION>AUS</LOCATION><TIME>2020-01</TIME><Value>1.5</Value></Obs></a>")
    assert loaders.interest_rates(spark, str(tmp_path / "r.xml")).first().Value == 1.5


def test_bar_types_and_fees(spark):
    t = text.BarType.parse("AUD/USD.SIM-5-MINUTE-BID-INTERNAL@1-MINUTE-EXTERNAL")
    assert str(t).endswith("@1-MINUTE-EXTERNAL") and t.is_time and t.composite == (1, "MINUTE", "EXTERNAL")
    with pytest.raises(ValueError):
        text.BarType.parse("nonsense")
    with pytest.raises(ValueError):
        wrangle.fee("none")
    rates = {(r.source, r.target): (r.rate, r.hops) for r in replay.exchange_rates(spark, [("A", "B", 2.0, 2.0), ("B", "C", 3.0, 3.0)]).collect()}
    assert rates[("A", "C")] == (6.0, 2) and ("A", "D") not in rates


def test_paths_hold_whole_codes(spark):
    got = {(r.source, r.target): r.rate for r in replay.exchange_rates(spark, [("BTC", "USDT", 99.0, 101.0), ("USDT", "USD", 0.9, 1.1)]).collect()}
    assert got["BTC", "USD"] == 100.0 and len(got) == 6


def test_losses_of_all_and_more(spark):
    from tickloom.operators import stats

    rows = [("a", 1, 0.1), ("a", 2, -1.0), ("a", 3, 0.1), ("b", 1, 0.5), ("b", 2, -1.5), ("b", 3, 0.2)]
    df = spark.createDataFrame(rows, "k string, ts long, r double")
    assert {r.k: round(r.max_drawdown, 9) for r in stats.max_drawdown(df, "k", ["ts"]).collect()} == {"a": -1.0, "b": -1.6}
    assert [round(r.equity, 9) for r in stats.equity(df, "k", ["ts"]).where("k = 'b'").orderBy("ts").collect()] == [1.5, -0.75, -0.9]


def test_refused_messages_do_not_count(spark):
    rows = [("a", t, t) for t in (0, 1, 2, 3, 4, 10, 11, 12)]
    df = spark.createDataFrame(rows, "k string, ts long, seq long")
    got = [r.allowed for r in replay.throttled(df, 2, 10, "k", ["ts", "seq"]).orderBy("seq").collect()]
    assert got == [True, True, False, False, False, True, True, False]


def test_prices_at_the_ends_of_the_range():
    assert amm.sqrt_price_at(amm.MIN_TICK) == 4295128739
    assert amm.sqrt_price_at(amm.MAX_TICK) == 1461446703485210103287273052203988822378723970342
    assert amm.sqrt_price_at(1) == 79232123823359799118286999568


def test_implied_vol_is_found_a_batch_at_a_time(spark):
    rows = [(i, 80.0 + i % 41, 0.04, 0.02, 0.1 + i % 37 / 60, i % 3 == 0, 75.0 + i % 47, 0.1 + i % 24 / 12) for i in range(6000)]
    o = spark.createDataFrame(rows, "id long, s double, r double, b double, vol double, call boolean, k double, t double")
    g = pricing.black_scholes(*[F.col(c) for c in ("s", "r", "b", "vol", "call", "k", "t")])
    found = o.select("*", g["price"].alias("price"), g["vega"].alias("vega")).where("vega > 0.02")
    price = F.when(F.col("id") % 100 == 7, None).when(F.col("id") % 100 == 8, 1e6).when(F.col("id") % 100 == 9, 0.0).otherwise(F.col("price"))
    out = found.select("id", "vol", pricing.implied_vol(price, *[F.col(c) for c in ("s", "r", "b", "call", "k", "t")]).alias("got"))
    for r in out.collect():
        assert r.got == 0.0 if r.id % 100 in (7, 8, 9) else abs(r.got - r.vol) < 1e-6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan  # the bisection is not interpreted row by row
