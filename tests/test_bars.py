import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions.indicators import INDICATORS, column_name, with_indicator
from tidebar.operators import strategy as st
from tidebar.sources import bars as src

T0 = dt.datetime(2024, 1, 1)


def frame(spark, close, **more):
    rows = [("a", T0 + dt.timedelta(minutes=k), float(c), float(c), float(c), float(c), 100.0, *(v[k] for v in more.values())) for k, c in enumerate(close)]
    return spark.createDataFrame(rows, ["symbol", "ts", "open", "high", "low", "close", "volume", *more])


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


@pytest.mark.parametrize("n", [2, 9, 26, 300])
def test_ema_equals_pandas(spark, n):
    x = 100 + np.random.default_rng(n).normal(size=700).cumsum()
    got = column(with_indicator(frame(spark, x), "e", "ema", [n]), "e")
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=n).mean(), rtol=1e-12)


def test_sma_needs_a_full_window(spark):
    assert column(with_indicator(frame(spark, [10, 11, 12, 11, 10, 10]), "s", "sma", [3]), "s")[:4] == [None, None, 11.0, pytest.approx(34 / 3)]


def test_every_indicator_gives_rows(spark):
    x = 100 + np.random.default_rng(1).normal(size=60).cumsum()
    bars = frame(spark, x).withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1}).coalesce(1).cache()
    for name in INDICATORS:
        df = with_indicator(bars, "x", name)
        assert len(df.columns) > len(bars.columns), name
        df.limit(1).collect()


def test_names():
    assert column_name("b", "ebbp", "Bull.") == "b_ebbp_bull"
    assert column_name("s", "sma", "") == "s"
    with pytest.raises(ValueError):
        with_indicator(None, "x", "nothing")


def test_resample_and_regrid(spark):
    bars = frame(spark, range(10)).where("minute(ts) not in (3, 4)")
    got = src.resample(bars, "5Min").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(0, 2, 0, 2, 300), (5, 9, 5, 9, 500)]
    assert column(src.regrid(bars, "1Min"), "close") == [0, 1, 2, 2, 2, 5, 6, 7, 8, 9]
    assert src.missing_bars(bars, "1Min").first().total_missing == 2
    assert src.infer_frequency(bars).first().step == 60


def test_store_replaces_and_prunes(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    bars = frame(spark, [1, 2]).withColumn("exchange", F.lit("x"))
    path = str(tmp_path / "store")
    src.upsert(spark, bars, path)
    src.upsert(spark, bars.withColumn("close", F.col("close") + 10), path)
    assert sorted(r.close for r in src.scan(spark, path, symbol="a").collect()) == [11, 12]
    assert src.scan(spark, path, symbol="b").count() == 0


def by_hand(bars, enter, exit_, fee=0.0, lot=1.0, cap=0.0):
    """The account in plain Python: (in trade, fee, aux, value) of every bar from closes and flags."""
    cash, aux, out = 1000.0, 0.0, []
    r8 = lambda x: float(np.rint(x * 1e8) / 1e8)
    for close, e, x in zip(bars, enter, exit_, strict=True):
        paid = 0.0
        if e and not x and not aux:
            spent = min(cash * lot, cap) if cap else cash * lot
            got = r8(spent / close)
            paid = r8(got * fee / 100)
            aux, cash = got - paid, r8(cash - spent)
        elif x and aux:
            got = r8(aux * close)
            paid = r8(got * fee / 100)
            aux, cash = 0.0, r8(cash + got - paid)
        out.append((aux > 0, paid, aux, cash + r8(aux * close)))
    return out


def test_lookback(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 6, 80).tolist(), rng.integers(0, 6, 80).tolist()
    s = st.Strategy.of({"enter": [["ind_1", "<", 3]], "any_enter": [["ind_1", ">", "ind_2", 2]], "exit": [["ind_2", ">=", 3, 3]], "any_exit": [["ind_2", "=", 0]]})
    got = column(st.with_actions(frame(spark, [1] * 80, ind_1=a, ind_2=b), s), "action")
    want = []
    for k in range(80):
        held = lambda f, n: k >= n - 1 and all(f(i) for i in range(k - n + 1, k + 1))
        want.append("x" if held(lambda i: b[i] >= 3, 3) else "ax" if b[k] == 0 else "e" if a[k] < 3 else "ae" if held(lambda i: a[i] > b[i], 2) else "h")
    assert got == want


@pytest.mark.parametrize("terms", [{}, {"comission": 0.7}, {"comission": 0.25, "lot_size": 0.5}, {"lot_size": 0.8, "max_lot_size": 300.0}])
def test_account(spark, terms):
    rng = np.random.default_rng(3)
    close = (20 + rng.normal(size=120).cumsum()).clip(1).round(4)
    actions = rng.choice(["e", "ae", "x", "ax", "tsl", "h", "h", "h"], 120).tolist()
    got = st.simulate(frame(spark, close, action=actions), st.Strategy.of(terms)).orderBy("ts").collect()
    opens, closes = [a in ("e", "ae") for a in actions], [a in ("x", "ax", "tsl") for a in actions]
    want = by_hand(close, opens, closes, terms.get("comission", 0), terms.get("lot_size", 1), terms.get("max_lot_size", 0))
    assert [r.in_trade for r in got] == [w[0] for w in want]
    for field, k in (("fee", 1), ("aux", 2), ("adj_account_value", 3)):
        np.testing.assert_allclose([r[field] for r in got], [w[k] for w in want], rtol=0, atol=1.1e-8)


def test_open_trades_close_at_the_end(spark):
    df = frame(spark, [10, 12, 15], action=["h", "e", "h"])
    got = st.simulate(df, st.Strategy.of({"exit_on_end": True})).orderBy("ts").collect()
    assert [r.action for r in got] == ["h", "e", "h", "x"] and (got[-1].ts - got[-2].ts).seconds == 1
    assert not got[-1].in_trade and got[-1].account_value == pytest.approx(1250)
    assert st.simulate(frame(spark, [10, 12], action=["e", "x"]), st.Strategy.of({"exit_on_end": True})).count() == 2


def test_symbols_keep_their_own_accounts(spark):
    one = frame(spark, [10, 11, 12, 13, 9], action=["e", "h", "x", "e", "x"])
    many = one
    for name in "bcdefgh":
        many = many.unionByName(one.withColumn("symbol", F.lit(name)))
    got = st.simulate(many.coalesce(1), st.Strategy.of({})).groupBy("symbol").agg(F.collect_list("adj_account_value").alias("v")).collect()
    assert len(got) == 8 and len({tuple(sorted(r.v)) for r in got}) == 1


def test_bad_documents():
    assert st.Strategy(enter=[["a", "~", 1]], lot_size=2).errors()
    with pytest.raises(ValueError):
        st.Strategy.of({"datapoints": [{"name": "a", "transformer": "none"}]})


def test_complete_documents():
    good = {"datapoints": [{"name": "m", "transformer": "macd"}], "enter": [["m_macd_macd", ">", "m_macd_signal"]], "exit": [["close", "<", 5, 2]], "freq": "5Min", "start": "2024-01-01"}
    assert st.validate(good) == {}
    for change, key in [({"enter": None}, "enter"), ({"exit": []}, "exit"), ({"datapoints": None}, "datapoints"), ({"freq": "5 parsecs"}, "freq"), ({"lot_size": 3}, "lot_size"), ({"start_date": "2024"}, "start_date")]:
        assert key in st.validate(good | change)
    assert "enter" in st.validate(good | {"enter": [["nothing", ">", 1]]}) and "enter" in st.validate(good | {"enter": [["close", "!=", 1]]})
    assert "exit" in st.validate(good | {"exit": [["close", ">", 1, -1]]}) and "any_exit" in st.validate(good | {"any_exit": [["close", ">"]]})


def test_buckets_count_from_the_first_midnight(spark):
    bars = frame(spark, range(30)).withColumn("ts", F.col("ts") + F.expr("interval 3 hours"))
    got = [r.ts for r in src.resample(bars, "7Min").orderBy("ts").collect()]
    assert got[0] == T0 + dt.timedelta(minutes=7 * 25) and all((t - T0).seconds % 420 == 0 for t in got)
    assert [r.ts for r in src.resample(bars, "5D").collect()] == [T0]
    gaps = bars.where("minute(ts) < 5 or minute(ts) > 20")
    made = src.resample(gaps, "5Min", empty=True).orderBy("ts").collect()
    assert len(made) == 6 and made[2].close is None and made[2].volume == 0


def test_ranges(spark):
    bars = frame(spark, range(72)).withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(close as int), 0, 0)"))
    assert src.between(bars, "2024-01-01", "2024-01-02").count() == 48 and src.between(bars, "", None).count() == 72
    assert src.between(bars, "2024-01-01 05:00:00", "2024-01-01 07:00:00").count() == 3
    assert src.between(bars, 1704067200, 1704067200000 + 3600000).count() == 2
    first = src.first_values(bars.withColumn("open", F.when(F.col("close") > 2, F.col("close"))), "1D").orderBy("ts").first()
    assert (first.open, first.close) == (3, 0)
    assert src.resample_calendar(bars, "month").first().volume == 7200


def test_gaps_and_coarser_datapoints(spark):
    bars = frame(spark, range(1, 13)).where("close not in (4, 5)")
    points = [{"name": "a", "transformer": "sma", "args": [2]}, {"name": "b", "transformer": "sma", "args": [2]}, {"name": "c", "transformer": "rolling_max", "args": [1], "freq": "3Min"}]
    df = st.with_datapoints(bars, st.Strategy.of({"datapoints": points, "freq": "1Min"})).orderBy("ts").collect()
    assert [r.close for r in df] == [1, 2, 3, 3, 3, 6, 7, 8, 9, 10, 11, 12]
    assert [r.a for r in df][:7] == [None, 1.5, 2.5, 2.5, 2.5, 2.5, 6.5]
    assert [r.b for r in df][:7] == [None, 1.5, 2.5, 3, 3, 4.5, 6.5]
    assert [r.c for r in df] == [3, 3, 3, 6, 6, 6, 9, 9, 9, 12, 12, 12]


def test_segments_start_anew(spark):
    rng = np.random.default_rng(4)
    bars = frame(spark, (30 + rng.normal(size=40).cumsum()).round(3))
    s = st.Strategy.of({"enter": [["close", ">", 30]], "exit": [["close", "<", 30, 2]]})
    got = st.backtest_segments(bars, s, 10).orderBy("ts").collect()
    for k in range(4):
        part = bars.orderBy("ts").collect()[10 * k : 10 * k + 10]
        alone = st.backtest(spark.createDataFrame(part, bars.schema), s).orderBy("ts").collect()
        assert [r.adj_account_value for r in got[10 * k : 10 * k + 10]] == [r.adj_account_value for r in alone]


def test_summary_equals_pandas(spark):
    rng = np.random.default_rng(6)
    close = (50 + rng.normal(size=300).cumsum()).round(3)
    bars = frame(spark, close).withColumn("ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 7 * timestampdiff(MINUTE, timestamp'2024-01-01', ts), 0, 0)"))
    df = st.backtest(bars, st.Strategy.of({"comission": 0.01, "datapoints": [{"name": "m", "transformer": "sma", "args": [5]}], "enter": [["close", ">", "m"]], "exit": [["close", "<", "m"]]}))
    got, p = st.flat(st.summarize(df)).first(), df.orderBy("ts").toPandas().set_index("ts")
    v, pc = p.adj_account_value, p.adj_account_value_change_perc
    dd = v / v.cummax() - 1
    runs = (p.in_trade != p.in_trade.shift()).cumsum()
    log = p.groupby(runs).first()
    log["at"] = p.index.to_series().groupby(runs.to_numpy()).first().to_numpy()
    log = log[log.adj_account_value_change != 0]
    wins = log.adj_account_value_change_perc > 0
    streaks = wins.groupby((wins != wins.shift()).cumsum()).agg(["size", "first"])
    daily, monthly = v.resample("D").last().ffill().pct_change(), v.resample("ME").last().ffill().pct_change()
    want = {
        "num_trades": len(log),
        "return_perc": 100 - v.iloc[0] / v.iloc[-1] * 100,
        "sharpe_ratio": pc.mean() / pc.std() * len(p) ** 0.5,
        "mean_trade_len": log["at"].diff().dt.total_seconds().mean(),
        "median_trade_len": log["at"].diff().dt.total_seconds().median(),
        "win_perc": wins.mean() * 100,
        "drawdown_metrics_max_drawdown_pct": dd.min() * 100,
        "drawdown_metrics_max_drawdown_duration": (dd < 0).groupby(((dd < 0) != (dd < 0).shift()).cumsum()).sum().max(),
        "risk_metrics_calmar_ratio": pc.mean() / abs(dd.min()),
        "risk_metrics_value_at_risk_95": pc.quantile(0.05),
        "risk_metrics_downside_deviation": pc[pc < 0].std(),
        "position_metrics_avg_position_duration": p[p.in_trade].groupby(runs).size().mean(),
        "trade_streaks_max_win_streak": streaks[streaks["first"]]["size"].max(),
        "trade_streaks_avg_loss_streak": streaks[~streaks["first"]]["size"].mean(),
        "trade_streaks_current_streak": streaks["size"].iloc[-1],
        "trade_quality_profit_factor": abs(log.adj_account_value_change_perc[wins].sum() / log.adj_account_value_change_perc[log.adj_account_value_change_perc < 0].sum()),
        "time_analysis_best_day": daily.max() * 100,
        "time_analysis_daily_return_std": daily.std() * 100,
        "time_analysis_avg_daily_return": daily.mean() * 100,
        "time_analysis_profitable_days_pct": (daily > 0).mean() * 100,
        "time_analysis_avg_monthly_return": monthly.mean() * 100,
        "time_analysis_worst_month": monthly.min() * 100,
    }
    for name, x in want.items():
        assert got[name] == pytest.approx(x, abs=6e-4), name


def test_nested_rules_and_best_runs(spark):
    df = spark.createDataFrame([("a", (1.0,)), ("b", (3.0,))], "symbol string, risk struct<x: double>")
    got = {r.symbol: r.rules for r in st.evaluate_rules(df, [["risk.x", ">", 2], ["risk.y", ">", 0]]).collect()}
    assert got["a"].results == [False] and got["b"].all
    assert [r.symbol for r in st.best_runs(df, "risk.x", 1).collect()] == ["b"]


def test_stored_assets(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    path = str(tmp_path / "store")
    bars = frame(spark, range(6)).withColumn("exchange", F.lit("x"))
    src.upsert(spark, bars.unionByName(bars.withColumn("symbol", F.lit("_tmp"))), path)
    assert [tuple(r) for r in src.assets(spark, path).collect()] == [("x", "a")]
    assert [r.close for r in src.scan(spark, path, "a", "x", start="2024-01-01 00:02:00", freq="2Min").orderBy("ts").collect()] == [3, 5]


def test_stops_equal_a_plain_loop(spark):
    rng = np.random.default_rng(12)
    mid = 100 + rng.normal(size=150).cumsum()
    high, low = mid + rng.random(150), mid - rng.random(150)
    bars = frame(spark, mid).drop("high", "low").join(spark.createDataFrame([(T0 + dt.timedelta(minutes=k), float(h), float(x)) for k, (h, x) in enumerate(zip(high, low, strict=True))], ["ts", "high", "low"]), "ts")
    rising, far, speed, stop = True, high[0], 0.02, low[0] - np.std(high - low, ddof=1)
    want = [stop]
    for k in range(1, 150):
        floor, roof = low[k - 1 : k + 1].min(), high[k - 1 : k + 1].max()
        stays = low[k] > stop if rising else high[k] < stop
        new = max(far, roof) if rising else min(far, floor)
        if stays:
            stop += (far - stop) * speed
            stop = min(stop, floor) if rising else max(stop, roof)
            speed = min(0.2, speed + 0.02) if new != far else speed
        else:
            rising, stop, speed = not rising, new, 0.02
        far = new
        want.append(stop)
    np.testing.assert_allclose(column(with_indicator(bars, "s", "sar"), "s"), want, rtol=1e-12)


def test_rules(spark):
    df = spark.createDataFrame([("a", 2, 1.0)], ["symbol", "n", "r"])
    got = st.evaluate_rules(df, [["n", ">", 1], ["r", ">", 5], ["n", "~", 1]]).first().rules
    assert (got.all, got.any, got.results) == (False, True, [True, False, False])
    assert st.evaluate_rules(df, []).first().rules.all is False


@pytest.mark.parametrize("names", [[5, -3, 9], ["b", "a", "c"]])
def test_ties_of_one_time_are_ordered(spark, names):
    rows = [("s", T0, name, float(k)) for k, name in enumerate(names)] + [("s", T0 + dt.timedelta(seconds=1), names[0], 7.0), ("s", T0 - dt.timedelta(days=30_000), names[0], 1.0), ("s", T0, names[0], None)]
    got = src.from_ticks(spark.createDataFrame(rows, ["a", "t", "k", "p"]).where("t >= '2024-01-01'"), F.col("a"), F.col("t"), F.col("p"), F.lit(1), F.col("k"), "1Min").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(1.0, 7.0, 0.0, 7.0, 4.0)]
