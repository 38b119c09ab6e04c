import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.scalars import clip, position
from panelwright.operators import evaluation as ev
from panelwright.operators import indicators as ind
from panelwright.operators import quality as dq
from panelwright.operators import recurrences as rec
from panelwright.spec import PanelSpec, StrategySpec

PANEL = PanelSpec()
INSTANT = PanelSpec(grain="instant")


def series(rows, values, symbol="a"):
    return rows("i int, symbol string, pnl double", [(i, symbol, v) for i, v in enumerate(values)]).select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("date"), "symbol", "pnl"
    )


def curve(df, **kw):
    return ev.equity_curve(df, PANEL, "pnl", **kw).orderBy("date", "symbol").collect()


def test_clip_keeps_null_and_open_sides(rows):
    df = rows("x double", [(None,), (-1.0,), (5.0,)])
    got = [r[0] for r in df.select(clip("x", 0.0, 2.0)).collect()]
    assert got == [None, 0.0, 2.0]
    assert [r[0] for r in df.select(clip("x", None, 2.0)).collect()] == [None, -1.0, 2.0]


def test_turnover_penalty(rows):
    df = rows("p double, held double", [(3.0, 0.0), (None, 1.0), (0.5, None)])
    got = [r[0] for r in df.select(position("p", StrategySpec(), "held")).collect()]
    assert got[0] == pytest.approx(2 * math.exp(-0.1))
    assert got[1:] == [None, None]
    bounded = [r[0] for r in df.select(position("p", StrategySpec())).collect()]
    assert bounded == [2.0, None, 0.5]


@pytest.mark.parametrize("by", [None, "symbol"])
def test_drawdown_cases(rows, by):
    got = [r["drawdown"] for r in curve(series(rows, [-0.01, -0.01]), by=by)]
    assert got == pytest.approx([0.0, 1.0])
    assert [r["drawdown"] for r in curve(series(rows, [0.0, -0.01]), by=by)] == [None, -math.inf]


@pytest.mark.parametrize("by", [None, "symbol"])
def test_null_pnl_breaks_the_curve(rows, by):
    df = series(rows, [0.1, None, 0.2])
    assert [r["equity"] for r in curve(df, by=by)] == [pytest.approx(0.1), None, None]
    report = ev.strategy_report(
        df.withColumn("one", F.lit(1.0)), PANEL, "one", "pnl", by=by
    ).first()
    assert report["competition_sharpe"] is None and report["total_return"] is None
    assert report["hit_rate"] == pytest.approx(2 / 3)


def test_constant_pnl_has_no_sharpe(rows):
    df = series(rows, [0.01] * 5)
    assert ev.penalised_sharpe(df, "pnl").first()[0] == 0.0


def test_report_values(rows):
    values = np.array([0.02, -0.01, 0.03, 0.0, -0.04])
    df = series(rows, values.tolist()).withColumn("one", F.lit(1.0))
    got = ev.strategy_report(df, PANEL, "one", "pnl").first()
    equity = values.cumsum()
    assert got["competition_sharpe"] == pytest.approx(
        values.mean() / values.std() - 0.03 * values.std()
    )
    assert got["total_return"] == pytest.approx(equity[-1])
    assert got["max_drawdown"] == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())
    assert got["hit_rate"] == pytest.approx(0.4)


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_blocked_scan_is_the_whole_scan(walk, block):
    """Pooled over days and over ranges of a crowded day, and per key over cut keys."""
    frame, df = walk
    df = df.withColumnRenamed("target", "pnl").select("date", "symbol", "pnl")
    pooled = ev.equity_curve(df, PANEL, "pnl", rows_per_block=block).toPandas()
    want = frame.sort_values(["date", "symbol"])
    equity = want["target"].cumsum()
    got = pooled.sort_values(["date", "symbol"])
    assert len(got) == len(want)
    assert np.allclose(got["equity"], equity, atol=1e-12)
    assert np.allclose(got["peak"], equity.cummax(), atol=1e-12)
    one_day = df.withColumn("date", F.lit("2020-01-01").cast("date")).select(
        "date", F.concat("symbol", F.lpad(F.hash("pnl").cast("string"), 12, "0")).alias("symbol"), "pnl"
    )
    got = ev.equity_curve(one_day, PANEL, "pnl", rows_per_block=block).toPandas().sort_values("symbol")
    assert np.allclose(got["equity"], got["pnl"].cumsum(), atol=1e-12)

    keyed = ev.equity_curve(df, INSTANT, "pnl", by="symbol", rows_per_block=block).toPandas()
    got = keyed.sort_values(["symbol", "date"])
    assert np.allclose(got["equity"], got.groupby("symbol")["pnl"].cumsum(), atol=1e-12)
    assert np.allclose(got["peak"], got.groupby("symbol")["equity"].cummax(), atol=1e-12)


def test_rsi_edges(rows):
    rising = series(rows, [float(i) for i in range(14)])
    flat = series(rows, [1.0] * 14)
    for df, want in ((rising, 100.0), (flat, None)):
        got = [r["RSI"] for r in ind.rsi(df, PANEL, "pnl").orderBy("date").collect()]
        assert got[:13] == [None] * 13 and got[13] == want


def test_full_windows_only(walk):
    frame, df = walk
    got = ind.technical_indicators(df.select("date", "symbol", "close"), PANEL).toPandas()
    got = got.sort_values(["symbol", "date"]).reset_index(drop=True)
    close = frame.sort_values(["symbol", "date"]).groupby("symbol")["close"]
    sma = close.rolling(20).mean().reset_index(drop=True)
    std = close.rolling(20).std().reset_index(drop=True)
    assert np.allclose(got["SMA_20"], sma, equal_nan=True)
    assert np.allclose(got["BB_upper"], sma + 2 * std, equal_nan=True)
    assert np.allclose(got["BB_lower"], sma - 2 * std, equal_nan=True)


def test_exponential_averages_carry_over_gaps(spark, monkeypatch):
    """NULLs repeat the average before them, wherever they fall in a run; three levels of blocks."""
    monkeypatch.setattr(rec, "RUN", 4)
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for key, n in (("a", 300), ("b", 5), ("c", 70)):
        held = {1: None, 9: None}
        for t in range(n):
            empty = rng.random() < 0.3 or t < 2 or 20 <= t < 33
            x = None if empty else float(rng.normal(100))
            for span in held:
                a = 2.0 / (span + 1.0)
                if x is not None:
                    held[span] = x if held[span] is None else a * x + (1 - a) * held[span]
            rows.append((dt.datetime(2020, 1, 1) + dt.timedelta(days=t), key, x))
            want[key, t] = dict(held)
    rows += [(dt.datetime(2020, 1, 1), None, 5.0)] * 3
    spec = PanelSpec(features=("x",))
    df = spark.createDataFrame(rows, "date timestamp, symbol string, x double")
    numbered = rec.number_rows(df, spec, counting="x")
    got = rec.exponential_averages(numbered, spec, {"e1": ("x", 1), "e9": ("x", 9)}).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.symbol is None:
            assert r.e1 is None and r.e9 is None
            continue
        t = (r.date - dt.datetime(2020, 1, 1)).days
        for span, value in ((1, r.e1), (9, r.e9)):
            assert (value is None) == (want[r.symbol, t][span] is None)
            assert value is None or value == pytest.approx(want[r.symbol, t][span], rel=1e-12)


def test_macd_of_a_constant_with_gaps(spark):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=t), "a", None if t in (0, 7) or 100 < t < 400 else 100.0) for t in range(500)]
    got = rec.macd(spark.createDataFrame(rows, "date timestamp, symbol string, close double"), PanelSpec(features=("close",))).collect()
    assert all(r.MACD is None for r in got if r.date == rows[0][0])
    assert all(abs(r.MACD) < 1e-9 and abs(r.MACD_signal) < 1e-9 for r in got if r.date != rows[0][0])


@pytest.mark.parametrize("spec, block", [(PANEL, 10_000), (INSTANT, 30)])
def test_macd_and_long_spans(walk, spec, block, monkeypatch):
    monkeypatch.setattr(rec, "RUN", 5)
    frame, df = walk
    got = rec.macd(df.select("date", "symbol", "close"), spec, rows_per_block=block).toPandas()
    got = got.sort_values(["symbol", "date"]).reset_index(drop=True)
    want = frame.sort_values(["symbol", "date"]).reset_index(drop=True)

    def ema(column, span):
        by = want.groupby("symbol")[column]
        return by.transform(lambda s: s.ewm(span=span, adjust=False).mean())

    want["macd"] = ema("close", 12) - ema("close", 26)
    assert np.allclose(got["MACD"], want["macd"], atol=1e-9)
    assert np.allclose(got["MACD_signal"], ema("macd", 9), atol=1e-9)
    rows = rec.number_rows(df.select("date", "symbol", "close"), spec, rows_per_block=block)
    long = rec.exponential_averages(rows, spec, {"e": ("close", 500), "x": ("close", 1)}).toPandas()
    long = long.sort_values(["symbol", "date"]).reset_index(drop=True)
    assert np.allclose(long["e"], ema("close", 500), atol=1e-9)
    assert np.allclose(long["x"], want["close"])


@pytest.mark.parametrize("spec, block", [(PANEL, 10_000), (INSTANT, 9)])
def test_forward_fill(walk, spec, block):
    frame, df = walk
    clean = df.withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))
    got = rec.forward_fill(clean, spec, ["volume"], rows_per_block=block).toPandas()
    got = got.sort_values(["symbol", "date"]).reset_index(drop=True)
    want = frame.sort_values(["symbol", "date"]).groupby("symbol")["volume"].ffill()
    assert np.allclose(got["volume"], want, equal_nan=True)


def test_quality_reports(rows):
    df = rows(
        "date date, symbol string, x double",
        [],
    ).unionByName(
        series(rows, [1.0, None, 3.0]).withColumnRenamed("pnl", "x")
    )
    assert dq.null_counts(df, ["x"]).first().asDict() == {"feature": "x", "n_rows": 3, "n_null": 1}
    assert dq.duplicate_keys(df.union(df), PANEL).count() == 3
    dq.assert_daily(df, PANEL)
    with pytest.raises(ValueError, match="2 rows"):
        dq.assert_daily(df.union(df), PANEL)
    assert dq.type_mismatches(df, df.schema) == []
    gaps = dq.date_gaps(df.where("x IS NOT NULL"), PANEL).collect()
    assert [g["gap_days"] for g in gaps] == [2]


def test_several_pooled_curves_in_one_table(rows):
    from panelwright.operators.evaluation import rmse, strategy_report

    data = [(f, m, f"2020-01-{d:02d}", s, float((f * d - 3 * m) % 5 - 1.5), 0.1 * d) for f in (0, 1) for m in (0, 1) for d in range(1, 9) for s in "ab"]
    df = rows("fold long, model long, date string, symbol string, position double, target double", data)
    df = df.withColumn("date", F.col("date").cast("timestamp_ntz"))
    spec = PanelSpec(target="target")
    got = {(r.fold, r.model): r for r in strategy_report(df, spec, "position", "target", runs=["fold", "model"]).collect()}
    assert len(got) == 4
    for (f, m), r in got.items():
        one = df.where(f"fold = {f} and model = {m}")
        want = strategy_report(one, spec, "position", "target").first()
        assert all(r[c] == pytest.approx(want[c]) for c in want.asDict())
    errors = {(r.fold, r.model): r.rmse for r in rmse(df, "target", "position", ["fold", "model"]).collect()}
    assert errors[1, 0] == pytest.approx(rmse(df.where("fold = 1 and model = 0"), "target", "position").first()[0])
