"""Metrics of replayed signals by hand."""

from tidemark.operators import research as R

TRADE = "signal_key long, pnl double, return_pct double, hold_minutes double, reason string"


def test_hand_numbers(spark):
    signals = spark.createDataFrame([(i, c) for i, c in enumerate([10, 49, 50, 69, 70, 84, 85, 100])], "signal_key long, confidence int")
    trades = spark.createDataFrame(
        [(0, 5.0, 5.0, 10.0, "take_profit"), (2, -2.0, -2.0, 20.0, "stop"), (3, 3.0, 3.0, 30.0, "time"), (4, -100.0, -100.0, 5.0, "rug"), (6, 4.0, 4.0, 15.0, "time"), (7, -100.0, -100.0, 40.0, "liquidity_failure")], TRADE
    )
    r = R.replay_metrics(signals, trades).first()
    assert (r.trades, r.signals, r.win_rate, r.median_, r.tail, r.hold) == (6, 8, 0.5, 0.5, -100.0, 20.0)
    assert round(r.profit_factor, 6) == round(12 / 202, 6) and round(r.rug_rate, 6) == round(1 / 6, 6)
    # two signals found no entry, one lost its liquidity
    assert r.liquidity_failure_rate == 3 / 8
    assert (r.precision_0_49, r.precision_50_69, r.precision_70_84, r.precision_85_100) == (0.5, 0.5, 0.0, 0.5)


def test_tail_and_nothing(spark):
    signals = spark.range(40).selectExpr("id AS signal_key", "60 AS confidence")
    trades = signals.selectExpr("signal_key", "CAST(signal_key - 100 AS DOUBLE) AS pnl", "CAST(signal_key - 100 AS DOUBLE) AS return_pct", "1.0D AS hold_minutes", "'time' AS reason")
    assert R.replay_metrics(signals, trades).first().tail == -98.0  # place 2 of 40
    r = R.replay_metrics(signals.limit(0), trades.limit(0)).first()
    assert (r.trades, r.signals, r.win_rate, r.profit_factor, r.tail, r.precision_0_49) == (0, 0, 0.0, 0.0, 0.0, 0.0)
