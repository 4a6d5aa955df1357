"""DuckDB SQL for the strategy queries, written on its own: recursive account, islands by running sums, one aggregate."""

from __future__ import annotations

from .indicator_sql import RUN, bars, mean

START = 1000.0


def r3(x: str) -> str:
    return f"coalesce(round_even(({x}) * 1000, 0) / 1000, 0)"


def r4(x: str) -> str:
    return f"coalesce(round_even(({x}) * 1e4, 0) / 1e4, 0)"


def r8(x: str) -> str:
    return f"(round_even(({x}) * 1e8, 0) / 1e8)"


def actions(fast: int, slow: int, stop: float = 0.0) -> str:
    """Table a: bars with the actions of the crossing averages that the flagship compares; the exit must have held for two bars."""
    tsl = f"WHEN c <= max(c) {RUN} * {1 - stop!r} THEN 'tsl'" if stop else ""
    return f"""{bars()}, d AS (SELECT *, {mean('c', fast)} AS fast, {mean('c', slow)} AS slow FROM n),
    a AS (SELECT symbol, t, c, CASE {tsl} WHEN fast < slow AND lag(fast < slow, 1, FALSE) {RUN} THEN 'x' WHEN fast > slow THEN 'e' ELSE 'h' END AS action FROM d)"""


def account(fee: float, keys: str = "symbol", lot: float = 1.0) -> str:
    """Tables up to f: table a with in_trade, cash, aux, fee, adj and the changes of adj; events are numbered, and every odd one opens a trade."""
    by = f"PARTITION BY {keys} ORDER BY t"
    same = " AND ".join(f"e.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    opened = r8(f"p.cash * {lot} / e.c")
    return f"""i AS (SELECT *, coalesce(last_value(CASE action WHEN 'e' THEN TRUE WHEN 'h' THEN NULL ELSE FALSE END IGNORE NULLS) OVER ({by}), FALSE) AS in_trade FROM a),
    j AS (SELECT *, in_trade <> lag(in_trade, 1, FALSE) OVER ({by}) AS event FROM i),
    k AS MATERIALIZED (SELECT *, count(*) FILTER (WHERE event) OVER ({by}) AS k FROM j),
    g AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS k, CAST({START} AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS aux, CAST(0 AS DOUBLE) AS fee FROM k
    UNION ALL SELECT {', '.join(f'p.{x.strip()}' for x in keys.split(','))}, e.k,
    CASE WHEN e.in_trade THEN {r8(f'p.cash - p.cash * {lot}')} ELSE {r8(f"p.cash + {r8('p.aux * e.c')} - {r8(f'''{r8('p.aux * e.c')} * {fee} / 100''')}")} END,
    CASE WHEN e.in_trade THEN {opened} - {r8(f'{opened} * {fee} / 100')} ELSE 0 END,
    CASE WHEN e.in_trade THEN {r8(f'{opened} * {fee} / 100')} ELSE {r8(f'''{r8('p.aux * e.c')} * {fee} / 100''')} END
    FROM g p JOIN k e ON {same} AND e.event AND e.k = p.k + 1),
    m AS (SELECT k.* EXCLUDE (k), g.cash, g.aux, CASE WHEN k.event THEN g.fee ELSE 0 END AS fee, g.cash + {r8('g.aux * k.c')} AS adj FROM k JOIN g USING ({keys}, k)),
    f AS MATERIALIZED (SELECT *, adj - lag(adj) OVER ({by}) AS ch, adj / nullif(lag(adj) OVER ({by}), 0) - 1 AS pc FROM m)"""


def trade_rows(keys: str = "symbol") -> str:
    """Tables up to l: table f with run, the number of the run of equal in_trade, and trade, whether the bar is in the trade log with tch and tpc."""
    by = f"PARTITION BY {keys} ORDER BY t"
    return f"""o AS (SELECT *, in_trade IS DISTINCT FROM lag(in_trade) OVER ({by}) AS first FROM f), q AS (SELECT *, sum(CAST(first AS INT)) OVER ({by}) AS run FROM o),
    s AS (SELECT *, first_value(ch IGNORE NULLS) OVER z AS tch, first_value(pc IGNORE NULLS) OVER z AS tpc
    FROM q WINDOW z AS (PARTITION BY {keys}, run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    l AS MATERIALIZED (SELECT *, first AND coalesce(tch <> 0, TRUE) AS trade FROM s)"""


def summary(keys: str = "symbol") -> tuple[str, dict[str, str]]:
    """(tables up to w, expressions of the metrics by name over w grouped by keys)."""
    by = f"PARTITION BY {keys} ORDER BY t"
    past = f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    day, month = "CAST(floor(t / 86400) AS BIGINT)", "(year(to_timestamp(t) AT TIME ZONE 'UTC') * 12 + month(to_timestamp(t) AT TIME ZONE 'UTC'))"
    tables = f"""u1 AS (SELECT *, adj / max(adj) OVER ({by}) - 1 AS dd, CASE WHEN trade THEN tpc END AS p, {day} AS dy, {month} AS mo,
    CASE WHEN trade THEN round_even((t - last_value(CASE WHEN trade THEN t END IGNORE NULLS) {past}) / 10, 0) * 10 END AS held,
    CASE WHEN trade THEN coalesce(tpc > 0, FALSE) END AS win FROM l),
    u2 AS (SELECT *, CASE WHEN dy IS DISTINCT FROM lead(dy) OVER ({by}) THEN adj END AS da, CASE WHEN mo IS DISTINCT FROM lead(mo) OVER ({by}) THEN adj END AS ma,
    (dd < 0) IS DISTINCT FROM lag(dd < 0) OVER ({by}) AS sank, trade AND win IS DISTINCT FROM last_value(win IGNORE NULLS) {past} AS turned FROM u1),
    u3 AS (SELECT *, da / nullif(last_value(da IGNORE NULLS) {past}, 0) - 1 AS dr, ma / nullif(last_value(ma IGNORE NULLS) {past}, 0) - 1 AS mr,
    sum(CAST(sank AS INT)) OVER ({by}) AS sink, sum(CAST(turned AS INT)) OVER ({by}) AS streak FROM u2),
    w AS MATERIALIZED (SELECT *, CASE WHEN first AND in_trade THEN count(*) OVER (PARTITION BY {keys}, run) END AS bin,
    CASE WHEN sank AND dd < 0 THEN count(*) OVER (PARTITION BY {keys}, sink) END AS blow,
    CASE WHEN turned THEN count(*) FILTER (WHERE trade) OVER (PARTITION BY {keys}, streak) END AS len FROM u3)"""
    ends = "arg_min(adj, t)", "arg_max(adj, t)"
    ret, hold = r3(f"100 - {ends[0]} / nullif({ends[1]}, 0) * 100"), r3("(1 - arg_min(c, t) / nullif(arg_max(c, t), 0)) * 100")
    won, lost, trades = "CASE WHEN p > 0 THEN p END", "CASE WHEN p < 0 THEN p END", "count(*) FILTER (WHERE trade)"
    down = "CASE WHEN pc < 0 THEN pc END"
    drag = r3(f"sum(fee) / nullif({ends[1]}, 0) * 100")
    out = {
        "return_perc": ret,
        "sharpe_ratio": r3("avg(pc) / nullif(stddev_samp(pc), 0) * sqrt(count(*))"),
        "buy_and_hold_perc": hold,
        "median_trade_len": r3("quantile_cont(held, 0.5)"),
        "mean_trade_len": r3("avg(held)"),
        "max_trade_held": r3("max(held)"),
        "min_trade_len": r3("min(held)"),
        "total_num_winning_trades": f"count({won})",
        "total_num_losing_trades": f"count({lost})",
        "avg_win_perc": r3(f"avg({won}) * 100"),
        "avg_loss_perc": r3(f"avg({lost}) * 100"),
        "best_trade_perc": r4("max(p)"),
        "min_trade_perc": r4("min(p)"),
        "median_trade_perc": r4("quantile_cont(p, 0.5)"),
        "mean_trade_perc": r4("avg(p)"),
        "num_trades": trades,
        "win_perc": r3(f"count({won}) / nullif({trades}, 0) * 100"),
        "loss_perc": r3(f"count({lost}) / nullif({trades}, 0) * 100"),
        "equity_peak": r3("max(cash)"),
        "equity_final": r3(ends[1]),
        "max_drawdown": r3("min(adj)"),
        "total_fees": r3("sum(fee)"),
        "first_tic": "strftime(to_timestamp(min(t)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')",
        "last_tic": "strftime(to_timestamp(max(t)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')",
        "total_tics": "count(*)",
        "perc_missing": "round(((max(t) - min(t)) // 14400 + 1 - count(*)) / ((max(t) - min(t)) // 14400 + 1) * 100, 2)",
        "total_missing": "greatest((max(t) - min(t)) // 14400 + 1 - count(*), 0)",
        "num_of_enter_signals": "count(*) FILTER (WHERE action IN ('e', 'ae'))",
        "num_of_exit_signals": "count(*) FILTER (WHERE action IN ('x', 'ax'))",
        "num_of_hold_signals": "count(*) FILTER (WHERE action = 'h')",
        "market_adjusted_return": r3(f"{ret} - {hold}"),
        "position_metrics_avg_position_size": r3("avg(CASE WHEN in_trade THEN aux END)"),
        "position_metrics_max_position_size": r3("max(CASE WHEN in_trade THEN aux END)"),
        "position_metrics_avg_position_duration": r3("avg(bin)"),
        "position_metrics_total_commission_impact": drag,
        "trade_quality_profit_factor": f"CASE WHEN coalesce(sum({lost}), 0) = 0 AND sum({won}) > 0 THEN CAST('inf' AS DOUBLE) ELSE {r3(f'abs(sum({won}) / nullif(sum({lost}), 0))')} END",
        "trade_quality_avg_win_loss_ratio": r3(f"abs(avg({won}) / nullif(avg({lost}), 0))"),
        "trade_quality_largest_winning_trade": r3("max(p)"),
        "trade_quality_largest_losing_trade": r3("min(p)"),
        "market_exposure_time_in_market_pct": r3("avg(CAST(in_trade AS INT)) * 100"),
        "market_exposure_avg_trade_duration": r3("avg(bin)"),
        "effective_trades_num_profitable_after_commission": "count(*) FILTER (WHERE trade AND tch > fee)",
        "effective_trades_num_unprofitable_after_commission": "count(*) FILTER (WHERE trade AND tch <= fee)",
        "effective_trades_commission_drag_pct": f"CASE WHEN {trades} > 0 THEN {drag} ELSE 0 END",
        "drawdown_metrics_max_drawdown_pct": r3("min(dd) * 100"),
        "drawdown_metrics_avg_drawdown_pct": r3("avg(dd) * 100"),
        "drawdown_metrics_max_drawdown_duration": r3("max(blow)"),
        "drawdown_metrics_avg_drawdown_duration": r3("avg(blow)"),
        "drawdown_metrics_current_drawdown": r3("arg_max(dd, t) * 100"),
        "risk_metrics_sortino_ratio": r3(f"avg(pc) / nullif(stddev_samp({down}), 0)"),
        "risk_metrics_calmar_ratio": r3("avg(pc) / nullif(abs(min(dd)), 0)"),
        "risk_metrics_value_at_risk_95": r3("quantile_cont(pc, 0.05)"),
        "risk_metrics_annualized_volatility": r3("stddev_samp(pc) * sqrt(252)"),
        "risk_metrics_downside_deviation": r3(f"stddev_samp({down})"),
        "trade_streaks_current_streak": "coalesce(arg_max(len, CASE WHEN turned THEN t END), 0)",
        "trade_streaks_max_win_streak": "coalesce(max(CASE WHEN win THEN len END), 0)",
        "trade_streaks_max_loss_streak": "coalesce(max(CASE WHEN NOT win THEN len END), 0)",
        "trade_streaks_avg_win_streak": r3("avg(CASE WHEN win THEN len END)"),
        "trade_streaks_avg_loss_streak": r3("avg(CASE WHEN NOT win THEN len END)"),
    }
    names = {"day": ("dr", "max(dy) - min(dy)", "avg_daily_return", "daily_return_std", "profitable_days_pct"), "month": ("mr", "max(mo) - min(mo)", "avg_monthly_return", "monthly_return_std", "profitable_months_pct")}
    for unit, (x, n, avg, sd, good) in names.items():
        zeros = f"list_resize(CAST([] AS DOUBLE[]), {n} - count({x}), 0.0)"
        every = f"list_concat(list({x}) FILTER (WHERE {x} IS NOT NULL), {zeros})"
        for name, agg in ((f"best_{unit}", "max"), (f"worst_{unit}", "min"), (avg, "avg"), (sd, "stddev_samp")):
            out[f"time_analysis_{name}"] = f"round_even(list_aggregate({every}, '{agg}') * 100 * 1000, 0) / 1000"
        out[f"time_analysis_{good}"] = f"round_even(count(*) FILTER (WHERE {x} > 0) / ({n} + 1) * 100 * 1000, 0) / 1000"
    return tables, out


def listed(metrics: dict[str, str], keys: str = "symbol") -> str:
    return f"{keys}, {', '.join(f'{x} AS {name}' for name, x in metrics.items())}"
