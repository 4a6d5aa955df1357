"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from ..operators.hmm import FLOOR, STAY
from ..operators.regimes import FEATURES
from ..queries import FLAGSHIP, HMM_ROUNDS, HUNDRED, RANGED, SWEPT
from ..sources.bars import seconds
from .hmm_sql import hmm_model, hmm_path, hmm_tables
from .indicator_sql import INDICATOR_SQL, RUN, bars, ema, lagged, mean, over, table, volume_mean
from .strategy_sql import account, actions, listed, r3, summary, trade_rows


def _rolled(*values: str) -> str:
    return f"WITH {bars()} SELECT symbol, t, {', '.join(f'round({v}, 6) AS v{k}' for k, v in enumerate(values))} FROM n"


def _decayed(alpha: float, x: str = "c") -> str:
    return f"""WITH {bars()}, w AS (SELECT symbol, r, CAST({x} AS DOUBLE) AS x FROM n) SELECT n.symbol, n.t,
    round(sum(w.x * pow({1 - alpha!r}, n.r - w.r)) / sum(pow({1 - alpha!r}, n.r - w.r)), 6) AS v0 FROM n JOIN w ON w.symbol = n.symbol AND w.r <= n.r GROUP BY 1, 2"""


_CHANGE = "100 * (c / nullif(lag(c) OVER (PARTITION BY symbol ORDER BY t), 0) - 1)"
_STATES = f"""{bars()}, s AS (SELECT symbol, t, CASE WHEN p > 2 THEN 'Strong Increase' WHEN p > 1 THEN 'Moderate Increase' WHEN p > 0 THEN 'Slight Increase'
    WHEN p <= -2 THEN 'Strong Decrease' WHEN p <= -1 THEN 'Moderate Decrease' WHEN p <= -0.5 THEN 'Slight Decrease' ELSE 'Stable' END AS state
    FROM (SELECT symbol, t, {_CHANGE} AS p FROM n))"""
_RET = f"q AS (SELECT *, coalesce(({_CHANGE}) / 100, 0) AS ret FROM n)"


def _zero(x: str) -> str:
    return f"round(coalesce({x}, 0), 6)"


_HI, _LO = over("max({})", 14, "h"), over("min({})", 14, "l")
_M, _SD = over("avg({})", 20, "c"), over("stddev_samp({})", 20, "c")
ORACLE_SQL = {
    "bars_4h": _rolled("o", "h", "l", "c", "v"),
    "bars_day": f"WITH {bars(86400)} SELECT symbol, t, round(o, 6) AS v0, round(h, 6) AS v1, round(l, 6) AS v2, round(c, 6) AS v3, round(v, 6) AS v4 FROM n",
    "bars_missing": f"""WITH {bars(3600)}, g AS (SELECT symbol, CAST((max(t) - min(t)) / 3600 AS BIGINT) + 1 AS e, count(*) AS k FROM n GROUP BY 1)
    SELECT symbol, greatest(e - k, 0) AS total_missing, round((e - k) / CAST(e AS DOUBLE) * 100, 2) AS perc_missing FROM g""",
    "ind_sma": _rolled(over("avg({})", 41, "c")),
    "ind_smm": _rolled(over("median({})", 9, "c")),
    "ind_mom": _rolled(f"c - {lagged('c', 10)}"),
    "ind_roc": _rolled(f"100 * (c - {lagged('c', 12)}) / {lagged('c', 12)}"),
    "ind_rolling_max": _rolled(over("max({})", 10, "c")),
    "ind_rolling_min": _rolled(over("min({})", 10, "c")),
    "ind_msd": _rolled(over("stddev_samp({})", 21, "c")),
    "ind_bbands": _rolled(f"({_M}) + 2 * ({_SD})", _M, f"({_M}) - 2 * ({_SD})"),
    "ind_stoch": _rolled(f"100 * (c - ({_LO})) / nullif(({_HI}) - ({_LO}), 0)"),
    "ind_williams": _rolled(f"-100 * (({_HI}) - c) / nullif(({_HI}) - ({_LO}), 0)"),
    "ind_tp": _rolled("tp"),
    "ind_bop": _rolled("(c - o) / nullif(h - l, 0)"),
    "ind_do": _rolled(over("min({})", 5, "l"), f"(({over('max({})', 20, 'h')}) + ({over('min({})', 5, 'l')})) / 2", over("max({})", 20, "h")),
    "ind_vwap": _rolled(f"sum(v * tp) {RUN} / sum(v) {RUN}"),
    "ind_ao": _rolled(f"({over('avg({})', 5, 'm')}) - ({over('avg({})', 34, 'm')})"),
    "ind_ema": _decayed(0.2),
    "ind_ssma": _decayed(1 / 9),
    "ind_smma": _decayed(1 / 42),
    "markov_states": f"WITH {_STATES} SELECT * FROM s",
    "markov_transitions": f"""WITH {_STATES}, p AS (SELECT symbol, lag(state) OVER (PARTITION BY symbol ORDER BY t) AS source, state AS target FROM s),
    k AS (SELECT symbol, source, target, count(*) AS "count" FROM p WHERE source IS NOT NULL GROUP BY 1, 2, 3)
    SELECT *, round("count" / CAST(sum("count") OVER (PARTITION BY symbol, source) AS DOUBLE), 9) AS probability FROM k""",
    "screen_features": f"""WITH {bars()}, {_RET} SELECT symbol, t, round(ret, 6) AS v0, {_zero(over('stddev_samp({})', 20, 'ret'))} AS v1,
    {_zero('(h - l) / nullif(c, 0)')} AS v2, {_zero(f"c / nullif({lagged('c', 20)}, 0) - 1")} AS v3, {_zero(f"c / max(c) {RUN} - 1")} AS v4 FROM q""",
    "regime_features": f"""WITH {bars()}, {_RET} SELECT symbol, t, round(ret, 6) AS v0, {_zero(over('stddev_samp({})', 20, 'ret'))} AS v1,
    {_zero('(h - l) / nullif(c, 0)')} AS v2,
    {_zero("CASE WHEN r >= 20 THEN regr_slope(c, r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END")} AS v3,
    {_zero(f"(v - ({over('avg({})', 20, 'v')})) / nullif(({over('stddev_samp({})', 20, 'v')}), 0)")} AS v4 FROM q""",
    "ind_fve": f"""WITH {bars()}, f AS (SELECT *, c - m + tp - lag(tp) OVER (PARTITION BY symbol ORDER BY t) AS mf FROM n),
    g AS (SELECT *, CASE WHEN mf > 0.003 * c THEN v WHEN mf < -0.003 * c THEN -v ELSE 0 END AS s FROM f)
    SELECT symbol, t, round(({over('sum({})', 22, 's')}) / ({over('avg({})', 22, 'v')}) / 22 * 100, 6) AS v0 FROM g""",
    "ind_obv": f"""WITH {bars()}, d AS (SELECT *, c - lag(c) OVER (PARTITION BY symbol ORDER BY t) AS d FROM n),
    e AS (SELECT *, CASE WHEN d < 0 THEN -v WHEN d >= 0 THEN v END AS s FROM d),
    g AS (SELECT *, CASE WHEN d = 0 THEN lag(s) OVER (PARTITION BY symbol ORDER BY t) ELSE s END AS x FROM e)
    SELECT symbol, t, CASE WHEN x IS NOT NULL THEN round(sum(x) {RUN}, 6) END AS v0 FROM g""",
    "ind_qstick": f"WITH {bars()} SELECT symbol, t, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 14 THEN round((c - o) / 14, 6) END AS v0 FROM n",
    "ind_williams_fractal": f"""WITH {bars()}, x AS (SELECT *, max(h) OVER w AS a, min(l) OVER w AS z, count(*) OVER w AS k FROM n
    WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT symbol, t, CASE WHEN k = 5 THEN CAST(h = a AS DOUBLE) END AS v0, CASE WHEN k = 5 THEN CAST(l = z AS DOUBLE) END AS v1 FROM x""",
    "ind_tr": f"WITH {bars()} SELECT symbol, t, round(greatest(h - l, abs(h - {lagged('c', 1)}), abs({lagged('c', 1)} - l)), 6) AS v0 FROM n",
    "ind_er": f"""WITH {bars()}, d AS (SELECT *, abs(c - {lagged('c', 1)}) AS d FROM n)
    SELECT symbol, t, round(abs(c - {lagged('c', 10)}) / nullif(({over('sum({})', 10, 'd')}), 0), 6) AS v0 FROM d""",
    "ind_bbwidth": _rolled(f"4 * ({_SD}) / nullif(({_M}), 0)"),
    "ind_percent_b": _rolled(f"(c - (({_M}) - 2 * ({_SD}))) / nullif(4 * ({_SD}), 0)"),
    "ind_chandelier": f"""WITH {bars()}, d AS (SELECT *, greatest(h - l, abs(h - {lagged('c', 1)}), abs({lagged('c', 1)} - l)) AS tr FROM n)
    SELECT symbol, t, round(({over('min({})', 22, 'l')}) + 3 * ({over('avg({})', 22, 'tr')}), 6) AS v0,
    round(({over('max({})', 22, 'h')}) - 3 * ({over('avg({})', 22, 'tr')}), 6) AS v1 FROM d""",
    "ind_linear_regression": f"""WITH {bars()} SELECT symbol, t, round(CASE WHEN r < 2 THEN c ELSE regr_intercept(c, r) OVER w + regr_slope(c, r) OVER w * r END, 6) AS v0 FROM n
    WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
}


_FEE = FLAGSHIP["comission"]
_FLAGSHIP = f"{actions(3, 9)}, {account(_FEE)}"
_TABLES, _METRICS = summary()
_RULES = ["num_trades > 1", "return_perc > 0"]


def _swept(pairs: list[tuple[int, int]], picked: list[str]) -> str:
    """Tables up to w over all variants, and r with the metrics ``picked``."""
    points = ", ".join(f"{mean('c', n)} AS a{n}" for n in sorted({n for p in pairs for n in p}))
    each = " UNION ALL ".join(
        f"SELECT '{a}-{b}' AS variant, symbol, t, c, CASE WHEN a{a} < a{b} AND lag(a{a} < a{b}, 1, FALSE) {RUN} THEN 'x' WHEN a{a} > a{b} THEN 'e' ELSE 'h' END AS action FROM d" for a, b in pairs
    )
    keys = "variant, symbol"
    tables, metrics = summary(keys)
    chosen = listed({k: metrics[k] for k in picked}, keys)
    return f"WITH RECURSIVE {bars()}, d AS (SELECT *, {points} FROM n), a AS ({each}), {account(_FEE, keys)}, {trade_rows(keys)}, {tables}, r AS (SELECT {chosen} FROM w GROUP BY {keys})"


def _grouped(label: str, extra: str = "") -> str:
    """Rows of hourly bars grouped by ``label``."""
    return f"""WITH {bars(3600)}{extra}, g AS (SELECT symbol, {label} AS t, arg_min(o, t) AS o, max(h) AS h, min(l) AS l, arg_max(c, t) AS c, sum(v) AS v FROM n GROUP BY 1, 2)"""


_FIVE = ", round(o, 6) AS v0, round(h, 6) AS v1, round(l, 6) AS v2, round(c, 6) AS v3, round(v, 6) AS v4"
_WEEK = "CAST(epoch(date_trunc('week', make_timestamp(CAST(t * 1000000 AS BIGINT)))) AS BIGINT)"
_LABELS = {
    "Trending up": "trend",
    "Trending down": "-trend",
    "Mean reverting": "-vol",
    "High volatility": "vol",
    "Low volatility": "-vol",
    "Liquidity stress": "rng + z",
    "Expansion": "vol + rng",
    "Contraction": "-vol",
    "Risk-on": "trend + vol",
    "Risk-off": "vol - trend",
}
_BEST = f"greatest({', '.join(_LABELS.values())}, 0)"
_REGIME = ORACLE_SQL["regime_features"].replace("WITH ", "", 1)
ORACLE_SQL |= {f"ind_{name}": text for name, text in INDICATOR_SQL.items()}
ORACLE_SQL |= {
    "flagship": f"""WITH RECURSIVE {_FLAGSHIP}, {trade_rows()}, {_TABLES}, r AS (SELECT {listed(_METRICS)} FROM w GROUP BY symbol)
    SELECT *, {' AND '.join(_RULES)} AS rules_all, {' OR '.join(_RULES)} AS rules_any, concat_ws(',', {', '.join(f'CAST({x} AS VARCHAR)' for x in _RULES)}) AS rules_results FROM r""",
    "sig_actions": f"WITH {actions(3, 9, 0.9)} SELECT symbol, t, action FROM a".replace("* 0.9", "* (1 - 0.9)"),
    "sim_account": f"WITH RECURSIVE {_FLAGSHIP} SELECT symbol, t, action, in_trade, round(aux, 6) AS aux, round(adj, 6) AS adj_account_value FROM f",
    "log_trades": f"WITH RECURSIVE {_FLAGSHIP}, {trade_rows()} SELECT symbol, t, in_trade, round(adj, 6) AS adj_account_value FROM l WHERE trade",
    "sim_segments": f"""WITH RECURSIVE {bars()}, d AS (SELECT *, (r - 1) // 50 AS segment, {mean('c', 3)} AS fast, {mean('c', 9)} AS slow FROM n),
    a AS (SELECT symbol, segment, t, c, CASE WHEN fast < slow AND lag(fast < slow, 1, FALSE) OVER (PARTITION BY symbol, segment ORDER BY t) THEN 'x' WHEN fast > slow THEN 'e' ELSE 'h' END AS action FROM d),
    {account(_FEE, 'symbol, segment')} SELECT symbol, segment, t, action, in_trade, round(adj, 6) AS adj_account_value FROM f""",
    "sweep_averages": f"""{_swept(SWEPT, ['num_trades', 'return_perc', 'sharpe_ratio', 'drawdown_metrics_max_drawdown_pct'])} SELECT variant, symbol, num_trades, return_perc,
    round(return_perc + 2 * sharpe_ratio - 0.5 * abs(drawdown_metrics_max_drawdown_pct) + CASE WHEN num_trades < 5 THEN -5 ELSE 0 END, 6) AS fitness FROM r""",
    "sweep_best": f"""{_swept(HUNDRED, ['num_trades', 'return_perc'])} SELECT variant, round(avg(return_perc), 6) AS mean_return, CAST(sum(num_trades) AS BIGINT) AS num_trades
    FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "sig_two_frequencies": f"""WITH h AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS s, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l,
    arg_max(value, (ts, event_id)) AS c, count(*) AS v FROM events GROUP BY 1, 2),
    k AS (SELECT symbol, s // 14400 * 14400 AS t, arg_min(c, s) AS c FROM h GROUP BY 1, 2),
    q AS (SELECT symbol, unnest(generate_series(min(t), max(t), 14400)) AS t FROM k GROUP BY 1),
    b AS (SELECT q.symbol, q.t, k.c AS g FROM q LEFT JOIN k ON k.symbol = q.symbol AND k.t = q.t),
    p AS (SELECT *, {over('avg({})', 3, 'g')} AS f0, last_value(g IGNORE NULLS) {RUN} AS c FROM b),
    e AS (SELECT symbol, t // 86400 * 86400 AS t, arg_max(c, t) AS c FROM p GROUP BY 1, 2),
    w AS (SELECT symbol, t, {over('avg({})', 2, 'c')} AS day FROM e),
    u AS (SELECT p.symbol, p.t, last_value(f0 IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.t) AS fast, last_value(w.day IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.t) AS day
    FROM p LEFT JOIN w ON w.symbol = p.symbol AND w.t = p.t)
    SELECT symbol, t, CASE WHEN fast < day THEN 'x' WHEN fast > day THEN 'e' ELSE 'h' END AS action, round(fast, 6) AS fast, round(day, 6) AS day FROM u""",
    "bars_7min": _grouped("(t - t0) // 420 * 420 + t0", ", d0 AS (SELECT symbol, min(t) // 86400 * 86400 AS t0 FROM n0 GROUP BY 1), n AS (SELECT * FROM n0 JOIN d0 USING (symbol))").replace(bars(3600), bars(60).replace("n AS", "n0 AS", 1)) + f" SELECT symbol, t{_FIVE} FROM g",
    "bars_5day": _grouped("(t - t0) // 432000 * 432000 + t0", ", d0 AS (SELECT symbol, min(t) // 86400 * 86400 AS t0 FROM n0 GROUP BY 1), n AS (SELECT * FROM n0 JOIN d0 USING (symbol))").replace("n AS (SELECT *, row", "n0 AS (SELECT *, row", 1)
    + f", q AS (SELECT symbol, unnest(generate_series(min(t), max(t), 432000)) AS t FROM g GROUP BY 1) SELECT q.symbol, q.t{_FIVE.replace('round(v, 6)', 'coalesce(round(v, 6), 0)')} FROM q LEFT JOIN g ON g.symbol = q.symbol AND g.t = q.t",
    "bars_week": f"{_grouped(_WEEK)} SELECT symbol, t{_FIVE} FROM g",
    "bars_first": f"""WITH {bars(3600)}, g AS (SELECT symbol, t // 86400 * 86400 AS t, arg_min(o, t) AS o, arg_min(h, t) AS h, arg_min(l, t) AS l, arg_min(c, t) AS c, arg_min(v, t) AS v FROM n GROUP BY 1, 2)
    SELECT symbol, t{_FIVE} FROM g WHERE t BETWEEN epoch(TIMESTAMP '2024-01-03') AND epoch(TIMESTAMP '2024-01-20')""",
    "bars_grid": f"""WITH {bars(600)}, q AS (SELECT symbol, unnest(generate_series(min(t), max(t), 600)) AS t FROM n GROUP BY 1)
    SELECT q.symbol, q.t, {', '.join(f'round(last_value(n.{x} IGNORE NULLS) OVER z, 6) AS v{k}' for k, x in enumerate('ohlcv'))} FROM q LEFT JOIN n ON n.symbol = q.symbol AND n.t = q.t
    WINDOW z AS (PARTITION BY q.symbol ORDER BY q.t)""",
    "bars_trending": f"WITH {bars()} SELECT symbol, t, coalesce(c > {lagged('c', 2)}, FALSE) AS up, coalesce(c < {lagged('c', 2)}, FALSE) AS down FROM n",
    "bars_frequency": f"""WITH {bars(600)}, d AS (SELECT symbol, t - {lagged('t')} AS step FROM n), k AS (SELECT symbol, step, count(*) AS k FROM d WHERE step IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, arg_max(step, (k, -step)) AS step FROM k GROUP BY 1""",
    "regime_labels": f"""WITH {_REGIME.split(' SELECT symbol, t, round(ret')[0]}, y AS (SELECT symbol, coalesce({over('stddev_samp({})', 20, 'ret')}, 0) AS vol, coalesce((h - l) / nullif(c, 0), 0) AS rng,
    coalesce(CASE WHEN r >= 20 THEN regr_slope(c, r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 0) AS trend,
    coalesce((v - {mean('v', 20)}) / nullif({over('stddev_samp({})', 20, 'v')}, 0), 0) AS z FROM q)
    SELECT symbol, CASE WHEN {_BEST} <= 0 THEN 'Mean reverting' {' '.join(f"WHEN {x} = {_BEST} THEN '{name}'" for name, x in _LABELS.items())} END AS label, count(*) AS n_bars FROM y GROUP BY 1, 2""",
    "screen_symbols": f"""WITH {bars()}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS k FROM n),
    y AS (SELECT *, CASE WHEN k <= 60 THEN c / max(CASE WHEN k <= 60 THEN c END) {RUN} - 1 END AS dd FROM x),
    s AS (SELECT symbol, count(*) AS candles, coalesce(avg(CASE WHEN k <= 30 THEN c * v END), 0) AS q, coalesce(min(dd), 0) AS w, max(t) AS e FROM y GROUP BY 1),
    d AS (SELECT n.symbol, sum(n.c * n.v) AS today FROM n JOIN s ON s.symbol = n.symbol AND n.t > s.e - 86400 GROUP BY 1)
    SELECT symbol, candles, round(today, 6) AS quote_volume_24h, round(q, 6) AS avg_quote_volume_30d, round(w, 6) AS max_drawdown_60d, CASE WHEN candles < 90 THEN 'candles' WHEN w < -0.999 THEN 'drawdown' END AS reason FROM s JOIN d USING (symbol)""",
    "screen_rank": f"""WITH {bars()}, m AS (SELECT symbol, c / nullif({lagged('c', 30)}, 0) - 1 AS a, c / nullif({lagged('c', 60)}, 0) - 1 AS z FROM n),
    q AS (SELECT symbol, 100 * quantile_cont(a, 0.5) + 50 * quantile_cont(z, 0.5) + 100 * quantile_cont(a, 0.25) AS s FROM m GROUP BY 1)
    SELECT symbol, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC NULLS LAST, symbol) AS rank FROM q""",
    "portfolio_log": f"""WITH RECURSIVE {actions(3, 9)}, z AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS r FROM a),
    p AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS r, CAST(1000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS qty, FALSE AS done FROM z
    UNION ALL SELECT z.symbol, z.r, CASE WHEN z.action = 'e' AND p.qty = 0 THEN 0 WHEN z.action = 'x' THEN round(p.cash + p.qty * z.c, 8) ELSE p.cash END,
    CASE WHEN z.action = 'e' AND p.qty = 0 THEN round(p.cash / z.c, 8) WHEN z.action = 'x' THEN 0 ELSE p.qty END,
    (z.action = 'e' AND p.qty = 0 AND p.cash > 0) OR (z.action = 'x' AND p.qty > 0) FROM p JOIN z ON z.symbol = p.symbol AND z.r = p.r + 1)
    SELECT symbol, t, CASE WHEN done THEN action ELSE 'h' END AS action, round(cash, 4) AS cash, round(qty, 4) AS position_qty, round(cash + qty * c, 4) AS equity FROM p JOIN z USING (symbol, r)""",
}
ORACLE_SQL["sim_slices"] = ORACLE_SQL["sim_account"]
ORACLE_SQL["ind_slices"] = table(ema("e", "c", 9), *volume_mean("f", 20), out=[mean("c", 20), "e", f"sum(v * tp) {RUN} / sum(v) {RUN}", "f"], step=3600)
ORACLE_SQL["store_bars"] = f"""WITH {bars()} SELECT CASE symbol WHEN 'click' THEN '0700' WHEN 'view' THEN '1INCH' ELSE symbol END AS symbol, t,
    round(o, 6) AS v0, round(h, 6) AS v1, round(l, 6) AS v2, round(CASE WHEN t % 86400 >= 28800 THEN c ELSE 2 * c END, 6) AS v3, round(v, 6) AS v4 FROM n"""
_HMM = hmm_tables(ORACLE_SQL["regime_features"], len(FEATURES), HMM_ROUNDS, STAY, FLOOR)
ORACLE_SQL["regime_train"] = f"WITH RECURSIVE {_HMM} {hmm_model(HMM_ROUNDS, len(FEATURES))}"
ORACLE_SQL["regime_apply"] = f"WITH RECURSIVE {_HMM}, {hmm_path(HMM_ROUNDS)}"


def _ranged() -> str:
    """Variants of different frequencies and ranges: each on its own grid, whose gaps the first average sees and the second doesn't."""
    keys, by = "variant, symbol", "PARTITION BY variant, symbol ORDER BY t"
    step = {name: seconds(r["freq"]) for name, r in RANGED.items()}
    inside = {name: f"AND e.t // {step[name]} * {step[name]} >= epoch(TIMESTAMP '{r['start']}') AND e.t // {step[name]} * {step[name]} < epoch(TIMESTAMP '{r['stop']}') + 86400" if "start" in r else "" for name, r in RANGED.items()}
    each = " UNION ALL ".join(f"SELECT '{name}' AS variant, symbol, t // {n} * {n} AS t, arg_min(c, t) AS g FROM n e WHERE TRUE {inside[name]} GROUP BY ALL" for name, n in step.items())
    grid = " UNION ALL ".join(f"SELECT variant, symbol, unnest(generate_series(min(t), max(t), {n})) AS t FROM rk WHERE variant = '{name}' GROUP BY 1, 2" for name, n in step.items())
    own = lambda x: x.replace("PARTITION BY symbol ORDER BY t", by)
    tables, metrics = summary(keys)
    secs = "CASE variant " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in step.items()) + " END"
    chosen = listed({k: metrics[k].replace("14400", secs) for k in ("num_trades", "return_perc", "total_tics", "perc_missing")}, keys)
    return f"""WITH RECURSIVE {bars(3600)}, rk AS ({each}), rq AS ({grid}),
    rg AS (SELECT rq.variant, rq.symbol, rq.t, rk.g FROM rq LEFT JOIN rk ON rk.variant = rq.variant AND rk.symbol = rq.symbol AND rk.t = rq.t),
    r0 AS (SELECT *, {own(mean('g', 3))} AS f0, last_value(g IGNORE NULLS) OVER ({by}) AS c FROM rg),
    r1 AS (SELECT *, last_value(f0 IGNORE NULLS) OVER ({by}) AS fast, {own(mean('c', 9))} AS slow FROM r0),
    a AS (SELECT variant, symbol, t, c, CASE WHEN fast < slow AND lag(fast < slow, 1, FALSE) OVER ({by}) THEN 'x' WHEN fast > slow THEN 'e' ELSE 'h' END AS action FROM r1),
    {account(_FEE, keys)}, {trade_rows(keys)}, {tables} SELECT {chosen} FROM w GROUP BY {keys}"""


ORACLE_SQL["sweep_ranges"] = _ranged()
