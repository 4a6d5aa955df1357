"""Strategies: a declarative document becomes one lazy plan of bars, indicators, actions and account.

Bars are shuffled by key once; indicators and actions are window expressions over
that partitioning. The account's rounding recurrence runs in one ordered pass that
streams through the sorted bars and touches only the bars on which a trade opens
or closes. What follows shares one more partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import slices
from ..functions.indicators import INDICATORS, Bars, column_name, look_back, with_indicator, with_plain_indicators, with_sliced_indicators
from ..sources.bars import OHLCV, between, bucket, filled, first_values, regrid, regrid_by, resample, seconds, within
from ..sources.staging import Stages

OPERATORS = {">": "gt", "<": "lt", "=": "eq", ">=": "ge", "<=": "le", "!=": "ne"}
REQUIRED = ("datapoints", "enter", "exit")
#: Keys that once said what start and stop say.
DEPRECATED = {"start_date", "end_date"}
#: Keys that say where a document's bars come from or how it is named.
DESCRIPTIVE = {"name", "symbol", "exchange", "strategy_name", "comment", "chart_start", "chart_stop", "lot_size_perc"}


@dataclass(frozen=True)
class Strategy:
    """A strategy document; ``logics`` are [left, operator, right, bars it must have held]."""

    datapoints: list[dict] = field(default_factory=list)
    enter: list = field(default_factory=list)
    exit: list = field(default_factory=list)
    any_enter: list = field(default_factory=list)
    any_exit: list = field(default_factory=list)
    base_balance: float = 1000.0
    comission: float = 0.0
    trailing_stop_loss: float = 0.0
    lot_size: float = 1.0
    max_lot_size: float = 0.0
    exit_on_end: bool = False
    rules: list = field(default_factory=list)
    freq: str | None = None
    start: object = None
    stop: object = None

    @classmethod
    def of(cls, document: Mapping, complete: bool = False) -> Strategy:
        """From a document; null values are the defaults, and chart_period stands for freq.

        ``complete``: the document must have all required keys, and its logics may
        only name columns of bars and datapoints.
        """
        errors = validate(document, complete)
        if errors:
            raise ValueError("; ".join(f"{k}: {m}" for k, found in errors.items() for m in found))
        known = {k: v for k, v in document.items() if k in cls.__dataclass_fields__ and v is not None}
        for old, new in (("chart_period", "freq"), ("chart_start", "start"), ("chart_stop", "stop")):
            if document.get(old):
                known[new] = document[old] if old == "chart_period" else known.get(new) or document[old]
        return cls(**known | {"lot_size": known.get("lot_size") or 1.0})

    def errors(self) -> list[str]:
        """What is wrong, as messages."""
        return [m for found in validate({f: getattr(self, f) for f in self.__dataclass_fields__}, False).values() for m in found]


def validate(document: Mapping, complete: bool = True) -> dict[str, list[str]]:
    """What is wrong with a document: messages by key."""
    found: dict[str, list[str]] = {}
    say = lambda key, message: found.setdefault(key, []).append(message)
    for key in REQUIRED if complete else ():
        if not document.get(key) and (key != "datapoints" or document.get(key) is None):
            say(key, "is missing")
    if complete and "start" not in document:
        say("start", "is missing")
    known = set(Strategy.__dataclass_fields__) | DESCRIPTIVE | {"chart_period"}
    for key in document.keys() - known:
        say(key, 'is deprecated: use "start" and "stop"' if key in DEPRECATED else "is not known")
    for key in ("freq", "chart_period"):
        if document.get(key):
            try:
                seconds(document[key])
            except ValueError as e:
                say(key, str(e))
    points = document.get("datapoints") or []
    names = [d.get("name") for d in points]
    for d in points:
        if d.get("transformer") not in INDICATORS:
            say("datapoints", f"{d.get('name')}: unknown transformer {d.get('transformer')}")
        if d.get("freq"):
            try:
                seconds(d["freq"])
            except ValueError as e:
                say("datapoints", f"{d.get('name')}: {e}")
    if len(set(names)) < len(names) or None in names:
        say("datapoints", "names must be given and differ")
    heads = [f"{d.get('name')}_{d.get('transformer')}_" for d in points]
    for group in ("enter", "exit", "any_enter", "any_exit"):
        for rule in document.get(group) or []:
            if len(rule) not in (3, 4):
                say(group, f"not a logic: {rule}")
                continue
            if rule[1] not in OPERATORS or rule[1] == "!=":
                say(group, f"unknown operator {rule[1]}")
            if len(rule) == 4 and int(rule[3] or 0) < 0:
                say(group, f"negative lookback: {rule}")
            for x in (rule[0], rule[2]) if complete else ():
                if isinstance(x, str) and number(x) is None and x not in (*names, *OHLCV) and not any(x.startswith(h) for h in heads):
                    say(group, f"{x} is no datapoint")
    if not 0 <= float(document.get("lot_size") or 0) <= 1:
        say("lot_size", "must lie between 0 and 1")
    return found


def number(x) -> float | None:
    """A number, or text that is one."""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(x)
    return float(x) if isinstance(x, str) and re.fullmatch(r"\d+|-?\d+\.\d+", x) else None


def _name(x: str) -> str:
    return f"`{x.replace('`', '``')}`"


def _operand(x, names: Mapping[str, str] | None = None) -> str:
    """A number, text that is a number, or a column's name, which ``names`` may stand in for, as SQL."""
    value = number(x)
    return f"{value!r}D" if value is not None else _name((names or {}).get(x, x))


def _over(keys: Iterable[str], back: int | None) -> str:
    start = "UNBOUNDED" if back is None else back
    return f"OVER (PARTITION BY {', '.join(map(_name, keys))} ORDER BY ts ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"


def _logic(rule: list, keys: Iterable[str], names: Mapping[str, str] | None) -> str:
    left, op, right, *back = rule
    now = f"coalesce({_operand(left, names)} {op} {_operand(right, names)}, {'true' if op == '!=' else 'false'})"
    n = int(back[0] or 0) if back else 0
    return f"(count(1) {_over(keys, n - 1)} = {n} AND min({now}) {_over(keys, n - 1)})" if n >= 2 else now


def _joined(rules: list, word: str, keys: Iterable[str], names: Mapping[str, str] | None) -> str:
    return f" {word} ".join(_logic(r, keys, names) for r in rules) or "false"


def logic(rule: list, keys: Iterable[str] = ("symbol",), names: Mapping[str, str] | None = None) -> Column:
    """Whether a logic holds, now and on the bars before that its lookback asks for; nulls hold nothing but !=."""
    return F.expr(_logic(rule, keys, names))


def every(rules: list, keys=("symbol",), names=None) -> Column:
    return F.expr(_joined(rules, "AND", keys, names))


def some(rules: list, keys=("symbol",), names=None) -> Column:
    return F.expr(_joined(rules, "OR", keys, names))


def action_of(s: Strategy, keys: tuple[str, ...] = ("symbol",), names: Mapping[str, str] | None = None) -> Column:
    """The first of tsl, x, ax, e, ae that holds, otherwise h. One SQL text, as a sweep has one for each variant."""
    cases = [("x", _joined(s.exit, "AND", keys, names)), ("ax", _joined(s.any_exit, "OR", keys, names)), ("e", _joined(s.enter, "AND", keys, names)), ("ae", _joined(s.any_enter, "OR", keys, names))]
    if s.trailing_stop_loss:
        cases.insert(0, ("tsl", f"coalesce(close <= max(close) {_over(keys, None)} * {1 - float(s.trailing_stop_loss)!r}D, false)"))
    return F.expr(f"CASE {' '.join(f"WHEN {held} THEN '{action}'" for action, held in cases)} ELSE 'h' END")


def stop_level(s: Strategy, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """The trailing stop: a share of the highest close so far."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return F.max("close").over(w) * (1 - float(s.trailing_stop_loss))


def with_actions(df: DataFrame, s: Strategy, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ``action`` and, where the strategy has one, the trailing_stop_loss."""
    df = df.withColumn("trailing_stop_loss", stop_level(s, keys)) if s.trailing_stop_loss else df
    return df.withColumn("action", action_of(s, keys))


def _points(df: DataFrame, points: list[tuple[str, Mapping]], keys: tuple[str, ...]) -> DataFrame:
    """Adds the columns of datapoints (name, document); one of a coarser freq is computed on its own bars and shown from each one's first base bar on."""
    have = df.columns
    plain = [(name, d["transformer"], d.get("args") or ()) for name, d in points if not d.get("freq")]
    df = with_plain_indicators(df, plain, keys) if plain else df
    for name, d in points:
        if d.get("freq"):
            coarse = resample(df.select(*keys, "ts", *OHLCV), d["freq"], keys, empty=True)
            coarse = coarse.withColumns({c: filled(c, keys) for c in OHLCV})
            made = with_indicator(coarse, name, d["transformer"], d.get("args") or (), keys)
            df = df.join(made.drop(*OHLCV), [*keys, "ts"], "left")
    return df.withColumns({c: filled(F.col(f"`{c}`"), keys) for c in df.columns if c not in have})


def chart(bars: DataFrame, s: Strategy, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The bars on the grid of the strategy's freq, in its range, shuffled by key; gaps have no values."""
    bars = between(first_values(bars, s.freq, keys) if s.freq else bars, s.start, s.stop).repartition(*keys)
    return regrid(bars, s.freq, fill=False, keys=keys) if s.freq else bars


def with_datapoints(bars: DataFrame, s: Strategy, keys: tuple[str, ...] = ("symbol",), warm_up: bool = False) -> DataFrame:
    """The chart with all datapoints. The first one sees the gaps; then the last values are carried forward, bars' and datapoints'.

    ``warm_up``: datapoints also see the bars before the strategy's start.
    """
    if warm_up and s.start:
        return between(with_datapoints(bars, replace(s, start=None), keys), s.start)
    df = chart(bars, s, keys)
    points = [(d["name"], d) for d in s.datapoints]
    if s.freq and points:
        df = _points(df, points[:1], keys).withColumns({c: filled(c, keys) for c in bars.columns if c not in (*keys, "ts")})
        points = points[1:]
    return _points(df, points, keys) if points else df


def _r8(x: float) -> float:
    return np.rint(x * 1e8) / 1e8


def trade(cash: float, aux: float, price: float, opens: bool, lot: float, cap: float, comission: float, plain: bool = False) -> tuple[float, float, float]:
    """(cash, holdings, fee) after a trade; ``plain``: cash is rounded as a decimal, as for a first entry."""
    if not opens:
        base = _r8(aux * price)
        fee = _r8(base * comission / 100)
        return _r8(cash + base - fee), 0.0, fee
    amount = min(cash * lot, cap) if cap else cash * lot
    aux = _r8(amount / price)
    fee = _r8(aux * comission / 100)
    return round(cash - amount, 8) if plain else _r8(cash - amount), aux - fee, fee


_TERMS = {"_base": "base_balance", "_lot": "lot_size", "_cap": "max_lot_size", "_fee": "comission"}


def terms(s: Strategy) -> dict[str, Column]:
    return {c: F.lit(float(getattr(s, f) or 0)) for c, f in _TERMS.items()}


def _account(keys: list[str]):
    """Streams bars sorted by key and time and adds cash, aux and fee; state is kept from batch to batch, and Python sees only the trades."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, fresh = None, (0.0, 0.0), True
        for batch in batches:
            n = batch.num_rows
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            at = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("close", "_event", "in_trade", *_TERMS)}
            begins = np.array([k == 0 or names[k] != names[k - 1] for k in range(n)], bool)
            if n and names[0] == key:
                begins[0] = False
            marks = np.flatnonzero(begins | at["_event"].astype(bool))
            values = np.zeros((len(marks) + 1, 2))
            values[0] = state
            fees = np.zeros(n)
            for i, k in enumerate(marks.tolist(), 1):
                if begins[k]:
                    state, fresh = (float(at["_base"][k]), 0.0), True
                if at["_event"][k]:
                    *now, fees[k] = trade(*state, at["close"][k], bool(at["in_trade"][k]), at["_lot"][k], at["_cap"][k], at["_fee"][k], fresh)
                    state, fresh = tuple(now), False
                values[i] = state
            key = names[-1] if n else key
            held = values[np.searchsorted(marks, np.arange(n), side="right")]
            made = [pa.array(held[:, 0]), pa.array(held[:, 1]), pa.array(fees)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "account_value", "aux", "fee"])

    return run


def simulate(df: DataFrame, s: Strategy | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds in_trade, aux, account_value, adj_account_value, fee and the changes of adj_account_value.

    Whether a trade is open follows from the last action that is not a hold, so
    only bars where that changes are events. Without ``s`` the columns of
    ``terms`` and ``_close_end`` say what holds for each row.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    if s is not None:
        df = df.withColumns(terms(s) | {"_close_end": F.lit(bool(s.exit_on_end))})
    code = F.when(F.col("action").isin("e", "ae"), 1).when(F.col("action").isin("x", "ax", "tsl"), 2)
    df = df.withColumn("in_trade", F.coalesce(F.last(code, ignorenulls=True).over(sofar) == 1, F.lit(False)))
    # a trade still open at the end is closed by one more row, a second later
    closing = F.col("_close_end") & F.col("in_trade") & F.lead("ts").over(w).isNull()
    df = df.withColumn("_copies", F.when(closing, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).withColumn("_copy", F.explode("_copies"))
    extra = F.col("_copy") == 1
    df = df.withColumns({"ts": F.when(extra, F.col("ts") + F.expr("interval 1 second")).otherwise(F.col("ts")), "in_trade": F.col("in_trade") & ~extra, "action": F.when(extra, "x").otherwise(F.col("action"))}).drop("_copies", "_copy", "_close_end")
    df = df.withColumn("_event", F.col("in_trade") != F.coalesce(F.lag("in_trade").over(w), F.lit(False)))
    shape = StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in ("account_value", "aux", "fee"))])
    # rows are partitioned and sorted as the window above left them, so neither step adds work
    df = df.sortWithinPartitions(*keys, "ts").mapInArrow(_account(list(keys)), shape).drop("_event", *_TERMS)
    df = df.withColumn("adj_account_value", F.col("account_value") + F.rint(F.col("aux") * F.col("close") * 1e8) / 1e8)
    before = F.lag("adj_account_value").over(w)
    return df.withColumns({"adj_account_value_change": F.col("adj_account_value") - before, "adj_account_value_change_perc": F.try_divide(F.col("adj_account_value"), before) - 1})


def longest_lookback(s: Strategy) -> int:
    return max([int(r[3] or 0) for g in (s.enter, s.exit, s.any_enter, s.any_exit) for r in g if len(r) == 4], default=0)


def sliced_datapoints(bars: DataFrame, s: Strategy, rows: int, keys: tuple[str, ...], stages: Stages) -> DataFrame:
    """As ``with_datapoints``, slice by slice; bars are in slices, with a halo for the logics' lookbacks.

    Datapoints of a freq of their own, and those that need all of a symbol's bars
    together, are still made symbol by symbol.
    """
    bars = between(first_values(bars, s.freq, keys) if s.freq else bars, s.start, s.stop)
    if s.freq:
        bars = stages(slices.regrid(slices.cut(bars, rows, 0, keys).drop("_own", "_next"), seconds(s.freq), keys))
    raw = [c for c in bars.columns if c not in (*keys, "ts", "_slice")]
    bound = {d["name"]: None if d.get("freq") else look_back(d["transformer"], d.get("args") or ()) for d in s.datapoints}
    df = slices.cut(bars, rows, max([longest_lookback(s), *(n or 0 for n in bound.values())]) + 1, keys)
    # the first datapoint sees the gaps of a grid, the others see bars without gaps
    for first, points in ((True, s.datapoints[:1]), (False, s.datapoints[1:])) if s.freq else ((False, s.datapoints),):
        have = df.columns
        sliced = [(d["name"], d["transformer"], d.get("args") or ()) for d in points if bound[d["name"]] is not None]
        df = with_sliced_indicators(df, sliced, keys, stages) if sliced else slices.own(df)
        whole = [(d["name"], d) for d in points if bound[d["name"]] is None]
        df = _points(df, whole, keys) if whole else df
        df = slices.carried(df, [c for c in df.columns if c not in have] + (raw if first else []), keys, stages)
        df = slices.with_halo(df, keys)
    return df


def sliced_actions(df: DataFrame, s: Strategy, keys: tuple[str, ...], stages: Stages) -> DataFrame:
    """As ``with_actions``, of bars in slices; halos are dropped."""
    df = slices.own(df.withColumn("action", action_of(replace(s, trailing_stop_loss=0.0), (*keys, "_slice"))))
    if not s.trailing_stop_loss:
        return df
    df = slices.before(df, {"_peak": (F.max("close"), F.max)}, keys, stages)
    sofar = Window.partitionBy(*keys, "_slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    level = F.greatest(F.max("close").over(sofar), "_peak") * (1 - float(s.trailing_stop_loss))
    df = df.withColumn("trailing_stop_loss", level).drop("_peak")
    return df.withColumn("action", F.when(F.coalesce(F.col("close") <= F.col("trailing_stop_loss"), F.lit(False)), "tsl").otherwise(F.col("action")))


def sliced_account(df: DataFrame, s: Strategy, keys: tuple[str, ...], stages: Stages) -> DataFrame:
    """As ``simulate``, of bars in slices: only the bars on which a trade opens or closes meet symbol by symbol, and their states are carried to the others slice by slice."""
    w = Window.partitionBy(*keys, "_slice").orderBy("ts")
    sofar, first = w.rowsBetween(Window.unboundedPreceding, 0), F.row_number().over(w) == 1
    last = lambda x: F.last(x, ignorenulls=True)
    code = F.when(F.col("action").isin("e", "ae"), 1).when(F.col("action").isin("x", "ax", "tsl"), 2)
    df = slices.before(df.drop("_own", "_next").withColumn("_code", code), {"_held": (F.max_by("_code", F.when(F.col("_code").isNotNull(), F.col("ts"))), last)}, keys, stages)
    df = df.withColumn("_now", F.coalesce(last(F.col("_code")).over(sofar), "_held"))
    held = {"in_trade": F.col("_now"), "_was": F.when(first, F.col("_held")).otherwise(F.lag("_now").over(w))}
    df = df.withColumns({n: F.coalesce(c == 1, F.lit(False)) for n, c in held.items()}).drop("_code", "_held", "_now")
    if s.exit_on_end:  # a trade still open at the end is closed by one more row, a second later
        end = df.groupBy(*keys).agg(F.max("ts").alias("_end"))
        closing = F.col("in_trade") & (F.col("ts") == F.col("_end"))
        df = df.join(end, list(keys)).withColumn("_copy", F.explode(F.when(closing, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        extra = F.col("_copy") == 1
        more = {"ts": F.col("ts") + F.expr("interval 1 second"), "in_trade": F.lit(False), "_was": F.lit(True), "action": F.lit("x")}
        df = df.withColumns({n: F.when(extra, c).otherwise(F.col(n)) for n, c in more.items()}).drop("_end", "_copy")
    df = df.withColumn("_event", F.col("in_trade") != F.col("_was")).drop("_was")
    trades = df.where("_event").select(*keys, "_slice", "ts", "close", "in_trade", "_event").withColumns(terms(s))
    made = ("account_value", "aux", "fee")
    shape = StructType([*trades.schema.fields, *(StructField(c, DoubleType()) for c in made)])
    trades = trades.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInArrow(_account(list(keys)), shape).select(*keys, "_slice", "ts", *made)
    df = df.drop("_event").join(trades, [*keys, "_slice", "ts"], "left")
    known = F.when(F.col("aux").isNotNull(), F.col("ts"))
    ends = {"_cash": (F.max_by("account_value", known), last), "_aux": (F.max_by("aux", known), last), "_close": (F.max_by("close", "ts"), F.last)}
    df = slices.before(df, ends, keys, stages)
    worth = lambda cash, aux, close: cash + F.rint(aux * close * 1e8) / 1e8
    start = {"_cash": F.coalesce("_cash", F.lit(float(s.base_balance))), "_aux": F.coalesce("_aux", F.lit(0.0))}
    df = df.withColumns(start)
    df = df.withColumns({"account_value": F.coalesce(last(F.col("account_value")).over(sofar), "_cash"), "aux": F.coalesce(last(F.col("aux")).over(sofar), "_aux"), "fee": F.coalesce("fee", F.lit(0.0))})
    df = df.withColumn("adj_account_value", worth(F.col("account_value"), F.col("aux"), F.col("close")))
    before = F.when(first, worth(F.col("_cash"), F.col("_aux"), F.col("_close"))).otherwise(F.lag("adj_account_value").over(w))
    df = df.withColumn("_before", before)
    changes = {"adj_account_value_change": F.col("adj_account_value") - F.col("_before"), "adj_account_value_change_perc": F.try_divide(F.col("adj_account_value"), F.col("_before")) - 1}
    return df.withColumns(changes).drop("_before", "_cash", "_aux", "_close", "_slice")


def backtest(bars: DataFrame, s: Strategy, keys: tuple[str, ...] = ("symbol",), slice_rows: int | None = None) -> DataFrame:
    """Bars with indicators, actions and the account. ``slice_rows``: bars are cut into slices of about so many, so that long symbols take many tasks."""
    if slice_rows:
        stages = Stages()
        return sliced_account(sliced_actions(sliced_datapoints(bars, s, slice_rows, keys, stages), s, keys, stages), s, keys, stages)
    return simulate(with_actions(with_datapoints(bars, s, keys), s, keys), s, keys)


def in_segments(df: DataFrame, size: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ``segment``, which as a further key makes each run of ``size`` bars an account and a lookback of its own."""
    return df.withColumn("segment", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1) / size))


def backtest_segments(bars: DataFrame, s: Strategy, size: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Datapoints over all bars, actions and account anew in each segment of ``size`` bars."""
    df, parts = in_segments(with_datapoints(bars, s, keys), size, keys), (*keys, "segment")
    if s.trailing_stop_loss:  # the stop's level is of the whole chart
        df = df.withColumn("trailing_stop_loss", stop_level(s, keys)).withColumn("_tsl", F.coalesce(F.col("close") <= F.col("trailing_stop_loss"), F.lit(False)))
        plain = replace(s, trailing_stop_loss=0.0)
        return simulate(df.withColumn("action", F.when(F.col("_tsl"), "tsl").otherwise(action_of(plain, parts))).drop("_tsl"), s, parts)
    return simulate(df.withColumn("action", action_of(s, parts)), s, parts)


def trade_log(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The first bar of every run of equal in_trade, each column's first value of the run, but for runs whose account value didn't change then."""
    return _with_trades(df, keys).where("_trade").withColumns({"adj_account_value_change": F.col("_change"), "adj_account_value_change_perc": F.col("_perc")}).drop("_run", "_trade", "_change", "_perc")


def validate_run(df: DataFrame, s: Strategy) -> list[str]:
    """What a finished run lacks: rows, or columns of a datapoint."""
    lacking = [f"datapoint {d['name']} has no column" for d in s.datapoints if not any(c == d["name"] or c.startswith(f"{d['name']}_") for c in df.columns)]
    return lacking + (["there are no bars"] if df.isEmpty() else [])


def _with_trades(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds _run, the number of the run of equal in_trade, _trade, whether the bar is in the trade log, and its _change and _perc there."""
    w = Window.partitionBy(*keys).orderBy("ts")
    first = ~F.lag("in_trade").over(w).eqNullSafe(F.col("in_trade"))
    df = df.withColumn("_first", first).withColumn("_run", F.sum(F.col("_first").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = ~F.lead("_first").over(w)
    value = lambda c: F.coalesce(F.col(c), F.when(within, F.lead(c).over(w)))
    df = df.withColumns({"_change": value("adj_account_value_change"), "_perc": value("adj_account_value_change_perc")})
    return df.withColumn("_trade", F.col("_first") & F.coalesce(F.col("_change") != 0, F.lit(True))).drop("_first")


def _r3(x: Column) -> Column:
    return F.coalesce(F.rint(x * 1000) / 1000, F.lit(0.0))


def _r4(x: Column) -> Column:
    return F.coalesce(F.rint(x * 1e4) / 1e4, F.lit(0.0))


def _spaced(values: Column, gaps: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of the values and of as many zeros as ``gaps``."""
    k = F.count(values)
    n = k + gaps
    mean = F.try_divide(F.sum(values), n)
    squares = k * F.var_pop(values) + k * F.pow(F.avg(values) - mean, F.lit(2.0)) + gaps * mean * mean
    return mean, F.sqrt(F.try_divide(squares, F.nullif(n - 1, F.lit(0))))


def summarize(df: DataFrame, keys: tuple[str, ...] = ("symbol",), freq: str | None = None, step: Column | None = None) -> DataFrame:
    """One row for each key with the metrics of the run; groups of metrics are structs. Values are rounded to three places, and what can't be computed is 0, but null in time_analysis.

    All of it is one pass of windows over the keys and one aggregation. Missing bars
    are counted for a ``freq``, or a ``step`` in seconds, a column that is the same
    for all rows of a key and null where they aren't to be counted.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    sofar, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    adj, pct, equity = F.col("adj_account_value"), F.col("adj_account_value_change_perc"), "adj_account_value"
    month = F.year("ts") * 12 + F.month("ts")
    df = _with_trades(df, keys).withColumns(
        {
            "_dd": adj / F.max(adj).over(sofar) - 1,
            "_day": F.when(~F.lead(F.to_date("ts")).over(w).eqNullSafe(F.to_date("ts")), adj),
            "_month": F.when(~F.lead(month).over(w).eqNullSafe(month), adj),
            "_held": F.when(F.col("_trade"), F.bround((F.unix_seconds("ts") - F.unix_seconds(F.last(F.when(F.col("_trade"), F.col("ts")), ignorenulls=True).over(before))) / 10, 0) * 10),
            "_win": F.when(F.col("_trade"), F.coalesce(F.col("_perc") > 0, F.lit(False))),
        }
    )
    df = df.withColumns(
        {
            "_dret": F.try_divide(F.col("_day"), F.last("_day", ignorenulls=True).over(before)) - 1,
            "_mret": F.try_divide(F.col("_month"), F.last("_month", ignorenulls=True).over(before)) - 1,
            "_sank": F.coalesce(~F.lag(F.col("_dd") < 0).over(w).eqNullSafe(F.col("_dd") < 0), F.lit(True)),
            "_turned": F.col("_trade") & ~F.last("_win", ignorenulls=True).over(before).eqNullSafe(F.col("_win")),
        }
    )
    df = df.withColumns({"_sink": F.sum(F.col("_sank").cast("long")).over(sofar), "_streak": F.sum(F.col("_turned").cast("long")).over(sofar)})
    length = lambda of, what: F.count(F.when(what, 1)).over(Window.partitionBy(*keys, of))
    new_run = F.col("_run") != F.coalesce(F.lag("_run").over(w), F.lit(0))
    df = df.withColumns(
        {
            "_bars_in": F.when(new_run & F.col("in_trade"), length("_run", F.lit(True))),
            "_bars_low": F.when(F.col("_sank") & (F.col("_dd") < 0), length("_sink", F.lit(True))),
            "_streaks": F.when(F.col("_turned"), length("_streak", F.col("_trade"))),
        }
    )
    trade, perc, change = F.col("_trade"), F.when(F.col("_trade"), F.col("_perc")), F.when(F.col("_trade"), F.col("_change"))
    first, last, c0, c1 = F.min_by(equity, "ts"), F.max_by(equity, "ts"), F.min_by("close", "ts"), F.max_by("close", "ts")
    wins, losses, trades = F.when(perc > 0, perc), F.when(perc < 0, perc), F.count_if(trade)
    share = lambda x: _r3(F.try_divide(F.count(x), trades) * 100)
    returns, held = _r3(100 - F.try_divide(first, last) * 100), _r3((1 - F.try_divide(c0, c1)) * 100)
    up, down = F.coalesce(F.sum(wins), F.lit(0.0)), F.coalesce(F.abs(F.sum(losses)), F.lit(0.0))
    quality = F.when((down == 0) & (up > 0), F.lit(float("inf"))).otherwise(_r3(F.try_divide(up, down)))
    drag = _r3(F.try_divide(F.sum("fee"), last) * 100)
    worst = F.min("_dd")
    days = F.datediff(F.max("ts"), F.min("ts"))
    months = (F.year(F.max("ts")) - F.year(F.min("ts"))) * 12 + F.month(F.max("ts")) - F.month(F.min("ts"))
    streak = lambda agg, won: agg(F.when(F.col("_win") == won, F.col("_streaks")))
    r3n = lambda x: F.rint(x * 100 * 1000) / 1000
    analysis = []
    for unit, c, n in (("day", "_dret", days), ("month", "_mret", months)):
        x, gaps = F.col(c), n - F.count(c)
        mean, sd = _spaced(x, gaps)
        zero = F.when(gaps > 0, 0.0)
        names = ("avg_daily_return", "daily_return_std", "profitable_days_pct") if unit == "day" else ("avg_monthly_return", "monthly_return_std", "profitable_months_pct")
        analysis += [r3n(F.greatest(F.max(x), zero)).alias(f"best_{unit}"), r3n(F.least(F.min(x), zero)).alias(f"worst_{unit}"), r3n(mean).alias(names[0]), r3n(sd).alias(names[1]), r3n(F.count_if(x > 0) / (n + 1)).alias(names[2])]
    missing = [F.lit(0.0).alias("perc_missing"), F.lit(0).cast("long").alias("total_missing")]
    if freq or step is not None:
        step = F.lit(seconds(freq)) if freq else F.max(step)
        expected = F.floor((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / step) + 1
        found = [F.round((expected - F.count("*")) / expected * 100, 2), F.greatest(expected - F.count("*"), F.lit(0))]
        missing = [F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(found, ("perc_missing", "total_missing"), strict=True)]
    out = df.groupBy(*keys).agg(
        returns.alias("return_perc"),
        _r3(F.try_divide(F.avg(pct), F.stddev_samp(pct)) * F.sqrt(F.count("*"))).alias("sharpe_ratio"),
        held.alias("buy_and_hold_perc"),
        _r3(F.percentile("_held", 0.5)).alias("median_trade_len"),
        _r3(F.avg("_held")).alias("mean_trade_len"),
        _r3(F.max("_held")).alias("max_trade_held"),
        _r3(F.min("_held")).alias("min_trade_len"),
        F.count(wins).alias("total_num_winning_trades"),
        F.count(losses).alias("total_num_losing_trades"),
        _r3(F.avg(wins) * 100).alias("avg_win_perc"),
        _r3(F.avg(losses) * 100).alias("avg_loss_perc"),
        _r4(F.max(perc)).alias("best_trade_perc"),
        _r4(F.min(perc)).alias("min_trade_perc"),
        _r4(F.percentile(perc, 0.5)).alias("median_trade_perc"),
        _r4(F.avg(perc)).alias("mean_trade_perc"),
        trades.alias("num_trades"),
        share(wins).alias("win_perc"),
        share(losses).alias("loss_perc"),
        _r3(F.max("account_value")).alias("equity_peak"),
        _r3(last).alias("equity_final"),
        _r3(F.min(adj)).alias("max_drawdown"),
        _r3(F.sum("fee")).alias("total_fees"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_tic"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_tic"),
        F.count("*").alias("total_tics"),
        *missing,
        F.count_if(F.col("action").isin("e", "ae")).alias("num_of_enter_signals"),
        F.count_if(F.col("action").isin("x", "ax")).alias("num_of_exit_signals"),
        F.count_if(F.col("action") == "h").alias("num_of_hold_signals"),
        _r3(returns - held).alias("market_adjusted_return"),
        F.struct(
            _r3(F.avg(F.when(F.col("in_trade"), F.col("aux")))).alias("avg_position_size"),
            _r3(F.max(F.when(F.col("in_trade"), F.col("aux")))).alias("max_position_size"),
            _r3(F.avg("_bars_in")).alias("avg_position_duration"),
            drag.alias("total_commission_impact"),
        ).alias("position_metrics"),
        F.struct(
            quality.alias("profit_factor"),
            _r3(F.abs(F.try_divide(F.avg(wins), F.avg(losses)))).alias("avg_win_loss_ratio"),
            _r3(F.max(perc)).alias("largest_winning_trade"),
            _r3(F.min(perc)).alias("largest_losing_trade"),
        ).alias("trade_quality"),
        F.struct(_r3(F.avg(F.col("in_trade").cast("int")) * 100).alias("time_in_market_pct"), _r3(F.avg("_bars_in")).alias("avg_trade_duration")).alias("market_exposure"),
        F.struct(
            F.count_if(change > F.col("fee")).alias("num_profitable_after_commission"),
            F.count_if(change <= F.col("fee")).alias("num_unprofitable_after_commission"),
            F.when(trades > 0, drag).otherwise(0.0).alias("commission_drag_pct"),
        ).alias("effective_trades"),
        F.struct(
            _r3(worst * 100).alias("max_drawdown_pct"),
            _r3(F.avg("_dd") * 100).alias("avg_drawdown_pct"),
            _r3(F.max("_bars_low")).alias("max_drawdown_duration"),
            _r3(F.avg("_bars_low")).alias("avg_drawdown_duration"),
            _r3(F.max_by("_dd", "ts") * 100).alias("current_drawdown"),
        ).alias("drawdown_metrics"),
        F.struct(
            _r3(F.try_divide(F.avg(pct), F.stddev_samp(F.when(pct < 0, pct)))).alias("sortino_ratio"),
            _r3(F.try_divide(F.avg(pct), F.abs(worst))).alias("calmar_ratio"),
            _r3(F.percentile(pct, 0.05)).alias("value_at_risk_95"),
            _r3(F.stddev_samp(pct) * F.sqrt(F.lit(252.0))).alias("annualized_volatility"),
            _r3(F.stddev_samp(F.when(pct < 0, pct))).alias("downside_deviation"),
        ).alias("risk_metrics"),
        F.struct(
            F.coalesce(F.max_by("_streaks", F.when(F.col("_turned"), F.col("ts"))), F.lit(0)).alias("current_streak"),
            F.coalesce(streak(F.max, True), F.lit(0)).alias("max_win_streak"),
            F.coalesce(streak(F.max, False), F.lit(0)).alias("max_loss_streak"),
            _r3(streak(F.avg, True)).alias("avg_win_streak"),
            _r3(streak(F.avg, False)).alias("avg_loss_streak"),
        ).alias("trade_streaks"),
        F.struct(*analysis).alias("time_analysis"),
    )
    return out


def flat(summary: DataFrame) -> DataFrame:
    """The summary with each metric of a group as a column group_metric."""
    columns = []
    for f in summary.schema.fields:
        if isinstance(f.dataType, StructType):
            columns += [F.col(f"{f.name}.{x}").alias(f"{f.name}_{x}") for x in f.dataType.names]
        else:
            columns.append(F.col(f.name))
    return summary.select(*columns)


def evaluate_rules(summary: DataFrame, rules: list) -> DataFrame:
    """Adds rules: whether all and any of [column, operator, number or column] hold; a column may be group.metric, and a rule of unknown columns is passed over."""
    known = {f.name for f in summary.schema.fields} | {f"{f.name}.{x}" for f in summary.schema.fields if isinstance(f.dataType, StructType) for x in f.dataType.names}
    path = lambda x: ".".join(map(_name, x.split("."))) if x in known else None
    held = []
    for name, op, value in rules:
        left, right = path(name), path(value) if number(value) is None else f"{number(value)!r}D"
        if left and right:
            held.append(F.expr(f"coalesce({left} {op} {right}, false)") if op in (">", "<", ">=", "<=") else F.lit(False))
    listed = F.array(*held) if held else F.array().cast("array<boolean>")
    return summary.withColumn("rules", F.struct((F.forall(listed, lambda x: x) & F.lit(bool(held))).alias("all"), F.exists(listed, lambda x: x).alias("any"), listed.alias("results")))


def best_runs(summaries: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of summaries with the greatest ``by``."""
    return summaries.orderBy(F.desc(by)).limit(k)


def ranged(bars: DataFrame, ranges: list[tuple], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The bars of several (freq, start, stop) in one pass over them: each bar goes to the ranges that it is in, with ``_range``, their number, as one more key, and ``_step``, the seconds of their freq; gaps have no values."""
    if any(freq and 86400 % seconds(freq) for freq, _, _ in ranges):
        bars = bars.join(bars.groupBy(*keys).agg(F.date_trunc("day", F.min("ts")).alias("_day")), list(keys))
    each = []
    for number, (freq, start, stop) in enumerate(ranges):
        origin = F.col("_day") if freq and 86400 % seconds(freq) else None
        at = bucket(F.col("ts"), freq, origin) if freq else F.col("ts")
        inside = F.lit(True)
        for edge, last in ((start, False), (stop, True)):
            inside = inside if edge is None or edge == "" else inside & within(at, edge, last)
        each.append(F.when(inside, F.struct(F.lit(number).alias("_range"), F.lit(seconds(freq) if freq else None).cast("long").alias("_step"), at.alias("_at"))))
    columns = [c for c in bars.columns if c not in (*keys, "ts", "_day")]
    rows = bars.select(*keys, "ts", *columns, F.inline(F.array_compact(F.array(*each))))
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns]
    parts = (*keys, "_range")
    rows = rows.groupBy(*parts, "_step", "_at").agg(*firsts).withColumnRenamed("_at", "ts").repartition(*parts)
    steps = F.lit(None).cast("long")
    for number, (freq, _, _) in enumerate(ranges):
        steps = F.when(F.col("_range") == number, F.lit(seconds(freq) if freq else None).cast("long")).otherwise(steps)
    return regrid_by(rows.drop("_step"), steps, parts).withColumn("_step", steps)


def outputs_of(s: Strategy) -> dict[str, set[str]]:
    """The columns of each datapoint; raises what is wrong with its arguments."""
    return {d["name"]: {column_name(d["name"], d["transformer"], o) for o in INDICATORS[d["transformer"]](Bars(None), *(d.get("args") or ()))} for d in s.datapoints}


def sound(variants: Mapping[str, Mapping]) -> tuple[dict[str, Strategy], dict[str, str]]:
    """(strategies, errors) by name: documents that can be run, and what is wrong with the others."""
    good, bad = {}, {}
    for name, document in variants.items():
        try:
            s = Strategy.of(document)
            known = {*OHLCV}.union(*outputs_of(s).values())
            for rule in [r for g in (s.enter, s.exit, s.any_enter, s.any_exit) for r in g]:
                if unknown := [x for x in (rule[0], rule[2]) if number(x) is None and x not in known]:
                    raise ValueError(f"{unknown[0]} is no column")
            good[name] = s
        except Exception as e:
            bad[name] = f"{type(e).__name__}: {e}"
    return good, bad


def sweep(bars: DataFrame, variants: Mapping[str, Mapping], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Summaries of many strategy documents over the same bars in one job, with the variant's name.

    Bars are read once: those of each different freq, start and stop become rows of
    a range of their own, and each different datapoint is computed once. A bar's
    actions under the variants of its range become rows, dealt out by key and
    variant, so that account and summary run once and in parallel over the variants;
    the plan grows by an expression a variant.
    """
    known = {name: Strategy.of(d) for name, d in variants.items()}
    if not known:
        raise ValueError("a sweep needs a variant")
    ranges = list(dict.fromkeys((s.freq, s.start, s.stop) for s in known.values()))
    of = {name: ranges.index((s.freq, s.start, s.stop)) for name, s in known.items()}
    if len(ranges) == 1:
        freq, df = ranges[0][0], chart(bars, next(iter(known.values())), keys)
        df = df.withColumns({"_range": F.lit(0), "_step": F.lit(seconds(freq) if freq else None).cast("long")})
        within_range = keys
    else:
        df = ranged(bars, ranges, keys)
        within_range = (*keys, "_range")
    gaps, made = any(freq for freq, _, _ in ranges), {}
    for late in (False, True):
        new = []
        for s in known.values():
            for k, d in enumerate(s.datapoints):
                what = (d["transformer"], str(d.get("args")), d.get("freq"), bool(gaps and k))
                if what not in made and bool(k) == late:
                    made[what] = f"_d{len(made)}"
                    new.append((made[what], d))
        df = _points(df, new, within_range) if new else df
        if gaps and not late and any(s.datapoints for s in known.values()):
            raw = [c for c in bars.columns if c not in (*keys, "ts")]
            df = df.withColumns({c: F.when(F.col("_step").isNotNull(), filled(c, within_range)).otherwise(F.col(c)) for c in raw})
    columns, actions, each = df.columns, {}, {}
    for number_of, (name, s) in enumerate(known.items()):
        names = {}
        for k, d in enumerate(s.datapoints):
            column = made[d["transformer"], str(d.get("args")), d.get("freq"), bool(gaps and k)]
            names |= {c.replace(column, d["name"], 1): c for c in columns if c == column or c.startswith(f"{column}_")}
        actions[f"_a{number_of}"] = action_of(s, within_range, names)
        said = name.replace("\\", "\\\\").replace("'", "\\'")
        money = ", ".join(f"'{c}', {float(getattr(s, f) or 0)!r}D" for c, f in _TERMS.items())
        each.setdefault(of[name], []).append(f"named_struct('variant', '{said}', 'action', _a{number_of}, '_close_end', {str(bool(s.exit_on_end)).lower()}, {money})")
    df = df.withColumns(actions).select(*keys, "_range", "_step", "ts", "close", *actions)
    chosen = F.expr(f"CASE _range {' '.join(f'WHEN {r} THEN array({', '.join(v)})' for r, v in each.items())} END")
    parts = (*keys, "variant")
    df = df.select(*keys, "ts", "close", "_step", F.inline(chosen)).repartition(*parts)
    return summarize(simulate(df, None, parts), parts, step=F.col("_step") if gaps else None)


#: The fitness of a variant that can't be run, a fixed value.
ERROR = -1e9


def fitness(weights: dict[str, float], min_trades: int = 0, penalty: float = -5.0) -> Column:
    """A weighted sum of summary columns, drawdowns by size, less a penalty for too few trades."""
    parts = [(F.abs(F.col(c)) if c.endswith("max_drawdown_pct") else F.col(c)) * float(x) for c, x in weights.items()]
    total = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    return total + F.when(F.col("num_trades") < min_trades, float(penalty)).otherwise(0.0)
