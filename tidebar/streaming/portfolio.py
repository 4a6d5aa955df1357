"""A paper portfolio as a stateful stream: actions of bars become trades and a running state for each key.

``act_on`` is the stream's operator. ``watch`` drives it from a store of bars: each
micro-batch of new bars is judged with a bounded history from the store, and the
actions of the new bars are appended to a folder that the stateful stream reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.strategy import Strategy, with_actions, with_datapoints
from ..sources.bars import read_store
from ..sources.store import BarStore

ACTIONS = "symbol string, ts timestamp, close double, action string"
STATE = "cash double, position_qty double, avg_price double, equity double, last timestamp"
LOG = "symbol string, ts timestamp, price double, action string, side string, qty double, notional double, cash double, position_qty double, avg_price double, equity double"
OPENS, CLOSES = ("e", "ae"), ("x", "ax", "tsl")


def step(state: tuple[float, float, float], action: str, price: float, lot: float, cap: float) -> tuple[tuple[float, float, float], tuple | None]:
    """((cash, quantity, mean price) after an action, (side, quantity, notional) of the trade if there was one); there is no commission."""
    cash, held, mean = state
    if action in OPENS and held <= 0 and price > 0:
        notional = min(cash * lot, cap) if cap else cash * lot
        if notional > 0:
            return (cash - notional, notional / price, price), ("BUY", notional / price, notional)
    elif action in CLOSES and held > 0 and price > 0:
        return (cash + held * price, 0.0, 0.0), ("SELL", held, held * price)
    return state, None


def act_on(actions: DataFrame, s: Strategy) -> DataFrame:
    """The log of a portfolio: a row for each bar of (symbol, ts, close, action), streamed or not, with what was done and the state after it.

    The state of a symbol outlives batches and restarts. Rows within a batch are
    taken in order of time; a bar not later than the last one taken is passed over,
    so that bars sent twice change nothing.
    """
    base, lot, cap = float(s.base_balance), float(s.lot_size or 1), float(s.max_lot_size or 0)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        cash, qty, mean, _, last = held.get if held.exists else (base, 0.0, 0.0, base, None)
        equity, out = cash, []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            if last is not None and row.ts <= pd.Timestamp(last):
                continue
            (cash, qty, mean), done = step((cash, qty, mean), row.action, row.close, lot, cap)
            cash, qty, mean = (round(x, 8) for x in (cash, qty, mean))
            equity, last = round(cash + qty * row.close, 8), row.ts
            side, amount, notional = done or (None, None, None)
            out.append((key[0], row.ts, row.close, row.action if done else "h", side, amount, notional, cash, qty, mean, equity))
        if last is not None:
            held.update((cash, qty, mean, equity, pd.Timestamp(last).to_pydatetime()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    return actions.select("symbol", "ts", "close", "action").groupBy("symbol").applyInPandasWithState(run, LOG, STATE, "append", GroupStateTimeout.NoTimeout)


def longest(s: Strategy) -> int:
    """Bars of history that a strategy's datapoints and lookbacks need, with some to spare."""
    periods = [int(a) for d in s.datapoints for a in d.get("args") or () if isinstance(a, int)]
    backs = [int(r[3] or 0) for g in (s.enter, s.exit, s.any_enter, s.any_exit) for r in g if len(r) == 4]
    return max(200, max([*periods, *backs], default=0) + 10)


def judge_new(spark: SparkSession, store: str, new: DataFrame, s: Strategy) -> DataFrame:
    """The actions of the new bars, from the last bars of their symbols in the store."""
    names = new.groupBy("symbol").agg(F.min("ts").alias("_from"))
    bars = read_store(spark, store).join(names, "symbol")
    place = F.row_number().over(Window.partitionBy("symbol", F.col("ts") >= F.col("_from")).orderBy(F.col("ts").desc()))
    recent = bars.withColumn("_place", place).where((F.col("ts") >= F.col("_from")) | (F.col("_place") <= longest(s)))
    found = with_actions(with_datapoints(recent.drop("_from", "_place", "exchange"), s), s)
    return found.join(new.select("symbol", "ts"), ["symbol", "ts"], "left_semi").select("symbol", "ts", "close", "action")


def watch(spark: SparkSession, store: str, s: Strategy, folder: str, once: bool = True, every: str = "1 minute") -> tuple[StreamingQuery, StreamingQuery]:
    """Two streams over a store of bars that others append to: new bars' actions to ``folder``/actions, and the portfolio's log to ``folder``/log.

    ``once``: each takes what is there and ends; otherwise they run ``every`` so often.
    Of a store of snapshots each commit's bars are judged once, however files are put
    together later; of a partitioned folder each file's.
    """
    trigger = {"availableNow": True} if once else {"processingTime": every}
    held = BarStore(spark, store)
    committed = bool(held.versions())
    if committed:
        bars = spark.readStream.option("wholetext", "true").text(f"{store}/snapshots").select(F.col("_metadata.file_name").cast("long").alias("version"))
    else:
        bars = spark.readStream.schema(read_store(spark, store).schema).parquet(store)

    def append(new: DataFrame, _: int) -> None:
        if committed:
            first, last = new.agg(F.min("version"), F.max("version")).first()
            if first is None:
                return
            new = held.since(first - 1, last)
        judge_new(spark, store, new, s).write.mode("append").parquet(f"{folder}/actions")

    judged = bars.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/.judged").trigger(**trigger).start()
    if once:
        judged.awaitTermination()
    log = act_on(spark.readStream.schema(ACTIONS).parquet(f"{folder}/actions"), s)
    traded = log.writeStream.format("parquet").option("checkpointLocation", f"{folder}/.traded").trigger(**trigger).start(f"{folder}/log")
    if once:
        traded.awaitTermination()
    return judged, traded


def traded(log: DataFrame) -> DataFrame:
    """The trades of a portfolio's log."""
    return log.where("side is not null")


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The state of a watched portfolio: the last row of each symbol's log."""
    rows = spark.read.schema(LOG).parquet(f"{folder}/log")
    last = F.max_by(F.struct(*(c for c in rows.columns if c != "symbol")), "ts").alias("last")
    return rows.groupBy("symbol").agg(last).select("symbol", "last.*")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """The log of a watched portfolio as a stream of its rows, as they come."""
    return spark.readStream.schema(LOG).parquet(f"{folder}/log")


def tail(spark: SparkSession, folder: str, n: int = 20) -> DataFrame:
    """The last ``n`` rows of the log in time, latest first."""
    return spark.read.schema(LOG).parquet(f"{folder}/log").orderBy(F.desc("ts"), "symbol").limit(n)


def passed_over(spark: SparkSession, folder: str) -> DataFrame:
    """Judged bars that the portfolio did not take as they are, since a later bar or the same one had been taken: late bars and corrections."""
    taken = spark.read.schema(LOG).parquet(f"{folder}/log").select("symbol", "ts", F.col("price").alias("close"))
    return spark.read.schema(ACTIONS).parquet(f"{folder}/actions").join(taken, ["symbol", "ts", "close"], "left_anti")
