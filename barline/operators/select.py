"""From scores to holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.expr import change
from barline.functions.groups import best_k


def top_k(scores: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """The k best scores per date among those >= threshold, with their ``place``."""
    return best_k(scores.where(F.col("score") >= threshold), ["date"], "score", k)


def holdings(paths: DataFrame, sched: DataFrame, k: int, threshold: float = 0.0, rank_h: int | None = None) -> DataFrame:
    """(variant, exec_date, symbol): the k best predicted returns at horizon ``rank_h``, by default the hold.

    A signal date without candidates has no rows; the schedule still lists it.
    """
    h = F.col("variant") if rank_h is None else F.lit(rank_h)
    wanted = sched.select("variant", "exec_date", F.col("signal_date").alias("date"), h.cast("int").alias("h"))
    signals = paths.where((F.col("value") >= threshold) & ~F.isnan("value")).join(F.broadcast(wanted), ["date", "h"])
    return best_k(signals, ["variant", "exec_date"], "value", k).select("variant", "exec_date", "symbol")


def rebalance_advice(current: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hold = in both, sell = only current, buy = only target."""
    key = [*(by or []), "symbol"]
    a = current.select(*key, F.lit(True).alias("_now"))
    b = target.select(*key, F.lit(True).alias("_then"))
    action = F.when(F.col("_now") & F.col("_then"), "hold").when(F.col("_now"), "sell").otherwise("buy")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def latest_signals(scores: DataFrame, bars: DataFrame, benchmark: str, k: int, threshold: float = 0.0) -> DataFrame:
    """Ranked picks of the benchmark's last day, or of the last day of all bars without a benchmark."""
    newest = bars.agg(F.coalesce(F.max(F.when(F.col("symbol") == benchmark, F.col("date"))), F.max("date"))).scalar()
    today = scores.where((F.col("date") == newest) & (F.col("symbol") != benchmark))
    return top_k(today, k, threshold).select("date", "symbol", "score", "place")


def align_after(pred: DataFrame, hist: DataFrame) -> DataFrame:
    """Predictions after the symbol's last historical date; all of them if none is later."""
    last = hist.groupBy("symbol").agg(F.max("date").alias("_last"))
    later = F.col("date") > F.col("_last")
    any_later = pred.join(last, "symbol").where(later).select("symbol", F.lit(True).alias("_any")).distinct()
    return (
        pred.join(last, "symbol", "left")
        .join(any_later, "symbol", "left")
        .where(F.col("_any").isNull() | later)
        .drop("_last", "_any")
    )


def threshold_position(series: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Signal from the change of the predicted value; a zero signal keeps the previous position.

    ``series`` has (symbol, date, value).
    """
    w = Window.partitionBy("symbol").orderBy("date")
    move = change("value", F.lag("value").over(w))
    signal = F.when(F.col("pred_return") > threshold, 1).when(F.col("pred_return") < -threshold, -1).otherwise(0)
    held = F.last(F.nullif(F.col("signal"), F.lit(0)), ignorenulls=True).over(w)
    return series.withColumn("pred_return", move).withColumn("signal", signal).withColumn("position", F.coalesce(held, F.lit(0)))


def period_weights(hold: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Attach ``weight``: 0 for symbols without one, NULL (equal weights) for dates without any.

    ``weights`` has (symbol, weight), or (date, symbol, weight) to vary by execution date.
    """
    if weights is None:
        return hold.withColumn("weight", F.lit(None).cast("double"))
    if "date" not in weights.columns:
        return hold.join(weights.select("symbol", "weight"), "symbol", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    by_date = weights.select(F.col("date").alias("exec_date"), "symbol", "weight")
    dated = F.broadcast(by_date.select("exec_date", F.lit(True).alias("_dated")).distinct())
    return (
        hold.join(by_date, ["exec_date", "symbol"], "left")
        .join(dated, "exec_date", "left")
        .withColumn("weight", F.when(F.col("_dated"), F.coalesce("weight", F.lit(0.0))))
        .drop("_dated")
    )
