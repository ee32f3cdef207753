"""Ranking and forecast evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.expr import PRICE_FIELDS, change, count_if, is_finite, pearson, ratio
from barline.functions.groups import GROUP_LIMIT, average_rank, best_k, place_down, split_hot, with_ranks


def rank_ic(
    df: DataFrame, pred: str, actual: str, by: list[str], min_n: int = 3, key: str = "symbol", limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """Spearman correlation per group over finite pairs, average ties; NULL below ``min_n`` or without variance."""
    pairs = df.where(is_finite(pred) & is_finite(actual)).select(*by, key, pred, actual)
    ranked = with_ranks(pairs, by, [pred, actual], key=key, limit=limit)
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson(average_rank(pred), average_rank(actual), min_n).alias("rank_ic")
    )


def _spearman(x: np.ndarray, y: np.ndarray, min_n: int) -> float | None:
    """As ``pearson`` over average ranks."""
    if len(x) < min_n:
        return None
    ranks = []
    for v in (x, y):
        in_order = np.sort(v)
        ranks.append((np.searchsorted(in_order, v, side="left") + np.searchsorted(in_order, v, side="right") + 1) / 2)
    return _correlation(*ranks)


def _correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    a, b = x - x.mean(), y - y.mean()
    sx, sy = np.sqrt(np.mean(a * a)), np.sqrt(np.mean(b * b))
    if sx < 1e-9 or sy < 1e-9:
        return None
    r = float(np.mean(a * b) / (sx * sy))
    return 0.0 if abs(r) < 1e-12 else r


def _places_down(values: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """1 for the largest value, ties by turn."""
    place = np.empty(len(values), dtype=np.int64)
    place[np.lexsort((-turn, values))[::-1]] = np.arange(1, len(values) + 1)
    return place


def _per_group(pairs: DataFrame, by: list[str], score: str, figures: Callable[..., list[float | None]], names: list[str]) -> DataFrame:
    """(by.., n, names..): ``figures(score, label, turn)`` of each group as arrays, turn being the place of the symbol.

    Rows are sorted by group only and one row a group leaves its task: no window, no sort for each order.
    """
    rows = pairs.select(*by, "symbol", score, "label")
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches([b.select(["symbol", score, "label"]) for b in batches])
        turn = pc.rank(group.column("symbol"), tiebreaker="first").to_numpy().astype(np.int64)
        found = figures(group.column(score).to_numpy(), group.column("label").to_numpy(), turn)
        columns = [pa.array([k.as_py()], k.type) for k in key]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([group.num_rows], pa.int64()), *[pa.array([f], pa.float64()) for f in found]], names=schema.names)

    return rows.groupBy(*by).applyInArrow(add_up, schema)


def ic_by_step(rows: DataFrame, min_n: int = 3, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """``rank_ic`` per (date, h) of packed rows (date, symbol, pred, actual): two arrays whose i-th values belong to h = i + 1.

    A row of arrays is dealt out once for all its steps; a task holds the arrays of one date. Dates above ``limit`` rows
    are ranked step by step with value ranges.
    """
    cold, large = split_hot(rows.select("date", "symbol", "pred", "actual"), ["date"], limit)

    def matrix(arrays: pa.ListArray) -> np.ndarray:
        """One line per row; NULLs, and what a shorter row lacks, are NaN."""
        sizes = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.full((len(sizes), int(sizes.max(initial=0))), np.nan)
        out[np.arange(out.shape[1]) < sizes[:, None]] = arrays.flatten().to_numpy(zero_copy_only=False)
        return out

    def correlate(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[matrix(b.column(0)), matrix(b.column(1))] for b in batches]
        width = max(m.shape[1] for pair in parts for m in pair)
        pred, actual = (np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1])), constant_values=np.nan) for m in side]) for side in zip(*parts))
        out: list[list] = [[], [], []]
        for i in range(width):
            both = np.isfinite(pred[:, i]) & np.isfinite(actual[:, i])
            if both.any():
                for column, value in zip(out, (i + 1, int(both.sum()), _spearman(pred[both, i], actual[both, i], min_n))):
                    column.append(value)
        types = [pa.int32(), pa.int64(), pa.float64()]
        columns = [pa.array([key[0].as_py()] * len(out[0]), pa.date32()), *[pa.array(c, t) for c, t in zip(out, types)]]
        yield pa.RecordBatch.from_arrays(columns, names=["date", "h", "n", "rank_ic"])

    ics = cold.select("pred", "actual", "date").groupBy("date").applyInArrow(correlate, "date date, h int, n long, rank_ic double")
    if large is None:
        return ics
    steps = F.posexplode(F.arrays_zip("pred", "actual")).alias("_i", "_s")
    long = large.select("date", "symbol", steps).select("date", "symbol", (F.col("_i") + 1).alias("h"), "_s.pred", "_s.actual")
    return ics.unionByName(rank_ic(long, "pred", "actual", ["date", "h"], min_n, limit=limit).select("date", "h", "n", "rank_ic"))


def mean_ic(ics: DataFrame, col: str = "rank_ic") -> DataFrame:
    return ics.agg(F.count(col).alias("n_groups"), F.avg(col).alias("mean_ic"))


def ic_ir(ics: DataFrame, mode: str = "validation", by: list[str] | None = None, col: str = "rank_ic") -> DataFrame:
    """Mean over spread of the ICs, and the share of positive ones.

    validation: population spread + 1e-8, from 3 groups on. forecast: population spread if above 1e-9.
    period: sample spread if positive, from 2 groups on.
    """
    n, mean = F.count(col), F.avg(col)
    if mode == "validation":
        ir = F.when(n >= 3, mean / (F.stddev_pop(col) + F.lit(1e-8)))
    elif mode == "forecast":
        ir = F.when(F.stddev_pop(col) > 1e-9, ratio(mean, F.stddev_pop(col)))
    elif mode == "period":
        ir = F.when((n > 1) & (F.stddev_samp(col) > 0), ratio(mean, F.stddev_samp(col)))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return ics.groupBy(*(by or [])).agg(
        n.alias("n_groups"), mean.alias("mean_ic"), ir.alias("ic_ir"), ratio(count_if(F.col(col) > 0), n).alias("pct_positive")
    )


def path_returns(paths: DataFrame) -> DataFrame:
    """(date, symbol, h, ret): value_(h+1) over the first value, minus 1; non-positive firsts are dropped."""
    first = F.min_by("value", "h").over(Window.partitionBy("date", "symbol"))
    rows = paths.withColumn("_first", first).where((F.col("h") > 1) & (F.col("_first") > 0))
    return rows.select("date", "symbol", (F.col("h") - 1).alias("h"), change("value", "_first").alias("ret"))


def _returns(path: str, wanted: int) -> Column:
    """Values 2 .. wanted + 1 of a packed path over its first one, minus 1; an empty array where that is not positive."""
    first = F.get(path, F.lit(0))
    return F.when(first > 0, F.transform(F.slice(path, 2, wanted), lambda x: change(x, first))).otherwise(F.array().cast("array<double>"))


def validation_metrics(paths: DataFrame, actual: DataFrame | None = None, horizons: int = 5, target: int = 5, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Mean IC over (date, horizon) and IC-IR at the target horizon, open to open.

    Both tables are (date, symbol, h, value) with opens from the first bar after ``date``. Without ``actual``, ``paths`` are
    packed: one row per (date, symbol) with arrays ``path`` and ``actual`` of the values h = 1, 2, ..
    """
    wanted = max(horizons, target)
    if actual is None:
        ics = ic_by_step(paths.select("date", "symbol", _returns("path", wanted).alias("pred"), _returns("actual", wanted).alias("actual")), limit=limit)
    else:
        pred = path_returns(paths).withColumnRenamed("ret", "pred")
        real = path_returns(actual).withColumnRenamed("ret", "actual")
        pairs = pred.where(F.col("h") <= wanted).join(real, ["date", "symbol", "h"])
        ics = rank_ic(pairs, "pred", "actual", ["date", "h"], limit=limit)
    at_target = F.when(F.col("h") == target, F.col("rank_ic"))
    return ics.agg(
        F.count(F.when(F.col("h") <= horizons, F.col("rank_ic"))).alias("n_groups"),
        F.avg(F.when(F.col("h") <= horizons, F.col("rank_ic"))).alias("mean_ic"),
        F.when(F.count(at_target) >= 3, F.avg(at_target) / (F.stddev_pop(at_target) + F.lit(1e-8))).alias("ic_ir"),
    )


def top_k_excess(scored: DataFrame, k: int = 10) -> DataFrame:
    """Mean label of the k best scores minus the mean of all, for dates with at least k rows."""
    top = best_k(scored.select("date", "symbol", "score", "label"), ["date"], "score", k)
    top = top.groupBy("date").agg(F.avg("label").alias("top_mean"))
    everyone = scored.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("universe_mean"))
    return everyone.where(F.col("n") >= k).join(top, "date").withColumn("top_excess", F.col("top_mean") - F.col("universe_mean"))


def ndcg_at_k(scored: DataFrame, k: int = 10, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Gain n..1 by label order, discount 1 / log2(place + 1), for dates with at least k rows."""
    pairs = scored.where(is_finite("score") & is_finite("label")).select("date", "symbol", "score", "label")
    cold, large = split_hot(pairs, ["date"], limit)
    s0 = sum(1 / math.log2(i + 1) for i in range(1, k + 1))
    s1 = sum(i / math.log2(i + 1) for i in range(1, k + 1))

    def figures(score: np.ndarray, label: np.ndarray, turn: np.ndarray) -> list[float | None]:
        place = _places_down(score, turn)
        top = place <= k
        gains = (len(score) + 1 - _places_down(label, turn)[top]) / np.log2(place[top] + 1)
        best = (len(score) + 1) * s0 - s1
        return [float(gains.sum()) / best if best else None]

    daily = _per_group(cold, ["date"], "score", figures, ["ndcg"]).where(F.col("n") >= k)
    if large is None:
        return daily
    ranked = with_ranks(large, ["date"], ["score", "label"], limit=limit, turns=True).select(
        "date", F.col("label_rk")["n"].alias("n"), place_down("score").alias("place"), place_down("label").alias("ideal")
    )
    gain = (F.col("n") + 1 - F.col("ideal")) / F.log2(F.col("place") + 1)
    by_date = ranked.groupBy("date").agg(F.max("n").alias("n"), F.sum(F.when(F.col("place") <= k, gain)).alias("_dcg"))
    best = (F.col("n") + 1) * F.lit(s0) - F.lit(s1)
    return daily.unionByName(by_date.where(F.col("n") >= k).select("date", "n", ratio("_dcg", best).alias("ndcg")))


def top_k_overlap(scored: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """Share of the k best by ``a`` that are also among the k best by ``b``."""
    by_a = best_k(scored.select("date", "symbol", a), ["date"], a, k).select("date", "symbol", F.lit(1).alias("_a"))
    by_b = best_k(scored.select("date", "symbol", b), ["date"], b, k).select("date", "symbol", F.lit(1).alias("_b"))
    both = by_a.join(by_b, ["date", "symbol"], "left")
    return both.groupBy("date").agg((F.count("_b") / F.lit(float(k))).alias("overlap"), F.count("_a").alias("_n")).where(F.col("_n") >= k).drop("_n")


def per_day_metrics(
    scored: DataFrame, k: int = 10, by: list[str] | None = None, score: str = "score", limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """n, rank IC, top and universe mean, excess and overlap per group, for groups of at least 2k rows.

    Score and label are ranked once, as arrays of a group; groups above ``limit`` rows by value ranges.
    """
    by = by or ["date"]
    pairs = scored.where(is_finite(score) & is_finite("label")).select(*by, "symbol", score, "label")
    cold, large = split_hot(pairs, by, limit)

    def figures(scores: np.ndarray, label: np.ndarray, turn: np.ndarray) -> list[float | None]:
        top, real = _places_down(scores, turn) <= k, _places_down(label, turn) <= k
        top_mean = float(label[top].mean()) if top.any() else None
        return [_spearman(scores, label, 3), top_mean, float(label.mean()), float((top & real).sum() / k)]

    day = _per_group(cold, by, score, figures, ["rank_ic", "top_mean", "universe_mean", "overlap_topk"])
    if large is not None:
        ranked = with_ranks(large, by, [score, "label"], limit=limit, turns=True).select(
            *by,
            "label",
            average_rank(score).alias("_rs"),
            average_rank("label").alias("_rl"),
            (place_down(score) <= k).alias("_top"),
            (place_down("label") <= k).alias("_real"),
        )
        many = ranked.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            pearson("_rs", "_rl", 3).alias("rank_ic"),
            F.avg(F.when(F.col("_top"), F.col("label"))).alias("top_mean"),
            F.avg("label").alias("universe_mean"),
            (count_if(F.col("_top") & F.col("_real")) / F.lit(float(k))).alias("overlap_topk"),
        )
        day = day.unionByName(many)
    return day.where(F.col("n") >= 2 * k).withColumn("top_excess", F.col("top_mean") - F.col("universe_mean"))


def aggregate_period(daily: DataFrame, freqs: list[str] = ("Q",), by: list[str] | None = None) -> DataFrame:
    """Days, mean IC, IC-IR, share positive, excess and overlap per period; several frequencies in one pass."""
    names = {
        "Y": F.date_format("date", "yyyy"),
        "Q": F.concat(F.date_format("date", "yyyy"), F.lit("Q"), F.quarter("date").cast("string")),
        "M": F.date_format("date", "yyyy-MM"),
        "all": F.lit("all"),
    }
    labels = F.array(*[F.struct(F.lit(f).alias("freq"), names[f].alias("period")) for f in freqs])
    by = by or []
    spread = F.stddev_samp("rank_ic")
    return (
        daily.withColumn("_p", F.explode(labels))
        .groupBy(*by, F.col("_p.freq").alias("freq"), F.col("_p.period").alias("period"))
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.avg("rank_ic").alias("mean_ic"),
            F.when((F.count(F.lit(1)) > 1) & (spread > 0), ratio(F.avg("rank_ic"), spread)).alias("ic_ir"),
            ratio(count_if(F.col("rank_ic") > 0), F.count(F.lit(1))).alias("pct_ic_pos"),
            F.avg("top_excess").alias("mean_top_excess"),
            F.avg("overlap_topk").alias("mean_overlap"),
            F.avg("universe_mean").alias("universe_mean_label"),
        )
    )


def feature_diagnostics(
    panel: DataFrame, cols: list[str], k: int = 10, freqs: list[str] = ("Q",), limit: int | None = GROUP_LIMIT
) -> DataFrame:
    """Every feature taken as a score, through the daily and period metrics, in one job.

    Rows are dealt out by date once, with all features beside each other; only dates above ``limit`` rows get a row for each feature.
    """
    cold, large = split_hot(panel.where(is_finite("label")).select("date", "symbol", "label", *cols), ["date"], limit)
    daily = _daily_by_feature(cold, cols, k)
    if large is not None:
        long = large.unpivot(["date", "symbol", "label"], cols, "feature", "score")
        daily = daily.unionByName(per_day_metrics(long, k, ["feature", "date"], limit=limit))
    return aggregate_period(daily, list(freqs), ["feature"])


def _daily_by_feature(panel: DataFrame, cols: list[str], k: int) -> DataFrame:
    """``per_day_metrics`` by (feature, date), each date as arrays of a task that are sorted once by feature."""

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        group = group.take(pc.sort_indices(group.column("symbol")))
        label = group.column("label").to_numpy()
        whole = _ordered(label)
        found = []
        for c in cols:
            score = group.column(c).to_numpy()
            there = np.isfinite(score)
            n = int(there.sum())
            if n < 2 * k or not n:
                continue
            own, (order, ranks) = (label, whole) if n == len(label) else (label[there], _ordered(label[there]))
            best, score_ranks = _ordered(score[there])
            top = best[:k]
            mean = float(own[top].mean()) if k else None
            found.append((c, n, _correlation(score_ranks, ranks) if n >= 3 else None, mean, float(own.mean()), len(np.intersect1d(top, order[:k])) / k if k else None))
        columns = [list(x) for x in zip(*found)] or [[] for _ in range(6)]
        types = [pa.string(), pa.int64(), *[pa.float64()] * 4]
        date = pa.array([group.column("date")[0].as_py()] * len(found), group.schema.field("date").type)
        yield pa.RecordBatch.from_arrays([date, *map(pa.array, columns, types)], names=schema.names)

    names = ["rank_ic", "top_mean", "universe_mean", "overlap_topk"]
    schema = T.StructType([panel.schema["date"], T.StructField("feature", T.StringType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    return panel.groupBy("date").applyInArrow(figures, schema).withColumn("top_excess", F.col("top_mean") - F.col("universe_mean"))


def _ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows from the largest value to the smallest, ties as they stand, and the average rank of each row in that order."""
    order = np.argsort(-values, kind="stable")
    there = values[order]
    starts = np.flatnonzero(np.append(True, there[1:] != there[:-1])) if len(there) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(there)))
    ranks = np.empty(len(there))
    ranks[order] = np.repeat(starts + (sizes + 1) / 2, sizes)
    return order, ranks


def select_metric(scored: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """One validation figure: mean over dates of rank IC, top-k excess or NDCG."""
    daily = {
        "rank_ic": lambda: rank_ic(scored, "score", "label", ["date"]).select(F.col("rank_ic").alias("_v")),
        "top_k_excess": lambda: top_k_excess(scored, k).select(F.col("top_excess").alias("_v")),
        "ndcg": lambda: ndcg_at_k(scored, k).select(F.col("ndcg").alias("_v")),
    }
    if metric not in daily:
        raise ValueError(f"unknown metric: {metric}")
    return daily[metric]().agg(F.avg("_v").alias("value"))


def forecast_fidelity(paths: DataFrame, actual: DataFrame | None = None, last: DataFrame | None = None, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Error, direction and IC figures per horizon. ``last`` has (date, symbol, close) at the end of the context.

    Without the two, ``paths`` are packed: one row per (date, symbol) with ``close`` and arrays ``path`` and ``actual`` of the
    values h = 1, 2, ..; steps that only one of them has take no part.
    """
    packed = actual is None
    if packed:
        n = F.least(F.size("path"), F.size("actual"))
        steps = F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), n).alias("pred"), F.slice("actual", F.lit(1), n).alias("act")))
        rows = paths.select("date", "symbol", "close", steps.alias("h", "_s")).select("date", "symbol", "close", (F.col("h") + 1).alias("h"), "_s.pred", "_s.act")
    else:
        rows = (
            paths.withColumnRenamed("value", "pred")
            .join(actual.withColumnRenamed("value", "act"), ["date", "symbol", "h"])
            .join(last.select("date", "symbol", "close"), ["date", "symbol"])
        )
    rows = rows.withColumn("pred_ret", change("pred", "close")).withColumn("act_ret", change("act", "close"))
    moved = (F.abs("pred_ret") > 1e-9) & (F.abs("act_ret") > 1e-9)
    agree = F.signum("pred_ret") == F.signum("act_ret")
    errors = rows.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ratio(F.abs(F.col("pred") - F.col("act")), F.abs("act"))).alias("mape"),
        F.avg(ratio(F.abs(F.col("close") - F.col("act")), F.abs("act"))).alias("mape_naive"),
        F.sqrt(F.avg((F.col("pred_ret") - F.col("act_ret")) * (F.col("pred_ret") - F.col("act_ret")))).alias("rmse_ret"),
        ratio(count_if(moved & agree), count_if(moved)).alias("direction_acc"),
        F.avg(F.when(F.col("act_ret") > 0, 1.0).otherwise(0.0)).alias("always_up_rate"),
    )
    if packed:
        moves = lambda c: F.transform(F.slice(c, F.lit(1), n), lambda x: change(x, F.col("close")))
        daily = ic_by_step(paths.select("date", "symbol", moves("path").alias("pred"), moves("actual").alias("actual")), limit=limit)
    else:
        daily = rank_ic(rows, "pred_ret", "act_ret", ["date", "h"], limit=limit)
    spread = F.stddev_pop("rank_ic")
    ics = daily.groupBy("h").agg(
        F.avg("rank_ic").alias("ic_mean"),
        spread.alias("ic_std"),
        F.when(spread > 1e-9, ratio(F.avg("rank_ic"), spread)).alias("ic_ir"),
        ratio(count_if(F.col("rank_ic") > 0), F.count("rank_ic")).alias("ic_positive_rate"),
    )
    return errors.join(ics, "h", "left")


def score_complementarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean daily Spearman correlation of two scores over dates with at least two common rows."""
    from barline.operators.scores import aligned

    daily = rank_ic(aligned(a, b), "score_a", "score_b", ["date"], min_n=2)
    return daily.agg(F.count("rank_ic").alias("n_days"), F.avg("rank_ic").alias("mean_correlation"))


def accuracy_summary(df: DataFrame) -> DataFrame:
    """Per symbol: mean absolute % error, share under 5 %, agreement of day-to-day direction, correlation.

    ``df`` has (symbol, date, predicted, actual). The first day has no direction and counts as a miss.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    err = F.abs(change("predicted", "actual"))
    rows = df.withColumns({"_dp": step("predicted"), "_da": step("actual"), "_err": err})
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_err").alias("mean_abs_pct_error"),
        ratio(count_if(F.col("_err") < 0.05), F.count(F.lit(1))).alias("accuracy"),
        ratio(count_if(F.col("_dp") == F.col("_da")), F.count(F.lit(1))).alias("direction_accuracy"),
        pearson("predicted", "actual", 2).alias("correlation"),
    )


def continuity_gap(pred: DataFrame, actual: DataFrame, key: list[str] = ("date", "symbol")) -> DataFrame:
    """First predicted against first actual bar: absolute gap and % of actual, per price field."""
    key = list(key)
    a = pred.where("h = 1").select(*key, *[F.col(c).alias(f"_p_{c}") for c in PRICE_FIELDS])
    b = actual.where("h = 1").select(*key, *[F.col(c).alias(f"_a_{c}") for c in PRICE_FIELDS])
    out = []
    for c in PRICE_FIELDS:
        gap = F.abs(F.col(f"_p_{c}") - F.col(f"_a_{c}"))
        out += [gap.alias(f"{c}_gap"), (ratio(gap, f"_a_{c}") * 100).alias(f"{c}_gap_pct")]
    return a.join(b, key).select(*key, *out)


def code_usage(codes: DataFrame, col: str) -> DataFrame:
    """Distinct codes, entropy in bits and total, from one count per code."""
    counts = codes.groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    total = F.sum("_c")
    return counts.agg(
        F.count(F.lit(1)).alias("unique_tokens"),
        (F.log2(total) - ratio(F.sum(F.col("_c") * F.log2("_c")), total)).alias("entropy_bits"),
        total.cast("long").alias("total_tokens"),
    )


def reconstruction_mse(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference of two vector columns over all rows and positions."""
    sq = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    return pairs.agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(sq), F.sum(F.size(a))).alias("mse"))


def group_pearson_ic(df: DataFrame, by: list[str], pred: str = "score", actual: str = "label") -> DataFrame:
    """Mean product of population z-scores (eps 1e-8 in the denominators); 0 for fewer than two rows."""
    pairs = df.where(is_finite(pred) & is_finite(actual))
    eps = F.lit(1e-8)
    ic = F.covar_pop(pred, actual) / ((F.stddev_pop(pred) + eps) * (F.stddev_pop(actual) + eps))
    n = F.count(F.lit(1))
    return pairs.groupBy(*by).agg(n.alias("n"), F.when(n < 2, F.lit(0.0)).otherwise(ic).alias("ic"))


def forecast_report(paths: DataFrame, last: DataFrame) -> DataFrame:
    """End of the path against the last close, with its range, mean and sample deviation."""
    agg = paths.groupBy("date", "symbol").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("value", "h").alias("end_value"),
        F.max("value").alias("max_value"),
        F.min("value").alias("min_value"),
        F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"),
    )
    return agg.join(last.select("date", "symbol", F.col("close").alias("last_close")), ["date", "symbol"]).withColumn(
        "change_pct", change("end_value", "last_close") * 100
    )


def forecast_steps(paths: DataFrame, last: DataFrame) -> DataFrame:
    """Each step's distance from the last close, absolute and in %."""
    joined = paths.join(last.select("date", "symbol", "close"), ["date", "symbol"])
    return joined.select(
        "date", "symbol", "h", "value", (F.col("value") - F.col("close")).alias("change"), (change("value", "close") * 100).alias("change_pct")
    )


def group_runs(df: DataFrame, key: str, order: str, block: int = 1_000_000) -> DataFrame:
    """Rows and contiguous runs per key along an integer row id; one run each is what in-order readers need.

    Rows are compared with their predecessor inside blocks of ids; only the last key of each block crosses
    over, so no task sees the whole file.
    """
    rows = df.select(key, order).withColumn("_b", F.floor(F.col(order) / F.lit(block)))
    tails = rows.groupBy("_b").agg(F.max_by(key, order).alias("_tail"))
    tails = tails.select("_b", F.lag("_tail").over(Window.orderBy("_b")).alias("_tail"))
    prev = F.coalesce(F.lag(key).over(Window.partitionBy("_b").orderBy(order)), F.col("_tail"))
    starts = rows.join(tails, "_b").withColumn("_start", prev.isNull() | (prev != F.col(key)))
    return starts.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), count_if(F.col("_start")).alias("n_runs"))
