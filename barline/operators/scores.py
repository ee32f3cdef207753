"""Scores per (date, symbol): standardising, blending, overlays, models, forecast paths."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, StorageLevel
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor  # noqa: F401 (tests train with it)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.expr import BAR_FIELDS, change, is_finite, pearson, ratio, std
from barline.functions.groups import BATCH, GROUP_LIMIT, average_rank, hot_groups, place_up, split_hot, with_ranks
from barline.operators.boosting import Booster
from barline.operators.calendar import numbered
from barline.operators.labels import calendar_forward_return
from barline.operators.pairs import pair_sums, tile_sums

TILE = 8192


def zscore_by_date(scores: DataFrame, ddof: int = 0, cols: list[str] = ("score",)) -> DataFrame:
    """(s - mean) / std per date; s - mean where the deviation is 0 or undefined.

    The statistics have one row per date, so they are broadcast and the scores are not shuffled.
    """
    pairs = [(F.avg(c).alias(f"_m_{c}"), std(c, ddof).alias(f"_s_{c}")) for c in cols]
    stats = scores.groupBy("date").agg(*[x for pair in pairs for x in pair])
    centred = {c: F.col(c) - F.col(f"_m_{c}") for c in cols}
    z = {c: F.coalesce(ratio(centred[c], f"_s_{c}"), centred[c]) for c in cols}
    return scores.join(F.broadcast(stats), "date").withColumns(z).select(*scores.columns)


def blend(a: DataFrame, b: DataFrame, w: float = 0.6, ddof: int = 0) -> DataFrame:
    """w z(a) + (1 - w) z(b) over the (date, symbol) pairs both tables score."""
    return blend_columns(aligned(a, b), "score_a", "score_b", w, ddof)


def blend_columns(df: DataFrame, a: str, b: str, w: float = 0.6, ddof: int = 0) -> DataFrame:
    """The same for two score columns of one table, which needs no join."""
    both = df.select("date", "symbol", a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    z = zscore_by_date(both, ddof, [a, b])
    return z.select("date", "symbol", (F.lit(w) * F.col(a) + F.lit(1.0 - w) * F.col(b)).alias("score"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("date", "symbol", F.col("score").alias("score_a"))
    return left.join(b.select("date", "symbol", F.col("score").alias("score_b")), ["date", "symbol"])


def momentum_overlay(
    scores: DataFrame,
    bars: DataFrame,
    cal: DataFrame,
    lookback: int = 60,
    gap: int = 5,
    hold: int = 5,
    mult: float = 2.0,
    min_values: int = 15,
) -> DataFrame:
    """score + mult x mean forward return over the calendar days idx - lookback - gap .. idx - gap - 1.

    ``gap >= hold`` keeps every return inside the past. Scores off the calendar, too early, or with fewer than
    ``min_values`` returns stay as they are.
    """
    if gap < hold:
        raise ValueError(f"gap ({gap}) must be >= hold ({hold}) to prevent look-ahead")
    days = F.broadcast(numbered(cal).select("date", "idx"))
    past = calendar_forward_return(bars, cal, hold).select("symbol", "idx", "ret")
    asked = scores.join(days, "date", "left")
    # scores and returns share one axis per symbol, so the trailing mean is a frame, not a range join
    line = past.select("symbol", "idx", "ret", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("score")).unionByName(
        asked.select("symbol", "idx", F.lit(None).cast("double").alias("ret"), "date", "score")
    )
    frame = Window.partitionBy("symbol").orderBy("idx").rangeBetween(-(lookback + gap), -(gap + 1))
    n, mean = F.count("ret").over(frame), F.avg("ret").over(frame)
    usable = F.col("idx").isNotNull() & (F.col("idx") >= lookback + gap) & (n >= min_values)
    return (
        line.withColumn("_bonus", F.when(usable, mean * F.lit(mult)).otherwise(F.lit(0.0)))
        .where(F.col("date").isNotNull())
        .select("date", "symbol", (F.col("score") + F.col("_bonus")).alias("score"))
    )


def rank_gradients(scored: DataFrame, sigma: float = 1.0, tile: int = TILE, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Pairwise rank gradient and hessian per (date, symbol) from ``score`` and ``label``.

    A date is sorted by label in one task and all its pairs are added up there (``pairs.pair_sums``): the time follows the rows, unless
    scores spread over more than ``pairs.INTERVALS`` / sigma. Dates above ``limit`` rows are cut into tiles by label place, pair by
    pair: a task then holds at most two tiles and a strip of their pairs, and sums per row leave it, never the pairs themselves.
    """
    rows = scored.where(F.col("label").isNotNull()).select("date", "symbol", "score", "label")
    cold, large = split_hot(rows, ["date"], limit)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        date = pa.Table.from_batches(list(batches))
        n = date.num_rows
        date = date.take(pc.sort_indices(date, [("label", "ascending"), ("symbol", "ascending")])).append_column("place", pa.array(np.arange(1, n + 1)))
        there = date.filter(pc.is_valid(date.column("score"))).combine_chunks()
        grad, hess = pair_sums(*[there.column(c).to_numpy() for c in ("score", "label", "place")], sigma, tile)
        yield from _gradient_rows(there, grad, np.maximum(hess, 1e-6) if n > 1 else np.zeros(len(hess)))

    out = cold.groupBy("date").applyInArrow(whole, "date date, symbol string, grad double, hess double")
    return out if large is None else out.unionByName(_tiled_gradients(large, sigma, tile, limit))


def _gradient_rows(table: pa.Table, grad: np.ndarray, hess: np.ndarray) -> list[pa.RecordBatch]:
    columns = [table.column("date"), table.column("symbol"), pa.array(grad), pa.array(hess)]
    return pa.Table.from_arrays(columns, names=["date", "symbol", "grad", "hess"]).to_batches(max_chunksize=BATCH)


def _tiled_gradients(scored: DataFrame, sigma: float, tile: int, limit: int | None) -> DataFrame:
    placed = with_ranks(scored, ["date"], ["label"], limit=limit, turns=True)
    rows = placed.where(F.col("label").isNotNull() & F.col("score").isNotNull()).select(
        "date",
        "symbol",
        "score",
        "label",
        place_up("label").alias("place"),
        F.floor((place_up("label") - 1) / tile).alias("own"),
        F.floor((F.col("label_rk")["n"] - 1) / tile).alias("last"),
    )
    both = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select(
        "date",
        "symbol",
        "score",
        "label",
        "place",
        "own",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches)).combine_chunks()
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        own = part.column("own").to_numpy()
        weak, strong = [part.filter(pa.array(own == t)).sort_by("place") for t in (low, high)]
        up, down = tile_sums(*[[t.column(c).to_numpy() for c in ("score", "label", "place")] for t in (strong, weak)], sigma)
        for table, grad, hess in ((strong, -up[0], up[1]), (weak, down[0], down[1])):
            if table.num_rows:
                yield from _gradient_rows(table, sigma * grad, sigma * sigma * hess)

    sums = (
        both.groupBy("date", "low", "high")
        .applyInArrow(add_up, "date date, symbol string, grad double, hess double")
        .groupBy("date", "symbol")
        .agg(F.sum("grad").alias("grad"), F.sum("hess").alias("hess"))
    )
    single = scored.groupBy("date").agg((F.count("label") < 2).alias("_single"))
    return sums.join(F.broadcast(single), "date").select(
        "date",
        "symbol",
        "grad",
        F.when(F.col("_single"), F.lit(0.0)).otherwise(F.greatest("hess", F.lit(1e-6))).alias("hess"),
    )


def assemble_features(panel: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """One vector column in the stored column order; array columns are taken whole."""
    arrays = [c for c in cols if isinstance(panel.schema[c].dataType, T.ArrayType)]
    ready = panel.withColumns({f"_v_{c}": array_to_vector(F.col(c).cast("array<double>")) for c in arrays})
    inputs = [f"_v_{c}" if c in arrays else c for c in cols]
    return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error" if arrays else "keep").transform(ready).drop(*[f"_v_{c}" for c in arrays])


Scorer = Model | Callable[[pd.DataFrame], pd.Series]


def score_table(panel: DataFrame, models: dict[str, Scorer], cal: DataFrame | None = None, cols: list[str] | None = None) -> DataFrame:
    """date, symbol, label, technicals and one column per model.

    A Spark ML model reads the vector ``features``; a function gets pandas batches with ``cols``.
    """
    rows = panel if cal is None else panel.join(F.broadcast(cal.select("date").distinct()), "date", "left_semi")
    for name, model in models.items():
        if isinstance(model, Model):
            rows = model.transform(rows).withColumnRenamed("prediction", name)
        else:
            rows = _score_batches(rows, name, model, cols)
    kept = ["date", "symbol", *[c for c in panel.columns if c == "label" or c.startswith("feat_")]]
    return rows.select(*kept, *models)


def _score_batches(rows: DataFrame, name: str, fn, cols: list[str] | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: np.asarray(fn(batch[cols] if cols else batch), dtype=float)})

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    return rows.mapInPandas(run, schema)


def tree_range_score(rows: DataFrame, model: GBTRegressionModel, n_trees: int, out: str) -> DataFrame:
    """Score with the first ``n_trees`` trees only."""
    total = F.lit(0.0)
    for i, tree in enumerate(model.trees[:n_trees]):
        rows = tree.setPredictionCol(f"_t{i}").transform(rows)
        total = total + F.col(f"_t{i}") * F.lit(float(model.treeWeights[i]))
    return rows.withColumn(out, total).drop(*[f"_t{i}" for i in range(n_trees)])


def rank_target(panel: DataFrame, limit: int | None = GROUP_LIMIT) -> DataFrame:
    """Centred average-tie percentile of the label per date: a pointwise target that keeps the order."""
    ranked = with_ranks(panel, ["date"], ["label"], limit=limit)
    return ranked.withColumn("target", centred_rank("label")).drop("label_rk")


def centred_rank(col: str) -> Column:
    """The target of ``rank_target`` where ``with_ranks`` has been: features and label can be ranked in one pass."""
    return (average_rank(col) - F.lit(0.5)) / F.col(f"{col}_rk")["n"] - F.lit(0.5)


def tree_prefix_scores(rows: DataFrame, model: GBTRegressionModel, out: str = "prefixes") -> DataFrame:
    """``out`` holds the score by the first 1, 2, .. trees, so that every tree is walked once for all prefixes.

    Spark ML walks the trees and names the leaf of each; its value is looked up in Arrow batches and summed along the trees.
    ``rows`` carry the vector ``features``. A missing feature goes right at every split, as in Spark ML.
    """
    values = _leaf_values(model)
    first = np.concatenate([[0], np.cumsum([len(v) for v in values])[:-1]]).astype(int)
    flat = np.concatenate(values)

    @F.pandas_udf("array<double>")
    def running(leaf: pd.Series) -> pd.Series:
        if leaf.empty:
            return leaf
        return pd.Series(list(np.cumsum(flat[first + np.stack(leaf.to_numpy()).astype(int)], axis=1)))

    walked = model.copy({model.leafCol: "_leaf", model.predictionCol: "_whole"}).transform(rows)
    return walked.withColumn(out, running(vector_to_array("_leaf"))).drop("_leaf", "_whole")


def _leaf_values(model: GBTRegressionModel) -> list[np.ndarray]:
    """What each leaf of each tree adds to a score."""
    return [w * np.array(_leaves(tree)) for tree, w in zip(model.trees, model.treeWeights)]


def _leaves(tree) -> list[float]:
    """Leaf values from left to right, the order in which Spark ML numbers them."""
    return [float(line.split("Predict:")[1]) for line in tree.toDebugString.splitlines() if "Predict:" in line]


def prefix_metrics(rows: DataFrame, model: GBTRegressionModel, min_n: int = 3, limit: int | None = GROUP_LIMIT, known: int = 0) -> DataFrame:
    """(trees, n_dates, rank_ic): the mean rank IC over dates of every tree prefix longer than ``known``, in one job.

    A row is dealt out by date once, with the leaf of each tree; the prefixes are added up and ranked in the date's task, one after the
    other. Dates above ``limit`` rows are ranked in value ranges instead, with a row for each prefix. A prefix that scores all
    rows of a date alike has no IC there. A row with a NULL, NaN or infinite label takes no part.
    """
    wanted = rows.where(is_finite("label")).select("date", "symbol", "label", "features")
    hot = hot_groups(wanted, ["date"], limit)
    cold, large = split_hot(wanted, ["date"], limit, hot)
    daily = _prefix_ics(cold, model, min_n, known)
    if large is not None:
        daily = daily.unionByName(_long_prefix_ics(large, model, min_n, limit, hot, known))
    figures = daily.groupBy((F.col("_tree") + 1).alias("trees"))
    return figures.agg(F.count("rank_ic").alias("n_dates"), F.avg("rank_ic").alias("rank_ic"))


def _prefix_ics(rows: DataFrame, model: GBTRegressionModel, min_n: int, known: int) -> DataFrame:
    """(date, _tree, rank_ic), each date as arrays in a task: its labels, a few bytes of leaves a row and one prefix at a time."""
    values = _leaf_values(model)
    kind = np.dtype(np.min_scalar_type(max(map(len, values))))

    @F.pandas_udf("binary")
    def leaves(leaf: pd.Series) -> pd.Series:
        return leaf.map(lambda x: np.asarray(x).astype(kind).tobytes()).astype(object)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        date = None
        for batch in batches:
            date = batch.column("date")[0] if date is None and batch.num_rows else date
            packed = np.frombuffer(b"".join(batch.column("leaves").to_pylist()), dtype=kind).reshape(batch.num_rows, len(values))
            parts.append((batch.column("label").to_numpy(), np.ascontiguousarray(packed.T)))
        label, leaf = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
        actual, score = _centred_ranks(label), np.zeros(len(label))
        ics = []
        for tree, (own, value) in enumerate(zip(leaf, values)):
            score += value[own]
            if tree >= known:
                ics.append(_rank_correlation(_centred_ranks(score), actual, min_n))
        trees = pa.array(range(known, len(values)), pa.int32())
        columns = [pa.array([date.as_py()] * len(ics), batch.schema.field("date").type), trees, pa.array(ics, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["date", "_tree", "rank_ic"])

    schema = T.StructType([rows.schema["date"], T.StructField("_tree", T.IntegerType()), T.StructField("rank_ic", T.DoubleType())])
    walked = model.copy({model.leafCol: "_leaf", model.predictionCol: "_whole"}).transform(rows)
    return walked.select("date", "label", leaves(vector_to_array("_leaf")).alias("leaves")).groupBy("date").applyInArrow(figures, schema)


def _centred_ranks(values: np.ndarray) -> np.ndarray:
    """Twice the average-tie rank less n + 1: whole numbers with the sum 0."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    upto = np.cumsum(n)
    return (2 * upto - n - len(values))[at].astype(float)


def _rank_correlation(x: np.ndarray, y: np.ndarray, min_n: int) -> float | None:
    """What ``pearson`` gives for average ranks."""
    sx, sy = np.sqrt(x @ x), np.sqrt(y @ y)
    if len(x) < min_n or not sx or not sy:
        return None
    r = float(x @ y / (sx * sy))
    return 0.0 if abs(r) < 1e-12 else r


def _long_prefix_ics(rows: DataFrame, model: GBTRegressionModel, min_n: int, limit: int, hot: DataFrame, known: int) -> DataFrame:
    """(date, _tree, rank_ic) of dates that no task can hold: a row for each row and prefix. The label is ranked once for all prefixes."""
    ranked = with_ranks(rows, ["date"], ["label"], limit=limit, hot=hot)
    long = tree_prefix_scores(ranked.withColumn("_actual", average_rank("label")), model).select(
        "date", "symbol", "_actual", F.posexplode("prefixes").alias("_tree", "score")
    ).where(F.col("_tree") >= known)
    by = ["date", "_tree"]
    # a date has as many rows in every prefix
    hot = hot.withColumn("_tree", F.explode(F.sequence(F.lit(known), F.lit(model.getNumTrees - 1))))
    scored = with_ranks(long, by, ["score"], limit=limit, hot=hot)
    return scored.groupBy(*by).agg(pearson(average_rank("score"), F.col("_actual"), min_n).alias("rank_ic"))


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` trees, with the same columns."""
    if n >= model.getNumTrees:
        return model
    sc = SparkContext.getOrCreate()
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(model.trees[:n], model.treeWeights)):
        trees[i], weights[i] = tree._java_obj, float(weight)
    cut = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, trees, weights)
    cut.set(cut.featuresCol(), model.getFeaturesCol())
    cut.set(cut.predictionCol(), model.getPredictionCol())
    return GBTRegressionModel(cut)


def best_prefix(trace: list[float | None], patience: int) -> tuple[int, bool]:
    """Prefix with the highest figure up to the first tree after which ``patience`` trees brought nothing better, and whether that was reached.

    The first of equal figures counts; None and NaN never improve. Without any figure the first tree is kept.
    """
    best, at = -math.inf, 0
    for n, value in enumerate(trace, 1):
        if value is not None and value > best:
            best, at = value, n
        if n - max(at, 1) >= patience:
            return max(at, 1), True
    return max(at, 1), False


def fit_ranker(
    panel: DataFrame,
    cols: list[str],
    val: Column,
    depth: int = 4,
    eta: float = 0.05,
    rounds: int = 200,
    max_bins: int = 64,
    k: int = 10,
    patience: int = 20,
    limit: int | None = GROUP_LIMIT,
) -> tuple[GBTRegressionModel, dict]:
    """Boosted trees on the per-date rank of the label; ``val`` marks the validation dates.

    The number of trees is chosen by the mean rank IC of the validation dates: growing ends once ``patience`` trees in a row did not
    beat the best prefix, ``rounds`` trees at most, and the best prefix is kept. Boosting is deterministic: it grows half of ``patience``
    trees at a time, goes on where it stood while the choice is open, and the result is that of one tree at a time.
    A ``target`` that the panel has is taken as it is, else it is ``rank_target``. The panel is read a few times, so one that is
    dear to make should be stored. An action: it trains. Returns the model and a summary with the IC of every prefix looked
    at (``trace``). ``limit`` None says that no date is too large for a task.
    """
    from barline.operators.evaluate import select_metric

    rows = panel.where(F.col("label").isNotNull())
    flat = (rows if "target" in panel.columns else rank_target(rows, limit)).withColumn("is_val", val)
    rows = assemble_features(flat, cols)
    numbers = not any(isinstance(panel.schema[c].dataType, (T.ArrayType, T.UserDefinedType)) for c in cols)
    counts = rows.groupBy("is_val").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("date").alias("dates")).collect()
    # figures read these rows for every few trees; what does not fit in memory goes to local disk, what is lost is recomputed
    held = rows.where("is_val").select("date", "symbol", "label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    booster = Booster((flat if numbers else rows).where("NOT is_val"), depth, eta, max_bins, cols if numbers else None)
    trace, settled = [], False
    while not settled and len(trace) < rounds:
        booster.grow(min(max(1, patience // 2), rounds - len(trace)))
        model = booster.model()
        figures = {r["trees"]: r["rank_ic"] for r in prefix_metrics(held, model, limit=limit, known=len(trace)).collect()}
        trace += [figures.get(n) for n in range(len(trace) + 1, model.getNumTrees + 1)]
        best, settled = best_prefix(trace, patience)
    booster.close()
    model = first_trees(model, best)
    scored = model.transform(held).select("date", "symbol", "label", F.col("prediction").alias("score")).persist(StorageLevel.MEMORY_AND_DISK)
    summary = {("val" if r["is_val"] else "train"): {"rows": r["rows"], "dates": r["dates"]} for r in counts}
    summary |= {"n_trees": model.getNumTrees, "trace": trace}
    # the rank IC of the kept prefix is known
    summary["rank_ic"] = trace[best - 1]
    for metric in ("top_k_excess", "ndcg"):
        summary[metric] = select_metric(scored, metric, k).first()["value"]
    scored.unpersist()
    held.unpersist()
    return model, summary


def early_stop_trace(metrics: DataFrame, patience: int = 2, mode: str = "max", by: list[str] | None = None) -> DataFrame:
    """Per ``step``: best so far, whether it is new, steps without improvement and the stop signal.

    NaN and NULL count as no improvement. The trace holds one row per training step.
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy("step")
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    signed = value if mode == "max" else -value
    before = F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = metrics.withColumn("_v", signed)
    rows = rows.withColumn("is_best", F.col("_v").isNotNull() & (before.isNull() | (F.col("_v") > before)))
    rows = rows.withColumn("_n", F.row_number().over(w))
    last_best = F.max(F.when(F.col("is_best"), F.col("_n"))).over(w)
    best = F.max("_v").over(w)
    return (
        rows.withColumn("best", best if mode == "max" else -best)
        .withColumn("bad", (F.col("_n") - F.coalesce(last_best, F.lit(0))).cast("long"))
        .withColumn("should_stop", ~F.col("is_best") & (F.col("bad") > patience))
        .drop("_v", "_n")
    )


def path_signals(paths: DataFrame, bars: DataFrame) -> DataFrame:
    """Last, mean, max and min of each predicted path minus the last known close."""
    agg = paths.groupBy("date", "symbol").agg(
        F.max_by("value", "h").alias("_last"), F.avg("value").alias("_mean"), F.max("value").alias("_max"), F.min("value").alias("_min")
    )
    joined = agg.join(bars.select("date", "symbol", "close"), ["date", "symbol"])
    return joined.select("date", "symbol", *[(F.col(f"_{n}") - F.col("close")).alias(f"sig_{n}") for n in ("last", "mean", "max", "min")])


def predicted_return_curve(paths: DataFrame, bars: DataFrame | None, basis: str = "open", pred_len: int | None = None) -> DataFrame:
    """Predicted return per horizon h.

    'open': open_(h+1) / open_1 - 1 for h = 1 .. pred_len - 1. 'close': close_h / last close - 1.
    Paths shorter than ``pred_len`` are dropped. Packed paths, one row per (date, symbol) with an array ``path`` of the values
    h = 1, 2, .. and the last known ``close``, need neither ``bars`` nor a shuffle; there 'both' gives the columns by_open and
    by_close for h = 1 .. pred_len - 1.
    """
    if "path" in paths.columns:
        rows = paths if pred_len is None else paths.where(F.size("path") >= pred_len)
        first = F.get("path", F.lit(0))
        by_open = F.transform(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), lambda x: change(x, first))
        by_close = F.transform("path", lambda x: change(x, F.col("close")))
        if basis == "both":
            both = F.zip_with(by_open, F.slice(by_close, F.lit(1), F.size(by_open)), lambda o, c: F.struct(o.alias("by_open"), c.alias("by_close")))
            steps = rows.select("date", "symbol", F.posexplode(both).alias("h", "_s"))
            return steps.select("date", "symbol", (F.col("h") + 1).alias("h"), "_s.by_open", "_s.by_close")
        if basis not in ("open", "close"):
            raise ValueError(f"basis must be 'open', 'close' or 'both', got {basis!r}")
        steps = rows.select("date", "symbol", F.posexplode(by_open if basis == "open" else by_close).alias("h", "value"))
        return steps.withColumn("h", F.col("h") + 1)
    path = Window.partitionBy("date", "symbol")
    rows = paths
    if pred_len is not None:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(path)).where(F.col("_n") >= pred_len).drop("_n")
    if basis == "open":
        first = F.min_by("value", "h").over(path)
        return (
            rows.withColumn("value", change("value", first)).where(F.col("h") > 1)
            .select("date", "symbol", (F.col("h") - 1).alias("h"), "value")
        )
    if basis != "close":
        raise ValueError(f"basis must be 'open' or 'close', got {basis!r}")
    last = bars.select("date", "symbol", "close")
    return rows.join(last, ["date", "symbol"]).select("date", "symbol", "h", change("value", "close").alias("value"))


def sample_mean(samples: DataFrame) -> DataFrame:
    """Mean, spread and quantiles over the sampled paths of a (date, symbol, h).

    ``samples`` has one row per sample with its ``value``, or one row per (date, symbol, h) with all of them in an array
    ``values``, which needs no grouping. NULLs take no part.
    """
    if "values" not in samples.columns:
        agg = samples.groupBy("date", "symbol", "h").agg(
            F.avg("value").alias("value"),
            F.stddev_pop("value").alias("spread"),
            F.percentile("value", [0.1, 0.5, 0.9]).alias("_q"),
        )
        return agg.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(("q10", "q50", "q90"))}).drop("_q")
    rows = samples.withColumn("_v", F.array_sort(F.array_compact(F.col("values").cast("array<double>"))))
    n = F.size("_v")
    rows = rows.withColumn("value", ratio(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x), n))
    off = lambda x: x - F.col("value")
    rows = rows.withColumn("spread", F.sqrt(ratio(F.aggregate("_v", F.lit(0.0), lambda a, x: a + off(x) * off(x)), n)))

    def quantile(p: float) -> Column:
        at = (n - 1) * F.lit(p)
        low, high = (F.get("_v", f(at).cast("int")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at)))

    rows = rows.withColumns({name: quantile(p) for name, p in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))})
    return rows.select("date", "symbol", "h", "value", "spread", "q10", "q50", "q90")


def expand_score(scores: DataFrame, holds: list[int]) -> DataFrame:
    """A scalar score as a path: the same value at every horizon the variants look at."""
    return scores.select("date", "symbol", F.explode(F.array(*[F.lit(h) for h in holds])).alias("h"), F.col("score").alias("value"))


Forecaster = Callable[[list[np.ndarray], int], list[np.ndarray]]


def batch_forecast(contexts: DataFrame, fn: Forecaster | None = None, horizon: int = 10, batch: int = 64, field: str = "close") -> DataFrame:
    """Paths (date, symbol, h, value) from ``context_windows`` (rebal_date, symbol, win). No shuffle.

    Without ``fn`` the last value is carried on. ``fn`` gets up to ``batch`` windows of shape
    (lookback, 6) and returns one array of ``horizon`` values per window. Windows are equally long.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    if fn is None:
        return contexts.select(F.col("rebal_date").alias("date"), "symbol", steps.alias("h"), F.element_at("win", -1)[field].alias("value"))
    flat = contexts.select(F.col("rebal_date").alias("date"), "symbol", *[F.col("win")[f].alias(f) for f in BAR_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            windows = np.stack([np.stack(pdf[f].to_numpy()) for f in BAR_FIELDS], axis=2)
            values = [np.asarray(v, dtype=float) for i in range(0, len(pdf), batch) for v in fn(list(windows[i : i + batch]), horizon)]
            yield pd.DataFrame({"date": pdf["date"], "symbol": pdf["symbol"], "_p": values})

    out = flat.mapInPandas(run, "date date, symbol string, _p array<double>")
    return out.select("date", "symbol", F.posexplode("_p").alias("h", "value")).withColumn("h", F.col("h") + 1)
