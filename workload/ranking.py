"""Scores, selection and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions.groups import with_shares
from barline.operators import evaluate as ev
from barline.operators import features as feat
from barline.operators import labels as lab
from barline.operators import postprocess as post
from barline.operators import scores as sc
from barline.operators import select as sel
from barline.operators import windows as win
from barline.operators.calendar import schedule
from barline.plans.signals import blended_picks
from workload.base import (
    BENCHMARK,
    W,
    all_bars,
    bars,
    blended,
    by_date,
    calendar,
    cte,
    curves,
    features,
    limit_of_dates,
    market,
    packed,
    packed_paths,
    paths,
    query,
    r6,
    rounded,
    scratch,
    score_a,
    score_b,
    scored,
    sql,
    table,
)
from workload.series import rank_sql, rebal
from workload.tables import sched_sql, traded

K = 10


def z_sql(s: str, std: str) -> str:
    by = "OVER (PARTITION BY date)"
    return f"coalesce(({s} - avg({s}) {by}) / nullif({std}({s}) {by}, 0), {s} - avg({s}) {by})"


cte("aligned", "SELECT a.date, a.symbol, a.score AS score_a, b.score AS score_b FROM score_a a JOIN score_b b ON a.date = b.date AND a.symbol = b.symbol")
cte(
    "blended",
    f"SELECT date, symbol, 0.6::DOUBLE * {z_sql('score_a', 'stddev_pop')} + (1.0::DOUBLE - 0.6::DOUBLE) * {z_sql('score_b', 'stddev_pop')} AS score FROM aligned",
)
cte("placed_blend", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place FROM blended WHERE score >= 0")


@query("weekly_picks", sql(f"SELECT date, symbol, round(score, 6) AS score, place FROM placed_blend WHERE place <= {K}"))
def _(spark, sf):
    panel = features(spark, sf)
    return rounded(blended_picks(panel, -F.col("feat_ma5_dist"), F.col("feat_momentum_20"), K))


# ---- scores ---------------------------------------------------------------------------------


@query("zscore_by_date", sql(f"SELECT date, symbol, round({z_sql('score', 'stddev_samp')}, 6) AS score FROM score_b"))
def _(spark, sf):
    return rounded(sc.zscore_by_date(score_b(spark, sf), ddof=1))


@query("blend", sql("SELECT date, symbol, round(score, 6) AS score FROM blended"))
def _(spark, sf):
    return rounded(sc.blend(score_a(spark, sf), score_b(spark, sf), 0.6))


cte(
    "overlaid",
    """SELECT s.date, s.symbol, s.score + CASE WHEN n.idx >= 65 AND count(g.ret) >= 15 THEN 2.0 * avg(g.ret) ELSE 0 END AS score
  FROM blended s LEFT JOIN numbered n ON s.date = n.date LEFT JOIN grid_returns g
  ON g.symbol = s.symbol AND g.idx BETWEEN n.idx - 65 AND n.idx - 6 GROUP BY s.date, s.symbol, s.score, n.idx""",
)


@query("momentum_overlay", sql("SELECT date, symbol, round(score, 6) AS score FROM overlaid"))
def _(spark, sf):
    return rounded(sc.momentum_overlay(blended(spark, sf), bars(spark, sf), calendar(spark, sf)))


cte("label_places", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY label, symbol) AS place FROM scored")
cte(
    "gradient_pairs",
    """SELECT i.date, i.symbol AS up, j.symbol AS down, (1 / (1 + exp(10.0 * (i.score - j.score)))) AS rho, abs(i.place - j.place) AS dist
  FROM label_places i JOIN label_places j ON i.date = j.date AND i.label > j.label""",
)


@query(
    "rank_gradients",
    sql(
        """SELECT s.date, s.symbol, round(sum(coalesce(g, 0)), 6) AS grad,
  round(CASE WHEN max(n) < 2 THEN 0 ELSE greatest(sum(coalesce(h, 0)), 0.000001) END, 6) AS hess
  FROM (SELECT date, symbol, count(*) OVER (PARTITION BY date) AS n FROM scored) s LEFT JOIN
  (SELECT date, up AS symbol, -10.0 * rho * dist AS g, 100.0 * rho * (1 - rho) * dist AS h FROM gradient_pairs UNION ALL
   SELECT date, down, 10.0 * rho * dist, 100.0 * rho * (1 - rho) * dist FROM gradient_pairs) p ON s.date = p.date AND s.symbol = p.symbol
  GROUP BY s.date, s.symbol"""
    ),
)
def _(spark, sf):
    return rounded(sc.rank_gradients(by_date(spark, sf, scored(spark, sf)), sigma=10.0, limit=limit_of_dates(spark, sf)))


@query(
    "score_table",
    sql(
        f"""SELECT f.date, f.symbol, round(label, 6) AS label, {r6('feat_ma5_dist', 'feat_vol_10')}, round(-feat_ma5_dist + 2 * feat_vol_10, 6) AS linear
  FROM features f JOIN labels5 l ON f.symbol = l.symbol AND f.date = l.date WHERE f.date IN (SELECT date FROM traded)"""
    ),
)
def _(spark, sf):
    b = bars(spark, sf)
    panel = lab.forward_open_return(feat.volatility(feat.ma_dist(b, 5), 10), 5).select("date", "symbol", "label", "feat_ma5_dist", "feat_vol_10")
    cols = ["feat_ma5_dist", "feat_vol_10"]
    linear = lambda pdf: -pdf[cols[0]] + 2 * pdf[cols[1]]
    return rounded(sc.score_table(panel, {"linear": linear}, traded(spark, sf), cols))


@query(
    "assemble_features",
    sql("SELECT vec_id, 65 AS n_values, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) + label, 6) AS total FROM embeddings"),
)
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = sc.assemble_features(table(spark, sf, "embeddings"), ["embedding", "label"])
    values = vector_to_array("features")
    return rounded(rows.select("vec_id", F.size(values).alias("n_values"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total")))


def labelled(spark, sf, ranks=True):
    """All technical features, the 5-step label and, unless not asked for, the ranks of the features."""
    rows = feat.technical_arrays(lab.forward_open_return(bars(spark, sf), 5), keep=["label"]).where("label is not null")
    return feat.cs_rank(rows, feat.TECH_FEATURES) if ranks else rows


VALIDATE = "date >= '2000-01-01'"
RANKER_COLS = [*feat.TECH_FEATURES, *[c + feat.RANK_SUFFIX for c in feat.TECH_FEATURES]]


def ranker(spark, sf):
    """The stored panel of all 26 features and the target, the model trained on it with the default rounds, and its summary."""
    panel = by_date(spark, sf, labelled(spark, sf, ranks=False))
    rows = with_shares(panel, ["date"], [*feat.TECH_FEATURES, "label"], limit=limit_of_dates(spark, sf), sized=["label"])
    target = (F.col("label_share") - F.lit(0.5) / F.col("label_n") - F.lit(0.5)).alias("target")
    ranks = [F.col(f"{c}_share").alias(c + feat.RANK_SUFFIX) for c in feat.TECH_FEATURES]
    path = scratch(spark)
    rows.select("date", "symbol", "label", target, *feat.TECH_FEATURES, *ranks).write.parquet(path)
    panel = spark.read.parquet(path)
    return panel, *sc.fit_ranker(panel, RANKER_COLS, F.expr(VALIDATE), limit=limit_of_dates(spark, sf))


def tree_scores(panel, model, cols):
    """Every row of panel with its label, the score by all trees and the score by the first half of them, one at least."""
    full = sc.score_table(sc.assemble_features(panel, cols), {"score_full": model})
    half = sc.tree_range_score(sc.assemble_features(full, cols), model, max(1, model.getNumTrees // 2), "score_half")
    return half.select("date", "symbol", "label", "score_full", "score_half")


@query(
    "fit_ranker",
    sql(
        f"""SELECT date, symbol, round({rank_sql('label')} - 0.5 / count(*) OVER (PARTITION BY date) - 0.5, 6) AS target, {VALIDATE} AS is_val,
  count(*) OVER (PARTITION BY {VALIDATE}) AS split_rows, (SELECT count(DISTINCT d.date) FROM labels5 d WHERE d.label IS NOT NULL AND (d.{VALIDATE}) = (l.{VALIDATE})) AS split_dates
  FROM labels5 l WHERE label IS NOT NULL"""
    ),
)
def _(spark, sf):
    """Trains on all 26 features; what SQL can say of it are targets and splits, score_ranker gives what was learned."""
    panel, _, summary = ranker(spark, sf)
    rows = panel.withColumn("is_val", F.expr(VALIDATE))
    pick = lambda what: F.when(F.col("is_val"), summary["val"][what]).otherwise(summary["train"][what]).alias(f"split_{what}")
    return rounded(rows.select("date", "symbol", "target", "is_val", pick("rows"), pick("dates")))


@query("score_ranker")
def _(spark, sf):
    """The whole validation panel scored by the trained ranker. SQL has no trees that are learned; tests walk them."""
    panel, model, _ = ranker(spark, sf)
    return rounded(tree_scores(panel.where(VALIDATE).drop("target"), model, RANKER_COLS))


def small_trees(spark):
    """Two trees of one split each: feat_momentum_20 at 0.01 gives 0.5 or 2.5, then feat_ma5_dist at 0.02 half of -1 or 1."""
    from pyspark.ml.regression import GBTRegressor

    cols = ["feat_momentum_20", "feat_ma5_dist"]
    grid = spark.createDataFrame([(0.01 + x, 0.02 + y, 2.0 * (x > 0) + (y > 0)) for x in (-1, 1) for y in (-1, 1)], [*cols, "target"])
    gbt = GBTRegressor(featuresCol="features", labelCol="target", maxDepth=1, maxIter=2, stepSize=0.5, seed=1)
    return gbt.fit(sc.assemble_features(grid, cols)), cols


@query(
    "score_trees",
    sql(
        f"""SELECT f.date, f.symbol, round(label, 6) AS label, CASE WHEN feat_momentum_20 <= 0.01 THEN 0.5 ELSE 2.5 END AS score_half,
  CASE WHEN feat_momentum_20 <= 0.01 THEN 0.5 ELSE 2.5 END + CASE WHEN feat_ma5_dist <= 0.02 THEN -0.5 ELSE 0.5 END AS score_full
  FROM features f JOIN labels5 l ON f.symbol = l.symbol AND f.date = l.date WHERE label IS NOT NULL AND f.{VALIDATE}"""
    ),
)
def _(spark, sf):
    model, cols = small_trees(spark)
    return rounded(tree_scores(labelled(spark, sf, ranks=False).where(VALIDATE).select("date", "symbol", "label", *cols), model, cols))


cte(
    "two_trees",
    f"""SELECT f.date, f.symbol, label, unnest([1, 2]) AS trees, unnest([CASE WHEN feat_momentum_20 <= 0.01 THEN 0.5 ELSE 2.5 END,
  CASE WHEN feat_momentum_20 <= 0.01 THEN 0.5 ELSE 2.5 END + CASE WHEN feat_ma5_dist <= 0.02 THEN -0.5 ELSE 0.5 END]) AS score
  FROM features f JOIN labels5 l ON f.symbol = l.symbol AND f.date = l.date WHERE label IS NOT NULL AND f.{VALIDATE}""",
)
cte("two_tree_ranks", f"SELECT date, trees, {rank_sql('score', 'date, trees')} AS rs, {rank_sql('label', 'date, trees')} AS rl FROM two_trees")


cte(
    "spearman",
    f"""SELECT date, symbol, score, label, {rank_sql('score')} AS rs, {rank_sql('label')} AS rl,
  row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place, row_number() OVER (PARTITION BY date ORDER BY label DESC, symbol) AS ideal,
  count(*) OVER (PARTITION BY date) AS n FROM scored""",
)


def corr_sql(x: str, y: str, min_n: int = 3) -> str:
    return f"CASE WHEN count(*) >= {min_n} AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN CASE WHEN abs(covar_pop({x}, {y})) < 1e-9 THEN 0.0 ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END END"


cte("ics", f"SELECT date, count(*) AS n, {corr_sql('rs', 'rl')} AS rank_ic FROM spearman GROUP BY date")


@query(
    "tree_prefix_metrics",
    sql(
        f"""SELECT trees, count(rank_ic) AS n_dates, round(avg(rank_ic), 6) AS rank_ic
  FROM (SELECT date, trees, {corr_sql('rs', 'rl')} AS rank_ic FROM two_tree_ranks GROUP BY date, trees) GROUP BY trees"""
    ),
)
def _(spark, sf):
    """Mean rank IC of each prefix of the two known trees over the validation panel, the figure by which fit_ranker chooses."""
    model, cols = small_trees(spark)
    panel = labelled(spark, sf, ranks=False).where(VALIDATE).select("date", "symbol", "label", *cols)
    figures = sc.prefix_metrics(sc.assemble_features(panel, cols), model)
    return rounded(figures.select(F.col("trees").cast("int").alias("trees"), "n_dates", "rank_ic"))


cte(
    "excess",
    f"SELECT date, max(n) AS n, avg(label) FILTER (place <= {K}) AS top_mean, avg(label) AS universe_mean FROM spearman GROUP BY date HAVING max(n) >= {K}",
)
cte(
    "ndcgs",
    f"""SELECT date, max(n) AS n, sum(CASE WHEN place <= {K} THEN (n + 1 - ideal) / log2(place + 1) END)
  / sum(CASE WHEN ideal <= {K} THEN (n + 1 - ideal) / log2(ideal + 1) END) AS ndcg FROM spearman GROUP BY date HAVING max(n) >= {K}""",
)


@query(
    "select_metric",
    sql(
        """SELECT 'rank_ic' AS metric, round(avg(rank_ic), 6) AS value FROM ics UNION ALL
  SELECT 'top_k_excess', round(avg(top_mean - universe_mean), 6) FROM excess UNION ALL SELECT 'ndcg', round(avg(ndcg), 6) FROM ndcgs"""
    ),
)
def _(spark, sf):
    s = scored(spark, sf)
    parts = [ev.select_metric(s, m, K).select(F.lit(m).alias("metric"), "value") for m in ("rank_ic", "top_k_excess", "ndcg")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


cte(
    "trace",
    """SELECT year(date) AS run, date AS step, CASE WHEN rank_ic < -0.15 THEN CAST('nan' AS DOUBLE) ELSE rank_ic END AS value,
  CASE WHEN rank_ic < -0.15 THEN NULL ELSE rank_ic END AS v FROM ics WHERE rank_ic IS NOT NULL""",
)
cte(
    "trace_best",
    """SELECT *, coalesce(v > max(v) OVER p, v IS NOT NULL) AS is_best, row_number() OVER (PARTITION BY run ORDER BY step) AS n FROM trace
  WINDOW p AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)


@query(
    "early_stop_trace",
    sql(
        """SELECT run, step, round(best, 6) AS best, is_best, bad, NOT is_best AND bad > 2 AS should_stop FROM
  (SELECT *, max(v) OVER w AS best, n - coalesce(max(CASE WHEN is_best THEN n END) OVER w, 0) AS bad FROM trace_best
   WINDOW w AS (PARTITION BY run ORDER BY step))"""
    ),
)
def _(spark, sf):
    ics = ev.rank_ic(scored(spark, sf), "score", "label", ["date"]).where("rank_ic is not null")
    value = F.when(F.col("rank_ic") < -0.15, F.lit(float("nan"))).otherwise(F.col("rank_ic"))
    steps = ics.select(F.year("date").alias("run"), F.col("date").alias("step"), value.alias("value"))
    return rounded(sc.early_stop_trace(steps, 2, by=["run"]).select("run", "step", "best", "is_best", "bad", "should_stop"))


@query(
    "path_signals",
    sql(
        """SELECT p.date, p.symbol, round(max(value) FILTER (h = 10) - max(close), 6) AS sig_last, round(avg(value) - max(close), 6) AS sig_mean,
  round(max(value) - max(close), 6) AS sig_max, round(min(value) - max(close), 6) AS sig_min
  FROM paths p JOIN bars b ON p.date = b.date AND p.symbol = b.symbol GROUP BY p.date, p.symbol"""
    ),
)
def _(spark, sf):
    return rounded(sc.path_signals(paths(spark, sf), bars(spark, sf)))


@query(
    "predicted_return_curve",
    sql(
        """SELECT c.date, c.symbol, c.h, round(c.value, 5) AS by_open, round(p.value / nullif(b.close, 0) - 1, 5) AS by_close FROM curves c
  JOIN paths p ON c.date = p.date AND c.symbol = p.symbol AND c.h = p.h JOIN bars b ON p.date = b.date AND p.symbol = b.symbol"""
    ),
)
def _(spark, sf):
    return rounded(sc.predicted_return_curve(packed_paths(spark, sf), None, "both", 10), 5)


cte("samples", "SELECT date, symbol, h, value * (1 + s * s / 100.0::DOUBLE) AS value FROM paths, range(0, 5) t(s)")


@query(
    "sample_mean",
    sql(
        """SELECT date, symbol, h, round(avg(value), 3) AS value, round(stddev_pop(value), 3) AS spread, round(quantile_cont(value, 0.1), 3) AS q10,
  round(quantile_cont(value, 0.5), 3) AS q50, round(quantile_cont(value, 0.9), 3) AS q90 FROM samples GROUP BY date, symbol, h"""
    ),
)
def _(spark, sf):
    drawn = paths(spark, sf).withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: F.col("value") * (F.lit(1.0) + s * s / F.lit(100.0))))
    return rounded(sc.sample_mean(drawn).select("date", "symbol", "h", "value", "spread", "q10", "q50", "q90"), 3)


@query("expand_score", sql("SELECT date, symbol, h, round(score, 6) AS value FROM score_b, (SELECT unnest([3, 5, 10]) AS h)"))
def _(spark, sf):
    return rounded(sc.expand_score(score_b(spark, sf), [3, 5, 10]))


cte(
    "ctx_rows",
    """SELECT r.date AS rebal_date, b.*, row_number() OVER (PARTITION BY r.date, symbol ORDER BY b.date DESC) AS back
  FROM bars b JOIN rebal r ON b.date BETWEEN r.date - 810 AND r.date""",
)
cte(
    "ctx",
    """SELECT * FROM (SELECT *, 91 - back AS pos, count(*) OVER (PARTITION BY rebal_date, symbol) AS whole FROM ctx_rows WHERE back <= 90) WHERE whole = 90""",
)
cte("ctx_ends", "SELECT rebal_date AS date, symbol, max(close) FILTER (pos = 90) AS last, max(close) FILTER (pos = 1) AS first FROM ctx GROUP BY rebal_date, symbol")


def contexts(spark, sf):
    return win.context_windows(bars(spark, sf), rebal(spark, sf), lookback=90, recency_factor=9)


@query("batch_forecast", sql("SELECT date, symbol, h, round(last, 6) AS value FROM ctx_ends, (SELECT unnest(range(1, 11)) AS h)"))
def _(spark, sf):
    return rounded(sc.batch_forecast(contexts(spark, sf), horizon=10))


@query(
    "batch_forecast_fn",
    sql("SELECT date, symbol, h, round(last + h * (last - first) / 89, 6) AS value FROM ctx_ends, (SELECT unnest(range(1, 11)) AS h)"),
)
def _(spark, sf):
    def drift(windows: list[np.ndarray], horizon: int) -> list[np.ndarray]:
        """A caller's own forecaster: the line through first and last close."""
        closes = [w[:, 3] for w in windows]
        return [c[-1] + np.arange(1, horizon + 1) * (c[-1] - c[0]) / (len(c) - 1) for c in closes]

    return rounded(sc.batch_forecast(contexts(spark, sf), drift, horizon=10))


# ---- selection ------------------------------------------------------------------------------


@query("top_k", sql(f"SELECT date, symbol, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place FROM score_b WHERE score >= 0.05) WHERE place <= {K}"))
def _(spark, sf):
    return rounded(sel.top_k(score_b(spark, sf), K, 0.05))


cte("sched", sched_sql(3, 5))
cte(
    "held",
    f"""SELECT variant, exec_date, symbol FROM (SELECT s.variant, s.exec_date, c.symbol,
  row_number() OVER (PARTITION BY s.variant, s.exec_date ORDER BY c.value DESC, c.symbol) AS place
  FROM sched s JOIN curves c ON c.date = s.signal_date AND c.h = s.variant WHERE c.value >= 0) WHERE place <= {K}""",
)


def sched(spark, sf):
    return schedule(calendar(spark, sf), [3, 5])


def held(spark, sf):
    return sel.holdings(curves(spark, sf), sched(spark, sf), K)


@query("holdings", sql("SELECT variant, exec_date, symbol FROM held"))
def _(spark, sf):
    return rounded(held(spark, sf))


cte("exec_steps", "SELECT variant, exec_date, lead(exec_date) OVER (PARTITION BY variant ORDER BY exec_date) AS next_exec FROM sched")
cte(
    "prior_held",
    "SELECT h.variant, e.next_exec AS exec_date, h.symbol FROM held h JOIN exec_steps e ON h.variant = e.variant AND h.exec_date = e.exec_date WHERE next_exec IS NOT NULL",
)


@query(
    "rebalance_advice",
    sql(
        """SELECT coalesce(a.variant, b.variant) AS variant, coalesce(a.exec_date, b.exec_date) AS exec_date, coalesce(a.symbol, b.symbol) AS symbol,
  CASE WHEN a.symbol IS NULL THEN 'buy' WHEN b.symbol IS NULL THEN 'sell' ELSE 'hold' END AS action
  FROM prior_held a FULL JOIN held b ON a.variant = b.variant AND a.exec_date = b.exec_date AND a.symbol = b.symbol"""
    ),
)
def _(spark, sf):
    w = Window.partitionBy("variant").orderBy("exec_date")
    steps = sched(spark, sf).select("variant", "exec_date", F.lead("exec_date").over(w).alias("next_exec"))
    target = held(spark, sf)
    current = target.join(steps, ["variant", "exec_date"]).where("next_exec is not null").select("variant", F.col("next_exec").alias("exec_date"), "symbol")
    return rounded(sel.rebalance_advice(current, target, ["variant", "exec_date"]))


@query(
    "latest_signals",
    sql(f"SELECT date, symbol, round(score, 6) AS score, place FROM placed_blend WHERE place <= {K} AND date = (SELECT max(date) FROM market)"),
)
def _(spark, sf):
    return rounded(sel.latest_signals(blended(spark, sf), all_bars(spark, sf), BENCHMARK, K))


cte("moves", f"SELECT symbol, date, close / nullif(lag(close) OVER ({W}), 0) - 1 AS pred_return FROM bars")
cte("signals", "SELECT *, CASE WHEN pred_return > 0.2 THEN 1 WHEN pred_return < -0.2 THEN -1 ELSE 0 END AS signal FROM moves")
cte(
    "positions",
    f"""SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM signals""",
)


def positions(spark, sf):
    return sel.threshold_position(bars(spark, sf).select("symbol", "date", F.col("close").alias("value")), 0.2)


@query("threshold_position", sql("SELECT symbol, date, round(pred_return, 6) AS pred_return, signal, position FROM positions"))
def _(spark, sf):
    return rounded(positions(spark, sf).select("symbol", "date", "pred_return", "signal", "position"))


@query(
    "align_after",
    sql(
        """SELECT b.symbol, b.date FROM bars b LEFT JOIN (SELECT symbol, max(date) AS last FROM bars WHERE date < '2001-06-01' GROUP BY symbol) l ON b.symbol = l.symbol
  WHERE b.date > l.last AND CAST(substr(b.symbol, 2) AS INT) % 5 <> 0 OR CAST(substr(b.symbol, 2) AS INT) % 5 = 0 AND b.date < '1999-01-01'"""
    ),
)
def _(spark, sf):
    # every fifth symbol only has predictions from before its history ends: all of those stay
    b = bars(spark, sf).select("symbol", "date")
    fifth = F.expr("CAST(substr(symbol, 2) AS INT) % 5 = 0")
    pred = b.where(~fifth | (F.col("date") < "1999-01-01"))
    return sel.align_after(pred, b.where("date < '2001-06-01'"))


cte("cap", "SELECT 'S' || s_suppkey AS symbol, CAST(greatest(s_acctbal, 0) AS DOUBLE) AS weight FROM supplier WHERE s_nationkey < 18")
cte("weighted", "SELECT h.*, coalesce(c.weight, 0) AS weight FROM held h LEFT JOIN cap c ON h.symbol = c.symbol")


def weights(spark, sf):
    s = table(spark, sf, "supplier").where("s_nationkey < 18")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.greatest("s_acctbal", F.lit(0)).cast("double").alias("weight"))


@query("period_weights", sql("SELECT variant, exec_date, symbol, round(weight, 6) AS weight FROM weighted"))
def _(spark, sf):
    return rounded(sel.period_weights(held(spark, sf), weights(spark, sf)))


# weights by date: volumes, of every other symbol, in two weeks of three
cte("dated_cap", "SELECT date, symbol, volume AS weight FROM bars WHERE weekofyear(date) % 3 <> 0 AND CAST(substr(symbol, 2) AS INT) % 2 = 0")


@query(
    "period_weights_dated",
    sql(
        """SELECT variant, exec_date, h.symbol, round(CASE WHEN d.date IS NOT NULL THEN coalesce(c.weight, 0) END, 6) AS weight FROM held h
  LEFT JOIN dated_cap c ON h.symbol = c.symbol AND h.exec_date = c.date LEFT JOIN (SELECT DISTINCT date FROM dated_cap) d ON h.exec_date = d.date"""
    ),
)
def _(spark, sf):
    every_other = F.expr("weekofyear(date) % 3 <> 0 AND CAST(substr(symbol, 2) AS INT) % 2 = 0")
    dated = bars(spark, sf).where(every_other).select("date", "symbol", F.col("volume").alias("weight"))
    return rounded(sel.period_weights(held(spark, sf), dated))


# ---- evaluation -----------------------------------------------------------------------------


@query("rank_ic", sql("SELECT date, n, round(rank_ic, 6) AS rank_ic FROM ics"))
def _(spark, sf):
    return rounded(ev.rank_ic(scored(spark, sf), "score", "label", ["date"]))


@query("mean_ic", sql("SELECT count(rank_ic) AS n_groups, round(avg(rank_ic), 6) AS mean_ic FROM ics"))
def _(spark, sf):
    return rounded(ev.mean_ic(ev.rank_ic(scored(spark, sf), "score", "label", ["date"])))


@query(
    "ic_ir",
    sql(
        """SELECT 'validation' AS mode, count(rank_ic) AS n_groups, round(avg(rank_ic), 6) AS mean_ic, round(avg(rank_ic) / (stddev_pop(rank_ic) + 0.00000001), 6) AS ic_ir,
  round(count(*) FILTER (rank_ic > 0) / count(rank_ic), 6) AS pct_positive FROM ics UNION ALL
  SELECT 'forecast', count(rank_ic), round(avg(rank_ic), 6), round(avg(rank_ic) / stddev_pop(rank_ic), 6), round(count(*) FILTER (rank_ic > 0) / count(rank_ic), 6) FROM ics UNION ALL
  SELECT 'period', count(rank_ic), round(avg(rank_ic), 6), round(avg(rank_ic) / stddev_samp(rank_ic), 6), round(count(*) FILTER (rank_ic > 0) / count(rank_ic), 6) FROM ics"""
    ),
)
def _(spark, sf):
    ics = ev.rank_ic(scored(spark, sf), "score", "label", ["date"])
    parts = [ev.ic_ir(ics, m).withColumn("mode", F.lit(m)) for m in ("validation", "forecast", "period")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


cte(
    "open_paths",
    """SELECT p.date, p.symbol, p.h, p.value, b.open AS actual FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars) o
  JOIN paths p ON p.symbol = o.symbol AND p.date = o.date JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars) b
  ON b.symbol = o.symbol AND b.rn = o.rn + p.h""",
)
cte(
    "open_returns",
    """SELECT p.date, p.symbol, p.h - 1 AS h, p.value / f.value - 1 AS pred, p.actual / f.actual - 1 AS act FROM open_paths p
  JOIN open_paths f ON p.date = f.date AND p.symbol = f.symbol AND f.h = 1 WHERE p.h BETWEEN 2 AND 6 AND f.value > 0 AND f.actual > 0""",
)
cte("open_ranks", f"SELECT date, h, {rank_sql('pred', 'date, h')} AS rp, {rank_sql('act', 'date, h')} AS ra FROM open_returns")
cte("open_ics", f"SELECT date, h, {corr_sql('rp', 'ra')} AS rank_ic FROM open_ranks GROUP BY date, h")


@query(
    "validation_metrics",
    sql(
        """SELECT count(rank_ic) AS n_groups, round(avg(rank_ic), 6) AS mean_ic,
  round(avg(rank_ic) FILTER (h = 5) / (stddev_pop(rank_ic) FILTER (h = 5) + 0.00000001), 6) AS ic_ir FROM open_ics"""
    ),
)
def _(spark, sf):
    rows = packed(feat.momentum(lab.with_own_path(bars(spark, sf), 10, "open"), 5))
    return rounded(ev.validation_metrics(rows, None, 5, 5))


@query("top_k_excess", sql(f"SELECT date, n, {r6('top_mean', 'universe_mean', 'top_mean - universe_mean AS top_excess')} FROM excess"))
def _(spark, sf):
    return rounded(ev.top_k_excess(scored(spark, sf), K))


@query("ndcg_at_k", sql("SELECT date, n, round(ndcg, 6) AS ndcg FROM ndcgs"))
def _(spark, sf):
    return rounded(ev.ndcg_at_k(scored(spark, sf), K))


@query(
    "top_k_overlap",
    sql(
        f"""SELECT date, round(count(*) FILTER (a <= {K} AND b <= {K}) / {K}, 6) AS overlap FROM
  (SELECT date, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS a, row_number() OVER (PARTITION BY date ORDER BY score_b DESC, symbol) AS b,
   count(*) OVER (PARTITION BY date) AS n FROM scored) WHERE n >= {K} GROUP BY date"""
    ),
)
def _(spark, sf):
    return rounded(ev.top_k_overlap(scored(spark, sf), "score", "score_b", K))


cte(
    "daily_metrics",
    f"""SELECT date, max(n) AS n, {corr_sql('rs', 'rl')} AS rank_ic, avg(label) FILTER (place <= {K}) AS top_mean, avg(label) AS universe_mean,
  count(*) FILTER (place <= {K} AND ideal <= {K}) / {K} AS overlap_topk, avg(label) FILTER (place <= {K}) - avg(label) AS top_excess
  FROM spearman GROUP BY date HAVING max(n) >= {2 * K}""",
)


@query("per_day_metrics", sql(f"SELECT date, n, {r6('rank_ic', 'top_mean', 'universe_mean', 'overlap_topk', 'top_excess')} FROM daily_metrics"))
def _(spark, sf):
    return rounded(ev.per_day_metrics(scored(spark, sf), K))


PERIODS = {"Q": "year(date) || 'Q' || quarter(date)", "M": "strftime(date, '%Y-%m')", "Y": "CAST(year(date) AS VARCHAR)", "all": "CASE WHEN date IS NOT NULL THEN 'all' END"}


def period_sql(source: str, freq: str, extra: str = "") -> str:
    return f"""SELECT {extra + ', ' if extra else ''}'{freq}' AS freq, {PERIODS[freq]} AS period, count(*) AS days, round(avg(rank_ic), 6) AS mean_ic,
  round(CASE WHEN count(*) > 1 AND stddev_samp(rank_ic) > 0 THEN avg(rank_ic) / stddev_samp(rank_ic) END, 6) AS ic_ir,
  round(count(*) FILTER (rank_ic > 0) / count(*), 6) AS pct_ic_pos, round(avg(top_excess), 6) AS mean_top_excess, round(avg(overlap_topk), 6) AS mean_overlap,
  round(avg(universe_mean), 6) AS universe_mean_label FROM {source} GROUP BY {extra + ', ' if extra else ''}{PERIODS[freq]}"""


@query("aggregate_period", sql(" UNION ALL ".join(period_sql("daily_metrics", f) for f in PERIODS)))
def _(spark, sf):
    return rounded(ev.aggregate_period(ev.per_day_metrics(scored(spark, sf), K), list(PERIODS)))


RAW = feat.TECH_FEATURES
cte(
    "feature_long",
    " UNION ALL ".join(
        f"SELECT f.date, f.symbol, '{c}' AS feature, f.{c} AS score, label FROM features f JOIN labels5 l ON f.symbol = l.symbol AND f.date = l.date WHERE label IS NOT NULL"
        for c in RAW
    ),
)
cte(
    "feature_ranks",
    f"""SELECT feature, date, label, {rank_sql('score', 'feature, date')} AS rs, {rank_sql('label', 'feature, date')} AS rl,
  row_number() OVER (PARTITION BY feature, date ORDER BY score DESC, symbol) AS place, row_number() OVER (PARTITION BY feature, date ORDER BY label DESC, symbol) AS ideal,
  count(*) OVER (PARTITION BY feature, date) AS n FROM feature_long""",
)
cte(
    "feature_daily",
    f"""SELECT feature, date, {corr_sql('rs', 'rl')} AS rank_ic, avg(label) AS universe_mean, count(*) FILTER (place <= {K} AND ideal <= {K}) / {K} AS overlap_topk,
  avg(label) FILTER (place <= {K}) - avg(label) AS top_excess FROM feature_ranks GROUP BY feature, date HAVING max(n) >= {2 * K}""",
)


@query("feature_diagnostics", sql(" UNION ALL ".join(period_sql("feature_daily", f, "feature") for f in ("Q", "all"))))
def _(spark, sf):
    panel = by_date(spark, sf, labelled(spark, sf, ranks=False).select("date", "symbol", "label", *RAW))
    return rounded(ev.feature_diagnostics(panel, RAW, K, ["Q", "all"], limit=limit_of_dates(spark, sf)))


cte(
    "close_paths",
    """SELECT p.date, p.symbol, p.h, p.value AS pred, b.close AS act, o.close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars) o
  JOIN paths p ON p.symbol = o.symbol AND p.date = o.date JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars) b
  ON b.symbol = o.symbol AND b.rn = o.rn + p.h""",
)
cte("close_returns", "SELECT *, pred / close - 1 AS pr, act / close - 1 AS ar FROM close_paths")
cte("close_ranks", f"SELECT date, h, {rank_sql('pr', 'date, h')} AS rp, {rank_sql('ar', 'date, h')} AS ra FROM close_returns")
cte("close_ics", f"SELECT date, h, {corr_sql('rp', 'ra')} AS rank_ic FROM close_ranks GROUP BY date, h")


@query(
    "forecast_fidelity",
    sql(
        """SELECT e.h, n, round(mape, 6) AS mape, round(mape_naive, 6) AS mape_naive, round(rmse_ret, 6) AS rmse_ret, round(direction_acc, 6) AS direction_acc,
  round(always_up_rate, 6) AS always_up_rate, round(ic_mean, 6) AS ic_mean, round(ic_std, 6) AS ic_std, round(ic_ir, 6) AS ic_ir, round(ic_positive_rate, 6) AS ic_positive_rate FROM
  (SELECT h, count(*) AS n, avg(abs(pred - act) / abs(act)) AS mape, avg(abs(close - act) / abs(act)) AS mape_naive, sqrt(avg((pr - ar) * (pr - ar))) AS rmse_ret,
    count(*) FILTER (abs(pr) > 1e-9 AND abs(ar) > 1e-9 AND sign(pr) = sign(ar)) / nullif(count(*) FILTER (abs(pr) > 1e-9 AND abs(ar) > 1e-9), 0) AS direction_acc,
    avg(CASE WHEN ar > 0 THEN 1.0 ELSE 0.0 END) AS always_up_rate FROM close_returns GROUP BY h) e JOIN
  (SELECT h, avg(rank_ic) AS ic_mean, stddev_pop(rank_ic) AS ic_std, avg(rank_ic) / nullif(stddev_pop(rank_ic), 0) AS ic_ir, count(*) FILTER (rank_ic > 0) / count(rank_ic) AS ic_positive_rate
   FROM close_ics GROUP BY h) i ON e.h = i.h"""
    ),
)
def _(spark, sf):
    rows = packed(feat.momentum(lab.with_own_path(bars(spark, sf), 10, "close"), 5))
    return rounded(ev.forecast_fidelity(rows))


cte("pair_ranks", f"SELECT date, {rank_sql('score_a')} AS ra, {rank_sql('score_b')} AS rb FROM aligned")
cte("pair_ics", f"SELECT date, {corr_sql('ra', 'rb', 2)} AS c FROM pair_ranks GROUP BY date")


@query("score_complementarity", sql("SELECT count(c) AS n_days, round(avg(c), 6) AS mean_correlation FROM pair_ics"))
def _(spark, sf):
    return rounded(ev.score_complementarity(score_a(spark, sf), score_b(spark, sf)))


cte("pairs", f"SELECT symbol, date, close AS actual, lag(close) OVER ({W}) * 0.98 AS predicted FROM bars")


@query(
    "accuracy_summary",
    sql(
        f"""SELECT symbol, count(*) AS n, round(avg(err), 6) AS mean_abs_pct_error, round(count(*) FILTER (err < 0.05) / count(*), 6) AS accuracy,
  round(count(*) FILTER (dp = da) / count(*), 6) AS direction_accuracy,
  round(covar_pop(predicted, actual) / (stddev_pop(predicted) * stddev_pop(actual)), 6) AS correlation FROM
  (SELECT *, abs(predicted / nullif(actual, 0) - 1) AS err, sign(predicted - lag(predicted) OVER ({W})) AS dp, sign(actual - lag(actual) OVER ({W})) AS da
   FROM pairs WHERE predicted IS NOT NULL) GROUP BY symbol"""
    ),
)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    pred = F.lag("close").over(w) * F.lit(0.98)
    pairs = bars(spark, sf).select("symbol", "date", F.col("close").alias("actual"), pred.alias("predicted")).where("predicted is not null")
    return rounded(ev.accuracy_summary(pairs))


GAPS = ", ".join(f"round(abs(o.{c} - b.{c}), 6) AS {c}_gap, round(abs(o.{c} - b.{c}) / nullif(b.{c}, 0) * 100, 6) AS {c}_gap_pct" for c in ("open", "high", "low", "close"))


@query(
    "continuity_gap",
    sql(
        f"""SELECT o.date, o.symbol, {GAPS} FROM (SELECT *, row_number() OVER ({W}) AS rn FROM bars) o
  JOIN (SELECT *, row_number() OVER ({W}) AS rn FROM bars) b ON b.symbol = o.symbol AND b.rn = o.rn + 1"""
    ),
)
def _(spark, sf):
    b = bars(spark, sf)
    w = Window.partitionBy("symbol").orderBy("date")
    pred = b.withColumn("h", F.lit(1))
    actual = b.select("symbol", "date", *[F.lead(c).over(w).alias(c) for c in ("open", "high", "low", "close")]).where("close is not null")
    return rounded(ev.continuity_gap(pred, actual.withColumn("h", F.lit(1))))


@query(
    "code_usage",
    sql(
        """SELECT 's1' AS code, count(*) AS unique_tokens, round(-sum(c / t * log2(c / t)), 6) AS entropy_bits, CAST(max(t) AS BIGINT) AS total_tokens
  FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS t FROM sign_codes GROUP BY s1) UNION ALL
  SELECT 's2', count(*), round(-sum(c / t * log2(c / t)), 6), CAST(max(t) AS BIGINT) FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS t FROM sign_codes GROUP BY s2)"""
    ),
)
def _(spark, sf):
    codes = feat.sign_code(table(spark, sf, "embeddings"), 10, 10)
    s1, s2 = (ev.code_usage(codes, c).select(F.lit(c).alias("code"), "unique_tokens", "entropy_bits", "total_tokens") for c in ("s1", "s2"))
    return rounded(s1.unionByName(s2))


cte(
    "units",
    """SELECT vec_id, CAST(x AS DOUBLE) / sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) OVER (PARTITION BY vec_id)) AS u, CASE WHEN x > 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END AS d
  FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)""",
)


@query("reconstruction_mse", sql("SELECT count(DISTINCT vec_id) AS n, round(avg((u - d) * (u - d)), 6) AS mse FROM units"))
def _(spark, sf):
    return rounded(ev.reconstruction_mse(feat.unit_signs(table(spark, sf, "embeddings")), "unit", "decoded"))


@query(
    "group_pearson_ic",
    sql(
        """SELECT date, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE covar_pop(score, label) / ((stddev_pop(score) + 0.00000001) * (stddev_pop(label) + 0.00000001)) END, 6) AS ic
  FROM scored GROUP BY date"""
    ),
)
def _(spark, sf):
    return rounded(ev.group_pearson_ic(scored(spark, sf), ["date"]))


@query(
    "forecast_report",
    sql(
        """SELECT p.date, p.symbol, count(*) AS n_steps, """
        + r6(
            "max(value) FILTER (h = 10) AS end_value",
            "max(value) AS max_value",
            "min(value) AS min_value",
            "avg(value) AS mean_value",
            "stddev_samp(value) AS std_value",
            "max(close) AS last_close",
            "(max(value) FILTER (h = 10) / max(close) - 1) * 100 AS change_pct",
        )
        + " FROM paths p JOIN bars b ON p.date = b.date AND p.symbol = b.symbol GROUP BY p.date, p.symbol"
    ),
)
def _(spark, sf):
    return rounded(ev.forecast_report(paths(spark, sf), bars(spark, sf)))


@query(
    "forecast_steps",
    sql(
        """SELECT h, count(*) AS n, round(avg(value - close), 6) AS change, round(avg((value / close - 1) * 100), 6) AS change_pct
  FROM paths p JOIN bars b ON p.date = b.date AND p.symbol = b.symbol GROUP BY h"""
    ),
)
def _(spark, sf):
    steps = ev.forecast_steps(paths(spark, sf), bars(spark, sf))
    return rounded(steps.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.avg("change").alias("change"), F.avg("change_pct").alias("change_pct")))


@query(
    "group_runs",
    sql(
        """SELECT event_type, count(*) AS n_rows, count(*) FILTER (prev IS NULL OR prev <> event_type) AS n_runs FROM
  (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events) GROUP BY event_type"""
    ),
)
def _(spark, sf):
    return rounded(ev.group_runs(table(spark, sf, "events"), "event_type", "event_id", block=1000))


# ---- post-processing ------------------------------------------------------------------------


def bar_paths(spark, sf):
    """Paths for every bar: h = 1..10 of the four prices drifting along the 5-step momentum."""
    drift_by = F.lit(1.0) + F.col("h") * F.col("feat_momentum_5") / F.lit(10.0)
    rows = feat.momentum(bars(spark, sf), 5).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(10))))
    prices = [(F.col(c) * drift_by).alias(c) for c in ("open", "high", "low", "close")]
    return rows.select("date", "symbol", "h", *prices, (F.col("volume") * F.col("h")).alias("volume"))


def packed_bar_paths(spark, sf):
    """(date, symbol, close, path): ``bar_paths`` with one row per (date, symbol)."""
    drift_by = lambda h: F.lit(1.0) + h * F.col("feat_momentum_5") / F.lit(10.0)
    prices = lambda h: [(F.col(c) * drift_by(h)).alias(c) for c in ("open", "high", "low", "close")]
    step = lambda h: F.struct(h.alias("h"), *prices(h), (F.col("volume") * h).alias("volume"))
    path = F.transform(F.sequence(F.lit(1), F.lit(10)), step).alias("path")
    return feat.momentum(bars(spark, sf), 5).select("date", "symbol", "close", path)


cte(
    "bar_paths",
    """SELECT b.date, b.symbol, CAST(t.h AS INTEGER) AS h, """
    + ", ".join(f"b.{c} * (1 + t.h * f.feat_momentum_5 / 10) AS {c}" for c in ("open", "high", "low", "close"))
    + ", volume * t.h AS volume FROM bars b JOIN features f ON b.symbol = f.symbol AND b.date = f.date, range(1, 11) t(h)",
)

@query(
    "price_limit",
    "WITH RECURSIVE "
    + sql("SELECT * FROM bar_paths").removeprefix("WITH ").rsplit("\nSELECT", 1)[0]
    + """,
fold AS (SELECT date, symbol, 0 AS h, close AS o, close AS hi, close AS lo, close AS last FROM bars
  UNION ALL SELECT p.date, p.symbol, p.h, greatest(least(p.open, f.last * 1.1::DOUBLE), f.last * 0.9::DOUBLE), greatest(least(p.high, f.last * 1.1::DOUBLE), f.last * 0.9::DOUBLE),
    greatest(least(p.low, f.last * 1.1::DOUBLE), f.last * 0.9::DOUBLE), greatest(least(p.close, f.last * 1.1::DOUBLE), f.last * 0.9::DOUBLE)
  FROM fold f JOIN bar_paths p ON p.date = f.date AND p.symbol = f.symbol AND p.h = f.h + 1)
SELECT date, symbol, h, round(o, 4) AS open, round(hi, 4) AS high, round(lo, 4) AS low, round(last, 4) AS close FROM fold WHERE h > 0""",
)
def _(spark, sf):
    out = post.price_limit(packed_bar_paths(spark, sf), None, 0.1)
    return rounded(out.select("date", "symbol", "h", "open", "high", "low", "close"), 4)


cte("usual", "SELECT symbol, avg(volume) AS usual FROM (SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM bars) WHERE r <= 20 GROUP BY symbol")


@query(
    "smooth_path",
    sql(
        """SELECT date, symbol, h, round(c, 4) AS close, round(v, 4) AS volume FROM
  (SELECT p.date, p.symbol, p.h, avg(p.close) OVER (PARTITION BY p.date, p.symbol ORDER BY p.h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) * (1 + trend * 0.3) AS c,
    greatest(usual * 0.3, least(usual * 3.0, p.volume)) AS v FROM bar_paths p JOIN slopes s ON p.symbol = s.symbol JOIN usual u ON p.symbol = u.symbol)"""
    ),
)
def _(spark, sf):
    return rounded(post.smooth_path(packed_bar_paths(spark, sf), bars(spark, sf)).select("date", "symbol", "h", "close", "volume"), 4)


# holidays: the days on which the market volume was highest in its month, with an effect by month
cte(
    "feasts",
    """SELECT date AS last_day, 10 + extract(month FROM date) AS days, extract(month FROM date) / 1000.0::DOUBLE AS effect FROM
  (SELECT date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY volume DESC, date) AS r FROM market) WHERE r = 1""",
)


@query(
    "holiday_effect",
    sql(
        """SELECT date, symbol, h, round(value * coalesce(factor, 1), 4) AS value FROM (SELECT p.date, p.symbol, p.h, p.value,
   (SELECT product(1 + effect) FROM feasts f WHERE p.date + p.h >= f.last_day AND p.date + p.h < f.last_day + CAST(f.days AS INTEGER)) AS factor FROM paths p)"""
    ),
)
def _(spark, sf):
    w = Window.partitionBy(F.trunc("date", "month")).orderBy(F.col("volume").desc(), "date")
    month = F.month("date")
    feasts = market(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select(
        F.col("date").alias("end"), (month + 10).alias("days"), (month / F.lit(1000.0)).alias("effect")
    )
    target = paths(spark, sf).withColumn("target_date", F.date_add("date", F.col("h")))
    out = post.holiday_effect(target, feasts, ["value"])
    return rounded(out.select("date", "symbol", "h", "value"), 4)


@query(
    "plausibility",
    sql(
        """SELECT p.date, p.symbol, h, abs(value - close) > close * 0.3::DOUBLE AS implausible
  FROM paths p JOIN bars b ON p.date = b.date AND p.symbol = b.symbol"""
    ),
)
def _(spark, sf):
    out = post.plausibility(paths(spark, sf), bars(spark, sf))
    return rounded(out.select("date", "symbol", "h", "implausible"))


OUTLOOK = {
    "uptrend": "s_nationkey % 2 = 0",
    "trend_strength": "s_nationkey / CAST(25 AS DOUBLE)",
    "sector_hot": "n_regionkey >= 2",
    "resonance": "(n_regionkey + 1) / CAST(6 AS DOUBLE)",
    "sector_count": "CAST(n_regionkey AS DOUBLE)",
    "macro": "CAST(s_suppkey % 10 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "expected_cuts": "CASE WHEN s_suppkey % 3 = 0 THEN CAST(2 AS DOUBLE) END",
    "fundamental": "CAST(s_suppkey % 7 AS DOUBLE) / CAST(7 AS DOUBLE)",
}
cte(
    "outlook",
    "SELECT 'S' || s_suppkey AS symbol, " + ", ".join(f"{v} AS {k}" for k, v in OUTLOOK.items()) + " FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
cte(
    "factors",
    """SELECT symbol, greatest(0.9, least(1.1, (CASE WHEN uptrend THEN 1 + trend_strength * 0.08 ELSE 1 + (trend_strength - 0.5) * 0.04 END)
  * (CASE WHEN sector_hot THEN 1 + resonance * 0.06 + least(sector_count * 0.01, 0.03) ELSE 1 + (resonance - 0.5) * 0.02 END)
  * (1 + (macro - 0.5) * 0.06) * (1 + coalesce(expected_cuts, 0) * 0.015) * (1 + (fundamental - 0.5) * 0.08))) AS factor FROM outlook""",
)


@query(
    "factor_adjust",
    sql(
        """SELECT date, p.symbol, h, round(factor, 4) AS factor, round(close * factor, 4) AS close, round(volume * (1 + (factor - 1) * 0.3), 4) AS volume
  FROM bar_paths p JOIN factors f ON p.symbol = f.symbol"""
    ),
)
def _(spark, sf):
    dims = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    outlook = dims.selectExpr("concat('S', s_suppkey) AS symbol", *[f"{v} AS {k}" for k, v in OUTLOOK.items()])
    out = post.factor_adjust(bar_paths(spark, sf), outlook)
    return rounded(out.select("date", "symbol", "h", "factor", "close", "volume"), 4)
