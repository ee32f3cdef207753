"""Plans look as intended, and streams behave."""

from __future__ import annotations

import datetime as dt
import random
import time

from pyspark.sql import functions as F
from tests.conftest import days, flat_bars, rows

from barline.functions.groups import best_k
from barline.operators import features, labels, scores
from barline.operators.windows import contexts
from barline.plans import backtest
from barline.operators import windows as win_ops
from barline.sources import bars as src
from barline.sources import sinks
from barline.streaming import bars as live
from workload import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def stored(bars_of, tmp_path):
    path = str(tmp_path / "panel")
    sinks.write_panel(bars_of({s: flat_bars(days(600, "2020-01-01")) for s in "AB"}), path)
    return path


def test_stored_panel_prunes_years_columns_and_pushes_filters(spark, bars_of, tmp_path):
    df = src.read_bars(spark, stored(bars_of, tmp_path), "A", "2021-03-01", "2021-04-30").select("date", "close")
    text = plan(df)
    assert "PartitionFilters: [isnotnull(year" in text and "2021" in text
    assert "EqualTo(symbol,A)" in text and "ReadSchema: struct<symbol:string,date:date,close:double>" in text
    assert df.count() == 23 + 22  # weekdays of March and April


def test_features_labels_and_windows_share_one_shuffle(spark, bars_of, tmp_path):
    bars = src.open_panel(spark, stored(bars_of, tmp_path))
    rows_ = labels.forward_open_return(features.momentum(features.ma_dist(bars, 5), 20), 5)
    assert plan(rows_).count("Exchange hashpartitioning") == 1
    assert plan(features.technical_features(bars)).count("Exchange hashpartitioning") == 1


def test_a_panel_stored_by_symbol_needs_no_exchange(spark, bars_of, tmp_path):
    rows_ = {s: flat_bars(days(100, "2020-01-01"), price=10.0 + i) for i, s in enumerate("ABCDE")}
    rows_["E"] = rows_["E"][:30]
    by_symbol = sinks.store_by_symbol(bars_of(rows_), str(tmp_path / "layout"), "layout_a", buckets=4)
    again = sinks.open_by_symbol(spark, str(tmp_path / "layout"), "layout_b", src.BAR_SCHEMA, 4)
    usual = bars_of(rows_)
    for stored_ in (by_symbol, again):
        assert stored_.count() == 430
        assert "Exchange" not in plan(features.technical_features(stored_))
        assert "Exchange" not in plan(labels.forward_open_return(stored_, 5))
        assert "Exchange" not in plan(labels.own_path(stored_, 5))
        assert "Exchange" not in plan(win_ops.normalised_windows(stored_, 10, 5))
        assert sorted(features.technical_features(stored_).collect()) == sorted(features.technical_features(usual).collect())
    # bars are read by bucket, the reference dates alone are dealt out
    refs = usual.select("symbol", "date").where("date = '2020-02-03'")
    path = labels.actual_path(by_symbol, refs, 3)
    assert not [line for line in plan(path).split("\n") if "Exchange" in line and "close" in line]
    assert sorted(path.collect()) == sorted(labels.actual_path(usual, refs, 3).collect())
    empty = sinks.store_by_symbol(usual.where("false"), str(tmp_path / "none"), "layout_none", buckets=4)
    assert empty.count() == 0


def test_a_sweep_reads_and_joins_bars_as_often_for_many_depths_as_for_one(spark, bars_of, tmp_path):
    bars = src.open_panel(spark, stored(bars_of, tmp_path))
    curves = bars.select("date", "symbol", F.lit(5).alias("h"), (F.col("close") - F.col("open")).alias("value"))
    cal = bars.select("date").distinct()
    for mode in ("close", "next_open"):
        one, many = (plan(backtest.sweep(curves, bars, cal, [(k, 5, 0.0, None) for k in range(1, n + 1)], mode)) for n in (1, 100))
        for part in ("FileScan", "SortMergeJoin", "BroadcastHashJoin", "Exchange hashpartitioning", "Window"):
            assert one.count(part) == many.count(part), (mode, part)
        assert "Cartesian" not in many and "NestedLoop" not in many


def test_merge_rewrites_touched_years_only(spark, bars_of, tmp_path):
    path = stored(bars_of, tmp_path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "panel").rglob("part-*")}
    first, second = days(1, "2021-03-01")[0], days(1, "2031-05-05")[0]  # a year of the panel and a new one
    changes = bars_of({"A": flat_bars([first], 7.0), "C": flat_bars([second], 9.0)}).withColumn("seq", F.lit(1))
    older = changes.withColumn("close", F.lit(1.0)).withColumn("seq", F.lit(0))
    keyless = changes.withColumn("date", F.lit(None).cast("date"))
    want = sorted(src.upsert_bars(src.open_panel(spark, path).drop("year"), changes).collect())
    updates = changes.unionByName(older).unionByName(keyless)
    assert sinks.merge_panel(updates, path, str(tmp_path / "merge-1")) == [2021, 2031]
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "panel").rglob("part-*")}
    kept = {f for f in before if "year=2021" not in str(f)}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any("year=2021" in str(f) for f in set(before) & set(after))
    read = lambda: sorted(src.open_panel(spark, path).drop("year").collect())
    assert read() == want
    # the same batch again, by a new merge and by its staged rows after a year got lost half-way
    sinks.merge_panel(updates, path, str(tmp_path / "merge-2"))
    assert read() == want
    for f in (tmp_path / "panel" / "year=2021").iterdir():
        f.unlink()
    assert len(read()) < len(want)
    assert sinks.merge_panel(updates, path, str(tmp_path / "merge-2")) == [2021, 2031]
    assert read() == want
    assert sinks.merge_panel(updates.limit(0), path, str(tmp_path / "merge-3")) == []
    assert read() == want


def test_features_are_pruned_to_the_ones_used(spark, bars_of, tmp_path):
    bars = src.open_panel(spark, stored(bars_of, tmp_path))
    text = plan(features.technical_features(bars).select("symbol", "date", "feat_ma5_dist"))
    assert "stddev" not in text and "volume" not in text


def test_top_k_cuts_before_the_shuffle(spark, bars_of, tmp_path):
    df = src.open_panel(spark, stored(bars_of, tmp_path)).withColumn("score", F.col("close"))
    assert "WindowGroupLimit" in plan(best_k(df, ["date"], "score", 10)) and "Partial" in plan(best_k(df, ["date"], "score", 10))


def test_large_k_is_cut_in_salted_parts(spark):
    (d,) = days(1)
    rng = random.Random(1)
    df = spark.createDataFrame([(d, f"S{i}", float(rng.randrange(500))) for i in range(5000)], "date date, symbol string, score double")
    got = [r["symbol"] for r in best_k(df, ["date"], "score", 1500).orderBy("place").collect()]
    want = [r["symbol"] for r in df.orderBy(F.desc("score"), "symbol").limit(1500).collect()]
    assert got == want


def test_scores_are_not_shuffled_for_their_zscore(spark, bars_of, tmp_path):
    df = src.open_panel(spark, stored(bars_of, tmp_path)).withColumn("score", F.col("close"))
    text = plan(scores.zscore_by_date(df))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_contexts_shuffle_the_bars_once_and_copy_nothing_before(spark, bars_of, tmp_path):
    bars = src.open_panel(spark, stored(bars_of, tmp_path))
    text = plan(contexts(bars, bars.select("date").distinct(), 5))
    assert text.count("Exchange") == 1 and "Join" not in text
    below = text[text.index("Exchange") :]
    assert "Generate" not in below


def test_no_registered_query_uses_a_cartesian_product(spark):
    trains = {"fit_ranker"}  # building it runs it
    for name, fn in catalog.QUERIES.items():
        if name not in trains:
            text = plan(fn(spark, "/root/testdata/sf0.001"))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


EVENTS = "event_id long, ts timestamp_ntz, symbol string, price double"


def _stamp(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_late_events_amend_open_bars_and_are_dropped_after(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [(1, _stamp(5), "A", 10.0), (2, _stamp(62), "A", 20.0)],
        [(3, _stamp(50), "A", 5.0), (4, _stamp(180), "A", 30.0)],  # 00:50 is late, its bar still open
        [(5, _stamp(10), "A", 99.0), (6, _stamp(400), "A", 40.0)],  # 00:10 comes after its bar was closed
        [(7, _stamp(800), "A", 50.0)],
    ]
    late = live.LateRows("late")
    spark.streams.addListener(late)
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(source)
        query = (
            live.stream_bars(stream).writeStream.queryName("late").format("parquet").option("path", sink)
            .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    out = spark.read.parquet(sink).withColumn("hour", F.hour("date"))
    assert rows(out.where("hour = 0"), "open", "high", "low", "close", "volume") == [(10.0, 10.0, 5.0, 5.0, 2.0)]
    assert rows(out, "hour") == [(0,), (1,), (3,), (6,)]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for _ in range(50):  # listeners are told a little later
        if late.dropped:
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.dropped == 1


def test_replayed_batch_changes_nothing(spark, tmp_path, bars_of):
    ds = days(2)
    base_bars = bars_of({"A": flat_bars(ds)}).withColumn("seq", F.lit(1))
    newer = bars_of({"A": flat_bars(ds[:1], 7.0)}).withColumn("seq", F.lit(2))
    older = bars_of({"A": flat_bars(ds, 3.0)}).withColumn("seq", F.lit(0))
    path = str(tmp_path / "table")
    base_bars.write.parquet(f"{path}/batch=0")
    for _ in range(2):
        live.newest_version(newer, F.col("seq")).write.mode("overwrite").parquet(f"{path}/batch=1")
        assert rows(live.current_bars(spark, path), "date", "close") == [(ds[0], 7.0), (ds[1], 100.0)]
    older.write.parquet(f"{path}/batch=2")  # a late, older version does not win
    live.compact_bars(spark, path, str(tmp_path / "small"))
    for table in (path, str(tmp_path / "small")):
        assert rows(live.current_bars(spark, table), "date", "close") == [(ds[0], 7.0), (ds[1], 100.0)]


def test_upserts_fold_and_keep_the_highest_version(spark, tmp_path, bars_of):
    ds = days(2)
    schema = bars_of({"A": flat_bars(ds)}).withColumn("seq", F.lit(1)).schema
    for i, (price, seq) in enumerate([(1.0, 1), (5.0, 9), (2.0, 2), (3.0, 3), (4.0, 4)]):
        bars_of({"A": flat_bars(ds, price)}).withColumn("seq", F.lit(seq)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        live.stream_upsert(stream, str(tmp_path / "table"), str(tmp_path / "progress"), fold=2).awaitTermination()
        want = 1.0 if i == 0 else 5.0
        assert rows(live.current_bars(spark, str(tmp_path / "table")), "date", "close") == [(d, want) for d in ds]
    assert sorted(p.name for p in (tmp_path / "table").glob("base=*")) == ["base=1", "base=3"]
