"""Keyed texts, header carry in long documents, calendar expiry of stream state, and the streamed user hook."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.udf import scan_per_group
from panelforge.operators import windows as W
from panelforge.session import scratch_path
from panelforge.sources import keyed as KY
from panelforge.sources import text as TX
from panelforge.streaming.incremental import composite_stream, read_composite


def _local(path):
    return path.removeprefix("file:")


def test_keyed_texts_round_trip(spark):
    rows = [(i, "é\n" * (i % 7) + f"text {i}") for i in range(300)] + [(400, ""), (401, None), (None, "x")]
    path = scratch_path(spark, "keyed")
    KY.write_keyed(spark.createDataFrame(rows, "k long, t string").repartition(3), "k", "t", path, piece_bytes=500)
    want = {k: t for k, t in rows if k is not None and t is not None}
    back = KY.read_keyed(spark, path)
    assert {r["key"]: r["text"] for r in back.collect()} == want and back.rdd.getNumPartitions() > 6
    listed = KY.manifest(path)
    assert len(listed) <= 3 and sum(f["rows"] for f in listed) == len(want)
    some = {r["key"]: r["text"] for r in KY.read_keyed(spark, path, keys=[5, 400, 999]).collect()}
    assert some == {5: want[5], 400: ""}
    assert KY.read_keyed(spark, path, keys=[]).count() == 0


def test_keyed_texts_append_overwrite_and_strays(spark):
    path = scratch_path(spark, "keyed")
    one, two = (spark.createDataFrame([(k, k * 3)], "k string, t string") for k in ("a", "b"))
    KY.write_keyed(one, "k", "t", path)
    KY.write_keyed(two, "k", "t", path, mode="append")
    assert sorted(r["text"] for r in KY.read_keyed(spark, path, key_type="string").collect()) == ["aaa", "bbb"]
    with open(os.path.join(_local(path), "part-stray.txt"), "w") as f:  # of a task that failed
        f.write("never read")
    assert KY.read_keyed(spark, path).count() == 2
    KY.write_keyed(two, "k", "t", path)
    assert [r["key"] for r in KY.read_keyed(spark, path, key_type="string").collect()] == ["b"]
    KY.write_keyed(one.limit(0), "k", "t", path)
    assert KY.read_keyed(spark, path).count() == 0


@pytest.mark.parametrize("block_lines", [1, 3, 10, 10_000])
def test_headers_carry_over_blocks(spark, block_lines):
    heads = {2: 2, 9: 9, 30: 30}
    lines = [("a", i, heads.get(i)) for i in range(1, 60)] + [("b", i, None) for i in range(1, 20)] + [(None, 1, 1), (None, 40, None)]
    d = spark.createDataFrame(lines, "f string, i int, h int").repartition(4)
    got = {(r["f"], r["i"]): r["header"] for r in W.carry_header(d, "f", "i", "h", block_lines=block_lines).collect()}
    assert got == {("a", i): max((k for k in heads if k <= i), default=None) for i in range(1, 60)} | {
        ("b", i): None for i in range(1, 20)} | {(None, 1): 1, (None, 40): 1}


def test_one_long_report_spreads_over_tasks(spark):
    block = "Alpha County (Rank {0}, FIPS {1})\n\"pred\": {0}.5\n" + "filler\n" * 40
    text = "".join(block.format(i, 27000 + i) for i in range(1, 1200))
    d = spark.createDataFrame([(1, text)], "doc int, text string")
    got = TX.parse_report(d, "doc", "text", ["pred"])
    assert {r["rank"]: (r["key"], r["pred"]) for r in got.collect()} == {i: (27000 + i, i + 0.5) for i in range(1, 1200)}
    lines = TX.lines(d, "doc", "text").withColumn("h", F.lit(None).cast("int"))
    carried = W.carry_header(lines, "doc", "line_no", "h", block_lines=1000)
    assert carried.select(F.floor(F.col("line_no") / 1000)).distinct().count() > 40


def _days(spark, path, name, rows):
    d = spark.createDataFrame([(p, dt.datetime(*t), v) for p, t, v in rows], "pixel int, ts timestamp, value double")
    d.coalesce(1).write.mode("append").parquet(path)


def test_month_state_expires_and_restarts(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    schema = "pixel int, ts timestamp, value double"
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(schema)

    def run():
        q = composite_stream(spark, src, schema, "pixel", "ts", ["value"], sink, ckpt, grain="month", lateness="40 days")
        q.awaitTermination()
        state = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
        return state[-1]["numRowsTotal"], sum(s["numRowsDroppedByWatermark"] for s in state)

    _days(spark, src, "a", [(1, (2001, 1, 5), 1.0), (2, (2001, 1, 20), 2.0), (1, (2001, 1, 31), 3.0)])
    assert run()[0] == 2
    _days(spark, src, "b", [(1, (2001, 2, 1), 10.0), (1, (2001, 1, 9), 5.0)])  # January is still open
    assert run()[0] == 3
    _days(spark, src, "c", [(1, (2001, 4, 2), 7.0)])
    kept, _ = run()
    assert kept <= 2  # January and February have closed
    _days(spark, src, "d", [(1, (2001, 1, 15), 1000.0), (2, (2001, 4, 3), 9.0)])  # too late for January
    kept, dropped = run()
    assert dropped >= 1 and kept <= 2
    got = {(r["pixel"], r["period"].strftime("%Y-%m")): r["value"] for r in read_composite(spark, sink, "pixel", ["value"]).collect()}
    assert got == {(1, "2001-01"): 3.0, (2, "2001-01"): 2.0, (1, "2001-02"): 10.0, (1, "2001-04"): 7.0, (2, "2001-04"): 9.0}


def test_groups_larger_than_a_batch_are_streamed(spark):
    sizes = []

    def smooth(state, rows):
        level = state
        out = []
        for x in rows["x"]:
            level = x if level is None else 0.5 * x + 0.5 * level
            out.append(level)
        return level, rows.assign(level=out, n=len(rows))[["g", "i", "level", "n"]]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        d = spark.range(1000).select(F.when(F.col("id") % 5 == 4, F.lit(None)).otherwise(F.col("id") % 5 % 2).cast("int").alias("g"),
                                     F.col("id").alias("i"), (F.col("id") % 17).cast("double").alias("x")).repartition(3)
        got = scan_per_group(d, ["g"], ["i"], smooth, "g int, i long, level double, n int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 1000 and max(r["n"] for r in got) <= 100
    by = {(r["g"], r["i"]): r["level"] for r in got}
    for g in (0, 1, None):
        level = None
        for i in sorted(i for k, i in by if k == g):
            level = float(i % 17) if level is None else 0.5 * (i % 17) + 0.5 * level
            assert by[g, i] == pytest.approx(level, abs=1e-12)
    assert not sizes


def test_many_small_groups_leave_together(spark):
    """Groups of two rows: one frame per batch reaches Spark, not one per group, and states do not mix."""
    def step(state, rows):
        assert isinstance(rows["x"], np.ndarray)
        state = (state or 0.0) + rows["x"].sum()
        return state, {"g": rows["g"], "total": np.full(len(rows["x"]), state), "rows": np.full(len(rows["x"]), len(rows["x"]))}

    d = spark.range(4000).select((F.col("id") % 2000).alias("g"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    got = scan_per_group(d, ["g"], ["i"], step, "g long, total double, rows long", arrays=True).collect()
    assert len(got) == 4000 and {r["g"]: r["total"] for r in got if r["rows"] == 2}.items() <= {(g, 2.0 * g + 2000) for g in range(2000)}
    assert sum(r["rows"] == 2 for r in got) >= 3980  # but for groups that a batch's end cuts
