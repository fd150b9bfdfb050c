"""Positions, running sums and blocks against plain Python."""

from __future__ import annotations

import glob
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rillflow.plans import ordering, sizing, storage


def test_running_sums_of_a_hot_group_with_nulls(spark):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.6 else rng.choice("abc"), i, None if rng.random() < 0.1 else rng.randrange(10)) for i in range(1000)]
    rng.shuffle(rows)
    got = {(r.g, r.i): (r.s, r.s_total) for r in ordering.running_sums(spark.createDataFrame(rows, "g string, i bigint, x bigint"), ["g"], [F.col("i")], {"s": F.col("x")}, totals=True).collect()}
    want, sums = {}, {}
    for g, i, x in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + (x or 0)
        want[g, i] = sums[g]
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] == sums[k[0]] for k, v in got.items())


def test_positions_and_empty_input(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    assert all(r.rn == r.x + 1 for r in ordering.with_position(df, [F.col("x")]).collect())
    assert ordering.with_position(df.limit(0), [F.col("x")]).count() == 0


@pytest.mark.parametrize("block_rows", [10, 37, 1000])
def test_blocks_see_their_neighbours(spark, block_rows):
    df = spark.range(300)
    framed = ordering.blocked(df, [F.col("id")], before=3, after=2, block_rows=block_rows)
    w = ordering.block_window()
    out = ordering.own_rows(framed.withColumns({"a": F.lag("id", 3).over(w), "b": F.lead("id", 2).over(w)})).collect()
    assert len(out) == 300
    assert all(r.a == (r.id - 3 if r.id >= 3 else None) and r.b == (r.id + 2 if r.id < 298 else None) for r in out)


def test_names_and_sizes(spark):
    df = spark.createDataFrame([(1, 2)], "__part int, `odd``name` int")
    assert ordering.free_name(df, "__PART") == "___PART"
    assert ordering.running_sums(df, ["odd`name"], [F.col("__part")], {"s": F.lit(1)}).count() == 1
    small, large = spark.range(10), spark.range(20)
    assert sizing.broadcast_if_small(large, 10) is large and sizing.broadcast_if_small(small, 10) is not small


def test_written_tables_go_to_the_shared_folder(spark):
    kept = storage.materialize(spark.range(5), "test")
    folder = storage.shared_dir(spark).removeprefix("file://")
    assert kept.inputFiles() and all(folder in f for f in kept.inputFiles())
    storage.delete(spark, kept.inputFiles()[0])



def test_small_streams_are_told_from_large(spark):
    small, large = spark.range(100), spark.range(10**9)
    assert ordering.is_small(small, 10_000) and not ordering.is_small(large, 10_000)
    by = [F.col("id")]
    for limit in (0, 10_000):
        sums = ordering.running_sums(small, [], by, {"s": F.col("id")}, totals=True, small_bytes=limit).collect()
        assert all(r.s == r.id * (r.id + 1) // 2 and r.s_total == 4950 for r in sums) and len(sums) == 100


def test_running_sums_of_decimals_floats_and_odd_groups(spark):
    rows = [(float("nan") if i % 3 == 0 else None if i % 3 == 1 else -0.5, i, Decimal(i) / 4, i / 8) for i in range(60)]
    df = spark.createDataFrame(rows, "g double, i bigint, d decimal(10,2), f double")
    out = ordering.running_sums(df, ["g"], [F.col("i")], {"dd": F.col("d"), "ff": F.col("f")}).collect()
    for r in out:
        own = [x for x in rows if x[1] % 3 == r.i % 3 and x[1] <= r.i]
        assert r.dd == sum(x[2] for x in own) and r.ff == pytest.approx(sum(x[3] for x in own))


def test_small_tables_can_be_tried_in_the_distributed_form(spark):
    df = spark.range(500)
    with ordering.distributed(block_rows=10):
        framed = ordering.blocked(df, [F.col("id")], before=2, small_bytes=1 << 30)
    assert framed.where(ordering.OWN).agg(F.max(ordering.BLOCK)).first()[0] == 49
    assert ordering.settings == ordering.Settings()


def test_written_tables_are_removed(spark):
    folder = storage.shared_dir(spark).removeprefix("file://")

    def written():
        return {p for p in glob.glob(f"{folder}/rillflow-*/*")}

    before = written()
    with storage.workspace(spark):
        kept = storage.materialize(spark.range(5), "test")
        name = storage.new_table("test")
        spark.range(3).write.option("path", storage.new_path(spark, "t")).saveAsTable(name)
        assert kept.count() == 5 and spark.catalog.tableExists(name) and len(written()) == len(before) + 2
    assert written() == before and not spark.catalog.tableExists(name)
