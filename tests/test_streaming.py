"""Streams against the same data as a table, restarts, and the prefix rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from triflux.functions.hashing import SketchParams
from triflux.operators.histogram import histogram, histogram_of, in_range
from triflux.operators.sketch import count_sketch
from triflux.plans.jobs import report_on_counts, report_on_items
from triflux.sources.items import items_from, stream_files
from triflux.streaming.offered import offer
from triflux.streaming.partials import (
    counts_tree,
    drain,
    partials_tree,
    read_counts,
    read_partials,
    read_running,
    running,
    write_counts,
    write_partials,
)
from triflux.streaming.prefix import batch_totals, keep_prefix, prefix_batches, prior_totals
from triflux.streaming.ranges import MergeTree, Range, carried
from triflux.streaming.state import keep_histogram, read_histogram
from triflux.streaming.stops import TRIGGER

PARAMS = SketchParams.draw(3, 16, seed=4)
LEFT, RIGHT = 10, 90


def put(folder, number, items):
    folder.mkdir(exist_ok=True)
    (folder / f"part-{number}.txt").write_text("".join(f"{x}\n" for x in items))


def some_items(seed, n=2_000):
    rng = random.Random(seed)
    return [rng.randrange(100) for _ in range(n)]


def stream(spark, folder, files=1):
    text = stream_files(spark, str(folder), format="text", max_files_per_batch=files)
    return items_from(text, "value")


def table(spark, folder):
    return items_from(spark.read.text(str(folder)), "value")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(4):
        put(source, i, some_items(i))
    counts = drain(stream(spark, source), LEFT, RIGHT)
    assert counts.select("batch").distinct().count() == 4
    batch = table(spark, source)
    hist = histogram(batch, LEFT, RIGHT)
    assert rows(histogram_of(counts).select("item", "f")) == rows(hist.select("item", "f"))
    from_stream = report_on_counts(counts, PARAMS, 5).first()
    assert from_stream == report_on_items(batch, LEFT, RIGHT, PARAMS, 5).first()
    assert from_stream.n_total == 8_000


def test_restart_counts_nothing_twice(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        query = write_partials(
            stream(spark, source), out, check, LEFT, RIGHT, availableNow=True
        )
        query.awaitTermination()
        return read_partials(spark, out).agg(F.sum("n")).first()[0]

    for i in range(3):
        put(source, i, some_items(i))
    assert run() == 6_000
    assert run() == 6_000
    # As after a crash before the last batch was committed: it is run again.
    (tmp_path / "check" / "commits" / "2").unlink()
    (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert run() == 6_000
    for i in range(3, 5):
        put(source, i, some_items(i))
    assert run() == 10_000
    hist = histogram(table(spark, source), LEFT, RIGHT)
    assert rows(histogram_of(read_partials(spark, out))) == rows(hist)


def test_running_sketch_and_histogram(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(2):
        put(source, i, some_items(i))
    out, check = str(tmp_path / "cells"), str(tmp_path / "state")

    def run():
        inside = stream(spark, source).where(in_range(LEFT, RIGHT))
        query = running(count_sketch(inside, PARAMS), out, check, availableNow=True)
        query.awaitTermination()
        return rows(read_running(spark, out).select("r", "c", "cell"))

    def want():
        inside = table(spark, source).where(in_range(LEFT, RIGHT))
        return rows(count_sketch(inside, PARAMS).select("r", "c", "cell"))

    assert run() == want()
    put(source, 2, some_items(2))
    assert run() == want()


def test_threshold_keeps_the_crossing_batch(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(5):
        put(source, i, some_items(i))
    counts = drain(stream(spark, source), LEFT, RIGHT)
    kept = prefix_batches(batch_totals(counts, "n"), 5_000)
    assert rows(kept) == [(0, 2_000, 0), (1, 2_000, 2_000), (2, 2_000, 4_000)]
    prefix = keep_prefix(counts, 5_000, "n")
    assert report_on_counts(prefix, PARAMS, 5).first().n_total == 6_000


@pytest.mark.parametrize("block_bits", [0, 1, 3, 20])
def test_prior_totals_in_blocks(spark, block_bits):
    rng = random.Random(6)
    totals = {b: rng.randrange(50) for b in rng.sample(range(100), 40)}
    df = spark.createDataFrame(list(totals.items()), "batch bigint, n bigint")
    want = [(b, n, sum(m for c, m in totals.items() if c < b)) for b, n in totals.items()]
    assert rows(prior_totals(df, block_bits)) == sorted(want)


def test_prefix_of_an_exactly_full_stream(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "batch bigint, n bigint")
    assert [r.batch for r in prefix_batches(df, 10).orderBy("batch").collect()] == [0, 1]
    assert prefix_batches(df, 11).count() == 3


def test_scratch_needs_a_shared_folder(spark, tmp_path):
    from triflux.functions.scratch import scratch_path

    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(f"file:{root}/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_readers_see_committed_batches_only(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):
        put(source, i, some_items(i))
    query = write_partials(
        stream(spark, source), out, str(tmp_path / "c"), LEFT, RIGHT, availableNow=True
    )
    query.awaitTermination()
    want = set(map(tuple, read_partials(spark, out).collect()))
    # What an attempt wrote before it failed, and a second attempt at a committed batch.
    half = spark.createDataFrame([(20, 999, 3)], "item bigint, n bigint, batch bigint")
    half.write.parquet(f"{out}/data/3-3-half")
    assert set(map(tuple, read_partials(spark, out).collect())) == want
    tree = partials_tree(spark, out)
    assert tree.add(half, 1) == tree.version()
    assert set(map(tuple, read_partials(spark, out).collect())) == want
    # The next commit removes what no version names.
    tree.add(half, 3)
    assert "3-3-half" not in {x.name for x in (tmp_path / "out" / "data").iterdir()}
    assert set(map(tuple, read_partials(spark, out).collect())) == want | {(20, 999, 3)}


def test_an_empty_stream_has_a_report_of_zeros(spark, tmp_path):
    (tmp_path / "in").mkdir()
    counts = drain(stream(spark, tmp_path / "in"), LEFT, RIGHT)
    assert counts.count() == 0
    report = report_on_counts(counts, PARAMS, 5).first()
    assert (report.n_total, report.n_in_range, report.n_distinct) == (0, 0, 0)
    assert read_running(spark, str(tmp_path / "none"), "r int, c bigint, cell bigint").count() == 0


@pytest.mark.parametrize("fanout", [2, 4, 10])
def test_a_thousand_batches_are_few_ranges(fanout):
    ranges, written = (), 0
    for batch in range(1_000):
        stay, gone, level = carried(ranges, fanout)
        low = gone[0].low if gone else batch
        ranges = (*stay, Range(level, low, batch, "x", 0))
        written += batch - low + 1
        assert len(ranges) <= (fanout - 1) * (1 + math.log(batch + 1, fanout))
        assert [r.level for r in ranges] == sorted((r.level for r in ranges), reverse=True)
        assert ranges[0].low == 0 and ranges[-1].high == batch
        assert all(a.high + 1 == b.low for a, b in zip(ranges, ranges[1:]))
        assert all(r.high - r.low + 1 == fanout**r.level for r in ranges)
    # Each batch is written once a level.
    assert written <= 1_000 * (1 + math.log(1_000, fanout))


def test_ranges_add_up_to_all_batches(spark, tmp_path):
    tree = MergeTree(spark, str(tmp_path / "t"), ["item"], ["n"], fanout=3, versions=2)
    rng, want = random.Random(1), {}
    for batch in range(30):
        rows = [(rng.choice([None, 1, 2, 3, batch]), 1 + batch % 7) for _ in range(3)]
        for item, n in rows:
            want[item] = want.get(item, 0) + n
        version = tree.add(spark.createDataFrame(rows, "item bigint, n bigint").coalesce(1), batch)
    assert [r.level for r in version.ranges] == [3, 1]
    assert len(list((tmp_path / "t" / "data").iterdir())) <= len(version.ranges) + 2
    assert len([x for x in (tmp_path / "t" / "versions").iterdir() if x.suffix == ".json"]) == 2
    got = tree.summed("item bigint, n bigint").collect()
    assert {r.item: r.n for r in got} == want and len(got) == len(want)


def test_a_reader_of_an_older_version_is_not_disturbed(spark, tmp_path):
    tree = MergeTree(spark, str(tmp_path / "t"), ["item"], ["n"], "n", fanout=2, versions=6)
    schema = "item bigint, n bigint"
    one = spark.createDataFrame([(1, 2)], schema)
    for batch in range(3):
        tree.add(one, batch)
    older = tree.version()
    rows_of_older = tree.summed(schema, older)
    for batch in range(3, 8):
        assert tree.add(one, batch).total == 2 * (batch + 1)
    assert [tuple(r) for r in rows_of_older.collect()] == [(1, 6)]
    assert [tuple(r) for r in tree.summed(schema).collect()] == [(1, 16)]


def test_histogram_in_state_grows_over_restarts(spark, tmp_path):
    source, check = tmp_path / "in", str(tmp_path / "check")

    def run():
        query = keep_histogram(stream(spark, source), check, LEFT, RIGHT, availableNow=True)
        query.awaitTermination()
        return rows(read_histogram(spark, check))

    def want():
        return rows(histogram(table(spark, source), LEFT, RIGHT))

    for i in range(3):
        put(source, i, some_items(i))
    assert run() == want() == run()
    first = want()
    for i in range(3, 6):
        put(source, i, some_items(i))
    assert run() == want() != first
    assert rows(read_histogram(spark, check, 2)) == first


def test_state_can_be_read_while_the_query_runs(spark, tmp_path):
    source, check = tmp_path / "in", str(tmp_path / "check")
    put(source, 0, some_items(0))
    query = keep_histogram(stream(spark, source), check, LEFT, RIGHT)
    try:
        query.processAllAvailable()
        assert rows(read_histogram(spark, check)) == rows(histogram(table(spark, source), LEFT, RIGHT))
        put(source, 1, some_items(1))
        query.processAllAvailable()
        assert query.isActive
        assert rows(read_histogram(spark, check)) == rows(histogram(table(spark, source), LEFT, RIGHT))
    finally:
        query.stop()


def test_default_trigger_is_a_tenth_of_a_second(spark, tmp_path):
    assert TRIGGER == "100 milliseconds"
    source = tmp_path / "in"
    put(source, 0, some_items(0))
    out = str(tmp_path / "out")
    query = write_partials(stream(spark, source), out, str(tmp_path / "c"), LEFT, RIGHT)
    try:
        query.processAllAvailable()
        assert read_partials(spark, out).agg(F.sum("n")).first()[0] == 2_000
        put(source, 1, some_items(1))
        # The query is still there and takes what comes.
        query.processAllAvailable()
        assert read_partials(spark, out).agg(F.sum("n")).first()[0] == 4_000
        spec = query._jsq.streamingQuery().trigger().toString()
        assert "100" in spec and "ProcessingTime" in spec
    finally:
        query.stop()


def offered(spark, folder, numbers):
    """A table with the given numbers of rows per partition; None is the unnumbered one."""
    data = [(10 + i % 7, k) for k, n in numbers.items() for i in range(n)]
    frame = spark.createDataFrame(data, "item bigint, day bigint")
    frame.write.partitionBy("day").parquet(str(folder))
    return offer(spark.read.schema("item bigint, day bigint").parquet(str(folder)), "day")


def test_partitions_are_offered_in_order(spark, tmp_path):
    days = offered(spark, tmp_path / "t", {17: 3, None: 5, 15: 2, 20: 4})
    assert days.batches == 7
    counts = drain(days, LEFT, RIGHT)
    assert rows(prior_totals(batch_totals(counts, "n"))) == [(0, 2, 0), (2, 3, 2), (5, 4, 5), (6, 5, 9)]
    assert rows(prefix_batches(batch_totals(counts, "n"), 6)) == [(0, 2, 0), (2, 3, 2), (5, 4, 5)]


def test_a_query_stops_itself_and_counts_each_batch_once(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    days = offered(spark, tmp_path / "t", {k: 10 for k in range(30)})

    def run(threshold):
        query = write_counts(days, out, check, LEFT, RIGHT, threshold)
        assert query.awaitTermination(120) and query.exception() is None
        version = counts_tree(spark, out).version()
        assert read_counts(spark, out).agg(F.sum("n")).first()[0] == version.total
        return version.batch, version.total

    assert run(45) == (4, 50)
    # Again: what is offered after the end does not count.
    assert run(45) == (4, 50)
    for commit in (tmp_path / "check" / "commits").iterdir():
        if commit.name.strip(".").split(".")[0] in ("3", "4", "5", "6"):
            commit.unlink()
    assert run(45) == (4, 50)


def test_items_of_unknown_time_come_last(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (None, 4), (None, 5)], "batch bigint, item bigint")
    assert prior_totals(batch_totals(df)).orderBy(F.asc_nulls_last("batch")).collect()[-1].prior == 3
    kept = {t: sorted(r.item for r in keep_prefix(df, t).collect()) for t in (1, 3, 4)}
    assert kept == {1: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4, 5]}
