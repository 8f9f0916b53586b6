"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry_points
from triflux.operators.graph import canonical_edges, closed_wedges, lay_out, orient
from triflux.operators.histogram import top_k
from triflux.operators.triangles import count_by_triplets, count_exact, estimate_by_colours
from triflux.plans import registry
from triflux.sources.edges import edges_from

SF = "/root/testdata/sf0.001"
STREAMS = {
    "item_histogram_stream",
    "item_histogram_running",
    "item_histogram_state",
    "count_sketch_stream",
    "count_sketch_running",
    "stream_prefix_batches",
    "stream_report_prefix",
    "stream_summary_stream",
    "stream_top_k",
}
BATCH = sorted(set(registry.QUERIES) - STREAMS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """The plan that ran, without the initial plans of its parts."""
    df.collect()
    kept, skipping = [], None
    for line in plan(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if skipping is not None and depth >= skipping:
            continue
        skipping = depth if "== Initial Plan ==" in line else None
        if skipping is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(entry_points.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "MapIn"):
        assert operator not in text


def test_scans_read_only_the_columns_and_rows_needed(spark):
    text = plan(entry_points.queries()["item_histogram"](spark, SF))
    assert "ReadSchema: struct<l_partkey:bigint>" in text
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_partkey,5\)", text)
    text = plan(entry_points.queries()["triangles_exact"](spark, SF))
    assert set(re.findall(r"ReadSchema: (\S+)", text)) == {
        "struct<l_partkey:bigint,l_suppkey:bigint>"
    }


def test_colour_filter_runs_before_the_first_shuffle(spark):
    text = plan(entry_points.queries()["monochromatic_edges"](spark, SF))
    assert text.index("Exchange hashpartitioning") < text.index("Filter")


def test_closing_join_shuffles_edges_once(spark):
    edges = edges_from(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_partkey", "l_suppkey")
    text = final(closed_wedges(orient(canonical_edges(edges))))
    assert "SortMergeJoin" in text
    assert re.search(r"ReusedExchange \[src.*REPARTITION_BY_COL", text)
    assert text.count("FileScan") == 1


def test_runs_on_laid_out_edges_shuffle_no_edge(spark):
    edges = edges_from(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_partkey", "l_suppkey")
    layout = lay_out(edges)
    want = count_exact(edges).first().triangles
    for a, b in registry.RUNS[:2]:
        run = estimate_by_colours(layout, 4, [(a, b)])
        assert run.first().estimate == estimate_by_colours(edges, 4, [(a, b)]).first().estimate
        text = final(run)
        keys = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text))
        # What moves is out-arrays, to the vertices that close them, and then counts.
        assert all("mid#" in x and "salt#" in x or x.startswith("run#") for x in keys), keys
        assert "Bucketed: true" in text and "lineitem" not in text
    assert count_exact(layout).first().triangles == want
    text = final(count_by_triplets(layout, 3, 5, 7))
    assert not re.search(r"hashpartitioning\((src|u|v|x)#", text)
    assert count_by_triplets(layout, 3, 5, 7).first().triangles == want


def test_estimates_do_not_shuffle_the_histogram_again(spark):
    text = final(registry.QUERIES["frequency_estimates"](spark, SF))
    assert text.count("FileScan") == 1
    shuffles = [x for x in text.splitlines() if "Exchange hashpartitioning(item" in x]
    assert len([x for x in shuffles if "ReusedExchange" not in x]) == 1
    assert "BroadcastHashJoin" in text


def test_no_task_has_all_of_the_top_k(spark):
    hist = spark.range(5_000).selectExpr("id as item", "id % 40 + 1 as f")
    frame = top_k(hist, 4_000)
    assert len(frame.collect()) == 4_000
    text = plan(frame)
    assert "TakeOrdered" not in text and "CollectLimit" not in text and "GlobalLimit" not in text
    assert re.search(r"Exchange rangepartitioning\(f#", text)
    # What one task orders are different frequencies and the digits of tied items.
    assert set(re.findall(r"Window \[.*\], \[(\w+)#\d+L? (?:ASC|DESC)", text)) <= {"f", "digit"}
    assert "HashAggregate(keys=[f#" in text and "HashAggregate(keys=[digit#" in text.replace("_groupingexpression", "digit")


def test_the_report_reads_its_source_once(spark):
    assert final(registry.QUERIES["stream_summary"](spark, SF)).count("FileScan") == 1


def test_prefix_batches_are_counted_once(spark):
    text = final(registry.QUERIES["stream_prefix"](spark, SF))
    assert text.count("FileScan") == 1
