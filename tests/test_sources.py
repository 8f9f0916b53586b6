import pytest
from pyspark.sql import functions as F

from triflux.functions.files import Folder
from triflux.functions.scratch import clear_scratch, keep_bucketed, keep_table, scratch_path
from triflux.sources.edges import edges_from, read_edge_text, read_edge_text_lenient
from triflux.sources.items import items_from, time_batch


def write(tmp_path, lines):
    path = tmp_path / "edges.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_strict_reads_extra_tokens_and_duplicates(spark, tmp_path):
    path = write(tmp_path, ["1,2", "2,3,9", " 3,1", "1,2"])
    edges = read_edge_text(spark, path, partitions=3)
    assert edges.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 2), (2, 3), (3, 1)]


def test_kept_edges_need_no_second_parse(spark, tmp_path):
    path = write(tmp_path, ["1,2", "2,3,9", " 3,1"])
    edges = read_edge_text(spark, path, keep=True)
    (tmp_path / "edges.txt").unlink()
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3), (3, 1)]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("bad", ["", "x,1", "7", "1,"])
def test_strict_fails_on_a_bad_line(spark, tmp_path, bad, ansi):
    path = write(tmp_path, ["1,2", bad, "2,3"])
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        strict_fails(spark, path)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def strict_fails(spark, path):
    with pytest.raises(Exception, match="not an (edge|integer)"):
        read_edge_text(spark, path).collect()


def test_lenient_sets_bad_lines_aside(spark, tmp_path):
    path = write(tmp_path, ["1,2", "", "2,3,9", " 3,1", "x,1"])
    text = read_edge_text_lenient(spark, path)
    edges, rejects = text.edges, text.rejects
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3), (3, 1)]
    assert sorted(r.value for r in rejects.collect()) == ["", "x,1"]


def test_edges_from_columns(spark):
    df = spark.createDataFrame([(1, "2", 0.5)], "a int, b string, c double")
    edges = edges_from(df, "a", "b")
    assert edges.dtypes == [("u", "bigint"), ("v", "bigint")]


def test_items_are_bigint_and_strict(spark):
    text = spark.createDataFrame([("4000000000",), ("-3",)], "value string")
    assert sorted(r.item for r in items_from(text, "value").collect()) == [-3, 4_000_000_000]
    with pytest.raises(Exception, match="not an (edge|integer)"):
        items_from(spark.createDataFrame([("4x",)], "value string"), "value").collect()


def test_time_batch(spark):
    df = spark.sql(
        "select explode(array(timestamp_ntz'1970-01-01 00:59:59.9',"
        " timestamp_ntz'1970-01-01 01:00:00')) ts"
    )
    assert [r[0] for r in df.select(time_batch("ts", 3600)).collect()] == [0, 1]
    assert df.select(time_batch("ts", 3600).alias("b")).schema["b"].dataType.typeName() == "long"
    assert df.select(F.count("ts")).first()[0] == 2


def test_lenient_reads_its_source_once(spark, tmp_path):
    path = write(tmp_path, ["1,2", "", "x,1", "2,3,9", " 3,1", "7", "1,"])
    text = read_edge_text_lenient(spark, path, partitions=2)
    (tmp_path / "edges.txt").unlink()
    assert (text.n_edges, text.n_rejects) == (3, 4)
    assert sorted(map(tuple, text.edges.collect())) == [(1, 2), (2, 3), (3, 1)]
    assert sorted(r.value for r in text.rejects.collect()) == ["", "1,", "7", "x,1"]
    (tmp_path / "none.txt").write_text("")
    none = read_edge_text_lenient(spark, str(tmp_path / "none.txt"))
    assert (none.n_edges, none.n_rejects, none.edges.count(), none.rejects.count()) == (0, 0, 0, 0)


def test_scratch_tables_can_be_removed(spark):
    frame = spark.range(10).selectExpr("id as u", "id + 1 as v")
    kept, bucketed = keep_table(frame, "kept"), keep_bucketed(frame, "bucketed", "u")
    paths = [Folder(spark, x.inputFiles()[0].rpartition("/")[0]) for x in (kept, bucketed)]
    assert bucketed.count() == 10 and all(x.names() for x in paths)
    clear_scratch(spark)
    assert not any(x.names() for x in paths)
    assert scratch_path(spark, "x").startswith("file:/")


def test_small_files_are_whole_or_not_there(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.names() == []
    folder.write("b", "zwei\nä")
    folder.write("a", "")
    assert folder.names() == ["a", "b"] and folder.read("b") == "zwei\nä" and folder.read("a") == ""
    folder.remove("a")
    folder.remove("none")
    assert folder.names() == ["b"]
