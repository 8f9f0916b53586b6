"""Edge lists from text lines ``u,v`` or from any table with two id columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from triflux.functions.checks import checked
from triflux.functions.scratch import keep_table, scratch_path


def _tokens(spark: SparkSession, path: str, partitions: int | None) -> DataFrame:
    lines = spark.read.text(path)
    if partitions is not None:
        lines = lines.repartition(partitions)
    return lines.select("value", F.split("value", ",").alias("t"))


def read_edge_text(
    spark: SparkSession,
    path: str,
    partitions: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Edges ``(u, v)`` from text lines; tokens after the second are ignored.

    Any other line (blank, one token, not an integer) fails the job. Use
    :func:`read_edge_text_lenient` to set such lines aside instead.
    ``partitions`` fixes the partition count; by default Spark chooses it.
    ``keep`` parses the text now, into a table that several runs can share.
    """
    t = F.col("t")
    said = F.concat(F.lit("not an edge: "), F.col("value"))
    edges = _tokens(spark, path, partitions).select(
        *[
            checked(F.try_element_at(t, F.lit(i)).try_cast("bigint"), said).alias(name)
            for i, name in ((1, "u"), (2, "v"))
        ]
    )
    return keep_table(edges, "edges") if keep else edges


@dataclass(frozen=True)
class EdgeText:
    """What a text was sorted into: ``edges (u, v)``, ``rejects (value)``, and their numbers."""

    edges: DataFrame
    rejects: DataFrame
    n_edges: int
    n_rejects: int


def read_edge_text_lenient(
    spark: SparkSession, path: str, partitions: int | None = None
) -> EdgeText:
    """Reads the text once and sets aside the lines that are not an edge.

    One job parses, counts and writes both kinds; the results read what it wrote.
    """
    t = F.col("t")
    u, v = (F.try_element_at(t, F.lit(i)).try_cast("bigint") for i in (1, 2))
    parsed = _tokens(spark, path, partitions).select(
        u.alias("u"), v.alias("v"), "value", (u.isNotNull() & v.isNotNull()).alias("good")
    )
    line = F.when(~F.col("good"), F.col("value")).alias("value")
    seen = Observation()
    counted = parsed.observe(
        seen,
        F.count_if("good").alias("n_edges"),
        F.count_if(~F.col("good")).alias("n_rejects"),
    )
    written = scratch_path(spark, "edge-text")
    counted.select("u", "v", line, "good").write.partitionBy("good").parquet(written)
    rows = spark.read.schema("u bigint, v bigint, value string, good boolean").parquet(written)
    return EdgeText(
        rows.where("good").select("u", "v"),
        rows.where("not good").select("value"),
        seen.get["n_edges"],
        seen.get["n_rejects"],
    )


def edges_from(table: DataFrame, u: str, v: str) -> DataFrame:
    """Two integer columns of a table read as the end points of undirected edges."""
    return table.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v"))
