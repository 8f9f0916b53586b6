"""Documents repeated so that sources reach target weights.

The sizes of the sources are summed, targets are filled like water levels, and
each document is emitted ``floor(rate)`` times plus once more when a number
hashed from it lies below the fraction of the rate. A rate is its source's
target over its source's size, at most ``cap``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.scratch import keep_table
from triflux.llm.names import fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 7

#: Words are runs of anything but these.
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def n_words(text: str = "text") -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source ``source, source_size, target`` from ``sizes (source, size)``.

    Sources weigh ``WEIGHTS``, repeating, in code-point order with null last, and
    share ``SHARE`` of all sizes. A target stops at ``CAP`` times its source's
    size; what is over is shared by weight among the others until none is above.
    In the end the others all have their weight times one level, so sources stop
    in the order of size by weight, and running sums tell how many do: a source
    stops if at the level that its own stop would give, the sources before it
    stopped, all fits into the share. One row per source is windowed.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(x) for x in WEIGHTS])
    weighed = rows.withColumn("weight", F.element_at(weights, (number % len(WEIGHTS) + 1)))
    stop = F.col("source_size") * CAP
    order = Window.orderBy(
        (F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    summed = weighed.select(
        "source",
        "source_size",
        "weight",
        F.sum(stop).over(so_far).alias("stopped"),
        F.sum("weight").over(so_far).alias("stopped_weight"),
        (F.sum("source_size").over(everything) * F.lit(SHARE)).alias("share"),
        F.sum("weight").over(everything).alias("weights"),
    )
    stops = (
        F.col("stopped") * F.col("weight")
        + stop * (F.col("weights") - F.col("stopped_weight"))
        <= F.col("share") * F.col("weight")
    )
    marked = summed.withColumn("stops", stops)
    level = (
        F.max("share").over(everything)
        - F.coalesce(F.max(F.when(F.col("stops"), F.col("stopped"))).over(everything), F.lit(0))
    ) / (
        F.max("weights").over(everything)
        - F.coalesce(
            F.max(F.when(F.col("stops"), F.col("stopped_weight"))).over(everything), F.lit(0)
        )
    )
    target = F.when(F.col("stops"), stop.cast("double")).otherwise(level * F.col("weight"))
    # The denominator is 0 only where every source stops.
    return marked.select("source", "source_size", target.alias("target"))


def chance(seed: int = SEED) -> Column:
    """A number from 0 to below 1, hashed from the seed and a document's id and text."""
    key = F.concat_ws(
        ":",
        F.lit(str(seed)),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.md5(F.coalesce(F.col("text"), F.lit(""))),
    )
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def copies(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies`` in a struct, the last column.

    That is ``_mix``, or a longer name where there is such a column. ``docs`` needs ``doc_id, text, source`` and keeps all its columns. Null texts
    and texts without words have size 0. A source of size 0 has target 0 and its
    documents no copies. Equal rows draw the same number. No random state: runs
    agree. Words are counted once, before sums and copies both use them.
    """
    size = fresh("_size", docs.columns)
    sized = docs.withColumn(size, n_words())
    targets = source_targets(sized.select("source", F.col(size).alias("size")))
    # Spark broadcasts the table if it is small enough, else splits a hot source's partition.
    table = keep_table(targets, "targets")
    t = table.alias("t")
    joined = sized.alias("d").join(t, F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size"))
    rate = F.coalesce(F.least(rate, F.lit(float(CAP))), F.lit(0.0))
    whole = F.floor(rate)
    n = (whole + F.when(chance(seed) < rate - whole, 1).otherwise(0)).cast("int")
    mix = F.struct(
        F.col(size).alias("size"),
        F.col("t.source_size").alias("source_size"),
        F.col("t.target").alias("target"),
        n.alias("copies"),
    )
    own = [F.col(f"d.{_quoted(c)}") for c in docs.columns]
    return joined.select(*own, mix.alias(fresh("_mix", docs.columns)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, each as often as it is taken."""
    rows = copies(docs, seed)
    own = [F.col(_quoted(c)) for c in docs.columns]
    times = F.col(_quoted(rows.columns[-1])).getField("copies")
    return rows.select(*own, F.explode(F.array_repeat(F.lit(0), times))).select(*own)


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``."""
    rows = copies(docs.select("doc_id", "text", "source"), seed)
    return rows.select(
        "doc_id",
        "_mix.size",
        "_mix.source_size",
        "_mix.target",
        (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"),
    )


SQL = f"""
with d as (
  select doc_id, source, text,
         cast(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) as bigint) size
  from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by 1),
w as (
  select *, ([{', '.join(map(str, WEIGHTS))}])[
    (row_number() over (order by source asc nulls last) - 1) % {len(WEIGHTS)} + 1] weight
  from s),
a as (
  select *, sum({CAP} * source_size) over o stopped, sum(weight) over o stopped_weight,
         cast(sum(source_size) over () as double) * {SHARE} share, sum(weight) over () weights
  from w
  window o as (order by source_size / weight, source asc nulls last
               rows between unbounded preceding and current row)),
m as (
  select *, stopped * weight + {CAP} * source_size * (weights - stopped_weight)
            <= share * weight stops
  from a),
l as (
  select (max(share) - cast(coalesce(max(stopped) filter (stops), 0) as double))
         / nullif(cast(max(weights) - coalesce(max(stopped_weight) filter (stops), 0) as double), 0) level
  from m),
t as (
  select source, source_size,
         case when stops then cast({CAP} * source_size as double) else level * weight end target
  from m, l),
r as (
  select doc_id, size, source_size, target,
         least(target / nullif(source_size, 0), {float(CAP)}) rate,
         cast('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(cast(doc_id as varchar), 'null'),
           md5(coalesce(text, '')))), 1, 12) as bigint) / {float(16**12)} chance
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       size * cast(floor(coalesce(rate, 0))
         + case when chance < rate - floor(rate) then 1 else 0 end as bigint) taken
from r
"""
