"""The same queries as plain SQL, for a side-by-side check on whole tables."""

from __future__ import annotations

from triflux.functions.hashing import PRIME
from triflux.plans.registry import (
    BATCH_SECONDS,
    COLOUR_A,
    COLOUR_B,
    COLOURS,
    K,
    LARGE_K,
    LEFT,
    PART_A,
    PART_A2,
    PART_B,
    PARTS,
    PREFIX_ITEMS,
    RIGHT,
    RUNS,
    SKETCH_ROWS,
    SPAN_SECONDS,
    TEXT_PARTITIONS,
    USERS_RIGHT,
    WIDE,
    WIDE_PRIME,
    WIDTH,
)


def _colour(x: str, a: int | str = COLOUR_A, b: int | str = COLOUR_B) -> str:
    return f"((({a} * {x} + {b}) % {PRIME}) % {COLOURS})"


def _median(values: str) -> str:
    a = f"list_sort({values})"
    return (
        f"case when len({a}) % 2 = 0 then ({a}[len({a}) // 2] + {a}[len({a}) // 2 + 1]) // 2 "
        f"else {a}[len({a}) // 2 + 1] end"
    )


def _numbered(rows: tuple[tuple[int, ...], ...]) -> str:
    return ", ".join(f"({i}, {', '.join(map(str, row))})" for i, row in enumerate(rows))


EDGES = """e as (
  select distinct least(l_partkey, l_suppkey) u, greatest(l_partkey, l_suppkey) v
  from lineitem where l_partkey <> l_suppkey)"""

TRIANGLES = """t as (
  select a.u, a.v, b.v w from e a
  join e b on a.v = b.u
  join e c on c.u = a.u and c.v = b.v)"""

COLOUR_RUNS = f"""
with {EDGES},
runs(run, a, b) as (values {_numbered(RUNS)}),
m as (select run, u, v from e, runs where {_colour('u', 'a', 'b')} = {_colour('v', 'a', 'b')}),
n as (
  select x.run, count(*) n from m x
  join m y on x.run = y.run and x.v = y.u
  join m z on x.run = z.run and z.u = x.u and z.v = y.v
  group by 1),
est as (
  select run, {COLOURS * COLOURS} * coalesce(n, 0) estimate from runs left join n using (run))"""

PARTKEYS = "items as (select l_partkey item from lineitem)"
USERS = "items as (select user_id item from events)"


def _sketched(
    items: str, right: int = RIGHT, width: int = WIDTH, p: int = PRIME
) -> str:
    return f"""
with {items},
coef(r, ah, bh, ag, bg) as (values {_numbered(SKETCH_ROWS)}),
h as (select item, count(*) f from items where item between {LEFT} and {right} group by 1),
z as (
  select r, item, f, ((ah * item + bh) % {p}) % {width} c,
         case when ((ag * item + bg) % {p}) % 2 = 1 then 1 else -1 end g
  from h, coef),
sk as (select r, c, cast(sum(f * g) as bigint) cell from z group by 1, 2),
est as (
  select item, f, {_median('list(cell * g)')} fhat from z join sk using (r, c) group by 1, 2),
kf as (select min(f) kf from (select f from h order by f desc limit {K})),
err as (select avg(abs(f - fhat) / f) avg_err from est, kf where f >= kf),
s2 as (select r, cast(coalesce(sum(cell * cell), 0) as bigint) s from coef left join sk using (r)
       group by 1),
f2 as (
  select cast(sum(f) as bigint) n_in_range, count(*) n_distinct,
         cast(sum(f * f) as double) / (cast(sum(f) as double) * cast(sum(f) as double)) f2
  from h),
f2e as (
  select cast({_median('list(s)')} as double)
         / (select cast(n_in_range as double) * cast(n_in_range as double) from f2) f2_est
  from s2)"""


def _batches() -> str:
    return f"""
with items as (
  select user_id item,
         cast(floor(epoch(date_trunc('second', ts)) / {BATCH_SECONDS}) as bigint) batch
  from events),
totals as (select batch, count(*) n from items group by 1),
running as (
  select batch, n, cast(coalesce(sum(n) over (
    order by batch rows between unbounded preceding and 1 preceding), 0) as bigint) prior
  from totals),
kept as (select * from running where prior < {PREFIX_ITEMS})"""


# Spans count from the first one; what has no time comes after the last.
SPANS = f"""spans as (
  select user_id item,
         coalesce(cast(floor(epoch(date_trunc('second', ts)) / {SPAN_SECONDS}) as bigint),
           (select max(cast(floor(epoch(date_trunc('second', ts)) / {SPAN_SECONDS}) as bigint)) + 1
            from events)) b
  from events),
span_totals as (select b - min(b) over () batch, n from (select b, count(*) n from spans group by 1)),
span_running as (
  select batch, n, cast(coalesce(sum(n) over (
    order by batch rows between unbounded preceding and 1 preceding), 0) as bigint) prior
  from span_totals),
span_kept as (select * from span_running where prior < {PREFIX_ITEMS})"""

PREFIX_USERS = f"""{SPANS},
items as (
  select item from spans
  where b - (select min(b) from spans) <= (select max(batch) from span_kept))"""

SUMMARY = """ select (select count(*) from items) n_total, n_in_range, n_distinct,
  round(avg_err, 6) avg_err, round(f2, 9) f2, round(f2_est, 9) f2_est from f2, err, f2e"""

CELLS = " select r, c, cell from sk"
HISTOGRAM = " select item, f from h"

ORACLES: dict[str, str] = {
    "edge_counts": f"with {EDGES} select (select count(*) from lineitem) raw_edges, "
    "(select count(*) from e) edges",
    "canonical_edges": f"with {EDGES} select u, v from e",
    "edges_through_text": f"with {EDGES} select u, v from e",
    "edges_lenient": "select l_partkey u, l_suppkey v from lineitem where l_linenumber < 5",
    "edge_rejects": """
select case l_linenumber when 7 then l_partkey || ';' || l_suppkey
       when 6 then l_partkey || ',' || l_returnflag else '' end as value
from lineitem where l_linenumber >= 5""",
    "edge_line_counts": """
select count(*) filter (l_linenumber < 5) n_edges, count(*) filter (l_linenumber >= 5) n_rejects
from lineitem""",
    "edge_partitions": f"select cast({TEXT_PARTITIONS} as bigint) partitions, count(*) edges from lineitem",
    "monochromatic_edges": f"with {EDGES} select {_colour('u')} colour, u, v from e "
    f"where {_colour('u')} = {_colour('v')}",
    "triangles_exact": f"with {EDGES}, {TRIANGLES} select count(*) triangles from t",
    "triangles_by_method": f"""
with {EDGES}, {TRIANGLES}
select unnest(['exact', 'exact_triplet', 'colour', 'partition']) as method, n triangles
from (select count(*) n from t)""",
    "triangles_list": f"with {EDGES}, {TRIANGLES} select u, v, w from t",
    "triangles_per_colour": f"""
with {EDGES}, {TRIANGLES},
n as (
  select {_colour('u')} colour, count(*) n from t
  where {_colour('u')} = {_colour('v')} and {_colour('v')} = {_colour('w')} group by 1)
select colour, coalesce(n, 0) triangles
from (select unnest(range({COLOURS})) colour) left join n using (colour)""",
    "triangles_colour_runs": f"{COLOUR_RUNS} select run, estimate from est",
    "triangles_runs_laid_out": f"{COLOUR_RUNS} select run, estimate from est",
    "triangles_exact_laid_out": f"with {EDGES}, {TRIANGLES} select count(*) triangles from t",
    "triangles_colour_median": f"{COLOUR_RUNS} "
    f"select {_median('list(estimate)')} estimate from est",
    "triangles_partition": f"""
with {EDGES},
k as (
  select u, v, (({PART_A} * u + {PART_A2} * v + {PART_B}) % {PRIME}) % {PARTS} part from e)
select {PARTS * PARTS} * count(*) estimate from k a
join k b on a.part = b.part and a.v = b.u
join k c on a.part = c.part and c.u = a.u and c.v = b.v""",
    "edge_triplet_keys": f"""
with {EDGES},
k as (
  select u, v, list_sort([{_colour('u')}, {_colour('v')}, i]) k
  from e, (select unnest(range({COLOURS})) i))
select k[1] k0, k[2] k1, k[3] k2, u, v from k""",
    "triangles_per_triplet": f"""
with {EDGES}, {TRIANGLES},
k as (select list_sort([{_colour('u')}, {_colour('v')}, {_colour('w')}]) k from t)
select k[1] k0, k[2] k1, k[3] k2, count(*) triangles from k group by all""",
    "triangles_triplet": f"with {EDGES}, {TRIANGLES} select count(*) triangles from t",
    "stream_prefix": f"{_batches()} select batch, n, prior from kept",
    "prefix_histogram": f"{_batches()} select item, count(*) f from items join kept using (batch) "
    f"where item between {LEFT} and {RIGHT} group by 1",
    "stream_prefix_batches": f"with {SPANS} select batch, n, prior from span_kept",
    "stream_report_prefix": _sketched(PREFIX_USERS, USERS_RIGHT) + SUMMARY,
    "stream_top_k": _sketched(PREFIX_USERS, USERS_RIGHT)
    + f" select item, f, fhat from est order by f desc, item limit {K}",
    "item_histogram_running": _sketched(USERS, USERS_RIGHT) + HISTOGRAM,
    "item_histogram_state": _sketched(USERS, USERS_RIGHT) + HISTOGRAM,
    "item_counts": f"with {PARTKEYS} "
    f"select case when item between {LEFT} and {RIGHT} then item end item, count(*) n "
    "from items group by 1",
    "item_histogram": _sketched(PARTKEYS) + HISTOGRAM,
    "items_by_frequency": _sketched(PARTKEYS) + HISTOGRAM + " order by f desc, item",
    "item_histogram_stream": _sketched(USERS) + HISTOGRAM,
    "count_sketch": _sketched(PARTKEYS) + CELLS,
    "count_sketch_of_histogram": _sketched(PARTKEYS) + CELLS,
    "count_sketch_merged": _sketched(PARTKEYS) + CELLS,
    "count_sketch_stream": _sketched(USERS) + CELLS,
    "count_sketch_running": _sketched(USERS) + CELLS,
    "frequency_estimates": _sketched(PARTKEYS) + " select item, f, fhat from est",
    "frequency_estimates_wide": _sketched(PARTKEYS, width=WIDE, p=WIDE_PRIME)
    + " select item, f, fhat from est",
    "top_k": _sketched(PARTKEYS)
    + f" select item, f, fhat from est order by f desc, item limit {K}",
    "top_k_large": _sketched(PARTKEYS) + f" select item, f from h order by f desc, item limit {LARGE_K}",
    "kth_frequency": _sketched(PARTKEYS) + " select kf from kf",
    "top_k_error": _sketched(PARTKEYS) + " select round(avg_err, 6) avg_err from err",
    "second_moment": _sketched(PARTKEYS)
    + " select n_in_range, n_distinct, round(f2, 9) f2 from f2",
    "second_moment_estimate": _sketched(PARTKEYS) + " select round(f2_est, 9) f2_est from f2e",
    "stream_summary": _sketched(PARTKEYS) + SUMMARY,
    "stream_summary_stream": _sketched(USERS) + SUMMARY,
}
