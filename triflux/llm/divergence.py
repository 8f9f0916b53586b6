"""How far the sources of a language diverge in the terms that they use.

Each source has a smoothed share of every term that its language keeps, and two
sources differ by the sum of the absolute differences of their shares. All pairs
are computed over a cube: groups (sources of a language) are cut into blocks of
about ``GROUPS``, terms into blocks of about ``TERMS``, both by hash. A slice holds
the shares of one block of groups for one block of terms. Every slice is copied to
the cells (group block, group block, term block) that it takes part in; a cell holds
two slices, whatever the corpus, and computes the partial divergences of its pairs.
Sums along the term axis make the results.

Shares are integers, parts of 10^9 rounded down, so all sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.scratch import keep_table

LEAST_DOCS = 30
PRIOR = 5
UNIT = 1_000_000_000
TOP = 50
GROUPS, TERMS = 64, 4096
#: Partial counts that a task holds.
KEPT = 300_000

COUNTS = "lang string, source string, term string, n long, docs long"
SLICES = (
    "lang string, gb int, tb int, sources array<string>, base binary, at binary, "
    "term binary, p binary, width int"
)
PARTIALS = "lang string, a string, b string, value long"

#: Bytes of terms, A to Z as a to z; all others become spaces.
_FOLDED = bytes(
    b if b > 0x7F or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII, unchanged."""
    return text.encode().translate(_FOLDED).split(b" ")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial ``COUNTS`` of ``lang, source, text``; a term counts once in a document's ``docs``."""
    # Occurrences above, documents below 2^32.
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        flat = [(*g, t, x >> 32, x & 0xFFFFFFFF) for g, own in held.items() for t, x in own.items()]
        columns = zip(*flat, strict=True)
        types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in COUNTS.split(", ")])

    for batch in batches:
        for lang, source, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            own = held.setdefault((lang, source), {})
            size -= len(own)
            seen: dict[bytes, int] = {}
            for term in terms(text):
                seen[term] = seen.get(term, 0) + 1
            seen.pop(b"", None)
            for term, n in seen.items():
                own[term] = own.get(term, 0) + (n << 32 | 1)
            size += len(own)
            if size > KEPT:
                yield rows()
                held, size = {}, 0
    if size:
        yield rows()


def _share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept))``, exact; NULL where nothing is kept."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    below = F.nullif(total + kept * PRIOR, F.lit(0).cast("bigint")).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", above, below)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, first`` of the terms in ``least_docs`` documents of a language.

    ``lang_n`` are the occurrences in the language, and one row of each term there is ``first``.
    """
    found = docs.mapInArrow(_count, COUNTS)
    # One shuffle: by term, so that a language or a source that is common is spread.
    summed = (
        found.repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    same = Window.partitionBy("lang", "term")
    return (
        summed.withColumn("lang_docs", F.sum("docs").over(same))
        .where(F.col("lang_docs") >= least_docs)
        .select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("n").over(same).alias("lang_n"),
            (F.row_number().over(same.orderBy("source")) == 1).alias("first"),
        )
    )


def _group_sizes(docs: DataFrame, kept: DataFrame, groups: int, terms: int) -> DataFrame:
    """Per group ``lang, source, total``, and of its language ``lang_total, vocabulary, gbs, tbs``."""
    zero = F.lit(0).cast("bigint")
    every = docs.select("lang", "source", zero.alias("n"), zero.alias("new"))
    found = kept.select("lang", "source", "n", F.col("first").cast("bigint").alias("new"))
    totals = (
        every.unionByName(found)
        .groupBy("lang", "source")
        .agg(F.sum("n").alias("total"), F.sum("new").alias("new"))
    )
    langs = totals.groupBy("lang").agg(
        F.sum("total").alias("lang_total"),
        F.sum("new").alias("vocabulary"),
        F.ceil(F.count(F.lit(1)) / groups).cast("int").alias("gbs"),
        F.greatest(F.lit(1), F.ceil(F.sum("new") / terms)).cast("int").alias("tbs"),
    )
    return totals.select("lang", "source", "total").join(langs, "lang")


def _pack(table: pa.Table) -> pa.Table:
    """One slice: its groups in order, and for each entry the group's place, the term and the share."""
    table = table.sort_by([("source", "ascending"), ("t", "ascending")])
    t = table["t"].to_numpy()
    groups = table.filter(pa.array(t < 0))
    sources = groups["source"].to_pylist()
    place = {x: i for i, x in enumerate(sources)}
    rest = table.filter(pa.array(t >= 0))
    at = np.array([place[x] for x in rest["source"].to_pylist()], np.int32)
    return pa.table(
        {
            "lang": pa.array([table["lang"][0].as_py()]),
            "gb": pa.array([table["gb"][0].as_py()], pa.int32()),
            "tb": pa.array([table["tb"][0].as_py()], pa.int32()),
            "sources": pa.array([sources], pa.list_(pa.string())),
            "base": pa.array([groups["p"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "at": pa.array([at.tobytes()], pa.binary()),
            "term": pa.array([rest["t"].to_numpy().astype(np.int32).tobytes()], pa.binary()),
            "p": pa.array([rest["p"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "width": pa.array([groups["width"][0].as_py()], pa.int32()),
        }
    )


def slices(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """A table of the slices: every block of groups for every block of terms of its language.

    Groups without terms are in them, too, and a language without terms has one block of none.
    """
    gb = F.pmod(F.xxhash64("source"), "gbs").cast("int").alias("gb")
    placed = kept.join(sizes, ["lang", "source"]).select(
        "lang",
        gb,
        F.pmod(F.xxhash64("term"), "tbs").cast("int").alias("tb"),
        "source",
        "term",
        _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
    )
    block = Window.partitionBy("lang", "tb").orderBy("term")
    entries = placed.withColumn("t", F.dense_rank().over(block) - 1).drop("term")
    widths = (
        kept.where("first")
        .join(sizes.select("lang", "tbs").distinct(), "lang")
        .groupBy("lang", F.pmod(F.xxhash64("term"), "tbs").cast("int").alias("tb"))
        .agg(F.count(F.lit(1)).cast("int").alias("width"))
    )
    zero = F.lit(0).cast("bigint")
    bases = (
        sizes.select(
            "lang",
            gb,
            "source",
            F.coalesce(_share(zero, F.col("total"), F.col("vocabulary")), zero).alias("p"),
            F.explode(F.sequence(F.lit(0), F.col("tbs") - 1)).alias("tb"),
        )
        .join(widths, ["lang", "tb"], "left")
        .select("lang", "gb", "tb", "source", "p", F.lit(-1).alias("t"), F.coalesce("width", F.lit(0)).alias("width"))
    )
    rows = bases.unionByName(entries.withColumn("width", F.lit(0)))
    return keep_table(rows.groupBy("lang", "gb", "tb").applyInArrow(_pack, SLICES), "slices")


def _dense(row: dict) -> np.ndarray:
    base = np.frombuffer(row["base"], np.int64)
    out = np.repeat(base[:, None], row["width"], axis=1)
    at, term = np.frombuffer(row["at"], np.int32), np.frombuffer(row["term"], np.int32)
    out[at, term] = np.frombuffer(row["p"], np.int64)
    return out


def _cell(table: pa.Table) -> pa.Table:
    """The partial divergences of the pairs of one cell, each pair once."""
    rows = sorted(table.to_pylist(), key=lambda r: r["gb"])
    one, other = rows[0], rows[-1]
    same = one["low"] == one["high"]
    left, right = _dense(one), _dense(other)
    found = []
    # Hashing may leave a block of groups empty; its cells have one slice and no pairs.
    for i, source in enumerate(one["sources"] if same or len(rows) == 2 else []):
        first = i + 1 if same else 0
        values = np.abs(right[first:] - left[i]).sum(axis=1).tolist()
        found += [(one["lang"], source, x, v) for x, v in zip(other["sources"][first:], values, strict=True)]
    columns = list(zip(*found, strict=True)) or [[]] * 4
    kinds = [pa.string()] * 3 + [pa.int64()]
    names = [x.split()[0] for x in PARTIALS.split(", ")]
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


def pair_divergences(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of all pairs of sources of a language, each pair once."""
    blocks = sizes.select("lang", "gbs").distinct()
    other = F.explode(F.sequence(F.lit(0), F.col("gbs") - 1))
    copied = parts.join(blocks, "lang").select(parts.columns + [other.alias("j")])
    cells = copied.select(
        "*", F.least("gb", "j").alias("low"), F.greatest("gb", "j").alias("high")
    ).drop("j", "gbs")
    partial = cells.groupBy("lang", "low", "high", "tb").applyInArrow(_cell, PARTIALS)
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    groups: int = GROUPS,
    terms: int = TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for ``docs (text, lang, source)``.

    Part ``pair`` ranks all other sources of the language by their divergence from
    ``source``; part ``term`` the ``top`` terms that stand out there most against the
    language as a whole. Values fall, ties go by the item's bytes, ranks begin at 1.

    Null texts, languages and sources count as empty strings. Repeated rows are
    documents of their own. A group without kept terms has the same share of each
    term; where a language keeps none all its divergences are 0 and no term stands
    out. Other columns are ignored, and an empty table gives an empty result.
    """
    clean = docs.select(
        *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")]
    )
    kept = keep_table(kept_terms(clean, least_docs), "terms")
    sizes = keep_table(_group_sizes(clean.select("lang", "source"), kept, groups, terms), "groups")
    values = pair_divergences(slices(kept, sizes), sizes)
    ways = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]
    pairs = values.select("lang", "value", F.inline(F.array(*ways)))

    p = _share(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    over = kept.join(sizes, ["lang", "source"]).select(
        "lang", (p - q).alias("value"), "source", F.col("term").alias("item")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value",
            F.row_number().over(order).alias("rank"),
        )

    standing = ranked(over.where("value > 0"), "term").where(F.col("rank") <= top)
    return ranked(pairs, "pair").unionByName(standing)


SQL = rf"""
with d as (
  select row_number() over () r, coalesce(text, '') text, coalesce(lang, '') lang,
         coalesce(source, '') source
  from documents),
x as (
  select r, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term
  from d),
k as (
  select lang, term, count(*) lang_n from x group by all having count(distinct r) >= {LEAST_DOCS}),
c as (select lang, source, term, count(*) n from x semi join k using (lang, term) group by all),
g as (select distinct lang, source from d),
s as (
  select g.lang, g.source, k.term, lang_n, coalesce(n, 0) n
  from g join k using (lang) left join c using (lang, source, term)),
p as (
  select lang, source, term, n,
         1 + {UNIT}::hugeint * (n + {PRIOR}) // (sum(n) over w + {PRIOR} * count(*) over w) p,
         1 + {UNIT}::hugeint * (lang_n + {PRIOR})
           // (sum(lang_n) over w + {PRIOR} * count(*) over w) q
  from s window w as (partition by lang, source)),
v as (
  select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all),
f as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0) value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join v on v.lang = a.lang and v.source = a.source and v.item = b.source
  union all
  select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) value,
       cast(row_number() over (partition by lang, source, part
         order by value desc, encode(item)) as int) rank
from f qualify part = 'pair' or rank <= {TOP}
"""
