"""Hard negatives by exact scores of all rows, the scores by the Four Russians' method.

An anchor's components are taken eight at a time, and the sums of all 256 subsets
of the eight make a table. A candidate's components are written as bit planes in
two's complement, so that one byte says which of eight components have a given bit.
That byte is the row of the table to read: a plane's sum is one look-up per eight
components, and the planes are shifted and added from the top one, which counts
negative, down to the last. The scores are exact.

Anchors are dealt to blocks, all rows to shards, evenly however alike they are. A
cell holds one block and one shard. The first round finds each anchor's positives,
which gives each pair of anchor and positive an interval of scores; the second finds
the negatives in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.scratch import keep_table

EVERY, SHIFTED, LABELS = 50, 7, 10
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Anchors of a block, rows of a shard, and rows scored at once.
BLOCK, SHARD, CHUNK = 512, 4096, 512
#: Components beyond this could give scores beyond 64 bits (with up to 2048 of them).
LARGEST = 2.0**26

SHARDS = "dim int, shard int, bits int, ids binary, labels binary, planes binary"
BLOCKS = "dim int, block int, ids binary, labels binary, vectors binary"
FOUND = "dim int, block int, at int, nth int, vec_id long, score long"
_LOWEST = np.iinfo(np.int64).min


def labelled_vectors(frame: DataFrame) -> DataFrame:
    """``vec_id, label, v, dim``: components times ``SCALE``, rounded down, and shifted labels.

    Rows take no part whose id, label or vector is null, or a component null or not
    finite; a finite component beyond ``LARGEST`` / ``SCALE`` is an error.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    vector = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull()
    rows = frame.where(whole & F.coalesce(F.forall(vector, finite), F.lit(False)))
    small = lambda x: F.abs(x.cast("double")) < F.lit(LARGEST / SCALE)
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    said = F.raise_error(F.lit("a component is too large for exact scores")).cast("array<long>")
    label = F.col("label").cast("long")
    return rows.select(
        "vec_id",
        F.when(F.col("vec_id") % SHIFTED == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.when(F.forall(vector, small), scaled).otherwise(said).alias("v"),
        F.size(vector).alias("dim"),
    )


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dim)


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """Bytes ``[plane, eight components, row]`` of integers; the last plane is the sign's."""
    n, dim = vectors.shape
    widest = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)) - 1)
    padded = np.zeros((n, -(-dim // 8) * 8), np.int64)
    padded[:, :dim] = vectors
    planes = [
        np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").T
        for b in range(widest.bit_length() + 1)
    ]
    return np.stack(planes)


def subset_sums(vectors: np.ndarray) -> np.ndarray:
    """Per eight components a table ``[byte, vector]`` of the sums over the byte's set bits."""
    n, dim = vectors.shape
    tables = np.zeros((-(-dim // 8), 256, n), np.int32)
    for d in range(dim):
        table, bit = tables[d // 8], 1 << d % 8
        table[bit : 2 * bit] = table[:bit] + vectors[:, d].astype(np.int32)
    return tables


def inner_products(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Exact scores ``[row, vector]`` from bit planes and tables of subset sums."""
    rows, vectors = planes.shape[2], tables.shape[2]
    out = np.zeros((rows, vectors), np.int64)
    if not vectors:
        return out
    # What one plane adds up to, at most.
    most = sum(int(np.abs(t, dtype=np.int64).max()) for t in tables)
    kind = np.int32 if most < 2**31 else np.int64
    for low in range(0, rows, CHUNK):
        part = planes[:, :, low : low + CHUNK]
        total = out[low : low + CHUNK]
        looked = np.empty(total.shape, np.int32)
        plane = np.empty(total.shape, kind)
        for b in range(len(part) - 1, -1, -1):
            plane[:] = 0
            for table, index in zip(tables, part[b], strict=True):
                np.take(table, index, axis=0, out=looked, mode="clip")
                plane += looked
            total <<= 1
            if b == len(part) - 1:
                total -= plane
            else:
                total += plane
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(columns, rows)`` of the k greatest allowed scores of each column, ties to smaller rows."""
    held = np.where(allowed, scores, _LOWEST).T
    if held.shape[1] > k:
        kth = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        columns, rows = np.nonzero((held >= kth[:, None]) & allowed.T)
    else:
        columns, rows = np.nonzero(allowed.T)
    order = np.lexsort((rows, -held[columns, rows], columns))
    columns, rows = columns[order], rows[order]
    place = np.arange(len(columns)) - np.searchsorted(columns, columns)
    return columns[place < k], rows[place < k]


def _pack_shard(table: pa.Table) -> pa.Table:
    table = table.sort_by([("vec_id", "ascending")])
    dim = table["dim"][0].as_py()
    planes = bit_planes(_matrix(table, dim))
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "bits": pa.array([len(planes)], pa.int32()),
            "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()),
            "labels": pa.array([table["label"].to_numpy().tobytes()], pa.binary()),
            "planes": pa.array([planes.tobytes()], pa.binary()),
        }
    )


def _pack_block(table: pa.Table) -> pa.Table:
    table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    dim = table["dim"][0].as_py()
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "block": pa.array([table["block"][0].as_py()], pa.int32()),
            "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()),
            "labels": pa.array([table["label"].to_numpy().tobytes()], pa.binary()),
            "vectors": pa.array([_matrix(table, dim).tobytes()], pa.binary()),
        }
    )


class _Cell:
    """One block of anchors and one shard of candidates."""

    def __init__(self, block: pa.Table, shard: pa.Table) -> None:
        own, rows = block.to_pylist()[0], shard.to_pylist()[0]
        self.dim, self.block = own["dim"], own["block"]
        self.anchors = np.frombuffer(own["ids"], np.int64)
        self.anchor_labels = np.frombuffer(own["labels"], np.int64)
        vectors = np.frombuffer(own["vectors"], np.int64).reshape(len(self.anchors), self.dim)
        self.tables = subset_sums(vectors)
        self.ids = np.frombuffer(rows["ids"], np.int64)
        self.labels = np.frombuffer(rows["labels"], np.int64)
        planes = np.frombuffer(rows["planes"], np.uint8)
        self.planes = planes.reshape(rows["bits"], -1, len(self.ids))
        self.wanted = own.get("wanted") or []

    def found(self, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        """Rows of ``FOUND`` from ``(nth, anchors, rows, scores)``."""
        n = sum(len(at) for _, at, _, _ in parts)
        empty = np.empty(0, np.int64)
        nth = np.concatenate([empty, *[np.full(len(at), k) for k, at, _, _ in parts]])
        at = np.concatenate([empty, *[x for _, x, _, _ in parts]])
        ids = np.concatenate([empty, *[self.ids[x] for _, _, x, _ in parts]])
        scores = np.concatenate([empty, *[x for _, _, _, x in parts]])
        return pa.table(
            {
                "dim": pa.array(np.full(n, self.dim, np.int32)),
                "block": pa.array(np.full(n, self.block, np.int32)),
                "at": pa.array(at.astype(np.int32)),
                "nth": pa.array(nth.astype(np.int32)),
                "vec_id": pa.array(ids.astype(np.int64)),
                "score": pa.array(scores.astype(np.int64)),
            }
        )


def _positives(block: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The best of the shard's rows with an anchor's label, scored label by label."""
    cell = _Cell(block, shard)
    parts = []
    for label in np.intersect1d(cell.anchor_labels, cell.labels):
        at = np.flatnonzero(cell.anchor_labels == label)
        rows = np.flatnonzero(cell.labels == label)
        scores = inner_products(cell.planes[:, :, rows], cell.tables[:, :, at])
        columns, found = best(scores, cell.ids[rows][:, None] != cell.anchors[at], k)
        parts.append((0, at[columns], rows[found], scores[found, columns]))
    return cell.found(parts)


def _negatives(block: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The best rows of other labels in the interval that each positive gives."""
    cell = _Cell(block, shard)
    scores = inner_products(cell.planes, cell.tables)
    other = cell.labels[:, None] != cell.anchor_labels
    other &= cell.ids[:, None] != cell.anchors
    parts = []
    for nth in sorted({x["nth"] for x in cell.wanted}):
        low = np.full(len(cell.anchors), 1, np.int64)
        high = np.zeros(len(cell.anchors), np.int64)
        for x in cell.wanted:
            if x["nth"] == nth:
                low[x["at"]], high[x["at"]] = -(-x["score"] // 2), 95 * x["score"] // 100
        columns, found = best(scores, other & (scores >= low) & (scores <= high), k)
        parts.append((nth, columns, found, scores[found, columns]))
    return cell.found(parts)


def _cells(blocks: DataFrame, shards: DataFrame, sizes: DataFrame, search, k: int) -> DataFrame:
    """Every block with every shard of its dimension, searched; rows of ``FOUND``."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = blocks.join(sizes.select("dim", "shards"), "dim").withColumn("shard", every("shards"))
    right = shards.join(sizes.select("dim", "blocks"), "dim").withColumn("block", every("blocks"))
    key = ["dim", "block", "shard"]

    def run(block: pa.Table, shard: pa.Table) -> pa.Table:
        # Hashing may leave a block or shard empty.
        if not block.num_rows or not shard.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _FOUND_TYPES})
        return search(block, shard, k)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND)


_FOUND_TYPES = [
    (x.split()[0], pa.int64() if x.endswith("long") else pa.int32()) for x in FOUND.split(", ")
]


def _ranked(found: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_rows: int = BLOCK,
    shard_rows: int = SHARD,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` is ``(vec_id, embedding, label)``; anchors are the rows whose id
    ``every`` divides. Positives are the best other rows of the anchor's label, and
    negatives the best rows of other labels that score 50 to 95 % of the positive.
    Scores are integer inner products, ties go to the smaller id, and ranks begin at
    1 among those returned. A pair without such a row is not in the result.

    Only rows of equal dimension meet. Rows with the anchor's id are neither;
    repeated rows count each, but equal anchor rows are asked once and different ones
    under one id each. ``labelled_vectors`` says which rows take no part. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = labelled_vectors(vectors).withColumn("row", F.monotonically_increasing_id())
    rows = keep_table(rows, "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0).select("dim", "vec_id", "label", "v").distinct()
    number = lambda n: F.greatest(F.lit(1), F.ceil(n)).cast("int")
    sizes = keep_table(
        rows.groupBy("dim").agg(
            number(F.count(F.lit(1)) / shard_rows).alias("shards"),
            number(F.count_if(F.col("vec_id") % every == 0) / block_rows).alias("blocks"),
        ),
        "sizes",
    )  # a row per dimension
    # The rows of a partition are numbered one after the other, so shards are even.
    shards = keep_table(
        rows.join(sizes, "dim")
        .withColumn("shard", F.pmod("row", "shards").cast("int"))
        .select("dim", "shard", "vec_id", "label", "v")
        .groupBy("dim", "shard")
        .applyInArrow(_pack_shard, SHARDS),
        "shards",
    )
    blocks = keep_table(
        anchors.join(sizes, "dim")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), "blocks").cast("int"))
        .select("dim", "block", "vec_id", "label", "v")
        .groupBy("dim", "block")
        .applyInArrow(_pack_block, BLOCKS),
        "blocks",
    )
    key = ["dim", "block", "at"]
    found = _cells(blocks, shards, sizes, _positives, positives).drop("nth")
    pairs = keep_table(_ranked(found, key, "nth", positives), "positives")
    wanted = pairs.groupBy("dim", "block").agg(
        F.collect_list(F.struct("at", "nth", "score")).alias("wanted")
    )  # of one block's anchors
    asked = blocks.join(wanted, ["dim", "block"])
    hard = _ranked(
        _cells(asked, shards, sizes, _negatives, negatives), [*key, "nth"], "rank", negatives
    )
    own = anchor_ids(blocks)
    return (
        hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(pairs.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), [*key, "nth"])
        .join(own, key)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def anchor_ids(blocks: DataFrame) -> DataFrame:
    """``dim, block, at, anchor_id``: the anchors of each block by their place there."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), row["dim"], np.int32)),
                        pa.array(np.full(len(ids), row["block"], np.int32)),
                        pa.array(np.arange(len(ids), dtype=np.int32)),
                        pa.array(ids),
                    ],
                    names=["dim", "block", "at", "anchor_id"],
                )

    return blocks.select("dim", "block", "ids").mapInArrow(
        unpack, "dim int, block int, at int, anchor_id long"
    )


SQL = f"""
with v as (
  select row_number() over () r, vec_id,
         case when vec_id % {SHIFTED} = 0 then (label + 1) % {LABELS} else label end label,
         list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select distinct vec_id, label, q from v where vec_id % {EVERY} = 0),
s as (
  select a.vec_id anchor_id, a.label, a.q, v.r, v.vec_id, v.label = a.label same,
         cast(list_inner_product(a.q, v.q) as bigint) score
  from a join v on a.vec_id <> v.vec_id and len(a.q) = len(v.q)),
p as (
  select anchor_id, label, q, r, vec_id positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id, label, q order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, label, q, p.r
         order by score desc, vec_id) as int) rank,
       vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id, label, q)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= {NEGATIVES}
"""
