"""Documents packed into token sequences of one length, by the histogram of their pieces.

A document is its token ids and the end id. Longer ones are cut into pieces of
``capacity`` tokens; no other document is cut. The configurations that
``config_lp`` finds for the histogram are laid out one after the other, so the
r-th piece of a length has its place from r alone.

The rank r comes in two parts, counted where a piece was made and summed over
the tasks before, so that no length, however common, is numbered in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.scratch import keep_table
from triflux.llm.config_lp import Plan, solve
from triflux.llm.tokens import encode_all, release, tokenizer_path

CAPACITY = 4096
#: Rows and bytes of ids after which a task hands on what it has.
BATCH_ROWS, BATCH_BYTES = 10_000, 1 << 25

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
)
PLACES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "sequence_id long, offset long"
)
_LONG = pa.int64()


def cut_pieces(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """A table of the pieces of ``docs (doc_id, text)``, if asked for with their ``ids``.

    A null or empty text is the end id alone. ``(task, nth)`` numbers the pieces
    of each length: ``nth`` counts within the task that made them. It is written
    before anything reads it, since another run might deal rows out differently.
    """
    path = path or tokenizer_path()
    schema = f"{PIECES}, ids binary" if with_ids else PIECES
    types = [_LONG, pa.int32(), *[_LONG] * 5, *[pa.binary()] * with_ids]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made: Counter[int] = Counter()
        rows: list[tuple] = []
        held = 0
        for docs in batches:
            texts = (x.as_py() for x in docs.column(1))
            ids_of = encode_all(texts, path)
            for doc_id, ids in zip(docs.column(0).to_pylist(), ids_of, strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    row = (doc_id, piece, at // 4, n, zlib.crc32(part), task, made[n])
                    rows.append((*row, part) if with_ids else row)
                    made[n] += 1
                    held += len(part) if with_ids else 0
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)
        release(path)

    return keep_table(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces")


def _layout(plan: Plan) -> dict[int, np.ndarray]:
    """Per length, rows ``first rank, copies' first sequence, pieces a copy, offset``."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: Counter[int] = Counter()
    sequence = 0
    for content, copies in plan:
        offset = 0
        for length, n in sorted(content.items(), reverse=True):
            rows[length].append((ranks[length], sequence, n, offset))
            ranks[length] += n * copies
            offset += n * length
        sequence += copies
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece goes: ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    The plan that tasks get has a row per configuration and length, at most some
    tens of thousands for the default capacity however many pieces there are.
    Columns are those of ``PLACES``; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows
    layout = _layout(solve({r["length"]: r["n"] for r in histogram}, capacity))
    shared = spark.sparkContext.broadcast(layout)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    firsts = counts.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    ranked = pieces.join(firsts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            ranks = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, at = np.unique(lengths[order], return_index=True)
            for length, own in zip(values.tolist(), np.split(order, at[1:]), strict=True):
                first, base, each, begin = plan[length].T
                k = np.searchsorted(first, ranks[own], "right") - 1
                copy, slot = np.divmod(ranks[own] - first[k], each[k])
                sequence[own] = base[k] + copy
                offset[own] = begin[k] + slot * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[x.split()[0] for x in PLACES.split(", ")],
            )

    return ranked.mapInArrow(place, PLACES)


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The table of pieces, if asked for with their ids, and the places of the pieces.

    Repeated rows are pieces of their own; an empty table gives empty tables.
    """
    pieces = cut_pieces(docs, path, capacity, with_ids)
    return pieces, place_pieces(pieces, capacity)


def packed_ids(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence, little-endian 32-bit, ready to train on.

    ``pieces`` needs the ids. A piece is found by all that tells it from others but its rank; pieces that
    agree in that, of repeated rows, have the same ids.
    """
    key = ["doc_id", "piece", "length", "ids_crc32"]
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in key]
    ids = pieces.groupBy(*key).agg(F.first("ids").alias("ids"))
    rows = places.alias("p").join(ids.alias("q"), same).select("sequence_id", "offset", "ids")
    return rows.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    ).select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
