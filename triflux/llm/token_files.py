"""Token-id files: independent zstandard frames with a seek table at the end.

A file holds the ids of its documents as one run of little-endian unsigned
32-bit integers, cut into frames of ``FRAME_IDS`` ids. Behind the frames come

- the document table, in a skippable frame: ids, null flags and starts of the
  documents in their order;
- the seek table of the zstandard seekable format: for each frame its size, its
  size when decompressed, and the low 32 bits of its XXH64.

Any zstandard decoder can decompress the file. A reader that wants some of the
documents takes their places from the table and decompresses the frames that
hold them, and no others; each frame is checked on the way.

A task writes its part under a name no other attempt has, and reports the name
as a row. The rows of the tasks that ended are the manifest, so a part that a
lost executor left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triflux.functions.scratch import scratch_path
from triflux.llm.tokens import encode_all, release, tokenizer_path

FRAME_IDS = 65_536
LEVEL = 3
# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = (
    "part int, path string, n_docs long, n_tokens long, n_frames long, n_bytes long, "
    "first_doc_id long, last_doc_id long"
)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class TokenFileWriter:
    """Writes documents one after the other; holds one frame of ids and the table."""

    def __init__(self, path: str, frame_ids: int = FRAME_IDS) -> None:
        store, self._name = open_store(path)
        store.create_dir(self._name.rpartition("/")[0], recursive=True)
        self._out = store.open_output_stream(self._name, compression=None)
        self._frame_bytes = 4 * frame_ids
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._waiting = bytearray()
        self._seek = bytearray()
        self._doc_ids: list[int | None] = []
        self._lengths: list[int] = []
        self.n_frames = self.n_bytes = 0

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.n_bytes += len(data)

    def _frame(self, ids: bytes) -> None:
        packed = self._zstd.compress(ids)
        check = xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF
        self._seek += struct.pack("<III", len(packed), len(ids), check)
        self._put(packed)
        self.n_frames += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._doc_ids.append(doc_id)
        self._lengths.append(len(ids) // 4)
        self._waiting += ids
        at, size = 0, self._frame_bytes
        while len(self._waiting) - at >= size:
            self._frame(bytes(self._waiting[at : at + size]))
            at += size
        del self._waiting[:at]

    def close(self) -> tuple[int, int]:
        """Ends the file; documents and ids in it."""
        if self._waiting:
            self._frame(bytes(self._waiting))
        n = len(self._doc_ids)
        table = self._zstd.compress(
            struct.pack("<Q", n)
            + np.array([x or 0 for x in self._doc_ids], "<i8").tobytes()
            + np.array([x is None for x in self._doc_ids], "u1").tobytes()
            + np.cumsum([0, *self._lengths], dtype="<u8").tobytes()
        )
        self._put(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._seek += struct.pack("<III", len(table) + 8, 0, 0)
        footer = struct.pack("<IBI", self.n_frames + 1, CHECKSUMS, SEEK_FOOTER)
        self._put(struct.pack("<II", SEEK_FRAME, len(self._seek) + len(footer)))
        self._put(bytes(self._seek) + footer)
        self._out.close()
        return n, sum(self._lengths)


class TokenFileReader:
    """Reads single documents or all; ``frames_read`` counts the frames decompressed."""

    def __init__(self, path: str) -> None:
        store, name = open_store(path)
        self._in = store.open_input_file(name)
        self._zstd = zstandard.ZstdDecompressor()
        size = self._in.size()
        n, checks, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != SEEK_FOOTER or checks != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        rows = np.frombuffer(self._in.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self._frames = rows[:-1]
        self._places = np.cumsum([0, *rows[:, 0].tolist()], dtype=np.int64)
        self._starts = np.cumsum([0, *rows[:-1, 1].tolist()], dtype=np.int64)
        at = int(self._places[n - 1])
        table = self._zstd.decompress(self._in.read_at(int(rows[-1, 0]) - 8, at + 8))
        docs = struct.unpack_from("<Q", table)[0]
        self._ids = np.frombuffer(table, "<i8", docs, 8)
        self._null = np.frombuffer(table, "u1", docs, 8 + 8 * docs)
        self.starts = np.frombuffer(table, "<u8", docs + 1, 8 + 9 * docs).astype(np.int64)
        self._last: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def __len__(self) -> int:
        return len(self._ids)

    def doc_id(self, k: int) -> int | None:
        return None if self._null[k] else int(self._ids[k])

    def _frame(self, f: int) -> bytes:
        if self._last[0] != f:
            packed_size, size, check = self._frames[f].tolist()
            packed = self._in.read_at(packed_size, int(self._places[f]))
            ids = self._zstd.decompress(packed, max_output_size=size)
            if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {f} is damaged")
            self._last = (f, ids)
            self.frames_read += 1
        return self._last[1]

    def pieces(self, k: int) -> Iterator[bytes]:
        """The ids of the k-th document, frame by frame."""
        at, end = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        f = int(np.searchsorted(self._starts, at, "right")) - 1
        while at < end:
            begin = int(self._starts[f])
            stop = min(end, int(self._starts[f + 1]))
            yield self._frame(f)[at - begin : stop - begin]
            at, f = stop, f + 1

    def read(self, doc_id: int | None) -> list[bytes]:
        """The ids of all documents of that id; documents lie in ascending order, null first."""
        nulls = int(self._null.sum())
        if doc_id is None:
            found = range(nulls)
        else:
            kept = self._ids[nulls:]
            found = range(
                nulls + int(np.searchsorted(kept, doc_id, "left")),
                nulls + int(np.searchsorted(kept, doc_id, "right")),
            )
        return [b"".join(self.pieces(k)) for k in found]

    def close(self) -> None:
        self._in.close()


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, frame_ids: int = FRAME_IDS
) -> DataFrame:
    """Writes the ids of ``docs (doc_id, text)`` below ``folder``; returns the manifest.

    Documents go to parts by ranges of doc_id, null first, and lie in ascending
    order in each; repeats of an id go by their text, equal rows side by side. A
    null text counts as empty: its ids are the end id. Other columns are ignored.
    An empty table gives an empty manifest. The shuffle carries the texts once,
    and no task holds more than a frame, the table of its part and one text.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    tie = F.xxhash64("text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select("doc_id", "text", tie.alias("tie"))
        .repartitionByRange(parts, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, last, part, name = None, None, None, 0, ""
        for batch in batches:
            doc_ids = batch.column(1).to_pylist()
            for doc_id, ids in zip(
                doc_ids, encode_all((x.as_py() for x in batch.column(2)), path), strict=True
            ):
                if writer is None:
                    first, part = doc_id, batch.column(0)[0].as_py()
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
                    writer = TokenFileWriter(name, frame_ids)
                writer.add(doc_id, ids)
                last = doc_id
        release(path)
        if writer is not None:
            n, tokens = writer.close()
            row = [part, name, n, tokens, writer.n_frames, writer.n_bytes, first, last]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int32()), pa.array([row[1]])]
                + [pa.array([x], pa.int64()) for x in row[2:]],
                names=[x.split()[0] for x in MANIFEST.split(", ")],
            )

    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_token_files(
    manifest: DataFrame, doc_ids: Sequence[int] | None = None, with_ids: bool = True
) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, its ``ids``.

    ``start`` counts the ids of all documents before it. ``doc_ids`` names the
    documents wanted, few enough for a driver to list; of the files whose range of
    ids may hold them, only the frames that do are decompressed.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per file: sums over files need no second stage.
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    if doc_ids is not None:
        hit: Column = F.lit(False)
        for x in doc_ids:
            first = F.coalesce("first_doc_id", F.lit(-(2**63)))  # null comes before all others
            hit = hit | F.lit(x).between(first, F.col("last_doc_id"))
        files = files.where(hit)
    wanted = None if doc_ids is None else set(doc_ids)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    kinds = [pa.int64()] * 4
    if with_ids:
        schema, kinds = schema + ", ids binary", [*kinds, pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                source = TokenFileReader(path)
                rows: list[tuple] = []
                held = 0
                for k in range(len(source)):
                    doc_id = source.doc_id(k)
                    if wanted is not None and doc_id not in wanted:
                        continue
                    crc, kept = 0, []
                    for ids in source.pieces(k):
                        crc = zlib.crc32(ids, crc)
                        if with_ids:
                            kept.append(ids)
                            held += len(ids)
                    begin, end = int(source.starts[k]), int(source.starts[k + 1])
                    row = (doc_id, before + begin, end - begin, crc)
                    rows.append((*row, b"".join(kept)) if with_ids else row)
                    if len(rows) >= 10_000 or held >= 1 << 25:
                        yield _batch(rows, kinds, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)
                source.close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "before").repartition(parts).mapInArrow(read, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names
    )


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes all documents to token files and reads every one back."""
    manifest = write_token_files(docs, scratch_path(spark, "tokens"))
    return read_token_files(manifest, with_ids=False)
