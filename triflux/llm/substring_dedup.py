"""Words removed where a run of ``WINDOW`` words repeats one of an earlier document.

A count-min sketch comes before the exact work. Documents are dealt to parts of
about ``PART_BYTES``, and a part hashes its windows. Its sketch is sparse: the
32-bit values that the cells follow from, one for each distinct window, with a
mark where several of its documents have it. Slices of all parts' sketches that
belong to one range of hashes are added up in one task, and each part gets back a
bit for each of its windows: whether the least of ``ROWS`` cells is 2 or more.
Cells only ever overestimate, so no repeated window is lost.

The second pass groups exactly what is left. A part sends the 128-bit digest of
the words of each such window once, with the least id among its documents that
have it, and gets back a bit: whether some other part has a smaller one. A third
reading of the same shuffle then removes the words.

Parts and ranges grow in number with the corpus. A task holds one part or one
range; a window that a third of all documents share is one entry in each part.
With n windows in all and m in a part, slices hold m * m / n entries: raise
``part_bytes`` with the root of the corpus, so that they stay above a few hundred.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
PART_BYTES = 1 << 23
ROWS = 3
#: Words hashed at once, and the letters of a word with a factor of their own.
CHUNK, LETTERS = 1 << 18, 4096

SLICES = "shard int, part int, kind int, values binary, marks binary"
ANSWERS = "part int, kind int, shard int, marks binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string"
_SKETCH, _EXACT = 0, 1


@lru_cache(maxsize=4)
def _factors(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers, the same in every worker."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts: their bytes, each word followed by one space.

    ``begins`` holds where each word begins and where the last one's space ends,
    ``firsts`` the first word of each text and the number of all words.
    """

    def __init__(self, texts: list[bytes | None]) -> None:
        joined = b" ".join([*(x or b"" for x in texts), b""])
        raw = np.frombuffer(joined, np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        after_word = space.copy()
        after_word[:1] = False
        after_word[1:] &= ~space[:-1]
        ends = np.cumsum([len(x or b"") + 1 for x in texts], dtype=np.int64)
        self.firsts = np.concatenate([[0], np.searchsorted(np.flatnonzero(after_word), ends)])
        kept = ~space | after_word
        self.bytes = np.where(space, np.uint8(32), raw)[kept]
        self.begins = np.concatenate([[0], np.flatnonzero(self.bytes == 32) + 1])

    def __len__(self) -> int:
        return len(self.begins) - 1

    def owners(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.firsts) - 1, dtype=np.int32), np.diff(self.firsts))

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        letters, places = _factors(256, 1), _factors(LETTERS, 2)
        for low in range(0, len(self), CHUNK):
            begins = self.begins[low : low + CHUNK + 1]
            own, at = self.bytes[begins[0] : begins[-1]], begins[:-1] - begins[0]
            place = np.arange(len(own)) - np.repeat(at, np.diff(begins))
            terms = letters[own] * places[place % LETTERS]
            out[low : low + CHUNK] = _mixed(np.add.reduceat(terms, at))
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows within a text, and the windows' 64-bit hashes."""
        n = len(self) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        owners, words = self.owners(), self._hashes()
        total = np.zeros(n, np.uint64)
        for k, factor in enumerate(_factors(size, 3)):
            total += words[k : k + n] * factor
        first = np.flatnonzero(owners[:n] == owners[size - 1 :])
        return first, _mixed(total[first])

    def digests(self, firsts: np.ndarray, size: int) -> np.ndarray:
        """For each window, a row of two numbers: 128 bits of the digest of its words."""
        data, digest = self.bytes.tobytes(), hashlib.blake2b
        spans = zip(self.begins[firsts].tolist(), (self.begins[firsts + size] - 1).tolist(), strict=True)
        found = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in spans])
        return np.frombuffer(found, np.uint64).reshape(-1, 2)


def _ranges(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where the slice of each shard begins in sorted hashes, and where the last ends."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


class _Part:
    """The windows of one part, in an order that does not depend on that of its rows."""

    def __init__(self, table: pa.Table, size: int, shards: int) -> None:
        self.size, self.shards = size, shards
        self.ids = table["doc_id"].combine_chunks()
        self.words = Words(table["text"].cast(pa.large_binary()).to_pylist())
        self.firsts, hashes = self.words.windows(size)
        self.owner = self.words.owners()[self.firsts]
        self.hashes, self.entry = np.unique(hashes, return_inverse=True)

    def sketch(self) -> list[tuple]:
        several = np.full(len(self.hashes), -1, np.int32)
        several[self.entry] = self.owner  # some document that has the window
        marks = np.zeros(len(self.hashes), bool)
        marks[self.entry[several[self.entry] != self.owner]] = True
        values = (self.hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cuts = _ranges(self.hashes, self.shards)
        return [
            (k, _SKETCH, values[a:b].tobytes(), _bits(marks[a:b]))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if a < b
        ]

    def repeated(self, answers: dict[int, bytes]) -> None:
        """Keeps the windows that the sketches say are repeated, of documents with an id."""
        cuts = _ranges(self.hashes, self.shards)
        flags = np.zeros(len(self.hashes), bool)
        for k, bits in answers.items():
            flags[cuts[k] : cuts[k + 1]] = _flags(bits, int(cuts[k + 1] - cuts[k]))
        chosen = flags[self.entry] & ~self.ids.is_null().to_numpy(zero_copy_only=False)[self.owner]
        self.firsts, self.owner = self.firsts[chosen], self.owner[chosen]
        del self.hashes, self.entry
        ids = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.own = ids[self.owner]
        pairs = self.words.digests(self.firsts, self.size)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        sorted_ = pairs[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
        self.digests = sorted_[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        self.least = np.minimum.reduceat(self.own[order], begins) if len(begins) else self.own[:0]

    def exact(self) -> list[tuple]:
        cuts = _ranges(self.digests[:, 0], self.shards)
        return [
            (k, _EXACT, self.digests[a:b].tobytes(), self.least[a:b].astype(np.int64).tobytes())
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if a < b
        ]

    def covered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which words stand in a window that a document with a smaller id has, too."""
        cuts = _ranges(self.digests[:, 0], self.shards)
        smaller = np.zeros(len(self.digests), bool)
        for k, bits in answers.items():
            smaller[cuts[k] : cuts[k + 1]] = _flags(bits, int(cuts[k + 1] - cuts[k]))
        gone = smaller[self.group] | (self.least[self.group] < self.own)
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, self.firsts[gone], 1)
        np.add.at(steps, self.firsts[gone] + self.size, -1)
        return np.cumsum(steps[:-1]) > 0


def _estimates(values: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Whether the count-min estimate is 2 or more, for the values of all parts in a row."""
    every = np.concatenate(values)
    count = 1 + np.concatenate(marks).astype(np.int32)
    bits = max(8, int(len(every) * 4 - 1).bit_length())
    least = np.full(len(every), np.iinfo(np.int32).max, np.int32)
    for factor in _factors(ROWS, 4):
        spread = (every.astype(np.uint64) + np.uint64(1)) * factor
        cell = (spread >> np.uint64(64 - bits)).astype(np.int64)
        cells = np.zeros(1 << bits, np.int32)
        np.add.at(cells, cell, count)
        np.minimum(least, cells[cell], out=least)
    return least >= 2


def _merged(table: pa.Table) -> pa.Table:
    """The slices of one range of all parts, added up: the answer for each of them."""
    parts = table["part"].to_pylist()
    first, second = table["values"].to_pylist(), table["marks"].to_pylist()
    kind, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
    if kind == _SKETCH:
        values = [np.frombuffer(x, np.uint32) for x in first]
        marks = [_flags(x, len(v)) for x, v in zip(second, values, strict=True)]
        flags = _estimates(values, marks)
    else:
        values = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in first]
        every = np.concatenate(values)
        least = np.concatenate([np.frombuffer(x, np.int64) for x in second])
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (every[order[1:]] != every[order[:-1]]).any(axis=1)
        smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
        flags = np.empty(len(order), bool)
        flags[order] = smallest[np.cumsum(new) - 1] < least[order]
    cuts = np.cumsum([len(v) for v in values])[:-1]
    answers = [_bits(x) for x in np.split(flags, cuts)]
    n = len(parts)
    return pa.table(
        [
            pa.array(parts, pa.int32()),
            pa.array([kind] * n, pa.int32()),
            pa.array([shard] * n, pa.int32()),
            pa.array(answers, pa.binary()),
        ],
        names=["part", "kind", "shard", "marks"],
    )


def _sent(part: int, slices: list[tuple]) -> pa.Table:
    columns = list(zip(*slices, strict=True)) or [[]] * 4
    shard, kind, values, marks = columns
    return pa.table(
        [
            pa.array(shard, pa.int32()),
            pa.array([part] * len(slices), pa.int32()),
            pa.array(kind, pa.int32()),
            pa.array(values, pa.binary()),
            pa.array(marks, pa.binary()),
        ],
        names=[x.split()[0] for x in SLICES.split(", ")],
    )


def _by_kind(answers: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
    found: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
    for row in answers.select(["kind", "shard", "marks"]).to_pylist():
        found[row["kind"]][row["shard"]] = row["marks"]
    return found


def without_repeats(
    docs: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs (doc_id, text)``.

    A word goes if it stands in a window of ``window`` words, of the document as it
    came in, whose words also follow one another in a document with a smaller id.
    Words are runs of anything but ASCII white space; ``kept`` joins the others by
    one space. Rows that repeat an id are judged each by itself, and not by one
    another. A null id is smaller than none and none is smaller than it, so such a
    row keeps all. A null text has no words and ``kept`` null; an empty text, or one
    of fewer than ``window`` words, loses none. Other columns are ignored, and an
    empty table gives an empty result. Windows count as equal if a 128-bit BLAKE2b
    digest of their words does.
    """
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(bytes_ / part_bytes))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    # Read three times, shuffled once.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part).groupBy("part")

    def sketch(table: pa.Table) -> pa.Table:
        return _sent(table["part"][0].as_py(), _Part(table, window, parts).sketch())

    def exact(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Part(table, window, parts)
        own.repeated(_by_kind(answers)[_SKETCH])
        return _sent(table["part"][0].as_py(), own.exact())

    def kept(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Part(table, window, parts)
        repeated, smaller = _by_kind(answers)
        own.repeated(repeated)
        gone, words = own.covered(smaller), own.words
        stays = np.repeat(~gone, np.diff(words.begins))
        left = words.bytes[stays].tobytes()
        sizes = np.concatenate([[0], np.cumsum(stays)])
        cuts = sizes[words.begins[words.firsts]].tolist()
        so_far = np.concatenate([[0], np.cumsum(gone)])
        texts = [left[a : max(a, b - 1)].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(
            [
                own.ids.cast(pa.int64()),
                pa.array(np.diff(words.firsts), pa.int64()),
                pa.array(np.diff(so_far[words.firsts]), pa.int64()),
                pa.array(texts, pa.string(), mask=table["text"].is_null().to_numpy()),
            ],
            names=[x.split()[0] for x in KEPT.split(", ")],
        )

    estimated = dealt.applyInArrow(sketch, SLICES).groupBy("shard").applyInArrow(_merged, ANSWERS)
    firsts = (
        dealt.cogroup(estimated.groupBy("part"))
        .applyInArrow(exact, SLICES)
        .groupBy("shard")
        .applyInArrow(_merged, ANSWERS)
    )
    return dealt.cogroup(estimated.unionByName(firsts).groupBy("part")).applyInArrow(kept, KEPT)


def removal_digest(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256``; a null text counts as empty."""
    return without_repeats(docs).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = rf"""
with d as (
  select row_number() over () r, doc_id,
         coalesce(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), []) w
  from documents),
g as (
  select r, doc_id, i, hash(list_slice(w, i, i + {WINDOW - 1})) h,
         array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') words
  from d, unnest(range(1, len(w) - {WINDOW - 2})) t(i)),
f as (select words, min(doc_id) least from g group by 1),
c as (
  select distinct r, i + k place
  from g join f using (words), unnest(range({WINDOW})) t(k)
  where least < doc_id),
x as (select r, list(place) gone from c group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
       sha256(array_to_string(
         [y for y, j in w if not list_contains(coalesce(gone, []), j)], ' ')) kept_sha256
from d left join x using (r)
"""
