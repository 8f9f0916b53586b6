"""Near-duplicate documents: bottom-k sketches, inverted lists, exact Jaccard.

The set of a document is its distinct shingles. One hash function gives each
shingle a 64-bit value, and a document retains its ``SKETCH`` smallest.

1. Documents with the same words are one class; only classes are compared.
2. Inverted lists of the ``LISTED`` smallest values give candidates: all pairs of
   a list of up to ``LONG_LIST`` classes. Longer lists are split by runs of 3
   neighbouring retained values. Texts that are alike have most runs in
   common, while unlike texts that share a passage do not. The lists of short
   texts, which have few runs, are not split.
3. What stays too long links each class to a few centres of its list.
4. The sketch of a pair's union estimates its similarity; likely pairs are
   confirmed on the full sets of their texts.
5. Classes of long lists that are not connected after that are compared on their
   full sets, block by block, so that no pair of such a list is left out.
6. Connected components of the confirmed links are groups of near-duplicates.

Two sets with similarity s miss each other in every list of step 2 with a chance
of (1 - s) to the power of ``LISTED``, below 1e-16 for s = 0.8, or where all that
they share is in long lists, of having no run of 3 in common. The estimate drops
a true pair only where it is off by five standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from triflux.functions.scratch import keep_table
from triflux.llm.components import connected_components
from triflux.llm.names import fresh

WORDS = 5
PERCENT = 80
SKETCH = 64
LISTED = 24
#: Sets of up to so many shingles are short; the others' sizes overlap theirs enough for pairs.
SHORT, REGULAR = 30, 25
LONG_LIST = 32
CENTRES = 2
#: Shingles and classes of a block, and columns of the matrix that a task has at once.
BLOCK, BLOCK_ROWS, COLUMNS = 200_000, 512, 4_096
#: Lengths of runs that split lists, one after the other.
RUNS = (1, 3)
#: The estimate from which pairs are confirmed: at 0.8 its standard deviation is 0.05.
LIKELY = 0.55
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
     0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    np.uint64,
)
#: Word hashes that a task keeps.
KEPT = 100_000


class Shingler:
    """Turns a text into its words and the sorted values of its distinct shingles."""

    def __init__(self, words: int) -> None:
        if not 1 <= words <= len(_MIX):
            raise ValueError(f"shingles have 1 to {len(_MIX)} words")
        self._n = words
        self._hashes: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        """Runs of anything but ASCII white space, A-Z in lower case."""
        return (text or "").encode().lower().split()

    def values(self, words: list[bytes]) -> np.ndarray:
        """Signed values in ascending order; fewer words than a shingle's are one as a whole."""
        if not words:
            return np.zeros(0, np.int64)
        if len(words) < self._n:
            return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words))], np.uint64).view(np.int64)
        known = self._hashes
        if len(known) > KEPT:
            known.clear()
        hashes = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh3_64_intdigest(word)
            hashes[i] = value
        last = len(words) - self._n + 1
        mixed = np.zeros(last, np.uint64)
        for i in range(self._n):
            mixed += hashes[i : i + last] * _MIX[i]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX[4]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX[5]
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))

    def class_of(self, words: list[bytes]) -> bytes | None:
        """128 bits that texts with the same words share; none for texts without words."""
        return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of ``docs (doc_id, text)`` its set's size, class and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes, classes, sketches = [], [], []
            for text in batch.column(1):
                own = shingler.words(text.as_py())
                values = shingler.values(own)
                sizes.append(len(values))
                classes.append(shingler.class_of(own))
                sketches.append(values[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "class", "sketch"],
            )

    schema = "doc_id long, n long, class binary, sketch array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def representatives(signed: DataFrame) -> DataFrame:
    """One row per class: ``node``, a number for it, its first document, size and sketch."""
    rows = signed.where(F.col("class").isNotNull()).groupBy("class")
    first = rows.agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    return first.select(F.monotonically_increasing_id().alias("node"), *first.columns)


def _lists(nodes: DataFrame, run: int, space: str) -> DataFrame:
    """A row for each position in ``starts``: the key is a hash of the run that begins there.

    A run that would go beyond the sketch ends with it.
    """
    at = nodes.select("node", "n", "sketch", F.explode("starts").alias("at"))
    values = [F.get("sketch", F.col("at") + k) for k in range(run)]
    return at.select("node", "n", "at", F.xxhash64(F.lit(f"{space}{run}"), *values).alias("key"))


def _first_starts(nodes: DataFrame) -> DataFrame:
    last = F.least(F.size("sketch"), F.lit(LISTED)) - 1
    return nodes.withColumn("starts", F.sequence(F.lit(0), last))


def _starts_in(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Nodes with the positions at which they are in ``lists``, ``LISTED`` at most."""
    return nodes.join(lists.groupBy("node").agg(F.collect_list("at").alias("starts")), "node")


def _split(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of lists of 2 to ``LONG_LIST``, and of longer ones. Counts combine before moving."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = keep_table(lists.join(sizes, "key"), "lists")
    long = F.col("members") > LONG_LIST
    return rows.where(~long).drop("members"), rows.where(long).drop("members")


def _alike(a: str, b: str) -> Column:
    """Sizes with which two sets can reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _pairs_of_short(lists: DataFrame) -> DataFrame:
    """All pairs, a below b, of lists that have ``LONG_LIST`` members at most."""
    members = lists.groupBy("key").agg(F.collect_list(F.struct("node", "n")).alias("m"))
    one = members.select("m", F.explode("m").alias("x"))
    two = one.select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.explode("m").alias("y"))
    kept = two.where((F.col("a") < F.col("y.node")) & _alike("na", "y.n"))
    return kept.select("a", F.col("y.node").alias("b"))


def _pairs_with_centres(lists: DataFrame) -> DataFrame:
    """Each member of a list with a few of its members, the same for all."""
    chosen = [
        F.min_by(F.struct("node", "n"), F.xxhash64(F.lit(k), "node")) for k in range(CENTRES)
    ]
    centres = lists.groupBy("key").agg(F.array(*chosen).alias("c"))
    rows = lists.join(centres, "key").select("node", "n", F.explode("c").alias("c"))
    kept = rows.where((F.col("node") != F.col("c.node")) & _alike("n", "c.n"))
    return kept.select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")
    )


def _similarity(a: str, b: str) -> Column:
    """The share of the union's sketch that both sets have: exact if the union fits in it."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs whose sketches make the similarity likely."""
    own = nodes.select("node", "sketch")
    a = own.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    b = own.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.distinct().join(a, "a").join(b, "b")
    return both.where(_similarity("sa", "sb") >= LIKELY).select("a", "b")


def _blocks_within(lists: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes that are in long lists, in blocks: ``node, n, label, cluster, bucket, block``.

    Classes that long lists connect are a cluster, so that each pair of it is met
    once, however many lists it shares. Sizes with which two sets can reach the
    similarity are in the same or in neighbouring buckets of a cluster. A block has
    about ``BLOCK`` shingles and ``BLOCK_ROWS`` classes at most; ``blocks`` counts those
    of a bucket.
    """
    rows = lists.select("node", "key").distinct()
    first = rows.groupBy("key").agg(F.min("node").alias("b"))
    # Most lists of a node have the same first member: one edge each.
    edges = rows.join(first, "key").select(F.col("node").alias("a"), "b").distinct()
    chained = connected_components(edges)
    members = chained.select("node", F.col("label").alias("cluster")).join(
        nodes.select("node", "n"), "node"
    )
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Clusters that are connected already are done.
    open_ = labelled.groupBy("cluster").agg(
        F.min("label").alias("low"), F.max("label").alias("high")
    )
    kept = labelled.join(open_.where("low < high").select("cluster"), "cluster").withColumn(
        "bucket", F.floor(F.ln("n") / math.log(100.5 / PERCENT)).cast("int")
    )
    sizes = kept.groupBy("cluster", "bucket").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks")
    )
    return keep_table(
        kept.join(sizes, ["cluster", "bucket"]).withColumn(
            "block", F.pmod(F.xxhash64("node"), "blocks").cast("int")
        ),
        "blocks",
    )


def _links_within(blocks: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Links that connect what is not connected yet, from comparing blocks pair by pair.

    A task gets two blocks with their texts and compares the full sets by numbers.
    It returns a forest of the links it finds: fewer rows than it was given.
    """
    sizes = blocks.select("cluster", "bucket", "blocks").distinct()
    with_next = blocks.join(
        sizes.select("cluster", (F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("up")),
        ["cluster", "bucket"],
        "left",
    ).join(
        sizes.select("cluster", (F.col("bucket") + 1).alias("bucket"), F.col("blocks").alias("down")),
        ["cluster", "bucket"],
        "left",
    )

    def others(count: str, pair: Callable[[Column], Column]) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.col(count) - 1), pair)
        return F.when(F.col(count) > 0, found).otherwise(F.array().cast("array<array<int>>"))

    own = others("blocks", lambda x: F.array(
        F.lit(0), F.col("bucket"), F.least(x, "block"), F.greatest(x, "block")
    ))
    up = others("up", lambda x: F.array(F.lit(1), F.col("bucket"), F.col("block"), x))
    down = others("down", lambda x: F.array(F.lit(1), F.col("bucket") - 1, x, F.col("block")))
    dealt = with_next.select(
        "cluster", "bucket", "block", "node", "label", F.explode(F.concat(own, up, down)).alias("at")
    ).join(texts, "node")

    def compare(table: pa.Table) -> pa.Table:
        kind, bucket, i, j = table["at"][0].as_py()
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        block, level = table["block"].to_numpy(), table["bucket"].to_numpy()
        left = np.flatnonzero((block == i) & (level == bucket))
        right = np.flatnonzero((block == j) & (level == bucket + kind))
        a: list[int] = []
        b: list[int] = []
        if len(np.unique(label)) > 1:
            shingler = Shingler(words)
            sets = [shingler.values(shingler.words(x.as_py())) for x in table["text"]]
            sizes = np.array([len(x) for x in sets])
            common = _common(sets, left, right)
            union = sizes[left][:, None] + sizes[right][None, :] - common
            good = (100 * common >= PERCENT * union) & (label[left][:, None] != label[right][None, :])
            roots: dict[int, int] = {}

            def root(x: int) -> int:
                while x in roots:
                    x = roots[x]
                return x

            for x, y in np.argwhere(good).tolist():
                p, q = int(left[x]), int(right[y])
                lower, higher = sorted((root(int(label[p])), root(int(label[q]))))
                if lower != higher:
                    roots[higher] = lower
                    a.append(int(node[p]))
                    b.append(int(node[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    grouped = dealt.groupBy("cluster", "at")
    return grouped.applyInArrow(compare, "a long, b long")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sets, by products of parts of their incidence matrix."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, counts = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True
    )
    shared = counts[column] > 1
    rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        begin, end = np.searchsorted(column, (at, at + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        has[rows[begin:end], column[begin:end] - at] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    return common


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, text`` of the wanted nodes: the text of one document of the class."""
    ids = nodes.join(wanted, "node").select("node", "class", "first_id")
    found = docs.select("doc_id", "text").join(
        ids, F.col("doc_id").eqNullSafe(F.col("first_id"))
    ).select("node", "class", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            same = [
                shingler.class_of(shingler.words(text.as_py())) == wanted.as_py()
                for wanted, text in zip(batch.column(1), batch.column(2), strict=True)
            ]
            kept = batch.filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(2)], names=["node", "text"]
            )

    # Ids may repeat: of the rows with an id those of the class stay, and one of them.
    rows = found.mapInArrow(own, "node long, text string")
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        last: dict[int, np.ndarray] = {}

        def values(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in last:
                if len(last) >= 64:
                    last.clear()
                last[node] = shingler.values(shingler.words(text.as_py()))
            return last[node]

        for batch in batches:
            good = []
            for x, y, tx, ty in zip(*batch.columns, strict=True):
                vx, vy = values(x.as_py(), tx), values(y.as_py(), ty)
                common = len(np.intersect1d(vx, vy, assume_unique=True))
                good.append(100 * common >= PERCENT * (len(vx) + len(vy) - common))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id of a document's group, itself included,
    and ``kept`` tells whether that is its own. Null texts and texts without words
    have no shingles and are linked with nothing; they are kept. Rows that repeat
    an id stay rows, each with the group of its own text; a null id is never the
    smallest of a group that has others, and a group of null ids alone has a null
    component and is kept. Other columns are ignored.
    """
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped(docs, words).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each group of ``docs``, with all its columns: one with the smallest doc_id.

    Rows without words are all kept. Rows that agree in id and words are one. Names of
    further columns are of no account; an empty table stays empty.
    """
    rows = grouped(docs, words).where(F.col("class").isNotNull())
    first = rows.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "class")).alias("x")
    )
    one, one_class, own_class = (
        fresh(x, docs.columns) for x in ("_one", "_one_class", "_class")
    )
    ones = first.select(F.col("x.doc_id").alias(one), F.col("x.class").alias(one_class))

    text_at = docs.columns.index("text")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [
                shingler.class_of(shingler.words(x.as_py())) for x in batch.column(text_at)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())],
                names=[*batch.schema.names, own_class],
            )

    schema = StructType([*docs.schema.fields, StructField(own_class, BinaryType())])
    marked = docs.mapInArrow(classed, schema)
    same = F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(own_class) == F.col(one_class))
    kept = marked.where(F.col(own_class).isNotNull()).join(ones, same)
    kept = kept.dropDuplicates(["doc_id", own_class]).select(*docs.columns)
    return kept.unionByName(marked.where(F.col(own_class).isNull()).select(*docs.columns))


def grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row ``doc_id, n, class, label, component_id``; the last three are null without words."""
    signed = keep_table(signatures(docs, words), "signatures")
    nodes = keep_table(representatives(signed), "nodes")
    short = nodes.where(F.col("n") <= SHORT)
    active = nodes.where(F.col("n") >= REGULAR)

    lists = _lists(_first_starts(short), 1, "short").withColumn("short", F.lit(True))
    starts, hot_lists = _first_starts(active), None
    cold_lists: DataFrame | None = None
    for run in RUNS:
        regular = _lists(starts, run, "run").withColumn("short", F.lit(False))
        lists = regular if cold_lists is not None else lists.unionByName(regular)
        cold, hot = _split(lists)
        cold_lists = cold if cold_lists is None else cold_lists.unionByName(cold)
        # The long lists of short texts stay as they are.
        hot_lists = hot.where("short") if hot_lists is None else hot_lists
        starts = _starts_in(active, hot.where("not short"))
    assert cold_lists is not None and hot_lists is not None
    hot_lists = hot_lists.unionByName(hot.where("not short"))

    pairs = _pairs_of_short(cold_lists).unionByName(_pairs_with_centres(hot_lists))
    likely = keep_table(likely_pairs(pairs, nodes), "pairs")
    links = _links(docs, nodes, likely, words)
    labels = connected_components(links)
    blocks = _blocks_within(hot_lists, nodes, labels)
    if not blocks.isEmpty():
        texts = keep_table(texts_of(docs, nodes, blocks.select("node"), words), "texts")
        more_links = keep_table(_links_within(blocks, texts, words), "links")
        labels = connected_components(links.unionByName(more_links))

    labelled = nodes.join(labels, "node", "left").select(
        "class", "first_id", F.coalesce("label", "node").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = labelled.join(smallest, "label").select("class", "label", "component_id")
    rows = signed.select("doc_id", "n", "class").join(of_class, "class", "left")
    return rows.select("doc_id", "n", "class", "label", "component_id")


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = keep_table(texts_of(docs, nodes, ends.distinct(), words), "texts")
    return keep_table(confirmed(pairs, texts, words), "links")
