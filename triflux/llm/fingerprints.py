"""Fingerprints of documents: bottom-k sketches of shingle hashes, in DataFrame functions.

A sketch is the sorted array of the ``SKETCH`` smallest hashes of a text's distinct
shingles. Sketches of parts merge into the sketch of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles; sets of up
to ``SKETCH`` shingles are estimated exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triflux.functions.scratch import keep_table

WORDS = 5
SKETCH = 64
WORD = "[^ \\t\\n\\x0B\\f\\r]+"

_KEY = ("has_id", "id", "tie")


def with_sketch(frame: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """``frame`` with the sketch of its column ``text``.

    Words are runs of anything but ASCII white space. A text with fewer words than
    a shingle has them all as one; one without words, or null, has none. Each step
    is a projection of its own, so that no array is made twice.
    """
    last = F.size("_hashes") - words
    shingle = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(words)])
    shingles = (
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), shingle))
        .when(F.size("_hashes") > 0, F.array(F.xxhash64("_hashes")))
        .otherwise(F.array().cast("array<long>"))
    )
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    return (
        frame.withColumn("_words", found)
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_shingles", shingles)
        .withColumn(name, F.slice(F.sort_array(F.array_distinct("_shingles")), 1, SKETCH))
        .drop("_words", "_hashes", "_shingles")
    )


def merge(a: str, b: str) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)


def resemblance(a: str, b: str) -> Column:
    """The estimated share of the union that both sets have; 1 for two empty sets."""
    union = merge(a, b)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(sketch: str) -> Column:
    """The estimated size of a sketch's set, exact below ``SKETCH``."""
    share = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    full = F.size(sketch) >= SKETCH
    return F.when(full, (SKETCH - 1) / share).otherwise(F.size(sketch).cast("double"))


def containment(a: str, b: str) -> Column:
    """The estimated share of the first set that the second has; 1 for an empty first set."""
    r = resemblance(a, b)
    both = r / (r + 1) * (distinct_shingles(a) + distinct_shingles(b))
    share = F.least(F.lit(1.0), both / distinct_shingles(a))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def as_text(sketch: str) -> Column:
    """A sketch as hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merged_sketches(frame: DataFrame, sketch: str, *keys: str) -> DataFrame:
    """The sketch of each group of parts: its hashes, counted once, by order up to ``SKETCH``.

    Duplicates combine before they move, and ranks are cut off in each task first.
    """
    values = frame.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    order = Window.partitionBy(*keys).orderBy("_hash")
    kept = values.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SKETCH)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def next_keys(keyed: DataFrame) -> DataFrame:
    """For each distinct key its successor: ``key``, ``next`` (structs) and ``n_chars``.

    Keys are dealt by ranges and sorted in each; only the first key of each range
    crosses over to the range before, so no task has more than a range.
    """
    parts = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = (
        keyed.select(*_KEY, "n_chars")
        .distinct()
        .repartitionByRange(parts, *_KEY)
        .sortWithinPartitions(*_KEY)
        .select(F.struct(*_KEY).alias("key"), "n_chars", F.spark_partition_id().alias("part"))
    )
    rows = keep_table(ranges, "order")
    firsts = rows.groupBy("part").agg(F.min("key").alias("first"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per range.
    after = firsts.select(
        "part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(whole)).alias("over")
    )
    within = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    led = rows.withColumn("within", within).join(F.broadcast(after), "part")
    return led.select("key", "n_chars", F.coalesce("within", "over").alias("next"))


def edited_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprints of ``docs (doc_id, text)``, of edited texts, and their likeness.

    In the edited text the last quarter of the code points, rounded down, gives way
    to the first as many (or all) of the next document. Documents lie in ascending
    order of doc_id, null first, those of one id by a hash of their text, and the
    first follows the last. Rows that agree in id and text are one document in that
    order, and all have the same next one; a document alone follows itself. A null
    text counts as empty. Other columns are ignored.

    The texts and sketches are shuffled once, by document, and read twice: to send
    each document's beginning to the one before, and to meet it there.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id",
        text.alias("text"),
        F.length(text).alias("n_chars"),
        F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(text).alias("tie"),
    )
    order = keep_table(next_keys(keyed), "next")
    sketched = with_sketch(keyed, "text", "sketch", words)

    # What each document sends: to whom, and how much of its beginning.
    sends = order.select(
        *[F.col(f"next.{k}").alias(k) for k in _KEY],
        F.col("key").alias("to"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("n"),
    )
    # Both uses take the same columns, or Spark would shuffle the texts for each.
    sent = sketched.join(sends, list(_KEY)).select(
        "to",
        F.col("text").substr(F.lit(1), F.col("n")).alias("begin"),
        "sketch",
        "doc_id",
        F.col("n_chars").alias("n_next"),
    )
    begins = sent.groupBy(*[F.col(f"to.{k}").alias(k) for k in _KEY]).agg(
        F.first("begin").alias("begin"),
        F.first("sketch").alias("next_sketch"),
        F.first("doc_id").alias("next_id"),
        F.first("n_next").alias("next_n_chars"),
    )
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    met = sketched.join(begins, list(_KEY)).select(
        "doc_id",
        "n_chars",
        "sketch",
        "next_sketch",
        "next_id",
        "next_n_chars",
        F.concat(F.col("text").substr(F.lit(1), kept), "begin").alias("edited"),
    )
    both = with_sketch(met, "edited", "edited_sketch", words)
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch").alias("near_edited"),
        resemblance("sketch", "next_sketch").alias("near_next"),
        "next_id",
        F.col("next_n_chars").cast("long").alias("next_n_chars"),
    )
