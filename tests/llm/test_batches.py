"""Texts go to Python in small batches, and results do not hang on their size."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triflux.functions import batches

DOCS = "doc_id long, text string, lang string, source string"
PYTHON = [x for x in corpus_pipeline.STAGES if x[0] != "source_mixing"]


def _docs(session):
    rows = [(i, f"one of the {i % 9} texts with token = abcdef{i % 9}ghijk0123 in it " * 3, "aa", "s") for i in range(40)]
    return session.createDataFrame([*rows, (90, None, "aa", None), (91, "", None, "s")], DOCS)


@pytest.mark.parametrize("stage", [f for _, f in PYTHON], ids=[name for name, _ in PYTHON])
def test_no_partition_of_texts_is_one_batch(spark, stage):
    session = spark.newSession()  # settings of its own
    stage(session, _docs(session), "")

    def each(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["bytes"])

    texts = session.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 2000).alias("text"))
    sizes = [r.bytes for r in texts.mapInArrow(each, "bytes long").collect()]
    assert sum(sizes) > 8_000_000 and max(sizes) < 1.1 * batches.BYTES


def test_a_limit_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "5000000")
    batches.in_small_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "5000000"


@pytest.mark.parametrize("stage", [f for _, f in PYTHON[:3]], ids=[name for name, _ in PYTHON[:3]])
def test_rows_are_the_same_in_batches_of_one(spark, stage):
    found = []
    for limit in ("1", "67108864"):
        session = spark.newSession()
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
        found.append(sorted(map(str, stage(session, _docs(session), "").collect())))
    assert found[0] == found[1] and found[0]
