"""Stages send small Arrow batches, whatever the session's settings were."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regioscope.llm import common

SF = "/root/testdata/sf0.001"
BATCHES = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_small_batches(spark, name):
    held = {k: spark.conf.get(k, None) for k in BATCHES}

    def sizes(source):
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "b"])

    try:
        for k in BATCHES:
            spark.conf.unset(k)
        dict(corpus_pipeline.STAGES)[name](spark, common.read(spark, SF, "documents"), SF)
        for length, rows in ((4000, 6000), (4, 6000)):
            text = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), length).alias("text"))
            most = text.mapInArrow(sizes, "n long, b long").agg(F.max("n").alias("n"), F.max("b").alias("b")).first()
            assert most.n <= 2000 and most.b <= 5 << 20
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
