"""Questions arriving as a stream, answered in micro-batches.

The reference answers one question per form submit and appends it to a
history; here questions land as files in a folder, Structured Streaming
picks them up, each micro-batch runs the batch answer plan against the
stored index, and the records are appended to the question log.  Each
epoch writes its own log partition with overwrite, so a retried epoch
replaces its output instead of duplicating it (exactly-once with the
checkpoint).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritext.operators import qlog as QL
from veritext.plans import qa
from veritext.session import stored

QUESTION_SCHEMA = "question_id bigint, question string"


def answer_stream(spark: SparkSession, question_dir: str, index: DataFrame, log_path: str,
                  checkpoint: str, cfg: qa.QAConfig | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None, lexical=None) -> StreamingQuery:
    """``lexical``: the stored term tables of the index, for questions that
    fall back to BM25."""
    reader = spark.readStream.schema(QUESTION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    questions = reader.parquet(question_dir)

    def each(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        started = time.time()
        records = stored(qa.answer(index, batch, cfg, lexical)["records"], "records")   # the answer work of this micro-batch
        elapsed = time.time() - started      # wall time of the batch, as the form measures per question
        entries = QL.log_entries(records, F.lit(elapsed)).withColumn("epoch", F.lit(epoch_id).cast("bigint"))
        entries.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/epoch={epoch_id}")

    writer = questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()
