"""Scoring a stream of records with a fitted run.

The fitted stages are plain column expressions and model transforms, so the batch functions
apply to a streaming frame unchanged; only the sink differs. Nearest neighbours are a join, which
each micro-batch makes for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewright.ml.knn import NearestNeighbours
from tablewright.plans.automl import FittedRun
from tablewright.plans.scoring import predict


def score_stream(
    run: FittedRun, records: DataFrame, path: str, checkpoint: str, keep: list[str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Append predictions for arriving records as Parquet files, exactly once."""
    trigger = trigger or {"availableNow": True}
    if isinstance(run.model, NearestNeighbours):

        def write(batch: DataFrame, number: int) -> None:
            # a batch that is repeated replaces its own folder
            predict(run, batch, keep).write.mode("overwrite").parquet(f"{path}/batch={number}")

        writer = records.writeStream.foreachBatch(write)
    else:
        writer = predict(run, records, keep).writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
