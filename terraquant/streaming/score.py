"""Scoring a stream of observations with a fitted model.

Imputation, scaling and prediction are row-local, so the batch scorer applies to a
streaming DataFrame unchanged; there is no state and no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scenario import score


def start_scoring(stream: DataFrame, model, ids: Sequence[str], output: str, checkpoint: str, features: Sequence[str] = ()) -> StreamingQuery:
    """Score what has arrived and append it to Parquet files, exactly once per input file."""
    scored = score(model, stream, features).select(*ids, "prediction")
    return (
        scored.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
