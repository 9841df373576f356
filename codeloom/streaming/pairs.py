"""The preparation job over an unbounded source.

The job is row-local, so the batch expressions apply to a stream unchanged: no watermark, no
state. The file sink with its checkpoint folder writes each source file's pairs exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from codeloom.operators.prep import prepare_pairs


def pair_stream(functions: DataFrame, path: str, checkpoint: str, **options) -> DataStreamWriter:
    """Writer of prepared pairs for a streaming (id, lang, code) table; start it to run."""
    return (
        prepare_pairs(functions, **options)
        .writeStream.format("json")
        .partitionBy("lang", "split")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
