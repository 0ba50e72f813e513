"""Archive files as a stream: each micro-batch is merged like a batch load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import utf8_without_errors
from ..operators.flatten import flatten
from ..plans.store import Store, kept
from ..sources.archive import parsed


def follow(spark: SparkSession, path: str, store: Store, checkpoint: str, files_at_a_time: int = 1, pattern: str = "*.jsonl.gz") -> StreamingQuery:
    """Loads what there is and ends. A batch that ran before a failure is known to the store by its number and is not loaded twice."""

    def load(rows: DataFrame, number: int) -> None:
        lines = rows.select("file", F.monotonically_increasing_id().alias("line"), utf8_without_errors(F.col("value")).alias("value")).where("trim(value) <> ''")
        with kept(parsed(lines).drop("value"), f"{store.root}/_kept") as records:
            store.load(f"{checkpoint}#{number}", flatten(records, placed=True))

    stream = spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_a_time).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
