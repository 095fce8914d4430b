"""The newest version of each key, kept up as log segments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshot import latest
from ..sources.logs import LOG_SCHEMA


def log_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """New segments of a log folder; replay from the checkpoint's place is Spark's."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def maintain(stream: DataFrame, table: str, checkpoint: str):
    """Merges each batch's newest versions into the Parquet table of generations; a redone batch writes the same one."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        new = latest(batch)
        if n:
            new = latest(spark.read.schema(LOG_SCHEMA).parquet(f"{table}/generation={n - 1}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{table}/generation={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_generation(spark: SparkSession, table: str) -> DataFrame:
    """The newest generation that was written to its end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/generation=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    done = [int(x.getPath().getParent().getName().partition("=")[2]) for x in found]
    if not done:
        raise ValueError("no generation was written to its end")
    return spark.read.schema(LOG_SCHEMA).parquet(f"{table}/generation={max(done)}")


def changes(stream: DataFrame):
    """Watch events with the value before: (user_key, seq, kind, value, previous), by state of one value a key. A key's rows may
    come in several batches: they are put in order together."""
    import pandas as pd

    def step(key, batches, state):
        previous = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        value = [None if gone else x for gone, x in zip(rows["is_delete"], rows["value"])]
        before = [previous, *value[:-1]]
        state.update((value[-1],))
        yield pd.DataFrame({"user_key": key[0], "seq": rows["seq"].tolist(), "kind": ["DELETE" if gone else "PUT" for gone in rows["is_delete"]], "value": value, "previous": before})

    out = "user_key string, seq long, kind string, value string, previous string"
    return stream.groupBy("user_key").applyInPandasWithState(step, out, "value string", "append", "NoTimeout")
