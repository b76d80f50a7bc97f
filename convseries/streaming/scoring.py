"""Structured Streaming over series: scoring, assembling from events, batched escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convseries.operators import serving


def score_stream(rows: DataFrame, student: DataFrame, meta: dict, normalize: bool = True) -> DataFrame:
    """A stream (id, values) scored by the student: (id, ..., student, margin, escalated). Stateless."""
    return serving.score(rows, student, meta, normalize)


def series_from_events(events: DataFrame, keys: list[str], ts: str, value: str, width: str | None = "1 day", gap: str | None = None, late: str = "1 hour", name: str = "values") -> DataFrame:
    """One series per key and tumbling window (or session, with gap) of an event stream, in time order; events later than the watermark are dropped."""
    window = F.session_window(ts, gap) if gap else F.window(ts, width)
    points = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(value).cast("double").alias("v"))))
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(*keys, window.alias("window")).agg(points.alias("_points"))
    return rows.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.transform("_points", lambda p: p["v"]).alias(name))


def batch_folders(path: str):  # noqa: ANN201
    """A sink (df, batch_id) that writes each micro-batch to a folder of its own, replacing what an earlier attempt at the same batch left there. Spark's commit puts a marker into a folder when all of it is written, and committed_batches reads none without it: a batch that is run again, or was cut off, counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def committed_batches(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """The rows of all batches that were written whole, with batch_id."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    place = fs_path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    markers = [str(f.getPath().getParent()) for f in files.globStatus(fs_path(f"{path}/batch_id=*/_SUCCESS")) or []]
    if not markers:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("int"))
    return spark.read.schema(schema).option("basePath", path).parquet(*markers)


def escalate_batches(scored: DataFrame, ensemble, sink, checkpoint: str, once: bool = True):  # noqa: ANN001, ANN201
    """Starts a query that answers each micro-batch's escalated rows with one ensemble call and hands (id, yhat, escalated) to sink(df, batch_id). A batch whose commit was lost is handed over again under its old number; batch_folders is a sink that keeps it once."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the student's answers are read twice
        try:
            hard = batch.where("escalated")
            better = ensemble.predict(hard.select("id", "values")).select("id", F.col("yhat").alias("_better"))
            sink(batch.join(better, "id", "left").select("id", F.coalesce("_better", "student").alias("yhat"), "escalated"), batch_id)
        finally:
            batch.unpersist()

    writer = scored.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
