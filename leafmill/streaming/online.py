"""Learning while documents arrive: outcomes are appended batch by batch and the model is refitted at intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.signing import load_key
from leafmill.operators import learner as le


class OnlineLearner:
    """Outcome table, signed model and the sample count of its training below one folder; a restart goes on with them.

    Each batch is written to a folder named after its number, so a repeated batch replaces itself. The key lies in a file
    that only its owner may read; a model that is not signed by it is not loaded but trained again.
    """

    def __init__(self, spark: SparkSession, root: str, key_file: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), load_key(key_file)
        self.model, self.last_trained = le.load_or_train(self.root, self.outcomes(), self.key)

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def outcomes(self) -> DataFrame | None:
        fs, path = self._fs(f"{self.root}/outcomes")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/outcomes") if fs.exists(path) else None

    def batch(self, rows: DataFrame, number: int) -> None:
        """Appends a batch of outcomes and refits after enough new samples."""
        rows.write.mode("overwrite").parquet(f"{self.root}/outcomes/batch={number}")
        self.model, self.last_trained = le.load_or_train(self.root, self.outcomes(), self.key)

    def retrain(self) -> None:
        """Trains on all outcomes whatever the count."""
        known = self.outcomes()
        fresh = le.train(known) if known is not None else None
        if fresh is not None:
            self.model, self.last_trained = fresh, known.where("ocr_performed").count()
            le.save_signed(fresh, self.root, self.key, self.last_trained)

    def reset(self) -> None:
        """Forgets all outcomes and the model."""
        fs, path = self._fs(self.root)
        fs.delete(path, True)
        self.model, self.last_trained = None, 0

    def start(self, stream: DataFrame, checkpoint: str, minutes: int | None = None):
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if minutes is None else writer.trigger(processingTime=f"{minutes} minutes")).start()


def decided(learner: OnlineLearner, images: DataFrame, draws: tuple) -> DataFrame:
    """Decisions on a batch of images with the learner's model and counts as they are now.

    Outcomes with their ``reason`` give the recent error and the share of wrong skips that adapt the rates; without it these are unknown.
    """
    known = learner.outcomes()
    spark = images.sparkSession
    empty = spark.createDataFrame([], "size_bin string, brightness_bin string, region string, samples long")
    samples = known.where("ocr_performed").count() if known is not None else 0
    counts = le.region_counts(known) if known is not None else empty
    now = le.adaptive_inputs(known).first() if known is not None and "reason" in known.columns else (0.0, 0, 0, 0)
    scored = le.predict(learner.model, images) if learner.model is not None else images.withColumn("probability", F.lit(None).cast("double"))
    return le.decide(scored, counts, F.lit(samples), F.col("probability"), *(F.lit(x) for x in now), draws)
