"""Change feeds: replay-safe op logs, latest revisions, incremental drift, progress journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.status import drift_status


def dedupe_ops_stream(ops: DataFrame, token: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """One row per idempotency token; state is kept for ``delay`` after a token's time."""
    return ops.withWatermark(ts, delay).dropDuplicatesWithinWatermark([token])


def newer(df: DataFrame, key: str, revision: str) -> DataFrame:
    """The highest revision of each key; numbers compare as numbers, other revisions are below any number and compare as text."""
    number = F.when(F.col(revision).rlike("^[0-9]+$"), F.col(revision).try_cast("decimal(38,0)"))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(F.coalesce(number, F.lit(-1).cast("decimal(38,0)")), F.col(revision))).alias("r")).select("r.*")


class LatestRevisions:
    """foreachBatch sink that keeps the latest revision per document in Parquet folders and never goes back.

    A batch writes its own keys only, as the folder ``n-n``. After every ``fan`` batches their folders are merged into one, after every
    ``fan`` of these again, and so on, so that a row is written anew some times by the logarithm of the number of batches, and a reader finds few folders.
    A batch that runs again writes the same folders from the same predecessors: merged ones go only when the next batch begins.
    Readers take the widest folders and the latest revision of each key. A reader that finds a folder gone meanwhile reads again.
    """

    def __init__(self, path: str, key: str = "doc_id", revision: str = "revision", fan: int = 16):
        self.path, self.key, self.revision, self.fan = path, key, revision, fan

    def _fs(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def folders(self, spark: SparkSession) -> list[tuple[int, int]]:
        """First and last batch of every complete folder."""
        fs, path = self._fs(spark)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        ranges = [tuple(map(int, n.split("-"))) for n in names if n.replace("-", "").isdigit()]
        return [(a, b) for a, b in ranges if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{a}-{b}/_SUCCESS"))]

    @staticmethod
    def widest(folders: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The folders that hold all batches once."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(folders, key=lambda f: (f[0], -f[1])):
            if not out or a > out[-1][1]:
                out.append((a, b))
        return out

    def _read(self, spark: SparkSession, folders: list[tuple[int, int]]) -> DataFrame:
        return newer(spark.read.parquet(*(f"{self.path}/{a}-{b}" for a, b in self.widest(folders))), self.key, self.revision)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, _ = self._fs(spark)
        there = self.folders(spark)
        for a, b in there:  # the batches before this one are done: what they merged isn't needed again
            if any(c <= a and b <= d < number and (a, b) != (c, d) for c, d in there):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{a}-{b}"), True)
        newer(batch, self.key, self.revision).write.mode("overwrite").parquet(f"{self.path}/{number}-{number}")
        width = self.fan
        while (number + 1) % width == 0:
            first = number + 1 - width
            parts = [(a, b) for a, b in self.folders(spark) if a >= first and b <= number and (a, b) != (first, number)]
            self._read(spark, parts).write.mode("overwrite").parquet(f"{self.path}/{first}-{number}")
            width *= self.fan

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self.folders(spark))


class DriftFeed:
    """foreachBatch sink: the drift of each micro-batch's documents (doc_id, text, remote) against static receipts."""

    def __init__(self, path: str, receipts: DataFrame):
        self.path, self.receipts = path, receipts

    def __call__(self, batch: DataFrame, number: int) -> None:
        status = drift_status(batch.select("doc_id", "text"), batch.select("doc_id", F.col("remote").alias("text")), self.receipts)
        status.write.mode("overwrite").parquet(f"{self.path}/batch={number}")


class Journal:
    """foreachBatch sink: verified ops (doc_id, seq, checkpoint) appended by batch, read as the last checkpoint per document."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.select("doc_id", "seq", "checkpoint").write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).groupBy("doc_id").agg(F.max("seq").alias("seq"), F.max_by("checkpoint", "seq").alias("checkpoint"))


def run_once(stream: DataFrame, sink, checkpoint: str) -> None:
    """All that is there now, in micro-batches, to the sink; then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
