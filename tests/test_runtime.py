import glob
import time

import pytest
from pyspark.sql import functions as F
from textloom import runtime


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with runtime.scratch(spark):
        a = runtime.materialize(spark.range(5), "gone")
        b = runtime.materialize(a.filter("id > 1"), "stays", keep=True)
        assert a.count() == 5
    names = [p.rsplit("/", 1)[1].split("-")[1] for p in glob.glob(f"{runtime.shared_dir(spark)}/textloom-*")]
    assert "gone" not in names and b.count() == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Cluster)


def test_what_a_table_shuffled_goes_with_its_write(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}
    before = shuffled()
    table = runtime.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartitionByRange(3, "k"), "shuffled")
    kept = shuffled() - before
    assert table.count() == 7
    for _ in range(50):
        if not (left := kept & shuffled()):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
