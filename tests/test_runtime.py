import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tagweave.runtime import checkpoint_dir, cut_lineage, is_blank, let, micros, written


def test_blank(spark):
    texts = [None, "", " \t\r\n", "  ", "﻿", "x", " x ", " x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(is_blank(F.col("t"))).collect()]
    assert got == [True] * 5 + [False] * 3


def test_micros_and_let(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 0, 1, 5),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(micros(F.col("t"))).collect()] == [1_000_005, None]
    assert spark.range(1).select(let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_checkpoints_go_to_the_folder_of_the_session(spark):
    folder = checkpoint_dir(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir() and folder
    assert "RDD" in df._jdf.queryExecution().toString()


def test_written_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1, 2], "a"), (2, None, None)], "i bigint, l array<int>, s string")
    again = written(df)
    assert again.schema == df.schema and sorted(again.collect()) == sorted(df.collect())
    assert written(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    session = SimpleNamespace(sparkContext=Context(), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError):
        checkpoint_dir(session)
