import pytest
from pyspark.sql import functions as F

from tagweave.llm.codes import canonical_code


@pytest.mark.parametrize(
    "reading, value, complete",
    [
        ("122018-LK-S-00003888-2", "122018-LK-S-00003888-2", True),
        ("l220l8_lk~5.OOO0388B - |", "122018-LK-S-00003888-1", True),
        ("]C1121018-PM-R-00032948-2", "121018-PM-R-00032948-2", True),
        ("QR:121018-DZ-M-00012939-2/1", "121018-DZ-M-00012939-2/1", True),
        ("121018DZM00012939-2/0", "121018-DZ-M-00012939-2", True),
        ("121018-5I-B-00012939-12/1.", "121018-SI-B-00012939-12/1", True),
        ("122218-DZ-M-00017245-", "122218-DZ-M-00017245", False),
        ("122918-QN-S-000393", "122918-QN-S-000393", False),
        ("121018-DZ-M-00012939-2/", "121018-DZ-M-00012939-2", False),
        ("121018-DZ-M-00012939-" + "7" * 60, "121018-DZ-M-00012939-" + "7" * 60, True),
        ("???", "", False),
    ],
)
def test_canonical(spark, reading, value, complete):
    got = spark.createDataFrame([(reading,)], "c string").select(canonical_code(F.col("c")).alias("p")).first()["p"]
    assert tuple(got) == (value, complete)


@pytest.mark.parametrize("reading", [None, "", " \t\n", " "])
def test_canonical_of_blank(spark, reading):
    assert spark.createDataFrame([(reading,)], "c string").select(canonical_code(F.col("c")).alias("p")).first()["p"] is None
