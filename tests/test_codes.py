import pytest
from pyspark.sql import functions as F

from tagweave.functions.codes import parse_code


@pytest.mark.parametrize(
    "code, want",
    [
        ("110825-VA-M-000547-2", ("110825", "VA", "M", "000547", 2, 0)),
        ("110825-VA-M-000547-2/3", ("110825", "VA", "M", "000547", 2, 3)),
        ("  110825-VA-M-000547-2\n", ("110825", "VA", "M", "000547", 2, 0)),
        ("110825-va-M-000547-2", None),
        ("110825-VA-M-000547", None),
        ("", None),
        (None, None),
        ("110825-VA-M-00000000000000000547-2", ("110825", "VA", "M", "00000000000000000547", 2, 0)),
        ("110825-VA-M-1-99999999999999999999", ("110825", "VA", "M", "1", None, 0)),
    ],
)
def test_parse(spark, code, want):
    got = spark.createDataFrame([(code,)], "c string").select(parse_code(F.col("c")).alias("p")).first()["p"]
    assert (tuple(got) if got else None) == want


def test_parse_without_strip(spark):
    got = spark.createDataFrame([(" 110825-VA-M-000547-2",)], "c string").select(parse_code(F.col("c"), False).alias("p")).first()["p"]
    assert got is None
