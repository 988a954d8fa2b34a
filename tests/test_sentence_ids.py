"""Sentence ids of any length of number."""

from pyspark.sql import functions as F

from attestra.operators import corpus


def test_numbers_beyond_four_digits_stay_whole(spark):
    d = spark.createDataFrame([("a", 7), ("a", 9_999), ("a", 10_000), ("a", 1_234_567), (None, 1), ("a", None)], "ref_id string, n long")
    got = [r[0] for r in d.select(corpus.sent_id(F.col("ref_id"), F.col("n"))).collect()]
    assert got == ["a::chunk-0007", "a::chunk-9999", "a::chunk-10000", "a::chunk-1234567", None, None]
