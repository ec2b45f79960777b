"""Stripping looks at a text's ends: same white space as the pattern that it was, and no time for blanks within."""

import time

from pyspark.sql import functions as F

from filingloom.functions.text import strip


def test_same_as_the_pattern(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace() or c in (0x180E, 0x200B, 0x85, 0xFEFF)]
    texts = [None, "", " ", "a", "é", "　", " \n", *(f"{c}a{c}b\n {c}" for c in spaces), *(c * 3 for c in spaces), " \x00x\x00 ", "\U0001f600 \xa0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("ours"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("theirs"))
    for r in df.collect():
        assert r.ours == r.theirs, repr(r.t)


def test_long_blanks_within(spark):
    """A run of 20,000 blanks amid each of 40 texts: a pattern tried at each of them takes the square of that."""
    df = spark.range(40).select(F.concat(F.lit(" a"), F.repeat(F.lit(" "), 20_000), F.col("id").cast("string"), F.lit("b ")).alias("t"))
    began = time.time()
    assert df.select(F.length(strip(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 10 * 20_003 + 30 * 20_004
    assert time.time() - began < 10
