import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from commitscope.functions.scans import after_sum_and_max, running_count, running_last, running_sum


def _data(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), s, rnd.choice([None, None, "x", "y", "z"]), rnd.randint(0, 3))
            for s in rnd.sample(range(200), 120)]
    return spark.createDataFrame(rows, "k string, seq long, v string, n long")


def test_running_helpers_match_windows_across_buckets(spark):
    df = _data(spark)
    w_incl = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    w_excl = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    w_rev = Window.partitionBy("k").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    expect = df.select(
        "k", "seq",
        F.coalesce(F.sum("n").over(w_incl), F.lit(0)).alias("s_in"),
        F.coalesce(F.sum("n").over(w_excl), F.lit(0)).alias("s_ex"),
        F.last("v", ignorenulls=True).over(w_incl).alias("l_in"),
        F.last("v", ignorenulls=True).over(w_excl).alias("l_ex"),
        F.first("v", ignorenulls=True).over(w_rev).alias("l_rev"),
        (F.row_number().over(Window.partitionBy("k").orderBy("seq")) - 1).alias("pos"))
    got = running_sum(df, ["k"], ["seq"], "n", "s_in", width=7)
    got = running_sum(got, ["k"], ["seq"], "n", "s_ex", width=7, inclusive=False)
    got = running_last(got, ["k"], ["seq"], "v", "l_in", width=7)
    got = running_last(got, ["k"], ["seq"], "v", "l_ex", width=7, inclusive=False)
    got = running_last(got, ["k"], ["seq"], "v", "l_rev", width=7, reverse=True)
    got = running_count(got, ["k"], ["seq"], "pos", width=7)
    cols = ["k", "seq", "s_in", "s_ex", "l_in", "l_ex", "l_rev", "pos"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, expect.select(*cols).collect()))


def test_sum_and_max_of_what_comes_after(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), s, rnd.choice([0, 1, 1]), rnd.choice([None, s])) for s in range(120)]
    df = spark.createDataFrame(rows, "k string, seq long, n long, m long").repartition(3)
    for width in (7, 1_000):
        got = {r.seq: (r.n, r.m) for r in after_sum_and_max(df, ["k"], ["seq"], "n", "m", width).collect()}
        assert len(got) == len(rows)
        for k, s, _, _ in rows:
            later = [r for r in rows if r[0] == k and k is not None and r[1] > s]
            assert got[s] == (sum(r[2] for r in later), max((r[3] for r in later if r[3] is not None), default=None))
