import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions.tails import correlation_p, normal_tail
from gaugeflow.operators import compare


def student(rho, n, parts=20_000):
    """Two-sided p by Simpson's rule over the angle, where Student's density is a power of the cosine."""
    df = n - 2
    t = abs(rho) * math.sqrt(df / (1 - rho * rho))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    top, f = math.atan(t / math.sqrt(df)), lambda u: math.cos(u) ** (df - 1)
    h = top / parts
    return 1 - 2 * scale * h / 3 * sum(f(i * h) * (1 if i in (0, parts) else 4 if i % 2 else 2) for i in range(parts + 1))


def test_correlation_p_equals_a_numeric_integral(spark):
    cases = [(r, n) for n in (3, 4, 5, 8, 12, 33, 100, 700, 1001, 1002, 1003, 5000, 40_000) for r in (1e-6, 0.003, 0.02, 0.1, -0.35, 0.7, -0.95)]
    got = spark.createDataFrame(cases, "r double, n long").select("r", "n", correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for x in got:
        assert x["p"] == pytest.approx(student(x["r"], x["n"]), abs=2e-9), (x["r"], x["n"])


def test_correlation_p_at_the_ends(spark):
    rows = [(None, 9), (0.5, 2), (1.0, 9), (-1.0, 3), (0.0, 7), (0.01, 4_000_000_000)]
    got = [r["p"] for r in spark.createDataFrame(rows, "r double, n long").coalesce(1).select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[:5] == [None, None, 0.0, 0.0, 1.0] and got[5] < 1e-300


def test_normal_tail(spark):
    z = [0.0, 0.1, 1.0, 1.96, 2.9999, 3.0, 3.5, 6.0, 12.0]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in z], "z double").coalesce(1).select(normal_tail(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(x / math.sqrt(2)) / 2 for x in z], rel=1e-9)


def patterns(values, alternative):
    """All sign patterns of the nonzero differences' average ranks."""
    d = [v for v in values if v]
    size = sorted(abs(v) for v in d)
    ranks = [sum(i + 1 for i, s in enumerate(size) if s == abs(v)) / size.count(abs(v)) for v in d]
    up, down = (sum(r for r, v in zip(ranks, d, strict=True) if (v > 0) == side) for side in (True, False))
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    if alternative == "two-sided":
        return min(up, down), min(1.0, 2 * sum(x <= min(up, down) for x in sums) / len(sums))
    return up, sum(x >= up if alternative == "greater" else x <= up for x in sums) / len(sums)


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_signed_ranks_equal_all_patterns(spark, alternative):
    g = random.Random(8)
    groups = {f"g{i}": [float(g.randint(-4, 6)) for _ in range(g.randint(2, 12))] for i in range(12)} | {"zero": [0.0, 0.0, 0.0], "one": [3.0], "none": [None, None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, delta double")
    for r in compare.wilcoxon(df, ["g"], alternative=alternative).collect():
        values = [v for v in groups[r["g"]] if v is not None]
        assert r["n"] == len(values)
        if len(values) < 2:
            assert (r["statistic"], r["p"], r["effect"], r["significant"]) == (None,) * 4 and r["error"].startswith("at least 2")
            continue
        w, p = patterns(values, alternative) if any(values) else (0.0, 1.0)
        assert r["statistic"] == w and r["p"] == pytest.approx(p) and r["significant"] == int(p < 0.05) and r["error"] is None
        assert r["effect"] == pytest.approx(1 - 2 * w / (len(values) * (len(values) + 1) / 2) if any(values) else 0.0)


def test_fifty_exact_and_sixty_normal_ranks_agree(spark):
    g = random.Random(2)
    df = spark.createDataFrame([("a", g.gauss(0.2, 1)) for _ in range(50)] + [("b", g.gauss(0.2, 1)) for _ in range(60)], "g string, delta double")
    exact = {r["g"]: r["p"] for r in compare.wilcoxon(df, ["g"], most_exact=60).collect()}
    normal = {r["g"]: r["p"] for r in compare.wilcoxon(df, ["g"], most_exact=0).collect()}
    assert all(abs(exact[k] - normal[k]) < 0.01 for k in exact)
    assert {r["g"]: r["p"] for r in compare.wilcoxon(df, ["g"]).collect()} == {"a": exact["a"], "b": normal["b"]}


def test_deltas_carry_members_and_p_from_six_pairs_on(spark):
    rows = [("six", f"n{i}", 0.1 * (i + 1)) for i in range(6)] + [("five", f"n{i}", 0.1 * (i + 1)) for i in range(5)] + [("two", "n1", 1.0), ("two", "n2", 1.0)]
    got = {r["arm"]: r for r in compare.paired_deltas(spark.createDataFrame(rows, "arm string, network_id string, delta double"), ["arm"], member="network_id").collect()}
    assert set(got) == {"six", "five"} and got["six"]["p"] == pytest.approx(2 / 64) and got["five"]["p"] is None
    assert [tuple(x) for x in got["six"]["deltas"]] == [(f"n{i}", 0.1 * (i + 1)) for i in range(6)]


def test_values_that_change_by_a_digit_still_meet_their_ranks(spark):
    """Means may differ in their last digit from one computation to the next."""
    wobble = F.udf(lambda v: v * (1 + random.random() * 1e-13), "double").asNondeterministic()
    df = spark.createDataFrame([("f", float(i), float((i * 7) % 10)) for i in range(1, 11)], "family string, a double, b double")
    known = compare.spearman(df, ["family"], "a", "b").first()
    got = compare.spearman(df.select("family", wobble("a").alias("a"), wobble("b").alias("b")), ["family"], "a", "b").first()
    assert (got["n"], got["rho"]) == (10, pytest.approx(known["rho"], abs=1e-12))
