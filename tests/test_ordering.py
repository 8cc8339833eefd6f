import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.operators.ordering import average_ranks, number_rows, quantiles, running_max, running_sum


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    # One group holds most rows; values repeat.
    pdf = pd.DataFrame({"id": np.arange(3000), "g": np.where(rng.random(3000) < 0.7, "hot", rng.integers(0, 20, 3000).astype(str)),
                        "v": rng.integers(0, 40, 3000) / 4.0, "w": rng.integers(1, 9, 3000)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_number_rows(frame, limit):
    pdf, df = frame
    got = number_rows(df, ["g"], ["v", F.desc("id")], "n", limit).toPandas().set_index("id").n.sort_index()
    want = pdf.sort_values(["g", "v", "id"], ascending=[True, True, False]).assign(
        n=lambda d: d.groupby("g").cumcount()).set_index("id").n.sort_index()
    assert (got == want).all()
    total = number_rows(df, [], ["v", "id"], "n", limit).toPandas().sort_values("n")
    assert total.n.tolist() == list(range(3000))
    assert total.id.tolist() == pdf.sort_values(["v", "id"]).id.tolist()


@pytest.mark.parametrize("limit", [0, 10**6])
def test_running_sum(frame, limit):
    pdf, df = frame
    got = running_sum(df, ["g"], ["v", "id"], "w", "s", limit).toPandas().set_index("id").s.sort_index()
    want = pdf.sort_values(["g", "v", "id"]).assign(s=lambda d: d.groupby("g").w.cumsum()).set_index("id").s.sort_index()
    assert (got == want).all()


@pytest.mark.parametrize("limit", [0, 200, 10**6])
def test_quantiles(frame, limit):
    pdf, df = frame
    wanted = {"a": 0.1, "b": 0.5, "c": 0.95, "d": 1.0}
    got = quantiles(df, ["g"], "v", wanted, limit).toPandas().set_index("g").sort_index()
    for name, p in wanted.items():
        want = pdf.groupby("g").v.quantile(p).sort_index()
        assert np.allclose(got[name], want)
    one = quantiles(df, [], "v", {"m": 0.3}, limit).first()["m"]
    assert one == pytest.approx(np.quantile(pdf.v, 0.3))


def test_quantiles_of_uneven_values(spark):
    """Values over many powers of ten, infinite ones, a null group, and no range exchange in the plan."""
    rng = np.random.default_rng(1)
    v = np.r_[10.0 ** rng.uniform(-12, 12, 400) * rng.choice([-1, 1], 400), [np.inf, -np.inf, 1.7e308, -1.7e308], np.full(50, 0.25)]
    rows = [(g, float(x)) for g in ("a", None) for x in v] + [("b", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
    result = quantiles(df, ["g"], "v", wanted, 10)
    got = {r.g: r for r in result.collect()}
    s, n = np.sort(v), len(v)
    for name, p in wanted.items():
        at = p * (n - 1)
        lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
        want = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
        assert got["a"][name] == got[None][name] == pytest.approx(want, rel=1e-12)
    assert got["b"].mid == 3.0 and "rangepartitioning" not in result._jdf.queryExecution().toString()


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (1, 10.0), (1, 2.0), (2, None)], "g int, v double")
    for limit in (0, 100):
        rows = quantiles(df, ["g"], "v", {"q": 0.95}, limit).collect()
        assert [(r.g, round(r.q, 6)) for r in rows] == [(1, 9.2)]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_average_ranks(frame, limit):
    pdf, df = frame
    got = average_ranks(df, ["g"], "v", "r", limit).toPandas().set_index("id").r.sort_index()
    assert np.allclose(got, pdf.groupby("g").v.rank().to_numpy())


def test_running_max_by_slices(spark):
    rows = [(i % 3, i, None if i % 4 == 0 else (i * 37) % 50) for i in range(120)]
    df = spark.createDataFrame(rows, "g long, i long, v long").withColumn("s", F.when(F.col("v").isNotNull(), F.struct("v", "i")))
    one, many = ({(r.g, r.i): r.m for r in running_max(df, ["g"], ["i"], "s", "m", n).collect()} for n in (1000, 0))
    assert one == many and len(one) == 120
    assert one[(1, 118)].v == max(v for g, _, v in rows if g == 1 and v is not None)
