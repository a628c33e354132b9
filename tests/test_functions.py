import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo, prob, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_match_surface_fixed_points(spark):
    for (t, km), expected in {(0, 0): 1.0, (120, 0): 0.0, (0, 2): 0.0, (120, 2): 0.5701997087974952, (121, 0): 0.0, (0, 2.01): 0.0}.items():
        assert value(spark, prob.match(F.lit(float(t)), F.lit(float(km)))) == pytest.approx(expected, abs=1e-12)


def test_transition_surface(spark):
    assert value(spark, prob.transition(F.lit(-1.0), F.lit(0.0))) == 0
    assert value(spark, prob.transition(F.lit(0.0), F.lit(0.0))) == 1
    assert value(spark, prob.transition(F.lit(551.0), F.lit(7.0))) == pytest.approx(math.exp(-4))
    assert value(spark, prob.transition(F.lit(None).cast("double"), F.lit(1.0))) == 1
    assert value(spark, prob.log(F.lit(0.0))) == pytest.approx(-690.7755278982137)


def test_haversine_and_destination_agree(spark):
    lat, lon = geo.destination(F.lit(29.0), F.lit(-90.0), F.lit(37.0), F.lit(5000.0))
    assert value(spark, geo.haversine(F.lit(29.0), F.lit(-90.0), lat, lon)) == pytest.approx(5.0 * 6371.0088 / 6371.0, abs=1e-9)
    assert value(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371.0088)


def test_segment_distance(spark):
    d, t = geo.to_segment(F.lit(-1.0), F.lit(1.0), F.lit(3.0), F.lit(1.0))
    assert value(spark, d) == pytest.approx(1) and value(spark, t) == pytest.approx(0.25)
    d, t = geo.to_segment(F.lit(3.0), F.lit(4.0), F.lit(3.0), F.lit(4.0))
    assert value(spark, d) == 5 and value(spark, t) == 0


def test_mcnemar_cases():
    assert stats.mcnemar(0, 0) == {"n10": 0, "n01": 0, "statistic": 0.0, "p_value": 1.0, "method": "exact"}
    assert stats.mcnemar(4, 20)["p_value"] == pytest.approx(2 * sum(math.comb(24, k) for k in range(5)) / 2**24)
    m = stats.mcnemar(5, 20)
    assert m["method"] == "chi2" and m["statistic"] == pytest.approx(14**2 / 25) and m["p_value"] == pytest.approx(math.erfc(math.sqrt(14**2 / 50)))


def test_t_tails():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07338803477074039, rel=1e-9)
    assert stats.t_tail(1.0, 1) == pytest.approx(0.5)
    assert stats.t_tail(2.0, 10, "greater") + stats.t_tail(2.0, 10, "less") == pytest.approx(1)
    assert stats.t_tail(1.959963984540054, 1e7) == pytest.approx(0.05, rel=1e-5)
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 40), rng.normal(0.5, 2, 60)
    t, df, p = stats.welch(40, a.mean(), a.var(ddof=1), 60, b.mean(), b.var(ddof=1))
    assert 40 < df < 98 and 0 < p < 1 and t < 0
    assert math.isnan(stats.paired(1, 0.0, 1.0)[2])
