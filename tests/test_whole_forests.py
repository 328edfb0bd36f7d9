import pytest

from gaugeflow import plans
from gaugeflow.operators import detect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c3_classifier_by_arm_grid", "d1_d2_d4_d13_arm_benchmark"])
def test_forests_of_arms_have_all_their_trees(spark, monkeypatch, name):
    """200 as in fit_forest() itself."""
    seen, fit = [], detect.fit_forest
    monkeypatch.setattr(detect, "fit_forest", lambda df, features, trees=200, **b: (seen.append(trees), fit(df, features, trees=2, **b))[1])
    assert plans.queries()[name](spark, SMALL).count() > 0
    assert seen and set(seen) == {200}
