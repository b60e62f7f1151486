"""Learning queries train with the published settings, not with a few trees."""

import pytest

from tidewatch.catalog import learning
from tidewatch.config import TrainingConfig


class Asked(Exception):
    pass


def _refuse(df, tie_break, config=None, *rest):
    raise Asked(config)


def _asked(monkeypatch, function, run):
    monkeypatch.setattr(learning, "features", lambda spark, folder: None)
    monkeypatch.setattr(learning.studies, function, _refuse)
    with pytest.raises(Asked) as found:
        run()
    return found.value.args[0]


def test_the_model_has_all_its_trees(spark, monkeypatch):
    asked = _asked(monkeypatch, "train_risk_model", lambda: learning.trained(spark, "nowhere"))
    assert asked == TrainingConfig() and asked.booster.trees == 500


@pytest.mark.parametrize(("function", "query"), [("walk_forward", learning.walk_forward_backtest), ("feature_ablation", learning.feature_ablation)])
def test_the_studies_fit_whole_models(spark, monkeypatch, function, query):
    assert _asked(monkeypatch, function, lambda: query(spark, "nowhere")) == TrainingConfig()
