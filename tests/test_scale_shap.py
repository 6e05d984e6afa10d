"""Work per row of the attributions."""

import numpy as np

from propel.ml import shap
from test_scale_boosting import grown


def test_patterns_are_worked_out_once_per_path(monkeypatch):
    m, bins = grown()
    paths = [p for t in m.trees for p in shap.leaf_paths(t)]
    monkeypatch.setattr(shap, "TABLE_FEATURES", 0)
    want = shap.contributions(paths, bins, 6)                   # pattern by pattern of the batch
    monkeypatch.undo()
    known = shap.tables(paths)
    monkeypatch.setattr(shap, "weights", None)                  # rows need no more weights
    assert np.abs(shap.contributions(paths, bins, 6, known) - want).max() < 1e-12
