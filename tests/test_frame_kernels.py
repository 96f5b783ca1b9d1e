"""Frames are judged where their points are packed: no shuffle and no join after that."""

import re

import numpy as np
import pandas as pd

from pathweave.operators import filters as flt
from pathweave.operators import neighbours
from pathweave.operators.neighbours import knn
from pathweave.plans import load_all

XYZ = ["xu", "yu", "zu"]


def test_largest_component_is_told_in_the_kernel(spark, sf_dir):
    text = load_all()["a22_largest_component"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, below = text.split("MapInPandas", 1)
    assert not re.search("Exchange|Join", above) and "Exchange" not in below[: below.index("- Generate")]


def test_votes_of_frames_equal_plain_rules():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 60, (40, 12, 3)).astype(float)
    p[::2, :3] += 900
    p[5, 0, 0], p[7, :, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        label, ok = flt.frame_components(neighbours.squared_distances([p[:, :, a] for a in range(3)]), 4, 1.5)
        for f in range(len(p)):
            d = np.sqrt(((p[f][:, None] - p[f][None]) ** 2).sum(axis=2))
            np.fill_diagonal(d, np.inf)
            score = np.sort(d, axis=1)[:, :4].mean(axis=1)
            s = np.sort(score[np.isfinite(score)])
            assert ok[f] == (len(s) > 0)
            if not len(s):
                continue
            med = s[(len(s) - 1) // 2]
            mad = np.sort(np.abs(s - med))[(len(s) - 1) // 2]
            linked = d <= (med + 1.5 * 1.4826 * mad if mad > 1e-12 else s.mean() + 1.5 * (s.std() + 1e-12))
            want = list(range(12))
            for _ in want:
                want = [min([want[i], *(want[j] for j in np.flatnonzero(linked[i]))]) for i in range(12)]
            assert label[f].tolist() == want


def test_no_large_group_costs_no_join(spark):
    pdf = pd.DataFrame(np.random.default_rng(1).integers(0, 99, (60, 3)), columns=XYZ).assign(g=[0, 1] * 30, point_id=range(60))
    got = knn(spark.createDataFrame(pdf), ["g"], "point_id", XYZ, 3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 60
