import hashlib
import math

import numpy as np
import pytest

from pathweave.plans.sampling import noise_augmentation


def number(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def unit(*parts) -> float:
    return number(*parts) / 2**32


def normal(*parts) -> float:
    return math.sqrt(-2 * math.log(max(unit(*parts, 1), 1e-12))) * math.cos(2 * math.pi * unit(*parts, 2))


def augmented(rows):
    """The same noise said row by row: {(demo, t, point): (slot, x, y, z)}."""
    demos = {d: sorted({p for e, _, p, *_ in rows if e == d}) for d in {r[0] for r in rows}}
    noisy = {}
    for d, points in demos.items():
        for p in points:
            walk = [0.0] * 3
            for _, t, _, *xyz in sorted(r for r in rows if r[0] == d and r[2] == p):
                out = []
                for i, a in enumerate("xyz"):
                    walk[i] += 2 * normal(d, p, t, f"drift{a}")
                    add = 50 * normal(d, f"shift{a}") + 20 * normal(d, p, f"bias{a}") + walk[i] + 5 * normal(d, t, p, f"jitter{a}")
                    add += 5000 * normal(d, p, f"big{a}") if unit(d, p, "outlier", 0) < 0.02 else 0.0
                    out.append(min(max(xyz[i] + add, -100000.0), 100000.0))
                noisy[d, t, p] = out
    want = {}
    for d, points in demos.items():
        kept = [p for p in points if unit(d, p, "drop", 0) >= 0.1]
        place = {p: i for i, p in enumerate(sorted(points, key=lambda p: (number(d, p, "perm", 0), p)))}
        for e, t, p, *_ in rows:
            if e == d:
                source = p if p in kept or not kept else kept[number(d, p, "donor", 0) % len(kept)]
                want[d, t, p] = (place[p], *noisy[d, t, source])
    return want


@pytest.fixture()
def given(spark):
    rng = np.random.default_rng(1)
    rows = [(d, t, p, *(100_000 if p % 9 == 0 else int(x) for x in rng.integers(0, 90_000, 3))) for d in range(3) for t in range(4) for p in range(60)]

    class Tracks:
        def tracks(self):
            return spark.createDataFrame(rows, "demo_id bigint, t int, point_id bigint, xu bigint, yu bigint, zu bigint").repartition(5)

    return rows, Tracks()


def test_noise_equals_the_rule_said_row_by_row(given):
    rows, tracks = given
    got = {(r.demo_id, r.t, r.point_id): (r.slot, r.x, r.y, r.z) for r in noise_augmentation(tracks).collect()}
    want = augmented(rows)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key][0] == row[0]
        np.testing.assert_allclose(got[key][1:], row[1:], atol=2e-6)
    # the case holds what it is about: copied tracks, outliers, clipped coordinates
    tracks_of = {(d, p) for d, _, p, *_ in rows}
    assert any(unit(d, p, "drop", 0) < 0.1 for d, p in tracks_of) and any(unit(d, p, "outlier", 0) < 0.02 for d, p in tracks_of)
    assert any(100000.0 in row[1:] for row in want.values())
