"""Every registered spatial query against its brute-force SQL."""

import numpy as np
import pytest

from tessera import catalogue, catalogue_hierarchies  # noqa: F401
from tessera.functions import kernels as K
from tessera.sources import fixtures as fx


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).fetch_df() if hasattr(duck, "fetch_df") else duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_push_out_matches_one_probe_after_another(spark, data):
    """The one query that SQL cannot express: each push moves a probe before its next triangle."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"capsule_push_out"}
    tri = np.array(sorted(fx.triangles(spark, data).collect()))
    corners = [tri[:, 1 + 3 * k : 4 + 3 * k] for k in range(3)]
    low, high = np.min(corners, 0), np.max(corners, 0)
    got = {r.probe_id: r for r in catalogue.QUERIES["capsule_push_out"](spark, data).collect()}
    probes = fx.spheres(spark, data).collect()
    assert len(got) == len(probes)
    for row in probes[::9]:
        p, q, n, at = np.array([row.px, row.py, row.pz]), np.array([row.px, row.py, row.pz + 0.1]), 0, 0
        while True:
            near = at + np.flatnonzero(((np.minimum(p, q) - row.r <= high[at:]) & (low[at:] <= np.maximum(p, q) + row.r)).all(1))
            for i in near:
                s = [c[i : i + 1] for c in corners]
                pairs = [K.segment_segment(s[e], s[(e + 1) % 3], p[None], q[None]) for e in range(3)] + [(K.closest_on_triangle(x[None], *s), x[None]) for x in (p, q)]
                gaps = [float(np.sqrt(K.dot(x - y, x - y))[0]) for x, y in pairs]
                k = int(np.argmin(gaps))
                if 0 < gaps[k] < row.r:
                    move = (pairs[k][1] - pairs[k][0])[0] / gaps[k] * (row.r - gaps[k])
                    p, q, n, at = p + move, q + move, n + 1, i + 1
                    break
            else:
                break
        r = got[row.sphere_id]
        assert r.n_hits == n and np.allclose([r.px, r.py, r.pz, r.qx, r.qy, r.qz], [*p, *q], atol=1e-9), row.sphere_id
    assert max(r.n_hits for r in got.values()) > 3
