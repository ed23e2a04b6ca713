"""Training positions of the mix against numeric integration of the schedules."""

import hashlib
from itertools import groupby

import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from flowlens.llm import mixing, runtime


def _integrated(knots, n=200_000):
    """Training times and the share of the demand due by each, by the trapezoid rule."""
    t = np.linspace(0, 1, n + 1)
    y = np.interp(t, np.linspace(0, 1, len(knots)), knots)
    area = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2 / n)])
    return t, area / area[-1]


def test_positions_follow_the_integrated_schedules(spark):
    rows = {r.doc_id: r for r in E.queries()["op7_mix_sources"](spark, SF_SMALL).collect()}
    source = {r.doc_id: r.source for r in runtime.documents(spark, SF_SMALL, "doc_id", "source").collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    seen = 0
    by_source = lambda i: (source[i] is None, source[i] or "")
    for _, ids in groupby(sorted(rows, key=lambda i: (by_source(i), hashlib.md5(str(i).encode()).hexdigest())), key=by_source):
        before = 0
        for i in ids:
            r, tier = rows[i], names.index(source[i]) % 3
            whole = int(r.target)
            if r.taken:
                share = (before + min(r["size"], whole - before) / 2) / whole
                t, area = _integrated(mixing.SCHEDULES[tier])
                assert r.position == pytest.approx(np.interp(share, area, t), abs=1e-6)
                seen += 1
            else:
                assert r.position is None
            before += r["size"]
    assert seen > 50
