"""The queries that fit or draw are registered with the whole size of their operators."""

import inspect

import pytest

from fieldloom.operators import landcover
from fieldloom.plans import learning


@pytest.mark.parametrize(("query", "operator", "name", "size"), [("land_cover_forest", "forest", "trees", 100), ("emission_intervals", "emission_draws", "draws", 20_000)])
def test_registered_sizes(spark, monkeypatch, query, operator, name, size):
    f, seen = getattr(landcover, operator), []

    def spy(*args, **kwargs):
        bound = inspect.signature(f).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments[name])
        return f(*args, **kwargs)

    monkeypatch.setattr(landcover, operator, spy)
    assert getattr(learning, query)(spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [size]
