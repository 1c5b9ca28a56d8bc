"""Connected components: against a plain search, and the size of the plans that the driver makes for them."""

import random

import pytest

from tempora.llm import shared
from tempora.llm.components import components


def _plain(edges):
    up = {}

    def root(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted((n, root(n)) for n in up)


@pytest.fixture
def leaves(monkeypatch):
    """The scans of each plan that is written."""
    out, write = [], shared.written

    def written(df, kind="table"):
        out.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, kind)

    monkeypatch.setattr(shared, "written", written)
    return out


_rng = random.Random(8)
_path = _rng.sample(range(60), 60)


@pytest.mark.parametrize("edges", [list(zip(_path, _path[1:])), [(700, i) for i in range(1, 500)], [(_rng.randrange(300), _rng.randrange(300)) for _ in range(220)], [(-5, 3), (3, -5), (3, 7), (9, 9)]])
def test_components(spark, leaves, edges):
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.root) for r in got) == _plain(edges)
    assert max(leaves) <= 4


def test_components_that_are_stars_take_no_round(spark, leaves):
    edges = [(2 * i, 2 * i + 1) for i in range(20)] + [(100, i) for i in range(101, 400)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.root) for r in got) == _plain(edges)
    assert len(leaves) == 1
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_pipeline_plans_of_near_duplicates_stay_small(spark, leaves):
    import corpus_pipeline

    text = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*text[:20], f"x{i}", *text[21:]] if i % 2 else text), "en", "s", 1) for i in range(5)] + [(9, "another text", "en", "s", 1)]
    kept = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9]
    assert max(leaves) <= 20
