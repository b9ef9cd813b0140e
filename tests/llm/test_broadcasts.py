"""What near and exact duplicates leave to the driver: tables that a count shows to be small, and nothing by Spark's own estimate."""

import random

import pytest

from tidemark.llm import exact, near
from tidemark.llm.storing import stored
from tests.llm.test_operators import brute_components, texts_of


@pytest.fixture
def docs(spark):
    """Copies with own changes, half of them too far from each other, chains, equal texts, and rows without id or words."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base)), (None, " ".join(base)), (1, " ".join(base)), (2, ""), (3, None), (0, "another text of the same id")]
    for i in range(10, 90):
        own = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3])):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(1000 + i, " ".join(chain[4 * i: 4 * i + 60])) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture
def planned(monkeypatch):
    """The plans of all stored tables, by name, when no table counts as small."""
    plans = {}

    def seen(df, name):
        plans.setdefault(name, []).append(plan(df))
        return stored(df, name)

    for module in (near, exact):
        monkeypatch.setattr(module, "stored", seen)
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    return plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(plans, out):
    return [name for name, found in [*plans.items(), ("result", [plan(out)])] for p in found if "Broadcast" in p]


def test_near_stage_of_the_pipeline_broadcasts_only_what_is_counted(docs, planned):
    rows = texts_of(docs)
    keep = {k for (_, k), _, _, kept in brute_components(rows, 5) if kept}
    out = near.deduplicate(docs)
    assert broadcasts(planned, out) == []
    assert sorted(texts_of(out), key=repr) == sorted(((k, t) for k, t in rows if k is None or k in keep), key=repr)


def test_exact_stage_of_the_pipeline_broadcasts_only_what_is_counted(docs, planned):
    first = {}
    for k, t in sorted(texts_of(docs), key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(t, k)
    out = exact.deduplicate(docs)
    assert broadcasts(planned, out) == []
    assert sorted(texts_of(out)) == sorted((k, t) for t, k in first.items())


def test_links_broadcast_only_what_is_counted(docs, planned):
    out = near.links(docs, words=4)
    assert {"members", "links", "stars", "open", "gathered"} <= set(planned)
    assert broadcasts(planned, out) == []
    got = sorted((((r["doc_id"] is not None, r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=repr)
    assert got == sorted(brute_components(texts_of(docs), 4), key=repr)
