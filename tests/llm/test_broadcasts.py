"""No join broadcasts rows by a size that Spark takes for far less than it is: all probes of a search, or stored rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.llm import simhash

DOCS = "doc_id long, text string, lang string, source string"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture
def copies(spark):
    """200 texts, each in 100 rows, without ids: the rows' fingerprints are stored in a few bytes."""
    return spark.range(0, 20_000, 1, 1).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.xxhash64(F.floor(F.col("id") / 100), F.lit(k)) for k in range(12))).alias("text")
    )


def test_probes_are_not_broadcast(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 400)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, d, replace=False))) for b in base[:60] for d in (1, 2, 3, 4)]
    fps = np.array(sorted({*map(int, base), *near}), np.int64)
    # As in the query: classes come from a shuffle, whose size Spark knows.
    classes = spark.createDataFrame([(int(x),) for x in fps for _ in range(2)], "fp long").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    found = simhash.links(classes)
    bits = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64))
    want = {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero((bits > 0) & (bits <= 3))) if fps[i] < fps[j]}
    got = [(r.a, r.b) for r in found.collect()]
    assert want and set(got) == want and len(got) == len(want)
    assert "Broadcast" not in plan_of(found)


def test_rows_are_not_broadcast(copies):
    found = simhash.near_duplicates(copies)
    assert found.select("fp").distinct().count() == 200 and found.filter("is_kept").count() == 20_000
    for df in (found, found.filter("is_kept")):
        assert "SortMergeJoin" in next(line for line in plan_of(df).splitlines() if "Join" in line)  # the join that rows take part in


def test_stored_edges_are_not_broadcast(spark, monkeypatch):
    kind, seen = type(spark.range(1)), []
    is_empty = kind.isEmpty
    monkeypatch.setattr(kind, "isEmpty", lambda df: (seen.append(df), is_empty(df))[1])
    dense = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    edges = spark.createDataFrame(dense + dense[:50] + [(100, 101), (102, 101), (102, 103)], "a long, b long")
    got = sorted((r.node, r.root) for r in simhash.components(edges).collect())
    assert got == [(i, 0) for i in range(40)] + [(i, 100) for i in range(100, 104)]
    assert seen and not any("Broadcast" in plan_of(df) for df in seen)


def test_pipeline_stage_does_not_broadcast_probes(spark, monkeypatch):
    """The stage of the pipeline finds its links by the same join, and leaves one row of each component."""
    import corpus_pipeline

    plans, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: (plans.append(links(*a, **b)), plans[-1])[1])
    words = [f"term{i}" for i in range(200)]
    rows = [(k, " ".join(words[:k] + ["other"] + words[k:]), "en", "a") for k in range(20)] + [(90, "nothing of that kind", "en", "a")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    left = {r.doc_id for r in kept.collect()}
    fps = {r.doc_id: r.fp for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    groups = dict.fromkeys(fps)
    for i in sorted(fps):
        if groups[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                groups[j] = i
                todo += [x for x in fps if groups[x] is None and bin((fps[j] ^ fps[x]) & (2**64 - 1)).count("1") <= 3]
    assert left == set(groups.values()) and len(left) < len(rows)
    assert plans and not any("Broadcast" in plan_of(df) for df in plans)
