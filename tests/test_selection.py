"""Growing dictionaries against full refits, statistics that are read off, and the one-call fit."""

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions.hermite import dictionary, total_degrees
from skerry.operators import scorematch, solvers
from skerry.operators.ranks import hash_halves, hash_parts, rank_gaussianize
from skerry.plans import diagnostics, selection


@pytest.fixture(scope="module")
def bent(spark):
    rng = np.random.default_rng(12)
    w = rng.standard_normal((3000, 3))
    w[:, 1] = 0.8 * (w[:, 0] ** 2 - 1) / math.sqrt(2) + 0.6 * w[:, 1]
    w[:, 2] = 0.5 * w[:, 2] * w[:, 0] + 0.8 * w[:, 2]
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(w)], "id bigint, a double, b double, c double").repartition(3).cache()


def test_enrichment_is_a_full_refit_each_time(bent):
    pool, start = dictionary(3, 4, 3), dictionary(3, 2, 1)
    _, folds = selection.fold_statistics(bent, ["a", "b", "c"], "id", pool)
    got = selection.enrich(folds[0], folds[1], pool, start, 0.01)
    place = {t: k for k, t in enumerate(pool)}
    weight = 0.01 * total_degrees(pool).astype(float) ** 2

    def refit(terms):
        at = [place[t] for t in terms]
        h = folds[0].A[np.ix_(at, at)] + np.diag(weight[at])
        theta = np.linalg.solve(h, folds[0].b[at])
        cost = 0.5 * theta @ h @ theta - folds[0].b[at] @ theta
        return theta, cost, 0.5 * theta @ folds[1].A[np.ix_(at, at)] @ theta - folds[1].b[at] @ theta

    terms = list(start)
    assert len(got.steps) >= 3
    for step in got.steps:
        tried = [t for t in pool if t in selection.admissible(terms, pool)]
        risks = [refit([*terms, t])[2] for t in tried]
        assert step["term"] == tried[int(np.argmin(risks))] and step["tried"] == len(tried)
        assert math.isclose(step["risk"], min(risks), abs_tol=1e-10)
        assert math.isclose(step["gain"], refit(terms)[1] - refit([*terms, step["term"]])[1], abs_tol=1e-10)
        terms.append(step["term"])
    assert terms == got.terms and np.allclose(got.theta, refit(terms)[0])
    assert got.stopped == "no gain" and min(refit([*terms, t])[2] for t in selection.admissible(terms, pool)) >= refit(terms)[2]
    at = [place[t] for t in terms]
    assert np.allclose(got.root @ got.root.T, folds[0].A[np.ix_(at, at)] + np.diag(weight[at]))
    assert ((0, 1), (2, 1)) in terms  # the bend
    few = selection.enrich(folds[0], folds[1], pool, start, 0.01, most_bytes=8 * 5**2)
    assert len(few.terms) == 5 and few.stopped == "bytes"
    assert selection.enrich(folds[0], folds[1], start, start, 0.01).stopped == "no term left"


def test_admissible_terms():
    pool = dictionary(2, 4, 2)
    first = selection.admissible([], pool)
    assert first == [((0,), (2,)), ((1,), (2,)), ((0, 1), (1, 1))]
    assert ((0, 1), (2, 1)) in selection.admissible([((0,), (2,)), ((0, 1), (1, 1))], pool)
    assert ((0, 1), (2, 1)) not in selection.admissible([((0, 1), (1, 1))], pool)


def test_risks_read_off_are_those_of_each_dictionary(bent):
    """Each candidate by a pass of its own, halves ranked apart by themselves."""
    candidates = [(2, 2, False), (3, 2, False), (4, 2, True)]
    got = selection.heldout_risks(bent, ["a", "b", "c"], "id", candidates)
    halves = hash_halves(bent.select("id", "a", "b", "c"), "id")
    parts = [rank_gaussianize(halves.where(F.col("fold") == k), ["a", "b", "c"]).select("a_z", "b_z", "c_z") for k in (0, 1)]
    for c in candidates:
        terms = dictionary(3, c[0], c[1], even=c[2])
        first, second = (scorematch.statistics(p, ["a_z", "b_z", "c_z"], terms)[0] for p in parts)
        assert math.isclose(got[c][0], solvers.heldout_risk(solvers.ridge(first, terms).theta, second), rel_tol=1e-9)


def test_one_call(bent):
    model, report = selection.fit_selected(bent, ["a", "b", "c"], "id", 2, [(2, 2, False), (3, 2, False)], [(2, 2), (4, 2)], points=1 << 12)
    chosen = {r["stage"]: r["candidate"] for r in report if r["selected"]}
    assert chosen[1] == "(3, 2, False)" and len(report) == 4 and all(math.isfinite(r["risk"]) for r in report)
    assert (model.degree, model.order) == (3, 2) and str((model.inner_degree, model.inner_order)) == chosen[2]
    assert all(min(x["risk"] for x in report if x["stage"] == k) == next(x["risk"] for x in report if x["stage"] == k and x["selected"]) for k in (1, 2))  # one split
    assert math.isfinite(model.evaluate(bent).agg(F.avg("log_density")).first()[0])


def test_parts_leave_rows_in_place(spark):
    """No row is moved, places are those in the order of the hash, and rows that the key doesn't tell apart are split, too."""
    rows = [(k, None if k % 50 == 0 else f"k{k}") for k in range(1001)]
    df = spark.createDataFrame(rows, "row int, key string").repartition(7)
    got = hash_parts(df, "key", [4, 2], "part", 3)
    order = sorted(rows, key=lambda r: (r[1] is not None, hashlib.md5(f"{r[1]}-3".encode()).hexdigest() if r[1] else ""))
    place = {k: i + 1 for i, (k, _) in enumerate(order)}
    assert {r.row: r.part for r in got.collect()} == {k: (place[k] > 250) + (place[k] > 500) for k in place}
    plain = spark.range(3000).withColumn("v", F.col("id") * 2)
    assert "Exchange" not in hash_halves(plain, "id")._jdf.queryExecution().executedPlan().toString()
    for n, same in ((0, 1), (1, 1), (2, 1), (7, 1), (40, 40), (41, 30)):
        folds = hash_halves(spark.createDataFrame([(max(k, same - 1),) for k in range(n)], "k int"), "k").groupBy("fold").count().collect()
        assert {r["fold"]: r["count"] for r in folds} == {f: c for f, c in ((0, n // 2), (1, n - n // 2)) if c}


def test_transferred_ranks_are_a_row_a_query(spark):
    """Also where a key is on two rows or missing; rows with a value that isn't finite have none."""
    pool = spark.createDataFrame([(k, float(k % 7), float(k)) for k in range(20)] + [(20, float("nan"), None)], "id int, a double, b double")
    asked = spark.createDataFrame([(1, 3.0, 4.5), (1, 6.0, 4.5), (None, -1.0, 90.0), (2, float("nan"), 1.0), (3, 1.0, None), (4, 1.0, float("inf"))], "id int, a double, b double")
    got = sorted(tuple(r) for r in diagnostics.transfer_ranks(pool, asked, ["a", "b"], "id").fillna(-1, ["id"]).collect())
    at = lambda k: NormalDist().inv_cdf(min(20, max(1, k)) / 21)
    want = sorted([(1, at(12), at(5)), (1, at(20), at(5)), (-1, at(0), at(20))])
    assert len(got) == 3 and all(g[0] == w[0] and np.allclose(g[1:], w[1:], atol=1e-6) for g, w in zip(got, want, strict=True))
