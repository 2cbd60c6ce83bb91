"""Choice of dictionary by held-out score-matching risk, admission by predicted memory, and dictionaries that grow."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.hermite import Index, dictionary, total_degrees
from skerry.operators import solvers
from skerry.operators.ranks import hash_halves, rank_gaussianize
from skerry.operators.scorematch import Stats, score_moments, statistics
from skerry.operators.subspace import top_eigenvectors
from skerry.operators.weights import one_standard_error
from skerry.plans.diagnostics import restrict
from skerry.plans.models import ReducedDensity, project
from skerry.plans.storage import settle

#: Published candidate grids, fixed values: (degree, order, even) and (degree, order).
STAGE_1 = ((4, 2, False), (4, 3, False), (4, 4, False), (4, 3, True), (4, 4, True))
STAGE_2 = ((4, 3), (5, 3), (6, 3), (5, 4), (6, 4))


def _terms(d: int, candidate: tuple, linear: bool) -> list:
    degree, order, *even = candidate
    return dictionary(d, degree, order, linear, bool(even and even[0]))


def candidate_table(spark: SparkSession, candidates: list[tuple], d: int, linear: bool = False) -> DataFrame:
    """place, candidate (its text), size (terms of its dictionary) and gram_bytes of each candidate."""
    rows = [(k, str(c), len(_terms(d, c, linear))) for k, c in enumerate(candidates)]
    return spark.createDataFrame(rows, "place int, candidate string, size bigint").withColumn("gram_bytes", 8.0 * F.col("size") ** 2)


def within_memory(table: DataFrame, most_bytes: float | None) -> DataFrame:
    """The candidates whose gram fits; where none does, the one with the fewest terms."""
    if most_bytes is None:
        return table
    fits = F.col("gram_bytes") <= most_bytes
    least = table.agg(F.bool_or(fits).alias("any_"), F.min_by("place", F.struct("size", "place")).alias("least_"))
    return table.crossJoin(F.broadcast(least)).where(F.when(F.col("any_"), fits).otherwise(F.col("place") == F.col("least_"))).drop("any_", "least_")  # one row


def fold_statistics(df: DataFrame, columns: list[str], key: str, terms: list[Index], seed: int = 0) -> tuple[DataFrame, dict[int, Stats]]:
    """The rows in halves by key, as normal scores of their ranks in their half, and the statistics of both halves over all
    terms: one pass over the scores, whatever the number of dictionaries that are read off it."""
    halves = hash_halves(df.select(key, *columns), key, seed)
    ranked = settle(rank_gaussianize(halves, columns, group=["fold"]).select("fold", *(f"{c}_z" for c in columns)))
    return ranked, statistics(ranked, [f"{c}_z" for c in columns], terms, fold="fold")


def _union(dictionaries: list[list[Index]]) -> list[Index]:
    return list(dict.fromkeys(t for terms in dictionaries for t in terms))


def _read_off(folds: dict[int, Stats], union: list[Index], dictionaries: dict[tuple, list[Index]]) -> dict[tuple, float]:
    """Risk on fold 1 of the ridge fit on fold 0, for each candidate's dictionary, from the statistics of all terms."""
    out = {}
    for c, terms in dictionaries.items():
        first, second = (restrict(folds[k], union, terms) for k in (0, 1))
        out[c] = solvers.heldout_risk(solvers.ridge(first, terms).theta, second)
    return out


def heldout_risks(df: DataFrame, columns: list[str], key: str, candidates: list[tuple], splits: int = 1, seed: int = 0, linear: bool = False) -> dict[tuple, list[float]]:
    """Risk on one half of the ridge fit on the other, halves ranked apart; one pass a split."""
    dictionaries = {c: _terms(len(columns), c, linear) for c in candidates}
    union, risks = _union(list(dictionaries.values())), {c: [] for c in candidates}
    for s in range(splits):
        found = _read_off(fold_statistics(df, columns, key, union, seed + s)[1], union, dictionaries)
        for c in candidates:
            risks[c].append(found[c])
    return risks


def reduced_risks(df: DataFrame, columns: list[str], key: str, r: int, first: tuple, candidates: list[tuple], splits: int = 1, seed: int = 1) -> dict[tuple, list[float]]:
    """The same for dictionaries over r projections of the scores: the subspace is that of the first stage's fit on half 0, so
    half 1 has no part in it. Three passes a split."""
    z, u = [f"{c}_z" for c in columns], [f"u{j}" for j in range(r)]
    outer, dictionaries = _terms(len(columns), first, False), {c: dictionary(r, *c) for c in candidates}
    union, risks = _union(list(dictionaries.values())), {c: [] for c in candidates}
    for s in range(splits):
        ranked, folds = fold_statistics(df, columns, key, outer, seed + s)
        theta = solvers.ridge(folds[0], outer).theta
        V = top_eigenvectors(score_moments(ranked.where("fold = 0").select(*z), z, outer, theta).C, r)[1]
        found = _read_off(statistics(project(ranked, z, V, u).select("fold", *u), u, union, fold="fold"), union, dictionaries)
        for c in candidates:
            risks[c].append(found[c])
    return risks


def _chosen(spark: SparkSession, table: DataFrame, risks: dict[tuple, list[float]], candidates: list[tuple]) -> tuple:
    rows = spark.createDataFrame([(str(c), float(v)) for c, vs in risks.items() for v in vs], "candidate string, risk double")
    return candidates[one_standard_error(rows.join(table, "candidate"), "candidate", "risk", "size", "place").first().place]


def _admitted(spark: SparkSession, candidates: list[tuple], d: int, most_bytes: float | None, linear: bool = False) -> tuple[DataFrame, list[tuple]]:
    table = within_memory(candidate_table(spark, candidates, d, linear), most_bytes)
    return table, [candidates[row.place] for row in table.orderBy("place").select("place").collect()]


def select(df: DataFrame, columns: list[str], key: str, candidates: list[tuple] = STAGE_1, splits: int = 1, most_bytes: float | None = None, linear: bool = False) -> tuple:
    """The candidate that the one-standard-error rule takes among those whose gram fits."""
    table, kept = _admitted(df.sparkSession, candidates, len(columns), most_bytes, linear)
    return _chosen(df.sparkSession, table, heldout_risks(df, columns, key, kept, splits, linear=linear), candidates)


def fit_selected(df: DataFrame, columns: list[str], key: str, r: int, stage_1: list[tuple] = STAGE_1, stage_2: list[tuple] = STAGE_2, splits: int = 1, most_bytes: float | None = None, **model) -> tuple[ReducedDensity, list[dict]]:
    """The estimator on all rows with the dictionaries that held-out halves of the rows choose, first for the subspace and then, in
    it, for the potential. The report has a row a stage and candidate: stage, candidate, risk (mean over splits), selected.

    model: further arguments of ReducedDensity.
    """
    spark = df.sparkSession
    table, kept = _admitted(spark, stage_1, len(columns), most_bytes)
    outer = heldout_risks(df, columns, key, kept, splits)
    first = _chosen(spark, table, outer, stage_1)
    table, kept = _admitted(spark, stage_2, r, most_bytes)
    inner = reduced_risks(df, columns, key, r, first, kept, splits)
    second = _chosen(spark, table, inner, stage_2)
    report = [{"stage": k, "candidate": str(c), "risk": sum(v) / len(v), "selected": c == best} for k, risks, best in ((1, outer, first), (2, inner, second)) for c, v in risks.items()]
    fitted = ReducedDensity(columns, r, degree=first[0], order=first[1], even=first[2], inner_degree=second[0], inner_order=second[1], **model).fit(df, key)
    return fitted, report


@dataclass
class Enriched:
    """A dictionary that grew: its terms, their coefficients, the Cholesky factor of the quadratic, and a row a step."""

    terms: list[Index]
    theta: np.ndarray
    root: np.ndarray
    steps: list[dict]
    stopped: str = ""


def admissible(terms: list[Index], pool: list[Index]) -> list[Index]:
    """Terms of the pool that aren't in yet and whose neighbours with one degree less are all in, or are of degree below two."""
    have, out = set(terms), []
    for support, degrees in pool:
        if (support, degrees) in have:
            continue
        below = []
        for k in range(len(support)):
            less = [(s, g - (j == k)) for j, (s, g) in enumerate(zip(support, degrees, strict=True)) if g - (j == k) > 0]
            below.append((tuple(s for s, _ in less), tuple(g for _, g in less)))
        if all(sum(g) < 2 or (s, g) in have for s, g in below):
            out.append((support, degrees))
    return out


def enrich(fit: Stats, held: Stats, pool: list[Index], start: list[Index], strength: float, tolerance: float = 0.0, most_bytes: float = 2e9) -> Enriched:
    """Terms of the pool, one at a time, that lower the risk on the held-out statistics most, ties to the first in the pool; until none
    lowers it by more than the tolerance or the gram would pass the bytes.

    The quadratic is A + strength |alpha|^2, so a larger dictionary's restricts to the smaller one's and its Cholesky factor is
    only extended: a term costs a triangular solve, and all terms that may come next are tried in one. No pass over the data:
    both statistics are of the whole pool.
    """
    place = {t: k for k, t in enumerate(pool)}
    weight = strength * total_degrees(pool).astype(float) ** 2
    at = [place[t] for t in start]
    root = np.linalg.cholesky(fit.A[np.ix_(at, at)] + np.diag(weight[at]))
    theta = np.linalg.solve(root.T, np.linalg.solve(root, fit.b[at]))

    def risk(x: np.ndarray, on: list[int]) -> float:
        return float(0.5 * x @ held.A[np.ix_(on, on)] @ x - held.b[on] @ x)

    now, out = risk(theta, at), Enriched(list(start), theta, root, [])
    while True:
        asked = [place[t] for t in admissible([pool[k] for k in at], pool)]
        if not asked:
            out.stopped = "no term left"
            break
        if 8.0 * (len(at) + 1) ** 2 > most_bytes:
            out.stopped = "bytes"
            break
        across = np.linalg.solve(root, fit.A[np.ix_(at, asked)])  # a column a term
        own = fit.A[asked, asked] + weight[asked] - (across**2).sum(0)
        rest = fit.b[asked] - fit.A[np.ix_(asked, at)] @ theta
        new = rest / own
        moved = theta[:, None] - np.linalg.solve(root.T, across) * new
        # the held-out risk of all of them: quadratic in the old part, the new coefficient and both
        risks = 0.5 * (moved * (held.A[np.ix_(at, at)] @ moved)).sum(0) - held.b[at] @ moved
        risks += new * (held.A[np.ix_(asked, at)] * moved.T).sum(1) + 0.5 * new**2 * held.A[asked, asked] - held.b[asked] * new
        best = int(np.argmin(risks))
        if now - risks[best] <= tolerance:
            out.stopped = "no gain"
            break
        root = np.block([[root, np.zeros((len(at), 1))], [across[:, best][None], np.sqrt(own[best]).reshape(1, 1)]])
        at, theta = [*at, asked[best]], np.append(moved[:, best], new[best])
        out.steps.append({"term": pool[asked[best]], "gain": float(0.5 * rest[best] ** 2 / own[best]), "risk": float(risks[best]), "tried": len(asked)})
        now = float(risks[best])
    out.terms, out.theta, out.root = [pool[k] for k in at], theta, root
    return out
