"""The jobs: two runs over growing input, reruns, failures between a batch and its commit, odd rows, and the command line."""

import json
import math
import subprocess
import sys
from pathlib import Path
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import common, copula_scores, queries, stream_fit

REPO = Path(__file__).resolve().parent.parent


def content(folder):
    """Rows of a written table, whatever its files."""
    return sorted(duckdb.sql(f"SELECT * FROM read_parquet('{folder}/*/*.parquet', hive_partitioning = true)").fetchall(), key=str)


SAMPLE = "part string, x double, y double, extra string"
FIT = {"group": "part", "columns": {"u": "x", "v": "y - 1"}, "degree": 3, "order": 2, "strength": 0.001, "files_per_batch": 2}


def sample(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = 1 + 0.6 * x + 0.8 * rng.normal(size=n)
    rows = [(["a", "b", None][k % 3], float(x[k]), float(y[k]), "e") for k in range(n)]
    return [*rows, ("a", None, 1.0, ""), ("b", float("nan"), 1.0, ""), (None, float("inf"), 0.0, ""), ("only odd", None, None, None), rows[0]]


def add(spark, rows, path, files):
    spark.createDataFrame(rows, SAMPLE).repartition(files).write.mode("append").parquet(str(path))


def plain_fit(rows):
    """theta by group from all rows at once, with derivatives by hand."""
    from skerry.functions.hermite import dictionary
    from skerry.operators.scorematch import block_sums

    terms, out = dictionary(2, 3, 2), {}
    for g in {r[0] for r in rows}:
        z = np.array([(x, y - 1) for p, x, y, _ in rows if p == g and x is not None and y is not None and math.isfinite(x) and math.isfinite(y)])
        if len(z):
            A, b, _ = block_sums(z, terms)
            out[g] = (len(z), np.linalg.solve(A / len(z) + 0.001 * np.eye(len(terms)), b / len(z)))
    return out


def same_fit(folder, rows):
    got = {}
    for term, n, theta, group in content(folder):
        got.setdefault(group, []).append((n, theta))
    want = plain_fit(rows)
    assert got.keys() == want.keys()
    for g, (n, theta) in want.items():
        assert {x[0] for x in got[g]} == {n} and np.allclose(sorted(x[1] for x in got[g]), sorted(theta), atol=1e-9)


def test_stream_takes_what_is_new(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    first, second = sample(1, 400), sample(2, 250)
    add(spark, first, source, 3)
    assert stream_fit.run(spark, source, target, marks, FIT)["new_rows"] == len(first)
    same_fit(f"{target}/fit", first)
    before = content(f"{target}/sums")
    add(spark, second, source, 2)
    assert stream_fit.run(spark, source, target, marks, FIT)["new_rows"] == len(second)  # none of the first rows again
    same_fit(f"{target}/fit", first + second)
    after = content(f"{target}/sums")
    assert [r for r in after if r in before] == before and len(after) > len(before)
    fitted = content(f"{target}/fit")
    assert stream_fit.run(spark, source, target, marks, FIT)["new_rows"] == 0
    assert content(f"{target}/sums") == after and content(f"{target}/fit") == fitted


def test_batch_that_comes_again(spark, tmp_path):
    """A failure after a batch was written and before it was committed: the batch overwrites itself."""
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    rows = sample(3, 200)
    add(spark, rows, source, 5)
    stream_fit.run(spark, source, target, marks, FIT)
    sums = content(f"{target}/sums")
    last = max((tmp_path / "marks" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (last, last.with_name(f".{last.name}.crc")):
        file.unlink()
    assert stream_fit.run(spark, source, target, marks, FIT)["new_rows"] > 0
    assert content(f"{target}/sums") == sums
    same_fit(f"{target}/fit", rows)


def test_stream_without_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], SAMPLE).write.parquet(source)
    assert stream_fit.run(spark, source, str(tmp_path / "out"), str(tmp_path / "marks"), FIT) == {"new_rows": 0, "fit": 0}


def plain_scores(rows, measures):
    """log_copula by row: ranks by sorting, numpy for the rest."""
    out = [None] * len(rows)
    for g in {r[1] for r in rows}:
        mine = [k for k, r in enumerate(rows) if r[1] == g]
        z = np.full((len(mine), measures), np.nan)
        for c in range(measures):
            v = [rows[k][2 + c] for k in mine]
            ok = sorted(x for x in v if x is not None and math.isfinite(x))
            for i, x in enumerate(v):
                if x is not None and math.isfinite(x):
                    place = (np.searchsorted(ok, x) + np.searchsorted(ok, x, "right") + 1) / 2
                    z[i, c] = NormalDist().inv_cdf(place / (len(ok) + 1))
        whole = z[np.isfinite(z).all(1)]
        with np.errstate(all="ignore"):
            r = np.nan_to_num(np.corrcoef(whole.T)) if len(whole) > 1 else np.eye(measures)
        np.fill_diagonal(r, 1)
        if np.linalg.eigvalsh(r)[0] > 1e-9:
            for i, k in enumerate(mine):
                if np.isfinite(z[i]).all():
                    out[k] = -0.5 * np.linalg.slogdet(r)[1] - 0.5 * z[i] @ (np.linalg.inv(r) - np.eye(measures)) @ z[i]
    return out


def test_scores_of_odd_groups(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        x, g = float(rng.normal()), [None, "a", "constant", "follows", "2024"][k % 5]
        y = 7.0 if g == "constant" else 2 * x if g == "follows" else x + float(rng.integers(0, 3))
        rows.append((k, g, x, y, float(rng.normal()), "clash"))
    rows += [(None, "a", 0.1, 0.2, 0.3, ""), (400, "a", None, 1.0, 1.0, ""), (401, "a", float("nan"), 1.0, 1.0, ""), (402, "alone", 1.0, 1.0, 1.0, ""), rows[1], (403, None, None, None, None, None)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "id bigint, g string, x double, y double, w double, log_copula string").write.parquet(source)
    config = {"key": "id", "group": "g", "measures": {"one": "x", "two": "y", "three": "w"}}
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        assert copula_scores.run(spark, source, target, config) == {"scores": len(rows), "groups": 6}
        once = content(f"{target}/scores"), content(f"{target}/groups")
        copula_scores.run(spark, source, target, config)
        assert (content(f"{target}/scores"), content(f"{target}/groups")) == once
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"  # put back
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    got = spark.read.schema("id bigint, log_copula double, g string").parquet(f"{target}/scores").collect()
    want = plain_scores(rows, 3)
    shown = lambda v: None if v is None else round(v, 7)
    assert sorted(((r.id, r.g, shown(r.log_copula)) for r in got), key=str) == sorted(((r[0], r[1], shown(v)) for r, v in zip(rows, want, strict=True)), key=str)
    groups = {r.g: r for r in spark.read.schema("n bigint, complete bigint, mean_log_copula double, g string").parquet(f"{target}/groups").collect()}
    assert groups["a"].n == 84 and groups["a"].complete == 82 and groups["follows"].mean_log_copula is None and groups["alone"].mean_log_copula == 0
    spark.createDataFrame(rows, "id bigint, g string, x double, y double, w double, log_copula string").limit(0).write.parquet(f"{source}-empty")
    assert copula_scores.run(spark, f"{source}-empty", target, config) == {"scores": 0, "groups": 0}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_match_their_sql(spark, name, tmp_path):
    texts = [(k, ["en", "de", "fr"][k % 3], "word. " * (k % 17 + 1) + "long" * (k * 7 % 23)) for k in range(200)]
    spark.createDataFrame(texts, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [("AN"[k % 2], float(k % 50), 900.0 * (k % 70) + k % 50) for k in range(300)]
    spark.createDataFrame(lines, "l_returnflag string, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_command_line(spark, tmp_path):
    """A session of its own, ended at its end; the config is a file."""
    rows = sample(9, 60)
    add(spark, rows, tmp_path / "in", 2)
    (tmp_path / "fit.json").write_text(json.dumps(FIT))
    args = ["--input", tmp_path / "in", "--output", tmp_path / "out", "--checkpoint", tmp_path / "marks", "--config", tmp_path / "fit.json"]
    env = {"PYTHONPATH": str(REPO), "SPARK_LOCAL_IP": "127.0.0.1"}
    import os

    done = subprocess.run([sys.executable, "-m", "jobs.stream_fit", *map(str, args)], cwd=REPO, env=os.environ | env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"{len(rows)} new rows" in done.stderr and "wrote" in done.stderr
    same_fit(tmp_path / "out" / "fit", rows)


def test_settings_come_back(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), common.settings(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get(key) == "3" and spark.range(10).groupBy((F.col("id") % 2).alias("k")).count().count() == 2
        raise KeyError
    assert spark.conf.get(key) == before
