"""Targets against repeated resharing, and sampling against a plain sort."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skerry.llm.mixing import ORACLE_SQL, mix, targets

SCHEMA = "doc_id bigint, source string, text string, size string"


def reshare(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def corpus():
    rng = random.Random(7)
    rows = []
    for k in range(900):
        source = rng.choice(["b", "b", "b", "b", "a", "é", "Z", None, "", "tiny"] if k else ["tiny"])
        if source == "tiny" and rng.random() < 0.9:
            source = "b"
        rows.append((k, source, " ".join(["w#"] * rng.randint(0, 40)), "x"))
    return [*rows, rows[3], (None, "b", "null id", ""), (901, "a", None, ""), (902, "void", "", ""), (903, "é", "long " * 3000, "")]


def test_targets_are_reshared(spark):
    sizes = {"b": 4000, "a": 10, None: 7, "é": 300, "": 900, "void": 0}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"), 1.5, 2.0).collect()}
    want = reshare(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-5) for s in want)


@pytest.mark.parametrize("slices", [1 << 14, 3])
def test_near_targets_and_same_as_sql(spark, slices):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix(df, slices=slices)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(map(tuple, mix(df.orderBy(F.desc("doc_id")), slices=slices).collect()), key=str)
    sizes = {s: sum(len((t or "").split()) for _, x, t, _ in rows if x == s) for s in {r[1] for r in rows}}
    want = reshare(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r[5] == s]
        longest = max(r[1] for r in mine)
        assert abs(sum(r[4] for r in mine) - want[s]) <= longest / 2 + 1e-6
        assert all(r[2] == size and math.isclose(r[3], want[s], abs_tol=1e-5) and 0 <= r[4] <= 2 * r[1] for r in mine)
    documents = df.toArrow()  # noqa: F841  read by name below
    if slices > 3:
        again = duckdb.sql(ORACLE_SQL).fetchall()
        assert got == sorted(again, key=str)


def test_weights_and_empty(spark):
    rows = [(k, "s", "w " * 10, "") for k in range(2000)] + [(k, "t", "w " * 1000, "") for k in range(3000, 3020)]
    out = mix(spark.createDataFrame(rows, SCHEMA), share=0.5, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).where("source = 's'")
    picked = {r.k: r.n for r in out.where("taken > 0").groupBy((F.col("doc_id") % 2).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert picked.get(0, 0) > 1.3 * picked.get(1, 1)
    assert not mix(spark.createDataFrame([], SCHEMA)).collect()
