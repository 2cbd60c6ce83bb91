"""The prefix-tree join against all pairs."""

import random
import re

import pytest

from skerry.llm.jaccard_join import jaccard_join, link, one_of_each

SCHEMA = "doc_id bigint, text string, n_shingles string"


def brute(rows, width=5, percent=80):
    sets, up = [], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows)), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    passage = " ".join(rng.choices(words, k=40))
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            base = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(base) + 1)
                base[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
            text = " ".join(base)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(0, 90)))
            if rng.random() < 0.4:
                text += "\n" + passage.upper()
        rows.append((k * 7 % 1009, text, "x"))
    return [*rows, (None, passage, "x"), (5000, None, None), (5001, "", ""), (5002, " \t\x0b", ""), (4, rows[9][1], "again"), (5003, passage * 300, ""), rows[3]]


@pytest.mark.parametrize("block", [1000, 7])
def test_matches_all_pairs(spark, block):
    rows = corpus(block)
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA), block=block).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    out = jaccard_join(spark.createDataFrame([], SCHEMA))
    assert out.columns[:3] == ["doc_id", "n_shingles", "component_id"] and not out.collect()


def test_one_of_each(spark):
    rows = corpus(5)
    kept = [tuple(r) for r in one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = {}
    for row, (doc, n, component) in zip(sorted(rows, key=str), brute(rows), strict=True):
        assert row[0] == doc
        if n and doc is not None:
            want.setdefault(component, []).append(row)
    alone = [r for r in rows if r[0] is None or not (r[1] or "").split()]
    assert sorted(map(str, (r for r in kept if r[0] is None or not (r[1] or "").split()))) == sorted(map(str, alone))
    linked = [r for r in kept if r[0] is not None and (r[1] or "").split()]
    assert all(r in rows for r in linked) and len(set(linked)) == len(linked)
    assert len(linked) >= len(want) and all(any(r in group for r in linked) for group in want.values())


def test_link_keeps_known_labels():
    import numpy as np

    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [7, 8], [7, 9])]
    roots = link([5, 4, 2, 2], sets, [0, 1, 2, 2])
    assert roots[0] == roots[1] and roots[2] == roots[3] != roots[0]


def test_texts_beyond_a_megabyte(spark):
    """Copies and near copies of a long text, one that only a near copy is near to, and the text's first half."""
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(160_000)]
    near, far = list(words), list(words)
    for k in range(0, len(near), 60):
        near[k] = "changed"
    for k in range(0, len(far), 30):
        far[k] = "changed"
    rows = [(9, " ".join(words), ""), (4, " ".join(near), ""), (2, " ".join(far), ""), (7, " ".join(words[:80_000]), ""), (8, " ".join(words).upper(), "")]
    assert len(rows[0][1]) > 1 << 20
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r.doc_id: r.component_id for r in got} == {2: 2, 4: 2, 7: 7, 8: 2, 9: 2}  # 9 and 2 are linked through 4 alone


def near_copies(seed, n, most):
    """Sorted sets that differ from one base in up to `most` of its 200 items; replaced items may meet again."""
    import numpy as np

    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = list(range(200))
        for at in rng.sample(range(200), rng.randint(0, most)):
            base[at] = 1000 + rng.randrange(4000)
        out.append(np.array(sorted(set(base)), np.uint64))
    return out


def same_parts(roots, links):
    up = list(range(len(roots)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links:
        up[find(i)] = find(j)
    return all((roots[i] == roots[j]) == (find(i) == find(j)) for i in range(len(up)) for j in range(i))


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_links_of_the_sets_that_ask(share):
    sets = near_copies(11, 90, 60)
    rng = random.Random(2)
    asks = [rng.random() < share for _ in sets]
    held = [set(x.tolist()) for x in sets]
    links = [(i, j) for i in range(90) for j in range(90) if i != j and asks[i] and 100 * len(held[i] & held[j]) >= 80 * len(held[i] | held[j])]
    assert same_parts(link([len(x) for x in sets], sets, list(range(90)), 80, asks), links)


def test_large_group_without_links_is_not_walked_node_by_node(monkeypatch):
    """Copies that differ too much to link: a walk looks at a level of the trie at once, not at each edge."""
    import numpy as np

    sets = [x for x in near_copies(4, 900, 110) if (x >= 1000).sum() > 50][:300]
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    roots = link([len(x) for x in sets], sets, list(range(300)))
    held = [set(x.tolist()) for x in sets]
    assert same_parts(roots, [(i, j) for i in range(300) for j in range(i) if 100 * len(held[i] & held[j]) >= 80 * len(held[i] | held[j])])
    assert len(calls) < 20 * 300


def test_messages_follow_the_data_not_the_partitions(spark, monkeypatch):
    """Many shuffle partitions over few texts: no message from each shard to each of as many buckets."""
    from skerry.llm.exchange import Workspace

    seen, settle = {}, Workspace.settle

    def counted(self, df, name):
        table = settle(self, df, name)
        seen[name] = {r[0]: r[1] for r in table.groupBy("kind").count().collect()} if name in ("sketch", "lists") else None
        return table

    monkeypatch.setattr(Workspace, "settle", counted)
    rows = corpus(3, 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "320")
    try:
        got = jaccard_join(spark.createDataFrame(rows, SCHEMA).coalesce(1)).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert seen["sketch"][2] <= 20 and seen["lists"][1] <= 24 * 24
