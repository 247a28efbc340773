import random

import numpy as np
from pyspark.sql import functions as F
from speechlake.llm import near as N
from speechlake.llm.components import connected_components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = N.lowered(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = roots(ids, links)
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in ids)


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect())


def test_equals_brute_force(docs, rows):
    assert result(docs) == brute(rows)


def test_chains_of_near_copies(spark):
    """Copies of copies, each near the one before only, in shuffled order of ids."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, ids = [], list(range(1000, 1160))
    rng.shuffle(ids)
    for _ in range(4):
        w = [word() for _ in range(300)]
        for _ in range(40):
            w = list(w)
            w[rng.randrange(300)] = word()
            w[rng.randrange(300)] = word()
            rows.append((ids.pop(), " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(df) == brute(rows)


def test_awkward_empty_and_clashing(awkward, nothing):
    out = N.near_duplicates(awkward.withColumn("kept", F.lit("x"))).collect()
    assert len(out) == awkward.count()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in out)
    assert N.near_duplicates(nothing).count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    for n, m in ((40, 25), (200, 180)):
        links = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(i, i + 1) for i in range(1000, 1030)]
        out = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
        nodes = {x for e in links if e[0] != e[1] for x in e}
        assert {r["node"]: r["component"] for r in out} == roots(nodes, [e for e in links if e[0] != e[1]])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(x[:600]), np.unique(x[300:])
    s = N.signatures([a, b, np.empty(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.15 and not s[2].any()
