import random
import re

import numpy as np
import pytest

from tidelog.llm import embeddings, jaccard, queries, shared


def brute_sets(rows, n):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute_components(ids, linked):
    up = {i: i for i in ids if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def brute_jaccard(rows, n, percent):
    sets = brute_sets(rows, n)
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None
             and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    up = brute_components([r[0] for r in rows], pairs)
    return sorted(repr((r[0], len(s), up.get(r[0]))) for r, s in zip(rows, sets))


def copies(rng, n, words, changes, extra=()):
    """Texts, many of them copies of others with some words changed, cut off or repeated."""
    made = lambda: [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 6, 12, 30, 80]))]
    texts = [made() for _ in range(n // 4)]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.choice(changes)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice(words)], [t[k], rng.choice(words)]]) or t[k : k + 1]
        texts.append(t + list(rng.choice([(), *extra])))
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("n, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 80, 3)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, seed):
    rng = random.Random(seed)
    for name, value in {"BLOCK": 5, "TILE": 8, "WIDE": 3, "LEAF": 4, "QUERIES": 3, "PAIRS": 10, "SAMPLE": 2, "HOT": 4}.items():
        monkeypatch.setattr(jaccard, name, value)
    words = [f"w{k}" for k in range(60)]
    passage = tuple(f"p{k}" for k in range(20))
    texts = copies(rng, 260, words, [0, 1, 1, 2, 3, 6, 10], [passage])
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "W1  w2\tW3"), (2004, "w1 w2 w3"), (None, texts[0]), (2005, texts[0]), (2005, texts[0]), (2006, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS sig", "4 AS comp").repartition(3)
    out = jaccard.jaccard_components(docs, n=n, percent=percent).collect()
    assert sorted(repr((r.id, r.n_shingles, r.component_id)) for r in out) == brute_jaccard(rows, n, percent)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(docs).count() == 0


def test_no_pair_misses_all_signatures():
    rng, sizes, met = np.random.default_rng(1), jaccard.Sizes(85), 0
    for _ in range(4000):
        a = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 120), dtype=np.uint64))
        drop, add = rng.integers(0, len(a) // 6 + 1), rng.integers(0, len(a) // 6 + 1)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 64, add, dtype=np.uint64)]))
        if sizes.links(a, b):
            met += 1
            assert len(np.intersect1d(jaccard.signatures(a, sizes), jaccard.signatures(b, sizes)))
    assert met > 1000


def test_tree_leaves_out_only_what_cannot_link():
    rng, sizes = np.random.default_rng(2), jaccard.Sizes(80)
    base = [np.unique(rng.integers(0, 1 << 64, rng.integers(1, 90), dtype=np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[rng.integers(0, len(b) // 5 + 1):], rng.integers(0, 1 << 64, 3, dtype=np.uint64)])) for b in base for _ in range(4)]
    pts, n, comp = np.array([jaccard.points(s) for s in sets]), np.array([len(s) for s in sets]), np.arange(len(sets)) % 7
    left, right = jaccard.RTree(pts, n, comp, sizes).search(pts, n, comp)
    found = set(zip(left.tolist(), right.tolist()))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if comp[i] != comp[j] and sizes.links(a, b):
                assert (i, j) in found
            assert (i, j) not in found or comp[i] != comp[j]
    assert len(found) < len(sets) ** 2 / 4


@pytest.mark.parametrize("cut_share", [0.0, 1.0, 100.0])
def test_vectors_equal_brute_force(spark, cut_share):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    vecs = [base[rng.integers(30)] * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.3]) for _ in range(220)]
    rows = [(k * 3 % 991, v.astype(np.float32).tolist(), int(rng.integers(3))) for k, v in enumerate(vecs)]
    rows += [(k + 1000, rows[0][1], 0) for k in range(20)] + [(1100, None, 1), (1101, [0.0] * 16, 1), (1102, [float("nan")] * 16, 1), (1103, rows[1][1], None), (1103, rows[1][1], None),
             (1104, [None] * 16, 1), (1105, [], 1), (1106, [1.0, 2.0], 1), (1107, [2.0, 4.0], 1), (None, rows[1][1], 1), (1108, [-0.0, 1.0], 1), (1109, [0.0, 1.0], 1), (1110, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS tile", "3 AS id")
    check_vectors(df, rows, tile=16, cut_share=cut_share)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def check_vectors(df, rows, **settings):
    out = embeddings.near_vectors(df, **settings).collect()

    def able(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def close(a, b):
        x, y = np.array(a[1], float), np.array(b[1], float)
        return a[2] == b[2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93

    good = [k for k, r in enumerate(rows) if able(r)]
    links = [(i, j) for i in good for j in good if i != j and close(rows[i], rows[j])]
    up = brute_components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    n = [0] * len(rows)
    for i, _ in links:
        n[i] += 1
    want = sorted(repr((r[0], n[k], up.get(r[0]), r[0] is None or up[r[0]] == r[0])) for k, r in enumerate(rows))
    assert sorted(repr((r.id, r.n_links, r.component_id, r.kept)) for r in out) == want


@pytest.mark.parametrize("cut_share", [0.0, 100.0])
def test_planted_vectors_of_64_dimensions(spark, cut_share):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 64))
    vecs = [base[k % 400 if k < 400 else rng.integers(40)] + rng.standard_normal(64) * (0.0 if k < 400 else rng.choice([0.1, 0.2, 0.26, 0.3])) for k in range(700)]
    rows = [(k, v.astype(np.float32).tolist(), int(k % 5 == 0)) for k, v in enumerate(vecs)]
    # an id with several vectors joins their components
    rows += [(900, rows[1][1], 0), (900, rows[2][1], 0), (901, rows[3][1], 0), (901, None, 0), (902, (np.array(rows[4][1]) * 2.0**40).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check_vectors(df, rows, tile=64, cut_share=cut_share)


def test_cells_hold_every_pair_within_the_budget():
    rng = np.random.default_rng(5)
    x, cuts = rng.standard_normal((300, 3)), np.sort(rng.standard_normal((3, 3)), axis=1)
    home, who, where = embeddings.cells_of(x, cuts, 0.25)
    reach = set(zip(who.tolist(), where.tolist()))
    for i in range(300):
        for j in range(300):
            if home[i] != home[j] and ((x[i] - x[j]) ** 2).sum() <= 0.25:
                assert (i, home[j]) in reach
    assert len(reach) < 300 * 40


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(300, 400)] + [(3, 3), (None, 5)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    up = brute_components({x for e in real for x in e}, real)
    assert got == up


def test_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op4_jaccard(spark, sf).columns == ["doc_id", "n_shingles", "component_id"]
    assert queries.op8_embeddings(spark, sf).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_groups_join_alike_hot_or_not(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_GROUPS", 8)
    rng = random.Random(6)
    rows = [(k, rng.choice([1, 1, 1, 2, 2, 3, 4, 5, None]), rng.choice("ab")) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, h string")
    groups = shared.save(df.where("g IS NOT NULL").groupBy("g", "h").count())
    got = sorted((r.id, r.g, r.h, r["count"]) for r in shared.join_groups(df, groups, ["g", "h"], "count").collect())
    n = {}
    for _, g, h in rows:
        n[g, h] = n.get((g, h), 0) + 1
    assert max(n.values()) * 8 > len(rows) > min(n.values()) * 8 and got == sorted((k, g, h, n[g, h]) for k, g, h in rows if g)
    none = df.limit(0)
    assert shared.join_groups(none, none.groupBy("g", "h").count(), ["g", "h"], "count").count() == 0


def test_samples_of_any_share(spark):
    from pyspark.sql import functions as F

    ids = spark.range(200_000)
    count = lambda share: ids.where(shared.sampled(share, "x", F.col("id"))).count()
    assert count(1.0) == count(7.0) == 200_000 and count(0.0) == 0 and 300 < count(1 / 400) < 700


def test_a_passage_that_all_documents_share_fits_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 64)
    rng, seen = random.Random(14), []
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passage = [word() for _ in range(55)]
    rows = [(k, " ".join(passage + [word() for _ in range(14)])) for k in range(1500)]
    rows += [(2000 + k, rows[k][1] + " end") for k in range(5)]
    real = jaccard._candidates

    def watch(tiles, sizes):
        seen.append(tiles.groupBy("sig", "i", "j").count().agg({"count": "max"}).first()[0])
        return real(tiles, sizes)

    monkeypatch.setattr(jaccard, "_candidates", watch)
    out = {r.id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).collect()}
    assert out == {k: k - 2000 if k >= 2000 else k for k, _ in rows}
    assert 64 < max(seen) <= 2 * 64


def test_hubs_are_broadcast_to_their_edges(spark):
    # a star of 10,000 whose centre has the largest id, one whose centre has the smallest, and a bridge
    edges = spark.range(10_000).selectExpr("id AS a", "1000000 AS b").union(spark.range(20_000, 30_000).selectExpr("10001 AS a", "id AS b"))
    edges = edges.union(spark.createDataFrame([(5, 40_000), (40_000, 40_001)], "a long, b long"))
    out = shared.connected_components(edges)
    got = {(r.component, r.n) for r in out.groupBy("component").agg({"node": "count"}).withColumnRenamed("count(node)", "n").collect()}
    assert got == {(0, 10_003), (10_001, 10_001)}
    both = edges.union(edges.selectExpr("b", "a")).toDF("u", "v")
    plan = shared._with_least(both, "true", 20_002)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "Join Inner" in plan and "broadcast" in plan
