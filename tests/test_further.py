import random

from tracemill.operators import graph, similarity


def test_spanning_forest(spark):
    rng = random.Random(4)
    e = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", f"e{k:02d}", float(rng.randrange(1, 4))) for k in range(26)] + [("x", "y", "e99", 1.0), (None, "x", "e98", 1.0), ("x", "x", "e97", 0.5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    want = set()
    for a, b, name, w in sorted((r for r in e if r[0]), key=lambda r: (r[3], r[2])):
        if top(a) != top(b):
            up[top(a)] = top(b)
            want.add(name)
    df = spark.createDataFrame(e, "from_node string, to_node string, name string, w double")
    assert {r["name"] for r in graph.spanning_forest(df, "w", "name").collect()} == want


def test_paths_lead_back(spark):
    rng = random.Random(6)
    e = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", float(rng.randrange(1, 5))) for _ in range(24)]
    df = spark.createDataFrame(e, "from_node string, to_node string, w double")
    far = graph.shortest_distances(df, spark.createDataFrame([("n0",)], "source string"), "w")
    tree = {r["node"]: (r["distance"], r["via"]) for r in graph.path_tree(far, df, "w").collect()}
    cost = {}
    for a, b, w in e:
        for x, y in ((a, b), (b, a)):
            cost[x, y] = min(cost.get((x, y), 1e9), w)
    for node, (distance, via) in tree.items():
        assert (via is None) == (node == "n0") and (via is None or abs(tree[via][0] + cost[via, node] - distance) < 1e-9)


def test_near_codes_finds_every_pair(spark):
    rng = random.Random(2)
    base = [[rng.randrange(2) for _ in range(64)] for _ in range(4)]
    codes = []
    for k in range(40):
        c = list(rng.choice(base))
        for p in rng.sample(range(64), rng.randrange(9)):
            c[p] ^= 1
        codes.append((k, "".join(map(str, c))))
    codes += [(90, codes[0][1]), (91, codes[0][1]), (92, None)]
    near = lambda a, b: sum(x != y for x, y in zip(a, b))
    lead = {}
    for k, c in codes:
        if c:
            lead.setdefault(c, k)
    want = {(lead[c], k, 0) for k, c in codes if c and lead[c] != k}
    want |= {(min(a, b), max(a, b), near(x, y)) for x, a in lead.items() for y, b in lead.items() if a < b and near(x, y) <= 7}
    got = {tuple(r) for r in similarity.near_codes(spark.createDataFrame(codes, "id int, code string"), 7).collect()}
    assert got == want


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 3)
    rng = random.Random(1)
    v = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(30)] + [(30, [0.0] * 5), (31, None)]
    df = spark.createDataFrame(v, "vec_id int, embedding array<double>")
    q = df.filter("vec_id % 3 = 0 and embedding is not null").selectExpr("vec_id as query_id", "embedding as query")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    want = {(k, i, n + 1) for k, x in v if k % 3 == 0 and k < 30 for n, (_, i) in enumerate(sorted((-cos(x, y), i) for i, y in v[:30] if i != k)[:2])}
    assert {(r["query_id"], r["vec_id"], r["place"]) for r in similarity.nearest_vectors(df, q, 2).collect()} == want
