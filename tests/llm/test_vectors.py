import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import cross_polytope as A
from orrery.llm import uniform_threshold as U

ODD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16), (905, []), (906, [1.0, 2.0]), (1000, None)]


def table(spark, n=600, seed=1, copies=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 16))
    x[: n // 2] /= np.linalg.norm(x[: n // 2], axis=1, keepdims=True)
    x[n - copies :] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows + [(i, v) for i, v in ODD], "id long, v array<double>")


@pytest.mark.parametrize("copies", [0, 250])
def test_neighbours(spark, monkeypatch, copies):
    monkeypatch.setattr(A, "ROWS", 64)
    monkeypatch.setattr(A, "QUERIES", 3)
    x, df = table(spark, copies=copies)
    found = A.nearest_neighbours(df.selectExpr("*", "1 as t", "2 as size"), df.where("id % 50 = 0"), k=7)
    hits = total = 0
    by = {}
    for r in found.collect():
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 600, 50))
    for q, rows in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:7]
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 8)) and [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in rows)
        hits += len(set(order) & {r.vec_id for r in rows})
        total += 7
        if copies and q in (0, 350, 400, 450, 500, 550):
            assert [r.vec_id for r in rows] == order
    assert hits / total >= 0.9


def test_few_rows_are_all_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0])], "id long, v array<float>")
    found = A.nearest_neighbours(df, df.where("id = 0"), k=10, tables=1, plans={2: (1, 1)}).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in found] == [(2, 1.414214), (1, 2.0)]
    assert A.nearest_neighbours(df.limit(0), df).count() == 0 and A.nearest_neighbours(df, df.limit(0)).count() == 0


def distinct_nearest(ids, x, query, q, k):
    best = {}
    for i, d in zip(ids.tolist(), np.sqrt(((x - q) ** 2).sum(axis=1)).tolist(), strict=True):
        if i != query:
            best[i] = min(best.get(i, d), d)
    return sorted((d, i) for i, d in best.items())[:k]


@pytest.mark.parametrize("k", [1, 5, 10, 500])
def test_nearest_counts_an_id_once(k):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 16))
    for times in ({}, {3: 20, 7: 40}, {0: 60}, {i: 2 for i in range(200)}):
        ids = np.repeat(np.arange(200), [times.get(i, 1) for i in range(200)])
        rows = x[ids] + np.where(np.arange(len(ids)) % 2, 1e-3, 0)[:, None]
        for query in (0, 3, 7, 50):
            q = x[query]
            near, score = A.nearest(ids, rows, query, q, ((rows - q) ** 2).sum(axis=1), k)
            want = distinct_nearest(ids, rows, query, q, k)
            assert near.tolist() == [i for _, i in want] and np.allclose(score, [d for d, _ in want])


def test_repeated_rows_hide_no_neighbours(spark):
    x, _ = table(spark)
    # All rows lie near one direction, so mostly in one bucket of a table.
    x = 1e-3 * x + np.random.default_rng(2).normal(size=16)
    ids = np.concatenate([np.repeat(np.arange(600), 2), np.repeat(17, 20), np.repeat(100, 30)])
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "id long, v array<double>")
    by = {}
    for r in A.nearest_neighbours(df, df.where("id % 100 = 0").dropDuplicates(["id"])).orderBy("rank").collect():
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: [i for _, i in distinct_nearest(ids, x[ids], q, x[q], 10)] for q in range(0, 600, 100)}


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, d)) if i != q][:k]
    return out


@pytest.mark.parametrize("kind", ["table", "norms", "wide"])
def test_recall_as_the_query_runs(spark, kind):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = df.collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.v for r in rows])
    r = np.random.default_rng(3)
    if kind == "norms":
        x = (x * np.exp(r.normal(0, 0.5, (len(x), 1)))).astype(np.float32)
    elif kind == "wide":
        ids, x = ids[:600], r.normal(size=(600, 300)).astype(np.float32)
    if kind != "table":
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<float>")
    want, by = brute(ids, x.astype(float), np.flatnonzero(ids % 40 == 0), 10), {}
    for row in A.nearest_neighbours(df, df.where("id % 40 = 0")).collect():
        by.setdefault(row.query_id, set()).add(row.vec_id)
    assert sum(len(by[q] & set(near)) for q, near in want.items()) / sum(map(len, want.values())) >= 0.9


def share_looked_at(x, queries, plan, tables=8, seed=7):
    looked = np.zeros((len(queries), len(x)), bool)
    for theirs, mine in zip(A.coordinates(x, tables, plan[0], seed), A.coordinates(x[queries], tables, plan[0], seed), strict=True):
        code = A.codes(theirs)
        for i, probes in enumerate(A.probe_codes(mine, plan[1])):
            looked[i] |= np.isin(code, probes)
    return looked.mean()


def test_share_of_rows_looked_at_falls_with_their_number(spark):
    """Vectors around centres: the more rows, the nearer the neighbours, and the fewer probes meet them."""
    r, shares = np.random.default_rng(4), []
    centres = r.normal(size=(400, 64))
    for n in (1000, 8000):
        x = (centres[r.integers(0, 400, n)] + 0.6 * r.normal(size=(n, 64))).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
        plan = A.fit_index(df, df.where("id % 10 = 0"), k=10, tables=8, recall=0.97, seed=7)[64]
        shares.append(share_looked_at(x.astype(float), np.arange(0, n, 50), plan))
    assert shares[1] < 0.6 * shares[0] and shares[1] < 0.15


@pytest.mark.parametrize("depth", [1, 2])
def test_probes_are_the_best_codes(depth):
    x = np.random.default_rng(5).normal(size=(6, 16))
    own = next(A.coordinates(x, 1, depth, 7))
    sums = own[0] if depth == 1 else (own[0][:, :, None] + own[1][:, None, :]).reshape(6, -1)
    order = np.argsort(-sums, axis=1)
    assert (A.codes(own) == order[:, 0]).all() and (A.probe_codes(own, 20) == order[:, :20]).all()
    for row in range(6):
        assert A.probes_needed(own, row, order[row]).tolist() == list(range(1, sums.shape[1] + 1))


def test_hadamard():
    x = np.eye(8)
    h = A.hadamard(x)
    assert np.allclose(h @ h.T, 8 * np.eye(8)) and set(np.unique(h)) == {-1.0, 1.0}


@pytest.mark.parametrize(("lists", "copies", "k"), [(2, 0, 5), (3, 250, 5), (1, 0, 10), (2, 0, 700)])
def test_top_k(spark, monkeypatch, lists, copies, k):
    monkeypatch.setattr(A, "ROWS", 64)
    x, df = table(spark, copies=copies)
    v = np.floor(64 * x).astype(int)
    found = U.top_k(df.select("id", U.whole_numbers(df["v"], 64).alias("v")), df.where("id % 100 = 0").select("id", U.whole_numbers(df["v"], 64).alias("v")), k=k, lists=lists)
    by = {}
    for r in found.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 100))
    for q, rows in by.items():
        s = {i: int(x) for i, x in enumerate(v @ v[q]) if i != q} | {901: 0}
        order = sorted(s, key=lambda i: (-s[i], i))[:k]
        assert sorted(rows) == [(n, i, s[i]) for n, i in enumerate(order, 1)]


def test_top_k_of_awkward_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, -0.5]), (1, [3.0e15, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [0.5, -1.0]), (5, [0.5, -1.0])], "id long, v array<double>")
    whole = df.select("id", U.whole_numbers(df["v"], 1).alias("v"))
    assert [(r.vec_id, r.score) for r in U.top_k(whole, whole.where("id = 0"), k=10).orderBy("rank").collect()] == [(5, 1), (1, -1)]
    assert U.top_k(whole.limit(0), whole).count() == 0
    big = 2**53
    far = spark.createDataFrame([(0, [1, 1]), (1, [big + 3, big + 3]), (2, [big + 10, big - 4]), (3, [big - 4, big + 10])], "id long, v array<long>")
    assert [(r.vec_id, r.score) for r in U.top_k(far, far.where("id = 0"), k=1).collect()] == [(1, 2 * big + 6)]
    assert [(r.vec_id, r.score) for r in U.top_k(far, far.where("id = 0"), k=3, lists=2).orderBy("rank").collect()] == [(1, 2 * big + 6), (2, 2 * big + 6), (3, 2 * big + 6)]
    big = np.array([[2**40, 3]])
    assert U.products(big, np.array([[2**20, 5]])).tolist() == [[2**60 + 15]]


def test_rows_without_an_id_take_no_part(spark):
    rows = [(None if i % 5 == 0 else i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.where("id is null or id % 4 = 0")
    ids = {i for i, _ in rows if i is not None}
    for found in (A.nearest_neighbours(vectors, queries, k=3), U.top_k(vectors.withColumn("v", U.whole_numbers(F.col("v"), 8)), queries.withColumn("v", U.whole_numbers(F.col("v"), 8)), k=3)):
        got = found.collect()
        assert {r.query_id for r in got} == {i for i in ids if i % 4 == 0} and {r.vec_id for r in got} <= ids and len(got) == 3 * len({r.query_id for r in got})


def test_ids_over_two_to_the_53(spark):
    big = 2**60
    vectors = spark.createDataFrame([(big + i, [i, 1]) for i in range(30)], "id long, v array<long>")
    got = U.top_k(vectors, vectors.where(f"id = {big + 7}"), k=2).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, big + 29, 204), (2, big + 28, 197)]
