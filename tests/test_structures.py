"""Index, joins and bootstraps against brute force."""

import numpy as np
import pytest
from tests.conftest import SF
from tidemark.operators import cells, retrieve


def _clustered(spark, n=3000, centres=60, d=16, seed=3):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, d)) * 3
    x = c[r.integers(0, centres, n)] + r.standard_normal((n, d)) * 0.6
    pool = spark.createDataFrame([(int(i), v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "memory_id long, vector array<double>, view string")
    queries = spark.createDataFrame([(int(i), x[i].tolist(), "ab"[i % 2]) for i in range(0, n, 50)], "query_id long, vector array<double>, view string")
    return queries, pool


def test_cell_index_finds_neighbours_in_a_fifth_of_the_pool(spark):
    queries, pool = _clustered(spark)
    index = cells.build_index(pool, "view", 10)
    exact = {(r.query_id, r.memory_id) for r in retrieve.topk(queries, pool, "view", 10).collect()}
    rows = cells.cell_topk(queries, index, 10).collect()
    found = {(r.query_id, r.memory_id) for r in rows}
    assert len(rows) == len(found) and len(found & exact) >= 0.9 * len(exact)
    assert cells.compared(queries, index) < 0.2
    assert index.rows.count() == pool.count()


def test_cell_index_on_the_table_and_on_nothing(spark):
    from tidemark.plans.retrieval import sides

    q, p = sides(spark, SF, "bits")
    index = cells.build_index(p, "view", 16, "jaccard")
    exact = {(r.query_id, r.memory_id) for r in retrieve.topk(q, p, "view", 16, "jaccard").collect()}
    found = {(r.query_id, r.memory_id) for r in cells.cell_topk(q, index, 16).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    empty = cells.build_index(p.where("false"), "view", 16, "jaccard")
    assert cells.cell_topk(q, empty, 16).count() == 0 and cells.cell_topk(q.where("false"), index, 16).count() == 0


def test_blocks_follow_each_groups_own_size(spark):
    queries, pool = _clustered(spark, 400, 5)
    a = {tuple(r) for r in retrieve.topk(queries, pool, "view", 5).collect()}
    assert a == {tuple(r) for r in retrieve.topk(queries, pool, "view", 5, q_block=2, p_block=30).collect()}


def _sets(seed, n):
    """Sets with groups of near copies, equal ones and empty ones."""
    r = np.random.default_rng(seed)
    centres = [set(np.random.default_rng(k).integers(0, 400, 30).tolist()) for k in range(6)]
    out = []
    for i in range(n):
        s = set(centres[i % 6]) if i % 3 else set(r.integers(0, 400, int(r.integers(0, 30))).tolist())
        for _ in range(int(r.integers(0, 5))):
            s.discard(int(r.choice(list(s)))) if len(s) > 1 and r.random() < 0.5 else s.add(int(r.integers(0, 400)))
        out.append((i, sorted(s)))
    return out


def test_similar_across_and_components_against_all_pairs(spark):
    from tidemark.operators.components import connected_components
    from tidemark.operators.families import set_components, similar_across

    left, right = _sets(1, 120), [(1000 + i, s) for i, s in _sets(2, 150)] + [(5000, _sets(1, 5)[4][1])]
    schema = "node long, items array<long>"
    a, b = (spark.createDataFrame(x, schema).repartition(3) for x in (left, right))
    alike = lambda x, y: bool(x and y) and len(set(x) & set(y)) >= 0.75 * len(set(x) | set(y))
    got = {(r.a, r.b): r.similarity for r in similar_across(a, b).collect()}
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in left for j, y in right if alike(x, y)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 100
    assert similar_across(a.where("false"), b).count() == 0
    both = left + right
    label = {i: i for i, _ in both}
    changed = True
    while changed:
        changed = False
        for i, x in both:
            low = min([label[i]] + [label[j] for j, y in both if alike(x, y)])
            changed |= low != label[i]
            label[i] = low
    edges = set_components(a.union(b), seen=2)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(found.get(i, i) == label[i] for i, _ in both)


def test_set_components_of_many_near_copies_make_few_pairs(spark):
    from tidemark.operators.families import set_components

    rows = [(i, [*range(i % 40), *range(41, 60), *range(100, 300), 1000 + i]) for i in range(400)]
    edges = set_components(spark.createDataFrame(rows, "node long, items array<long>"))
    assert edges.count() <= 2 * len(rows)


def test_sets_that_share_too_little_of_their_prefixes_are_not_compared(spark, monkeypatch):
    """Ten pairs of sets share an item in twenty, one pair all but one item in a hundred; equal sets are one."""
    from tidemark.operators import families

    rows = [(i, sorted([*range(i // 2 * 1000, i // 2 * 1000 + 5), *range(10**6 + i * 1000, 10**6 + i * 1000 + 95)])) for i in range(20)]
    rows += [(100, [*range(10**8, 10**8 + 100)]), (101, [*range(10**8 + 1, 10**8 + 101)]), (102, [*range(10**8, 10**8 + 100)])]
    compared, verified = [], families._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(families, "_verified", counted)
    got = families.similar_pairs(spark.createDataFrame(rows, "node long, items array<long>").repartition(3), 0.75).collect()
    assert sorted((r.a, r.b, round(r.similarity, 4)) for r in got) == [(100, 101, 0.9802), (100, 102, 1.0)]
    assert compared == [1]


def test_sets_that_share_little_with_any_other_are_not_compared_with_a_centre(spark, monkeypatch):
    """Ten pairs of sets share an item in twenty, and nothing else with any set; one pair shares all but one item in a hundred."""
    from tidemark.operators import families

    rows = [(i, sorted([*range(i // 2 * 1000, i // 2 * 1000 + 5), *range(10**6 + i * 1000, 10**6 + i * 1000 + 95)])) for i in range(20)]
    rows += [(100, [*range(10**8, 10**8 + 100)]), (101, [*range(10**8 + 1, 10**8 + 101)]), (102, [*range(10**8, 10**8 + 100)])]
    compared, verified = [], families._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(families, "_verified", counted)
    edges = families.set_components(spark.createDataFrame(rows, "node long, items array<long>").repartition(3), 0.75).collect()
    assert {frozenset(e) for e in edges} == {frozenset((100, 101)), frozenset((100, 102))}
    assert compared == [1, 0]


def test_joint_families_take_the_sets_of_a_keys_first_row(spark):
    from tidemark.operators.families import joint_families

    a, b, c = ([*range(k, k + 20)] for k in (0, 100, 200))
    q = spark.createDataFrame([(1, "x", "m", a), (2, "y", "n", b)], "id long, key string, form string, items array<long>")
    p = spark.createDataFrame([(1, "x", "o", c), (2, "z", "r", a), (3, "w", "s", c), (4, None, "t", b)], q.schema)
    got = [sorted((r.id, r.family_id) for r in side.collect()) for side in joint_families(q, p, "id", "key", ["form"], items="items")]
    assert got == [[(1, "p:2"), (2, "p:4")], [(1, "p:2"), (2, "p:2"), (3, "p:3"), (4, "p:4")]]


def test_forest_of_few_cells_is_that_of_its_rows(spark, monkeypatch):
    """Any layout gives the same trees; with more cells than a task may hold, Spark ML's forest is about as far off."""
    from tidemark.operators import learn

    rows = spark.createDataFrame([(i, float(i % 20), float(i * 7 % 31), float(i % 20 // 5) + i % 3 * 0.01) for i in range(1500)], "id long, x double, z double, y double")
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    read = lambda n: {r.id: r.forest_pred for r in learn.forest(train.repartition(n), test, ["x", "z"], "y", 60).collect()}
    one, other = read(2), read(5)
    assert len(one) == 375 and one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)
    monkeypatch.setattr(learn, "CELL_SUMS", 0)
    plain = read(2)
    far = [sum(abs(x[k] - k % 20 // 5) for k in x) / len(x) for x in (one, plain)]
    assert max(far) < 0.6 and abs(far[0] - far[1]) < 0.25, far


def test_replicate_areas_equal_those_of_their_weights(spark):
    """Ties within a range, across ranges and over whole ranges."""
    from tidemark.operators import bootstrap

    r = np.random.default_rng(5)
    n, draws = 400, 150
    for scores in (np.round(r.random(n), 2), np.where(r.random(n) < 0.7, 0.5, np.round(r.random(n), 1)), np.zeros(n)):
        y = r.integers(0, 2, n)
        df = spark.createDataFrame([(int(i), float(s), int(v)) for i, (s, v) in enumerate(zip(scores, y))] + [(None, 0.1, 1), (9999, None, 0)], "id long, s double, y int").repartition(5)
        got = [a for x in sorted(bootstrap.replicate_aurocs(df, "id", "s", "y", draws).collect()) for a in x.auroc]
        w = bootstrap.weights(np.arange(n), draws).astype(float)
        higher = (scores[:, None] > scores[None, :]) + 0.5 * (scores[:, None] == scores[None, :])
        for k in range(draws):
            pos, neg = w[:, k] * (y == 1), w[:, k] * (y == 0)
            assert abs(got[k] - pos @ higher @ neg / (pos.sum() * neg.sum())) < 1e-9
    one = bootstrap.replicate_aurocs(df.where("y = 1"), "id", "s", "y", 3).first()
    assert one.auroc == [None] * 3


def test_replicate_medians_against_brute_force(spark):
    from tidemark.operators import bootstrap, stats

    r = np.random.default_rng(6)
    rows = [(int(i), "xyz"[min(2, i % 5)], float(v)) for i, v in enumerate(np.round(r.normal(size=1000), 1))] + [(5000, "x", None), (5001, "lone", 2.0), (5002, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(6)
    draws = 300
    got = {x.g: sorted(x.medians) for x in bootstrap.replicate_medians(df, "id", "v", draws, group=df["g"]).collect()}
    table = {x.g: x for x in stats.bootstrap_median(df, "id", "v", draws, by="g").collect()}
    for g in ("x", "y", "z", "lone", ""):
        ids, v = (np.array(a) for a in zip(*[(i, x) for i, k, x in rows if (k or "") == g and x is not None]))
        w = bootstrap.weights(ids, draws)
        want = sorted(float(np.median(np.repeat(v, w[:, k]))) for k in range(draws) if w[:, k].sum())
        assert np.allclose(got[g], want)
        assert table[g].n == len(v) and np.allclose([table[g]["median"], table[g].low, table[g].high], [np.median(v), *np.quantile(want, [0.025, 0.975])])


def test_refits_equal_fits_of_each_replicate(spark):
    from tidemark.operators import bootstrap, learn

    r = np.random.default_rng(7)
    n, draws = 300, 40
    x = r.standard_normal((n, 2))
    y = (r.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -0.5] + 0.3)))).astype(int)
    df = spark.createDataFrame([(int(i), float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int").repartition(4)
    got = bootstrap.logistic_refits(df, "id", ["a", "b"], "y", 0.01, draws)
    w = bootstrap.weights(np.arange(n), draws).astype(float)
    design = np.column_stack([x, np.ones(n)])
    for k in range(draws):
        b, v = np.zeros(3), w[:, k] / w[:, k].sum()
        for _ in range(50):
            q = 1 / (1 + np.exp(-design @ b))
            b = b - np.linalg.solve((design * (v * q * (1 - q))[:, None]).T @ design + np.diag([0.02, 0.02, 0]), design.T @ (v * (q - y)) + [0.02 * b[0], 0.02 * b[1], 0])
        assert np.allclose(got[k], b, atol=1e-6)
    whole = spark.createDataFrame([("a", 1.4), ("b", 0.5), ("intercept", 0.0)], "name string, value double")
    report = {x.name: x for x in learn.coefficient_report(whole, spark.createDataFrame([("a", 1), ("b", -1)], "name string, sign int"), got, ["a", "b", "intercept"]).collect()}
    assert (report["a"].flipped, report["b"].flipped, report["intercept"].flipped) == (False, True, False)
    assert np.allclose([report["b"].low, report["b"].high], np.quantile(got[:, 1], [0.025, 0.975]))
    assert np.isnan(bootstrap.logistic_refits(df.where("y = 1"), "id", ["a", "b"], "y", 0.01, 3)).all()


def test_minhash_pairs_find_what_the_exact_join_finds(spark):
    from tidemark.operators.families import bands, minhash_pairs, similar_pairs
    from tidemark.plans.leakage import sets

    for least in (0.5, 0.75, 0.9):
        rows, count = bands(least)
        assert rows * count <= 128 and 1 - (1 - least**rows) ** count >= 0.95
    s = sets(spark, SF.replace("0.001", "0.01"))
    exact = {(r.a, r.b): r.similarity for r in similar_pairs(s).collect()}
    found = {(r.a, r.b): r.similarity for r in minhash_pairs(s).collect()}
    assert found.keys() <= exact.keys() and len(found) >= 0.9 * len(exact) and len(exact) > 50
    assert minhash_pairs(s.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["cosine", "jaccard", "hamming"])
def test_block_holds_a_slab_of_similarities(kind):
    import tracemalloc

    import pandas as pd

    r = np.random.default_rng(5)
    bits = r.random((5_000, 16)) < 0.5
    vectors = [v.tobytes() for v in np.packbits(bits, axis=1)] if kind == "hamming" else list(bits.astype(float))
    left = pd.DataFrame({"query_id": np.arange(1_000), "vector": vectors[:1_000]})
    right = pd.DataFrame({"memory_id": np.arange(5_000), "vector": vectors})
    tracemalloc.start()
    got = retrieve._best_of_block(left, right, 3, kind)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 1_000 * 5_000 * 8  # all similarities of the block at once took several times that
    assert len(got) == 3_000 and (got["query_id"] != got["memory_id"]).all()
    x = bits.astype(float)
    for q in (0, 999):
        inter, n = x[q] @ x.T, x.sum(1)
        if kind == "cosine":
            s = inter / np.maximum(np.sqrt(n[q] * n), 1e-12)
        elif kind == "jaccard":
            s = inter / np.maximum(n[q] + n - inter, 1)
        else:
            s = -(bits[q] != bits).mean(1)
        s = np.round(s, 12)
        s[q] = -np.inf
        assert got.loc[got["query_id"] == q, "memory_id"].tolist() == np.argsort(-s, kind="stable")[:3].tolist()


@pytest.mark.parametrize("name", [None, "name"])
def test_tasks_of_an_overlap_follow_its_pairs(spark, name):
    from tidemark.operators import selection

    r = np.random.default_rng(11)
    facts = [(int(e), int(i), "xy "[e % 3]) for e in range(40) for i in r.choice(60, 10 + e % 7, replace=False)] + [(1, None, "x"), (None, 3, "x")]
    got = selection.overlap(spark.createDataFrame(facts, "entity_id long, item long, name string"), 12, 0.25, name=name, rows=50)
    held: dict = {}
    for e, i, _ in facts:
        held.setdefault(e, set()).add(i)
    want = []
    for a in range(40):
        for b in range(a + 1, 40):
            x, y = len(held[a]), len(held[b])  # a null item counts in a size and is shared with none
            n = len((held[a] & held[b]) - {None})
            if min(x, y) >= 12 and n and n / min(x, y) >= 0.25 and (not name or (a % 3 == b % 3 and a % 3 < 2)):
                want.append((a, b, x, y, n, round(n / min(x, y), 4)))
    assert sorted(tuple(x) for x in got.select("a", "b", "n_a", "n_b", "shared", "overlap").collect()) == want
    tasks = max(int(x) for x in __import__("re").findall(r"hashpartitioning\(e#\d+L?, (\d+)\)", got._jdf.queryExecution().executedPlan().toString()))
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bootstrap_weights_are_hashed_in_parts():
    import tracemalloc

    from tidemark.operators import bootstrap

    ids = np.arange(-500, 500) * 7919
    tracemalloc.start()
    got = bootstrap.weights(ids, 1_000, 5)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 4 * got.size  # whole matrices of 64-bit hashes took 16 bytes a cell and more
    mask = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    for i, draw in ((0, 0), (7, 999), (999, 3), (640, 512)):
        h = mix(mix((int(ids[i]) + 5 * 0x9E3779B97F4A7C15) & mask) ^ mix((draw + 1) * 0x9E3779B97F4A7C15 & mask))
        assert got[i, draw] == bootstrap._TABLE[h >> 48]


def test_baselines_and_their_table_read_the_rows_once(spark):
    """The join, the edges, the cells, the trees and the table without ranks once made the rows anew for each."""
    from pyspark.sql import functions as F
    from tidemark.operators import learn, stats

    seen, n = spark.sparkContext.accumulator(0), 300

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(n).select("id", F.concat(F.lit("e"), F.col("id") % 3).alias("e"), (F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y")).mapInArrow(count, "id long, e string, x double, y double")
    held = spark.range(n).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    fitted = learn.mandatory_baselines(rows, held, "id", "e", "y", ["x"], trees=20)
    got = {(r.method, r.entity_id): r for r in stats.baseline_table(fitted, ranks=False).collect()}
    assert seen.value == n
    assert got.keys() == {(m, e) for m in ("mean", "forest") for e in ("e0", "e1", "e2", "__macro__")}
    ranked = stats.baseline_table(fitted).drop("spearman").collect()
    assert len(ranked) == len(got) and all(r.n == (o := got[r.method, r.entity_id]).n and abs(r.rmse - o.rmse) < 1e-9 and abs(r.r2 - o.r2) < 1e-9 for r in ranked)
    with pytest.raises(stats.MissingBaselineError):
        stats.baseline_table(fitted.where("method = 'forest'"), ranks=False)


def test_a_choice_of_backbones_ranks_nothing(spark, monkeypatch):
    """J10 reads errors only; ranks of all methods' rows were once made for it and dropped."""
    from tidemark import plans
    from tidemark.operators import stats

    def ranks(*_):
        raise AssertionError("ranks")

    monkeypatch.setattr(stats, "spearman_by", ranks)
    assert {r.method for r in plans.queries()["j10_select_backbones"](spark, SF).collect()} == {"model", "rival", "constant"}
    assert {r.method for r in plans.queries()["j10_backbones_with_forest"](spark, SF).collect()} == {"rival", "constant"}


def test_places_follow_the_ranks_where_rounded_similarities_tie(spark, tmp_path):
    """G10 once ranked again by six digits, so that neighbours that differ beyond them stood by their ids."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from tests.oracle import assert_same
    from tidemark import plans

    vectors = [[1.0, 0.0]] + [[1.0, i % 2 + (21 - i) * 1e-5] for i in range(1, 21)]  # the larger the id, the nearer to row 0
    embeddings = pa.table({"vec_id": pa.array(range(21), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(21)], pa.int32())})
    pq.write_table(embeddings, tmp_path / "embeddings.parquet")
    got = plans.queries()["g10_rank_scalars"](spark, str(tmp_path))
    assert [r.memory_id for r in got.sort("rank_norm").collect()] == [*range(20, 0, -2), *range(19, 8, -2)]
    assert_same(got, plans.oracle_sql()["g10_rank_scalars"], str(tmp_path))
