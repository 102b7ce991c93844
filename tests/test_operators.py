import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import facts, graph, linkage, score, stats, verify


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def walk(spark):
    relations = [(1, 2, "is_conjugate_base_of"), (2, 3, "is_tautomer_of"), (1, 4, "is_a"), (4, 6, "is_a"), (1, 5, "has_functional_parent")]
    edges = graph.build_edges(spark.createDataFrame(relations, "src int, dst int, etype string"))
    return graph.scored_walk(graph.bounded_walk(spark.createDataFrame([(1,)], "seed int"), edges, 1.5), 1.5).cache()


def test_bounded_walk(walk):
    assert rows(walk.select("node", "cost", "steps", "relation", "score")) == [
        (1, 0.0, 0, "exact", 100), (2, 0.5, 1, "conjugate_base_of", 72), (3, 0.75, 2, "identity", 55), (4, 1.0, 1, "is_a", 33), (5, 0.75, 1, "scaffold", 45),
    ]


def test_hub_guard(spark):
    df = spark.createDataFrame([(5, "scaffold", str(i)) for i in range(41)] + [(4, "is_a", str(i)) for i in range(41)], "node int, relation string, code string")
    assert graph.guarded(df, "node", "relation", "code").select("node").distinct().collect() == [(4,)]


def test_first_fitting_rule_expands(spark):
    names = spark.createDataFrame([(1, "vitamins, total"), (2, "vitamin c"), (3, "iron")], "id int, name string")
    rules = [("vitamins", "^vitamins", "^vitamin "), ("all", "total", ".*")]
    assert rows(graph.expand(names.where("id = 1"), names, rules)) == [(1, 2, "vitamins")]


def test_witnesses(spark):
    df = spark.createDataFrame([(1, 10, 5.0, "a"), (1, 10, 5.0, "b"), (1, 10, 6.0, "a"), (2, 10, None, "a"), (2, 10, None, "a")], "f int, n int, amount double, s string")
    assert rows(facts.collapse_witnesses(df, ["f", "n", "amount"], "s")) == [(1, 10, 5.0, "a;b"), (1, 10, 6.0, "a"), (2, 10, None, "a")]


def test_relistings(spark):
    foods = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "x", "t"), (4, "x", "s")], "id int, name string, src string")
    vec = spark.createDataFrame([(i, n, a) for i in (1, 2, 3) for n, a in ((10, 1.0), (11, 2.0))] + [(4, 10, 1.0)], "id int, n int, a double")
    assert rows(facts.drop_relistings(foods, vec, "id", ["name", "src"], "n", "a").select("id")) == [(1,), (3,), (4,)]
    assert rows(facts.drop_relistings(foods, vec, "id", ["name", "src"], "n", "a", exempt=F.col("id") == 2).select("id")) == [(1,), (2,), (3,), (4,)]


def test_mint_never_renumbers(spark):
    registry = spark.createDataFrame([("b", 9_000_000)], "code string, number long")
    codes = spark.createDataFrame([("c",), ("b",), ("a",), (None,)], "code string")
    assert rows(facts.mint(codes, registry, "code", "number", 9_000_000)) == [("a", 9_000_001), ("c", 9_000_002)]
    with pytest.raises(Exception, match="no number left"):
        facts.mint(codes, registry, "code", "number", 9_000_000, limit=9_000_001).collect()


def test_merge_and_override(spark):
    base, extra = spark.createDataFrame([(7, "A")], "n int, c string"), spark.createDataFrame([(7, "B")], "n int, c string")
    assert rows(facts.merge_or_override(base, extra, "n", False)) == [(7, "A"), (7, "B")]
    assert rows(facts.merge_or_override(base, extra, "n", True)) == [(7, "B")]


def test_chain_filter_keeps_the_generic_of_a_target(spark):
    df = spark.createDataFrame([(5,), (6,), (7,)], "k int")
    aliases = spark.createDataFrame([(5, 6)], "specific int, generic int")
    assert rows(facts.chain_filter(df, spark.createDataFrame([(5,)], "k int"), "k", aliases)) == [(5,), (6,)]


@pytest.mark.parametrize(("hits", "kept"), [([75, 41, 41, 30], [75]), ([60, 55, 50], [60, 55]), ([60], [60])])
def test_winners(spark, hits, kept):
    df = spark.createDataFrame([("k", float(h)) for h in hits], "k string, s double")
    assert sorted(r.s for r in linkage.keep_winners(df, "k", "s").collect()) == sorted(map(float, kept))


def test_curated_rescue(spark):
    df = spark.createDataFrame([("k", 75.0, False), ("k", 41.0, True), ("k", 41.0, True), ("k", 30.0, True)], "k string, s double, star boolean")
    assert sorted(r.s for r in linkage.keep_winners(df, "k", "s", curated=F.col("star")).collect()) == [41.0, 41.0, 75.0]


def test_peer_gate_is_strict(spark):
    df = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 3.0), ("c", "f", 5.0), ("d", "g", -1.0)], "o string, f string, s double")
    out = score.peer_gate(df, "o", "f", "s", min_peers=3)
    assert rows(out.select("o", "comp_score")) == [("c", 2.0)]


def test_diversity_cap_fills_up(spark):
    df = spark.createDataFrame([("o", i, 10.0 - i, "x" if i < 4 else "y") for i in range(6)], "o string, i int, s double, c string")
    out = score.diversity_cap(df, "o", "i", "s", ["c"], 4, 2)
    assert [r.i for r in out.orderBy("rank").collect()] == [0, 1, 4, 5]
    out = score.diversity_cap(df.where("c = 'x'"), "o", "i", "s", ["c"], 3, 2)
    assert [r.i for r in out.orderBy("rank").collect()] == [0, 1, 2]


def test_max_rank_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (5.0, 9.0)], "x double, y double")
    import numpy as np

    want = np.corrcoef([0, 2, 2, 3], [0, 2, 1, 3])[0, 1]
    assert stats.max_rank_correlation(df, "x", "y").first().rho == pytest.approx(want)


def test_mann_whitney(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    r = stats.mann_whitney(df, "g", "v", "a", "b").first()
    assert (r.n_a, r.n_b, r.u) == (2, 3, 0.5) and 0 < r.p < 1


def test_rarefaction(spark):
    df = spark.createDataFrame([("s", "x", 2), ("s", "y", 1), ("t", "x", 1)], "s string, k string, n long")
    got = {r.s: r.expected for r in stats.rarefied(df, "s", "k", "n", 2).collect()}
    assert got["s"] == pytest.approx(1 + 2 / 3) and got["t"] is None


def test_pairs_that_share_nothing_count(spark):
    import itertools

    import numpy as np

    r = np.random.default_rng(4)
    group = {e: "xyz"[e % 3] for e in range(12)}
    items = {e: {int(v) + 4 * (e % 3) for v in r.integers(0, 9, 3)} for e in group}
    full = [(a, b, 1 - 2 * len(items[a] & items[b]) / (len(items[a]) + len(items[b]))) for a, b in itertools.combinations(group, 2)]
    assert 10 < sum(d == 1 for *_, d in full) < 56
    distances = stats.sorensen(spark.createDataFrame([(e, v) for e in group for v in items[e]], "e int, v int"), "e", "v")
    groups = spark.createDataFrame(list(group.items()), "e int, g string")
    got = stats.within_between(distances, groups, "e", "g").first()
    same, other = ([d for a, b, d in full if (group[a] == group[b]) is s] for s in (True, False))
    assert (got.within, got.between, got.gap) == pytest.approx((np.mean(same), np.mean(other), np.mean(other) - np.mean(same)))
    within, total = sum(d * d for a, b, d in full if group[a] == group[b]) / 4, sum(d * d for *_, d in full) / 12
    got = stats.permanova(distances, groups, "e", "g", 99).first()
    assert (got.pseudo_f, got.r2) == pytest.approx(((total - within) / 2 / (within / 9), 1 - within / total))
    every = stats.permanova(spark.createDataFrame(full, "i int, j int, distance double"), groups, "e", "g", 99).first()
    assert tuple(got) == pytest.approx(tuple(every))
    apart = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "q")], "e int, g string")
    near = spark.createDataFrame([(1, 2, 0.5)], "i int, j int, distance double")
    assert tuple(stats.within_between(near, apart, "e", "g").first()) == pytest.approx((0.75, 1.0, 0.25))


def test_checks_count_nulls_as_broken(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert rows(verify.row_checks(df, {"positive": F.col("x") > 0})) == [("positive", False, 1)]
    assert rows(verify.field_count_check(spark.createDataFrame([("a\tb",), ("a",)], "value string"), "x\ty", "fields")) == [("fields", False, 1)]


def test_blocked_similarity(spark):
    names = spark.createDataFrame([(1, "glucose"), (2, "galactose")], "id int, name string")
    asked = spark.createDataFrame([("q", "glucosee"), ("r", "zzz")], "q string, name string")
    out = linkage.blocked_similarity(asked, names, "q", "name", "id", "name", 0.9).collect()
    assert [(r.query, r.id) for r in out] == [("q", 1)]


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    current = spark.createDataFrame([(1, "old"), (2, "kept")], "k int, v string")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1)], "k int, v string, at int")
    got = facts.upsert(current, new, "k", order=F.col("at")).select("k", "v")
    assert rows(got) == [(1, "b"), (2, "kept"), (3, "c")]


def test_labels_without_a_tier_are_unknown(spark):
    df = spark.createDataFrame([(1, "x;y"), (2, "z"), (3, None)], "k int, labels string")
    tiers = spark.createDataFrame([("x", 1), ("y", 2)], "label string, rank int")
    assert rows(facts.best_label(df, "k", "labels", tiers, "label", "rank")) == [(1, "y", 2), (2, "unknown", None), (3, "unknown", None)]


def test_order_breaks(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 4), (4, 9), (None, 1)], "a int, b int")
    assert rows(facts.order_breaks(df, "a", "b")) == [(4, 1)]
    assert rows(facts.order_breaks(df.limit(0), "a", "b")) == [(0, 0)]


def test_sets_that_share_nothing(spark):
    """Columns with the names that the operator uses inside, and pairs at distance 1."""
    presence = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "j string, i int")
    distances = stats.sorensen(presence, "j", "i")
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "e string, g string")
    assert rows(stats.within_between(distances, groups, "e", "g")) == [(0.0, 1.0, 1.0)]


def test_permanova_against_numpy(spark):
    """F, R2 and blocked permutations from the full matrix of distances."""
    import numpy as np

    rng = np.random.default_rng(4)
    own = [(i, int(k)) for i in range(14) for k in rng.choice(40, 4, replace=False)]
    sets = [{k for j, k in own if j == i} for i in range(14)]
    d2 = np.array([[(1 - 2 * len(a & b) / (len(a) + len(b))) ** 2 for b in sets] for a in sets])
    labels = np.array([i % 3 for i in range(14)])

    def within(g):
        return sum(d2[np.ix_(g == k, g == k)].sum() / 2 / (g == k).sum() for k in range(3))

    total = d2.sum() / 2 / 14
    want = ((total - within(labels)) / 2) / (within(labels) / 11)
    distances = stats.sorensen(spark.createDataFrame(own, "e int, k int"), "e", "k")
    groups = spark.createDataFrame([(i, int(labels[i]), i // 7) for i in range(14)], "e int, g int, b int")
    for block in (None, "b"):
        r = stats.permanova(distances, groups, "e", "g", 50, block=block).first()
        assert (r.pseudo_f, r.r2) == (pytest.approx(want), pytest.approx(1 - within(labels) / total)) and 0 < r.p <= 1


def test_greedy_basket_step_by_step(spark):
    """Each choice is the best of all that are left, given what was taken before."""
    import math
    import random

    r = random.Random(8)
    amounts = [("e", f"i{i}", n, r.randint(1, 9) * 1.0, "xyz"[i % 3]) for i in range(9) for n in range(4) if r.random() < 0.6]
    weights = {n: (1.0 + n / 4, 2.0 + n) for n in range(4)}
    own = {}
    for _, i, n, a, c in amounts:
        own.setdefault((i, c), []).append((n, a))
    eaten, kinds, want, left = {}, {}, [], dict(own)
    for rank in range(1, 5):
        def value(key):
            gain = sum(weights[n][0] * (math.log1p((eaten.get(n, 0) + a) / weights[n][1]) - math.log1p(eaten.get(n, 0) / weights[n][1])) for n, a in left[key])
            shared = sum(n in eaten for n, _ in left[key]) / len(left[key])
            return math.log1p(gain) * math.sqrt(len(left[key]) / (len(left[key]) + 2)) - 0.6 * shared - 0.2 * kinds.get(key[1], 0)

        best = max(sorted(left), key=value)
        want.append((rank, best[0], pytest.approx(value(best))))
        for n, a in left.pop(best):
            eaten[n] = eaten.get(n, 0) + a
        kinds[best[1]] = kinds.get(best[1], 0) + 1
    df = spark.createDataFrame(amounts, "e string, i string, n int, a double, c string")
    w = spark.createDataFrame([(n, *v) for n, v in weights.items()], "n int, weight double, scale double")
    got = score.greedy_basket(df, w, "e", "i", "n", "a", "c", 4).orderBy("rank").select("rank", "i", "score").collect()
    assert [tuple(x) for x in got] == want


def test_diversity_cap_by_hand(spark):
    import random

    r = random.Random(5)
    items = [("e", f"i{i:02}", r.randint(0, 50) / 10, "xyz"[r.randint(0, 2)], r.randint(0, 4)) for i in range(40)]
    for k, cap in ((6, 2), (10, -1), (5, 0), (30, 1)):
        limit = max(2, round(0.4 * k)) if cap < 0 else cap
        taken, rest = [], []
        for x in sorted(items, key=lambda x: (-x[2], x[1])):
            full = limit and any(sum(t[j] == x[j] for t in taken) >= limit for j in (3, 4))
            (rest if full else taken).append(x) if len(taken) < k else None
        want = {x[1] for x in taken + rest[: k - len(taken)]}
        df = spark.createDataFrame(items, "e string, i string, s double, c string, l int")
        assert {x.i for x in score.diversity_cap(df, "e", "i", "s", ["c", "l"], k, cap).collect()} == want, (k, cap)


def test_ordination_keeps_the_order_of_distances(spark):
    """Points of a plane come back up to scale and turn; an entity without near ones is far."""
    import numpy as np

    rng = np.random.default_rng(2)
    points = rng.random((12, 2))
    full = np.linalg.norm(points[:, None] - points[None], axis=2)
    full /= full.max() * 1.01
    pairs = [(i, j, float(full[i, j])) for i in range(12) for j in range(i + 1, 12)]
    entities = spark.createDataFrame([(i,) for i in range(12)], "e int")
    out, stress = stats.ordination(spark.createDataFrame(pairs, "i int, j int, distance double"), entities, "e")
    x = np.array([(r.axis_1, r.axis_2) for r in out.orderBy("e").collect()])
    got = np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(12, 1)]
    assert stress < 0.02 and np.corrcoef(got, full[np.triu_indices(12, 1)])[0, 1] > 0.99
    with pytest.raises(ValueError):
        stats.ordination(spark.createDataFrame(pairs, "i int, j int, distance double"), entities, "e", most=5)


def test_first_of_key_orders_by_price_and_key_in_one_number(spark, tmp_path):
    from tessera.plans import catalogue as plans

    # A cent is worth 10,000 keys: of customer 1 the dearer order comes first.
    orders = [(900_000, 1, "O", 10.00), (5, 1, "O", 10.01), (7, 2, "O", 3.0), (9, 2, "O", 2.0), (4, 3, "F", None), (8, 4, "F", None), (3, 4, "F", 1e6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = sorted(con.sql(plans.SQL["first_of_key"]).fetchall())
    got = sorted(tuple(r[c] for c in ("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")) for r in plans.QUERIES["first_of_key"](spark, str(tmp_path)).collect())
    assert got == want == [(1, "O", 5, 10.0), (2, "O", 9, 2.0), (3, "F", None, None), (4, "F", 3, 1e6)]
