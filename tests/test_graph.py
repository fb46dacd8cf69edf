import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.operators import graph, skew
from murmura.operators import layout as layout_module
from murmura.operators.layout import Cells, layout


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, w double")


STAR = [("c", x) for x in "1234"]
TAIL = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
CLIQUES = (list(combinations(["a1", "a2", "a3", "a4"], 2))
           + list(combinations(["b1", "b2", "b3", "b4"], 2)) + [("a1", "b1")])


def core(spark, pairs):
    return {r.id: r.core for r in graph.core_numbers(edges(spark, pairs)).collect()}


def brute_core(pairs):
    around = {}
    for a, b in pairs:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    out, k = {}, 0
    while around:
        weak = [v for v, n in around.items() if len(n) <= k]
        if not weak:
            k += 1
            continue
        for v in weak:
            out[v] = k
            for u in around.pop(v):
                if u in around:
                    around[u].discard(v)
    return out


def test_core_numbers(spark):
    assert core(spark, STAR) == dict.fromkeys("c1234", 1)
    assert core(spark, TAIL) == {"a": 2, "b": 2, "c": 2, "d": 1}
    messy = CLIQUES + [("b", "b"), ("a2", "a1"), ("b4", "z"), ("z", "y"), ("y", "b4"), ("q", "z")]
    assert core(spark, messy) == brute_core(messy)


def test_k_core_equals_core_numbers(spark):
    pairs = CLIQUES + TAIL + [("d", "e")]
    for k in (1, 2, 3):
        kept = graph.k_core(edges(spark, pairs), k, mode="simple")
        want = {v for v, c in brute_core(pairs).items() if c >= k}
        assert {r.id for r in graph.nodes(kept).collect()} == want
    assert graph.k_core(edges(spark, STAR), 2).count() == 0


def test_reciprocal_edges_count_twice_in_directed_mode(spark):
    pair = [("a", "b"), ("b", "a"), ("a", "a")]
    assert graph.k_core(edges(spark, pair), 2).count() == 2
    assert graph.k_core(edges(spark, pair), 2, mode="simple").count() == 0


def test_communities_of_two_cliques(spark):
    e = edges(spark, CLIQUES)
    labels = {r.id: r.community for r in graph.communities(e).collect()}
    assert {labels[f"a{i}"] for i in range(1, 5)} == {0}
    assert {labels[f"b{i}"] for i in range(1, 5)} == {1}
    found = graph.modularity(e, graph.communities(e)).first().modularity
    alone = graph.nodes(e).withColumn("community", F.col("id"))
    assert found == pytest.approx(12 / 13 - 0.5)
    assert found > graph.modularity(e, alone).first().modularity


def test_communities_on_the_path_for_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (2,))
    labels = {r.id: r.community for r in graph.communities(edges(spark, CLIQUES)).collect()}
    assert len(set(labels.values())) == 2 and labels["a1"] != labels["b1"]


def test_coverage_and_rank(spark):
    labels = spark.createDataFrame(
        [(f"n{i}", c) for i, c in enumerate([0] * 5 + [1] * 3 + [2] + [3])], "id string, community long")
    got = [r.community for r in graph.top_communities(labels, coverage=0.9).orderBy("community").collect()]
    assert got == [0, 1, 2]
    assert graph.top_communities(labels, k=2).count() == 2
    assert graph.top_communities(labels, coverage=1.0).count() == 4


def test_hot_keys_join_keeps_all_rows(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    big = big.unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    side = big.select("k").distinct().withColumn("v", F.length("k"))
    assert skew.hot_keys(big, "k", rows=300) == ["hot"]
    for how in ("inner", "left"):
        plain = big.join(side, "k", how).orderBy("id").collect()
        split = skew.join_unique(big, side, "k", how, hot=["hot"]).orderBy("id").collect()
        assert split == plain


def test_global_order_equals_a_window(spark):
    df = spark.range(500).select((F.xxhash64("id") % 7).alias("a"), F.col("id").alias("b"))
    got = skew.with_global_order(df, ["a", "b"], ["a"], running={"b": "before"})
    rows = sorted(((r.a, r.b) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    total, want = 0, {}
    for i, (a, b) in enumerate(rows):
        want[(a, b)] = (i, total)
        total += b
    assert {(r.a, r.b): (r["rank"], r.before) for r in got.collect()} == want


def test_graph_of_kept_communities(spark):
    e = edges(spark, CLIQUES)
    nodes, lines = graph.community_graph(e, graph.communities(e), k=1)
    assert nodes.count() == 4 and lines.count() == 6
    assert {r.degree for r in nodes.collect()} == {3, 4}


def test_details_of_either_side_count_a_post_once(spark):
    shares = spark.createDataFrame(
        [("1", "a", "b", ["#x", "@a"], 1), ("2", "z", "b", ["#x"], -1), ("3", "z", "y", ["q"], 0)],
        "post_id string, uid string, ouid string, toks array<string>, sentiment int")
    members = spark.createDataFrame([("a", 0), ("b", 0)], "uid string, community long")
    assert graph.community_posts(shares, members).count() == 1
    both = graph.community_posts(shares, members, "either")
    assert sorted(r.post_id for r in both.collect()) == ["1", "2"]
    assert graph.community_wordcloud(both, 5).collect()[0]["word"] == "#x"
    mood = graph.community_sentiment(both, normalize=True).first()
    assert (mood.positive, mood.negative, mood.neutral) == (0.5, 0.5, 0.0)


def test_layout_is_finite_deterministic_and_groups_neighbours(spark):
    e = edges(spark, CLIQUES)
    first = {r.id: (r.x, r.y, r.z) for r in layout(e, 2, 25, early_stop=False).collect()}
    again = {r.id: (r.x, r.y, r.z) for r in layout(e, 2, 25, early_stop=False).collect()}
    assert first.keys() == again.keys() and all(
        first[k] == pytest.approx(again[k], abs=1e-6) for k in first)
    assert all(abs(v) < 1e6 for p in first.values() for v in p) and all(p[2] == 0 for p in first.values())

    def gap(a, b):
        return sum((x - y) ** 2 for x, y in zip(first[a], first[b])) ** 0.5

    assert gap("a2", "a3") < gap("a2", "b3")
    assert any(r.z != 0 for r in layout(e, 3, 2).collect())


def test_communities_are_cut_into_connected_parts(spark):
    links = graph.undirected(edges(spark, CLIQUES + TAIL))
    one = graph.nodes(edges(spark, CLIQUES + TAIL)).withColumn("community", F.lit(0))
    parts = {}
    for r in graph.connected_parts(links, one).collect():
        parts.setdefault(r.community, set()).add(r.id)
    assert parts == {"a": set("abcd"), "a1": {f"{c}{i}" for c in "ab" for i in range(1, 5)}}


def test_path_peels_to_nothing_and_has_core_one(spark):
    path = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(9)])
    assert graph.k_core(path, 2).count() == 0
    assert {r.core for r in graph.core_numbers(path).collect()} == {1}


@pytest.mark.parametrize("dims, levels, error", [(2, 4, 0.2), (3, 3, 0.1)])
def test_cell_hierarchy_is_close_to_all_pairs(dims, levels, error):
    rng = np.random.default_rng(4)
    at = np.zeros((1500, 3))
    at[:, :dims] = rng.normal(0, 40, (1500, dims))
    mass = rng.uniform(1, 4, 1500)
    low, side = at.min(axis=0), 2 ** levels
    width = (at.max(axis=0) - low).max() * (1 + 1e-9) / side
    cell = np.clip(np.floor((at[:, :dims] - low[:dims]) / width), 0, side - 1).astype(int)
    number = (cell * side ** np.arange(dims)).sum(axis=1)
    rows = [(n, mass[number == n].sum(), *(mass[number == n, None] * at[number == n]).sum(axis=0))
            for n in np.unique(number)]
    cells = Cells(dims, levels, low, width, rows)
    for level in range(2, levels + 1):
        assert cells.sums[level][:, 0].sum() == pytest.approx(mass.sum())
    found = cells.repulsion(at, at, mass)
    away = at[:, None] - at[None]
    square = (away ** 2).sum(axis=-1)
    np.fill_diagonal(square, np.inf)
    exact = (mass[None, :, None] * away / square[..., None]).sum(axis=1)
    wrong = np.linalg.norm(found - exact, axis=1) / np.linalg.norm(exact, axis=1)
    assert np.median(wrong) < error


@pytest.mark.parametrize("dims, levels", [(2, 5), (3, 3)])
def test_repulsion_reads_only_the_bodies_it_needs(dims, levels):
    rng = np.random.default_rng(7)
    at, mass = np.zeros((512, 3)), rng.integers(1, 9, 512).astype(float)
    at[:, :dims] = rng.uniform(-100, 100, (512, dims))
    side = 2 ** levels
    width = 200.0 / side
    cell = np.floor((at[:, :dims] + 100) / width).astype(int)
    number = (cell * side ** np.arange(dims)).sum(axis=1)
    rows = [(n, mass[number == n].sum(), *(mass[number == n, None] * at[number == n]).sum(axis=0))
            for n in np.unique(number)]
    cells = Cells(dims, levels, np.full(3, -100.0), width, rows)
    moved = np.clip(at + rng.normal(0, 5, at.shape) * (np.arange(3) < dims), -99, 99)
    cells.repulsion(moved, at, mass)
    tracemalloc.start()
    found = cells.repulsion(moved, at, mass)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A number or a few per body met, where whole vectors of all cousins were kept.
    assert peak < 512 * 8 * 8 * 6 ** dims
    for i in range(0, 512, 37):
        here = np.floor((moved[i, :dims] + 100) / width).astype(int)
        force = np.zeros(3)
        for level in range(2, levels + 1):
            shift = levels - level
            group, mine = cell >> shift, here >> shift
            for other in np.unique(group, axis=0):
                far = np.abs(other - mine).max() > 1
                met = far and np.abs((other >> 1) - (mine >> 1)).max() <= 1
                if not met and (far or level < levels):
                    continue
                held = (group == other).all(axis=1) & (np.arange(512) != i)
                if held.any():
                    away = moved[i] - (mass[held, None] * at[held]).sum(axis=0) / mass[held].sum()
                    force += mass[held].sum() * away / (away ** 2).sum()
        assert found[i] == pytest.approx(force, rel=1e-9, abs=1e-9)


def test_blocks_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(layout_module, "BLOCK", 1)
    placed = layout_module._Graph(edges(spark, CLIQUES), 2, 42)
    assert placed.tasks == min(8, max(spark.sparkContext.defaultParallelism,
                                      int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed.move(1, 1.0)
    assert placed.state.count() == 8


def test_layout_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(layout_module, "BLOCK", 3)
    placed = {r.id: (r.x, r.y) for r in layout(edges(spark, CLIQUES), 2, 60, early_stop=False).collect()}
    assert len(placed) == 8
    gap = lambda a, b: np.hypot(*np.subtract(placed[a], placed[b]))
    inside = np.mean([gap(*p) for p in combinations(["a1", "a2", "a3", "a4"], 2)])
    assert inside < np.mean([gap(f"a{i}", f"b{j}") for i in range(1, 5) for j in range(1, 5)])


def _ring_of_groups(spark):
    pairs = [(f"n{g}-{i}", f"n{g}-{j}") for g in range(6) for i in range(6) for j in range(i)]
    return edges(spark, pairs + [(f"n{g}-0", f"n{(g + 1) % 6}-1") for g in range(6)])


def test_rounds_of_moves_carry_numbers_and_meet_links_once(spark, monkeypatch):
    seen, one_round = [], graph._one_round

    def watched(around, state, *rest):
        seen.append((dict(around.dtypes), dict(state.dtypes)))
        return one_round(around, state, *rest)

    monkeypatch.setattr(graph, "_one_round", watched)
    found = graph.communities(_ring_of_groups(spark)).groupBy("community").agg(F.collect_set("id").alias("ids"))
    assert sorted(sorted(r.ids) for r in found.collect()) == [[f"n{g}-{i}" for i in range(6)] for g in range(6)]
    for links, state in seen:
        assert links == {"id": "bigint", "nb": "bigint", "w": "double"}
        assert state["community"] == "bigint"


def test_shuffled_rounds_equal_broadcast_ones(spark, monkeypatch):
    e = _ring_of_groups(spark).union(edges(spark, [("n0-0", "n0-0"), ("alone", "alone")])).union(
        spark.createDataFrame([("n1-1", None, 2.0), (None, None, 1.0)], "src string, dst string, w double"))
    want = sorted(graph.communities(e, 2.0).collect())
    assert len({r.id for r in want}) == 37
    for name in ("BROADCAST_ROWS", "NUMBERED_ROWS"):
        monkeypatch.setattr(graph, name, 1)
    assert sorted(graph.communities(e, 2.0).collect()) == want
