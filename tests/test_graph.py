"""Hand-checked cases, both engines against each other, and streaming."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.functions.normalise import dedup_edges
from loomgraph.operators.betweenness import betweenness
from loomgraph.operators.components import connected_components, verify_components
from loomgraph.operators.graph import Graph
from loomgraph.operators.mutation import LOG, apply_ops, apply_txns, both_directions, op_results
from loomgraph.operators.paths import UNREACHABLE, sssp, verify_sssp
from loomgraph.operators.rank import pagerank, verify_pagerank
from loomgraph.operators.traversal import bfs, bfs_goal_rank, discovery_order, verify_bfs
from loomgraph.operators.triangles import triangle_count, triangle_count_ordered, verify_triangles
from loomgraph.sources import generate
from loomgraph.sources.edges import read_edge_list, write_edge_list
from loomgraph.streaming.oplog import GraphStore, stream_ops

ENGINES = ("task", "cluster")
RAW = "src long, dst long, weight long"


def graph(spark, edges, **kw):
    return Graph.from_edges(spark.createDataFrame([(*e, None)[:3] if len(e) == 2 else e for e in edges], RAW), **kw)


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def tiny(spark):
    return graph(spark, [(1, 2, 1), (1, 3, 1), (3, 2, 1), (4, 2, 1), (5, 2, 1)])


def test_tiny(tiny):
    assert tiny.num_nodes() == 6 and tiny.num_edges() == 5 and tiny.num_edges_directed() == 5
    assert dict(map(tuple, tiny.out_degree().collect())) == {0: 0, 1: 2, 2: 0, 3: 1, 4: 1, 5: 1}
    assert triangle_count(tiny).first()[0] == 1 and triangle_count_ordered(tiny).first()[0] == 0
    assert verify_triangles(tiny, 1).first().valid and not verify_triangles(tiny, 2).first().valid
    for e in ENGINES:
        assert rows(bfs(tiny, 1, e)) == {(1, 0, 1), (2, 1, 1), (3, 1, 1)}
        assert rows(connected_components(tiny, e)) == {(0, 0)} | {(k, 1) for k in range(1, 6)}
        top = sorted(rows(pagerank(tiny, 20, 4e-4, e)), key=lambda x: -x[1])[:2]
        assert top[0] == (2, pytest.approx(0.10840625)) and top[1] == (3, pytest.approx(0.035625))
        assert rows(bfs(tiny, 99, e)) == set()


def test_small_shapes(spark):
    assert triangle_count_ordered(graph(spark, [(3, 2), (2, 1), (3, 1)])).first()[0] == 1
    loop = graph(spark, [(2, 2)])
    assert loop.num_nodes() == 3 and loop.num_edges() == 0
    none = Graph.from_edges(spark.createDataFrame([], RAW))
    assert none.num_nodes() == 0
    for e in ENGINES:
        assert rows(connected_components(loop, e)) == {(0, 0), (1, 1), (2, 2)}
        assert dict(map(tuple, pagerank(loop, 20, None, e).collect())) == pytest.approx({0: 0.05, 1: 0.05, 2: 0.05})
        assert rows(connected_components(graph(spark, [(1, k) for k in range(2, 6)]), e)) == {(0, 0)} | {(k, 1) for k in range(1, 6)}
        assert rows(sssp(graph(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 5)]), 0, engine=e)) == {(0, 0), (1, 1), (2, 2)}
        diamond = betweenness(graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3)]), [0], engine=e)
        assert {(r.id, r.raw) for r in diamond.collect()} == {(0, 3.0), (1, 0.5), (2, 0.5), (3, 0.0)}
        assert rows(connected_components(none, e)) == set() and rows(bfs(none, 0, e)) == set()
        with pytest.raises(Exception, match="no weight"):
            sssp(graph(spark, [(0, 1)]), 0, engine=e).collect()
    parallels = spark.createDataFrame([(1, 2, 9, 0), (1, 2, 4, 1), (1, 2, 7, 2)], RAW + ", k long")
    assert [dedup_edges(parallels, p, "k").first().weight for p in ("min", "max", "sum", "first", "last")] == [4, 9, 20, 9, 7]


def fifo(edges, start, goal):
    neigh = {}
    for a, b in sorted(edges):
        neigh.setdefault(a, []).append(b)
    seen, queue = [start], [start]
    met = {start}
    while queue:
        for v in neigh.get(queue.pop(0), []):
            if v == goal:
                return len(seen)
            if v not in met:
                met.add(v)
                seen.append(v)
                queue.append(v)
    return len(seen)


def test_goal_rank(spark):
    g = graph(spark, [(0, 2), (0, 1), (1, 3), (2, 4)])
    assert [bfs_goal_rank(g, 0, k).first()[0] for k in (3, 4, None, 9)] == [3, 4, 5, 5]
    with pytest.raises(ValueError, match="exist"):
        bfs_goal_rank(g, 77)
    rng = random.Random(1)
    for _ in range(3):
        edges = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(24)) if a != b} | {(11, 0)}
        g = graph(spark, edges, num_vertices=12)
        for goal in (0, 5, None):
            for e in ENGINES:
                assert bfs_goal_rank(g, 0, goal, e).first()[0] == fifo(edges, 0, goal), (edges, goal)


@pytest.mark.parametrize("make", [generate.uniform_edges, generate.rmat_edges])
def test_engines_agree(spark, make):
    raw = generate.random_weights(make(spark, 6, 3, seed=4))
    g = Graph.from_edges(raw, num_vertices=64)
    source = generate.pick_sources(g.out_degree(), 1)[0]
    both = lambda f: [rows(f(e)) for e in ENGINES]
    near = lambda f: [{(r[0], round(r[1], 9)) for r in f(e).collect()} for e in ENGINES]
    for f in (lambda e: bfs(g, source, e), lambda e: discovery_order(g, source, e), lambda e: sssp(g, source, engine=e), lambda e: connected_components(g, e)):
        a, b = both(f)
        assert a == b
    assert rows(sssp(g, source, delta=50, engine="cluster")) == both(lambda e: sssp(g, source, engine=e))[0]
    assert len(rows(sssp(g, source, fill_unreachable=True))) == 64 and any(d == UNREACHABLE for _, d in rows(sssp(g, source, fill_unreachable=True))) == (len(rows(sssp(g, source))) < 64)
    for f in (lambda e: pagerank(g, 20, 4e-4, e), lambda e: betweenness(g, [source, 1, 2], engine=e), lambda e: betweenness(g, [source], False, e)):
        a, b = near(f)
        assert a == b
    assert verify_bfs(g, source, bfs(g, source)).first().valid and verify_sssp(g, source, sssp(g, source)).first().valid
    assert verify_components(g, connected_components(g)).first().valid
    assert not verify_pagerank(g, pagerank(g, 1), 1e-9).first().valid


def test_undirected_in_is_out(spark):
    g = graph(spark, [(1, 2, 3), (2, 1, 1), (2, 3, 4)], directed=False)
    assert rows(g.edges) == {(1, 2, 1), (2, 1, 1), (2, 3, 4), (3, 2, 4)} and g.num_edges() == 2
    assert [r.id for r in g.in_neigh(2).collect()] == [r.id for r in g.out_neigh(2).collect()] == [1, 3]


def test_edge_list_files(spark, tmp_path):
    (tmp_path / "a").write_text("1 2 +2\n1 3 -1\n1 4  1.5\n1 5 \n9\t4\n7 8 5 920588400")
    got = read_edge_list(spark, str(tmp_path / "a"))
    assert rows(got) == {(1, 2, 2), (1, 3, None), (1, 4, None), (1, 5, None), (9, 4, None), (7, 8, 5)}
    write_edge_list(got, str(tmp_path / "b"))
    assert rows(read_edge_list(spark, str(tmp_path / "b"))) == rows(got)
    (tmp_path / "c").write_text("1 2\nx 3\n")
    with pytest.raises(Exception, match="not an edge"):
        read_edge_list(spark, str(tmp_path / "c")).collect()


def test_generators(spark):
    for n in (5, 64, 100, 128):
        ids = spark.range(n).selectExpr("id as src", "id as dst", "1L as weight")
        assert sorted(r.src for r in generate.permute_ids(ids, n, 3).collect()) == list(range(n))
    a, b = (rows(generate.rmat_edges(spark, 7, 4, seed=9, parts=p).select("src", "dst")) for p in (1, 5))
    assert a == b
    assert rows(generate.binary_tree(spark, 1)) == {(0, 1, 2), (1, None, None), (2, None, None)}
    ops = generate.random_ops(spark, 2000, 50, 10).groupBy("op").count().collect()
    assert {r.op for r in ops} == {"FIND", "INSERT", "DELETE", "INSERT_EDGE", "DELETE_EDGE"}


def log(spark, *ops):
    return spark.createDataFrame([(t, k, op, v, e, None, None) for k, (t, op, v, e) in enumerate(ops)], LOG)


def state(spark, ids, edges=()):
    return spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(*e, None) for e in edges], RAW)


def test_transactions(spark):
    a = log(spark, (1, "INSERT", 5, None), (1, "FIND", 9, None), (1, "INSERT", 6, None), (2, "INSERT", 7, None), (2, "FIND", 1, None))
    v, e, said = apply_txns(*state(spark, [1]), a)
    assert rows(v) == {(1,), (7,)} and [tuple(r)[:2] for r in said.orderBy("txn_id").collect()] == [(1, "Aborted"), (2, "Committed")]
    v, _, _ = apply_txns(*state(spark, [1]), log(spark, (1, "INSERT", 5, None), (1, "FIND", 5, None)))
    assert rows(v) == {(1,)}
    strict = log(spark, (1, "INSERT", 5, None), (1, "DELETE", 9, None))
    assert rows(apply_txns(*state(spark, [1]), strict)[0]) == {(1,), (5,)} and rows(apply_txns(*state(spark, [1]), strict, strict=True)[0]) == {(1,)}
    cut = log(spark, (1, "INSERT_EDGE", 1, 2), (1, "DELETE", 2, None), (1, "INSERT", 2, None))
    for f in (apply_ops, apply_txns):
        v, e = f(*state(spark, [1, 2]), cut)[:2]
        assert rows(v) == {(1,), (2,)} and rows(e) == set()
    with pytest.raises(Exception, match="not allowed"):
        apply_ops(*state(spark, [1]), log(spark, (1, "CONNECT", 1, 1)))[0].collect()


def simulate(ids, edges, ops):
    vertices, edges, said = set(ids), set(edges), []
    for _, op, v, e in ops:
        ok = {"FIND": v in vertices, "DELETE": v in vertices, "INSERT": v not in vertices}.get(op)
        if op == "INSERT":
            said.append("Inserted" if ok else "Success")
            vertices.add(v)
        elif op == "DELETE":
            said.append("Deleted" if ok else "Fail")
            vertices.discard(v)
            edges = {x for x in edges if v not in x}
        elif op == "FIND":
            said.append("Found" if ok else "Fail")
        elif op == "INSERT_EDGE":
            good = {v, e} <= vertices and (v, e) not in edges
            said.append("Inserted" if good else "Fail")
            edges |= {(v, e)} if good else set()
        else:
            said.append("Deleted" if (v, e) in edges else "Fail")
            edges.discard((v, e))
    return vertices, edges, said


def test_single_operations_equal_a_simulation(spark):
    rng = random.Random(4)
    ops = [(k, rng.choice(["FIND", "INSERT", "DELETE", "INSERT", "INSERT_EDGE", "INSERT_EDGE", "DELETE_EDGE"]), rng.randrange(6), rng.randrange(6)) for k in range(500)]
    ops = [(k, op, v, e if "EDGE" in op else None) for k, op, v, e in ops]
    start = [0, 1, 2, 3], [(0, 1), (1, 2)]
    vertices, edges, said = simulate(*start, ops)
    df = log(spark, *ops)
    v, e = apply_ops(*state(spark, *start), df)
    assert {r.id for r in v.collect()} == vertices and {(r.src, r.dst) for r in e.collect()} == edges
    got = [r.status for r in op_results(*state(spark, *start), df).orderBy("op_seq").collect()]
    assert got == said
    assert both_directions(log(spark, (1, "INSERT_EDGE", 1, 2))).count() == 2


def test_stream(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.create(*state(spark, [1, 2]))
    source = str(tmp_path / "log")
    parts = [log(spark, (1, "INSERT", 3, None), (1, "INSERT_EDGE", 1, 2)), log(spark, (2, "FIND", 9, None), (2, "INSERT", 4, None)), log(spark, (1, "INSERT", 8, None), (3, "DELETE", 2, None))]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(source)
        stream_ops(spark, source, store, str(tmp_path / "checkpoint")).awaitTermination(120)
    v, e = store.graph()
    assert rows(v) == {(1,), (3,)} and rows(e) == set()
    assert [tuple(r)[:2] for r in store.results().orderBy("txn_id", "txn_status").collect()] == [(1, "Committed"), (1, "Late"), (2, "Aborted"), (3, "Committed")]
    store.apply(parts[0], 0)
    assert rows(store.graph()[0]) == {(1,), (3,)}


def walk(ids, edges, txns, strict):
    """Transactions one by one, each judged by the state before it."""
    vertices, edges, said = set(ids), dict(edges), []
    for t, ops in txns:
        fails = []
        for op, v, e, _ in ops:
            ends = v in vertices and e in vertices
            fails.append({"FIND": v not in vertices, "DELETE": v not in vertices, "INSERT": False, "INSERT_EDGE": not ends or (v, e) in edges, "DELETE_EDGE": (v, e) not in edges}[op])
        abort = any(f and (strict or op[0] == "FIND") for f, op in zip(fails, ops, strict=True))
        said.append((t, "Aborted" if abort else "Committed", sum(fails)))
        if abort:
            continue
        now, made = set(vertices), dict(edges)
        for op, v, e, w in ops:
            if op == "INSERT":
                now.add(v)
            elif op == "DELETE":
                now.discard(v)
                made = {x: k for x, k in made.items() if v not in x}
            elif op == "INSERT_EDGE" and {v, e} <= vertices and (v, e) not in edges:
                made[v, e] = w
            elif op == "DELETE_EDGE" and {v, e} <= vertices:
                made.pop((v, e), None)
        vertices, edges = now, made
    return vertices, edges, said


@pytest.mark.parametrize("seed, strict", [(1, False), (2, False), (3, True), (4, True)])
def test_transactions_against_a_walk(spark, seed, strict):
    rng = random.Random(seed)
    ops = ["FIND", "INSERT", "INSERT", "INSERT", "DELETE", "INSERT_EDGE", "INSERT_EDGE", "INSERT_EDGE", "DELETE_EDGE"]
    txns = [(t, [(rng.choice(ops), rng.randrange(6), rng.randrange(6), rng.randrange(100)) for _ in range(1 + rng.randrange(4))]) for t in range(60)]
    ids, first = range(4), {(0, 1): 7, (1, 2): 8, (3, 0): 9}
    flat = [(t, op, v, e if "EDGE" in op else None, w) for t, x in txns for op, v, e, w in x]
    log = spark.createDataFrame([(t, k, op, v, e, None, w) for k, (t, op, v, e, w) in enumerate(flat)], LOG)
    state = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(*k, w) for k, w in first.items()], RAW)
    v, e, said = apply_txns(*state, log, strict)
    want = walk(ids, first, txns, strict)
    assert {x[1] for x in want[2]} == {"Aborted", "Committed"}
    assert sorted(map(tuple, said.collect())) == want[2]
    assert rows(v) == {(i,) for i in want[0]} and rows(e) == {(*k, w) for k, w in want[1].items()}


def test_transactions_take_the_whole_log(spark):
    events = sorted(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_id", "user_id").collect())
    there = {r.user_id for r in events}
    for r in events:
        k = r.event_id * 7 % 10
        (there.add if k < 4 else there.discard if k < 8 else lambda v: None)(r.user_id)
    assert len(events) > 200
    assert rows(queries.QUERIES["txns_final_vertices"](spark, "/root/testdata/sf0.001")) == {(v,) for v in there}


def test_components_read_every_order(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    orders, n = [tuple(r) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect()], spark.read.parquet(f"{sf}/customer.parquet").count()
    # customers in pairs of their own: only orders that the sparse graph leaves out hold them together
    key = {o * 7919 % n: o for _, o in orders if o % 20}
    few = [(b - 1, key[b]) for b in range(1, n, 2) if b in key]
    assert len(few) > 20
    spark.createDataFrame(few, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(n).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    want = {(k, k) for k in range(n)} - {(c + 1, c + 1) for c, _ in few} | {(c + 1, c) for c, _ in few}
    assert rows(queries.QUERIES["components_all_orders"](spark, str(tmp_path))) == want
    sizes = rows(queries.QUERIES["components_all_orders_by_size"](spark, str(tmp_path)))
    assert sum(s for _, s in sizes) == n and sum(s == 2 for _, s in sizes) == len(few)
    assert queries.QUERIES["components_all_orders_verified"](spark, str(tmp_path)).first().valid


def test_records_are_counted_with_and_without_a_number_of_vertices(spark):
    edges = [(1, 2, 1), (1, 2, 5), (2, 2, 1), (0, 1, 3), (-1, 2, 1)]
    for n in (None, 3):
        assert graph(spark, edges, num_vertices=n).num_edges_directed() == 5
        assert graph(spark, edges, num_vertices=n, directed=False).num_edges_directed() == 10
        assert rows(graph(spark, edges, num_vertices=n).edges) == {(1, 2, 1), (0, 1, 3)}


def test_distances_that_only_support_each_other_are_refused(spark):
    g = graph(spark, [(1, 2, 0), (2, 1, 0), (0, 3, 4)])
    claimed = lambda *x: spark.createDataFrame(list(x), "id long, dist long")
    assert not verify_sssp(g, 0, claimed((0, 0), (3, 4), (1, 5), (2, 5))).first().valid
    assert verify_sssp(g, 0, claimed((0, 0), (3, 4))).first().valid
    joined = graph(spark, [(1, 2, 0), (2, 1, 0), (0, 1, 4)])
    assert verify_sssp(joined, 0, sssp(joined, 0)).first().valid


def test_an_adjacency_can_be_emptied(tiny, spark):
    none = tiny.edges.limit(0)
    assert rows(tiny.replace_out_edges(none, spark.createDataFrame([(1,)], "id long")).edges) == {(3, 2, 1), (4, 2, 1), (5, 2, 1)}
    assert rows(tiny.replace_in_edges(none, spark.createDataFrame([(2,)], "id long")).edges) == {(1, 3, 1)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 1024])
def test_permutations_are_bijections(spark, n):
    ids = spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    moved = [r.src for r in generate.permute_ids(ids, n, seed=4).collect()]
    assert sorted(moved) == list(range(n))
    if n >= 1000:
        steps = {(b - a) % n for a, b in zip(moved, moved[1:], strict=False)}
        assert len(steps) > n // 4 and moved != [r.src for r in generate.permute_ids(ids, n, seed=5).collect()]


def test_tree_depth_follows_the_children(spark):
    tree = spark.createDataFrame([(0, 9, 4), (9, 2, None), (2, None, 7), (7, None, None), (4, None, None)], "id long, left long, right long")
    assert generate.tree_spine(tree, "left").first().depth == 2 and generate.tree_spine(tree, "right").first().depth == 1
    assert generate.tree_spine(tree.filter("id = 4").withColumn("id", F.lit(0)), "left").first().depth == 0


def test_rounds_read_edges_dealt_once(spark):
    g = graph(spark, [(k, (k * 7 + 1) % 50, 1) for k in range(50)]).settled()
    front = spark.range(50).select(F.col("id").alias("src"))
    plan = g.edges.join(front.hint("merge"), "src").groupBy("src").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1, plan


def test_triangles_of_a_dense_graph_with_a_hub(spark):
    rng = np.random.default_rng(5)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 25, (160, 2)) if a != b} | {(12, k) for k in range(25) if k != 12} | {(k, 12) for k in range(20, 25)}
    both = edges | {(b, a) for a, b in edges}
    plain = sum((u, v) in both and (v, w) in both and (u, w) in both for u in range(25) for v in range(u) for w in range(v))
    ordered = sum((u, v) in edges and (v, w) in edges and (u, w) in edges for u in range(25) for v in range(u) for w in range(v))
    g = graph(spark, sorted(edges))
    assert plain > ordered > 0
    assert triangle_count(g).first()[0] == plain and triangle_count_ordered(g).first()[0] == ordered
    assert verify_triangles(g, plain).first().valid and not verify_triangles(g, plain + 1).first().valid
