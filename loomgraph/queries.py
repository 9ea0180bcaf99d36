"""Registered graph queries and their SQL oracles.

The graphs are derived from the relational tables: ``ord`` (customers, an edge per order, weighted), ``sparse`` (a
twentieth of it, for components of several sizes; ``components_all_orders`` takes all), ``cp`` (customer to part), ``nt`` (nation to nation), ``evt`` (a user to the next)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions.normalise import count_degrees, dedup_edges, drop_loops, max_node_id, restrict_to_vertices, symmetrize, transpose
from .operators.betweenness import betweenness
from .operators.components import component_sizes, connected_components, verify_components
from .operators.graph import Graph
from .operators.mutation import apply_ops, apply_txns, op_results, seq_of
from .operators.paths import sssp, verify_sssp
from .operators.rank import pagerank, verify_pagerank
from .operators.traversal import bfs, bfs_goal_rank, discovery_order, reachable_count, verify_bfs
from .operators.triangles import triangle_count, triangle_count_ordered, triangles_per_vertex, verify_triangles
from .plans.store import scratch
from .sources import generate
from .sources.edges import edges_from_table, read_edge_list, write_edge_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register the decorated function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    n = table(spark, sf_dir, "customer").count()
    return edges_from_table(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey") * 7919 % n, 1 + F.col("o_orderkey") % 255), n


def ord_graph(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    raw, n = raw_orders(spark, sf_dir)
    return Graph.from_edges(raw, directed, n)


def sparse_graph(spark: SparkSession, sf_dir: str) -> Graph:
    n = table(spark, sf_dir, "customer").count()
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0")
    return Graph.from_edges(edges_from_table(rows, "o_custkey", F.col("o_orderkey") * 7919 % n), True, n)


def op_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All users, and the log of operations that the events stand for."""
    events = table(spark, sf_dir, "events")
    users = events.select(F.col("user_id").alias("id")).distinct()
    n = users.count()
    k = F.col("event_id") * 7 % 10
    op = F.when(k < 4, "INSERT").when(k < 8, "DELETE").when(k == 8, "INSERT_EDGE").otherwise("DELETE_EDGE")
    null = F.lit(None).cast("long")
    log = events.select(seq_of(F.col("ts"), F.col("event_id")).alias("op_seq"), op.alias("op"), F.col("user_id").alias("v"), F.when(k >= 8, F.col("event_id") * 31 % n).alias("e"), null.alias("value"), null.alias("weight"))
    return users, log.withColumn("txn_id", F.col("op_seq"))


ORD = """n as (select count(*) as n from customer),
raw as (select o_custkey as src, (o_orderkey * 7919) % (select n from n) as dst, 1 + o_orderkey % 255 as weight from orders),
g as (select src, dst, min(weight) as weight from raw where src <> dst group by src, dst),
u as (select distinct least(src, dst) as a, greatest(src, dst) as b from g),
v as (select c_custkey as id from customer)"""
SPARSE = """n as (select count(*) as n from customer),
g as (select distinct o_custkey as src, (o_orderkey * 7919) % (select n from n) as dst from orders where o_orderkey % 20 = 0 and o_custkey <> (o_orderkey * 7919) % (select n from n)),
v as (select c_custkey as id from customer)"""
DEPTHS = f"""with recursive {ORD},
r(id, depth) as (select 0::bigint, 0 union select g.dst, r.depth + 1 from r join g on g.src = r.id where r.depth < 25),
d as (select id, min(depth) as depth from r group by id)"""


# --- degrees, construction, access -----------------------------------------------------------------------------


@query("select o_custkey as id, count(*) as out_degree from orders group by o_custkey order by 2 desc, 1 limit 10")
def top_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers of most orders, parallels included."""
    found = count_degrees(raw_orders(spark, sf_dir)[0], both_ends=False)
    return found.select("id", F.col("degree").alias("out_degree")).orderBy(F.desc("out_degree"), "id").limit(10)


@query(f"with {ORD} select id, count(src) as out_degree from v left join g on src = id group by id")
def out_degree(spark, sf_dir):
    return ord_graph(spark, sf_dir).out_degree()


@query(f"with {ORD} select id, count(dst) as in_degree from v left join g on dst = id group by id")
def in_degree(spark, sf_dir):
    return ord_graph(spark, sf_dir).in_degree()


@query(f"with {ORD}, d as (select id, count(src) as out_degree from v left join g on src = id group by id) select out_degree, count(*) as vertices from d group by out_degree")
def degree_distribution(spark, sf_dir):
    return ord_graph(spark, sf_dir).out_degree().groupBy("out_degree").agg(F.count("*").alias("vertices"))


@query(f"with {ORD} select id, count(*) as degree from (select src as id from raw union all select dst from raw) group by id")
def degree_counts(spark, sf_dir):
    return count_degrees(raw_orders(spark, sf_dir)[0])


@query(f"with {ORD} select max(greatest(src, dst)) as max_id from raw")
def max_node(spark, sf_dir):
    return max_node_id(raw_orders(spark, sf_dir)[0])


@query(f"with {ORD}, d as (select count(*) as c from g group by src) select (select n from n) as nodes, (select count(*) from g) as edges, (select max(c) from d) as max_out_degree")
def graph_stats(spark, sf_dir):
    return ord_graph(spark, sf_dir).stats()


@query(f"with {ORD} select (select n from n) as nodes, (select count(*) from u) as edges, (select 2 * count(*) from raw) as records")
def undirected_counts(spark, sf_dir):
    raw, _ = raw_orders(spark, sf_dir)
    g = Graph.from_edges(raw, directed=False)
    return spark.createDataFrame([(g.num_nodes(), g.num_edges(), g.num_edges_directed())], "nodes long, edges long, records long")


@query(f"with {ORD} select 'directed' as kind, count(*) as records from raw union all select 'undirected', 2 * count(*) from raw")
def input_records(spark, sf_dir):
    """Records of a graph whose number of vertices is given."""
    made = [(k, ord_graph(spark, sf_dir, k == "directed").num_edges_directed()) for k in ("directed", "undirected")]
    return spark.createDataFrame(made, "kind string, records long")


@query(f"with {ORD} select src, dst, weight from raw")
def edge_list_round_trip(spark, sf_dir):
    """All orders written as edge-list text and read again."""
    path = scratch(spark, "edge-list")
    write_edge_list(raw_orders(spark, sf_dir)[0], path)
    return read_edge_list(spark, path)


@query(f"with {ORD} select src, dst, weight from g")
def edges_simple(spark, sf_dir):
    return ord_graph(spark, sf_dir).edges


@query(f"with {ORD} select src, dst, weight from raw where src <> dst")
def edges_no_loops(spark, sf_dir):
    return drop_loops(raw_orders(spark, sf_dir)[0])


@query(f"with {ORD} select dst as src, src as dst, weight from g")
def edges_transposed(spark, sf_dir):
    return transpose(ord_graph(spark, sf_dir).edges)


@query(f"with {ORD}, b as (select src, dst, weight from raw union all select dst, src, weight from raw) select src, dst, min(weight) as weight from b where src <> dst group by src, dst")
def edges_symmetric(spark, sf_dir):
    return dedup_edges(symmetrize(drop_loops(raw_orders(spark, sf_dir)[0])))


@query(f"with {ORD} select src, dst, arg_max(weight, k) as weight from (select src, dst, weight, o_orderkey as k from (select o_custkey as src, (o_orderkey * 7919) % (select n from n) as dst, 1 + o_orderkey % 255 as weight, o_orderkey from orders)) where src <> dst group by src, dst")
def edges_last_weight(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7919 % n).alias("dst"), (1 + F.col("o_orderkey") % 255).alias("weight"), F.col("o_orderkey").alias("k"))
    return dedup_edges(drop_loops(raw), "last", "k")


@query(f"with {ORD} select src, dst, weight from g where src % 3 <> 0 and dst % 3 <> 0")
def edges_restricted(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    return restrict_to_vertices(g.edges, g.vertices.filter("id % 3 <> 0"))


@query(f"with {ORD} select src, dst, weight from g where src % 10 <> 0 union all select id, id + 1, 7 from v where id % 10 = 0 and id + 1 < (select n from n)")
def edges_replaced_out(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    new = g.vertices.filter("id % 10 = 0").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(7).cast("long").alias("weight"))
    return g.replace_out_edges(new).edges


@query(f"with {ORD} select src, dst, weight from g where dst % 10 <> 0 union all select id + 1, id, 7 from v where id % 10 = 0 and id + 1 < (select n from n)")
def edges_replaced_in(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    new = g.vertices.filter("id % 10 = 0").select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"), F.lit(7).cast("long").alias("weight"))
    return g.replace_in_edges(new).edges


@query(f"with {ORD} select src, dst, weight from g where src % 10 <> 0")
def edges_emptied_out(spark, sf_dir):
    """Every tenth vertex gets an empty adjacency."""
    g = ord_graph(spark, sf_dir)
    return g.replace_out_edges(g.edges.limit(0), g.vertices.filter("id % 10 = 0")).edges


@query(f"with {ORD} select src as id, string_agg(dst || ':' || weight, ',' order by dst) as neighbours from g group by src")
def out_neighbours(spark, sf_dir):
    said = F.array_join(F.transform("neighbours", lambda x: F.concat_ws(":", x.dst.cast("string"), x.weight.cast("string"))), ",")
    return ord_graph(spark, sf_dir).adjacency().select("id", said.alias("neighbours"))


@query(f"with {ORD} select 'out' as side, dst as id, weight from g where src = 7 union all select 'in', src, weight from g where dst = 7")
def neighbours_of_seven(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    return g.out_neigh(7).select(F.lit("out").alias("side"), "id", "weight").union(g.in_neigh(7).select(F.lit("in"), "id", "weight"))


@query(f"with {ORD} select id from v where id = 3")
def find_vertex(spark, sf_dir):
    return ord_graph(spark, sf_dir).find_vertex(3)


@query("select distinct o_custkey as src, l_partkey as dst from orders join lineitem on o_orderkey = l_orderkey where o_custkey <> l_partkey")
def customer_part_edges(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return drop_loops(edges_from_table(both, "o_custkey", "l_partkey")).select("src", "dst").distinct()


@query("""select c_nationkey::bigint as src, s_nationkey::bigint as dst, count(*) as weight from customer join orders on c_custkey = o_custkey
join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2""")
def nation_edges(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return dedup_edges(drop_loops(edges_from_table(lines, "c_nationkey", "s_nationkey", F.lit(1))), "sum")


@query("""select distinct user_id as src, nxt as dst from (select user_id, lead(user_id) over (order by ts, event_id) as nxt from events) where nxt is not null and nxt <> user_id""")
def event_edges(spark, sf_dir):
    # a total order of all events; each row needs the one right after it
    after = table(spark, sf_dir, "events").select("user_id", F.lead("user_id").over(Window.orderBy("ts", "event_id")).alias("nxt"))
    return drop_loops(edges_from_table(after, "user_id", "nxt")).select("src", "dst").distinct()


# --- traversal ---------------------------------------------------------------------------------------------------


@query(f"{DEPTHS} select id, depth from d")
def bfs_depth(spark, sf_dir):
    return bfs(ord_graph(spark, sf_dir), 0).select("id", "depth")


@query(f"{DEPTHS} select d.id, coalesce(min(p.id), 0) as parent from d left join (g join d p on g.src = p.id) on g.dst = d.id and p.depth = d.depth - 1 group by d.id")
def bfs_parent(spark, sf_dir):
    return bfs(ord_graph(spark, sf_dir), 0).select("id", "parent")


@query(f"{DEPTHS} select count(*) as reached from d")
def bfs_reachable_count(spark, sf_dir):
    return reachable_count(ord_graph(spark, sf_dir), 0)


@query(f"{DEPTHS} select true as valid")
def bfs_verified(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    return verify_bfs(g, 0, bfs(g, 0))


_ORDER = "l0 as materialized (select 0::bigint as id, 0::bigint as rank)"
for _k in range(1, 13):
    _ORDER += f""",
n{_k} as materialized (select dst as id, min(rank) as pby from g join (select * from l{_k - 1}) p on g.src = p.id where dst in (select id from d where depth = {_k}) group by dst),
l{_k} as materialized (select id, (select count(*) from d where depth < {_k}) + row_number() over (order by pby, id) - 1 as rank from n{_k})"""
_ORDER += ",\nfifo as (" + " union all ".join(f"select * from l{k}" for k in range(13)) + ")"


@query(f"{DEPTHS}, {_ORDER} select id, rank::bigint as rank from fifo")
def bfs_discovery_order(spark, sf_dir):
    return discovery_order(ord_graph(spark, sf_dir), 0)


@query(f"{DEPTHS}, {_ORDER} select rank::bigint as rank from fifo where id = 77")
def bfs_rank_of_goal(spark, sf_dir):
    return bfs_goal_rank(ord_graph(spark, sf_dir), 0, 77)


# --- shortest paths, rank, components ------------------------------------------------------------------------------

SSSP = f"""with recursive {ORD},
r(id, dist) using key (id) as (select 0::bigint, 0::bigint union
  select g.dst, min(r.dist + g.weight) from r join g on g.src = r.id left join recurring.r as o on o.id = g.dst where o.dist is null or r.dist + g.weight < o.dist group by g.dst)"""


@query(f"{SSSP} select id, dist from r")
def shortest_paths(spark, sf_dir):
    return sssp(ord_graph(spark, sf_dir), 0)


@query(f"{SSSP} select count(*) as reached, sum(dist)::bigint as total, max(dist) as farthest from r")
def shortest_path_summary(spark, sf_dir):
    return sssp(ord_graph(spark, sf_dir), 0, delta=64).agg(F.count("*").alias("reached"), F.sum("dist").alias("total"), F.max("dist").alias("farthest"))


@query("select true as valid")
def shortest_paths_verified(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    return verify_sssp(g, 0, sssp(g, 0))


_RANKS = f"with {ORD}, od as (select src, count(*) as deg from g group by src), s0 as materialized (select id, 1.0::double / n as score, 0.0::double as change from v, n)"
for _k in range(1, 21):
    _RANKS += f""", s{_k} as materialized (select o.id, 0.15::double / n + 0.85::double * coalesce(x.gain, 0) as score, abs(0.15::double / n + 0.85::double * coalesce(x.gain, 0) - o.score) as change
from s{_k - 1} o cross join n left join (select g.dst, sum(p.score / od.deg) as gain from g join od on g.src = od.src join s{_k - 1} p on p.id = g.src group by g.dst) x on x.dst = o.id)"""
_ERRORS = "e as (" + " union all ".join(f"select {k} as k, sum(change) as err from s{k}" for k in range(1, 21)) + "), stop as (select coalesce(min(k) filter (where err < 0.0004), 20) as k from e)"
_EVERY = " union all ".join(f"select {k} as k, id, score from s{k}" for k in range(1, 21))


@query(f"{_RANKS} select id, round(score, 10) as score from s20")
def pagerank_20(spark, sf_dir):
    return pagerank(ord_graph(spark, sf_dir), 20).select("id", F.round("score", 10).alias("score"))


@query(f"{_RANKS}, {_ERRORS}, every as ({_EVERY}) select id, round(score, 10) as score from every join stop using (k)")
def pagerank_eps(spark, sf_dir):
    return pagerank(ord_graph(spark, sf_dir), 20, 4e-4).select("id", F.round("score", 10).alias("score"))


@query("select true as valid")
def pagerank_verified(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    return verify_pagerank(g, pagerank(g, 20)).select("valid")


COMPONENTS = f"""with recursive {SPARSE}, b as (select src, dst from g union select dst, src from g),
r(id, label) using key (id) as (select id, id from v union
  select b.dst, min(r.label) from r join b on b.src = r.id join recurring.r as o on o.id = b.dst where r.label < o.label group by b.dst)"""


@query(f"{COMPONENTS} select id, label as component from r")
def components(spark, sf_dir):
    return connected_components(sparse_graph(spark, sf_dir))


@query(f"{COMPONENTS} select label as component, count(*) as size from r group by label")
def components_by_size(spark, sf_dir):
    return component_sizes(connected_components(sparse_graph(spark, sf_dir)))


@query("select true as valid")
def components_verified(spark, sf_dir):
    g = sparse_graph(spark, sf_dir)
    return verify_components(g, connected_components(g))


ALL_COMPONENTS = COMPONENTS.replace(SPARSE, ORD)


@query(f"{ALL_COMPONENTS} select id, label as component from r")
def components_all_orders(spark, sf_dir):
    return connected_components(ord_graph(spark, sf_dir))


@query(f"{ALL_COMPONENTS} select label as component, count(*) as size from r group by label")
def components_all_orders_by_size(spark, sf_dir):
    return component_sizes(connected_components(ord_graph(spark, sf_dir)))


@query("select true as valid")
def components_all_orders_verified(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    return verify_components(g, connected_components(g))


# --- triangles, betweenness ------------------------------------------------------------------------------------------


@query(f"with {ORD}, x as (select * from g where src > dst) select count(*) as triangles from x a join x b on a.dst = b.src join x c on c.src = a.src and c.dst = b.dst")
def triangles_ordered(spark, sf_dir):
    return triangle_count_ordered(ord_graph(spark, sf_dir))


@query(f"with {ORD} select count(*) as triangles from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b")
def triangles_undirected(spark, sf_dir):
    return triangle_count(ord_graph(spark, sf_dir))


@query(f"with {ORD}, t as (select x.a as p, x.b as q, y.b as r from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b) select id, count(*) as triangles from (select p as id from t union all select q from t union all select r from t) group by id")
def triangles_by_vertex(spark, sf_dir):
    return triangles_per_vertex(ord_graph(spark, sf_dir))


@query("select true as valid")
def triangles_verified(spark, sf_dir):
    g = ord_graph(spark, sf_dir)
    return verify_triangles(g, triangle_count(g).first().triangles)


_DEEP = 10
_BC = "f0 as materialized (select 0::bigint as id, 1.0::double as sigma)"
for _k in range(1, _DEEP + 1):
    _BC += f", f{_k} as materialized (select g.dst as id, sum(f.sigma) as sigma from g join f{_k - 1} f on f.id = g.src where g.dst in (select id from d where depth = {_k}) group by g.dst)"
_BC += f", b{_DEEP} as materialized (select id, 0.0::double as delta from f{_DEEP})"
for _k in range(_DEEP - 1, -1, -1):
    _BC += f", b{_k} as materialized (select f.id, coalesce(sum(f.sigma / t.sigma * (1 + b.delta)), 0) as delta from f{_k} f left join (g join f{_k + 1} t on t.id = g.dst join b{_k + 1} b on b.id = t.id) on g.src = f.id group by f.id)"
_BC += ", bc as (" + " union all ".join(f"select * from b{k}" for k in range(_DEEP + 1)) + "), top as (select max(delta) as m from bc)"


@query(f"{DEPTHS}, {_BC} select v.id, round(coalesce(bc.delta, 0) / m, 9) as score from v cross join top left join bc on bc.id = v.id")
def betweenness_single_source(spark, sf_dir):
    return betweenness(ord_graph(spark, sf_dir), [0]).select("id", F.round("score", 9).alias("score"))


def _paths_from(s: int) -> str:
    """Depths, path counts and dependencies from one source, as common table expressions."""
    out = f"""r{s}(id, depth) as (select {s}::bigint, 0 union select g.dst, r{s}.depth + 1 from r{s} join g on g.src = r{s}.id where r{s}.depth < 25),
d{s} as materialized (select id, min(depth) as depth from r{s} group by id), f{s}_0 as materialized (select {s}::bigint as id, 1.0::double as sigma)"""
    for k in range(1, _DEEP + 1):
        out += f", f{s}_{k} as materialized (select g.dst as id, sum(f.sigma) as sigma from g join f{s}_{k - 1} f on f.id = g.src where g.dst in (select id from d{s} where depth = {k}) group by g.dst)"
    out += f", b{s}_{_DEEP} as materialized (select id, 0.0::double as delta from f{s}_{_DEEP})"
    for k in range(_DEEP - 1, -1, -1):
        out += f", b{s}_{k} as materialized (select f.id, coalesce(sum(f.sigma / t.sigma * (1 + b.delta)), 0) as delta from f{s}_{k} f left join (g join f{s}_{k + 1} t on t.id = g.dst join b{s}_{k + 1} b on b.id = t.id) on g.src = f.id group by f.id)"
    return out


_THREE = (1, 2, 3)
_BC3 = "with recursive " + ORD + "".join(f",\n{_paths_from(x)}" for x in _THREE)
_BC3 += ", bc as (select id, sum(delta) as raw from (" + " union all ".join(f"select id, delta from b{x}_{k} where id <> {x}" for x in _THREE for k in range(_DEEP + 1)) + ") group by id), top as (select max(raw) as m from bc)"


@query(f"{_BC3} select v.id, round(coalesce(raw, 0) / m, 9) as score from v cross join top left join bc on bc.id = v.id")
def betweenness_three_sources(spark, sf_dir):
    """Sources' own dependencies are left out."""
    return betweenness(ord_graph(spark, sf_dir), list(_THREE), include_source=False).select("id", F.round("score", 9).alias("score"))


# --- the plans for large graphs, whatever the size ----------------------------------------------------------------------


@query(ORACLES["bfs_parent"])
def bfs_parent_by_rounds(spark, sf_dir):
    return bfs(ord_graph(spark, sf_dir), 0, "cluster").select("id", "parent")


@query(ORACLES["bfs_discovery_order"])
def bfs_discovery_order_by_rounds(spark, sf_dir):
    return discovery_order(ord_graph(spark, sf_dir), 0, "cluster")


@query(ORACLES["shortest_paths"])
def shortest_paths_by_buckets(spark, sf_dir):
    return sssp(ord_graph(spark, sf_dir), 0, delta=64, engine="cluster")


@query(ORACLES["pagerank_eps"])
def pagerank_eps_by_rounds(spark, sf_dir):
    return pagerank(ord_graph(spark, sf_dir), 20, 4e-4, "cluster").select("id", F.round("score", 10).alias("score"))


@query(ORACLES["components_all_orders"])
def components_by_rounds(spark, sf_dir):
    return connected_components(ord_graph(spark, sf_dir), "cluster")


@query(ORACLES["betweenness_single_source"])
def betweenness_by_rounds(spark, sf_dir):
    return betweenness(ord_graph(spark, sf_dir), [0], engine="cluster").select("id", F.round("score", 9).alias("score"))


# --- mutation -----------------------------------------------------------------------------------------------------------

LOG = """n as (select count(distinct user_id) as n from events),
l as (select row_number() over (order by ts, event_id) as seq, (event_id * 7) % 10 as k, user_id as v, (event_id * 31) % (select n from n) as e from events),
h as (select distinct user_id as id, -1::bigint as seq, true as there from events union all select v, seq, k < 4 from l where k < 8),
fv as (select id from h group by id having arg_max(there, seq)),
p as (select seq, v as id from l where k >= 8 union all select seq, e from l where k >= 8),
pe as (select p.seq, bool_and(coalesce((select arg_max(h.there, h.seq) from h where h.id = p.id and h.seq < p.seq), false)) as ok from p group by p.seq),
ee as (select l.v as src, l.e as dst, arg_max(k = 8, l.seq) as made, max(l.seq) as seq from l join pe on pe.seq = l.seq and pe.ok where k >= 8 group by 1, 2),
cut as (select v as id, max(seq) as seq from l where k between 4 and 7 group by v),
fe as (select src, dst from ee where made and not exists (select 1 from cut where cut.id in (src, dst) and cut.seq > ee.seq))"""


@query(f"with {LOG} select id from fv")
def ops_final_vertices(spark, sf_dir):
    users, log = op_log(spark, sf_dir)
    return apply_ops(users, spark.createDataFrame([], "src long, dst long, weight long"), log)[0]


@query(f"with {LOG} select src, dst from fe")
def ops_final_edges(spark, sf_dir):
    users, log = op_log(spark, sf_dir)
    return apply_ops(users, spark.createDataFrame([], "src long, dst long, weight long"), log)[1].select("src", "dst")


@query(f"""with {LOG}, s as (select seq, k, coalesce((select arg_max(h.there, h.seq) from h where h.id = l.v and h.seq < l.seq), false) as there from l where k < 8)
select case when k < 4 then 'INSERT' else 'DELETE' end as op, case when k < 4 then case when there then 'Success' else 'Inserted' end else case when there then 'Deleted' else 'Fail' end end as status, count(*) as operations from s group by 1, 2""")
def ops_statuses(spark, sf_dir):
    users, log = op_log(spark, sf_dir)
    found = op_results(users, spark.createDataFrame([], "src long, dst long, weight long"), log)
    return found.filter("op in ('INSERT', 'DELETE')").groupBy("op", "status").agg(F.count("*").alias("operations"))


@query()
def txns_final_vertices(spark, sf_dir):
    """All vertices after the whole log in transactions of twenty operations."""
    users, log = op_log(spark, sf_dir)
    log = log.withColumn("txn_id", F.floor((F.col("op_seq") - 1) / 20).cast("long"))
    return apply_txns(users, spark.createDataFrame([], "src long, dst long, weight long"), log)[0]


@query(f"""with {LOG}, c as (select l.seq, l.k, l.v, l.e, pe.ok from l join pe on pe.seq = l.seq),
m as (select c.*, (select max(d.seq) from l d where d.k between 4 and 7 and d.v in (c.v, c.e) and d.seq < c.seq) as cut,
  (select arg_max(struct_pack(at := p.seq, made := p.k = 8), p.seq) from c p where p.ok and p.v = c.v and p.e = c.e and p.seq < c.seq) as last from c),
t as (select *, coalesce(last.made and (cut is null or last.at > cut), false) as there from m)
select case when k = 8 then 'INSERT_EDGE' else 'DELETE_EDGE' end as op,
  case when not ok then 'Fail' when k = 8 then case when there then 'Fail' else 'Inserted' end when there then 'Deleted' else 'Fail' end as status,
  case when not ok then 'vertex not found' when k = 8 and there then 'edge exists' when k = 9 and not there then 'edge not found' end as message, count(*) as operations from t group by all""")
def ops_edge_statuses(spark, sf_dir):
    users, log = op_log(spark, sf_dir)
    found = op_results(users, spark.createDataFrame([], "src long, dst long, weight long"), log)
    return found.filter("op in ('INSERT_EDGE', 'DELETE_EDGE')").groupBy("op", "status", "message").agg(F.count("*").alias("operations"))


# --- generators -----------------------------------------------------------------------------------------------------------


@query('select id, case when 2 * id + 1 < 2047 then 2 * id + 1 end as "left", case when 2 * id + 2 < 2047 then 2 * id + 2 end as "right" from range(2047) t(id)')
def binary_tree(spark, sf_dir):
    return generate.binary_tree(spark, 10)


@query("select 10 as left_depth, 10 as right_depth")
def binary_tree_depths(spark, sf_dir):
    tree = generate.binary_tree(spark, 10)
    return generate.tree_spine(tree, "left").select(F.col("depth").alias("left_depth")).crossJoin(generate.tree_spine(tree, "right").select(F.col("depth").alias("right_depth")))


@query("select 2560 as edges, true as in_range")
def uniform_generator(spark, sf_dir):
    e = generate.random_weights(generate.uniform_edges(spark))
    return e.agg(F.count("*").cast("int").alias("edges"), F.min(F.col("src").between(0, 255) & F.col("dst").between(0, 255) & F.col("weight").between(1, 255)).alias("in_range"))


@query("select 10240 as edges, true as in_range")
def rmat_generator(spark, sf_dir):
    e = generate.rmat_edges(spark, 10)
    return e.agg(F.count("*").cast("int").alias("edges"), F.min(F.col("src").between(0, 1023) & F.col("dst").between(0, 1023)).alias("in_range"))


@query("select count(*) as ids, count(*) as images, true as in_range from range(1000)")
def id_permutation(spark, sf_dir):
    """Ids 0 .. 999 under the permutation of generated graphs: every one is met once."""
    moved = generate.permute_ids(spark.range(1000).select(F.col("id").alias("src"), F.col("id").alias("dst")), 1000)
    return moved.agg(F.count("*").alias("ids"), F.countDistinct("src").alias("images"), F.min(F.col("src").between(0, 999) & (F.col("src") == F.col("dst"))).alias("in_range"))


@query("select 10240 as edges, true as low_low, true as low_high, true as high_low")
def rmat_quadrants(spark, sf_dir):
    """Shares of the outermost quadrants before the permutation, each within three hundredths of its parameter."""
    e = generate.rmat_edges(spark, 10, permute=False)
    share = lambda c: F.avg(c.cast("double"))
    low_src, low_dst = F.col("src") < 512, F.col("dst") < 512
    near = lambda c, p: F.abs(share(c) - p) < 0.03
    return e.agg(F.count("*").cast("int").alias("edges"), near(low_src & low_dst, generate.A).alias("low_low"), near(low_src & ~low_dst, generate.B).alias("low_high"), near(~low_src & low_dst, generate.C).alias("high_low"))
