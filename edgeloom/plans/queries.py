"""The registered graph queries and the same results in DuckDB's SQL."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.curves import hilbert_key_classic, morton_key
from edgeloom.operators import adjacency, bandwidth, blocking, canonical, components, factorise, ordering, ranges
from edgeloom.operators.pagerank import pagerank, pagerank_blocks
from edgeloom.plans import flows
from edgeloom.shared import cut
from edgeloom.sources import edges as sources
from edgeloom.sources import formats

MOST = 16
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_RAW = {
    "user_next": "select src, dst from (select user_id src, lead(user_id) over (order by ts, event_id) dst from events) where dst is not null",
    "part_supp": "select l_partkey src, l_suppkey dst from lineitem",
    "cust_part": "select o_custkey src, l_partkey dst from lineitem join orders on l_orderkey = o_orderkey",
    "cust_supp": "select o_custkey src, l_suppkey dst from lineitem join orders on l_orderkey = o_orderkey",
    "part_supp_bipartite": "select l_partkey src, l_suppkey + n1 dst from lineitem, (select max(l_partkey) + 1 n1 from lineitem)",
    "order_customer": "select o_orderkey + n1 src, o_custkey dst from orders, (select max(o_custkey) + 1 n1 from orders)",
    "customer_orders": "select o_custkey src, o_orderkey dst from orders",
    "order_part": "select l_orderkey src, l_partkey dst from lineitem",
}
_ENDS = "V as (select src id from E union select dst from E)"
_RANKS = f"{_ENDS}, R as (select id old_id, row_number() over (order by id) - 1 new_id from V)"
_DENSE = f"{_RANKS}, D as (select a.new_id src, b.new_id dst from E join R a on src = a.old_id join R b on dst = b.old_id)"
_ORDER = "K as (select greatest(1, length(bin(max(greatest(src, dst))))) k from E)"


def query(name: str, source: str, sql: str, base: str = "") -> Callable:
    """Register ``f(edges)`` over the distinct edges of ``source``; ``sql`` may use E, and what ``base`` adds.

    A second parameter of ``f`` is the curve's order. It needs only the largest id, which is taken from the source
    before its duplicates are removed, so that nothing has to be stored for it.
    """
    def add(f: Callable[..., DataFrame]) -> Callable:
        curved = len(inspect.signature(f).parameters) == 2

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            raw = getattr(sources, source)(spark, sf_dir)
            return f(canonical.distinct_edges(raw), *([canonical.order_of(raw)] if curved else []))

        _QUERIES[name] = run
        _SQL[name] = f"with recursive E as (select distinct src, dst from ({_RAW[source]})){', ' + base if base else ''} {sql}"
        return f

    return add


def _walk(cells: str, order: str = "K") -> str:
    """SQL of the textbook Hilbert walk over ``cells(a, b)``: a relation W(a, b, h)."""
    return f"""W0 as (select a, b, a x, b y, (1::bigint << (k - 1)::int) s, 0::bigint d from {cells}, {order}
 union all select a, b, case when ry = 0 then fy else fx end, case when ry = 0 then fx else fy end, s // 2, d + s * s * xor(3 * rx, ry)
 from (select *, case when ry = 0 and rx = 1 then s - 1 - lx else lx end fx, case when ry = 0 and rx = 1 then s - 1 - ly else ly end fy
 from (select a, b, s, d, ((x & s) > 0)::bigint rx, ((y & s) > 0)::bigint ry, x & (s - 1) lx, y & (s - 1) ly from W0 where s > 0))),
 W as (select a, b, d h from W0 where s = 0)"""


_CELLS = f"{_ORDER}, C as (select src a, dst b from E), {_walk('C')}"
_DEPTHS = f"""{_ORDER}, L as (select src, dst, k, unnest(range(least({blocking.MIN_DEPTH}, k), k + 1)) d from E, K),
 N as (select *, src >> (k - d)::int cx, dst >> (k - d)::int cy, count(*) over (partition by d, src >> (k - d)::int, dst >> (k - d)::int) n from L),
 M as (select src, dst, min(d) d from N where n < {MOST} group by 1, 2),
 B as (select (src >> (k - d)::int) << (k - d)::int x, (dst >> (k - d)::int) << (k - d)::int y, 1::bigint << (k - d)::int side_len, count(*) nnz from M, K group by 1, 2, 3),
 C as (select x a, y b from B), {_walk('C')}"""


@query("edges_distinct", "user_next", "select src, dst from E")
def edges_distinct(edges):
    return edges


@query("drop_self_loops", "cust_part", "select src, dst from E where src <> dst")
def drop_self_loops(edges):
    return canonical.distinct_edges(edges, drop_self_loops=True)


@query("vertex_rank", "order_part", "select old_id, new_id from R", _RANKS)
def vertex_rank(edges):
    return canonical.vertex_ranks(edges)


@query("compress_edges", "order_part", "select src, dst from D", _DENSE)
def compress_edges(edges):
    return canonical.compress(edges)[0]


@query("graph_stats", "cust_part", "select (select count(*) from V) n, count(*) m, max(greatest(src, dst)) max_id, max(k) curve_order from E, K", f"{_ENDS}, {_ORDER}")
def graph_stats(edges):
    return canonical.stats(edges)


_DEGREES = f"{_ENDS}, G as (select id, (select count(*) from E where dst = id) in_deg, (select count(*) from E where src = id) out_deg from V)"


@query("degrees", "cust_part", "select id, in_deg, out_deg from G", _DEGREES)
def degrees(edges):
    return adjacency.degrees(edges)


@query("max_degree", "part_supp", "select max(in_deg) max_in, max(out_deg) max_out from G", _DEGREES)
def max_degree(edges):
    return adjacency.max_degrees(edges)


@query("top_k_hubs", "user_next", "select src id, count(*) deg from E group by 1 order by 2 desc, 1 limit 10")
def top_k_hubs(edges):
    return adjacency.top_hubs(edges, 10)


_STARTS = "select id, sum(deg) over (order by id rows unbounded preceding)::bigint - deg as start, deg as degree from (select id, count({0}) deg from V left join E on {0} = id group by 1)"


@query("csr_offsets_out", "cust_part", _STARTS.format("src"), _ENDS)
def csr_offsets_out(edges):
    return adjacency.all_offsets(edges).select("id", F.col("start").cast("long").alias("start"), "degree")


@query("csr_offsets_in", "user_next", _STARTS.format("dst"), _ENDS)
def csr_offsets_in(edges):
    return adjacency.all_offsets(edges, incoming=True).select("id", F.col("start").cast("long").alias("start"), "degree")


@query("csr_edge_offsets", "order_part", "select src id, sum(count(*)) over (order by src rows unbounded preceding)::bigint - count(*) as start, count(*) degree from E group by 1")
def csr_edge_offsets(edges):
    return adjacency.offsets(edges)


@query("csr_adjacency", "user_next", "select src id, string_agg(dst::varchar, ',' order by dst) neighbours from E group by 1")
def csr_adjacency(edges):
    return adjacency.adjacency(edges).select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query("csr_adjacency_chunks", "part_supp", "select id, chunk, string_agg(dst::varchar, ',' order by dst) neighbours from (select src id, dst, (row_number() over (partition by src order by dst) - 1) // 8 as chunk from E) group by 1, 2")
def csr_adjacency_chunks(edges):
    return adjacency.adjacency_chunks(edges, 8).select("id", "chunk", F.array_join("neighbours", ",").alias("neighbours"))


@query("bipartite_csr_out", "part_supp_bipartite", _STARTS.format("src"), _ENDS)
def bipartite_csr_out(edges):
    return adjacency.all_offsets(edges).select("id", F.col("start").cast("long").alias("start"), "degree")


@query("bipartite_csr_in", "part_supp_bipartite", _STARTS.format("dst"), _ENDS)
def bipartite_csr_in(edges):
    return adjacency.all_offsets(edges, incoming=True).select("id", F.col("start").cast("long").alias("start"), "degree")


@query("avg_rw_dist", "cust_supp", "select (select count(*) from V)::double / count(*) read_distance, sum(gap)::double / count(*) write_distance from (select coalesce(abs(dst - lag(dst) over (partition by src order by dst)), 0) gap from E)", _ENDS)
def avg_rw_dist(edges):
    return adjacency.read_write_distance(edges, canonical.endpoints(edges).count())


@query("degree_order", "cust_part", "select id old_id, row_number() over (order by in_deg + out_deg desc, id) - 1 new_id from G", _DEGREES)
def degree_order(edges):
    return ordering.degree_order(edges)


_SIDES = "S as (select 0 side, src id, count(*) deg from E group by 2 union all select 1, dst, count(*) from E group by 2), O as (select side, id old_id, row_number() over (order by side, deg desc, id) - 1 new_id from S)"


@query("bipartite_degree_order", "part_supp", "select side, old_id, new_id from O", _SIDES)
def bipartite_degree_order(edges):
    return ordering.bipartite_degree_order(edges)


@query("bipartite_relabel", "part_supp", "select a.new_id src, b.new_id dst from E join O a on a.side = 0 and src = a.old_id join O b on b.side = 1 and dst = b.old_id", _SIDES)
def bipartite_relabel(edges):
    return ordering.relabel_sides(edges, cut(ordering.bipartite_degree_order(edges), "order"))


@query("first_visit_order", "part_supp", "select dst old_id, row_number() over (order by u, dst) - 1 new_id from (select dst, min(src) u from E group by 1)")
def first_visit_order(edges):
    return ordering.first_visit_order(edges)


@query("relabel_edges", "cust_part", "select a.new_id src, b.new_id dst from E join T a on src = a.old_id join T b on dst = b.old_id", f"{_DEGREES}, T as (select id old_id, row_number() over (order by in_deg + out_deg desc, id) - 1 new_id from G)")
def relabel_edges(edges):
    return canonical.relabel(edges, cut(ordering.degree_order(edges), "order"))


@query("hilbert_key", "part_supp", "select a src, b dst, h from W", _CELLS)
def hilbert_key(edges, order):
    return ordering.with_hilbert(edges, order)


@query("hilbert_key_batches", "cust_part", "select a src, b dst, h from W", _CELLS)
def hilbert_key_batches(edges, order):
    return ordering.with_hilbert(edges, order, batches=True)


@query("hilbert_classic", "user_next", "select a src, b dst, h from W", _CELLS)
def hilbert_classic(edges, order):
    return edges.withColumn("h", hilbert_key_classic("src", "dst", order))


@query("hilbert_rank", "user_next", "select a src, b dst, h, row_number() over (order by h) - 1 as rank from W", _CELLS)
def hilbert_rank(edges, order):
    return ordering.hilbert_ranks(edges, order)


@query("hilbert_edge_lines", "cust_supp", "select row_number() over (order by h) - 1 as rank, concat(a, ' ', b, ' ', row_number() over (order by h) - 1) as value from W", _CELLS)
def hilbert_edge_lines(edges, order):
    return formats.hilbert_edge_lines(ordering.hilbert_ranks(edges, order))


_MORTON = " + ".join(f"(((src >> {i}) & 1) << {3 * i}) + (((dst >> {i}) & 1) << {3 * i + 1})" for i in range(18))


@query("morton_key", "cust_part", f"select src, dst, {_MORTON} as m from E")
def morton(edges):
    return edges.withColumn("m", morton_key("src", "dst"))


@query("box_count", "part_supp", "select count(*) n from E where src >= 100 and src < 200 and dst >= 10 and dst < 60")
def box_count(edges):
    return ordering.box(edges, 100, 200, 10, 60).agg(F.count("*").alias("n"))


@query("box_edges", "part_supp", "select src, dst from E where src >= 100 and src < 200 and dst >= 10 and dst < 60")
def box_edges(edges, order):
    clustered = cut(ordering.cluster_by_hilbert(edges, order, 8), "clustered")
    return ordering.box(clustered, 100, 200, 10, 60).select("src", "dst")


@query("block_metadata", "user_next", "select h idx, x, y, side_len, nnz from B join W on x = a and y = b", _DEPTHS)
def block_metadata(edges, order):
    return blocking.block(edges, order, MOST)


@query("block_metadata_bipartite", "part_supp_bipartite", "select h idx, x, y, side_len, nnz from B join W on x = a and y = b", _DEPTHS)
def block_metadata_bipartite(edges, order):
    return blocking.block(edges, order, MOST)


@query("block_edges", "user_next", "select a src, b dst, h, row_number() over (order by h) - 1 as place from W", _CELLS)
def block_edges(edges, order):
    return blocking.block_edges(blocking.block_of_edges(edges, order, MOST))


@query("block_index", "user_next", 'select row_number() over (order by h) - 1 as block, h idx, (2 * sum(nnz) over (order by h rows unbounded preceding))::bigint as "end" from B join W on x = a and y = b', _DEPTHS)
def block_index(edges, order):
    index = blocking.block_index(blocking.block(edges, order, MOST))
    return index.select("block", "idx", F.col("end").cast("long").alias("end"))


@query("block_lines", "user_next", "select h idx, concat(x, ' ', y, ' ', side_len, ' ', h, ' ', nnz, ' ') as value from B join W on x = a and y = b", _DEPTHS)
def block_lines(edges, order):
    return formats.block_lines(blocking.block(edges, order, MOST))


def _rounds(n: int) -> str:
    base, damping = "(select (1 - 0.85::double) / count(*) from V)", "0.85::double"
    steps = [f"{_ENDS}, Q as (select src, count(*) q from E group by 1), P1 as (select id, {base} score from V)"]
    steps += [f"P{t} as (select V.id, {base} + {damping} * coalesce(c, 0) score from V left join (select dst, sum(score / q) c from E join P{t - 1} on id = E.src join Q on Q.src = E.src group by 1) on dst = V.id)" for t in range(2, n + 1)]
    return ", ".join(steps)


@query("pagerank_1", "cust_part", "select id, round(score, 9) score from P1", _rounds(1))
def pagerank_1(edges):
    return pagerank(edges, 1).select("id", F.round("score", 9).alias("score"))


@query("pagerank_10", "user_next", "select id, round(score, 9) score from P10", _rounds(10))
def pagerank_10(edges):
    return pagerank(edges, 10).select("id", F.round("score", 9).alias("score"))


@query("pagerank_blocks", "user_next", "select id, round(score, 9) score from P10", _rounds(10))
def pagerank_by_blocks(edges):
    return pagerank_blocks(edges, 10).select("id", F.round("score", 9).alias("score"))


@query("pagerank_dangling", "cust_part", "select id, round(score, 9) score from P4", _rounds(4))
def pagerank_dangling(edges):
    return pagerank(edges, 4).select("id", F.round("score", 9).alias("score"))


@query("pagerank_relabelled", "user_next", "select id, round(score, 9) score from P5", _rounds(5))
def pagerank_relabelled(edges):
    ids = cut(ordering.degree_order(edges), "order")
    scores = pagerank(canonical.relabel(edges, ids), 5)
    return scores.join(ids, F.col("id") == F.col("new_id")).select(F.col("old_id").alias("id"), F.round("score", 9).alias("score"))


#: Labels by the smallest id in reach, R(id, component): a walk that keeps a vertex's every smaller label once.
_REACH = f"""{_ENDS}, U as materialized (select src a, dst b from E union select dst, src from E),
 T as (select id, id label from V union select b, label from T join U on a = id where b > label),
 R as materialized (select id, min(label) component from T group by 1)"""


@query("components", "order_customer", "select id, component from R", _REACH)
def connected(edges):
    return components.components(edges)


@query("components_dense", "user_next", "select id, component from R", _REACH)
def connected_dense(edges):
    return components.components(edges)


@query("component_sizes", "order_customer", "select component, count(*) n from R group by 1", _REACH)
def component_sizes(edges):
    return components.value_counts(components.components(edges))


@query("component_sizes_compared", "order_customer", "select n as size, count(*) found, count(*) truth from (select count(*) n from R group by component) group by 1", _REACH)
def component_sizes_compared(edges):
    """Sizes of the components against those of the same graph under other ids."""
    ids = cut(ordering.degree_order(edges), "order")
    return components.compared(components.components(canonical.relabel(edges, ids)), components.components(edges))


BOX = (100, 200, 10, 60)
_IN_BOX = "src >= 100 and src < 200 and dst >= 10 and dst < 60"


@query("box_ranges", "part_supp", f"select src, dst from E where {_IN_BOX}")
def box_ranges(edges, order):
    clustered = cut(ordering.cluster_by_hilbert(edges, order, 8), "clustered")
    return ranges.box_by_ranges(clustered, order, BOX).select("src", "dst")


@query("box_capped_count", "part_supp", f"select least(count(*), 101) n from E where {_IN_BOX}")
def box_capped_count(edges, order):
    clustered = cut(ordering.cluster_by_hilbert(edges, order, 8), "clustered")
    return ranges.capped_count(ranges.box_by_ranges(clustered, order, BOX), 100)


_MERGED = f"""{_DEPTHS}, P as materialized (select row_number() over (order by h) - 1 as block, h idx, nnz, sum(nnz) over (order by h rows unbounded preceding)::bigint e from B join W on x = a and y = b),
 X as materialized (select p.block, greatest(p.block + 1, count(q.e)) nx from P p left join P q on q.e < p.e - p.nnz + {4 * MOST} group by 1),
 G as (select 0::bigint b from (select 1 from P limit 1) union all select nx from G join X on block = b where nx < (select count(*) from P)),
 S as (select b, row_number() over (order by b) - 1 as segment, lead(b) over (order by b) till from G)"""


@query("block_merge", "user_next", "select segment, b as block, count(*) blocks, min(idx) idx, sum(nnz)::bigint nnz from S join P on block >= b and (till is null or block < till) group by 1, 2", _MERGED)
def block_merge(edges, order):
    return blocking.merge_blocks(blocking.block(edges, order, MOST), 4 * MOST)


def _levels(n: int) -> str:
    """SQL of the search by levels, ``n`` of them, and of as many rounds of labels before it."""
    steps = ["U as materialized (select 2 * src a, 2 * dst + 1 b from E union select 2 * dst + 1, 2 * src from E), V as materialized (select a id, count(*) degree from U group by 1), C0 as (select id, id c from V)"]
    steps += [f"C{k} as materialized (select a id, min(least(x.c, y.c)) c from U join C{k - 1} x on x.id = a join C{k - 1} y on y.id = b group by 1)" for k in range(1, n)]
    steps += [f"""L0 as materialized (select id, row_number() over (order by degree, id) - 1 as number, row_number() over (order by degree, id) - 1 as start, 0 as level from
 (select id, degree, row_number() over (partition by c order by degree, id) r from V join C{n - 1} using (id) where id % 2 = 0) where r = 1)"""]
    for k in range(1, n):
        old = f" where b not in (select id from L{k - 2})" if k > 1 else ""
        steps.append(f"""L{k} as materialized (select id, row_number() over (order by parent, degree, id) - 1 as number, start, {k} as level from
 (select b id, min(number) parent, min(start) start from U join L{k - 1} on a = id{old} group by 1) join V using (id))""")
    every = " union all ".join(f"select * from L{k}" for k in range(n))
    return ", ".join(steps) + f""", F as materialized (select id % 2 side, id // 2 old_id, row_number() over (partition by id % 2 order by start, level, number) - 1 new_id from ({every})),
 Y as (select max(abs(src - dst)) bandwidth_before, max(abs(p.new_id - q.new_id)) bandwidth_after from E join F p on p.side = 0 and p.old_id = src join F q on q.side = 1 and q.old_id = dst)"""


def _ordered_sides(edges: DataFrame) -> DataFrame:
    edges = cut(edges, "edges")
    order = bandwidth.cuthill_mckee(edges)
    after = bandwidth.bandwidth(ordering.relabel_sides(edges, order))
    return order.select("side", "old_id", "new_id", F.lit(bandwidth.bandwidth(edges)).cast("long").alias("bandwidth_before"), F.lit(after).cast("long").alias("bandwidth_after"))


_CM = "select side::int side, old_id, new_id, bandwidth_before, bandwidth_after from F, Y"


@query("cuthill_mckee", "part_supp", _CM, _levels(12))
def cuthill_mckee(edges):
    return _ordered_sides(edges)


@query("cuthill_mckee_forest", "customer_orders", _CM, _levels(4))
def cuthill_mckee_forest(edges):
    """Many components: each customer's orders."""
    return _ordered_sides(edges)


@query("edge_lines", "user_next", "select concat(src, ' ', dst) as value from E")
def edge_lines(edges):
    return sources.edge_lines(edges)


@query("edges_one_based", "cust_supp", "select concat(src + 1, ' ', dst + 1) as value from E")
def edges_one_based(edges):
    return sources.edge_lines(edges, base=1)


@query("parsed_edges", "cust_supp", "select src, dst from E")
def parsed_edges(edges):
    return sources.parse_edge_lines(edges.select(F.concat(F.col("src").cast("string"), F.lit(",\t "), F.col("dst").cast("string"), F.lit(" \r")).alias("value")))


_LIGRA = f"{_DENSE}, Z as (select new_id id, (select count(*) from D where src = new_id) deg from R)"


@query("ligra_lines", "user_next", """select 0 section, 0::bigint place, 0::bigint minor, 'AdjacencyGraph' as value union all select 0, 1, 0, (select count(*) from V)::varchar union all select 0, 2, 0, (select count(*) from E)::varchar
 union all select 1, id, 0, (sum(deg) over (order by id rows unbounded preceding) - deg)::bigint::varchar from Z union all select 2, src, dst, dst::varchar from D""", _LIGRA)
def ligra_lines(edges):
    return formats.adjacency_lines(cut(canonical.compress(edges)[0], "dense"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = adjacency.adjacency(sources.part_supp_weighted(spark, sf_dir))
    pairs = F.zip_with("neighbours", "weights", lambda n, w: F.concat(n.cast("string"), F.lit(":"), w.cast("long").cast("string")))
    return lists.select("id", F.array_join(pairs, ",").alias("neighbours"))


_QUERIES["weighted_adjacency"] = _weighted
_SQL["weighted_adjacency"] = "select src id, string_agg(concat(dst, ':', w), ',' order by dst) neighbours from (select l_partkey src, l_suppkey dst, sum(l_quantity)::bigint w from lineitem group by 1, 2) group by 1"


def _bipartite_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-adjacency of the weighted bipartite graph in one id space: lists of sources with their weights."""
    lists = flows.bipartite_csrs(sources.part_supp_weighted(spark, sf_dir))["in"]
    pairs = F.zip_with("neighbours", "weights", lambda n, w: F.concat(n.cast("string"), F.lit(":"), w.cast("long").cast("string")))
    return lists.select("id", F.array_join(pairs, ",").alias("neighbours"))


_QUERIES["bipartite_weighted_in"] = _bipartite_weighted
_SQL["bipartite_weighted_in"] = "select dst + n1 id, string_agg(concat(src, ':', w), ',' order by src) neighbours from (select l_partkey src, l_suppkey dst, sum(l_quantity)::bigint w from lineitem group by 1, 2), (select max(l_partkey) + 1 n1 from lineitem) group by 1"


FACTOR_ROUNDS = 5


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of parts and suppliers, in one id space, from the quantities between them."""
    n1 = sources.part_supp(spark, sf_dir).agg(F.coalesce(F.max("src") + 1, F.lit(0)).alias("n1")).first().n1
    found = factorise.factorise(canonical.bipartite(sources.part_supp_weighted(spark, sf_dir), n1), FACTOR_ROUNDS)
    return found.select("id", F.posexplode("factors").alias("k", "factor")).select("id", "k", F.round("factor", 6).alias("factor"))


def _factor_rounds() -> str:
    steps = [f"A as materialized (select l_partkey u, l_suppkey + n1 v, sum(l_quantity) w from lineitem, (select max(l_partkey) + 1 n1 from lineitem) group by 1, 2), I as (select u id from A union select v from A), F0 as materialized (select id, k, ((id * 7919 + k * 104729) % 1000 + 1) / 1000.0::double f from I, range({factorise.RANK}) t(k))"]
    for t in range(FACTOR_ROUNDS):
        steps.append(f"""R{t} as materialized (select u, v, any_value(w) - sum(a.f * b.f) e from A join F{t} a on a.id = u join F{t} b on b.id = v and a.k = b.k group by 1, 2),
 F{t + 1} as materialized (select F{t}.id, F{t}.k, F{t}.f + {factorise.STEP} * g f from F{t} join (select id, k, sum(g) g from
 (select u id, k, e * f g from R{t} join F{t} on id = v union all select v, k, e * f from R{t} join F{t} on id = u) group by 1, 2) using (id, k))""")
    return "with " + ", ".join(steps) + f" select id, k::int k, round(f, 6) factor from F{FACTOR_ROUNDS}"


_QUERIES["factors"] = _factors
_SQL["factors"] = _factor_rounds()


def _block_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of blocks and of edges in them, against the graph's edges."""
    raw = sources.cust_supp(spark, sf_dir)
    edges = canonical.distinct_edges(raw)
    blocks = blocking.block(edges, canonical.order_of(raw), MOST)
    rows = blocks.select(F.lit(1).alias("blocks"), F.col("nnz").alias("assigned"), F.lit(0).alias("m"))
    rows = rows.unionByName(edges.select(F.lit(0).alias("blocks"), F.lit(0).cast("long").alias("assigned"), F.lit(1).alias("m")))
    return rows.agg(*(F.sum(c).alias(c) for c in ("blocks", "assigned", "m")))


_QUERIES["block_totals"] = _block_totals
_SQL["block_totals"] = f"with recursive E as (select distinct src, dst from ({_RAW['cust_supp']})), {_DEPTHS} select (select count(*) from B) blocks, (select sum(nnz)::bigint from B) assigned, (select count(*) from E) m"


def _weighted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = canonical.order_of(sources.part_supp(spark, sf_dir))
    return blocking.block_edges(blocking.block_of_edges(sources.part_supp_weighted(spark, sf_dir), order, MOST))


_QUERIES["weighted_block_edges"] = _weighted_blocks
_SQL["weighted_block_edges"] = f"with recursive E as (select l_partkey src, l_suppkey dst, sum(l_quantity) weight from lineitem group by 1, 2), {_CELLS} select a src, b dst, weight, h, row_number() over (order by h) - 1 as place from W join E on a = src and b = dst"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
