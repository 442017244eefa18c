"""Queries of the graph engine over the test tables, and plain SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.query import run
from .sources.commerce import commerce, exported

# name -> (query, SQL) on the relational tables as a graph
GQL: dict[str, tuple[str, str]] = {
    "scan_label": ("MATCH (c:Customer) RETURN c.custkey AS custkey, c.name AS name", "select c_custkey as custkey, c_name as name from customer"),
    "scan_all_count": ("MATCH (n) RETURN COUNT(*) AS c", "select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders) + (select count(distinct user_id) from events) + (select count(*) from events) + (select count(*) from documents) as c"),
    "scan_multilabel": ("MATCH (d:Document:English) RETURN d.docid AS docid", "select doc_id as docid from documents where lang = 'en'"),
    "scan_multilabel3": ("MATCH (d:Document:English:Long) RETURN d.docid AS docid, d.nchars AS nchars", "select doc_id as docid, n_chars as nchars from documents where lang = 'en' and n_chars >= 1000"),
    "filter_cmp": ("MATCH (c:Customer) WHERE c.acctbal > 5000.0 RETURN c.custkey AS k, c.acctbal AS b", "select c_custkey as k, c_acctbal as b from customer where c_acctbal > 5000"),
    "filter_bool": ("MATCH (p:Part) WHERE NOT (p.size < 10 OR p.size > 40) AND p.brand <> 'Brand#2' RETURN p.partkey AS k", "select p_partkey as k from part where not (p_size < 10 or p_size > 40) and p_brand <> 'Brand#2'"),
    "filter_inline": ("MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.custkey AS k", "select c_custkey as k from customer where c_mktsegment = 'BUILDING'"),
    "filter_null_eq": ("MATCH (n:Nation) WHERE n.acctbal = null RETURN n.name AS name", "select n_name as name from nation"),
    "filter_cross_type": ("MATCH (p:Part) WHERE p.size = '11' RETURN p.partkey AS k", "select p_partkey as k from part where false"),
    "filter_null_cmp": ("MATCH (d:Document) WHERE d.lang > 'f' RETURN d.docid AS k", "select doc_id as k from documents where lang > 'f'"),
    "project_arith": ("MATCH (p:Part) RETURN p.partkey AS k, p.retailprice * 2.0 - 1.0 AS x, p.size + 1 AS y, p.size / 2 AS z", "select p_partkey as k, p_retailprice * 2.0 - 1.0 as x, p_size + 1 as y, p_size / 2 as z from part"),
    "project_mod": ("MATCH (p:Part) RETURN p.partkey AS k, (0 - p.size) % 7 AS m", "select p_partkey as k, ((-p_size % 7) + 7) % 7 as m from part"),
    "project_neg": ("MATCH (p:Part) RETURN p.partkey AS k, -p.size AS m", "select p_partkey as k, -p_size as m from part"),
    "project_concat": ("MATCH (p:Part) RETURN p.partkey AS k, p.brand + p.type AS s", "select p_partkey as k, p_brand || p_type as s from part"),
    "project_zero_div": ("MATCH (c:Customer) RETURN c.custkey AS k, (c.acctbal / 0.0 > 0.0) AS up", "select c_custkey as k, c_acctbal > 0 as up from customer"),
    "fn_size": ("MATCH (p:Part) RETURN p.partkey AS k, size(p.name) AS n, length(p.brand) AS m", "select p_partkey as k, length(p_name) as n, length(p_brand) as m from part"),
    "fn_coalesce": ("MATCH (n:Nation) RETURN coalesce(n.nosuch, n.name) AS x", "select n_name as x from nation"),
    "fn_coalesce_null": ("MATCH (d:Document) RETURN d.docid AS k, coalesce(d.author, d.lang, 'none') AS x", "select doc_id as k, coalesce(author, lang, 'none') as x from documents"),
    "fn_labels": ("MATCH (d:Document) RETURN d.docid AS k, labels(d) AS l, size(labels(d)) AS n", "select doc_id as k, l, len(l) as n from (select doc_id, list_sort(list_filter(['Document', case when lang = 'en' then 'English' end, case when n_chars >= 1000 then 'Long' end], lambda x: x is not null)) as l from documents)"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.custkey AS c, o.orderkey AS o", "select o_custkey as c, o_orderkey as o from orders"),
    "expand_in": ("MATCH (n:Nation)<-[:LOCATED_IN]-(c:Customer) RETURN n.name AS n, c.custkey AS c", "select n_name as n, c_custkey as c from customer join nation on n_nationkey = c_nationkey"),
    "expand_undirected": ("MATCH (p:Part)-[:SUPPLIES]-(s) RETURN p.partkey AS p, COUNT(*) AS n", "select l_partkey as p, count(distinct l_suppkey) as n from lineitem group by 1"),
    "expand_untyped": ("MATCH (c:Customer)-->(x) RETURN c.custkey AS c, COUNT(*) AS n", "select c_custkey as c, 1 + count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1"),
    "expand_types": ("MATCH (c:Customer)-[:PLACED|LOCATED_IN]->(x) RETURN COUNT(*) AS n", "select (select count(*) from customer) + (select count(*) from orders) as n"),
    "expand_two_hop": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN c.mktsegment AS seg, COUNT(*) AS n, SUM(p.retailprice) AS v", "select c_mktsegment as seg, count(*) as n, sum(p_retailprice) as v from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1"),
    "expand_three_hop": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s:Supplier) RETURN c.mktsegment AS seg, COUNT(*) AS n", "with sp as (select distinct l_suppkey as s, l_partkey as p from lineitem) select c_mktsegment as seg, count(*) as n from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join sp on sp.p = l_partkey group by 1"),
    "expand_target_filter": ("MATCH (o:Order)-[:CONTAINS]->(p:Part {brand: 'Brand#1'}) RETURN o.orderkey AS o, p.partkey AS p", "select l_orderkey as o, l_partkey as p from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#1'"),
    "expand_edge_prop": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity > 45.0 RETURN o.orderkey AS orderkey, r.quantity AS qty", "select l_orderkey as orderkey, l_quantity as qty from lineitem where l_quantity > 45"),
    "expand_edge_inline": ("MATCH (o:Order)-[r:CONTAINS {returnflag: 'R'}]->(p:Part) RETURN o.orderkey AS o, p.partkey AS p, r.linenumber AS n", "select l_orderkey as o, l_partkey as p, l_linenumber as n from lineitem where l_returnflag = 'R'"),
    "homomorphism": ("MATCH (a:Part)<-[:SUPPLIES]-(s:Supplier)-[:SUPPLIES]->(b:Part) RETURN COUNT(*) AS n", "with sp as (select distinct l_suppkey as s, l_partkey as p from lineitem) select count(*) as n from sp x join sp y using (s)"),
    "cycle_alias": ("MATCH (a:Part)<-[:SUPPLIES]-(s:Supplier)-[:SUPPLIES]->(a) RETURN COUNT(*) AS n", "select count(*) as n from (select distinct l_suppkey, l_partkey from lineitem)"),
    "comma_patterns": ("MATCH (c:Customer)-[:PLACED]->(o:Order), (o)-[:CONTAINS]->(p:Part) WHERE p.size = 7 RETURN c.custkey AS c, COUNT(*) AS n", "select o_custkey as c, count(*) as n from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_size = 7 group by 1"),
    "agg_count": ("MATCH (c:Customer) RETURN COUNT(*) AS n", "select count(*) as n from customer"),
    "agg_count_expr": ("MATCH (d:Document) RETURN COUNT(d.author) AS a, COUNT(d.lang) AS l, COUNT(*) AS n", "select count(author) as a, count(lang) as l, count(*) as n from documents"),
    "agg_sum": ("MATCH (p:Part) RETURN SUM(p.size) AS s, SUM(p.retailprice) AS t", "select sum(p_size)::bigint as s, sum(p_retailprice) as t from part"),
    "agg_sum_empty": ("MATCH (p:Part) WHERE p.size < 0 RETURN SUM(p.size) AS s, COUNT(*) AS n, AVG(p.size) AS a, MAX(p.size) AS m", "select 0 as s, 0 as n, null::double as a, null::bigint as m"),
    "agg_avg": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, AVG(c.acctbal) AS a", "select c_mktsegment as seg, avg(c_acctbal) as a from customer group by 1"),
    "agg_minmax": ("MATCH (p:Part) RETURN p.brand AS b, MIN(p.retailprice) AS lo, MAX(p.name) AS hi", "select p_brand as b, min(p_retailprice) as lo, max(p_name) as hi from part group by 1"),
    "agg_group": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, COUNT(*) AS n", "select c_mktsegment as seg, count(*) as n from customer group by 1"),
    "agg_group_multi": ("MATCH (p:Part) RETURN p.brand AS b, p.type AS t, COUNT(*) AS n, SUM(p.size) AS s", "select p_brand as b, p_type as t, count(*) as n, sum(p_size)::bigint as s from part group by all"),
    "agg_nested": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, COUNT(*) + 1 AS n, SUM(c.acctbal) / COUNT(*) AS mean", "select c_mktsegment as seg, count(*) + 1 as n, sum(c_acctbal) / count(*) as mean from customer group by 1"),
    "distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS b", "select distinct p_brand as b from part"),
    "distinct_multi": ("MATCH (p:Part) RETURN DISTINCT p.brand AS b, p.type AS t ORDER BY b, t", "select distinct p_brand as b, p_type as t from part"),
    "order_asc": ("MATCH (d:Document) RETURN d.docid AS k, d.lang AS l ORDER BY d.lang, d.docid LIMIT 50", "select doc_id as k, lang as l from documents order by lang nulls first, doc_id limit 50"),
    "order_multi_desc": ("MATCH (d:Document) RETURN d.docid AS k ORDER BY d.lang DESC, d.docid DESC LIMIT 40", "select doc_id as k from documents order by lang desc nulls last, doc_id desc limit 40"),
    "order_hidden": ("MATCH (p:Part) RETURN p.name AS name ORDER BY p.retailprice DESC, p.partkey LIMIT 20", "select p_name as name from part order by p_retailprice desc, p_partkey limit 20"),
    "skip": ("MATCH (n:Nation) RETURN n.name AS name ORDER BY n.nationkey SKIP 20", "select n_name as name from nation order by n_nationkey offset 20"),
    "skip_limit": ("MATCH (n:Nation) RETURN n.name AS name ORDER BY n.nationkey LIMIT 4 SKIP 3", "select n_name as name from nation order by n_nationkey limit 4 offset 3"),
    "topk": ("MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY p DESC, k LIMIT 10", "select o_orderkey as k, o_totalprice as p from orders order by 2 desc, 1 limit 10"),
    "order_alias": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.custkey AS k, SUM(o.totalprice) AS total ORDER BY total DESC LIMIT 5", "select o_custkey as k, sum(o_totalprice) as total from orders group by 1 order by 2 desc limit 5"),
    "order_agg": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.custkey AS k ORDER BY COUNT(*) DESC, c.custkey LIMIT 5", "select o_custkey as k from orders group by 1 order by count(*) desc, 1 limit 5"),
    "in_list": ("MATCH (d:Document) WHERE 'Long' IN labels(d) AND d.lang IN ['de', 'fr'] RETURN d.docid AS k", "select doc_id as k from documents where n_chars >= 1000 and lang in ('de', 'fr')"),
    "is_null": ("MATCH (d:Document) WHERE d.lang IS NULL OR d.author IS NULL RETURN d.docid AS k, d.source AS s", "select doc_id as k, source as s from documents where lang is null or author is null"),
    "s1_names": ("MATCH (c:Customer) WHERE c.mktsegment = 'BUILDING' RETURN c.name AS name ORDER BY c.name LIMIT 25", "select c_name as name from customer where c_mktsegment = 'BUILDING' order by 1 limit 25"),
    "s2_join": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.mktsegment = 'BUILDING' RETURN o.orderkey AS k", "select o_orderkey as k from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'"),
    "s3_second_degree": ("MATCH (a:Supplier)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(b:Supplier) WHERE a.suppkey = 3 AND b.suppkey <> 3 RETURN DISTINCT b.name AS name", "with sp as (select distinct l_suppkey as s, l_partkey as p from lineitem) select distinct s_name as name from sp x join sp y using (p) join supplier on s_suppkey = y.s where x.s = 3 and y.s <> 3"),
    "s4_group_top": ("MATCH (n:Nation)<-[:LOCATED_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.name AS name, COUNT(*) AS n ORDER BY n DESC, name LIMIT 3", "select n_name as name, count(*) as n from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey group by 1 order by 2 desc, 1 limit 3"),
    "s1_reach": ("MATCH (a:Event)-[:NEXT*1..2]->(b:Event) WHERE a.etype = 'purchase' RETURN DISTINCT b.eventid AS v", "with nx as (select event_id as a, lead(event_id) over w as b, lead(event_id, 2) over w as c, event_type as t from events where user_id is not null window w as (partition by user_id order by ts, event_id)) select b as v from nx where t = 'purchase' and b is not null union select c from nx where t = 'purchase' and c is not null"),
    "s5_collect": ("MATCH (p:Part) RETURN p.brand AS brand, COUNT(*) AS n, COLLECT(p.size) AS sizes", "select p_brand as brand, count(*) as n, list_sort(list(p_size::bigint)) as sizes from part group by 1"),
    "s7_ancestors": ("MATCH (p:Document)<-[:PARENT*1..3]-(d:Document) RETURN p.docid AS p, COUNT(*) AS n", "with recursive pe as (select distinct a.doc_id as a, b.doc_id as b from documents a join documents b on a.parent_sha = b.commit_sha), w(s, v, d) as (select b, a, 1 from pe union select w.s, pe.a, d + 1 from w join pe on pe.b = w.v where d < 3) select s as p, count(distinct v) as n from w where s <> v group by 1"),
    "s5_events": ("MATCH (u:User)-[:DID]->(e:Event) RETURN u.userid AS u, e.etype AS t, COUNT(*) AS n, SUM(e.value) AS v", "select user_id as u, event_type as t, count(*) as n, coalesce(sum(value), 0) as v from events where user_id is not null group by all"),
    "s6_next": ("MATCH (a:Event)-[r:NEXT]->(b:Event) WHERE a.etype = b.etype RETURN a.etype AS t, COUNT(*) AS n, SUM(r.gap) AS gap", "with x as (select event_type as t, lead(event_type) over w as u, epoch_us(lead(ts) over w) - epoch_us(ts) as gap from events where user_id is not null window w as (partition by user_id order by ts, event_id)) select t, count(*) as n, sum(gap)::bigint as gap from x where t = u group by 1"),
    "s7_parent": ("MATCH (d:Document)-[:PARENT]->(p:Document) RETURN d.docid AS d, p.docid AS p, d.source AS s", "select a.doc_id as d, b.doc_id as p, a.source as s from documents a join documents b on a.parent_sha = b.commit_sha"),
}

FLAGSHIP = "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LOCATED_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, COUNT(*) AS orders, SUM(o.totalprice) AS revenue"
FLAGSHIP_SQL = "select r_name as region, count(*) as orders, sum(o_totalprice) as revenue from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1"

_NEXT = "nx as (select event_id as a, lead(event_id) over (partition by user_id order by ts, event_id) as b from events where user_id is not null)"


def _chain(lo: int, hi: int, where: str) -> str:
    """Each event has one successor, so its distance is the number of steps."""
    return f"with recursive {_NEXT}, w(s, v, d) as (select a, a, 0 from nx where {where} union select s, b, d + 1 from w join nx on nx.a = w.v where b is not null and d < {hi}) select s, v from w where d >= {lo}"


# events after each one of the same user; each has one successor, so the k-th of them is at distance k
_AFTER = "f as (select event_id as s, count(*) over (partition by user_id order by ts desc, event_id desc) - 1 as n from events where user_id is not null)"
_SUPPLIES = """sp as (select distinct l_suppkey as s, l_partkey as p from lineitem),
  two as (select distinct x.s, y.s as t from sp x join sp y using (p) where x.s <> y.s),
  three as (select distinct t.s, p from two t join sp on sp.s = t.t),
  m as (select s, 'p' as k, p as v, 1 as d from sp union all select s, 's', t, 2 from two union all select s, 'p', p, 3 from three anti join sp using (s, p))"""

# name -> (query, SQL) of variable-length walks
WALKS: dict[str, tuple[str, str]] = {
    "var_1_3": ("MATCH (a:Event)-[:NEXT*1..3]->(b:Event) WHERE a.etype = 'purchase' RETURN a.eventid AS s, b.eventid AS v", _chain(1, 3, "a in (select event_id from events where event_type = 'purchase')")),
    "var_exact": ("MATCH (a:Event)-[:NEXT*2]->(b:Event) RETURN a.eventid AS s, b.eventid AS v", _chain(2, 2, "true")),
    "var_from": ("MATCH (a:Event)-[:NEXT*2..]->(b:Event) RETURN a.eventid AS s, COUNT(*) AS n", f"with {_AFTER} select s, n - 1 as n from f where n > 1"),
    "var_upto": ("MATCH (a:Event)-[:NEXT*..2]->(b) RETURN a.eventid AS s, COUNT(*) AS n", f"with {_AFTER} select s, least(n, 2) as n from f where n > 0"),
    "var_unbounded": ("MATCH (d:Document)-[:PARENT*]->(p:Document) RETURN d.docid AS s, p.docid AS v", "with recursive pe as (select a.doc_id as a, b.doc_id as b from documents a join documents b on a.parent_sha = b.commit_sha), w(s, v) as (select a, b from pe union select s, b from w join pe on pe.a = w.v) select s, v from w where s <> v"),
    "var_incoming": ("MATCH (p:Document)<-[:PARENT*1..2]-(d:Document) RETURN p.docid AS s, d.docid AS v", "with pe as (select distinct a.doc_id as a, b.doc_id as b from documents a join documents b on a.parent_sha = b.commit_sha) select b as s, a as v from pe where a <> b union select y.b, x.a from pe x join pe y on x.b = y.a where y.b <> x.a"),
    "var_undirected": ("MATCH (s:Supplier)-[:SUPPLIES*1..3]-(x) RETURN s.suppkey AS s, labels(x) AS l, COUNT(*) AS n", f"with {_SUPPLIES} select s, case k when 's' then ['Supplier'] else ['Part'] end as l, count(*) as n from m group by all"),
    "var_distance_two": ("MATCH (s:Supplier)-[:SUPPLIES*2]-(x:Supplier) RETURN s.suppkey AS s, COUNT(*) AS n", f"with {_SUPPLIES} select s, count(*) as n from two group by 1"),
}

# the last load of each node that is not deleted; edges whose ends name one, in any spelling of its UUID or by local-<vid>
LIVE = r"""live as (select logical_id, vid, x.l as labels, x.p as props from (select logical_id, vid, arg_max(struct_pack(l := labels, p := props), loaded_at) as x from graph_nodes group by all having max(deleted_at) is null)),
  nm as (select replace(logical_id, '-', '') as k, vid from live union select 'local-' || vid, vid from live),
  raw as (select *, case when src_logical_id like 'local-%' then src_logical_id else regexp_replace(replace(lower(src_logical_id), 'urn:uuid:', ''), '[-{}\s]', '', 'g') end as s,
          case when dst_logical_id like 'local-%' then dst_logical_id else regexp_replace(replace(lower(dst_logical_id), 'urn:uuid:', ''), '[-{}\s]', '', 'g') end as t from graph_edges),
  e as (select g.logical_id, edge_type, a.vid as src, b.vid as dst, arg_max(struct_pack(p := props), loaded_at).p as props from raw g join nm a on a.k = g.s join nm b on b.k = g.t group by all)"""

# The declared properties by type, as in prop_keys.
_NODE = {"string": "name city title text nickname firmware email slug", "int": "age foundedYear externalRef headcount battery depth", "double": "score rating latitude longitude balance", "bool": "active pinned online"}
_EDGE = {"string": "role", "int": "since", "double": "weight", "bool": "confirmed"}


def props_sql(owner: str, props: str = "props") -> str:
    """The properties of a JSON object that can be read in their type, as sorted texts key=value."""
    out = []
    for t, keys in (_NODE if owner == "node" else _EDGE).items():
        for k in keys.split():
            x = f"({props} ->> '$.{k}')"
            number = f"regexp_full_match(trim({x}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
            read = {"string": x, "int": f"case when regexp_full_match(trim({x}), '[+-]?[0-9]+') then try_cast({x} as bigint)::varchar end", "double": f"case when {number} then try_cast({x} as double)::varchar end", "bool": f"case when lower(trim({x})) in ('true', 'false') then lower(trim({x})) end"}[t]
            out.append(f"'{k}=' || {read}")
    return f"list_sort(list_filter([{', '.join(out)}], lambda x: x is not null))"

# name -> (query, SQL) on the exported graph
EXPORTED: dict[str, tuple[str, str]] = {
    "graph_label_count": ("MATCH (p:Person:Verified) RETURN COUNT(*) AS n", f"with {LIVE} select count(*) as n from live where list_contains(labels, 'Person') and list_contains(labels, 'Verified')"),
    "graph_expand": ("MATCH (p:Person)-[:knows]->(q:Person) RETURN p.name AS name, COUNT(*) AS n", f"with {LIVE} select a.props ->> '$.name' as name, count(*) as n from e join live a on a.vid = src join live b on b.vid = dst where edge_type = 'knows' and list_contains(a.labels, 'Person') and list_contains(b.labels, 'Person') group by 1"),
    "graph_two_hop": ("MATCH (p:Comment)-[:REPLY_OF]->(q)-[:CREATED|tagged]->(r:Topic) RETURN COUNT(*) AS n", f"with {LIVE} select count(*) as n from e x join e y on x.dst = y.src join live a on a.vid = x.src join live c on c.vid = y.dst where x.edge_type = 'REPLY_OF' and y.edge_type in ('CREATED', 'tagged') and list_contains(a.labels, 'Comment') and list_contains(c.labels, 'Topic')"),
    "graph_city": ("MATCH (p:Person) WHERE p.age >= 40 AND p.city IS NOT NULL RETURN p.city AS city, COUNT(*) AS n, AVG(p.age) AS age", f"with {LIVE}, x as (select props ->> '$.city' as city, case when regexp_full_match(trim(props ->> '$.age'), '[+-]?[0-9]+') then trim(props ->> '$.age')::bigint end as age from live where list_contains(labels, 'Person')) select city, count(*) as n, avg(age) as age from x where age >= 40 and city is not null group by 1"),
}


def _gql(make: Callable, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: run(make(s, d), text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"flagship": _gql(commerce, FLAGSHIP)}
    for group, make in ((GQL, commerce), (WALKS, commerce), (EXPORTED, exported)):
        out |= {k: _gql(make, q) for k, (q, _) in group.items()}
    collect = out["s5_collect"]
    out["s5_collect"] = lambda s, d: collect(s, d).selectExpr("brand", "n", "array_sort(sizes) as sizes")
    out["filter_param"] = lambda s, d: run(commerce(s, d), "MATCH (c:Customer {mktsegment: $seg}) WHERE c.acctbal >= $lo RETURN c.custkey AS k", {"seg": "MACHINERY", "lo": 100})
    out["agg_collect"] = lambda s, d: run(commerce(s, d), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, COLLECT(n.name) AS names").selectExpr("r", "array_sort(names) as names")
    return out


def oracle_sql() -> dict[str, str]:
    out = {"flagship": FLAGSHIP_SQL}
    for group in (GQL, WALKS, EXPORTED):
        out |= {k: q for k, (_, q) in group.items()}
    out["filter_param"] = "select c_custkey as k from customer where c_mktsegment = 'MACHINERY' and c_acctbal >= 100"
    out["agg_collect"] = "select r_name as r, list_sort(list(n_name)) as names from nation join region on r_regionkey = n_regionkey group by 1"
    return out
