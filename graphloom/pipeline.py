"""Queries of the general data-pipeline operators, over whole tables, and plain SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.eav import named, node_cells, wide_nodes
from .operators.ledger import processed, ranges, unshipped
from .operators.orphans import orphan_report, orphans
from .operators.skew import edge_profile, frequencies, percentiles, summary
from .session import scratch
from .sources.tables import table
from .streaming.changefeed import apply_node_feed


def _p4_wide(s: SparkSession, d: str) -> DataFrame:
    return named(*wide_nodes(table(s, d, "wal_ops"), table(s, d, "prop_keys")))


def _weights(s: SparkSession, d: str) -> DataFrame:
    """Hours from creation to load of each edge row, by source."""
    hours = F.floor((F.unix_seconds(F.col("loaded_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 60)
    return frequencies(table(s, d, "graph_edges"), "src_logical_id", hours)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: unshipped(table(s, d, "wal_ops"), table(s, d, "sync_runs")),
        "p1_items": lambda s, d: ranges(table(s, d, "sync_runs")).select(F.col("target").alias("target_id"), "lo", "hi", "state", "token"),
        "p1_processed": lambda s, d: processed(table(s, d, "wal_ops"), scratch(s, "ledger")),
        "p2_found": lambda s, d: orphans(table(s, d, "graph_edges"), table(s, d, "graph_nodes")),
        "p2_report": lambda s, d: orphan_report(table(s, d, "graph_edges"), table(s, d, "graph_nodes")),
        "p3_found": lambda s, d: apply_node_feed(s, f"{d}/wal_ops.parquet", scratch(s, "feed")),
        "p4_found": lambda s, d: node_cells(table(s, d, "wal_ops"), table(s, d, "prop_keys")),
        "p4_wide": _p4_wide,
        "p5_found": lambda s, d: edge_profile(table(s, d, "graph_edges")),
        "p5_modes": lambda s, d: summary(_weights(s, d)).select(F.col("key").alias("node_ref"), "n", "n_distinct", "mode"),
        "p5_percentiles": lambda s, d: percentiles(_weights(s, d), [0.5, 0.9, 0.99]).select(F.col("key").alias("node_ref"), "p", "value"),
    }


_COMMITTED = "select txn_id, min(commit_lsn) as c from wal_ops where op = 'CommitTxn' group by txn_id"

_NODE_RECORDS = f"""
  r as (select distinct lsn, op, vid, logical_id, label_ids, added, removed, key_id, prop_value, props
        from wal_ops join ({_COMMITTED}) using (txn_id)
        where op in ('AddNode', 'DelNode', 'SetNodeLabels', 'SetNodeProp', 'DelNodeProp') and vid is not null),
  life as (select vid, max(lsn) filter (where op = 'AddNode') as since, max(lsn) filter (where op = 'DelNode') as gone, max(lsn) as last_lsn
           from r group by vid),
  alive as (select vid, since, last_lsn from life where since > coalesce(gone, -1))"""

_P1 = f"""
with f as (select lsn, txn_id, min(arrived_at) as a from wal_ops where op not in ('BeginTxn', 'CommitTxn') group by lsn, txn_id),
  c as ({_COMMITTED}),
  done as (select s.target_id, f.lsn from f join c using (txn_id) join sync_runs s
           on s.outcome = 'acked' and s.from_lsn < c.c and c.c <= s.to_lsn and s.started_at >= f.a)
select t.target_id, f.lsn from f join c using (txn_id) cross join (select distinct target_id from sync_runs where target_id is not null) t
except select target_id, lsn from done"""

_P1_ITEMS = """
with a as (select distinct batch_id, target_id, from_lsn, to_lsn, started_at, outcome, ended_at from sync_runs where from_lsn < to_lsn and started_at is not null),
  now as (select greatest(max(started_at), max(ended_at)) as t from a),
  cuts as (select target_id, from_lsn as lo from a union select target_id, to_lsn from a union select target_id, -4611686018427387904 from a),
  i as (select target_id, lo, coalesce(lead(lo) over (partition by target_id order by lo), 4611686018427387904) as hi from cuts),
  f as (select i.target_id, lo, hi, max((started_at, batch_id)) filter (where outcome = 'acked') as done, max((started_at, batch_id)) as top,
               arg_max(outcome is null and ended_at is null and started_at + interval 10 minute > (select t from now), (started_at, batch_id)) as held
        from i left join a on a.target_id = i.target_id and a.from_lsn <= lo and hi <= a.to_lsn group by all)
select target_id, lo, hi, case when done is not null then 'done' when held then 'leased' else 'pending' end as state, coalesce(done, top)[2] as token from f"""

_ORPHANS = """
with n as (select replace(logical_id, '-', '') as k, vid, min(deleted_at) as d, min(loaded_at) as l from graph_nodes group by all),
  p as (select k, min(d) as d, min(l) as l from (select k, d, l from n union all select 'local-' || vid, d, l from n) group by k),
  e as (select logical_id, edge_type, src_logical_id as s, dst_logical_id as t, created_at as c, min(loaded_at) as l from graph_edges group by all),
  r as (select logical_id, edge_type, 'src' as edge_end, s as ref, c, l from e where s is not null
        union all select logical_id, edge_type, 'dst', t, c, l from e where t is not null),
  q as (select r.*, case when ref like 'local-%' then ref else regexp_replace(replace(lower(ref), 'urn:uuid:', ''), '[-{}\\s]', '', 'g') end as k from r),
  o as (select q.logical_id as edge_logical_id, edge_type, edge_end,
               case when p.k is null then 'missing' when p.d <= q.c then 'deleted' when p.l > q.l then 'late' end as reason,
               strftime(c, '%Y-%m') as period_ym from q left join p using (k))"""

_P3 = f"""
with {_NODE_RECORDS},
  touched as (select vid, lsn, unnest(label_ids) as l, true as there from r where op = 'AddNode'
              union all select vid, lsn, unnest(added), true from r where op = 'SetNodeLabels'
              union all select vid, lsn, unnest(list_filter(removed, lambda x: not list_contains(coalesce(added, []), x))), false from r where op = 'SetNodeLabels'),
  last as (select vid, l, arg_max(there, lsn) as there, max(lsn) as lsn from touched group by vid, l),
  labels as (select a.vid, string_agg(l::varchar, ',' order by l) as label_list from alive a join last on last.vid = a.vid and there and last.lsn >= a.since group by a.vid)
select a.vid, r.logical_id, coalesce(label_list, '') as label_list, a.last_lsn
from alive a join r on r.vid = a.vid and r.op = 'AddNode' and r.lsn = a.since left join labels on labels.vid = a.vid"""

_P4 = f"""
with {_NODE_RECORDS},
  single as (select vid, lsn, key_id, case when op = 'SetNodeProp' then trim(prop_value) end as v from r where op in ('SetNodeProp', 'DelNodeProp')),
  objects as (select vid, lsn, k.key_id, trim(props -> ('$."' || k.key_id || '"')) as v
              from r cross join (select distinct key_id from prop_keys where owner_kind = 'node') k
              where op = 'AddNode' and props is not null and json_exists(props, '$."' || k.key_id || '"')),
  last as (select vid, key_id, arg_max(coalesce(v, 'null'), lsn) as v, max(lsn) as lsn from (select * from single union all select * from objects) group by vid, key_id),
  held as (select a.vid, l.key_id, k.value_type as t, v, left(v, 1) = '"' as is_text,
                  case when left(v, 1) = '"' then v::json ->> '$' else v end as x
           from alive a join last l on l.vid = a.vid and l.lsn >= a.since
           join (select distinct key_id, value_type from prop_keys where owner_kind = 'node') k on k.key_id = l.key_id
           where v <> 'null' and left(v, 1) not in ('{{', '[')),
  num as (select *, case when regexp_full_match(trim(x), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then trim(x) end as n from held)
select vid, key_id, cell from (
  select vid, key_id, case t
    when 'string' then x
    when 'bool' then case when (is_text or v in ('true', 'false')) and lower(trim(x)) in ('true', 'false') then lower(trim(x)) end
    when 'double' then case when isfinite(try_cast(n as double)) then cast(cast(round(cast(n as double) * 1000) as hugeint) as varchar) end
    when 'int' then case when regexp_full_match(n, '[+-]?[0-9]+') then cast(try_cast(n as bigint) as varchar)
                         when try_cast(n as double) = floor(try_cast(n as double)) then cast(cast(cast(n as double) as bigint) as varchar) end end as cell
  from num) where cell is not null"""

# The declared node keys in the order of their ids.
_KEYS = "name:string age:int city:string score:double active:bool title:string foundedYear:int text:string externalRef:int rating:double pinned:bool latitude:double longitude:double nickname:string headcount:int firmware:string battery:int online:bool balance:double email:string depth:int slug:string"
_READ = {"string": "{}", "int": "{}::bigint", "double": "{}::double / 1000", "bool": "{}::boolean"}
_P4_WIDE = f"with {_NODE_RECORDS}, c as ({_P4}) select a.vid, " + ", ".join(_READ[t].format(f"max(cell) filter (where key_id = {i})") + f' as "{n}"' for i, (n, t) in enumerate(x.split(":") for x in _KEYS.split())) + " from alive a left join c on c.vid = a.vid group by a.vid"

_P5 = """
with e as (select distinct logical_id, src_logical_id as s, dst_logical_id as t from graph_edges)
select 'src' as edge_end, s as node_ref, count(distinct logical_id) as n_edges, count(distinct t) as n_peers from e where s is not null group by s
union all select 'dst', t, count(distinct logical_id), count(distinct s) from e where t is not null group by t"""

_P5_WEIGHTS = """
with w as (select src_logical_id as node_ref, floor((epoch_us(loaded_at) // 1000000 - epoch_us(created_at) // 1000000) / 60)::bigint as m
           from graph_edges where src_logical_id is not null)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_items": _P1_ITEMS,
        "p1_processed": f"select lsn, c as commit_lsn from (select distinct lsn, txn_id from wal_ops where op not in ('BeginTxn', 'CommitTxn')) join ({_COMMITTED}) using (txn_id)",
        "p2_found": _ORPHANS + " select edge_logical_id, edge_end, reason, period_ym from o where reason is not null",
        "p2_report": _ORPHANS + " select edge_type, edge_end, reason, period_ym, count(*) as n from o where reason is not null group by all",
        "p3_found": _P3,
        "p4_found": _P4,
        "p4_wide": _P4_WIDE,
        "p5_found": _P5,
        "p5_modes": _P5_WEIGHTS + ", f as (select node_ref, m, count(*) as n from w where m is not null group by all), t as (select node_ref, sum(n)::bigint as n, count(*) as n_distinct, max(n) as top from f group by 1) select t.node_ref, t.n, n_distinct, min(m) as mode from t join f on f.node_ref = t.node_ref and f.n = top group by all",
        "p5_percentiles": _P5_WEIGHTS + " select node_ref, p, m as value from (select *, row_number() over (partition by node_ref order by m) as r, count(*) over (partition by node_ref) as c from w where m is not null) cross join (select unnest([0.5, 0.9, 0.99])::double as p) where r = greatest(ceil(p * c), 1)",
    }
