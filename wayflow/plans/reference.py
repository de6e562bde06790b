"""Queries of the engine's own operators over the tables at hand, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayflow.functions import scalar
from wayflow.model import AlgorithmOptions, TrafficOptions
from wayflow.operators import baselines, demand, dependency, facts, nearby, paths, reroute, selection, timeline, traffic
from wayflow.plans import embedding as em
from wayflow.plans import loops
from wayflow.session import cut, fresh, table
from wayflow.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- scalar functions over graph nodes ----
# A hundred-millionth is added before rounding where exact halves occur, so that both engines round them alike.

_BPR = "case when flow <= cap then fft else least(9223372036854775807::hugeint, fft::hugeint + (fft::hugeint * 15 * flow::hugeint * flow * flow * flow + 100 * cap::hugeint * cap * cap * cap - 1) // (100 * cap::hugeint * cap * cap * cap))::bigint end"


@query(f"with {em.NODES_SQL} select run_id, edge_id, time, {_BPR} as delay, least(3600, {_BPR}) as capped from nodes join edges using (edge_id)")
def f_delay(spark, sf_dir):
    rows = em.nodes(spark, sf_dir).join(em.edges(spark, sf_dir), "edge_id")
    delay = scalar.bpr("fft", "cap", "flow")
    return rows.select("run_id", "edge_id", "time", delay.alias("delay"), F.least(F.lit(3600), delay).alias("capped"))


@query(f"""with {em.NODES_SQL} select run_id, edge_id, time, round(fft + fft * 15 / 100.0 * pow(flow / cap::double, 4) + 1e-8, 4) as soft, flow * 1000000 // greatest(1, cap) as ratio,
case when flow > cap then round((flow - cap) / cap::double, 6) else 0 end as excess from nodes join edges using (edge_id)""")
def f_load(spark, sf_dir):
    rows = em.nodes(spark, sf_dir).join(em.edges(spark, sf_dir), "edge_id")
    return rows.select("run_id", "edge_id", "time", F.round(scalar.soft_bpr("fft", "cap", "flow") + 1e-8, 4).alias("soft"), scalar.ratio_key("flow", "cap").alias("ratio"), F.round(scalar.excess("flow", "cap"), 6).alias("excess"))


@query(f"""with {em.NODES_SQL}, r as (select run_id, flow, row_number() over (partition by run_id order by flow) - 1 as i, count(*) over (partition by run_id) as n from nodes)
select run_id, pct, flow as value from r, (values (0), (50), (90), (99), (100)) v(pct) where i = pct * (n - 1) // 100""")
def f_percentile(spark, sf_dir):
    rows = cut(em.nodes(spark, sf_dir))
    parts = [dependency.order_statistic(rows, ["run_id"], "flow", p, "value").select("run_id", F.lit(p).alias("pct"), "value") for p in (0, 50, 90, 99, 100)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query(f"""with {em.NODES_SQL}, b as (select edge_id, fft, cap, max(flow) as flow from nodes join edges using (edge_id) group by all),
s as (select *, max(fft) over () as far, max(flow) over () as most from b),
g as (select edge_id, count(*) as degree from (select src as edge_id from edges union all select dst from edges) group by 1)
select s.edge_id, 1 + (50 * (fft * 1000000 // far) + 50 * (flow * 1000000 // most)) // 100 as score, least(2305843009213693951, flow * 45 // 100) as percent, (flow * 45 * 2 + 100) // 200 as percent_rounded,
round(pow(1 + 1 / (2 * 4.0 * cap), flow / 100.0) / (2 * 24.0 * 1000 * cap), 12) as price, round(exp(0.5) / cap, 9) as bound from s""")
def f_scores(spark, sf_dir):
    rows = em.nodes(spark, sf_dir).join(em.edges(spark, sf_dir), "edge_id").groupBy("edge_id", "fft", "cap").agg(F.max("flow").alias("flow"))
    top = rows.agg(F.max("fft").alias("far"), F.max("flow").alias("most"))
    rows = rows.join(F.broadcast(top))  # one row
    far, most = F.expr("fft * 1000000 div far"), F.expr("flow * 1000000 div most")
    return rows.select(
        "edge_id", scalar.edge_score(far, most).alias("score"), scalar.scale_percent("flow", 45).alias("percent"), scalar.scale_percent_rounded("flow", 45).alias("percent_rounded"),
        F.round(scalar.cell_price(F.col("flow") / 100, F.col("cap"), 4.0, 24.0, 1000.0), 12).alias("price"), F.round(scalar.cell_bound(F.col("cap")), 9).alias("bound"),
    )


@query(f"""with {em.NODES_SQL}, r as (select *, row_number() over (partition by run_id order by flow) - 1 as i, count(*) over (partition by run_id) as n from nodes),
c as (select run_id, flow as clip from r where i = 99 * (n - 1) // 100)
select run_id, edge_id, time, round(case when clip <= 0 then 0 else ln(1 + least(flow, clip)) / ln(1 + clip) end, 9) as impact_norm from nodes join c using (run_id)""")
def f_normalised(spark, sf_dir):
    rows = em.nodes(spark, sf_dir).withColumnRenamed("flow", "impact")
    return dependency.normalised(rows).select("run_id", "edge_id", "time", F.round("impact_norm", 9).alias("impact_norm"))


@query("""select fact_id, case when regexp_full_match(dataset, 'Hop[0-9]+Rep[0-9]+-[0-9]+') then regexp_extract(dataset, '^(Hop[0-9]+Rep[0-9]+)', 1) when regexp_full_match(dataset, '(BJ|MH)RealRep[0-9]+-[0-9]+') then regexp_extract(dataset, '^((?:BJ|MH)RealRep[0-9]+)', 1) else dataset end as family,
coalesce(try_cast(regexp_extract(dataset, '^Hop([0-9]+)Rep', 1) as int), -1) as hop2, try_cast(regexp_extract(dataset, 'Rep([0-9]+)-', 1) as int) as rep2, try_cast(regexp_extract(dataset, '-([0-9]+)$', 1) as int) as seed2,
round((total_before - total_after) / nullif(total_before, 0)::double * 100, 6) as reduction_percent, round(reroute_sec / greatest(batch_count, 1), 6) as per_batch from ablation_facts""")
def f_names(spark, sf_dir):
    p = scalar.dataset_parts("dataset")
    return table(spark, sf_dir, "ablation_facts").select(
        "fact_id", scalar.dataset_group("dataset").alias("family"), p["hop"].alias("hop2"), p["rep"].alias("rep2"), p["seed"].alias("seed2"),
        F.round(scalar.safe_ratio(F.col("total_before") - F.col("total_after"), "total_before"), 6).alias("reduction_percent"), F.round(scalar.per("reroute_sec", "batch_count"), 6).alias("per_batch"),
    )


@query(f"""with {em.FACTS_SQL}, s as (select hop, min(method_total_sec) as lo, max(method_total_sec) as hi from f group by 1)
select run_id, round(case when hi > lo then (method_total_sec - lo) / (hi - lo) else 0.5 end, 6) as scaled, round(case when query_count <= 1024 then 1.0 when query_count <= 4096 then 1.0 + (query_count - 1024) * (3.0 / 3072) when query_count <= 20000 then 4.0 + (query_count - 4096) * (6.0 / 15904) else 10.0 end, 6) as cost,
case removal_mode when 'none' then 0 when 'remove' then 1 else 2 end as mode_rank, total_after from f join s using (hop)""")
def f_scaled(spark, sf_dir):
    rows = facts.scaled(em.facts(spark, sf_dir), ["hop"], "method_total_sec", "scaled")
    rank = scalar.place_of("removal_mode", ["none", "remove"])
    return rows.select("run_id", F.round("scaled", 6).alias("scaled"), F.round(scalar.interpolated("query_count", [(1024, 1.0), (4096, 4.0), (20000, 10.0)]), 6).alias("cost"), rank.alias("mode_rank"), "total_after")


@query("""select line_id, try_cast(trim(split_part(line, ',', 5)) as double) as number, cast(nullif(regexp_extract(line, '^Hop([0-9]+)', 1), '') as int) as lead from raw_results where line_no > 1
and (try_cast(trim(split_part(line, ',', 5)) as double) is null or isfinite(try_cast(trim(split_part(line, ',', 5)) as double)))""")
def f_parsed(spark, sf_dir):
    rows = table(spark, sf_dir, "raw_results").where("line_no > 1")
    return rows.select("line_id", scalar.finite(F.trim(F.split_part("line", F.lit(","), F.lit(5)))).alias("number"), F.nullif(F.regexp_extract("line", r"^Hop([0-9]+)", 1), F.lit("")).try_cast("int").alias("lead"))


# ---- scans and sets ----


@query(f"with {em.EDGES_SQL}, o as (select distinct src as node from edges where src <> dst), i as (select distinct dst as node from edges where src <> dst) select node from o intersect select node from i")
def s_usable_nodes(spark, sf_dir):
    return readers.usable_nodes(em.edges(spark, sf_dir))


@query(f"with {em.EDGES_SQL}, n as (select distinct node from road_nodes where lon is not null and lat is not null) select * from edges where fft > 0 and src in (select node from n) and dst in (select node from n)")
def s_road_edges(spark, sf_dir):
    return readers.road_edges(em.edges(spark, sf_dir), table(spark, sf_dir, "road_nodes").where("lon is not null and lat is not null").distinct()).select("edge_id", "src", "dst", "fft", "cap")


@query("""with f as (select origin, destination, min(candidate_id) as first from query_candidates group by 1, 2), d as (select *, row_number() over (order by first) - 1 as od from f)
select candidate_id, od from query_candidates join d using (origin, destination)""")
def s_od_dictionary(spark, sf_dir):
    return readers.od_dictionary(table(spark, sf_dir, "query_candidates"), "candidate_id").select("candidate_id", "od")


@query("""with p as (select distinct dataset from ablation_facts) select dataset, coalesce(try_cast(regexp_extract(dataset, '^Hop([0-9]+)', 1) as int), -1) as hop, cast(regexp_extract(dataset, 'Rep([0-9]+)-', 1) as int) as rep, cast(regexp_extract(dataset, '-([0-9]+)$', 1) as int) as seed
from p where regexp_full_match(dataset, '(Hop[0-9]+Rep|BJRealRep|MHRealRep)[0-9]+-[0-9]+')""")
def s_datasets(spark, sf_dir):
    files = table(spark, sf_dir, "ablation_facts").select(F.concat(F.lit("/data/"), "dataset", F.lit(".txt")).alias("path")).distinct()
    return readers.datasets(files).drop("path")


@query("""with k as (select file_name as source, try_cast(nullif(regexp_extract(line, '_iter([0-9]+),', 1), '') as int) as iteration, length(line) as n, line_id from raw_results where line_no > 1),
l as (select source, iteration, max_by(n, line_id) as value from k where iteration is not null group by 1, 2) select source, iteration, 'chars' as metric, cast(value as double) as value from l""")
def s_log_metrics(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_results").where("line_no > 1").withColumn("i", F.nullif(F.regexp_extract("line", "_iter([0-9]+),", 1), F.lit(""))).where("i is not null")
    # one log line per result line, the latest of a source and iteration last
    lines = raw.groupBy(F.col("file_name").alias("source"), "i").agg(F.max_by(F.length("line"), "line_id").alias("n")).select("source", F.concat(F.lit("done iteration="), F.col("i"), F.lit(" chars="), F.col("n").cast("string")).alias("value"))
    return readers.log_metrics(lines)


@query(f"with {em.TRIPS_SQL} select run_id, count(*) as query_count, min(depart) as min_departure, max(depart) as max_departure, max(depart) - min(depart) as departure_span_sec, count(distinct (origin, destination)) as unique_od_count from trips group by 1")
def a_trip_summary(spark, sf_dir):
    return writers.trip_summary(em.trips(spark, sf_dir), ["run_id"])


@query(f"""with {em.FACTS_SQL}, s as (select count(*) as rows, count(distinct dataset) as datasets, sum(total_after) as total from f)
select 'rows' as metric, cast(rows as varchar) as value from s union all select 'datasets', cast(datasets as varchar) from s union all select 'total', cast(cast(total as bigint) as varchar) from s""")
def k_report(spark, sf_dir):
    row = em.facts(spark, sf_dir).agg(F.count("*").alias("rows"), F.countDistinct("dataset").alias("datasets"), F.sum("total_after").alias("total"))
    return writers.as_report(row)


@query(f"with {em.FACTS_SQL} select 'peak' as window_label, dataset, hop, rep, seed, run_id as method, query_count from f")
def k_labelled(spark, sf_dir):
    return writers.labelled(em.facts(spark, sf_dir).select("dataset", "hop", "rep", "seed", F.col("run_id").alias("method"), "query_count"), "window_label", "peak")


# ---- timelines ----


@query(f"with {em.PROFILE_SQL} select * from profile")
def t_profile(spark, sf_dir):
    return traffic.profile(em.stays(spark, sf_dir))


@query(f"""with {em.PROFILE_SQL}, p as (select candidate_id as probe, (departure_abs_seconds // 86400) % 2 as run_id, candidate_id % 997 as edge_id, departure_abs_seconds % 86400 as time from query_candidates)
select probe, p.run_id, p.edge_id, p.time, coalesce(c.flow, 0) as flow from p asof left join profile c on p.run_id = c.run_id and p.edge_id = c.edge_id and p.time >= c.time""")
def j_as_of(spark, sf_dir):
    probes = table(spark, sf_dir, "query_candidates").selectExpr("candidate_id as probe", "(departure_abs_seconds div 86400) % 2 as run_id", "cast(candidate_id % 997 as int) as edge_id", "departure_abs_seconds % 86400 as time")
    return timeline.as_of(probes, traffic.profile(em.stays(spark, sf_dir)), ["run_id", "edge_id"], "time", "flow").select("probe", "run_id", "edge_id", "time", "flow")


@query(f"with {em.PROFILE_SQL} select s.run_id, trip_id, pos, s.edge_id, c.time, c.flow from stays s join profile c on s.run_id = c.run_id and s.edge_id = c.edge_id and c.time >= enter and c.time < exit where is_entry")
def j_visits(spark, sf_dir):
    stays = em.stays(spark, sf_dir)
    events = traffic.profile(stays).where("is_entry").select("run_id", "edge_id", "time", "flow")
    met = timeline.interval_join(events, stays.select("run_id", "trip_id", "pos", "edge_id", "enter", "exit"), ["run_id", "edge_id"], "time", "enter", "exit")
    return met.select("run_id", "trip_id", "pos", "edge_id", "time", "flow")


@query(f"with {em.STAYS_SQL} select run_id, edge_id, cast(b as bigint) as bucket, count(*) as flow from (select run_id, edge_id, unnest(range(enter // 600, (greatest(exit, enter + 1) - 1) // 600 + 1)) as b from stays) group by all")
def a_buckets(spark, sf_dir):
    return traffic.bucketed(em.stays(spark, sf_dir), 600)


@query(f"with {em.STAYS_SQL}, b as (select edge_id, unnest(range(enter // 600, (greatest(exit, enter + 1) - 1) // 600 + 1)) as b from stays) select e.src as node, cast(0 as bigint) as kind, count(*) as flow from b join edges e using (edge_id) group by 1 union all select e.dst, 1, count(*) from b join edges e using (edge_id) group by 1")
def a_vertex_flow(spark, sf_dir):
    return traffic.vertex_flow(traffic.bucketed(em.stays(spark, sf_dir), 600), em.edges(spark, sf_dir))


@query(f"""with {em.PROFILE_SQL}, s as (select run_id, edge_id, case when time <= 0 then 0 else time // 600 end as slot, time, flow from profile)
select run_id, edge_id, slot, arg_max(time, (flow, time)) as time, max(flow) as flow from s group by 1, 2, 3""")
def a_slot_nodes(spark, sf_dir):
    return dependency.slot_nodes(traffic.profile(em.stays(spark, sf_dir)), 600)


_AREA = """, g as (select *, time - lag(time) over w as dt, lag(flow) over w as pf from profile window w as (partition by run_id, edge_id order by time)),
area as (select run_id, edge_id, time, flow, is_entry, cast(sum(coalesce(dt * pf, 0)) over (partition by run_id, edge_id order by time) as bigint) as area from g)"""


@query(f"with {em.PROFILE_SQL}{_AREA} select run_id, edge_id, time, area from area")
def w_area(spark, sf_dir):
    return timeline.areas(traffic.profile(em.stays(spark, sf_dir)), ["run_id", "edge_id"]).select("run_id", "edge_id", "time", "area")


_ANCHORS = (
    _AREA
    + """, x as (select *, min(time) over (partition by run_id, edge_id) as first, min(case when is_entry then time end) over (partition by run_id, edge_id) as entry from area),
y as (select *, greatest(first, time - 1200) as wfrom from x),
z as (select y.*, y.time - wfrom as duration, y.area - (a.area + a.flow * (wfrom - a.time)) as window_area from y asof join area a on y.run_id = a.run_id and y.edge_id = a.edge_id and y.wfrom >= a.time),
v as (select z.*, abs(z.flow * duration - window_area) as dev, cap from z join edges using (edge_id) where is_entry),
anchors as (select run_id, edge_id, time, case when time = entry then 0 when duration > 0 and dev * 100 >= 20 * cap * duration then cast(dev::hugeint * 1000000 // (cap * duration) as bigint) end as score from v)"""
)


@query(f"with {em.PROFILE_SQL}{_ANCHORS} select run_id, edge_id, time, score from anchors where score is not null")
def t_anchors(spark, sf_dir):
    return dependency.anchors(cut(traffic.profile(em.stays(spark, sf_dir))), em.edges(spark, sf_dir))


@query(f"with {em.PROFILE_SQL}{_ANCHORS} select p.run_id, p.edge_id, p.time, p.flow, p.flow as original_flow from profile p semi join (select * from anchors where score > 0) a on p.run_id = a.run_id and p.edge_id = a.edge_id and p.time = a.time where is_entry")
def t_important(spark, sf_dir):
    profile = cut(traffic.profile(em.stays(spark, sf_dir)))
    return dependency.important(dependency.nodes(profile), dependency.anchors(profile, em.edges(spark, sf_dir))).select("run_id", "edge_id", "time", "flow", "original_flow")


@query(f"with {em.STAYS_SQL}, a as (select run_id, edge_id as src_edge, enter as src_time, lead(edge_id) over w as dst_edge, lead(enter) over w as dst_time from stays window w as (partition by run_id, trip_id order by pos)) select * from a where dst_edge is not null")
def j_route_arcs(spark, sf_dir):
    return dependency.route_arcs(em.stays(spark, sf_dir))


@query(f"""with {em.PROFILE_SQL}, n as (select run_id, edge_id, time, flow from profile where is_entry), l as (select *, lag(time) over w as pt, lag(flow) over w as pf from n window w as (partition by run_id, edge_id order by time)),
m as (select run_id, edge_id, time, pt, fft, cap, pf as flow from l join edges using (edge_id) where pt is not null)
select run_id, edge_id as src_edge, pt as src_time, edge_id as dst_edge, time as dst_time from m where pt + {_BPR} > time""")
def j_same_edge_arcs(spark, sf_dir):
    return dependency.same_edge_arcs(dependency.nodes(traffic.profile(em.stays(spark, sf_dir))), em.edges(spark, sf_dir))


@query(f"""with {em.NODES_SQL}, r as (select n.*, cap, flow / greatest(cap, 1)::double as ratio from nodes n join edges using (edge_id)),
p as (select run_id, count(*) as nodes, max(flow) as flow_max, round(avg(flow), 6) as flow_mean, round(max(ratio), 6) as ratio_max, round(avg(ratio), 6) as ratio_mean from r group by 1),
a as (select run_id, edge_id, enter, lead(edge_id) over (partition by run_id, trip_id order by pos) as nx from stays), d as (select run_id, edge_id, enter, count(*) as k from a where nx is not null group by all)
select p.*, s.arcs, s.degree_max from p join (select run_id, cast(sum(k) as bigint) as arcs, max(k) as degree_max from d group by 1) s using (run_id)""")
def a_graph_stats(spark, sf_dir):
    return dependency.stats(em.nodes(spark, sf_dir), dependency.route_arcs(em.stays(spark, sf_dir)), em.edges(spark, sf_dir))


@query(f"""with {em.STAYS_SQL}, s as (select *, enter // 600 as slot from stays), w as (select run_id, edge_id as src_edge, slot as src_slot, lead(edge_id) over x as dst_edge, lead(slot) over x as dst_slot from s window x as (partition by run_id, trip_id order by pos))
select distinct run_id, src_edge, src_slot, dst_edge, dst_slot from w where dst_edge is not null and (src_edge <> dst_edge or src_slot <> dst_slot)""")
def t_slot_arcs(spark, sf_dir):
    stays = em.stays(spark, sf_dir)
    slots = dependency.slot_nodes(traffic.profile(stays), 600)
    return dependency.slot_arcs(stays, slots, em.edges(spark, sf_dir), 600).where("kind = 'route'").drop("kind")


# ---- selection over graph nodes: a node's flow stands for its impact ----

_OVER = ", rel as (select n.run_id, n.edge_id, n.time, case when flow > cap then round((flow - cap) / cap::double, 9) else 0 end as relief from nodes n join edges using (edge_id))"


def _relief(spark, sf_dir):
    """Relief of a run without anchors, every impact being 1: the excess of what is over capacity."""
    nodes = em.nodes(spark, sf_dir)
    ones = nodes.select("run_id", "edge_id", "time", F.lit(1.0).alias("impact_norm"))
    none = nodes.limit(0).select("run_id", "edge_id", "time", F.lit(0).alias("score"))
    return dependency.relief(nodes, fresh(ones), fresh(none), em.edges(spark, sf_dir)).withColumn("relief", F.round("relief", 9))


def _on(spark, sf_dir):
    return em.stays(spark, sf_dir).select("run_id", "trip_id", "edge_id", F.col("enter").alias("time"))


_SCORE = f"with {em.NODES_SQL}{_OVER}, v as (select distinct run_id, trip_id, edge_id, enter as time from stays), sc as (select run_id, trip_id, sum(relief) as score from v join rel using (run_id, edge_id, time) where relief > 0 group by 1, 2)"


@query(_SCORE + " select run_id, trip_id, round(score + 1e-8, 5) as score from sc")
def a_route_scores(spark, sf_dir):
    return selection.route_scores(_on(spark, sf_dir), _relief(spark, sf_dir), "relief").select("run_id", "trip_id", F.round(F.col("score") + 1e-8, 5).alias("score"))


@query(_SCORE + ", c as (select *, sum(score) over (partition by run_id order by score desc, trip_id rows between unbounded preceding and 1 preceding) as b, sum(score) over (partition by run_id) as t from sc) select run_id, trip_id from c where coalesce(b, 0) < t * 80 / 100")
def q_score_top(spark, sf_dir):
    return selection.score_top(_on(spark, sf_dir), _relief(spark, sf_dir), 80).select("run_id", "trip_id")


@query(f"with {em.STAYS_SQL}, s as (select run_id, trip_id, sum(flow) as delay from stays group by 1, 2), r as (select *, row_number() over (partition by run_id order by delay desc, trip_id) as place, count(*) over (partition by run_id) as n from s) select run_id, trip_id, cast(delay as bigint) as delay, place from r where place <= 30 * n // 100")
def q_top_fraction(spark, sf_dir):
    rows = em.stays(spark, sf_dir).groupBy("run_id", "trip_id").agg(F.sum("flow").alias("delay"))
    return selection.top_fraction(rows, ["run_id"], [F.desc("delay"), F.col("trip_id")], 30)


@query(f"""with {em.NODES_SQL}{_OVER}, e as (select run_id, edge_id, sum(relief) as mass from rel where relief > 0 group by 1, 2), c as (select *, sum(mass) over (partition by run_id order by mass desc rows between unbounded preceding and 1 preceding) as b, sum(mass) over (partition by run_id) as t from e)
select run_id, count(*) as items from c where coalesce(b, 0) < t * 50 / 100 group by 1""")
def a_mass_cover(spark, sf_dir):
    mass = _relief(spark, sf_dir).groupBy("run_id", "edge_id").agg(F.sum("relief").alias("mass"))
    return selection.covering_count(mass, ["run_id"], "mass", 50)


@query(f"with {em.STAYS_SQL}, a as (select run_id, trip_id, avg(flow) as score from stays group by 1, 2) select run_id, trip_id, round(score, 6) as score from a")
def a_mean_scores(spark, sf_dir):
    return selection.mean_scores(em.stays(spark, sf_dir), "flow").withColumn("score", F.round("score", 6))


_LOADS = """, r as (select n.*, cap, fft, flow * 1000000 // greatest(1, cap) as ratio from nodes n join edges using (edge_id)), k as (select *, row_number() over (partition by run_id order by ratio) - 1 as i, count(*) over (partition by run_id) as n from r),
th as (select run_id, ratio as theta from k where i = 90 * (n - 1) // 100)"""
_ALONG = """, along as (select run_id, edge_id as e, enter as t, lead(edge_id) over w as f, lead(enter) over w as u from stays window w as (partition by run_id, trip_id order by pos))"""


@query(f"""with recursive {em.NODES_SQL}{_LOADS}{_ALONG}, hot as (select run_id, edge_id as e, time as t from r join th using (run_id) where ratio > theta),
below as (select run_id, f as e, u as t from along semi join hot on along.run_id = hot.run_id and along.e = hot.e and along.t = hot.t where f is not null
  union select a.run_id, a.f, a.u from below b join along a on a.run_id = b.run_id and a.e = b.e and a.t = b.t where a.f is not null),
source as (select * from hot anti join below using (run_id, e, t)) select distinct s.run_id, trip_id from stays s join source q on s.run_id = q.run_id and s.edge_id = q.e and s.enter = q.t""")
def c_sources(spark, sf_dir):
    """Trips through a loaded node below which no other loaded one stands, over the stays' route arcs."""
    stays = em.stays(spark, sf_dir)
    return selection.source_congestion(_on(spark, sf_dir), cut(em.nodes(spark, sf_dir)), dependency.route_arcs(stays), em.edges(spark, sf_dir), 90, by_rounds=True)


@query(f"""with {em.NODES_SQL}{_LOADS} select run_id, edge_id, time from r join th using (run_id) where ratio >= theta""")
def t_loaded(spark, sf_dir):
    return dependency.loaded(em.nodes(spark, sf_dir), em.edges(spark, sf_dir), 90)


@query(f"""with recursive {em.NODES_SQL}{_OVER}{_ALONG}, act as (select run_id, edge_id as e, time as t, relief, edge_id || ':' || time as x from rel where relief > 0),
b as (select a.run_id, p.x, q.x as y from along a join act p on a.run_id = p.run_id and a.e = p.e and a.t = p.t join act q on a.run_id = q.run_id and a.f = q.e and a.u = q.t), s as (select * from b union select run_id, y, x from b),
reached as (select run_id, x, x as y from act union select g.run_id, g.x, s.y from reached g join s on g.run_id = s.run_id and g.y = s.x), lab as (select run_id, x, min(y) as c from reached group by 1, 2),
v as (select distinct run_id, trip_id, edge_id as e, enter as t from stays), sc as (select run_id, c, trip_id, sum(relief) as score from v join act using (run_id, e, t) join lab using (run_id, x) group by 1, 2, 3),
m as (select run_id, c, sum(relief) as mass from act join lab using (run_id, x) group by 1, 2), w as (select *, sum(score) over (partition by run_id, c order by score desc, trip_id rows between unbounded preceding and 1 preceding) as before from sc join m using (run_id, c))
select distinct run_id, trip_id from w where coalesce(before, 0) < mass * 50 / 100""")
def c_balanced(spark, sf_dir):
    """Per component of overloaded nodes the trips that cover half of its mass, over the stays' route arcs."""
    relief = cut(_relief(spark, sf_dir))
    arcs = selection._active_arcs(dependency.route_arcs(em.stays(spark, sf_dir)), relief)
    return selection.by_component(_on(spark, sf_dir), relief, dependency.labels(relief, cut(arcs)), 50)


_NORM = """, nr as (select *, row_number() over (partition by run_id order by flow) - 1 as i, count(*) over (partition by run_id) as n from nodes), nc as (select run_id, flow as clip from nr where i = 99 * (n - 1) // 100),
norm as (select run_id, edge_id, time, flow, case when clip <= 0 then 0 else ln(1 + least(flow, clip)) / ln(1 + clip) end as impact_norm from nodes join nc using (run_id))"""


@query(f"with {em.PROFILE_SQL}{_ANCHORS}, nodes as (select run_id, edge_id, enter as time, max(flow) as flow from stays group by 1, 2, 3){_NORM} select run_id, edge_id, time, round(impact_norm * (flow - cap) / cap::double + 1e-9, 6) as relief from norm semi join (select run_id, edge_id, time from anchors where score > 0) a using (run_id, edge_id, time) join edges using (edge_id) where flow > cap and impact_norm > 0")
def t_relief(spark, sf_dir):
    """Excess relief of the anchors, a node's flow standing for its impact."""
    edges, nodes = em.edges(spark, sf_dir), cut(em.nodes(spark, sf_dir))
    norm = dependency.normalised(nodes.withColumnRenamed("flow", "impact"))
    found = dependency.relief(nodes, norm, dependency.anchors(cut(traffic.profile(em.stays(spark, sf_dir))), edges), edges)
    return found.withColumn("relief", F.round(F.col("relief") + 1e-9, 6))


@query(f"""with {em.NODES_SQL}{_NORM}, b as (select n.*, cap, {_BPR} as base from norm n join edges using (edge_id)), br as (select run_id, greatest(base, 1) as d, row_number() over (partition by run_id order by greatest(base, 1)) - 1 as i, count(*) over (partition by run_id) as n from b),
un as (select run_id, d as unit from br where i = 90 * (n - 1) // 100) select run_id, edge_id, time, flow as impact, cast(round(impact_norm * unit * greatest(0.0, least(1.0, (flow / greatest(cap, 1)::double - 0.5) / 0.5)) + 1e-9, 0) as bigint) as penalty from b join un using (run_id)""")
def t_prices(spark, sf_dir):
    """What rerouting pays per node, a node's flow standing for its impact."""
    edges, nodes = em.edges(spark, sf_dir), cut(em.nodes(spark, sf_dir))
    impacts = nodes.join(edges, "edge_id").select("run_id", "edge_id", "time", scalar.bpr("fft", "cap", "flow").alias("base"), F.col("flow").alias("impact"))
    return dependency.penalties(cut(impacts), nodes, edges)


_SOFT = "(fft + fft * 15 / 100.0 * pow({f} / cap::double, 4))"


@query(f"""with {em.NODES_SQL}{_NORM}, g as (select n.*, round({_SOFT.format(f="flow")} - {_SOFT.format(f="(flow - 1)")}, 9) as margin from norm n join edges using (edge_id)),
gr as (select run_id, margin, row_number() over (partition by run_id order by margin) - 1 as i, count(*) over (partition by run_id) as n from g where margin > 0), gc as (select run_id, greatest(margin, 1) as clip from gr where i = 99 * (n - 1) // 100)
select run_id, edge_id, time, round(ln(1 + least(greatest(margin, 0), clip)) / ln(1 + clip) * impact_norm + 1e-9, 5) as relief from g join gc using (run_id) where margin > 0 and impact_norm > 0""")
def t_bpr_relief(spark, sf_dir):
    """Relief by the delay that one vehicle less saves, a node's flow standing for its impact."""
    nodes = cut(em.nodes(spark, sf_dir))
    norm = dependency.normalised(nodes.withColumnRenamed("flow", "impact"))
    return dependency.bpr_relief(nodes, fresh(norm), em.edges(spark, sf_dir)).withColumn("relief", F.round(F.col("relief") + 1e-9, 5))


@query(f"""with {em.NODES_SQL}, e as (select run_id, edge_id, sum(flow) as mass from nodes group by 1, 2), r as (select *, row_number() over (partition by run_id order by mass desc, edge_id) as k from e)
select run_id, round(sum(case when k <= 10 then mass else 0 end) / nullif(sum(mass), 0)::double, 9) as share from r group by 1""")
def a_top_share(spark, sf_dir):
    mass = em.nodes(spark, sf_dir).groupBy("run_id", "edge_id").agg(F.sum("flow").cast("double").alias("mass"))
    return selection.top_share(mass, ["run_id"], "mass", "edge_id", 10).withColumn("share", F.round("share", 9))


@query(f"""with {em.NODES_SQL} select run_id, edge_id, time, case when cap - 1 <= 0 then 9223372036854775807 else cast(trunc(flow * 1000000::double / (cap - 1)) as bigint) end as ratio, cast(least(2305843009213693951::hugeint, flow::hugeint * 100000000000000 + fft) as bigint) as added,
round(0.5 * cap / 500.0 + 0.5 * (1 - flow / (flow + 1)::double), 9) as score from nodes join edges using (edge_id)""")
def f_variants(spark, sf_dir):
    rows = em.nodes(spark, sf_dir).join(em.edges(spark, sf_dir), "edge_id")
    order = scalar.order_score("cap", F.lit(500.0), F.col("flow") / (F.col("flow") + 1))
    return rows.select("run_id", "edge_id", "time", scalar.ratio_key_or_max("flow", F.col("cap") - 1).alias("ratio"), scalar.saturating_add(F.col("flow").cast("decimal(38,0)") * 100_000_000_000_000, "fft").alias("added"), F.round(order, 9).alias("score"))


# ---- demand ----

_CELL = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(n.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(n.lat)) * pow(sin((radians(n.lon) - radians(p.lon)) / 2), 2))))"


@query(f"""with n as (select distinct node, lon, lat from road_nodes where lon between -180 and 180 and lat between -90 and 90), p as (select point_id as id, lon, lat from snapped_points where lon between -180 and 180 and lat between -90 and 90),
m as (select p.id, n.node, {_CELL} as d from p join n on abs(p.lat - n.lat) < 0.003), k as (select *, row_number() over (partition by id order by d, node) as r from m where d <= 300) select id, node, round(d, 4) as snap_m from k where r = 1""")
def j_nearest_node(spark, sf_dir):
    ok = nearby.usable(F.col("lon"), F.col("lat"))
    nodes = table(spark, sf_dir, "road_nodes").where(ok).distinct()
    points = table(spark, sf_dir, "snapped_points").where(ok).select(F.col("point_id").alias("id"), "lon", "lat")
    return demand.nearest_node(points, nodes, 300).select("id", "node", F.round("snap_m", 4).alias("snap_m"))


_POINTS = "pts as (select point_id as id, taxi_id as who, timestamp_seconds as t, node, lon, lat from snapped_points where taxi_id is not null and node is not null and lon between -180 and 180 and lat between -90 and 90)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "snapped_points").where(nearby.usable(F.col("lon"), F.col("lat")) & F.col("taxi_id").isNotNull() & F.col("node").isNotNull()).selectExpr("point_id as id", "taxi_id as who", "timestamp_seconds as t", "node", "lon", "lat")


@query(f"with {_POINTS}, l as (select *, lag(node) over w as pn, lag(t) over w as pt from pts window w as (partition by who order by t, id)) select id, who, t, node from l where not coalesce(pn = node and pt = t, false)")
def w_without_repeats(spark, sf_dir):
    return demand.without_repeats(_points(spark, sf_dir), "who", "t", "node", "id").select("id", "who", "t", "node")


@query(f"""with {_POINTS}, m as (select s.id as s_id, s.who, s.node as origin, n.node as destination, s.t as depart, n.t - s.t as duration, {_CELL.replace("p.", "s.")} / 1000 as km, row_number() over (partition by s.id order by n.t, n.id) as k
from pts s join pts n on s.who = n.who and n.t between s.t + 120 and s.t + 86400), g as (select *, row_number() over (partition by s_id order by k) as r from m where k <= 8 and origin <> destination and km >= 0.3)
select s_id, who, origin, destination, depart, duration, round(km, 6) as km from g where r = 1""")
def j_paired_trips(spark, sf_dir):
    return demand.paired_trips(_points(spark, sf_dir), 120, 86400, 8, 0.3).withColumn("km", F.round("km", 6))


@query("""select candidate_id, case when departure_abs_seconds is null then 'bad_time' when duration_seconds is null or duration_seconds not between 60 and 7200 then 'bad_duration' when pickup_lon is null or pickup_lat is null or not (pickup_lon between -180 and 180 and pickup_lat between -90 and 90) then 'bad_coordinate'
when not (pickup_lon between 116.0 and 117.0 and pickup_lat between 39.5 and 40.5) then 'outside_bbox' when haversine_km is null or haversine_km < 0.3 then 'bad_haversine' when pickup_snap_m is null or pickup_snap_m not between 0 and 200 then 'snap_failed' when origin = destination then 'same_node' end as reason from query_candidates""")
def f_reasons(spark, sf_dir):
    c = F.col
    tests = {
        "bad_time": c("departure_abs_seconds").isNotNull(), "bad_duration": c("duration_seconds").between(60, 7200), "bad_coordinate": nearby.usable(c("pickup_lon"), c("pickup_lat")),
        "outside_bbox": c("pickup_lon").between(116.0, 117.0) & c("pickup_lat").between(39.5, 40.5), "bad_haversine": c("haversine_km") >= 0.3,
        "snap_failed": c("pickup_snap_m").between(0, 200), "same_node": c("origin") != c("destination"),
    }
    return table(spark, sf_dir, "query_candidates").select("candidate_id", demand.first_reason(tests).alias("reason"))


@query("""with n as (select distinct * from road_nodes where lon is not null and lat is not null) select round(min(lon) - 2.0 / (111 * cos(radians(avg(lat)))), 7) as lon0, round(max(lon) + 2.0 / (111 * cos(radians(avg(lat)))), 7) as lon1, round(min(lat) - 2.0 / 111, 7) as lat0, round(max(lat) + 2.0 / 111, 7) as lat1 from n""")
def f_bounding_box(spark, sf_dir):
    box = demand.bounding_box(table(spark, sf_dir, "road_nodes").where("lon is not null and lat is not null").distinct(), 2.0)
    return box.select(*(F.round(c, 7).alias(c) for c in box.columns))


@query(f"""with {em.TRIPS_SQL}, n as (select distinct node from road_nodes n, (select 116.31 as lon, 39.96 as lat) p where n.lon is not null and n.lat is not null and {_CELL} <= 2500) select * from trips where origin in (select node from n) and destination in (select node from n)""")
def f_within_radius(spark, sf_dir):
    nodes = table(spark, sf_dir, "road_nodes").where("lon is not null and lat is not null").distinct()
    return demand.within_radius(em.trips(spark, sf_dir), nodes, 116.31, 39.96, 2.5).select("run_id", "trip_id", "origin", "destination", "depart")


@query(f"with {em.TRIPS_SQL}, s as (select run_id, min(depart) as lo, max(depart) as hi from trips group by 1) select run_id, trip_id, case when hi <= lo then 0 else cast(round_even((depart - lo)::double * 3600 / (hi - lo), 0) as bigint) end as depart from trips join s using (run_id)")
def f_rescaled(spark, sf_dir):
    return demand.rescaled(em.trips(spark, sf_dir), ["run_id"], 3600).select("run_id", "trip_id", "depart")


@query("select destination, count(*) as trips from query_candidates group by 1 order by 2 desc, 1 limit 20")
def o_popular(spark, sf_dir):
    return demand.popular(table(spark, sf_dir, "query_candidates"), 20)


@query(f"with {em.TRIPS_SQL} select run_id, trip_id, cast(k as int) as copy, depart from trips, (values (0), (1), (2)) v(k)")
def o_amplified(spark, sf_dir):
    return demand.amplified(em.trips(spark, sf_dir), "trip_id", 3, 0, 7).select("run_id", "trip_id", "copy", "depart")


@query()
def o_sample(spark, sf_dir):
    return demand.sample(em.trips(spark, sf_dir), "trip_id", 500, 1)


@query()
def o_slices(spark, sf_dir):
    return demand.slices(em.trips(spark, sf_dir), "trip_id", 5, 3).select("trip_id", "part")


@query()
def q_random(spark, sf_dir):
    return selection.random_fraction(em.trips(spark, sf_dir), 30, 0)


# ---- facts ----


@query(f"with {em.FACTS_SQL} select selection_method, gamma, count(*) as n, round(avg(reduction), 3) as mean, round(median(reduction), 3) as median, max(reduction) as most, round(avg(case when total_after < total_before then 1.0 else 0.0 end), 6) as win_rate from f group by 1, 2")
def a_group_means(spark, sf_dir):
    return facts.group_means(em.facts(spark, sf_dir), ["selection_method", "gamma"], "reduction", F.col("total_after") < F.col("total_before"))


@query(f"with {em.FACTS_SQL}, r as (select *, row_number() over (partition by dataset order by total_after, iteration, run_id, random_seed) as k from f) select dataset, total_after, iteration, run_id from r where k = 1")
def a_best_row(spark, sf_dir):
    c = F.col
    return facts.best(em.facts(spark, sf_dir), ["dataset"], [c("total_after"), c("iteration"), c("run_id"), c("random_seed")]).select("dataset", "total_after", "iteration", "run_id")


_CURVE = f"with {em.FACTS_SQL}, p as (select dataset, arg_min(total_before, iteration) as total, 0 as iteration from (select dataset, iteration, min(total_before) as total_before from f group by 1, 2) group by 1 union all select dataset, min(total_after), iteration + 1 from f group by dataset, iteration)"


def _curves(spark, sf_dir):
    # one total per iteration, so that the first row is well defined
    rows = em.facts(spark, sf_dir).groupBy("dataset", "iteration").agg(F.min("total_before").alias("total_before"), F.min("total_after").alias("total_after"))
    return facts.curve(rows, ["dataset"])


@query(_CURVE + " select dataset, total, iteration from p")
def a_curve(spark, sf_dir):
    return _curves(spark, sf_dir).select("dataset", "total", "iteration")


@query(_CURVE + """, m as (select dataset, arg_min(total, iteration) as t0, arg_max(total, iteration) as last, min(case when iteration > 0 then total end) as least, avg(case when iteration > 0 then total end) as mean from p group by 1)
select dataset, case when t0 > 0 and least is not null then round(1 - last / t0::double, 6) end as final_reduction, case when t0 > 0 and least is not null then round(1 - mean / t0::double, 6) end as speed, case when t0 > 0 and least is not null then last - least end as rebound from m""")
def a_curve_metrics(spark, sf_dir):
    return facts.curve_metrics(_curves(spark, sf_dir), ["dataset"])


@query(_CURVE + """, u as (select *, case when lag(total) over w is null then 0 else greatest(0, total - lag(total) over w) end as up from p window w as (partition by dataset order by iteration)),
m as (select dataset, max(up) as max_up, cast(sum(up) as bigint) as sum_up, count(*) filter (where up > 0) as num_up_steps, max(total) - min(total) as range, arg_min(total, iteration) as t0 from u group by 1)
select dataset, max_up, sum_up, num_up_steps, round(max_up / nullif(t0, 0)::double, 6) as max_up_ratio, round(sum_up / nullif(t0, 0)::double, 6) as sum_up_ratio, round(range / nullif(t0, 0)::double, 6) as range_ratio from m""")
def a_volatility(spark, sf_dir):
    return facts.volatility(_curves(spark, sf_dir), ["dataset"])


@query(f"""with {em.FACTS_SQL}, m as (select dataset, count(distinct iteration) as iterations, min(total_after) as best, arg_max(total_after, (iteration, total_after)) as final, sum(method_total_sec) as sec, avg(selected_fraction) as fraction from f group by 1)
select dataset, iterations, best, final, final - best as fluctuation, round(sec, 6) as total_sec, round(fraction + 1e-9, 6) as mean_fraction from m where iterations >= 2""")
def a_rolled_up(spark, sf_dir):
    return facts.rolled_up(em.facts(spark, sf_dir), ["dataset"], 2).drop("reduction_percent")


@query(f"with {em.FACTS_SQL} select query_count, count(*) as n, round(avg(reroute_sec), 4) as mean, round(stddev_pop(reroute_sec), 4) as std_pop, round(stddev_samp(reroute_sec), 4) as std_samp from f group by 1")
def a_spread(spark, sf_dir):
    return facts.spread(em.facts(spark, sf_dir), ["query_count"], "reroute_sec")


@query(f"with {em.FACTS_SQL} select hop, seed, iteration, selection_method, count(*) as rows from f group by all having count(*) > 1")
def a_duplicates(spark, sf_dir):
    return facts.duplicates(em.facts(spark, sf_dir), ["hop", "seed", "iteration", "selection_method"])


@query(f"with {em.FACTS_SQL} select hop, seed, count(distinct iteration) as found, count(*) as rows, count(distinct iteration) >= 3 as complete from f group by 1, 2")
def a_completeness(spark, sf_dir):
    return facts.completeness(em.facts(spark, sf_dir), ["hop", "seed"], "iteration", 3)


@query(f"with {em.FACTS_SQL} select dataset, selection_method, round(sum(reroute_sec), 6) as part, round(sum(reroute_sec) / nullif(sum(method_total_sec), 0) * 100, 4) as share from f group by 1, 2")
def a_share(spark, sf_dir):
    return facts.share_of_total(em.facts(spark, sf_dir), ["dataset", "selection_method"], "reroute_sec", "method_total_sec")


_KEYS = "hop, rep, seed, query_count"


@query(f"with {em.FACTS_SQL}, a as (select {_KEYS}, min(total_after) as normal from f where reroute_method = 'normal_td_dijkstra' group by all), b as (select {_KEYS}, min(total_after) as priced from f where reroute_method = 'tdg_impact_reroute' group by all) select *, round(normal / nullif(priced, 0)::double * 100, 4) as ratio from a join b using ({_KEYS})")
def j_compared(spark, sf_dir):
    f = em.facts(spark, sf_dir)
    return facts.compared(f.where("reroute_method = 'normal_td_dijkstra'"), f.where("reroute_method = 'tdg_impact_reroute'"), _KEYS.split(", "), "total_after", ("normal", "priced"))


@query(f"with {em.FACTS_SQL}, a as (select {_KEYS}, min(select_sec) as random_sec from f where selection_method = 'random' group by all), b as (select {_KEYS}, min(select_sec) as graph_sec from f where selection_method like 'tdg%' group by all) select *, round(random_sec / nullif(graph_sec, 0)::double * 100, 4) as ratio from a join b using ({_KEYS})")
def j_slowdown(spark, sf_dir):
    f = em.facts(spark, sf_dir)
    return facts.compared(f.where("selection_method = 'random'"), f.where("selection_method like 'tdg%'"), _KEYS.split(", "), "select_sec", ("random_sec", "graph_sec"))


@query(f"with {em.FACTS_SQL}, g as (select hop, avg(total_after) as mean from f group by 1) select run_id, dataset, total_after, round(total_after / nullif(mean, 0), 6) as to_mean from f left join g using (hop)")
def j_added_back(spark, sf_dir):
    f = em.facts(spark, sf_dir)
    return facts.to_group_mean(f, ["hop"], "total_after", "to_mean").select("run_id", "dataset", "total_after", F.round("to_mean", 6).alias("to_mean"))


@query(f"with {em.FACTS_SQL}, g as (select hop, seed, arg_min(gamma, (total_after, gamma)) as gamma from f where gamma is not null group by 1, 2) select f.run_id, f.hop, f.seed, f.gamma, f.total_after from f join g using (hop, seed, gamma)")
def j_picks(spark, sf_dir):
    f = em.facts(spark, sf_dir)
    return facts.picked(f, ["hop", "seed"], "gamma", "total_after").select("run_id", "hop", "seed", "gamma", "total_after")


@query(f"with {em.FACTS_SQL}, done as (select hop, seed from f group by 1, 2 having count(distinct iteration) >= 3) select distinct hop, seed, 'missing' as state from f anti join done using (hop, seed) union all select distinct hop, seed, 'complete' from f semi join done using (hop, seed)")
def j_anti_semi(spark, sf_dir):
    f = em.facts(spark, sf_dir).select("hop", "seed", "iteration")
    return facts.by_state(f, ["hop", "seed"], "iteration", 3)


@query(f"""with {em.FACTS_SQL}, d as (select dataset, max(reduction) as score, max(query_count) as size from f group by 1), a as (select *, 0 as tier from d where size >= 10000 order by score desc, dataset limit 10),
b as (select *, 1 as tier from d where dataset not in (select dataset from a) order by score desc, dataset limit 10) select * from a union all select * from b""")
def o_tiered(spark, sf_dir):
    d = em.facts(spark, sf_dir).groupBy("dataset").agg(F.max("reduction").alias("score"), F.max("query_count").alias("size"))
    return facts.tiered(d, [("size >= 10000", 10), ("true", 10)], "dataset", "score")


@query(f"with {em.FACTS_SQL}, a as (select distinct dataset from f where hop = -1), b as (select distinct dataset from f where iteration >= 3) select dataset, 'both' as side from (select * from a intersect select * from b) union all select dataset, 'first' from (select * from a except select * from b)")
def o_sets(spark, sf_dir):
    f = em.facts(spark, sf_dir)
    a, b = f.where("hop = -1").select("dataset"), f.where("iteration >= 3").select("dataset")
    return a.intersect(b).withColumn("side", F.lit("both")).unionAll(a.distinct().subtract(b).withColumn("side", F.lit("first")))


# ---- paths ----


@query()
def p_routes(spark, sf_dir):
    return paths.shortest_routes(em.edges(spark, sf_dir), em.trips(spark, sf_dir)).select("run_id", "trip_id", "edges", "tt")


_SOURCES = "select distinct origin as source from query_candidates where origin is not null"


@query(f"""with recursive {em.EDGES_SQL}, d as (
  select cast(v.source as int) as source, cast(v.source as int) as node, 0::bigint as dist from ({_SOURCES}) v
  union
  select d.source, dst, d.dist + fft from d join edges on d.node = src where d.dist + fft <= 150
) select source, node, min(dist) as dist from d group by 1, 2""")
def p_bounded(spark, sf_dir):
    sources = table(spark, sf_dir, "query_candidates").where("origin is not null").select(F.col("origin").alias("source"))
    return paths.distances(em.edges(spark, sf_dir), sources, 150)


# all distances by doubling the number of hops: min-plus squares of the matrix of edges
_DOUBLED = ", ".join(f"d{k} as materialized (select x.a, y.b, min(x.d + y.d) as d from d{k - 1} x join d{k - 1} y on x.b = y.a group by 1, 2)" for k in range(1, 11))
_CLOSURE = f"""with {em.EDGES_SQL}, ends as (select src as node from edges union select dst from edges union select origin from query_candidates where origin is not null union select destination from query_candidates where destination is not null),
d0 as (select a, b, min(d) as d from (select src as a, dst as b, fft as d from edges union all select node, node, 0 from ends) group by 1, 2), {_DOUBLED}, t as (select distinct destination as node from query_candidates where destination is not null)"""


def _destinations(spark, sf_dir):
    return table(spark, sf_dir, "query_candidates").where("destination is not null").select(F.col("destination").alias("source")).distinct()


@query(_CLOSURE + " select b as source, a as node, d as dist from d10 where b in (select node from t)")
def p_reverse(spark, sf_dir):
    return paths.distances(em.edges(spark, sf_dir), _destinations(spark, sf_dir), backward=True)


@query(_CLOSURE + " select a as source, b as node, d as dist from d10 where a in (select node from t)")
def p_relaxed(spark, sf_dir):
    return paths.relaxed_distances(em.edges(spark, sf_dir), _destinations(spark, sf_dir))


@query(_CLOSURE + " select a as source, b as node, d as dist from d10 where a in (select node from t) and d between 300 and 600")
def p_range(spark, sf_dir):
    return paths.nodes_in_range(em.edges(spark, sf_dir), _destinations(spark, sf_dir), 300, 600)


@query(_CLOSURE + f", {em.TRIPS_SQL} select run_id, trip_id, cast(coalesce(d, 0) as bigint) as tt, d > 0 as reached from (select run_id, trip_id, (select d from d10 where a = origin and b = destination) as d from trips)".replace("d > 0 as reached", "coalesce(d > 0, false) as reached"))
def p_costs(spark, sf_dir):
    """Travel time of the shortest route of every trip, whichever of several equal ones it is."""
    found = paths.shortest_routes(em.edges(spark, sf_dir), em.trips(spark, sf_dir))
    return found.select("run_id", "trip_id", "tt", (F.size("edges") > 0).alias("reached"))


@query(_CLOSURE + """, q as (select distinct origin, destination from query_candidates where origin is not null and destination is not null),
m as (select q.origin as a, q.destination as b, x.d + y.d as cost, x.b as hub from q join d10 x on x.a = q.origin join d10 y on y.a = x.b and y.b = q.destination) select a, b, min(cost) as cost, arg_min(hub, (cost, hub)) as hub from m group by 1, 2""")
def j_hub_merge(spark, sf_dir):
    """Costs of pairs by labels that have every node as a hub."""
    edges = em.edges(spark, sf_dir)
    ends = table(spark, sf_dir, "query_candidates").where("origin is not null and destination is not null").selectExpr("origin as a", "destination as b").distinct()
    out, into = paths.distances(edges, ends.selectExpr("a as source")), paths.distances(edges, ends.selectExpr("b as source"), backward=True)
    return baselines.merge_labels(out, into, ends)


@query()
def p_diverse(spark, sf_dir):
    return paths.diverse_routes(em.edges(spark, sf_dir), em.trips(spark, sf_dir), 3, 70).select("run_id", "trip_id", "edges", "tt")


@query(_CLOSURE + f", {em.TRIPS_SQL} select trip_id, origin = destination or d is not null as contiguous from trips left join d10 on a = origin and b = destination")
def p_valid(spark, sf_dir):
    """A verdict for every trip: a route without edges is one only where origin and destination are the same."""
    edges = em.edges(spark, sf_dir)
    return paths.valid(paths.shortest_routes(edges, em.trips(spark, sf_dir)), edges).select("trip_id", "contiguous")


@query()
def p_greedy(spark, sf_dir):
    return baselines.greedy_routes(em.trips(spark, sf_dir), em.edges(spark, sf_dir, em.CAP))


@query()
def p_priced(spark, sf_dir):
    return baselines.priced_routes(em.trips(spark, sf_dir), em.edges(spark, sf_dir))


@query()
def p_labels(spark, sf_dir):
    edges, trips = em.edges(spark, sf_dir), em.trips(spark, sf_dir)
    free = traffic.free_flow_schedule(loops.initial_routes(edges, trips), edges)
    flows = traffic.bucketed(free, 21600, ["edge_id"])
    return baselines.label_routes(trips, flows, edges, 21600)


# ---- traffic and loops ----


@query()
def t_congestion(spark, sf_dir):
    edges, trips = em.edges(spark, sf_dir, em.CAP), em.trips(spark, sf_dir)
    free = cut(paths.shortest_routes(edges, trips))
    return traffic.totals(traffic.simulate(free, edges), free)


@query()
def t_simulated(spark, sf_dir):
    edges = em.edges(spark, sf_dir, em.CAP)
    return traffic.simulate(loops.initial_routes(edges, em.trips(spark, sf_dir)), edges)


@query()
def t_simulated_by_rounds(spark, sf_dir):
    edges = em.edges(spark, sf_dir, em.CAP)
    return traffic.simulate_by_rounds(cut(loops.initial_routes(edges, em.trips(spark, sf_dir))), edges)


def _graph(spark, sf_dir, compressed=False):
    """Edges, trips and the graph of their traffic, built anew for every query."""
    edges, trips = em.edges(spark, sf_dir, em.CAP), em.trips(spark, sf_dir)
    now = cut(traffic.simulate(loops.initial_routes(edges, trips), edges))
    return edges, trips, loops.graph_of(now, edges, AlgorithmOptions(), TrafficOptions(), compressed)


@query()
def t_impacts(spark, sf_dir):
    return _graph(spark, sf_dir)[2].impacts


@query()
def t_penalties(spark, sf_dir):
    edges, _, g = _graph(spark, sf_dir)
    return dependency.penalties(g.impacts, g.nodes, edges)


@query()
def t_components(spark, sf_dir):
    _, _, g = _graph(spark, sf_dir)
    return dependency.run_components(g.nodes, g.arcs)


_PARTS = f"""with recursive {em.STAYS_SQL}, a as (select run_id, edge_id as e, enter as t, lead(edge_id) over w as f, lead(enter) over w as u from stays window w as (partition by run_id, trip_id order by pos)),
n as (select distinct run_id, edge_id as e, enter as t from stays), b as (select distinct run_id, e || ':' || t as x, f || ':' || u as y from a where f is not null), s as (select run_id, x, y from b union select run_id, y, x from b),
r as (select run_id, e || ':' || t as x, e || ':' || t as y from n union select r.run_id, r.x, s.y from r join s on r.run_id = s.run_id and r.y = s.x)"""


@query(_PARTS + " select run_id, count(*) as nodes, cast(sum(size) as bigint) as pairs from (select run_id, x, count(*) as size from r group by 1, 2) group by 1")
def t_component_sizes(spark, sf_dir):
    """Weak components of the stays' route arcs: per run the nodes and the ordered pairs of nodes in one component."""
    sizes = dependency.component_sizes(em.visited(spark, sf_dir))
    return sizes.groupBy("run_id").agg(F.sum("k").alias("nodes"), F.sum(F.col("k") * F.col("k")).alias("pairs"))


@query()
def t_compressed(spark, sf_dir):
    _, _, g = _graph(spark, sf_dir)
    return dependency.compressed_visits(g.trajectories, g.profile, g.anchors)


@query()
def t_compressed_graph(spark, sf_dir):
    """Size of the compressed graph beside the fine one."""
    edges, _, g = _graph(spark, sf_dir)
    reduced = cut(dependency.compressed_visits(g.trajectories, g.profile, g.anchors))
    nodes = cut(dependency.compressed_nodes(reduced, g.profile))
    arcs = dependency.joined_arcs(dependency.compressed_arcs(reduced), nodes, edges)
    fine = dependency.stats(g.nodes, g.arcs, edges).select("run_id", F.col("nodes").alias("fine_nodes"), F.col("arcs").alias("fine_arcs"))
    return dependency.stats(nodes, arcs, edges).join(fine, "run_id").withColumn("ratio", F.round(F.col("fine_nodes") / F.col("nodes"), 2))


@query()
def t_slot_impacts(spark, sf_dir):
    edges, _, g = _graph(spark, sf_dir)
    slots = cut(dependency.slot_nodes(g.profile, 600))
    return dependency.slot_impacts(slots, dependency.slot_arcs(g.trajectories, slots, edges, 600), edges)


def _candidates(name: str):
    def run(spark, sf_dir):
        edges, trips, g = _graph(spark, sf_dir)
        return selection.candidates(name, trips=trips, visits=g.visits, nodes=g.nodes, arcs=g.arcs, edges=edges, relief=g.relief, options=AlgorithmOptions())

    return run


for _name in ("source_congestion", "component_balanced", "component_marginal", "component_marginal_major80_budget5"):
    QUERIES[f"c_{_name}"] = _candidates(_name)


def _selected(name: str):
    def run(spark, sf_dir):
        edges, trips, g = _graph(spark, sf_dir)
        return loops.select(name, g, trips, edges, AlgorithmOptions(), trips.select("run_id", "trip_id"))

    return run


for _name in ("tdg", "tdg_anchor", "tdg_congestion", "tdg_excess_relief", "tdg_bpr_relief", "most_delayed"):
    QUERIES[f"q_{_name}"] = _selected(_name)


@query()
def b_batches(spark, sf_dir):
    edges, trips, g = _graph(spark, sf_dir)
    chosen = loops.select("tdg_excess_relief", g, trips, edges, AlgorithmOptions(), trips.select("run_id", "trip_id"))
    return selection.batches(chosen, g.visits, g.nodes, edges, 90, 70)


@query()
def q_slot_select(spark, sf_dir):
    edges, _, g = _graph(spark, sf_dir)
    slots = cut(dependency.slot_nodes(g.profile, 600))
    arcs = cut(dependency.slot_arcs(g.trajectories, slots, edges, 600))
    pool = selection.slot_candidates(slots, arcs, g.trajectories, edges, 600, 90)
    return selection.slot_select(g.trajectories, slots, arcs, pool, edges, 600, 50)


@query()
def r_unselected(spark, sf_dir):
    edges, trips = em.edges(spark, sf_dir, em.CAP), em.trips(spark, sf_dir)
    return loops.unselected_total(cut(loops.initial_routes(edges, trips)), selection.random_fraction(trips, 30, 0), edges)


def _loop(name: str):
    def run(spark, sf_dir):
        return loops.run_named(name, em.edges(spark, sf_dir, em.CAP), em.trips(spark, sf_dir), AlgorithmOptions(), TrafficOptions(), False).by_iteration()

    return run


for _name in loops.LOOPS:
    QUERIES[f"r_{_name}"] = _loop(_name)


@query()
def k_ablation(spark, sf_dir):
    """Ablation facts of a loop, without the columns that hold seconds, which differ from time to time."""
    done = loops.run_named("baseline", em.edges(spark, sf_dir, em.CAP), em.trips(spark, sf_dir), AlgorithmOptions(max_iterations=2))
    rows = writers.shaped(done.facts().withColumn("run_id", F.concat(F.lit("run"), F.col("run_id").cast("string"))), "ablation")
    return rows.drop(*(c for c in rows.columns if c.endswith("_sec")))


@query()
def r_slots(spark, sf_dir):
    return loops.slot_loop(em.edges(spark, sf_dir, em.CAP), em.trips(spark, sf_dir), 600, AlgorithmOptions()).by_iteration()
