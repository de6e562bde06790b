"""How the tables at hand are read as roads, trips, stays and results; the SQL twins of each view stand beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflow.operators import facts as facts_ops
from wayflow.session import cut, measured, table

#: Departures of RUN_DAYS successive days are as many runs; capacities are divided by CAP so that the trips at hand meet congestion.
RUN_DAYS, CAP = 4, 40

EDGES_SQL = "edges as (select distinct edge_id, from_node as src, to_node as dst, free_flow_time as fft, cast(greatest(1, coalesce(capacity, 1)) as int) as cap from road_edges)"


def edges(spark: SparkSession, sf_dir: str, divide: int = 1) -> DataFrame:
    cap = F.greatest(F.lit(1), F.expr(f"coalesce(capacity, 1) div {divide}")).cast("int").alias("cap")
    return table(spark, sf_dir, "road_edges").distinct().select("edge_id", F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.col("free_flow_time").alias("fft"), cap)


TRIPS_SQL = f"""trips as (select (departure_abs_seconds // 86400) % {RUN_DAYS} as run_id, cast(candidate_id as int) as trip_id, origin, destination, departure_abs_seconds % 86400 as depart from query_candidates)"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "query_candidates").selectExpr(f"(departure_abs_seconds div 86400) % {RUN_DAYS} as run_id", "cast(candidate_id as int) as trip_id", "origin", "destination", "departure_abs_seconds % 86400 as depart")


#: Graph nodes as stays: ten ids in a row are a trip; a stay lasts the edge's free-flow time.
STAYS_SQL = (
    EDGES_SQL
    + """, t as (select distinct * from tdg_nodes where edge_id is not null and flow >= 0),
stays as (select cast(split_part(dataset, '-', 2) as bigint) as run_id, cast(id // 10 as int) as trip_id, cast(id % 10 as int) as pos, t.edge_id, time_sec as enter, time_sec + fft as exit, id % 10 = 9 as last, cast(flow as bigint) as flow
from t join edges using (edge_id))"""
)


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tdg_nodes").where("edge_id is not null and flow >= 0").select("id", "dataset", "edge_id", "time_sec", "flow").distinct()
    rows = t.join(edges(spark, sf_dir).select("edge_id", "fft"), "edge_id")
    return rows.selectExpr("cast(split_part(dataset, '-', 2) as bigint) as run_id", "cast(id div 10 as int) as trip_id", "cast(id % 10 as int) as pos", "edge_id", "time_sec as enter", "time_sec + fft as exit", "id % 10 = 9 as last", "cast(flow as bigint) as flow")


def visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, trip_id, edge_id, enter of the stays, where repeats do not matter: neither copies are removed nor roads joined."""
    t = table(spark, sf_dir, "tdg_nodes").where("edge_id is not null and flow >= 0")
    known = measured(cut(table(spark, sf_dir, "road_edges").select("edge_id").distinct()))
    return t.join(known, "edge_id", "left_semi").selectExpr("cast(split_part(dataset, '-', 2) as bigint) as run_id", "cast(id div 10 as int) as trip_id", "edge_id", "time_sec as enter")


PROFILE_SQL = (
    STAYS_SQL
    + """, deltas as (select run_id, edge_id, enter as time, 1 as d, 1 as e from stays union all select run_id, edge_id, exit, -1, 0 from stays where not last),
changes as (select run_id, edge_id, time, sum(d) as d, max(e) as e from deltas group by all),
profile as (select run_id, edge_id, time, cast(sum(d) over (partition by run_id, edge_id order by time) as bigint) as flow, e = 1 as is_entry from changes)"""
)

#: Graph nodes as they are: one per (run, edge, time), the largest flow of equal ones.
NODES_SQL = STAYS_SQL + """, nodes as (select run_id, edge_id, enter as time, max(flow) as flow, max(flow) as original_flow from stays group by 1, 2, 3)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays(spark, sf_dir).groupBy("run_id", "edge_id", F.col("enter").alias("time")).agg(F.max("flow").alias("flow"), F.max("flow").alias("original_flow"))


FACTS_SQL = "f as (select distinct * exclude (fact_id) from ablation_facts where hop is not null and seed is not null and total_after >= 0)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_ops.distinct_facts(table(spark, sf_dir, "ablation_facts"))
