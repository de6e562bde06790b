"""Queries of the training-data problems (4 to 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflow.llm import encode, leaks, quantiles, sentences, topn
from wayflow.operators.delimited import ABLATION_COLUMNS
from wayflow.session import cut, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "ablation_facts")
    best = topn.top_n(facts.where("total_after >= 0"), ["hop", "seed"], "total_after", "fact_id", 5, [c for c in facts.columns if c != "fact_id"])
    return best.select("hop", "seed", "fact_id")


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "ablation_facts")
    best = topn.top_n(facts.where("total_after >= 0"), ["hop", "seed"], "total_after", "fact_id", 5, [c for c in facts.columns if c != "fact_id"])
    return best.withColumnRenamed("rank", "place")


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id once; on a checkpoint, since the rows are read again for what a digest leaves open."""
    nodes = table(spark, sf_dir, "tdg_nodes").where("edge_id is not null and flow >= 0").select("id", "edge_id", "flow", "time_sec")
    return cut(nodes.dropDuplicates(["id"]).select("edge_id", "flow", "time_sec"))


def _capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "road_edges").where("capacity >= 1").groupBy("edge_id").agg(F.min("capacity").alias("limit"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles.exceeding(_flows(spark, sf_dir), "edge_id", "flow", _capacities(spark, sf_dir), [50, 90])
    return found.select(F.col("grp").cast("int").alias("edge_id"), F.col("pct").cast("int").alias("pct"))


def p5_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per edge from digests of separate hours, with the bound on the error and the capacity."""
    flows = _flows(spark, sf_dir)
    parts = [quantiles.digest(flows.where(F.expr(f"pmod(time_sec div 3600, 4) = {k}")), "edge_id", "flow") for k in range(4)]
    nodes = quantiles.merge(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))
    asked = quantiles.percentiles(nodes, [50, 90, 95, 99]).withColumnRenamed("grp", "edge_id")
    return asked.join(_capacities(spark, sf_dir).withColumn("edge_id", F.col("edge_id").cast("bigint")), "edge_id", "left").withColumnRenamed("limit", "capacity")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p4_top": p4_top, "p5_found": p5_found, "p5_combined": p5_combined, "p6_ids": p6_ids, "p7_found": p7_found, "p7_spans": p7_spans, "p8_found": p8_found}

_TOP = f"""
with g as (select *, row_number() over (partition by {", ".join(c for c, _ in ABLATION_COLUMNS)} order by fact_id) as copy from ablation_facts where hop is not null and seed is not null and total_after >= 0),
d as (select * from g where copy = 1),
r as (select *, row_number() over (partition by hop, seed order by total_after, fact_id) as place from d)
"""
_FLOWS = """
with f as (select id, any_value(edge_id) as edge_id, any_value(flow) as flow from tdg_nodes where edge_id is not null and flow >= 0 group by id),
r as (select edge_id, flow, row_number() over (partition by edge_id order by flow) - 1 as i, count(*) over (partition by edge_id) as n from f),
c as (select edge_id, min(capacity) as capacity from road_edges where capacity >= 1 group by 1)
"""
SQL = {
    "p4_found": _TOP + "select hop, seed, fact_id from r where place <= 5",
    "p4_top": _TOP + "select hop, seed, total_after, fact_id, place from r where place <= 5",
    # exact while no edge has more than K flows, as at the scale at which the two are compared; beyond it the digests fold
    "p5_combined": _FLOWS + """, v as (select edge_id, pct, n, flow as v, greatest(0, length(bin(flow)) - 12) as s from r, (values (50), (90), (95), (99)) v(pct) where i = pct * (n - 1) // 100),
b as (select *, (v >> s) << s as lo, ((v >> s) << s) + (1 << s) - 1 as hi from v)
select cast(edge_id as bigint) as edge_id, n, """
    + ", ".join(f"cast(max(case when pct = {p} then {b} end) as bigint) as {b}{p}" for b in ("lo", "hi") for p in (50, 90, 95, 99))
    + ", max(c.capacity) as capacity from b left join c using (edge_id) group by edge_id, n",
    "p5_found": _FLOWS + "select edge_id, pct from r join c using (edge_id), (values (50), (90)) v(pct) where i = pct * (n - 1) // 100 and flow > capacity",
}
