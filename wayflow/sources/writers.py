"""Sinks: fact tables by schema, trip files, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflow.operators.delimited import ABLATION_COLUMNS

#: Columns of the fact tables, in order (fixed values).
FACTS = {
    "ablation": [c for c, _ in ABLATION_COLUMNS],
    "one_shot": "dataset, hop, rep, seed, method, query_count, unreachable_count, initial_total_travel_time, final_total_travel_time, avg_initial_travel_time, avg_final_travel_time, reference_sec, profile_sec, index_sec, route_sec, evaluate_sec, total_sec, parameters".split(", "),
    "congestion": "dataset, hop, rep, seed, query_count, min_departure, max_departure, departure_span_sec, reachable_count, unreachable_count, free_flow_ttt, evaluated_ttt, congestion_extra_ttt, inflation_ratio, avg_free_flow_tt, avg_evaluated_tt, shortest_path_sec, evaluate_sec".split(", "),
    "selection_debug": "run_id, dataset, hop, rep, seed, algorithm, removal_mode, query_count, lambda, gamma, theta_percentile, anchor_window, anchor_threshold, random_seed, selected_count, important_node_count, total_before, tdg_unselected_after_remove, random_unselected_after_remove, tdg_prepare_sec, tdg_select_sec, random_select_sec, mean_tdg_selected_impact_score, mean_random_selected_impact_score, mean_all_query_impact_score, tdg_node_count, tdg_edge_timeline_count, tdg_max_flow, tdg_max_congestion_ratio, tdg_mean_congestion_ratio".split(", "),
    "reroute_debug": "run_id, dataset, hop, rep, seed, query_count, selection_method, selection_fraction, random_seed, selected_count, lambda, reroute_method, impact_weight, total_before, total_after, tdg_prepare_sec, normalize_sec, reroute_sec, evaluate_after_sec, method_total_sec, mean_selected_impact_score, mean_all_query_impact_score, tdg_node_count, tdg_edge_timeline_count".split(", "),
    "simple_selection": "dataset, hop, rep, seed, query_count, selection_method, selection_fraction, random_seed, selected_count, total_before, unselected_after_remove, reduction, select_sec, evaluate_remaining_sec".split(", "),
    "slot_legacy": "run_id, dataset, hop, rep, seed, query_count, iteration, method, slot_width, tau, gamma, lambda, capacity_ignore, legacy_reroute_weight, random_fraction, random_seed, selected_count, candidate_count, source_node_count, tdg_node_count, total_before, total_after, reduction, initial_routes_sec, evaluate_before_sec, slot_tdg_sec, select_sec, reroute_sec, evaluate_after_sec, iteration_sec, cumulative_sec".split(", "),
    "iterations": "dataset, hop, rep, seed, algorithm, query_count, iteration, total_travel_time, initial_total_travel_time, final_total_travel_time".split(", "),
}
#: Types of columns whose names don't tell (fixed values); names and labels are text, shares and seconds doubles, parameters INT, counts and totals BIGINT.
TEXT = {"run_id", "dataset", "method", "algorithm", "parameters", "selection_method", "removal_mode", "reroute_method", "candidate_filter"}
SMALL = {"hop", "rep", "seed", "iteration", "gamma", "lambda", "theta_percentile", "anchor_window", "anchor_threshold", "impact_weight", "candidate_theta", "slot_width", "tau", "capacity_ignore", "legacy_reroute_weight", "selection_fraction"}


def kind_of(column: str, table: str) -> str:
    known = dict(ABLATION_COLUMNS)
    if column in known:
        return known[column]
    if column in TEXT:
        return "string"
    if column in SMALL:
        return "int"
    return "double" if column.endswith(("_sec", "_ratio", "_fraction", "_score")) or column.startswith(("avg_", "mean_")) or column == "anchor_score_max_sec" else "bigint"


def shaped(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with exactly the columns of a fact table, typed; columns that are not known yet are null."""
    return rows.select(*((F.col(f"`{c}`") if c in rows.columns else F.lit(None)).cast(kind_of(c, kind)).alias(c) for c in FACTS[kind]))


def log_lines(rows: DataFrame, event: str) -> DataFrame:
    """value: a line ``event key=value ...`` per row; columns that are null are left out."""
    pairs = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c in rows.columns]
    return rows.select(F.concat_ws(" ", F.lit(event), *pairs).alias("value"))


def write_facts(rows: DataFrame, kind: str, path: str, partition_by: list[str] | None = None, form: str = "csv") -> None:
    """Partitioned facts are clustered first, so that each partition is a few files, not one per task."""
    out = shaped(rows, kind)
    if partition_by:
        out = out.repartition(*partition_by)
    writer = out.write.mode("overwrite").format(form)
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_trips(trips: DataFrame, path: str) -> None:
    """``origin destination depart`` lines in order of departure; parts in order of their names."""
    trips.orderBy("depart", "origin", "destination").select(F.concat_ws(" ", "origin", "destination", "depart")).write.mode("overwrite").text(path)


def labelled(rows: DataFrame, column: str, label: str) -> DataFrame:
    return rows.select(F.lit(label).alias(column), *rows.columns)


def as_report(row: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def merged(spark, path: str) -> DataFrame:
    """The CSV files below a folder as one table, by column name."""
    from wayflow.sources import readers

    return readers.results(spark, [path])


def metadata(trips: DataFrame, keys: list[str], method: str, window_sec: int) -> DataFrame:
    """value: one JSON document per trip set: what it was made by, and its summary."""
    own = trip_summary(trips, keys).withColumns({"method": F.lit(method), "window_sec": F.lit(window_sec)})
    return as_json(own)


def trip_summary(trips: DataFrame, keys: list[str]) -> DataFrame:
    return trips.groupBy(*keys).agg(
        F.count("*").alias("query_count"), F.min("depart").alias("min_departure"), F.max("depart").alias("max_departure"),
        (F.max("depart") - F.min("depart")).alias("departure_span_sec"), F.countDistinct("origin", "destination").alias("unique_od_count"),
    )


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
