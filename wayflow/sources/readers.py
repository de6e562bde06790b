"""Readers of the text formats: parameter files, road graphs, coordinates, trips, location pings, taxi trips, result tables, logs."""

from __future__ import annotations

import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayflow.functions import scalar


def parameters(path: str) -> dict[str, str]:
    """``key: value`` lines, ``#`` comments, the last of equal keys; a line without a colon is an error."""
    out = {}
    for line in Path(path).read_text().splitlines():
        line = line.split("#")[0].strip()
        if line:
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no colon in {line!r}")
            out[key.strip()] = value.strip()
    return out


def inputs(path: str) -> dict[str, str]:
    """Paths of graph, coordinates and trips, relative ones taken from the file's folder."""
    own = parameters(path)
    if not own.get("graph_path"):
        raise ValueError("graph_path is missing")
    keys = ("graph_path", "coordinates_path", "queries_path")
    return {k: str(Path(path).parent / own[k]) for k in keys if own.get(k)}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, in file order), value.

    Lines are numbered within their block of the file and the blocks by their place in it, so nothing is sorted in one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    sizes = raw.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    sizes = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(F.broadcast(sizes), ["f", "b"]).select((F.col("first") + F.col("m") - F.col("m0")).alias("line_no"), "value")


def _ints(value: Column) -> Column:
    """The whole numbers a line begins with."""
    head = F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")
    return F.transform(head, lambda x: F.regexp_extract(x, r"^-?\d+", 0).try_cast("bigint"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(edges, number of nodes). Three dialects, told apart by the first line:

    ``% V E`` then ``from to metres`` (free flow at 60 km/h, a vehicle per 40 m, both rounded and at least 1; a node more than stated);
    a line with a negative first and at least five numbers, then ``id from to seconds capacity`` with the id ignored; else ``from to seconds`` with
    capacity seconds div 40, at least 1. Lines with fewer numbers are no edges. Edge ids follow the file.
    """
    lines = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("n", _ints(F.regexp_replace("value", "^\\s*%", "")))
    first = lines.orderBy("line_no").limit(1).select("value", "n").collect()
    if not first:
        return spark.createDataFrame([], "edge_id int, src int, dst int, fft bigint, cap int"), 0
    head, numbers = first[0].value.strip(), [x for x in first[0].n if x is not None]
    if head.startswith("%"):
        kind, stated = "metres", numbers[0] + 1
    elif numbers and numbers[0] < 0 and len(numbers) >= 5:
        kind, stated = "full", abs(numbers[1]) if len(numbers) > 1 else 0
    else:
        kind, stated = "bare", 0
    rows = lines.where(~F.trim("value").startswith("%"))
    if kind == "full":
        rows = rows.where((F.size("n") >= 5) & (F.get("n", F.lit(0)) >= 0))
        own = rows.select("line_no", F.col("n")[1].alias("src"), F.col("n")[2].alias("dst"), F.col("n")[3].alias("fft"), F.col("n")[4].alias("cap"))
    else:
        rows = rows.where((F.size("n") >= 3) & F.col("n")[2].isNotNull())
        third = F.col("n")[2]
        fft = F.greatest(F.lit(1), F.floor(third / 60000 * 3600 + 0.5)) if kind == "metres" else third
        cap = F.greatest(F.lit(1), F.floor(third / 40 + 0.5)) if kind == "metres" else F.greatest(F.lit(1), F.expr("n[2] div 40"))
        own = rows.select("line_no", F.col("n")[0].alias("src"), F.col("n")[1].alias("dst"), fft.cast("bigint").alias("fft"), cap.alias("cap"))
    edges = dense(own, "line_no", "edge_id").select(F.col("edge_id").cast("int").alias("edge_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("fft").cast("bigint").alias("fft"), F.col("cap").cast("int").alias("cap"))
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return edges, max(stated, (top if top is not None else -1) + 1)


def dense(rows: DataFrame, order: str, out: str, width: int = 1_000_000) -> DataFrame:
    """Numbers from 0 in the given order, by counting ranges of it."""
    rows = rows.withColumn("_b", F.floor(F.col(order) / width))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_f", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return rows.withColumn("_i", own).join(F.broadcast(sizes), "_b").withColumn(out, F.col("_f") + F.col("_i")).drop("_b", "_i", "_f")


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """node, lon, lat; the last line of a node counts."""
    lines = numbered_lines(spark, path).withColumn("p", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).where("size(p) >= 3")
    rows = lines.select("line_no", F.col("p")[0].try_cast("int").alias("node"), scalar.finite(F.col("p")[1]).alias("lon"), scalar.finite(F.col("p")[2]).alias("lat")).dropna()
    return rows.groupBy("node").agg(F.max_by(F.struct("lon", "lat"), "line_no").alias("c")).select("node", "c.lon", "c.lat")


def trips(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """trip_id (place among the valid lines), origin, destination, depart. strict: any other number of columns than three is an error."""
    lines = numbered_lines(spark, path).where("trim(value) <> '' and not startswith(trim(value), '#')").withColumn("n", _ints(F.col("value")))
    good = (F.size("n") >= 3) & F.get("n", F.lit(0)).isNotNull() & F.get("n", F.lit(1)).isNotNull() & F.get("n", F.lit(2)).isNotNull()
    if strict:
        good &= F.assert_true(F.size("n") == 3, "a trip has three columns").isNull()
    own = dense(lines.where(good), "line_no", "trip_id")
    return own.select(F.col("trip_id").cast("int").alias("trip_id"), *(F.col("n")[i].cast(t).alias(c) for i, (c, t) in enumerate((("origin", "int"), ("destination", "int"), ("depart", "bigint")))))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Coarse candidates (six columns and more, with or without a header) with ``od``, dense by first appearance of the pair."""
    lines = numbered_lines(spark, path).withColumn("p", F.split("value", ",")).where("size(p) >= 6")
    names = ("origin", "destination", "departure_abs_seconds", "taxi_id", "duration_seconds", "haversine_km")
    kinds = ("int", "int", "bigint", "string", "int", "double")
    rows = lines.select("line_no", *(F.trim(F.col("p")[i]).try_cast(t).alias(c) for i, (c, t) in enumerate(zip(names, kinds, strict=True)))).where("origin is not null and destination is not null")
    return od_dictionary(rows, "line_no")


def od_dictionary(rows: DataFrame, order: str) -> DataFrame:
    first = rows.groupBy("origin", "destination").agg(F.min(order).alias("_first"))
    return rows.join(dense(first, "_first", "od").drop("_first"), ["origin", "destination"])


def datasets(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, dataset, hop, rep, seed of the files whose names follow the scheme, in order of (hop, rep, seed)."""
    name = F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    rows = paths.select(path, name.alias("dataset")).withColumn("p", scalar.dataset_parts("dataset")).where("p is not null")
    return rows.select(path, "dataset", "p.*").orderBy("hop", "rep", "seed")


def dataset_names(text: str) -> list[str]:
    """A comma list, or a file of one name per line with ``#`` comments."""
    raw = Path(text).read_text().splitlines() if Path(text).is_file() else text.split(",")
    return [x for x in (line.split("#")[0].strip() for line in raw) if x]


def unpacked(path: str, to: str) -> str:
    """A ZIP is unpacked into a folder all executors see, since readers take no ZIP; other paths stay."""
    if not path.endswith(".zip"):
        return path
    with zipfile.ZipFile(path) as z:
        z.extractall(to)
    return to


def pings(lines: DataFrame) -> DataFrame:
    """taxi_id, timestamp, lon, lat from ``value`` and ``file``: commas or blanks, four or five fields, the file's name where the taxi is missing; bad lines are left out."""
    text = F.trim("value")
    comma = F.split(text, r"\s*,\s*")
    blank = F.split(text, r"\s+")
    # blank-separated lines have date and time as two fields
    joined = F.when(F.size(blank) >= 5, F.array(blank[0], F.concat_ws(" ", blank[1], blank[2]), F.get(blank, F.lit(3)), F.get(blank, F.lit(4)))).otherwise(F.array(F.lit(""), F.concat_ws(" ", blank[0], F.get(blank, F.lit(1))), F.get(blank, F.lit(2)), F.get(blank, F.lit(3))))
    parts = F.when(text.contains(","), F.when(F.size(comma) >= 4, comma).otherwise(F.concat(F.array(F.lit("")), comma))).otherwise(joined)
    stem = F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    rows = lines.select(F.coalesce(F.nullif(F.get(parts, F.lit(0)), F.lit("")), stem).alias("taxi_id"), scalar.parsed_time(F.get(parts, F.lit(1))).alias("timestamp"), scalar.finite(F.get(parts, F.lit(2))).alias("lon"), scalar.finite(F.get(parts, F.lit(3))).alias("lat"))
    return rows.where("timestamp is not null and lon is not null and lat is not null")


#: Names a column goes by, compared without case and punctuation (fixed values).
ALIASES = {
    "pickup_time": ("pickup_datetime", "tpep_pickup_datetime", "trip_pickup_datetime", "trip_pickup_date_time", "lpep_pickup_datetime", "pickup_time"),
    "dropoff_time": ("dropoff_datetime", "tpep_dropoff_datetime", "trip_dropoff_datetime", "trip_dropoff_date_time", "lpep_dropoff_datetime", "dropoff_time"),
    "pickup_lon": ("pickup_longitude", "start_lon", "pickup_lon", "pu_longitude"),
    "pickup_lat": ("pickup_latitude", "start_lat", "pickup_lat", "pu_latitude"),
    "dropoff_lon": ("dropoff_longitude", "drop_off_longitude", "end_lon", "dropoff_lon", "do_longitude"),
    "dropoff_lat": ("dropoff_latitude", "drop_off_latitude", "end_lat", "dropoff_lat", "do_latitude"),
    "trip_distance": ("trip_distance", "trip_distance_miles", "distance"),
}
#: Places of those columns in files of 17 columns without header.
HEADERLESS = {"pickup_time": 2, "dropoff_time": 3, "trip_distance": 5, "pickup_lon": 6, "pickup_lat": 7, "dropoff_lon": 8, "dropoff_lat": 9}


def taxi_trips(raw: DataFrame) -> DataFrame:
    """Trips with the columns of ALIASES from a table of text with headers, or with 17 columns ``_c0``.. without. Files that only name zones are refused."""
    names = {scalar.column_name(c): c for c in raw.columns}
    if raw.columns[:1] == ["_c0"]:
        place = {k: f"_c{i}" for k, i in HEADERLESS.items()}
    else:
        place = {k: next((names[a] for a in map(scalar.column_name, own) if a in names), None) for k, own in ALIASES.items()}
    lost = [k for k, v in place.items() if v is None and k != "trip_distance"]
    if lost:
        raise ValueError(f"columns not found: {', '.join(lost)}")
    time = [scalar.parsed_time(F.col(f"`{place[k]}`")).alias(k) for k in ("pickup_time", "dropoff_time")]
    rest = [(scalar.finite(F.col(f"`{place[k]}`")) if place[k] else F.lit(None).cast("double")).alias(k) for k in list(ALIASES)[2:]]
    return raw.select(*time, *rest)


def usable_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with a way in and a way out, loops aside."""
    own = edges.where("src <> dst")
    return own.select(F.col("src").alias("node")).distinct().join(own.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")


def road_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes, with a length."""
    known = nodes.select("node")
    ok = edges.where("fft > 0 and src >= 0 and dst >= 0")
    return ok.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")


def results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result tables with headers, by column name, with ``source_file``. Files that share their header are one scan, however many they are."""
    first = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    heads = first.where("at = 0").groupBy("path").agg(F.min_by("value", "m").alias("head")).groupBy("head").agg(F.collect_list("path").alias("paths"))
    parts = [spark.read.csv(r.paths, header=True).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)) for r in heads.orderBy("head").collect()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tolerant_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Torn rows are left out, as are rows whose dataset does not follow the scheme."""
    fields = StructType.fromDDL(schema).fields
    text = ", ".join([*(f"`{f.name}` string" for f in fields), "_torn string"])
    rows = spark.read.csv(path, header=True, schema=text, columnNameOfCorruptRecord="_torn")
    # every column is looked at, whichever of them are asked for later
    sound = reduce(lambda x, y: x & y, (F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull() for f in fields), F.col("_torn").isNull())
    typed = rows.where(sound).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields))
    return typed.where(scalar.dataset_parts("dataset").isNotNull())


def log_metrics(lines: DataFrame) -> DataFrame:
    """source, iteration, metric, value of ``key=value`` pairs of log lines (source, value); the last of equal keys."""
    pairs = F.regexp_extract_all("value", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=(\S+)"), F.lit(0))
    rows = lines.select("source", F.posexplode(pairs).alias("place", "pair"), "value")
    iteration = F.regexp_extract("value", r"\biteration=(\d+)", 1).try_cast("int")
    split = rows.select("source", iteration.alias("iteration"), F.split_part("pair", F.lit("="), F.lit(1)).alias("metric"), F.substring_index("pair", "=", -1).try_cast("double").alias("number"), "place")
    return split.where("metric <> 'iteration' and number is not null").groupBy("source", "iteration", "metric").agg(F.max_by("number", "place").alias("value"))
