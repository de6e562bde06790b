"""Queries of the general data-processing problems (1 to 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflow.operators import delimited, nearby, tracks
from wayflow.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.rejected(table(spark, sf_dir, "raw_results"))


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.typed(table(spark, sf_dir, "raw_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def points(name: str, kind: str, key: str, lon: str, lat: str, metres: str, where: str = "true") -> DataFrame:
        return table(spark, sf_dir, name).where(where).selectExpr(f"'{kind}' as set", f"cast({key} as bigint) as id", f"{lon} as lon", f"{lat} as lat", f"cast({metres} as double) as r")

    left = points("snapped_points", "snapped", "point_id", "lon", "lat", "0").unionAll(
        points("query_candidates", "pickup", "candidate_id", "pickup_lon", "pickup_lat", "pickup_snap_m + 30", "pickup_snap_m between 0 and 500")
    )
    right = points("road_nodes", "node", "node", "lon", "lat", "0").distinct()
    right = right.unionAll(right.withColumns({"set": F.lit("node100"), "r": F.lit(100.0)})).unionAll(
        points("study_regions", "region", "region_id", "center_lon", "center_lat", "radius_km * 1000", "radius_km > 0").distinct()
    )
    # ids of points and candidates are unique; a node could stand at two places
    once = right.groupBy("set", "id").count().where("count > 1").isEmpty()
    found = nearby.dual_tree_join(left, right, [("snapped", "node100"), ("pickup", "node"), ("snapped", "region")], once)
    return found.select(F.col("lset").alias("src"), F.col("lid").alias("src_id"), F.regexp_replace("rset", "100", "").alias("kind"), F.col("rid").alias("ref_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.trips_and_stops(table(spark, sf_dir, "gps_points"))
    return found.selectExpr("taxi_id", "kind", "start_us div 1000000 as start_sec", "end_us div 1000000 as end_sec")


def p2_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.trips_and_stops(table(spark, sf_dir, "gps_points"))
    return found.selectExpr("taxi_id", "kind", "start_us div 1000000 as start_sec", "end_us div 1000000 as end_sec", "duration_sec", "round(metres, 1) as metres", "start_lon", "start_lat", "end_lon", "end_lat")


QUERIES = {"p1_found": p1_found, "p1_rows": p1_rows, "p2_found": p2_found, "p2_trips": p2_trips, "p3_found": p3_found}
SQL: dict[str, str] = {}

_FAR = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({c}) - radians({a})) / 2), 2))))"
_USABLE = "{0} between -180 and 180 and {1} between -90 and 90"
_METRES = lambda a, b, c, d: _FAR.format(a=a, b=b, c=c, d=d)

SQL["p3_found"] = f"""
with n as (select distinct node, lon, lat from road_nodes where {_USABLE.format("lon", "lat")}),
s as (select * from snapped_points where {_USABLE.format("lon", "lat")}),
q as (select * from query_candidates where {_USABLE.format("pickup_lon", "pickup_lat")} and pickup_snap_m between 0 and 500)
select distinct 'snapped' as src, s.point_id as src_id, 'node' as kind, cast(n.node as bigint) as ref_id from s, n
where abs(s.lat - n.lat) < 0.002 and {_METRES("s.lon", "s.lat", "n.lon", "n.lat")} <= 100
union all select distinct 'snapped', s.point_id, 'region', cast(g.region_id as bigint) from s, study_regions g
where g.radius_km > 0 and {_USABLE.format("g.center_lon", "g.center_lat")} and {_METRES("s.lon", "s.lat", "g.center_lon", "g.center_lat")} <= g.radius_km * 1000
union all select distinct 'pickup', q.candidate_id, 'node', cast(n.node as bigint) from q, n
where abs(q.pickup_lat - n.lat) < 0.006 and {_METRES("q.pickup_lon", "q.pickup_lat", "n.lon", "n.lat")} <= q.pickup_snap_m + 30"""

# Fields are cut by one pattern; a record of which the pattern does not cover everything has broken quoting.
_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_RESULTS = f"""
with h as (select file_name, min_by(ltrim(regexp_replace(line, '\\r$', ''), chr(65279)), line_id) as head from raw_results where line_no = 1 group by 1),
l as (select line_id, file_name, regexp_replace(line, '\\r$', '') as line from raw_results where line_no > 1),
j as (
  select line_id, line, regexp_matches(line, '^{_FIELD}(?:,{_FIELD})*$') as whole,
    list_transform(regexp_extract_all(',' || line, ',{_FIELD}', 1), lambda x: trim(case when x like '"%' then replace(substr(x, 2, greatest(length(x) - 2, 0)), '""', '"') else x end)) as f,
    list_transform(string_split(head, ','), lambda x: trim(x)) as n
  from l join h using (file_name) where trim(line) <> '' and line not like '#%' and line <> head
), v as (
  select line_id, f, n, whole, len(f) = len(n) as even, f[list_position(n, 'dataset')] as d, f[list_position(n, 'iteration')] as i, f[list_position(n, 'total_after')] as t from j
), b as (
  select line_id, f, n, case when not whole then 'quoting' when not even then 'column_count' else 'invalid_value' end as reason,
    case when not whole or not even then 'line'
      when not regexp_full_match(coalesce(d, ''), '(Hop[0-9]+Rep|BJRealRep|MHRealRep)[0-9]+-[0-9]+') then 'dataset'
      when not regexp_full_match(coalesce(i, ''), '0*[0-9]{{1,3}}') then 'iteration'
      when not regexp_full_match(coalesce(t, ''), '0*[0-9]{{1,19}}') or cast(t as hugeint) > 9223372036854775807 then 'total_after' end as bad_field from v
)"""
SQL["p1_found"] = _RESULTS + " select line_id, reason, bad_field from b where bad_field is not null"
# whole numbers are digits only here; the other engine's cast would take a point as well
_AS = {"string": "{0}", "double": "try_cast({0} as double)", "int": "case when regexp_full_match({0}, '[-+]?[0-9]+') then try_cast({0} as int) end", "bigint": "case when regexp_full_match({0}, '[-+]?[0-9]+') then try_cast({0} as bigint) end"}
SQL["p1_rows"] = _RESULTS + " select line_id, " + ", ".join(_AS[t].format(f"f[list_position(n, '{c}')]") + f" as {c}" for c, t in delimited.ABLATION_COLUMNS) + " from b where bad_field is null"

_GAP, _STAY = 1_800_000_000, 300_000_000
_HOP = lambda k: f"{_FAR.format(a='lon', b='lat', c=f'lead(lon, {k}) over w', d=f'lead(lat, {k}) over w')} * 3.6 > 250 * ((lead(t, {k}) over w) - t) / 1e6"
SQL["p2_found"] = f"""
with recursive u as (
  select distinct upper(regexp_replace(taxi_id, '^\\s+|\\s+$', '', 'g')) as taxi, epoch_us(timestamp) as t, lon, lat from gps_points
  where trim(taxi_id) <> '' and timestamp is not null and lon between 115 and 118 and lat between 38.5 and 41.5
), f as (
  select *, {_HOP(1)} as f1, {_HOP(2)} as f2, {_HOP(3)} as f3 from u window w as (partition by taxi order by t, lon, lat)
), d as (
  select *, coalesce(lag(f1) over w and f1 and not lag(f2) over w, false) or coalesce(lag(f1) over w and lead(f1) over w and not lag(f3) over w, false)
    or coalesce(lag(f1, 2) over w and f1 and not lag(f3, 2) over w, false) as stray from f window w as (partition by taxi order by t, lon, lat)
), p as (
  select taxi, t, lon, lat, row_number() over w as i, coalesce(t - lag(t) over w > {_GAP}, false) as gap from d where not stray window w as (partition by taxi order by t, lon, lat)
), q as (
  select *, sum(case when gap then 1 else 0 end) over (partition by taxi order by i) as part, max(i) over (partition by taxi) as n from p
), b as (
  select a.taxi, a.i, any_value(a.t) as t, coalesce(min(c.i), any_value(a.n) + 1) - 1 as e from q a
  left join q c on a.taxi = c.taxi and c.i > a.i and (c.part > a.part or {_FAR.format(a='a.lon', b='a.lat', c='c.lon', d='c.lat')} > 100) group by 1, 2
), k as (
  select b.taxi, b.i, b.e, b.t as t0, q.t as t1, b.i as start from b join q on b.taxi = q.taxi and b.e = q.i where q.t - b.t >= {_STAY}
), n as (
  select k.*, m.start as following from k asof left join (select taxi, start from k) m on k.taxi = m.taxi and k.e < m.start
), s as (
  select taxi, min(i) as i from k group by 1 union all select n.taxi, n.following from s join n using (taxi, i) where n.following is not null
), h as (
  select n.taxi, n.t0, n.t1, n.e, lead(n.i) over (partition by n.taxi order by n.i) as ni, lead(n.t0) over (partition by n.taxi order by n.i) as nt from s join n using (taxi, i)
)
select taxi as taxi_id, 'stop' as kind, t0 // 1000000 as start_sec, t1 // 1000000 as end_sec from h
union all select h.taxi, 'trip', t1 // 1000000, nt // 1000000 from h join q a on a.taxi = h.taxi and a.i = h.e join q c on c.taxi = h.taxi and c.i = h.ni where a.part = c.part"""
