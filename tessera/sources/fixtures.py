"""Spatial tables derived from the driver's relational ones, for Spark and as DuckDB SQL.

The same text defines both, apart from array indexing (0- and 1-based) and
the clock function, so that coordinates agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.vectors import AXES


def _element(i, sql: bool) -> str:
    return f"cast(embedding[{i}{' + 1' if sql else ''}] as double)"


def _triangle_columns(sql: bool, spread: str = "25e-2") -> dict[str, str]:
    e = lambda i: _element(f"9 * k + {i}", sql)
    out = {"tri_id": "vec_id * 7 + k"}
    for i, c in enumerate(AXES):
        out[f"a{c}"] = e(i)
    for j, p in ((3, "vb"), (6, "c")):
        for i, c in enumerate(AXES):
            out[f"{p}{c}"] = f"{e(i)} + {spread} * {e(i + j)}"
    return out


def _ray_columns(sql: bool) -> dict[str, str]:
    return {"ray_id": "vec_id"} | {f"o{c}": f"10e0 * {_element(i, sql)}" for i, c in enumerate(AXES)} | {f"d{c}": f"-{_element(i, sql)}" for i, c in enumerate(AXES)}


def _event_ray_columns(sql: bool) -> dict[str, str]:
    """Rays through the events' space, from its floor upwards."""
    e = lambda i: _element(i, sql)
    return {"ray_id": "vec_id", "ox": f"50e0 + 200e0 * {e(0)}", "oy": f"50e0 + 200e0 * {e(1)}", "oz": "0e0", "dx": e(3), "dy": e(4), "dz": "1e0"}


def _query_columns(sql: bool) -> dict[str, str]:
    return {"query_id": "vec_id"} | {f"p{c}": f"2e0 * {_element(60 + i, sql)}" for i, c in enumerate(AXES)}


def _sphere_columns(sql: bool) -> dict[str, str]:
    return {"sphere_id": "vec_id"} | {f"p{c}": _element(54 + i, sql) for i, c in enumerate(AXES)} | {"r": f"2e-1 * abs({_element(63, sql)}) + 2e-2"}


def _box_columns(sql: bool) -> dict[str, str]:
    mid = [_element(57 + i, sql) for i in range(3)]
    half = [f"(1e-2 + 2e-1 * abs({_element(60 + i, sql)}))" for i in range(3)]
    return {"box_id": "vec_id"} | {f"min{c}": f"{m} - {h}" for c, m, h in zip(AXES, mid, half)} | {f"max{c}": f"{m} + {h}" for c, m, h in zip(AXES, mid, half)}


HOURS_SPARK = "cast(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast({t} as timestamp_ntz)) as double) / 36e8"
HOURS_SQL = "cast(epoch_us({t}) - 1704067200000000 as double) / 36e8"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} as {k}" for k, v in columns.items())


TRIANGLES = f"select {_select(_triangle_columns(True))} from embeddings, (select unnest(range(7)) as k) as ks"
RAYS = f"select {_select(_ray_columns(True))} from embeddings"
EVENT_RAYS = f"select {_select(_event_ray_columns(True))} from embeddings"
QUERY_POINTS = f"select {_select(_query_columns(True))} from embeddings"
SPHERES = f"select {_select(_sphere_columns(True))} from embeddings"
BOXES = f"select {_select(_box_columns(True))} from embeddings"
POINTS = f"select event_id as point_id, cast(user_id as double) as px, value as py, {HOURS_SQL.format(t='ts')} as pz from events"
_LEAD = ", ".join(f"lead(p{c}) over w as n{c}" for c in AXES)
_FIRST = ", ".join(f"first_value(p{c}) over (partition by user_id order by ts, point_id) as f{c}" for c in AXES)
_TIMED = POINTS.replace("select event_id", "select user_id, ts, event_id")
SEGMENTS = f"select point_id as seg_id, px as x0, py as y0, pz as z0, nx as x1, ny as y1, nz as z1 from (select *, {_LEAD} from ({_TIMED}) as p window w as (partition by user_id order by ts, point_id)) as s where nx is not null"
LOOP = f"select point_id as seg_id, px as x0, py as y0, pz as z0, coalesce(nx, fx) as x1, coalesce(ny, fy) as y1, coalesce(nz, fz) as z1 from (select *, {_LEAD}, {_FIRST}, count(*) over (partition by user_id) as n from ({_TIMED}) as p window w as (partition by user_id order by ts, point_id)) as s where n > 2"
_DAYS = HOURS_SQL.format(t="o_orderdate")
_DIGIT = "cast(substring(o_orderpriority, 1, 1) as double)"
OBJECTS = f"select o_custkey as object_id, min(o_totalprice) as minx, min({_DAYS}) as miny, min({_DIGIT}) as minz, max(o_totalprice) as maxx, max({_DAYS}) as maxy, max({_DIGIT}) as maxz from orders group by o_custkey"
AABBS = "select tri_id as box_id, " + ", ".join(f"{f}(a{c}, vb{c}, c{c}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in AXES) + f" from ({TRIANGLES}) as t"


def _embeddings(spark: SparkSession, sf_dir: str, columns: dict[str, str], each: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if each:
        df = df.selectExpr("vec_id", "embedding", each)
    return df.selectExpr(*(f"{v} as {k}" for k, v in columns.items()))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, _triangle_columns(False), "explode(sequence(0, 6)) as k")


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, _ray_columns(False))


def event_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, _event_ray_columns(False))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, _query_columns(False))


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, _sphere_columns(False))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, _box_columns(False))


def points(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    own = ["user_id", "ts"] if keyed else []
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*own, "event_id as point_id", "cast(user_id as double) as px", "value as py", f"{HOURS_SPARK.format(t='ts')} as pz")


def polyline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points named x, y, z with their user and order, for segments."""
    return points(spark, sf_dir, keyed=True).selectExpr("user_id", "ts", "point_id", "point_id as seg_id", "px as x", "py as y", "pz as z")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = orders.selectExpr("o_custkey as object_id", "o_totalprice as x", f"{HOURS_SPARK.format(t='o_orderdate')} as y", f"{_DIGIT} as z")
    return at.groupBy("object_id").agg(*_extremes())


def _extremes():
    from pyspark.sql import functions as F

    return [f(c).alias(f"{n}{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES]


def aabbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [f"{f}(a{c}, vb{c}, c{c}) as {n}{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in AXES]
    return triangles(spark, sf_dir).selectExpr("tri_id as box_id", *own)
