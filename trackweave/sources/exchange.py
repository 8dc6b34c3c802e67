"""Exchange formats: GeoJSON lines, airspace layers as JSON, templated raw messages, files of one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import TIME

#: Files that only pandas can write go through the driver: larger tables are refused.
DRIVER_ROWS = 1_000_000

#: One airspace: layers with levels (null: unbounded) and a GeoJSON polygon.
AIRSPACE = "name string, type string, shapes array<struct<upper: double, lower: double, polygon: struct<type: string, coordinates: array<array<array<double>>>>>>"

#: Hex characters before the message of a long record: its marks and receiver clock.
LONG_HEADER = 18


def line_string(df: DataFrame, by: list[str]) -> DataFrame:
    """geojson of each flight: a LineString of its known positions in time; one position makes no line."""
    tie = [c for c in ("event_id",) if c in df.columns]
    known = df.filter("longitude is not null and latitude is not null")
    at = F.array_sort(F.collect_list(F.struct(TIME, *tie, "longitude", "latitude")))
    pairs = F.transform("_at", lambda p: F.array(p["longitude"], p["latitude"]))
    lines = known.groupBy(*by).agg(at.alias("_at")).filter(F.size("_at") > 1)
    return lines.select(*by, F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates"))).alias("geojson"))


def airspace_to_json(layers: DataFrame) -> DataFrame:
    """name, type and json from one row per layer: name, type, lower, upper, ring (array of struct x, y)."""
    corners = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(corners, F.slice(corners, 1, 1))).alias("coordinates"))
    shapes = F.array_sort(F.collect_list(F.struct("upper", "lower", polygon.alias("polygon"))))
    made = layers.groupBy("name", "type").agg(shapes.alias("shapes"))
    return made.select("name", "type", F.to_json(F.struct("name", "type", "shapes")).alias("json"))


def airspace_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """One row per layer of each airspace: name, type, lower, upper, ring without its closing corner."""
    each = df.select(F.from_json(column, AIRSPACE).alias("a")).select("a.name", "a.type", F.explode("a.shapes").alias("s"))
    outer = F.col("s.polygon.coordinates")[0]
    ring = F.transform(F.slice(outer, 1, F.size(outer) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return each.select("name", "type", "s.lower", "s.upper", ring.alias("ring"))


def raw_messages(df: DataFrame, template: str = "time, longmsg", sep: str = ",", column: str = "value") -> DataFrame:
    """mintime and rawmsg of templated text lines; longmsg loses its header, shortmsg is taken whole."""
    names = [n.strip() for n in template.split(sep)]
    message = next((n for n in names if n in ("longmsg", "shortmsg")), None)
    if "time" not in names or message is None:
        raise ValueError("the template needs time and longmsg or shortmsg")
    parts = F.split(F.col(column), f"\\Q{sep}\\E")

    def part(name: str) -> Column:
        return F.trim(F.get(parts, names.index(name)))

    raw = part(message)
    return df.select(part("time").try_cast("double").alias("mintime"), (F.substr(raw, F.lit(LONG_HEADER + 1)) if message == "longmsg" else raw).alias("rawmsg")).filter("mintime is not null and rawmsg <> ''")


def write_local(df: DataFrame, path: str, rows: int = DRIVER_ROWS, **options) -> None:
    """pickle, feather, excel or hdf by suffix, for tables of at most ``rows`` rows; others raise ValueError."""
    kind = path.rpartition(".")[2].lower()
    writers = {"pkl": "to_pickle", "pickle": "to_pickle", "feather": "to_feather", "xlsx": "to_excel", "h5": "to_hdf"}
    if kind not in writers:
        raise ValueError(f"no writer for {path!r}")
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows; write parquet")
    getattr(df.toPandas(), writers[kind])(path, **options)
