"""The collection facade: method chains over DataFrame operators."""

from __future__ import annotations

import ast

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schema
from .operators import aggregates, clip, detectors, grouped, holding, intervals, joins, keys, ml, references, resample, segments, sets, slicing, windows
from .pieces import Segments


class Trajectories:
    """An immutable collection of flights over a DataFrame; ``df`` is the way out.

    Operators that work per flight take the flight key themselves: flight_id,
    or icao24 and callsign cut at gaps.
    """

    def __init__(self, df: DataFrame, by: list[str] | None = None):
        self.df, self.by = df, by or keys.flight_key(df)

    def _on(self, df: DataFrame) -> Trajectories:
        return Trajectories(df, self.by)

    @classmethod
    def from_file(cls, spark, path: str, **options) -> Trajectories:
        from .sources.files import read

        return cls(schema.normalise(read(spark, path, **options)))

    def iterate(self, gap="10 min") -> Trajectories:
        return Trajectories(keys.iterate(self.df, gap), ["flight_id"])

    def assign_id(self, gap="10 min") -> Trajectories:
        return self.iterate(gap)

    # Filters and columns
    def query(self, condition: str | Column) -> Trajectories:
        return self._on(self.df.filter(condition))

    def assign(self, **columns) -> Trajectories:
        return self._on(self.df.withColumns({k: v(self.df) if callable(v) else v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}))

    def drop(self, *columns) -> Trajectories:
        return self._on(self.df.drop(*columns))

    def rename(self, **columns) -> Trajectories:
        return self._on(self.df.withColumnsRenamed(columns))

    def fillna(self, value, subset=None) -> Trajectories:
        return self._on(self.df.na.fill(value, subset))

    def replace(self, old, new=None, subset=None) -> Trajectories:
        return self._on(self.df.na.replace(old, new, subset))

    def sort_values(self, *by) -> Trajectories:
        return self._on(self.df.orderBy(*by))

    def drop_duplicates(self, subset: list[str], order: list[str] | None = None) -> Trajectories:
        return self._on(sets.drop_duplicates(self.df, subset, order) if order else self.df.dropDuplicates(subset))

    def merge(self, other: DataFrame, on, how: str = "inner") -> Trajectories:
        return self._on(self.df.join(other, on, how))

    def groupby(self, *by):
        return self.df.groupBy(*by)

    def pipe(self, func, *args, **kwargs):
        """A callable on this collection, or a method call as text with literal arguments."""
        if callable(func):
            return func(self, *args, **kwargs)
        node = ast.parse(func, mode="eval").body
        if isinstance(node, ast.Name):
            return getattr(self, node.id)(*args, **kwargs)
        if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name) or node.func.id.startswith("_"):
            raise ValueError(f"not a method call: {func!r}")
        return getattr(self, node.func.id)(*map(ast.literal_eval, node.args), **{k.arg: ast.literal_eval(k.value) for k in node.keywords})

    # Set algebra
    def __add__(self, other: Trajectories | int) -> Trajectories:
        return self if other == 0 else self._on(sets.union(self.df, other.df))

    __radd__ = __add__

    def __and__(self, other: Trajectories) -> Trajectories:
        return self._on(sets.intersect(self.df, other.df, self.by))

    def __sub__(self, other: Trajectories | list) -> Trajectories:
        return self._on(sets.minus_ids(self.df, self.by[0], other) if isinstance(other, list) else sets.minus(self.df, other.df, self.by))

    def __xor__(self, other: Trajectories) -> Trajectories:
        return self._on(sets.symmetric(self.df, other.df, self.by))

    def __getitem__(self, key):
        """Flights of one id, of a list of ids, or of an index frame (DataFrame with start and stop)."""
        if isinstance(key, DataFrame):
            return self._on(joins.index_by(self.df, key, [c for c in self.by if c in key.columns]))
        ids = key if isinstance(key, (list, tuple, set)) else [key]
        names = [c for c in ("flight_id", "callsign", "icao24") if c in self.df.columns]
        test = F.lit(False)
        for c in names:
            test = test | F.col(c).isin(list(ids))
        return self._on(self.df.filter(test))

    def sample(self, size: int, seed: int = 0) -> Trajectories:
        return self._on(sets.sample(self.df, self.by, size, seed))

    # Aggregates
    def summary(self, *attributes: str) -> DataFrame:
        return aggregates.summary(self.df, self.by, *attributes)

    def basic_stats(self) -> DataFrame:
        return aggregates.basic_stats(self.df, self.by)

    def filter(self, *steps, strategy: str | None = "fill", **kernels) -> Trajectories:
        """A noise filter by name ("default", "aggressive"), or steps of operators.windows one after the other, without filling."""
        if not steps or isinstance(steps[0], str):
            return self._on(windows.filtered(self.df, self.by, steps[0] if steps else "default", strategy, **kernels))
        return self._on(windows.compose(*steps)(self.df))

    # Segments
    def split(self, value="10 min", unit: str | None = None, condition=None) -> Segments:
        """Segments cut at gaps; a number without a unit counts minutes; condition as in operators.segments.split."""
        gap = f"{value} {unit or 'min'}" if isinstance(value, (int, float)) else value
        return Segments(self.df, segments.split(self.df, self.by, gap, condition), self.by)

    def segments(self, method, *args, **kwargs) -> Segments:
        """Segments found by a detector: its name, a method call as text, or a callable on this collection."""
        out = self.pipe(method, *args, **kwargs)
        if isinstance(out, Segments):
            return out
        segs = out.df if isinstance(out, Trajectories) else out
        if "seg_idx" not in segs.columns:
            segs = segs.withColumn("seg_idx", (F.row_number().over(Window.partitionBy(*self.by).orderBy("start", "stop")) - 1).cast("long"))
        return Segments(self.df, segs, self.by)

    def next(self, method, *args, **kwargs) -> Trajectories:
        return self.segments(method, *args, **kwargs).next().all()

    def final(self, method, *args, **kwargs) -> Trajectories:
        return self.segments(method, *args, **kwargs).final().all()

    def all(self, method, *args, flight_id: str | None = None, **kwargs) -> Trajectories:
        return self.segments(method, *args, **kwargs).all(flight_id)

    def sum(self, method, *args, **kwargs) -> DataFrame:
        return self.segments(method, *args, **kwargs).sum()

    def has(self, method, *args, **kwargs) -> Trajectories:
        return self.segments(method, *args, **kwargs).has()

    def max_split(self, value="10 min", unit: str | None = None, key="duration") -> Trajectories:
        return self.split(value, unit).max(key).all()

    def apply_segments(self, func, method, *args, **kwargs):
        """func on the segments of a detector, as flights of their own."""
        return self.segments(method, *args, **kwargs).map(func)

    def sliding_windows(self, duration, step) -> Trajectories:
        return Trajectories(grouped.sliding_windows(self.df, self.by, duration, step), [*self.by, "window"])

    # Methods by name
    def _method(self, kind: str, method: str, *args, **kwargs):
        table = METHODS[kind]
        if method not in table:
            raise ValueError(f"{kind} knows {sorted(table)}, not {method!r}")
        out = table[method](self.df, *args, by=self.by, **kwargs)
        if kind in ROWS:
            return self._on(out)
        if not {"start", "stop"} <= set(out.columns):
            return out
        if "seg_idx" not in out.columns:
            out = out.withColumn("seg_idx", (F.row_number().over(Window.partitionBy(*self.by).orderBy("start")) - 1).cast("long"))
        return Segments(self.df, out, self.by)

    def aligned(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("aligned", method, *args, **kwargs)

    def landing(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("landing", method, *args, **kwargs)

    def takeoff(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("takeoff", method, *args, **kwargs)

    # Older names of the same.
    def aligned_on_ils(self, *args, **kwargs) -> Segments:
        return self.aligned(*args, method="ils", **kwargs)

    def aligned_on_navpoint(self, *args, **kwargs) -> Segments:
        return self.aligned(*args, method="beacon", **kwargs)

    def aligned_on_runway(self, *args, **kwargs) -> Segments:
        return self.aligned(*args, method="runway", **kwargs)

    def takeoff_from_runway(self, *args, **kwargs) -> Segments:
        return self.takeoff(*args, method="polygon_based", **kwargs)

    def go_around(self, *args, method: str = "default", **kwargs) -> DataFrame:
        return self._method("go_around", method, *args, **kwargs)

    def holding_pattern(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("holding_pattern", method, *args, **kwargs)

    def point_merge(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("point_merge", method, *args, **kwargs)

    def thermals(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("thermals", method, *args, **kwargs)

    def movement(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("movement", method, *args, **kwargs)

    def pushback(self, *args, method: str = "default", **kwargs) -> DataFrame:
        return self._method("pushback", method, *args, **kwargs)

    def parking_position(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("parking_position", method, *args, **kwargs)

    def phases(self, *args, method: str = "default", **kwargs) -> Trajectories:
        return self._method("phases", method, *args, **kwargs)

    def fuelflow(self, *args, method: str = "default", **kwargs) -> Trajectories:
        return self._method("fuelflow", method, *args, **kwargs)

    def emission(self, *args, method: str = "default", **kwargs) -> Trajectories:
        return self._method("emission", method, *args, **kwargs)

    def predict(self, *args, method: str = "default", **kwargs) -> DataFrame:
        return self._method("predict", method, *args, **kwargs)

    forward = predict

    def infer_airport(self, *args, method: str = "landing", **kwargs) -> DataFrame:
        return self._method("infer_airport", method, *args, **kwargs)

    def infer_flightplan(self, *args, method: str = "default", **kwargs) -> Segments:
        return self._method("infer_flightplan", method, *args, **kwargs)

    def _at_airport(self, airport: str, airports: DataFrame, which: str) -> Trajectories:
        ok = self.infer_airport(airports, method=which).filter(F.col("airport") == airport)
        return self._on(self.df.join(ok, self.by, "left_semi"))

    def landing_at(self, airport: str, airports: DataFrame) -> Trajectories:
        """Flights whose last position is nearest to an airport."""
        return self._at_airport(airport, airports, "landing")

    def takeoff_from(self, airport: str, airports: DataFrame) -> Trajectories:
        """Flights whose first position is nearest to an airport."""
        return self._at_airport(airport, airports, "takeoff")

    # Shapes
    def distance_to_zone(self, zones: DataFrame, zone: str, name: str = "distance") -> Trajectories:
        """Adds the metres to the boundary of a zone, negative inside."""
        from .operators.clip import distance_to_zone

        return self._on(distance_to_zone(self.df, zones, zone, name))

    def clip(self, zones: DataFrame, strict: bool = True) -> Trajectories:
        """Rows from a flight's first entry into a polygon to its last exit there, as index_ and zone tell."""
        return Trajectories(clip.clip(self.df, zones, self.by, strict), [*self.by, "zone"])

    def clip_iterate(self, zones: DataFrame) -> Segments:
        """The times inside each polygon as segments, with zone."""
        return Segments(self.df, clip.crossings(self.df, zones, self.by), self.by)

    def intersects(self, zones: DataFrame) -> Trajectories:
        """Flights that pass through one of the polygons, between its levels."""
        return self._on(self.df.join(clip.intersects(self.df, zones, self.by), self.by, "left_semi"))

    # Learning and pairs
    def clustering(self, *cols: str, nb_samples: int = 15, method: str = "kmeans", scaler: str | None = "standard", **options) -> ml.Clustering:
        return ml.Clustering(self.by, cols, nb_samples, method, scaler, **options)

    def centroid(self, nb_samples: int, *cols: str) -> DataFrame:
        """The flight with the least mean distance to all, by its features."""
        return ml.centroid(ml.features(self.df, self.by, nb_samples, *cols), self.by[0])

    def generation(self, *cols: str, nb_samples: int = 15) -> ml.Generation:
        return ml.Generation.fit(ml.features(self.df, self.by, nb_samples, *cols))

    def closest_point_of_approach(self, lateral_separation: float, vertical_separation: float, round_t="1 d") -> DataFrame:
        return joins.closest_approach(self.df, lateral_separation, vertical_separation, round_t, self.by[0])

    # Facts about the whole
    def _fact(self, value):
        return self.df.agg(value).first()[0]

    @property
    def start_time(self):
        return self._fact(F.min(keys.TIME))

    @property
    def end_time(self):
        return self._fact(F.max(keys.TIME))

    @property
    def callsigns(self) -> DataFrame:
        return self.df.select("callsign").filter("callsign is not null").distinct()

    @property
    def icao24(self) -> DataFrame:
        return self.df.select("icao24").filter("icao24 is not null").distinct()

    @property
    def flight_ids(self) -> DataFrame:
        return self.df.select("flight_id").filter("flight_id is not null").distinct()

    def __len__(self) -> int:
        """Number of flights."""
        return self.df.select(*self.by).distinct().count()

    def head(self, n: int = 5) -> DataFrame:
        """n rows, the first in time (a report)."""
        return self.df.orderBy(keys.TIME, *self.by).limit(n)

    def tail(self, n: int = 5) -> DataFrame:
        return self.df.orderBy(F.desc(keys.TIME), *self.by).limit(n)

    def guarded(self, func, schema=None) -> tuple[Trajectories, DataFrame]:
        """The flights that func(pandas rows) gives, and a table of those whose func raised."""
        from .operators.faults import guarded

        good, bad = guarded(self.df, self.by, func, schema)
        return self._on(good), bad

    # Plans are lazy as they are; these end them.
    def iterate_lazy(self, iterate_kw: dict | None = None) -> Trajectories:
        return self.iterate(**(iterate_kw or {}))

    def eval(self, cache_file: str | None = None) -> Trajectories:
        """Runs the plan once: written to ``cache_file`` (read back if it is there) or to the folder that executors share."""
        from .operators.scratch import materialize

        if cache_file is None:
            return self._on(materialize(self.df))
        spark = self.df.sparkSession
        try:
            return self._on(spark.read.parquet(cache_file))
        except AnalysisException:
            self.df.write.parquet(cache_file)
            return self._on(spark.read.schema(self.df.schema).parquet(cache_file))

    def kept(self, folder: str, version: str | None = None, max_age: float | None = None) -> Trajectories:
        """The collection as it was written for the same plan and files, else written now; see operators.kept."""
        from .operators.kept import kept

        return self._on(kept(self.df, folder, version, max_age))

    def to_parquet(self, path: str, **options) -> None:
        self.df.write.parquet(path, **options)

    def to_csv(self, path: str, **options) -> None:
        self.df.write.csv(path, header=True, **options)

    def to_json(self, path: str, **options) -> None:
        self.df.write.json(path, **options)

    def to_local(self, path: str, **options) -> None:
        """pickle, feather, excel or hdf by suffix, through the driver (row count checked)."""
        from .sources.exchange import write_local

        write_local(self.df, path, **options)

    def geojson(self) -> DataFrame:
        from .sources.exchange import line_string

        return line_string(self.df, self.by)

    def __getattr__(self, name: str):
        """Operators on (df, .., by=..) as methods; results with the same rows stay collections."""
        if name.startswith("_"):
            raise AttributeError(name)
        for module in (slicing, windows, resample, aggregates, detectors, segments, joins, intervals, references):
            func = getattr(module, name, None)
            if callable(func) and getattr(func, "__module__", "") == module.__name__:
                return self._bound(func)
        raise AttributeError(name)

    def _bound(self, func):
        import inspect

        takes_key = "by" in inspect.signature(func).parameters

        def call(*args, **kwargs):
            args = tuple(a.df if isinstance(a, Trajectories) else a for a in args)
            out = func(self.df, *args, **({"by": self.by} if takes_key and "by" not in kwargs else {}) | kwargs)
            return self._on(out) if isinstance(out, DataFrame) and set(self.by) <= set(out.columns) else out

        return call


# What a method name stands for: functions of (df, .., by=..).
METHODS = {
    "aligned": {"default": detectors.beacon_aligned, "beacon": detectors.beacon_aligned, "ils": detectors.ils_aligned, "runway": detectors.zone_runs},
    "landing": {"default": detectors.ils_aligned, "aligned_on_ils": detectors.ils_aligned, "any": detectors.landing_attempts, "runway_change": detectors.runway_change},
    "takeoff": {"default": detectors.takeoff_runs, "polygon_based": detectors.takeoff_runs, "track_based": detectors.track_takeoffs},
    "go_around": {"default": detectors.go_around},
    "holding_pattern": {"default": detectors.holding, "rule": detectors.holding, "learned": holding.learned},
    "point_merge": {"default": detectors.point_merge},
    "thermals": {"default": detectors.thermals},
    "movement": {"default": detectors.moving, "start_moving": detectors.moving, "slow_taxi": detectors.slow_taxi},
    "pushback": {"default": detectors.pushback},
    "parking_position": {"default": detectors.parking, "geometry": detectors.parking},
    "phases": {"default": detectors.phases},
    "fuelflow": {"default": grouped.fuel},
    "emission": {"default": grouped.emission},
    "predict": {"default": detectors.predict_straight, "straight": detectors.predict_straight, "flightplan": references.follow_plan},
    "infer_airport": {
        "default": detectors.nearest_airport,
        "landing": detectors.nearest_airport,
        "takeoff": lambda df, airports, by: detectors.nearest_airport(df, airports, by, "takeoff"),
    },
    "infer_flightplan": {"default": detectors.infer_flightplan},
}
#: Methods that add columns to the rows, in place of finding segments.
ROWS = {"phases", "fuelflow", "emission"}
