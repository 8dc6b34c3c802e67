"""Segments of a collection as a collection of their own: first, last, longest, by number, mapped, joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.timeunits import us
from .operators import aggregates
from .operators import segments as ops


class Segments:
    """Rows of flights with the segments (key, seg_idx, start, stop, ..) that a detector or a split found in them.

    Choosing segments gives Segments again; ``rows`` and ``all`` give the rows
    inside them.  Nothing is computed before an action.
    """

    def __init__(self, rows: DataFrame, segs: DataFrame, by: list[str]):
        self.source, self.segs, self.by = rows, segs, by

    def _with(self, segs: DataFrame) -> Segments:
        return Segments(self.source, segs, self.by)

    def next(self) -> Segments:
        """The first segment of each flight."""
        return self._with(ops.pick(self.segs, self.by, "next"))

    def final(self) -> Segments:
        """The last segment of each flight."""
        return self._with(ops.pick(self.segs, self.by, "final"))

    def _extreme(self, which: str, key: str | Column) -> Segments:
        if isinstance(key, Column) or key in self.segs.columns:
            return self._with(ops.pick(self.segs, self.by, which, F.col(key) if isinstance(key, str) else key))
        if key == "duration":
            return self._with(ops.pick(self.segs, self.by, which, us("stop") - us("start")))
        value = self.rows().groupBy(*self.by, F.col("index_").alias("seg_idx")).agg(aggregates.feature(key).alias("_key"))
        return self._with(ops.pick(self.segs.join(value, [*self.by, "seg_idx"], "left"), self.by, which, F.col("_key")).drop("_key"))

    def max(self, key: str | Column = "duration") -> Segments:
        """The segment with the largest duration, column or feature such as altitude_max; ties to the first."""
        return self._extreme("max", key)

    def min(self, key: str | Column = "duration") -> Segments:
        return self._extreme("min", key)

    def __getitem__(self, index: int | slice) -> Segments:
        """Segments by place in their flight, from 0; of a slice the step must be positive and the bounds not negative."""
        at = ops.numbered(self.segs, self.by)
        if isinstance(index, int):
            if index < 0:
                return self._with(ops.numbered(self.segs, self.by, back=True).filter(F.col("_at") == -index - 1).drop("_at"))
            return self._with(at.filter(F.col("_at") == index).drop("_at"))
        start, stop, step = index.start or 0, index.stop, index.step or 1
        if step < 1 or start < 0 or (stop or 0) < 0:
            raise ValueError("a slice goes forward, from bounds that are not negative")
        test = (F.col("_at") >= start) & (F.pmod(F.col("_at") - start, F.lit(step)) == 0)
        return self._with(at.filter(test & (F.col("_at") < stop) if stop is not None else test).drop("_at"))

    def filter(self, condition: str | Column) -> Segments:
        return self._with(self.segs.filter(condition))

    def sum(self) -> DataFrame:
        """(key, n): segments of every flight, 0 for flights without any."""
        n = self.segs.groupBy(*self.by).agg(F.count(F.lit(1)).alias("n"))
        return self.source.select(*self.by).distinct().join(n, self.by, "left").select(*self.by, F.coalesce("n", F.lit(0)).alias("n"))

    def __len__(self) -> int:
        return self.segs.count()

    def has(self):
        """The flights with a segment, as a collection."""
        from .frame import Trajectories

        return Trajectories(ops.has(self.source, self.segs, self.by), self.by)

    def rows(self) -> DataFrame:
        """Rows inside segments, ends included, with the segment's number as index_."""
        return ops.rows_of(self.source, self.segs, self.by)

    def all(self, flight_id: str | None = None):
        """The rows inside segments as a collection; a template such as "{self.flight_id}_{i}" names its flights."""
        from .frame import Trajectories

        rows = self.rows()
        if flight_id is None:
            return Trajectories(rows, self.by)
        return Trajectories(rows.withColumn("flight_id", named(flight_id)), ["flight_id"])

    def map(self, func):
        """func on the segments as flights of their own (a collection keyed by flight and index_)."""
        from .frame import Trajectories

        return func(Trajectories(self.rows(), [*self.by, "index_"]))

    __call__ = map


def named(template: str) -> Column:
    """A text with {self.column} and {i}, {i:02d} (the segment's number) as a column."""
    import re

    parts = []
    for text, field, width in re.findall(r"([^{]*)(?:\{([^}:]*)(?::0?(\d+)d?)?\})?", template):
        if text:
            parts.append(F.lit(text))
        if field:
            c = F.col("index_" if field == "i" else field.removeprefix("self.")).cast("string")
            parts.append(F.lpad(c, int(width), "0") if width else c)
    return F.concat(*parts)
