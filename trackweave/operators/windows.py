"""Row-to-row operators and noise filters over one canonical window per flight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timeunits import micros, us
from .keys import TIME, ordered, running

Step = Callable[[DataFrame], DataFrame]


def diff(df: DataFrame, by: list[str], **features: str) -> DataFrame:
    """new=old columns: the value less the one before."""
    w = ordered(df, by)
    return df.withColumns({n: F.col(c) - F.lag(c).over(w) for n, c in features.items()})


def absolute(df: DataFrame, **features: str) -> DataFrame:
    return df.withColumns({n: F.abs(c) for n, c in features.items()})


def unwrap(df: DataFrame, by: list[str], *features: str) -> DataFrame:
    """<f>_unwrapped: angles without jumps of more than half a turn; nulls stay null and bridge nothing."""
    w = ordered(df, by)
    for f in features:
        known = F.last_value(f, True).over(w.rowsBetween(W.unboundedPreceding, -1))
        d = F.col(f) - known
        turn = F.when(d > 180, -360 * F.ceil((d - 180) / 360)).when(d < -180, -360 * F.floor((d + 180) / 360))
        df = df.withColumn("_turn", F.coalesce(turn, F.lit(0)).cast("double")).withColumn(f"{f}_unwrapped", F.col(f) + F.sum("_turn").over(running(df, by))).drop("_turn")
    return df


def fill(df: DataFrame, by: list[str], *features: str, forward: bool = True, backward: bool = True) -> DataFrame:
    """Null values from the next, then from the previous known one (in that order when both)."""
    w = ordered(df, by)
    back, fwd = w.rowsBetween(0, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, 0)
    out = {}
    for f in features:
        steps = ([F.first_value(f, True).over(back)] if backward else []) + ([F.last_value(f, True).over(fwd)] if forward else [])
        out[f] = F.coalesce(*steps)
    return df.withColumns(out)


def cumulative_distance(df: DataFrame, by: list[str], reverse: bool = False) -> DataFrame:
    """cumdist (NM), compute_gs (kt) and compute_track; a flight's first row takes the second's speed and track."""
    w = ordered(df, by)
    lat, lon = F.lag("latitude").over(w), F.lag("longitude").over(w)
    df = df.withColumns({"_d": geo.distance(lat, lon, "latitude", "longitude"), "_t": us(TIME) - us(F.lag(TIME).over(w)), "_b": geo.bearing(lat, lon, "latitude", "longitude")})
    gs = F.when(F.col("_t") > 0, F.col("_d") / (F.col("_t") / 3.6e9))
    df = df.withColumns({"_gs": gs, "_b": F.when(F.col("_b") == 0, 360.0).otherwise(F.col("_b"))})
    total = F.sum(F.coalesce("_d", F.lit(0.0)))
    cum = total.over(running(df, by))
    if reverse:
        cum = F.coalesce(F.sum("_d").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))
    first = F.row_number().over(w) == 1
    pad = lambda c: F.when(first, F.lead(c).over(w)).otherwise(F.col(c))
    return df.withColumns({"cumdist": cum, "compute_gs": pad("_gs"), "compute_track": pad("_b")}).drop("_d", "_t", "_b", "_gs")


def handle_last_position(df: DataFrame, by: list[str]) -> DataFrame:
    """Positions of rows that repeat last_position become null; the column goes."""
    same = F.col("last_position") == F.lag("last_position").over(ordered(df, by))
    return df.withColumns({c: F.when(~F.coalesce(same, F.lit(False)), F.col(c)) for c in ("latitude", "longitude", "altitude") if c in df.columns}).drop("last_position")


# Filters: DataFrame -> DataFrame steps that compose.


def compose(*steps: Step) -> Step:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


def _frame(df, by, k):
    return ordered(df, by).rowsBetween(-(k // 2), (k - 1) // 2)


def median(by: list[str], **kernels: int) -> Step:
    """Centred rolling median; rows without a full kernel keep their value."""
    return lambda df: df.withColumns({f: F.when(F.count(f).over(_frame(df, by, k)) == k, F.percentile(f, 0.5).over(_frame(df, by, k))).otherwise(F.col(f)) for f, k in kernels.items()})


def mean(by: list[str], **kernels: int) -> Step:
    """Centred rolling mean; rows without a full kernel keep their value."""
    return lambda df: df.withColumns({f: F.when(F.count(f).over(_frame(df, by, k)) == k, F.avg(f).over(_frame(df, by, k))).otherwise(F.col(f)) for f, k in kernels.items()})


def padded_median(df: DataFrame, by: list[str], c: str, k: int) -> Column:
    """Median over k rows with zeros beyond the flight's ends."""
    have = F.collect_list(c).over(_frame(df, by, k))
    return F.get(F.sort_array(F.concat(have, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(have)))), k // 2)


def sigma_median(by: list[str], **kernels: int) -> Step:
    """Nulls values whose squared distance from the running median exceeds the root of its running median."""

    def run(df: DataFrame) -> DataFrame:
        for f, k in kernels.items():
            df = df.withColumn("_m", padded_median(df, by, f, k)).withColumn("_e", F.pow(F.col(f) - F.col("_m"), 2))
            df = df.withColumn("_s", F.sqrt(padded_median(df, by, "_e", k)))
            small = F.count(F.lit(1)).over(W.partitionBy(*by)) < k
            df = df.withColumn(f, F.when(small | (F.col("_e") <= F.col("_s")), F.col(f))).drop("_m", "_e", "_s")
        return df

    return run


def derivative(by: list[str], feature: str, first: float, second: float, kernel: float = 10.0) -> Step:
    """Nulls samples that lie within ``kernel`` seconds of a spike before and of one after."""

    def run(df: DataFrame) -> DataFrame:
        w = ordered(df, by)
        dt = (us(TIME) - us(F.lag(TIME).over(w))) / 1e6
        df = df.withColumn("_1", F.abs((F.col(feature) - F.lag(feature).over(w)) / dt))
        df = df.withColumn("_2", F.abs((F.col("_1") - F.lag("_1").over(w)) / dt))
        df = df.withColumn("_spike", F.when((F.col("_1") > first) | (F.col("_2") > second), us(TIME)))
        prev = F.last_value("_spike", True).over(w.rowsBetween(W.unboundedPreceding, 0))
        nxt = F.first_value("_spike", True).over(w.rowsBetween(0, W.unboundedFollowing))
        k = int(kernel * 1e6)
        bad = (us(TIME) - prev <= k) & (nxt - us(TIME) <= k)
        return df.withColumn(feature, F.when(~F.coalesce(bad, F.lit(False)), F.col(feature))).drop("_1", "_2", "_spike")

    return run


def clustering(by: list[str], feature: str, threshold: float, group_size: int = 5, gap="60 s") -> Step:
    """Nulls values of runs of at most ``group_size`` rows cut off by time gaps or jumps."""

    def run(df: DataFrame) -> DataFrame:
        w = ordered(df, by)
        cut = (us(TIME) - us(F.lag(TIME).over(w)) > micros(gap)) | (F.abs(F.col(feature) - F.lag(feature).over(w)) > threshold)
        df = df.withColumn("_cut", F.when(cut, 1).otherwise(0)).withColumn("_grp", F.sum("_cut").over(running(df, by)))
        n = F.count(F.lit(1)).over(W.partitionBy(*by, "_grp"))
        return df.withColumn(feature, F.when(n > group_size, F.col(feature))).drop("_cut", "_grp")

    return run


def position(by: list[str], cascades: int = 2) -> Step:
    """Drops rows whose computed ground speed is three deviations above the flight's mean, ``cascades`` times."""

    def run(df: DataFrame) -> DataFrame:
        cols = df.columns
        for _ in range(cascades):
            d = cumulative_distance(df, by)
            w = W.partitionBy(*by)
            bound = F.avg("compute_gs").over(w) + 3 * F.stddev_samp("compute_gs").over(w)
            df = d.withColumn("_bound", bound).filter(F.col("compute_gs") < F.col("_bound")).select(*cols)
        return df

    return run


# Usual kernels and bounds of the filters by column.
SIGMA = {"altitude": (17, 53), "geoaltitude": (17, 53), "selected_mcp": (17, 53), "selected_fms": (17, 53), "IAS": (23,), "TAS": (23,), "Mach": (23,), "vertical_rate": (3,), "groundspeed": (5,), "compute_gs": (17, 53), "compute_track": (17,), "track": (17,)}
MEDIAN = {"altitude": 11, "geoaltitude": 9, "vertical_rate": 5, "groundspeed": 9, "track": 5}
MEAN = {"altitude": 10, "geoaltitude": 10, "vertical_rate": 3, "groundspeed": 7, "track": 3}
SPIKES = {"altitude": (200, 150, 10), "geoaltitude": (200, 150, 10), "vertical_rate": (1500, 1000, 5), "groundspeed": (12, 10, 3), "track": (12, 10, 2)}
GROUPS = {"altitude": (500, 15), "geoaltitude": (500, 15), "vertical_rate": (500, 15), "track": (500, 15), "latitude": (500, 15), "longitude": (500, 15)}


def default_filter(by: list[str], **kernels) -> Step:
    """Cascades of sigma_median, by the usual kernels or those given (a number or several per column), on the columns that there are."""
    given = {c: k if isinstance(k, (tuple, list)) else (k,) for c, k in kernels.items()}

    def run(df: DataFrame) -> DataFrame:
        for c, ks in (given or SIGMA).items():
            for k in ks if c in df.columns else ():
                df = sigma_median(by, **{c: k})(df)
        return df

    return run


def aggressive_filter(by: list[str]) -> Step:
    """Medians, spikes of the derivatives, small groups, then means, by the usual values on the columns that there are."""

    def run(df: DataFrame) -> DataFrame:
        have = lambda table: {c: v for c, v in table.items() if c in df.columns}
        steps = [median(by, **have(MEDIAN))]
        steps += [derivative(by, c, *v) for c, v in have(SPIKES).items()]
        steps += [clustering(by, c, *v) for c, v in have(GROUPS).items()]
        return compose(*steps, mean(by, **have(MEAN)))(df)

    return run


FILTERS = {"default": default_filter, "aggressive": aggressive_filter}


def filtered(df: DataFrame, by: list[str], method: str | Step = "default", strategy: str | None = "fill", **kernels) -> DataFrame:
    """A noise filter by name or as a step; then values that it took away are filled backward and forward (no strategy: left null).

    Booleans and texts stay as they are; columns keep their types.
    """
    step = FILTERS[method](by, **kernels) if isinstance(method, str) else method
    out = step(df)
    numbers = [f.name for f in df.schema.fields if f.name in {*SIGMA, *MEDIAN, *GROUPS, *kernels} and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    return fill(out, by, *numbers) if strategy == "fill" and numbers else out
