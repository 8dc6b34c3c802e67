"""Functions of single flights that may fail: a flight that raises is put aside, the others go on."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .grouped import beside, pandas_flights
from .scratch import materialize

#: Characters of a message, and of a trace, that are kept.
MESSAGE, TRACE = 500, 4000


def guarded(df: DataFrame, by: list[str], func: Callable[[pd.DataFrame], pd.DataFrame | None], schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that func gave, by with error, message, trace and n of each flight whose func raised).

    func gets a flight's rows in time order and gives rows of ``schema`` (that
    of ``df`` by default), or None for no rows.  A result that doesn't fit the
    schema is a fault of its flight, too.  The flights are computed once and
    written; both tables read what was written.  Short flights share Arrow batches.
    """
    kind = df.schema if schema is None else T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.names
    types = [to_arrow_type(f.dataType) for f in kind]
    # Flat columns: a row is a flight's or a fault's, and has nulls for the other.
    fields = [(c, df.schema[c].dataType) for c in by] + [("error", T.StringType()), ("message", T.StringType()), ("trace", T.StringType()), ("n", T.LongType())]
    whole = T.StructType([T.StructField(f.name, f.dataType, True) for f in kind] + [T.StructField(f"_fault_{c}", t, True) for c, t in fields])

    def one(pdf: pd.DataFrame) -> tuple[pd.DataFrame | None, dict | None]:
        """(rows, None), or (None, fault) of a flight."""
        try:
            out = func(pdf)
            if out is None:
                return None, None
            out = out[names]
            for f, t in zip(kind, types):  # what can't be written fails here, in its flight
                pa.Array.from_pandas(out[f.name], type=t)
            return out, None
        except Exception as e:  # noqa: BLE001 - whatever a flight raises is its own
            at = {c: pdf[c].iloc[0] for c in by}
            at = {c: None if pd.isna(v) else v for c, v in at.items()}
            at |= {"error": type(e).__name__, "message": str(e)[:MESSAGE], "trace": traceback.format_exc()[-TRACE:], "n": len(pdf)}
            return None, {f"_fault_{c}": v for c, v in at.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, ends in pandas_flights(batches, by):
            done = [one(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(ends[:-1], ends[1:])]
            good, bad = [g for g, _ in done if g is not None and len(g)], [b for _, b in done if b]
            if good:
                # Columns are put together as objects where flights gave them different types, so none changes a value.
                mixed = [c for c in names if len({g[c].dtype for g in good}) > 1]
                yield filled(pd.concat([g.astype({c: object for c in mixed}) for g in good] if mixed else good, ignore_index=True))
            if bad:
                yield filled(pd.DataFrame(bad, dtype=object))

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        """The other kind's columns as nulls."""
        rest = {c: pd.Series([None] * len(rows), rows.index, dtype=object) for c in whole.names if c not in rows.columns}
        return rows.assign(**rest)[whole.names].astype({c: object for c in rows.columns if isinstance(rows[c].dtype, pd.StringDtype)})

    both = materialize(beside(df, by).mapInPandas(run, whole))
    bad = F.col("_fault_error").isNotNull()
    return both.filter(~bad).select(*names), both.filter(bad).select(*[F.col(f"_fault_{c}").alias(c) for c, _ in fields])
