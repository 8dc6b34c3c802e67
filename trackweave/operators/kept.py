"""Results kept by content: what was computed from the same files by the same plan is read back."""

from __future__ import annotations

import hashlib
import re
import time
import uuid

from pyspark.sql import DataFrame

#: Plans whose results can't be told from their text: Python code, and rows that stand in no file.
_CODE = re.compile(r"Python|Pandas|InArrow|ScalaUDF|MapPartitions|MapElements|TypedFilter")
_ROWS = re.compile(r"LogicalRDD|LocalRelation|InMemoryRelation|ExternalRDD")


def _path(df: DataFrame, name: str):
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


def plan_text(df: DataFrame) -> str:
    """The optimized plan without names and numbers of its own, whole."""
    spark, keys = df.sparkSession, {"spark.sql.debug.maxToStringFields": "1000000", "spark.sql.maxMetadataStringLength": "1000000"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def content_key(df: DataFrame, version: str | None = None) -> str | None:
    """A key of the plan, the schema, the session's time zone and the paths, sizes and times of all input files.

    None where the content can't be told: rows that come from no file, random
    values, or Python code without a ``version`` that names it.
    """
    text = plan_text(df)
    if _ROWS.search(text) or not df._jdf.queryExecution().analyzed().deterministic() or (version is None and _CODE.search(text)):
        return None
    files = []
    for f in sorted(df.inputFiles()):
        path, system = _path(df, f)
        status = system.getFileStatus(path)
        files.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    parts = [text, df.schema.json(), df.sparkSession.conf.get("spark.sql.session.timeZone"), version or "", *files]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def kept(df: DataFrame, folder: str, version: str | None = None, max_age: float | None = None) -> DataFrame:
    """``df`` as it was written to ``folder`` for the same content, else written there now.

    A changed, added or removed source file, another plan, schema or time zone
    gives another key; entries older than ``max_age`` seconds are made anew.
    An entry is written aside and renamed when it is whole, so runs beside each
    other and lost drivers leave no parts of one.  What has no key is not kept.
    """
    key = content_key(df, version)
    if key is None:
        return df
    spark, place = df.sparkSession, f"{folder.rstrip('/')}/{key}"
    done, system = _path(df, f"{place}/_SUCCESS")
    if max_age is not None and system.exists(done) and time.time() - system.getFileStatus(done).getModificationTime() / 1000 > max_age:
        system.delete(done.getParent(), True)
    if not system.exists(done):
        aside, _ = _path(df, f"{folder.rstrip('/')}/_{uuid.uuid4().hex}")
        df.write.parquet(aside.toString())
        if not system.rename(aside, done.getParent()) or system.exists(_path(df, f"{place}/{aside.getName()}")[0]):
            system.delete(_path(df, f"{place}/{aside.getName()}")[0], True)  # another run was faster
            system.delete(aside, True)
    return spark.read.schema(df.schema).parquet(place)
