"""Labelled CSV files laid out by run, and the tables written between stages
(S-1 .. S-5, S-7).

The reference's layout is ``<root>/<dataset>/<model>/<iteration>/<file>.csv``;
one glob read turns the path into run-key columns.  Tables written here are
Parquet partitioned by the run key (CSV on request), so later reads prune by
dataset, model and iteration.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divspark.operators.joins import join_small
from divspark.session import checkpoint_dir

LABELLED_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
PARAPHRASE_SCHEMA = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("text", T.StringType()),
                                  T.StructField("seed", T.StringType())])
RUN_KEYS = ("dataset", "model", "iteration")

# Fixed value: the strings pandas ``read_csv`` turns into missing values by default.
PANDAS_NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: What Hive-style directory names escape.
_HIVE_ESCAPED = re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def _csv_reader(spark: SparkSession, schema):
    r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
         .option("quote", '"').option("mode", "PERMISSIVE"))
    return r.schema(schema) if schema is not None else r.option("inferSchema", True)


def pandas_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn pandas' default missing-value words into nulls (``read_csv`` default)."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for c in cols:
        df = df.withColumn(c, F.when(~F.col(c).isin(*PANDAS_NA_VALUES), F.col(c)))
    return df


def read_labelled_csv(spark: SparkSession, path: str, schema=LABELLED_SCHEMA, *,
                      na_words: bool = False) -> DataFrame:
    """S-1 ``pd.read_csv(path)`` with an explicit schema (no inference pass).

    Quotes are doubled inside fields, as pandas writes them; fields may hold
    line breaks.  ``na_words=True`` also nulls ``nan``, ``null``, ``NA`` ...
    """
    df = _csv_reader(spark, schema).csv(path)
    return pandas_nulls(df) if na_words else df


def _percent_decoded(c):
    """``%XX`` sequences decoded; a plus sign stays one."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _directory_glob(key: str, values: Sequence | None) -> str:
    """Glob of the directory names that stand for one of ``values`` (any, if None): plain, or
    Hive-style with escaped values, in which a null has a name of its own."""
    if values is None:
        return "*"

    def literal(name: str) -> str:
        return re.sub(r"([\\{}\[\]*?,^])", r"\\\1", name)
    names = []
    for v in values:
        if v is not None:
            names.append(literal(str(v)))
        hive = "__HIVE_DEFAULT_PARTITION__" if v is None else _HIVE_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", str(v))
        names.append(literal(f"{key}={hive}"))
    return "{" + ",".join(names) + "}"


def read_runs(spark: SparkSession, root: str, file_name: str, schema=LABELLED_SCHEMA, *,
              keys: Sequence[str] = RUN_KEYS, na_words: bool = False,
              only: Mapping[str, Sequence] | None = None) -> DataFrame:
    """S-2 every run's ``file_name`` under ``root/<k1>/<k2>/.../file_name`` in one
    read; the directory names become the ``keys`` columns (``iteration`` as int,
    null when it is not numeric).

    ``only`` chooses runs by key, e.g. ``{"dataset": ["atis"], "iteration": [0, 1]}``: the
    other runs' directories are neither listed nor opened.  A key's values are those
    of the result; no run of that name gives an empty table.
    """
    depth = len(keys)
    unknown = set(only or {}) - set(keys)
    if unknown:
        raise ValueError(f"not among the run keys: {sorted(unknown)}")
    globs = [_directory_glob(k, None if only is None or k not in only else only[k]) for k in keys]
    if "{}" in globs:
        globs = None
    pattern = os.path.join(root, *globs, file_name) if globs else None
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern) if only and globs else None
    if only and (path is None or not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)):
        fields = spark.createDataFrame([], schema)
        return fields.select("*", *[F.lit(None).cast("int" if k == "iteration" else "string").alias(k) for k in keys])
    df = read_labelled_csv(spark, pattern, schema, na_words=na_words)
    path = F.col("_metadata.file_path")
    rx = "/".join(["([^/]+)"] * depth) + "/[^/]+$"
    for i, k in enumerate(keys, start=1):
        name = _percent_decoded(F.regexp_extract(path, rx, i))  # the path comes as a URL
        # plain directory names, or Hive-style ``name=value`` ones, whose values are escaped
        value = F.regexp_extract(name, "^[A-Za-z_][A-Za-z0-9_]*=(.*)$", 1)
        v = F.when(value == "", name).when(value != "__HIVE_DEFAULT_PARTITION__", _percent_decoded(value))
        df = df.withColumn(k, v.try_cast("int") if k == "iteration" else v)
    return df


def read_with_fallback(spark: SparkSession, root: str, file_names: Sequence[str], schema=LABELLED_SCHEMA, *,
                       keys: Sequence[str] = RUN_KEYS, na_words: bool = False) -> DataFrame:
    """S-3 ``try: read(first) except: read(second)`` per run: rows of the
    first name that exists in each run.  The per-run choice is a small
    aggregate joined back (no window over a whole run)."""
    from pyspark.errors import AnalysisException

    parts = None
    for prio, name in enumerate(file_names):
        try:
            p = read_runs(spark, root, name, schema, keys=keys, na_words=na_words)
        except AnalysisException:  # no run has this file
            continue
        p = p.withColumn("_prio", F.lit(prio))
        parts = p if parts is None else parts.unionByName(p)
    if parts is None:
        raise FileNotFoundError(f"none of {list(file_names)} under {root}")
    best = parts.groupBy(*keys).agg(F.min("_prio").alias("_prio"))
    return join_small(parts, best, [*keys, "_prio"], null_safe=True).drop("_prio")


def write_runs(df: DataFrame, path: str, keys: Sequence[str] = RUN_KEYS, *, fmt: str = "parquet",
               mode: str = "overwrite", options: dict | None = None) -> None:
    """S-4 / S-5 / S-7: one table partitioned by the run key (``fmt='csv'``
    writes a header and doubled quotes, readable by :func:`read_labelled_csv`).

    Rows are rebalanced on the run key first: a small run is one file instead of
    one per task, a large one is split."""
    present = [F.col(k) for k in keys if k in df.columns]
    if present:
        df = df.hint("rebalance", *present)
    w = df.write.mode(mode).partitionBy(*[k for k in keys if k in df.columns])
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"').option("quote", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.options(**(options or {})).format(fmt).save(path)


def read_written(spark: SparkSession, path: str, schema=None, *, fmt: str = "parquet") -> DataFrame:
    """Read back a table of :func:`write_runs` (partition columns discovered)."""
    if fmt == "csv":
        return _csv_reader(spark, schema).csv(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base.replace("file:", "", 1) if base.startswith("file:") else base,
                        "divspark-tables", f"{name}-{uuid.uuid4().hex}")
