"""Projection and filters (F-4 .. F-10, S-6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """F-4 ``dropna()`` / F-5 ``dropna(subset=[...])``."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def distinct_rows(df: DataFrame) -> DataFrame:
    """F-6 ``drop_duplicates()``: a hash aggregate with map-side partial dedup."""
    return df.distinct()


# Fixed value: the refusal / preamble marker tested by the assembly scripts.
REFUSAL_MARKER = "paraphra"


def drop_refusals(df: DataFrame, text: str = "text", marker: str = REFUSAL_MARKER) -> DataFrame:
    """F-7 ``df[~df.text.str.contains('paraphra')]`` (case-sensitive)."""
    return df.where(~F.col(text).contains(marker))


def project(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """F-8 ``df[[...]]`` / ``rename``: a list keeps names, a mapping renames ``old -> new``."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(a).alias(b) for a, b in columns.items()])
    return df.select(*columns)


def map_labels(df: DataFrame, mapping: Mapping[str, int], source: str, out: str = "label", *,
               strict: bool = True) -> DataFrame:
    """F-9 ``dct[x]``: label name to id through a fixed map (inlined literal).

    ``strict`` fails the job on an unknown name, as the ``KeyError`` does.
    """
    m = F.create_map(*[e for k, v in mapping.items() for e in (F.lit(k), F.lit(int(v)))])
    val: Column = m[F.col(source)]
    if strict:
        val = F.when(F.col(source).isNull() | val.isNotNull(), val).otherwise(
            F.raise_error(F.concat(F.lit("unknown label name: "), F.col(source))).cast("int"))
    return df.withColumn(out, val)


def one_vs_rest(df: DataFrame, target, label: str = "label", out: str = "y") -> DataFrame:
    """F-10 ``change_label_except_for``: 1 for the target label, else 0."""
    t = F.col(target) if isinstance(target, str) else F.lit(target)
    return df.withColumn(out, F.when(F.col(label) == t, 1).otherwise(0))


def normalise_seeds(df: DataFrame, keys: Sequence[str], seed: str = "seed",
                    label: str = "label", out: str = "text") -> DataFrame:
    """S-6 ``df[['seed','label']].drop_duplicates().rename(seed -> text)``.

    Also reads seed files whose text column already has the ``text`` name.
    """
    col = seed if seed in df.columns else out
    return df.select(*keys, F.col(col).alias(out), label).distinct()
