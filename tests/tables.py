"""Altered copies of the test tables: empty ones, and hard ones with nulls, repeats and clashing columns."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that operators use inside.
CLASHING = ("value", "n", "id", "h", "start", "label", "nodes", "row", "o", "p", "v", "k", "mask", "readings", "token", "kl", "ts")
NAMES = ("records", "codex_session", "manifest_entries", "raw_lines", "documents", "accounts", "store_fields", "mix_targets")


def _write(spark, sf, to, name, change):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    change(df).coalesce(2).write.parquet(f"{to}/{name}.parquet")


def empty(spark, sf, to, names=NAMES):
    for name in names:
        _write(spark, sf, to, name, lambda df: df.limit(0))
    return str(to)


def hard(spark, sf, to, names=NAMES, repeat=True):
    def change(df):
        null = spark.createDataFrame([tuple(None for _ in df.columns)], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))
        if "kind" in df.columns and "handle" in df.columns or "json_type" in df.columns or "max_repeats" in df.columns:
            repeat_ = False
        else:
            repeat_ = repeat
        out = df.unionByName(df).unionByName(null) if repeat_ else df.unionByName(null)
        for c in CLASHING:
            if c not in df.columns:
                out = out.withColumn(c, F.lit("clash"))
        return out

    for name in names:
        _write(spark, sf, to, name, change)
    return str(to)


def rows(df):
    return sorted(map(repr, df.distinct().collect()))


def exists(sf):
    return os.path.isdir(sf)
