"""Safety report of an export: counts of findings and bounded samples, in one pass over its lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import secretscan as S
from .redaction import _QUOTED, shannon

LIMITS = {"email": 20, "public_ip": 20, "token": 20, "high_entropy": 15}


def line_findings(lines: DataFrame, key: str, column: str) -> DataFrame:
    """(key, email, public_ip, token, high_entropy): arrays of what each line holds."""
    v = F.col(column)
    return lines.select(key, S.emails(v).alias("email"), S.public_ips(v).alias("public_ip"), S.tokens(v).alias("token"), S.high_entropy(v).alias("high_entropy"))


def counts(lines: DataFrame, key: str, column: str) -> DataFrame:
    """One row of totals per category."""
    found = line_findings(lines, key, column)
    return found.agg(*[F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).alias(f"{c}s") for c in LIMITS])


def samples(lines: DataFrame, key: str, column: str, category: str) -> DataFrame:
    """(value, key, position): the first findings of a category in line order, at most its limit (a bounded report)."""
    found = line_findings(lines, key, column).select(key, F.posexplode(category).alias("position", "value"))
    return found.orderBy(key, "position").limit(LIMITS[category]).select("value", key, F.col("position").cast("long").alias("position"))


def excerpt(value: Column, size: int = 160) -> Column:
    """A line of at most ``size`` bytes, else its beginning and ``...``; no character is split."""
    head = F.make_valid_utf8(F.substring(F.to_binary(value, F.lit("utf-8")), 1, size - 3).cast("string"))
    return F.when(F.octet_length(value) <= size, value).otherwise(F.concat(F.regexp_replace(head, "\ufffd+$", ""), F.lit("...")))


def name_examples(lines: DataFrame, key: str, column: str, name: str, most: int = 5) -> DataFrame:
    """(key, excerpt): the first lines that contain ``name`` in any case, at most ``most`` (a bounded report)."""
    hits = lines.where(F.contains(F.lower(F.col(column)), F.lit(name.lower())))
    return hits.orderBy(key).limit(most).select(key, excerpt(F.col(column)).alias("excerpt"))


def entropy_contexts(lines: DataFrame, key: str, column: str, around: int = 24) -> DataFrame:
    """(key, value, context): the high-entropy values with ``around`` bytes on either side, line breaks as blanks; in one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v in zip(b.column(0), b.column(1).to_pylist()):
                for m in _QUOTED.finditer(v or ""):
                    inner = m[0][1:-1]
                    if all(re.search(c, inner) for c in ("[A-Z]", "[a-z]", "[0-9]")) and shannon(inner) >= 4.0:
                        before, after = v[: m.start()].encode()[-around:], v[m.end() :].encode()[:around]
                        out.append((k, inner, (before.decode("utf-8", "ignore") + m[0] + after.decode("utf-8", "ignore")).replace("\n", " ")))
            yield pa.RecordBatch.from_arrays([pa.array([o[0].as_py() for o in out], b.column(0).type), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=[key, "value", "context"])

    return lines.select(key, column).mapInArrow(run, f"`{key}` {lines.schema[key].dataType.simpleString()}, value string, context string")


def name_scan(lines: DataFrame, column: str, name: str) -> DataFrame:
    """One row: how many lines contain ``name`` in any case."""
    return lines.agg(F.count_if(F.contains(F.lower(F.col(column)), F.lit(name.lower()))).alias("lines_with_name"))
