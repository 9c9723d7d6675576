"""Shared by the session adapters: reading files, picking from JSON variants, putting records together.

An adapter yields turns (path, ord, turn) and one row of metadata per path;
``finish`` joins them into canonical records. Variants are only payload: what
is sorted or grouped is typed or JSON text.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalar import first_non_empty, int_number, json_string, timestamp_seconds, utc_text

ARRAY = "array<variant>"
CALLS, BLOCKS = f"array<{schema.CALL}>", f"array<{schema.BLOCK}>"


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, value) of the files under ``root`` whose name fits ``glob``; a missing root has none."""
    local = urlparse(root)
    if local.scheme in ("", "file") and not os.path.exists(local.path):
        return spark.createDataFrame([], "path string, value string")
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return read.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), "value")


def lines(of: DataFrame) -> DataFrame:
    """(path, line_no, raw): the lines of files, trimmed; blank ones are left out but keep their number (from 0)."""
    rows = of.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("raw", r"^[\s]+|[\s]+$", "").alias("raw")).where("raw != ''")


def parsed(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with the JSON object ``v`` of each; what is no object is left out."""
    return rows.withColumn("v", F.try_parse_json(raw)).where(F.schema_of_variant("v").startswith("OBJECT"))


def s(v: Column, *paths: str) -> Column:
    """First non-empty string at the paths, '' if none is a JSON string."""
    return first_non_empty(*[json_string(v, p) for p in paths])


def sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def arr(v: Column, path: str) -> Column:
    """The array at ``path``; [] for anything else."""
    return F.coalesce(F.try_variant_get(v, path, ARRAY), F.array().cast(ARRAY))


def text_of(v: Column) -> Column:
    """JSON text of a variant; null for absent and JSON null."""
    return F.when(F.schema_of_variant(v) != "VOID", F.to_json(v))


def json_at(v: Column, path: str) -> Column:
    return text_of(sub(v, path))


def number(v: Column, path: str) -> Column:
    return int_number(v, path)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` bound to a name: a form that names it many times stays as small as one that names it once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def time_at(v: Column, path: str) -> Column:
    """Normalised time at ``path``, from a string or a number of milliseconds."""
    ms = F.try_variant_get(v, path, "double").cast("long").cast("string")
    kind = F.schema_of_variant(sub(v, path))
    raw = F.when(kind == "STRING", F.try_variant_get(v, path, "string")).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), ms)
    # A time's forms name it some hundred times, and a trace has several of them in each turn.
    seconds = once(F.coalesce(raw, F.lit("")), timestamp_seconds)
    return F.coalesce(once(seconds, lambda t: F.when(t.isNotNull(), utc_text(t))), F.lit(""))


def decoded(text: Column) -> Column:
    """JSON text as it stands if it parses, else as a JSON string (arguments that are JSON inside a string)."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1))


def is_type(kind: str) -> Callable[[Column], Column]:
    return lambda b: F.coalesce(json_string(b, "$.type") == kind, F.lit(False))


def texts(blocks: Column, kind: str, sep: str, *fields: str) -> Column:
    """Texts of the blocks of one type, joined; empty ones count only without separator."""
    found = F.transform(F.filter(blocks, is_type(kind)), lambda b: s(b, *fields))
    return F.array_join(F.filter(found, lambda t: t != ""), sep)


def output(text: Column | None = None, content: Column | None = None, raw: Column | None = None) -> Column:
    return F.struct(
        (F.lit(None).cast("string") if text is None else text).alias("text"),
        (F.lit(None).cast(BLOCKS) if content is None else content).alias("content"),
        (F.lit(None).cast("string") if raw is None else raw).alias("raw"),
    )


def call(tool: Column, input: Column, out: Column, status: Column) -> Column:
    return F.struct(tool.alias("tool"), input.alias("input"), out.alias("output"), status.alias("status"))


def block(type_: Column, **fields: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(type_.alias("type"), *[fields.get(n, null).alias(n) for n in ("text", "media_type", "data", "url", "name")])


def turn(role: Column, timestamp: Column, text: Column, reasoning: Column | None = None, calls: Column | None = None, attachments: Column | None = None, extensions: Column | None = None) -> Column:
    return F.struct(
        role.alias("role"), timestamp.alias("timestamp"), text.alias("text"), (F.lit("") if reasoning is None else reasoning).alias("reasoning"),
        (F.array().cast(CALLS) if calls is None else calls.cast(CALLS)).alias("tool_calls"), (F.array().cast(BLOCKS) if attachments is None else attachments.cast(BLOCKS)).alias("attachments"),
        (F.lit(None).cast("string") if extensions is None else extensions).alias("extensions"),
    )


def first(value: Column, order: Column) -> Column:
    """Aggregate: the first non-empty value in order, '' if none."""
    return F.coalesce(F.min_by(F.when(value != "", value), F.when(value != "", order)), F.lit(""))


def last(value: Column, order: Column) -> Column:
    return F.coalesce(F.max_by(F.when(value != "", value), F.when(value != "", order)), F.lit(""))


def earliest(value: Column) -> Column:
    return F.coalesce(F.min(F.when(value != "", value)), F.lit(""))


def latest(value: Column) -> Column:
    return F.coalesce(F.max(F.when(value != "", value)), F.lit(""))


def contentful(t: str = "turn") -> Column:
    return (F.col(f"{t}.text") != "") | (F.col(f"{t}.reasoning") != "") | (F.size(f"{t}.tool_calls") > 0) | (F.size(f"{t}.attachments") > 0)


def finish(meta: DataFrame, turns: DataFrame, origin: str) -> DataFrame:
    """Canonical records from metadata (path, record_id, grouping, model, ... tokens) and turns (path, ord, turn)."""
    ordered = turns.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "turn"))).alias("o"))
    rows = meta.join(ordered.select("path", F.transform("o", lambda x: x["turn"]).alias("turns")), "path", "left")
    rows = rows.withColumn("turns", F.coalesce("turns", F.array().cast(f"array<{schema.TURN}>")))
    of = lambda r: F.size(F.filter("turns", lambda x: x["role"] == r)).cast("long")
    n_calls = F.aggregate("turns", F.lit(0), lambda acc, x: acc + F.size(x["tool_calls"])).cast("long")
    usage = F.struct(of("user").alias("user_turns"), of("assistant").alias("assistant_turns"), n_calls.alias("tool_calls"), F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"))
    null = F.lit(None).cast("string")
    provenance = F.struct(F.col("path").alias("source_path"), F.col("record_id").alias("source_id"), F.lit(origin).alias("source_origin"), null.alias("extracted_at"), null.alias("version"), null.alias("extensions"))
    have = set(rows.columns)
    get = lambda c: (F.col(c) if c in have else F.lit("")).alias(c)
    return rows.select(
        "record_id", F.lit(origin).alias("origin"), *[get(c) for c in ("grouping", "model", "branch", "started_at", "ended_at", "working_dir", "title")],
        F.col("turns").cast(f"array<{schema.TURN}>").alias("turns"), usage.alias("usage"), (F.col("extensions") if "extensions" in have else null).alias("extensions"), provenance.alias("_provenance"),
    )
