"""Rollout logs: one event per line; what lies between two message boundaries belongs to the later one.

Reasoning and tool calls wait for the next user or assistant boundary. Each
row's island is the number of boundaries before it, so one window per file
and one join replace a state machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import build as B


def read(spark: SparkSession, *roots: str) -> DataFrame:
    """Records of all ``*.jsonl`` under the roots (active before archived)."""
    rows = None
    for root in roots:
        part = B.lines(B.files(spark, root, "*.jsonl"))
        rows = part if rows is None else rows.unionByName(part)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return assemble(rows.select("path", F.col("line_no").alias("ord"), "raw", stem.alias("record_id")))


def _attachment(value: Column) -> Column:
    null = F.lit(None).cast("string")
    data = value.startswith("data:")
    return B.block(F.lit("image"), data=F.when(data, value).otherwise(null), url=F.when(data, null).otherwise(value))


def _line_value(text: Column, label: str) -> Column:
    """Value of the last line that starts with ``label``, null if there is none."""
    return F.try_element_at(F.transform(F.filter(F.split(text, "\n"), lambda x: x.startswith(label)), lambda x: F.trim(F.substr(x, F.lit(len(label) + 1)))), F.lit(-1))


def assemble(rows: DataFrame) -> DataFrame:
    """Records from (path, ord, raw, record_id). Token counts are the largest totals; equal neighbouring turns are one."""
    v = F.col("v")
    p = B.sub(v, "$.payload")
    e = B.parsed(rows).select("path", "ord", "record_id", p.alias("p"), B.s(v, "$.type").alias("type"), B.s(p, "$.type").alias("kind"), B.time_at(v, "$.timestamp").alias("at"))
    p = F.col("p")
    item, event = F.col("type") == "response_item", F.col("type") == "event_msg"

    raw_out = B.s(p, "$.output")
    code, wall = _line_value(raw_out, "Exit code:"), _line_value(raw_out, "Wall time:")
    raw = F.when(code.isNotNull() | wall.isNotNull(), F.to_json(F.struct(code.alias("exit_code"), wall.alias("wall_time"))))
    own = F.try_parse_json(raw_out)
    object_ = F.coalesce(F.schema_of_variant(own).startswith("OBJECT"), F.lit(False))
    custom = F.when(object_, B.output(B.s(own, "$.output"), None, raw_out)).when(own.isNull(), B.output(raw_out)).otherwise(B.output(F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(own, "$", "string"))))
    out = F.when(F.col("kind") == "function_call_output", B.output(raw_out, None, raw)).when(F.col("kind") == "custom_tool_call_output", custom)
    results = e.where(item & F.col("kind").isin("function_call_output", "custom_tool_call_output")).select("path", B.s(p, "$.call_id").alias("call_id"), "ord", out.alias("out"))
    results = results.groupBy("path", "call_id").agg(F.max_by("out", "ord").alias("out"))

    is_call = item & F.col("kind").isin("function_call", "custom_tool_call")
    says = F.when(item & (F.col("kind") == "message") & B.s(p, "$.role").isin("user", "assistant"), B.s(p, "$.role"))
    says = says.when(event & (F.col("kind") == "user_message"), "user").when(event & (F.col("kind") == "agent_message"), "assistant")
    before = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("says", says).withColumn("island", F.coalesce(F.sum(F.col("says").isNotNull().cast("int")).over(before), F.lit(0)))

    thoughts = F.when(item & (F.col("kind") == "reasoning"), F.transform(B.arr(p, "$.summary"), lambda b: B.s(b, "$.text"))).when(event & (F.col("kind") == "agent_reasoning"), F.array(B.s(p, "$.text")))
    arguments = F.when(F.col("kind") == "function_call", B.s(p, "$.arguments")).otherwise(B.s(p, "$.input", "$.arguments"))
    calls = e.where(is_call).select("path", "island", "ord", B.s(p, "$.call_id").alias("call_id"), B.s(p, "$.name").alias("tool"), B.decoded(arguments).alias("input")).join(results, ["path", "call_id"], "left")
    status = F.when(F.col("out").isNull(), "").when(F.contains(F.lower("out.text"), F.lit("error")), "error").otherwise("success")
    calls = calls.groupBy("path", "island").agg(F.array_sort(F.collect_list(F.struct("ord", B.call(F.col("tool"), F.col("input"), F.col("out"), status).alias("call")))).alias("c"))
    calls = calls.select("path", "island", F.transform("c", lambda x: x["call"]).alias("calls"))
    why = e.withColumn("w", thoughts).where("w is not null").groupBy("path", "island").agg(F.array_sort(F.collect_list(F.struct("ord", "w"))).alias("w"))
    why = why.select("path", "island", F.array_join(F.array_distinct(F.filter(F.flatten(F.transform("w", lambda x: x["w"])), lambda x: x != "")), "\n").alias("reasoning"))
    pending = calls.join(why, ["path", "island"], "full")

    parts = B.arr(p, "$.content")
    is_text = lambda b: B.s(b, "$.type").isin("input_text", "text", "output_text")
    text = F.when(item, F.array_join(F.transform(F.filter(parts, is_text), lambda b: F.coalesce(B.json_string(b, "$.text"), F.lit(""))), "\n")).otherwise(B.s(p, "$.message"))
    images = F.concat(*[F.transform(B.arr(p, k), lambda x: _attachment(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(B.s(x, "$.url", "$.path")))) for k in ("$.images", "$.local_images")])
    attached = F.when(item, F.transform(F.filter(parts, B.is_type("input_image")), lambda b: _attachment(B.s(b, "$.image_url")))).otherwise(images)
    bounds = e.where("says is not null").select("path", "island", "ord", "at", "says", text.alias("text"), attached.alias("attached"))
    ends = e.groupBy("path").agg(B.latest(F.col("at")).alias("end"), F.max("ord").alias("last"))
    flushes = bounds.join(pending, ["path", "island"], "full").join(ends, "path")
    assistant = B.turn(F.lit("assistant"), F.coalesce("at", "end"), F.when(F.col("says") == "assistant", F.col("text")).otherwise(""), F.coalesce("reasoning", F.lit("")), F.coalesce("calls", F.array().cast(B.CALLS)))
    user = F.when(F.col("says") == "user", B.turn(F.lit("user"), F.col("at"), F.col("text"), None, None, F.col("attached")))
    both = flushes.select("path", F.coalesce("ord", F.col("last") + 1).alias("ord"), F.posexplode(F.array(assistant, user)).alias("k", "turn")).where("turn is not null").where(B.contentful())
    same = F.struct("turn.role", "turn.text", "turn.reasoning", F.size("turn.attachments"), F.size("turn.tool_calls"))
    turns = both.select("path", F.struct("ord", "k").alias("ord"), "turn").withColumn("same", same)
    turns = turns.withColumn("prev", F.lag("same").over(Window.partitionBy("path").orderBy("ord"))).where(~F.col("same").eqNullSafe(F.col("prev"))).select("path", "ord", "turn")

    meta_, context = F.col("type") == "session_meta", F.col("type") == "turn_context"
    pick = lambda cond, path: F.when(cond, B.s(p, path)).otherwise("")
    total = lambda *names: F.max(F.when(event & (F.col("kind") == "token_count"), sum((B.number(p, f"$.info.total_token_usage.{n}") for n in names), F.lit(0))).otherwise(0))
    model = F.when(meta_, B.s(p, "$.model_provider")).when(context, B.s(p, "$.model")).otherwise("")
    ord_ = F.col("ord")
    either = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), d)
    meta = e.groupBy("path").agg(
        either(B.last(pick(meta_, "$.id"), ord_), F.first("record_id")).alias("record_id"), B.first(pick(meta_ | context, "$.cwd"), ord_).alias("working_dir"),
        B.first(pick(meta_, "$.git.branch"), ord_).alias("branch"), either(B.last(model, ord_), F.lit("codex/unknown")).alias("model"),
        B.earliest(F.col("at")).alias("started_at"), B.latest(F.col("at")).alias("ended_at"), total("input_tokens", "cached_input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"),
    ).withColumn("grouping", either(F.col("working_dir"), F.lit("codex:unknown")))
    return B.finish(meta, turns, "codex")
