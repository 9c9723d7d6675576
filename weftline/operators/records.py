"""Operators on canonical records: validation, dedup, counts, summaries, tool schemas, message views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

t = S.text


def _has(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) > 0


def turns_of(turns: Column) -> Column:
    """The non-null turns; [] for null."""
    return F.coalesce(F.filter(turns, lambda x: x.isNotNull()), F.array().cast("array<void>"))


def validity() -> Column:
    """The first failure of a record, null if it is valid.

    In this order: record_id, origin, grouping, model not blank; turns not
    empty; started_at, ended_at RFC 3339 where not empty; then turn by turn
    the role, the time, and some content. Null turns count as turns without a role.
    """

    def time(c: Column) -> Column:
        return (t(c) != "") & S.rfc3339_seconds(c).isNull()

    def turn(x: Column, i: Column) -> Column:
        n = F.concat(F.lit("turn "), i.cast("string"))
        empty = (t(x["text"]) == "") & (t(x["reasoning"]) == "") & ~_has(x["tool_calls"]) & ~_has(x["attachments"])
        return (
            F.when(~t(x["role"]).isin("user", "assistant"), F.concat(n, F.lit(': invalid role "'), t(x["role"]), F.lit('"')))
            .when(time(x["timestamp"]), F.concat(n, F.lit(" timestamp")))
            .when(empty, F.concat(n, F.lit(" has no content")))
        )

    c = F.col
    required = [F.when(F.trim(t(c(n))) == "", f"{n} is required") for n in ("record_id", "origin", "grouping", "model")]
    return F.coalesce(
        *required,
        F.when(~_has(c("turns")), "turns must not be empty"),
        F.when(time(c("started_at")), "started_at"),
        F.when(time(c("ended_at")), "ended_at"),
        F.try_element_at(F.filter(F.transform(c("turns"), turn), lambda e: e.isNotNull()), F.lit(1)),
    )


def first_wins(records: DataFrame, *order: Column) -> DataFrame:
    """One row per record_id: orchestrator's first, then by origin, source path and ``order``.

    Only record ids are shuffled to find the repeated ones; the payload of
    those alone is ranked, the rest passes through (the ids of repeats are
    broadcast where the plan sees at run time that they are few). Rows without
    record_id are no repeats of each other and are all kept.
    """
    from pyspark.sql import Window

    repeated = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and record_id is not null").select("record_id")
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.when(F.col("origin") == "orchestrator", 0).otherwise(1), F.col("origin"), F.col("_provenance.source_path"), *order))
    several = records.join(repeated, "record_id", "left_semi").withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return records.join(repeated, "record_id", "left_anti").unionByName(several)


def usage_counts(records: DataFrame) -> DataFrame:
    """(record_id, user_turns, assistant_turns, tool_calls) counted from the turns."""
    turns = turns_of(F.col("turns"))
    role = lambda r: F.size(F.filter(turns, lambda x: x["role"] == r)).cast("long")
    calls = F.aggregate(turns, F.lit(0), lambda acc, x: acc + F.size(F.filter(F.coalesce(x["tool_calls"], F.array()), lambda c: c.isNotNull())))
    counted = F.when(F.size(turns) == 0, 0).otherwise(calls).cast("long")
    return records.select("record_id", role("user").alias("user_turns"), role("assistant").alias("assistant_turns"), counted.alias("tool_calls"))


def breakdown(records: DataFrame, key: str) -> DataFrame:
    """(key, records, input_tokens, output_tokens) of each value of ``key``."""
    total = lambda c: F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c)
    return records.groupBy(F.coalesce(key, F.lit("")).alias(key)).agg(F.count(F.lit(1)).alias("records"), total("input_tokens"), total("output_tokens"))


def totals(records: DataFrame, marker: str) -> DataFrame:
    """One row: records, tokens, and occurrences of the redaction marker anywhere in the records' lines."""
    hits = F.regexp_count(F.to_json(F.struct("*")), F.lit(r"\Q" + marker + r"\E"))
    total = lambda c: F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c)
    return records.agg(F.count(F.lit(1)).alias("records"), total("input_tokens"), total("output_tokens"), F.coalesce(F.sum(hits), F.lit(0)).alias("redactions"))


def calls(records: DataFrame) -> DataFrame:
    """(record_id, turn_no, call_no, call) of the non-null tool calls."""
    rows = records.select("record_id", F.posexplode("turns").alias("turn_no", "x")).where("x is not null")
    return rows.select("record_id", "turn_no", F.posexplode("x.tool_calls").alias("call_no", "call")).where("call is not null")


def infer_tools(records: DataFrame) -> DataFrame:
    """(tool, param, type, required, calls): the parameters each tool was seen with.

    A parameter has the type of its first value (by record, turn, call) and is
    required if every call of the tool has it; calls whose input is no object
    count as calls. A tool without parameters has one row with null param.
    """
    rows = calls(records).where("call.tool is not null and call.tool != ''").select("record_id", "turn_no", "call_no", "call.tool", "call.input").dropDuplicates(["record_id", "turn_no", "call_no"])
    counted = rows.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))
    names = rows.where(F.ltrim("input").startswith("{")).select("record_id", "turn_no", "call_no", "tool", "input", F.explode(F.json_object_keys("input")).alias("param"))
    value = F.try_variant_get(F.try_parse_json("input"), F.concat(F.lit("$['"), F.col("param"), F.lit("']")), "variant")
    s = F.schema_of_variant(value)
    kind = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    params = names.groupBy("tool", "param").agg(F.count_distinct("record_id", "turn_no", "call_no").alias("seen"), F.min_by(kind, F.struct("record_id", "turn_no", "call_no")).alias("type"))
    return counted.join(params, "tool", "left").select("tool", "param", "type", F.coalesce(F.col("seen") == F.col("calls"), F.lit(False)).alias("required"), "calls")


def overlay_catalog(tools: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inferred tools with the catalog's description and parameters where it knows them; the catalog's other tools are dropped.

    ``tools``: (tool, parameters); ``catalog``: (name, description, parameters,
    position), the last position of a name wins.
    """
    last = catalog.groupBy("name").agg(F.max_by(F.struct("description", "parameters"), "position").alias("c"))
    joined = tools.join(last, tools["tool"] == last["name"], "left")
    return joined.select("tool", F.coalesce("c.description", F.lit("")).alias("description"), F.coalesce("c.parameters", "parameters").alias("parameters"))


def messages(records: DataFrame) -> DataFrame:
    """(record_id, index, role, content, name, call_id, is_last): turns as messages, each tool output as a ``tool`` message after its turn."""

    def of_turn(x: Column, i: Column) -> Column:
        none = F.lit(None).cast("string")
        own = F.struct(t(x["role"]).alias("role"), t(x["text"]).alias("content"), none.alias("name"), none.alias("call_id"))
        outs = F.transform(
            F.coalesce(x["tool_calls"], F.array()),
            lambda c, j: F.when(c["output"].isNotNull(), F.struct(F.lit("tool").alias("role"), S.output_text(c["output"]).alias("content"), t(c["tool"]).alias("name"), S.call_id(i, j, c["tool"]).alias("call_id"))),
        )
        return F.when(x.isNotNull(), F.concat(F.array(own), F.filter(outs, lambda o: o.isNotNull())))

    flat = F.flatten(F.filter(F.transform("turns", of_turn), lambda a: a.isNotNull()))
    rows = records.select("record_id", F.posexplode(flat).alias("index", "m"), F.size(flat).alias("n"))
    return rows.select("record_id", F.col("index").cast("long").alias("index"), "m.*", (F.col("index") + 1 == F.col("n")).alias("is_last"))


def merged_messages() -> Column:
    """Array of (role, content): turns without tool messages, runs of one role joined by a line break where both have text.

    An expression-only fold over the turns; reasoning, attachments and tool
    calls of merged turns are lost.
    """
    item = "struct<role:string,content:string>"
    start = F.array().cast(f"array<{item}>")

    def fold(acc: Column, x: Column) -> Column:
        role, content = t(x["role"]), t(x["text"])
        last = F.try_element_at(acc, F.lit(-1))
        sep = F.when((last["content"] != "") & (content != ""), "\n").otherwise("")
        joined = F.struct(last["role"].alias("role"), F.concat(last["content"], sep, content).alias("content"))
        same = F.coalesce(last["role"] == role, F.lit(False))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(F.struct(role.alias("role"), content.alias("content")))))

    kept = F.filter("turns", lambda x: x.isNotNull() & (t(x["role"]) != "tool"))
    return F.coalesce(F.aggregate(kept, start, fold), start)


def role_adjacency(records: DataFrame) -> DataFrame:
    """(record_id, turn_no, role, prev_role, next_role), '' at the ends; positions of null turns are kept."""
    at = lambda i: t(F.try_element_at("turns", i)["role"])
    rows = records.select("record_id", "turns", F.posexplode("turns").alias("i", "x"))
    prev = F.when(F.col("i") > 0, at(F.col("i"))).otherwise("")
    return rows.select("record_id", F.col("i").cast("long").alias("turn_no"), t(F.col("x.role")).alias("role"), prev.alias("prev_role"), at(F.col("i") + 2).alias("next_role"))
