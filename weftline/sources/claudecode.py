"""Project logs: one JSONL file per session, tool results in later user lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build as B


def read(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<project>/<session>.jsonl`` and the sessions' ``subagents`` folders, one record each; without assistant turns none."""
    rows = B.lines(B.files(spark, root, "*.jsonl"))
    sub = F.regexp_extract("path", r"^(.*)/subagents/", 1)
    session = F.when(sub != "", sub).otherwise(F.regexp_replace("path", r"\.jsonl$", ""))
    project = F.regexp_extract(session, r"^(.*)/[^/]+$", 1)
    rows = rows.withColumn("session", session).withColumn("is_sub", sub != "").withColumn("project", project)
    main = rows.where("not is_sub").select("session").distinct().withColumn("main", F.lit(True))
    rows = rows.join(main, "session", "left")
    suffix = F.when(F.col("is_sub") & F.coalesce("main", F.lit(False)), ":subagents").otherwise("")
    record = F.concat(F.substring(F.sha2("project", 256), 1, 16), F.lit("/"), F.regexp_extract("session", r"([^/]+)$", 1), suffix)
    # Subagent files of a session are one record in order of time; other files keep their own order.
    when = F.when(F.col("is_sub"), B.time_at(F.try_parse_json("raw"), "$.timestamp")).otherwise("")
    key = F.when(F.col("is_sub"), F.concat("session", F.lit("/subagents"))).otherwise(F.col("path"))
    rows = rows.select(key.alias("path"), F.struct(when.alias("t"), F.col("path").alias("p"), F.col("line_no").alias("n")).alias("ord"), "raw", record.alias("record_id"), F.regexp_extract("project", r"([^/]+)$", 1).alias("grouping"))
    return assemble(rows).where("usage.assistant_turns > 0")


def assemble(rows: DataFrame) -> DataFrame:
    """Records from (path, ord, raw, record_id, grouping).

    The last result of a call id counts; times: the first by order and the
    latest; user texts and assistant texts join without separator, thoughts by
    lines; a call has status ``success`` once it has a result.
    """
    v = F.col("v")
    e = B.parsed(rows).select("path", "ord", "record_id", "grouping", "v", B.s(v, "$.type").alias("type"), B.time_at(v, "$.timestamp").alias("at"))
    blocks = B.arr(v, "$.message.content")
    found = e.where("type = 'user'").select("path", "ord", "v", F.posexplode(F.filter(blocks, B.is_type("tool_result"))).alias("k", "b"))
    content = B.arr(F.col("b"), "$.content")
    typed = F.when(F.size(content) > 0, F.transform(content, lambda c: B.block(B.s(c, "$.type"), text=B.s(c, "$.text")))).when(B.s(F.col("b"), "$.content") != "", F.array(B.block(F.lit("text"), text=B.s(F.col("b"), "$.content"))))
    joined = F.coalesce(F.array_join(F.filter(F.transform(typed, lambda c: c["text"]), lambda t: t != ""), "\n"), F.lit(""))
    raw = F.when(F.schema_of_variant(B.sub(v, "$.toolUseResult")).startswith("OBJECT<") & (F.to_json(B.sub(v, "$.toolUseResult")) != "{}"), B.json_at(v, "$.toolUseResult"))
    results = found.select("path", B.s(F.col("b"), "$.tool_use_id").alias("id"), F.struct("ord", "k").alias("o"), B.output(joined, typed, raw).alias("out"))
    results = results.groupBy("path", "id").agg(F.max_by("out", "o").alias("out")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("id", "out"))).alias("results"))
    e = e.join(results, "path", "left").withColumn("results", F.coalesce("results", F.map_from_arrays(F.array(), F.array()).cast(f"map<string,{B.schema.OUTPUT}>")))

    def calls(b):  # noqa: ANN001, ANN202
        out = F.col("results")[B.s(b, "$.id")]
        return B.call(B.s(b, "$.name"), B.json_at(b, "$.input"), out, F.when(out.isNotNull(), "success").otherwise(""))

    user_text = F.when(F.schema_of_variant(B.sub(v, "$.message.content")) == "STRING", F.try_variant_get(v, "$.message.content", "string")).otherwise(B.texts(blocks, "text", "", "$.text"))
    turn = F.when(F.col("type") == "user", B.turn(F.lit("user"), F.col("at"), user_text)).when(
        F.col("type") == "assistant",
        B.turn(F.lit("assistant"), F.col("at"), B.texts(blocks, "text", "", "$.text"), B.texts(blocks, "thinking", "\n", "$.thinking", "$.text"), F.transform(F.filter(blocks, B.is_type("tool_use")), calls)),
    )
    turns = e.select("path", "ord", turn.alias("turn")).where("turn is not null").where(F.when(F.col("turn.role") == "user", F.trim("turn.text") != "").otherwise(B.contentful()))
    assistant = F.col("type") == "assistant"
    tokens = lambda *paths: F.sum(F.when(assistant, sum((B.number(v, f"$.message.usage.{p}") for p in paths), F.lit(0))).otherwise(0))
    branch = B.s(v, "$.gitBranch")
    meta = e.groupBy("path").agg(
        F.first("record_id").alias("record_id"), F.first("grouping").alias("grouping"), B.first(F.col("at"), F.col("ord")).alias("started_at"), B.latest(F.col("at")).alias("ended_at"),
        B.first(B.s(v, "$.cwd"), F.col("ord")).alias("working_dir"), B.first(F.when(branch != "HEAD", branch).otherwise(""), F.col("ord")).alias("branch"),
        F.coalesce(F.nullif(B.first(F.when(assistant, B.s(v, "$.message.model")).otherwise(""), F.col("ord")), F.lit("")), F.lit("claudecode/unknown")).alias("model"),
        tokens("input_tokens", "cache_read_input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"),
    )
    return B.finish(meta, turns, "claudecode")
