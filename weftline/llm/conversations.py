"""Rebuilding conversations from message rows.

Rows that lack a session id hang on their file and on the unique call ids they
quote; sessions, such files and such calls are nodes of a graph. Its
components, found by alternating large-star and small-star joins, are the
conversations; a session that nothing ties to another is one by itself. A
conversation's messages are ordered by (time of its file, line) and validated
by aggregates that combine map-side, so one session holding a large share of
the rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import timestamps
from ..session import stage, unstage

CALLS = ("function_call", "custom_tool_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")
#: A quoted id links rows across sessions only if it cannot repeat by chance: at least this many hex digits.
UNIQUE_ID = r"^call_[0-9a-f]{16,}$"


#: At most this many nodes can each have more than 1/HUBS of all edge ends: the size bound of a broadcast.
HUBS = 10_000


def _to_lowest(ends: DataFrame) -> DataFrame:
    """(u, v, m): edges ``ends`` (u, v) with the smallest neighbour m of u; hubs get it by broadcast, so no join key is hot."""
    low = stage(ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    total = low.agg(F.sum("n")).first()[0] or 0
    hub = F.col("n") > F.lit(total / HUBS)
    hubs = F.broadcast(low.where(hub).select("u", F.col("m").alias("h")))
    marked = ends.join(hubs, "u", "left")
    rest = marked.where("h is null").select("u", "v").join(low.where(~hub).select("u", "m"), "u")
    return marked.where("h is not null").select("u", "v", F.col("h").alias("m")).unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph; the component is its smallest node.

    Alternates large-star (larger neighbours move to the smallest one) and
    small-star (a node and its smaller neighbours move to the smallest) until
    the edges no longer change. A node's neighbourhood is only reduced to its
    minimum, never collected, and the edges are written every round. Null ends
    are ignored; a node without edges needs a loop (a, a) to appear.
    """
    all_ = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    nodes = all_.select(F.col("u").alias("node")).unionByName(all_.select(F.col("v").alias("node"))).distinct()
    e = all_.where("u != v")
    staged, mark = None, None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        down = stage(large.distinct().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v"))
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = _to_lowest(down).select(pair.alias("x")).select("x.*").where("u != v")
        new = stage(small.distinct())
        unstage(down, *([staged] if staged is not None else []))
        staged = e = new
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def message_text(payload: Column) -> Column:
    """Text of a message payload (JSON): its string content or the joined texts of its blocks; null if it has none."""
    content = F.get_json_object(payload, "$.content")
    blocks = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.when(F.ltrim(content).startswith("["), F.coalesce(joined, content)).otherwise(content)


def parsed(codex: DataFrame) -> DataFrame:
    """The fields the operator needs of each row, without the payload.

    kind: ``message`` (of user or assistant, text not blank), ``call``,
    ``output`` or null for rows that only carry time. Broken and null payloads
    give null kinds.
    """
    p = F.col("p")
    fields = F.from_json("payload", "struct<type:string,role:string,call_id:string,id:string>")
    text = message_text(F.col("payload"))
    filled = F.coalesce(timestamps.strip(text) != "", F.lit(False))
    item = F.col("type") == "response_item"
    kind = (
        F.when(item & (p["type"] == "message") & p["role"].isin("user", "assistant"), F.when(filled, "message"))
        .when(item & p["type"].isin(*CALLS), "call")
        .when(item & p["type"].isin(*OUTPUTS), "output")
    )
    session = timestamps.strip(F.col("session_id"))
    return codex.withColumn("p", fields).select(
        "row_id", F.when(session != "", session).alias("session_id"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line_no", F.lit(-1)).alias("line_no"),
        "timestamp", "client_tz", "ingested_at", kind.alias("kind"), p["role"].alias("role"), p["call_id"].alias("call_id"),
        F.when(F.col("type") == "session_meta", p["id"]).alias("meta_id"),
    )


def file_times(rows: DataFrame) -> DataFrame:
    """(conversation_id, file, at) of conversations of several files: the earliest unambiguous instant of a file's rows, else the earliest arrival.

    The order of files says nothing in a conversation of one file, so only the
    rows of the others are read for their time.
    """
    files = rows.select("conversation_id", "file").distinct()
    several = files.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conversation_id")
    read = timestamps.with_readings(rows.join(several, "conversation_id", "left_semi"), "timestamp", "client_tz")
    times = timestamps.instants(F.col("readings"))
    one = F.when(F.size(times) == 1, times[0])
    found = read.select("conversation_id", "file", one.alias("t"), F.unix_seconds(F.col("ingested_at").cast("timestamp")).alias("i"))
    return found.groupBy("conversation_id", "file").agg(F.coalesce(F.min("t"), F.min("i"), F.lit(0)).alias("at"))


def identify(rows: DataFrame) -> DataFrame:
    """(node, component) over session, file and unique call nodes that are tied; nodes are prefixed ``s:``, ``f:``, ``c:``.

    Only files that rows without session or more than one session lie in, and
    calls that rows without session quote, tie anything; all links are reduced
    to distinct pairs first. Only ids that cannot repeat by chance link rows of
    different sessions.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    session, lost = rows.where("session_id is not null"), rows.where("session_id is null")
    pairs = rows.where("file != ''").select("file", "session_id").distinct()
    tied = pairs.groupBy("file").agg(F.min("session_id").alias("a"), F.max("session_id").alias("z"), F.count_if(F.col("session_id").isNull()).alias("n")).where("a != z or n > 0").select("file")
    by_file = pairs.join(tied, "file", "left_semi").select(F.coalesce(node("s", "session_id"), node("f", "file")).alias("a"), node("f", "file").alias("b"))
    quoted = lost.where(F.col("call_id").rlike(UNIQUE_ID)).select("call_id", F.when(F.col("file") != "", node("f", "file")).otherwise(node("c", "call_id")).alias("a")).distinct()
    calls = quoted.select("call_id").distinct()
    callers = session.where(F.col("call_id").rlike(UNIQUE_ID)).join(calls, "call_id", "left_semi").select(node("s", "session_id").alias("a"), node("c", "call_id").alias("b")).distinct()
    lost_calls = quoted.select("a", node("c", "call_id").alias("b"))
    return connected_components(by_file.unionByName(callers).unionByName(lost_calls))


def _named(node: str) -> Column:
    """Session id of a session node."""
    return F.regexp_replace(node, "^s:", "")


def _node() -> Column:
    """The node a row hangs on: its session, else its file, else the unique call it quotes; null if it has none."""
    of = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    return F.when(F.col("session_id").isNotNull(), of("s", "session_id")).when(F.col("file") != "", of("f", "file")).when(F.col("call_id").rlike(UNIQUE_ID), of("c", "call_id"))


def conversation_nodes(names: DataFrame) -> DataFrame:
    """(node, conversation_id, lost): the smallest session id of the node's component; a component without a session (lost) bears the name of its smallest node."""
    named = names.where("node like 's:%'").groupBy("component").agg(F.min(_named("node")).alias("conversation_id"))
    found = names.join(named, "component", "left")
    return found.select("node", F.coalesce("conversation_id", "component").alias("conversation_id"), F.col("conversation_id").isNull().alias("lost"))


def with_conversation(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (with ``node``) with their conversation_id, that of their node's component or their own session's, and whether it is a lost one.

    It is null for rows without session, file and unique call: none of them can be told to belong to another.
    """
    found = rows.join(nodes, "node", "left") if not nodes.isEmpty() else rows.withColumns({"conversation_id": F.lit(None).cast("string"), "lost": F.lit(False)})
    return found.withColumns({"conversation_id": F.coalesce("conversation_id", "session_id"), "lost": F.coalesce("lost", F.lit(False))})


def validate(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(conversation_id, lost, reason) of each conversation, by its rows that have a session id, or by all if none has; reason null for the sound ones.

    All tests are minima and maxima, which repeated deliveries don't change.
    Lines compare within a file as they are; file times are joined only for
    the few calls that more than one file mentions.
    """
    rows = rows.where("session_id is not null or lost")
    by_file = rows.groupBy("conversation_id", "file").agg(
        F.bool_and("lost").alias("lost"),
        F.max(F.when(F.col("kind") == "message", F.struct("line_no", "role"))).alias("last"),
        F.max((F.col("kind") == "message").cast("int")).alias("any"), F.max(((F.col("kind") == "message") & (F.col("role") == "user")).cast("int")).alias("user"),
    )
    sessions = by_file.join(files, ["conversation_id", "file"], "left").groupBy("conversation_id").agg(
        F.bool_and("lost").alias("lost"),
        F.max(F.when(F.col("last").isNotNull(), F.struct("at", "file", "last"))).alias("last"),
        F.coalesce(F.max("any"), F.lit(0)).alias("any"), F.coalesce(F.max("user"), F.lit(0)).alias("user"),
    )
    tools = rows.where("kind in ('call', 'output')")
    unanswered = tools.where("call_id is null").select("conversation_id").distinct()
    of = lambda kind, how: how(F.when(F.col("kind") == kind, F.col("line_no")))
    ends = tools.where("call_id is not null").groupBy("conversation_id", "call_id", "file").agg(
        of("call", F.min).alias("c0"), of("call", F.max).alias("c1"), of("output", F.min).alias("o0"), of("output", F.max).alias("o1"),
    )
    files_of = ends.groupBy("conversation_id", "call_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.min("o0").alias("o0"), F.max("o1").alias("o1"),
    )
    sound = F.coalesce((F.col("c0") < F.col("o0")) & (F.col("c1") < F.col("o1")), F.lit(False))
    broken = files_of.where((F.col("n") == 1) & ~sound).select("conversation_id").distinct()
    spread = ends.join(files_of.where("n > 1").select("conversation_id", "call_id"), ["conversation_id", "call_id"]).join(files, ["conversation_id", "file"], "left")
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct("at", "file", F.col(c)))
    spread = spread.groupBy("conversation_id", "call_id").agg(*[f(place(c)).alias(c) for c, f in (("c0", F.min), ("c1", F.max), ("o0", F.min), ("o1", F.max))])
    broken = broken.unionByName(spread.where(~sound).select("conversation_id")).unionByName(unanswered).distinct().withColumn("broken", F.lit(True))
    reason = (
        F.when(F.col("any") == 0, "empty")
        .when(F.coalesce("broken", F.lit(False)) | (F.col("user") == 0), "broken")
        .when(F.col("last.last.role") == "user", "no_reply")
    )
    return sessions.join(broken, "conversation_id", "left").select("conversation_id", "lost", reason.alias("reason"))


def _rebuilt(codex: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their conversation, the tied nodes with theirs, the verdicts, and the times of the files that need one."""
    rows = stage(parsed(codex).withColumn("node", _node()))
    nodes = stage(conversation_nodes(identify(rows)))
    rows = with_conversation(rows, nodes)
    files = stage(file_times(rows.where("conversation_id is not null")))
    return rows, nodes, validate(rows, files), files


def dropped(codex: DataFrame) -> DataFrame:
    """(session_id, reason): the sessions of the conversations to drop, with the first reason that holds.

    A conversation is a session, or the sessions that files or quoted calls
    tie together; each of these has its verdict. Rows without session_id tie,
    but count for no reason; a conversation of such rows alone is judged by
    them, but is no session to report. An empty table gives no rows. Calls and outputs
    count whether or not their conversation has messages, but one without
    messages is ``empty`` first.
    """
    _, nodes, verdicts, _ = _rebuilt(codex)
    bad = stage(verdicts.where("reason is not null and not lost").drop("lost"))
    # A conversation bears the id of one of its sessions; the others are nodes of its component.
    others = nodes.where("node like 's:%'").select(_named("node").alias("session_id"), "conversation_id").where("session_id != conversation_id")
    return bad.select(F.col("conversation_id").alias("session_id"), "reason").unionByName(others.join(bad, "conversation_id").select("session_id", "reason"))


def messages(codex: DataFrame) -> DataFrame:
    """(conversation_id, session_id, position, role, text): the kept conversations' messages in order.

    A conversation bears its smallest session id. Rows without session_id join
    the conversation their file or quotes lead to; where that has no session it
    bears the name of its smallest node (``f:`` and a file, or ``c:`` and a
    call). A row without session, file and unique call would be a conversation
    of one message, which is always one to drop. Positions count from 0 in the conversation over (file time,
    file, line); they come from per-file offsets, so a long session is ordered
    file by file. Repeated deliveries count once.
    """
    rows, _, verdicts, files = _rebuilt(codex)
    bad = stage(verdicts.where("reason is not null").select("conversation_id"))
    texts = codex.where("type = 'response_item'").select("row_id", message_text(F.col("payload")).alias("text"))
    found = rows.where("kind = 'message' and conversation_id is not null").dropDuplicates(["row_id"]).select("row_id", "session_id", "file", "line_no", "role", "conversation_id")
    kept = stage(found.join(bad, "conversation_id", "left_anti").withColumn("chunk", F.floor(F.col("line_no") / 1000)))
    sizes = kept.groupBy("conversation_id", "file", "chunk").agg(F.count(F.lit(1)).alias("n")).join(files, ["conversation_id", "file"], "left")
    w = "partition by conversation_id order by at, file, chunk rows between unbounded preceding and 1 preceding"
    offsets = sizes.select("conversation_id", "file", "chunk", F.expr(f"coalesce(sum(n) over ({w}), 0)").alias("skip"))
    inner = F.expr("row_number() over (partition by conversation_id, file, chunk order by line_no, row_id)") - 1
    placed = kept.withColumn("k", inner).join(offsets, ["conversation_id", "file", "chunk"])
    placed = placed.select("conversation_id", "session_id", (F.col("skip") + F.col("k")).cast("long").alias("position"), "role", "row_id")
    return placed.join(texts.dropDuplicates(["row_id"]), "row_id").select("conversation_id", "session_id", "position", "role", "text")
