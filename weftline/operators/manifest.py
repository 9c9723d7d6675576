"""Manifests of published sessions: reading, diff against the published state, merge, mix of redaction keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import parse_redaction_key, text
from ..session import stage, unstage

CONTENT = ("source_hash", "redaction_key", "redacted_hash")


def diff_unique(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(file, aligned_file, action, rule) of each local entry, where keys are unique on both sides.

    In order: same format and session id adopts the remote file and uploads
    only if the content differs; same file and content is kept; same content
    elsewhere adopts that file; the rest is uploaded. Three equi-joins.
    """
    session = lambda p: F.when((text(F.col(f"{p}session_id")) != "") & (text(F.col(f"{p}format")) != ""), F.concat_ws("|", F.col(f"{p}format"), F.col(f"{p}session_id")))
    content = lambda p: F.concat_ws("|", *[text(F.col(f"{p}{c}")) for c in CONTENT])
    r = remote.select(F.col("file").alias("r_file"), session("").alias("r_session"), content("").alias("r_content"))
    by_session = r.where("r_session is not null").select("r_session", F.col("r_file").alias("s_file"), F.col("r_content").alias("s_content"))
    by_file = r.select(F.col("r_file").alias("f_file"), F.col("r_content").alias("f_content"))
    by_content = r.where("r_content != '||'").groupBy("r_content").agg(F.max("r_file").alias("c_file"))
    rows = local.select("file", session("").alias("k"), content("").alias("c"))
    rows = rows.join(by_session, rows["k"] == by_session["r_session"], "left").join(by_file, rows["file"] == by_file["f_file"], "left").join(by_content, rows["c"] == by_content["r_content"], "left")
    rule = F.when(F.col("s_file").isNotNull(), 1).when(F.col("f_content") == F.col("c"), 2).when(F.col("c_file").isNotNull() & (F.col("c_file") != F.col("file")), 3).otherwise(4)
    aligned = F.when(rule == 1, F.col("s_file")).when(rule == 3, F.col("c_file")).otherwise(F.col("file"))
    upload = (rule == 4) | ((rule == 1) & (F.col("s_content") != F.col("c")))
    return rows.select("file", aligned.alias("aligned_file"), F.when(upload, "upload").otherwise("keep").alias("action"), rule.alias("rule"))


def diff_ordered(local: list[dict], remote: list[dict]) -> tuple[list[dict], list[dict], list[dict]]:
    """(to upload, to retain, aligned) for entry lists with repeated keys, in list order; a remote file is claimed once.

    For the few thousand entries of one publication; ``diff_unique`` is for tables.
    """
    content = lambda e: tuple(e.get(c) or "" for c in CONTENT)
    session = lambda e: (e["format"], e["session_id"]) if e.get("format") and e.get("session_id") else None
    by_file = {e["file"]: e for e in remote}
    by_content = {content(e): e for e in remote if any(content(e))}
    by_session = {session(e): e for e in remote if session(e)}
    claimed: set[str] = set()
    upload, aligned = [], []
    for e in local:
        same = by_session.get(session(e)) if session(e) else None
        twin = by_content.get(content(e))
        here = by_file.get(e["file"])
        if same is not None and same["file"] not in claimed:
            new, send = e | {"file": same["file"]}, content(same) != content(e)
        elif here is not None and content(here) == content(e):
            new, send = e, False
        elif twin is not None and twin["file"] != e["file"] and twin["file"] not in claimed:
            new, send = e | {"file": twin["file"]}, False
        else:
            new, send = e, True
        aligned.append(new)
        claimed.add(new["file"])
        if send:
            upload.append(new)
    return upload, [e for e in remote if e["file"] not in claimed], aligned


def diff(local: DataFrame, remote: DataFrame, order: Column) -> DataFrame:
    """(position, file, aligned_file, action, rule) of each local entry, for entries with repeated keys, in the order ``order``.

    As ``diff_unique``, but a remote file is claimed once, by the first local
    entry that adopts it: an entry whose file is claimed before it goes on to
    its next choice. Of remote entries with one key the last counts. Solved in
    rounds over tables: an entry takes a file once no earlier entry can still
    claim it, so every round settles at least all that wait for nobody.
    """
    key = lambda p="": F.when((text(F.col(f"{p}session_id")) != "") & (text(F.col(f"{p}format")) != ""), F.concat_ws("|", F.col(f"{p}format"), F.col(f"{p}session_id")))
    content = F.concat_ws("|", *[text(F.col(c)) for c in CONTENT])
    r = remote.select(order.alias("o"), text(F.col("file")).alias("file"), key().alias("k"), content.alias("c"))
    last = lambda of, name: r.where(f"{of} is not null").groupBy(of).agg(F.max_by(F.struct("file", "c"), "o").alias(name))
    mine = local.select(order.alias("o"), text(F.col("file")).alias("file"), key().alias("k"), content.alias("c"))
    rows = mine.join(last("k", "s"), "k", "left").join(last("file", "f"), "file", "left").join(last("c", "t").where("c != '||'"), "c", "left")
    option = lambda cond, file, rule, upload: F.when(cond, F.struct(file.alias("file"), F.lit(rule).alias("rule"), upload.alias("upload")))
    no, yes = F.lit(False), F.lit(True)
    options = F.array_compact(F.array(
        option(F.col("s").isNotNull(), F.col("s.file"), 1, F.col("s.c") != F.col("c")), option(F.col("f.c") == F.col("c"), F.col("file"), 2, no),
        option(F.col("t").isNotNull() & (F.col("t.file") != F.col("file")), F.col("t.file"), 3, no), option(yes, F.col("file"), 4, yes),
    ))
    # What stands after one's own file, which is taken without asking, is never reached.
    first_own = F.array_min(F.transform(F.filter(options, lambda x: x["rule"].isin(2, 4)), lambda x: x["rule"]))
    open_ = stage(rows.select("o", F.col("file").alias("own"), F.filter(options, lambda x: x["rule"] <= first_own).alias("left")))
    done = []
    while not open_.isEmpty():
        may = open_.select("o", F.explode("left").alias("x")).select("o", "x.file").groupBy("file").agg(F.min("o").alias("first"))
        now = open_.withColumn("want", F.col("left")[0]).join(may, F.col("want.file") == may["file"], "left")
        ready = F.col("want.rule").isin(2, 4) | (F.col("first") >= F.col("o"))
        taken = stage(now.where(ready).select("o", "own", F.col("want.file").alias("aligned_file"), F.col("want.rule").alias("rule"), F.col("want.upload").alias("upload")))
        claims = taken.groupBy("aligned_file").agg(F.min("o").alias("claimed")).withColumnRenamed("aligned_file", "cfile")
        rest = open_.join(taken.select("o"), "o", "left_anti").select("o", "own", F.posexplode("left").alias("i", "x")).join(claims, F.col("x.file") == claims["cfile"], "left")
        # A choice that was claimed before is gone; one's own file stays.
        kept = rest.where("x.rule in (2, 4) or claimed is null or claimed > o").groupBy("o", "own").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a"))
        new = stage(kept.select("o", "own", F.transform("a", lambda z: z["x"]).alias("left")))
        unstage(open_)
        open_, done = new, [*done, taken]
    out = done[0] if done else None
    for d in done[1:]:
        out = out.unionByName(d)
    if out is None:
        return local.sparkSession.createDataFrame([], "position long, file string, aligned_file string, action string, rule long")
    return out.select(F.col("o").cast("long").alias("position"), F.col("own").alias("file"), "aligned_file", F.when(F.col("upload"), "upload").otherwise("keep").alias("action"), F.col("rule").cast("long").alias("rule"))


def retained(remote: DataFrame, aligned: DataFrame) -> DataFrame:
    """The remote entries whose file no local entry has taken."""
    return remote.join(aligned.select(F.col("aligned_file").alias("file")).distinct(), "file", "left_anti")


def merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local entries, and the remote ones whose file no local entry has."""
    return local.unionByName(remote.join(local.select("file").distinct(), "file", "left_anti"))


def key_mix(entries: DataFrame) -> DataFrame:
    """(redaction_key, images, sessions): how many sessions each key has, with its image policy (``unknown`` if malformed)."""
    images = F.coalesce(parse_redaction_key(F.col("redaction_key"))["images"], F.lit("unknown"))
    return entries.groupBy(F.coalesce("redaction_key", F.lit("")).alias("redaction_key"), images.alias("images")).agg(F.count(F.lit(1)).alias("sessions"))


def by_format(entries: DataFrame) -> DataFrame:
    return entries.groupBy("format").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def preflight(entries: DataFrame) -> DataFrame:
    """One row: how many keys there are, how many entries have a malformed one, and whether a publication may go on."""
    bad = parse_redaction_key(F.col("redaction_key")).isNull()
    rows = entries.agg(F.count_distinct("redaction_key").alias("keys"), F.count_if(bad).alias("malformed"))
    return rows.withColumn("ok", (F.col("keys") == 1) & (F.col("malformed") == 0))


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, entries) of a JSONL manifest; raises on a missing, second or late header and on unknown kinds.

    Blank lines are skipped. Only the header and one row of error counts come to the driver.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("trim(line) != ''")
    kinds = lines.select("line_no", "line", F.get_json_object("line", "$.kind").alias("kind"))
    facts = kinds.agg(F.count_if(F.col("kind") == "header").alias("headers"), F.min(F.when(F.col("kind") == "header", F.col("line_no"))).alias("first"), F.min(F.when(F.col("kind") == "session", F.col("line_no"))).alias("session"), F.count_if(~F.coalesce(F.col("kind"), F.lit("")).isin("header", "session")).alias("unknown")).first()
    if not facts["headers"]:
        raise ValueError("the manifest has no header")
    if facts["headers"] > 1:
        raise ValueError("the manifest has a second header")
    if facts["session"] is not None and facts["session"] < facts["first"]:
        raise ValueError("a session stands before the header")
    if facts["unknown"]:
        raise ValueError("the manifest has a line of unknown kind")
    import json

    header = json.loads(kinds.where("kind = 'header'").first()["line"])
    schema = "file string, format string, session_id string, source_hash string, redaction_key string, redacted_hash string, lines bigint, turns bigint"
    return header, kinds.where("kind = 'session'").select(F.from_json("line", schema).alias("e")).select("e.*")
