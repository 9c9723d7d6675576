"""Nested conversation records to flat, linked tables by structural variant.

A bottom-up tree automaton gives every object a state: which of its fields are
present and the states of its children, folded into a short variant name. The
automaton is finite, so there are at most a few hundred variants whatever the
data. Each item is routed to the table of its variant, which has the variant's
own typed columns beside the supertype's keys: record id, item kind, positions,
the link to the parent. The tables are the partitions of one write; an item's
supertype row is read back from them without its payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK
from ..session import scratch

BLOCK_FIELDS = ("type", "text", "media_type", "data", "url", "name")


def _state(letter: str, present: Column) -> Column:
    return F.when(present, letter).otherwise("")


def block_state(block: Column) -> Column:
    """State of a content block: the letters of its non-null fields, e.g. ``txm``; ``0`` if it has none."""
    letters = dict(zip(BLOCK_FIELDS, "txmdun"))
    state = F.concat(*[_state(c, block[f].isNotNull()) for f, c in letters.items()])
    return F.when(state == "", "0").otherwise(state)


def output_state(output: Column) -> Column:
    """State of a tool output: ``-`` for null, else text/content/raw; its blocks' states fold to none, text alone (``t``), data or url alone (``m``), or both (``b``)."""
    blocks = F.filter(output["content"], lambda b: b.isNotNull())
    texts, media = F.exists(blocks, lambda b: b["text"].isNotNull()), F.exists(blocks, lambda b: b["data"].isNotNull() | b["url"].isNotNull())
    inside = F.when(texts & media, "b").when(texts, "t").when(media, "m").otherwise("")
    content = F.when(output["content"].isNull(), "").otherwise(F.concat(F.lit("c["), inside, F.lit("]")))
    return F.when(output.isNull(), "-").otherwise(F.concat(_state("t", output["text"].isNotNull()), content, _state("r", output["raw"].isNotNull())))


def call_state(call: Column) -> Column:
    """State of a tool call: input kind, output state and status presence."""
    first = F.substring(F.ltrim(call["input"]), 1, 1)
    kind = F.when(call["input"].isNull(), "0").when(first == "{", "o").when(first == "[", "a").when(first == '"', "s").otherwise("p")
    return F.concat(_state("n", call["tool"].isNotNull()), F.lit("i"), kind, F.lit("("), output_state(call["output"]), F.lit(")"), _state("s", call["status"].isNotNull()))


def _turns(records: DataFrame, *keep: str) -> DataFrame:
    return records.select("record_id", *keep, F.posexplode("turns").alias("turn_no", "turn")).where("turn is not null").withColumn("turn_no", F.col("turn_no").cast("long"))


def turns_table(records: DataFrame) -> DataFrame:
    """One row per non-null turn; ``n_calls`` and ``n_attachments`` count non-null elements, -1 for a null list."""
    count = lambda a: F.when(F.col(a).isNull(), -1).otherwise(F.size(F.filter(F.col(a), lambda x: x.isNotNull())))
    return _turns(records).select(
        "record_id", "turn_no", "turn.role", "turn.timestamp", "turn.text", "turn.reasoning", "turn.extensions",
        count("turn.tool_calls").cast("long").alias("n_calls"), count("turn.attachments").cast("long").alias("n_attachments"),
    ).distinct()


def calls_table(records: DataFrame) -> DataFrame:
    """One row per non-null tool call with its variant; links: (record_id, turn_no)."""
    calls = _turns(records).select("record_id", "turn_no", F.posexplode("turn.tool_calls").alias("call_no", "call")).where("call is not null")
    return calls.select(
        "record_id", "turn_no", F.col("call_no").cast("long").alias("call_no"), call_state(F.col("call")).alias("variant"),
        "call.tool", "call.input", "call.status", F.col("call.output").isNotNull().alias("has_output"),
        F.col("call.output.text").alias("output_text"), F.col("call.output.raw").alias("output_raw"),
    ).distinct()


def _blocks(records: DataFrame) -> DataFrame:
    calls = _turns(records).select("record_id", "turn_no", F.posexplode("turn.tool_calls").alias("call_no", "call")).where("call is not null")
    outs = calls.select("record_id", "turn_no", "call_no", F.posexplode("call.output.content").alias("item_no", "block")).where("block is not null")
    return outs.select("record_id", "turn_no", F.lit("output_block").alias("item"), F.col("call_no").cast("long").alias("call_no"), F.col("item_no").cast("long").alias("item_no"), "block")


def _attachments(records: DataFrame) -> DataFrame:
    rows = _turns(records).select("record_id", "turn_no", F.posexplode("turn.attachments").alias("item_no", "block")).where("block is not null")
    return rows.select("record_id", "turn_no", F.lit("attachment").alias("item"), F.lit(-1).cast("long").alias("call_no"), F.col("item_no").cast("long").alias("item_no"), "block")


def blocks_table(records: DataFrame) -> DataFrame:
    """One row per non-null output block and attachment with its variant and fields."""
    both = _blocks(records).unionByName(_attachments(records))
    return both.select("record_id", "turn_no", "item", "call_no", "item_no", block_state(F.col("block")).alias("variant"), *[F.col(f"block.{f}").alias(f) for f in BLOCK_FIELDS]).distinct()


KEYS = ("record_id", "turn_no", "item", "call_no", "item_no")
_CALL = "struct<tool:string,input:string,status:string,output_text:string,output_raw:string>"


def _routable(records: DataFrame) -> DataFrame:
    """All items in one pass: supertype keys, variant, and the payload of a call or a block."""
    none = F.array().cast(f"array<struct<item:string,call_no:bigint,item_no:bigint,variant:string,call:{_CALL},block:{BLOCK}>>")
    turn = F.col("turn")

    def item(kind: str, call_no: Column, item_no: Column, variant: Column, call: Column | None = None, block: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("item"), call_no.cast("long").alias("call_no"), item_no.cast("long").alias("item_no"), variant.alias("variant"),
            (F.lit(None).cast(_CALL) if call is None else call).alias("call"), (F.lit(None).cast(BLOCK) if block is None else block).alias("block"),
        )

    def of_call(c: Column, i: Column) -> Column:
        flat = F.struct(c["tool"].alias("tool"), c["input"].alias("input"), c["status"].alias("status"), c["output"]["text"].alias("output_text"), c["output"]["raw"].alias("output_raw"))
        return F.when(c.isNotNull(), item("tool_call", F.lit(-1), i, call_state(c), call=flat))

    def of_blocks(kind: str, call_no: Column, blocks: Column) -> Column:
        return F.coalesce(F.transform(blocks, lambda b, i: F.when(b.isNotNull(), item(kind, call_no, i, block_state(b), block=b))), none)

    calls = F.coalesce(F.transform(turn["tool_calls"], of_call), none)
    outs = F.coalesce(F.flatten(F.transform(turn["tool_calls"], lambda c, i: of_blocks("output_block", i, c["output"]["content"]))), none)
    rows = _turns(records).select("record_id", "turn_no", F.explode(F.concat(calls, outs, of_blocks("attachment", F.lit(-1), turn["attachments"]))).alias("x"))
    return rows.where("x is not null").select("record_id", "turn_no", "x.*")


#: Rows of one variant are spread over so many tasks of the write, so that no variant is one task's alone.
SPREAD = 16


class Subtypes:
    """The typed subtype tables of a folder: one per (item, variant), a partition each."""

    def __init__(self, records: DataFrame, path: str | None = None) -> None:
        """Route every item of ``records`` to its variant's table, under ``path`` or in the shared folder."""
        self.spark, self.path = records.sparkSession, path or scratch(records.sparkSession, "subtypes")
        rows = _routable(records)
        self.schema = rows.schema
        spread = F.pmod(F.xxhash64("record_id"), F.lit(SPREAD))
        rows.repartition("item", "variant", spread).write.mode("overwrite").partitionBy("item", "variant").parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def supertype(self) -> DataFrame:
        """The common supertype table: the keys of all items and their variants; repeated deliveries are still there."""
        return self._all().select(*KEYS, "variant")

    def variants(self) -> list[tuple[str, str]]:
        """(item, variant) of the tables there are; the automaton has a few hundred states at most."""
        return sorted((r[0], r[1]) for r in self._all().select("item", "variant").distinct().collect())

    def table(self, item: str, variant: str) -> DataFrame:
        """One subtype table: supertype keys and the variant's own columns, typed; each item once.

        A call's input is a JSON value (variant type) if it is an object or
        array, a string, number or boolean by its kind; absent fields have no column.
        """
        rows = self._all().where((F.col("item") == item) & (F.col("variant") == variant))
        keys = [F.col(k) for k in ("record_id", "turn_no", "call_no", "item_no")]
        if item != "tool_call":
            letters = dict(zip("txmdun", BLOCK_FIELDS))
            return rows.select(*keys, *[F.col(f"block.{f}").alias(f) for letter, f in letters.items() if letter in variant]).dropDuplicates(["record_id", "turn_no", "call_no", "item_no"])
        head, _, out = variant.partition("(")
        out, _, tail = out.rpartition(")")
        kind, text = head[-1], F.col("call.input")
        json = F.try_parse_json(text)
        value = {"o": json, "a": json, "s": F.try_variant_get(json, "$", "string"), "p": text}.get(kind)
        columns = ([F.col("call.tool").alias("tool")] if head.startswith("n") else []) + ([value.alias("input")] if value is not None else [])
        columns += [F.col("call.status").alias("status")] if tail == "s" else []
        columns += [F.col("call.output_text").alias("output_text")] if out.startswith("t") else []
        columns += [F.try_parse_json("call.output_raw").alias("output_raw")] if out.endswith("r") else []
        return rows.select(*keys, *columns).dropDuplicates(["record_id", "turn_no", "call_no", "item_no"])


def items_found(records: DataFrame) -> DataFrame:
    """The supertype table of the routed subtypes: every non-null tool call, output block and attachment once, with its links.

    Null turns, calls, blocks and lists give no rows but keep their positions;
    a record delivered twice counts once; an empty table gives no rows.
    """
    return Subtypes(records).supertype().select(*KEYS).distinct()


def variant_counts(records: DataFrame) -> DataFrame:
    """How many items each subtype table holds (deliveries of one item counted once)."""
    return Subtypes(records).supertype().distinct().groupBy("item", "variant").agg(F.count(F.lit(1)).alias("n"))


def route(records: DataFrame, path: str) -> Subtypes:
    """Write under ``path`` the turns, the calls and blocks by variant, and the typed subtype tables, which are returned."""
    turns_table(records).write.mode("overwrite").parquet(f"{path}/turns")
    calls_table(records).write.mode("overwrite").partitionBy("variant").parquet(f"{path}/tool_calls")
    blocks_table(records).write.mode("overwrite").partitionBy("item", "variant").parquet(f"{path}/blocks")
    return Subtypes(records, f"{path}/items")
