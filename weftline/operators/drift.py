"""Schemas that drift between files: one consistent table and a log of changes.

Every line contributes the JSON types it shows at each path; a type set is an
element of a lattice (union is the join), so lines fold into files and files
into stores in any order, map-side first. The file's fold is compared with the
store's baseline and each departure is reported. Lines are parsed inside one
Arrow pass whose output is small: distinct facts per batch, not rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, stage

#: Bits of the type lattice.
TYPES = ("string", "number", "boolean", "object", "array")
_BIT = {t: 1 << k for k, t in enumerate(TYPES)}
#: Bits beside the lattice for the union schema: numbers that a long, or a double, does not hold exactly.
_NO_LONG, _NO_DOUBLE = 32, 64
#: Objects with more distinct names (maps keyed by data) and containers deeper than this come whole as JSON text.
MOST_NAMES, DEEPEST = 500, 12
FACTS = "file_id long, store string, field_path string, types int, value string"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse(raw: str | None) -> object:
    """The JSON object of a line; None for a null, blank, cut or non-object line."""
    if not raw:
        return None
    try:
        value = json.loads(raw, parse_constant=_no_constant)
        if "\\ud" in raw or "\\uD" in raw:  # half surrogates, which escapes can spell, become question marks
            value = json.loads(json.dumps(value, ensure_ascii=False).encode("utf-8", "replace"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _escaped(key: str) -> str:
    """A key as a step of an unambiguous path: not empty, without dots and brackets."""
    return key.replace("~", "~0").replace(".", "~1").replace("[", "~2").replace("]", "~3") or "~4"


def _unescaped(key: str) -> str:
    return key.replace("~4", "").replace("~3", "]").replace("~2", "[").replace("~1", ".").replace("~0", "~")


def _number_bits(v: float) -> int:
    if isinstance(v, float):
        return _BIT["number"] | _NO_LONG
    return _BIT["number"] | (0 if -(2**63) <= v < 2**63 else _NO_LONG) | (0 if abs(v) <= 2**53 else _NO_DOUBLE)


def observe_exact(value: dict) -> set[tuple[str, int, None]]:
    """As ``observe``, with escaped keys, number bits and nothing below ``DEEPEST``."""
    out: set[tuple[str, int, None]] = set()
    todo: list[tuple[str, object, int]] = [("", value, 0)]
    while todo:
        path, at, depth = todo.pop()
        steps = [(f"{path}.{_escaped(k)}" if depth else _escaped(k), v) for k, v in at.items()] if isinstance(at, dict) else [(f"{path}[]", v) for v in at]
        for p, v in steps:
            kind = json_type(v)
            if kind is None:
                continue
            out.add((p, _number_bits(v) if kind == "number" else _BIT[kind], None))
            if kind in ("object", "array") and depth + 1 < DEEPEST:
                todo.append((p, v, depth + 1))
    return out


def json_type(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def observe(value: object, listed: frozenset[str]) -> set[tuple[str, int, str | None]]:
    """(path, type bit, string at a path with listed values) of one parsed line; JSON nulls show nothing."""
    out: set[tuple[str, int, str | None]] = set()
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        path, at = todo.pop()
        if isinstance(at, dict):
            children = [(f"{path}.{k}" if path else k, v) for k, v in at.items()]
        else:
            children = [(f"{path}[]", v) for v in at]
        for p, v in children:
            kind = json_type(v)
            if kind is None:
                continue
            out.add((p, _BIT[kind], v if kind == "string" and p in listed else None))
            if kind in ("object", "array"):
                todo.append((p, v))
    return out


def facts(lines: DataFrame, listed: dict[str, list[str]], exact: bool = False) -> DataFrame:
    """Distinct (file_id, store, field_path, types, value) facts of all parseable lines; ``exact`` takes those of ``observe_exact``.

    ``listed`` names the paths per store whose string values matter (the
    baseline's discriminators, so its size is the baseline's). Facts repeat
    within an Arrow batch at most; the following fold removes the rest.
    """
    want = {s: frozenset(p) for s, p in listed.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()
            for file_id, store, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                value = parse(raw)
                if value is not None:
                    seen.update((file_id, store, *x) for x in (observe_exact(value) if exact else observe(value, want.get(store, frozenset()))))
            cols = list(zip(*seen)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["file_id", "store", "field_path", "types", "value"])

    return lines.select("file_id", "store", "raw").mapInArrow(run, FACTS)


def baseline(store_fields: DataFrame) -> DataFrame:
    """The baseline with parents, allowed type bits and value lists, one row per (store, path)."""
    bits = F.aggregate(
        F.split("json_type", r"\|"), F.lit(0),
        lambda acc, t: acc.bitwiseOR(F.coalesce(F.create_map(*[F.lit(x) for kv in _BIT.items() for x in kv])[F.trim(t)], F.lit(0))),
    )
    values = F.when(F.col("known_values").isNotNull(), F.transform(F.split("known_values", ","), F.trim))
    return store_fields.select("store", "field_path", bits.alias("allowed"), F.coalesce("required", F.lit(False)).alias("required"), values.alias("known")).dropDuplicates(["store", "field_path"])


def _with_parent(df: DataFrame) -> DataFrame:
    """Parent path ('' for the root) and the container the child needs there (object or array bit)."""
    element = F.col("field_path").endswith("[]")
    parent = F.when(element, F.expr("substring(field_path, 1, length(field_path) - 2)")).otherwise(F.regexp_replace("field_path", r"\.?[^.]*$", ""))
    return df.withColumn("parent", parent).withColumn("container", F.when(element, _BIT["array"]).otherwise(_BIT["object"]))


def changes(lines: DataFrame, store_fields: DataFrame) -> DataFrame:
    """(file_id, field_path, change): each file's departures from its store's baseline.

    ``lines`` has file_id, store and raw. A path counts only if its parent is
    the root or a baseline path seen in the file as a container the baseline
    allows. Files whose store has no baseline report every root field as
    ``added``. Rows without file_id are left out. Lines that do not parse,
    repeated lines and JSON nulls change nothing; an empty table gives no rows.
    """
    spec = baseline(store_fields)
    listed: dict[str, list[str]] = {}
    for row in spec.where("known is not null").select("store", "field_path").collect():  # the baseline is a small configuration table
        listed.setdefault(row[0], []).append(row[1])
    seen = (
        facts(lines.where("file_id is not null"), listed)
        .groupBy("file_id", "store", "field_path")
        .agg(F.bit_or("types").alias("types"), F.array_compact(F.collect_set("value")).alias("vals"))
    )
    # Read several times below: written once, so that the lines are parsed once.
    return _compare(stage(seen), spec)


def _compare(seen: DataFrame, spec: DataFrame) -> DataFrame:
    """Compare folded files with the baseline: equi-joins of (file, path) with (store, path) and with the parent's row."""
    seen = seen.withColumn("store", F.coalesce("store", F.lit("")))
    at = seen.join(spec, ["store", "field_path"], "left").withColumn("new", F.col("allowed").isNull())
    # Required paths of the store that the file does not show.
    needed = seen.select("file_id", "store").distinct().join(spec.where("required").select("store", "field_path", "allowed"), "store")
    gone = needed.join(seen.select("file_id", "field_path"), ["file_id", "field_path"], "left_anti").select("file_id", "field_path", "allowed", F.lit(True).alias("gone"))
    rows = at.withColumn("gone", F.lit(False)).select("file_id", "field_path", "types", "vals", "allowed", "known", "new", "gone")
    rows = _with_parent(rows.unionByName(gone.withColumn("new", F.lit(False)), allowMissingColumns=True))
    # A path counts below the root, and below baseline paths that the file shows as a container the baseline allows.
    open_ = at.where(F.col("types").bitwiseAND(F.col("allowed")).bitwiseAND(_BIT["object"] | _BIT["array"]) != 0).select("file_id", F.col("field_path").alias("parent"), F.col("types").bitwiseAND(F.col("allowed")).alias("inside"))
    shown = rows.join(open_, ["file_id", "parent"], "left").where((F.col("parent") == "") | F.coalesce(F.col("inside").bitwiseAND(F.col("container")) != 0, F.lit(False)))

    hit = lambda c: F.collect_list(F.when(F.col(c), F.struct("field_path", F.coalesce("types", F.lit(0)).alias("types"), F.coalesce("allowed", F.lit(0)).alias("allowed"))))
    moves = shown.where("gone or new").groupBy("file_id", "parent").agg(hit("gone").alias("gone"), hit("new").alias("new"))
    pair = (F.size("gone") == 1) & (F.size("new") == 1) & (F.col("gone")[0]["allowed"].bitwiseAND(F.col("new")[0]["types"]) != 0)
    of = lambda c, change: F.transform(F.col(c), lambda x: F.struct(x["field_path"].alias("field_path"), F.lit(change).alias("change")))
    moved = F.when(pair, of("gone", "renamed")).otherwise(F.concat(of("gone", "removed"), of("new", "added")))
    # One pass more over the paths that stay: their type and their values.
    retyped = F.when(F.col("types").bitwiseAND(F.bitwise_not(F.col("allowed"))) != 0, "retyped")
    unknown = F.when(F.col("known").isNotNull() & (F.size(F.array_except("vals", "known")) > 0), "new_value")
    kept = shown.where("not gone and not new").select("file_id", "field_path", F.explode(F.array_compact(F.array(retyped, unknown))).alias("change"))
    return moves.select("file_id", F.explode(moved).alias("x")).select("file_id", "x.*").unionByName(kept).distinct()


def change_log(lines: DataFrame, store_fields: DataFrame) -> DataFrame:
    """(store, first_seen, file_id, change_no, field_path, change): all changes in order of store, the file's first sight, file and path.

    ``change_no`` counts from 1 within a file. Files never seen at a known time come first.
    """
    first = lines.where("file_id is not null").groupBy("file_id").agg(F.min("store").alias("store"), F.min("seen_at").alias("first_seen"))
    number = F.expr("row_number() over (partition by file_id order by field_path, change)").cast("long")
    found = changes(lines, store_fields).withColumn("change_no", number)
    return found.join(first, "file_id").select("store", "first_seen", "file_id", "change_no", "field_path", "change").orderBy("store", "first_seen", "file_id", "change_no")


def _folded(lines: DataFrame, exact: bool = False) -> DataFrame:
    """(store, field_path, types, files, cast_to): all files' type sets joined, with the type values are cast to."""
    types = F.col("types").bitwiseAND(_NO_LONG - 1)
    one = F.bit_count(types) == 1
    scalar = types.bitwiseAND(_BIT["object"] | _BIT["array"]) == 0
    name = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.log2(types.cast("double")).cast("int") + 1)
    seen = facts(lines, {}, exact).groupBy("store", "field_path").agg(F.bit_or("types").alias("types"), F.count_distinct("file_id").alias("files"))
    return seen.withColumn("cast_to", F.when(one, name).when(scalar, "string").otherwise("json"))


def promoted_types(lines: DataFrame, store_fields: DataFrame) -> DataFrame:
    """The union schema: per store and path the join of all files' type sets and the type values are cast to.

    Promotion: one type stays; any mixture of scalars becomes ``string``;
    a mixture with a container stays JSON text (``json``).
    """
    return _folded(lines).select("store", "field_path", "cast_to", "files")


class Node:
    """A path of the union schema with the type its values are cast to; objects know their children by key, arrays by ``[]``."""

    def __init__(self, to: str) -> None:
        self.to, self.children = to, {}

    def close(self) -> Node:
        """Containers whose inside is not known, and all below a mixture, are JSON text."""
        if self.to not in ("object", "array"):
            self.children = {}
        elif not self.children:
            self.to = "json"
        for child in self.children.values():
            child.close()
        return self

    def named(self) -> list[tuple[str, str, Node]]:
        """(key, column, node) of an object's children; the columns differ when case is ignored."""
        keys = {_unescaped(k): n for k, n in sorted(self.children.items(), key=lambda x: x[0].swapcase())}
        taken: set[str] = set()
        out = []
        for key, node in keys.items():
            column, k = key or "_", 2
            while column.lower() in taken or k > 2 and column in keys:
                column, k = f"{key}~{k}", k + 1
            taken.add(column.lower())
            out.append((key, column, node))
        return out

    def spark(self) -> T.DataType:
        if self.to == "object":
            return T.StructType([T.StructField(c, n.spark()) for _, c, n in self.named()])
        if self.to == "array":
            return T.ArrayType(self.children["[]"].spark())
        return {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}.get(self.to, T.StringType())

    def arrow(self) -> pa.DataType:
        if self.to == "object":
            return pa.struct([pa.field(c, n.arrow()) for _, c, n in self.named()])
        if self.to == "array":
            return pa.list_(self.children["[]"].arrow())
        return {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}.get(self.to, pa.string())

    def caster(self) -> Callable[[object], object]:
        """A function from parsed JSON to the value of the column; nulls stay."""
        if self.to == "object":
            parts = [(key, column, node.caster()) for key, column, node in self.named()]
            return lambda v: None if v is None else {c: f(v.get(k)) for k, c, f in parts}
        if self.to == "array":
            item = self.children["[]"].caster()
            return lambda v: None if v is None else [item(x) for x in v]
        if self.to == "double":
            return lambda v: None if v is None else float(v)
        if self.to == "json":
            return lambda v: None if v is None else json.dumps(v, ensure_ascii=False)
        if self.to == "string":
            return lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        return lambda v: v


def union_schema(lines: DataFrame) -> Node:
    """The union schema of all stores as a tree, folded from ``promoted_types``' lattice; only paths come to the driver.

    Numbers are ``long`` if all are, else ``double`` if that holds them
    exactly, else text.
    """
    paths = cut(_folded(lines.withColumn("file_id", F.lit(0)).withColumn("store", F.lit("")), exact=True))
    up = F.regexp_replace("field_path", r"(\[\]|(^|\.)[^.\[\]]*)$", "")
    wide = paths.groupBy(up.alias("up")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_NAMES).select("up")
    under = (F.col("up") == "") | F.startswith("field_path", F.concat("up", F.lit("."))) | F.startswith("field_path", F.concat("up", F.lit("[")))
    rows = paths.join(F.broadcast(wide), under, "left_anti").select("field_path", "types", "cast_to").collect()
    root = Node("object")
    for path, types, to in sorted(map(tuple, rows)):
        if to == "number":
            to = "long" if not types & _NO_LONG else "double" if not types & _NO_DOUBLE else "string"
        at = root
        *above, last = [x for part in path.split(".") for x in re.findall(r"\[\]|^[^\[]*", part)]
        for x in above:
            at = at.children.setdefault(x, Node("json"))
        at.children.setdefault(last, Node(to)).to = to
    return root.close()


def consistent(lines: DataFrame) -> DataFrame:
    """All parseable lines of all stores as one table; a repeated line counts once.

    ``fields`` carries every field of every line, cast to the union schema of
    all lines: objects are structs, arrays arrays, mixtures with containers
    JSON text. Before it stand the fields common to the stores as text.
    Fields that some shapes lack are null.
    """
    schema = union_schema(lines)
    v = F.try_parse_json("raw")
    text = lambda *paths: F.coalesce(*[F.try_variant_get(F.col("v"), p, "string") for p in paths])
    rows = lines.withColumn("v", v).select(
        "file_id", "line_no", "store", "client_version", text("$.type").alias("type"), text("$.timestamp", "$.created").alias("timestamp"),
        text("$.payload.type", "$.message.content[0].type").alias("content_type"), text("$.payload.role", "$.message.role").alias("role"),
        text("$.payload.cwd", "$.cwd").alias("cwd"), text("$.payload.model", "$.message.model").alias("model"), text("$.id", "$.uuid", "$.payload.id").alias("id"), "raw",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cast, kind = schema.caster(), schema.arrow()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                values = [parse(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                out = batch.filter(pa.array([x is not None for x in values], pa.bool_()))
                fields = pa.array([cast(x) for x in values if x is not None], kind)
                yield pa.RecordBatch.from_arrays([*out.columns[:-1], fields], names=[*batch.schema.names[:-1], "fields"])

    kind = T.StructType([*rows.schema.fields[:-1], T.StructField("fields", schema.spark())])
    return rows.mapInArrow(run, kind).dropDuplicates(["file_id", "line_no"])
