"""P3, P6, P7: defined cases, hostile tables, brute force."""

import json
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
import tables
from pyspark.sql import functions as F

from weftline.operators import drift, nested, timestamps
from weftline.plans import general


@pytest.fixture(scope="module")
def hostile(spark, sf, tmp_path_factory):
    return tables.empty(spark, sf, tmp_path_factory.mktemp("empty")), tables.hard(spark, sf, tmp_path_factory.mktemp("hard"))


@pytest.mark.parametrize("name", list(general.QUERIES))
def test_hostile_tables(spark, sf, hostile, name):
    empty, hard = hostile
    assert general.QUERIES[name](spark, empty).count() == 0
    got = general.QUERIES[name](spark, hard)
    if name.endswith("_found"):
        assert got.count() == got.distinct().count()
        assert tables.rows(got) == tables.rows(general.QUERIES[name](spark, sf))
    else:
        got.count()


CASES = [
    ("2024-05-06T07:08:09Z", None, "2024-05-06T07:08:09Z"), (" 2024-05-06 07:08:09 ", "Asia/Tokyo", "2024-05-05T22:08:09Z"), ("2024-05-06T07:08Z", None, "2024-05-06T07:08:00Z"),
    ("2024-05-06T07:08:09,123Z", None, "2024-05-06T07:08:09Z"), ("2024-05-06T07:08:09+0530", None, "2024-05-06T01:38:09Z"), ("2024-05-06T07:08:09+09", None, "2024-05-05T22:08:09Z"),
    ("2024-05-06 07:08:09 GMT-3", None, "2024-05-06T10:08:09Z"), ("2024-05-06 07:08:09 Europe/Berlin", "UTC", "2024-05-06T05:08:09Z"), ("2024-05-06T07:08:09+02:00[Europe/Berlin]", None, "2024-05-06T05:08:09Z"),
    ("Mon, 06 May 2024 07:08:09 +0000", None, "2024-05-06T07:08:09Z"), ("6 May 2024 07:08:09 CEST", None, "2024-05-06T05:08:09Z"), ("May 6, 2024 12:08:09 AM", "UTC", "2024-05-06T00:08:09Z"),
    ("13/05/2024 07:08:09", "UTC", "2024-05-13T07:08:09Z"), ("05/06/2024 07:08:09", "UTC", ""), ("05/05/2024 07:08:09", "UTC", "2024-05-05T07:08:09Z"), ("06.05.2024 07:08:09", "UTC", "2024-05-06T07:08:09Z"),
    ("20240506T070809Z", None, "2024-05-06T07:08:09Z"), ("1714979289", None, "2024-05-06T07:08:09Z"), ("1714979289123", None, "2024-05-06T07:08:09Z"), ("1714979289123456789", None, "2024-05-06T07:08:09Z"), ("1714979289.5", None, "2024-05-06T07:08:09Z"),
    ("2024-03-31 02:30:00", "Europe/Berlin", ""), ("2024-10-27 02:30:00", "Europe/Berlin", ""), ("2024-10-27T02:30:00+01:00", "Europe/Berlin", "2024-10-27T01:30:00Z"),
    ("2024-05-06", None, ""), ("07:08:09", None, ""), ("0", None, ""), ("-1", None, ""), ("2024-02-30 10:00:00", None, ""), ("2024-05-06 24:00:00", None, ""), ("nope", None, ""), ("2024-05-06 07:08:09", "Not/AZone", ""), ("99999999999999999999999999", None, ""),
]


def test_readings(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, value string, zone string")
    times = timestamps.instants(F.col("readings"))
    got = dict(timestamps.with_readings(df, "value", "zone").select("i", F.when(F.size(times) == 1, timestamps.canonical(times[0])).otherwise("")).collect())
    assert [got[i] for i in range(len(CASES))] == [want for *_, want in CASES]


def test_local_times_against_zoneinfo(spark):
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata"]
    rows, want = [], []
    for z in zones:
        for base in (datetime(2024, 3, 10), datetime(2024, 3, 31), datetime(2024, 4, 7), datetime(2024, 10, 6), datetime(2024, 10, 27), datetime(2024, 11, 3)):
            for m in range(0, 300, 29):
                w = base + timedelta(minutes=m)
                rows.append((len(rows), f"{w:%Y-%m-%d %H:%M:%S}", z))
                both = {w.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(timezone.utc) for f in (0, 1)}
                real = {u for u in both if u.astimezone(ZoneInfo(z)).replace(tzinfo=None) == w}
                want.append(sorted(f"{u:%Y-%m-%dT%H:%M:%SZ}" for u in real))
    df = timestamps.with_readings(spark.createDataFrame(rows, "i int, value string, zone string"), "value", "zone")
    got = dict(df.select("i", F.array_sort(F.transform(timestamps.instants(F.col("readings")), timestamps.canonical))).collect())
    assert [got[i] for i in range(len(rows))] == want


def test_mixture_prefers_the_sources_format(spark):
    rows = [(str(i), f"{d}/03/2025 10:00:00", None, "a") for i, d in enumerate(range(13, 29))] + [("x", "05/03/2025 10:00:00", None, "a"), ("y", "05/03/2025 10:00:00", None, "b")]
    got = {r.id: r for r in timestamps.normalise(spark.createDataFrame(rows, "id string, value string, zone string, source string")).collect()}
    assert (got["x"].status, got["x"].utc, got["x"].best_utc) == ("ambiguous", "", "2025-03-05T10:00:00Z") and got["x"].posterior > 0.9
    assert 0.4 < got["y"].posterior < 0.6
    sure = timestamps.normalise(spark.createDataFrame(rows, "id string, value string, zone string, source string"), resolve_at=0.9).where("id = 'x'").first()
    assert sure.utc == "2025-03-05T10:00:00Z"


def test_found_times_need_no_mixture(spark, sf, monkeypatch):
    records, codex = spark.read.parquet(f"{sf}/records.parquet"), spark.read.parquet(f"{sf}/codex_session.parquet")
    values = timestamps.record_times(records).unionByName(timestamps.codex_times(codex)).where(F.col("value").isNotNull() & (timestamps.strip(F.col("value")) != "") & ~timestamps.is_canonical(F.col("value")))
    want = {tuple(r) for r in timestamps.normalise(values).select("tbl", "id", "turn_no", "utc").collect()}
    monkeypatch.setattr(timestamps, "format_mixture", lambda read: pytest.fail("a mixture was fitted that decides nothing"))
    assert {tuple(r) for r in timestamps.times_found(records, codex).collect()} == want


def test_items_against_python(spark, sf):
    want = set()
    for r in spark.read.parquet(f"{sf}/records.parquet").collect():
        for n, t in enumerate(r.turns or []):
            for i, c in enumerate((t and t.tool_calls) or []):
                if c is not None:
                    want.add((r.record_id, n, "tool_call", -1, i))
                    want |= {(r.record_id, n, "output_block", i, k) for k, b in enumerate((c.output and c.output.content) or []) if b is not None}
            want |= {(r.record_id, n, "attachment", -1, k) for k, b in enumerate((t and t.attachments) or []) if b is not None}
    assert {tuple(x) for x in nested.items_found(spark.read.parquet(f"{sf}/records.parquet")).collect()} == want


def test_subtype_tables_are_typed_and_whole(spark, sf, tmp_path):
    records = spark.read.parquet(f"{sf}/records.parquet")
    subtypes = nested.Subtypes(records, str(tmp_path / "items"))
    rows, seen = 0, set()
    for item, variant in subtypes.variants():
        t = subtypes.table(item, variant)
        rows += t.count()
        seen.add((item, variant))
        if item == "tool_call" and variant.startswith("nio"):
            assert dict(t.dtypes)["input"] == "variant"
        if item != "tool_call":
            assert {"data"} & set(t.columns) == ({"data"} if "d" in variant else set())
    assert rows == nested.items_found(records).count() and seen == {(r.item, r.variant) for r in nested.variant_counts(records).collect()}


def test_route_writes_subtype_tables(spark, sf, tmp_path):
    nested.route(spark.read.parquet(f"{sf}/records.parquet"), str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/blocks")
    assert back.count() == nested.blocks_table(spark.read.parquet(f"{sf}/records.parquet")).count() and "variant" in back.columns


def changes_in_python(lines, spec):
    base = {}
    for s in spec:
        base.setdefault(s.store, {})[s.field_path] = (set(s.json_type.split("|")), s.required, s.known_values.split(",") if s.known_values else None)
    files = {}
    for r in lines:
        v = drift.parse(r.raw)
        if v is not None:
            files.setdefault((r.file_id, r.store), []).append(v)
    out = set()
    for (file_id, store), docs in files.items():
        seen = {}

        def walk(path, value, seen=seen):
            kind = drift.json_type(value)
            if kind is None:
                return
            if path:
                seen.setdefault(path, (set(), set()))[0].add(kind)
                if kind == "string":
                    seen[path][1].add(value)
            for k, x in value.items() if kind == "object" else []:
                walk(f"{path}.{k}" if path else k, x)
            for x in value if kind == "array" else []:
                walk(f"{path}[]", x)

        for d in docs:
            walk("", d)
        b = base.get(store, {})

        def looked(p, b=b, seen=seen):
            up, need = (p[:-2], "array") if p.endswith("[]") else (p.rpartition(".")[0], "object")
            return up == "" or up in b and up in seen and need in seen[up][0] and need in b[up][0]

        parent = lambda p: p[:-2] if p.endswith("[]") else p.rpartition(".")[0]
        gone, new = {}, {}
        for p, (types, required, known) in b.items():
            if looked(p):
                if p in seen:
                    if seen[p][0] - types:
                        out.add((file_id, p, "retyped"))
                    if known and seen[p][1] - set(known):
                        out.add((file_id, p, "new_value"))
                elif required:
                    gone.setdefault(parent(p), []).append(p)
        for p in seen:
            if p not in b and looked(p):
                new.setdefault(parent(p), []).append(p)
        for up in gone.keys() | new.keys():
            g, n = gone.get(up, []), new.get(up, [])
            if len(g) == len(n) == 1 and b[g[0]][0] & seen[n[0]][0]:
                out.add((file_id, g[0], "renamed"))
            else:
                out |= {(file_id, p, "removed") for p in g} | {(file_id, p, "added") for p in n}
    return out


def test_changes_against_python(spark, sf):
    lines, spec = spark.read.parquet(f"{sf}/raw_lines.parquet"), spark.read.parquet(f"{sf}/store_fields.parquet")
    assert {tuple(x) for x in drift.changes(lines, spec).collect()} == changes_in_python(lines.collect(), spec.collect())


def test_drift_small(spark):
    spec = spark.createDataFrame([("s", "a", "object", True, None), ("s", "a.x", "number", True, None), ("s", "t", "string", True, "p,q"), ("s", "l", "array", False, None), ("s", "l[]", "object", False, None), ("s", "l[].k", "string|number", True, None)], "store string, field_path string, json_type string, required boolean, known_values string")
    docs = {1: {"a": {"x": 1}, "t": "p"}, 2: {"a": {"y": 2}, "t": "z"}, 3: {"a": {"y": "s"}, "t": "p"}, 4: {"a": [1], "t": None}, 5: {"a": {"x": True}, "t": "q", "l": [{"k": 1}, {"k": "b"}, {"k": []}], "n": {"deep": 1}}, 6: {"a": {"x": 1}, "t": "p", "l": []}}
    lines = spark.createDataFrame([(k, "s", json.dumps(v)) for k, v in docs.items()] + [(7, "s", '{"a": '), (7, "s", ""), (7, "s", None), (8, "s", "5")], "file_id long, store string, raw string")
    got = sorted(tuple(r) for r in drift.changes(lines, spec).collect())
    assert got == [(2, "a.x", "renamed"), (2, "t", "new_value"), (3, "a.x", "removed"), (3, "a.y", "added"), (4, "a", "retyped"), (4, "t", "removed"), (5, "a.x", "retyped"), (5, "l[].k", "retyped"), (5, "n", "added")]


def test_consistent_lines_carry_every_field(spark):
    docs = [
        {"type": "a", "n": 1, "m": 1, "big": 2**60, "mix": "s", "deep": {"x.y": [1, None, 2], "X": "up", "x": "low", "": [True]}, "none": None},
        {"type": "b", "n": 2.5, "m": "t", "big": 2**64, "mix": [{"k": 1.5}], "msgs": [{"role": "user", "calls": [{"id": 7}]}, {"role": None, "text": "\ud800é"}], "empty": {}},
        {"renamed": {"gitBranch": "main"}, "map": {f"k{i}": i for i in range(drift.MOST_NAMES + 1)}},
    ]
    lines = spark.createDataFrame([(1, i, "s" if i else None, None, json.dumps(d)) for i, d in [*enumerate(docs), (0, docs[0])]] + [(1, 9, "s", None, '{"cut": '), (1, 10, "s", None, "5")], "file_id long, line_no long, store string, client_version string, raw string")
    got = {r.line_no: r for r in drift.consistent(lines).collect()}
    assert sorted(got) == [0, 1, 2] and got[0].type == "a"
    a, b, c = (got[i].fields.asDict(True) for i in range(3))
    assert (a["n"], b["n"], a["m"], b["m"], a["big"], b["big"]) == (1.0, 2.5, "1", "t", str(2**60), str(2**64))
    assert (a["mix"], b["mix"]) == ('"s"', '[{"k": 1.5}]') and a["deep"]["x.y"] == [1, None, 2] and a["deep"]["_"] == [True] and sorted(map(str, a["deep"].values())) == sorted(["[1, None, 2]", "[True]", "up", "low"])
    assert b["msgs"] == [{"role": "user", "calls": [{"id": 7}], "text": None}, {"role": None, "calls": None, "text": "?é"}] and b["empty"] == "{}"
    assert c["renamed"] == {"gitBranch": "main"} and json.loads(c["map"]) == docs[2]["map"] and a["map"] is None


def test_consistent_lines_against_python(spark, sf, tmp_path):
    """Every non-null leaf of every line is in ``fields``, counted by its text."""
    lines = spark.read.parquet(f"{sf}/raw_lines.parquet")
    drift.consistent(lines).write.parquet(str(tmp_path / "lines"))

    def leaves(v):
        if isinstance(v, dict | list):
            return [x for y in (v.values() if isinstance(v, dict) else v) for x in leaves(y)]
        text = v if isinstance(v, str) else json.dumps(v)
        try:
            return [] if v is None else [repr(float(text))]
        except ValueError:
            return [text]

    schema = drift.union_schema(lines)

    def back(v, node):
        if v is None or node.to in ("long", "double", "boolean", "string"):
            return v
        if node.to == "json":
            return json.loads(v)
        return [back(x, node.children["[]"]) for x in v] if node.to == "array" else {k: back(v[c], n) for k, c, n in node.named()}

    got = {(r["file_id"], r["line_no"]): sorted(leaves(back(r["fields"].asDict(True), schema))) for r in spark.read.parquet(str(tmp_path / "lines")).collect()}
    want = {(r.file_id, r.line_no): sorted(leaves(v)) for r in lines.collect() if (v := drift.parse(r.raw)) is not None}
    assert got == want
