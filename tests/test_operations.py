import json
import random

import pytest
import tables
from pyspark.sql import functions as F

from weftline.functions import secretscan
from weftline.operators import attest, extraction, manifest, redaction
from weftline.plans import operations
from weftline.sources import sinks

ENTRY = "position long, file string, format string, session_id string, source_hash string, redaction_key string, redacted_hash string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_equal_the_ordered_walk(spark, seed):
    random.seed(seed)

    def entries(n):
        return [(i, random.choice("abcdefghijklmnop"), random.choice(["x", "y", ""]), random.choice(["1", "2", "3", "4", "5", ""]), random.choice(["h", "i", "", None]), random.choice(["k", ""]), random.choice(["r", "", None])) for i in range(n)]

    names = [c.split(" ")[0] for c in ENTRY.split(", ")]
    local, remote = entries(40), entries(20)
    as_dicts = lambda rows: [dict(zip(names, r)) for r in rows]
    upload, retain, aligned = manifest.diff_ordered(as_dicts(local), as_dicts(remote))
    got = manifest.diff(spark.createDataFrame(local, ENTRY), spark.createDataFrame(remote, ENTRY), F.col("position")).orderBy("position")
    rows = got.collect()
    assert [r.aligned_file for r in rows] == [e["file"] for e in aligned]
    assert [r.position for r in rows if r.action == "upload"] == [e["position"] for e in upload]
    kept = manifest.retained(spark.createDataFrame(remote, ENTRY), got).select("position").collect()
    assert sorted(r.position for r in kept) == sorted(e["position"] for e in retain)
    assert manifest.diff(spark.createDataFrame([], ENTRY), spark.createDataFrame(remote, ENTRY), F.col("position")).count() == 0


@pytest.mark.parametrize("name", [n for n in operations.QUERIES if n != "session_lookup"])
def test_empty_tables(spark, sf, tmp_path_factory, name):
    if not hasattr(test_empty_tables, "at"):
        test_empty_tables.at = tables.empty(spark, sf, tmp_path_factory.mktemp("empty"))
    assert operations.QUERIES[name](spark, test_empty_tables.at).count() <= 1


def test_scope(spark):
    assert [extraction.resolve_scope("a", True, "c"), extraction.resolve_scope("", True, "c"), extraction.resolve_scope("", False, "c"), extraction.resolve_scope()] == ["a", "all", "c", ""]
    df = spark.createDataFrame([("x",), ("y",), (None,)], "origin string")
    assert extraction.in_scope(df, "all", ("x",)).count() == 3 and extraction.in_scope(df, "x", ("x", "y")).count() == 1
    with pytest.raises(ValueError, match="unknown scope 'z'"):
        extraction.in_scope(df, "z", ("x", "y"))


def test_tools(spark):
    body = json.dumps([{"type": "function", "function": {"name": "a", "description": "d", "parameters": {"type": "object"}}}, {"name": "b"}, {"description": "nameless"}, 7, {"name": "a", "description": "later"}])
    file = extraction.tools_of(spark, body)
    assert [(r.position, r.type, r.name, r.description, r.parameters) for r in file.orderBy("position").collect()] == [(0, "function", "a", "d", '{"type": "object"}'), (1, "function", "b", "", None), (4, "function", "a", "later", None)]
    inferred = spark.createDataFrame([("a", "{}"), ("c", "{}")], "tool string, parameters string")
    assert {r.name for r in extraction.resolve_tools(inferred, file).collect()} == {"a", "b"}
    assert {(r.name, r.description, r.parameters) for r in extraction.resolve_tools(inferred, None, file).collect()} == {("a", "later", "{}"), ("c", "", "{}")}
    rows = spark.createDataFrame([("t", 'q"x', "string", True), ("t", "n", "number", False), ("u", None, None, False)], "tool string, param string, type string, required boolean")
    got = {r.tool: json.loads(r.parameters) for r in extraction.parameters_json(rows).collect()}
    assert got == {"t": {"type": "object", "properties": {"n": {"type": "number"}, 'q"x': {"type": "string"}}, "required": ['q"x']}, "u": {"type": "object", "properties": {}}}


def test_parts_of_a_credential():
    assert redaction.scrub_parts("k=ID12 s=deadbeef99", "ID12", "ID12:deadbeef99", "#") == ("k=# s=#", 2)
    assert redaction.scrub_parts("use ID12:deadbeef99 now", "ID12", "ID12:deadbeef99", "#") == ("use # now", 1)
    assert redaction.scrub_parts("user 12345678 and abcdefgh", "api", "12345678abcdefgh", "#") == ("user # and #", 2)
    assert redaction.scrub_parts("nothing", "api", "12345678abcdefgh", "#") == ("nothing", 0) and redaction.scrub_parts("", "", "") == ("", 0)


def test_detectors_of_ones_own(monkeypatch):
    monkeypatch.setattr(secretscan, "_REGISTERED", {})
    secretscan.register(secretscan.Detector("loom", ("loom_",), r"loom_[0-9]{4}"))
    with pytest.raises(ValueError, match="already"):
        secretscan.register(secretscan.Detector("loom", (), "x"))
    assert redaction.Rules(marker="#").apply("a loom_1234 b") == ("a # b", 1)
    found = secretscan.patterns_of("# mine\npatterns:\n  - name: one\n    regex: 'w''[0-9]+'\n  - name: two\n    regex: \"a\\\\d\"\n  - name: nothing\nother:\n  - name: x\n    regex: y\n")
    assert [(d.label, d.pattern) for d in found] == [("one", "w'[0-9]+"), ("two", "a\\d")]
    with pytest.raises(Exception, match="unterminated|missing"):
        secretscan.patterns_of("patterns:\n- name: bad\n  regex: (x\n")


def test_excerpts(spark):
    lines = spark.createDataFrame([(1, "Ann " + "é" * 200), (2, "none"), (3, "say ANN"), (4, None)], "id int, text string")
    got = {r.id: r.excerpt for r in attest.name_examples(lines, "id", "text", "ann").collect()}
    assert got[3] == "say ANN" and got[1].endswith("...") and len(got[1].encode()) <= 160 and got[1][:-3] == ("Ann " + "é" * 200)[: len(got[1]) - 3] and set(got) == {1, 3}
    quoted = spark.createDataFrame([(1, 'x = "aB3dE5gH7jK9mN1pQ3sT"\nend')], "id int, text string")
    (r,) = attest.entropy_contexts(quoted, "id", "text").collect()
    assert r.value == "aB3dE5gH7jK9mN1pQ3sT" and r.context == 'x = "aB3dE5gH7jK9mN1pQ3sT" end'


def test_uploads_and_staging(spark, tmp_path):
    entries = spark.createDataFrame([(1, "h", "old"), (2, "h", "new"), (3, None, "none")], "n int, source_hash string, file string")
    wanted = spark.createDataFrame([("h",), ("g",), (None,)], "source_hash string")
    assert {(r.source_hash, r.file) for r in extraction.upload_lookup(wanted, entries, F.col("n")).collect()} == {("h", "new"), ("g", None), (None, None)}
    with pytest.raises(Exception, match="no file to upload"):
        extraction.upload_lookup(wanted, entries, F.col("n"), strict=True).collect()
    (tmp_path / "a").write_text("x")
    hashes = sinks.file_hashes(spark, str(tmp_path)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "sha256")
    good = hashes.first().sha256
    manifest_ = spark.createDataFrame([("a", good), ("b", good)], "file string, redacted_hash string")
    assert [r.file for r in extraction.staging_faults(manifest_, hashes).collect()] == ["b"]


def test_summaries():
    total, model = {"records": 2}, [{"model": "b", "records": 1}, {"model": "a", "records": 1}]
    assert list(json.loads(sinks.summary_json(total, model, []))["models"]) == ["a", "b"]
    text = sinks.copies_markdown([{"format": "codex", "sessions": 2, "lines": 9}], [{"redaction_key": "k", "images": "strip", "sessions": 2}])
    assert "- sessions: 2" in text and "Images are stripped." in text and "| codex | 2 | 9 |" in text
