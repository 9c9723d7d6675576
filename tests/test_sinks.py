import hashlib
import json

import pytest

from weftline.operators.redaction import Rules
from weftline.plans import render
from weftline.sources import sinks


def test_records_round_trip(spark, sf, tmp_path):
    records = spark.read.parquet(f"{sf}/records.parquet").dropDuplicates(["record_id"])
    sinks.write_records(records, str(tmp_path / "r"), 1)
    back = sinks.read_records(spark, str(tmp_path / "r"), strict=True)
    assert back.count() == records.count()
    key = lambda df: sorted((r.record_id, len(r.turns or [])) for r in df.select("record_id", "turns").collect())
    assert key(back) == key(records)
    sinks.write_rendered(records, render.flat, str(tmp_path / "t"))
    assert set(json.loads(spark.read.text(str(tmp_path / "t")).first().value)) >= {"id", "content"}


def test_validate_file(spark, tmp_path):
    good = {"record_id": "1", "origin": "o", "grouping": "g", "model": "m", "turns": [{"role": "user", "text": "x"}]}
    p = tmp_path / "a.jsonl"
    p.write_text(json.dumps(good) + "\n" + json.dumps(good) + "\n")
    assert sinks.validate_file(spark, str(p)) == (2, None, None)
    p.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"model": " "}) + "\n")
    assert sinks.validate_file(spark, str(p)) == (1, 2, "no JSON object")
    p.write_text(json.dumps(good) + "\n" + json.dumps(good | {"turns": [{"role": "x"}]}) + "\n")
    assert sinks.validate_file(spark, str(p))[1:] == (2, 'turn 0: invalid role "x"')


def test_isolate_keeps_shape_and_source(spark, tmp_path):
    src = tmp_path / "in" / "p" / "s.jsonl"
    src.parent.mkdir(parents=True)
    body = json.dumps({"type": "user", "message": {"content": [{"type": "text", "text": "token=abc12345"}, {"type": "image", "source": "x"}]}}) + "\n\n" + json.dumps({"n": 1}) + "\n"
    src.write_text(body)
    (r,) = sinks.isolate(spark, str(tmp_path / "in"), Rules(marker="[M]"), keep_images=False).collect()
    first, second = map(json.loads, r.redacted.splitlines())
    assert first == {"type": "user", "message": {"content": [{"type": "text", "text": "token=[M]"}]}} and second == {"n": 1} and r.lines == 2
    assert src.read_text() == body and r.source_hash == "sha256:" + hashlib.sha256(body.encode()).hexdigest()
    assert r.redacted_hash == "sha256:" + hashlib.sha256(r.redacted.encode()).hexdigest() and r.target.endswith("/s.jsonl")
    (h,) = sinks.file_hashes(spark, str(tmp_path / "in")).collect()
    assert h.sha256 == r.source_hash and h.bytes == len(body)
    src.write_text("{broken")
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        sinks.isolate(spark, str(tmp_path / "in"), Rules()).collect()


def test_images_are_stripped_only_where_the_format_has_them():
    image = {"type": "image", "source": "x"}
    line = {"message": {"content": [image, {"type": "tool_result", "content": [image, 1]}, {"type": "tool_use", "input": {"images": ["kept"], "list": [image]}}]}}
    out = sinks.strip_images(line, "claudecode")["message"]["content"]
    assert out == [{"type": "tool_result", "content": [1]}, {"type": "tool_use", "input": {"images": ["kept"], "list": [image]}}]
    item = {"type": "response_item", "payload": {"type": "message", "content": [{"type": "input_image"}, {"type": "input_text"}], "images": ["kept"]}}
    assert sinks.strip_images(item, "codex")["payload"] == {"type": "message", "content": [{"type": "input_text"}], "images": ["kept"]}
    event = {"type": "event_msg", "payload": {"type": "user_message", "images": ["x"], "local_images": ["y"], "message": "m"}}
    assert sinks.strip_images(event, "codex")["payload"] == {"type": "user_message", "message": "m"}
    call = {"type": "response_item", "payload": {"type": "function_call", "images": ["kept"]}}
    assert sinks.strip_images(call, "codex") == call and sinks.strip_images({"n": 1}, "codex") == {"n": 1}


def test_isolate_takes_native_formats_only_and_a_hook(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"a": "x"}\n')
    (r,) = sinks.isolate(spark, str(tmp_path), Rules(), origin="codex", before=lambda line: line | {"b": 1}).collect()
    assert json.loads(r.redacted) == {"a": "x", "b": 1}
    with pytest.raises(ValueError, match="no native format"):
        sinks.isolate(spark, str(tmp_path), Rules(), origin="amp")


def test_manifest_and_readme():
    text = sinks.manifest_text({"v": 1}, [{"file": "f"}])
    assert [json.loads(x)["kind"] for x in text.splitlines()] == ["header", "session"] and json.loads(text.splitlines()[0])["session_count"] == 1
    md = sinks.summary_markdown({"records": 2}, [{"model": "b", "records": 1, "input_tokens": 1, "output_tokens": 1}, {"model": "a", "records": 1, "input_tokens": 1, "output_tokens": 1}], [])
    assert md.index("| a |") < md.index("| b |")
