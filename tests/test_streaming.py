import json

from weftline.streaming import records


def test_new_files_become_records_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda i, role="user": json.dumps({"record_id": str(i), "origin": "o", "grouping": "g", "model": "m", "turns": [{"role": role, "text": "t"}]})
    (source / "a.jsonl").write_text("\n".join([row(1), row(2), row(1), row(3, "system"), "broken", ""]))
    run = lambda: records.write(records.read(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    run()
    (source / "b.jsonl").write_text("\n".join([row(2), row(4)]))
    run()
    assert sorted(r.record_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "4"]
