import json
import sqlite3

from weftline.sources import claudecode, codex, traces


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_missing_roots_are_empty(spark, tmp_path):
    assert codex.read(spark, str(tmp_path / "none")).count() == 0
    assert traces.amp(spark, str(tmp_path / "none")).count() == 0
    assert claudecode.read(spark, str(tmp_path / "none")).count() == 0


def test_codex(spark, tmp_path):
    msg = lambda role, *texts: {"type": "message", "role": role, "content": [{"type": "input_text", "text": t} for t in texts]}
    item = lambda n, p: {"type": "response_item", "timestamp": f"2026-04-17T10:00:{n:02d}.5Z", "payload": p}
    write(tmp_path / "s" / "rollout-1.jsonl", [
        {"type": "session_meta", "timestamp": "2026-04-17T10:00:00Z", "payload": {"id": "sess", "cwd": "/w/p", "model_provider": "prov", "git": {"branch": "main"}}},
        {"type": "turn_context", "timestamp": "2026-04-17T10:00:01Z", "payload": {"cwd": "/w/other", "model": "m-1"}},
        "not json", "", "[1]",
        item(2, msg("user", "a", "b")),
        item(3, {"type": "reasoning", "summary": [{"text": "why"}, {"text": "why"}]}),
        item(4, {"type": "function_call", "call_id": "c1", "name": "read_file", "arguments": '{"path": "x"}'}),
        item(5, {"type": "function_call_output", "call_id": "c1", "output": "Exit code: 0\nWall time: 1 s\nfine"}),
        item(6, {"type": "custom_tool_call", "call_id": "c2", "name": "edit", "input": "plain words"}),
        item(7, {"type": "custom_tool_call_output", "call_id": "c2", "output": '{"output": "an Error", "n": 1}'}),
        item(8, msg("assistant", "done")), item(9, msg("assistant", "done")), item(9, msg("assistant", "done")),
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 100, "cached_input_tokens": 5, "output_tokens": 42}}}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "look", "images": ["data:image/png;base64,AA", {"url": "http://x/y.png"}]}},
        item(12, {"type": "reasoning", "summary": [{"text": "late"}]}),
    ])
    (r,) = codex.read(spark, str(tmp_path)).collect()
    assert (r.record_id, r.model, r.branch, r.working_dir, r.grouping) == ("sess", "m-1", "main", "/w/p", "/w/p")
    assert (r.started_at, r.ended_at) == ("2026-04-17T10:00:00Z", "2026-04-17T10:00:12Z")
    assert [(t.role, t.text, t.reasoning) for t in r.turns] == [("user", "a\nb", ""), ("assistant", "done", "why"), ("assistant", "done", ""), ("user", "look", ""), ("assistant", "", "late")]
    one, two = r.turns[1].tool_calls
    assert (one.tool, json.loads(one.input), one.status, json.loads(one.output.raw)) == ("read_file", {"path": "x"}, "success", {"exit_code": "0", "wall_time": "1 s"})
    assert (two.input, two.status, two.output.text) == ('"plain words"', "error", "an Error")
    assert [(a.data, a.url) for a in r.turns[3].attachments] == [("data:image/png;base64,AA", None), (None, "http://x/y.png")]
    assert (r.usage.user_turns, r.usage.assistant_turns, r.usage.tool_calls, r.usage.input_tokens, r.usage.output_tokens) == (2, 3, 2, 105, 42)


def test_claudecode(spark, tmp_path):
    write(tmp_path / "proj" / "s1.jsonl", [
        {"type": "user", "timestamp": "2026-04-17T10:00:00Z", "cwd": "/w", "gitBranch": "HEAD", "message": {"content": "hello"}},
        {"type": "assistant", "timestamp": "2026-04-17T10:00:02Z", "gitBranch": "dev", "message": {"model": "m", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "thinking", "thinking": "t1"}, {"type": "thinking", "text": "t2"}, {"type": "tool_use", "id": "x", "name": "bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "y", "name": "bash", "input": {}}], "usage": {"input_tokens": 3, "cache_read_input_tokens": 4, "output_tokens": 5}}},
        {"type": "user", "timestamp": "2026-04-17T10:00:01Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "content": "old"}]}},
        {"type": "user", "toolUseResult": {"ok": True}, "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "content": [{"type": "text", "text": "new"}, {"type": "text", "text": "er"}]}]}},
    ])
    write(tmp_path / "proj" / "s1" / "subagents" / "b.jsonl", [{"type": "assistant", "timestamp": "2026-04-17T11:00:05Z", "message": {"content": [{"type": "text", "text": "second"}]}}])
    write(tmp_path / "proj" / "s1" / "subagents" / "c.jsonl", [{"type": "assistant", "timestamp": "2026-04-17T11:00:01Z", "message": {"content": [{"type": "text", "text": "first"}]}}])
    write(tmp_path / "proj" / "s2.jsonl", [{"type": "user", "message": {"content": "no answer"}}])
    got = {r.record_id.split("/")[1]: r for r in claudecode.read(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["s1", "s1:subagents"]
    r = got["s1"]
    assert (r.model, r.branch, r.working_dir, r.started_at, r.ended_at, r.usage.input_tokens) == ("m", "dev", "/w", "2026-04-17T10:00:00Z", "2026-04-17T10:00:02Z", 7)
    assert [(t.role, t.text, t.reasoning) for t in r.turns] == [("user", "hello", ""), ("assistant", "ab", "t1\nt2")]
    x, y = r.turns[1].tool_calls
    assert (x.output.text, json.loads(x.output.raw), x.status, y.output, y.status) == ("new\ner", {"ok": True}, "success", None, "")
    assert [t.text for t in got["s1:subagents"].turns] == ["first", "second"]


def test_gemini(spark, tmp_path):
    doc = {"sessionId": "g1", "startTime": "2026-01-01T00:00:00Z", "lastUpdated": "2026-01-01T01:00:00Z", "messages": [
        {"type": "user", "timestamp": "2026-01-01T00:00:01Z", "content": [{"text": "a"}, {"text": "b"}, {"inlineData": {"mimeType": "image/png", "data": "QQ"}}, {"functionCall": {"name": "f"}}]},
        {"type": "gemini", "content": "hi", "model": "gm", "thoughts": [{"description": "x"}, {"description": "y"}], "tokens": {"input": 1, "cached": 2, "output": 3}, "toolCalls": [{"name": "t", "args": {"q": 1}, "output": {"r": 2}}, {"toolName": "u"}]},
        {"type": "info", "content": "skip"},
    ]}
    for name in ("session-1.json", "session-2.json"):
        write(tmp_path / "d1" / "chats" / name, [json.dumps(doc)])
    (r,) = traces.gemini(spark, str(tmp_path)).collect()
    assert (r.record_id, r.model, r.usage.input_tokens, r.usage.output_tokens, r.grouping) == ("g1", "gm", 3, 3, "d1")
    assert (r.turns[0].text, r.turns[0].attachments[0].type, json.loads(r.turns[0].extensions)) == ("a\nb", "image", {"tool_events": [{"name": "f"}]})
    assert (r.turns[1].reasoning, [c.tool for c in r.turns[1].tool_calls], r.turns[1].tool_calls[0].status) == ("x\ny", ["t", "u"], "success")


def test_kimi_openclaw_supplied(spark, tmp_path):
    import hashlib

    digest = hashlib.md5(b"/home/w").hexdigest()
    write(tmp_path / "k" / "kimi.json", [json.dumps({"work_dirs": [{"path": "/home/w"}]})])
    write(tmp_path / "k" / "sessions" / digest / "s" / "context.jsonl", [
        {"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "think", "text": "t"}, {"type": "text", "text": "a"}], "tool_calls": [{"function": {"name": "f", "arguments": '{"x": 1}'}}]},
        {"role": "_usage", "token_count": 7}, {"role": "_usage", "token_count": 5},
    ])
    (r,) = traces.kimi(spark, str(tmp_path / "k")).collect()
    assert (r.working_dir, r.usage.output_tokens, r.turns[1].reasoning, r.turns[1].tool_calls[0].input) == ("/home/w", 7, "t", '{"x": 1}')
    write(tmp_path / "o" / "a" / "sessions" / "1.jsonl", [
        {"type": "session", "id": "oc", "cwd": "/c", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "model_change", "provider": "p", "modelId": "m"},
        {"type": "message", "timestamp": "2026-01-01T00:01:00Z", "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "1", "name": "sh", "arguments": "{}"}, {"type": "toolCall", "id": "2", "name": "sh"}]}},
        {"type": "message", "message": {"role": "toolResult", "toolCallId": "1", "content": [{"text": "Error: no"}]}},
        {"type": "bashExecution", "command": "ls", "output": "x", "exitCode": 0},
    ])
    write(tmp_path / "o" / "a" / "sessions" / "2.jsonl", [{"type": "message"}])
    (r,) = traces.openclaw(spark, str(tmp_path / "o")).collect()
    assert (r.record_id, r.model, r.ended_at) == ("oc", "p/m", "2026-01-01T00:01:00Z")
    assert [c.status for c in r.turns[0].tool_calls] == ["error", "success"] and r.turns[1].tool_calls[0].status == "success"
    write(tmp_path / "sup" / "mine" / "x.jsonl", [{"record_id": "1", "model": "m", "origin": "z", "turns": [{"role": "user", "text": "t"}]}, {"record_id": "2", "model": "", "turns": []}, "broken"])
    (r,) = traces.supplied(spark, str(tmp_path / "sup")).collect()
    assert (r.record_id, r.origin, r.grouping, r.turns[0].text) == ("1", "supplied", "supplied/mine", "t")


def test_amp(spark, tmp_path):
    write(tmp_path / "T-1.json", [json.dumps({"id": "T-1", "title": "t", "created": 1767225600000, "env": {"initial": {"trees": [{"uri": "file:///w/x"}], "platform": {"clientType": "cli"}}}, "meta": {"visibility": "private"}, "messages": [
        {"role": "user", "content": [{"type": "text", "text": "q"}], "meta": {"sentAt": 1767225601000}}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "h", "startTime": 1767225602000}, {"type": "text", "text": "a"}], "usage": {"model": "mm", "inputTokens": 1, "cacheReadInputTokens": 2, "outputTokens": 3}}, {"role": "assistant", "content": []}]})])
    (r,) = traces.amp(spark, str(tmp_path)).collect()
    assert (r.record_id, r.grouping, r.working_dir, r.model, r.started_at, r.ended_at) == ("T-1", "default", "/w/x", "mm", "2026-01-01T00:00:00Z", "2026-01-01T00:00:02Z")
    assert [(t.role, t.text, t.reasoning) for t in r.turns] == [("user", "q", ""), ("assistant", "a", "h")] and r.usage.input_tokens == 3
    assert json.loads(r.extensions) == {"amp": {"visibility": "private", "client_type": "cli"}}


def test_amp_plan_is_small(spark):
    # The driver holds the plan several times over; with times written out at each mention this one took 10 million characters.
    rows = spark.createDataFrame([("p", "g", "{}")], "path string, grouping string, raw string")
    assert len(traces.amp_traces(rows)._jdf.queryExecution().analyzed().toString()) < 1_000_000


def test_sqlite_sources(spark, tmp_path):
    from weftline.sources import databases

    db = tmp_path / "o.db"
    with sqlite3.connect(db) as c:
        c.executescript("create table session(id text, directory text, time_created int, time_updated int); create table message(id text, session_id text, data text, time_created int); create table part(id text, message_id text, data text, time_created int)")
        c.execute("insert into session values('s','/d',1767225600000,1767225600000)")
        c.executemany("insert into message values(?,?,?,?)", [("m2", "s", json.dumps({"role": "assistant", "model": {"providerID": "p", "modelID": "m"}, "tokens": {"input": 1, "output": 2, "cache": {"read": 3, "write": 4}}}), 1767225602000), ("m1", "s", json.dumps({"role": "user"}), 1767225601000), ("m3", "s", json.dumps({"role": "user"}), 1767225609000)])
        c.executemany("insert into part values(?,?,?,?)", [("p1", "m1", json.dumps({"type": "text", "text": "q"}), 1), ("p2", "m2", json.dumps({"type": "tool", "tool": "t", "state": {"status": "completed", "input": {"a": 1}, "output": "o"}}), 2), ("p3", "m2", json.dumps({"type": "file", "mime": "image/png", "url": "data:x"}), 3)])
    (r,) = databases.opencode(spark, str(db)).collect()
    assert [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "")]
    assert (r.model, r.usage.input_tokens, r.turns[1].tool_calls[0].status, r.turns[1].tool_calls[0].output.text, r.turns[1].attachments[0].data, r.ended_at) == ("p/m", 8, "success", "o", "data:x", "2026-01-01T00:00:09Z")
    kv = tmp_path / "c.db"
    with sqlite3.connect(kv) as c:
        c.execute("create table cursorDiskKV(key text primary key, value blob)")
        put = lambda k, v: c.execute("insert into cursorDiskKV values(?,?)", (k, json.dumps(v).encode()))
        put("composerData:a", {"fullConversationHeadersOnly": [{"bubbleId": "1"}, {"bubbleId": "2"}, {"bubbleId": "9"}, {"bubbleId": "3"}]})
        put("bubbleId:a:1", {"type": 1, "text": "q", "createdAt": "2026-01-01T00:00:00Z", "workspaceUris": ["file:///w"]})
        put("bubbleId:a:2", {"type": 2, "text": "a", "thinking": {"text": "t"}, "modelInfo": {"modelName": "m"}, "tokenCount": {"inputTokens": 5, "outputTokens": 6}, "toolFormerData": {"name": "mcp_x_run", "params": '{"tools": [{"parameters": {"k": 1}}]}', "result": "ok", "status": "done"}})
        put("bubbleId:a:3", {"type": 7, "tokenCount": {"inputTokens": 1}})
    (r,) = databases.cursor(spark, str(kv)).collect()
    assert [(t.role, t.text, t.reasoning) for t in r.turns] == [("user", "q", ""), ("assistant", "a", "t")]
    call = r.turns[1].tool_calls[0]
    assert (r.record_id, r.working_dir, r.model, r.usage.input_tokens, call.tool, json.loads(call.input), call.output.text, call.status) == ("a", "/w", "m", 6, "run", {"k": 1}, "ok", "done")
    orc = tmp_path / "r.db"
    with sqlite3.connect(orc) as c:
        c.executescript("create table Repositories(id text, display_name text, git_url text); create table workspaces(id text, repo_id text, root_path text, directory_name text, branch_name text); create table sessions(id text, workspace_id text, agent text, external_id text, title text, created_at text); create table session_messages(id text, session_id text, role text, text text, rich_payload text, timestamp text)")
        c.execute("insert into Repositories values('r','Repo','https://h/x/repo.git')")
        c.execute("insert into workspaces values('w','r','/w/one','one','dev')")
        c.execute("insert into sessions values('s','w','Codex CLI','ext','T','2026-01-01 00:00:00')")
        c.executemany("insert into session_messages values(?,?,?,?,?,?)", [("2", "s", "assistant", "a", None, "2026-01-01 00:00:02"), ("1", "s", "User", "q", None, "2026-01-01 00:00:01"), ("3", "s", "noise", "z", None, "2026-01-01 00:00:03")])
    (r,) = databases.orchestrator(spark, str(orc)).collect()
    assert (r.record_id, r.grouping, r.branch, r.working_dir, [t.text for t in r.turns]) == ("s", "orchestrator:Repo", "dev", "/w/one", ["q", "a"])


def test_codex_fold_against_a_plain_loop(spark, sf):
    """Turn roles and texts of every session file of the test table, against a sequential reading of its rows."""
    from weftline.plans import reference

    rows = {r.row_id: r for r in spark.read.parquet(f"{sf}/codex_session.parquet").where("session_id is not null").collect()}
    files = {}
    for r in rows.values():
        files.setdefault(f"{r.session_id}/{r.file}", []).append(r)
    want = {}
    for path, items in files.items():
        turns, calls, why = [], 0, []

        def push(t, turns=turns):
            if not turns or turns[-1] != t:
                turns.append(t)

        for r in sorted(items, key=lambda r: r.line_no):
            try:
                p = json.loads(r.payload) if r.payload else None
            except ValueError:
                continue
            p = p if isinstance(p, dict) else {}
            says = p.get("role") if p.get("type") == "message" and r.type == "response_item" else None
            content = p.get("content")
            text = "\n".join(b.get("text") or "" for b in content if b.get("type") in ("input_text", "output_text", "text")) if isinstance(content, list) else ""
            if p.get("type") in ("function_call", "custom_tool_call"):
                calls += 1
            elif p.get("type") == "reasoning":
                why += [b["text"] for b in p.get("summary") or [] if b.get("text") and b["text"] not in why]
            if says in ("user", "assistant"):
                t = ("assistant", text if says == "assistant" else "", "\n".join(why), calls)
                if any(t[1:]):
                    push(t)
                    calls, why = 0, []
                if says == "user" and text:
                    push(("user", text, "", 0))
        if calls or why:
            push(("assistant", "", "\n".join(why), calls))
        want[path] = turns
    got = {r._provenance.source_path: [(t.role, t.text, t.reasoning, len(t.tool_calls)) for t in r.turns] for r in reference.codex_records(spark, sf).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
