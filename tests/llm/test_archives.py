"""WARC round trips and tool calls."""

import base64
import hashlib
import json
import random

from impactrank.llm import tool_calls, warc
from impactrank.llm._spark import shared_dir

PAGES = [(1, "http://b.example.com/x?q=1#top", "<p>one</p>"), (2, "https://www.a.example.com:8443/", "<p>one</p>"), (9, "http://b.example.com/x?q=1", "<p>one</p>"), (4, None, None), (5, "not a url", ""), (-7, "http://b.example.com/é y", "déjà\r\n\r\nvu" * 500), (None, "http://z.example", "gone")]


def pages(spark):
    return spark.createDataFrame([(*p, "t") for p in PAGES], "page_id BIGINT, url STRING, html STRING, key STRING")


def test_round_trip(spark):
    out = {r["page_id"]: r for r in warc.archive_round_trip(pages(spark)).collect()}
    assert set(out) == {1, 2, 9, 4, 5, -7}
    for page, _, html in PAGES[:-1]:
        raw = (html or "").encode()
        assert (out[page]["payload_bytes"], out[page]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert out[page]["payload"] is None or bytes(out[page]["payload"]) == raw
    assert {p: (r["record_type"], r["refers_to"]) for p, r in out.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 4: ("revisit", 5), 5: ("response", None), -7: ("response", None)}
    small = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(pages(spark), min_bytes=5).collect()}
    assert small[4] == small[5] == "response" and small[1] == "revisit"
    assert warc.archive_round_trip(pages(spark).where("false")).count() == 0


def test_repeated_rows_have_one_response(spark):
    rows = [(7, "http://b", "same"), (7, "http://a", "same"), (7, "http://c", "other"), (3, "http://d", "same"), (3, "http://d", "same")]
    out = warc.archive_round_trip(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert sorted((r["page_id"], r["payload_digest"] == digest(b"same"), r["record_type"], r["refers_to"] or 0) for r in out) == [(3, True, "revisit", 7), (3, True, "revisit", 7), (7, False, "response", 0), (7, True, "response", 0), (7, True, "revisit", 7)]
    assert [r["target_uri"] for r in out if r["record_type"] == "response" and r["payload_digest"] == digest(b"same")] == ["http://a"]


def test_lookup_reads_by_key(spark):
    folder = shared_dir(spark)
    many = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p{i % 50}", f"<p>{i}</p>") for i in range(400)], "page_id BIGINT, url STRING, html STRING")
    directory = warc.write_index(warc.write_archives(many, folder), folder, lines=16)
    assert directory.count() >= 25
    found = warc.lookup(spark, folder, "https://H3.example.com/p3")
    assert [r.page_id for r in found] == [i for i in range(400) if i % 7 == 3 and i % 50 == 3] and found[0].payload == b"<p>3</p>"
    assert warc.lookup(spark, folder, "http://nowhere.example/") == []


def test_url_keys():
    assert warc.url_key("http://User@Www.Example.com:80/a/b?x=1#f") == "com,example,www)/a/b?x=1"
    assert warc.url_key("https://e.com:81") == "com,e:81)/" and warc.url_key(None) == ")"


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "noop": {}}


def calls(spark, rows):
    return spark.createDataFrame(rows, tool_calls.CALL)


def test_link_order_validate(spark):
    c = calls(spark, [
        (1, 0, "x", "add", '{"b": 2.5, "a": 1}', []), (1, 2, "y", "add", '{"a": "1", "c": 0}', ["x"]), (1, 4, "z", "none", "{}", ["?"]), (1, 6, "n", "noop", "[1]", None),
        (2, 0, "p", "noop", "{}", ["q"]), (2, 1, "q", "noop", "{}", ["r"]), (2, 2, "r", "noop", "{}", []), (2, 3, "s", "noop", "{}", ["s"]), (2, 4, "t", "noop", "broken", ["s"]),
        (1, 8, "x", "noop", "{}", []), (1, 9, None, "noop", "{}", []),
    ])
    r = spark.createDataFrame([(1, 1, "x", 'a "quoted"\nline'), (1, 3, "y", None), (1, 3, "y", None), (1, 5, "lost", "o"), (2, 0, "r", "early"), (1, 7, None, "?")], tool_calls.RESULT)
    out = tool_calls.link(c, r, SCHEMAS).collect()
    by = {(x["conv_id"], x["call_id"], x["kind"], x["turn"]): x for x in out}
    assert len(out) == 17
    assert json.loads(by[1, "x", "call", 0]["line"]) == {"arguments": {"a": 1, "b": 2.5}, "call_id": "x", "kind": "call", "name": "add"}
    assert by[1, "x", "call", 0]["line"].startswith('{"arguments":{"a":1,"b":2.5},"call_id":"x"') and by[1, "x", "call", 0]["errors"] == []
    assert by[1, "x", "result", 1]["line"] == '{"call_id":"x","content":"a \\"quoted\\"\\nline","kind":"result"}'
    assert by[1, "y", "call", 2]["errors"] == ["a: not integer", "b: missing", "c: unexpected"]
    assert by[1, "z", "call", 4]["errors"] == ["unknown tool", "depends_on: unknown call", "result: missing"]
    assert by[1, "n", "call", 6]["errors"][0] == "arguments: not an object"
    assert by[1, "lost", "orphan", 5]["stage"] is None and by[1, None, "orphan", 7]["errors"] == ["identifier: missing"]
    assert {k: by[2, k, "call", t]["stage"] for k, t in (("p", 0), ("q", 1), ("r", 2), ("s", 3), ("t", 4))} == {"p": 3, "q": 2, "r": 1, "s": None, "t": None}
    assert "depends_on: cycle" in by[2, "s", "call", 3]["errors"] and "result: before its call" in by[2, "r", "call", 2]["errors"]
    assert by[1, "x", "repeat", 8]["errors"] == ["call: repeated"] and sum(x["kind"] == "repeat" for x in out) == 2


def brute_stages(deps):
    """Stage of each call of one conversation that is out of order."""
    got = {}
    for _ in range(len(deps) + 1):
        for k, on in deps.items():
            if k not in got and all(d in got for d in on if d in deps):
                got[k] = 1 + max([got[d] for d in on if d in deps], default=0)
    return {k: got.get(k) for k in deps}


def test_stages_equal_brute_force_and_long_chains_take_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(12):
        names = [f"k{i}" for i in range(rng.randint(2, 14))]
        deps = {k: sorted({rng.choice([*names, "?"]) for _ in range(rng.choice([0, 1, 1, 2, 3]))} - ({k} if rng.random() < 0.8 else set())) for k in names}
        rows += [(conv, 50 - i if conv % 2 else i, k, "noop", "{}", deps[k]) for i, k in enumerate(names)]
        turn = {k: (50 - i if conv % 2 else i) for i, k in enumerate(names)}
        late = any(turn[d] >= turn[k] for k in names for d in deps[k] if d in turn)
        want |= {(conv, k): s if late else 0 for k, s in brute_stages(deps).items()}
    chain = 300
    rows += [(99, chain - i, f"c{i}", "noop", "{}", [f"c{i - 1}"] if i else []) for i in range(chain)]
    want |= {(99, f"c{i}"): i + 1 for i in range(chain)}
    written = []
    keep = tool_calls.write_table
    monkeypatch.setattr(tool_calls, "write_table", lambda df, folder, name: written.append(name) or keep(df, folder, name))
    got = {(r["conv_id"], r["call_id"]): r["stage"] for r in tool_calls.stages(calls(spark, rows)).collect()}
    assert got == want and len(written) < 40


def test_link_of_clashing_columns_and_long_texts(spark):
    long = "x" * 200_000
    c = spark.createDataFrame([(1, 0, "a", "add", '{"a": 1, "b": 2, "note": "' + long + '"}', [], "k", 5)], tool_calls.CALL + ", stage string, rows long")
    r = spark.createDataFrame([(1, 1, "a", long, "z", 1)], tool_calls.RESULT + ", line string, turn_ long")
    out = {x["kind"]: x for x in tool_calls.link(c, r, SCHEMAS).collect()}
    assert out["call"]["errors"] == [] and len(out["call"]["line"]) > 200_000 and json.loads(out["result"]["line"])["content"] == long


def test_parse_messages_and_empty(spark):
    m = spark.createDataFrame([(1, 0, "assistant", '{"tool_calls": [{"id": "k", "name": "noop", "arguments": {"z": 1, "a": [2]}, "depends_on": ["j"]}]}'), (1, 1, "tool", '{"tool_call_id": "k", "content": "done"}'), (1, 2, "user", "hello {"), (1, 3, "assistant", None)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    c, r = tool_calls.parse_messages(m)
    assert [tuple(x) for x in c.collect()] == [(1, 0, "k", "noop", '{"a":[2],"z":1}', ["j"])]
    assert [tuple(x) for x in r.collect()] == [(1, 1, "k", "done")]
    assert tool_calls.link(c.where("false"), r.where("false"), SCHEMAS).count() == 0


def test_no_python_in_the_plan(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, None, None, None)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    out = tool_calls.link(*tool_calls.turns_as_calls(m), tool_calls.REPLY_SCHEMA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert sorted((x["kind"], x["turn"]) for x in out.where("conv_id = 1").collect()) == [("call", 0), ("result", 1)]
