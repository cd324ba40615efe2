"""The line protocol and the prompt."""

import json

import pytest

from tidemark.engine import Engine
from tidemark.repl import commands, run
from tidemark.session import Session


def test_protocol(spark):
    session = Session(Engine.memory(spark))
    ask = lambda **r: json.loads(json.dumps(session.answer(json.dumps(r))))
    assert ask(op="ping", id=7) == {"ok": True, "result": {"type": "pong"}, "id": 7}
    got = ask(op="execute", datalog='(transact [[:a :s :on] [:a :x 1.5] [:a :y nil] [:a :r #uuid "550e8400-e29b-41d4-a716-446655440000"]])')
    assert got["result"]["type"] == "transacted" and got["result"]["tx_count"] == 1
    assert ask(op="execute", datalog="(query [:find ?v :where [:a :s ?v]])")["result"] == {"type": "query", "variables": ["?v"], "results": [[{"$kw": ":on"}]]}
    assert ask(op="execute", datalog="(query [:find ?v :where [:a :r ?v]])")["result"]["results"] == [[{"$ref": "550e8400-e29b-41d4-a716-446655440000"}]]
    assert ask(op="execute", datalog="(query [:find ?v :where [:a :y ?v]])")["result"]["results"] == [[None]]
    assert ask(op="execute", datalog="(retract [[:a :s :on]])")["result"]["type"] == "retracted"
    tail = ask(op="export_since", since_tx_count=1)["result"]
    assert tail["head_tx_count"] == 2 and [(r["valid_time"], r["asserted"], r["value"]) for r in tail["records"]] == [("all", False, {"$kw": ":on"})]
    assert ask(op="execute", datalog="(forget [[:a :nothing 1]])")["result"] == {"type": "forgotten", "tx_id": None, "tx_count": 2, "durability": "applied", "forgotten": 0}
    for kind, request in {"parse": {"op": "execute", "datalog": "(query"}, "execution": {"op": "execute", "datalog": "(query [:find ?v :where [:a :x ?v] [(what? ?v)]])"}, "protocol": {"op": "nothing"}}.items():
        assert ask(**request)["error"]["kind"] == kind
    assert session.answer("no json")["error"]["kind"] == "protocol" and ask(op="export_since", since_tx_count=-1)["error"]["kind"] == "protocol"
    assert ask(op="status")["result"]["tx_count"] == 2
    assert [json.loads(x)["result"]["type"] for x in session.serve(["", '{"op":"ping"}', '{"op":"shutdown"}', '{"op":"ping"}'])] == ["pong", "shutdown"]


@pytest.mark.parametrize("lines, want", [(["# note", "(a", " b)", "", '(c "(")', "EXIT", "(d)"], ["(a\n b)", '(c "(")']), (["(open"], ["(open"])])
def test_commands(lines, want):
    assert list(commands(lines)) == want


def test_prompt(spark):
    out = list(run(Engine.memory(spark), ["(transact [[:a :n 1]])", "(query [:find ?v", ":where [:a :n ?v]])", "(oops)"]))
    assert out[1].splitlines() == ["?v", "--", "1", "1 rows"] and out[2].startswith("error")
