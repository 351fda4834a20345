"""Strict case records: every fault is a reject with its place, and what is allowed stays a case."""

import json

import pytest

from evalgrain.sources import cases as case_source

ASSERTION = {"tool": "t", "path": "a.b", "equals": 1}
FAULTS = [
    ({"expected_skills": "pdf"}, "expected_skills", "wrong type"),
    ({"expected_skills": None}, "expected_skills", "wrong type"),
    ({"expected_skills": ["pdf", None]}, "expected_skills[1]", "wrong type"),
    ({"turns": "oops"}, "turns", "wrong type"),
    ({"turns": ["oops"]}, "turns[0]", "wrong type"),
    ({"turns": [{}]}, "turns[0].prompt", "missing"),
    ({"turns": [{"prompt": ""}]}, "turns[0].prompt", "missing"),
    ({"turns": [{"prompt": "q", "colour": 1}]}, "turns[0].colour", "unknown field"),
    ({"turns": [{"prompt": "q"}, {"prompt": 3}]}, "turns[1].prompt", "wrong type"),
    ({"turns": [{"prompt": "q", "expect_trajectory": {"gaol": "x"}}]}, "turns[0].expect_trajectory.gaol", "unknown field"),
    ({"forbid_artifacts": "maybe"}, "forbid_artifacts", "wrong type"),
    ({"requires_context": 1}, "requires_context", "wrong type"),
    ({"prompt": 5}, "prompt", "wrong type"),
    ({"stage": 5}, "stage", "wrong type"),
    ({"stage": "end"}, "stage", "unknown stage"),
    ({"severity": "urgent"}, "severity", "unknown severity"),
    ({"context": []}, "context", "wrong type"),
    ({"context": {"messages": [{"role": "robot", "content": "c"}]}}, "context.messages[0].role", "unknown value"),
    ({"context": {"messages": [{"role": "user"}]}}, "context.messages[0].content", "missing"),
    ({"context": {"tools": [{"name": "t", "description": "d", "input_schema": []}]}}, "context.tools[0].input_schema",
     "wrong type"),
    ({"context": {"tools": [{"name": "t", "description": "d", "source": "shop"}]}}, "context.tools[0].source", "unknown value"),
    ({"expect_trajectory": {"argument_assertions": [ASSERTION, {"tool": "t", "equals": 1}]}},
     "expect_trajectory.argument_assertions[1].path", "missing"),
    ({"expect_trajectory": {"argument_assertions": [{**ASSERTION, "equals": {}}]}},
     "expect_trajectory.argument_assertions[0].equals", "wrong type"),
    ({"expect_trajectory": {"argument_assertions": [{"tool": "t", "path": "p", "in": [1, []]}]}},
     "expect_trajectory.argument_assertions[0].in[1]", "wrong type"),
    ({"expect_trajectory": {"argument_assertions": [{"tool": "t", "path": "p", "required": False}]}},
     "expect_trajectory.argument_assertions[0].required", "unknown value"),
    ({"expect_trajectory": {"argument_assertions": [{**ASSERTION, "matches": "x"}]}},
     "expect_trajectory.argument_assertions", "not one matcher"),
    ({"expect_trajectory": {"argument_assertions": [{"tool": "t", "path": "p"}]}},
     "expect_trajectory.argument_assertions", "not one matcher"),
    ({"expect_trajectory": {"required_tools": ["a", "a"]}}, "expect_trajectory.required_tools", "repeated tool"),
    ({"expect_trajectory": {"required_tools": ["a"], "forbidden_tools": ["a"]}}, "expect_trajectory.forbidden_tools",
     "tool required and forbidden"),
    ({"expect_trajectory": {"required_verification": True}}, "expect_trajectory.verification_tools", "no verification tools"),
    ({"turns": [{"prompt": "q"}, {"prompt": "q", "expect_trajectory": {"required_verification": True}}]},
     "turns[1].expect_trajectory.verification_tools", "no verification tools"),
]
ALLOWED = [
    {}, {"stage": None, "reference": None, "expect_trajectory": None},
    {"turns": [], "tags": [], "expected_skills": []},
    {"turns": [{"prompt": "q", "reference": None, "expect_trajectory": {"goal": "", "required_tools": ["a", "b"]}}]},
    {"context": {"role_prompt": "r", "messages": [{"role": "tool", "content": "", "name": None}],
                 "tools": [{"name": "t", "description": "d", "source": "mcp", "server": None, "input_schema": {"type": "object"}}]}},
    {"expect_trajectory": {"argument_assertions": [
        ASSERTION, {"tool": "t", "path": "p", "in": [1, "a", 2.5, True]}, {"tool": "t", "path": "p", "required": True},
        {"tool": "t", "path": "p", "matches": "^x", "equals": None}]}},
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("strict") / "set.jsonl"
    odd = ["{", "[]", '"text"', "null", "7", '{"id": "no-prompt"}']
    records = [{"id": f"fault-{k}", "prompt": "p", **extra} for k, (extra, _, _) in enumerate(FAULTS)]
    records += [{"id": f"fine-{k}", "prompt": "p", **extra} for k, extra in enumerate(ALLOWED)]
    path.write_text("\n".join([*map(json.dumps, records), *odd]) + "\n")
    cases, rejects = case_source.read_cases(spark, str(path))
    return cases.collect(), rejects.collect()


def test_every_fault_is_a_reject_with_its_place(parsed):
    got = {json.loads(r.value)["id"]: (r["at"], r.problem) for r in parsed[1] if '"fault-' in r.value}
    assert got == {f"fault-{k}": (at, problem) for k, (_, at, problem) in enumerate(FAULTS)}


def test_what_is_allowed_stays_a_case(parsed):
    assert sorted(r.id for r in parsed[0]) == [f"fine-{k}" for k in range(len(ALLOWED))]
    empty = next(r for r in parsed[0] if r.id == "fine-0")
    assert (empty.severity, empty.expected_skills, empty.turns) == ("medium", [], None)


def test_lines_that_are_no_case(parsed):
    got = {r.value: (r["at"], r.problem) for r in parsed[1] if '"fault-' not in r.value}
    assert got == {**dict.fromkeys(["{", "[]", '"text"', "null", "7"], (None, "not a JSON object")),
                   '{"id": "no-prompt"}': (None, "id or prompt missing")}
