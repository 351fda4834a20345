"""Readers on real files, writers, streaming and plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from evalgrain.operators import plugins
from evalgrain.session import materialize, new_folder
from evalgrain.sources import cases as case_source, runs as run_source, sessions, skills as skill_source
from evalgrain.sources.lines import read_lines
from evalgrain.streaming import ingest


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_line_keys_rise_across_splits(spark, tmp_path):
    path = write(tmp_path / "big.txt", [f"{i:05d}" for i in range(4000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 3
        got = [r["value"] for r in lines.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"{i:05d}" for i in range(4000)]


def test_read_runs(spark, tmp_path, rows):
    write(tmp_path / "set__m" / "e1" / "runs.jsonl", [
        json.dumps({"case_id": "a", "repeat_index": 0, "model": "m", "selected_skills": ["x"]}), "",
        json.dumps({"case_id": "b", "repeat_index": 1, "model": "m", "status": "failed", "error": "boom", "ok": False}),
        json.dumps({"case_id": "c", "repeat_index": 1, "model": "m", "ok": True, "usage": {"total_tokens": 5}})])
    got = rows(run_source.read_runs(spark, str(tmp_path / "*" / "*" / "runs.jsonl")).select(
        "run_id", "case_id", "status", "ok", "error_kind", "turn_index", "usage.total_tokens"))
    assert [(r["case_id"], r["status"], r["ok"], r["error_kind"]) for r in got] == [
        ("a", "success", True, None), ("b", "failed", False, "harness"), ("c", "success", True, None)]
    assert {r["run_id"] for r in got} == {"set__m/e1"} and got[2]["total_tokens"] == 5.0


def test_broken_run_line_fails(spark, tmp_path):
    path = write(tmp_path / "r" / "e" / "runs.jsonl", ["{broken"])
    with pytest.raises(Exception):
        run_source.read_runs(spark, path).collect()


def test_read_cases_and_status(spark, tmp_path, rows):
    path = write(tmp_path / "set.jsonl", [
        "# generator: g", "# review_status: draft — not read", '{"id": "x-pos-01", "prompt": "p", "expected_skills": ["x"]}',
        "# review_status: APPROVED", '{"id": "y", "prompt": "p", "colour": 1}', '{"id": "z", "prompt": "p", "severity": "urgent"}', "{"])
    cases, rejects = case_source.read_cases(spark, path)
    assert [r["id"] for r in rows(cases)] == ["x-pos-01"]
    assert sorted(r["problem"] for r in rows(rejects)) == ["not a JSON object", "unknown field", "unknown severity"]
    status = case_source.read_review_status(spark, path)
    assert status.first()["review_status"] == "DRAFT"
    assert case_source.approved_only(cases, status).count() == 0


def test_read_run_dim_json(spark, tmp_path):
    write(tmp_path / "g" / "e" / "config.snapshot.json", [json.dumps(
        {"suite": {"suite_id": "s", "repeats": 3, "scoring": {"gate": {"top1": ">= 0.9"}}}, "mock": True})])
    row = run_source.read_run_dim(spark, str(tmp_path / "g" / "e")).first()
    assert (row["run_id"], row["suite"]["suite_id"], row["mock"]) == ("g/e", "s", True)


def test_latest_run(spark, tmp_path):
    import os
    old = write(tmp_path / "g" / "old" / "runs.jsonl", ["{}"])
    write(tmp_path / "g" / "new" / "runs.jsonl", ["{}"])
    os.utime(old, (1, 1))
    assert run_source.latest_run(spark, str(tmp_path / "*" / "*" / "runs.jsonl")).first()["run_id"] == "g/new"


def test_skills_and_manifest(spark, tmp_path, rows):
    write(tmp_path / "k" / "pdf" / "v1" / "SKILL.md", ["---", "name: pdf", "description: Reads PDF.", "triggers: [a, b]", "---", "body"])
    write(tmp_path / "k" / "pdf" / "v10" / "SKILL.md", ["---", "name: pdf", "disable: true", "---", "body"])
    write(tmp_path / "k" / "odd" / "v1" / "SKILL.md", ["---", "name: yes", "---", "body"])
    write(tmp_path / "k" / "pdf" / "notes" / "SKILL.md", ["x"])
    write(tmp_path / "k" / "pdf" / "v1" / ".git" / "x", ["x"])
    skills = skill_source.read_skill_catalog(spark, str(tmp_path / "k"))
    assert [(r["skill_id"], r["version"], r["disabled"]) for r in rows(skills.select("skill_id", "version", "disabled"))] == [
        ("odd", "v1", False), ("pdf", "v1", False), ("pdf", "v10", True)]
    manifest = skill_source.file_manifest(spark, str(tmp_path / "k" / "pdf"))
    assert sorted(r["path"] for r in rows(manifest)) == ["notes/SKILL.md", "v1/SKILL.md", "v10/SKILL.md"]


@pytest.mark.parametrize("front, want", [
    (["disable: True"], ("s", "", [], True)), (["disable: yes"], ("s", "", [], True)), (['disable: "true"'], ("s", "", [], False)),
    (["enabled: off"], ("s", "", [], True)), (["name: a  # the name", "description: one", "  two"], ("a", "one two", [], False)),
    (['triggers: ["a, b", c]'], ("s", "", ["a, b", "c"], False)), (["name: 'no'", "triggers:"], ("no", "", [], False)),
    (["name: [", "disable: true"], ("s", "", [], False)), (["- list"], ("s", "", [], False))])
def test_front_matter_is_yaml(spark, front, want):
    text = "\n".join(["---", *front, "---", "body"])
    files = spark.createDataFrame([("/k/s/v1/SKILL.md", bytearray(text, "utf-8"))], "path string, content binary")
    row = skill_source.skill_documents(files).first()
    assert (row["skill_id"], row["description"], row["triggers"], row["disabled"]) == want


def test_session_file(spark, tmp_path, rows):
    def message(**body):
        return json.dumps({"type": "message", "message": body})

    path = write(tmp_path / "s.jsonl", [
        message(role="assistant", content=["bare", 7, None, {"type": "text", "text": "hi"},
                                           {"type": "toolCall", "id": "c1", "name": "write",
                                            "arguments": {"api_key": "k", "body": "x" * 900}}]),
        "not json", message(role="toolResult", toolCallId="c1", toolName="write", isError=False),
        message(role="assistant", content=[{"type": "tool_use", "id": "c2", "name": "no"}, {"type": "toolUse", "id": "c3", "name": "read",
                                                                                         "arguments": "text", "input": {"p": 1}}]),
        message(role="toolResult", toolCallId="c3", toolName="read", isError=True)])
    got = sessions.read_session_events(spark, path).orderBy("step_index").select(
        "step_index", "event_type", "tool_name", "call_id", "status", F.to_json("arguments").alias("a")).collect()
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [
        (1, "tool_call", "write", "c1", "started"), (2, "tool_result", "write", "c1", "success"),
        (3, "tool_call", "read", "c3", "started"), (4, "tool_result", "read", "c3", "failed")]
    first = json.loads(got[0]["a"])
    assert first["api_key"] == "<redacted>" and first["body"] == "x" * 900
    assert json.loads(got[2]["a"]) == {"p": 1}


def test_scores_are_never_overwritten(spark):
    scores = spark.createDataFrame([("r", "m", 1.0)], "run_id string, metric string, value double")
    folder = new_folder(spark, "scores")
    run_source.write_scores(scores, folder)
    with pytest.raises(Exception):
        run_source.write_scores(scores, folder)


def test_materialize(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert materialize(df).exceptAll(df).count() == 0


def test_gold_problems(spark, tmp_path, rows):
    gold = {"schema_version": "1.0", "calibration_id": "c", "dimension_versions": {"relevancy": "v1", "tone": "v1"},
            "annotations": [{"case_id": "a", "dimension": "relevancy", "score": 1.0, "rationale": "r"}] * 2}
    path = write(tmp_path / "gold.json", [json.dumps(gold)])
    documents = run_source.read_documents(spark, path)
    found = run_source.gold_problems(
        run_source.read_human_gold(spark, path, scored=True), run_source.declared_dimensions(documents).drop("version"),
        ["case_id", "repeat_index", "turn_index", "dimension"])
    assert sorted((r["dimension"], r["problem"]) for r in rows(found)) == [
        ("relevancy", "repeated key"), ("tone", "declared, not annotated"), ("tone", "unknown dimension")]


def test_plugins(spark, rows):
    @plugins.register_evaluator("test-rate", version="v1")
    def rate(tables):
        return tables.runs.groupBy("run_id").agg(F.lit(0.5).alias("value")).withColumn("metric", F.lit("rate"))

    tables = plugins.Tables(runs=spark.createDataFrame([("r",)], "run_id string"))
    assert rows(plugins.gate_metrics(["test-rate"], tables)) == [
        {"run_id": "r", "metric": "rate", "value": 0.5, "conflict": False}]
    assert plugins.manifest(spark, ["test-rate"]).first()["version"] == "v1"
    with pytest.raises(ValueError):
        plugins.register_evaluator("test-rate", version="v1")(lambda t: t.runs)
    with pytest.raises(ValueError):
        plugins.find("nobody")


def test_streaming_ingest(spark, tmp_path):
    write(tmp_path / "in" / "g" / "e" / "runs.jsonl", [json.dumps({"case_id": "a", "repeat_index": 0, "model": "m"})])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = ingest.land_runs(spark, str(tmp_path / "in" / "*" / "*"), out, state, once=True)
    query.awaitTermination(120)
    row = spark.read.parquet(out).first()
    assert (row["run_id"], row["case_id"], row["status"], row["ok"]) == ("g/e", "a", "success", True)
