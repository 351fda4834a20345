"""Case files: JSON lines with a leading comment block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from evalgrain import schemas
from evalgrain.sources.lines import read_lines
from evalgrain.sources.strict import Rules, bind, fault, split_fault


_EXPECTED = ("expect_trajectory.", "turns[].expect_trajectory.")
_MATCHERS = ("required", "forbidden", "equals", "in", "matches")
_SCALAR = ("STRING", "BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN")


def _both(*names: str) -> frozenset[str]:
    """Places below the expectations of the case and of its later turns."""
    return frozenset(start + name for start in _EXPECTED for name in names)


def case_rules() -> Rules:
    filled = _both("argument_assertions[].tool", "argument_assertions[].path") | {"turns[].prompt"}
    return Rules(
        nullable=frozenset({"stage", "reference", "expect_trajectory", "turns[].reference", "turns[].expect_trajectory",
                            "context.messages[].name", "context.tools[].server"})
        | _both(*(f"argument_assertions[].{m}" for m in _MATCHERS)),
        required=filled | {"context.messages[].role", "context.messages[].content", "context.tools[].name",
                           "context.tools[].description"},
        filled=filled,
        choices={"context.messages[].role": schemas.CONTEXT_ROLES, "context.tools[].source": schemas.TOOL_SOURCES},
        shapes={"context.tools[].input_schema": ("OBJECT",),
                **{p: _SCALAR for p in _both("argument_assertions[].equals", "argument_assertions[].in[]")}},
        only_true=_both("argument_assertions[].required", "argument_assertions[].forbidden"))


def parse_cases(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects). A line with an unknown field, a bad value or broken JSON is a reject, at any depth.

    Rejects are (file_path, line_no, problem, at, value); `at` is the place of the first fault, such as
    `turns[0].expect_trajectory.goal`, NULL where the whole line is at fault. Flags must be JSON true or false.
    """
    kept = lines.withColumn("value", F.trim("value")) \
        .filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    parsed = kept.select("file_path", "line_no", "value", F.from_json(
        "value", schemas.CASES, {"mode": "PERMISSIVE"}).alias("_c"))
    checked = parsed.withColumn("_f", case_line_fault(F.col("value"), F.col("_c")))
    cases = checked.filter("_f IS NULL").select("file_path", "line_no", "_c.*")
    # A generator, so that the walk is not done once to filter and once more to show what was found.
    rejects = checked.select("file_path", "line_no", F.inline(F.array_compact(F.array(split_fault(F.col("_f"))))), "value")
    return with_defaults(cases), rejects


def read_cases(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return parse_cases(read_lines(spark, path))


def case_line_fault(line: Column, parsed: Column) -> Column:
    """The first fault of a line as `strict` gives it, else NULL. `parsed` is the line as a struct."""
    def expected_fault(holder: Column) -> Column:
        return F.concat(F.lit("expect_trajectory."), bind(holder["expect_trajectory"], expectation_fault))

    kind = StructType.fromDDL(schemas.CASES)
    later = F.transform(parsed["turns"], lambda turn, i: F.concat(
        F.lit("turns["), i.cast("string"), F.lit("]."), expected_fault(turn)))
    return F.when(F.json_object_keys(line).isNull(), "|not a JSON object").otherwise(F.coalesce(
        bind(F.try_parse_json(line),
             lambda v: F.when(v.isNull(), "|not a JSON object").otherwise(fault(v, kind, case_rules()))),
        F.when(parsed["id"].isNull() | parsed["prompt"].isNull(), "|id or prompt missing"),
        F.when(~parsed["severity"].isin(*schemas.SEVERITIES), "severity|unknown severity"),
        F.when(~parsed["stage"].isin(*schemas.STAGES), "stage|unknown stage"),
        expected_fault(parsed), F.get(F.array_compact(later), F.lit(0))))


def expectation_fault(expected: Column) -> Column:
    """Fields of a trajectory expectation that contradict each other."""
    def matchers(assertion: Column) -> Column:
        given = [assertion[name].isNotNull() & (~F.is_variant_null(assertion[name]) if name == "equals" else F.lit(True))
                 for name in _MATCHERS]
        return sum((g.cast("int") for g in given), F.lit(0))

    tools = ("required_tools", "verification_tools", "forbidden_tools")
    return F.coalesce(
        *(F.when(F.size(F.array_distinct(expected[name])) < F.size(expected[name]), f"{name}|repeated tool") for name in tools),
        F.when(F.arrays_overlap(expected["required_tools"], expected["forbidden_tools"]),
               "forbidden_tools|tool required and forbidden"),
        F.when(expected["required_verification"]
               & (F.size(F.coalesce(expected["verification_tools"], F.array().cast("array<string>"))) == 0),
               "verification_tools|no verification tools"),
        F.when(F.exists(expected["argument_assertions"], lambda a: matchers(a) != 1),
               "argument_assertions|not one matcher"))


def with_defaults(cases: DataFrame) -> DataFrame:
    columns = {"severity": F.coalesce("severity", F.lit("medium")),
               "requires_context": F.coalesce("requires_context", F.lit(False)),
               "forbid_artifacts": F.coalesce("forbid_artifacts", F.lit(False))}
    for f in schemas.fields(schemas.CASES):
        if f.dataType.simpleString() == "array<string>":
            columns[f.name] = F.coalesce(f.name, F.array().cast("array<string>"))
    return cases.withColumns(columns)


def header_pairs(lines: DataFrame) -> DataFrame:
    """(file_path, line_no, key, value) of the `# key: value` lines before the first other line."""
    trimmed = lines.withColumn("value", F.trim("value"))
    first_other = trimmed.filter(~F.col("value").startswith("#")) \
        .groupBy("file_path").agg(F.min("line_no").alias("_stop"))
    header = trimmed.filter(F.col("value").startswith("#")).join(first_other, "file_path", "left") \
        .filter("_stop IS NULL OR line_no < _stop")
    pattern = r"^#\s*([^:]+):\s*(.*)$"
    return header.filter(F.col("value").rlike(pattern)).select(
        "file_path", "line_no", F.regexp_extract("value", pattern, 1).alias("key"),
        F.regexp_extract("value", pattern, 2).alias("value"))


def read_review_status(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_path, review_status): the first marker of the leading comment block, else NULL."""
    return review_status(read_lines(spark, path))


def review_status(lines: DataFrame) -> DataFrame:
    """`lines`: file_path, line_no, value. One aggregate; no file is gathered."""
    comment = F.col("value").startswith("#")
    marker = r"review_status:\s*(\S+)"
    per_file = lines.withColumn("value", F.trim("value")).groupBy("file_path").agg(
        F.min(F.when(~comment, F.col("line_no"))).alias("_stop"),
        F.min(F.when(comment & F.col("value").rlike(marker), F.struct(
            "line_no", F.upper(F.regexp_extract("value", marker, 1)).alias("status")))).alias("_m"))
    in_header = F.col("_m").isNotNull() & (
        F.col("_stop").isNull() | (F.col("_m.line_no") < F.col("_stop")))
    return per_file.select("file_path", F.when(in_header, F.col("_m.status")).alias("review_status"))


def approved_only(cases: DataFrame, status: DataFrame) -> DataFrame:
    """Leave out the cases of draft files."""
    drafts = status.filter("review_status = 'DRAFT'").select("file_path")
    return cases.join(drafts, "file_path", "left_anti")
