"""Session logs of an agent runtime → exact trajectory events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalgrain.functions.arguments import as_object, redact_arguments
from evalgrain.operators import ordered
from evalgrain.sources.lines import read_lines

# Fixed values.
CALL_BLOCKS = ("toolcall", "tooluse", "functioncall")


ENTRY = (
    "type string, message struct<role: string, content: array<variant>, toolName: string, "
    "toolCallId: string, isError: boolean, timestamp: bigint>"
)


def session_events(lines: DataFrame, keys: list[str], source: str = "session") -> DataFrame:
    """Tool calls and results of each session, numbered in log order.

    `lines`: keys, line_no, value. Lines that are no JSON object are ignored.
    Each line yields a short array; steps are numbered through the session by
    adding up event counts, so a long session is not gathered.
    """
    message = lines.filter(F.col("value").contains("message")) \
        .select(*keys, "line_no", F.from_json("value", ENTRY).alias("_e")) \
        .select(*keys, "line_no", (F.col("_e.type") == "message").alias("_is_message"), "_e.message.*")
    fields = (("type", "string"), ("id", "string"), ("name", "string"),
              ("arguments", "variant"), ("input", "variant"), ("parameters", "variant"))
    objects = F.transform(F.filter("content", lambda x: F.coalesce(as_object(x).isNotNull(), F.lit(False))),
                          lambda x: F.struct(*[F.try_variant_get(x, f"$.{n}", kind).alias(n) for n, kind in fields]))
    blocks = F.filter(objects, lambda x: F.coalesce(
        F.lower(F.trim(x["type"])).isin(*CALL_BLOCKS) & (x["name"] != ""), F.lit(False)))
    result = F.array(F.struct(*[
        (F.col(column) if column else F.lit(None)).cast(kind).alias(name)
        for name, column, kind in (
            ("type", "role", "string"), ("id", "toolCallId", "string"), ("name", "toolName", "string"),
            ("arguments", None, "variant"), ("input", None, "variant"), ("parameters", None, "variant"))]))
    found = F.when(F.col("_is_message") & (F.col("role") == "assistant"), blocks) \
        .when(F.col("_is_message") & (F.col("role") == "toolResult") & (F.col("toolName") != ""), result)
    counted = ordered.running_totals(
        message.select(*keys, "line_no", "role", "isError", "timestamp", found.alias("_found")),
        keys, "line_no", {"_upto": F.coalesce(F.array_size("_found"), F.lit(0)).cast("bigint")})
    events = counted.select(
        *keys, "role", "isError", "timestamp", (F.col("_upto") - F.size("_found")).alias("_before"),
        F.posexplode("_found").alias("_pos", "_e"))
    is_call = F.col("role") == "assistant"
    status = F.when(is_call, "started").when(F.coalesce("isError", F.lit(False)), "failed") \
        .otherwise("success")
    arguments = F.coalesce(*[as_object(F.col(f"_e.{f}")) for f in ("arguments", "input", "parameters")])
    return events.select(
        *keys, (F.col("_before") + F.col("_pos") + 1).cast("int").alias("step_index"),
        F.when(is_call, "tool_call").otherwise("tool_result").alias("event_type"),
        "_e.name", F.col("_e.name").alias("tool_name"), F.col("_e.id").alias("call_id"),
        arguments.alias("arguments"), status.alias("status"), F.lit("exact").alias("evidence_level"),
        F.when(~is_call & (F.col("timestamp") >= 0), F.col("timestamp")).alias("timestamp_ms"),
        F.lit(source).alias("source"),
    ).withColumn("arguments", redact_arguments(F.col("arguments")))


def read_session_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of all session files; a file is a session."""
    return session_events(read_lines(spark, path), ["file_path"])
