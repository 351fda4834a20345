"""Cost of a run: tokens and tool calls. Missing telemetry stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(usage: Column) -> Column:
    """Total tokens; else the sum of the parts present; else NULL."""
    total, read, written = usage["total_tokens"], usage["input_tokens"], usage["output_tokens"]
    parts = F.when(
        read.isNotNull() | written.isNotNull(),
        F.coalesce(read, F.lit(0)) + F.coalesce(written, F.lit(0)),
    )
    return F.coalesce(total, parts).cast("double")


def tool_call_count(usage: Column, tool_calls: Column) -> Column:
    """Reported total; else the calls added up, where an unknown or zero count is one call."""
    summed = F.aggregate(
        tool_calls,
        F.lit(0.0),
        lambda acc, call: acc + F.when(F.coalesce(call["count"], F.lit(0)) == 0, F.lit(1.0))
        .otherwise(call["count"].cast("double")),
    )
    return F.coalesce(usage["tool_calls_total"].cast("double"), summed)
