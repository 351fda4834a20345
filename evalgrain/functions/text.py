"""String expressions: identifiers, hashes, prompts, error texts, model output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
CASE_TYPES = ("pos", "amb", "multi", "rej")
CASE_STAGES = ("trigger", "logic", "artifact", "failure")
SYSTEM_KINDS = ("runtime", "network", "harness")
NO_LABEL = "∅"
QUOTA_WORDS = (
    "quota", "insufficient balance", "insufficient credits", "billing hard limit",
    "account is in good standing", "overdue payment", "arrearage",
)
AUTH_WORDS = (
    "authentication", "unauthorized", "invalid api key", "invalid_api_key", "forbidden",
)
DNS_WORDS = (
    "dns", "name or service not known", "nodename nor servname", "getaddrinfo",
)
NETWORK_WORDS = (
    "econnrefused", "enotfound", "etimedout", "socket hang up", "network",
    "fetch failed", "rate limit", "429", "502", "503", "504", "timeout",
)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def case_type(case_id: Column) -> Column:
    """Second segment from the right of a dash-separated id; `?` when it has none."""
    parts = F.split(case_id, "-")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise(F.lit("?"))


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def normalize_prompt(text: Column) -> Column:
    """Unicode whitespace collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def model_identity(name: Column) -> Column:
    """The part of a model name that no provider prefix changes."""
    trimmed = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), "/+$", "")
    return F.element_at(F.split(trimmed, "/"), -1)


def slug(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._+-]", "-"), "^-+|-+$", "")
    return F.when(cleaned == "", F.lit("unknown")).otherwise(cleaned)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def full_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def version_order(version: Column) -> Column:
    """`v10` after `v9`, `v1.1` after `v1`: integer arrays compare element by element."""
    digits = F.split(F.regexp_replace(version, "^v", ""), r"\.")
    return F.transform(digits, lambda part: part.cast("int"))


def truncated(text: Column, limit: int) -> Column:
    marker = F.lit(f"\n…[truncated at {limit} chars]")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), marker)).otherwise(text)


def quotable(text: Column) -> Column:
    """Text without whitespace and emphasis marks, for comparing quotes."""
    return F.regexp_replace(text, r"(?U)[\s`*_~]+", "")


def quote_in(quote: Column, text: Column) -> Column:
    return quotable(text).contains(quotable(quote))


def error_kind_from_text(stderr: Column) -> Column:
    return F.when(contains_any(F.lower(stderr), NETWORK_WORDS), F.lit("network")) \
        .otherwise(F.lit("runtime"))


def error_subkind(error_kind: Column, text: Column) -> Column:
    """Diagnosis of a network failure from its text; NULL for every other kind."""
    low = F.lower(text)
    label = (
        F.when(contains_any(low, QUOTA_WORDS), "provider_quota_exhausted")
        .when(contains_any(low, AUTH_WORDS), "provider_authentication")
        .when(contains_any(low, DNS_WORDS), "network_dns")
        .when(low.contains("timeout") | low.contains("timed out"), "network_timeout")
        .when(low.contains("rate") & low.contains("limit"), "provider_rate_limited")
        .otherwise("network_connectivity")
    )
    return F.when((error_kind == "network") & text.isNotNull(), label)


def json_body(raw: Column) -> Column:
    """First `{` to last `}` of a model answer, else the answer itself."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(body != "", body).otherwise(raw)


def parse_selection(raw: Column, catalog: Column) -> Column:
    """struct(parsed, selected, reasoning): ids the answer names that the catalog holds.

    An answer that is no JSON object is `parsed = false`; the caller records a
    task failure. Order and repetition of the answer are kept.
    """
    variant = F.try_parse_json(json_body(raw))
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    ids = F.coalesce(
        F.try_variant_get(variant, "$.selected_skills", "array<string>"),
        F.array().cast("array<string>"),
    )
    reasoning = F.try_variant_get(variant, "$.reasoning", "string")
    return F.struct(
        is_object.alias("parsed"),
        F.when(is_object, F.filter(ids, lambda x: F.array_contains(catalog, x))).alias("selected"),
        F.when(reasoning != "", reasoning).alias("reasoning"),
    )


# Reply fields in order of preference, and the fields of a nested reply.
REPLY_FIELDS = ("text", "reply", "message", "content", "output", "result", "response")
NESTED_REPLY_FIELDS = ("text", "content", "body")


def extract_reply(raw: Column) -> Column:
    """Reply text of a runtime's JSON output; the raw output when nothing fits."""
    variant = F.try_parse_json(raw)
    kind = F.schema_of_variant(variant)
    payloads = F.try_variant_get(variant, "$.payloads", "array<variant>")
    texts = F.filter(
        F.transform(payloads, lambda p: _string_at(p, "$.text")), lambda t: t.isNotNull())
    steps = [F.when(F.size(texts) > 0, F.array_join(texts, "\n")),
             F.when(kind == "STRING", F.try_variant_get(variant, "$", "string"))]
    for field in REPLY_FIELDS:
        value = _string_at(variant, f"$.{field}")
        steps.append(F.when(F.regexp_replace(value, r"(?U)\s+", "") != "", value))
        steps += [_string_at(variant, f"$.{field}.{inner}") for inner in NESTED_REPLY_FIELDS]
    return F.coalesce(*steps, raw)


def _string_at(variant: Column, path: str) -> Column:
    """The value at `path` only when it is a JSON string."""
    value = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(variant, path, "string"))


def extract_meta(raw: Column) -> Column:
    """struct(tools, usage, loaded_skills, resolved_model) from a runtime's JSON output."""
    variant = F.try_parse_json(raw)

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(variant, path, kind)

    agent, tools = "$.meta.agentMeta", "$.meta.toolSummary"
    names = F.coalesce(at(f"{tools}.tools", "array<variant>"), F.array().cast("array<variant>"))
    entries = F.coalesce(
        at("$.meta.systemPromptReport.skills.entries", "array<variant>"),
        F.array().cast("array<variant>"))
    model = non_empty(at(f"{agent}.model", "string"))
    return F.struct(
        F.filter(F.transform(names, lambda n: _string_at(n, "$")), lambda n: n.isNotNull())
        .alias("tools"),
        F.struct(
            at(f"{agent}.usage.input", "double").alias("input_tokens"),
            at(f"{agent}.usage.output", "double").alias("output_tokens"),
            at(f"{agent}.usage.total", "double").alias("total_tokens"),
            at(f"{agent}.usage.reasoningTokens", "double").alias("reasoning_tokens"),
            at(f"{tools}.calls", "double").alias("tool_calls_total"),
            at(f"{tools}.failures", "double").alias("tool_failures_total"),
        ).alias("usage"),
        F.filter(F.transform(entries, lambda e: _string_at(e, "$.name")), lambda n: n.isNotNull())
        .alias("loaded_skills"),
        F.when(model.isNotNull(), F.concat(
            F.coalesce(at(f"{agent}.provider", "string"), F.lit("?")), F.lit("/"), model))
        .alias("resolved_model"),
    )
