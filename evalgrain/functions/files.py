"""Paths, glob patterns and MIME types."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, functions as F

# State of version control and of the agent runtime, and the files
# the runtime lays out at the root of an empty workspace.
STATE_DIRS = (".git", ".openclaw")
BOOTSTRAP_FILES = (
    "AGENTS.md", "BOOTSTRAP.md", "HEARTBEAT.md", "IDENTITY.md", "SOUL.md",
    "TOOLS.md", "USER.md", "openclaw-workspace-state.json",
)

_STDLIB = mimetypes.MimeTypes(filenames=())
_TYPE_BY_SUFFIX = _STDLIB.types_map[True]
_COMPRESSION = tuple(_STDLIB.encodings_map)
_SHORT_SUFFIX = _STDLIB.suffix_map


def glob_regex(pattern: Column) -> Column:
    """Shell pattern → anchored regex; `*` and `?` cross `/`, matching is case-sensitive.

    Compute it on the case side of a join: one conversion per expectation,
    not one per run.
    """
    literal = F.regexp_replace(pattern, r"([\\.^$|()\[\]{}+])", r"\\$1")
    plain = F.replace(F.replace(literal, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*"))
    body = F.when(pattern.contains("["), _glob_with_sets(pattern)).otherwise(plain)
    return F.concat(F.lit("(?s)^"), body, F.lit("$"))


def _glob_with_sets(pattern: Column) -> Column:
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[!?\]?[^\]]*\]|.)"), F.lit(1))

    def piece(token: Column) -> Column:
        inner = F.regexp_replace(
            F.regexp_replace(token, r"^\[!?|\]$", ""), r"([\\\[\]&^])", r"\\$1")
        charset = F.concat(
            F.when(token.startswith("[!"), F.lit("[^")).otherwise(F.lit("[")), inner, F.lit("]"))
        return (
            F.when(token == "*", F.lit(".*"))
            .when(token == "?", F.lit("."))
            .when((F.length(token) > 2) & token.startswith("[") & (token != "[!]"), charset)
            .otherwise(F.regexp_replace(token, r"([\\.^$|()\[\]{}+*?])", r"\\$1"))
        )

    return F.array_join(F.transform(tokens, piece), "")


def guess_mime(path: Column) -> Column:
    """MIME type by suffix, from the table of the Python standard library."""
    suffix_of = r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$"
    expanded = path
    for short, long in _SHORT_SUFFIX.items():
        expanded = F.when(F.lower(path).endswith(short),
                          F.regexp_replace(path, r"\.[^./]*$", long)) \
            .otherwise(expanded)
    outer = F.regexp_extract(expanded, suffix_of, 1)
    bare = F.when(outer.isin(*_COMPRESSION), F.regexp_replace(expanded, r"\.[^./]*$", "")) \
        .otherwise(expanded)
    suffix = F.lower(F.regexp_extract(bare, suffix_of, 1))
    table = ", ".join(f"'{ext}', '{kind}'" for ext, kind in sorted(_TYPE_BY_SUFFIX.items()))
    return F.try_element_at(F.expr(f"map({table})"), suffix)


def artifact_hit(regex: Column, mime: Column, artifacts: Column) -> Column:
    """Some artifact matches the pattern, is not empty, and has the type its name promises."""
    return F.exists(
        artifacts,
        lambda a: F.coalesce(
            F.regexp_like(a["path"], regex)
            & (a["size_bytes"] > 0)
            & (mime.isNull() | a["mime_type"].isNull() | (a["mime_type"] == "")
               | (a["mime_type"] == mime)),
            F.lit(False)),
    )


def workspace_hit(regex: Column, files: Column) -> Column:
    return F.exists(files, lambda f: F.coalesce(F.regexp_like(f, regex), F.lit(False)))


def is_runtime_state(path: Column, bootstrap: tuple[str, ...] = BOOTSTRAP_FILES) -> Column:
    """Files that belong to version control or to the runtime, not to the run."""
    in_state_dir = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in STATE_DIRS]))
    return in_state_dir | path.isin(*bootstrap) if bootstrap else in_state_dir
