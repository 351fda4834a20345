"""Skill documents and file manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalgrain.functions.text import content_hash
from evalgrain.operators import joins

# Fixed values.
VERSION_PATTERN = r"^v\d+(\.\d+)*$"
IGNORED_PARTS = (".git", ".env", "__pycache__", ".DS_Store")
IMPORT_META = "_meta.json"

FRONT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("triggers", T.ArrayType(T.StringType())), T.StructField("exclusions", T.ArrayType(T.StringType())),
    T.StructField("disabled", T.BooleanType())])


@F.pandas_udf(FRONT)
def _front_matter(batch: pd.Series) -> pd.DataFrame:
    """The fields of YAML front matter; broken YAML and YAML that is no mapping have none."""
    import yaml  # only tasks that read skill documents need it

    def words(value) -> list[str]:
        return [str(v) for v in value] if isinstance(value, list) else []

    def fields(front: str) -> tuple:
        try:
            meta = yaml.safe_load(front)
        except yaml.YAMLError:
            meta = None
        meta = meta if isinstance(meta, dict) else {}
        name, about = meta.get("name"), meta.get("description")
        return (name if isinstance(name, str) and name else None, "" if about is None else str(about),
                words(meta.get("triggers")), words(meta.get("exclusions")),
                meta.get("disable") is True or meta.get("enabled") is False)

    return pd.DataFrame([fields(front or "") for front in batch],
                        columns=["name", "description", "triggers", "exclusions", "disabled"])


def skill_documents(files: DataFrame) -> DataFrame:
    """Catalog rows from (path, content). Only the front matter is read, as YAML; the hash covers the file."""
    text = F.col("content").cast("string")
    parts = F.split("path", "/")
    front = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---", 1)
    return files.select(
        "path", content_hash(text).alias("content_hash"), _front_matter(front).alias("_f"),
    ).select(
        F.coalesce("_f.name", F.try_element_at(parts, F.lit(-3))).alias("skill_id"),
        F.try_element_at(parts, F.lit(-2)).alias("version"), "_f.description", "_f.triggers", "_f.exclusions",
        "_f.disabled", "content_hash", F.col("path").alias("source_path"),
    ).filter(F.col("version").rlike(VERSION_PATTERN))


def read_skill_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Skills under <root>/<id>/<vN>/SKILL.md."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "SKILL.md") \
        .load(f"{root.rstrip('/')}/*/*").select("path", "content")
    return skill_documents(files)


def catalog_clashes(skills: DataFrame) -> DataFrame:
    return joins.duplicate_keys(skills, ["skill_id", "version"])


def manifest_of(files: DataFrame, root: str) -> DataFrame:
    """(path, sha256, size_bytes) relative to a root, without transport files. Input: path, content."""
    relative = F.regexp_replace("path", F.lit("^.*?" + _quote(root.rstrip("/")) + "/"), F.lit(""))
    rows = files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"),
                        F.length("content").cast("bigint").alias("size_bytes"))
    ignored = F.arrays_overlap(
        F.split("path", "/"), F.array(*[F.lit(p) for p in IGNORED_PARTS]))
    return rows.filter(~ignored & (F.col("path") != IMPORT_META))


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return manifest_of(files.select("path", "content"), root)


def manifest_digest(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """An order-free digest of each file set: equal sets have equal digests.

    Every (path, hash) pair is hashed to numbers that are added up, so a set of
    any size is combined map-side instead of being sorted in one place.
    """
    pair = F.concat_ws("\0", "path", "sha256")
    digest = F.sha2(pair, 256)
    lanes = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
             for i in range(4)]
    return manifest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.sha2(F.concat_ws("-", *[lane.cast("string") for lane in lanes]), 256).alias("set_digest"))
