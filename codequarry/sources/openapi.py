"""OpenAPI 3 and Swagger 2 specifications as endpoint rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codequarry import fixed_values as fixed
from codequarry.functions import names, routes as rf, regex as rx

PARAMETER = "array<struct<name:string,`in`:string,required:boolean,type:string,schema:struct<type:string>>>"
OPERATION = (
    f"struct<operationId:string,summary:string,description:string,tags:array<string>,deprecated:boolean,parameters:{PARAMETER},"
    "requestBody:struct<required:boolean,content:map<string,string>>,responses:map<string,struct<description:string,content:map<string,string>>>>"
)


def spec_files(files: DataFrame) -> DataFrame:
    """Files in a customary place, or anywhere under an OpenAPI or Swagger name outside skipped folders."""
    path = F.col("file_path")
    named = path.rlike(fixed.SPEC_NAME_PATTERN) & ~rx.any_contains(path, fixed.SPEC_SKIP_PARTS)
    return files.where(path.isin(*fixed.SPEC_PATHS) | named)


def _to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    def convert(text: str) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text), default=str)
        except (yaml.YAMLError, ValueError, RecursionError):
            return None

    for files in batches:
        yield files.assign(content=[convert(t) for t in files["content"]])


def as_json(files: DataFrame) -> DataFrame:
    """Texts as JSON; only YAML files pass through a Python worker."""
    narrow = files.select("repo_name", "file_path", "content")
    is_json = F.endswith("file_path", F.lit(".json"))
    converted = narrow.where(~is_json).mapInPandas(_to_json, narrow.schema)
    return narrow.where(is_json).unionByName(converted).where("content is not null")


def _parameters(listed: Column) -> Column:
    source = lambda p: (
        F.when(p["in"].isin("path", "query", "header", "body"), p["in"]).when(p["in"] == "formData", "body").otherwise("query")
    )
    return F.transform(
        F.filter(listed, lambda p: F.coalesce(p["name"], F.lit("")) != ""),
        lambda p: F.struct(
            p["name"].alias("name"), F.lit(-1).alias("position"), source(p).alias("source"),
            F.coalesce(p["schema"]["type"], p["type"]).alias("type_hint"), F.coalesce(p["required"], F.lit(False)).alias("required"),
        ),
    )


def spec_endpoints(files: DataFrame) -> DataFrame:
    """One row per path and verb of every specification (columns repo_name, file_path, content as JSON)."""
    spec = F.col("content")
    server = F.get_json_object(spec, "$.servers[0].url")
    base = (
        F.when(F.get_json_object(spec, "$.swagger").isNotNull(), F.coalesce(F.get_json_object(spec, "$.basePath"), F.lit("")))
        .when(F.contains(server, F.lit("://")), F.regexp_extract(server, r"^[^:]*://[^/]*(/.+)$", 1))
        .when(F.startswith(server, F.lit("/")), server)
        .otherwise("")
    )
    version = F.when(F.get_json_object(spec, "$.swagger").isNotNull(), "swagger2").otherwise("openapi3")
    paths = files.select(
        "repo_name", "file_path", base.alias("base"), version.alias("spec_version"),
        F.explode(F.from_json(F.get_json_object(spec, "$.paths"), "map<string,string>")).alias("path", "item"),
    )
    verbs = paths.select("*", F.from_json("item", "map<string,string>").alias("entries")).select(
        "repo_name", "file_path", "spec_version", F.concat("base", "path").alias("path"), F.col("entries")["parameters"].alias("shared"), F.explode("entries").alias("verb", "body")
    )
    operations = verbs.where(F.col("verb").isin(*fixed.HTTP_VERBS) & F.startswith("body", F.lit("{"))).select(
        "*", F.upper("verb").alias("method"), F.from_json("body", OPERATION).alias("op"), F.from_json("shared", PARAMETER).alias("common")
    )
    empty = F.array().cast(PARAMETER)
    route = rf.normalized(F.col("path"), F.col("method"), F.lit("openapi"))
    all_parameters = _parameters(F.concat(F.coalesce("common", empty), F.coalesce("op.parameters", empty)))
    operation_id = F.coalesce("op.operationId", F.concat_ws("_", "method", "path"))
    return operations.select(
        names.short_hash(F.col("repo_name"), F.col("file_path"), F.col("method"), F.col("path")).alias("id"),
        route.withField("parameters", all_parameters).alias("route"),
        F.concat(F.lit("openapi:"), operation_id).alias("chunk_id"),
        operation_id.alias("qualified_name"),
        "file_path",
        "repo_name",
        F.lit("openapi").alias("language"),
        F.struct(
            F.coalesce("op.summary", F.lit("")).alias("summary"), F.coalesce("op.description", F.lit("")).alias("description"), F.col("op.tags").alias("tags"),
            F.coalesce("op.deprecated", F.lit(False)).alias("deprecated"), F.lit("openapi").alias("source"), "spec_version",
            F.when(F.col("op.requestBody").isNotNull(), F.struct(F.coalesce("op.requestBody.required", F.lit(False)).alias("required"), F.map_keys("op.requestBody.content").alias("content_types"))).alias("request_body"),
            F.transform_values("op.responses", lambda _, r: F.struct(F.coalesce(r["description"], F.lit("")).alias("description"), F.map_keys(r["content"]).alias("content_types"))).alias("responses"),
        ).alias("metadata"),
    )
