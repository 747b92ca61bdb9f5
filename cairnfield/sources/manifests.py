"""Capability manifests, one JSON document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MANIFEST_SCHEMA = (
    "id string, version string, appliesTo array<struct<facet:string,min:double,count:string>>, "
    "intentTriggers array<string>, "
    "contract struct<inputs:map<string,string>,outputs:map<string,string>,"
    "tools:array<struct<name:string,bind:string>>,reasoning:string>, "
    "surface struct<form:string,controls:array<string>,stage:string>, "
    "permissions array<string>, memoryKeys array<string>, reversibility string"
)


def read_manifests(spark: SparkSession, folder: str, one_per_line: bool = False) -> DataFrame:
    """Manifests of a folder, one to a file or one to a line."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", not one_per_line).json(folder)
