"""Schemas of the data model, and parameters as JSON."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Structs of the model's values, as DDL.
READ = "struct<seq:string,qual:array<int>>"
RANGE = "struct<lower:int,upper:int,reversed:boolean>"
MUTATION = "struct<kind:string,position:int,from_:string,to:string>"
ALIGNMENT = f"struct<seq1:string,mutations:array<{MUTATION}>,range1:{RANGE},range2:{RANGE},score:float>"
SINGLE_READ = f"struct<read_id:bigint,description:string,data:{READ}>"
PAIRED_READ = f"struct<read_id:bigint,r1:struct<description:string,data:{READ}>,r2:struct<description:string,data:{READ}>>"
CLUSTER_NODE = "struct<id:bigint,root_id:bigint,parent_id:bigint,depth:int>"


def sequence_field(name: str, alphabet: str, nullable: bool = True) -> T.StructField:
    """A string column that says which alphabet it holds."""
    return T.StructField(name, T.StringType(), nullable, {"alphabet": alphabet})


def tag_alphabet(column: Column, name: str, alphabet: str) -> Column:
    return column.alias(name, metadata={"alphabet": alphabet})


def alphabet_of(field: T.StructField) -> str | None:
    return field.metadata.get("alphabet")


def to_json(parameters) -> str:
    """A parameter object (dataclass) as JSON, with its class's name."""
    return json.dumps({"type": type(parameters).__name__} | dataclasses.asdict(parameters), sort_keys=True)


def from_json(text: str, *classes: type):
    """The object again, of one of the classes."""
    data = json.loads(text)
    kind = {c.__name__: c for c in classes}.get(data.pop("type", None))
    if kind is None:
        raise ValueError("unknown parameter type")
    unknown = set(data) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) and "tuple" in str(fields[k].type) else v for k, v in data.items()})


def encode_struct(column: Column) -> Column:
    return F.to_json(column)


def decode_struct(column: Column, schema: str) -> Column:
    return F.from_json(column, schema)
