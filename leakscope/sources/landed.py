"""Landed JSON of any shape: bodies are parsed once, typed values are taken from them, and what has no such shape is an error row."""
from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.text import strip


class Field(NamedTuple):
    """A value of an item: where it is, its type, and whether an item without it is an error."""

    path: str
    type: str = "string"
    required: bool = False


class Shape(NamedTuple):
    """What bodies of a kind look like: where the list of items is, and the fields of an item."""

    items: str
    fields: Mapping[str, Field]


class Landed(NamedTuple):
    items: DataFrame
    errors: DataFrame


PASTES = Shape("$", {
    "key": Field("$.key", required=True), "title": Field("$.title"), "syntax": Field("$.syntax"), "size": Field("$.size", "int"), "expire": Field("$.expire"),
})
FORUM = Shape("$.data.children", {
    "id": Field("$.data.id", required=True), "title": Field("$.data.title"), "selftext": Field("$.data.selftext"), "body": Field("$.data.body"),
    "permalink": Field("$.data.permalink"),
})


def _wrong(item: Column, name: str, field: Field) -> Column:
    """What is wrong with a field of an item, null if nothing."""
    there = F.try_variant_get(item, field.path, "variant")
    missing = there.isNull() | F.coalesce(F.is_variant_null(there), F.lit(False))
    nested = F.schema_of_variant(there).rlike("^(OBJECT|ARRAY)")  # as text it would be its JSON
    mistyped = ~missing & (F.try_variant_get(item, field.path, field.type).isNull() | nested)
    wrong = F.when(mistyped, F.lit(f"{name} is no {field.type}"))
    return F.when(missing, F.lit(f"no {name}")).otherwise(wrong) if field.required else wrong


def landed_items(raw: DataFrame, shape: Shape, body: str = "body") -> Landed:
    """Bodies -> items (the other columns, position, the shape's fields) and errors (the other columns, position, message).

    Every item of a readable body is either an item or an error, with the first thing that is wrong with it; every body that can't be
    read is one error, without position: nothing in it (null or blank), no JSON (broken, cut off), or no list where the shape has one. A
    body with an empty list yields nothing. A field that isn't there, or null, is null unless it is required. One narrow stage, no
    exchange; a stream works too. Both frames parse the bodies they are asked for; nothing is written.
    """
    keep = [c for c in raw.columns if c != body]
    parsed = raw.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{body}`").alias("_body"), F.try_parse_json(F.col(f"`{body}`")).alias("_v"))
    listed = parsed.withColumn("_items", F.try_variant_get("_v", shape.items, "array<variant>"))
    unread = F.when(F.col("_body").isNull() | (F.length(strip(F.col("_body"))) == 0), "no content").when(F.col("_v").isNull(), "unreadable record")
    unread = unread.when(F.col("_items").isNull(), F.lit(f"no list at {shape.items}"))
    rows = listed.select(*[F.col(f"`{c}`") for c in keep], unread.alias("_unread"), F.posexplode_outer("_items").alias("position", "_i"))
    wrong = F.coalesce(*[_wrong(F.col("_i"), name, field) for name, field in shape.fields.items()])
    judged = rows.withColumn("message", F.when(F.col("_unread").isNotNull(), F.col("_unread")).when(F.col("position").isNotNull(), F.when(
        F.col("_i").isNull(), F.lit("no item")).otherwise(wrong)))
    own = [F.col(f"`{c}`") for c in keep]
    items = judged.filter(F.col("message").isNull() & F.col("position").isNotNull()).select(
        *own, "position", *[F.try_variant_get("_i", field.path, field.type).alias(name) for name, field in shape.fields.items()])
    return Landed(items, judged.filter(F.col("message").isNotNull()).select(*own, "position", F.concat(F.lit("Scan failed: "), "message").alias("message")))
