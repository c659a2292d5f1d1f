"""Reading and writing JSON bodies and arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.text import is_blank, same_text

# Attribute name and passing value of a task body.
BODY_STATUS = "taskStatus"
BODY_PASSED = "Passed"


def is_object(json: Column, corrupt: Column) -> Column:
    """True if the text is one readable JSON object.

    ``from_json`` answers a struct of nulls for blank, malformed and non-object text alike, which cannot be told from
    ``{}``; the corrupt-record column and the first character tell them apart without a second parse.
    """
    return F.coalesce(json.rlike(r"^\s*\{"), F.lit(False)) & corrupt.isNull()


def first_attribute(attributes: Column, name: str) -> Column:
    """Value of the first entry called ``name`` (any case); later entries never count, even if it is null."""
    return F.get(F.filter(attributes, lambda a: same_text(a["name"], name)), 0)["value"]


def verdict_struct(present: Column, attributes: Column, status_code: Column, change_reason: Column) -> Column:
    """The few values batch closing needs from one task body, small enough to shuffle in its place."""
    return F.struct(
        present.alias("parsed"),
        F.when(present, first_attribute(attributes, BODY_STATUS)).alias("body_status"),
        F.when(present, status_code).alias("status_code"),
        F.when(present, change_reason).alias("change_reason"),
    )


def verdict_of_struct(result: Column) -> Column:
    return verdict_struct(
        result.isNotNull(),
        result["taskFlowResponse"]["characteristic"],
        result["taskStatusCode"],
        result["statusChangeReason"],
    )


def verdict_of_body(json: Column, task_flow: Column, status_code: Column, reason: Column, corrupt: Column) -> Column:
    return verdict_struct(is_object(json, corrupt), task_flow["characteristic"], status_code, reason)


def href_or_null(result: Column) -> Column:
    href = result["taskFlowResponse"]["href"]
    return F.when(~is_blank(href), href)


def to_attributes(values: Column, type_name: str = "String") -> Column:
    """Map of text values to an ordered array of (name, value, valueType); a null value has no type."""
    return F.transform(
        F.map_entries(values),
        lambda e: F.struct(
            e["key"].alias("name"),
            e["value"].alias("value"),
            F.when(e["value"].isNotNull(), F.lit(type_name)).alias("valueType"),
        ),
    )


def append_if_absent(existing: Column, new: Column) -> Column:
    """Existing entries in order, then ``new`` unless an entry has its id."""
    kept = F.coalesce(existing, F.filter(F.array(new), lambda _: F.lit(False)))
    present = F.exists(kept, lambda e: F.coalesce(e["id"] == new["id"], F.lit(False)))
    return F.when(present, kept).otherwise(F.concat(kept, F.array(new)))
