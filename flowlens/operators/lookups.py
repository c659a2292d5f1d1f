"""Registry lookups as joins. Dimensions come from ``valid_action_codes`` / ``valid_dcx_codes``.

Callers pass the dimensions through ``measured`` once: broadcast when measured small, shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.text import dcx_key, starts_with_zero
from flowlens.schemas import DEFAULT, UNKNOWN

c = F.col


def with_action(rows: DataFrame, codes: DataFrame, name: str = "action_name", prefix: str = "") -> DataFrame:
    """Adds action_code, action_type (null if the name is unknown) and the membership flag ``known``."""
    dim = codes.select(
        c("action_name").alias(f"_{prefix}key"),
        c("action_code").alias(f"{prefix}action_code"),
        c("action_type").alias(f"{prefix}action_type"),
        F.lit(True).alias(f"{prefix}known"),
    )
    joined = rows.join(dim, c(name) == c(f"_{prefix}key"), "left").drop(f"_{prefix}key")
    return joined.withColumn(f"{prefix}known", F.coalesce(f"{prefix}known", F.lit(False)))


def with_default_code(rows: DataFrame, codes: DataFrame, default_name: str) -> DataFrame:
    """Code of the name, else of the default name; a known name with a null code stays null."""
    joined = with_action(rows.withColumn("_default", F.lit(default_name)), codes, "_default", "default_")
    return (
        joined.withColumn("code_or_default", F.when(c("known"), c("action_code")).otherwise(c("default_action_code")))
        .withColumn("name_or_default", F.when(c("known"), c("action_name")).otherwise(F.lit(default_name)))
        .drop("_default", "default_action_code", "default_action_type", "default_known")
    )


def names_by_code(codes: DataFrame) -> DataFrame:
    """One name per code: the smallest."""
    return codes.filter(c("action_code").isNotNull()).groupBy("action_code").agg(F.min("action_name").alias("action_name"))


def with_dcx(rows: DataFrame, dcx: DataFrame, flow_type: Column | None = None, modem_type: Column | None = None) -> DataFrame:
    """Adds ``dcx_action_code``: a discriminated probe, then the all-default one.

    Codes starting with 0 are told apart by modem type, others by flow type. The second probe also answers when
    the first row exists but holds no code.
    """
    default = F.lit(DEFAULT)
    flow = F.lit(None).cast("string") if flow_type is None else flow_type
    modem = F.lit(None).cast("string") if modem_type is None else modem_type
    code = c("action_code")
    first = F.when(
        code.isNotNull(),
        F.when(starts_with_zero(code), dcx_key(code, default, modem)).otherwise(dcx_key(code, flow, default)),
    )
    second = F.when(code.isNotNull(), dcx_key(code, default, default))
    probe1 = dcx.select(c("dcx_key").alias("_k1"), c("dcx_action_code").alias("_d1"))
    probe2 = dcx.select(c("dcx_key").alias("_k2"), c("dcx_action_code").alias("_d2"))
    return (
        rows.withColumn("_p1", first)
        .withColumn("_p2", second)
        .join(probe1, c("_p1") == c("_k1"), "left")
        .join(probe2, c("_p2") == c("_k2"), "left")
        .withColumn("dcx_action_code", F.coalesce("_d1", "_d2"))
        .drop("_p1", "_p2", "_k1", "_k2", "_d1", "_d2")
    )


def resolve(rows: DataFrame, codes: DataFrame, dcx: DataFrame) -> DataFrame:
    """Known names with their merged triplet; a missing second code becomes ``UNKNOWN``."""
    known = with_action(rows, codes).filter(c("known"))
    return with_dcx(known, dcx).withColumn("dcx_action_code", F.coalesce("dcx_action_code", F.lit(UNKNOWN)))


def contains_name(rows: DataFrame, codes: DataFrame) -> DataFrame:
    return rows.join(codes.select("action_name"), "action_name", "left_semi")


def contains_dcx_key(rows: DataFrame, dcx: DataFrame) -> DataFrame:
    """Rows (action_code, flow_type, modem_type) whose exact key exists, without fallback."""
    keyed = rows.withColumn("_key", dcx_key(c("action_code"), c("flow_type"), c("modem_type")))
    return keyed.join(dcx.select(c("dcx_key").alias("_key")), "_key", "left_semi").drop("_key")


def missing_names(required: DataFrame, codes: DataFrame) -> DataFrame:
    return required.join(codes.select("action_name"), "action_name", "left_anti")
