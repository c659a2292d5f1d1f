"""Flow documents: task references, final patches, folding of patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens import schemas as S
from flowlens.functions.text import is_blank, same_text
from flowlens.operators.routing import has_task_ref
from flowlens.operators.skew import CHUNK, number_rows

c = F.col

# Tags of a task reference and of an attribute.
REF_ROLE, REF_TYPE, REF_REFERRED = "TaskFlow", "RelatedEntity", "TaskFlow"
PROCESS_STATUS, CHANGE_REASON, TEXT_TYPE = "processStatus", "statusChangeReason", "string"


def task_refs(events: DataFrame) -> DataFrame:
    """Rows to append to a flow's references, one per usable terminal event."""
    name = c("action_name")
    return events.filter(has_task_ref()).select(
        "correlation_id",
        CHUNK,
        "arrival_seq",
        c("task_flow_id").alias("id"),
        "href",
        F.coalesce(name, F.lit("")).alias("name"),
        F.lit(REF_ROLE).alias("role"),
        F.lit(REF_TYPE).alias("type"),
        F.lit(REF_REFERRED).alias("referred_type"),
        F.when(is_blank(name), REF_REFERRED).otherwise(name).alias("flow_ref_type"),
    )


def merged_refs(existing: DataFrame, new: DataFrame, fields: list[str], keys: tuple[str, ...] = ("correlation_id",)) -> DataFrame:
    """Reference lists in row form: (correlation_id, pos, id, fields…).

    ``existing`` holds (correlation_id, pos, id, fields…) and stays first, in order. A new id is appended once, at
    its first arrival, unless it exists already. Row form keeps a flow with any number of tasks spread over tasks;
    nothing collects a flow's list into one value. With ``keys`` of (flow, list) several lists are merged in the same
    pass, each against its own entries.
    """
    first = (
        new.groupBy(*keys, "id")
        .agg(F.min(F.struct("arrival_seq", CHUNK, *fields)).alias("_r"))
        .select(*keys, "id", "_r.*")
    )
    known = existing.select(*keys, "id").distinct()
    added = first.join(known, [*keys, "id"], "left_anti")
    sizes = existing.groupBy(*keys).agg(F.max("pos").alias("_start"))
    appended = number_rows(added, list(keys), ["arrival_seq"], "pos", sizes).select(*keys, "pos", "id", *fields)
    return existing.select(*keys, c("pos").cast("long"), "id", *fields).unionByName(appended)


#: The two lists of a flow document that refer to its tasks.
RELATED, TASK_FLOW = "relatedEntity", "taskFlow"


def both_lists(refs: DataFrame) -> DataFrame:
    """Each reference for both lists, (…, list, id, href, referred_type): ``taskFlow`` names the action as the referred type."""
    entry = F.explode(F.array(
        F.struct(F.lit(RELATED).alias("list"), c("referred_type").alias("referred_type")),
        F.struct(F.lit(TASK_FLOW).alias("list"), c("flow_ref_type").alias("referred_type")),
    ))
    return refs.select("correlation_id", CHUNK, "arrival_seq", "id", "href", entry.alias("_e")).select(
        "correlation_id", CHUNK, "arrival_seq", "id", "href", "_e.*")


def explode_refs(documents: DataFrame, array: str, fields: dict[str, str]) -> DataFrame:
    """Existing array entries as rows, positions from 1; null entries are dropped."""
    return (
        documents.select(c("id").alias("correlation_id"), F.posexplode(array).alias("_p", "_e"))
        .filter(c("_e").isNotNull())
        .select(
            "correlation_id",
            (c("_p") + 1).cast("long").alias("pos"),
            c("_e.id").alias("id"),
            *[c("_e").getField(w).alias(n) for n, w in fields.items()],
        )
    )


def attribute(name: str, value: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        none.alias("id"),
        F.lit(name).alias("name"),
        value.alias("value"),
        F.lit(TEXT_TYPE).alias("valueType"),
        F.lit(TEXT_TYPE).alias("@type"),
        F.lit(TEXT_TYPE).alias("@baseType"),
        F.lit(None).cast("array<string>").alias("characteristicRelationship"),
    )


def upsert_attributes(existing: Column, status: Column, reason: Column) -> Column:
    """Drop old status and reason entries (any case), append the new ones; a blank reason is left out."""
    empty = F.array().cast(f"array<{S.CHARACTERISTIC}>")

    def kept(e: Column) -> Column:
        return ~(same_text(e["name"], PROCESS_STATUS) | same_text(e["name"], CHANGE_REASON))

    def when_set(test: Column, entry: Column) -> Column:
        return F.when(test, F.array(entry)).otherwise(empty)

    return F.concat(
        F.coalesce(F.filter(existing, kept), empty),
        when_set(status.isNotNull(), attribute(PROCESS_STATUS, status)),
        when_set(~is_blank(reason), attribute(CHANGE_REASON, reason)),
    )


def final_patches(ends: DataFrame, documents: DataFrame) -> DataFrame:
    """Body of the closing patch per flow end: id, state and the whole attribute list.

    ``ends`` has few rows per flow, so the join is on unique document ids. Unknown documents patch an empty list.
    """
    docs = documents.select(c("id").alias("correlation_id"), c("characteristic").alias("_old"))
    return ends.join(docs, "correlation_id", "left").select(
        c("correlation_id").alias("id"),
        "end_seq",
        "state",
        upsert_attributes(c("_old"), c("process_status"), c("status_change_reason")).alias("characteristic"),
    )


def state_patches(rows: DataFrame, state: Column) -> DataFrame:
    """State-only patch rows; a null state is skipped."""
    return rows.withColumn("_s", state).filter(c("_s").isNotNull()).select("id", c("_s").alias("state"))


def fold_patches(patches: DataFrame, fields: list[str]) -> DataFrame:
    """Merge-patch: per document and field the last present value; absent fields stay, arrays are replaced whole."""
    return patches.groupBy("id").agg(*[F.max_by(f, F.when(c(f).isNotNull(), c("seq"))).alias(f) for f in fields])


def folded_at(patches: DataFrame, moments: DataFrame, key: str, fields: list[str], order: str = "arrival_seq") -> DataFrame:
    """``moments`` with each field's last present value among the patches of their key at or before them, null when none.

    Both hold (key, chunk, order); ``fields`` are columns of ``patches``. The running fold scans (key, chunk) pieces, each bounded by the
    chunk size; one row per piece hands the fold of all earlier pieces over. No pair of patch and moment is ever formed.
    """
    asked = moments.select(key, CHUNK, order, F.struct("*").alias("_m"))
    both = patches.select(key, CHUNK, order, *fields).unionByName(asked, allowMissingColumns=True)
    heads = both.groupBy(key, CHUNK).agg(*[F.max_by(f, F.when(c(f).isNotNull(), c(order))).alias(f) for f in fields])
    before = W.partitionBy(key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select(key, CHUNK, *[F.last(f, ignorenulls=True).over(before).alias(f"_c_{f}") for f in fields])
    inside = W.partitionBy(key, CHUNK).orderBy(order, c("_m").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = both.withColumns({f"_r_{f}": F.last(f, ignorenulls=True).over(inside) for f in fields}).filter(c("_m").isNotNull())
    return running.join(carried, [key, CHUNK]).select("_m.*", *[F.coalesce(f"_r_{f}", f"_c_{f}").alias(f) for f in fields])


def appended_entries(patches: DataFrame, array: str) -> DataFrame:
    """The appending variant for one array field, in row form: every entry of every patch in patch order."""
    return patches.select("id", "seq", F.posexplode(array).alias("entry_pos", "_e")).select(
        "id", "seq", "entry_pos", "_e.*"
    )
