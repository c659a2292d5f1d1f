"""Secret scans over an incremental ledger of content-addressed texts.

Every version of every document is a blob, named by the SHA-256 of its text. A run scans only (blob, rule version) pairs
that the ledger does not have, one text per blob however many paths hold it, appends its findings, and joins them back to
all paths. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.bits import split_join
from flowlens.llm.spans import Rule, digest_text, listed, locate, replaced
from flowlens.operators.storage import fresh_dir

#: Fixed values of the contract.
RULES = [
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, keep="length(s.value) >= 6",
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
RULE_VERSION = "base-1"
KINDS = [r.kind for r in RULES]
_FOUND = "array<struct<start:int,end:int,kind:string,value:string>>"
LEDGER = f"blob string, rule_version string, findings {_FOUND}"


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, text): the path, the address and the content of every row; a null text counts as empty."""
    body = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(body, 256).alias("blob"), body.alias("text"))


@dataclass
class Ledger:
    """A folder of appended commits of (blob, rule_version, findings) rows, in storage that all executors share."""

    path: str

    def read(self, docs: DataFrame) -> DataFrame:
        spark = docs.sparkSession
        try:
            return spark.read.schema(f"{LEDGER}, commit string").parquet(self.path)
        except Exception as e:  # noqa: BLE001  a ledger without commits has no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], f"{LEDGER}, commit string")

    def commit(self, docs: DataFrame, rules: list[Rule] = RULES, rule_version: str = RULE_VERSION, commit: str = "0") -> None:
        """Scan what is unseen under this rule version. Repeating a commit name replaces that commit only."""
        known = self.read(docs).where((F.col("rule_version") == rule_version) & (F.col("commit") != commit)).select("blob")
        paths = versions(docs).select("doc_id", "blob")
        holders = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(known, "blob", "left_anti")
        chosen = holders.select(F.col("blob").alias("its_blob"), F.col("doc_id").alias("holder")).hint("shuffle_hash")
        fresh = versions(docs).join(chosen, F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("blob") == F.col("its_blob")))
        found = locate(fresh.select("blob", "text"), rules).select(
            "blob", F.lit(rule_version).alias("rule_version"),
            listed([r.kind for r in rules], by_start=True).cast(_FOUND).alias("findings"),
        )
        found.dropDuplicates(["blob"]).write.mode("overwrite").parquet(f"{self.path}/commit={commit}")

    def findings(self, docs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
        """(doc_id, blob, findings) of every row of ``docs``: what the ledger has about its content, spread to all paths.

        Paths join only the blobs with findings; the rest get an empty array, so copies of a clean text meet nobody.
        """
        have = self.read(docs).where(F.col("rule_version") == rule_version).where(F.size("findings") > 0).select("blob", "findings")
        paths = versions(docs).select("doc_id", "blob")
        return paths.join(have, "blob", "left").select(
            "doc_id", "blob", F.coalesce("findings", F.array().cast(_FOUND)).alias("findings")
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, findings) of every row, through a ledger of its own.

    Null and empty texts have no findings. Repeated rows stay repeated, are scanned once and each gets the findings. Rows
    with a null doc_id are scanned and kept. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    ledger = Ledger(fresh_dir(docs.sparkSession, "blob-ledger"))
    ledger.commit(docs)
    return ledger.findings(docs)


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with the same columns and rows, every finding of the ledger replaced in the text, ``n_chars`` following it.

    Texts without a finding stay as they are, nulls included.
    """
    ledger = Ledger(fresh_dir(docs.sparkSession, "blob-ledger"))
    ledger.commit(docs)
    have = ledger.read(docs).where(F.size("findings") > 0).select("blob", "findings", F.xxhash64("blob").alias("h"))
    address = "sha2(coalesce(text, ''), 256)"
    clear, doubtful = split_join(docs, f"xxhash64({address})", have)
    packed = doubtful.select(F.struct("*").alias("row"), F.expr(address).alias("address"))
    met = packed.join(have, F.col("address") == F.col("blob"), "left").withColumn(
        "new", F.when(F.col("findings").isNotNull(), replaced("row.text", "findings", f"'{mark}'")))
    row = met.where("findings IS NOT NULL").withColumn("row", F.col("row").withField("text", F.col("new")))
    if "n_chars" in docs.columns:
        row = row.withColumn("row", F.col("row").withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType)))
    return clear.unionByName(met.where("findings IS NULL").select("row.*")).unionByName(row.select("row.*"))


def count_of(kind: str) -> Column:
    return F.expr(f"CAST(size(filter(findings, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")


def op4(docs: DataFrame) -> DataFrame:
    marked = scan(docs).withColumn("spans", digest_text("findings"))
    return marked.select("doc_id", *map(count_of, KINDS), F.sha2("spans", 256).alias("base_sha256"), "spans")
