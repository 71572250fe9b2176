"""Secret scans (native): an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256). The ledger, two folders of Parquet,
knows which (blob, rule version) pairs have been scanned and what was found; a scan reads only the
pairs it has not seen, and findings are joined back to every row that holds the blob. A match's
position comes from the texts between the matches: what a split at the pattern leaves, and the
matches themselves, in turn.

Defined cases: a null text is an empty blob without findings; very long texts are scanned whole; repeated rows share one scan and
each get its findings; a null doc_id is a row like any other; an empty table adds nothing. Other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.session import fresh_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` are dropped after matching; ``needs`` is a part that every match has."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr(self).encode()).hexdigest()[:12]}"


#: The base rules. [0-9a-f]{32,} and AKIA[A-Z0-9]{12,} match what the open runs of 32 and 16 characters or more do.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 8, r"(?i)password|passwd|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]{12,}", needs="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Kinds that the scan adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("hosted_git", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh[pousr]_"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox[abprs]-"),
)
RULES = BASE + ADDED


def blob_id(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: str, rule: Rule) -> F.Column:
    """array<struct(gap, len, good)>: the characters before each match since the last, its own, and whether it is long enough."""
    column = F.col(text)
    found = F.regexp_extract_all(column, F.lit(rule.pattern), F.lit(0))
    key = found if rule.group == 0 else F.regexp_extract_all(column, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(found.alias("m"), key.alias("k"), F.slice(F.split(column, rule.pattern, -1), 1, F.size(found)).alias("g"))
    return F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["k"]) >= rule.least).alias("good")))


def _likely(text: F.Column, rules) -> F.Column:
    """Whether a text holds what some rule needs."""
    return text.rlike("|".join(f"(?:{r.needs or r.pattern})" for r in rules))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, version, kind, rank, start, end) of rows blob, text, todo (the rule versions to run)."""
    nothing = F.lit(None).cast("array<struct<gap:int,len:int,good:boolean>>")
    found = blobs.where(_likely(F.col("text"), rules))
    per_rule = [
        F.struct(F.lit(r.version).alias("version"), F.lit(r.kind).alias("kind"), F.lit(i).alias("rank"), F.when(F.array_contains("todo", r.version) & F.col("text").rlike(r.needs or r.pattern), _matches("text", r)).otherwise(nothing).alias("matches"))
        for i, r in enumerate(rules)
    ]
    upto = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    return (
        found.select("blob", F.explode(F.array(*per_rule)).alias("r"))
        .where("r.matches is not null")
        .select("blob", "r.version", "r.kind", "r.rank", F.posexplode("r.matches").alias("i", "m"))
        .select("blob", "version", "kind", "rank", (end - F.col("m.len")).alias("start"), end.alias("end"), "m.good")
        .where("good")
        .drop("good")
    )


class BlobLedger:
    """Scanned pairs and findings under ``path``, a folder in a store that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, versions array<string>")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, version string, kind string, rank int, start long, end long")

    def scan(self, docs: DataFrame, rules=RULES) -> DataFrame:
        """Scan what is unseen; returns the pairs added (blob, versions). The findings are written first, so a scan that fails is repeated whole by the next one."""
        versions = F.array(*[F.lit(r.version) for r in rules])
        seen = self.scanned().groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
        first = seen.isEmpty()

        def unseen(rows: DataFrame) -> DataFrame:
            if first:
                return rows.withColumn("todo", versions)
            left = F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>")))
            return rows.join(seen, "blob", "left").withColumn("todo", left).where("size(todo) > 0").drop("seen")

        # Texts that no rule can match are not sent anywhere; their blobs are entered all the same.
        likely = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(_likely(F.col("text"), rules))
        blobs = unseen(likely.select(blob_id(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"]))
        added = unseen(docs.select(blob_id(F.col("text")).alias("blob")).distinct()).select("blob", F.col("todo").alias("versions"))
        run = fresh_path(self.spark, "scan")
        added.write.parquet(run)
        scan_blobs(blobs, rules).write.mode("append").parquet(f"{self.path}/findings")
        new = self.spark.read.schema("blob string, versions array<string>").parquet(run)
        new.write.mode("append").parquet(f"{self.path}/scanned")
        return new

    def report(self, docs: DataFrame, rules=RULES) -> DataFrame:
        """For every row of ``docs``: doc_id, blob, spans (array of start, rank, kind, end, in that order) of these rule versions."""
        current = [r.version for r in rules]
        # A failed scan may have left findings that its repetition wrote again.
        spans = self.findings().where(F.col("version").isin(current)).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "kind", "end"))).alias("spans"))
        empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
        rows = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
        return rows.join(spans, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
