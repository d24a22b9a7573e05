"""Secret scans over all historical versions through a ledger of content-addressed blobs.

A version's blob is the SHA-256 of its text. Only pairs of a blob and a rule version that the ledger
has not seen are scanned: equal texts once, known texts only with new or changed rules. Each run
appends one batch to the ledger; a batch that did not end is not read. Findings are joined back to
every path that holds the blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybird.llm.staging import new_folder
from tallybird.llm.texts import whole_text
from tallybird.sources.workspace import _path, is_complete

REDACTED = "<redacted>"


class Rule(NamedTuple):
    """``pattern`` is matched leftmost without overlaps; a match whose ``group`` is shorter than
    ``least`` is dropped after matching. ``cues``: lower-case bytes of which every match holds one
    (compared after lowering A-Z); an empty tuple: always try."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    cues: tuple[bytes, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
        (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, 0, (b"akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 24),
)
# Formats that vendors publish.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 30, 0, (b"private key-----",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 40, 0, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 20, 0, (b"xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0, (b"eyj",)),
)
RULES = BASE_RULES + MORE_RULES
_HEX = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def _may_hold(rule: Rule, data: bytes, lowered: bytes) -> bool:
    """False only if the text cannot match."""
    if rule.kind == "hex":
        return b"\1" * rule.least in data.translate(_HEX)
    return not rule.cues or any(cue in lowered for cue in rule.cues)


def spans(rule: Rule, text: str) -> Iterator[tuple[int, int]]:
    for found in re.finditer(rule.pattern, text):
        if found.end(rule.group) - found.start(rule.group) >= rule.least:
            yield found.start(), found.end()


def _scan(rules: tuple[Rule, ...]):
    by_name = {rule.name: rule for rule in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for text, todo in zip(batch.column("text"), batch.column("todo").to_pylist()):
                data = text.as_buffer().to_pybytes()
                lowered, decoded, own = data.lower(), None, []
                for rule in (by_name[name] for name in todo):
                    if _may_hold(rule, data, lowered):
                        decoded = data.decode("utf-8", "replace") if decoded is None else decoded
                        own += [{"kind": rule.kind, "start": a, "end": b} for a, b in spans(rule, decoded)]
                found.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("todo"), pa.array(found, kind)],
                names=["blob", "rules", "findings"],
            )

    return scan


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rules, findings) of all complete batches; empty for a new ledger."""
    schema = f"blob string, rules array<string>, findings {FINDINGS}"
    fs, root = _path(spark, ledger)
    batches = [s.getPath().toString() for s in fs.listStatus(root)] if fs.exists(root) else []
    batches = [path for path in batches if is_complete(spark, path)]
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*batches)


def update_ledger(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what is new. ``texts``: (blob, text), with repeats.

    Texts move once, to meet equal texts; a blob that holds a third of all rows is combined before
    it moves. Running it again scans nothing.
    """
    spark = texts.sparkSession
    names = F.array(*[F.lit(rule.name) for rule in rules])
    seen = read_ledger(spark, ledger).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen")
    )
    todo = (
        texts.dropDuplicates(["blob"])
        .join(seen, "blob", "left")
        .withColumn("todo", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select("blob", "text", "todo")
    )
    todo.mapInArrow(_scan(rules), f"blob string, rules array<string>, findings {FINDINGS}").write.parquet(
        f"{ledger}/{uuid.uuid4().hex}"
    )


def findings_by_blob(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of blobs with any finding of the given rule kinds, by start, then by the
    order of the rules. One row per blob."""
    order = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (rule.kind, k)])
    rank = F.element_at(order, F.col("found.kind"))
    return (
        read_ledger(spark, ledger)
        .where(F.size("findings") > 0)
        .select("blob", F.explode("findings").alias("found"))
        .withColumn("rank", rank)
        .where("rank IS NOT NULL")
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_set(F.struct("found.start", "rank", "found.end", "found.kind"))
            ).alias("findings")
        )
    )


def scan_versions(
    versions: DataFrame, ledger: str | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(row, blob, findings): every row of ``versions`` as a struct, with the findings of its text.

    ``ledger`` names the ledger's folder; without one a new, empty ledger is used. A null or empty
    text has no findings. Columns of any name pass through in ``row``; repeated rows each get their
    findings; an empty table gives an empty one.
    """
    spark = versions.sparkSession
    ledger = ledger or new_folder(spark, "ledger")
    blob = F.sha2(whole_text(versions, text), 256)
    update_ledger(versions.select(blob.alias("blob"), whole_text(versions, text).alias("text")), ledger, rules)
    found = findings_by_blob(spark, ledger, rules)
    return versions.select(F.struct(*[versions[c] for c in versions.columns]).alias("row"), blob.alias("blob")).join(
        found, "blob", "left"
    )


def listed(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the findings, comma-joined; an empty string for none."""
    wanted = findings if kinds is None else F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.coalesce(
        F.array_join(F.transform(wanted, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","), F.lit("")
    )


def count_of(findings: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(findings, lambda x: x["kind"] == kind)), F.lit(0)).cast("long")


def without_secrets(text: Column, findings: Column) -> Column:
    """The text with every stretch that findings cover replaced by ``REDACTED``; spans that overlap
    or touch make one stretch."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(done: Column, x: Column) -> Column:
        fresh = F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit(REDACTED))
        first = (x["start"] > done["at"]) | (done["at"] == 0)
        return F.struct(
            F.when(first, fresh).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], x["end"]).alias("at"),
        )

    redacted = F.aggregate(
        findings, start, cut, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    )
    return F.when(F.size(findings) > 0, redacted).otherwise(text)


def redact_documents(docs: DataFrame, ledger: str | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, secrets cut out of the text and ``length`` (if there is
    such a column) made the new number of characters. Rows without a finding stay as they are."""
    scanned = scan_versions(docs, ledger, text)
    found = F.col("findings").isNotNull()
    clean = without_secrets(F.col("row")[text], F.col("findings"))
    columns = []
    for name in docs.columns:
        own = F.col("row")[name]
        if name == text:
            own = F.when(found, clean).otherwise(own)
        elif name == length:
            own = F.when(found, F.length(clean).cast(docs.schema[name].dataType)).otherwise(own)
        columns.append(own.alias(name))
    return scanned.select(*columns)
