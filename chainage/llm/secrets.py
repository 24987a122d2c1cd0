"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every file is content-addressed (SHA-256 of the text). The ledger
holds which pairs of blob and rule version have been scanned and what was found. A run
scans each blob that has no such pair yet, once, however many paths hold it, and joins
the findings back to all paths. Equal blobs are combined map-side before the shuffle;
the join back splits hot blobs (AQE), since it is a plain equi-join of thin rows.

Positions: splitting a text at a pattern gives the gaps between its matches, and their
running lengths give each match's first and last code point.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int = 0  # code points of group `group`; shorter matches drop after they have consumed their text
    group: int = 0
    base: bool = False
    hint: str = ""  # a text without this plain string has no match


#: The base patterns of the contract, then public token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True, "AKIA"),
    # the runs of 24 or more: the same spans as all runs without the short ones
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, False, "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, False, "eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False, "gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False, "xox"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0, False, "AIza"),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]{24,}", 0, 0, False, "sk_live_"),
)
RULE_VERSION = "1"


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Array of (rule, gap, length, ok): the code points before each match and in it."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def one(match: Column, i: Column) -> Column:
        fits = F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least
        return F.struct(F.lit(number).alias("rule"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(match).alias("n"), fits.alias("ok"))

    there = text.contains(rule.hint) if rule.hint else text.rlike(rule.pattern)
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,n:int,ok:boolean>>")
    return F.when(there, F.transform(found, one)).otherwise(none)


def blobs(versions: DataFrame) -> DataFrame:
    """(blob, text): each distinct content of versions (blob, text) once."""
    return versions.groupBy("blob").agg(F.first("text").alias("text"))


def addressed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its text (null: empty) as text and the text's address as blob."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("blob", F.sha2(F.col("text"), 256))


def scan(new: DataFrame, rules: tuple[Rule, ...] = RULES, marks: bool = False) -> DataFrame:
    """(blob, kind, start, end) of new (blob, text). With marks also a row without kind for each blob."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    every = [_matches(F.col("text"), r, k) for k, r in enumerate(rules)]
    if marks:
        zero = F.lit(0)
        every.append(F.array(F.struct(F.lit(None).cast("int").alias("rule"), zero.alias("i"), zero.alias("gap"), zero.alias("n"), F.lit(True).alias("ok"))))
    found = new.select("blob", F.explode(F.concat(*every)).alias("m")).select("blob", "m.*")
    before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before)).where("ok").select("blob", F.get(kinds, F.col("rule")).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end")


class Ledger(NamedTuple):
    """scanned: (blob, rule_version); findings: (blob, rule_version, kind, start, end)."""

    scanned: DataFrame
    findings: DataFrame


def update(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> Ledger:
    """The ledger after docs: scans only blobs without this rule version. Write both tables to keep them."""
    found = blobs(addressed(docs).select("blob", "text"))
    if ledger:
        found = found.join(ledger.scanned.where(F.col("rule_version") == version), "blob", "left_anti")
    scanned = found.select("blob", F.lit(version).alias("rule_version"))
    findings = scan(found, rules).withColumn("rule_version", F.lit(version)).select("blob", "rule_version", "kind", "start", "end")
    if ledger:
        scanned, findings = ledger.scanned.unionByName(scanned), ledger.findings.unionByName(findings)
    return Ledger(scanned, findings)


#: A written ledger: one row without kind for each scanned pair of blob and rule version, and one for each finding.
LEDGER = "blob string, rule_version string, kind string, start bigint, end bigint"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the ledger written under folder; none if there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def extend(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> Ledger:
    """Scans the blobs of docs that the ledger under folder doesn't have with this rule version, and appends them to it; returns what the ledger has of this version.

    What is scanned and what was found is appended by one job, so a run that fails leaves
    the ledger as it was.
    """
    ledger = read_ledger(docs.sparkSession, folder).where(F.col("rule_version") == version)
    seen = ledger.where("kind is null").select("blob")
    rows = addressed(docs).select("blob", "text")
    # addresses alone tell whether there is anything new
    if seen.isEmpty() or not rows.select("blob").distinct().join(seen, "blob", "left_anti").isEmpty():
        new = blobs(rows).join(seen, "blob", "left_anti")
        found = scan(new, rules, marks=True).select("blob", F.lit(version).alias("rule_version"), "kind", *[F.col(c).cast("long") for c in ("start", "end")])
        found.write.mode("append").parquet(folder)
    now = read_ledger(docs.sparkSession, folder).where(F.col("rule_version") == version)
    return Ledger(now.where("kind is null").select("blob", "rule_version"), now.where("kind is not null"))


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): the sorted spans of each blob with findings; rule is the place of their kind among rules. Kinds that rules don't have drop."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    placed = findings.withColumn("rule", (F.array_position(kinds, F.col("kind")) - 1).cast("int")).where("rule >= 0")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end"))).alias("found"))


def of_version(findings: DataFrame, version: str) -> DataFrame:
    """Findings of one version of the rules: what an older version has found says nothing about this one's kinds and spans."""
    return findings.where(F.col("rule_version") == version)


def report(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """One row per row of docs, by the findings of this rule version: doc_id, n_<base kind>, base_sha256, spans.

    Defined edge cases: null and empty texts have no spans (sha256 of nothing, empty
    string); null ids and repeated rows keep their rows; other columns are ignored.
    """
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [k for k, r in enumerate(rules) if r.base]
    named = by_blob(of_version(findings, version), rules)

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
    rows = addressed(docs).select("doc_id", "blob").join(named, "blob", "left").withColumn("found", F.coalesce("found", none))

    def of(k: int):
        return lambda s: s["rule"] == k

    counts = [F.size(F.filter("found", of(k))).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    only_base = F.filter("found", lambda s: s["rule"].isin(base))
    return rows.select("doc_id", *counts, F.sha2(written(only_base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """docs with every span that this rule version has found replaced by the mark (overlapping spans as one) and n_chars brought up to date.

    Defined edge cases: null texts become empty ones; null ids and repeated rows are carried
    as they are; other columns may bear any name; an empty table stays empty.
    """
    given, numbered = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    docs = docs.toDF(*[c if c in ("text", "n_chars") else n for c, n in zip(given, numbered, strict=True)])
    spans = by_blob(of_version(findings, version), rules).withColumnsRenamed({"blob": "__blob", "found": "__found"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__text", text).withColumn("__blob", F.sha2(F.col("__text"), 256)).join(spans, "__blob", "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        until = F.greatest(acc["at"], s["end"])
        kept = F.substring(F.col("__text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(until.alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit(mark))).alias("out"))

    cleaned = F.aggregate("__found", start, step, lambda a: F.concat(a["out"], F.substring(F.col("__text"), (a["at"] + 1).cast("int"), F.length("__text"))))
    out = rows.withColumn("text", F.when(F.col("__found").isNull(), F.col("__text")).otherwise(cleaned))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns).toDF(*given)
