"""URL filters by hashed expressions, in DataFrame operations only.

A rule names a host and the beginning of a path; it fits that host and its subdomains.
Each URL is expanded into expressions: its host's suffixes (cut at dots) times its path's
prefixes, of the numbers of labels and the path lengths that occur among the rules. An
expression meets the rules by an equi-join on the first PREFIX hex digits of its SHA-256;
pairs that meet are confirmed by their full digests. Of the rules that fit, that of the
lowest tier wins, in it the longest, then that of the longer host, then a block.

Rows equal in id and URL are counted before anything is shuffled, and from there on
everything is keyed by (id, URL), so neither a hot URL nor a hot host gathers rows. Rules
travel to the tasks in slices of at most SLICE rows: each slice is a broadcast of known
size, and a longer rule list costs more passes over the URLs, not more memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.llm.common import ascii_lower, checkpoint

#: Hex digits of the digest that expressions and rules are joined on.
PREFIX = 8
#: Rules of one broadcast (about 200 bytes each).
SLICE = 200_000

#: The rules of the contract, then this library's own, which judge what no other rule fits.
RULES = (
    ("org", "/", "allow", 0),
    ("example.org", "/es/", "block", 0),
    ("example.org", "/en/1", "block", 0),
    ("com", "/fr/", "allow", 0),
    ("com", "/de/", "block", 0),
    ("cheap-pills.example.com", "/", "block", 1),
)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str, int], ...] = RULES) -> DataFrame:
    """(host, path, verdict, tier) of rules given in code."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"), F.lit(t).alias("tier")) for h, p, v, t in rules]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def labels_of(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """The suffixes of host with so many labels, each before the prefixes of path of so many code points; as an array."""
    labels = labels_of(host)
    counts = F.filter(F.array(*[F.lit(n) for n in label_counts]), lambda n: n <= F.size(labels))
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    suffix = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    return F.flatten(F.transform(counts, lambda n: F.transform(lengths, lambda m: F.concat(suffix(n), F.substring(path, F.lit(1), m)))))


def _known(rules: DataFrame) -> DataFrame:
    """Usable rules: one row per (host, path, verdict, tier), with its string, digest and shape."""
    plain = rules.select(
        ascii_lower(F.col("host")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("verdict").alias("own_verdict"),
        F.coalesce(F.col("tier").cast("int"), F.lit(0)).alias("tier") if "tier" in rules.columns else F.lit(0).alias("tier"),
    )
    usable = plain.where("host is not null and own_verdict in ('allow', 'block') and (path = '' or path like '/%')").distinct()
    text = F.concat("host", "path")
    shape = (F.size(labels_of(F.col("host"))).alias("labels"), F.length("path").alias("path_length"), F.length("host").alias("host_length"))
    return usable.select(text.alias("own_rule"), digest(text).alias("full"), "own_verdict", "tier", *shape)


def judge(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rows_of_slice: int = SLICE) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, tier.

    rules: (host, path, verdict) and, if wished, tier (0 where it is missing): verdict is
    allow or block, path is empty or begins with /. rule is the winning rule of tier 0,
    null if none fits; verdict that of the winning rule of any tier, else the default; tier
    that of the winning rule. Defined edge cases: a null URL or one without :// has an empty
    host and path and fits no rule of a named host; null ids and repeated rows keep their
    rows; rules without a host, of another verdict or with a path of another form are left
    out; repeated rules count once; no rules or no pages are no error; other columns are
    ignored.
    """
    spark = pages.sparkSession
    given = _known(rules if rules is not None else rule_table(spark))
    shapes = given.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    # both lists hold distinct small numbers: as many as there are lengths of hosts and paths, not as rules
    label_counts, lengths = sorted(shapes["labels"]), sorted(shapes["lengths"])
    slices = max(1, -(-shapes["n"] // rows_of_slice))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n"))
    if slices > 1:
        rows, given = checkpoint(rows), checkpoint(given)
    split = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # every row has an expression, so that the join keeps it
    asked = split.withColumn("expression", F.explode_outer(expressions(F.col("host"), F.col("path"), label_counts, lengths) if shapes["n"] else F.lit(None).cast("array<string>")))
    asked = asked.withColumn("asked", digest(F.col("expression"))).withColumn("prefix", F.substring("asked", 1, PREFIX)).drop("expression")
    order = F.struct(-F.col("tier"), F.length("own_rule"), "host_length", F.col("own_verdict"))

    def met(part: DataFrame) -> DataFrame:
        keyed = F.broadcast(part.withColumn("prefix", F.substring("full", 1, PREFIX)))
        pairs = asked.join(keyed, "prefix", "left")
        # a shared prefix isn't yet a shared expression
        best = F.max(F.when(F.col("asked") == F.col("full"), F.struct(order.alias("order"), "own_rule", "own_verdict", "tier")))
        return pairs.groupBy("page_id", "url", "host", "path", "n").agg(best.alias("best"))

    if slices == 1:
        found = met(given)
    else:
        part = F.pmod(F.xxhash64("full"), F.lit(slices))
        each = [met(given.where(part == i)) for i in range(slices)]
        found = reduce(DataFrame.unionByName, each).groupBy("page_id", "url", "host", "path", "n").agg(F.max("best").alias("best"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.tier") == 0, F.col("best.own_rule")).alias("rule"),
        F.coalesce("best.own_verdict", F.lit(default)).alias("verdict"),
        F.col("best.tier").alias("tier"),
    )


def oracle(rules: tuple[tuple[str, str, str, int], ...] = RULES, default: str = "allow") -> str:
    """The same as DuckDB SQL: each rule against each URL, by string comparison."""
    listed = ", ".join(f"('{h}', '{p}', '{v}', {t})" for h, p, v, t in rules)
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH r(rh, rp, rv, tier) AS (VALUES {listed}),
p AS (SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {lower}) AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT row, rh || rp AS rule, rv, tier, row_number() OVER (PARTITION BY row ORDER BY tier, len(rh || rp) DESC, len(rh) DESC, rv DESC) AS k
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, CASE WHEN tier = 0 THEN rule END AS rule, coalesce(rv, '{default}') AS verdict, tier
FROM p LEFT JOIN m ON p.row = m.row AND m.k = 1
"""
