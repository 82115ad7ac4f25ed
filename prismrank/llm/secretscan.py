"""Operator 6 (native): secret scans over an incremental blob ledger.

A text is content-addressed by its SHA-256: it is a blob, and every row that
holds it, of whatever version or path, is a path of that blob.  The ledger has
one row per (blob, rule version) that was ever scanned, and the findings.  A
scan reads only blobs with a rule version that the ledger does not have, runs
just those rules, appends to the ledger, and joins the findings back to all
paths.  Findings are appended before the ledger rows that vouch for them, so a
scan that dies between the two is repeated, and findings are read as a set.

Positions are code points.  A match's start is the length of the gaps and
matches before it: ``split`` gives the gaps and ``regexp_extract_all`` the
matches of the same scan from left to right.

Defined results: a null text is the empty blob; null ids are kept as they are;
repeated rows are paths of one blob, each with the same findings; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismrank.llm._shared import scratch


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched from left to right without overlaps; a match
    stays if its ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    # only runs that can stay: a run of fewer characters is no match at all
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, blob (SHA-256 of the text, binary) and text of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def _matches(rule: Rule) -> F.Column:
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    named = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    return F.arrays_zip(F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(named, F.length).alias("named"))


def scan_blobs(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``todo``: blob, text, rules (keys of the rules to run).  One row per
    match that stays: blob, rule, first, last (code points, end exclusive)."""
    found = None
    for rule in rules:
        hit = todo.filter(F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern))
        # the last gap has no match: its size is null
        rows = hit.select("blob", F.lit(rule.key).alias("rule"), F.posexplode(_matches(rule)).alias("i", "m")).select("blob", "rule", "i", "m.gap", "m.size", "m.named")
        before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("last", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(before)).filter((F.col("named") >= rule.least) & F.col("size").isNotNull())
        rows = rows.select("blob", "rule", (F.col("last") - F.col("size")).cast("long").alias("first"), F.col("last").cast("long").alias("last"))
        found = rows if found is None else found.union(rows)
    return found


class Ledger:
    """Scanned (blob, rule) pairs and findings below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob binary, rule string").distinct()

    def findings(self) -> DataFrame:
        return self._read("findings", "blob binary, rule string, first long, last long").distinct()

    def unseen(self, docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """Each blob once, with its text and the rules that it was not scanned
        with; equal blobs are merged in the map tasks already."""
        seen = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        once = blobs(docs).select("blob", "text").dropDuplicates(["blob"])
        todo = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
        return once.join(seen, "blob", "left").select("blob", "text", todo.alias("rules")).filter(F.size("rules") > 0)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        todo = self.unseen(docs, rules)
        # of the texts only those that any rule matches are kept for the second
        # look, in one written table: usually few
        any_rule = F.lit(False)
        for r in rules:
            any_rule = any_rule | F.col("text").rlike(r.pattern)
        looked = scratch(self.spark, "looked")
        todo.select("blob", "rules", F.when(any_rule, F.col("text")).alias("text")).write.parquet(looked)
        looked = self.spark.read.schema("blob binary, rules array<string>, text string").parquet(looked)
        scan_blobs(looked.filter("text is not null"), rules).write.mode("append").parquet(f"{self.folder}/findings")
        looked.select("blob", F.explode("rules").alias("rule")).write.mode("append").parquet(f"{self.folder}/scanned")


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return, per row of
    ``docs``, doc_id, blob and ``spans``: an array of (first, place of the rule
    in ``rules``, last), in that order, empty where nothing was found."""
    ledger.update(docs, rules)
    place = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))]), F.col("rule"))
    mine = ledger.findings().filter(F.col("rule").isin([r.key for r in rules]))
    per = mine.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("first", place.alias("place"), "last"))).alias("spans"))
    paths = blobs(docs).select("doc_id", "blob")
    nothing = F.array().cast("array<struct<first:bigint,place:int,last:bigint>>")
    return paths.join(per, "blob", "left").select("doc_id", "blob", F.coalesce("spans", nothing).alias("spans"))


def documents_digest(docs: DataFrame) -> DataFrame:
    """The columns that ``op6_secret_scan`` returns.  The ledger starts empty;
    its rules are the base rules, so all spans are base spans."""
    spark = docs.sparkSession
    found = scan(docs, Ledger(spark, scratch(spark, "ledger")))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["first"].cast("string"), s["last"].cast("string"))), ",")
    n = [F.size(F.expr(f"filter(spans, s -> s.place = {i})")).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(RULES)]
    return found.select("doc_id", *n, F.sha2(line, 256).alias("base_sha256"), line.alias("spans"))


def _sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, row_id, {place} AS place, '{kind}' AS kind, gap_sum + size_sum - size AS first, gap_sum + size_sum AS last FROM (
    SELECT doc_id, row_id, size, named, sum(gap) OVER o AS gap_sum, sum(size) OVER o AS size_sum FROM (
      SELECT doc_id, row_id, unnest(range(1, len(m) + 1)) AS i, length(unnest(g[1:len(m)])) AS gap, length(unnest(m)) AS size, length(unnest(v)) AS named
      FROM (SELECT doc_id, row_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d))
    WINDOW o AS (PARTITION BY row_id ORDER BY i))
  WHERE named >= {least}"""


SQL = (
    "WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_sql(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(RULES))
    + """), s AS (
  SELECT row_id, string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, place) AS spans,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex
  FROM f GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (row_id)
"""
)
