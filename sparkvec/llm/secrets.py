"""Operator 9: secret scans over an incremental blob ledger; DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes, so equal texts
are one blob however many paths hold it.  The ledger is a table of what has been
scanned: a row has a blob, the rule versions it was scanned with and what they
found.  A run scans only the (blob, rule version) pairs that the ledger lacks,
appends one batch, and joins the findings of all blobs back to all paths.  Findings
are kept by rule version, and a run reports those of its own versions only.

Spans come from splitting a text at a rule's matches: the lengths of the pieces
and of the matches, summed in order, are code point offsets.

A null text is an empty one.  Repeated rows stay and share a blob; rows with null ids
are scanned like others.  Texts are scanned whole however long.  Spans that start
together stand in the order of the rules.  A table without rows gives none.  Other
columns are kept by :func:`redacted` and not read otherwise.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm._util import shared_dir


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its ``group`` (0: all of it) has ``least`` characters or more."""

    name: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base rules in their order, then the ones that this operator adds.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # runs are matched whole, so the length may stand in the pattern
)
ADDED = (
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    # To the END line; where there is none, over what follows without a space.
    Rule("private_key", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\t\r\n]*-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*)", 0, 1),
)
RULES = BASE + ADDED
FOUND = "array<struct<rule:string,start:int,end:int>>"
MASK = "[SECRET]"


def content_address(text):
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows (blob, rules, found); none if nothing was written yet."""
    schema = f"blob string, rules array<string>, found {FOUND}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _matches(rule: Rule):
    """Per match of a rule in ``text``: characters before it since the last match, its own, and of its group."""
    p = F.lit(rule.pattern)
    size = lambda x: F.length(x)
    gaps = F.transform(F.split("text", rule.pattern, -1), size)
    all_ = F.transform(F.regexp_extract_all("text", p, F.lit(0)), size)
    group = F.transform(F.regexp_extract_all("text", p, F.lit(rule.group)), size) if rule.group else all_
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(all_)).alias("gap"), all_.alias("size"), group.alias("group")),
        lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (x["group"] >= rule.least).alias("good")),
    )
    none = F.array().cast("array<struct<gap:int,size:int,good:boolean>>")
    todo = ~F.array_contains(F.col("known"), rule.key)
    return F.when(todo & F.col("text").rlike(rule.pattern), rows).otherwise(none)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of versions (..., text) that the ledger lacks for some rule, and append the result."""
    spark = versions.sparkSession
    keys = F.array(*[F.lit(r.key) for r in rules])
    known = (
        open_ledger(spark, ledger)
        .select("blob", F.explode("rules").alias("rule"))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("known"))
    )
    blobs = (
        versions.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("blob", content_address(F.col("text")))
        .groupBy("blob")
        .agg(F.first("text").alias("text"))
        .join(known, "blob", "left")
        .withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        .withColumn("rules", F.array_except(keys, "known"))
        .where(F.size("rules") > 0)
    )
    per_rule = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(i).alias("nth"), _matches(r).alias("m")) for i, r in enumerate(rules)])
    flat = F.flatten(
        F.transform(
            per_rule,
            lambda x: F.transform(
                x["m"], lambda m, i: F.struct(x["nth"].alias("nth"), i.alias("i"), x["rule"].alias("rule"), m["gap"].alias("gap"), m["size"].alias("size"), m["good"].alias("good"))
            ),
        )
    )
    rows = blobs.select("blob", "rules", F.explode_outer(flat).alias("m")).select("blob", "rules", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("blob", "nth").orderBy("i")).cast("int")
    found = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    found.groupBy("blob").agg(
        F.first("rules").alias("rules"),
        F.collect_list(F.when(F.col("good"), F.struct("rule", "start", "end"))).alias("found"),
    ).write.parquet(f"{ledger}/batch-{uuid.uuid4().hex}")


def findings(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions, each with ``blob`` and ``found``: spans of all rules by start, then rule order.

    Columns of versions called blob or found are replaced; :func:`redacted` keeps all.
    Without a ledger a new one is made for this run.
    """
    spark = versions.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger"
    scan(versions, ledger, rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    wanted = F.array(*[F.lit(r.key) for r in rules])
    spans = (
        open_ledger(spark, ledger)
        .where(F.size("found") > 0)
        .select("blob", F.explode("found").alias("f"))
        .where(F.array_contains(wanted, F.col("f.rule")))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("nth"), F.col("f.end").alias("end"), F.substring_index("f.rule", "@", 1).alias("rule")))).alias("found"))
    )
    paths = versions.drop("blob", "found").withColumn("blob", content_address(F.col("text")))
    return paths.join(spans, "blob", "left").withColumn(
        "found",
        F.coalesce(
            F.transform("found", lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"))),
            F.array().cast(FOUND),
        ),
    )


def report(found: DataFrame) -> DataFrame:
    """The digest columns of op9 from the rows of :func:`findings`."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    names = [r.name for r in BASE]
    count = lambda name: F.size(F.filter("found", lambda x: x["rule"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("found", lambda x: x["rule"].isin(names))
    return found.select("doc_id", *[count(n) for n in names], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    return report(findings(docs.select("doc_id", "text"), ledger))


def redacted(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """All rows and columns of docs, with every span found in ``text`` replaced by a mask."""
    versions = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").cast("string").alias("text"))
    found = findings(versions, ledger)
    merged = F.expr(
        """aggregate(found, cast(array() as array<struct<start:int,end:int>>), (acc, s) ->
           if(size(acc) > 0 and s.start <= element_at(acc, -1).end,
              concat(slice(acc, 1, size(acc) - 1),
                     array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))),
              concat(acc, array(named_struct('start', s.start, 'end', s.end)))))"""
    )
    clean = F.expr(
        f"""if(size(spans) = 0, text, concat(
              substring(text, 1, spans[0].start),
              array_join(transform(spans, (s, i) -> concat('{MASK}',
                substring(text, s.end + 1, if(i + 1 < size(spans), spans[i + 1].start, length(text)) - s.end))), '')))"""
    )
    out = found.withColumn("spans", merged).withColumn("clean", clean)
    return out.select(*[F.col("clean").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
