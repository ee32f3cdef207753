"""Secret scans over an incremental ledger of text versions, with DataFrame functions only.

Method: a text version (blob) is addressed by the SHA-256 of its bytes. The ledger holds one row for every pair of blob
and rule version that was ever scanned, with its findings, empty ones included. A scan takes the blobs of the
given rows, removes pairs the ledger has, scans each remaining blob once, appends, and joins the findings to
every row (path) that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import shared_path

MASK = "[SECRET]"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Raw matches are leftmost and do not overlap; those whose group is shorter than least go."""

    kind: str
    pattern: str
    least: int
    group: int = 0


#: The kinds in their order. A run of a class is maximal, so its least length can stand in the pattern itself.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
RULE_VERSION = "2"
#: Findings (some 60 bytes each) that go to all executors rather than being joined by a shuffle of the rows.
BROADCAST_SPANS = 500_000


def rule_spans(text: str, rule: Rule, rank: int) -> Column:
    """Spans of one rule in the column named text: code points, end exclusive.

    Places come from the pieces between the raw matches: their lengths and the matches' lengths add up. No piece is
    searched again, so a long text costs one more pass.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    pieces = F.split(F.col(text), rule.pattern, -1)
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit"))
    none = F.expr(f"cast(array() as {SPANS})")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        sound = F.length(x["hit"] if rule.group == 0 else F.regexp_extract(x["hit"], rule.pattern, rule.group)) >= rule.least
        span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.cast("long").alias("at"), F.when(sound, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    folded = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.rlike(F.col(text), pattern), folded).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) to (blob, spans): all rules' spans by start, then rule order."""
    out = blobs
    for rank, rule in enumerate(rules):
        out = out.withColumn(f"_r{rank}", rule_spans("text", rule, rank))
    return out.select("blob", F.sort_array(F.concat(*[F.col(f"_r{rank}") for rank in range(len(rules))])).alias("spans"))


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """The ledger below path, empty before the first scan."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def ledger_scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """docs plus `blob` and `spans` (array of start, rank, end, kind). Scans unseen (blob, rule_version) pairs only.

    ledger: a path all executors share; None: a fresh one in the cluster's shared folder. New findings are appended to
    it before the join, so later calls find them. A blob is kept once by each map task before the shuffle, so groups of
    copies do not meet; only blobs with findings take part in the join back to the rows. They are broadcast up to
    BROADCAST_SPANS findings, counted first, and joined by a shuffle beyond.

    Null texts count as empty (no findings); equal texts share a blob; repeated rows stay; an empty table gives no rows.
    Columns of docs named blob or spans are replaced. A rule change needs a new rule_version.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_path(spark, "ledger")
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    seen = ledger_rows(spark, ledger).where(F.col("rule_version") == rule_version)
    present = docs.select(blob.alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unseen = present.join(seen.select("blob"), "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    scanned = scan(unseen, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    scanned.write.mode("append").parquet(ledger)
    hits = ledger_rows(spark, ledger).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
    # a pair is written once, but two scans at the same time may both append it
    hits = hits.groupBy("blob").agg(F.first("spans").alias("spans"))
    if (hits.agg(F.sum(F.size("spans") + 2)).first()[0] or 0) <= BROADCAST_SPANS:
        hits = F.broadcast(hits)
    rows = docs.drop("blob", "spans").withColumn("blob", blob)
    joined = rows.join(hits, "blob", "left")
    return joined.select(*rows.columns, F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: str) -> Column:
    """The text with every stretch covered by spans replaced by MASK; overlapping spans leave one mask."""
    col, last = F.col(text), F.lit(0).cast("long")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(col, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate(
        F.col(spans),
        F.struct(last.alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(col, (acc["at"] + 1).cast("int"), F.length(col))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(col)
