"""Secret scans over an incremental blob ledger (operator 1, DataFrame functions only).

Every text version is addressed by its SHA-256.  The ledger holds, for each
blob, the rule versions that have scanned it and the spans they found; a run
scans only blob and rule-version pairs that the ledger lacks, writes the new
entries, and joins the findings back to every path (document) of the blob.

Spark has no function that gives the positions of all matches, so a text is
split by the rule and the lengths of gaps and matches add up to positions.

Defined cases: null text is the empty text; null doc_id and repeated rows keep
their rows; matches of one rule are leftmost and do not overlap, matches of
different rules may; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """A versioned pattern; a match counts if ``group`` of it has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    #: A literal without which the pattern cannot match, where there is one.
    literal: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


#: The rules in their order; the first three are the contract's base.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True, literal="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", literal="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", literal="eyJ"),
)

_SPANS = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"
LEDGER = f"blob string, rules array<string>, spans {_SPANS}"


#: Matches that are folded at once.
PART = 256


def in_parts(array: Column) -> Column:
    """The array cut into arrays of PART elements."""
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(PART))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(array, i, F.lit(PART)))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in code points, in order of position."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), judged.alias("judged"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["whole"])
        span = F.struct(
            start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
            stop.cast("bigint").alias("stop")
        )
        good = F.length(x["judged"]) >= rule.least
        return F.struct(stop.cast("bigint").alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(_SPANS)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(
            part["spans"],
            lambda x: F.struct(
                (x["start"] + acc["at"]).alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"),
                (x["stop"] + acc["at"]).alias("stop")
            )
        )
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    # A fold copies its list at each step, so matches are folded by the part and the parts after that.
    folded = F.transform(in_parts(parts), lambda part: F.aggregate(part, zero, step))
    found = F.aggregate(folded, zero, join, lambda acc: acc["spans"])
    there = text.rlike(rule.pattern)
    if rule.literal:
        there = text.contains(rule.literal) & there
    return F.when(there, found).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rules, spans) for the blob and rule-version pairs that ``ledger`` lacks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    spans = []
    for rank, rule in enumerate(rules):
        got = rule_spans(F.col("text"), rule, rank)
        spans.append(got if ledger is None else F.when(F.array_contains("todo", rule.key), got).otherwise(F.array().cast(_SPANS)))
    return blobs.select("blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*spans)).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each document (path) with all spans that the ledger has for its blob, as ``_found``; the input's columns stay."""
    per_blob = ledger.where(F.size("spans") > 0).groupBy(F.col("blob").alias("_blob")).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_found")
    )
    paths = docs.withColumn("_blob", blob_of(F.col("text")))
    return paths.join(per_blob, "_blob", "left").withColumn("_found", F.coalesce("_found", F.array().cast(_SPANS))).drop("_blob")


def keep_ledger(spark: SparkSession, path: str, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger kept at ``path`` lacks of ``docs``, adds it there, and returns the whole ledger.

    ``docs`` may hold any number of versions of a path; a version that any run has scanned under a rule's
    present version is not scanned again, whatever path it had then.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    new = table(scan(docs, spark.read.schema(LEDGER).parquet(path) if there else None, rules), "ledger")
    new.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind>.., base_sha256, spans for every document."""
    new = table(scan(docs, ledger, rules), "ledger")
    found = findings(docs.select("doc_id", "text"), new if ledger is None else ledger.unionByName(new))
    base = [r.kind for r in rules if r.base]
    of_kind = lambda kind: F.filter("_found", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts,
        F.sha2(_listed(F.filter("_found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("_found")).alias("spans")
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``[<kind>]``; overlapping spans are replaced as one, after the first's kind."""
    new = table(scan(docs, None, rules), "ledger")
    found = findings(docs, new)
    rest = lambda text, at: F.substring(text, (at + 1).cast("int"), F.length(text))
    between = lambda text, a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc: Column, s: Column, text: Column, begin: Column) -> Column:
        """acc: how far the text is done, and the pieces so far; ``text`` begins at ``begin``."""
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.concat(acc["out"], F.array(between(text, acc["at"] - begin, s["start"] - begin), mark)).alias("out")
        )

    def join(acc: Column, part: Column) -> Column:
        stop = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["stop"])))
        # A one-element array binds the part's own text, so that it is cut out once.
        bound = F.array(F.struct(between(F.col("_text"), acc["at"], stop).alias("text"), acc["at"].alias("at"), acc["out"].alias("out")))
        done = F.transform(
            bound,
            lambda b: F.struct(
                stop.alias("at"),
                F.concat(
                    b["out"],
                    F.array(
                        F.array_join(
                            F.aggregate(
                                part, F.struct(b["at"].alias("at"), F.array().cast("array<string>").alias("out")),
                                lambda c, s: step(c, s, b["text"], b["at"]), lambda c: c["out"]
                            ),
                            ""
                        )
                    )
                ).alias("out")
            )
        )
        return F.element_at(done, 1)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(in_parts(F.col("_spans")), start, join, lambda acc: F.concat(F.array_join(acc["out"], ""), rest(F.col("_text"), acc["at"])))
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col("_text"))
    held = found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").alias("_text"), F.col("_found").alias("_spans"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = held.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
