"""Secret scans over an incremental blob ledger (operator 6). DataFrame functions only.

A blob is the SHA-256 of a text. The ledger is a Parquet table in the shared
folder with one row per blob and scan: which rule versions ran, and what they
found (each span with the rule version it is from). A scan content-addresses every row (every historical version of every
path), takes one owner row per blob, drops the blob and rule-version pairs that
the ledger has, runs the remaining rules over whole texts, appends the result to
the ledger, and joins the ledger's findings of exactly the asked rule versions back to
all paths; spans of other versions stay in the ledger and out of the result.

Texts are never grouped: the owner of a blob is a grouped minimum over hashes and
ids (partial first, so a hot group of copies is one row per task), and the text
comes along by a join on the unique owner key. Findings go back by a join on the
blob, small on the findings' side and split by AQE where a blob has many paths.

Positions come from the pieces between the matches: ``split`` and
``regexp_extract_all`` walk a text the same way, so the lengths of pieces and
matches add up to code point offsets.

Defined cases: a null text is empty and has no findings; copies and repeated rows
share a blob and its findings; an empty table gives no rows and an empty ledger. Further
columns, whatever they are called, are not read by a scan and kept by ``without_secrets``. Long
texts are scanned whole; a rule's matches are placed in blocks, so work and memory grow
with the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.arrays import let
from pairlens.llm import common as c

#: matches of a text that are placed together
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and non-overlapping; those whose ``group`` is
    shorter than ``least`` characters are dropped. ``hint``: a literal every match contains."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The contract's kinds, in its order. Runs of access and hex characters are maximal, so
#: their least length can stand in the pattern; an assign match can hide a later one and can't.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)

#: Kinds that this scan adds: key blocks, signed web tokens, bearer headers, vendor-prefixed tokens, URLs with credentials.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("bearer", 1, r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{20,}", hint="earer "),
    Rule("vendor", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
    # user and password of any length; of a scheme its last 21 characters at most, which changes no more than a span's start
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/@]{3,}+@", hint="://"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:int,k:int,kind:string,end:int>"
#: in the ledger: with the rule's key (null in a ledger written before spans had one)
KEPT_SPAN = "struct<start:int,k:int,kind:string,end:int,rule:string>"
_SPAN_TYPE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("k", T.IntegerType()),
                           T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()),
                           T.StructField("rule", T.StringType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())),
                       T.StructField("findings", T.ArrayType(_SPAN_TYPE))])


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """All spans of one rule as an array, in order; code point offsets, end exclusive. Matches are placed in
    blocks of ``BLOCK``, whose starts are summed first: the work grows with the number of matches."""
    none = F.array().cast(f"array<{KEPT_SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    found = F.zip_with(F.zip_with(F.split(text, rule.pattern, -1), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
                       values, lambda x, v: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(v).alias("own")))

    def step(acc: Column, x: Column) -> Column:
        first, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["n"]
        one = F.array(F.struct(first.alias("start"), F.lit(order).alias("k"), F.lit(rule.kind).alias("kind"), end.alias("end"),
                               F.lit(rule.key).alias("rule")))
        return F.when(x["n"].isNull(), acc).otherwise(F.struct(
            end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans")))

    def in_block(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def starts(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["n"], F.lit(0))))
        return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def cut(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(every) - 1) / BLOCK).cast("int")), lambda b: F.slice(every, b * BLOCK + 1, BLOCK))

    spans = let(let(found, cut), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), in_block)))
    may = F.contains(text, F.lit(rule.hint)) if rule.hint else F.lit(True)
    return F.when(may & text.rlike(rule.pattern), spans).otherwise(none)


def ordered(spans: Column) -> Column:
    """Spans in order, each once: equal ones lie side by side then."""
    return let(F.array_sort(spans), lambda own: F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))))


def empty_ledger(spark: SparkSession) -> str:
    """A new ledger in the shared folder; returns its path."""
    path = c.fresh_path(spark, "ledger")
    spark.range(0).select(F.lit("").alias("blob"), F.array(F.lit("")).alias("rules"), F.array().cast(f"array<{KEPT_SPAN}>").alias("findings")) \
        .write.parquet(path)
    return path


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows, one per blob and scan; a span without a rule's key gets that of its kind in its row."""
    own = lambda x, rules: F.coalesce(x["rule"], F.get(F.filter(rules, lambda r: F.startswith(r, F.concat(x["kind"], F.lit("@")))), F.lit(0)))
    return spark.read.schema(LEDGER).parquet(path).withColumn(
        "findings", F.transform("findings", lambda x: x.withField("rule", own(x, F.col("rules")))))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per blob: rules that ran and all findings."""
    return ledger_rows(spark, path).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"),
        ordered(F.flatten(F.collect_list("findings"))).alias("findings"))


def scan(docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return ``path, blob, findings`` for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .withColumn("blob", F.sha2(F.col("text"), 256))
    paths = c.stored(rows.select("path", "blob"), "paths")
    known = read_ledger(spark, ledger)
    wanted = F.array(*[F.lit(r.key) for r in rules])
    owners = (paths.groupBy("blob").agg(F.min("path").alias("path"))
              .join(known.select("blob", F.col("rules").alias("ran")), "blob", "left")
              .withColumn("todo", F.array_except(wanted, F.coalesce("ran", F.array().cast("array<string>"))))
              .filter(F.size("todo") > 0).select("blob", "path", "todo"))
    owner = owners.alias("o")
    unseen = rows.alias("r").join(owner, F.col("r.blob").eqNullSafe(F.col("o.blob")) & F.col("r.path").eqNullSafe(F.col("o.path"))) \
        .select("o.blob", "o.todo", "r.text")
    none = F.array().cast(f"array<{KEPT_SPAN}>")
    found = F.concat(*[F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r, k)).otherwise(none)
                       for k, r in enumerate(rules)])
    (unseen.select("blob", F.col("todo").alias("rules"), found.alias("findings"))
     .dropDuplicates(["blob"]).write.mode("append").parquet(ledger))
    # the order of kinds is that of ``rules``, whatever it was in the scan that found a span
    asked = F.filter("findings", lambda x: F.array_contains(wanted, x["rule"]))
    spans = F.transform(asked, lambda x: F.struct(
        x["start"].alias("start"), (F.array_position(wanted, x["rule"]) - 1).cast("int").alias("k"), x["kind"].alias("kind"), x["end"].alias("end")))
    hits = (ledger_rows(spark, ledger).select("blob", spans.alias("findings")).filter(F.size("findings") > 0).groupBy("blob")
            .agg(ordered(F.flatten(F.collect_list("findings"))).alias("findings")))
    return paths.join(hits, "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"))


def spans_text(findings: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(findings), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def of_kind(findings: Column, *kinds: str) -> Column:
    return F.filter(findings, lambda x: x["kind"].isin(*kinds))


def without_secrets(docs: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
                    ledger: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has no finding, columns unchanged."""
    spark = docs.sparkSession
    found = scan(docs, ledger or empty_ledger(spark), path, text, rules)
    bad = found.filter(F.size("findings") > 0).select(F.col("blob").alias("bad_blob")).distinct()
    blob = c.own_name(docs, "blob")
    tagged = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return tagged.join(bad, tagged[blob] == bad["bad_blob"], "left_anti").drop(blob)
