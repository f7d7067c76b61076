"""URL filters: rules first, then trust and distrust along host links (operator 9).

A rule names a host (with all its subdomains) and a path prefix; the longest
rule that fits a page decides it. Other pages get their host's verdict: hosts are
seeded by the pages that rules allow (trust) or block (distrust). Trust follows
links by personalised PageRank from its seeds; distrust follows links backwards,
from blocked hosts to those that link to them. Both are in pages, and a host is
blocked where distrust holds more than ``block_share`` of the two and of the host's own
pages, which count ``own_weight`` each: one link of a host of a million pages to a
blocked one blocks nothing.

Host edges come from absolute links in the pages' HTML, counted per pair of hosts
(partial counts first, so a hub is a few rows per task). Edges are written once, in
buckets by their source and one of ``SALTS`` salts (a hub's edges are in as many buckets), and
never dealt again: a round deals the ranks to them, one row per host with any score
and salt, sums by target, and writes the new ranks to the shared folder. Scores only grow, and the
largest relative growth of a host never rises again once no host is new. Rounds stop
when no host got its first score and no host's score grew by more than ``tolerance``
of itself, so their number follows from the graph (its longest way, then a factor of
``damping`` a round) and unrelated hosts don't count; ``max_rounds`` is None or a bound
that a caller sets. Scores are doubles: one below 1e-308 is none.

Defined cases: a null url or one without "://" has an empty host and path, fits no
rule and is allowed; null html has no links; repeated rows are judged each; a host
without a score is allowed; an empty table gives no rows. Rules of equal length:
block before allow. Only page_id, url and html are read, whatever further columns are called; html
of any length is searched whole.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm import common as c

#: parts of a hub's edges
SALTS = 16
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"),
         UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


@dataclass(frozen=True)
class Spread:
    damping: float = 0.85
    max_rounds: int | None = None
    #: of each host's own score
    tolerance: float = 1e-6
    block_share: float = 0.75
    #: of a host's own page against its distrust
    own_weight: float = 1e-6


def lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to / ? # or the end, and the path up to ? # or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def judged(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest fitting rule as struct<size, block, rule, verdict>, or null."""
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
                   F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.verdict == "block").alias("block"),
                            F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules]
    none = F.lit(None).cast("struct<size:int,block:boolean,rule:string,verdict:string>")
    return F.greatest(none, none, *fits)


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """``src, dst, n``: pages of ``src`` times their distinct linked hosts."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)),
                                         lambda x: lower_ascii(F.regexp_extract(x, r"//([^/?#]*)", 1))))
    return (pages.select(F.col(host).alias("src"), F.explode(links).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def page_rank(edges: DataFrame, seeds: DataFrame, s: Spread = Spread()) -> DataFrame:
    """``edges(src, dst, n)``, ``seeds(host, seed)`` -> ``host, score``: each round a host keeps
    (1 - damping) of its seed and gets its share of the scores of hosts that link to it."""
    spark = edges.sparkSession
    start = seeds.select("host", (F.col("seed") * (1 - s.damping)).alias("score"))
    ranks = c.stored(start, "ranks")
    if edges.isEmpty() or ranks.isEmpty():
        return ranks
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    shares = edges.join(out, "src").select("src", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int").alias("salt"), "dst", (F.col("n") / F.col("out")).alias("share"))
    shares = c.stored_in_buckets(shares, "shares", ["src", "salt"])
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    none = F.lit(0.0).alias("before")
    # sums in another order differ in the last digits: no round can be asked for less
    grew = F.col("score") - F.col("before") > F.col("before") * max(s.tolerance, 1e-12)
    last, rounds = None, 0
    while s.max_rounds is None or rounds < s.max_rounds:
        sent = ranks.select(F.col("host").alias("src"), "score", salts.alias("salt"))
        got = shares.join(sent, ["src", "salt"]).select(
            F.col("dst").alias("host"), (F.col("score") * F.col("share") * s.damping).alias("score"), none)
        new = (start.select("host", "score", none).union(got)
               .union(ranks.select("host", F.lit(0.0), F.col("score")))
               .groupBy("host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")).filter("score > 0"))
        path = c.fresh_path(spark, "ranks")
        new.write.parquet(path)
        kept = spark.read.schema(new.schema).parquet(path)
        more = not kept.filter(grew).isEmpty()
        if last:
            c.discard(spark, last)
        ranks, last, rounds = kept.select("host", "score"), path, rounds + 1
        if not more:
            break
    return ranks


def host_scores(pages: DataFrame, edges: DataFrame, s: Spread = Spread()) -> DataFrame:
    """``pages(host, verdict of a rule or null)`` -> ``host, n_pages, trust, distrust, blocked``."""
    seeds = c.stored(pages.filter("verdict is not null").groupBy("host").agg(
        F.sum(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("distrust")), "seeds")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = page_rank(edges, seeds.filter("trust > 0").select("host", F.col("trust").alias("seed")), s)
    distrust = page_rank(back, seeds.filter("distrust > 0").select("host", F.col("distrust").alias("seed")), s)
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    sizes = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    n = F.coalesce("n_pages", F.lit(0))
    return both.join(sizes, "host", "left").select("host", n.alias("n_pages"), t.alias("trust"), d.alias("distrust"),
                                                   (d > s.block_share * (t + d + s.own_weight * n)).alias("blocked"))


def verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
             rules: tuple[UrlRule, ...] = RULES, s: Spread = Spread()) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row."""
    host, path = host_and_path(F.col(url))
    cut = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    edges = c.stored(host_links(cut, "host", "html"), "host-links")
    best = judged(F.col("host"), F.col("path"), rules)
    ruled = cut.select("page_id", "host", "path", best.alias("r")).select(
        "page_id", "host", "path", F.col("r")["rule"].alias("rule"), F.col("r")["verdict"].alias("verdict"))
    # only blocked hosts are joined: a page of any other host is allowed; the pages of a host are in SALTS parts
    blocked = c.stored(host_scores(ruled.select("host", "verdict"), edges, s).filter("blocked").select("host"), "blocked-hosts").select(
        F.col("host").alias("bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"), F.lit("block").alias("of_host"))
    part = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    return ruled.join(blocked, (ruled.host == blocked.bad) & (part == blocked.part), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "of_host", F.lit("allow")).alias("verdict"))
