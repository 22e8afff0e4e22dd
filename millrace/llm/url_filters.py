"""URL filters: host and path rules, and link-graph propagation for the rest. DataFrame functions only.

A rule names a host, which also stands for its subdomains, and a path prefix; the longest fitting rule decides. Hosts with
pages that rules allow are trusted seeds and hosts with pages that rules block distrusted ones, each by the share of its
pages under rules that are so. Trust flows along links by personalised PageRank from the trusted seeds; distrust flows
against them, from the blocked hosts to those that link to them: a host takes the mean distrust of what its links lead to,
times the damping. So it depends on where a host's own links lead, and not on how many others link to the same blocked
host. A host whose distrust exceeds its trust by more than a threshold is blocked; all others, among them those that
neither flow reaches, are allowed.

Edges are the absolute links (http, https and protocol-relative href) between two different hosts, weighted by their number.
Each step moves a host's score over its out-edges and returns the rest to the seeds; `DAMPING ** STEPS` bounds what further
steps could move.

Defined results: a null url or one without `://` has an empty host and path, which fit no rule and are allowed; repeated
rows are judged alike, and their links count each time; null html has no links; html of any length is read in place. Other
columns of pages play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialize, small_or_whole

#: (verdict, rule): host, then path from the first slash on.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
STEPS = 16
#: By how much distrust may exceed trust, where a host of none but blocked pages has 0.15 of its own and one that links to
#: none but such hosts 0.1275.
THRESHOLD = 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ordered(rules: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """Rules as they are tried: the longest first, of equal ones block first."""
    return sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """A struct (verdict, rule) of the longest rule that fits, null if none does. Equal lengths: block before allow."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in reversed(ordered(rules)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of links between different hosts. pages: host, html. Links are counted per page first, so that
    what is shuffled is one row for each host pair and task."""
    links = F.regexp_extract_all("html", F.lit(LINK), 1)
    rows = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    rows = rows.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, score): what seeds (host, mass) send along edges (src, dst, share), damped at each step. Shares that sum to 1
    over the edges of a src make it personalised PageRank; over those of a dst, damped means.

    Scores that reach a host without out-edges stop there. Only hosts that mass has reached have a row, so work follows
    the flow and not the number of hosts; every fourth step is written to the shared folder."""
    restart = seeds.select("host", (F.col("mass") * (1 - damping)).alias("score"))
    now = seeds.select("host", F.col("mass").alias("score"))
    for step in range(steps):
        moved = now.join(edges, now["host"] == edges["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        now = restart.unionAll(moved).groupBy("host").agg(F.sum("score").alias("score"))
        if step % 4 == 3:
            now = materialize(now, "rank")
    return now


def host_scores(pages: DataFrame, hosts: DataFrame, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) of the hosts that either flow reaches. hosts: host, allowed, blocked (pages under rules)."""
    edges = materialize(host_edges(pages), "edges")

    pages_under = F.col("allowed") + F.col("blocked")
    seeded = hosts.where(pages_under > 0)

    def flow(src: str, dst: str, kind: str, name: str) -> DataFrame:
        out = edges.groupBy(F.col("src").alias("of")).agg(F.sum("weight").alias("all"))  # of the host that links, either way
        shares = edges.join(out, edges["src"] == F.col("of")).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("weight") / F.col("all")).alias("share"))
        seeds = seeded.where(F.col(kind) > 0).select("host", (F.col(kind) / pages_under).alias("part"))
        total = seeds.agg(F.sum("part")).first()[0] or 1.0
        seeds = seeds.select("host", (F.col("part") / total).alias("mass"))
        return propagate(materialize(shares, "shares"), seeds, steps).select("host", (F.col("score") * total).alias(name))

    if is_empty(edges):  # no step would move anything: seeds keep what each step returns to them
        kept = F.lit(1 - DAMPING if steps else 1.0)
        return seeded.select("host", (kept * F.col("allowed") / pages_under).alias("trust"), (kept * F.col("blocked") / pages_under).alias("distrust"))
    trust, distrust = flow("src", "dst", "allowed", "trust"), flow("dst", "src", "blocked", "distrust")
    both = trust.join(distrust, "host", "full")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, steps: int = STEPS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust. Pages are read twice, once for urls and once
    for links; neither their html nor their paths are shuffled but for the final join with the hosts' scores, which is a
    broadcast while hosts are few."""
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    by_host = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").alias("allowed"), F.count_if(F.col("r.verdict") == "block").alias("blocked"))
    hosts = materialize(by_host, "hosts")
    scores = materialize(host_scores(judged.select("host", "html"), hosts, steps), "scores")
    out = judged.drop("html").join(small_or_whole(scores), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust - trust > threshold, "block").otherwise("allow")  # of the flows as they are; columns are rounded
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))
