"""URL filtering: rules first, then trust and distrust spread over the graph of hosts.

Rules judge the pages they fit. Hosts with allowed pages seed trust, hosts with blocked pages seed distrust. Trust is the
personalised PageRank along links between hosts; distrust is the same against the links, since who links to bad hosts is suspect. A page without
a rule is blocked if its host's distrust exceeds its trust by more than a margin, else allowed.

Links are absolute ones (with a host) in the pages' html, between different hosts, each pair counted once; relative links stay within
their host. Scores that flow into a host without links go back to the seeds, so trust and distrust each add up to one. Rounds go on until
no more than TOLERANCE can still move; with a damping below one their number follows from it, and nothing else ends them.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; hosts that no
seed reaches are allowed, and so are those whose distrust only equals their trust; among rules of equal length the first by
text, then verdict, wins; repeated pages are judged alike but count each as a page; null html has no links; urls and pages of any length
are read whole; columns of the input with the names of the results are replaced, others stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.line_dedup import ascii_lower
from kinlink.llm.workdir import materialize, release

DAMPING = 0.85
TOLERANCE = 1e-6
LOOK_EVERY = 6  # rounds from one look at what still moves to the next
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    """text: a host, and after its first slash the start of a path; it fits the host and its subdomains."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the contract.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict))


def match_inline(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows (host, path, ...) with rule and rule_verdict: one expression, for few rules."""
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(_longest_first(rules)):
        host = F.col("host")
        fits = ((host == r.host) | host.endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def match_joined(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same by a join with the domains above each distinct host, for many rules."""
    table = rows.sparkSession.createDataFrame(
        [(r.host, r.path, r.text, r.verdict, -k) for k, r in enumerate(_longest_first(rules))],
        "rule_host string, rule_path string, rule string, rule_verdict string, rank long",
    )
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pairs = rows.select("host", "path").distinct().select("host", "path", F.explode(above).alias("rule_host"))
    fitting = pairs.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fitting.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "rule_verdict")).alias("b"))
    best = best.select("host", "path", "b.rule", "b.rule_verdict")
    return rows.join(best, ["host", "path"], "left")


def match_rules(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return match_inline(rows, rules) if len(rules) <= INLINE_RULES else match_joined(rows, rules)


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst): distinct links between different hosts. pages: host, html."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)(?<![\w-])href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""), 1)
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(found, ascii_lower))).alias("dst"))
    return links.where("src <> dst").distinct()


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): PageRank of each kind of seed, restarted at the seeds, and adding up to one.

    links: kind, src, dst (distinct). seeds: kind, host, share, the shares of a kind adding up to one. Restarting what reaches a host
    without links is the same as dividing by the sum at the end. All that still moves shrinks by the damping in each round.
    """
    links = materialize(links, "links")
    if links.isEmpty():
        return seeds.select("kind", "host", F.col("share").alias("score"))
    # Written first, so that the join may split a host with very many links.
    degree = materialize(links.groupBy("kind", "src").agg(F.count("*").alias("degree")), "degrees")
    weighted = materialize(links.join(degree, ["kind", "src"]).select("kind", "src", "dst", (1 / F.col("degree")).alias("weight")), "links")
    start = materialize(seeds.select("kind", "host", (F.col("share") * (1 - damping)).alias("score")), "seeds")
    now, rounds = start, math.ceil(math.log(tolerance) / math.log(damping))
    for k in range(1, rounds + 1):
        flow = weighted.join(now.withColumnRenamed("host", "src"), ["kind", "src"])
        flow = flow.select("kind", F.col("dst").alias("host"), (F.col("weight") * F.col("score") * damping).alias("score"))
        then = materialize(flow.union(start).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
        if k % LOOK_EVERY == 0:
            change = then.union(now.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d"))
            if (change.agg(F.sum("d")).first()[0] or 0.0) * damping / (1 - damping) < tolerance:
                now = then
                break
        if now is not start:
            release(now)
        now = then
    sums = now.groupBy("kind").agg(F.sum("score").alias("whole"))
    return now.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("score") / F.col("whole")).alias("score"))


def judge_hosts(matched: DataFrame, links: DataFrame, margin: float = 0.0) -> DataFrame:
    """(host, trust, distrust, host_verdict) of all hosts that a seed reaches.

    matched: host, rule_verdict of each page. links: src, dst.
    """
    counts = materialize(
        matched.where("rule_verdict is not null and host <> ''").groupBy("rule_verdict", "host").agg(F.count("*").alias("pages")), "judged"
    )
    kind = F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust")
    totals = counts.groupBy("rule_verdict").agg(F.sum("pages").alias("total"))
    seeds = counts.join(F.broadcast(totals), "rule_verdict").select(kind.alias("kind"), "host", (F.col("pages") / F.col("total")).alias("share"))
    forth = links.select(F.lit("trust").alias("kind"), "src", "dst")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    scores = spread(forth.union(back), seeds)
    pivot = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    both = scores.groupBy("host").agg(pivot("trust"), pivot("distrust"))
    return both.withColumn("host_verdict", F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust added."""
    made = ("host", "path", "rule", "rule_verdict", "verdict", "trust", "distrust")
    kept = [c for c in pages.columns if c not in made]
    url = F.col(url_col).cast("string")
    located = pages.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"))
    matched = match_rules(located, rules)
    hosts = judge_hosts(matched.select("host", "rule_verdict"), host_links(located.select("host", F.col(html_col).alias("html"))))
    joined = matched.join(materialize(hosts, "hosts"), "host", "left")
    return joined.select(
        *kept,
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def url_filter_digest(pages: DataFrame) -> DataFrame:
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


#: For pages whose links all stay within their host, as those of the given tables: there the seeds alone have scores.
ORACLE = """
WITH rules(rule, host, path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), located AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), best AS (
  SELECT l.r, arg_max(x.rule, length(x.rule)) AS rule, arg_max(x.verdict, length(x.rule)) AS verdict
  FROM located l JOIN rules x ON (l.host = x.host OR l.host LIKE '%.' || x.host) AND starts_with(l.path, x.path) GROUP BY l.r
), matched AS (
  SELECT l.*, b.rule, b.verdict AS judged FROM located l LEFT JOIN best b USING (r)
), shares AS (
  SELECT host, count(*) FILTER (judged = 'allow') / sum(count(*) FILTER (judged = 'allow')) OVER () AS trust,
    count(*) FILTER (judged = 'block') / sum(count(*) FILTER (judged = 'block')) OVER () AS distrust
  FROM matched WHERE judged IS NOT NULL AND host <> '' GROUP BY host
)
SELECT page_id, m.host, path, rule, coalesce(judged, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM matched m LEFT JOIN shares s ON m.host = s.host
"""
