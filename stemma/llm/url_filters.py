"""URL filters (operator 10): link-graph propagation, with rules on top. DataFrame operations only.

A rule is an action on a host, with its subdomains, and a path prefix; of the rules that fit a url the longest wins.
Hosts of pages that a rule allows are trusted seeds, hosts of pages that a rule blocks are blocked seeds, each
weighed by the number of such pages as a share of all seed pages. Trust flows along links between hosts, split over a
host's links by their number; distrust flows against them, from a blocked host to those that link to it. Both are
personalised PageRank vectors; rounds go on until one adds at most TOLERANCE of the seeds' mass to each of them. A host
is blocked when distrust is most of what reached it, however little that is: the verdict is a ratio, so it does not
depend on the size of the table. A page that no rule fits gets its host's verdict.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and its verdict is that of the
empty host, which takes no part in the graph: allow. A url, a page and a host of any length are read whole; of rules of
equal length that fit, the one of the greater name wins. Each input row gives one row; other input columns are not
carried; null html has no links; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm._common import materialise, release

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: Rows of a table by host that may be sent to every executor; a larger one is joined by shuffle, where Spark splits the
#: partition of a hot host.
BROADCAST_HOSTS = 200_000
DAMPING, BLOCK_SHARE = 0.85, 0.75
#: The last round adds at most this share of the seeds' mass.
TOLERANCE = 1e-9
#: Rounds that are enough: each adds at most DAMPING of what the one before it added.
ROUNDS = math.ceil(math.log(TOLERANCE, DAMPING))


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: str) -> tuple:
    """Expressions for host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def small(hosts: DataFrame, label: str) -> DataFrame:
    """hosts, written down, and marked for broadcast if they are few."""
    hosts = materialise(hosts, label)
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts


def host_rules(spark: SparkSession, hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """hosts (host) -> (host, fitting array of (size, name, action, path)), for hosts that some rule is about."""
    table = spark.createDataFrame([(r.host, len(r.name), r.name, r.action, r.path) for r in rules], "rule_host string, size int, name string, action string, path string")
    ends = F.expr("inline(transform(sequence(1, size(split(host, '[.]'))), i -> named_struct('rule_host', array_join(slice(split(host, '[.]'), i, 256), '.'))))")
    found = hosts.select("host", ends).join(table, "rule_host")
    return found.groupBy("host").agg(F.collect_set(F.struct("size", "name", "action", "path")).alias("fitting"))


def host_links(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> (source, target, n): links to other hosts."""
    target = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1)))
    links = pages.where("host <> '' and instr(html, '//') > 0").select(F.col("host").alias("source"), target.alias("target"))
    links = links.select("source", F.translate("target", _UPPER, _LOWER).alias("target")).where("source <> target")
    return links.groupBy("source", "target").agg(F.count("*").alias("n"))


def _mass(ranks: DataFrame) -> dict[str, float]:
    """Sum of each kind. No host's rank falls from one round to the next, so its growth is the whole change."""
    return {r.kind: r.v for r in ranks.groupBy("kind").agg(F.sum("v").alias("v")).collect()}


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """seeds (host, trusted, blocked) -> (host, trust, distrust), in shares of all seeds."""
    out = links.groupBy("source").agg(F.sum("n").alias("all"))
    back = links.groupBy("target").agg(F.sum("n").alias("all"))
    ahead = links.join(out, "source").select(F.lit("t").alias("kind"), F.col("source").alias("giver"), F.col("target").alias("taker"), (F.col("n") / F.col("all")).alias("w"))
    behind = links.join(back, "target").select(F.lit("d").alias("kind"), F.col("target").alias("giver"), F.col("source").alias("taker"), (F.col("n") / F.col("all")).alias("w"))
    edges = materialise(ahead.unionAll(behind), "edges")
    seeds = materialise(seeds.where("trusted + blocked > 0"), "seeds")
    total = seeds.agg(F.sum(F.col("trusted") + F.col("blocked"))).first()[0] or 1
    share = f"inline(array(struct('t' as kind, trusted / {float(total)!r}D as v), struct('d' as kind, blocked / {float(total)!r}D as v)))"
    start = materialise(seeds.select("host", F.expr(share)).where("v > 0"), "start")
    now, seeded = start, _mass(start)
    mass = seeded
    if seeded and not edges.isEmpty():
        # A round adds at most damping of what the one before it added, so these are enough.
        for _ in range(math.ceil(math.log(tolerance, damping))):
            moved = now.join(edges, (now["kind"] == edges["kind"]) & (now["host"] == edges["giver"])).select(edges["kind"], F.col("taker").alias("host"), (F.col("v") * F.col("w") * damping).alias("v"))
            after = start.select("kind", "host", "v").unionAll(moved).groupBy("kind", "host").agg(F.sum("v").alias("v"))
            after = materialise(after, "ranks")
            if now is not start:
                release(now)
            now, before, mass = after, mass, _mass(after)
            if all(mass[k] - before[k] <= tolerance * seeded[k] for k in seeded):
                break
    return now.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("v")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.col("v")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust)."""
    spark = pages.sparkSession
    host, path = parts("u")
    rows = pages.select(F.col(id_col).alias("k"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("html")).select("k", host.alias("host"), path.alias("path"), "html")
    plain = materialise(rows.select("k", "host", "path"), "urls")
    fitting = small(host_rules(spark, plain.select("host").distinct(), rules), "fitting")
    best = F.expr("array_max(filter(fitting, r -> startswith(path, r.path)))")
    ruled = materialise(plain.join(fitting, "host", "left").withColumn("best", best).select("k", "host", "path", F.col("best.name").alias("rule"), F.col("best.action").alias("action")), "ruled")
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("trusted"), F.count_if(F.col("action") == "block").alias("blocked"))
    scores = propagate(seeds, host_links(rows.select("host", "html")))
    share = F.round(F.try_divide("distrust", F.col("trust") + F.col("distrust")), 6)
    scores = scores.withColumn("method", F.when(share > BLOCK_SHARE, "block").otherwise("allow"))
    judged = ruled.join(small(scores, "scores"), "host", "left")
    verdict = F.coalesce("action", "method", F.lit("allow"))
    return judged.select(F.col("k").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge_sql(rules: list[Rule]) -> str:
    """The same in DuckDB's SQL over the table pages. What each round adds is summed, over all ROUNDS of them."""
    values = ", ".join(f"('{r.host}', {len(r.name)}, '{r.name}', '{r.action}', '{r.path}')" for r in rules)
    pattern = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, size, name, action, path) AS (VALUES {values}),
ruled AS (SELECT s.page_id, s.host, s.path, (SELECT max(struct_pack(size := r.size, name := r.name, action := r.action)) FROM rules r
    WHERE (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.path)) AS best FROM split s),
pages_of AS (SELECT host, unnest(['t', 'd']) AS kind, unnest([count(*) FILTER (best.action = 'allow'), count(*) FILTER (best.action = 'block')])::DOUBLE AS v FROM ruled WHERE host <> '' GROUP BY host),
start AS (SELECT host, kind, v / (SELECT sum(v) FROM pages_of) AS v FROM pages_of WHERE v > 0),
found AS (SELECT host AS source, translate(unnest(list_distinct(regexp_extract_all(html, '{pattern}', 1))), '{_UPPER}', '{_LOWER}') AS target FROM split WHERE host <> ''),
links AS (SELECT source, target, count(*) AS n FROM found WHERE source <> target GROUP BY ALL),
edges AS (SELECT 't' AS kind, source AS giver, target AS taker, n / sum(n) OVER (PARTITION BY source) AS w FROM links
    UNION ALL SELECT 'd', target, source, n / sum(n) OVER (PARTITION BY target) FROM links),
moved AS (SELECT kind, host, v, 0 AS i FROM start
    UNION ALL SELECT e.kind, e.taker, sum(m.v * e.w * {DAMPING}), m.i + 1 FROM moved m JOIN edges e ON m.kind = e.kind AND m.host = e.giver WHERE m.i < {ROUNDS} GROUP BY e.kind, e.taker, m.i),
scores AS (SELECT host, sum(CASE WHEN kind = 't' THEN v ELSE 0 END) AS trust, sum(CASE WHEN kind = 'd' THEN v ELSE 0 END) AS distrust FROM moved GROUP BY host)
SELECT p.page_id, p.host, p.path, p.best.name AS rule, coalesce(p.best.action, CASE WHEN round(distrust / nullif(trust + distrust, 0), 6) > {BLOCK_SHARE} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled p LEFT JOIN scores USING (host)"""
