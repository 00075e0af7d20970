"""URL filter by trust and distrust that spread over host links.

Rules of a host and a path prefix judge the urls they fit. The hosts of pages that a rule
allowed are trusted seeds, those of pages it blocked are distrusted seeds, each by the share
of its pages so judged. Trust is the personalised PageRank from the trusted seeds along host
links: with the constant ``1 - damping`` a walk starts anew at a seed, and so does a walk that
reaches a host without links (that only scales the result, so it is done at the end). It is
given in units of a seed, so it does not shrink with the corpus. Distrust runs from the blocked
seeds against the links: a host's own distrusted share, and of the rest ``damping`` times the
mean distrust of the hosts its links lead to. It is the chance that a damped walk from the host
meets a blocked page, lies between 0 and 1 and does not depend on how many others link to a
blocked host. Both are iterated until what is left to come is proven to be below ``tolerance``.
A host is blocked when its distrust reaches ``threshold`` and exceeds its trust; urls that no rule
fits take their host's verdict.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and
is allowed; null html has no links; links to the own host are no edges; a link repeated in one
page counts once, in several pages once for each; repeated pages count each; ties between
rules of equal length go to the one listed first; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-9
#: Rounds between writing the state, which ends a plan's growth.
_WRITE_EVERY = 5
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: str) -> Column:
    return F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to a slash, question mark, hash or end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: str = "url") -> Column:
    """After the host up to a question mark, hash or end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):  # the last one wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def judged_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path and the rule that fits each url."""
    parts = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    return parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of ``src`` that link to ``dst``; combined map-side."""
    found = F.array_distinct(F.transform(
        F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, _UPPER, _UPPER.lower())))
    links = pages.select(host_of().alias("src"), F.explode(found).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"))


def host_seeds(urls: DataFrame) -> DataFrame:
    """(host, trust, distrust): shares of a host's pages that rules allow and block."""
    share = lambda v: (F.sum((F.coalesce(F.col("fit.verdict"), F.lit("")) == v).cast("long")) / F.count(F.lit(1)))
    return urls.where("host <> ''").groupBy("host").agg(
        share("allow").alias("trust"), share("block").alias("distrust"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), each within ``tolerance`` of the limit.

    One table holds both directions, so a round is one join and one grouping that combines
    map-side. A host with very many links is a skewed join key, which adaptive execution splits.
    A round shrinks changes by ``damping`` at least, which bounds the rounds and what is left.
    """
    seeds = written(seeds, "seeds")
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = edges.join(total, "src").join(seeds.select(F.col("host").alias("src"), "distrust"), "src", "left").select(
        "src", "dst", (F.col("n") / F.col("total")).alias("w"), (1 - F.coalesce("distrust", F.lit(0.0))).alias("rest"))
    forward = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), "w", F.lit(0.0).alias("v"))
    backward = shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("w"),
                             (F.col("w") * F.col("rest")).alias("v"))
    flows = written(forward.unionByName(backward), "flows")
    base = seeds.select("host", (F.lit(1 - damping) * F.col("trust")).alias("trust"), "distrust")
    state, shrink, left = written(base, "state"), damping ** _WRITE_EVERY, 1.0
    while left > tolerance:
        before = state
        for _ in range(_WRITE_EVERY):
            gained = flows.join(state, "host").groupBy(F.col("to").alias("host")).agg(
                (damping * F.sum(F.col("trust") * F.col("w"))).alias("trust"),
                (damping * F.sum(F.col("distrust") * F.col("v"))).alias("distrust"))
            state = base.unionByName(gained).groupBy("host").agg(
                F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        state = written(state, "state")
        past = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        # trust shrinks in its sum, distrust in its maximum
        moved = state.join(past, "host", "left").agg(
            F.sum(F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0)))),
            F.max(F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0))))).first()
        discard(before)
        left = max(moved[0] or 0.0, moved[1] or 0.0) * shrink / (1 - shrink)
    # walks that end start anew at the seeds: the limit without them, scaled to the seeds' sum
    whole, held = (rows.agg(F.coalesce(F.sum("trust"), F.lit(0.0))).scalar() for rows in (seeds, state))
    return state.withColumn("trust", F.when(held > 0, F.col("trust") * whole / held).otherwise(F.lit(0.0)))


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING,
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    urls = judged_urls(pages, rules)
    scores = propagate(host_seeds(urls), written(host_edges(pages), "host-edges"), damping)
    blocked = scores.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select(
        "host", F.lit("block").alias("spread"))
    return urls.join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "spread", F.lit("allow")).alias("verdict"))


def oracle(rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD,
           rounds: int = 150) -> str:
    """DuckDB SQL for ``verdicts`` over ``pages``; 150 rounds leave less than 1e-9."""
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
            for r in sorted(rules, key=lambda r: -len(r.text))]
    named = sorted(rules, key=lambda r: -len(r.text))
    case = lambda attr: "CASE " + " ".join(f"WHEN {f} THEN '{getattr(r, attr)}'" for f, r in zip(fits, named)) + " END"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_UPPER.lower()}')"
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0
    THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (SELECT page_id, html, host, path, {case("text")} AS rule, {case("verdict")} AS fit FROM parts),
links AS (SELECT host AS src, unnest(list_distinct(
    [{lower("h")} for h in regexp_extract_all(html, '{link}', 1)])) AS dst FROM urls),
edges AS (SELECT src, dst, count(*) AS n FROM links
    WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
s0 AS MATERIALIZED (SELECT host, avg((coalesce(fit, '') = 'allow')::INT) AS trust,
    avg((coalesce(fit, '') = 'block')::INT) AS distrust FROM urls WHERE host <> '' GROUP BY host),
shares AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w, 1 - coalesce(distrust, 0) AS rest
  FROM edges LEFT JOIN s0 ON s0.host = src),
flows AS MATERIALIZED (
  SELECT src AS host, dst AS "to", w, 0.0::DOUBLE AS v FROM shares UNION ALL
  SELECT dst, src, 0.0::DOUBLE, w * rest FROM shares),
base AS MATERIALIZED (SELECT host, {1 - damping!r}::DOUBLE * trust AS trust, distrust FROM s0),
steps AS (SELECT 0 AS k, host, trust, distrust FROM base UNION ALL
  SELECT k, host, sum(trust), sum(distrust) FROM (
    SELECT (SELECT max(k) FROM steps) + 1 AS k, host, trust, distrust FROM base UNION ALL
    SELECT k + 1, "to", {damping} * trust * w, {damping} * distrust * v FROM flows JOIN steps USING (host))
  WHERE k <= {rounds} GROUP BY k, host),
last AS (SELECT host, trust * (SELECT sum(trust) FROM s0) / nullif(sum(trust) OVER (), 0) AS trust, distrust
  FROM steps WHERE k = {rounds})
SELECT page_id, host, path, rule, coalesce(fit, CASE WHEN distrust >= {threshold} AND distrust > coalesce(trust, 0)
    THEN 'block' END, 'allow') AS verdict
FROM urls LEFT JOIN last USING (host)"""
