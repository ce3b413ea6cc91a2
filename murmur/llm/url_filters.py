"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain
and suffix. From the top down, each group's rate of bad pages has a beta prior
centred on its parent's posterior mean; the prior's strength is estimated
once a level from how much the groups of the level scatter beyond binomial
noise. A host with few labels thus takes its domain's rate, an unseen one its
suffix's. Hosts whose rate is above ``max_bad`` with posterior confidence
``z`` are blocked; explicit rules come first.

All of it is DataFrame expressions: counts with partial aggregation, one row
a host in the joins, and the rules as one expression a page.

Input cases: a url that is null or has no ``://`` has an empty host and path
and is judged like the host ``''``; pages are judged row by row, repeated or
not; outcomes that are null do not count; with no outcomes at all no host is
blocked by reputation; an empty table gives no rows; further input columns
are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import narrow
from murmur.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which names are registered (co.uk, com.au).
SECOND_LEVEL = "co|com|org|net|ac|gov|edu"
MAX_BAD = 0.35
Z = 1.645
#: Bounds of the estimated prior strength, as within-group correlation.
RHO_MIN, RHO_MAX = 0.001, 0.5

#: (rule, verdict); a rule is host/path-prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    name = F.regexp_replace(host, r":[0-9]*$", "")
    found = F.regexp_extract(name, rf"((?:[^.]+\.)?(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+))$", 1)
    return F.when(name.rlike(r"^[0-9.]+$") | (found == ""), name).otherwise(found)


def public_suffix(domain: Column) -> Column:
    found = F.regexp_extract(domain, rf"((?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+)$", 1)
    return F.when(domain.rlike(r"^[0-9.]+$") | (found == ""), domain).otherwise(found)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits
    its host and all subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _shrunk(groups: DataFrame, parent_mean: str) -> DataFrame:
    """Adds ``a`` and ``b``, the posterior of each group's rate: beta prior of
    mean ``parent_mean`` and one strength for all, by the method of moments:
    the expected square of a standardised group rate is 1 + (n - 1) rho."""
    m = F.col(parent_mean)
    scatter = F.pow(F.col("bad") - F.col("n") * m, 2) / (F.col("n") * m * (1 - m))
    labelled = groups.where("n > 0")
    rho = labelled.agg(((F.sum(scatter) - F.count(F.lit(1))) / F.sum(F.col("n") - 1)).alias("r")).select(
        F.greatest(F.lit(RHO_MIN), F.least(F.lit(RHO_MAX), F.coalesce(
            F.when(~F.isnan("r"), F.col("r")), F.lit(RHO_MAX)))).alias("r"))
    strength = F.lit(1.0) / rho.scalar() - 1
    return groups.withColumn("k", strength).withColumn("a", F.col("k") * m + F.col("bad")).withColumn(
        "b", F.col("k") * (1 - m) + F.col("n") - F.col("bad"))


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, bad_rate, bad_rate_low): the posterior mean and lower
    bound of every host's rate of bad pages. ``hosts``: (host), distinct;
    ``outcomes``: (host, n, bad) counts of labelled pages, one row a host."""
    # one row a host, stored: every level and its scalars read it again
    rows = cut_lineage(hosts.join(outcomes, "host", "left").select(
        "host", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad")
    ).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("domain"))))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = rows.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("m")).select(
        F.coalesce("m", F.lit(0.5)))

    def mean_of(groups: DataFrame, key: str, name: str) -> DataFrame:
        return groups.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias(name))

    suffixes = cut_lineage(_shrunk(suffixes.withColumn("m0", overall.scalar()), "m0"))
    domains = cut_lineage(_shrunk(domains.join(mean_of(suffixes, "suffix", "m1"), "suffix"), "m1"))
    rows = _shrunk(rows.join(mean_of(domains, "domain", "m2"), "domain"), "m2")
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return rows.select("host", "n", "bad", mean.alias("bad_rate"),
                       F.greatest(F.lit(0.0), mean - F.lit(Z) * spread).alias("bad_rate_low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, bad_rate, bad_rate_low) of
    every page: a rule's verdict, else block where the host's lower bound is
    above ``max_bad``. ``outcomes``: (url, bad) of labelled pages, bad 0 or 1."""
    seen = narrow(pages, page_id=id_col, url=url_col).withColumns(
        {"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    counted = outcomes.where("bad in (0, 1)").select(url_host(F.col("url")).alias("host"), "bad").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    judged = host_reputation(seen.select("host").distinct(), counted).select("host", "bad_rate", "bad_rate_low")
    rule, says = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate_low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(judged, "host").select(
        "page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"),
        "bad_rate", "bad_rate_low")


def outcomes_of_labels(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, bad) of the pages whose url ends in the number of a labelled
    document (``/en/123``): bad where it is toxic or of low quality."""
    number = F.regexp_extract(F.col(url_col), r"(?s)^.*?://[^/?#]*/[a-z]+/([0-9]{1,18})/?(?:[?#].*)?$", 1)
    numbered = pages.select(F.col(url_col).alias("url"), number.alias("k")).where("k != ''").select(
        "url", F.col("k").cast("long").alias("doc_id"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.greatest(F.col("toxic"), 1 - F.col("quality"))).alias("bad"))
    return numbered.join(known, "doc_id").select("url", "bad")


def filter_urls_sql(max_bad: float = MAX_BAD, rules=RULES) -> str:
    """The same over the tables ``pages`` and ``labels`` in DuckDB's SQL."""
    def case(what: str) -> str:
        arms = []
        for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True):
            own, slash, prefix = text.partition("/")
            arms.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + prefix}') "
                        f"THEN '{text if what == 'rule' else says}'")
        return "CASE " + " ".join(arms) + " ELSE NULL END"

    def shrunk(source: str, parent: str) -> str:
        return f"""SELECT g.*, k * {parent} + bad AS a, k * (1 - {parent}) + n - bad AS b FROM {source} g, (
            SELECT 1.0 / greatest({RHO_MIN}, least({RHO_MAX}, coalesce(CASE WHEN d > 0 THEN s / d END, {RHO_MAX}))) - 1
                AS k FROM (SELECT sum((bad - n * {parent}) ** 2 / (n * {parent} * (1 - {parent}))) - count(*) AS s,
                sum(n - 1) AS d FROM {source} WHERE n > 0))"""

    return rf"""
WITH seen AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(url, '(?s)^.*?://[^/?#]*/[a-z]+/([0-9]{{1,18}})/?(?:[?#].*)?$', 1) AS k FROM pages),
known AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(*) AS n, sum(known.bad) AS bad FROM seen JOIN known ON CAST(nullif(k, '') AS BIGINT) = doc_id
  WHERE known.bad IN (0, 1) GROUP BY host),
named AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM (SELECT DISTINCT host FROM seen)),
split AS (SELECT host, CASE WHEN regexp_matches(name, '^[0-9.]+$') OR d = '' THEN name ELSE d END AS domain FROM (
  SELECT *, regexp_extract(name, '((?:[^.]+\.)?(?:(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+))$', 1) AS d FROM named)),
rows0 AS (SELECT host, domain, CASE WHEN regexp_matches(domain, '^[0-9.]+$') OR s = '' THEN domain ELSE s END AS suffix,
  coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM (
  SELECT *, regexp_extract(domain, '((?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+)$', 1) AS s FROM split) LEFT JOIN counted USING (host)),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM rows0 GROUP BY ALL),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains0 GROUP BY ALL),
suffixes1 AS (SELECT *, (SELECT coalesce((sum(bad) + 0.5) / (sum(n) + 1.0), 0.5) FROM suffixes0) AS m0 FROM suffixes0),
suffixes2 AS ({shrunk('suffixes1', 'm0')}),
domains1 AS (SELECT domains0.*, s.a / (s.a + s.b) AS m1 FROM domains0 JOIN suffixes2 s USING (suffix)),
domains2 AS ({shrunk('domains1', 'm1')}),
rows1 AS (SELECT rows0.*, d.a / (d.a + d.b) AS m2 FROM rows0 JOIN domains2 d USING (domain)),
rows2 AS ({shrunk('rows1', 'm2')}),
judged AS (SELECT host, a / (a + b) AS bad_rate,
  greatest(0.0, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) AS bad_rate_low FROM rows2)
SELECT page_id, host, path, {case('rule')} AS rule,
  coalesce({case('verdict')}, CASE WHEN bad_rate_low > {max_bad} THEN 'block' ELSE 'allow' END) AS verdict,
  round(bad_rate, 6) AS bad_rate, round(bad_rate_low, 6) AS bad_rate_low
FROM seen JOIN judged USING (host)"""
