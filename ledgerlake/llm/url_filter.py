"""URL filters: written rules first, empirical-Bayes host reputation for the rest.

Labelled page outcomes (good or not) are counted per host, registered domain and suffix.
At each level the rate is beta-binomial: the posterior mean of the level above is the
prior mean, and the prior's strength is fitted to the spread between the level's units by
the method of moments. A host without labels inherits its domain's posterior. A page is
allowed if the lower credible bound of its host's good rate (mean less ``Z`` standard
deviations of the beta posterior) reaches ``LOWEST``.

Everything is built-in expressions. Pages are counted per host with partial sums first,
so a host with a third of all pages is no hot task; the three levels then have a row a
host at most, and pages meet their host's bound in one equi-join that adaptive execution
can split. Only three fitted strengths and one overall rate reach the driver.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and the overall rate as its prior; null outcomes and pages without outcome only
miss in the counts; several outcomes of one page all count; equal pages are judged alike;
an empty table gives an empty table; columns of the names given to results are replaced,
``html`` and other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.64
LOWEST = 0.5
#: Prior strength (in labelled pages) where the spread can't be fitted, and the range of fits.
STRENGTH, WEAKEST, STRONGEST = 10.0, 1.0, 1000.0
#: A suffix of two labels, as a pattern: a generic label under a country's; any other suffix is the last label.
LONG_SUFFIX = r"(?:ac|co|com|edu|gen|go|gob|gouv|gov|id|ltd|mil|ne|net|nhs|nom|or|org|plc|sch|web)\.[a-z][a-z]"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host (ASCII lower-cased) and path."""
    at = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(at, URL, 1), UPPER, LOWER), "path": F.regexp_extract(at, URL, 2)})


def matched(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits host and path, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _levels(long: str) -> dict[str, Column]:
    suffix = F.regexp_extract("host", rf"((?:^|\.)(?:{long})|[^.]*)$", 1)
    suffix = F.regexp_replace(suffix, r"^\.", "")
    domain = F.regexp_extract("host", rf"([^.]*\.(?:{long})|[^.]*\.[^.]*|[^.]*)$", 1)
    return {"suffix": suffix, "domain": domain}


def _strength(units: DataFrame) -> float:
    """The beta prior's strength from the spread of rates between units with labels (n, k)."""
    u = units.where("n > 0").select(F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"))
    r = u.agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.expr("n * n")).alias("nn"), F.sum(F.expr("k * k / n")).alias("kk")).first()
    if r.u < 2 or r.k in (0, r.n):
        return STRENGTH
    p, room = r.k / r.n, r.n - r.nn / r.n - (r.u - 1)
    if room <= 0:
        return STRENGTH
    spread = (r.kk - r.k * r.k / r.n - p * (1 - p) * (r.u - 1)) / (p * (1 - p) * room)
    return round(min(max((1 - spread) / spread, WEAKEST), STRONGEST), 6) if spread > 0 else STRONGEST


def reputations(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", long_suffix: str = LONG_SUFFIX) -> DataFrame:
    """(host, n, k, mean, lower) for every host of ``pages`` (with a column host).

    ``outcomes`` has page_id and good (boolean).
    """
    judged = outcomes.where("good IS NOT NULL").select(F.col("page_id").alias("_page"), F.col("good").cast("long").alias("good"))
    labelled = pages.select(F.col(f"`{page_id}`").alias("_page"), "host").join(judged, "_page", "left")
    hosts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = materialise(hosts.withColumns(_levels(long_suffix)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    rate = (total[1] + 1) / (total[0] + 2)
    shrunk = lambda prior, m: (F.col("k") + prior * m) / (F.col("n") + m)
    by_suffix = suffixes.select("suffix", shrunk(F.lit(rate), F.lit(_strength(suffixes))).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(F.col("suffix_mean"), F.lit(_strength(domains))).alias("domain_mean"))
    m = _strength(hosts)
    mean = shrunk(F.col("domain_mean"), F.lit(m))
    scored = hosts.join(by_domain, ["domain", "suffix"]).withColumn("mean", mean)
    lower = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m + 1))
    return scored.select("host", "n", "k", "mean", lower.alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, lowest: float = LOWEST, long_suffix: str = LONG_SUFFIX) -> DataFrame:
    """``pages`` with host, path, rule, verdict (``allow`` or ``block``) and the host's lower bound."""
    found = parsed(pages, url).drop("host_lower_bound", "rule", "verdict")
    bounds = reputations(found, outcomes, page_id, long_suffix).select(F.col("host"), F.col("lower").alias("host_lower_bound"))
    name, verdict = matched(rules)
    own = F.when(F.col("host_lower_bound") >= F.lit(lowest), F.lit("allow")).otherwise(F.lit("block"))
    return found.join(bounds, "host", "left").withColumns({"rule": name, "verdict": F.coalesce(verdict, own)})


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labelled outcomes by id: good if of quality and not toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; outcomes are the labels of the same id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, outcomes_of(table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in longest) + " END"
    long = LONG_SUFFIX
    fit = lambda units: f"""(SELECT CASE WHEN u < 2 OR k IN (0, n) OR n - nn / n - (u - 1) <= 0 THEN {STRENGTH} WHEN s <= 0 THEN {STRONGEST}
      ELSE round(least(greatest((1 - s) / s, {WEAKEST}), {STRONGEST}), 6) END FROM (SELECT *, (kk - k * k / n - k / n * (1 - k / n) * (u - 1)) / (k / n * (1 - k / n) * (n - nn / n - (u - 1))) AS s
      FROM (SELECT count(*) AS u, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, CAST(sum(n * n) AS DOUBLE) AS nn, sum(k * k / n) AS kk FROM {units} WHERE n > 0)))"""  # noqa: E731
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
o AS (SELECT doc_id AS page_id, CAST(quality = 1 AND toxic = 0 AS BIGINT) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS (SELECT host, count(good) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS k, regexp_replace(regexp_extract(host, '((?:^|\.)(?:{long})|[^.]*)$', 1), '^\.', '') AS suffix,
      regexp_extract(host, '([^.]*\.(?:{long})|[^.]*\.[^.]*|[^.]*)$', 1) AS domain FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM d GROUP BY ALL),
t AS (SELECT {fit("s")} AS ms, {fit("d")} AS md, {fit("h")} AS mh, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) AS rate),
sm AS (SELECT suffix, (k + rate * ms) / (n + ms) AS mean FROM s, t),
dm AS (SELECT domain, d.suffix, (k + mean * md) / (n + md) AS mean FROM d JOIN sm USING (suffix), t),
hm AS (SELECT host, (k + mean * mh) / (n + mh) AS mean, n + mh AS m FROM h JOIN dm USING (domain, suffix), t)
SELECT page_id, host, path, {case(lambda r: r.name)} AS rule,
  coalesce({case(lambda r: r.verdict)}, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (m + 1)) >= {LOWEST} THEN 'allow' ELSE 'block' END) AS verdict
FROM p JOIN hm USING (host)
"""
