"""URL filters: explicit rules, else empirical-Bayes host reputation.

Outcomes: a page that a rule judges is a labelled page, bad if the rule blocks it and good if the rule allows it;
where labels of the pages themselves are at hand they are used instead (low quality or toxic: bad). Counts are
summed up a tree, host -> registered domain -> suffix. A suffix is the last name of the host, or the last
two if they are in SUFFIXES; a registered domain has one name more. Each level's beta prior has the posterior
mean of the level above (suffixes: that of all labels, or the share BASE, since pages that rules judge are no fair
sample of the others) and a strength that is fitted to the spread between its groups by the method of moments
for the beta-binomial: a level whose groups differ no more than chance gets the strongest prior. A page without
a rule is blocked when the lower posterior bound of its host's share of bad pages is over the threshold; the
bound is a normal approximation to the beta quantile, mean - z * deviation, so hosts of which little is known
are allowed.

The longest rule wins: a rule fits its host and all subdomains of it, if the path starts with the rule's.

Only urls (and labels, if given) are read. Counts are combined before any shuffle. Hosts meet their domains, domains their
suffixes and pages the reputations with the hottest keys broadcast (at most 1,000, by the share of rows they
hold) and the rest shuffled.

Defined cases: a null url, or one without ://, has an empty host and path, meets no rule and is judged by the
reputation of the empty host; without any outcome every share is BASE and nothing is blocked; an unmatched label, or one with null quality and null toxic, is no outcome; several labels of a page all
count; repeated rows each count and are each judged; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, join_with_hot_keys

#: Fixed values: (rule, verdict).
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Public suffixes of two names.
SUFFIXES = """co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au co.nz org.nz co.jp ne.jp or.jp ac.jp co.kr or.kr com.cn net.cn org.cn
    com.tw com.hk com.sg com.my co.id co.th in.th co.in net.in com.br net.br org.br com.ar com.mx com.co com.tr co.za org.za co.il com.ua com.pl""".split()
#: Bounds of a prior's strength in pages, deviations below the posterior mean, the share of bad pages to block at, and the share assumed where nothing is known.
WEAKEST, STRONGEST, Z, THRESHOLD, BASE = 2.0, 200.0, 1.645, 0.5, 0.1


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _strength(groups: DataFrame) -> float:
    """The level's prior strength, from one row of sums over its groups."""
    seen = groups.where("n > 0")
    k, n, bad, squares, spread = seen.agg(F.count(F.lit(1)), F.sum("n"), F.sum("bad"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
    if not k:
        return STRONGEST
    mean = bad / n
    within, scale = mean * (1 - mean), n - squares / n
    between = (spread - n * mean * mean - (k - 1) * within) / scale if scale > 0 else 0.0
    return min(max(within / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST


def named(hosts: DataFrame) -> DataFrame:
    """hosts with domain and suffix."""
    names = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(names, -1 * F.least(F.size(names), n), n), ".")
    size = F.when(last(F.lit(2)).isin(SUFFIXES), F.lit(2)).otherwise(F.lit(1))
    return hosts.withColumns({"domain": last(size + 1), "suffix": last(size)})


def reputations(outcomes: DataFrame, base: float | None = None) -> DataFrame:
    """host, pages, bad, n -> the host's posterior mean and bound; bad and n count labelled pages. base is the share above the suffixes (none: that of all outcomes)."""
    hosts = named(outcomes)
    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("_below")]
    domains = durable(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = durable(domains.groupBy("suffix").agg(*sums))
    bad, n, n_domains = suffixes.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("bad", "n", "_below"))).first()
    base = (bad + 1) / (n + 2) if base is None else base
    n_hosts = domains.agg(F.coalesce(F.sum("_below"), F.lit(0))).first()[0]

    def mean(level: DataFrame, prior: Column) -> Column:
        strength = _strength(level)
        return (F.col("bad") + strength * prior) / (F.col("n") + strength)

    suffixes = suffixes.select("suffix", mean(suffixes, F.lit(base)).alias("up"), "_below")
    below = domains.select("suffix", "domain", "bad", "n", F.col("_below").alias("_hosts"))
    domains = join_with_hot_keys(below, suffixes, ["suffix"], "_below", n_domains).select("domain", mean(domains, F.col("up")).alias("up"), F.col("_hosts").alias("_below"))
    strength = _strength(outcomes)
    hosts = join_with_hot_keys(hosts.drop("suffix"), domains, ["domain"], "_below", n_hosts).withColumn("mean", (F.col("bad") + strength * F.col("up")) / (F.col("n") + strength))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    return hosts.select("host", "pages", F.col("mean").alias("bad_share"), (F.col("mean") - Z * deviation).alias("bound"), F.col("n").alias("labelled"))


def _labelled(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host -> host, pages, bad, n by the pages' own labels (doc_id is the page's id)."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.coalesce(bad, F.lit(False)).cast("long").alias("_bad")).where("page_id IS NOT NULL")
    marks = marks.groupBy("page_id").agg(F.sum("_bad").alias("_bad"), F.count(F.lit(1)).alias("_n"))
    return judged.join(marks, "page_id", "left").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, labelled, bad_share, bound (the last three of the host)."""
    url = F.col("url")
    judged = durable(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    verdict = F.lit(None).cast("string")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    by_rule = judged.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(verdict == "block").alias("bad"), F.count(verdict).alias("n"))
    known = durable(reputations(durable(by_rule), BASE) if labels is None else reputations(durable(_labelled(judged, labels))))
    total = known.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    method = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return join_with_hot_keys(judged, known, ["host"], "pages", total).select(
        "page_id", "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "labelled", F.round("bad_share", 6).alias("bad_share"), F.round("bound", 6).alias("bound")
    )


SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
hosts AS (
  SELECT host, CAST(count(*) FILTER (rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AS DOUBLE) AS bad, CAST(count(rule) AS DOUBLE) AS n FROM judged GROUP BY host),
named AS (
  SELECT *, CASE WHEN multi THEN regexp_extract(host, '([^.]*\.)?[^.]*\.[^.]*$') ELSE regexp_extract(host, '([^.]*\.)?[^.]*$') END AS domain,
         CASE WHEN multi THEN regexp_extract(host, '[^.]*\.[^.]*$') ELSE regexp_extract(host, '[^.]*$') END AS suffix
  FROM (SELECT *, regexp_extract(host, '[^.]*\.[^.]*$') IN ({SUFFIXES}) AS multi FROM hosts)),
domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM named GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix),
s1 AS (
  SELECT suffix, bad, n, CAST(0.1 AS DOUBLE) AS up,
         sum(bad) OVER () / greatest(sum(n) OVER (), 1) AS m, sum(n) OVER () AS total,
         sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER () AS k, sum(n * n) OVER () AS nn FROM suffixes),
s2 AS (
  SELECT *, m * (1 - m) AS v,
         (sum(CASE WHEN n > 0 THEN n * (bad / n - m) * (bad / n - m) ELSE 0 END) OVER () - (k - 1) * m * (1 - m))
         / nullif(total - nn / greatest(total, 1), 0) AS b FROM s1),
s3 AS (SELECT suffix, bad, n, up, least(greatest(CASE WHEN b > 0 THEN v / b - 1 ELSE 200.0 END, 2.0), 200.0) AS strength FROM s2),
s4 AS (SELECT suffix, (bad + strength * up) / (n + strength) AS up FROM s3),
d1 AS (
  SELECT domain, bad, n, up, sum(bad) OVER () / greatest(sum(n) OVER (), 1) AS m, sum(n) OVER () AS total,
         sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER () AS k, sum(n * n) OVER () AS nn FROM domains JOIN s4 USING (suffix)),
d2 AS (
  SELECT *, m * (1 - m) AS v,
         (sum(CASE WHEN n > 0 THEN n * (bad / n - m) * (bad / n - m) ELSE 0 END) OVER () - (k - 1) * m * (1 - m))
         / nullif(total - nn / greatest(total, 1), 0) AS b FROM d1),
d3 AS (SELECT domain, bad, n, up, least(greatest(CASE WHEN b > 0 THEN v / b - 1 ELSE 200.0 END, 2.0), 200.0) AS strength FROM d2),
d4 AS (SELECT domain, (bad + strength * up) / (n + strength) AS up FROM d3),
h1 AS (
  SELECT host, bad, n, up, sum(bad) OVER () / greatest(sum(n) OVER (), 1) AS m, sum(n) OVER () AS total,
         sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER () AS k, sum(n * n) OVER () AS nn FROM named JOIN d4 USING (domain)),
h2 AS (
  SELECT *, m * (1 - m) AS v,
         (sum(CASE WHEN n > 0 THEN n * (bad / n - m) * (bad / n - m) ELSE 0 END) OVER () - (k - 1) * m * (1 - m))
         / nullif(total - nn / greatest(total, 1), 0) AS b FROM h1),
h3 AS (SELECT host, bad, n, up, least(greatest(CASE WHEN b > 0 THEN v / b - 1 ELSE 200.0 END, 2.0), 200.0) AS strength FROM h2),
h4 AS (SELECT host, n, (bad + strength * up) / (n + strength) AS mean, strength FROM h3),
known AS (SELECT host, CAST(n AS BIGINT) AS labelled, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (n + strength + 1)) AS bound FROM h4)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, labelled,
       round(mean, 6) AS bad_share, round(bound, 6) AS bound
FROM judged JOIN known USING (host)
""".replace("{SUFFIXES}", ", ".join(f"'{x}'" for x in SUFFIXES))
