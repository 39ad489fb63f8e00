"""URL filter: rules by host and path, and an empirical-Bayes reputation of hosts, with DataFrame operations only.

A page's outcome is bad or not. A host's bad rate has a beta prior around its registered domain's rate, that
one around its suffix's, that one around the rate of all. How strong the priors are is estimated from the
outcomes of each level (the beta-binomial's variance). A host is blocked where the lower bound of its rate is
above a limit: few outcomes on a host say little by themselves.

A suffix is the last label, or the last two where SUFFIXES lists them; other public suffixes of several labels
aren't known. A registered domain has one label more. Ports and user parts don't count there, and an IP address is a domain and
a suffix of its own. The SQL takes the last label and the last two: equal where no such host occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.util import joined, keep

#: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: So many rules are one expression; more are joined.
CHAIN = 500
#: Deviations between mean and bound, the limit of the bound, and the range of the spread between siblings.
DEVIATIONS, LIMIT, SPREAD = 1.645, 0.5, (0.001, 0.5)

#: Public suffixes of two labels: second-level labels by country.
SUFFIXES = tuple(
    f"{label}.{country}"
    for country, labels in {
        "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi maori net org school",
        "za": "ac co gov net org web", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "in": "ac co edu firm gen gov ind net org res",
        "br": "art blog com edu gov net org", "ar": "com edu gob gov net org", "mx": "com edu gob net org", "co": "com edu gov net org", "cn": "ac com edu gov net org",
        "hk": "com edu gov idv net org", "tw": "com edu gov idv net org", "sg": "com edu gov net org per", "my": "com edu gov net org", "th": "ac co go in mi net or",
        "id": "ac co go my net or sch web", "ph": "com edu gov net org", "vn": "com edu gov net org", "tr": "bel com edu gen gov k12 net org web", "il": "ac co gov k12 muni net org",
        "ua": "com edu gov in net org", "pl": "com edu gov net org", "es": "com edu gob nom org", "pt": "com edu gov org", "gr": "com edu gov net org", "eg": "com edu gov net org",
        "ke": "ac co go ne or", "ng": "com edu gov net org", "sa": "com edu gov net org", "pk": "com edu gov net org", "pe": "com edu gob net org", "hu": "co org",
    }.items()
    for label in labels.split()
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOMAIN = r"([^.]*\.)?[^.]*$"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path; both empty for a null url and one without `://`."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, _UPPER, _LOWER), "path": path})


def _site() -> tuple[Column, Column]:
    """A host's registered domain and suffix."""
    bare = F.regexp_extract("host", r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    address = bare.startswith("[") | bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*SUFFIXES)
    domain = F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(address, bare).when(long, two).otherwise(F.substring_index(bare, ".", -1))


def _chain(rules: Sequence[tuple[str, str, str]], value: int | None) -> Column:
    """The longest rule that fits host and path: its text, or with a number that part of it; null where none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((F.col("host") == r[0]) | F.col("host").endswith("." + r[0])) & F.col("path").startswith(r[1])
        out = F.when(fits, F.lit(r[0] + r[1] if value is None else r[value])).otherwise(out)
    return out


def ruled(df: DataFrame, rules: Sequence[tuple[str, str, str]], chain: int = CHAIN) -> DataFrame:
    """Add the longest rule that fits `host` and `path`, and what it says as `said`; both null where none does.

    Up to `chain` rules are one expression. More are joined by the host's last labels, once for each number of labels
    that rules have.
    """
    if len(rules) <= chain:
        return df.withColumns({"rule": _chain(rules, None), "said": _chain(rules, 2)})
    order = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("size"), F.length("rule_host").alias("host_size"), "rule_host", "rule_path", "verdict")
    listed = df.sparkSession.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")
    listed = listed.groupBy("rule_host").agg(F.collect_list(order).alias("found"))
    depths = sorted({r[0].count(".") + 1 for r in rules})
    for d in depths:
        own = listed.where(F.size(F.split("rule_host", "[.]")) == d).select(F.col("rule_host").alias(f"_h{d}"), F.col("found").alias(f"_f{d}"))
        df = df.join(own, F.substring_index("host", ".", -d) == F.col(f"_h{d}"), "left")
    fitting = [F.filter(F.coalesce(F.col(f"_f{d}"), F.array()), lambda r: F.col("path").startswith(r["rule_path"])) for d in depths]
    df = df.withColumn("_best", F.array_max(F.concat(*fitting)))
    df = df.withColumns({"rule": F.concat("_best.rule_host", "_best.rule_path"), "said": F.col("_best.verdict")})
    return df.drop("_best", *[f"_{x}{d}" for d in depths for x in "hf"])


def _strength(children: DataFrame, p0: float) -> float:
    """The priors' strength, from (n, k, p) with p the parent's rate."""
    n, k, p = F.col("n"), F.col("k"), F.col("p")
    r = children.where("n > 0").agg(F.sum(n * (k / n - p) ** 2).alias("s"), F.count("*").alias("c"), F.sum("n").alias("t"), F.sum(n * n).alias("q")).first()
    v = p0 * (1 - p0)
    below = (r["t"] - r["q"] / r["t"] - (r["c"] - 1)) * v if r["c"] else 0
    rho = (r["s"] - (r["c"] - 1) * v) / below if below > 0 else SPREAD[0]
    return 1 / max(SPREAD[0], min(SPREAD[1], rho)) - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, pages, n, k, bound) for rows (host, bad); bad is 0, 1 or null, and null where the outcome isn't known.

    Without any outcome the rate of all counts as 0 and no bound exceeds the limit. The rows are read once: the sums of
    hosts, domains and suffixes are written, and only the priors' strengths come to the driver.
    """
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("k"))
    domain, suffix = _site()
    hosts = keep(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = keep(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p0 = total["k"] / total["n"] if total["n"] else 0.0

    def shrunk(children: DataFrame, name: str) -> tuple[DataFrame, float]:
        m = _strength(children, p0)
        return children.withColumn(name, (F.col("k") + m * F.col("p")) / (F.col("n") + m)), m

    top, _ = shrunk(suffixes.withColumn("p", F.lit(float(p0))), "rate")
    mid, _ = shrunk(keep(domains.join(top.select("suffix", F.col("rate").alias("p")), "suffix"), "rates"), "rate")
    own, m = shrunk(keep(hosts.drop("suffix").join(mid.select("domain", F.col("rate").alias("p")), "domain"), "rates"), "rate")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + m + 1))
    return own.select("host", "pages", "n", "k", (F.col("rate") - DEVIATIONS * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, bound) for every row of `pages`.

    `outcomes` has (id, bad), at most one row an id; null ids have none. Repeated pages count as often as they
    occur and give rows of their own; a null url has an empty host, judged like any host; other columns are
    not read. An empty table gives no rows. Hosts of many pages are sent out, the others joined.
    """
    split = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))).select("page_id", "host", "path")
    known = split.join(outcomes.select(F.col("id").alias("page_id"), "bad"), "page_id", "left").select("host", "bad")
    hosts = reputation(known)
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    found = ruled(joined(split, hosts, "host", "pages", total), rules)
    method = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), F.col("n").alias("n_labelled"), F.round("bound", 6).alias("bound"))


def outcomes(labels: DataFrame) -> DataFrame:
    """(id, bad) of labelled pages: bad is 1 for low quality or toxic contents; ids that occur twice take the worse."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    return labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad"))


def sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same over `pages` and `labels`, for DuckDB."""
    order = sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r), reverse=True)
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in order]
    text = " ".join(f"WHEN {f} THEN '{r[0]}{r[1]}'" for f, r in zip(fits, order, strict=True))
    said = " ".join(f"WHEN {f} THEN '{r[2]}'" for f, r in zip(fits, order, strict=True))

    def spread(table: str) -> str:
        return f"""(SELECT 1 / greatest({SPREAD[0]}, least({SPREAD[1]}, coalesce(CASE WHEN (t - q / t - (c - 1)) * v > 0
          THEN (s - (c - 1) * v) / ((t - q / t - (c - 1)) * v) END, {SPREAD[0]}))) - 1 AS m FROM (
          SELECT sum(n * (k / n - p) ** 2) AS s, CAST(count(*) AS DOUBLE) AS c, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(n * n) AS DOUBLE) AS q, max(p0) * (1 - max(p0)) AS v
          FROM {table} WHERE n > 0))"""

    return f"""
WITH o AS (SELECT doc_id AS page_id, max(CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS INTEGER)) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
h AS (SELECT host, regexp_extract(host, '{_DOMAIN}', 0) AS domain, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM u LEFT JOIN o USING (page_id) GROUP BY 1),
d AS (SELECT domain, split_part(domain, '.', -1) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
s1 AS (SELECT s.*, p0, p0 AS p FROM s, (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0) AS p0 FROM s)),
s2 AS (SELECT suffix, p0, (k + m * p) / (n + m) AS p FROM s1, {spread("s1")}),
d1 AS (SELECT d.*, s2.p, s2.p0 FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, p0, (k + m * p) / (n + m) AS p FROM d1, {spread("d1")}),
h1 AS (SELECT h.*, d2.p, d2.p0 FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, n, m, (k + m * p) / (n + m) AS rate FROM h1, {spread("h1")}),
h3 AS (SELECT host, n, rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + m + 1)) AS bound FROM h2)
SELECT page_id, host, path, CASE {text} END AS rule,
  CASE {said} WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict, CAST(n AS BIGINT) AS n_labelled, round(bound, 6) AS bound
FROM u JOIN h3 USING (host)"""
