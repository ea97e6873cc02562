"""URL filters: exact rules first, else the empirical-Bayes reputation of the host.

Labelled outcomes of pages are counted by host, registered domain and suffix. Each level's bad share is shrunk towards
the level above by a beta-binomial prior: the prior's mean is the posterior mean above, its strength comes from the
spread of the level's shares around those means (method of moments). A host is blocked when the lower bound of its posterior share of bad
pages, mean - z * standard deviation, exceeds `max_bad`. Hosts without labels stand on their domain's prior.

Null urls and urls without "://" have an empty host and path. Outcomes that are null, or of unknown pages, count for
nothing; with no labels at all only the rules block. Repeated rows are judged each. An empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, files_for

#: Blocked hosts up to this many are broadcast; more are joined by shuffling (adaptive execution splits a hot host).
BROADCAST_ROWS = 300_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as columns; A-Z of the host in lower case."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


#: Public suffixes of two labels under which owners register domains (others have one label).
SUFFIXES = (
    "ac.at", "ac.id", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.th", "ac.uk", "ac.za",
    "appspot.com", "asn.au", "blogspot.com", "cloudfront.net", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke",
    "co.kr", "co.nz", "co.th", "co.uk", "co.ve", "co.za", "com.ar", "com.au", "com.bd", "com.br",
    "com.cn", "com.co", "com.ec", "com.eg", "com.es", "com.gr", "com.hk", "com.mx", "com.my", "com.ng",
    "com.pe", "com.ph", "com.pk", "com.pl", "com.pt", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua",
    "com.uy", "com.ve", "com.vn", "edu.ar", "edu.au", "edu.br", "edu.cn", "edu.co", "edu.es", "edu.hk",
    "edu.in", "edu.mx", "edu.my", "edu.pl", "edu.sg", "edu.tr", "edu.tw", "edu.vn", "fly.dev", "github.io",
    "gitlab.io", "go.id", "go.jp", "go.kr", "go.th", "gob.ar", "gob.es", "gob.mx", "gob.pe", "gouv.fr",
    "gov.ar", "gov.au", "gov.br", "gov.cn", "gov.hk", "gov.il", "gov.in", "gov.it", "gov.my", "gov.ph",
    "gov.pl", "gov.sg", "gov.tr", "gov.tw", "gov.uk", "gov.vn", "gov.za", "govt.nz", "gv.at", "herokuapp.com",
    "id.au", "ltd.uk", "me.uk", "ne.jp", "net.ar", "net.au", "net.br", "net.cn", "net.in", "net.nz",
    "net.pl", "net.tr", "net.tw", "net.uk", "net.za", "netlify.app", "nhs.uk", "nom.br", "nom.es", "or.at",
    "or.id", "or.jp", "or.kr", "or.th", "org.ar", "org.au", "org.br", "org.cn", "org.es", "org.hk",
    "org.il", "org.in", "org.mx", "org.my", "org.nz", "org.pl", "org.sg", "org.tr", "org.tw", "org.ua",
    "org.uk", "org.za", "pages.dev", "plc.uk", "police.uk", "sch.id", "sch.uk", "vercel.app", "web.app", "workers.dev",
)


def split_host(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix), without a port: the suffix is the last label, or the last two if listed, and the domain has one label
    more. A numeric address is its own domain, under the suffix `ip`."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    listed, numeric = two.isin(*suffixes) if suffixes else F.lit(False), bare.rlike("^([0-9]+\\.){3}[0-9]+$|^\\[")
    domain = F.when(numeric, bare).when(listed, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(numeric, "ip").when(listed, two).otherwise(F.substring_index(bare, ".", -1))


def _strength(level: DataFrame) -> float:
    """Prior strength from (k, n, mean: that of the member's parent) of a level's members, by the method of moments: under a beta-binomial
    law around each parent's mean, (k - n * mean)^2 / n has the expectation mean * (1 - mean) * (1 + (n - 1) / (strength + 1)). Between 2 and 1000."""
    found = level.where("n > 0").agg(
        F.expr("sum((k - n * mean) * (k - n * mean) / n)"), F.expr("sum(mean * (1 - mean))"), F.expr("sum((n - 1) * mean * (1 - mean))")
    ).first()
    spread, plain, more = (x or 0.0 for x in found)
    if spread <= plain or more <= 0:
        return 1000.0
    return max(2.0, min(1000.0, more / (spread - plain) - 1))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """pages: (page_id, host); outcomes: (page_id, bad boolean). Returns (host, n, k, share, bound) for each host."""
    known = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    own = pages.select("page_id", "host").join(known, "page_id", "left")
    counts = own.groupBy("host").agg(F.sum(F.col("bad").isNotNull().cast("double")).alias("n"), F.sum(F.coalesce(F.col("bad").cast("double"), F.lit(0.0))).alias("k"))
    domain, suffix = split_host(F.col("host"), suffixes)
    files = files_for(pages.count())
    hosts = durable(counts.withColumn("domain", domain).withColumn("suffix", suffix), files)
    domains = durable(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), files)
    ends = durable(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), files)
    n, k = ends.agg(F.sum("n"), F.sum("k")).first()
    top = ((k or 0.0) + 0.5) / ((n or 0.0) + 1.0) if n else 0.0
    shrunk = lambda s: (F.col("k") + F.lit(s) * F.col("mean")) / (F.col("n") + F.lit(s))
    ends = ends.withColumn("mean", F.lit(top))
    means = ends.select("suffix", shrunk(_strength(ends)).alias("mean"))
    domains = durable(domains.join(means, "suffix"), files)
    means = domains.select("domain", shrunk(_strength(domains)).alias("mean"))
    hosts = durable(hosts.join(means, "domain"), files)
    s = _strength(hosts)
    return (
        hosts.withColumn("share", shrunk(s))
        .withColumn("bound", F.col("share") - F.lit(z) * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("n") + F.lit(s) + 1)))
        .select("host", "n", "k", "share", "bound")
    )


def _first_fit(rules: Sequence[tuple[str, str, str]], value) -> Column:
    out = None
    for action, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, value(action, host, path)) if out is None else out.when(fits, value(action, host, path))
    return F.lit(None).cast("string") if out is None else out


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    max_bad: float = 0.3,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row. rules: up to 1000 of (allow or block, host, path); a rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = durable(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), files_for(pages.count(), 100_000, 24))
    blocked = durable(host_reputation(rows, outcomes, z).where(F.col("bound") > max_bad).select(F.col("host").alias("bad_host")), 24)
    small = blocked.count() <= BROADCAST_ROWS
    method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return (
        rows.withColumn("rule", _first_fit(rules, lambda a, h, p: F.lit(h + p)))
        .withColumn("ruling", _first_fit(rules, lambda a, h, p: F.lit(a)))
        .join(F.broadcast(blocked) if small else blocked, F.col("host") == F.col("bad_host"), "left")
        .select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"))
    )
