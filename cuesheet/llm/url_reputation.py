"""URL filter: allow and block rules, then an empirical-Bayes reputation of hosts.

Labelled pages give each host good and bad outcomes. A suffix's rate of bad pages is shrunk to that of all pages, a registered
domain's to its suffix, a host's to its domain; each prior is a beta distribution whose strength is the moment estimate from
the spread of the rates below it. A page is blocked if the lower bound of its host's posterior rate (mean less ``z``
standard deviations) exceeds ``most_bad``. Hosts without labels take the posterior of their domain, suffix or all pages.

Null and empty urls and urls without "://" have an empty host and path, fit no rule and are judged by the rate of all pages. Very long urls
are matched whole. Pages may
repeat; labels without a page count nowhere; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Registries of countries sell domains under such a label and the country's two letters: com.tr, co.in, ac.uk.
SECOND_LEVEL = r"(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org|sch)\.[a-z]{2}"
STRENGTH = (1.0, 1000.0)
#: Bad and good pages taken as seen before any label.
PRIOR = (0.1, 0.9)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def _is_deep(two: Column, suffixes: Sequence[str]) -> Column:
    """Whether domains are registered under the two labels: by the rule of SECOND_LEVEL, or as one of ``suffixes``."""
    ruled = two.rlike(f"^{SECOND_LEVEL}$")
    return ruled | two.isin(*suffixes) if suffixes else ruled


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1)
    return F.when(host.rlike(r"^[\d.]+$"), host).when(_is_deep(two, suffixes), two).otherwise(F.regexp_extract(host, r"([^.]+)\.?$", 1))


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1)
    three = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)\.?$", 1)
    short = F.when(_is_deep(two, suffixes), three).otherwise(two)
    return F.when(host.rlike(r"^[\d.]+$") | (short == ""), host).otherwise(short)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; rules are (verdict, host/path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(rates: DataFrame, child: str, parent: str) -> float:
    """Prior strength from the spread of the children's rates around their parent's: a method of moments, within STRENGTH.

    rates: a row per child with n, bad and the parent's mean. The expected squared distance of a rate from its mean m is
    m (1 - m) (1 / n) (1 + (n - 1) / (s + 1)).
    """
    m, n = F.col("mean"), F.col("n")
    of = rates.filter("n > 1")
    x = of.agg(F.sum(n * (F.col("bad") / n - m) ** 2).alias("seen"), F.sum(m * (1 - m)).alias("noise"), F.sum(m * (1 - m) * (n - 1)).alias("slope")).first()
    if not x.slope or x.seen <= x.noise:
        return STRENGTH[1]
    return min(max(x.slope / (x.seen - x.noise) - 1, STRENGTH[0]), STRENGTH[1])


def reputations(pages: DataFrame, outcomes: DataFrame, *, suffixes: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> tuple[dict[str, DataFrame], tuple[float, float]]:
    """({level: (key, a, b)} for host, domain and suffix, staged; (a, b) of all pages). outcomes: (id, bad 0/1)."""
    host = bare_host(host_of(F.col(url_col)))
    seen = pages.select(F.col(id_col).alias("_id"), host.alias("host")).filter("host <> ''").join(outcomes.select(F.col(id_col).alias("_id"), F.col("bad").cast("double").alias("bad")).filter("bad is not null"), "_id")
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    hosts = staged(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    whole = (total.bad + PRIOR[0], total.n - total.bad + PRIOR[1])
    levels, mean = {}, F.lit(whole[0] / sum(whole))
    out: dict[str, DataFrame] = {}
    for name, rows, parent in (("suffix", suffixes, None), ("domain", domains, "suffix"), ("host", hosts, "domain")):
        if parent is None:
            rows = rows.withColumn("mean", mean)
        else:
            rows = rows.join(levels[parent].select(F.col("key").alias(parent), (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), parent)
        rows = staged(rows, f"rates-{name}")
        s = _strength(rows, name, "mean")
        levels[name] = out[name] = staged(rows.select(F.col(name).alias("key"), (F.col("mean") * s + F.col("bad")).alias("a"), ((1 - F.col("mean")) * s + F.col("n") - F.col("bad")).alias("b")), f"posterior-{name}")
    return out, whole


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], *, most_bad: float = 0.3, z: float = 1.645, suffixes: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per page: id, host, path, rule, verdict, bad_mean, bad_low (the posterior's mean and lower bound).

    suffixes: further suffixes of two labels under which domains are registered, as from the public suffix list.
    """
    levels, whole = reputations(pages, outcomes, suffixes=suffixes, id_col=id_col, url_col=url_col)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("_bare", bare_host(F.col("host")))
    rows = rows.withColumns({"_host": F.col("_bare"), "_domain": domain_of(F.col("_bare"), suffixes), "_suffix": suffix_of(F.col("_bare"), suffixes)})
    for name, df in levels.items():  # the larger side is the pages; a hot host is split by adaptive execution
        rows = rows.join(df.select(F.col("key").alias(f"_{name}"), F.struct("a", "b").alias(f"_{name}_post")), f"_{name}", "left")
    post = F.coalesce("_host_post", "_domain_post", "_suffix_post", F.struct(F.lit(whole[0]).alias("a"), F.lit(whole[1]).alias("b")))
    a, b = post["a"], post["b"]
    mean = a / (a + b)
    low = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    found = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(found["verdict"], F.when(low > most_bad, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(id_col, "host", "path", found["rule"].alias("rule"), verdict.alias("verdict"), mean.alias("bad_mean"), low.alias("bad_low"))
