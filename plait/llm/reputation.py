"""URL filters: rules, and host reputations by empirical Bayes where no rule fits."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

# Public suffixes of two labels that are known here; all others are the last label.
TWO_LABELS = ["ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk"]

# No rate is taken as less or more alike among the members of a group than this.
LEAST_ALIKE, MOST_ALIKE = 0.001, 0.5

# Hosts with more than one page in so many are joined without a shuffle: no more of them.
HOT_HOSTS = 1000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _last(labels: Column, count: int) -> Column:
    from_end = F.slice(labels, F.greatest(F.size(labels) - count + 1, F.lit(1)), F.lit(count))
    return F.array_join(from_end, ".")


def with_domains(hosts: DataFrame, two_labels: list[str] = TWO_LABELS) -> DataFrame:
    """Add the public ``suffix`` of each ``host`` and its registered ``domain``, one label more."""
    labels = F.split("host", r"\.")
    two = _last(labels, 2).isin(two_labels)
    return hosts.withColumns({
        "suffix": F.when(two, _last(labels, 2)).otherwise(_last(labels, 1)),
        "domain": F.when(two, _last(labels, 3)).otherwise(_last(labels, 2)),
    })


def _strength(groups: DataFrame) -> float:
    """How many labelled pages the rate of the level above counts as, by moments.

    Among members of a group with rate ``m``, bad pages spread by
    ``n m (1 - m) (1 + (n - 1) r)``; ``r`` is estimated over all members with labelled
    pages and the prior counts as ``1 / r - 1`` pages.
    """
    plain = F.col("m") * (1 - F.col("m"))
    over = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) - F.col("n") * plain)
    unit = F.sum(F.col("n") * (F.col("n") - 1) * plain)
    over, unit = groups.agg(over, unit).first()
    alike = over / unit if unit else LEAST_ALIKE
    return 1 / min(max(alike, LEAST_ALIKE), MOST_ALIKE) - 1


def _rate(strength: float) -> Column:
    return (F.col("bad") + strength * F.col("m")) / (F.col("n") + strength)


def reputations(hosts: DataFrame, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """Add ``rate`` and ``blocked`` to ``host, n, bad`` (unique hosts, labelled and bad pages).

    Rates of suffixes are shrunk to that of all pages, those of registered domains to
    their suffix's and those of hosts to their domain's; each level's beta-binomial prior
    is fitted to the level's own counts. ``rate`` is the posterior mean of a bad page. A
    host is blocked if even the lower end of its posterior (mean less ``z`` standard
    deviations) is above ``limit``; a host without labelled pages is judged by its domain.
    """
    hosts = with_domains(hosts)
    total, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = suffixes.withColumn("m", F.lit((bad + 0.5) / (total + 1)))
    suffixes = suffixes.select("suffix", _rate(_strength(suffixes)).alias("m"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", _rate(_strength(domains)).alias("m"))
    hosts = hosts.join(domains, "domain")
    strength = _strength(hosts)
    rate = _rate(strength)
    spread = F.sqrt(rate * (1 - rate) / (F.col("n") + (strength + 1)))
    return hosts.select("host", "n", "bad", rate.alias("rate"), (rate - z * spread > limit).alias("blocked"))


def _rules_of(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``host, rules``: the rules that fit a host, longest first."""
    table = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"no rule: {verdict} {rule}")
        table.append((len(rule), len(host), verdict, host.translate(_LOWER), slash + path, rule))
    table.sort(key=lambda r: (-r[0], -r[1], r[2] != "block"))
    table = [(place, host, path, rule, verdict) for place, (_, _, verdict, host, path, rule) in enumerate(table)]
    ruled = hosts.sparkSession.createDataFrame(
        table, "place int, rule_host string, path string, rule string, verdict string"
    )
    labels = F.split("host", r"\.")
    deepest = max([r[1].count(".") + 1 for r in table], default=1)
    ends = F.array_distinct(F.array(*[_last(labels, k) for k in range(1, deepest + 1)]))
    fits = hosts.select("host", F.explode(ends).alias("rule_host")).join(ruled, "rule_host")
    return fits.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("place", "path", "rule", "verdict"))).alias("rules")
    )


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, z: float = 1.645
) -> DataFrame:
    """``page_id, host, path, rule, verdict, host_labelled, host_bad`` of every page.

    ``outcomes`` holds labelled pages, ``url`` and ``bad`` (boolean; null is unlabelled,
    repeated rows count as often as they occur). ``rules`` are ``("block" or "allow",
    "host/path")``, a list short enough for the driver; a rule fits its host and all
    subdomains if the page's path starts with the rule's. The longest rule wins (then the
    one with the longer host, then a blocking one); without a rule the host's reputation
    decides (:func:`reputations`). ``rule`` is the rule's text or null.

    A null url and one without ``://`` have an empty host and path, which no rule fits and
    which counts as a host of its own. A page_id may be null or repeated; each row is
    judged. No pages give no rows; other columns, whatever their names, are ignored.

    Pages are reduced to counts per host before any shuffle. Judgements come back to pages
    by a join on the host; hosts with more than a thousandth of all pages, a thousand at
    most, are broadcast, so a host may have any share of the pages.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    zero = F.lit(0).cast("long")
    counted = rows.groupBy("host").agg(F.count("*").alias("pages"))
    labelled = outcomes.where("bad is not null").select(host_of(F.col("url")).alias("host"), "bad")
    labelled = labelled.groupBy("host").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    every = counted.select("host", "pages", zero.alias("n"), zero.alias("bad"))
    every = every.unionByName(labelled.withColumn("pages", zero))
    hosts = written(every.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "bad")]), "hosts")
    judged = hosts.select("host", "pages").join(reputations(hosts.drop("pages"), limit, z), "host")
    judged = judged.join(_rules_of(hosts.where("pages > 0"), rules), "host", "left")
    judged = written(judged.where("pages > 0").select("host", "pages", "n", "bad", "blocked", "rules"), "judged")
    total = judged.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]

    known = [F.struct("n", "bad", "blocked", "rules")]
    hot = judged.where(F.col("pages") * HOT_HOSTS > total).select(F.col("host").alias("_hot"), known[0].alias("_known"))
    cold = judged.where(F.col("pages") * HOT_HOSTS <= total).select(F.col("host").alias("_cold"), known[0].alias("_found"))
    # Pages of hot hosts meet nothing in the second join: spread them. No host holds a slash.
    apart = F.concat(F.lit("/"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("string"))
    met = rows.join(F.broadcast(hot), F.col("host") == F.col("_hot"), "left").withColumn(
        "_key", F.when(F.col("_hot").isNotNull(), apart).otherwise(F.col("host"))
    )
    met = met.join(cold, F.col("_key") == F.col("_cold"), "left")
    met = met.withColumn("_known", F.coalesce("_known", "_found"))
    fits = F.filter(F.col("_known.rules"), lambda r: F.startswith(F.col("path"), r["path"]))
    first = F.get(fits, F.lit(0))
    by_host = F.when(F.col("_known.blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return met.select(
        "page_id", "host", "path", first["rule"].alias("rule"),
        F.coalesce(first["verdict"], by_host).alias("verdict"),
        F.col("_known.n").alias("host_labelled"), F.col("_known.bad").alias("host_bad"),
    )
