"""URL filters: listed rules first, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages are counted by host, registered domain, public suffix and in all. Each level's bad
rate is shrunk by a beta prior whose mean is the posterior mean of the level above and whose strength comes
from the beta-binomial spread of the level's units. A host is blocked when the lower bound of its
posterior is above the rate of all pages (or a given one).

Everything is DataFrame expressions. Defined results: a null url, or one without ``://``, has an empty
host and path, fits no rule and gets the reputation of the empty host. Repeated or contradictory outcomes of
a page count once, as bad if any is; null ones count for nothing. A port is part of the host but of no domain,
and an IP address is its own registered domain and suffix. Rows and columns of the input are kept but for host,
path, rule, verdict, bad_mean and bad_lower, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.skew import salted_join
from tessera.llm.store import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this count are held in the expression, more are joined; both give the same.
INLINE_RULES = 24
#: Suffixes of two labels under which names are registered. Other rules can be given: a suffix of any number of
#: labels, ``*.x`` for any one label before x, and ``!y`` for a name y that is registered all the same.
SUFFIXES = tuple("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp or.jp ne.jp com.br com.cn com.mx com.pl net.pl org.pl co.in co.kr co.za com.tr com.ar com.sg com.hk com.tw github.io gitlab.io blogspot.com".split())
_ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _name(host: Column) -> Column:
    """The host in lower case without user, port and a final dot."""
    return F.translate(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(?::[0-9]*)?$|\.(?::[0-9]*)?$", ""), UPPER, LOWER)


def _parent(name: Column) -> Column:
    """The name without its first label; empty for one label."""
    return F.regexp_extract(name, r"^[^.]*\.(.*)$", 1)


def _suffix_of(name: Column, suffixes: Sequence[str]) -> Column:
    """The longest suffix of a name that a rule gives, else its last label. Exceptions go before all other rules."""
    plain, wild, but = ([x[n:] for x in suffixes if x.startswith(mark) and (mark or x[0] not in "*!")] for n, mark in ((0, ""), (2, "*."), (1, "!")))
    fits = lambda x: x.isin(*plain) | (x.contains(".") & _parent(x).isin(*wild) if wild else F.lit(False))
    longest = F.get(F.filter(_suffixes(name), fits), F.lit(0))
    kept = F.get(F.filter(_suffixes(name), lambda x: x.isin(*but)), F.lit(0)) if but else F.lit(None).cast("string")
    return F.coalesce(_parent(kept), longest, F.substring_index(name, ".", -1))


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix and the label before it; an IP address, or a name that is a suffix, itself."""
    name = _name(host)
    suffix = _suffix_of(name, suffixes)
    own = F.substring_index(F.substr(name, F.lit(1), F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0))), ".", -1)
    return F.when(name.rlike(_ADDRESS) | (name == suffix), name).otherwise(F.concat(own, F.lit("."), suffix))


def public_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    name = _name(host)
    return F.when(name.rlike(_ADDRESS), name).otherwise(_suffix_of(name, suffixes))


def _suffixes(host: Column) -> Column:
    """host and every parent domain of it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``.

    A rule is (verdict, "host/path"); it fits its host and all subdomains when the path starts with the
    rule's; the longest wins. A list of up to INLINE_RULES is evaluated in the scan, a longer one or a DataFrame
    with columns verdict, rule is joined on the host's parent domains, of which frequent ones are dealt out.
    """
    if isinstance(rules, DataFrame):
        keyed = rules.select(
            F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"),
            F.substring_index("rule", "/", 1).alias("_rule_host"), F.expr("substr(rule, instr(rule, '/'))").alias("_rule_path"),
        )
        keys = urls.select("host", "path").distinct().withColumn("_rule_host", F.explode(_suffixes(F.col("host"))))
        # only parents that a rule names are joined, so that common suffixes without rules bring no rows
        best = (
            salted_join(keys, keyed, "_rule_host")
            .where(F.col("path").startswith(F.col("_rule_path")))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("_rule").alias("n"), "_rule", "_verdict")).alias("_best"))
        )
        best = best.select(F.concat_ws("/", F.length("host"), "host", "path").alias("_url"), "_best")
        joined = salted_join(urls.withColumn("_url", F.concat_ws("/", F.length("host"), "host", "path")), best, "_url", how="left")
        return joined.withColumns({"rule": F.col("_best._rule"), "rule_verdict": F.col("_best._verdict")}).drop("_best", "_url")
    if len(rules) > INLINE_RULES:
        return match_rules(urls, urls.sparkSession.createDataFrame(list(rules), "verdict string, rule string"))
    hit, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda x: len(x[1])):  # each longer one overrides
        name, path = rule.split("/", 1)
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{path}")
        hit, verdict = F.when(fits, F.lit(rule)).otherwise(hit), F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.withColumns({"rule": hit, "rule_verdict": verdict})


def _level(units: DataFrame, parents: DataFrame, parent: str, floor: float, ceiling: float) -> DataFrame:
    """Posterior of each unit (unit, n, bad) under the beta prior of its parent.

    The prior's mean is the parent's own posterior mean; its strength comes from the spread of the units
    around it (method of moments), kept within floor..ceiling.
    """
    joined = cut(salted_join(units, parents.select(parent, F.col("mean").alias("_prior")), parent), "level")
    spread = joined.groupBy(parent).agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.greatest(F.col("n"), F.lit(1)) - F.col("_prior"), F.lit(2))).alias("_ss"),
        F.count("*").alias("_k"),
    )
    # under the beta-binomial, E[ss / var] = k + rho * (n - k) with rho = 1 / (strength + 1)
    var = F.col("_prior") * (1 - F.col("_prior"))
    rho = (F.col("_ss") / var - F.col("_k")) / F.greatest(F.col("_n") - F.col("_k"), F.lit(1))
    strength = F.when(rho > 0, F.greatest(F.lit(floor), F.least(F.lit(ceiling), 1 / rho - 1))).otherwise(F.lit(ceiling))
    return (
        salted_join(joined, spread, parent)
        .withColumn("_s", F.when(var > 0, strength).otherwise(F.lit(ceiling)))
        .withColumn("mean", (F.col("bad") + F.col("_s") * F.col("_prior")) / (F.col("n") + F.col("_s")))
        .withColumn("weight", F.col("n") + F.col("_s"))
    )


def host_reputation(outcomes: DataFrame, floor: float = 2.0, ceiling: float = 1000.0, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior bad rate of every host: (host, n, bad, mean, lower, world).

    ``outcomes`` has host and bad (0, 1 or null for unlabelled). Counts are aggregated before any
    shuffle; the levels suffix > registered domain > host then shrink towards each other. ``lower`` is the
    one-sided bound mean - z * sd of the beta posterior, ``world`` the rate of all.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host"), suffixes), "suffix": public_suffix(F.col("host"), suffixes), "all": F.lit(1)})
    hosts = cut(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix", "all").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix", "all").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    world = ends.groupBy("all").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("mean"))
    ends = _level(ends, world, "all", floor, ceiling)
    domains = _level(domains, ends, "suffix", floor, ceiling)
    hosts = _level(hosts, domains, "domain", floor, ceiling).join(F.broadcast(world.select("all", F.col("mean").alias("world"))), "all")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return hosts.select("host", "n", "bad", "mean", (F.col("mean") - z * sd).alias("lower"), "world")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules, key: str = "page_id", max_bad: float | None = None) -> DataFrame:
    """Add host, path, rule, verdict, bad_mean and bad_lower to ``pages``.

    ``outcomes`` has ``key`` and bad (0/1). A page that fits a rule gets the rule's verdict; else it is
    blocked when the lower posterior bound of its host's bad rate is above ``max_bad``, by default the bad rate
    of all labelled pages.
    """
    added = ("host", "path", "rule", "verdict", "bad_mean", "bad_lower")
    kept = [c for c in pages.columns if c not in added]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(key).alias("_key"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    marks = outcomes.select(F.col(key).alias("_key"), F.col("bad").cast("int").alias("bad")).groupBy("_key").agg(F.max("bad").alias("bad"))
    # as small as the outcomes: only labelled pages are counted, the other hosts are added with nothing
    seen = packed.select("_key", "host").join(marks, "_key", "left")
    reputation = host_reputation(seen)
    bound = F.col("world") if max_bad is None else F.lit(max_bad)
    known = cut(reputation.select("host", F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"), (F.col("lower") > bound).alias("_bad")), "reputation")
    out = salted_join(match_rules(packed, rules), known, "host", packed.select("host"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("_bad"), "block").otherwise("allow"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "host", "path", "rule", verdict.alias("verdict"), "bad_mean", "bad_lower")
