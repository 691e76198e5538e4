"""URL filtering against dated lists: an as-of join of captures to the list entries in force when they were fetched.

A list is a feed of dated entries: from ``listed_at`` on, ``verdict`` holds for a host suffix, or for a path prefix
below one. A path prefix is one of characters: /de holds for /dependency too. Entries of one target become validity
intervals (each ends where the next begins). The distinct hosts, far fewer than captures, collect the intervals of their
suffixes; captures then join on their host alone and evaluate the intervals at their own time. Where these rules are more
than ``BROADCAST_BYTES``, as with a list of many paths under one domain, the distinct URLs collect the intervals that they
match, by joins on domain and path prefix, so no row grows with the list. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts; where two entries share target and time, the one that stands first here holds.
VERDICTS = ("block", "allow", "remove")
#: Bytes of all hosts' rules up to which they are broadcast, counted with RULE_BYTES for each.
BROADCAST_BYTES = 32 << 20
RULE_BYTES = 160

_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]+)"
_PATH = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and final dots; null where the URL is null or has none."""
    found = F.regexp_extract(F.lower(F.trim(url)), _HOST, 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path from its slash on, case kept; '/' where there is none."""
    found = F.regexp_extract(F.trim(url), "(?i)" + _PATH, 1)
    return F.when(found == "", "/").otherwise(found)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, path, verdict, valid_from, valid_to) of entries (target, verdict, listed_at); valid_to is null while in force.

    ``target`` is a domain or domain/path. Null or unknown verdicts and entries without target or date count for
    nothing; repeated entries count once; ``remove`` ends an interval and starts none.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")), F.lit(0))
    known = entries.where(F.col("target").isNotNull() & F.col("listed_at").isNotNull() & (rank > 0))
    domain = F.lower(F.regexp_extract("target", r"^([^/]*)", 1))
    path = F.regexp_extract("target", r"^[^/]*(/.*)$", 1)
    one = known.groupBy(domain.alias("domain"), path.alias("path"), "listed_at").agg(F.min_by("verdict", rank).alias("verdict"))
    w = Window.partitionBy("domain", "path").orderBy("listed_at")
    return one.select("domain", "path", "verdict", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(w).alias("valid_to")).where("verdict <> 'remove' AND domain <> ''")


def _suffixes(host: str) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _rule() -> Column:
    return F.struct(
        F.size(F.split("domain", r"\.")).alias("labels"), F.length("path").alias("depth"), (F.col("verdict") == "block").alias("blocks"), "domain", "path", "verdict", "valid_from", "valid_to"
    )


def rules_by_url(urls: DataFrame, valid: DataFrame) -> DataFrame:
    """(host, path, rules) of the (host, path) that any interval matches: the lengths of a domain's paths tell which prefixes to look up."""
    lengths = valid.groupBy("domain").agg(F.collect_set(F.length("path")).alias("lengths"))
    asked = urls.select("host", "path", F.explode(_suffixes("host")).alias("domain")).join(lengths, "domain")
    keys = asked.select("host", F.col("path").alias("whole"), "domain", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("whole"))
    keys = keys.select("host", "whole", "domain", F.substring(F.col("whole"), F.lit(1), F.col("n")).alias("path"))
    return keys.join(valid, ["domain", "path"]).groupBy("host", F.col("whole").alias("path")).agg(F.collect_list(_rule()).alias("rules"))


def rules_by_host(hosts: DataFrame, valid: DataFrame) -> DataFrame:
    """(host, rules) of the hosts that any interval is about, now or at another time."""
    suffixed = hosts.select("host", F.explode(_suffixes("host")).alias("domain"))
    return suffixed.join(valid, "domain").groupBy("host").agg(F.collect_list(_rule()).alias("rules"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``captures`` with host, verdict (block, allow or null), target, listed_at and keep.

    Of the intervals that hold at ``fetched_at`` (from inclusive, to exclusive) the one of most domain labels, then of
    the longest path, decides. A capture is kept unless that says block; without URL, host or time nothing is said and
    it is kept. Every row stays, repeated ones too. Own columns of these five names are replaced.
    """
    mine = ("host", "verdict", "target", "listed_at", "keep")
    columns = [c for c in captures.columns if c not in mine or c in (url, fetched_at)]
    at, at_url = F.col(f"`{fetched_at}`"), F.col(f"`{url}`")
    rows = captures.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)), host_of(at_url).alias("host"), path_of(at_url).alias("path"), at.alias("at"))
    valid = intervals(entries)
    # how large the hosts' rules are follows from how many intervals each domain has, without making them
    per_domain = valid.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    hosts = rows.where(F.col("host").isNotNull()).select("host").distinct()
    total = hosts.select(F.explode(_suffixes("host")).alias("domain")).join(per_domain, "domain").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if total * RULE_BYTES <= broadcast_bytes:
        joined = rows.join(F.broadcast(rules_by_host(hosts, valid)), "host", "left")
    else:
        urls = rows.where(F.col("host").isNotNull()).select("host", "path").distinct()
        joined = rows.join(rules_by_url(urls, valid), ["host", "path"], "left")
    holds = lambda r: (r["valid_from"] <= F.col("at")) & (r["valid_to"].isNull() | (F.col("at") < r["valid_to"])) & F.startswith(F.col("path"), r["path"])
    best = joined.withColumn("best", F.array_max(F.filter("rules", holds)))
    return best.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)), "host", F.col("best.verdict").alias("verdict"), F.concat("best.domain", "best.path").alias("target"),
        F.col("best.valid_from").alias("listed_at"), (~F.coalesce(F.col("best.verdict") == "block", F.lit(False))).alias("keep"),
    )
