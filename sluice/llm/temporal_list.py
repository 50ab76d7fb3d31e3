"""URL filters by a temporal list join, with DataFrame functions only.

List entries are dated: an entry adds or removes a pattern of a list from a date
on. Entries become validity intervals, and every capture is judged by the entries
active on the day it was fetched (as-of join), never by today's list.

Patterns are domains (the host and all below it), hosts, or URLs without scheme,
fragment and trailing slash.

Scale: entries of one pattern collapse to one state change per list and day, so a
history is bounded by days times lists. Hosts are judged once each: distinct hosts
are expanded to their parent domains of as many labels as the lists' longest
domain has, joined to the histories by equality, and the captures join their
host's history, one row for one row: no interval is paired with captures outside
it. Histories of listed hosts are broadcast if counted and no more than
BROADCAST_SPANS intervals in all; otherwise captures are dealt by host, and those of
hosts with a large share of all captures over salted copies.

Defined cases: a null or hostless URL or a null date matches nothing and is kept
(blocked false); several entries of one pattern, list and day: the largest seq
holds; a removal without an addition has no effect; an entry with a null pattern or
date is ignored; an empty list blocks nothing; extra capture columns pass through,
and those with names of the operator's own come out with "_in" appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, set_aside, spread_join

OWN = ("host", "url_key", "blocked", "matches")
BROADCAST_SPANS = 500_000


def url_host(url: str) -> Column:
    """Lower-case host without user, port and final dots; null where there is none."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def url_key(url: str) -> Column:
    """URL without scheme, user, port of its scheme, fragment and trailing slash; host in lower case."""
    rest = F.regexp_replace(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(?::\d+)?([^#]*)", 1), r"/$", "")
    return F.concat(url_host(url), rest)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, history: array of (list, since, until), until null while active.

    ``entries``: list, kind, pattern, action ('add' or 'remove'), effective (date), seq (order within a day).
    """
    clean = entries.where("pattern IS NOT NULL AND effective IS NOT NULL AND list IS NOT NULL")
    daily = clean.groupBy("list", "kind", "pattern", "effective").agg(F.max(F.struct("seq", "action"))["action"].alias("action"))
    changes = daily.groupBy("list", "kind", "pattern").agg(F.array_sort(F.collect_list(F.struct("effective", "action"))).alias("c"))
    # A state begins where an addition follows no addition, and ends at the next removal.
    begins = F.expr("filter(c, (x, i) -> x.action = 'add' AND (i = 0 OR c[greatest(i - 1, 0)].action <> 'add'))")
    spans = F.expr("transform(b, x -> named_struct('list', list, 'since', x.effective, 'until', array_min(transform(filter(c, y -> y.action = 'remove' AND y.effective > x.effective), y -> y.effective))))")
    return (
        changes.withColumn("b", begins).withColumn("h", spans).where("size(h) > 0")
        .groupBy("kind", "pattern").agg(F.flatten(F.collect_list("h")).alias("history"))
    )


def active(history: Column, day: Column) -> Column:
    return F.filter(history, lambda h: (h["since"] <= day) & (h["until"].isNull() | (day < h["until"])))


def _host_histories(hosts: DataFrame, lists: DataFrame) -> DataFrame:
    """host, host_history: what any of the host's patterns ever said, each with its pattern."""
    named = lists.where("kind IN ('domain', 'host')").select("kind", "pattern", "history")
    most = named.agg(F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))).alias("n"))
    labels, n = F.split("host", r"\."), F.size(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.least(n, F.col("n"))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    each = hosts.join(F.broadcast(most))  # one row
    keys = each.select("host", F.explode(F.array_distinct(F.concat(F.coalesce(F.when(F.col("n") > 0, parents), F.array().cast("array<string>")), F.array("host")))).alias("pattern"))
    met = keys.join(named, "pattern").where((F.col("kind") == "domain") | (F.col("pattern") == F.col("host")))
    told = F.transform("history", lambda h: F.struct(h["list"].alias("list"), F.col("kind").alias("kind"), F.col("pattern").alias("pattern"), h["since"].alias("since"), h["until"].alias("until")))
    return met.select("host", told.alias("h")).groupBy("host").agg(F.flatten(F.collect_list("h")).alias("host_history"))


def _with_history(captures: DataFrame, told: DataFrame, key: str, history: str, most: int) -> DataFrame:
    """Captures beside the history of their key, null where it has none."""
    told = cut(told, "histories")
    if (told.agg(F.sum(F.size(history))).first()[0] or 0) <= most:
        return captures.join(F.broadcast(told), key, "left")
    listed = cut(captures.join(told.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n")).join(told, key), "listed")
    inside = spread_join(captures, listed, [key], [c for c in captures.columns if c != key]).drop("n")
    return inside.unionByName(captures.join(listed.select(key), key, "left_anti").withColumn(history, F.lit(None).cast(dict(told.dtypes)[history])))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_date", broadcast: int = BROADCAST_SPANS) -> DataFrame:
    """Captures with host, url_key, matches (entries active on the day, in order) and blocked."""
    captures, names = set_aside(captures, (*OWN, "host_history", "url_history", "n"))
    url, day = names[url], names[day]
    lists = cut(intervals(entries), "lists")
    with_keys = captures.withColumn("host", url_host(url)).withColumn("url_key", url_key(url))
    hosts = with_keys.select("host").where("host IS NOT NULL").distinct()
    told = F.transform("history", lambda h: F.struct(h["list"].alias("list"), F.lit("url").alias("kind"), F.col("pattern").alias("pattern"), h["since"].alias("since"), h["until"].alias("until")))
    by_url = lists.where("kind = 'url'").select(F.col("pattern").alias("url_key"), told.alias("url_history"))
    joined = _with_history(with_keys, _host_histories(hosts, lists), "host", "host_history", broadcast)
    joined = _with_history(joined, by_url, "url_key", "url_history", broadcast)
    none = F.expr("cast(array() as array<struct<list: string, kind: string, pattern: string, since: date, until: date>>)")
    every = F.concat(F.coalesce("host_history", none), F.coalesce("url_history", none))
    matches = F.array_sort(F.coalesce(active(every, F.col(day)), none))
    return joined.withColumn("matches", matches).withColumn("blocked", F.size("matches") > 0).select(*captures.columns, "host", "url_key", "matches", "blocked")
