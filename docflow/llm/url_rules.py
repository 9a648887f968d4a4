"""URL filters by a sort-merge range join (native DataFrame code).

A rule (host, path, verdict) fits its host and all subdomains when the url's path
starts with the rule's; the longest fitting rule wins. Hosts become canonical
keys: labels reversed, each as hex digits and closed by a dot, so the subdomains
of a host are exactly the keys in one interval. Intervals of hosts (and, for one
host, of path prefixes) are either nested or apart. A sweep over rule starts, rule
ends and keys in sort order therefore needs only the stack of the rules that are
open: each start event carries the stack from then on, each end event the stack
without it, and a key reads the last event before it.

The sweep runs twice over distinct keys: hosts against rule hosts, which gives the
stack of rule hosts that hold a host, then (rule host, path) against path
prefixes, which gives the longest prefix. A url is judged by the best of them.

Scale: urls are reduced to distinct (host, path) and distinct hosts before any
sort, so a host with a third of all urls is one key. The sweep's input is
range-partitioned and written once, with the number of its partition; windows run
inside a partition, and what is open at its start comes from the last event of the
partitions before it, one row a partition. Rules are never broadcast by hint.

Defined results: a null url, or one without ``://``, has empty host and path and
fits no rule; without a fitting rule the verdict is ``default``. Rules with a
null part are ignored; of equal rules with different verdicts block wins. Rows
that repeat are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.llm.storage import stored
from docflow.llm.text import ascii_lower, pick


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels in hex, each closed by a dot, which sorts before every hex digit."""
    return F.concat(F.array_join(F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.hex(F.encode(x, "UTF-8"))), "."), F.lit("."))


def path_key(host: Column, path: Column) -> Column:
    """A host and a prefix of a path; ``!`` sorts before every hex digit."""
    return F.concat(F.hex(F.encode(host, "UTF-8")), F.lit("!"), F.hex(F.encode(path, "UTF-8")))


END, START, KEY = 0, 1, 2


def sweep(events: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` with ``state``: that of the last event at or before ``key``.

    ``events`` has ``key, kind, state`` (state never null), ``keys`` has ``key`` and more.
    """
    state = events.schema["state"].dataType
    rows = events.unionByName(keys.select(F.col("key"), F.lit(KEY).alias("kind"), F.struct(*keys.columns).alias("row")), allowMissingColumns=True)
    rows = stored(rows.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "sweep")
    last = rows.where(F.col("kind") != KEY).groupBy("part").agg(F.max_by("state", F.struct("key", "kind")).alias("last"))
    parts = rows.select("part").distinct().join(last, "part", "left")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    carried = parts.select("part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("seen", F.last("state", ignorenulls=True).over(so_far)).where(F.col("kind") == KEY)
    return seen.join(F.broadcast(carried), "part").select("row.*", F.coalesce("seen", "carried", F.array().cast(state)).alias("state"))


def _host_events(hosts: DataFrame) -> DataFrame:
    """Start and end of each rule host's interval, with the stack of rule hosts open after it, outermost first."""
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up"))
    known = above.join(hosts.select(F.col("host").alias("up")), "up")
    stacks = known.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.length("up").alias("n"), "up"))), lambda x: x["up"]).alias("stack"))
    start = F.struct(F.col("k").alias("key"), F.lit(START).alias("kind"), F.col("stack").alias("state"))
    end = F.struct(F.concat(F.substring("k", F.lit(1), F.length("k") - 1), F.lit("/")).alias("key"), F.lit(END).alias("kind"), F.slice("stack", 1, F.size("stack") - 1).alias("state"))
    return stacks.withColumn("k", host_key(F.col("host"))).select(F.explode(F.array(start, end)).alias("e")).select("e.*")


def _path_events(rules: DataFrame) -> DataFrame:
    """Start and end of each path prefix's interval under its host, with the longest prefix open after it."""
    shorter = rules.select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("up"))
    above = shorter.where("up != path").join(rules.select("host", F.col("path").alias("up")), ["host", "up"])
    outer = above.groupBy("host", "path").agg(F.max_by("up", F.length("up")).alias("up"))
    found = rules.select("host", "path").join(outer, ["host", "path"], "left")
    none = F.array().cast("array<string>")
    key = path_key(F.col("host"), F.col("path"))
    start = F.struct(key.alias("key"), F.lit(START).alias("kind"), F.array("path").alias("state"))
    end = F.struct(F.concat(key, F.lit("G")).alias("key"), F.lit(END).alias("kind"), F.when(F.col("up").isNull(), none).otherwise(F.array("up")).alias("state"))
    return found.select(F.explode(F.array(start, end)).alias("e")).select("e.*")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row; ``rules`` has ``host, path, verdict``."""
    rules = stored(rules.where("host is not null and path is not null and verdict is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict")), "rules")
    own = pick(pages, _id=id_col, _url=url_col).select("_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    urls = stored(own.select("host", "path").distinct(), "urls")
    hosts = urls.select("host").distinct().withColumn("key", host_key(F.col("host")))
    held = sweep(_host_events(rules.select("host").distinct()), hosts).select("host", F.explode("state").alias("rule_host"))
    # The keys are exact, so what the stack holds does hold the host; the test only says so.
    held = held.where((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), "rule_host")))
    under = stored(urls.join(held, "host"), "under")
    paths = under.select("rule_host", "path").distinct().withColumn("key", path_key(F.col("rule_host"), F.col("path")))
    longest = sweep(_path_events(rules), paths).where(F.size("state") > 0).select("rule_host", "path", F.get("state", F.lit(0)).alias("rule_path"))
    fits = under.join(longest, ["rule_host", "path"]).join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), ["rule_host", "rule_path"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_host", "rule_path", "verdict")).alias("b"))
    # Under the turned host the verdicts are dealt out anew, so AQE can split the join at a hot url.
    turned = best.select(F.reverse("host").alias("_tsoh"), "path", "b")
    return own.withColumn("_tsoh", F.reverse("host")).join(turned, ["_tsoh", "path"], "left").select(
        F.col("_id").alias(id_col), "host", "path", F.when(F.col("b").isNotNull(), F.concat("b.rule_host", "b.rule_path")).alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"),
    )
