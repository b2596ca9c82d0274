"""Allow and block rules on URL prefixes, by a sort-merge range join.

A host turns into a key that is sorted from its last label on: ``www.example.com`` becomes
``com.example.www.``. All subdomains of a rule's host then lie in one interval of keys, from
``com.example.`` up to ``com.example/`` (``/`` is the character after ``.``), and intervals of
different hosts are nested or apart. A sweep in key order meets each interval's start and end;
between two such boundaries the same nested rules are active, innermost last: the stack.

Everything is a DataFrame operation. The stack at each boundary comes from an equi-join of the
rule hosts with their own parent hosts. The sweep is a running window over boundaries and URLs;
URLs are dealt over ``lanes`` by a hash, and each lane gets the few boundaries, so that a host
with a third of all URLs is swept by all lanes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.common import lower_ascii

LANES = 256


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """``key, stack``: where in key order the set of active rules changes, and the rules active from there.

    ``rules`` has ``host``, ``path`` and ``verdict``. Of equal rules with different verdicts the
    one that sorts last (``block`` after ``allow``) counts. Rows with a null are no rule.
    """
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna()
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("host_n"),
                    F.concat("host", "path").alias("rule"), "verdict", "path")
    own = rules.groupBy("host").agg(F.collect_list(rule).alias("own"))
    labels = F.split("host", r"\.")
    parents = own.select("host", F.explode(F.expr(
        r"transform(sequence(1, size(split(host, '\\.'))), k -> array_join(slice(split(host, '\\.'), k, 1000000), '.'))")).alias("parent"))
    found = parents.join(own.select(F.col("host").alias("parent"), "own"), "parent")
    stacks = found.groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("parent") != F.col("host"), F.col("own")))).alias("after"))
    reversed_host = F.array_join(F.reverse(labels), ".")
    return stacks.select(F.inline(F.array(
        F.struct(F.concat(reversed_host, F.lit(".")).alias("key"), F.col("inside").alias("stack")),
        F.struct(F.concat(reversed_host, F.lit("/")).alias("key"), F.col("after").alias("stack")))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               lanes: int = LANES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` for its ``url`` column.

    A rule fits its host and all subdomains if the URL's path starts with the rule's; the longest
    (host and path together, then the longer host) wins. Without one, ``rule`` is null and the
    verdict is ``default``. A null URL, or one without ``://``, has empty host and path. Rows that
    repeat are judged one by one; an empty table of pages or of rules is fine. Input columns come
    back in the struct ``row``, so no name can clash.
    """
    seen = pages.select(F.struct("*").alias("row"))
    address = F.coalesce(F.col("row").getField(url).cast("string"), F.lit(""))
    seen = seen.select("row", url_host(address).alias("host"), url_path(address).alias("path"))
    bounds = boundaries(rules)
    stack_type = dict((f.name, f.dataType) for f in bounds.schema)["stack"]
    urls = seen.select(F.pmod(F.xxhash64("host", "path"), F.lit(lanes)).cast("int").alias("lane"),
                       host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"),
                       F.lit(None).cast(stack_type).alias("stack"), "row", "host", "path")
    starts = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "key", F.lit(0).alias("kind"), "stack",
                           F.lit(None).cast(seen.schema["row"].dataType).alias("row"),
                           F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    order = Window.partitionBy("lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = urls.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = swept.select("row", "host", "path", F.array_max(fits).alias("best"))
    return best.select("row", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
