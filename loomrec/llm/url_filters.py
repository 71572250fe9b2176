"""URL filters (native): allow and block rules over hosts with their subdomains, and paths.

A rule's canonical key is its reversed host, each label closed by a dot, followed by its path:
``example.com`` with ``/en/`` is ``com.example./en/``. A url has one key for each of its host and
the hosts above, as deep as the rules' hosts are; the urls that a rule fits are then those with a key in the interval of keys that
begin with the rule's. Such intervals nest or are disjoint. A sorted sweep over rules and urls
keeps a stack of the rules whose interval is open: at each rule the stack is what is left of the
last one and the rule itself, and a url's innermost rule is the last of that stack that is still
open at the url's key. The longest rule over a url's keys decides.

Sweeps run by (exact rule host, salt): urls are counted by host first, hosts with many are dealt to
several sweeps, each with a copy of that host's rules. Rules are stacked in runs of ``run_length``
by host; the rules open where a run begins are found by an equi-join on prefixes.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the
default verdict; an empty host has no key; repeated rules count once (block wins over allow);
repeated rows are judged each; empty tables of urls or rules are fine. Null rule hosts or paths are
empty; an empty rule host fits nothing; very long urls, of many labels too, are judged whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.common import ascii_lower, let, spread_join
from loomrec.session import write_through


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(host: Column, deepest: Column) -> Column:
    """The reversed keys of a host and the hosts above it, com., com.example., ..., up to ``deepest`` labels."""

    def keys(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), deepest)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))

    return F.when((host == "") | (deepest < 1), F.array().cast("array<string>")).otherwise(let(F.reverse(F.split(host, r"\.")), keys))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stacked_rules(rules: DataFrame, run_length: int = 256) -> DataFrame:
    """hostkey, path, stack: for each rule the rules open at its key, outermost first, itself last."""
    clean = (
        rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host != ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("hostkey"), "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    numbered = clean.withColumn("run", F.floor((F.row_number().over(Window.partitionBy("hostkey").orderBy("path")) - 1) / run_length))
    entry = F.struct("path", "rule", "verdict")
    runs = numbered.groupBy("hostkey", "run").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    # What is open where a later run begins: rules whose path is a proper prefix of the run's first.
    heads = runs.where("run > 0").select("hostkey", "run", F.col("entries")[0]["path"].alias("head"))
    open_at = (
        heads.withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), F.length("head") - 1), lambda n: F.col("head").substr(F.lit(1), n))))
        .join(numbered.select("hostkey", "path", "rule", "verdict"), ["hostkey", "path"])
        .groupBy("hostkey", "run")
        .agg(F.sort_array(F.collect_list(entry)).alias("carried"))
    )
    none = "cast(array() as array<struct<path: string, rule: string, verdict: string>>)"
    swept = f"""aggregate(entries,
        named_struct('stack', coalesce(carried, {none}), 'out', cast(array() as array<array<struct<path: string, rule: string, verdict: string>>>)),
        (a, e) -> named_struct(
            'stack', array_append(filter(a.stack, r -> startswith(e.path, r.path)), e),
            'out', array_append(a.out, array_append(filter(a.stack, r -> startswith(e.path, r.path)), e)))).out"""
    stacks = runs.join(open_at, ["hostkey", "run"], "left").select("hostkey", F.explode(F.expr(swept)).alias("stack"))
    return stacks.select("hostkey", F.expr("element_at(stack, -1).path").alias("path"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", sweep_rows: int = 2000) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); ``rules`` has host, path, verdict."""
    urls = write_through(pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    stacks = write_through(stacked_rules(rules), "url-stacks")
    # No rule fits by a host below the deepest of the rules' own.
    deepest = F.coalesce(stacks.agg(F.max(F.size(F.split("hostkey", r"\.")) - 1)).scalar(), F.lit(0))
    points = urls.withColumn("deepest", deepest).select("rid", "path", F.explode(host_keys(F.col("host"), F.col("deepest"))).alias("hostkey"))
    ruled = stacks.groupBy("hostkey").agg(F.count(F.lit(1)).alias("n_rules"))
    counts = points.groupBy("hostkey").agg(F.count(F.lit(1)).alias("n"))
    # A sweep has at least four times as many urls as rules, so copies of rules stay a part of the rows.
    sweeps = counts.join(ruled, "hostkey").select("hostkey", "n", F.ceil(F.col("n") / F.greatest(F.lit(sweep_rows), F.col("n_rules") * 4)).cast("int").alias("sweeps"))
    sweeps = write_through(sweeps, "url-sweeps")
    found = spread_join(points, sweeps, "hostkey", "n", F.coalesce(sweeps.agg(F.sum("n")).scalar(), F.lit(0)))
    dealt = found.select("hostkey", F.pmod(F.xxhash64("rid"), "sweeps").cast("int").alias("salt"), "path", "rid", F.lit(None).cast("array<struct<path:string,rule:string,verdict:string>>").alias("stack"))
    copies = stacks.join(sweeps, "hostkey").select("hostkey", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("salt"), "path", F.lit(None).cast("long").alias("rid"), "stack")
    sweep = Window.partitionBy("hostkey", "salt").orderBy("path", F.col("rid").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    fits = (
        copies.unionByName(dealt)
        .repartition("hostkey", "salt")
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .where("rid is not null")
        .select("rid", F.expr("try_element_at(filter(stack, r -> startswith(path, r.path)), -1)").alias("r"))
        .where("r is not null")
    )
    best = fits.groupBy("rid").agg(F.max(F.struct(F.length("r.rule").alias("n"), "r.rule", "r.verdict")).alias("r"))
    return urls.join(best.hint("merge"), "rid", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
