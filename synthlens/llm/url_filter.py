"""URL filter rules as a sort-merge range join (DataFrame functions only).

The canonical key of a host is its labels reversed, each ended by a dot
(``www.example.org`` is ``org.example.www.``). All subdomains of a rule's
host are then the interval of keys that start with the rule's key, and the
intervals of any two rules are nested or disjoint.

Steps:

1. hosts are aggregated first (one row per distinct host, so a hot host is
   one row in the sweep);
2. host rows and rule rows (an opening at the interval's start, a closing
   at its end) are dealt by the key's leading labels and a salt, and sorted
   by key; rules with fewer labels than the dealing depth are copied to the
   groups below them, rules inside a group to each of its salts;
3. a sorted sweep (window functions) keeps the stack of active rules: the
   nesting depth is the running sum of openings and closings, and level d
   of the stack is the last rule opened at depth d, valid while the depth
   is at least d;
4. the stack joins back to the pages on the host; among the rules of the
   stack whose path starts the page's path, the longest wins.

Cases: a null url or one without ``://`` has empty host and path and fits
no rule; a page that no rule fits gets the default verdict and a null rule;
repeated pages give repeated rows; a rule repeated with both verdicts
resolves to ``block``; an empty page or rule table works. Only the id and
url columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthlens.llm.common import ascii_lower_col

GROUP_LABELS = 3  # leading labels of the canonical key that deal out the sweep
SALTS = 16  # parts of one group


def split_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id_col, host, path). Host: after the first ``://`` up to ``/``, ``?``,
    ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end."""
    p = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    rest = F.coalesce(F.expr("CASE WHEN locate('://', _url) > 0 THEN substring(_url, locate('://', _url) + 3) END"),
                      F.lit(""))
    p = p.select(id_col, rest.alias("_rest"))
    return p.select(F.col(id_col), ascii_lower_col(F.regexp_extract("_rest", r"^([^/?#]*)", 1)).alias("host"),
                    F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def canonical_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _group(key: Column, n: int) -> Column:
    """The key's first ``n`` labels (the whole key if it has fewer)."""
    return F.concat(F.substring_index(F.expr("substring(_key, 1, length(_key) - 1)"), ".", n), F.lit("."))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack): for each distinct host the rules whose host covers it,
    outermost first. ``rules``: (host, path, verdict), hosts in lower case."""
    per_host = (rules.groupBy("host").agg(F.collect_set(F.struct("path", "verdict")).alias("_paths"))
                .select(F.col("host").alias("_rule_host"), canonical_key(F.col("host")).alias("_key"), "_paths"))
    per_host = per_host.withColumn("_labels", F.size(F.split("_key", r"\.")) - 1)
    h = hosts.select("host", canonical_key(F.col("host")).alias("_key")).withColumn(
        "_group", _group(F.col("_key"), GROUP_LABELS))
    h = h.withColumn("_salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int"))
    # the group keys that hold hosts, and the leading labels by which shorter rules cover them
    parts = h.select("_group", "_salt").distinct()
    level = F.size(F.split("_group", r"\.")) - 1
    prefixes = parts.select("_group", "_salt", F.explode(F.sequence(F.lit(1), F.least(level, F.lit(GROUP_LABELS))))
                            .alias("_n"))
    prefixes = prefixes.select("_group", "_salt", F.concat(F.expr("substring_index(_group, '.', _n)"), F.lit("."))
                               .alias("_cover")).distinct()
    dealt = per_host.withColumn("_cover", _group(F.col("_key"), GROUP_LABELS)).join(prefixes, "_cover")
    # a rule at or inside a group belongs there; one with fewer labels covers every group below it
    dealt = dealt.where((F.col("_labels") < GROUP_LABELS) | (F.col("_cover") == F.col("_group")))
    opened = dealt.select("_group", "_salt", "_key", F.lit(0).alias("_kind"), F.lit(1).alias("_turn"),
                          F.struct("_rule_host", "_paths").alias("_rule"), F.lit(None).cast("string").alias("host"))
    end = F.expr("concat(substring(_key, 1, length(_key) - 1), '/')")  # '/' follows '.'
    closed = dealt.select("_group", "_salt", end.alias("_key"), F.lit(-1).alias("_kind"), F.lit(-1).alias("_turn"),
                          F.lit(None).cast(opened.schema["_rule"].dataType).alias("_rule"),
                          F.lit(None).cast("string").alias("host"))
    seen = h.select("_group", "_salt", "_key", F.lit(1).alias("_kind"), F.lit(0).alias("_turn"),
                    F.lit(None).cast(opened.schema["_rule"].dataType).alias("_rule"), "host")
    events = opened.unionByName(closed).unionByName(seen)
    sweep = (Window.partitionBy("_group", "_salt").orderBy("_key", "_kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = events.withColumn("_depth", F.sum("_turn").over(sweep))
    most = rules.select(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 1
    levels = [F.last(F.when((F.col("_turn") == 1) & (F.col("_depth") == d), F.col("_rule")), ignorenulls=True)
              .over(sweep) for d in range(1, most + 1)]
    swept = swept.select("host", "_turn", "_depth", *[c.alias(f"_at{d}") for d, c in enumerate(levels, 1)])
    stack = F.slice(F.array(*[f"_at{d}" for d in range(1, most + 1)]), F.lit(1), F.greatest(F.col("_depth").cast("int"),
                                                                                       F.lit(0)))
    return swept.where(F.col("_turn") == 0).select("host", stack.alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default_verdict: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict). ``rules``: (host, path, verdict);
    a rule fits its host and all subdomains if the page's path starts with
    the rule's path; the longest rule (host and path together) wins."""
    p = split_urls(pages, id_col, url_col)
    stacks = active_rules(p.where(F.col("host") != "").select("host").distinct(), rules)
    joined = p.join(stacks, "host", "left")
    flat = F.flatten(F.transform("stack", lambda r: F.transform(
        r["_paths"], lambda q: F.struct((F.length(r["_rule_host"]) + F.length(q["path"])).alias("n"),
                                        F.length(r["_rule_host"]).alias("host_n"), q["verdict"].alias("verdict"),
                                        q["path"].alias("path"),
                                        F.concat(r["_rule_host"], q["path"]).alias("rule")))))
    fit = F.array_max(F.filter(flat, lambda r: F.col("path").startswith(r["path"])))
    out = joined.withColumn("_best", fit)
    return out.select(id_col, "host", "path", F.col("_best")["rule"].alias("rule"),
                      F.coalesce(F.col("_best")["verdict"], F.lit(default_verdict)).alias("verdict"))
