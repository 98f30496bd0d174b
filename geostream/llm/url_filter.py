"""URL filter by a tree of path templates for each host; DataFrame functions only.

Rules label the pages that they fit, as blocked or allowed. Path segments that vary (digits, or many values with few pages
each) become wildcards; sibling branches of the tree whose labelled purity doesn't differ significantly from that of the
rest of their parent are merged; a template's purity is the blocked share of its labelled pages, smoothed towards a part of
its parent's, from the host down; templates from a threshold on are rejected. With a threshold of at least that part, no
template is rejected without a labelled page of its own branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import fold_ascii, quoted, stage

#: (host and path prefix, verdict); a rule holds for its host and all subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with host (A-Z lower-cased) and path; both empty if the url is null or has no ://."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return pages.withColumn("host", fold_ascii(host)).withColumn("path", path)


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """pages with the longest rule that fits, or null, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        own, _, rest = text.partition("/")
        fits = ((F.col("host") == own) | F.endswith(F.col("host"), F.lit("." + own))) & F.startswith(F.col("path"), F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


#: Segments that vary by their form: numbers, also with a file type, and long hexadecimal names.
NUMBER = r"^[0-9]+(\.[A-Za-z0-9]+)?$"
HEXADECIMAL = r"^[0-9a-f-]{16,}$"


def templates(paths: DataFrame, least_pages: int, few: int) -> DataFrame:
    """(host, path, template) of rows (host, path, n), host not empty.

    A segment that doesn't vary by its form stays as it is if at least least_pages pages of its host have it at its depth,
    or if the host has at most few different ones there; else it is a wildcard. All segments count, at one go; a slash at
    the end doesn't.
    """
    parts = paths.select("host", "path", "n", F.posexplode(F.slice(F.split(F.regexp_replace("path", "/$", ""), "/"), 2, F.length("path") + 1)).alias("level", "part"))
    varies = F.regexp_like("part", F.lit(NUMBER)) | F.regexp_like("part", F.lit(HEXADECIMAL))
    seen = parts.filter(~varies).groupBy("host", "level", "part").agg(F.sum("n").alias("pages"))
    kinds = seen.groupBy("host", "level").agg(F.count("*").alias("kinds"))
    kept = seen.join(kinds, ["host", "level"]).filter((F.col("pages") >= least_pages) | (F.col("kinds") <= few)).select("host", "level", "part", F.lit(True).alias("stays"))
    steps = parts.join(kept, ["host", "level", "part"], "left").withColumn("step", F.when(F.col("stays"), F.col("part")).otherwise(F.lit("*")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("level", "step"))), lambda x: x["step"])
    found = steps.groupBy("host", "path").agg(F.concat(F.lit("/"), F.array_join(ordered, "/")).alias("template"))
    return found.unionByName(paths.filter("path in ('', '/')").select("host", "path", F.lit("").alias("template")))


def _prefixes(template: Column) -> Column:
    """(depth, node) of a template and all that it begins with, from the host's root, which is '' at depth 0."""
    steps = F.split(template, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct((i - 1).alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("node")))


def template_purity(counts: DataFrame, prior_pages: float, trust: float, z: float) -> DataFrame:
    """(host, template, purity) from rows (host, template, labelled, blocked).

    A branch whose blocked share a two-proportion test at z can't tell from that of the rest of its parent's labelled pages
    shares its counts with the other such branches of that parent. purity = (blocked + prior_pages * trust * purity of the
    parent) / (labelled + prior_pages), beginning above the hosts with the share of all labelled pages; without labels it is
    trust times the parent's. Every step is an aggregate by node, so that a large host is no task of its own.
    """
    nodes = counts.select("host", "template", "labelled", "blocked", F.explode(_prefixes(F.col("template"))).alias("x")).select("host", "template", "labelled", "blocked", "x.depth", "x.node")
    own = nodes.groupBy("host", "depth", "node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    own = stage(own.withColumn("parent", F.when(F.col("depth") > 0, F.regexp_replace("node", "/[^/]*$", ""))), "url-nodes")
    of_parent = own.select("host", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("labelled").alias("all_labelled"), F.col("blocked").alias("all_blocked"))
    both = own.join(of_parent, ["host", "depth", "parent"], "left")
    rest_labelled, rest_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
    pooled = F.col("all_blocked") / F.col("all_labelled")
    gap = F.abs(F.col("blocked") / F.col("labelled") - rest_blocked / rest_labelled)
    differs = (F.col("labelled") > 0) & (rest_labelled > 0) & (gap > z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest_labelled)) + 1e-12)
    both = stage(both.withColumn("branch", F.when(F.col("depth") == 0, F.lit("")).when(F.coalesce(differs, F.lit(False)), F.col("node")).otherwise(F.lit("*"))), "url-nodes")
    merged = both.groupBy("host", "depth", "parent", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("host", "depth", "parent", "branch")]
    placed = both.alias("a").join(merged.alias("m"), key[0] & key[1] & key[2] & key[3]).select("a.host", "a.depth", "a.node", "m.labelled", "m.blocked")
    whole = counts.agg(((F.sum("blocked") + 0.5) / (F.sum("labelled") + 1)).alias("all"))
    line = nodes.select("host", "template", "depth", "node").join(placed, ["host", "depth", "node"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "labelled", "blocked"))).alias("line"))
    start = F.coalesce("all", F.lit(0.5)).cast("double")
    down = F.aggregate("line", start, lambda p, x: (x["blocked"] + prior_pages * trust * p) / (x["labelled"] + prior_pages))
    return line.crossJoin(F.broadcast(whole)).select("host", "template", down.alias("purity"))  # one row


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least_pages: int = 5, few: int = 3, threshold: float = 0.75, prior_pages: float = 2.0, trust: float = 0.75, z: float = 1.96) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict (allow or block) of every row.

    The longest rule that fits decides; else the page's template does, blocked if its purity reaches the threshold. Pages
    with an empty host and no rule have no template and are allowed. Repeated rows get the same verdict; paths of any length
    and depth count whole; no rows: no rows; other columns pass through (those with one of the added names are replaced).
    """
    pages = pages.drop("host", "path", "rule", "template", "purity", "verdict", "ruled")
    ruled = with_rule(with_parts(pages), rules)
    # Everything below works on distinct (host, path) with counts, partially aggregated before any shuffle.
    known = ruled.filter("host != ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    known = stage(known, "url-paths")
    placed = stage(templates(known, least_pages, few).join(known, ["host", "path"]), "url-templates")
    purity = template_purity(placed.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), prior_pages, trust, z)
    # One row for each template, of known size: broadcast if small, else the join splits a template with many paths.
    of_path = placed.select("host", "path", "template").join(stage(purity, "url-purity"), ["host", "template"]).select("host", "path", "template", "purity")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    judged = ruled.filter("host != ''").join(of_path, ["host", "path"], "left")
    lone = ruled.filter("host = ''").withColumns({"template": F.lit(None).cast("string"), "purity": F.lit(None).cast("double")})
    return judged.select(*quoted(lone.columns)).unionByName(lone).withColumn("verdict", verdict).drop("ruled")
