"""URL verdicts from listed rules and, where none fits, from a tree of path templates per host.

The tree grows level by level: a path segment that stays rare among the children of its
branch is variable and becomes a wildcard; frequent ones stay. Each template then counts
its labelled URLs. Sibling branches, which differ in one literal segment, are merged from
the leaves up where their share of bad URLs does not differ significantly from that of all
of them together; siblings without labels join such a branch. A branch is rejected, with
all its templates, if its labelled share of bad URLs, smoothed towards those of its
siblings, its host and all hosts, is at least PURITY.

Only counts per host, template and segment are shuffled, after partial counts; joins back
to the URLs are salted, so one host may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginloom.llm.common import salted_left_join, stored

# (verdict, host, path prefix); a rule is written host + path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LITERAL_ROWS = 8
LITERAL_SHARE = 0.02
WILDCARD = "*"
MERGED = "?"  # merged literals beside a wildcard that differs from them; no path has this character
PRIOR_URLS = 10.0
PURITY = 0.8
SIMILAR_Z = 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or a URL without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written out, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, domain + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def templates(urls: DataFrame) -> DataFrame:
    """Add ``template`` to rows with host and path: the path with variable segments as wildcards."""
    whole = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = urls.withColumn("segments", whole)
    rows = stored(rows.withColumn("template", F.lit("")).withColumn("url_salt", F.xxhash64("path")), "url-segments")
    # deeper branches have fewer than LITERAL_ROWS rows, hence wildcards only
    deepest = [r.depth for r in rows.select(F.size("segments").alias("depth")).orderBy(F.desc("depth")).limit(LITERAL_ROWS).collect()]
    depth = deepest[-1] if len(deepest) == LITERAL_ROWS else 0
    for level in range(depth):
        own = F.get("segments", F.lit(level))
        node = F.concat_ws("\n", "host", "template")
        there = rows.filter(F.size("segments") > level).select(node.alias("node"), own.alias("segment"))
        children = there.groupBy("node", "segment").agg(F.count("*").alias("rows")).filter(F.col("rows") >= LITERAL_ROWS)
        totals = there.groupBy("node").agg(F.count("*").alias("total"))
        frequent = children.join(totals, "node").filter(F.col("rows") >= LITERAL_SHARE * F.col("total"))
        # at most 1 / LITERAL_SHARE segments per node
        literals = frequent.groupBy("node").agg(F.collect_set("segment").alias("literals"))
        joined = salted_left_join(rows.withColumn("node", node), literals, "node", F.col("url_salt"))
        kept = F.coalesce(F.array_contains("literals", own), F.lit(False))
        step = F.concat("template", F.lit("/"), F.when(kept, own).otherwise(WILDCARD))
        rows = joined.withColumn("template", F.when(own.isNotNull(), step).otherwise(F.col("template"))).drop("node", "literals")
        rows = stored(rows, "url-templates")
    rest = F.repeat(F.lit(f"/{WILDCARD}"), F.greatest(F.size("segments") - depth, F.lit(0)))
    return rows.withColumn("template", F.concat("template", rest)).drop("segments", "url_salt")


def _merged(counts: DataFrame, unlabelled: bool = False) -> DataFrame:
    """Templates of a host that differ in one literal segment only, merged where their labels are alike.

    Works through the positions from the last to the first; at each, branches that agree in
    all other segments are siblings (at most 1 / LITERAL_SHARE and the wildcard). Two or
    more labelled ones that are alike become one branch, and siblings without labels join
    it unless a labelled one differs. Gives host, template and ``branch``, the merged
    template, for templates with labels or, with ``unlabelled``, for all.
    """
    literal = F.regexp_replace("template", r"(?:/\*)++$", "")
    depth = counts.select(F.max(F.size(F.split(literal, "/", -1)))).first()[0] or 0
    rows = counts.select("host", "template", "bad", "labelled", F.col("template").alias("branch"))
    siblings = Window.partitionBy("host", "siblings")
    for place in range(depth - 1, 0, -1):
        parts = F.split("branch", "/", -1)

        def at_place(segment: str, place: int = place, parts: Column = parts) -> Column:
            return F.array_join(F.transform(parts, lambda s, i: F.when(i == place, segment).otherwise(s)), "/")

        branches = rows.groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
        branches = branches.filter(F.size(parts) > place).withColumn("siblings", at_place(WILDCARD))
        known = F.col("labelled") > 0
        share = F.try_divide(F.sum("bad").over(siblings), F.sum("labelled").over(siblings))
        spread = F.sqrt(F.try_divide(F.col("share") * (1 - F.col("share")), F.col("labelled")))
        alike = known & (F.abs(F.try_divide("bad", "labelled") - F.col("share")) <= SIMILAR_Z * spread + 1e-12)
        judged = branches.withColumn("share", share).withColumn("alike", F.coalesce(alike, F.lit(False)))
        judged = judged.withColumn("n_alike", F.sum(F.col("alike").cast("int")).over(siblings))
        judged = judged.withColumn("n_known", F.sum(known.cast("int")).over(siblings))
        joins = (F.col("n_alike") >= 2) & (F.col("alike") | (~known & (F.col("n_alike") == F.col("n_known"))))
        judged = judged.withColumn("joins", joins)
        apart = F.max((F.col("branch") == F.col("siblings")) & ~F.col("joins")).over(siblings)
        target = F.when(F.col("apart"), at_place(MERGED)).otherwise(F.col("siblings"))
        moves = judged.withColumn("apart", apart).filter("joins").select(F.concat_ws("\n", "host", "branch").alias("node"), target.alias("target"))
        moved = salted_left_join(rows.withColumn("node", F.concat_ws("\n", "host", "branch")), moves, "node", F.col("template"))
        rows = stored(moved.withColumn("branch", F.coalesce("target", "branch")).drop("node", "target"), "template-branches")
    return (rows if unlabelled else rows.filter("labelled > 0")).select("host", "template", "branch")


def _others(branches: DataFrame, group: str) -> DataFrame:
    """Add ``{group}_bad`` and ``{group}_labelled``: the labels of the other branches of the host with the same ``group``.

    Both are 0 where fewer than two others have labels: one branch speaks for no other.
    """
    known = (F.col("labelled") > 0).cast("int")
    sums = branches.groupBy(group).agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"), F.sum(known).alias("all_known"))
    joined = salted_left_join(branches, sums, group, F.col("branch"))
    many = F.col("all_known") - known >= 2
    for name in ("bad", "labelled"):
        joined = joined.withColumn(f"{group}_{name}", F.when(many, F.col(f"all_{name}") - F.col(name)).otherwise(0))
    return joined.drop("all_bad", "all_labelled", "all_known")


def rejected_templates(urls: DataFrame) -> DataFrame:
    """host and template of the rejected ones; ``urls`` has host, template and bad (boolean, null if unlabelled).

    A branch's share of bad URLs is smoothed towards that of its siblings, theirs towards
    that of the rest of the host, and this towards the overall share. It holds for all
    templates of the branch. Without any label on the host nothing is rejected.
    """
    bad = F.col("bad").cast("int")
    counts = stored(urls.groupBy("host", "template").agg(F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad")), "template-labels")
    overall = counts.agg(F.try_divide(F.sum("bad"), F.sum("labelled"))).first()[0] or 0.0
    merged = _merged(counts.filter("host <> ''"), unlabelled=True)
    branches = counts.join(merged, ["host", "template"]).groupBy("host", "branch").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    # the last literal segment tells siblings apart
    parent = F.regexp_replace("branch", r"/(?![*?](?:/|$))[^/]+((?:/[*?])*+)$", "/*$1")
    held = _others(_others(branches.withColumn("parent", F.concat_ws("\n", "host", parent)), "parent"), "host")
    purity, evidence = F.lit(overall), F.lit(0)
    for level in ("host_", "parent_", ""):
        labelled = F.col(f"{level}labelled")
        purity, evidence = (F.col(f"{level}bad") + PRIOR_URLS * purity) / (labelled + PRIOR_URLS), evidence + labelled
    impure = held.filter((evidence > 0) & (purity >= PURITY)).select(F.concat_ws("\n", "host", "branch").alias("node"), F.lit(True).alias("impure"))
    named = merged.withColumn("node", F.concat_ws("\n", "host", "branch"))
    return salted_left_join(named, impure, "node", F.col("template")).filter("impure").select("host", "template")


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and template.

    A URL gets the verdict of the longest rule that fits its host, or a domain above it,
    and the start of its path. Any other is blocked if its host's template is rejected.
    Labelled URLs are those that a rule judges, unless ``labels`` (page_id, bad) are given.
    A null URL or one without ``://`` has an empty host and path and is allowed. Rows are
    judged each, repeated ones and ones without an id too; an empty table gives no rows.
    Other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    if labels is None:
        rows = rows.withColumn("bad", F.col("says") == "block")
    else:
        given = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
        rows = rows.join(given, "page_id", "left")
    rows = templates(rows)
    out = rejected_templates(rows).select(F.concat_ws("\n", "host", "template").alias("node"), F.lit(True).alias("rejected"))
    joined = salted_left_join(rows.withColumn("node", F.concat_ws("\n", "host", "template")), out, "node", F.col("path"))
    by_template = F.when(F.col("rejected"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("says", by_template).alias("verdict"), "template")
