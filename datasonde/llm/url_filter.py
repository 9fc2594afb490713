"""Judge URLs by host rules and by a path-template tree, with DataFrame functions only.

Rules (host, path) are applied first; the longest that fits wins. What the rules say of the
URLs they fit are the labels from which templates are judged:

1. Paths are split in segments. A segment with a digit is variable and becomes ``*`` (with its
   file extension). URLs are folded to distinct (host, template) rows at once, combined before
   the shuffle, so a host with a third of all URLs is as small as any other afterwards.
2. These templates are the leaves of a tree per host: a branch is a segment below its parent,
   the path before it. Where a parent has more than ``MANY`` different literal branches, its
   branches are variable: those without a label become ``**``. Nothing is wildcarded for being
   rare.
3. Literal branches of one parent that have labels are merged if their blocked shares are
   statistically alike: they fall in one of 21 classes of the share, and each agrees with the
   pooled share of its class (a z test). They become ``+`` and the class. Branches without
   labels are never merged with labelled ones, and mixed ones (between 5 and 95 %), whose
   verdict hangs on what lies below them, are left to their own branches.
4. A template's purity is its smoothed blocked share, (blocked + strength * prior) /
   (labelled + strength). At ``threshold`` or more it is blocked, so a template without labels,
   whose share is the prior, is allowed.

A missing URL, or one without ``://``, has an empty host and path. Repeated rows are judged
alike, whatever their ids; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datasonde.functions.shared import stored
from datasonde.llm.columns import ascii_lower, packed

# (verdict, host, path): a rule fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

MANY = 50
CLASSES = 20
MIXED = (1, 18)
Z = 1.96
PRIOR = 0.3
STRENGTH = 5.0
THRESHOLD = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a URL; both empty if it is missing or has no ``://``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host + path, and its verdict; null where none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def fits(rule) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    def chain(value) -> Column:
        none = F.lit(None).cast("string")
        return reduce(lambda other, r: F.when(fits(r), F.lit(value(r))).otherwise(other), reversed(longest), none)

    return chain(lambda r: r[1] + r[2]), chain(lambda r: r[0])


def lexical_template(path: Column) -> Column:
    """The path with ``*`` for each segment that has a digit; its file extension stays."""
    return F.regexp_replace(path, r"[^/]*[0-9][^/]*?(\.[A-Za-z]+)?(?=/|$)", "*$1")


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, lexical, template, labelled, blocked, purity) from (host, lexical, verdict) rows."""
    leaves = stored(
        urls.groupBy("host", "lexical").agg(
            F.count("verdict").alias("labelled"),
            F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"),
        )
    )
    # A branch's parent is the path before it, told by its digest, as paths may be long.
    branch = "transform(split(lexical, '/'), (s, i) -> struct(md5(array_join(slice(split(lexical, '/'), 1, i), '/')) as parent, s as segment))"
    segments = leaves.select("host", "lexical", "labelled", "blocked", F.posexplode(F.expr(branch)).alias("depth", "branch"))
    segments = segments.select("host", "lexical", "labelled", "blocked", "depth", "branch.parent", "branch.segment")
    of = ["host", "parent"]
    branches = segments.groupBy(*of, "segment").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    literal = (F.col("segment") != "") & ~F.col("segment").startswith("*")
    siblings = branches.filter(literal).groupBy(*of).agg(F.count(F.lit(1)).alias("siblings"))

    classed = branches.filter(literal & (F.col("labelled") > 0)).withColumn("class", F.expr(f"blocked * {CLASSES} div labelled"))
    pool = classed.groupBy(*of, "class").agg((F.sum("blocked") / F.sum("labelled")).alias("pool"))
    spread = F.sqrt(F.col("labelled") * F.col("pool") * (1 - F.col("pool")))
    alike = F.abs(F.col("blocked") - F.col("labelled") * F.col("pool")) <= Z * spread + 0.5
    pure = (F.col("class") < MIXED[0]) | (F.col("class") > MIXED[1])
    similar = classed.join(pool, [*of, "class"]).filter(pure & alike)
    several = similar.groupBy(*of, "class").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    merged = similar.join(several, [*of, "class"], "left_semi").select(*of, "segment", "class")
    variable = literal & (F.col("labelled") == 0) & (F.col("siblings") > MANY)
    named = branches.join(siblings, of, "left").join(merged, [*of, "segment"], "left")
    name = F.when(F.col("class").isNotNull(), F.concat(F.lit("+"), F.col("class").cast("string"))).when(variable, "**").otherwise(F.col("segment"))
    named = named.select(*of, "segment", name.alias("name"))

    paths = (
        segments.join(named, [*of, "segment"])
        .groupBy("host", "lexical", "labelled", "blocked")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("names"))
        .select("host", "lexical", "labelled", "blocked", F.array_join(F.col("names").getField("name"), "/").alias("template"))
    )
    judged = paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    judged = judged.withColumn("purity", (F.col("blocked") + STRENGTH * PRIOR) / (F.col("labelled") + STRENGTH))
    return paths.select("host", "lexical", "template").join(judged, ["host", "template"])


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` as a struct ``row`` with host, path, rule, verdict, template and purity."""
    rows = packed(pages, url=F.col(f"`{url}`"))
    host, path = url_parts(F.col("url"))
    rows = rows.select("row", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"), lexical_template(F.col("path")).alias("lexical"))
    # Stored, the templates have a known size, and are broadcast only if that is below Spark's threshold.
    tree = stored(template_tree(rows.select("host", "lexical", F.col("ruled").alias("verdict"))))
    judged = rows.join(tree.select("host", "lexical", "template", "purity"), ["host", "lexical"], "left")
    by_template = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return judged.select("row", "host", "path", "rule", F.coalesce("ruled", by_template).alias("verdict"), "template", "purity")
