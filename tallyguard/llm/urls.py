"""URL filters: explicit rules first, then a tree of path templates for each host.

Below each host the segments of the paths form a tree. Level by level, segments that are
variable by their form (numbers, dates, hexadecimal ids) become a wildcard, and so do branches
with too few labelled pages to tell. The other branches of a node are merged where they are alike:
those with a like share of blocked pages, among the labelled ones, form a group, and a branch stays in its group unless
its share differs significantly from that of the group's others (a test of two proportions).
The purity of a template is the share of blocked pages among its labelled ones, smoothed towards
the purity of the template above it, the host towards the share of the whole table. Pages that no
rule speaks about are blocked where their template's purity reaches the threshold and the
template itself has labels enough: ``min_pages`` of them, or all its pages where it has fewer.
A purity that is only inherited blocks nothing.

With a label column, a null is a page without a label: it stays in the tree and is judged, but
counts neither as blocked nor as clean. Without one the rules label every page: it is blocked
where a rule blocks it, and clean where a rule allows it or none speaks about it. Paths are counted per
host and path before anything else, so repeated pages cost nothing; a busy host is many paths.
The first ``depth`` levels are always grown. Below them the tree goes on, to any depth, wherever
the labels of a template are not all alike; where they are (or where there are none), the rest of
the path cannot part them and is one wildcard tail. All steps are DataFrame operations.

A null url or one without ``://`` has an empty host and an empty path and is judged like any
other (its template is the empty host). Rows are kept one to one, repeated or not; columns of
``pages`` that bear the name of an added column are replaced; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage

DEPTH = 3  # levels grown in any case; deeper ones where labels are mixed
Z = 3.0  # standard errors by which a branch must differ from its group to leave it
SHARES = (1, 4, 7)  # eighths of blocked pages that part the groups
MIN_PAGES = 5  # fewer labelled pages never make a branch of their own
ALPHA = 10.0  # labelled pages that the template above counts for
THRESHOLD = 0.5
# Fixed value: forms of segments that vary from page to page.
VARIABLE = r"^([0-9]+([._-][0-9]+)*|[0-9a-f]{8,}|[0-9a-f-]{32,})(\.[a-z]{1,5})?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = "/"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith("." + self.host)
        return inside & path.startswith(self.path)


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """The name or verdict of the longest rule that fits, null without one."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        chosen = F.when(rule.fits(host, path), F.lit(getattr(rule, what))).otherwise(chosen)
    return chosen


def template_purity(
    paths: DataFrame, depth: int = DEPTH, z: float = Z, min_pages: int = MIN_PAGES, alpha: float = ALPHA
) -> DataFrame:
    """``paths(host, path, pages, n, blocked)``, one row per path, with ``template`` and ``purity``.

    ``n`` of the ``pages`` are labelled, ``blocked`` of those as blocked. ``supported`` tells
    whether the template has labels of its own to block on.
    """
    whole = paths.agg(F.sum("blocked").alias("b"), F.sum("n").alias("n")).first()
    prior = (whole["b"] or 0) / whole["n"] if whole["n"] else 0.0
    segments = F.filter(F.split("path", "/"), lambda s: s != "")

    def judged(rows: DataFrame, keys: list[str], above: Column) -> DataFrame:
        node = rows.groupBy(*keys).agg(
            F.sum("pages").alias("_pages"), F.sum("n").alias("_n"), F.sum("blocked").alias("_b")
        )
        return (
            rows.join(node, keys)
            .withColumn("purity", (F.col("_b") + alpha * above) / (F.col("_n") + alpha))
            .withColumn("supported", F.col("_n") >= F.least("_pages", F.lit(min_pages)))
            .withColumn("mixed", (F.col("_b") > 0) & (F.col("_b") < F.col("_n")))
            .drop("_pages", "_n", "_b")
        )

    rows = paths.withColumns({"segments": segments, "template": F.lit("")})
    rows = judged(rows, ["host"], F.lit(float(prior)))
    done, level = [], 0  # finished rows of the levels below ``depth``
    while True:
        if level >= depth:
            rows = stage(rows, f"urls-below-{level}")
            further = F.col("mixed") & (F.size("segments") > level)
            tail = F.when(F.size("segments") > level, F.concat("template", F.lit(LEVELS + "**")))
            done.append(
                rows.filter(~further).select(
                    "host", "path", F.coalesce(tail, "template").alias("template"), "purity", "supported"
                )
            )
            rows = rows.filter(further)
            if rows.isEmpty():
                return reduce(DataFrame.unionByName, done)
        segment = F.get("segments", level)
        named = F.when(segment.rlike(VARIABLE), "*").otherwise(segment)
        rows = stage(rows.withColumn("branch", named), f"urls-level-{level}")
        here = rows.filter("branch IS NOT NULL")
        branch = here.groupBy("host", "template", "branch").agg(
            F.sum("n").alias("n"), F.sum("blocked").alias("b")
        )
        n, b = F.col("n"), F.col("b")
        group = F.lit(0)
        for eighths in SHARES:
            group = group + (8 * b >= eighths * n).cast("int")
        literal = branch.filter((F.col("branch") != "*") & (n >= max(min_pages, 1))).withColumn("group", group)
        alike = literal.groupBy("host", "template", "group").agg(
            F.sum("n").alias("all_n"), F.sum("b").alias("all_b")
        )
        rest_n, rest_b = F.col("all_n") - n, F.col("all_b") - b
        pooled = F.col("all_b") / F.col("all_n")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest_n)))
        apart = F.abs(b / n - F.try_divide(rest_b, rest_n)) > z * error
        own = F.when(F.coalesce(apart, F.lit(False)), F.col("branch")).otherwise(
            F.concat(F.lit("*"), F.col("group").cast("string"))
        )
        kept = literal.join(alike, ["host", "template", "group"]).select(
            "host", "template", "branch", own.alias("own")
        )
        name = F.coalesce(F.col("own"), F.lit("*"))
        longer = F.when(F.col("branch").isNull(), F.col("template")).otherwise(
            F.concat("template", F.lit(LEVELS), name)
        )
        ended = F.col("branch").isNull()
        rows = rows.join(kept, ["host", "template", "branch"], "left").select(
            "host", "path", "pages", "n", "blocked", "segments", "purity", "supported", "mixed",
            longer.alias("template"), ended.alias("ended"),
        )
        deeper = judged(rows.filter("NOT ended").drop("supported", "mixed"), ["host", "template"], F.col("purity").cast("double"))
        rows = deeper.unionByName(rows.filter("ended")).drop("ended")
        level += 1


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    url: str = "url",
    blocked: str | None = None,
    threshold: float = THRESHOLD,
    **tree,
) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict (allow or block).

    ``blocked`` names a boolean column of labels (null: unlabelled); by default the rules'
    verdicts are the labels.
    """
    added = ("host", "path", "rule", "template", "purity", "verdict")
    host, path = parts(F.col(url))
    own = pages.withColumn("_label", F.col(blocked) if blocked else F.lit(None).cast("boolean"))
    split = own.withColumns({"_host": host, "_path": path})
    ruled = split.drop(*added).withColumnsRenamed({"_host": "host", "_path": "path"})
    ruled = ruled.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules, "name"))
    ruled = ruled.withColumn("_ruled", longest_rule(F.col("host"), F.col("path"), rules, "verdict"))
    label = F.col("_label") if blocked else F.coalesce(F.col("_ruled") == "block", F.lit(False))
    marked = ruled.withColumn("_block", label.cast("boolean").cast("bigint"))
    paths = marked.groupBy("host", "path").agg(
        F.count("*").alias("pages"),
        F.count("_block").alias("n"),
        F.coalesce(F.sum("_block"), F.lit(0)).alias("blocked"),
    )
    purity = stage(template_purity(stage(paths, "urls-paths"), **tree), "urls-purity")
    purity = purity.withColumnRenamed("supported", "_supported")
    full = F.col("_supported") & (F.col("purity") >= threshold)
    verdict = F.coalesce(F.col("_ruled"), F.when(full, "block").otherwise("allow"))
    return (
        marked.join(purity, ["host", "path"])
        .withColumn("verdict", verdict)
        .drop("_label", "_ruled", "_block", "_supported")
    )
