"""URL filters: explicit rules, and below them a tree of path templates for each host.

Variable segments become wildcards, branches that cannot be told apart by their children and labels are merged,
and a template is rejected when the smoothed share of its labelled urls that are blocked is high. The labels are
the urls that the rules themselves judge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from luminal.llm.common import cut

FANOUT = 20  # a node with so many branches has a variable segment; its rare branches become one wildcard
CHI2, Z = 5.99, 1.96  # what counts as a difference, at 5 %
ALPHA = 4.0  # labelled urls that the prior is worth; an unlabelled url adds half a one
REJECT = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """urls (_id, _host, _path) with _rule and _said, what the longest rule that fits says. Rules meet hosts by an
    equi-join on the hosts' last labels, as many as the longest rule's host has, so there may be thousands of rules;
    each distinct host is looked up once."""
    table = urls.sparkSession.createDataFrame(
        [(r.host, -len(r.name), i, r.path, r.name, r.verdict) for i, r in enumerate(rules)], "_suffix string, longest int, place int, path string, name string, verdict string"
    )
    labels = F.split("_host", r"\.")
    most = max((r.host.count(".") + 1 for r in rules), default=1)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    hosts = urls.select("_host").distinct().select("_host", F.explode(ends).alias("_suffix"))
    fits = hosts.join(table, "_suffix").groupBy("_host").agg(F.array_sort(F.collect_list(F.struct("longest", "place", "path", "name", "verdict"))).alias("_fits"))
    hit = F.get(F.filter("_fits", lambda r: F.startswith(F.col("_path"), r["path"])), F.lit(0))
    return urls.join(fits, "_host", "left").withColumn("_hit", hit).select("_id", "_host", "_path", F.col("_hit.name").alias("_rule"), F.col("_hit.verdict").alias("_said"))


def _variable(seg: Column) -> Column:
    return seg.contains("#") | (seg == "**")


def templates(urls: DataFrame) -> DataFrame:
    """urls (_host, _path, _label: 1 blocked, 0 allowed, null unknown) to (_host, _shape, template, purity): a row
    for each shape of path, digits runs being one. The tree is as deep as the deepest path; a round works out a level at
    which the paths of a node branch, wherever it lies, and what all of them have in common is passed at once, so that a
    chain of any length costs no round. All counts are of all urls, summed before they are shuffled."""
    shapes = urls.groupBy("_host", F.regexp_replace("_path", "[0-9]+", "#").alias("_shape")).agg(
        F.count("*").alias("n"), F.count("_label").alias("seen"), F.coalesce(F.sum("_label"), F.lit(0)).alias("bad")
    )
    parts = F.slice(F.split("_shape", "/"), 2, 1 << 20)
    now = cut(shapes.withColumns({"segs": parts, "node": F.lit(""), "at": F.lit(0)}), "url-shapes")
    sums = [F.sum(c).alias(c) for c in ("n", "seen", "bad")]
    total = now.agg(*sums).first()
    prior = (total["bad"] or 0) / total["seen"] if total["seen"] else 0.0
    end = F.lit("\0")
    plain = lambda seg: F.when(_variable(seg), F.lit("/*")).when(seg == "", F.lit("/")).otherwise(F.concat(F.lit("/"), seg))
    done = []  # shapes that have ended: no other shape's node is theirs
    for level in count():
        # what all shapes of a node have in common is what its first and its last have; there a node has one branch
        rest = F.slice("segs", F.col("at") + 1, F.greatest(F.lit(0), F.size("segs") - F.col("at")))
        now = now.withColumn("rest", rest)
        ways = now.groupBy("_host", "node", "at").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        differs = F.array_position(F.zip_with("low", "high", lambda a, b: ~a.eqNullSafe(b)), True)
        ways = ways.select("_host", "node", "at", F.when(differs == 0, F.size("low")).otherwise(differs - 1).cast("int").alias("shared"))
        now = now.join(ways, ["_host", "node", "at"])
        passed = F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("shared")), plain), "")
        now = cut(now.select("_host", "_shape", "segs", F.concat("node", passed).alias("node"), (F.col("at") + F.col("shared")).alias("at"), "n", "seen", "bad", (F.col("shared") == F.size("rest")).alias("ended")), f"url-level{level}")
        # where some shape of a node ends and others go on, its end is a branch like theirs
        others = now.groupBy("_host", "node", "at").agg(F.bool_or(~F.col("ended")).alias("more"))
        now = now.join(others, ["_host", "node", "at"])
        done.append(now.filter("not more").select("_host", "_shape", "node", "n", "seen", "bad"))
        now = now.filter("more").drop("more", "ended")
        if now.isEmpty():
            break
        seg, below = F.coalesce(F.get("segs", F.col("at")), end), F.get("segs", F.col("at") + 1)
        now = now.withColumn("seg", seg)
        branches = now.groupBy("_host", "node", "seg").agg(
            *sums, F.sum(F.when(below.isNull(), F.col("n")).otherwise(0)).alias("last"), F.sum(F.when(below.contains("#"), F.col("n")).otherwise(0)).alias("numbered")
        )
        nodes = branches.groupBy("_host", "node").agg(F.count("*").alias("kinds"), *[F.sum(c).alias("all_" + c) for c in ("n", "bad", "last", "numbered")])
        both = branches.join(nodes, ["_host", "node"])
        n, every = F.col("n"), F.col("all_n")
        # chi-square of what stands below the branch against what stands below all its siblings
        chi2 = F.lit(0.0)
        for own, pooled in ((F.col("last"), F.col("all_last")), (F.col("numbered"), F.col("all_numbered")), (n - F.col("last") - F.col("numbered"), every - F.col("all_last") - F.col("all_numbered"))):
            due = n * pooled / every
            chi2 = chi2 + F.when(due > 0, (own - due) * (own - due) / due).otherwise(0.0)
        p = F.col("all_bad") / every
        spread = F.sqrt(p * (1 - p) * (1 / n + 1 / every))
        apart = F.when(spread > 0, F.abs(F.col("bad") / n - p) / spread).otherwise(0.0)
        rare = (F.col("kinds") >= FANOUT) & (n * FANOUT < every)
        alike = (F.col("kinds") > 1) & (chi2 < CHI2) & (apart < Z)
        token = F.when(F.col("seg") == end, F.lit("")).when(_variable(F.col("seg")) | rare | alike, F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("seg")))
        token = F.when((F.col("seg") != end) & (F.col("seg") == ""), F.lit("/")).otherwise(token)
        chosen = both.select("_host", "node", "seg", token.alias("token"))
        now = cut(now.join(chosen, ["_host", "node", "seg"]).withColumn("node", F.concat("node", "token")).drop("token", "rest", "shared"), f"url-branch{level}")
        done.append(now.filter(F.col("seg") == end).select("_host", "_shape", "node", "n", "seen", "bad"))
        now = now.filter(F.col("seg") != end).select("_host", "_shape", "segs", "node", (F.col("at") + 1).alias("at"), "n", "seen", "bad")
    now = cut(reduce(DataFrame.unionByName, done), "url-templates")
    weight = ALPHA + (F.col("n") - F.col("seen")) / 2
    purity = (F.col("bad") + F.lit(prior) * weight) / (F.col("seen") + weight)
    judged = now.groupBy("_host", "node").agg(*sums).select("_host", "node", purity.alias("purity"))
    return now.select("_host", "_shape", "node").join(judged, ["_host", "node"]).select("_host", "_shape", F.concat("_host", "node").alias("template"), "purity")


def judge(df: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of df: id_col, host, path, rule, verdict (allow or block), template, purity.

    The longest rule that fits a url decides (of equally long ones the first listed); other urls are blocked if their
    template is rejected. A url that is null or has no :// has empty host and path, fits no rule and is allowed unless
    its template, the empty one, is rejected. Repeated rows are judged alike; an empty table gives an empty result."""
    urls = df.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    urls = cut(_ruled(urls, rules), "urls")
    label = F.when(F.col("_said") == "block", 1).when(F.col("_said") == "allow", 0)
    tree = templates(urls.withColumn("_label", label))
    out = urls.withColumn("_shape", F.regexp_replace("_path", "[0-9]+", "#")).join(tree, ["_host", "_shape"])
    return out.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity",
    )
