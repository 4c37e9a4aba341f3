"""URL filter: rules first, then a path-template tree per host.

Segments that vary (numbers, identifiers, rare words without labels) become wildcards. Going down from each
host, sibling branches whose share of labelled rejections does not differ significantly from
their pooled share are merged into one branch; those clearly above and clearly below it are
merged among themselves. The tree goes on until every branch holds one shape. The labelled pages
are those that a rule decides, or a given column.

Purity is smoothed down the tree: a branch's share of rejections among its labelled pages is drawn
towards that of its parent, and a branch without labels takes its parent's. A host starts at its
share of rejections among all its pages: pages without a label are not known to be bad, so a few
rejected pages do not condemn the rest of a host.

All counts are aggregated by Spark on (host, shape), before any join, so that a host with very
many pages is only as many rows as it has shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.llm.common import ascii_lower, cut

#: (verdict, host, path): the longest rule that fits a URL decides it.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules are part of the expression; beyond so many they belong in a joined table.
MOST_RULES = 10_000
#: A word segment without a labelled page stays a branch of its own from so many pages on.
LEAST_PAGES = 3
#: Standard errors that make two shares differ.
APART = 2.0
#: Weight of the parent's share, and share of rejections from which a template is rejected.
PRIOR_WEIGHT, REJECT = 2.0, 0.5


def parse_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for null and where ``://`` is missing."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, u.substr(F.instr(u, "://") + 3, F.length(u))).otherwise("")
    df = df.withColumn("__rest", rest)
    raw = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    tail = F.col("__rest").substr(F.length(raw) + 1, F.length("__rest"))
    return (
        df.withColumn("host", ascii_lower(raw))
        .withColumn("path", F.regexp_extract(tail, r"^[^?#]*", 0))
        .drop("__rest")
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path``, and its verdict; null where none fits.

    Of rules of one length the one with the longer host wins, then an earlier one.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    rule = verdict = F.lit(None).cast("string")
    for decision, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All path segments, with numbers and identifiers generalised."""

    def general(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "<n>")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.regexp_replace(s, r"^[0-9]+", "<n>"))
            .when(s.rlike(r"^[0-9A-Fa-f-]{8,}$") & s.rlike("[0-9]"), "<id>")
            .when(s.rlike(r"[0-9]{3,}"), "<id>")
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def named_branches(at: DataFrame) -> DataFrame:
    """host, prefix, seg and ``branch``, the name under which the segment goes on."""
    branches = at.groupBy("host", "prefix", "seg").agg(
        F.sum("n").alias("cn"), F.sum("m").alias("cm"), F.sum("b").alias("cb")
    )
    parents = branches.groupBy("host", "prefix").agg(F.sum("cm").alias("pm"), F.sum("cb").alias("pb"))
    share = F.col("pb") / F.greatest("pm", F.lit(1))
    own = F.col("cb") / F.greatest("cm", F.lit(1))
    spread = APART * F.sqrt((share * (1 - share) + 1e-9) / F.greatest("cm", F.lit(1)))
    wild = F.col("seg").startswith("<")
    # labelled segments are merged by the test only, however few pages they have
    rare = ~wild & (F.col("cm") == 0) & (F.col("cn") < LEAST_PAGES)
    branch = (
        F.when(rare, "*")
        .when(wild | (F.col("cm") == 0), F.col("seg"))
        .when(own > share + spread, "{+}")
        .when(own < share - spread, "{-}")
        .otherwise("{=}")
    )
    return branches.join(parents, ["host", "prefix"]).select("host", "prefix", "seg", branch.alias("branch"))


def with_purity(shapes: DataFrame, known: str) -> DataFrame:
    """Shapes with their node's ``labelled`` pages, ``purity`` and number of shapes (``alike``).

    ``known`` is the count that the share of rejections is taken of; the purity so far is the
    parent's, and the same in all shapes of a node.
    """
    node = shapes.groupBy("host", "prefix").agg(
        F.sum("m").alias("labelled"),
        F.sum("b").alias("nb"),
        F.sum(known).alias("nk"),
        F.min("purity").alias("up"),
        F.count("*").alias("alike"),
    )
    smoothed = (F.col("nb") + PRIOR_WEIGHT * F.col("up")) / (F.col("nk") + PRIOR_WEIGHT)
    node = node.select("host", "prefix", "labelled", smoothed.alias("purity"), "alike")
    return shapes.drop("labelled", "purity", "alike").join(node, ["host", "prefix"])


def template_tree(pages: DataFrame) -> DataFrame:
    """``host``, ``segs``, ``template``, ``labelled``, ``purity`` of each shape.

    ``pages`` has host, segs and ``bad``: 1 rejected, 0 accepted, null unlabelled.
    """
    shapes = cut(
        pages.groupBy("host", "segs")
        .agg(F.count("*").alias("n"), F.count("bad").alias("m"), F.sum("bad").alias("b"))
        .withColumn("b", F.coalesce("b", F.lit(0)))
        .withColumn("prefix", F.lit(""))
    )
    total = shapes.agg((F.sum("b") / F.sum("n")).alias("p")).first()
    shapes = cut(with_purity(shapes.withColumn("purity", F.lit(float(total["p"] or 0.0))), "n"))
    done, level = None, 0
    while True:
        # a node of one shape has nothing left to split
        ended = (F.size("segs") <= level) | (F.col("alike") == 1)
        rest = F.array_join(F.concat(F.array("prefix"), F.slice("segs", level + 1, F.greatest(F.size("segs"), F.lit(1)))), "/")
        out = shapes.where(ended).select("host", "segs", rest.alias("template"), "labelled", "purity")
        done = out if done is None else done.unionByName(out)
        at = shapes.where(~ended).withColumn("seg", F.get("segs", F.lit(level)))
        if at.isEmpty():
            return done
        moved = at.join(named_branches(at), ["host", "prefix", "seg"])
        moved = cut(moved.withColumn("prefix", F.concat("prefix", F.lit("/"), "branch")).drop("seg", "branch"))
        shapes = cut(with_purity(moved, "m"))
        level += 1


def judge_urls(
    pages: DataFrame,
    rules=RULES,
    url: str = "url",
    label: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` of every URL.

    ``label`` names a column with 1 for pages to reject and 0 for good ones; without it, pages
    that a rule decides are the labelled ones. Where no rule fits, a template is blocked from a
    purity of REJECT on and else allowed. Null URLs and those without ``://`` have an empty host
    and path and are judged like any other; an empty table has no rows. Repeated rows stay. Other
    columns are ignored, and one in ``keep`` that has the name of a result is an error.
    """
    keep = ["page_id"] if keep is None else keep
    clash = {c.lower() for c in keep} & {"host", "path", "rule", "verdict", "template", "purity"}
    if clash:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    chosen = [F.col(f"`{c}`") for c in keep]
    known = [F.col(f"`{label}`").cast("int").alias("__label")] if label else []
    parsed = parse_url(pages.select(*chosen, F.col(f"`{url}`").alias("__url"), *known), "__url")
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("__decided", decided)
    bad = F.col("__label") if label else (F.col("__decided") == "block").cast("int")
    parsed = parsed.withColumn("bad", bad).withColumn("segs", segments(F.col("path")))
    tree = template_tree(parsed.select("host", "segs", "bad"))
    by_template = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise("allow")
    return parsed.join(tree, ["host", "segs"]).select(
        *chosen,
        "host",
        "path",
        "rule",
        F.coalesce("__decided", by_template).alias("verdict"),
        "template",
        "purity",
    )
