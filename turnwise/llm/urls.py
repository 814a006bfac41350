"""URL filter: fixed rules, and a path-template tree for each host that judges the rest.

The tree of a host has its path templates as branches. A segment is generalised at once if its
shape shows that it varies (numbers, hexadecimal ids, dates, long slugs with digits). Where
segments that each have a small share of their parent's urls have a good part of them together,
those become one wildcard: shares say so, not numbers, so a deeper crawl has the same templates.
Segments of a rule stay. Urls that a rule decides are labelled, and labels of one's own can be given
too. Repeated urls count once.

Sibling branches (same parent, same shape below) are merged where a likelihood-ratio test on
their counts of bad and good labels finds no difference (ALIKE); branches without labels join their
siblings if those are all alike. Labels flow up the tree: a place's purity is the share of bad
labels below it, smoothed towards the purity of the place above, from all hosts down to the merged
branch. The deepest place with LABELLED labels or more, the host's root at the highest, judges: a
url is rejected if its purity reaches THRESHOLD. A host with fewer labels is not judged.

All of it is DataFrame operations. Whole paths are in the tree, places in it known by a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: (host, path beginning, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A segment is rare with at most one in DIFFERENT of its parent's urls; where rare ones have VARIES of them (DIFFERENT
#: urls more are assumed that aren't rare), they become one wildcard.
DIFFERENT, VARIES = 20, 0.2
#: Smoothing: a place counts for so many labels in those below it; PRIOR is the share of bad labels assumed of all hosts.
STRENGTH, PRIOR = 2.0, 0.3
THRESHOLD, LABELLED = 0.7, 3
#: Likelihood ratio (chi-square with one degree of freedom, 5 %) up to which two branches are alike.
ALIKE = 3.841

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits host and path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _general(segment: Column) -> Column:
    """A segment's class if its shape varies from page to page, else the segment itself."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.([A-Za-z]+)$", 1)))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{id}")
        .when(segment.rlike(r"^(?=.*[0-9])[A-Za-z0-9_.~%-]{12,}$"), "{slug}")
        .otherwise(segment)
    )


def _ratio(n1: Column, b1: Column, n2: Column, b2: Column) -> Column:
    """Likelihood ratio of two branches with ``b`` bad of ``n`` labels against one with all of them."""
    term = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    apart = term(b1) + term(n1 - b1) + term(b2) + term(n2 - b2) - term(n1.cast("double")) - term(n2.cast("double"))
    return 2 * (apart - term(b1 + b2) - term(n1 + n2 - b1 - b2) + term((n1 + n2).cast("double")))


def _places(segments: Column) -> Column:
    """(depth, parent, segment, id) of each place that a branch goes through; ids are digests of all segments so far."""
    kind = "array<struct<depth:int,parent:string,segment:string,id:string>>"
    start = F.struct(F.lit("").alias("id"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.md5(F.concat(acc["id"], F.lit("/"), x))
        place = F.struct((F.size(acc["out"]) + 1).alias("depth"), acc["id"].alias("parent"), x.alias("segment"), here.alias("id"))
        return F.struct(here.alias("id"), F.concat(acc["out"], F.array(place)).alias("out"))

    return F.aggregate(segments, start, step, lambda acc: acc["out"])


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join on its host: the planner no longer knows how it is dealt out, so both sides are
    shuffled for the join and Spark may split the partition of a host or place that very many rows have."""
    return df.withColumn("host", F.concat("host", F.lit("")))


def _templates(once: DataFrame) -> DataFrame:
    """host, bid, tid, t of each branch: its segments with those that vary as ``*``, and their digest.

    ``once``: host, bid, branch, ruled, urls; one row a branch.
    """
    nodes = once.select("host", "bid", "urls", "ruled", F.explode(_places(F.col("branch"))).alias("n"))
    nodes = nodes.select("host", "bid", "urls", "n.*", (F.col("n.depth") <= F.col("ruled")).alias("fixed"))
    children = nodes.groupBy("host", "parent", "segment").agg(F.sum("urls").alias("urls"), F.max("fixed").alias("fixed"))
    children = children.join(_dealt(children.groupBy("host", "parent").agg(F.sum("urls").alias("total"))), ["host", "parent"])
    rare = cut(children.where((F.col("urls") * DIFFERENT <= F.col("total")) & ~F.col("fixed")))
    places = rare.groupBy("host", "parent").agg(F.sum("urls").alias("rare"), F.max("total").alias("total")).where(F.col("rare") >= VARIES * (F.col("total") + DIFFERENT))
    vary = rare.join(_dealt(places.select("host", "parent")), ["host", "parent"], "left_semi").select("host", "parent", "segment", F.lit(True).alias("varies"))
    marked = nodes.join(vary, ["host", "parent", "segment"], "left")
    segment = F.when(F.col("varies"), F.lit("*")).otherwise(F.col("segment"))
    named = marked.groupBy("host", "bid").agg(F.array_sort(F.collect_list(F.struct("depth", segment.alias("segment")))).alias("s"))
    t = F.transform("s", lambda x: x["segment"])
    return named.select("host", "bid", t.alias("t")).withColumn("tid", F.md5(F.array_join("t", "/")))


def _merged(templates: DataFrame) -> DataFrame:
    """host, family, labelled, bad (of a template), part, part_labelled, part_bad: the merged branch that it belongs to.

    Siblings with the same counts are one row, so a family has a row for each pair of counts only.
    In order of their share of bad labels, neighbours that are alike are merged.
    """
    same = templates.groupBy("host", "family", "labelled", "bad").agg(F.count("*").alias("m")).where("labelled > 0")
    same = same.withColumns({"n": F.col("m") * F.col("labelled"), "b": F.col("m") * F.col("bad")})
    family = Window.partitionBy("host", "family")
    order = family.orderBy(F.desc(F.col("bad") / F.col("labelled")), F.desc("labelled"))
    ratio = _ratio(F.col("n"), F.col("b"), F.lag("n").over(order), F.lag("b").over(order))
    same = same.withColumn("new", F.when(ratio > ALIKE, 1).otherwise(0)).withColumn("part", F.sum("new").over(order))
    whole = Window.partitionBy("host", "family", "part")
    same = same.withColumns({"part_labelled": F.sum("n").over(whole), "part_bad": F.sum("b").over(whole), "parts": F.max("part").over(family)})
    names = ["host", "family", "labelled", "bad", "part", "part_labelled", "part_bad"]
    unknown = same.where("parts = 0").select("host", "family", F.lit(0).cast("long").alias("labelled"), F.lit(0.0).alias("bad"), *names[4:]).distinct()
    return same.select(*names).unionByName(unknown)


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, n_labelled of every row.

    ``labels`` (page_id, bad: boolean) may add labelled pages to those that rules decide. Null
    urls, and those without ``://``, have empty host and path and are one branch. Repeated rows
    come out as often as they went in. Urls are read whole; n_labelled counts different ones, at
    the place that judges (0 if none does). A verdict is never null. Of an empty table the result is
    empty; other columns are left out.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64("url").alias("u1"), F.xxhash64("url", F.lit(1)).alias("u2"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    bad = F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0)
    if labels is not None:
        known = labels.groupBy(F.col("page_id").alias("labelled_id")).agg(F.max(F.col("bad").cast("int")).alias("known"))
        rows = rows.join(known, F.col("page_id") == F.col("labelled_id"), "left").drop("labelled_id")
        bad = F.coalesce(bad, F.col("known"))
    # Segments that the rule of a page names.
    ruled = F.lit(0)
    for name, start, _ in rules:
        ruled = F.when(F.col("r.rule") == name + start, max(start.count("/") - 1, 0)).otherwise(ruled)
    branch = F.transform(F.split(F.regexp_replace("path", r"^/", ""), "/", -1), _general)
    rows = cut(rows.select("page_id", "host", "path", "r", "u1", "u2", bad.alias("bad"), ruled.alias("ruled"), F.md5(F.array_join(branch, "/")).alias("bid")))
    # One row an url, then one a branch from here on, with its urls and labels summed.
    once = rows.groupBy("host", "bid", "u1", "u2").agg(F.first("path").alias("path"), F.max("ruled").alias("ruled"), F.avg("bad").alias("bad"))
    once = once.groupBy("host", "bid").agg(F.first("path").alias("path"), F.max("ruled").alias("ruled"), F.count("*").alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    once = cut(once.withColumn("branch", branch).drop("path"))
    named = cut(_templates(once))
    # Siblings differ in the last fixed segment only.
    counted = once.select("host", "bid", "labelled", "bad").join(named, ["host", "bid"])
    templates = counted.groupBy("host", "tid").agg(F.first("t").alias("t"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    fixed = F.transform("t", lambda x, i: F.when(x.rlike(r"^(\{.*|\*|)$"), -1).otherwise(i))
    templates = templates.withColumn("last", F.array_max(fixed))
    family = F.array_join(F.transform("t", lambda x, i: F.when(i == F.col("last"), F.lit("<>")).otherwise(x)), "/")
    templates = cut(templates.withColumn("family", family))
    # Labels below each place of the templates, and what the places above a merged branch hold.
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("parent"), F.lit("").alias("segment"), F.lit("").alias("id")))
    places = F.explode(F.concat(root, _places(F.col("t")))).alias("p")
    below = templates.where("labelled > 0").select("host", "labelled", "bad", places).groupBy("host", F.col("p.id").alias("id")).agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    above = templates.select("host", "tid", "last", places).where("p.depth <= greatest(last, 0)").select("host", "tid", "p.depth", "p.id")
    chain = above.join(_dealt(below), ["host", "id"]).groupBy("host", "tid").agg(F.array_sort(F.collect_list(F.struct("depth", "n", "b"))).alias("chain"))
    every = once.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = ((every[0] or 0.0) + STRENGTH * PRIOR) / ((every[1] or 0) + STRENGTH)
    known = templates.join(_merged(templates), ["host", "family", "labelled", "bad"], "left").join(chain, ["host", "tid"], "left")
    kind = "array<struct<depth:int,n:bigint,b:double>>"
    leaf = F.when(F.col("part_labelled") > 0, F.array(F.struct(F.lit(1 << 30).alias("depth"), F.col("part_labelled").alias("n"), F.col("part_bad").alias("b")))).otherwise(F.array().cast(kind))
    start = F.struct(F.lit(prior).alias("p"), F.lit(None).cast("double").alias("purity"), F.lit(0).cast("long").alias("n"))

    def down(acc: Column, x: Column) -> Column:
        p = (x["b"] + STRENGTH * acc["p"]) / (x["n"] + STRENGTH)
        enough = x["n"] >= LABELLED
        return F.struct(p.alias("p"), F.when(enough, p).otherwise(acc["purity"]).alias("purity"), F.when(enough, x["n"]).otherwise(acc["n"]).alias("n"))

    places_down = F.concat(F.coalesce("chain", F.array().cast(kind)), leaf)
    known = known.withColumn("j", F.aggregate(places_down, start, down))
    template = F.concat_ws(":", "family", F.coalesce(F.col("part").cast("string"), F.lit("-")))
    verdicts = known.select("host", "tid", template.alias("template"), F.coalesce("j.purity", "j.p").alias("purity"), F.col("j.n").alias("n_labelled"))
    by_branch = named.select("host", "bid", "tid").join(_dealt(verdicts), ["host", "tid"]).drop("tid")
    out = rows.join(by_branch, ["host", "bid"], "left")
    reject = (F.col("n_labelled") >= LABELLED) & (F.col("purity") >= THRESHOLD)
    own = F.when(F.coalesce(reject, F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "template", "purity", "n_labelled")
