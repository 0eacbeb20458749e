"""URL filter by a path-template tree per host.

Every path is cut into segments. Segments that are numbers, long hexadecimal strings or dates become
wildcards at once. Then, level by level from the root, a node with more than `max_children`
different literal children has them replaced by one wildcard, and sibling branches (all that lies below a
child) whose labelled share of bad urls does not differ from that of all siblings together (a z-test) are
merged into one branch. Levels end where no host has two paths of that depth. A template is
rejected if its share of bad labels, smoothed towards its host's and through it towards the overall
share, reaches `min_purity`. Listed rules overrule templates: a rule (host, path) fits the host and
its subdomains if the path starts with the rule's, and the longest wins.

Scale: urls are aggregated to (host, path shape) with map-side combine before the tree is built, so a
host with a third of all urls is a few hundred rows; levels are aggregations and joins of that
table, which is written after each level. Urls meet their templates in one equi-join on (host, shape),
where AQE splits hot hosts. No group is gathered in one task.

Defined results: null urls and urls without `://` have empty host and path and the empty template;
unlabelled hosts fall back to the overall share; without any labels nothing is rejected; repeated rows are
judged alike, and count as often as they occur; an empty table gives none; extra columns pass through, columns
named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm._common import Placed, forget, written
from grainmill.llm._text import lower_ascii

NUMBER = r"^[0-9]+(?=(\.[A-Za-z]{1,5})?$)"
HEX = r"^[0-9a-fA-F]{8}[0-9a-fA-F-]{4,}(?=(\.[A-Za-z]{1,5})?$)"
DATE = r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?(?=(\.[A-Za-z]{1,5})?$)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def shape_of(path: Column) -> Column:
    """All of the path's segments, with obvious variables as {n}, {h}, {d}."""
    seg = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(seg, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, DATE, "{d}"), NUMBER, "{n}"), HEX, "{h}"))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: int) -> Column:
    """The longest fitting rule's string (field 0) or verdict (field 1), or null. rules: (verdict, host, path)."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.lit((h + p, verdict)[field])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def _is_wild(seg: Column) -> Column:
    return seg.rlike(r"^(\{[nhd]\}|\*+)(\.|$)")


def _replaced(shape: Column, i: int) -> Column:
    """shape with segment i as '*'."""
    return F.transform(shape, lambda s, k: F.when(k == i, F.lit("*")).otherwise(s))


def templates(shapes: DataFrame, max_children: int = 20, z: float = 1.96) -> DataFrame:
    """shapes (host, shape, n, n_lab, n_bad) and for each its `template`: the shape after generalising and merging."""
    now = shapes.withColumn("template", F.col("shape"))
    i = 0
    while now.where(F.size("template") > i).groupBy("host").agg(F.count_distinct("template").alias("k")).where("k > 1").limit(1).count():
        # 1. A node with too many literal children is a variable.
        here = now.where((F.size("template") > i) & ~_is_wild(F.get("template", F.lit(i))))
        node = here.select("host", F.slice("template", 1, i).alias("prefix"), F.get("template", F.lit(i)).alias("child")).distinct()
        wide = node.groupBy("host", "prefix").agg(F.count("*").alias("k")).where(F.col("k") > max_children).select(F.col("host").alias("wh"), F.col("prefix").alias("wp"))
        now = now.join(wide, (F.col("host") == F.col("wh")) & (F.slice("template", 1, i) == F.col("wp")) & (F.size("template") > i), "left")
        now = now.withColumn("template", F.when(F.col("wh").isNotNull() & ~_is_wild(F.get("template", F.lit(i))), _replaced(F.col("template"), i)).otherwise(F.col("template"))).drop("wh", "wp")
        # 2. Sibling branches that differ no more than chance would have it become one.
        branch = F.slice("template", 1, i + 1)
        sums = now.where(F.size("template") > i).groupBy("host", branch.alias("branch")).agg(F.sum("n_lab").alias("l"), F.sum("n_bad").alias("b"))
        pooled = sums.groupBy(F.col("host").alias("ph"), F.slice("branch", 1, i).alias("pp")).agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count("*").alias("k")).where("k > 1")
        p = (F.col("pb") + 0.5) / (F.col("pl") + 1)
        alike = (F.col("l") == 0) | (F.abs(F.col("b") / F.greatest("l", F.lit(1)) - p) <= z * F.sqrt(p * (1 - p) / F.greatest("l", F.lit(1))))
        merged = sums.join(pooled, (F.col("host") == F.col("ph")) & (F.slice("branch", 1, i) == F.col("pp"))).where(alike)
        merged = merged.select(F.col("host").alias("mh"), F.col("branch").alias("mb"), F.count("*").over(Window.partitionBy("ph", "pp")).alias("m")).where("m > 1").drop("m")
        now = now.join(merged, (F.col("host") == F.col("mh")) & (branch == F.col("mb")) & (F.size("template") > i), "left")
        now = now.withColumn("template", F.when(F.col("mh").isNotNull(), _replaced(F.col("template"), i)).otherwise(F.col("template"))).drop("mh", "mb")
        now = written(now, "url-templates")
        if i:
            forget(before)
        before, i = now, i + 1
    return now


def judge(urls: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = (), url: str = "url", id_col: str = "page_id", max_children: int = 20, z: float = 1.96, strength: float = 5.0, min_purity: float = 0.5) -> DataFrame:
    """urls with host, path, rule, template, purity (the template's smoothed share of bad labels) and verdict.

    labels: (id_col, bad), bad 1 or 0; several for an id count as bad if one of them is.
    """
    outputs = ["host", "path", "rule", "template", "purity", "verdict"]
    placed = Placed(urls)
    cols = [f"c{i}" for i in range(len(placed.names))]
    u = placed(url).cast("string")
    d = placed.df.select(*cols, host_of(u).alias("host"), path_of(u).alias("path")).withColumn("shape", shape_of(F.col("path")))
    if labels is None:
        seen = d.select("host", "shape", F.lit(None).cast("int").alias("bad"))
    else:
        marks = Placed(labels)
        known = marks.df.select(marks(id_col).alias("lid"), marks("bad").cast("int").alias("bad")).where("lid is not null and bad in (0, 1)").groupBy("lid").agg(F.max("bad").alias("bad"))
        seen = d.join(known, placed(id_col) == F.col("lid"), "left").select("host", "shape", "bad")
    shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("n_lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("n_bad"))
    found = templates(written(shapes, "url-shapes"), max_children, z)
    overall = found.agg(((F.sum("n_bad") + 1) / (F.sum("n_lab") + 2)).alias("p")).first()["p"]
    overall = float(overall) if overall is not None else 0.0
    by_host = found.groupBy("host").agg(F.sum("n_lab").alias("hl"), F.sum("n_bad").alias("hb"))
    by_template = found.groupBy("host", "template").agg(F.sum("n_lab").alias("tl"), F.sum("n_bad").alias("tb"))
    smooth = lambda b, n, prior: (F.col(b) + strength * prior) / (F.col(n) + strength)
    scored = by_template.join(by_host, "host").withColumn("purity", smooth("tb", "tl", smooth("hb", "hl", F.lit(overall)))).select("host", "template", "purity", "tl")
    final = found.join(scored, ["host", "template"]).select(F.col("host").alias("fh"), F.col("shape").alias("fs"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "tl")
    out = d.join(final, (F.col("host") == F.col("fh")) & (F.col("shape") == F.col("fs")), "left")
    own = F.when((F.col("purity") >= min_purity) & (F.col("tl") > 0), F.lit("block")).otherwise(F.lit("allow"))
    by_rule = rule_of(F.col("host"), F.col("path"), rules, 1)
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, 0)).withColumn("verdict", F.coalesce(by_rule, own))
    return out.select(*placed.others(outputs), *outputs)
