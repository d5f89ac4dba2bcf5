"""URL filter: host and path rules, then a path-template tree.

1. Segments with digits are variable; addresses are counted by host and the rest. Level by level, a segment below its parent stays a constant if it is
   a word of a fair share of the parent's addresses, at the host or at one of the domains above it, and becomes a wildcard otherwise. Levels go on until
   too few addresses are deeper for any constant.
2. At each domain level sibling branches merge, from the deepest constant up: a branch whose labelled block rate differs from that of its siblings
   by no more than chance (two-sample test, the branch left out of the pool) becomes a wildcard. Branches without labels stay.
3. Purity is the smoothed share of blocked labels. Counts of a host's template are smoothed by the purity of the same template at the domain above, and so
   on to all hosts; there by the template's prefixes, up to the share of all labels. So hosts and branches without labels inherit. A template is
   rejected if its purity reaches ``REJECT``. Labels are what rules decide, or given ones.

All steps are grouped counts and joins; nothing is collected. Joins to domains that many hosts share are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, without, written

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its own; the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Domain levels between a host and all hosts; copies of the small side of a join on a key that many rows may share.
LEVELS, SALT = 3, 16
#: A constant needs this share of its parent's addresses, and this many.
SHARE, LEAST = 0.02, 5
SMOOTHING, REJECT, Z = 4.0, 0.8, 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule like 'net/', its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def masked(path: Column) -> Column:
    """The path's segments, joined again, with those that have digits as '*'."""
    return F.concat(F.lit("/"), F.array_join(F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)), "/"))


def levels(host: Column) -> Column:
    """'' for all hosts, the host's last labels, one more each, and the host."""
    return F.array_distinct(F.array(F.lit(""), *[F.substring_index(host, ".", -k) for k in range(1, LEVELS + 1)], host))


def _salted(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """left joined with a small unique right, whose copies deal out keys that many rows of left share."""
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(right, [*on, "_salt"], how).drop("_salt")


def templates(paths: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """paths (host, masked, n, bad, good) with ``template``: the path with variable segments as '*'."""
    parts = F.slice(F.split("masked", "/", -1), 2, 1 << 30)
    df = written(paths.withColumn("parts", parts).withColumn("template", F.lit("")))
    i = 0
    while (df.where(F.size("parts") > i).agg(F.sum("n")).first()[0] or 0) >= least:
        seg = F.element_at("parts", i + 1)
        here = df.where(F.size("parts") > i).groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("n"))
        wide = here.withColumn("suffix", F.explode(levels(F.col("host"))))
        total = wide.groupBy("suffix", "template").agg(F.sum("n").alias("t"))
        often = wide.where("seg <> '*'").groupBy("suffix", "template", "seg").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        fixed = _salted(often, total, ["suffix", "template"], "seg").where(F.col("n") >= share * F.col("t")).select("suffix", "template", "seg")
        own = _salted(wide.select("host", "template", "seg", "suffix"), fixed, ["suffix", "template", "seg"], "host").select("host", "template", "seg").distinct().withColumn("fixed", F.lit(True))
        marked = df.withColumn("seg", F.when(F.size("parts") > i, F.try_element_at("parts", F.lit(i + 1)))).join(own, ["host", "template", "seg"], "left")
        step = F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("fixed"), F.col("seg")).otherwise("*")))
        new = written(marked.select("host", "masked", "n", "bad", "good", "parts", step.alias("template")))
        released(df)
        df, i = new, i + 1
    return df.withColumn("template", F.concat("template", F.expr(f"repeat('/*', greatest(size(parts) - {i}, 0))"))).drop("parts")


def _constant_part(template: Column) -> Column:
    return F.regexp_replace(template, r"(/\*)+$", "")


def merged(each: DataFrame, z: float = Z) -> DataFrame:
    """(suffix, template, merged, b, g): at every domain level, what each template of each (host, template, bad, good) merges into and its labels there."""
    nodes = each.withColumn("suffix", F.explode(levels(F.col("host")))).groupBy("suffix", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    nodes = written(nodes.withColumn("merged", F.col("template")))
    deepest = nodes.agg(F.max(F.size(F.split(_constant_part(F.col("template")), "/", -1)))).first()[0] or 0
    for j in range(deepest - 1, 0, -1):
        parts = F.split("merged", "/", -1)
        broad = F.when(F.size(parts) > j, F.array_join(F.transform(parts, lambda x, k: F.when(k == j, "*").otherwise(x)), "/")).otherwise(F.col("merged"))  # noqa: B023
        by = nodes.groupBy("suffix", "merged").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).withColumn("wide", broad)
        pool = by.groupBy("suffix", "wide").agg(F.sum("b").alias("pb"), F.sum("g").alias("pg"))
        n, m = F.col("b") + F.col("g"), F.col("pb") + F.col("pg") - F.col("b") - F.col("g")
        rate = F.col("pb") / (F.col("pb") + F.col("pg"))
        alike = F.abs(F.col("b") / n - (F.col("pb") - F.col("b")) / m) <= z * F.sqrt(rate * (1 - rate) * (1 / n + 1 / m))
        to = F.when((n > 0) & (m > 0), F.when(alike, F.col("wide"))).otherwise(F.lit(None))
        by = by.join(pool, ["suffix", "wide"]).select("suffix", "merged", F.coalesce(to, F.col("merged")).alias("to"))
        new = written(nodes.join(by, ["suffix", "merged"]).select("suffix", "template", "bad", "good", F.col("to").alias("merged")))
        released(nodes)
        nodes = new
    stat = nodes.groupBy("suffix", "merged").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    return nodes.join(stat, ["suffix", "merged"]).select("suffix", "template", "merged", "b", "g")


def judged(tree: DataFrame, smoothing: float = SMOOTHING, reject: float = REJECT, z: float = Z) -> DataFrame:
    """(host, template, merged, purity, blocked) from paths with templates."""
    each = written(tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    table = merged(each, z)
    parts = F.split(_constant_part(F.col("template")), "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("rank"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))
    every = each.groupBy("template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    above = every.select("bad", "good", F.explode(prefixes).alias("p")).groupBy("p.prefix").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    # by template, which hosts share, the labels of its prefixes
    top = every.select("template", F.explode(prefixes).alias("p")).select("template", "p.rank", "p.prefix").join(above, "prefix")
    top = top.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("rank", "b", "g"))).alias("top"))
    own = each.select("host", "template", F.posexplode(levels(F.col("host"))).alias("rank", "suffix"))
    own = _salted(own, table, ["suffix", "template"], "host").groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct("rank", "b", "g"))).alias("own"), F.max_by("merged", "rank").alias("merged")
    )
    chain = _salted(own, top, ["template"], "host")
    purity = F.aggregate(F.concat("top", "own"), F.lit(0.5).cast("double"), lambda p, x: (x["b"] + smoothing * p) / (x["b"] + x["g"] + smoothing))
    return chain.select("host", "template", "merged", purity.alias("purity")).withColumn("blocked", F.col("purity") >= reject)


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, bad: Column | None = None) -> DataFrame:
    """Pages with host, path, rule, verdict, template and purity.

    rule is the longest that fits, or null; verdict is the rule's, else block if the template is rejected, else allow. bad: a label of each page
    (true, false or null) from other columns; by default what its rule says. Null urls and those without '://' have an empty host and path; they form a
    host of their own. Urls of any length are read whole. Repeated rows count as often as they occur and are judged alike; ties between siblings don't matter, as
    all are tested at once; an empty table gives an empty one. Columns named like the outputs are replaced, others carried.
    """
    outputs = ["host", "path", "rule", "verdict", "template", "purity"]
    df = without(pages, outputs + ["_bad", "_masked"]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "verdict": verdict})
    df = df.withColumn("_bad", F.col("verdict") == "block" if bad is None else bad).withColumn("_masked", masked(F.col("path")))
    label = F.col("_bad")
    paths = df.groupBy("host", F.col("_masked").alias("masked")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(label, 1).otherwise(0)).alias("bad"), F.sum(F.when(~label, 1).otherwise(0)).alias("good"))
    tree = templates(paths)
    table = tree.select("host", "masked", "template").join(judged(tree), ["host", "template"])
    table = table.select("host", F.col("masked").alias("_masked"), F.col("merged").alias("template"), "purity", "blocked")
    out = _salted(df, table, ["host", "_masked"], "path")
    own = F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    names = [c for c in df.columns if c not in ("_bad", "_masked", "verdict")]
    return out.select(*[f"`{c}`" for c in names], own.alias("verdict"), "template", "purity")
