"""URL filter by path-template trees, in DataFrame operations only.

Per host, the segments of all paths form a tree. Level by level, a child keeps its segment where it is frequent
below its parent or where its labelled share of blocked pages differs significantly from that of its siblings
together; all other children, statistically alike, merge into the wildcard ``*``. Levels are built until no path has a further
segment; only where ``depth`` is given, what lies below that level becomes ``**``. A template is rejected if its labelled
purity, smoothed towards one half, reaches a limit. Labels come from the rules: pages that a rule decides are the labelled
ones, and keep the rule's verdict.

Rows are first aggregated to distinct (host, path), so a hot URL counts once; all joins are on tables that were
written before, so that Spark can split a hot host's partition.

Defined results: a url that is null or has no ``://`` has an empty host and path and no rule; repeated rows each
get a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: (verdict, host, path) of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEPTH = 8  # levels that the SQL is written for; on paths of more segments it says less than ``judge_urls``
SHARE = 20  # a child with at least 1/20 of its parent's pages keeps its segment
Z2 = 9.0  # squared deviations from the siblings' pooled share that still count as alike
REJECT = (3, 5)  # reject at a smoothed purity of 3/5 or more


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract words them."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule as written, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(r):
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    name = reduce(lambda c, r: c.when(fits(r), F.lit(r[1] + r[2])), ordered, F.when(F.lit(False), F.lit("")))
    verdict = reduce(lambda c, r: c.when(fits(r), F.lit(r[0])), ordered, F.when(F.lit(False), F.lit("")))
    return name, verdict


def judge_urls(pages: DataFrame, rules=RULES, depth: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_pages, template_labelled, template_blocked."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})

    sums = [F.sum(c).alias(c) for c in ("n", "lab", "blk")]
    tree = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("said").alias("lab"), F.count(F.when(F.col("said") == "block", 1)).alias("blk"))
    segs = F.filter(F.split("path", "/", -1), lambda s: s != "")
    if depth is not None:
        segs = F.when(F.size(segs) > depth, F.concat(F.slice(segs, 1, depth), F.array(F.lit("**")))).otherwise(segs)
    tree = cut(tree.withColumns({"segs": segs, "prefix": F.lit("")}))
    for d in count() if depth is None else range(depth):
        seg = F.when(F.size("segs") > d, F.get("segs", F.lit(d)))
        child = cut(tree.withColumn("seg", seg).where("seg is not null").groupBy("host", "prefix", "seg").agg(*sums))
        if depth is None and child.isEmpty():
            break
        parent = cut(child.groupBy("host", "prefix").agg(F.sum("n").alias("n_all"), F.sum("lab").alias("lab_all"), F.sum("blk").alias("blk_all")))
        n, lab, blk, n_all, lab_all, blk_all = (F.col(c).cast("double") for c in ("n", "lab", "blk", "n_all", "lab_all", "blk_all"))
        gap = F.abs(blk * lab_all - lab * blk_all) - lab_all  # one label's worth of leeway
        unlike = (gap > 0) & (gap * gap > Z2 * lab * blk_all * (lab_all - blk_all))
        kept = cut(child.join(parent, ["host", "prefix"]).where((n * SHARE >= n_all) | unlike).select("host", "prefix", "seg", F.col("seg").alias("keeps")))
        named = F.when(F.col("seg").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), F.coalesce("keeps", F.lit("*"))))
        tree = cut(tree.withColumn("seg", seg).join(kept, ["host", "prefix", "seg"], "left").select("host", "path", "segs", "n", "lab", "blk", named.alias("prefix")))
    tail = F.lit("") if depth is None else F.when(F.size("segs") > depth, F.lit("/**")).otherwise(F.lit(""))
    tree = tree.select("host", "path", "n", "lab", "blk", F.concat("prefix", tail).alias("template"))
    marks = cut(tree.groupBy("host", "template").agg(*sums).toDF("host", "template", "template_pages", "template_labelled", "template_blocked"))
    tree = cut(tree.select("host", "path", "template").join(marks, ["host", "template"]))
    reject = (F.col("template_blocked") + 1) * REJECT[1] >= (F.col("template_labelled") + 2) * REJECT[0]
    learned = F.when(reject, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(tree, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("said", learned).alias("verdict"), "template", "template_pages", "template_labelled", "template_blocked"
    )


def oracle(rules=RULES, depth: int = DEPTH) -> str:
    """The same in DuckDB SQL, one group of common table expressions a level."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r[1] + r[2]}'" for f, r in zip(fits, ordered)) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{r[0]}'" for f, r in zip(fits, ordered)) + " END"
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {rule} AS rule, {said} AS said FROM p),
c AS (SELECT host, path, count(*)::BIGINT AS n, count(said)::BIGINT AS lab, (count(*) FILTER (said = 'block'))::BIGINT AS blk FROM r GROUP BY ALL),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS raw FROM c),
t0 AS (SELECT host, path, n, lab, blk, raw, '' AS prefix FROM s),
"""
    for d in range(depth):
        sql += f"""k{d} AS (SELECT host, prefix, raw[{d + 1}] AS seg, sum(n) AS n, sum(lab) AS lab, sum(blk) AS blk FROM t{d} WHERE len(raw) > {d} GROUP BY ALL),
g{d} AS (SELECT host, prefix, sum(n)::DOUBLE AS n_all, sum(lab)::DOUBLE AS lab_all, sum(blk)::DOUBLE AS blk_all FROM k{d} GROUP BY ALL),
h{d} AS (SELECT k.host, k.prefix, k.seg, k.n, n_all, lab::DOUBLE AS lab, lab_all, blk_all, abs(blk * lab_all - lab * blk_all) - lab_all AS gap FROM k{d} k JOIN g{d} USING (host, prefix)),
w{d} AS (SELECT host, prefix, seg FROM h{d} WHERE n * {SHARE} >= n_all OR (gap > 0 AND gap * gap > {Z2} * lab * blk_all * (lab_all - blk_all))),
t{d + 1} AS (SELECT t.host, t.path, n, lab, blk, raw, CASE WHEN len(raw) <= {d} THEN t.prefix ELSE t.prefix || '/' || coalesce(w.seg, '*') END AS prefix
  FROM t{d} t LEFT JOIN w{d} w ON t.host = w.host AND t.prefix = w.prefix AND t.raw[{d + 1}] = w.seg),
"""
    return sql + f"""f AS (SELECT host, path, n, lab, blk, prefix || CASE WHEN len(raw) > {depth} THEN '/**' ELSE '' END AS template FROM t{depth}),
m AS (SELECT host, template, sum(n)::BIGINT AS template_pages, sum(lab)::BIGINT AS template_labelled, sum(blk)::BIGINT AS template_blocked FROM f GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN (template_blocked + 1) * {REJECT[1]} >= (template_labelled + 2) * {REJECT[0]} THEN 'block' ELSE 'allow' END) AS verdict,
  template, template_pages, template_labelled, template_blocked
FROM r JOIN f USING (host, path) JOIN m USING (host, template)"""
