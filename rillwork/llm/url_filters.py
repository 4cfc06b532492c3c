"""URL filters by a tree of path templates.

Rules judge the urls that they fit. From these judgements a tree of templates is learnt for each host and carried over to
the host's other urls:

1. level by level, the segments under a node are counted. A segment that holds less than 1/FANOUT of its node's urls, or
   fewer than SUPPORT, is a variable one and becomes a wildcard, so a node has FANOUT literal branches at most;
2. literal branches of a node whose shares of blocked urls don't differ by a test of two proportions are merged, from the
   lowest share to the highest; those without judged urls are merged with each other. What is below is counted together;
3. paths end, or go on below DEPTH as one tail. Each url has a template now: its way through the tree;
4. a template is rejected if its share of blocked urls, smoothed towards the share in all hosts, is at least LIMIT.

Everything is counted over distinct urls, as sums that are made before the shuffle; windows stay within a node's literal
branches. Only joins see the urls of a large host, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions.columns import named
from rillwork.functions.shared import cut

Rule = tuple[str, str, str]
# The contract's rules, as verdict, host and path.
RULES: tuple[Rule, ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Levels of the tree, literal branches of a node, urls that a literal branch has at least.
DEPTH, FANOUT, SUPPORT = 4, 16, 4
#: How many deviations apart shares of branches are that aren't merged, urls that the smoothing weighs, and the share from which on a template is rejected.
APART, WEIGHT, LIMIT = 1.64, 4.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """urls (host, path, ...) with `rule` and `said`, null where no rule fits.

    A rule fits its host and the hosts under it, and paths that start with its own; the longest wins, by its host and path together, then by
    its host. Rules meet a host's suffixes by an equality join.
    """
    spark = urls.sparkSession
    known = spark.createDataFrame([(h, p, v, f"{h}{p}") for v, h, p in rules] or [("", "", "", "")], "suffix string, of string, said string, rule string").where("said <> ''").distinct()
    names = F.split("host", r"\.")
    parts = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, k, F.size(names)), "."))
    suffixes = urls.select("host").distinct().select("host", F.explode(parts).alias("suffix"))
    order = F.struct((-F.length("rule")).alias("long"), (-F.length("suffix")).alias("host_long"), "of", "rule", "said")
    fits = suffixes.join(known, "suffix").groupBy(F.col("host").alias("of_host")).agg(F.sort_array(F.collect_set(order)).alias("fits"))
    found = urls.join(fits, F.col("host") == F.col("of_host"), "left")
    best = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["of"])), 0)
    return found.withColumns({"rule": best["rule"], "said": best["said"]}).drop("of_host", "fits")


def _differ(b1: Column, n1: Column, b2: Column, n2: Column) -> Column:
    """Whether two shares b/n differ, by the deviation of their difference if both were the same."""
    pooled, one = F.try_divide(b1 + b2, n1 + n2), F.lit(1.0)
    gap = F.try_divide(b1, n1) - F.try_divide(b2, n2)
    return gap * gap > F.lit(APART * APART) * (pooled * (one - pooled) * (F.try_divide(one, n1) + F.try_divide(one, n2)))


def _branches(children: DataFrame) -> DataFrame:
    """(host, node, seg, branch) of the literal segments: merged ones have one name."""
    totals = children.groupBy("host", "node").agg(F.sum("n").alias("total"))
    literal = children.where(F.col("n") >= SUPPORT).join(totals, ["host", "node"]).where(F.col("n") * FANOUT >= F.col("total"))
    rate = F.try_divide("bad", "judged")
    order = Window.partitionBy("host", "node").orderBy(F.asc_nulls_first("rate"), "seg")  # FANOUT rows at most
    before = lambda c: F.lag(c).over(order)
    both = (F.col("judged") > 0) & (before("judged") > 0)
    first = before("judged").isNull() | ((F.col("judged") > 0) != (before("judged") > 0)) | (both & _differ(F.col("bad").cast("double"), F.col("judged").cast("double"), before("bad").cast("double"), before("judged").cast("double")))
    numbered = literal.withColumn("rate", rate).withColumn("first", F.when(first, 1).otherwise(0)).withColumn("group", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("="), "seg")).over(Window.partitionBy("host", "node", "group"))), "|")
    return numbered.select("host", "node", "seg", name.alias("branch"))


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, bad, judged, ...) with `template`."""
    segments = F.split(F.substring("path", 2, 1 << 30), "/")
    state = urls.withColumn("segs", segments).withColumn("node", F.lit(""))
    for level in range(DEPTH):
        seg = F.when(F.size("segs") > level, F.get("segs", level))
        last = level == DEPTH - 1
        state = cut(state.withColumn("seg", F.when(F.size("segs") > DEPTH, F.lit(None)).otherwise(seg) if last else seg))
        children = state.where("seg IS NOT NULL").groupBy("host", "node", "seg").agg(F.count(F.lit(1)).alias("n"), F.sum("judged").alias("judged"), F.sum("bad").alias("bad"))
        found = _branches(cut(children)).toDF("b_host", "b_node", "b_seg", "branch")
        on = (F.col("host") == F.col("b_host")) & (F.col("node") == F.col("b_node")) & (F.col("seg") == F.col("b_seg"))
        goes_on = F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("*")))
        ended = F.when(F.size("segs") > DEPTH, F.concat("node", F.lit("/**"))).otherwise(F.col("node")) if last else F.col("node")
        state = state.join(found, on, "left").withColumn("node", F.when(F.col("seg").isNull(), ended).otherwise(goes_on)).drop("b_host", "b_node", "b_seg", "branch", "seg")
    return state.withColumnRenamed("node", "template").drop("segs")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: `id_col`, host, path, rule, verdict, template, purity (the smoothed share of blocked urls).

    A url that a rule fits has the rule's verdict, whatever its template's. A template without judged urls isn't
    rejected. Defined cases: null urls and such without `://` have an empty host and path and are allowed, unless a rule
    for the empty host fits; ports and user names are part of the host; repeated urls count once in the tree; repeated and
    null ids pass row by row; without rules nothing is rejected; other columns aren't read, so their names can't clash; an
    empty table gives no rows. ValueError for a verdict that is neither allow nor block.
    """
    if any(v not in ("allow", "block") for v, _, _ in rules):
        raise ValueError("verdicts are allow or block")
    host, path = parsed(named(url_col))
    rows = cut(pages.select(named(id_col).alias("id"), host.alias("host"), path.alias("path")))
    known = ruled(rows.select("host", "path").distinct(), rules)
    urls = known.withColumns({"judged": F.col("rule").isNotNull().cast("long"), "bad": F.coalesce(F.col("said") == "block", F.lit(False)).cast("long")})
    grown = cut(templates(urls))
    counts = cut(grown.groupBy("host", "template").agg(F.sum("judged").alias("t_judged"), F.sum("bad").alias("t_bad")))
    every = counts.agg(F.sum("t_judged").alias("judged"), F.sum("t_bad").alias("bad")).first()
    base = every["bad"] / every["judged"] if every["judged"] else 0.0
    purity = (F.col("t_bad").cast("double") + F.lit(WEIGHT * base)) / (F.col("t_judged").cast("double") + F.lit(WEIGHT))
    scored = counts.select(F.col("host").alias("t_host"), F.col("template").alias("t_template"), "t_judged", purity.alias("purity"))
    of = grown.join(scored, (F.col("host") == F.col("t_host")) & (F.col("template") == F.col("t_template")))
    own = F.when((F.col("t_judged") > 0) & (F.col("purity") >= LIMIT), "block").otherwise("allow")
    judged = of.select(F.col("host").alias("u_host"), F.col("path").alias("u_path"), "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")
    out = rows.join(judged, (F.col("host") == F.col("u_host")) & (F.col("path") == F.col("u_path")), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template", "purity")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "template")


QUERIES = {"op12_url_filters": op12_url_filters}


def _oracle() -> str:
    rest = "substr(url, instr(url, '://') + 3)"
    has = "url IS NOT NULL AND instr(url, '://') > 0"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    steps = [
        f"""r AS (SELECT page_id, CASE WHEN {has} THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
  CASE WHEN {has} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)""",
        f"k AS (SELECT * FROM (VALUES {rules}) t(said, h, p))",
        """f AS (SELECT host, path, h || p AS rule, said FROM (SELECT DISTINCT host, path FROM r) JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC) = 1)""",
        """u0 AS (SELECT host, path, rule, said, CAST(rule IS NOT NULL AS BIGINT) AS judged, CAST(coalesce(said = 'block', false) AS BIGINT) AS bad, string_split(substr(path, 2), '/') AS segs, '' AS node
  FROM (SELECT DISTINCT host, path FROM r) LEFT JOIN f USING (host, path))""",
    ]
    for n in range(DEPTH):
        seg = f"segs[{n + 1}]" if n < DEPTH - 1 else f"CASE WHEN len(segs) <= {DEPTH} THEN segs[{n + 1}] END"
        ended = "node" if n < DEPTH - 1 else f"CASE WHEN len(segs) > {DEPTH} THEN node || '/**' ELSE node END"
        steps += [
            f"s{n} AS (SELECT *, {seg} AS seg FROM u{n})",
            f"c{n} AS (SELECT host, node, seg, count(*) AS n, CAST(sum(judged) AS BIGINT) AS judged, CAST(sum(bad) AS BIGINT) AS bad FROM s{n} WHERE seg IS NOT NULL GROUP BY ALL)",
            f"l{n} AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, node) AS total FROM c{n}) WHERE n >= {SUPPORT} AND n * {FANOUT} >= total)",
            f"""g{n} AS (SELECT *, lag(judged) OVER w AS j1, lag(bad) OVER w AS b1 FROM l{n}
  WINDOW w AS (PARTITION BY host, node ORDER BY CASE WHEN judged > 0 THEN bad / judged END NULLS FIRST, seg))""",
            f"""d{n} AS (SELECT *, CASE WHEN j1 IS NULL OR (judged > 0) <> (j1 > 0) OR (judged > 0 AND j1 > 0 AND pow(bad / judged - b1 / j1, 2)
  > {APART * APART!r} * (((bad + b1) / (judged + j1)) * (1.0::DOUBLE - (bad + b1) / (judged + j1)) * (1.0::DOUBLE / judged + 1.0::DOUBLE / j1))) THEN 1 ELSE 0 END AS fresh FROM g{n})""",
            f"e{n} AS (SELECT *, sum(fresh) OVER (PARTITION BY host, node ORDER BY CASE WHEN judged > 0 THEN bad / judged END NULLS FIRST, seg ROWS UNBOUNDED PRECEDING) AS grp FROM d{n})",
            f"n{n} AS (SELECT host, node, seg, array_to_string(list_sort(list('=' || seg) OVER (PARTITION BY host, node, grp)), '|') AS branch FROM e{n})",
            f"u{n + 1} AS (SELECT host, path, rule, said, judged, bad, segs, CASE WHEN seg IS NULL THEN {ended} ELSE node || '/' || coalesce(branch, '*') END AS node FROM s{n} LEFT JOIN n{n} USING (host, node, seg))",
        ]
    steps += [
        f"t AS (SELECT host, node, sum(judged) AS judged, sum(bad) AS bad FROM u{DEPTH} GROUP BY ALL)",
        "z AS (SELECT CASE WHEN sum(judged) > 0 THEN sum(bad) / sum(judged) ELSE 0 END AS base FROM t)",
        f"x AS (SELECT host, node, judged > 0 AND (bad + {WEIGHT!r}::DOUBLE * base) / (judged + {WEIGHT!r}::DOUBLE) >= {LIMIT!r}::DOUBLE AS rejected FROM t, z)",
    ]
    return f"WITH {', '.join(steps)}\nSELECT page_id, r.host, r.path, rule, coalesce(said, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, u.node AS template FROM r JOIN u{DEPTH} u USING (host, path) JOIN x ON u.host = x.host AND u.node = x.node"


ORACLE = {"op12_url_filters": _oracle()}
