"""URL filters from association rules, in DataFrame and ML operations only.

Spark's FP-growth mines token combinations of the labelled urls, of MIN_COUNT bad ones or more; a combination
is a rule when its confidence, the share of bad urls among all labelled ones that hold it, is MIN_LIFT times the
share of bad urls overall, and its lower Wilson bound lies above that share, so that few urls prove nothing. An
inverted index from token to rule finds the rules that a url holds whole. Hand-written host and path rules come
first: the longest that fits decides.

Tokens that stand in exactly the same labelled urls are one item, so that a shared path of many segments is not
2**n combinations; a url holds the item if it holds any of its tokens.

Defined results: a null url, or one without ``://``, has empty host and path and no tokens, so the
method allows it; a url that appears in several rows is judged alike; without labels no rules are mined; an empty
table gives an empty result; other columns play no part. Tokens are host labels (h:), path segments (p:), a file's
extension (x:) and query keys (q:), A-Z lower-cased in hosts, digit runs as #.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, LOWER, UPPER, Scratch, ascii_lower, table

#: host, path, verdict. Fixed by the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Bad labelled urls that hold a rule's tokens, at least; its confidence over the share of bad urls, at least; standard errors of the Wilson bound.
MIN_COUNT, MIN_LIFT, WILSON_Z = 5, 1.5, 1.645
BAD = "@bad"


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return (
        df.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
        .withColumn("path", F.regexp_extract(F.substring(F.col("_rest"), F.length("_host") + 1, F.length("_rest")), r"^[^?#]*", 0))
        .withColumn("query", F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1))
        .withColumn("host", ascii_lower(F.col("_host")))
        .drop("_rest", "_host")
    )


def fixed_rule(rules=RULES):
    """The longest rule that fits, as (rule, verdict); null where none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        best = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens():
    part = lambda c, sep, mark: F.transform(F.filter(F.split(c, sep), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.filter(F.split("query", "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)) != ""), lambda x: F.concat(F.lit("q:"), F.split_part(x, F.lit("="), F.lit(1))))
    return F.array_distinct(F.concat(part(F.col("host"), r"\.", "h:"), part(F.col("path"), "/", "p:"), part(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1), "/", "x:"), keys))


RULE_TYPE = "rule_id long, items array<string>, bad long, seen long"


def mine(labelled: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """From rows (tokens, bad): the items' tokens (token, item), and rules (rule_id, items, bad, seen)."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = scratch.cut(labelled.select("tokens", "bad", F.expr("uuid()").alias("rid")))
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    nothing = spark.createDataFrame([], "token string, item string"), spark.createDataFrame([], RULE_TYPE)
    if n_bad < min_count:
        return nothing
    whole = "decimal(38,0)"
    places = [F.sum(F.xxhash64("rid", F.lit(i)).cast(whole)).alias(f"s{i}") for i in range(2)]
    seen = rows.select("rid", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"), *places).where(F.col("bad") >= min_count)
    named = seen.groupBy("bad", "n", "s0", "s1").agg(F.min("token").alias("item"))
    items = scratch.cut(seen.join(named, ["bad", "n", "s0", "s1"]).select("token", "item"))
    if items.isEmpty():
        return nothing
    held = rows.select("rid", "bad", F.explode("tokens").alias("token")).join(items, "token").groupBy("rid", "bad").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = scratch.cut(held)
    marked = held.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / held.count()).fit(marked)
    sets = scratch.cut(model.freqItemsets)
    # a combination's urls, and the bad ones among them, are two of the sets that were mined
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("bad"))
    all_ = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("items"), F.col("freq").alias("seen"))
    p, m, z2 = F.col("bad") / F.col("seen"), F.col("seen"), WILSON_Z**2
    lower = (p + z2 / (2 * m) - WILSON_Z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
    share = n_bad / n
    rules = scratch.cut(bad.join(all_, "items").where((F.col("bad") >= min_count) & (p >= min_lift * share) & (lower > share)))
    # a rule that holds another one, less an item, adds nothing to it
    fewer = rules.select("items", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("sub"))
    more = fewer.join(rules.select(F.col("items").alias("sub")), "sub", "left_semi").select("items").distinct()
    return items, scratch.cut(rules.join(more, "items", "left_anti").select(F.xxhash64("items").alias("rule_id"), "items", "bad", "seen"))


def matches(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Pairs (key, rule_id): the rules whose items a row (key, items) holds all, by an inverted index from item to rule."""
    index = rules.select("rule_id", F.size("items").alias("size"), F.explode("items").alias("item"))
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    held = rows.select(key, F.explode("items").alias("item")).join(index, "item")
    return held.groupBy(key, "rule_id", "size").agg(F.count("*").alias("n")).where("n = size").select(key, "rule_id")


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages (page_id, url) judged: page_id, host, path, rule, verdict. labels are rows (doc_id, quality, toxic) of page ids."""
    scratch = Scratch(pages.sparkSession)
    p = with_host_path(pages.select("page_id", F.col(url).alias("url"))).withColumn("tokens", tokens())
    marked = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    items, mined = mine(p.join(marked, p.page_id == marked.doc_id).select("tokens", "bad"), scratch)
    # distinct urls, so that a url in a third of the rows is matched once
    urls = p.where("url is not null").groupBy("url").agg(F.first("tokens").alias("tokens"))
    lookup = F.broadcast(items) if items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else items
    held = urls.select("url", F.explode("tokens").alias("token")).join(lookup, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    # a table of its own, so that adaptive execution can split the rows of a hot url in the join
    hit = scratch.cut(matches(held, mined, "url").select(F.col("url").alias("_url")).distinct())
    out = p.join(hit, F.col("url") == F.col("_url"), "left").withColumn("_fixed", fixed_rule(rules))
    method = F.when(F.col("_url").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce(F.col("_fixed.verdict"), method).alias("verdict"))


def op1_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


_cases = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
OP1_SQL = rf"""
WITH RECURSIVE a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS h0, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM a),
c AS (SELECT page_id, url, query, translate(h0, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM b),
x AS (SELECT *, regexp_extract(path, '\.([A-Za-z0-9]{{1,5}})$', 1) AS ext FROM c),
d AS (SELECT page_id, url, host, path, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    CASE WHEN ext <> '' THEN ['x:' || regexp_replace(ext, '[0-9]+', '#', 'g')] ELSE [] END,
    list_transform(list_filter(string_split(query, '&'), lambda x: split_part(x, '=', 1) <> ''), lambda x: 'q:' || split_part(x, '=', 1)))) AS tokens FROM x),
m AS (SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
l AS (SELECT row_number() OVER () AS r, tokens, bad FROM d JOIN m ON page_id = doc_id),
n AS (SELECT count(*) FILTER (bad) / count(*)::DOUBLE AS share FROM l),
one AS (SELECT r, bad, unnest(tokens) AS t FROM l),
items AS (SELECT t FROM one WHERE bad GROUP BY t HAVING count(*) >= {MIN_COUNT}),
sets AS (
  SELECT [t] AS s, t AS last FROM items
  UNION ALL
  SELECT list_append(sets.s, items.t), items.t FROM sets JOIN items ON items.t > sets.last
  WHERE (SELECT count(*) FROM l WHERE bad AND list_has_all(l.tokens, list_append(sets.s, items.t))) >= {MIN_COUNT}),
counted AS (SELECT s, count(*) FILTER (bad) / count(*)::DOUBLE AS p, count(*)::DOUBLE AS m FROM sets JOIN l ON list_has_all(l.tokens, s) GROUP BY s),
rules AS (SELECT s FROM counted, n WHERE p >= {MIN_LIFT} * share
  AND (p + {WILSON_Z**2} / (2 * m) - {WILSON_Z} * sqrt(p * (1 - p) / m + {WILSON_Z**2} / (4 * m * m))) / (1 + {WILSON_Z**2} / m) > share),
hit AS (SELECT DISTINCT url FROM d JOIN rules ON list_has_all(d.tokens, s) WHERE url IS NOT NULL),
e AS (SELECT d.page_id, d.host, d.path, hit.url IS NOT NULL AS mined, CASE
{_cases} END AS f FROM d LEFT JOIN hit ON d.url = hit.url)
SELECT page_id, host, path, CASE WHEN f IS NOT NULL THEN split_part(f, '|', 1) END AS rule,
  CASE WHEN f IS NOT NULL THEN split_part(f, '|', 2) WHEN mined THEN 'block' ELSE 'allow' END AS verdict FROM e
"""
