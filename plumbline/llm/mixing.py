"""Mixing sources to target weights.

Tokens are summed for each source, targets follow from the weights, and each document is emitted
floor(rate) times plus one copy drawn by a hash of its id with probability equal to the fraction. The
hash's seed is chosen for each source among a fixed few, as the one whose copies come nearest the target.

Defined results: a null or empty text has size 0 and is emitted like any other document of its source
(its copies carry no words); a null source is a source of its own, last in order; a source without
words has rate 0; repeated rows with one id draw alike; an empty table gives an empty result. Columns
of the input stay as they are; the added ones are named by ``prefix``, with underscores in front where the
input has such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, Sealed, global_rank, lookup_join, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeated.
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"


def word_count(c):
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, scratch: Scratch, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, target): shares by weight, none above cap times its source, the excess dealt again by weight.

    The loop is over scalars: a source is capped when cap * size <= weight * left / weights_left. Integers
    and decimals decide, so that reruns and other engines agree; each round caps at least one source.
    """
    sums = sized.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = global_rank(sums, [F.col(source).asc_nulls_last()], scratch)
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    t = scratch.cut(ranked.withColumn("_w", pick).drop("_rank"))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    whole = "decimal(38,0)"
    full = F.col("source_size").cast("decimal(19,0)") * cap
    left, weight = int(total), int(t.agg(F.sum("_w")).first()[0] or 0)
    fixed = F.lit(False)
    while weight > 0:
        capped = (F.col("source_size").cast("decimal(24,0)") * F.lit(cap * weight).cast("decimal(13,0)")).cast(whole) <= (F.col("_w").cast("decimal(5,0)") * F.lit(left).cast("decimal(20,0)")).cast(whole)
        used, w = t.where(capped).agg(F.sum(full), F.sum("_w")).first()
        now_left, now_weight = int(total) - int(used or 0), int(t.agg(F.sum("_w")).first()[0]) - int(w or 0)
        fixed = capped
        if (now_left, now_weight) == (left, weight):
            break
        left, weight = now_left, now_weight
    share = F.col("_w").cast("double") * F.lit(float(left)) / F.lit(float(max(weight, 1)))
    target = F.when(fixed, (F.col("source_size") * cap).cast("double")).otherwise(share)
    return t.select(source, "source_size", target.alias("target"))


#: Seeds tried for each source; the one whose draw lands nearest to the target is taken. Every draw is a hash of seed and id.
SEEDS = 16


def draws(key: str, seed: str):
    """SEEDS numbers in [0, 1) for a row, 32 bits of an MD5 each."""
    each = []
    for j in range(SEEDS):
        h = F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(j // 4)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
        each.append(F.conv(F.substring(h, j % 4 * 8 + 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)))
    return F.array(*each)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, prefix: str = "mix_", weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with <prefix>size, <prefix>source_size, <prefix>target and <prefix>copies (0 up to cap). ``size`` names a column that already has the words."""
    sealed, out = _mixed(docs, key, text, source, size, weights, cap, seed)
    return sealed.open(out, **{f"{prefix}{c}": F.col(c) for c in ("size", "source_size", "target", "copies")})


def _mixed(docs: DataFrame, key: str, text: str, source: str, size: str | None, weights, cap: int, seed: str) -> tuple[Sealed, DataFrame]:
    """The sealed rows with size, source_size, target and copies."""
    scratch, sealed = Scratch(docs.sparkSession), Sealed(docs)
    key, source = sealed[key], sealed[source]
    sized = sealed.rows.withColumn("size", F.col(sealed[size]) if size else word_count(F.col(sealed[text])))
    narrow = sized.select(key, source, "size") if size else scratch.cut(sized.select(key, source, "size"))
    targets = scratch.cut(source_targets(narrow, source, "size", scratch, weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = targets.withColumn("rate", rate).withColumn("frac", F.col("rate") - F.floor("rate"))
    # for each source, what each seed's extra copies would add; sums of integers, so reruns agree
    tried = lookup_join(narrow, rated, source).withColumn("_d", draws(key, seed))
    extra = [F.sum(F.when(F.get("_d", F.lit(j)) < F.col("frac"), F.col("size")).otherwise(0)).alias(f"_s{j}") for j in range(SEEDS)]
    sums = tried.groupBy(source).agg(F.first("target").alias("_t"), F.first("rate").alias("_r"), F.first("source_size").alias("_n"), *extra)
    off = F.array(*[F.struct(F.abs(F.floor("_r") * F.col("_n") + F.col(f"_s{j}") - F.col("_t")).alias("off"), F.lit(j).alias("j")) for j in range(SEEDS)])
    seeds = sums.select(F.col(source).alias("_src"), F.array_min(off)["j"].alias("seed"))
    best = rated.join(seeds, F.col(source).eqNullSafe(F.col("_src"))).drop("_src")
    out = lookup_join(sized, scratch.cut(best), source)
    draw = F.get(draws(key, seed), F.col("seed"))
    return sealed, out.withColumn("copies", F.floor("rate") + F.when(draw < F.col("frac"), 1).otherwise(0))


def emit(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row as often as its copies say, in the input's columns."""
    sealed, out = _mixed(docs, key, text, source, None, weights, cap, seed)
    some = out.where("copies > 0")
    return sealed.open(some.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))))


def op3_mixing_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = Scratch(spark).cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    m = mix(sized, size="size")
    return m.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).cast("long").alias("taken"), F.col("source"), F.col("mix_copies").cast("long").alias("copies"))


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY source),
fill AS (
  SELECT 0 AS k, CAST((SELECT sum(source_size) FROM s) AS HUGEINT) AS l, CAST((SELECT sum(w) FROM s) AS HUGEINT) AS b
  UNION ALL
  SELECT k + 1,
    CAST((SELECT sum(source_size) FROM s) AS HUGEINT) - coalesce((SELECT sum({CAP} * s.source_size) FROM s WHERE CAST({CAP} * s.source_size AS HUGEINT) * fill.b <= CAST(s.w AS HUGEINT) * fill.l), 0),
    CAST((SELECT sum(w) FROM s) AS HUGEINT) - coalesce((SELECT sum(s.w) FROM s WHERE CAST({CAP} * s.source_size AS HUGEINT) * fill.b <= CAST(s.w AS HUGEINT) * fill.l), 0)
  FROM fill WHERE k < 64 AND b > 0),
last AS (SELECT l, b FROM fill ORDER BY k DESC LIMIT 1),
t AS (
  SELECT s.source, s.source_size,
    CASE WHEN CAST({CAP} * s.source_size AS HUGEINT) * last.b <= CAST(s.w AS HUGEINT) * last.l THEN CAST({CAP} * s.source_size AS DOUBLE)
      ELSE CAST(s.w AS DOUBLE) * CAST(last.l AS DOUBLE) / CAST(greatest(last.b, 1) AS DOUBLE) END AS target FROM s, last),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    [CAST(('0x' || substr(md5('{SEED}:' || CAST(j // 4 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), CAST(j % 4 * 8 + 1 AS INT), 8)) AS BIGINT) / 4294967296.0 FOR j IN range({SEEDS})] AS draws
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT source, target, source_size, rate, size, j, draws[j + 1] < rate - floor(rate) AS hit FROM r, range({SEEDS}) AS g(j)),
v AS (SELECT source, j, abs(floor(any_value(rate)) * any_value(source_size) + coalesce(sum(size) FILTER (hit), 0) - any_value(target)) AS off FROM u GROUP BY source, j),
b AS (SELECT source, j FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, j) = 1)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draws[j + 1] < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken, r.source,
  CAST(floor(rate) + CASE WHEN draws[j + 1] < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
