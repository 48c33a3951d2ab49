"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Vectors are compared within a label only. Equal vectors of a label are one class and are compared once.
Centres are fitted, for each of the LENGTHS most frequent lengths, on at most SAMPLE vectors and SAMPLE_BYTES;
vectors of any other length have one cell a label, which changes no result. A label uses as many as it has classes for (CELL a cell, to
the power of two below, MAX_CELLS at most). A class lies in the cell of its nearest centre, its home, and
visits each earlier cell whose bisector with its home is nearer than the greatest distance that a linked
pair can have; so every linked pair meets in the earlier of its two homes, and recall is 1 by construction.

A cell's classes are dealt into blocks of BLOCK by hash, residents apart from visitors. Each pair of a
block of residents and another block is a task of its own: a product of two matrices, which returns link
counts and a spanning forest, never the pairs. Each pair is met once.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with
nothing, neither does one without a label; vectors of different lengths never link; a null vec_id links
like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, components, ship, table

MIN_COSINE = 0.98
SAMPLE, CELL, MAX_CELLS, BLOCK, ROUNDS = 20_000, 2000, 1024, 1024, 8
LENGTHS, SAMPLE_BYTES = 16, 1 << 25


def spherical_kmeans(x, k: int, rounds: int = ROUNDS):
    """k unit centres of unit rows x; starts from rows spread evenly over their order."""
    import numpy as np

    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def cells_of(unit, centres, reach: float):
    """For each unit row: its home, and with it the earlier cells where a row within ``reach`` of it may have its home."""
    import numpy as np

    d = unit @ centres.T
    home = d.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))  # between centres
    # distance to the bisector of home and other: (d_home - d_other) / gap; equal centres are no border
    margin = d[np.arange(len(unit)), home][:, None] - d
    inside = margin <= (reach + 1e-9) * gap[home] + 1e-12
    inside &= np.arange(len(centres))[None, :] < home[:, None]
    inside[np.arange(len(unit)), home] = True
    return home, [np.flatnonzero(r) for r in inside]


def valid(vec: str, label: str):
    c = F.col(vec)
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & ok, F.lit(False))


def neighbours(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", cosine: float = MIN_COSINE) -> DataFrame:
    """Rows (key, n_links, component_id), one for each row of vectors."""
    import numpy as np

    ship(__name__)
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    as_double = F.transform(F.col(vec), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), as_double.alias("v"), valid(vec, label).alias("ok"))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # rid names a class in all that follows: its number in the written table, so that no two classes can share one
    classes = scratch.cut(classes.withColumn("rid", F.monotonically_increasing_id()))
    dims = [r.d for r in classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()]
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    sizes = classes.groupBy(F.col("label").alias("l"), F.size("v").alias("d")).agg(F.count("*").alias("n"))
    want = F.when(~F.col("d").isin(dims), 1).otherwise(F.least(F.lit(MAX_CELLS), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("n") / CELL)))).cast("int"))))
    sizes = sizes.withColumn("k", want)
    counts = sorted({r.k for r in sizes.select("k").distinct().collect()})  # powers of two: eleven at most
    centres = {}
    for d in dims:
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
        got = classes.where(F.size("v") == d).orderBy(F.xxhash64("v"), "rid").limit(most).select("v").toArrow().column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        unit = got / np.linalg.norm(got, axis=1, keepdims=True)
        for k in counts:
            centres[d, k] = spherical_kmeans(unit, min(k, len(unit)))

    def unit_rows(x):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                vs, ks = part.column(3).to_pylist(), part.column(4).to_pylist()
                at, home, cell = [], [], []
                for d, k in sorted({(len(v), k) for v, k in zip(vs, ks)}):
                    idx = [i for i, v in enumerate(vs) if len(v) == d and ks[i] == k]
                    fitted = centres.get((d, k))
                    hs, cs = (np.zeros(len(idx), int), [np.zeros(1, int)] * len(idx)) if fitted is None else cells_of(unit_rows(np.array([vs[i] for i in idx], np.float64)), fitted, reach)
                    for i, h, c in zip(idx, hs.tolist(), cs):
                        at += [i] * len(c)
                        home += [h] * len(c)
                        cell += c.tolist()
                took = part.take(pa.array(at, pa.int64()))
                resident = pa.array(np.array(home) == np.array(cell))
                yield pa.RecordBatch.from_arrays([*[took.column(i) for i in range(4)], pa.array(cell, pa.int32()), resident], ["rid", "label", "copies", "v", "cell", "resident"])

    asked = classes.join(sizes, (F.col("label") == F.col("l")) & (F.size("v") == F.col("d"))).select("rid", "label", "copies", "v", "k")
    placed = scratch.cut(asked.mapInArrow(place, "rid long, label string, copies long, v array<double>, cell int, resident boolean"))
    size = F.size("v").alias("d")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.count_if(c) / BLOCK)).cast("int")
    cells = placed.groupBy("label", size, "cell").agg(blocks(F.col("resident")).alias("nr"), blocks(~F.col("resident")).alias("nv"))
    # cells are as many as labels times centres: a shuffled join, its rows split where a cell is large
    dealt = placed.withColumn("d", size).join(cells, ["label", "d", "cell"])
    h = F.xxhash64(F.lit(3), "rid")
    # blocks of residents are 0 to nr - 1, of visitors nr to nr + nv - 1; a resident block meets every later one and itself
    dealt = dealt.withColumn("block", F.when(F.col("resident"), F.pmod(h, F.col("nr"))).otherwise(F.col("nr") + F.pmod(h, F.col("nv"))).cast("int"))
    partner = F.when(F.col("resident"), F.sequence(F.lit(0), F.col("nr") + F.col("nv") - 1)).otherwise(F.sequence(F.lit(0), F.col("nr") - 1))
    sides = dealt.withColumn("other", F.explode(partner))
    task = F.struct(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    work = sides.select("label", "d", "cell", task.alias("pair"), "block", "rid", "copies", "v")

    def compare(key_, t):
        import pyarrow as pa

        i, j, d = key_[3].as_py()["i"], key_[3].as_py()["j"], key_[1].as_py()
        block = t.column("block").to_numpy()
        rid, copies = t.column("rid").to_numpy(), t.column("copies").to_numpy()
        x = unit_rows(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, lab = np.zeros(len(rid), np.int64), np.arange(len(rid))
        ps, qs = [], []
        for s in range(0, len(a), 256):
            part = a[s : s + 256]
            hit = x[part] @ x[b].T >= cosine
            if i == j:
                hit &= part[:, None] < b[None, :]
            p, q = np.nonzero(hit)
            ps.append(part[p].astype(np.int32))
            qs.append(b[q].astype(np.int32))
            np.add.at(links, ps[-1], copies[qs[-1]])
            np.add.at(links, qs[-1], copies[ps[-1]])
        p, q = (np.concatenate(y) if y else np.zeros(0, np.int32) for y in (ps, qs))
        while len(p):  # each row takes the least label it is linked to, and that label's own, until nothing changes
            least = lab.copy()
            np.minimum.at(least, p, lab[q])
            np.minimum.at(least, q, lab[p])
            least = least[least]
            if (least == lab).all():
                break
            lab = least
        ea = np.flatnonzero(lab != np.arange(len(lab)))
        eb = lab[ea]
        some = np.flatnonzero(links)
        none_i, none_l = [None] * len(some), [None] * len(ea)
        return pa.table({"rid": pa.array(np.concatenate([rid[some], rid[ea]])), "links": pa.array(links[some].tolist() + none_l, pa.int64()), "other": pa.array(none_i + rid[eb].tolist(), pa.int64())})

    found = scratch.cut(work.groupBy("label", "d", "cell", "pair").applyInArrow(compare, "rid long, links long, other long"))
    linked = found.where("links is not null").groupBy("rid").agg(F.sum("links").alias("links"))
    comp = scratch.cut(components(found.where("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b")), scratch))
    named = classes.select("rid", "least", "copies").join(linked, "rid", "left").join(comp, F.col("rid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rid"))
    named = scratch.cut(named.select("rid", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), "c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    per = named.join(least, "c").select("rid", "least", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    keyed = scratch.cut(classes.select("label", "v", "rid").join(per, "rid"))
    out = rows.withColumn("lv", F.when(F.col("ok"), F.col("v"))).join(keyed.withColumnsRenamed({"label": "label2", "v": "v2"}), (F.col("label") == F.col("label2")) & (F.col("lv") == F.col("v2")), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op5_embedding_dedup(spark, sf_dir):
    n = neighbours(table(spark, sf_dir, "embeddings"))
    return n.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a),
r AS (SELECT a AS s, b AS t FROM p UNION SELECT r.s, p.b FROM r JOIN p ON r.t = p.a),
c AS (SELECT s AS vec_id, min(t) AS c FROM r GROUP BY s)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.vec_id LEFT JOIN c ON e.vec_id = c.vec_id
"""
