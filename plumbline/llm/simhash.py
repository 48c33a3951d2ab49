"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, Hamming verification.

A fingerprint is cut in d + w blocks; d differing bits touch d blocks at most, so two fingerprints at
distance d or less agree on some choice of w whole blocks. Each choice is a join key; w follows from the
number of fingerprints, so that keys stay selective, and changes no result. Distinct fingerprints alone are joined,
so copies cost nothing, and a key's members are linked through its ends first; only members that are
still in different components are compared with each other. No link between components is lost.

Defined results: a null text has no words; a text without words has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle; rows with one id are separate rows and share an
id; a null id joins a component but never names it unless all ids are null; an empty table gives none.

With ``similarity`` texts are linked as well where the exact Jaccard similarity of their shingle sets is at
least that; candidates share one of BANDS keys of ROWS minima. A text without words has no such links.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, as_edges, components, link_by_keys, ship, table
from plumbline.llm.line_dedup import _constants, alike

SHINGLE, DISTANCE, XX_SEED = 3, 3, 42
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once: 4 MB.
CHUNK = 1 << 16
#: A pair at Jaccard 0.8 shares a key with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
BANDS, ROWS = 20, 5
XORS = _constants(BANDS * ROWS)


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = XX_SEED):
    """The shingles' XXH64. bytes.split() cuts at x20 and x09 to x0D."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(first, last)), np.uint64, len(first))


def majority(hashes) -> int:
    """Bit i is set where over half of the hashes have it set."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = XX_SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def set_hash(distinct) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(distinct.tobytes())
    return h - (1 << 64) if h >> 63 else h


def sketch(hashes) -> tuple[int, list[int]]:
    """A hash of the set, and its bands' keys as signed longs; none for an empty set."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return 0, []
    least = np.array([((hashes ^ np.uint64(c % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)).min() for c in XORS], np.uint64).reshape(BANDS, ROWS)
    keys = np.array([xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least)], np.uint64).view(np.int64).tolist()
    return set_hash(np.unique(hashes)), keys


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, sketched: bool = False) -> DataFrame:
    """Rows (key, fp): the fingerprint as a signed long; with ``sketched`` also the set's hash sid and its keys."""
    ship(__name__)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            hashes = (shingle_hashes(t.as_py(), shingle) for t in b.column(1))
            if sketched:
                fp, sets = [], []
                for h in hashes:
                    fp.append(majority(h))
                    sets.append(sketch(h))
                more = [pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.list_(pa.int64()))]
            else:
                fp, more = [majority(h) for h in hashes], []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), *more], ["id", "fp", "sid", "keys"][: 2 + len(more)])

    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "id long, fp long" + ", sid long, keys array<long>" * sketched).withColumnRenamed("id", key)


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (sid, hs) of rows (text): the text's set of shingles and the set's hash."""
    ship(__name__)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            hs = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(h) for h in hs], pa.int64()), pa.array([h.view(np.int64) for h in hs], pa.list_(pa.int64()))], ["sid", "hs"])

    return texts.mapInArrow(run, "sid long, hs array<long>")


def similar(docs: DataFrame, prints: DataFrame, key: str, text: str, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) of fingerprints whose texts' shingle sets are alike. Distinct sets alone are compared."""
    some = prints.where(F.size("keys") > 0)
    of = scratch.cut(some.groupBy("sid").agg(F.min("fp").alias("fp"), F.first("keys").alias("keys")))

    def sets(wanted: DataFrame) -> DataFrame:
        # ids may repeat or be null: a text of a wanted id says itself which set it has
        ids = some.join(wanted, F.col("sid") == F.col("item"), "left_semi").groupBy("sid").agg(F.min(F.struct(F.col(key).isNull(), key))[key].alias("_id")).select("_id").distinct()
        texts = docs.join(ids, F.col(key).cast("long").eqNullSafe(F.col("_id")), "left_semi")
        return scratch.cut(sets_of(texts.select(F.col(text).alias("text")), shingle).dropDuplicates(["sid"]).select(F.col("sid").alias("item"), F.col("hs").alias("v")))

    linked = link_by_keys(of.select(F.explode("keys").alias("key"), F.col("sid").alias("item")), lambda a, b: alike(a, b, similarity), scratch, sets)
    named = as_edges(linked).join(of.select(F.col("sid").alias("a"), F.col("fp").alias("fa")), "a").join(of.select(F.col("sid").alias("b"), F.col("fp").alias("fb")), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    alike_sets = some.select("sid", F.col("fp").alias("a")).join(of.select("sid", F.col("fp").alias("b")), "sid").select("a", "b")
    return named.unionByName(alike_sets).where("a <> b").distinct()


def whole_blocks(n: int, distance: int) -> int:
    """How many whole blocks make a key: the fewest, from three, with which a fingerprint of n meets at most one other by chance.

    Any number is exact; longer keys are more, and keep chance meetings from growing with the square of n.
    """
    w = 3
    while n * comb(distance + w, w) > 1 << (64 * w // (distance + w)) and w < 12:
        w += 1
    return w


#: Keys of a fingerprint that are shuffled at once.
KEYS_AT_ONCE = 32


def block_keys(distance: int = DISTANCE, whole: int = 3) -> list:
    """Arrays of at most KEYS_AT_ONCE keys of column fp, one key for each choice of ``whole`` blocks out of distance + whole."""
    n = distance + whole
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << b for i in chosen for b in range(cuts[i], cuts[i + 1])) for chosen in combinations(range(n), whole)]
    signed = [[j, m - (1 << 64) if m >> 63 else m] for j, m in enumerate(masks)]
    parts = [F.from_json(F.lit(json.dumps(signed[i : i + KEYS_AT_ONCE])), "array<array<long>>") for i in range(0, len(signed), KEYS_AT_ONCE)]
    return [F.transform(each, lambda m: F.xxhash64(m[0], F.col("fp").bitwiseAND(m[1]))) for each in parts]


def near(a, b, distance: int = DISTANCE):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def link(fps: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """Components (node, component) of distinct fingerprints (fp) at distance or less; those without a link are left out."""
    keys = block_keys(distance, whole_blocks(fps.count(), distance))
    return link_by_keys([fps.select(F.explode(k).alias("key"), F.col("fp").alias("item")) for k in keys], lambda a, b: near(a, b, distance), scratch)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """Rows (key, fp, component_id) for each row of docs."""
    scratch, name = Scratch(docs.sparkSession), key
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    key, text = "id", "text"
    prints = scratch.cut(fingerprints(docs, key, text, shingle, similarity is not None), 1024)
    ids = scratch.cut(prints.groupBy("fp").agg(F.min(key).alias("id")))
    linked = scratch.cut(link(ids.select("fp"), distance, scratch))
    if similarity is not None:
        more = similar(docs, prints, key, text, shingle, similarity, scratch)
        linked = scratch.cut(components(as_edges(linked).unionByName(more), scratch))
    named = linked.join(ids, linked.node == ids.fp)
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    of = linked.join(least, "component").select(F.col("node").alias("fp"), "least")
    # a table of its own, so that adaptive execution can split the rows of a hot fingerprint in the join
    final = scratch.cut(ids.join(of, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id")))
    return prints.join(final, "fp").select(F.col(key).alias(name), "fp", "component_id")


def op6_simhash(spark, sf_dir):
    g = groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
