"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line is compared by its set of character shingles: SHINGLE code points of the lower-cased line from every
position; a shorter line is one shingle. A line's signature is the least hash of its set under each of 16 XOR
constants. A band's key is three minima; any two of the 12 bands have one minimum in common at most. A pair at
similarity exactly 0.8 shares a band with probability 0.9968 (counted over all 2**16 cases), at 0.9 with 0.99994.
Lines that share a band are candidates. Bitmaps of two sets differ in no more bits than the sets in shingles, so pairs
whose bitmaps differ in too many are left out without loss; a pair then counts when the exact Jaccard similarity of the
two sets (of 64-bit hashes) is MIN_SIMILARITY or more. Linked lines form components by distributed star rounds; of each component
one line stays in the whole corpus, the first by (doc_id, text hash, line number), and the others go.

Distinct lines alone are compared, and of a band's members those that are not in one component yet.

Defined results: empty lines stay; lines of any other length go where they repeat; a null text stays null; a
text that loses every line becomes empty, its row stays; rows alike in id and text get the same answer; a null
id orders last; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, Sealed, key_filter, link_by_keys, pass_filter, table, with_maybe

SHINGLE, MIN_SIMILARITY = 12, 0.8
#: Minima of a signature, and the three of each band: found by search, so that few pairs of 0.8 to 0.95 share no band.
MINIMA = 16
BANDS = [(5, 6, 11), (0, 7, 14), (4, 8, 9), (1, 10, 13), (2, 3, 15), (0, 10, 12), (7, 9, 12), (4, 13, 14), (1, 2, 11), (5, 8, 15), (1, 3, 6), (3, 8, 13)]
#: Bands that are shuffled at once.
BANDS_AT_ONCE = 6
#: Shingles that are hashed in one row, and 64-bit words of a candidate's bitmap.
AT_ONCE, WORDS = 16, 16
#: The lowest long: to flip its bit turns the order of unsigned longs into that of signed ones.
LOW = -(1 << 63)


def _constants(n: int) -> list[int]:
    """n 64-bit constants by the SplitMix64 rule, as signed longs."""
    out, x, mask = [], 0, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def coded(line: Column | str) -> Column:
    """A line lower-cased, four bytes a code point, so that any stretch is found at once."""
    return F.encode(F.lower(line), "UTF-32")


def last_place(code: Column, k: int = SHINGLE) -> Column:
    """The byte, from 1, at which the last shingle of a coded line begins; a shorter line is one shingle."""
    return F.greatest(F.lit(1), F.octet_length(code) - (4 * k - 1)).cast("int")


def shingle(code: Column, at: Column, k: int = SHINGLE) -> Column:
    return F.xxhash64(F.substring(code, at, F.lit(4 * k)))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (id, row, pos, line, lid, chk): the lines that are not empty; lid and chk are 128 bits of hash."""
    cut = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return cut.where("line <> ''").withColumn("lid", F.xxhash64("line")).withColumn("chk", check("line"))


def check(line: str) -> Column:
    return F.xxhash64(F.lit(7), F.col(line))


def shingles(line: Column) -> Column:
    """The hashes of a line's shingles, one for each place. The coded line goes through a lambda by name, so that it is made once."""
    every = F.transform(F.array(coded(line)), lambda code: F.transform(F.sequence(F.lit(1), last_place(code), F.lit(4)), lambda p: shingle(code, p)))
    return F.get(every, F.lit(0))


def hashed(lines: DataFrame, *keep: str) -> DataFrame:
    """Rows (*keep, p, h0, h1, ...): the hashes of AT_ONCE shingles from place p on. Beyond the last place the last one stands again, which changes no minimum and no bitmap."""
    code = lines.select(*keep, coded("line").alias("code")).withColumn("last", last_place(F.col("code")))
    each = code.select(*keep, "code", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * AT_ONCE))).alias("p"))
    return each.select(*keep, "p", *[shingle(F.col("code"), F.least(F.col("p") + 4 * i, F.col("last"))).alias(f"h{i}") for i in range(AT_ONCE)])


def least(n: int, drop: int) -> list[Column]:
    """The least unsigned h under n XOR constants, less its lowest bits."""
    low = [F.least(*[F.col(f"h{i}").bitwiseXOR(F.lit(c ^ LOW)) for i in range(AT_ONCE)]).bitwiseXOR(F.lit(LOW)) for c in _constants(n)]
    return [F.min(F.shiftrightunsigned(m, drop)).alias(f"m{i}") for i, m in enumerate(low)]


def bitmaps(lines: DataFrame) -> DataFrame:
    """Rows (lid, o0, o1, ...): a bit is set where a shingle's hash falls on it."""
    each = hashed(lines, "lid")
    hs = [F.col(f"h{i}") for i in range(AT_ONCE)]
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias(f"b{i}") for i, h in enumerate(hs)]
    word = [F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int").alias(f"w{i}") for i, h in enumerate(hs)]
    one = lambda w: reduce(Column.bitwiseOR, [F.when(F.col(f"w{i}") == w, F.col(f"b{i}")).otherwise(F.lit(0).cast("long")) for i in range(AT_ONCE)])
    return each.select("lid", *bit, *word).groupBy("lid").agg(*[F.bit_or(one(w)).alias(f"o{w}") for w in range(WORDS)])


def may_be_alike(a: str, b: str, similarity: float) -> Column:
    """False only where two sets' Jaccard similarity is surely less: the sizes n are too different, or the bitmaps differ in more
    bits than alike sets do in shingles."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(add, [F.bit_count(F.col(f"{a}.o{w}").bitwiseXOR(F.col(f"{b}.o{w}"))) for w in range(WORDS)])
    return (F.least(na, nb) + 1e-9 >= F.greatest(na, nb) * similarity) & (apart <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def lines_alike(a: str, b: str, similarity: float) -> Column:
    """Whether the Jaccard similarity of two lines' sets, of sizes n, is that or more."""
    common = F.size(F.array_intersect(shingles(F.col(f"{a}.line")), shingles(F.col(f"{b}.line"))))
    return common * (1 + similarity) + 1e-9 >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * similarity


def signatures(lines: DataFrame) -> DataFrame:
    """Rows (lid, chk, n, keys): a distinct line, its count and its bands' keys. The minima of a line's copies are combined before the one shuffle; no text is shuffled."""
    sig = hashed(lines, "lid", "chk").groupBy("lid").agg(F.max("chk").alias("chk"), F.count_if(F.col("p") == 1).alias("n"), *least(MINIMA, 24))
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{i}") for i in band]) for b, band in enumerate(BANDS)])
    return sig.select("lid", "chk", "n", keys.alias("keys"))


def alike(a: Column | str, b: Column | str, similarity: float) -> Column:
    """Whether two sets' Jaccard similarity is that or more. They go through a lambda by name, so that none is made for each of its uses."""

    def enough(x: Column) -> Column:
        return F.exists(F.array(F.size(F.array_intersect(x["a"], x["b"]))), lambda common: common >= F.lit(similarity) * (F.size(x["a"]) + F.size(x["b"]) - common))

    return F.exists(F.array(F.struct((F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b"))), enough)


def line_components(docs: DataFrame, key: str, text: str, scratch: Scratch, similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Rows (lid, chk, component) of the lines that recur or are linked."""
    sigs = scratch.cut(signatures(lines_of(docs, key, text)))
    scratch.tidy()

    def wanted_lines(wanted: DataFrame) -> DataFrame:
        """The wanted lines, their sets' sizes and bitmaps. A line is several times smaller than its set, so sets are made where they are compared."""
        some = scratch.cut(sigs.select("lid", "chk").join(wanted, F.col("lid") == F.col("item"), "left_semi"))
        held = pass_filter(lines_of(docs, key, text).select("lid", "chk", "line"), key_filter(some, "lid"), "lid").dropDuplicates(["lid", "chk"])
        lines = scratch.cut(held.join(some, ["lid", "chk"], "left_semi").select("lid", "line"))
        sized = lines.withColumn("n", F.size(F.array_distinct(shingles(F.col("line")))))
        return scratch.cut(sized.join(bitmaps(lines), "lid").select(F.col("lid").alias("item"), F.struct("line", "n", *[f"o{w}" for w in range(WORDS)]).alias("v")))

    parts = [sigs.select(F.explode(F.slice("keys", at, BANDS_AT_ONCE)).alias("key"), F.col("lid").alias("item")) for at in range(1, len(BANDS) + 1, BANDS_AT_ONCE)]
    linked = link_by_keys(parts, lambda a, b: lines_alike(a, b, similarity), scratch, wanted_lines, may=lambda a, b: may_be_alike(a, b, similarity))
    of = sigs.select("lid", "chk", "n").join(linked, F.col("lid") == F.col("node"), "left")
    return of.where("n > 1 or component is not null").select("lid", "chk", F.coalesce("component", "lid").alias("component"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = MIN_SIMILARITY) -> DataFrame:
    """docs with the text's repeated lines gone, and _n_lines, _removed (positions from 0)."""
    scratch, sealed = Scratch(docs.sparkSession), Sealed(docs)
    rows, key, text = sealed.rows, sealed[key], sealed[text]
    comp = scratch.cut(line_components(rows, key, text, scratch, similarity))
    scratch.tidy()
    found = pass_filter(lines_of(rows, key, text).select("id", "row", "pos", "lid", "chk"), key_filter(comp, "lid"), "lid")
    at = F.struct(F.col("id").isNull().alias("none"), "id", "row", "pos")
    spots = scratch.cut(found.join(comp, ["lid", "chk"]).select("component", "id", "row", "pos"))
    # the kept places are taken out by their own place, which no group shares, and not by the component, which a third of the lines may share
    first = spots.groupBy("component").agg(F.min(at).alias("first")).select(F.coalesce("first.id", F.lit(0)).alias("id0"), "first.none", F.col("first.row").alias("row0"), F.col("first.pos").alias("pos0"))
    mine = (F.coalesce("id", F.lit(0)) == F.col("id0")) & (F.col("id").isNull() == F.col("none")) & (F.col("row") == F.col("row0")) & (F.col("pos") == F.col("pos0"))
    gone = spots.join(first, mine, "left_anti")
    removed = scratch.cut(gone.groupBy("id", "row").agg(F.collect_set("pos").alias("_gone")))
    scratch.drop(spots)
    scratch.tidy()
    # texts that lose nothing stay where they are; the filter lets few of them through to the join
    flagged = with_maybe(rows.withColumn("_row", F.xxhash64(text)), key_filter(removed, "row"), "_row")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    none = F.array().cast("array<int>")
    same = flagged.where("not _maybe").select(*rows.columns, n_lines.alias("_n"), none.alias("_out"))
    met = flagged.where("_maybe").join(removed.withColumnsRenamed({"id": "_gone_id", "row": "_gone_row"}), F.col(key).cast("long").eqNullSafe(F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row")), "left")
    met = met.withColumn("_lines", F.split(text, "\n", -1)).withColumn("_n", n_lines).withColumn("_out", F.coalesce("_gone", none))
    kept = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_out"))
    new = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    met = met.withColumn(text, F.when(F.size("_out") == 0, F.col(text)).otherwise(new)).select(*rows.columns, "_n", "_out")
    return sealed.open(same.unionByName(met), _n_lines=F.col("_n"), _removed=F.col("_out"))


def op10_line_dedup(spark, sf_dir):
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
