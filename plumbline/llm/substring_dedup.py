"""Repeated substrings by prefix-free parsing of UTF-8 bytes.

Parse. A rolling hash runs over WINDOW bytes; a position is a trigger where its hash is least among some
SPREAD neighbours in a row. Triggers cut each text into phrases. Since a trigger depends on fewer than
SPREAD bytes either side, two equal stretches of LENGTH bytes have the same triggers inside, and at least
one lies between SPREAD and 2 * SPREAD - 1 bytes after the stretch's start: the start's anchor.

Dictionary. The starts that share an anchor need the bytes around it, its context. Each distinct context
is one entry with the number of its places (the parse), whatever the number of copies: in highly
repetitive text entries are few. All windows of LENGTH bytes at one anchor hold its core, the bytes that
they share, so an entry whose core occurs once is done with.

Order. A corpus suffix cut at LENGTH bytes is a suffix of an entry and belongs to all its places. The
suffixes of entries that share a core are put in order of (core, key) and met there with equal ones; an
entry with several places repeats as a whole. Only whether neighbours in that order agree over LENGTH
bytes matters here, so keys are fingerprints of the stretches, not the stretches themselves.

Cores, contexts and keys are polynomial hashes modulo 2**64 from one pass of prefix sums over a text, and
equality is by them: two stretches count as equal when the 64 bits of the core and the 64 of the context or
key agree. With 10**12 entries (100 TB), each met with some ten others of its core, a wrong meeting anywhere
has a probability of about 10**-6.

Passages. Beside the bytes, a text's words between white space are parsed in the same way: of the hashes of
STRETCH words in a row those are taken that are least among some ROW in a row, so each passage of PASSAGE words
or more that recurs has one that recurs, whatever its length in bytes. What a text shares with another is counted
and not removed.

No step holds a group: counts are combined before shuffles, and hot cores spread over their windows.

Defined results: a null text counts as empty; texts under LENGTH bytes keep all; rows alike in id and
text are two texts (so they repeat each other); a null id is an id like others; an empty table gives an
empty result; other columns are ignored. Removal may cut inside a character: results are bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, key_filter, pass_filter, ship, table, with_maybe

LENGTH = 400
WINDOW = 16
#: The largest spread for which the anchor and its neighbourhood lie inside every stretch.
SPREAD = (LENGTH - WINDOW) // 4
#: Words of the passages that are told of: all of PASSAGE words; none shares fewer than STRETCH.
PASSAGE, STRETCH = 51, 40
ROW = PASSAGE - STRETCH + 1
#: Bytes that are hashed at once: many short texts, or a part of a long one.
CHUNK = 1 << 19
BASE, FINAL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict = {}


def powers(n: int):
    """BASE**i and its inverse, modulo 2**64, for i below n."""
    import numpy as np

    if len(_powers.get("up", ())) < n:
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(b):
    """Sums of (byte + 1) * BASE**i over the bytes before each place."""
    import numpy as np

    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(max(len(b) + 1, 1 << 16))[0][: len(b)], out=sums[1:])
    return sums


def mixed(h):
    import numpy as np

    h ^= h >> np.uint64(32)
    h *= np.uint64(FINAL)
    h ^= h >> np.uint64(32)
    return h


def stretch_hash(sums, start, end):
    """A hash of the bytes from start to end, for arrays of both; lengths count."""
    import numpy as np

    h = (sums[end] - sums[start]) * powers(max(len(sums), 1 << 16))[1][start]
    return mixed(h + (end - start).astype(np.uint64) * np.uint64(FINAL))


def slide(h, width: int, f):
    """f over each ``width`` values in a row, by doubling."""
    k, cur = 1, h
    while k * 2 <= width:
        cur = f(cur[:-k], cur[k:])
        k *= 2
    n = len(h) - width + 1
    return f(cur[:n], cur[width - k : width - k + n]) if k < width else cur


def least_of_rows(h, ends, width: int, spread: int):
    """Places whose hash is the least of some ``spread`` hashes in a row that lie in one text; a hash covers ``width`` places, texts lie one after another up to ``ends``."""
    import numpy as np

    n = len(h)
    if n < spread:
        return np.zeros(0, np.int64)
    small = (h >> np.uint64(32)).astype(np.uint32)
    across = np.zeros(n + 1, np.int32)  # hashes that run into the next text; a row with one of them has no least hash
    np.add.at(across, np.clip(ends - width + 1, 0, n), 1)
    np.add.at(across, np.clip(ends, 0, n), -1)
    across = np.cumsum(across[:-1]) > 0
    small[across] = 0
    edge = np.zeros(spread - 1, np.uint32)
    top = slide(np.concatenate([edge, slide(small, spread, np.minimum), edge]), spread, np.maximum)
    return np.flatnonzero((top == small) & ~across)


def triggers(b, sums, ends, window: int = WINDOW, spread: int = SPREAD):
    """Positions, in the texts that lie in b one after another up to ``ends``, whose hash is the least of some ``spread`` hashes in a row of the text."""
    h = (sums[window:] - sums[:-window]) * powers(max(len(b) + 1, 1 << 16))[1][: max(len(b) - window + 1, 0)]
    return least_of_rows(mixed(h), ends, window, spread)


def word_hashes(b, starts, ends):
    """The hashes of the words of the texts that lie in b, and the number of words up to each text's end. Long texts are hashed by parts."""
    import numpy as np

    blank = np.ones(len(b) + 2, bool)
    np.logical_or((b - np.uint8(9)) < 5, b == 32, out=blank[1:-1])
    first, last = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    cut = np.unique(ends[:-1])
    cut = cut[~blank[cut] & ~blank[cut + 1]]  # one text's last word touches the next one's first
    if len(cut):
        first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
    out = np.empty(len(first), np.uint64)
    for at in range(0, len(b), CHUNK) if len(b) > CHUNK else [0]:
        lo, hi = np.searchsorted(first, [at, at + CHUNK]) if len(b) > CHUNK else (0, len(first))
        if hi > lo:
            begin = int(first[lo])
            out[lo:hi] = stretch_hash(prefix_sums(b[begin : last[hi - 1]]), first[lo:hi] - begin, last[lo:hi] - begin)
    return out, np.searchsorted(first, ends)


def passages(words, ends, stretch: int = STRETCH, row: int = ROW):
    """Arrays (text, hash): the stretches of words that are taken, of the texts whose words end at ``ends``."""
    import numpy as np

    up, down = powers(max(len(words) + 1, 1 << 16))
    if len(words) < stretch:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    h = mixed((sums[stretch:] - sums[:-stretch]) * down[: len(words) - stretch + 1])
    at = least_of_rows(h, ends, stretch, row)
    return np.searchsorted(ends, at, side="right"), h[at]


def anchors(b, starts, ends, length: int = LENGTH, spread: int = SPREAD):
    """Arrays (text, anchor, first start, last start, core, context) of the texts that lie in b: each start has as anchor the first trigger at least ``spread`` after it."""
    import numpy as np

    sums = prefix_sums(b)
    c = triggers(b, sums, ends, spread=spread)
    of = np.searchsorted(ends, c, side="right")
    begin, end = starts[of], ends[of]
    before = np.concatenate([[-(1 << 40)], c[:-1]]) if len(c) else c
    lo, hi = np.maximum(before - spread + 1, begin), np.minimum(c - spread, end - length)
    ok = lo <= hi
    of, c, lo, hi = of[ok], c[ok], lo[ok], hi[ok]
    core = stretch_hash(sums, c - spread, c + length - 2 * spread + 1)
    # the context's place about the anchor counts
    context = mixed(stretch_hash(sums, lo, hi + length) + (c - lo).astype(np.uint64) * np.uint64(BASE))
    begin = starts[of]
    return of, c - begin, lo - begin, hi - begin, core, context


def long_anchors(b, length: int = LENGTH, spread: int = SPREAD, chunk: int = CHUNK):
    """The same for one long text, by parts with what each needs of its neighbours."""
    import numpy as np

    out = []
    for at in range(0, len(b), chunk):
        lo, hi = max(0, at - 2 * length), min(len(b), at + chunk + 2 * length)
        _, c, s, e, core, context = anchors(b[lo:hi], np.zeros(1, np.int64), np.array([hi - lo]), length, spread)
        own = (c + lo >= at) & (c + lo < at + chunk)
        out.append([c[own] + lo, s[own] + lo, e[own] + lo, core[own], context[own]])
    c, s, e, core, context = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return np.zeros(len(c), np.int64), c, s, e, core, context


#: Texts handled at once: what a worker holds follows from them, not from Arrow's batches.
ROWS = 256


def _parts(batches: Iterator) -> Iterator:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _bodies(batch, column: int) -> list[bytes]:
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in batch.column(column).to_pylist()]


def _heaps(bodies: list[bytes], least: int) -> Iterator:
    """Lists of row numbers whose texts are hashed together: short ones up to CHUNK bytes, a long one alone. Texts under ``least`` bytes have neither stretch nor passage."""
    heap, size = [], 0
    for i, d in enumerate(bodies):
        if len(d) < least:
            continue
        if size + len(d) > CHUNK and heap:
            yield heap
            heap, size = [], 0
        heap.append(i)
        size += len(d)
    if heap:
        yield heap


def repeated_places(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """Rows (id, th, lo, hi, shared) of docs (id, th, text): the starts lo to hi have a stretch that also starts elsewhere, or a passage is shared."""
    spread = (length - WINDOW) // 4

    def places(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in _parts(batches):
            bodies = _bodies(part, 2)
            for heap in _heaps(bodies, min(length, 2 * PASSAGE - 1)):
                b = np.frombuffer(b"".join([bodies[i] for i in heap]), np.uint8)
                ends = np.cumsum([len(bodies[i]) for i in heap])
                starts = np.concatenate([[0], ends[:-1]])
                found = long_anchors(b, length, spread) if len(b) > CHUNK else anchors(b, starts, ends, length, spread)
                of2, passage = passages(*word_hashes(b, starts, ends))
                # a passage is a row without an anchor
                none = np.full(len(of2), -1)
                of, c, lo, hi, core, context = (np.concatenate(x) for x in zip(found, (of2, none, none, none, passage, passage)))
                own = pa.array(np.array(heap)[of])
                ints = [pa.array(x.astype(np.int32)) for x in (c, lo, hi)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), *ints, pa.array(core.view(np.int64)), pa.array(context.view(np.int64))], ["id", "th", "c", "lo", "hi", "core", "ctx"])

    both = scratch.cut(docs.mapInArrow(places, "id long, th long, c int, lo int, hi int, core long, ctx long"), ROWS)
    every, told = both.where("c >= 0"), both.where("c < 0").select("id", "th", "core")
    place = F.struct(F.col("id").isNull(), "id", "th")
    twice = scratch.cut(told.groupBy("core").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("core"))
    shared = scratch.cut(pass_filter(told, key_filter(twice, "core"), "core").join(twice, "core", "left_semi").groupBy("id", "th").agg(F.count("*").alias("shared")))
    nowhere = F.lit(None).cast("int")
    shared = shared.select("id", "th", nowhere.alias("lo"), nowhere.alias("hi"), "shared")
    again = scratch.cut(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    if again.isEmpty():
        return shared
    scratch.tidy()
    found = scratch.cut(pass_filter(every, key_filter(again, "core"), "core").join(again, "core", "left_semi"))
    for used in (both, twice, again):
        scratch.drop(used)
    # the dictionary, with one place of each entry
    dictionary = scratch.cut(found.groupBy("core", "ctx").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "c", "lo", "hi")).alias("at")))
    several = dictionary.groupBy("core").agg(F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("c0 <> c1").select("core")
    entry = F.struct("core", "ctx", "at.c", "at.lo", "at.hi")
    asked = scratch.cut(dictionary.join(several, "core", "left_semi").groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(F.collect_list(entry).alias("asked")))
    scratch.tidy()
    shown = pass_filter(docs, key_filter(asked, "th"), "th").groupBy("id", "th").agg(F.first("text").alias("text"))
    texts = shown.join(asked.withColumnsRenamed({"id": "id2", "th": "th2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("text", "asked")

    def keys(batches: Iterator) -> Iterator:
        """Each entry's suffixes: a key of LENGTH bytes for each start, from the last one back."""
        import numpy as np
        import pyarrow as pa

        for part in _parts(batches):
            for d, asked_ in zip(_bodies(part, 0), part.column(1)):
                e = asked_.values.flatten()
                core, ctx, c, lo, hi = e[0], e[1], *(x.to_numpy().astype(np.int64) for x in e[2:])
                n = hi - lo + 1
                ends = np.cumsum(n)
                back = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
                at = np.repeat(hi, n) - back
                b = np.frombuffer(d, np.uint8)
                key = np.empty(len(at), np.uint64)
                for s in range(0, max(1, len(b) - length + 1), CHUNK):  # a long text by parts
                    own = (at >= s) & (at < s + CHUNK) if len(b) > CHUNK else slice(None)
                    sums = prefix_sums(b[s : s + CHUNK + length])
                    key[own] = stretch_hash(sums, at[own] - s, at[own] - s + length)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([core, ctx, pa.array((c - spread - hi).astype(np.int32)), lists], ["core", "ctx", "a0", "keys"])

    of = scratch.cut(texts.mapInArrow(keys, "core long, ctx long, a0 int, keys array<long>"), ROWS)
    scratch.drop(asked)
    suffixes = of.select("core", "ctx", "a0", F.posexplode("keys").alias("a", "key")).select("core", "key", "ctx", (F.col("a0") + F.col("a")).alias("a"))
    equal = scratch.cut(suffixes.groupBy("core", "key").agg(F.count("*").alias("m")).where("m > 1").select("core", "key"))
    met = pass_filter(suffixes, key_filter(equal, "key"), "key").join(equal, ["core", "key"], "left_semi")
    partly = scratch.cut(met.groupBy("core", "ctx").agg(F.sort_array(F.collect_set("a")).alias("at")))
    for used in (of, equal):
        scratch.drop(used)
    scratch.tidy()
    decided = dictionary.where("n > 1").select("core", "ctx", F.lit(None).cast("array<int>").alias("at"))
    # a table of its own, so that adaptive execution can split an entry's many places in the join
    decided = scratch.cut(decided.unionByName(partly.join(dictionary.where("n = 1").select("core", "ctx"), ["core", "ctx"], "left_semi")))
    whole = F.array(F.struct("lo", "hi"))
    each = F.transform("at", lambda a: F.struct((F.col("c") - spread - a).alias("lo"), (F.col("c") - spread - a).alias("hi")))
    hits = found.join(decided, ["core", "ctx"]).select("id", "th", F.explode(F.when(F.col("at").isNull(), whole).otherwise(each)).alias("s"))
    return hits.select("id", "th", "s.lo", "s.hi", F.lit(0).cast("long").alias("shared")).unionByName(shared)


def spans(data_len: int, lo, hi, length: int):
    """Maximal covered runs (starts, ends) of stretches that start at lo to hi."""
    import numpy as np

    step = np.zeros(data_len + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi + length, -1)
    inside = np.concatenate([[0], (np.cumsum(step) > 0).astype(np.int8)])
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256, n_shared, spans array of (start, end)), and kept (binary) if asked for; n_shared counts the passages that another text holds too."""
    ship(__name__)
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    hits = scratch.cut(repeated_places(narrow, scratch, length).groupBy("id", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"), F.sum("shared").alias("shared")))
    scratch.tidy()
    # texts that lose nothing stay where they are; the filter lets few of them through to the join
    flagged = with_maybe(narrow, key_filter(hits, "th"), "th")
    none = F.lit(None).cast("array<int>")
    same = flagged.where("not _maybe or _maybe is null").select("id", "text", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("shared"))
    met = flagged.where("_maybe").join(hits.withColumnsRenamed({"id": "id2", "th": "th2"}), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    both = same.unionByName(met.select("id", "text", "lo", "hi", F.coalesce("shared", F.lit(0)).alias("shared")))
    out_type = f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, spans array<struct<start:long,end:long>>, kept binary"

    def cut(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in _parts(batches):
            size, gone, n, sha, sp, kept = [], [], [], [], [], []
            for d, lo, hi in zip(_bodies(b, 1), b.column(2), b.column(3)):
                starts = ends = np.zeros(0, np.int64)
                if lo.is_valid and len(lo):
                    starts, ends = spans(len(d), np.array(lo.as_py()), np.array(hi.as_py()), length)
                rest = b"".join(d[s:e] for s, e in zip([0, *ends.tolist()], [*starts.tolist(), len(d)]))
                size.append(len(d))
                gone.append(len(d) - len(rest))
                n.append(len(starts))
                sha.append(hashlib.sha256(rest).hexdigest())
                sp.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
                kept.append(rest if with_bytes else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), b.column(4), pa.array(sp, kind), pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans", "kept"])

    out = both.mapInArrow(cut, out_type)
    return scratch.cut(out if with_bytes else out.drop("kept"), ROWS)


def op9_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")
