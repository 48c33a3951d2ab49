"""SentencePiece encoding and decoding, with several distinct sampled segmentations of each text.

The text, with its spaces as the piece mark, has a lattice: an edge for each vocabulary piece at each place,
and for the bytes of a code point without a piece. Sampling is over all its paths; a path's probability is
proportional to the product of its pieces' weights to the power ALPHA. The lattice falls into units, cut
between neighbours that stand beside each other in no piece, so no path crosses a cut. Backward log-sums
over a unit's lattice, kept for units met again, give each edge's probability given its start.

Sampling is Gumbel top-k without replacement by A-star search. A node is a prefix of edges; its perturbed
score, drawn top-down given its parent's, is exactly the greatest among the paths below it, and so is the
search's bound. The greatest child has its parent's score; which edge that is follows the edges' probabilities,
and the others' scores are drawn given it. So a popped node is followed to its end, for many texts at once, and
the other edges on its way wait in the text's queue. The first k ends are the k distinct samples; with the k+1st
score as threshold t, a path of log-probability p is in the result with probability 1 - exp(-exp(p - t)), its
inclusion score. An edge beyond a prefix of log-probability under -FAR would be among the first with probability
10**-21, less than a draw can tell from 0, and waits only where there are few others. Each draw is a hash of the
row's key, the sample, and the place in the lattice, so results depend on neither batches nor tasks.

The BPE vocabulary has ranks instead of probabilities; a piece of rank r weighs 1 / (r + OFFSET).

Defined results: a null text gives no rows; an empty text one sample without pieces; a text with fewer
segmentations than k gives them all, with inclusion 1; rows of one key and text give equal samples; very
long texts are read whole; an empty table gives none; other columns are left out. decode() returns exactly
the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import remembered, ship, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, OFFSET, SEED = 2, 0.5, 10, "sp-2"
#: A lone surrogate, which no valid text has, stands for a mark that is in the text itself.
MARK, SENTINEL = "▁", "\ud800"
#: Slots of units that a worker remembers before it starts anew, texts whose units are solved together, and texts that are walked together.
REMEMBERED, SOLVED, TOGETHER = 1 << 20, 512, 64
#: Nats beyond which an edge's prefix is as good as impossible.
FAR = 50.0
#: Code points below this have a table of which may be neighbours within a piece.
NEAR = 0x250
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def pieces_of(model: str = MODEL) -> list[str]:
    """The vocabulary in order of ids. Read on the driver; tasks get it with their function."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def uniforms(key, number):
    """Draws from (0, 1), a hash of key and number each (SplitMix64)."""
    import numpy as np

    x = key + number * np.uint64(GOLDEN)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX2)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def inner(starts, counts):
    """0 .. count - 1 for each count, in a row, and starts repeated as often."""
    import numpy as np

    ends = np.cumsum(counts)
    n = np.arange(int(ends[-1]) if len(ends) else 0)
    n -= np.repeat(ends - counts, counts)
    return n, np.repeat(starts, counts)


class Lattice:
    """Units' lattices in flat arrays. A unit of n code points has n + 1 slots; a slot's edges stand in a row."""

    def __init__(self, pieces: list[str], alpha: float = ALPHA):
        import numpy as np

        self.alpha, self.size = alpha, len(pieces)
        self.byte0 = pieces.index("<0x00>")
        words = {p: i for i, p in enumerate(pieces) if not re.fullmatch(r"<.*>", p)}
        starts = dict.fromkeys((p[:n] for p in words for n in range(1, len(p))), -1)
        hashed = sorted((self._hash(p), i) for p, i in (starts | words).items())  # pieces, and beginnings of pieces as -1
        self.keys = np.array([h for h, _ in hashed], np.uint64)
        self.ids = np.array([i for _, i in hashed], np.int64)
        # where a key is looked up: a table of a power of two, the next free places taken where one is taken already
        self.bits = max(len(hashed).bit_length() + 3, 8)
        self.table, wait, step = np.full(1 << self.bits, -1, np.int32), np.arange(len(hashed)), 0
        while len(wait):
            place = self._place(self.keys[wait], step)
            free = self.table[place] < 0
            self.table[place[free][::-1]] = wait[free][::-1]
            wait, step = wait[self.table[place] != wait], step + 1
        self.probes = step
        rank = np.maximum(np.arange(len(pieces)) - self.byte0 - 255, 0)
        self.weight = -np.log(rank + OFFSET) * alpha
        self.byte_weight = -np.log(len(pieces)) * alpha
        beside = {(ord(a), ord(b)) for p in words for a, b in zip(p, p[1:])}
        self.beside = np.array(sorted(a << 21 | b for a, b in beside), np.uint64)
        low = np.zeros((NEAR, NEAR), bool)  # the mark has row 0, and what is not below NEAR the last one, which is looked up one by one
        for a, b in beside:
            a, b = (0 if c == ord(MARK) else c for c in (a, b))
            if a < NEAR - 1 and b < NEAR - 1:
                low[a, b] = True
        self.low = low.ravel()
        self.forget()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * GOLDEN + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _place(self, h, step: int):
        import numpy as np

        return (((h * np.uint64(GOLDEN)) >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def _find(self, h):
        """The numbers of keys, -1 for what is none."""
        import numpy as np

        out = self.table[self._place(h, 0)]
        wait = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        for step in range(1, self.probes):
            if not len(wait):
                break
            out[wait] = self.table[self._place(h[wait], step)]
            wait = wait[(out[wait] >= 0) & (self.keys[out[wait]] != h[wait])]
        out[wait] = -1
        return out

    def forget(self) -> None:
        import numpy as np

        self.at: dict[str, int] = {}
        self.room: dict = {}
        self.uses = np.zeros(0, np.int64)  # how often a unit was met
        self.base = np.zeros(0, np.int64)  # a unit's first slot
        self.stop = np.zeros(0, np.int64)  # and its last, which has no edges
        self.first = np.zeros(1, np.int64)  # a slot's first edge; one more at the end
        self.logq = self.upto = np.zeros(0)  # an edge's log-probability given its slot; the summed probabilities of the slot's edges up to it
        self.piece = np.zeros(0, np.int32)
        self.step = np.zeros(0, np.int8)

    def _grow(self, name: str, at: int, values) -> None:
        """Writes values at a place of an array and lets it end there; the room behind it doubles where it runs out."""
        import numpy as np

        room = self.room.get(name)
        if room is None or len(room) < at + len(values):
            new = np.empty(max(3 * (at + len(values)) // 2, 1 << 12), getattr(self, name).dtype)
            new[:at] = getattr(self, name)[:at]
            self.room[name] = room = new
        room[at : at + len(values)] = values
        setattr(self, name, room[: at + len(values)])

    def prepared(self, text: str) -> str:
        return (MARK + text.replace(MARK, SENTINEL).replace(" ", MARK)) if text else ""

    def units(self, text: str) -> list[str]:
        """The prepared text, cut between code points that are neighbours in no piece."""
        import numpy as np

        t = self.prepared(text)
        if len(t) < 2:
            return [t] if t else []
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.minimum(c, NEAR - 1)
        row[c == 0] = NEAR - 1
        row[c == ord(MARK)] = 0
        joined = self.low[row[:-1] * np.uint32(NEAR) + row[1:]]
        other = row == NEAR - 1
        rest = np.flatnonzero(other[:-1] | other[1:])
        if len(rest):
            pair = c[rest].astype(np.uint64) << np.uint64(21) | c[rest + 1]
            joined[rest] = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] == pair
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(t)]
        return [t[s:e] for s, e in zip(cuts, cuts[1:])]

    def rows(self, texts: list[list[str]]) -> list:
        """The numbers of the units of each text; new units are solved first."""
        import numpy as np

        every = list(chain.from_iterable(texts))
        got = np.fromiter(map(self.at.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(got < 0).tolist()
        if missing:
            new = dict.fromkeys(every[i] for i in missing)
            if len(self.first) + sum(map(len, new)) > REMEMBERED:
                self.forget_rare()
                got = np.fromiter(map(self.at.get, every, repeat(-1)), np.int64, len(every))
                missing = np.flatnonzero(got < 0).tolist()
                new = dict.fromkeys(every[i] for i in missing)
            self.add(list(new))
            got[missing] = [self.at[every[i]] for i in missing]
        self.uses = np.concatenate([self.uses, np.zeros(len(self.base) - len(self.uses), np.int64)]) + np.bincount(got, minlength=len(self.base))
        return np.split(got, np.cumsum([len(us) for us in texts])[:-1]) if texts else []

    def forget_rare(self) -> None:
        """Keeps the units met most often, of at most half the slots, and forgets the others."""
        import numpy as np

        size = self.stop - self.base + 1
        best = np.argsort(-self.uses, kind="stable")
        best = best[(np.cumsum(size[best]) <= REMEMBERED // 2) & (self.uses[best] > 1)]
        names = list(self.at)
        i, slot = inner(self.base[best], size[best])
        slot += i
        count = self.first[slot + 1] - self.first[slot]
        i, edge = inner(self.first[slot], count)
        edge += i
        kept = {c: getattr(self, c)[edge] for c in ("logq", "upto", "piece", "step")}
        ends, size = np.cumsum(size[best]), size[best]
        self.forget()
        self.at = {names[u]: n for n, u in enumerate(best.tolist())}
        self._grow("base", 0, ends - size)
        self._grow("stop", 0, ends - 1)
        self._grow("first", 0, np.concatenate([[0], np.cumsum(count)]))
        for name, values in kept.items():
            self._grow(name, 0, values)
        self.uses = np.zeros(len(best), np.int64)

    def add(self, units: list[str]) -> None:
        import numpy as np

        for u in units:
            self.at[u] = len(self.at)
        n = np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(u + "\0" for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        stop = np.cumsum(n + 1) - 1
        left = np.repeat(stop, n + 1) - np.arange(len(code))  # code points up to the unit's end
        slots, ids, lengths = [], [], []
        live, h = np.flatnonzero(left), np.zeros(int((left > 0).sum()), np.uint64)
        length = 1
        while len(live):
            h = h * np.uint64(GOLDEN) + code[live + length - 1] + np.uint64(1)
            j = self._find(h)
            begun = j >= 0
            pid = np.where(begun, self.ids[j], -1)
            if length == 1:  # bytes where the vocabulary lacks the code point
                pid = np.where(pid >= 0, pid, self.size + code[live].astype(np.int64))
            some = pid >= 0
            slots.append(live[some])
            ids.append(pid[some])
            lengths.append(np.full(int(some.sum()), length))
            begun &= left[live] > length
            live, h = live[begun], h[begun]
            length += 1
        slot, pid, step = (np.concatenate(x[::-1]) for x in (slots, ids, lengths))  # longest pieces first, which are likely ones
        order = np.argsort(slot, kind="stable")
        slot, pid, step = slot[order], pid[order], step[order]
        c = np.maximum(pid - self.size, 0)
        wide = np.where(c == ord(SENTINEL), 3, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        w = np.where(pid < self.size, self.weight[np.minimum(pid, self.size - 1)], wide * self.byte_weight)
        first = np.searchsorted(slot, np.arange(len(code) + 1))
        back = np.zeros(len(code))  # log of the summed weights of the paths from a slot to the unit's end
        by = np.argsort(left, kind="stable")
        edge = np.searchsorted(left[by], np.arange(1, int(left.max()) + 2))
        for lo, hi in zip(edge.tolist(), edge[1:].tolist()):
            s = by[lo:hi]
            count = first[s + 1] - first[s]
            i, e = inner(first[s], count)
            e += i
            v = w[e] + back[slot[e] + step[e]]
            at = np.cumsum(count) - count
            top = np.maximum.reduceat(v, at)
            back[s] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), at))
        q = w + back[slot + step] - back[slot]
        upto = np.cumsum(np.exp(q))
        upto -= np.concatenate([[0.0], upto])[first[slot]]
        upto[first[1:][left > 0] - 1] = 2.0  # a slot's last edge takes what rounding leaves
        slots0, edges0 = len(self.first) - 1, len(self.logq)
        self._grow("base", len(self.base), stop - n + slots0)
        self._grow("stop", len(self.stop), stop + slots0)
        self._grow("first", slots0, first + edges0)
        for name, values in (("logq", q), ("upto", upto), ("piece", pid), ("step", step.astype(np.int8))):
            self._grow(name, edges0, values)

    def walk(self, slot, stop, key):
        """Follows each (slot, stop) to its end by drawn edges: the number of steps of each walk, and all steps' slots and edges in a row."""
        import numpy as np

        steps, t, out = np.zeros(len(slot), np.int64), 0, []
        who = np.flatnonzero(slot < stop)
        at, end, key = slot[who], stop[who], key[who]
        while len(who):
            u = uniforms(key, np.array([t << 8], np.uint64))
            edge = self.first[at]
            more = np.flatnonzero(self.upto[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[self.upto[edge[more]] <= u[more]]
            out.append((who, at, edge))
            steps[who] += 1
            at = at + self.step[edge]
            live = at < end
            who, at, end, key = who[live], at[live], end[live], key[live]
            t += 1
        offset = np.cumsum(steps) - steps
        slots, edges = np.zeros(int(steps.sum()), np.int64), np.zeros(int(steps.sum()), np.int64)
        for t, (w, a, e) in enumerate(out):
            place = offset[w] + t
            slots[place], edges[place] = a, e
        return steps, slots, edges

    def sample(self, texts: list, k: int, seeds: list[int]) -> list[list[tuple]]:
        """For each text (unit numbers) at most k distinct (edges, log-probability, inclusion), from the greatest perturbed score down."""
        import numpy as np

        n = len(texts)
        seed = np.array(seeds, np.uint64)
        # A Gumbel score at log-probability l is l - log E, E exponential. Given that the greatest child has its parent's score g,
        # a sibling's is -log(exp(-g) + exp(-head) * E / q), head the prefix's log-probability and q the sibling's given the prefix.
        root = np.log(-np.log(uniforms(seed, np.ones(1, np.uint64))))
        got: list[list] = [[] for _ in range(n)]
        queues: list[list] = [[] for _ in range(n)]
        # what is followed now: (text, -score, edges before, their log-probability, unit and slot to go on from)
        now = [(d, float(root[d]), np.zeros(0, np.int64), 0.0, 0, -1) for d in range(n)]
        for r in range(k):
            starts, stops, units, counts = [], [], [], []
            for d, _, _, _, u, slot in now:
                rest = texts[d][u:]
                start = self.base[rest]
                if slot >= 0:
                    start[0] = slot
                starts.append(start)
                stops.append(self.stop[rest])
                units.append(np.arange(u, u + len(rest)))
                counts.append(len(rest))
            unit = np.concatenate(units)
            salt = np.repeat(np.array([(int(seed[d]) + (r + 1) * MIX2) % (1 << 64) for d, *_ in now], np.uint64), counts)
            key = spread(unit.astype(np.uint64) * np.uint64(MIX1) + salt)
            steps, slots, edges = self.walk(np.concatenate(starts), np.concatenate(stops), key)
            step_start = np.cumsum(steps) - steps
            step_end = np.concatenate([[0], np.cumsum(steps)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            took = self.logq[edges]
            run = np.cumsum(took)
            before = run - took
            need = k - r  # no more than these can still be popped, the threshold included
            spans = []
            for j, (d, _, prefix, phi, _, _) in enumerate(now):
                s, e = step_end[j], step_end[j + 1]
                shift = phi - (float(before[s]) if e > s else 0.0)
                got[d].append((np.concatenate([prefix, edges[s:e]]) if len(prefix) else edges[s:e], shift + float(run[e - 1]) if e > s else phi))
                upto = s + int(np.searchsorted(-before[s:e], FAR + shift, side="right"))
                if upto < e and int((self.first[slots[s:upto] + 1] - self.first[slots[s:upto]] - 1).sum()) < 16 * need:
                    upto = e
                spans.append((s, upto, shift))
            near = np.concatenate([np.arange(s, e) for s, e, _ in spans])
            first = self.first[slots[near]]
            degree = self.first[slots[near] + 1] - first
            i, edge = inner(first, degree)
            edge += i
            own = np.repeat(near, degree)
            other = edge != edges[own]
            i, edge, own = i[other], edge[other], own[other]
            walk = np.searchsorted(step_start, own, side="right") - 1
            # an empty walk has the start of the next one: the last walk that starts there has the step
            number = ((own - step_start[walk]) << 8) + i + 1
            late = np.log(-np.log(uniforms(key[walk], number.astype(np.uint64)))) - self.logq[edge] - before[own]
            cut = np.searchsorted(own, [s for s, _, _ in spans] + [spans[-1][1]] if spans else [0]).tolist()
            for j, (d, minus, prefix, _, _, _) in enumerate(now):
                s, upto, shift = spans[j]
                lo, hi = cut[j], int(np.searchsorted(own, upto))
                if hi <= lo:
                    continue
                value = late[lo:hi]
                best = np.argpartition(value, need - 1)[:need] if hi - lo > need else np.arange(hi - lo)
                for x in best.tolist():
                    step = int(own[lo + x])
                    heapq.heappush(queues[d], (float(np.logaddexp(minus, value[x] - shift)), r, lo + x, prefix, edges[s:step], float(before[step]) + shift, int(edge[lo + x]), int(unit[walk[lo + x]])))
            now = []
            if r + 1 < k:
                for d in range(n):
                    if len(got[d]) == r + 1 and queues[d]:
                        minus, _, _, prefix, way, head, e, u = heapq.heappop(queues[d])
                        slot = int(np.searchsorted(self.first, e, side="right")) - 1 + int(self.step[e])
                        now.append((d, minus, np.concatenate([prefix, way, [e]]), head + float(self.logq[e]), u, slot))
            if not now:
                break
        out = []
        for d in range(n):
            limit = -queues[d][0][0] if queues[d] else None
            out.append([(e, p, 1.0 if limit is None else float(-np.expm1(-np.exp(p - limit)))) for e, p in got[d]])
        return out

    def ids_of(self, paths: list):
        """The piece ids of the paths' edges in a row, and the number of ids of each path. A code point without a piece becomes its bytes."""
        import numpy as np

        ids = self.piece[np.concatenate(paths)]
        count = np.fromiter(map(len, paths), np.int64, len(paths))
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, count
        c = ids[odd] - self.size
        c[c == ord(SENTINEL)] = ord(MARK)
        wide = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        i, c2 = inner(c, wide)
        w = np.repeat(wide, wide)
        bits = c2 >> (6 * (w - 1 - i))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w]
        byte = np.where(w == 1, c2, np.where(i == 0, lead | bits, 0x80 | bits & 0x3F))
        size = np.ones(len(ids), np.int64)
        size[odd] = wide
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]), np.int32)
        plain = np.ones(len(ids), bool)
        plain[odd] = False
        out[ends[plain] - 1] = ids[plain]
        out[np.repeat(ends[odd] - wide, wide) + i] = self.byte0 + byte
        edge_ends = np.cumsum(count)
        upto = np.concatenate([[0], ends])
        return out, upto[edge_ends] - upto[edge_ends - count]


def spread(x):
    """Keys of walks, mixed so that neighbouring units' draws have nothing in common."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def lattice_of(model: str, alpha: float, pieces: list[str]) -> Lattice:
    """A worker process keeps its lattice from task to task; what is in it changes no draw."""
    kept = remembered()
    if (model, alpha) not in kept:
        kept.clear()
        kept[model, alpha] = Lattice(pieces, alpha)
    return kept[model, alpha]


def decode_ids(ids, pieces: list[str], byte0: int) -> str:
    out = bytearray()
    for i in ids:
        out += bytes([i - byte0]) if byte0 <= i < byte0 + 256 else pieces[i].replace(MARK, " ").encode()
    return out.decode("utf-8", "surrogatepass")[1:]


def encode_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, alpha: float = ALPHA, seed: str = SEED, model: str = MODEL) -> DataFrame:
    """Rows (key, sample from 0, ids, logp, inclusion)."""
    ship(__name__)
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(model))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        lattice = lattice_of(model, alpha, pieces.value)
        for b in batches:
            for at in range(0, b.num_rows, SOLVED):
                part = b.slice(at, SOLVED)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None]
                units = lattice.rows([lattice.units(texts[i]) for i in some])
                for first in range(0, len(some), TOGETHER):
                    own = some[first : first + TOGETHER]
                    got = lattice.sample(units[first : first + TOGETHER], samples, [xxh64_intdigest(f"{seed}:{keys[i]}".encode()) for i in own])
                    r, s, edges, p, q = zip(*[(i, s, e, p, q) for i, each in zip(own, got) for s, (e, p, q) in enumerate(each)])
                    ids, n = lattice.ids_of(edges)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(s, pa.int32()), lists, pa.array(p), pa.array(q)], ["key", "sample", "ids", "logp", "inclusion"])

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "key long, sample int, ids array<int>, logp double, inclusion double").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL, name: str = "decoded") -> DataFrame:
    """encoded with the text that its ids stand for."""
    import pandas as pd

    ship(__name__)
    spark: SparkSession = encoded.sparkSession
    pieces = spark.sparkContext.broadcast(pieces_of(model))

    def run(col):
        byte0 = pieces.value.index("<0x00>")
        return pd.Series([None if i is None else decode_ids(i, pieces.value, byte0) for i in col])

    run.__annotations__ = {"col": pd.Series, "return": pd.Series}
    return encoded.withColumn(name, F.pandas_udf(run, "string")(F.col(ids)))


def op2_sentencepiece(spark, sf_dir):
    e = encode_samples(table(spark, sf_dir, "documents"))
    return e.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.round("logp", 6).alias("logp"), F.round("inclusion", 9).alias("inclusion"))
