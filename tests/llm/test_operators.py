"""The operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, embed_dedup, license_scan, line_dedup, lsm_dedup, mixing, queries, simhash, sp_sampling, substring_dedup, toxicity, url_rules
from plumbline.llm.common import Scratch, components, global_rank, key_filter, link_by_keys, lookup_join, pass_filter
from tests.conftest import SF

random.seed(7)
WORDS = [f"w{i}" for i in range(400)]


def words(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def union_find(n, edges):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        p[b] = a
    return [root(i) for i in range(n)]


LONG = words(300)
TEXTS = [None, "", " \n ", LONG, LONG, LONG.replace("w1 ", "w2 ", 1), words(2), "Released under the MIT License.", "MIT license, MIT LICENSE; the Apache-License 2.0", words(5000), "ß é 😀 ▁ x", "a" * 900]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, size string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_components_and_helpers(spark):
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    want = union_find(200, edges)
    assert got == {n: want[n] for e in edges for n in e if any(n in x and x[0] != x[1] for x in edges)}
    t = spark.createDataFrame([(f"k{i}", i) for i in range(50)] + [(None, -1)], "k string, v int")
    big = lookup_join(spark.createDataFrame([("k1", 1), (None, 2), ("zz", 3)], "k string, n int"), t, "k", limit=5)
    assert {r.n: r.v for r in big.collect()} == {1: 1, 2: -1, 3: None}
    ranked = global_rank(t.select("k"), [F.col("k").asc_nulls_last()], Scratch(spark))
    assert [r.k for r in ranked.orderBy("_rank").collect()] == sorted(f"k{i}" for i in range(50)) + [None]
    h = t.where("v >= 0").select("v", F.xxhash64("v").alias("h"))
    assert {r.v for r in pass_filter(h, key_filter(h.where("v < 9"), "h"), "h").collect()} >= set(range(9))


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id] or ""))
        assert r.mix_size == size and 0 <= r.mix_copies <= 3
    total = sum(r.mix_size for r in rows)
    per = {r.source: (r.mix_source_size, r.mix_target) for r in rows}
    assert all(t <= 3 * s + 1e-6 for s, t in per.values()) and abs(sum(t for _, t in per.values()) - total) < 1e-6 * total
    assert mixing.emit(docs).count() == sum(r.mix_copies for r in rows) and mixing.emit(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    names = ["mix_note", "mix_size", "target", "_d", "_t", "frac", "_k"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    assert "_mix_size" in mixing.mix(wide).columns and mixing.mix(wide).where("mix_size = 'mix_size' and _mix_size >= 0").count() == len(TEXTS)
    assert mixing.emit(wide).where("mix_note = 'mix_note' and frac = 'frac'").count() == sum(r.mix_copies for r in rows)


def test_exact_dedup(spark, docs, empty):
    more = docs.unionByName(docs.where("doc_id = 3"))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in lsm_dedup.exact_dedup(more, keep="largest").collect()]
    all_ = [(i, t or "") for i, t in enumerate(TEXTS)] + [(3, LONG)]
    n, top = Counter(t for _, t in all_), {}
    for i, t in all_:
        top[t] = max(i, top.get(t, i))
    assert sorted(got) == sorted((i, top[t], n[t], i == top[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in all_)
    assert lsm_dedup.exact_dedup(empty).count() == 0
    assert {r.keep_id for r in lsm_dedup.exact_dedup(docs.where("doc_id in (3, 4)")).collect()} == {3}


def test_merge_index(spark, tmp_path):
    ix = lsm_dedup.MergeIndex(spark, str(tmp_path / "ix"), fanout=2)
    parts = [[(b"a", 5), (b"b", 1), (b"b", 4)], [(b"a", 3)], [(b"c", 9), (b"a", 7)], [(b"d", 2)], [(b"d", 1)]]
    shape = []
    for part in parts:
        rows = spark.createDataFrame(part, "digest binary, id long")
        shape.append(sorted({bytes(r.digest) for p in ix.probe(rows) for r in p.collect()}))
        ix.flush(rows)
    assert shape == [[], [b"a"], [b"a"], [], [b"d"]]  # what each memtable met in the runs before it
    assert ix.compactions == 3 and [len(x) for x in ix.levels] == [1, 0, 1]
    assert sorted((bytes(r.digest), r.id, r.n) for r in ix.read().collect()) == [(b"a", 3, 3), (b"b", 1, 2), (b"c", 9, 1), (b"d", 1, 2)]
    top = ix.spark.read.parquet(ix.levels[2][0] + "/rows").withColumn("f", F.input_file_name()).collect()
    by = {}
    for r in top:
        by.setdefault(r.f, []).append(bytes(r.digest))
    assert all(v == sorted(v) for v in by.values())


def test_exact_dedup_compacts(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(lsm_dedup, "MergeIndex", lambda *a: made.append(LSM(*a)) or made[-1])
    lsm_dedup.exact_dedup(docs).count()
    assert made[0].compactions == 3 and [len(x) for x in made[0].levels] == [0, 0, 1]


LSM = lsm_dedup.MergeIndex


def test_url_rules(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/2", "http://x.net/es/1", "http://x.net", "net/es/", None, "", "http://b.info/good"]
    urls += [f"http://a{i}.org/bad/{i}" for i in range(6)] + [f"http://c{i}.info/ok/{i}" for i in range(9)] + ["http://new.org/bad/99", "http://new.org/ok/99"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, i % 2 == 0) for i in range(9, 15)] + [(i, 1, False) for i in range(15, 24)] + [(0, 1, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block") and got[4] == ("x.net", "", None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert {got[i][3] for i in range(9, 15)} | {got[24][3]} == {"block"} and {got[i][3] for i in range(15, 24)} | {got[8][3]} == {"allow"}
    assert url_rules.judge(pages, labels.where("false")).where("verdict = 'block' and rule is null").count() == 0
    assert url_rules.judge(pages.where("false"), labels).count() == 0


def test_rules_of_long_paths_are_mined_quickly(spark):
    import time

    long = "/".join("abcdefghijklmnopqrstuvwx")
    rows = [(["h:s.org", *[f"p:{x}" for x in long.split("/")], f"p:u{i}"], i % 5 > 0) for i in range(40)] + [([f"h:o{i}.org"], False) for i in range(80)]
    began = time.time()
    items, rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), Scratch(spark))
    got = [(r["items"], r.bad, r.seen) for r in rules.collect()]
    assert got == [(["h:s.org"], 32, 40)] and items.where("item = 'h:s.org'").count() == 25 and time.time() - began < 20


def test_rules_are_mined_from_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        p = url_rules.with_host_path(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")).withColumn("tokens", url_rules.tokens())
        l = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").groupBy("doc_id").agg(F.expr("bool_or(coalesce(quality = 0 or toxic = 1, false))").alias("bad"))
        _, rules = url_rules.mine(p.join(l, F.col("page_id") == F.col("doc_id")).select("tokens", "bad"), Scratch(spark))
        assert rules.where("bad >= 5").count() == rules.count() > 0, sf


def fingerprint(t, k=3):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize(("shingle", "distance"), [(3, 3), (5, 6)])
def test_simhash(spark, docs, empty, shingle, distance):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    base = LONG.split()
    for i in range(40):
        w = list(base)
        for _ in range(i % 6):
            w[random.randrange(300)] = random.choice(WORDS)
        texts[100 + i] = " ".join(w)
    ids = sorted(texts)
    fp = [fingerprint(texts[i], shingle) for i in ids]
    edges = [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= distance]
    comp = union_find(len(ids), edges)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.groups(df, shingle=shingle, distance=distance).collect()}
    assert got == {i: (fp[k], ids[comp[k]]) for k, i in enumerate(ids)}
    assert simhash.groups(empty).count() == 0


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    texts = {}
    for g in range(8):
        base = words(400).split()
        texts[10 * g] = " ".join(base)
        for c in range(1, 4):
            w = list(base)
            for at in random.sample(range(5, 395), 2 * c + 1):
                w[at] = f"new{at}"
            texts[10 * g + c] = " ".join(w)
    texts |= {900: None, 901: "one two"}
    sets = {i: {tuple((t or "").split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))} for i, t in texts.items()}
    ids = sorted(texts)
    near = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    comp = union_find(len(ids), near)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()}
    assert kept == {ids[k] for k, c in enumerate(comp) if c == k} and len(kept) == 10


def line_set(line):
    low = line.lower()
    return {low[i : i + 12] for i in range(max(1, len(low) - 11))}


def test_line_dedup(spark, empty):
    base = [words(60) for _ in range(6)]
    docs, occ = [], []
    for i in range(30):
        lines = []
        for _ in range(5):
            w = random.choice(base).split()
            for _ in range(random.randrange(4)):
                w[random.randrange(60)] = random.choice(WORDS)
            lines.append(" ".join(w))
        docs.append((i, "\n".join([*lines, "short", "", words(30)])))
    docs += [(90, None), (91, ""), (92, "x" * 400), (93, "y" + "x" * 400)]
    for i, t in docs:
        occ += [(i, p, x) for p, x in enumerate((t or "").split("\n")) if x]
    uniq = sorted({x for *_, x in occ})
    sets = [line_set(x) for x in uniq]
    edges = [(a, b) for a in range(len(uniq)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = dict(zip(uniq, union_find(len(uniq), edges)))
    first, gone = {}, set()
    for i, p, x in sorted(occ):
        if first.setdefault(comp[x], (i, p)) != (i, p):
            gone.add((i, p))
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, row string")
    out = line_dedup.dedup_lines(df).collect()
    got = {(r.doc_id, p) for r in out for p in r._removed}
    assert got <= gone and len(got) >= 0.97 * len(gone)
    for r in out:
        t = dict(docs)[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in r._removed)) and r.row == "k"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_short_lines(spark):
    texts = ["ab\n\nかな。\nonce", "かな。\nab\n\nAB", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.text, sorted(r._removed)) for r in line_dedup.dedup_lines(df).collect()}
    assert out == {0: (texts[0], []), 1: ("", [0, 1, 3]), 2: ("", [0])}


def test_line_dedup_compares_whole_lines(spark):
    link = "see https://example.com/"
    clean = [link + "page/one", link + "other?id=9", "あいうえおかきくけこさし" + "すせそたちつてとな", "あいうえおかきくけこさし" + "はひふへほまみむめも"]
    base = words(80)
    near = [base, base[:150] + "q" + base[150:], base[:-2], "".join(random.choice("abcdefgh") for _ in range(300))]
    near.append(near[3][:140] + "Z" + near[3][141:])
    dense = " ".join("abcdefghijkl"[i % 12] * (20 + i % 5) for i in range(12))
    lines = clean + near + [dense, dense + "x" * 14, "short one line", "short one linE", "short two line"]
    sets = [line_set(x) for x in lines]
    comp = union_find(len(lines), [(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r._removed}
    assert gone == {i for i, c in enumerate(comp) if c != i} == {5, 6, 8, 10, 12}


def test_line_comparison_is_cheap_and_loses_nothing(spark):
    """Shingles are hashed many in a row, minima are those of all places, and bitmaps refuse no pair that is alike."""
    rng, lines = random.Random(5), []
    for n in (1, 11, 12, 13, 27, 28, 60, 300, 4000):
        x = "".join(rng.choice("abcde é漢") for _ in range(n))
        lines += [x, x + "q" * (n // 8), x[: n // 3] + "Z" + x[n // 3 + 1 :], x[n // 7 :], "".join(rng.choice("abcde") for _ in range(n))]
    lines.append("ab" * 200)
    df = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    rows = line_dedup.hashed(df, "lid")
    assert {r.lid: r["count"] for r in rows.groupBy("lid").count().collect()} == {i: max(1, -(-(len(x) - 11) // line_dedup.AT_ONCE)) for i, x in enumerate(lines)}
    hs = {r.lid: r.hs for r in df.select("lid", line_dedup.shingles(F.col("line")).alias("hs")).collect()}
    assert all(len(hs[i]) == max(1, len(x) - 11) and len(set(hs[i])) == len(line_set(x)) for i, x in enumerate(lines))
    for r in rows.groupBy("lid").agg(*line_dedup.least(16, 24)).collect():
        assert list(r[1:]) == [min((h ^ c) % 2**64 for h in hs[r.lid]) >> 24 for c in line_dedup._constants(16)]
    v = df.withColumn("n", F.size(F.array_distinct(line_dedup.shingles(F.col("line"))))).join(line_dedup.bitmaps(df), "lid")
    v = v.select("lid", F.struct(*v.columns[1:]).alias("v"))
    pairs = v.toDF("a", "va").crossJoin(v.toDF("b", "vb")).select("a", "b", line_dedup.may_be_alike("va", "vb", 0.8).alias("may"), line_dedup.lines_alike("va", "vb", 0.8).alias("alike")).collect()
    sets = [line_set(x) for x in lines]
    assert all(r.alike == (len(sets[r.a] & sets[r.b]) >= 0.8 * len(sets[r.a] | sets[r.b])) for r in pairs)
    assert all(r.may for r in pairs if r.alike) and sum(r.may for r in pairs) < 1.2 * sum(r.alike for r in pairs) < len(pairs) / 8


def test_line_bands_are_few_and_lose_no_recall(spark):
    """A line has 12 keys, not 20. Of pairs at 0.8 to 0.9 no more share no band than with the 20 bands of four minima: 0.004815, 0.000858, 0.0000663."""
    df = spark.createDataFrame([(1, "one line of text\nanother")], "doc_id long, text string")
    assert {len(r["keys"]) for r in line_dedup.signatures(line_dedup.lines_of(df, "doc_id", "text")).select("keys").collect()} == {12}
    masks = [sum(1 << i for i in band) for band in line_dedup.BANDS]
    missed = [(case.bit_count(), line_dedup.MINIMA) for case in range(1 << line_dedup.MINIMA) if not any(case & m == m for m in masks)]
    for p, before in ((0.8, 0.004814), (0.85, 0.000858), (0.9, 0.0000663)):
        assert sum(p**k * (1 - p) ** (n - k) for k, n in missed) < before


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["_n_lines", "_removed", "_lines", "_row", "_maybe", "_f", "_gone", "__0", "id", "line"]
    df = spark.createDataFrame([(1, "a b c\nd", *names), (2, "a b c", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "__n_lines", "__removed"]
    assert sorted((str(r.doc_id), r.text, *r[2:12], r["__removed"]) for r in out.collect()) == sorted([("1", "a b c\nd", *names, []), ("2", "", *names, [0]), ("None", None, *names, [])], key=str)


def test_hot_keys_lose_no_link(spark):
    """Items of one key, met in the end in blocks: numbers link with those one or two away."""
    n = 60
    keyed = spark.createDataFrame([(7, i * 3 if i % 2 else i * 3 + 1) for i in range(n)] + [(8, 500), (8, 501)], "key long, item long")
    got = {r.node: r.component for r in link_by_keys(keyed, lambda a, b: F.abs(F.col(a) - F.col(b)) <= 2, Scratch(spark), block=7, peels=1).collect()}
    items = sorted(r.item for r in keyed.collect())
    comp = union_find(len(items), [(i, j) for i in range(len(items)) for j in range(i) if items[i] - items[j] <= 2])
    assert got == {items[i]: items[c] for i, c in enumerate(comp) if comp.count(c) > 1} and len(got) > n


LICENSE_RULES = [(r["id"], r["label"], re.compile(r["pattern"]), r["priority"], r["keywords"]) for r in license_scan.rules()]


def license_hits(norm):
    """The detections that stay, of all rules without a gate."""
    every = sorted((-p, -(m[0].count(" ") + 1), norm[: m.start()].count(" ") - 1, i) for i, _, rx, p, _ in LICENSE_RULES for m in rx.finditer(norm))
    kept = []
    for _, short, start, i in every:
        end = start - short
        if not any((s <= start and end <= e) or (start <= s and e <= end) for s, e, _ in kept):
            kept.append((start, end, i))
    return kept


def test_license_scan(spark, docs, empty):
    assert len(license_scan.SIGNATURES) > 150 and len({p for *_, p in license_scan.SIGNATURES}) == len(license_scan.SIGNATURES)
    rows = license_scan.scan(docs).collect()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), TEXTS[r.doc_id] or ""))
        assert r.n_words == len(w)
        base = sorted((i, v) for p, v in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert sorted((b.start, b.label) for b in r.base) == base
        assert [(d.start, d.end, d.id) for d in r.found] == license_hits(" " + "".join(x + " " for x in w))
    wide = docs.withColumn("_norm", F.lit(1)).withColumn("found", F.lit(2))
    assert license_scan.scan(wide).where("_norm = 1 and found = 2 and n_words >= 0 and size(_found) >= 0").count() == len(TEXTS)
    assert license_scan.scan(empty).count() == 0


def test_license_priority(spark):
    texts = ["all of it is licensed under the terms of the apache license version 2 0 here", "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "https://www.apache.org/licenses/LICENSE-2.0", "(c) 2020 A B. All rights reserved."]
    got = [[d.label for d in r.found] for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == ["apache-2.0", "apache"] and got[1] == ["gpl-2.0"] and "apache-2.0" in got[2] and got[3] == ["all-rights-reserved"]


def spelled(parsed):
    """Texts that a parsed pattern matches: each alternative, each repeat left out and taken once."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            part = [chr(arg)]
        elif kind in ("ASSERT", "NOT_LITERAL"):
            part = ["" if kind == "ASSERT" else "z"]
        elif kind == "IN":
            part = [chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])]
        elif kind == "BRANCH":
            part = [x for a in arg[1] for x in spelled(a)]
        elif kind == "SUBPATTERN":
            part = spelled(arg[-1])
        else:
            part = [x for n in sorted({arg[0], max(arg[0], 1)}) for x in ([y * n if n > 1 else y for y in spelled(arg[2])] if n else [""])]
        out = [o + x for o in out for x in part][:400]
    return out


def test_license_gate_drops_no_rule(spark):
    """Every text that a rule's pattern spells out holds the rule's keyword, and the gated scan finds what the ungated regexes find."""
    texts = []
    for i, _, rx, _, keywords in LICENSE_RULES:
        for t in spelled(re._parser.parse(rx.pattern))[:40]:
            assert any(k in f" {t} " for k in keywords), (i, t, keywords)
            texts.append(t)
    random.shuffle(texts)
    texts = [" ".join(("see " + " and ".join(texts[k : k + 3]) + " then").split()) for k in range(0, 900, 3)]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all([(d.start, d.end, d.id) for d in r.found] == license_hits(f" {texts[r.doc_id]} ") for r in rows)


def test_toxicity(spark, docs, empty):
    clean = [(i, words(40) + (" odd" if i % 3 == 0 else ""), 0, i % 3 > 0) for i in range(300)]
    bad = [(1000 + i, words(20) + " vile" * (1 + i % 3) + " nastyword" + str(i) + " " + words(20), 1, True) for i in range(60)]
    rows = clean + bad
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q), y) for i, _, y, q in rows if i % 2], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    assert "vile" in model.markers and len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(got[i].p_toxic > model.cut, bool(y)) for i, _, y, _ in rows if not i % 2]
    assert all(a == b for a, b in held)
    assert got[1002].severity > got[1000].severity > got[0].severity
    # the score, by hand
    at = {m: i for i, m in enumerate(model.markers)}
    for i, t, *_ in rows[::17] + rows[-3:]:
        n = Counter(f for w in re.findall(toxicity.WORD, t.lower()) for f in (w, *[w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k]) if f in at)
        z = sum(model.weights[at[f]] * np.log1p(c) for f, c in n.items())
        above = 1 / (1 + np.exp(np.array(model.thresholds) - z))
        assert abs(got[i].severity - above.sum()) < 1e-9 and abs(got[i].p_toxic - above[-1]) < 1e-9
    names = ["_key", "bad", "p_toxic", "severity", "n_markers", "_tox", "key", "grade"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    assert {r.p_toxic for r in toxicity.score(wide, model).collect()} == {"p_toxic"} == {r.p_toxic for r in toxicity.score(wide, toxicity.Model()).collect()}
    assert toxicity.reject(wide, model).columns == wide.columns and toxicity.train(wide, labels).markers == []
    edge = {r.doc_id: r.p_toxic for r in toxicity.score(docs, model).collect()}
    assert len(edge) == len(TEXTS) and edge[0] == edge[1] <= model.cut
    assert toxicity.score(empty, model).count() == 0 and not toxicity.train(df, labels.where("false")).markers


def test_toxicity_holds_little_in_a_worker(spark, monkeypatch):
    """A worker makes strings of one text at a time, and frees what another operator's task left in it."""
    real, made = F.arrow_udf, []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: made.append(f) or real(f, kind))
    one = spark.createDataFrame([(1, "a vile text"), (2, None)], "doc_id long, text string")
    rows = toxicity.score(one, toxicity.Model(["vile"], [2.0], [0.0, 1.0])).orderBy("doc_id").collect()
    assert [r.n_markers for r in rows] == [1, 0] and rows[0].severity > rows[1].severity
    texts = pa.array(["vile " + "x" * 20_000] * 1_000 + [None])
    common.remembered()["left"] = "by another"
    tracemalloc.start()
    out = made[0](texts).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["n_markers"] for r in out] == [1] * 1_000 + [0] and peak < texts.nbytes / 10 and not common.remembered()


def test_ordinal_fit_finds_its_own_parameters():
    rng = np.random.default_rng(1)
    n, m, w, th = 6000, 5, np.array([1.5, -1.0, 0.5, 0.0, 2.0]), np.array([0.5, 2.0])
    x = rng.random((n, m)) * (rng.random((n, m)) < 0.6)
    y = (x @ w + rng.logistic(size=n) > th[:, None]).sum(axis=0)
    rows, at = np.nonzero(x)
    got_w, got_th = toxicity.fit_ordinal(rows, at, x[rows, at], m, y, 3)
    assert np.abs(got_w - w).max() < 0.3 and np.abs(got_th - th).max() < 0.2


def test_substrings(spark, empty):
    rnd = lambda n: "".join(random.choice("abcdefgh \n") for _ in range(n))
    q = rnd(700)
    texts = [None, "", "a" * 399, "a" * 400, "a" * 5000, "abcdefghij" * 100, rnd(300) + ("abcdefghij" * 100)[3:777] + rnd(10), q, q[:399] + "X" + q[400:], "é" * 300 + q, "zz" + q[100:600] + q[50:560], rnd(3000), "ab" * 700, q]
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, core string")
    for r in substring_dedup.dedup_substrings(df, with_bytes=True).collect():
        b = raw[r.doc_id]
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                cover[i : i + 400] = True
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        assert (r.n_bytes, r.n_removed, r.kept, r.kept_sha256) == (len(b), int(cover.sum()), kept, hashlib.sha256(kept).hexdigest()), r.doc_id
        assert r.n_spans == int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_shared_passages(spark):
    fresh = lambda n: " ".join(f"{random.choice(WORDS)}{random.randrange(10**6)}" for _ in range(n))
    short = " ".join(random.choice("abcdefghij") for _ in range(51))
    passage, few = fresh(55), fresh(39)
    texts = [fresh(80) + " " + passage + "\n" + fresh(30), passage + " " + fresh(9), fresh(300), few + " " + fresh(90), fresh(60) + " " + few, short, fresh(20) + "\t" + short + " " + fresh(3), "a b c", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_shared for r in substring_dedup.dedup_substrings(df).collect()}
    assert {i for i, n in got.items() if n} == {0, 1, 5, 6} and len(got) == len(texts)


def test_word_hashes(monkeypatch):
    texts = [b"ab  c\td ", b"x", b"", b"y z", b"long" * 300]
    ends = np.cumsum([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), np.uint8)
    h, upto = substring_dedup.word_hashes(b, np.concatenate([[0], ends[:-1]]), ends)
    each = [w for t in texts for w in t.split()]
    assert len(h) == len(each) and upto.tolist() == np.cumsum([len(t.split()) for t in texts]).tolist()
    assert [h[i] == h[j] for i in range(7) for j in range(i)] == [each[i] == each[j] for i in range(7) for j in range(i)]
    monkeypatch.setattr(substring_dedup, "CHUNK", 7)
    assert (substring_dedup.word_hashes(b, np.concatenate([[0], ends[:-1]]), ends)[0] == h).all()


def test_long_texts_by_parts():
    data = np.frombuffer(bytes(random.choice(b"abcdefgh") for _ in range(9000)) + b"ab" * 800, np.uint8)
    whole = substring_dedup.anchors(data, np.zeros(1, np.int64), np.array([len(data)]))
    parts = substring_dedup.long_anchors(data, chunk=700)
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) > 50


def test_embeddings_of_many_lengths(spark, empty):
    rng = np.random.default_rng(5)
    base = {d: rng.normal(size=d) for d in range(1, 71)}
    rows = [(d * 10 + i, (base[d] + rng.normal(size=d) * 0.001).tolist(), 1, "x") for d in base for i in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rid string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.neighbours(df).collect()}
    assert got == {d * 10 + i: (1, d * 10) for d in base for i in range(2)}
    assert embed_dedup.neighbours(df.where("false")).count() == 0


@pytest.mark.parametrize("cell", [2000, 20])
def test_embeddings(spark, monkeypatch, cell):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.3])).astype("float32").tolist(), int(i % 2)) for i in range(400)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [None, *rows[0][1][1:]], 0), (505, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows[:400]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:400]])
    hit = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :]) & ~np.eye(400, dtype=bool)
    comp = union_find(400, list(zip(*np.nonzero(hit))))
    want = {i: (int(hit[i].sum()), comp[i]) for i in range(400)} | {i: (0, i) for i in range(500, 506)}
    assert got == want


def test_sampling(spark, docs, empty):
    e = sp_sampling.encode_samples(docs, samples=3)
    rows = sp_sampling.decode(e).collect()
    assert all(r.decoded == TEXTS[r.doc_id] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(tuple(r.ids))
        assert 0 <= r.inclusion <= 1 and r.logp <= 1e-9
    assert 0 not in by and by[1] == [()] and all(len(set(v)) == len(v) for v in by.values()) and len(by[3]) == 3
    again = {(r.doc_id, r.sample): r.ids for r in sp_sampling.encode_samples(docs, samples=3).collect()}
    assert all(again[r.doc_id, r.sample] == r.ids for r in rows)
    assert sp_sampling.encode_samples(empty).count() == 0


PIECES = sp_sampling.pieces_of()


def segmentations(t, lattice):
    """Every way to write a prepared text in pieces, as (ids, log of its weight)."""
    at = {p: i for i, p in enumerate(PIECES) if not re.fullmatch("<.*>", p)}
    if not t:
        return [((), 0.0)]
    out = []
    for n in range(1, len(t) + 1):
        i = at.get(t[:n])
        if i is None and n > 1:
            continue
        ids = (i,) if i is not None else tuple(lattice.byte0 + x for x in t[0].encode())
        w = lattice.weight[i] if i is not None else len(ids) * lattice.byte_weight
        out += [(ids + more, w + v) for more, v in segmentations(t[n:], lattice)]
    return out


@pytest.mark.parametrize("text", ["the cat", "zqx é", "ab  c", "_inform", "ofonha\nthe"])
def test_sampling_covers_the_whole_lattice(text):
    lattice = sp_sampling.Lattice(PIECES)
    units = lattice.units(text)
    assert "".join(units) == lattice.prepared(text)
    every = segmentations(lattice.prepared(text), lattice)
    total = np.logaddexp.reduce([w for _, w in every])
    p = {ids: np.exp(w - total) for ids, w in every}
    rows, n = lattice.rows([units])[0], 4000
    first, weighed = Counter(), Counter()
    for got in lattice.sample([rows] * n, 3, list(range(n))):
        paths = [tuple(lattice.ids_of([e])[0].tolist()) for e, _, _ in got]
        assert len(set(paths)) == len(paths) == min(3, len(p))
        first[paths[0]] += 1
        for ids, (_, logp, inclusion) in zip(paths, got):
            assert abs(logp - np.log(p[ids])) < 1e-9
            weighed[ids] += np.exp(logp) / inclusion
    for ids in sorted(p, key=p.get)[-4:]:
        assert abs(first[ids] / n - p[ids]) < 0.03 and abs(weighed[ids] / n - p[ids]) < 0.03
    whole = lattice.sample([rows], len(p) + 3, [5])[0]
    assert {tuple(lattice.ids_of([e])[0].tolist()) for e, _, _ in whole} == set(p) and {q for *_, q in whole} == {1.0}


def test_sampling_with_little_memory(monkeypatch):
    texts = [words(40) for _ in range(30)]
    run = lambda x: [[(x.ids_of([e])[0].tolist(), round(p, 9), round(q, 9)) for e, p, q in x.sample(x.rows([x.units(t)]), 2, [i])[0]] for i, t in enumerate(texts)]
    want = run(sp_sampling.Lattice(PIECES))
    monkeypatch.setattr(sp_sampling, "REMEMBERED", 700)
    little = sp_sampling.Lattice(PIECES)
    assert run(little) == want and len(little.first) < 1200


def test_sampling_does_not_depend_on_neighbours():
    texts = [words(30), "", "a", words(200), "▁ ▁▁  x", "y" * 3000]
    each = []
    for group in ([0, 1, 2, 3, 4, 5], [5, 3], [4, 2, 1, 0]):
        lattice = sp_sampling.Lattice(PIECES)
        got = lattice.sample(lattice.rows([lattice.units(texts[i]) for i in group]), 3, [i + 1 for i in group])
        each.append({i: [(lattice.ids_of([e])[0].tolist(), round(p, 6), round(q, 9)) for e, p, q in g] for i, g in zip(group, got)})
    assert all(each[0][i] == v for other in each[1:] for i, v in other.items())
    assert sp_sampling.Lattice(PIECES).units("a   b") == ["▁a", "▁▁▁b"]  # pieces of several marks can be drawn


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    from tests.test_queries import TABLES, rows

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = c.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert rows([r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]) == rows([dict(zip(names, r)) for r in cur.fetchall()])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, kept = Scratch(spark), docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, scratch.cut(stage(spark, kept, SF))
        assert kept.columns == docs.columns
        if name == "line_dedup":
            assert kept.count() == before.count()
        if name == "simhash_near_dedup":
            g = {r.doc_id: (fingerprint(r.text, 5), r.doc_id) for r in before.select("doc_id", "text").collect()}
            ids = sorted(g)
            edges = [(a, b) for a in range(len(ids)) for b in range(a) if (g[ids[a]][0] ^ g[ids[b]][0]).bit_count() <= 6]
            comp = union_find(len(ids), edges)
            assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for k, i in enumerate(ids) if comp[k] == k}
    got = corpus_pipeline.STAGES[4][1](spark, kept, SF)
    assert got.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def tables_at(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def first_lines(docs):
    """Line dedup by hand: of each component of lines the first place by (doc_id, text hash, line) stays."""
    uniq = sorted({x for _, t in docs for x in (t or "").split("\n") if x})
    sets = [line_set(x) for x in uniq]
    comp = dict(zip(uniq, union_find(len(uniq), [(a, b) for a in range(len(uniq)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])))
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        kept = []
        for x in (t or "").split("\n"):
            if not x or comp[x] not in seen:
                kept.append(x)
            if x:
                seen.add(comp[x])
        out[i] = None if t is None else "\n".join(kept)
    return out


def near_kept(texts):
    ids = sorted(texts)
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or "").split() for i in ids}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in low.items()}
    fp = {i: fingerprint(texts[i], 5) for i in ids}
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 6 or bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = union_find(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if near(ids[a], ids[b])])
    return {ids[i]: texts[ids[i]] for i, c in enumerate(comp) if c == i}


def copies_by_hand(docs):
    """Copies of each document (id, text, source): targets by water-filling, of sixteen seeds the one that lands nearest."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    names = sorted({s for *_, s in docs if s is not None}) + ([None] if any(s is None for *_, s in docs) else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    have = {s: sum(size[i] for i, _, x in docs if x == s) for s in names}
    total, capped = sum(have.values()), set()
    while True:
        left, w = total - sum(3 * have[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and 3 * have[s] * w <= weight[s] * left}
        if not more:
            break
        capped |= more
    target = {s: 3.0 * have[s] if s in capped else weight[s] * left / w for s in names}
    draw = lambda i, j: int(hashlib.md5(f"mix-1:{j // 4}:{i}".encode()).hexdigest()[j % 4 * 8 : j % 4 * 8 + 8], 16) / 2**32
    out = {}
    for s in names:
        rate = target[s] / have[s] if have[s] else 0.0
        whole, frac = int(rate), rate - int(rate)
        of = [i for i, _, x in docs if x == s]
        best = min(range(16), key=lambda j: (abs(sum(size[i] * (whole + (draw(i, j) < frac)) for i in of) - target[s]), j))
        out |= {i: whole + (draw(i, best) < frac) for i in of}
    return out


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline

    base = [words(120) for _ in range(6)]
    rows = []
    for i in range(24):
        w = base[i % 6].split()
        for _ in range(i % 3):
            w[random.randrange(120)] = f"n{i}"
        lines = [" ".join(w[:40]), "a line that many documents share", " ".join(w[40:]) + f" only{i}", words(200 + i)]
        rows.append((i, "\n".join(lines[: 4 if i % 2 else 3]), "en", f"s{i % 4}" if i % 5 else None, 7))
    rows += [(90, None, "en", "s0", None), (91, "", "en", "s0", 0), (92, "vile " * 6 + words(60), "en", "s1", 1)]
    labels = [(i, 1, 0) for i in range(24)] + [(92, 1, 1)]
    clean = [r for r in rows if r[0] != 92]
    sf = tables_at(spark, tmp_path, rows, labels)
    model = toxicity.Model(["vile"], [4.0], [1.0, 2.0], 0.5)
    kept = {r.doc_id for r in toxicity.reject(spark.read.parquet(f"{sf}/documents.parquet"), model).collect()}
    assert kept == {r[0] for r in clean}
    sf = tables_at(spark, tmp_path / "clean", clean, [])
    lines = first_lines([(r[0], r[1]) for r in clean])
    left = near_kept(lines)
    copies = copies_by_hand([(r[0], left[r[0]], r[3]) for r in clean if r[0] in left])
    want = Counter({i: 2 * n if left[i] else n for i, n in copies.items() if n and left[i] is not None})
    out = sp_sampling.decode(corpus_pipeline.run(spark, sf)).collect()
    assert Counter(r.doc_id for r in out) == want and all(r.decoded == left[r.doc_id] for r in out)


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, tables_at(spark, tmp_path / "none", [], [])).count() == 0
    rows = [(None, None, None, None, None), (None, "some words", None, None, None), (1, "", "x", "y", 0), (2, "twice", "x", "y", 5), (2, "twice", "x", "y", 5), (3, "long " * 40_000, "x", "y", 1)]
    out = corpus_pipeline.run(spark, tables_at(spark, tmp_path / "odd", rows, [(1, None, None), (None, 1, 1)]))
    assert out.columns == ["doc_id", "sample", "ids", "logp", "inclusion"] and out.where("inclusion < 0 or inclusion > 1 or logp > 1e-9").count() == 0
    clash = ["gone", "_key", "bad", "p_toxic", "severity", "_n_lines", "_removed", "_lines", "_row", "mix_note", "id", "fp", "component_id", "c0", "__0", "key", "size"]
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet").select("*", *[F.lit(n).alias(n) for n in clash])
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = Scratch(spark).cut(stage(spark, docs, str(tmp_path / "odd")))
        assert docs.columns[5:] == clash and all(tuple(r)[5:] == tuple(clash) for r in docs.collect()), name


def test_wide_inputs(spark, docs):
    names = ["fp", "component", "node", "rid", "lo", "key", "digest", "_maybe", "url2", "tokens", "hs", "n"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for f in (simhash.groups, lsm_dedup.exact_dedup, substring_dedup.dedup_substrings, sp_sampling.encode_samples):
        assert f(wide).count() == f(docs).count()
    pages = spark.createDataFrame([(1, "http://a.net/es/x", "q"), (None, None, "q")], "page_id long, url string, host string")
    assert {r.verdict for r in url_rules.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()} == {"block", "allow"}
