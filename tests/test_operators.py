import io
import re
import struct
import zipfile

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import notes as N
from plumbline.operators import pages as P
from plumbline.operators import quality as Q
from plumbline.operators import search as S
from plumbline.operators import status as ST
from plumbline.operators import verify as V
from plumbline.sources import containers, files
from plumbline.sources.html import read_html


def test_ladder(spark):
    books = spark.createDataFrame([(1, "He said “one two three four five six seven” and left.\nThen more."), (2, None), (3, "")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "said “one two three four five six seven” and"), (2, "left. Then more."), (3, "THEN, MORE!"), (4, "absent"), (5, "one two three four five six seven")], "item_id int, quote string")
    got = {r.item_id: (r.level, r.doc_id) for r in V.outcome(quotes, V.ladder(quotes, books)).collect()}
    assert got == {1: ("NORMALIZED", 1), 2: ("NORMALIZED", 1), 3: ("PUNCT", 1), 4: (None, None), 5: ("EXACT", 1)}


def test_many_quotes_go_in_blocks(spark, monkeypatch):
    books = spark.createDataFrame([(1, "alpha beta gamma. delta epsilon zeta eta theta iota kappa"), (2, None)], "doc_id int, text string")
    texts = ["beta gamma", "BETA, GAMMA!", "delta; epsilon", "absent", "none here", "theta", "Iota. Kappa", "delta epsilon zeta eta theta iota kappa"]
    quotes = spark.createDataFrame(list(enumerate(texts)), "item_id int, quote string")
    elided = spark.createDataFrame(list(enumerate(["alpha beta gamma ... delta epsilon", "beta gamma. delta ... zeta eta theta", "theta iota kappa ... alpha beta gamma", "epsilon zeta eta", "ALPHA, BETA GAMMA ... DELTA-EPSILON"])), "item_id int, quote string")
    rows = lambda: (sorted(V.ladder(quotes, books).collect()), sorted(V.ladder(elided, books).collect()))
    want = rows()
    assert len(want[0]) == 6 and [(r.item_id, r.level) for r in want[1]] == [(0, "EXACT"), (1, "EXACT"), (3, "EXACT"), (4, "PUNCT")]
    monkeypatch.setattr(V, "BROADCAST_ROWS", 2)
    assert rows() == want


def test_containment(spark, monkeypatch):
    import random

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    books = [(i, text(400)) for i in range(12)] + [(20, ""), (21, None), (22, "x" * 50)]
    quotes = [(i, books[i % 12][1][a : a + n]) for i, (a, n) in enumerate([(0, 30), (100, 16), (370, 30), (50, 15), (7, 1), (200, 60), (3, 17)])] + [(50, "x" * 20), (51, text(40)), (52, "x" * 51)]
    b, q = spark.createDataFrame(books, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, q string")
    want = sorted((i, d) for i, x in quotes for d, t in books if t and x in t)
    got = lambda: sorted((r.item_id, r.doc_id) for r in V.contained(q, b.where("text is not null"), "q", "text", "item_id", "doc_id").collect())
    assert got() == want
    monkeypatch.setattr(V, "BROADCAST_ROWS", 3)
    assert got() == want


def test_verification_record(spark):
    text = "Chapter one says “one two three four” and no more.\nThe second line,  with spaces; it ends here.\nA third line closes."
    books = spark.createDataFrame([("b", text)], "slug string, text string")
    pages = V.line_segments(books, "slug")
    chapters = pages.where("pos < 3").groupBy("slug").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("label", F.lit("ch1")).withColumn("pos", F.lit(1))
    notes = [("n1", "second line", "ch1 / p.2", "claim", None), ("n2", "line, with spaces", "p.2", "claim", None), ("n3", "THIRD LINE CLOSES", "ch9 / p.9", "claim", None), ("n4", "absent words", "p.1", "claim", None),
             ("n5", "says \"one two three ... line, with spaces", "p.1", None, None), ("n6", None, "p.1", "figure", "a.png"), ("n7", None, "p.1", "figure", "gone.png"), ("n8", "A third", "ch2 / p.4", "claim", None), ("n9", "nine", "p.1", "claim", None)]
    df = spark.createDataFrame([("b", *n) for n in notes] + [("zz", "n1", "any", "p.1", "claim", None)], "slug string, id string, quote string, locator string, kind string, evidence string")
    r = V.verify_notes(df, books, pages, chapters, spark.createDataFrame([("b", "a.png")], "slug string, path string"))
    got = {(x.slug, x.id): x for x in r.collect()}
    short = {k[1]: (x.status, x.level, x.found_at, x.found_locator) for k, x in got.items() if k[0] == "b"}
    assert short["n1"] == ("PASS", "EXACT", text.index("second"), "ch1 / p.2")
    assert short["n2"] == ("PASS", "NORMALIZED", text.index("line,  with"), "ch1 / p.2")
    assert short["n3"] == ("LOCATOR_MISMATCH", "PUNCT", text.index("third"), "p.3") and got["b", "n3"].issues == ["locator says 'ch9 / p.9' but the quote is at 'p.3'", V.BY_LETTERS]
    assert short["n4"] == ("FAIL", None, None, None) == short["n9"] and got["b", "n4"].issues == [V.NO_QUOTE]
    assert short["n5"] == ("PASS", "NORMALIZED", text.index("says"), "ch1 / p.1")
    assert short["n6"] == ("FIGURE", "IMAGE", None, "p.1") and got["b", "n6"].evidence_path == "a.png" and short["n7"][0] == "FAIL"
    assert short["n8"][0] == "LOCATOR_MISMATCH" and got["zz", "n1"].status == "FAIL"
    rep = {x.slug: x for x in V.report(r, "slug", strict=True).collect()}
    assert rep["b"].must_drop == ["n3", "n4", "n7", "n8", "n9"] and not rep["b"].ok and rep["b"].levels == {"EXACT": 2, "NORMALIZED": 2, "PUNCT": 1}
    assert rep["b"].counts == {"FAIL": 3, "FIGURE": 1, "LOCATOR_MISMATCH": 2, "PASS": 3}


def test_report_reads_the_records_once(spark):
    rows = [("b", "n2", "FAIL", None), ("b", "n1", "PASS", "PUNCT"), ("b", "n1", "PASS", "PUNCT"), ("b", None, "PASS", "EXACT"), ("c", None, "FAIL", None), ("d", "n1", "PASS", "NORMALIZED")]
    r = spark.createDataFrame(rows, "slug string, id string, status string, level string")
    got = lambda strict: {x.slug: (x.notes, x.counts, x.levels, x.must_drop, x.ok) for x in V.report(r, strict=strict).collect()}
    none = {"EXACT": 0, "NORMALIZED": 0, "PUNCT": 0}
    b, c, d = (4, {"FAIL": 1, "PASS": 3}, {**none, "EXACT": 1, "PUNCT": 2}), (1, {"FAIL": 1}, none, [], False), (1, {"PASS": 1}, {**none, "NORMALIZED": 1}, [], True)
    assert got(False) == {"b": (*b, ["n2"], False), "c": c, "d": d} and got(True) == {"b": (*b, ["n1", "n2"], False), "c": c, "d": d}
    assert plan(V.report(r, strict=True)).count("LogicalRDD") == 1


def test_locate_and_mismatch(spark):
    books = spark.createDataFrame([(1, "ab\ncd\n\nx")], "doc_id int, text string")
    seg = V.line_segments(books)
    assert [(r.label, r.start, r.end) for r in seg.orderBy("pos").collect()] == [("p.1", 0, 3), ("p.2", 3, 6), ("p.3", 6, 7), ("p.4", 7, 8)]
    at = spark.createDataFrame([(1, 0), (1, 6), (1, 99)], "doc_id int, found_at int")
    assert {r.found_at: r.label for r in V.locate(at, seg).collect()} == {0: "p.1", 6: "p.3", 99: None}
    pairs = spark.createDataFrame([("ch3 / p.9", "ch3 / p.1"), ("p.2", "p.3"), ("somewhere", "p.3")], "c string, a string")
    assert [r.m for r in pairs.select(V.mismatch("c", "a").alias("m")).collect()] == [False, True, False]


def test_quality(spark):
    bodies = ["word " * 40, "x" * 79, "ab" * 40, "%&" * 50 + "words here", "ok " * 30, "w " * 45 + "�" * 2]
    rows = [(1, i, f"p.{i}", b) for i, b in enumerate(bodies, 1)]
    m = Q.metrics(spark.createDataFrame(rows, "book int, pos int, label string, body string"))
    j = {r.pos: r.verdict for r in Q.verdicts(m, "book").collect()}
    assert j == {1: "OK", 2: "EMPTY", 3: "GARBLED", 4: "GARBLED", 5: "OK", 6: "GARBLED"}
    b = Q.books(Q.verdicts(m, "book"), "book").first()
    assert (b.overall, b.sections, b.fail_rate) == ("UNUSABLE", 6, 0.667)
    assert [r.label for r in Q.excluded(Q.verdicts(m, "book"), "book", "pos").orderBy("rank").collect()] == ["p.3", "p.4", "p.6", "p.2"]


def test_sections_are_scored_once_for_a_report(spark):
    from plumbline.operators import reports as R

    sec = spark.createDataFrame([("b", 1, "p.1", "word " * 40, False), ("b", 2, "p.2", "x", True), ("b", 3, "p.3", "ab" * 40, True)], "slug string, pos int, label string, body string, has_figure boolean")
    known = spark.range(1).select(F.lit("b").alias("slug"), F.lit("native").alias("provenance"), F.lit(300).alias("total_chars"))
    r = R.extraction(Q.metrics(sec), known)
    assert [(x.sections, x.ok, x.garbled, x.visual, x.image_only_labels, x.excluded, x.passes) for x in r.collect()] == [(3, 1, 1, ["p.2", "p.3"], ["p.2"], ["p.3"], False)]
    assert plan(r).count("LogicalRDD") == 1


def brute_hits(books, terms):
    out, seen = [], set()
    for b, text in books:
        for t in terms:
            for mode in ("norm", "alnum"):
                view, idx, space = "", [], False
                for i, c in enumerate(text):
                    if mode == "alnum":
                        if c.isalnum():
                            view += c.lower()
                            idx.append(i)
                    elif not (c.isspace() and space):
                        view += " " if c.isspace() else c.lower()
                        idx.append(i)
                    space = c.isspace()
                needle = re.sub(r"[^a-z0-9]", "", t.lower()) if mode == "alnum" else t.lower()
                for m in re.finditer(f"(?={re.escape(needle)})", view):
                    if (b, idx[m.start()] // 8) not in seen:
                        seen.add((b, idx[m.start()] // 8))
                        out.append((b, t, mode, idx[m.start()]))
    return sorted(out)


def test_search(spark):
    books = [(1, "The improve-\nment of  the the cat. aaaa THE CAT"), (2, "nothing"), (3, "")]
    df = spark.createDataFrame(books, "doc_id int, text string")
    terms = ["improvement", "the the", "aa", "cat"]
    found = S.hits(df, terms, V.line_segments(df))
    assert sorted((r.doc_id, r.term, r["mode"], r.offset) for r in found.collect()) == brute_hits(books, terms)
    assert S.top(found, 1).first().snippet.startswith("The improve- ment of the the cat")
    assert {(r.locator, r.hits) for r in S.sections(found).collect()} == {("p.1", 1), ("p.2", found.count() - 1)}
    even = spark.createDataFrame([(1, "\n" * i + "cat" + "\n" * (12 - i)) for i in range(0)] + [(1, "\n".join(["cat"] * 12))], "doc_id int, text string")
    assert [r.locator for r in S.densest(S.sections(S.hits(even, ["cat"], V.line_segments(even)))).collect()] == [f"p.{i}" for i in range(1, 13, 2)][:8] + []
    assert S.hits(df, [" "], V.line_segments(df)).count() == 0
    total = S.top(found, 2).collect()
    assert len(total) == 2 and {r.total for r in total} == {found.count()}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_not_read_for_each_of_its_lines_or_hits(spark):
    text = "ab\n" * 700 + "cat"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x"), (4, "\n😀b\n")], "doc_id int, text string")
    seg = V.line_segments(df)
    assert [(r.doc_id, r.pos, r.start, r.end) for r in seg.where("doc_id > 1").orderBy("doc_id", "pos").collect()] == [(2, 1, 0, 0), (3, 1, 0, 1), (4, 1, 0, 1), (4, 2, 1, 4), (4, 3, 4, 4)]
    assert [(r.start, r.end) for r in seg.where("doc_id = 1").orderBy("pos").collect()] == [(3 * i, 3 * i + 3) for i in range(701)]
    # what stands above the rows of lines or hits must not use the whole text
    assert all("text" not in line for line in plan(seg).split("Generate")[0].splitlines())
    hits = S.hits(df, ["ab", "cat"])
    assert hits.count() == 76 and hits.where("term = 'cat'").first().offset == 2100
    assert all("_text" not in x.split("[")[1] for x in plan(hits).splitlines() if "Generate explode" in x and "decode" in x)
    assert "posexplode" not in plan(hits)


def test_offsets_meet_segments_of_their_stretch_alone(spark, monkeypatch):
    import random

    rng = random.Random(5)
    seg = [(b, i, f"s{i}", a, a + rng.choice([0, 1, 50, 3000])) for b in (1, 2) for i, a in enumerate(sorted(rng.randrange(9000) for _ in range(40)))]
    off = [(b, o) for b in (1, 2, 3) for o in [*(rng.randrange(12000) for _ in range(60)), 0, 1023, 1024, 8999]] + [(1, None)]
    want = {(b, o, next((s[2] for s in seg if o is not None and s[0] == b and s[3] <= o < s[4]), None)) for b, o in off}
    at, segments = spark.createDataFrame(off, "doc_id int, found_at int"), spark.createDataFrame(seg, "doc_id int, pos int, label string, start int, end int")
    got = V.locate(at, segments)
    assert {(r.doc_id, r.found_at, r.label) for r in got.collect()} == want
    assert "explode(sequence" in plan(got)
    monkeypatch.setattr(V, "STRETCH", 7)
    assert {(r.doc_id, r.found_at, r.label) for r in V.locate(at, segments).collect()} == want


def test_html(spark):
    html = '<html><head><title>no</title><script>var a = "</p>";</script></head><body><h1>7</h1><h2>Name &amp; co</h2><p>One<br>two</p><!-- x --></body></html>'
    r = spark.createDataFrame([(html,)], "h string").select(T.html_text(F.col("h")).alias("t"), T.html_title(F.col("h")).alias("n")).first()
    p = read_html(html)
    assert r.t == p.text and r.n == p.title == "7. Name & co"
    assert read_html("<head><p>never closed").text == "" and read_html("<p>a<br/>b<br>c").text == "a\n\nb\nc"
    assert read_html("<h1>In <i>two</i> pieces</h1>").title == "In. two" and read_html("<h1>" + "x" * 200).title == "x" * 120


def test_notes(spark):
    good = '{"id":"n1","claim":"c","quote":"q","locator":"ch10 / p.2","kind":"claim","scope":"core","speaker":"cited"}'
    lines = ["", "// remark", "{bad", good, good.replace('"n1"', '""'), good.replace("claim\",\"scope", "figure\",\"scope"), good.replace('"core"', '"odd"').replace("n1", "n2").replace("ch10", "ch3")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line_no int, line string")
    got = {r.line_no: (r.kept, r.errors) for r in N.parse(df).collect()}
    assert got == {3: (False, ["line 3: invalid JSON"]), 4: (True, []), 5: (False, ["line 5: missing fields id"]), 6: (False, ["line 6: missing fields evidence"]), 7: (True, ["line 7: bad scope 'odd'"])}
    notes = N.notes_of(N.parse(df)).withColumn("k", F.lit(1))
    md = [r.md for r in N.render(notes, "k").orderBy("place").collect()]
    assert md[0].startswith("## ch3\n\n### n2") and "**Attribution: someone" in md[0] and md[1].startswith("## ch10\n\n### n1")


def test_status_and_pages(spark):
    b = spark.createDataFrame([("a", 0, False, 0), ("b", 3, True, 0), ("c", 3, False, 1000 - 899), ("d", 3, False, 1000 - 900)], "slug string, notes long, brief boolean, notes_mtime long")
    s = ST.states(b, F.lit(1000))
    assert {r.slug: r.state for r in s.collect()} == {"a": "extracted", "b": "studied", "c": "in-progress", "d": "notes-only"}
    assert [r.ord for r in ST.next_actions(s).orderBy("ord", "slug").collect()] == [1, 2, 2]
    done = s.where("slug = 'b'")
    last = lambda *a: [r.action for r in ST.next_actions(*a).collect()]
    assert last(done, None, "stale") == [ST.AGAIN] and last(done) == [ST.READY] and last(done.unionByName(done)) == [ST.SYNTHESIZE]
    more = spark.createDataFrame([("y.pdf",), ("x.pdf",)], "stem string")
    assert last(done, more, "stale") == [ST.EXTRACT % (2, "x.pdf, y.pdf")]
    stems = spark.createDataFrame([("a-book",), ("my a",), ("zzz",), ("",), (None,)], "stem string")
    assert sorted(str(r.stem) for r in ST.unextracted(stems, s).collect()) == ["", "None", "zzz"]
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert get(P.parse_pages(F.lit("4,12,,40-44,12"))) == [4, 12, 40, 41, 42, 43, 44]
    assert get(P.evenly_spaced(F.lit(10), F.lit(3))) == [1, 4, 7]
    assert get(P.evenly_spaced(F.lit(2), F.lit(5))) == [1, 2]
    img = spark.createDataFrame([(1, "page num type width height"), (2, "----"), (3, "1 0 image 199 300"), (4, "1 1 image 200 100"), (5, "2 0 smask 900 900"), (6, "2 1 image 700 900"), (7, "x y")], "line_no int, line string")
    inv = {r.page: (r["count"], r.figure, r.full_page) for r in P.inventory(P.image_rows(img)).collect()}
    assert inv == {1: (2, True, False), 2: (1, True, True)}
    assert get(P.provenance(F.lit(None).cast("string"), F.lit(8), F.lit(10), F.lit(24_999))) == "ocr-suspected"
    assert get(P.provenance(F.lit("ABBYY"), F.lit(0), F.lit(0), F.lit(0))) == "ocr"


def mobi(text: bytes, packing=1, locked=0):
    head = struct.pack(">HHIHHHH", packing, 0, len(text), 1, 4096, locked, 0)
    first = 78 + 16
    table = struct.pack(">I4sI4s", first, b"", first + len(head), b"")
    return b"x" * 60 + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", 2) + table + head + text


def test_containers(spark, tmp_path):
    body = "<body><h1>One</h1><p>" + "first words " * 40 + "</p></body><body><h1>Two</h1><p>" + "more words " * 20 + "</p></body>"
    (tmp_path / "A Book.azw3").write_bytes(mobi(body.encode()))
    (tmp_path / "locked.mobi").write_bytes(mobi(body.encode(), locked=1))
    (tmp_path / "huff.prc").write_bytes(mobi(body.encode(), packing=17480))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("o/p.opf", '<package xmlns="x"><manifest><item href="a.xhtml" id="a"/><item id="b" media-type="m" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="none"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<h1>Alpha</h1><p>the text of the first item</p>")
        z.writestr("o/b.xhtml", "<h1>Beta</h1><p>the text of the second item</p>")
    (tmp_path / "e.epub").write_bytes(b.getvalue())
    (tmp_path / "notes.docx").write_bytes(b"?")
    s = containers.sections(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = s.collect()
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.error} == {"locked.mobi": "DRM protected", "huff.prc": "HUFF/CDIC compression is not supported", "notes.docx": "unknown format .docx"}
    assert [r.title for r in sorted(rows, key=lambda r: r.pos or 0) if r.path.endswith("epub")] == ["Beta", "Alpha"]
    books, chapters = containers.books(spark, str(tmp_path))
    text = {r.slug: r.text for r in books.collect()}
    assert set(text) == {"a-book", "e"}
    for c in chapters.collect():
        assert text[c.slug][c.start : c.end] == c.body + "\n\n"


def test_palmdoc():
    assert containers.unpack(b"abc\x80\x18") == b"abcabc"
    assert containers.unpack(b"\x02\x80\x81x\xe1") == b"\x80\x81x a"
    assert containers.unpack(b"ab\xbf\xff") == b"ab"
    assert containers.trim(b"text\x01\x82", 0b10) == b"text"
    assert containers.trim(b"text\x00", 0b1) == b"text"


def test_outline_spans(spark):
    spans = spark.createDataFrame([("b", i + 1, 100 * i, 100 * i + 100) for i in range(5)], "slug string, pos int, start int, end int")
    o = spark.createDataFrame([("b", 2, "Two", 1), ("b", 0, " One ", 0), ("b", 2, "Also two", 2), ("b", 4, " ", 3)], "slug string, page int, title string, ord int")
    got = [(r.label, r.title, r.start, r.end) for r in P.outline_spans(o, spans).orderBy("start").collect()]
    assert got == [("ch1", "One", 0, 200), ("ch2", "Also two", 200, 500)]


def test_books_need_a_map(spark, tmp_path):
    for name, text in (("a", "text of a"), ("b", "text of b"), ("c", "no map")):
        (tmp_path / f"{name}.txt").write_text(text)
    for name in "ab":
        (tmp_path / f"{name}.map.json").write_text('{"kind":"pdf","slug":"%s","total_chars":9,"provenance":"native","pages":[{"label":"p.1","start":0,"end":9}]}' % name)
    got = {r.slug: (r.text, r.kind, r.pages[0].label) for r in files.load_books(spark, str(tmp_path)).collect()}
    assert got == {"a": ("text of a", "pdf", "p.1"), "b": ("text of b", "pdf", "p.1")}
    assert [r.slug for r in files.load_books(spark, str(tmp_path), ["b"]).collect()] == ["b"]
    books = files.load_books(spark, str(tmp_path)).select("slug", "text")
    files.write_books(books, V.line_segments(books, "slug"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/books")).count() == spark.read.parquet(str(tmp_path / "out/segments")).count() == 2
    files.write_jsonl(books.withColumn("_line", F.lit(1)), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["slug", "text"]
    (tmp_path / "topic.config.yaml").write_text("title: x")
    assert files.find_topic(str(tmp_path / "out")) == str(tmp_path) and {r.stem for r in files.sources(spark, str(tmp_path)).collect()} == set()


def test_files(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('\n{"id":"a"}\n')
    (tmp_path / "c.yaml").write_text('title: "My: topic" # remark\ndepth: deep\nother: x\n')
    notes, errors = files.read_notes(spark, str(tmp_path / "n.jsonl"))
    assert notes.count() == 0 and errors.first().error.startswith("line 2: missing fields claim, locator")
    assert {r.key: r.value for r in files.config(spark, str(tmp_path / "c.yaml")).collect()} == {"title": "My: topic", "depth": "deep"}
    assert files.rejected(spark, str(tmp_path / "n.jsonl")).first().rejected == 1
    pages = containers.pdf_pages(spark.createDataFrame([("s", "one\ftwo\f")], "slug string, raw string"))
    assert [(r.pos, r.body) for r in pages.collect()] == [(1, "one"), (2, "two")]
    spans = P.page_spans(pages, "slug", "pos", "body").orderBy("pos").collect()
    assert [(r.start, r.end) for r in spans] == [(0, 4), (4, 7)]
