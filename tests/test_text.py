import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.unicode_tables import fold_table

SAMPLES = ["", "plain text", "“Quoted” — don’t…", "soft­hyphen", "café CAFÉ ﬁn ① İstanbul é", "tab\t\n\x1c x", "한국어 ½ ℡", "a😀b", "......... ___ ééé %%%"]


def norm(s):
    fold = fold_table()
    return re.sub(r"\s+", " ", "".join(fold[c] if c in fold else unicodedata.normalize("NFKC", c) for c in s))


def alnum(s):
    fold = fold_table()
    out = "".join(fold[c] if c in fold else unicodedata.normalize("NFKC", c) for c in s)
    return "".join(e for c in out if c.isalnum() for e in unicodedata.normalize("NFKD", c.lower()) if e.isalnum())


def test_norm_alnum_leader(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    rows = df.select("i", T.norm(F.col("s")).alias("n"), T.alnum(F.col("s")).alias("a"), T.leader_collapse(F.col("s")).alias("l")).orderBy("i").collect()
    for r, s in zip(rows, SAMPLES):
        assert r.n == norm(s)
        assert r.a == alnum(s)
        assert r.l == re.sub(r"([^\sa-zA-Z0-9])\1{2,}", r"\1", s)


def test_classes_are_nested(spark):
    from plumbline.functions.unicode_tables import changes

    every = "".join(chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000)
    df = spark.createDataFrame([(every,)], "s string")
    for kind in ("norm", "alnum"):
        one, _, gone, longer = changes(kind)
        held = {*one, *gone, *(a for a, _ in longer)}
        # a flat class has hundreds of ranges, and each character of a text goes through all of them
        assert max(x.count("-") for x in re.findall(r"\[([^][]+)\]", T._changed(kind))) <= 2
        left = df.select(F.regexp_replace("s", T._changed(kind), "").alias("x")).first().x
        assert left == "".join(c for c in every if c not in held)


def test_offsets_map_back(spark):
    text = "x “im­prove-\nment” café 😀 improvement"
    row = spark.createDataFrame([(text,)], "t string").select(T.raw_offsets(F.col("t"), T.find_all(T.alnum(F.col("t")), "improvement", 9), F.lit("alnum")).alias("o")).first()
    assert [text[o : o + 2] for o in row.o] == ["im", "im"]


def test_every_offset_maps_back(spark):
    texts = [s for s in SAMPLES if s] + ["a \xa0 b  \n c", "ﬁ½ x", "\xad\xada b"]
    for mode, form in (("norm", norm), ("alnum", alnum)):
        df = spark.createDataFrame([(t, list(range(len(form(t))))) for t in texts], "t string, p array<int>")
        for r in df.select("t", T.raw_offsets(F.col("t"), F.col("p"), F.lit(mode)).alias("o")).collect():
            # the text up to the character that a position comes from gives at least that much, and without it no more
            for p, o in enumerate(r.o):
                assert len(form(r.t[: o + 1])) > p >= len(form(r.t[:o])) or mode == "norm" and r.t[o].isspace()
    row = spark.createDataFrame([("abc", [1], None)], "t string, p array<int>, m string").select(T.raw_offsets(F.col("t"), F.col("p"), F.col("m")).alias("o")).first()
    assert row.o == [1]


@pytest.mark.parametrize(
    ("text", "parts", "found"),
    [
        ("aaaaaaaaaaaa middle bbbbbbbbbbbb", ["aaaaaaaaaaaa", "bbbbbbbbbbbb"], (True, 0, 32)),
        ("aaaaaaaaaaaa" + "-" * 3001 + "bbbbbbbbbbbb", ["aaaaaaaaaaaa", "bbbbbbbbbbbb"], (False,)),
        ("aaaaaaaaaaaa" + "-" * 3000 + "bbbbbbbbbbbb", ["aaaaaaaaaaaa", "bbbbbbbbbbbb"], (True, 0, 3024)),
        ("aaaaaaaaaaa b bbbbbbbbbbbb", ["aaaaaaaaaaa", "bbbbbbbbbbbb"], (False,)),
        ("short", ["hort"], (True, 1, 5)),
    ],
)
def test_elided_parts(spark, text, parts, found):
    s = spark.createDataFrame([(text, parts)], "t string, p array<string>").select(T.search_parts(F.col("t"), F.col("p")).alias("s")).first().s
    assert s.ok == found[0] and (not s.ok or (s.first, s.cursor) == found[1:])


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(T.find_all(F.lit("aaaa"), "aa", 50)) == [0, 1, 2]
    assert len(get(T.find_all(F.lit("a" * 300), "a", 200))) == 200
    assert get(T.find_all(F.lit("x.a(b.a(b"), ".a(", 9)) == [1, 5] and get(T.find_all(F.lit("😀b😀b"), "😀b", 9)) == [0, 2] and get(T.find_all(F.lit("ab"), "c", 9)) == []
    assert get(T.locator_tokens(F.lit("Ch. 3 / p.87 epic"))) == ["ch3", "p87", "pic"]
    assert get(T.split_elisions(F.lit("one [...] two… three"))) == ["one", "two", "three"]
    assert get(T.split_elisions(F.lit("..."))) == ["..."]
    assert get(T.slugify(F.lit("/x/My Book (2).epub"))) == "my-book-2"
    assert get(T.slugify(F.lit("/x/!!!.pdf"))) == "book"
