"""Text functions as Column expressions; all stay in the JVM but for `raw_offsets`."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.unicode_tables import changes, fold_table

#: White space as Python's \s has it.
WS = r"(?U)[\s\x1c-\x1f]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mapped(c: Column, kind: str) -> Column:
    """Every character by its table. Growing characters are replaced one kind at a time, those that a text holds."""
    one, to, gone, longer = changes(kind)
    simple = F.translate(c, one + gone, to)
    if not longer:
        return simple
    low = [(a, b) for a, b in longer if a <= "ÿ"]
    for a, b in low:
        simple = F.replace(simple, F.lit(a), F.lit(b))
    table = F.from_json(F.lit(json.dumps({a: b for a, b in longer if a > "ÿ"})), "map<string,string>")
    high = _class(a for a, _ in longer if a > "ÿ")
    held = F.array_distinct(F.regexp_extract_all(c, F.lit(high), F.lit(0)))
    return F.when(c.rlike(high), F.aggregate(held, simple, lambda acc, a: F.replace(acc, a, F.element_at(table, a)))).otherwise(simple)


def _class(chars) -> str:
    """A regex class of characters. Java tries the ranges of a class one after another, so they are halved into nested classes that are entered by their bounds alone."""
    runs = []
    for i in sorted(map(ord, chars)):
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    span = lambda some: f"\\x{{{some[0][0]:x}}}-\\x{{{some[-1][1]:x}}}"

    def nested(some):
        if len(some) < 3:
            return "".join(span([r]) for r in some)
        half = len(some) // 2
        return "".join(f"[[{span(part)}]&&[{nested(part)}]]" for part in (some[:half], some[half:]))

    return f"[[{span(runs)}]&&[{nested(runs)}]]"


@cache
def _changed(kind: str) -> str:
    """A regex class of the characters beyond ASCII that a table changes."""
    one, _, gone, longer = changes(kind)
    return _class(c for c in (*one, *gone, *(a for a, _ in longer)) if c > "\x7f")


def _wide(c: Column) -> Column:
    """True where a text holds a character beyond ASCII."""
    return F.octet_length(c) > F.length(c)


def fold(c: Column) -> Column:
    """Folds mangled punctuation and applies compatibility forms, character by character, in texts that hold a character to change."""
    return F.when(_wide(c) & c.rlike(_changed("norm")), _mapped(c, "norm")).otherwise(c)


def norm(c: Column) -> Column:
    """fold(), and each run of white space as one space. Case and punctuation stay; ends are not trimmed."""
    return F.regexp_replace(fold(c), WS + "+", " ")


def alnum(c: Column) -> Column:
    """Letters and digits alone, lower-cased, without accents."""
    wide = F.regexp_replace(_mapped(c, "alnum"), r"[^\p{L}\p{N}]", "")
    return F.when(c.rlike(r"[^\x00-\x7f]"), wide).otherwise(F.regexp_replace(F.translate(c, UPPER, LOWER), "[^a-z0-9]", ""))


def once(c: Column) -> Column:
    """A value that the optimiser must not copy into each of its uses: to be taken with select() or withColumn()."""
    return F.explode(F.array(c))


def bound(c: Column, f) -> Column:
    """f of a value that goes through a lambda by name, so that it is computed once a row however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def running(numbers: Column) -> Column:
    """Running sums of an array of whole numbers, by doubling: a round adds to each sum the one that ends where it begins. No array grows by one at a time."""
    def sums(a):
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(a))
        return F.aggregate(steps, a, lambda acc, s: F.transform(acc, lambda n, i: n + F.when(i >= s, F.get(acc, i - s)).otherwise(F.lit(0))))

    return bound(numbers, sums)


def locate(needle: Column, text: Column, start: Column | int = 1) -> Column:
    """Position from 1, in code points, of the first ``needle`` in ``text`` at or after ``start``; 0 where there is none."""
    return F.call_function("locate", needle, text, F.lit(start) if isinstance(start, int) else start)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


# Fixed value: the signs of which a run is taken as one.
LEADER = r"((?U)[^\s\x1c-\x1fa-zA-Z0-9])\1{2,}"


def leader_collapse(c: Column) -> Column:
    """A run of three or more of one sign that is no ASCII letter, digit or space becomes one sign."""
    return F.regexp_replace(c, LEADER, "$1")


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda t: t != "")


def is_wordlike(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) * 2 >= F.length(t)


def slugify(name: Column) -> Column:
    """A file name's stem in lower case, other signs as single hyphens; book where nothing is left."""
    base = F.regexp_replace(name, r"^.*/", "")
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "book").otherwise(slug)


# Fixed value: what counts as a token of a locator.
LOCATOR = r"(?i)((?:ch|p|loc)\.?\s*[0-9ivxlc]+)"


def locator_tokens(c: Column) -> Column:
    """The distinct tokens of a locator, such as ch3 and p87, in lower case. Not anchored: epic holds pic."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(LOCATOR), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"^(ch|p|loc)\.?\s*", "$1")))


def split_elisions(quote: Column) -> Column:
    """The parts between ellipses, trimmed, without empty ones; the whole quote where none is left."""
    plain = F.replace(F.replace(quote, F.lit("[...]"), F.lit("...")), F.lit("…"), F.lit("..."))
    parts = F.filter(F.transform(F.split(plain, r"\.\.\."), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(quote)))


# The shortest part of an elided quote, and the longest gap between parts, in transformed text.
MIN_FRAGMENT, ELISION_WINDOW = 12, 3000


def search_parts(text: Column, parts: Column) -> Column:
    """Finds parts in order, each from where the last ended: struct(ok, first, cursor), positions from 0 in ``text``. No backtracking."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(-1).alias("first"), F.lit(0).alias("cursor"))

    def step(acc, part):
        at = locate(part, text, acc["cursor"] + 1) - 1
        fits = (part != "") & (at >= 0) & ((acc["first"] < 0) | (at - acc["cursor"] <= ELISION_WINDOW))
        fits = fits & ((F.size(parts) == 1) | (F.length(part) >= MIN_FRAGMENT))
        good = acc["ok"] & fits
        return F.struct(good.alias("ok"), F.when(good & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"), F.when(good, at + F.length(part)).otherwise(acc["cursor"]).alias("cursor"))

    return F.aggregate(parts, start, step)


def find_all(text: Column, needle: str, limit: int) -> Column:
    """Positions from 0 of overlapping occurrences of a literal, at most ``limit``: the text is split before each of them, in one pass."""
    if not needle:
        return F.array().cast("array<int>")
    literal = "".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}" for c in needle)
    parts = F.split(text, f"(?={literal})", limit + 2)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    # each part but the last ends where an occurrence starts; one at the very start makes no part
    ends = bound(parts, lambda a: F.aggregate(F.slice(a, F.lit(1), F.size(a) - 1), start, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out")))["out"])
    found = F.concat(F.when(F.startswith(text, F.lit(needle)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), ends)
    return F.when(F.contains(text, F.lit(needle)), F.slice(found, 1, limit)).otherwise(F.array().cast("array<int>"))


def raw_offsets(text: Column, positions: Column, mode: Column) -> Column:
    """Offsets in the raw text of positions in its transformed text, by mode norm or alnum; the positions themselves where the mode is null.

    An Arrow function: call it once a text, on texts with hits only.

    A text is mapped as one array of code points: what each leaves in the transformed text is looked up, summed, and searched for the positions.
    """
    import pandas as pd

    table = fold_table()

    def run(t, p, modes):
        import re
        import unicodedata

        import numpy as np

        def folded(ch):
            to = table.get(ch)
            return unicodedata.normalize("NFKC", ch) if to is None else to

        def bare(ch):  # letters and digits that a character leaves
            return sum(e.isalnum() for c in folded(ch) if c.isalnum() for e in unicodedata.normalize("NFKD", c.lower())), 0, 0

        def plain(ch):  # characters that a character leaves after one that is no space, and whether they start and end with one
            blank = [re.match(r"\s", c) is not None for c in folded(ch)]
            return sum(not (now and before) for before, now in zip([False, *blank], blank)), *((blank[0], blank[-1]) if blank else (0, 0))

        rules, known, out = {"norm": plain, "alnum": bare}, {}, []
        for s, at, mode in zip(t, p, modes):
            if mode is None:
                out.append(at)
                continue
            if len(at) == 0:
                out.append([])
                continue
            code = np.frombuffer(s.encode("utf-32-le"), np.uint32)
            left = known.setdefault(mode, np.full((0x110000, 3), 255, np.uint8))
            for c in set(code[left[code, 0] == 255].tolist()):
                left[c] = rules[mode](chr(c))
            at_ = np.flatnonzero(left[code, 0])
            n, starts, ends = left[code[at_]].T.astype(np.int64)
            n[1:] -= starts[1:] & ends[:-1]
            out.append(at_[np.searchsorted(np.cumsum(n), np.asarray(at), side="right")].tolist())
        return pd.Series(out)

    run.__annotations__ = {"t": pd.Series, "p": pd.Series, "modes": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<int>")(F.when(mode.isNotNull(), text), positions, mode)


# Tags whose content is left out, and tags that stand for a line break.
SKIPPED, BLOCKS = ("script", "style", "head"), ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote")
#: Entities that the native path decodes; others take the parser path.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _undecoded(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def squeeze(c: Column) -> Column:
    """Blanks to one space, three or more line ends to two, ends trimmed."""
    c = F.regexp_replace(c, r"[ \t\r\f\x0b]+", " ")
    return strip(F.regexp_replace(c, rf"\n{WS}*\n{WS}*\n+", "\n\n"))


def html_text(html: Column) -> Column:
    """Text of well-formed HTML by a chain of replacements. `plumbline.sources.html` has a parser for the rest."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in SKIPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"(?is)<!doctype[^>]*>", "")
    c = F.regexp_replace(c, r"(?i)<br\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>", "\n\n")
    c = F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", "\n")
    c = F.regexp_replace(c, r"</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", "")
    return squeeze(_undecoded(c))


def html_title(html: Column) -> Column:
    """The first heading; a short one with the next after it; at most 120 characters; null without headings."""
    heads = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>"), F.lit(1)), lambda h: strip(_undecoded(F.regexp_replace(h, "<[^>]*>", ""))))
    heads = F.slice(F.filter(heads, lambda h: h != ""), 1, 3)
    first = F.get(heads, F.lit(0))
    joined = F.when((F.length(first) <= 4) & (F.size(heads) > 1), F.concat(first, F.lit(". "), F.get(heads, F.lit(1)))).otherwise(first)
    return F.left(joined, F.lit(120))
