"""Character tables made on the driver from Python's Unicode data, by rule."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

# How mangled punctuation is folded.
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"
DASHES = "‐‑‒–—―−"
SPACES = "       　"
DELETED = "­​‌‍﻿"
ELLIPSIS = "…"


@cache
def fold_table() -> dict[str, str]:
    return {c: to for group, to in ((SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"'), (DASHES, "-"), (SPACES, " "), (DELETED, ""), (ELLIPSIS, "...")) for c in group}


def folded(c: str) -> str:
    """A character by the fold table, else by its own compatibility composition."""
    to = fold_table().get(c)
    return unicodedata.normalize("NFKC", c) if to is None else to


def bare(c: str) -> str:
    """Letters and digits of a folded character, lower-cased, without accents."""
    return "".join(e for f in folded(c) if f.isalnum() for e in unicodedata.normalize("NFKD", f.lower()) if e.isalnum())


@cache
def changes(kind: str) -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """(from, to, deleted, longer): one-to-one pairs as two strings, characters that vanish, and those that grow."""
    rule = {"norm": folded, "alnum": bare}[kind]
    one, to, gone, longer = [], [], [], []
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if kind == "alnum" and not c.isalnum() and c not in fold_table() and unicodedata.normalize("NFKC", c) == c:
            continue  # dropped by class afterwards, not by table
        r = rule(c)
        if r == c:
            continue
        if len(r) == 1:
            one.append(c)
            to.append(r)
        elif not r:
            gone.append(c)
        else:
            longer.append((c, r))
    return "".join(one), "".join(to), "".join(gone), tuple(longer)
