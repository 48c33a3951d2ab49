"""License scans by ordered signature rules, in DataFrame operations only.

Texts are lower-cased (A-Z) and cut in words, joined by single spaces. A rule's keyword, a substring that all its
matches hold, gates it, and keywords are gated in turn by a word that several of them share: only the rules whose
keyword a text holds run their regexes over it. Detections are taken in
order of priority, then length, start and rule; one that lies within a taken one, or has a taken one within it, is
suppressed, so a short identifier goes before the long general notice around it. Positions are word numbers from 0.

The rules are the hand-written signatures of `license_rules` and, below them in priority, the names of FAMILIES in
the forms of TEMPLATES.

Defined results: a null text is an empty one; a text without words has n_words 0, null positions, empty
labels and score 0; repeated rows are judged alike; other columns stay, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Sealed, ascii_lower, table
from plumbline.llm.license_rules import SIGNATURES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrase: label. Fixed by the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label, keywords (every alternative of the name holds one), name as a regex over words, identifier as a regex over words.
FAMILIES = (
    ("mit", ("mit", "expat"), "(?:mit|expat)", "mit(?: 0)?"),
    ("apache", ("apache",), "apache(?: software)?", "apache [0-9]+(?: [0-9]+)?"),
    ("gpl", ("general public",), "(?:gnu )?general public", "gpl [0-9]+(?: [0-9]+)?(?: only| or later)?"),
    ("gpl", ("gpl",), "(?:gnu )?gpl", "gpl [0-9]+"),
    ("lgpl", ("lesser general public", "library general public"), "(?:gnu )?(?:lesser|library) general public", "lgpl [0-9]+(?: [0-9]+)?(?: only| or later)?"),
    ("lgpl", ("lgpl",), "(?:gnu )?lgpl", "lgpl [0-9]+"),
    ("agpl", ("affero",), "(?:gnu )?affero general public", "agpl [0-9]+(?: [0-9]+)?(?: only| or later)?"),
    ("agpl", ("agpl",), "(?:gnu )?agpl", "agpl [0-9]+"),
    ("bsd", ("bsd",), "(?:new |modified |simplified |revised |original )?(?:[0-9] clause )?bsd", "(?:0bsd|bsd [0-9] clause)"),
    ("isc", ("isc",), "isc", "isc"),
    ("mpl", ("mozilla",), "mozilla public", "mpl [0-9]+(?: [0-9]+)?"),
    ("mpl", ("mpl",), "mpl", "mpl [0-9]+"),
    ("epl", ("eclipse",), "eclipse public", "epl [0-9]+(?: [0-9]+)?"),
    ("edl", ("eclipse distribution",), "eclipse distribution", "edl [0-9]+"),
    ("cddl", ("common development",), "common development and distribution", "cddl [0-9]+(?: [0-9]+)?"),
    ("cpl", ("common public",), "common public", "cpl [0-9]+(?: [0-9]+)?"),
    ("cc-by", ("creative commons",), "creative commons attribution(?: share ?alike| non ?commercial| no ?derivatives)*", "cc by(?: nc| sa| nd)*(?: [0-9]+)*"),
    ("cc0", ("cc0",), "cc0", "cc0 [0-9]+(?: [0-9]+)?"),
    ("unlicense", ("unlicense",), "(?:the )?unlicense", "unlicense"),
    ("wtfpl", ("wtf", "you want to public"), "(?:wtfpl|do what the fuck you want to public)", "wtfpl"),
    ("zlib", ("zlib",), "zlib(?: libpng)?", "zlib"),
    ("libpng", ("libpng",), "libpng", "libpng(?: [0-9]+)*"),
    ("artistic", ("artistic",), "(?:perl )?artistic", "artistic [0-9]+(?: [0-9]+)?"),
    ("boost", ("boost",), "boost(?: software)?", "bsl [0-9]+(?: [0-9]+)?"),
    ("busl", ("business source",), "business source", "busl [0-9]+(?: [0-9]+)?"),
    ("postgresql", ("postgresql",), "postgresql", "postgresql"),
    ("python", ("python",), "python(?: software foundation)?", "(?:psf|python) [0-9]+(?: [0-9]+)?"),
    ("ofl", ("open font",), "(?:sil )?open font", "ofl [0-9]+(?: [0-9]+)?"),
    ("eupl", ("european union public",), "european union public", "eupl [0-9]+(?: [0-9]+)?"),
    ("ms-pl", ("microsoft public",), "microsoft public", "ms pl"),
    ("ms-rl", ("microsoft reciprocal",), "microsoft reciprocal", "ms rl"),
    ("apsl", ("apple public",), "apple public source", "apsl [0-9]+(?: [0-9]+)?"),
    ("ipl", ("ibm public",), "ibm public", "ipl [0-9]+(?: [0-9]+)?"),
    ("qpl", ("q public",), "q public", "qpl [0-9]+(?: [0-9]+)?"),
    ("sleepycat", ("sleepycat",), "sleepycat", "sleepycat"),
    ("ncsa", ("ncsa",), "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("afl", ("academic free",), "academic free", "afl [0-9]+(?: [0-9]+)?"),
    ("osl", ("open software",), "open software", "osl [0-9]+(?: [0-9]+)?"),
    ("php", ("php",), "php", "php [0-9]+(?: [0-9]+)?"),
    ("ruby", ("ruby",), "ruby", "ruby"),
    ("vim", ("vim",), "vim", "vim"),
    ("x11", ("x11",), "x11", "x11"),
    ("openssl", ("openssl",), "openssl", "openssl"),
    ("curl", ("curl",), "curl", "curl"),
    ("ntp", ("ntp",), "ntp", "ntp"),
    ("beerware", ("beerware",), "beerware", "beerware"),
    ("upl", ("universal permissive",), "universal permissive", "upl [0-9]+(?: [0-9]+)?"),
    ("odbl", ("open database",), "open database", "odbl [0-9]+(?: [0-9]+)?"),
    ("gfdl", ("free documentation",), "(?:gnu )?free documentation", "gfdl [0-9]+(?: [0-9]+)?"),
    ("cecill", ("cecill",), "cecill", "cecill(?: [a-c0-9]+)*"),
    ("mulan", ("mulan",), "mulan(?: permissive software)?", "mulanpsl [0-9]+(?: [0-9]+)?"),
    ("json", ("json",), "json", "json"),
    ("elastic", ("elastic",), "elastic", "elastic [0-9]+(?: [0-9]+)?"),
    ("sspl", ("server side public",), "server side public", "sspl [0-9]+(?: [0-9]+)?"),
    ("mspl", ("open public",), "open public", "opl [0-9]+(?: [0-9]+)?"),
)
LICENSE = "licen[cs]e"
#: pattern with {name} or {id}, priority, weight.
TEMPLATES = (
    (f"spdx {LICENSE} identifier {{id}}", 5, 1.0),
    (f"(?:licensed|released|distributed|available|published|redistributed|provided|covered) under (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?{{name}}(?: {LICENSE})?(?: (?:version |v)?[0-9]+(?: [0-9]+)?)?", 4, 0.9),
    (f"{{name}} {LICENSE} (?:version |v )?[0-9]+(?: [0-9]+)?", 3, 0.8),
    (f"(?:subject to|governed by|see|under) the (?:terms of the )?{{name}} {LICENSE}", 2, 0.7),
    (f"{{name}} {LICENSE}", 1, 0.6),
)
BASE_WEIGHT = 0.6
MARK = "\x01"


def rules() -> list[dict]:
    """All rules, signatures first: a rule's number breaks ties."""
    made = [(label, priority, weight, [keyword], pattern) for label, priority, weight, keyword, pattern in SIGNATURES]
    for pattern, priority, weight in TEMPLATES:
        for label, keywords, name, spdx in FAMILIES:
            words = list(keywords) if "{name}" in pattern else ["spdx"]
            made.append((label, priority, weight, words, pattern.replace("{name}", name).replace("{id}", spdx)))
    return [{"id": i, "label": label, "keywords": words, "pattern": f"(?<= )(?:{pattern})(?= )", "priority": priority, "weight": weight} for i, (label, priority, weight, words, pattern) in enumerate(made)]


def gates(keywords) -> list[dict]:
    """The keywords by a lead that each of them holds: the long word that most of those left share, else the keyword itself."""
    left, out = set(keywords), []
    while left:
        shared = Counter(w for k in left for w in set(re.findall("[a-z]{5,}", k)))
        lead = max(shared, key=lambda w: (shared[w], w)) if shared else min(left)
        of = sorted(k for k in left if lead in k)
        out.append({"lead": lead, "keywords": of})
        left -= set(of)
    return out


RULE_TYPE = "struct<id:int,label:string,keywords:array<string>,pattern:string,priority:int,weight:double>"


def normal(text: Column) -> Column:
    """The words between single spaces, with one at either end; a single space where there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), SEPARATORS, " ")


def starts(norm: Column, pattern: Column) -> Column:
    """Word numbers at which a pattern, which looks behind for a space, matches."""
    marked = F.split(F.ltrim(F.regexp_replace(norm, pattern, F.lit(MARK + "$0"))), " ")
    return F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i).otherwise(-1)), lambda i: i >= 0)


#: What scan() tells of a text: its words, the places of base phrases, and the detections.
FOUND = "array<struct<start:int,end:int,id:int,label:string,priority:int,weight:double>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, base (places: start, label) and found (detections in the order they were taken: start, end, id, label, priority, weight)."""
    sealed, table_ = Sealed(docs), rules()
    norm, lead_of = F.col("_norm"), gates(w for r in table_ for w in r["keywords"])
    open_ = F.filter(F.from_json(F.lit(json.dumps(lead_of)), "array<struct<lead:string,keywords:array<string>>>"), lambda g: F.contains(norm, g["lead"]))
    held = F.flatten(F.transform(open_, lambda g: F.filter(g["keywords"], lambda k: F.contains(norm, k))))
    active = F.filter(F.from_json(F.lit(json.dumps(table_)), f"array<{RULE_TYPE}>"), lambda r: F.arrays_overlap("_held", r["keywords"]))

    def found(r):
        hits = F.regexp_extract_all(norm, r["pattern"], F.lit(0))
        return F.transform(
            F.arrays_zip(starts(norm, r["pattern"]).alias("start"), hits.alias("hit")),
            lambda x: F.struct((-r["priority"]).alias("neg"), (-F.size(F.split(x["hit"], " "))).alias("short"), x["start"].alias("start"), r["id"].alias("id"), r["label"].alias("label"), r["weight"].alias("weight")),
        )

    def take(kept, d):
        start, end = d["start"], d["start"] - d["short"]
        nested = F.exists(kept, lambda k: ((k["start"] <= start) & (end <= k["end"])) | ((start <= k["start"]) & (k["end"] <= end)))
        one = F.struct(start.alias("start"), end.alias("end"), d["id"].alias("id"), d["label"].alias("label"), (-d["neg"]).alias("priority"), d["weight"].alias("weight"))
        return F.when(nested, kept).otherwise(F.concat(kept, F.array(one)))

    def places(phrase, label):
        return F.transform(starts(norm, F.lit(f"(?<= ){phrase}(?= )")), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    base = [places(*x) for x in BASE.items()]
    no_base, nothing = F.from_json(F.lit("[]"), "array<struct<start:int,label:string>>"), F.from_json(F.lit("[]"), FOUND)
    every = F.array_sort(F.flatten(F.transform(active, found)))
    # explode() of one value keeps the optimiser from copying the value into each of its uses
    rows = sealed.rows.withColumn("_norm", F.explode(F.array(normal(F.col(sealed[text])))))
    rows = rows.withColumn("_held", F.explode(F.array(held))).withColumn("_all", F.explode(F.array(F.when(F.size("_held") > 0, every))))
    return sealed.open(
        rows,
        n_words=(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("long"),
        base=F.when(F.contains(norm, F.lit("license")), F.concat(*base)).otherwise(no_base),
        found=F.when(F.size("_all") > 0, F.aggregate("_all", nothing, take)).otherwise(nothing),
    )


def op7_license_scan(spark, sf_dir):
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = F.transform("base", lambda b: b["start"])
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    labels = F.array_union(base_labels, F.transform("found", lambda d: d["label"]))
    weights = F.concat(F.transform("found", lambda d: d["weight"]), F.transform("base", lambda b: F.lit(BASE_WEIGHT)), F.array(F.lit(0.0)))
    return s.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), F.array_max(weights).alias("score"),
    )
