"""Queries over the driver's tables, by name, each with its SQL.

`documents` stand for books, their lines for sections, `benchmark` for quotes, `pages` for XHTML files,
`labels` and `conversations` for verdict tables and conversation material.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.unicode_tables import DASHES, DELETED, DOUBLE_QUOTES, SINGLE_QUOTES, SPACES
from plumbline.operators import notes as N
from plumbline.operators import pages as P
from plumbline.operators import quality as Q
from plumbline.operators import search as S
from plumbline.operators import status as ST
from plumbline.operators import verify as V
from plumbline.session import dealt, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def books(spark, d) -> DataFrame:
    return dealt(table(spark, d, "documents").select("doc_id", "text"))


def quotes(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))


ALNUM = "regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_ONE = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES
_TO = "''" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES)


def norm_sql(c: str) -> str:
    return f"regexp_replace(replace(translate({c}, '{_ONE}{DELETED}', '{_TO}'), '…', '...'), '\\s+', ' ', 'g')"


def alnum_sql(c: str) -> str:
    return ALNUM.format(c)


_q = f"q AS (SELECT item_id, text AS raw, trim({norm_sql('text')}) AS q, {alnum_sql('text')} AS a FROM benchmark)"
_b = f"b AS (SELECT doc_id, text, {norm_sql('text')} AS body FROM documents)"


# ---- quotes ----


@query(f"""
WITH {_q}, {_b},
m AS (SELECT q.item_id, min(b.doc_id) AS doc_id, count(*) AS n_books FROM q JOIN b ON strpos(b.text, q.q) > 0 GROUP BY q.item_id)
SELECT q.item_id, CASE WHEN m.doc_id IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, coalesce(m.n_books, 0) AS n_books, m.doc_id,
  CAST(strpos(d.text, q.q) - 1 AS BIGINT) AS found_at
FROM q LEFT JOIN m ON q.item_id = m.item_id LEFT JOIN documents d ON d.doc_id = m.doc_id
""")
def verify_quotes_exact(spark, d):
    hit = exact_hits(spark, d)
    first = hit.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_books"), F.min_by("found_at", "doc_id").alias("found_at"))
    return quotes(spark, d).select("item_id").join(first, "item_id", "left").select("item_id", F.when(F.col("doc_id").isNull(), "FAIL").otherwise("PASS").alias("status"), F.coalesce("n_books", F.lit(0)).cast("long").alias("n_books"), "doc_id", "found_at")


#: Ways to disturb a quote, so that every rung of the ladder is reached: (name, Spark, SQL).
VARIANTS = (
    ("plain", lambda c: c, "text"),
    ("upper", lambda c: F.translate(c, T.LOWER, T.UPPER), f"translate(text, '{T.LOWER}', '{T.UPPER}')"),
    ("soft", lambda c: F.concat(F.substring(c, 1, 20), F.lit("­"), F.substring(c, F.lit(21), F.length(c))), "substr(text, 1, 20) || '­' || substr(text, 21)"),
    ("bang", lambda c: F.replace(c, F.lit(" "), F.lit("! ")), "replace(text, ' ', '! ')"),
    ("absent", lambda c: F.reverse(c), "reverse(text)"),
)


def variants(spark, d):
    q = quotes(spark, d)
    each = F.array(*[F.struct(F.lit(n).alias("variant"), f(F.col("quote")).alias("quote")) for n, f, _ in VARIANTS])
    return q.select("item_id", F.explode(each).alias("v")).select(F.concat_ws(":", F.col("item_id").cast("string"), "v.variant").alias("item_id"), "v.quote")


_vq = " UNION ALL ".join(f"SELECT CAST(item_id AS VARCHAR) || ':{n}' AS item_id, {s} AS text FROM benchmark" for n, _, s in VARIANTS)
_ladder = f"""
WITH v AS ({_vq}),
q AS (SELECT item_id, trim({norm_sql('text')}) AS q, {alnum_sql(norm_sql('text'))} AS a FROM v),
b AS (SELECT doc_id, text, {norm_sql('text')} AS body, {alnum_sql('text')} AS al FROM documents),
h AS (SELECT item_id, doc_id, CASE WHEN strpos(b.text, q.q) > 0 THEN 'EXACT' ELSE 'NORMALIZED' END AS level FROM q JOIN b ON strpos(b.body, q.q) > 0),
p AS (SELECT q.item_id, b.doc_id, 'PUNCT' AS level FROM q JOIN b ON strpos(b.al, q.a) > 0 WHERE q.a <> '' AND q.item_id NOT IN (SELECT item_id FROM h)),
a AS (SELECT * FROM h UNION ALL SELECT * FROM p),
o AS (SELECT *, CASE level WHEN 'EXACT' THEN 1 WHEN 'NORMALIZED' THEN 2 ELSE 3 END AS o FROM a),
best AS (SELECT item_id, min(o) AS b FROM o GROUP BY item_id),
r AS (SELECT o.item_id, any_value(level) AS level, count(*) AS n_books, min(doc_id) AS doc_id FROM o JOIN best ON o.item_id = best.item_id AND o = b GROUP BY o.item_id),
res AS (SELECT q.item_id, CASE WHEN level IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, level, coalesce(n_books, 0) AS n_books, doc_id FROM q LEFT JOIN r ON q.item_id = r.item_id)
"""


@query(_ladder + "SELECT * FROM res")
def verify_ladder(spark, d):
    q = variants(spark, d)
    return V.outcome(q, V.ladder(q, books(spark, d)))


@query(_ladder + """, k AS (SELECT status AS kind, count(*) AS n FROM res GROUP BY status UNION ALL
SELECT l.level, count(res.item_id) FROM (VALUES ('EXACT'), ('NORMALIZED'), ('PUNCT')) l(level) LEFT JOIN res ON res.level = l.level GROUP BY l.level) SELECT * FROM k""")
def verify_counts(spark, d):
    r = verify_ladder(spark, d)
    levels = r.agg(*[F.count_if(F.col("level") == v).alias(v) for v in ("EXACT", "NORMALIZED", "PUNCT")])
    levels = levels.select(F.explode(F.create_map(*[x for v in ("EXACT", "NORMALIZED", "PUNCT") for x in (F.lit(v), F.col(v))])).alias("kind", "n"))
    return r.groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("n")).unionByName(levels)


_cut = "length(text) // 2"


@query(f"""
WITH q AS (SELECT item_id, trim({norm_sql(f"left(text, {_cut})")}) AS f1, trim({norm_sql(f"substr(text, {_cut} + 11)")}) AS f2 FROM benchmark),
{_b},
s AS (SELECT item_id, doc_id, f1, f2, level, t, strpos(t, f1) - 1 AS p1, strpos(t, f1) - 1 + length(f1) AS c1 FROM q, (SELECT doc_id, 1 AS level, text AS t FROM b UNION ALL SELECT doc_id, 2, body FROM b) WHERE contains(t, f1)),
t AS (SELECT *, strpos(substr(t, c1 + 1), f2) AS r FROM s),
m AS (SELECT * FROM t WHERE r > 0 AND r - 1 <= 3000 AND length(f1) >= 12 AND length(f2) >= 12 QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY level) = 1)
SELECT item_id, doc_id, CASE level WHEN 1 THEN 'EXACT' ELSE 'NORMALIZED' END AS level, CAST(p1 AS BIGINT) AS found_at, CAST(c1 + r - 1 + length(f2) AS BIGINT) AS ends FROM m
""")
def elision_match(spark, d):
    """Each quote with ten characters after its middle left out."""
    half = F.floor(F.length("quote") / 2).cast("int")
    q = quotes(spark, d).select("item_id", F.concat(F.substring(F.col("quote"), F.lit(1), half), F.lit(" [...] "), F.substring(F.col("quote"), half + 11, F.length("quote"))).alias("quote"))
    return V.ladder(q, books(spark, d)).where("level <> 'PUNCT'").select("item_id", "doc_id", "level", F.col("found_at").cast("long"), F.col("ends").cast("long"))


_hits = f"""
WITH {_q}, {_b},
h AS (SELECT q.item_id, b.doc_id, CAST(strpos(b.text, q.q) - 1 AS BIGINT) AS found_at FROM q JOIN b ON strpos(b.text, q.q) > 0),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS pos, length(text) AS total FROM documents),
w AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u),
seg AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, 'p.' || CAST(pos AS VARCHAR) AS label, CAST(s AS BIGINT) AS "start", CAST(least(s + length(body) + 1, total) AS BIGINT) AS "end", body FROM w)
"""


def exact_hits(spark, d):
    q = quotes(spark, d).select("item_id", T.once(T.strip(T.norm(F.col("quote")))).alias("q"))
    hit = V.contained(q, books(spark, d).where("text is not null"), "q", "text", "item_id", "doc_id")
    return hit.select("item_id", "doc_id", (T.locate(F.col("q"), F.col("text")) - 1).cast("long").alias("found_at"))


@query(_hits + """SELECT h.*, seg.label FROM h LEFT JOIN seg ON h.doc_id = seg.doc_id AND seg."start" <= h.found_at AND h.found_at < seg."end" """)
def locate_offsets(spark, d):
    return V.locate(exact_hits(spark, d), V.line_segments(books(spark, d)))


@query(_hits + """, l AS (SELECT h.item_id, h.doc_id, 'p. ' || CAST(h.item_id % 7 + 1 AS VARCHAR) AS claimed, seg.label FROM h LEFT JOIN seg ON h.doc_id = seg.doc_id AND seg."start" <= h.found_at AND h.found_at < seg."end")
SELECT item_id, doc_id, claimed, label, CASE WHEN label IS NOT NULL AND replace(claimed, ' ', '') <> label THEN 'LOCATOR_MISMATCH' ELSE 'PASS' END AS status FROM l""")
def locator_mismatch(spark, d):
    at = locate_offsets(spark, d).withColumn("claimed", F.concat(F.lit("p. "), (F.col("item_id") % 7 + 1).cast("string")))
    return at.select("item_id", "doc_id", "claimed", "label", F.when(V.mismatch("claimed", "label"), "LOCATOR_MISMATCH").otherwise("PASS").alias("status"))


@query(_hits + 'SELECT doc_id, pos, label, "start", "end" FROM seg')
def segment_spans(spark, d):
    return V.line_segments(books(spark, d)).drop("body")


@query("""
WITH l AS (SELECT doc_id, 'Ch. ' || CAST(doc_id % 12 AS VARCHAR) || ' / p.' || CAST(doc_id % 300 AS VARCHAR) || ' epic ' || source AS locator FROM documents),
t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(locator, '(?i)((?:ch|p|loc)\\.?\\s*[0-9ivxlc]+)', 1), lambda x: regexp_replace(lower(x), '^(ch|p|loc)\\.?\\s*', '\\1')))) AS token FROM l)
SELECT * FROM t
""")
def locator_tokens(spark, d):
    loc = F.concat(F.lit("Ch. "), (F.col("doc_id") % 12).cast("string"), F.lit(" / p."), (F.col("doc_id") % 300).cast("string"), F.lit(" epic "), F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.explode(T.locator_tokens(loc)).alias("token"))


# ---- text functions ----


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, CAST(length({norm_sql('text')}) AS BIGINT) AS norm_chars FROM documents")
def normalize_text(spark, d):
    n = books(spark, d).select("doc_id", T.once(T.norm(F.col("text"))).alias("n"))
    return n.select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("long").alias("norm_chars"))


@query(f"SELECT doc_id, md5({alnum_sql('text')}) AS alnum_md5 FROM documents")
def alnum_text(spark, d):
    return books(spark, d).select("doc_id", F.md5(T.alnum(F.col("text"))).alias("alnum_md5"))


_RUNS = "!#$%&*-=_.|~+ßçèéêíñóöüáúàâîôûùëïäœ¿¡·"


def collapse_sql(c: str) -> str:
    for ch in _RUNS:
        c = f"regexp_replace({c}, '[{ch}]{{3,}}', '{ch}', 'g')" if ch not in "-|" else f"regexp_replace({c}, '\\{ch}{{3,}}', '{ch}', 'g')"
    return c


@query(f"SELECT doc_id, md5({collapse_sql('text')}) AS flat_md5 FROM documents")
def leader_collapse(spark, d):
    return books(spark, d).select("doc_id", F.md5(T.leader_collapse(F.col("text"))).alias("flat_md5"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^.*/', '') AS base FROM pages),
s AS (SELECT page_id, trim(regexp_replace(lower(regexp_replace(base, '([^.])\\.[^.]*$', '\\1')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM p)
SELECT page_id, CASE WHEN slug = '' THEN 'book' ELSE slug END AS slug FROM s
""")
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


# ---- quality ----

_metric = f"""
WITH u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, body, {collapse_sql('body')} AS flat FROM u),
g AS (SELECT *, regexp_replace(flat, '\\s', '', 'g') AS dense, list_filter(regexp_split_to_array(flat, '\\s+'), lambda t: t <> '' AND 2 * length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= length(t)) AS w FROM f),
m AS (SELECT doc_id, pos, 'p.' || CAST(pos AS VARCHAR) AS label, CAST(length(body) AS BIGINT) AS chars, CAST(len(w) AS BIGINT) AS tokens,
  CASE WHEN length(dense) > 0 THEN round(length(regexp_replace(dense, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(dense)::DOUBLE, 3) ELSE 0.0 END AS alnum_ratio,
  CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda t: length(t))) / len(w)::DOUBLE, 2) ELSE 0.0 END AS avg_word_len,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda t: length(t) > 25)) / len(w)::DOUBLE, 3) ELSE 0.0 END AS long_token_ratio,
  CASE WHEN length(body) > 0 THEN round((length(body) - length(replace(body, '�', ''))) / length(body)::DOUBLE, 4) ELSE 0.0 END AS replacement_ratio FROM g),
md AS (SELECT doc_id, median(chars) AS median_chars FROM m GROUP BY doc_id),
v AS (SELECT m.*, md.median_chars, CASE WHEN chars < 80 AND pos % 5 = 0 AND {{fig}} THEN 'IMAGE_ONLY' WHEN chars < 80 THEN 'EMPTY'
  WHEN alnum_ratio < 0.55 OR avg_word_len > 12.0 OR long_token_ratio > 0.04 OR replacement_ratio > 0.002 THEN 'GARBLED'
  WHEN median_chars > 0 AND chars < median_chars * 0.25 THEN 'SHORT' ELSE 'OK' END AS verdict FROM m JOIN md ON m.doc_id = md.doc_id)
"""
_v0, _v1 = _metric.replace("{fig}", "false"), _metric.replace("{fig}", "true")
_bk = """, bk AS (SELECT doc_id, count(*) AS sections, count(*) FILTER (verdict = 'OK') AS ok, count(*) FILTER (verdict = 'SHORT') AS short, count(*) FILTER (verdict = 'EMPTY') AS empty,
  count(*) FILTER (verdict = 'GARBLED') AS garbled, count(*) FILTER (verdict = 'IMAGE_ONLY') AS image_only FROM v GROUP BY doc_id),
r AS (SELECT *, (empty + garbled) / sections::DOUBLE AS rate FROM bk),
o AS (SELECT doc_id, sections, ok, short, empty, garbled, image_only, round(rate, 3) AS fail_rate, CASE WHEN garbled > 0 OR (rate > 0.10 AND empty + garbled >= CASE WHEN sections < 20 THEN 2 ELSE 1 END) THEN CASE WHEN rate > 0.35 THEN 'UNUSABLE' ELSE 'DEGRADED' END ELSE 'OK' END AS overall FROM r)
"""


def scored(spark, d):
    return Q.metrics(V.line_segments(books(spark, d)).select("doc_id", "pos", "label", "body")).drop("body")


def judged(spark, d):
    return Q.verdicts(scored(spark, d), "doc_id")


@query(_v0 + "SELECT * FROM m")
def quality_section_metrics(spark, d):
    return scored(spark, d)


@query(_v0 + "SELECT doc_id, pos, chars, median_chars, verdict FROM v")
def quality_verdicts(spark, d):
    return judged(spark, d).select("doc_id", "pos", "chars", "median_chars", "verdict")


@query(_v0 + _bk + "SELECT * FROM o")
def quality_book_overall(spark, d):
    return Q.books(judged(spark, d), "doc_id")


@query(_v0 + "SELECT verdict, count(*) AS sections FROM v GROUP BY verdict")
def quality_counts(spark, d):
    return judged(spark, d).groupBy("verdict").agg(F.count("*").alias("sections"))


@query(_v0 + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN verdict = 'GARBLED' THEN 0 ELSE 1 END, pos) AS rank, label, verdict FROM v WHERE verdict IN ('GARBLED', 'EMPTY')")
def excluded_sections(spark, d):
    return Q.excluded(judged(spark, d), "doc_id", "pos")


@query(_v1 + "SELECT doc_id, label, verdict FROM v WHERE pos % 5 = 0 AND (doc_id % 2 = 0 OR chars < median_chars * 0.4)")
def visual_selection_shape(spark, d):
    s = scored(spark, d).withColumn("has_figure", F.col("pos") % 5 == 0)
    j = Q.verdicts(s, "doc_id", "has_figure").withColumn("prov", F.when(F.col("doc_id") % 2 == 0, "native").otherwise("ocr"))
    return Q.visual(j, "has_figure", "prov").select("doc_id", "label", "verdict")


@query(_v0 + "SELECT b.doc_id, b.pos, b.label, b.body_chars FROM (SELECT doc_id, pos, label, chars AS body_chars FROM v) b ANTI JOIN (SELECT doc_id, label FROM v WHERE verdict IN ('GARBLED', 'EMPTY')) x ON b.doc_id = x.doc_id AND b.label = x.label")
def study_sections(spark, d):
    j = judged(spark, d)
    return j.select("doc_id", "pos", "label", F.col("chars").alias("body_chars")).join(Q.excluded(j, "doc_id", "pos"), ["doc_id", "label"], "left_anti").select("doc_id", "pos", "label", "body_chars")


# ---- search ----

TERMS = ["license", "MIT License", "the the", "ándo", "aaa"]
_terms = ", ".join(f"({i}, '{t}', {m}, '{w}')" for m, words in enumerate(S.needles(TERMS).values()) for i, (t, w) in enumerate(zip(TERMS, words)))
#: Hits one after another, then each character of the texts with a hit and where it stands in the view, which leads back to the raw text.
_search = f"""
WITH RECURSIVE v AS (SELECT doc_id, 0 AS m, lower({norm_sql('text')}) AS view FROM documents UNION ALL SELECT doc_id, 1, {alnum_sql('text')} FROM documents),
t(term_no, term, m, needle) AS (VALUES {_terms}),
occ AS (
  SELECT doc_id, v.m, term_no, term, needle, view, 0 AS nth, strpos(view, needle) AS spot FROM v JOIN t ON v.m = t.m AND contains(view, needle)
  UNION ALL
  SELECT doc_id, m, term_no, term, needle, view, nth + 1, spot + strpos(substr(view, spot + 1), needle) FROM occ WHERE nth + 1 < {S.LIMIT} AND contains(substr(view, spot + 1), needle)),
x AS (SELECT doc_id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM occ)),
n AS (SELECT doc_id, i, CASE WHEN regexp_matches(c, '\\s') AND coalesce(regexp_matches(lag(c) OVER w, '\\s'), false) THEN 0 ELSE 1 END AS n0, length({alnum_sql('c')}) AS n1 FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, n0, n1, sum(n0) OVER w AS e0, sum(n1) OVER w AS e1 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
map AS (SELECT doc_id, 0 AS m, i, e0 - n0 AS lo, e0 AS hi FROM s WHERE n0 > 0 UNION ALL SELECT doc_id, 1, i, e1 - n1, e1 FROM s WHERE n1 > 0),
h AS (SELECT occ.doc_id, occ.m, term_no, term, nth, i AS o FROM occ JOIN map ON occ.doc_id = map.doc_id AND occ.m = map.m AND lo <= spot - 1 AND spot - 1 < hi),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, o // {S.BUCKET} ORDER BY term_no, m, nth) = 1),
r AS (SELECT f.doc_id, term, CASE m WHEN 0 THEN 'norm' ELSE 'alnum' END AS mode, CAST(o AS BIGINT) AS "offset", 'p.' || CAST(length(left(text, o)) - length(replace(left(text, o), chr(10), '')) + 1 AS VARCHAR) AS locator,
  trim(regexp_replace(substr(text, greatest(0, o - {S.CONTEXT // 2}) + 1, least(length(text), o + length(term) + {S.CONTEXT // 2}) - greatest(0, o - {S.CONTEXT // 2})), '\\s+', ' ', 'g')) AS snippet, term_no, m, nth
  FROM f JOIN documents d ON f.doc_id = d.doc_id),
sec AS (SELECT doc_id, locator, count(*) AS hits, min([term_no, m, nth, "offset"]) AS seen FROM r GROUP BY doc_id, locator)
"""


def found(spark, d):
    b = books(spark, d)
    return S.hits(b, TERMS, V.line_segments(b))


@query(_search + 'SELECT doc_id, term, mode, "offset", locator FROM r')
def search_hits(spark, d):
    return found(spark, d).select("doc_id", "term", "mode", "offset", "locator")


@query(_search + "SELECT doc_id, locator, hits FROM sec")
def search_sections(spark, d):
    return S.sections(found(spark, d)).drop("first_seen")


@query(_search + "SELECT doc_id, locator, hits FROM sec ORDER BY hits DESC, doc_id, seen LIMIT 8")
def search_topk(spark, d):
    return S.densest(S.sections(found(spark, d))).drop("first_seen")


@query(_search + 'SELECT doc_id, term, "offset", snippet, (SELECT count(*) FROM r) AS total FROM r ORDER BY doc_id, "offset", term_no, m, nth LIMIT 20')
def search_snippets(spark, d):
    return S.top(found(spark, d)).select("doc_id", "term", "offset", "snippet", "total")


# ---- HTML ----

_attr = """(?:"[^"]*"|''[^'']*''|[^>"''])*"""


def html_sql(c: str) -> str:
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    for tag in T.SKIPPED:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b{_attr}>.*?</{tag}\\s*>', '', 'g')"
    c = f"regexp_replace({c}, '(?is)<!doctype[^>]*>', '', 'g')"
    c = f"regexp_replace({c}, '(?i)<br\\b{_attr}/>', chr(10) || chr(10), 'g')"
    c = f"regexp_replace({c}, '(?i)</?(?:{'|'.join(T.BLOCKS)})\\b{_attr}>', chr(10), 'g')"
    c = f"regexp_replace({c}, '</?[a-zA-Z]{_attr}>', '', 'g')"
    return squeeze_sql(entities_sql(c))


def entities_sql(c: str) -> str:
    for a, b in T.ENTITIES:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


def squeeze_sql(c: str) -> str:
    c = f"regexp_replace({c}, '[ \\t\\r\\f\\v]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({c}, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, md5({html_sql('html')}) AS text_md5, CAST(length({html_sql('html')}) AS BIGINT) AS chars FROM pages")
def html_text(spark, d):
    t = table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("chars"))


_title = entities_sql("regexp_replace(x, '<[^>]*>', '', 'g')")
_heads = f"list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]\\s*>', 1), lambda x: trim({_title})), lambda y: y <> '')"


@query(f"WITH h AS (SELECT page_id, {_heads} AS h FROM pages) SELECT page_id, left(CASE WHEN length(h[1]) <= 4 AND len(h) > 1 THEN h[1] || '. ' || h[2] ELSE h[1] END, 120) AS title FROM h")
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query(f"""
WITH t AS (SELECT page_id // 10 AS book, page_id, {html_sql('html')} AS body FROM pages),
k AS (SELECT *, length(body) + 2 AS n FROM t WHERE length(body) >= 20),
s AS (SELECT *, sum(n) OVER (PARTITION BY book ORDER BY page_id) AS e, row_number() OVER (PARTITION BY book ORDER BY page_id) AS i FROM k)
SELECT book, page_id, 'ch' || CAST(i AS VARCHAR) AS label, CAST(e - n AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM s
""")
def chapter_spans(spark, d):
    t = table(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("book"), "page_id", T.html_text(F.col("html")).alias("body"))
    return P.chapter_spans(t, "book", "page_id", "body").select("book", "page_id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# ---- pages and images ----


@query("""
WITH d AS (SELECT doc_id, n_chars % 97 AS total, doc_id % 15 + 1 AS k FROM documents),
e AS (SELECT doc_id, total, k, unnest(range(0, CASE WHEN k >= total THEN total ELSE k END)) AS i FROM d WHERE total > 0)
SELECT DISTINCT doc_id, CAST(CASE WHEN k >= total THEN i + 1 ELSE greatest(1, least(total, floor(i * (total / k::DOUBLE)) + 1)) END AS BIGINT) AS page FROM e
""")
def sample_pages(spark, d):
    t = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 97).alias("total"), (F.col("doc_id") % 15 + 1).alias("k"))
    return t.select("doc_id", F.explode(P.evenly_spaced(F.col("total"), F.col("k"))).alias("page"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 9 AS a, doc_id % 5 AS w FROM documents),
e AS (SELECT doc_id, a AS page FROM d UNION SELECT doc_id, 12 FROM d UNION SELECT doc_id, unnest(range(a + 5, a + 6 + w)) FROM d)
SELECT DISTINCT doc_id, CAST(page AS BIGINT) AS page FROM e
""")
def parse_page_spec(spark, d):
    a = F.col("doc_id") % 9
    spec = F.format_string("%d, 12,,%d-%d", a, a + 5, a + 5 + F.col("doc_id") % 5)
    return table(spark, d, "documents").select("doc_id", F.explode(P.parse_pages(spec)).alias("page"))


_img = "i AS (SELECT l_orderkey % 200 AS book, l_linenumber AS page, CAST(floor(l_extendedprice) AS INT) % 1200 AS width, CAST(floor(l_quantity) AS INT) * 25 AS height FROM lineitem)"
_inv = f"WITH {_img}, v AS (SELECT book, page, count(*) AS \"count\", max(width) AS max_w, max(height) AS max_h, max(width) >= 200 AND max(height) >= 200 AS figure, max(width) >= 700 AND max(height) >= 900 AS full_page FROM i GROUP BY book, page)"


def images(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % 200).alias("book"), F.col("l_linenumber").alias("page"), (F.floor("l_extendedprice").cast("int") % 1200).alias("width"), (F.floor("l_quantity").cast("int") * 25).alias("height"))


@query(_inv + "SELECT * FROM v")
def image_inventory(spark, d):
    return P.inventory(images(spark, d), "book")


@query(_inv + "SELECT book, page FROM v WHERE figure")
def figure_selection(spark, d):
    return P.inventory(images(spark, d), "book").where("figure").select("book", "page")


@query(_inv + """, p AS (SELECT book, count(*) FILTER (full_page) AS full_pages, count(*) AS pages FROM v GROUP BY book)
SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'ocr' WHEN p.full_pages / greatest(p.pages, 1)::DOUBLE >= 0.8 AND d.n_chars / greatest(p.pages, 1)::DOUBLE < 2500 THEN 'ocr-suspected' ELSE 'native' END AS provenance
FROM documents d JOIN p ON d.doc_id % 200 = p.book""")
def provenance_rule(spark, d):
    p = P.inventory(images(spark, d), "book").groupBy("book").agg(F.count_if("full_page").alias("full_pages"), F.count("*").alias("pages"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 200).alias("book"), F.when(F.col("doc_id") % 11 == 0, "Producer: ABBYY FineReader 12").otherwise("Producer: press").alias("meta"))
    return docs.join(p, "book").select("doc_id", P.provenance(F.col("meta"), F.col("full_pages"), F.col("pages"), F.col("n_chars")).alias("provenance"))


# ---- notes and status ----


def note_lines(spark, d):
    """A JSON line for each turn of a conversation, with the faults that a reader must report."""
    c = table(spark, d, "conversations").withColumn("no", F.col("conv_id") * 100 + F.col("turn"))
    fig = F.col("no") % 5 == 0
    body = F.to_json(F.struct(
        F.when(F.col("no") % 13 != 0, F.concat(F.lit("n"), F.col("no").cast("string"))).alias("id"), F.col("text").alias("claim"), F.when(~fig & (F.col("no") % 7 != 0), F.col("text")).alias("quote"),
        F.when(fig & (F.col("no") % 10 == 0), F.lit("pages/p0001.png")).alias("evidence"), F.concat(F.lit("ch"), (F.col("turn") % 4 + F.col("conv_id") % 9).cast("string"), F.lit(" / p."), F.col("conv_id").cast("string")).alias("locator"),
        F.when(fig, "figure").when(F.col("no") % 11 == 0, "rumour").otherwise("claim").alias("kind"), F.when(F.col("no") % 3 == 0, "adjacent").otherwise("core").alias("scope"), F.when(F.col("role") == "user", "conversation").when(F.col("no") % 17 == 0, "nobody").otherwise("author").alias("speaker"),
    ))
    line = F.when(F.col("no") % 19 == 0, "{broken").when(F.col("no") % 23 == 0, "// a remark").when(F.col("no") % 29 == 0, "   ").otherwise(body)
    return c.select("conv_id", "turn", F.col("no").alias("line_no"), line.alias("line"))


_notes = """
WITH c AS (SELECT *, conv_id * 100 + turn AS no FROM conversations),
f AS (SELECT conv_id, turn, no, CASE WHEN no % 13 <> 0 THEN 'n' || CAST(no AS VARCHAR) END AS id, text AS claim, CASE WHEN no % 5 <> 0 AND no % 7 <> 0 THEN text END AS quote,
  CASE WHEN no % 10 = 0 THEN 'pages/p0001.png' END AS evidence, 'ch' || CAST(turn % 4 + conv_id % 9 AS VARCHAR) || ' / p.' || CAST(conv_id AS VARCHAR) AS locator, turn % 4 + conv_id % 9 AS ch,
  CASE WHEN no % 5 = 0 THEN 'figure' WHEN no % 11 = 0 THEN 'rumour' ELSE 'claim' END AS kind, CASE WHEN no % 3 = 0 THEN 'adjacent' ELSE 'core' END AS scope,
  CASE WHEN role = 'user' THEN 'conversation' WHEN no % 17 = 0 THEN 'nobody' ELSE 'author' END AS speaker, no % 19 = 0 AS broken FROM c WHERE no % 19 = 0 OR (no % 23 <> 0 AND no % 29 <> 0)),
g AS (SELECT *, list_filter([CASE WHEN coalesce(id, '') = '' THEN 'id' END, CASE WHEN coalesce(claim, '') = '' THEN 'claim' END, CASE WHEN kind = 'figure' AND evidence IS NULL THEN 'evidence' WHEN kind <> 'figure' AND coalesce(quote, '') = '' THEN 'quote' END], lambda x: x IS NOT NULL) AS miss FROM f),
e AS (SELECT *, 'line ' || CAST(no AS VARCHAR) || ': ' AS ln FROM g),
r AS (SELECT *, NOT broken AND len(miss) = 0 AS kept, CASE WHEN broken THEN ln || 'invalid JSON' WHEN len(miss) > 0 THEN ln || 'missing fields ' || array_to_string(miss, ', ')
  ELSE array_to_string(list_filter([CASE WHEN kind = 'rumour' THEN ln || 'bad kind ''rumour''' END, CASE WHEN speaker = 'nobody' THEN ln || 'bad speaker ''nobody''' END], lambda x: x IS NOT NULL), '; ') END AS errors FROM e)
"""


@query(_notes + "SELECT no AS line_no, kept, errors FROM r")
def notes_validate(spark, d):
    return N.parse(note_lines(spark, d)).select("line_no", "kept", F.array_join("errors", "; ").alias("errors"))


def rendered(spark, d):
    n = N.notes_of(N.parse(note_lines(spark, d)).select("n", "conv_id", "kept"))
    return N.render_order(n, "conv_id")


@query(_notes + "SELECT conv_id, id, 'ch' || CAST(ch AS VARCHAR) AS chapter, row_number() OVER (PARTITION BY conv_id ORDER BY ch, id) AS place FROM r WHERE kept")
def notes_render_order(spark, d):
    return rendered(spark, d).select("conv_id", "id", "chapter", "place")


@query(_notes + ", w AS (SELECT conv_id, id, ch, lag(ch) OVER (PARTITION BY conv_id ORDER BY ch, id) AS p FROM r WHERE kept) SELECT conv_id, id, 'ch' || CAST(ch AS VARCHAR) AS chapter FROM w WHERE p IS DISTINCT FROM ch")
def heading_breaks(spark, d):
    return rendered(spark, d).where("heading").select("conv_id", "id", "chapter")


@query(_notes + """SELECT conv_id, id, md5(CASE WHEN lag(ch) OVER w IS DISTINCT FROM ch THEN '## ch' || CAST(ch AS VARCHAR) || chr(10) || chr(10) ELSE '' END || '### ' || id || chr(10) || chr(10) || claim || chr(10) || chr(10) ||
  CASE speaker WHEN 'conversation' THEN '**Attribution: came out of a conversation, not from the book.**' || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN kind = 'figure' THEN '**From a page image, not from text.** Evidence: `' || evidence || '`' || chr(10) || chr(10) || '![' || id || '](' || evidence || ')' ELSE '> ' || replace(trim(quote, chr(10) || ' '), chr(10), ' ') END ||
  chr(10) || chr(10) || '`' || locator || '` · ' || kind || ' · ' || scope || chr(10)) AS md_md5 FROM r WHERE kept WINDOW w AS (PARTITION BY conv_id ORDER BY ch, id)""")
def notes_markdown(spark, d):
    n = N.notes_of(N.parse(note_lines(spark, d)).select("n", "conv_id", "kept"))
    return N.render(n, "conv_id").select("conv_id", "id", F.md5("md").alias("md_md5"))


_status = """
WITH b AS (SELECT d.doc_id, source || '-' || CAST(d.doc_id AS VARCHAR) AS slug, coalesce(l.n, 0) AS notes, d.doc_id % 3 = 0 AS brief, 1000000 - (d.doc_id % 40) * 60 AS mtime
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
s AS (SELECT *, CASE WHEN notes = 0 THEN 'extracted' WHEN brief THEN 'studied' WHEN 1000000 - mtime < 900 THEN 'in-progress' ELSE 'notes-only' END AS state FROM b)
"""


def book_status(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    b = table(spark, d, "documents").join(lab, "doc_id", "left").select("doc_id", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("slug"), F.coalesce("n", F.lit(0)).cast("long").alias("notes"), (F.col("doc_id") % 3 == 0).alias("brief"), (1000000 - (F.col("doc_id") % 40) * 60).alias("notes_mtime"))
    return ST.states(b, F.lit(1000000))


@query(_status + "SELECT slug, notes, state FROM s")
def status_states(spark, d):
    return book_status(spark, d).select("slug", "notes", "state")


@query(_status + """SELECT 1 AS ord, slug, 'wait: ' || slug || ' looks like a study run still in progress (' || CAST(notes AS VARCHAR) || ' notes so far). Do not restart it.' AS action FROM s WHERE state = 'in-progress'
UNION ALL SELECT 2, slug, 'run study on ' || slug || CASE state WHEN 'notes-only' THEN ' (notes exist but no brief, so the run was interrupted)' ELSE ' (extracted but never studied)' END FROM s WHERE state IN ('extracted', 'notes-only')""")
def next_actions(spark, d):
    return ST.next_actions(book_status(spark, d))


_unextracted = """WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(split_part(url, '?', 1), '#.*$', ''), '^.*://', '') AS stem FROM pages), b AS (SELECT DISTINCT 'example.' || x AS slug FROM (VALUES ('com/de'), ('com/fr'), ('net/en'), ('org')) v(x))
SELECT stem FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE contains(stem, slug))"""


@query(_unextracted)
def unextracted_anti(spark, d):
    return unextracted(spark, d)


def unextracted(spark, d) -> DataFrame:
    stem = F.regexp_replace(F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "#.*$", ""), "^.*://", "")
    src = table(spark, d, "pages").select(stem.alias("stem")).distinct()
    b = spark.createDataFrame([(f"example.{x}",) for x in ("com/de", "com/fr", "net/en", "org")], "slug string")
    return ST.unextracted(src, b)


@query(_status + """, g AS (SELECT d.source, max(s.mtime) AS newest FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE s.state = 'studied' GROUP BY d.source)
SELECT CASE WHEN min(newest) < max(newest) THEN 'rerun synthesis, the notes changed after it last ran' ELSE 'the topic is ready' END AS action FROM g""")
def next_actions_studied(spark, d):
    """The last step of a topic whose books are the studied ones, its synthesis as old as the source whose notes are oldest."""
    s = book_status(spark, d).where("state = 'studied'")
    per = s.withColumn("source", F.regexp_extract("slug", "^(.*)-", 1)).groupBy("source").agg(F.max("notes_mtime").alias("newest"))
    state = per.agg(F.min("newest").alias("m"), F.max("newest").alias("newest")).select(ST.synthesis_state(F.col("m"), F.col("newest")).alias("synthesis"))
    return ST.next_actions(s, synthesis=state).select("action")


@query(f"SELECT 'study the ' || count(*) || ' book(s) not yet extracted: ' || string_agg(stem, ', ' ORDER BY stem) AS action FROM ({_unextracted})")
def next_actions_unextracted(spark, d):
    return ST.next_actions(book_status(spark, d), unextracted(spark, d)).where("ord = 0").select("action")


@query("""SELECT d.doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 50 < 25 THEN 'stale' ELSE 'current' END AS synthesis FROM documents d""")
def synthesis_states(spark, d):
    m = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 50)
    return table(spark, d, "documents").select("doc_id", ST.synthesis_state(m, F.lit(25)).alias("synthesis"))


# ---- given verdicts: bookkeeping of judged stages ----

_verd = """WITH v AS (SELECT doc_id AS note_id, 'entailment' AS stage, 1 AS attempt, 1 AS checker, CASE WHEN quality = 1 THEN 'SUPPORTS' ELSE 'OVERREACHES' END AS verdict FROM labels
UNION ALL SELECT doc_id, 'entailment', 1, 2, CASE WHEN toxic = 0 THEN 'SUPPORTS' ELSE 'OVERREACHES' END FROM labels
UNION ALL SELECT doc_id, 'context', 1, 1, CASE WHEN toxic = 0 THEN 'SOUND' ELSE 'REVERSED' END FROM labels
UNION ALL SELECT doc_id, 'context', 2, 1, 'SOUND' FROM labels WHERE toxic = 1 AND doc_id % 2 = 0)
"""


def given_verdicts(spark, d):
    lab = table(spark, d, "labels")
    v = lambda stage, attempt, checker, verdict, rows=lab: rows.select(F.col("doc_id").alias("note_id"), F.lit(stage).alias("stage"), F.lit(attempt).alias("attempt"), F.lit(checker).alias("checker"), verdict.alias("verdict"))
    ok = F.col("toxic") == 0
    return (
        v("entailment", 1, 1, F.when(F.col("quality") == 1, "SUPPORTS").otherwise("OVERREACHES"))
        .unionByName(v("entailment", 1, 2, F.when(ok, "SUPPORTS").otherwise("OVERREACHES")))
        .unionByName(v("context", 1, 1, F.when(ok, "SOUND").otherwise("REVERSED")))
        .unionByName(v("context", 2, 1, F.lit("SOUND"), lab.where("toxic = 1 and doc_id % 2 = 0")))
    )


@query(_verd + """, l AS (SELECT * FROM v WHERE checker = 1 QUALIFY row_number() OVER (PARTITION BY note_id, stage ORDER BY attempt DESC) = 1)
SELECT stage, count(*) AS notes, count(*) FILTER (verdict IN ('SUPPORTS', 'SOUND')) AS passed, count(*) FILTER (verdict NOT IN ('SUPPORTS', 'SOUND')) AS dropped FROM l GROUP BY stage""")
def stage_funnel(spark, d):
    return N.stage_funnel(given_verdicts(spark, d).where("checker = 1"), {"entailment": "SUPPORTS", "context": "SOUND"})


@query(_verd + "SELECT note_id, stage, count(DISTINCT verdict) AS verdicts, count(*) AS checkers FROM v WHERE attempt = 1 GROUP BY note_id, stage HAVING count(DISTINCT verdict) > 1")
def deep_disagreement(spark, d):
    return N.disagreements(given_verdicts(spark, d).where("attempt = 1"))


@query("""WITH n AS (SELECT doc_id % 40 AS ch, doc_id FROM documents), k AS (SELECT DISTINCT doc_id % 40 AS ch FROM labels WHERE quality = 0)
SELECT n.ch AS chapter, count(*) AS gaps FROM n ANTI JOIN k ON n.ch = k.ch GROUP BY n.ch""")
def coverage_gaps(spark, d):
    args = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("chapter"))
    covered = table(spark, d, "labels").where("quality = 0").select((F.col("doc_id") % 40).alias("chapter")).distinct()
    return args.join(covered, "chapter", "left_anti").groupBy("chapter").agg(F.count("*").alias("gaps"))


@query(_hits + """, spot AS (SELECT h.item_id, h.doc_id, seg.pos FROM h JOIN seg ON h.doc_id = seg.doc_id AND seg."start" <= h.found_at AND h.found_at < seg."end")
SELECT spot.item_id, spot.doc_id, count(*) AS passages, CAST(sum(length(s.body)) AS BIGINT) AS chars FROM spot JOIN seg s ON spot.doc_id = s.doc_id AND s.pos BETWEEN spot.pos - 2 AND spot.pos + 2 GROUP BY spot.item_id, spot.doc_id""")
def context_window(spark, d):
    seg = V.line_segments(books(spark, d))
    at = V.locate(exact_hits(spark, d), seg, "doc_id", "found_at", "pos")
    near = N.context_window(seg, at.select("item_id", "doc_id", "pos"), "doc_id", "pos")
    return near.groupBy("item_id", "doc_id").agg(F.count("*").alias("passages"), F.sum(F.length("body")).alias("chars"))


@query("""SELECT conv_id, count(*) FILTER (turn % 3 = 0) AS supported, count(*) FILTER (turn % 3 = 1) AS flagged, count(*) FILTER (turn % 3 = 2) AS unsupported FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def gate_counts(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").withColumn("verdict", F.element_at(F.array(F.lit("SUPPORTED"), F.lit("FLAGGED"), F.lit("UNSUPPORTED")), (F.col("turn") % 3 + 1).cast("int")))
    return c.groupBy("conv_id").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("SUPPORTED", "FLAGGED", "UNSUPPORTED")])


@query("""WITH t AS (SELECT doc_id, unnest([lang, lang || '-' || source, 's' || CAST(doc_id % 7 AS VARCHAR)]) AS tag, source FROM documents)
SELECT tag, count(DISTINCT source) AS books, count(*) AS notes FROM t GROUP BY tag HAVING count(DISTINCT source) >= 2""")
def tag_clusters(spark, d):
    tags = F.array("lang", F.concat_ws("-", "lang", "source"), F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")))
    t = table(spark, d, "documents").select(F.explode(tags).alias("tag"), "source")
    return t.groupBy("tag").agg(F.count_distinct("source").alias("books"), F.count("*").alias("notes")).where("books >= 2")
