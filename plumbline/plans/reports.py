"""Queries of the reports and bookkeeping tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import notes as N
from plumbline.operators import pages as P
from plumbline.operators import quality as Q
from plumbline.operators import reports as R
from plumbline.operators import verify as V
from plumbline.plans.queries import _bk, _metric, _notes, alnum_sql, books, given_verdicts, norm_sql, note_lines, query
from plumbline.session import table

# ---- verification records ----


def sections(spark, d) -> tuple[DataFrame, DataFrame]:
    """Pages, which are a text's lines, and chapters, which are four of them."""
    pages = V.line_segments(books(spark, d)).drop("body")
    n = (F.floor((F.col("pos") - 1) / 4) + 1).cast("long")
    ch = pages.groupBy("doc_id", n.alias("pos")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return pages, ch.withColumn("label", F.concat(F.lit("ch"), F.col("pos").cast("string")))


def claims(spark, d) -> DataFrame:
    """A note on each document, in seven kinds, from a plain quote to one that is not there."""
    k, mid, third = F.col("doc_id") % 7, F.floor(F.length("text") / 2).cast("int") + 1, F.floor(F.length("text") / 3).cast("int") + 1
    cut = lambda at, n: F.substring(F.col("text"), at, F.lit(n))
    quote = (
        F.when(k == 1, F.translate(cut(mid, 60), T.LOWER, T.UPPER))
        .when(k == 2, F.concat(cut(third, 40), F.lit(" ... "), cut(third + 60, 40)))
        .when(k == 3, F.reverse(cut(F.lit(1), 80)))
        .when(k == 4, F.lit(None))
        .when(k == 5, F.concat(cut(mid, 10), F.lit("­"), cut(mid + 10, 50)))
        .otherwise(cut(mid, 60))
    )
    locator = F.concat(F.lit("Ch. 1 / p. "), (F.col("doc_id") % 4 + 1).cast("string"))
    return books(spark, d).where("text is not null").select(
        "doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), quote.alias("quote"), locator.alias("locator"),
        F.when(k == 4, "figure").otherwise("claim").alias("kind"), F.when(k == 4, F.concat(F.lit("pages/"), (F.col("doc_id") % 3).cast("string"), F.lit(".png"))).alias("evidence"),
    )


def records(spark, d) -> DataFrame:
    files = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("pages/0.png"), F.lit("pages/1.png"))).alias("path"))
    return V.verify_notes(claims(spark, d), books(spark, d), *sections(spark, d), files, "doc_id")


_parts = ", ".join(f"{form(c)} AS {p}{i}" for p, form in (("f", lambda c: f"trim({norm_sql(c)})"), ("a", lambda c: alnum_sql(c))) for i, c in ((1, "q1"), (2, "q2")))


def _level(name: str, t: str, p: str) -> str:
    """Whether the parts stand in a text in order, and where, from 0."""
    a, b = f"{p}1", f"{p}2"
    rest = f"strpos(substr({t}, strpos({t}, {a}) + length({a})), {b})"
    return f"CASE WHEN {a} <> '' AND contains({t}, {a}) AND (q2 IS NULL OR (length({a}) >= 12 AND length({b}) >= 12 AND {rest} > 0 AND {rest} - 1 <= 3000)) THEN strpos({t}, {a}) - 1 END AS {name}"


_records = f"""
WITH k AS (SELECT doc_id, text, doc_id % 7 AS k, length(text) // 2 + 1 AS mid, length(text) // 3 + 1 AS third FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, k, 'n' || CAST(doc_id AS VARCHAR) AS id, doc_id % 4 + 1 AS cp, 'Ch. 1 / p. ' || CAST(doc_id % 4 + 1 AS VARCHAR) AS locator,
  CASE k WHEN 1 THEN translate(substr(text, mid, 60), '{T.LOWER}', '{T.UPPER}') WHEN 2 THEN substr(text, third, 40) WHEN 3 THEN reverse(substr(text, 1, 80)) WHEN 5 THEN substr(text, mid, 10) || '­' || substr(text, mid + 10, 50) ELSE substr(text, mid, 60) END AS q1,
  CASE k WHEN 2 THEN nullif(trim(substr(text, third + 60, 40)), '') END AS q2 FROM k),
p AS (SELECT *, {norm_sql('text')} AS body, {alnum_sql('text')} AS bare, {_parts} FROM c),
l AS (SELECT *, {_level('e', 'text', 'f')}, {_level('n', 'body', 'f')}, {_level('u', 'bare', 'a')} FROM p WHERE k <> 4),
v AS (SELECT *, CASE WHEN e IS NOT NULL THEN 'EXACT' WHEN n IS NOT NULL THEN 'NORMALIZED' WHEN u IS NOT NULL THEN 'PUNCT' END AS level FROM l),
x AS (SELECT doc_id, level, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM v WHERE level IN ('NORMALIZED', 'PUNCT')),
w AS (SELECT doc_id, i, CASE WHEN level = 'PUNCT' THEN length({alnum_sql('c')}) WHEN regexp_matches(c, '\\s') AND coalesce(regexp_matches(lag(c) OVER o, '\\s'), false) THEN 0 ELSE 1 END AS m FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, m, sum(m) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS hi FROM w),
f AS (SELECT v.*, CASE level WHEN 'EXACT' THEN e ELSE s.i END AS o FROM v LEFT JOIN s ON v.doc_id = s.doc_id AND m > 0 AND hi - m <= CASE level WHEN 'NORMALIZED' THEN n WHEN 'PUNCT' THEN u END AND hi > CASE level WHEN 'NORMALIZED' THEN n WHEN 'PUNCT' THEN u END),
g AS (SELECT *, length(left(text, o)) - length(replace(left(text, o), chr(10), '')) + 1 AS page FROM f),
h AS (SELECT *, 'ch' || CAST((page - 1) // 4 + 1 AS VARCHAR) || ' / p.' || CAST(page AS VARCHAR) AS spot, level IS NOT NULL AND (page - 1) // 4 <> 0 AND page <> cp AS off FROM g),
r AS (SELECT doc_id, id, CASE WHEN level IS NULL THEN 'FAIL' WHEN off THEN 'LOCATOR_MISMATCH' ELSE 'PASS' END AS status, level, CAST(o AS BIGINT) AS found_at, CASE WHEN level IS NOT NULL THEN spot END AS found_locator,
  array_to_string(list_filter([CASE WHEN level IS NULL THEN '{V.NO_QUOTE}' END, CASE WHEN off THEN 'locator says ''' || locator || ''' but the quote is at ''' || spot || '''' END, CASE WHEN level = 'PUNCT' THEN '{V.BY_LETTERS.replace("'", "''")}' END], lambda x: x IS NOT NULL), '; ') AS issues, NULL::VARCHAR AS evidence_path FROM h
  UNION ALL SELECT doc_id, id, CASE WHEN doc_id % 3 < 2 THEN 'FIGURE' ELSE 'FAIL' END, 'IMAGE', NULL, locator, CASE WHEN doc_id % 3 < 2 THEN '{V.FROM_IMAGE}' ELSE 'evidence image not found: pages/' || CAST(doc_id % 3 AS VARCHAR) || '.png' END, CASE WHEN doc_id % 3 < 2 THEN 'pages/' || CAST(doc_id % 3 AS VARCHAR) || '.png' END FROM c WHERE k = 4),
strict AS (SELECT * FROM r WHERE status IN ('FAIL', 'LOCATOR_MISMATCH') OR (level = 'PUNCT' AND status = 'PASS'))
"""


@query(_records + "SELECT * FROM r WHERE level IS NULL OR level <> 'IMAGE'")
def note_verification(spark, d):
    return records(spark, d).where("level is null or level <> 'IMAGE'").withColumn("issues", F.array_join("issues", "; "))


@query(_records + "SELECT * FROM r WHERE level = 'IMAGE'")
def figure_verification(spark, d):
    return records(spark, d).where("level = 'IMAGE'").withColumn("issues", F.array_join("issues", "; "))


@query(_records + "SELECT DISTINCT id FROM strict")
def verify_strict_drops(spark, d):
    return V.failing(records(spark, d), strict=True).select("id").distinct()


@query(_records + """, t AS (SELECT r.*, lang FROM r JOIN documents USING (doc_id)), drops AS (SELECT lang, string_agg(DISTINCT id, ',' ORDER BY id) AS must_drop FROM documents JOIN strict USING (doc_id) GROUP BY lang)
SELECT t.lang, count(*) AS notes, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, count(*) FILTER (level = 'EXACT') AS exact, count(*) FILTER (level = 'NORMALIZED') AS normalized, count(*) FILTER (level = 'PUNCT') AS punct, any_value(must_drop) AS must_drop, any_value(must_drop) IS NULL AS ok
FROM t LEFT JOIN drops USING (lang) GROUP BY t.lang""")
def verification_report(spark, d):
    r = records(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    out = V.report(r, "lang", strict=True)
    levels = [F.col("levels")[v].alias(v.lower()) for v in V.LEVELS]
    return out.select("lang", "notes", F.array_join(F.array_sort(F.map_keys("counts")), ",").alias("statuses"), *levels, F.when(F.size("must_drop") > 0, F.array_join("must_drop", ",")).alias("must_drop"), "ok")


@query(_records + "SELECT lang AS topic, count(DISTINCT doc_id) AS books, bool_and(status <> 'FAIL') AS ready FROM r JOIN documents USING (doc_id) GROUP BY lang")
def topics_ready(spark, d):
    per = V.report(records(spark, d), "doc_id").join(table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic")), "doc_id")
    return R.topics_ready(per, "topic")


# ---- extraction reports ----

_inv = """inv AS (SELECT l_orderkey AS doc_id, 'p.' || CAST(l_linenumber AS VARCHAR) AS label, l_linenumber AS page, max(CAST(floor(l_extendedprice) AS INT) % 1200) >= 200 AND max(CAST(floor(l_quantity) AS INT) * 25) >= 200 AS figure,
  max(CAST(floor(l_extendedprice) AS INT) % 1200) >= 700 AND max(CAST(floor(l_quantity) AS INT) * 25) >= 900 AS full_page FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_prov = f"{_inv}, pv AS (SELECT d.doc_id, length(text) AS total_chars, CASE WHEN count(*) FILTER (full_page) / greatest(count(page), 1)::DOUBLE >= 0.8 AND length(text) / greatest(count(page), 1)::DOUBLE < 2500 THEN 'ocr-suspected' ELSE 'native' END AS provenance FROM documents d LEFT JOIN inv ON d.doc_id = inv.doc_id GROUP BY d.doc_id, text)"
_judged = _metric.replace("v AS (SELECT m.*, md.median_chars,", _prov + ", v AS (SELECT m.*, md.median_chars, inv.doc_id IS NOT NULL AS has_figure,").replace("chars < 80 AND pos % 5 = 0 AND {fig}", "chars < 80 AND inv.doc_id IS NOT NULL").replace("FROM m JOIN md ON m.doc_id = md.doc_id)", "FROM m JOIN md ON m.doc_id = md.doc_id LEFT JOIN inv ON figure AND m.doc_id = inv.doc_id AND m.label = inv.label)")
_report = _judged + _bk + """, ls AS (SELECT v.doc_id, coalesce(string_agg(label, ',' ORDER BY pos) FILTER (has_figure AND (provenance = 'native' OR chars < median_chars * 0.4)), '') AS visual,
  coalesce(string_agg(label, ',' ORDER BY pos) FILTER (verdict = 'IMAGE_ONLY'), '') AS image_only_labels, coalesce(string_agg(label, ',' ORDER BY CASE verdict WHEN 'GARBLED' THEN 0 ELSE 1 END, pos) FILTER (verdict IN ('GARBLED', 'EMPTY')), '') AS excluded
  FROM v JOIN pv ON v.doc_id = pv.doc_id GROUP BY v.doc_id),
rep AS (SELECT o.*, visual, image_only_labels, excluded, total_chars, provenance, overall = 'OK' AS passes FROM o JOIN ls ON o.doc_id = ls.doc_id JOIN pv ON o.doc_id = pv.doc_id)
"""


def images(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.floor("l_extendedprice").cast("int") % 1200).alias("width"), (F.floor("l_quantity").cast("int") * 25).alias("height"))
    return P.inventory(li, "doc_id").withColumn("label", F.concat(F.lit("p."), F.col("page").cast("string")))


def report_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    inv = images(spark, d)
    pages = inv.groupBy("doc_id").agg(F.count_if("full_page").alias("full"), F.count("*").alias("n"))
    b = table(spark, d, "documents").select("doc_id", F.length("text").alias("total_chars")).join(pages, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    b = b.select("doc_id", "total_chars", P.provenance(F.lit(None), zero("full"), zero("n"), F.col("total_chars")).alias("provenance"))
    scored = Q.metrics(V.line_segments(books(spark, d)).select("doc_id", "pos", "label", "body")).drop("body")
    return R.with_figures(scored, inv, "doc_id"), b


@query(_judged + "SELECT doc_id, label, has_figure, verdict FROM v WHERE has_figure")
def figure_sections(spark, d):
    scored, _ = report_inputs(spark, d)
    return Q.verdicts(scored, "doc_id", "has_figure").where("has_figure").select("doc_id", "label", "has_figure", "verdict")


@query(_report + "SELECT * FROM rep")
def extraction_report(spark, d):
    r = R.extraction(*report_inputs(spark, d), "doc_id")
    return r.withColumns({c: F.array_join(c, ",") for c in ("visual", "image_only_labels", "excluded")})


_pct = lambda c: f"CAST(CAST(round(CAST({c} AS DECIMAL(12,4)) * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_one = "CAST(CAST(round(CAST(avg_word_len AS DECIMAL(12,2)), 1) AS DECIMAL(12,1)) AS VARCHAR)"
_why = f"""array_to_string(list_filter([CASE WHEN alnum_ratio < 0.55 THEN 'only ' || {_pct('alnum_ratio')} || ' letters and digits' END, CASE WHEN avg_word_len > 12.0 THEN 'average word length ' || {_one} || ', spaces likely lost' END,
  CASE WHEN long_token_ratio > 0.04 THEN {_pct('long_token_ratio')} || ' of tokens over 25 characters' END, CASE WHEN replacement_ratio > 0.002 THEN 'unreadable characters present' END], lambda x: x IS NOT NULL), '; ')"""


@query(_report + f""", ln AS (SELECT doc_id, string_agg('| ' || label || ' | ' || format('{{:,}}', chars) || ' | ' || {_pct('alnum_ratio')} || ' | ' || {_one} || ' | ' || CASE WHEN has_figure THEN 'yes' ELSE '' END || ' | ' || verdict || ' | ' ||
  CASE verdict WHEN 'GARBLED' THEN {_why} ELSE '' END || ' |', chr(10) ORDER BY pos) AS lines FROM v GROUP BY doc_id),
z AS (SELECT rep.*, lines, CASE WHEN excluded = '' THEN [] ELSE string_split(excluded, ',') END AS ex, CASE WHEN visual = '' THEN [] ELSE string_split(visual, ',') END AS vi FROM rep JOIN ln ON rep.doc_id = ln.doc_id)
SELECT doc_id, md5('# Extraction report: ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'Extracted ' || format('{{:,}}', total_chars) || ' characters across ' || CAST(sections AS VARCHAR) || ' pages.' || chr(10) || chr(10) || 'Text provenance: **' || provenance || '**.' || chr(10) || chr(10) ||
  '{R.TABLE_HEAD.replace(chr(10), "' || chr(10) || '")}' || chr(10) || lines || chr(10) || chr(10) || '## Verdict: ' || overall || chr(10) || chr(10) ||
  CASE overall WHEN 'UNUSABLE' THEN replace('{R.VERDICTS["UNUSABLE"]}', '%s', {_pct('fail_rate')}) WHEN 'DEGRADED' THEN '**' || CAST(len(ex) AS VARCHAR) || ' of ' || CAST(sections AS VARCHAR) || ' sections failed the gate and are excluded from study.**' ELSE '{R.VERDICTS["OK"]}' END ||
  CASE WHEN len(ex) > 0 THEN chr(10) || chr(10) || 'Excluded sections:' || chr(10) || chr(10) || array_to_string(list_transform(ex, lambda x: '- `' || x || '`'), chr(10)) ELSE '' END ||
  CASE WHEN len(vi) > 0 THEN chr(10) || chr(10) || '## Visual pass' || chr(10) || chr(10) || 'Pages: ' || array_to_string(list_transform(vi[1:60], lambda x: '`' || x || '`'), ', ') || CASE WHEN len(vi) > 60 THEN ' ...' ELSE '' END ELSE '' END) AS md_md5 FROM z""")
def extraction_markdown(spark, d):
    return R.extraction_markdown(*report_inputs(spark, d), "doc_id").select("doc_id", F.md5("md").alias("md_md5"))


# ---- page selection ----

_select = _report + """, b AS (SELECT doc_id, length(text) % 97 AS total, CASE WHEN doc_id % 4 = 0 THEN '2,' || CAST(doc_id % 9 AS VARCHAR) || '-' || CAST(doc_id % 9 + 3 AS VARCHAR) END AS spec, doc_id % 4 = 1 AS from_report, doc_id % 4 = 2 OR doc_id % 8 = 1 AS with_images, 12 AS sample FROM documents),
sel AS (SELECT doc_id, total, 2 AS page FROM b WHERE spec IS NOT NULL UNION ALL SELECT doc_id, total, unnest(range(doc_id % 9, doc_id % 9 + 4)) FROM b WHERE spec IS NOT NULL
  UNION ALL SELECT b.doc_id, total, page FROM b JOIN rep USING (doc_id) JOIN inv ON inv.doc_id = b.doc_id AND list_contains(string_split(visual, ','), inv.label) WHERE b.from_report
  UNION ALL SELECT b.doc_id, total, page FROM b JOIN inv ON inv.doc_id = b.doc_id AND figure WHERE spec IS NULL AND NOT from_report AND with_images
  UNION ALL SELECT doc_id, total, CASE WHEN 12 >= total THEN i + 1 ELSE greatest(1, least(total, floor(i * (total / 12.0)) + 1)) END FROM (SELECT *, unnest(range(0, least(12, total))) AS i FROM b WHERE spec IS NULL AND NOT from_report AND NOT with_images)),
pg AS (SELECT DISTINCT doc_id, CAST(page AS BIGINT) AS page, format('p{:04d}.png', CAST(page AS BIGINT)) AS file FROM sel WHERE page BETWEEN 1 AND total)
"""


def selection(spark, d) -> DataFrame:
    no = F.col("doc_id") % 4
    spec = F.when(no == 0, F.format_string("2,%d-%d", F.col("doc_id") % 9, F.col("doc_id") % 9 + 3))
    b = table(spark, d, "documents").select("doc_id", (F.length("text") % 97).alias("total"), spec.alias("spec"), (no == 1).alias("from_report"), ((no == 2) | (F.col("doc_id") % 8 == 1)).alias("with_images"), F.lit(12).alias("sample"))
    listed = R.extraction(*report_inputs(spark, d), "doc_id").select("doc_id", F.explode("visual").alias("label"))
    return R.selected_pages(b, images(spark, d), listed, "doc_id")


@query(_select + "SELECT * FROM pg")
def page_manifest(spark, d):
    return selection(spark, d)


@query(_select + "SELECT * FROM pg WHERE NOT (page % 3 = 0)")
def pages_to_render(spark, d):
    done = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(3), F.lit(99), F.lit(3))).alias("n")).select("doc_id", F.format_string("p%04d.png", "n").alias("file"))
    return R.to_render(selection(spark, d), done, "doc_id")


# ---- rendered notes ----

_doc = _notes + f""", x AS (SELECT *, lag(ch) OVER w IS DISTINCT FROM ch AS heading, row_number() OVER w AS place FROM r WHERE kept WINDOW w AS (PARTITION BY conv_id ORDER BY ch, id)),
y AS (SELECT conv_id, count(*) AS notes, string_agg(CASE WHEN heading THEN '## ch' || CAST(ch AS VARCHAR) || chr(10) || chr(10) ELSE '' END || '### ' || id || chr(10) || chr(10) || claim || chr(10) || chr(10) ||
  CASE speaker WHEN 'conversation' THEN '**Attribution: came out of a conversation, not from the book.**' || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN kind = 'figure' THEN '**From a page image, not from text.** Evidence: `' || evidence || '`' || chr(10) || chr(10) || '![' || id || '](' || evidence || ')' ELSE '> ' || replace(regexp_replace(quote, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') END ||
  chr(10) || chr(10) || '`' || locator || '` · ' || kind || ' · ' || scope || chr(10), chr(10) ORDER BY place) AS blocks FROM x GROUP BY conv_id),
q AS (SELECT conv_id, count(*) AS dropped FROM r WHERE NOT kept GROUP BY conv_id),
z AS (SELECT y.conv_id, notes, coalesce(dropped, 0) AS dropped, blocks FROM y LEFT JOIN q ON y.conv_id = q.conv_id)
SELECT conv_id, notes, notes AS unverified, dropped, md5('{R.HEAD.replace(chr(10), "' || chr(10) || '")}' || CAST(notes AS VARCHAR) || ' notes.' || chr(10) || chr(10) || replace('{R.UNVERIFIED.replace(chr(10), "' || chr(10) || '")}', '%s', CAST(notes AS VARCHAR)) || blocks ||
  CASE WHEN dropped > 0 THEN chr(10) || replace('{R.DROPPED.replace(chr(10), "' || chr(10) || '")}', '%s', CAST(dropped AS VARCHAR)) ELSE '' END) AS md_md5 FROM z
"""


@query(_doc)
def notes_documents(spark, d):
    parsed = N.parse(note_lines(spark, d))
    notes = N.notes_of(parsed.select("n", "conv_id", "kept"))
    lost = parsed.where("not kept").groupBy("conv_id").agg(F.count("*").alias("rejected"))
    return R.notes_document(notes, lost, "conv_id").select("conv_id", "notes", "unverified", "dropped", F.md5("md").alias("md_md5"))


# ---- status over tables ----

_topic = """
WITH n AS (SELECT conv_id AS doc_id, count(*) AS notes, count(*) FILTER (role = 'assistant') AS figure_notes, max(floor(epoch(ts))) AS notes_mtime FROM conversations LEFT JOIN events ON event_id = conv_id GROUP BY conv_id),
x AS (SELECT doc_id, count(*) AS rejected FROM labels WHERE quality = 0 GROUP BY doc_id),
m AS (SELECT page_id AS doc_id, min(CASE WHEN contains(url, 'example.com') THEN 'native' ELSE 'ocr' END) AS provenance FROM pages GROUP BY page_id),
t AS (SELECT max(floor(epoch(ts))) AS now FROM events),
b AS (SELECT d.doc_id, coalesce(notes, 0) AS notes, coalesce(figure_notes, 0) AS figure_notes, coalesce(rejected, 0) AS rejected, coalesce(provenance, 'unknown') AS provenance, k.item_id IS NOT NULL AS brief, CAST(coalesce(notes_mtime, 0) AS BIGINT) AS notes_mtime
  FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) k ON d.doc_id = k.item_id),
s AS (SELECT b.*, CASE WHEN notes = 0 THEN 'extracted' WHEN brief THEN 'studied' WHEN CAST(now AS BIGINT) - notes_mtime < 900 THEN 'in-progress' ELSE 'notes-only' END AS state FROM b, t)
"""


def topic(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("mtime"))
    notes = table(spark, d, "conversations").join(e, F.col("conv_id") == F.col("event_id"), "left").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "assistant", "figure").otherwise("claim").alias("kind"), "mtime")
    lost = table(spark, d, "labels").where("quality = 0").select("doc_id")
    maps = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.when(F.contains("url", F.lit("example.com")), "native").otherwise("ocr").alias("provenance"))
    briefs = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    now = e.agg(F.max("mtime").alias("now"))
    b = R.topic_books(table(spark, d, "documents").select("doc_id"), notes, lost, maps, briefs, F.lit(0), "doc_id").drop("state")
    return R.ST.states(b.crossJoin(F.broadcast(now)), F.col("now")).drop("now")


@query(_topic + "SELECT * FROM s")
def topic_status(spark, d):
    return topic(spark, d)


@query(_topic + "SELECT max(notes_mtime) AS newest FROM s")
def newest_notes(spark, d):
    return R.newest(topic(spark, d))


# ---- given verdicts ----

_acts = """WITH v AS (SELECT doc_id AS note_id, 'entailment' AS stage, 1 AS attempt, CASE WHEN quality = 1 THEN 'SUPPORTS' ELSE 'OVERREACHES' END AS verdict FROM labels
UNION ALL SELECT doc_id, 'entailment', 1, CASE WHEN toxic = 0 THEN 'SUPPORTS' ELSE 'OVERREACHES' END FROM labels
UNION ALL SELECT doc_id, 'context', 1, CASE WHEN toxic = 0 THEN 'SOUND' ELSE 'REVERSED' END FROM labels
UNION ALL SELECT doc_id, 'context', 2, 'SOUND' FROM labels WHERE toxic = 1 AND doc_id % 2 = 0),
l AS (SELECT note_id, stage, min(verdict) AS verdict, max(verdict) AS other FROM v JOIN (SELECT note_id, stage, max(attempt) AS attempt FROM v GROUP BY ALL) USING (note_id, stage, attempt) GROUP BY note_id, stage),
a AS (SELECT n.doc_id AS note_id, st.stage, l.verdict, CASE WHEN l.verdict IS NULL THEN 'pending' WHEN l.verdict <> other THEN 'drop' WHEN l.verdict IN ('SUPPORTS', 'SOUND') THEN 'pass' WHEN l.verdict = 'OVERREACHES' THEN 'narrow and rerun' WHEN l.verdict = 'REVERSED' THEN 'drop' END AS action
  FROM (SELECT DISTINCT doc_id FROM documents) n CROSS JOIN (VALUES ('entailment'), ('context')) st(stage) LEFT JOIN l ON n.doc_id = l.note_id AND st.stage = l.stage)
"""


def acted(spark, d) -> DataFrame:
    return R.actions(table(spark, d, "documents").select(F.col("doc_id").alias("note_id")), given_verdicts(spark, d), ("entailment", "context"))


@query(_acts + "SELECT * FROM a")
def verdict_actions(spark, d):
    return acted(spark, d)


@query(_acts + ", rec AS (" + _records + """SELECT doc_id AS note_id, level FROM r), f AS (SELECT note_id, min(stage) AS stage FROM a WHERE action = 'drop' GROUP BY note_id)
SELECT 'written' AS part, 'all' AS kind, count(DISTINCT note_id) AS n FROM a UNION ALL SELECT 'kept', 'all', count(DISTINCT note_id) FROM a WHERE note_id NOT IN (SELECT note_id FROM f)
UNION ALL SELECT 'dropped', stage, count(*) FROM f GROUP BY stage UNION ALL SELECT 'level', coalesce(level, 'none'), count(*) FROM rec GROUP BY 2""")
def run_report(spark, d):
    return R.run_report(acted(spark, d), records(spark, d).select(F.col("doc_id").alias("note_id"), "level"))


@query("""WITH p AS (SELECT d.lang, CASE WHEN l.toxic = 1 THEN 'NUMBER-ERROR' WHEN l.quality = 0 THEN 'WORD-ERROR' ELSE 'CLEAN' END AS verdict FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, count(*) AS pages, count(*) FILTER (verdict = 'CLEAN') AS clean, count(*) FILTER (verdict = 'WORD-ERROR') AS word_errors, count(*) FILTER (verdict = 'NUMBER-ERROR') AS number_errors, count(*) FILTER (verdict = 'NUMBER-ERROR') = 0 AS numbers_ok FROM p GROUP BY lang""")
def ocr_audit(spark, d):
    v = F.when(F.col("toxic") == 1, "NUMBER-ERROR").when(F.col("quality") == 0, "WORD-ERROR").otherwise("CLEAN")
    return R.audit(table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("verdict", v), "lang")


@query("""WITH s AS (SELECT conv_id AS draft, turn // 3 AS round, CASE WHEN l.doc_id IS NULL THEN 'UNSUPPORTED' WHEN role = 'user' THEN 'FLAGGED' ELSE 'SUPPORTED' END AS v FROM conversations c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON c.conv_id + c.turn = l.doc_id),
g AS (SELECT draft, round, count(*) FILTER (v = 'SUPPORTED') AS supported, count(*) FILTER (v = 'FLAGGED') AS flagged, count(*) FILTER (v = 'UNSUPPORTED') AS unsupported FROM s GROUP BY draft, round)
SELECT *, CASE WHEN unsupported = 0 THEN 'pass' WHEN sum(CASE WHEN unsupported > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY draft ORDER BY round ROWS UNBOUNDED PRECEDING) >= 2 THEN 'give up' ELSE 'rewrite' END AS outcome FROM g""")
def gate_rounds(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("draft"), F.floor(F.col("turn") / 3).alias("round"), (F.col("conv_id") + F.col("turn")).alias("note_id"), F.when(F.col("role") == "user", "FLAGGED").otherwise("SUPPORTED").alias("verdict"))
    return R.gate(s, table(spark, d, "labels").select(F.col("doc_id").alias("note_id")))


_tagged = """WITH t AS (SELECT d.source AS book, d.doc_id AS note_id, unnest([lang, lang || '-' || source, 's' || CAST(d.doc_id % 7 AS VARCHAR), 'q' || CAST(quality AS VARCHAR) || lang]) AS tag, CASE WHEN toxic = 1 THEN 'against' WHEN quality = 0 THEN 'aside' ELSE 'for' END AS stance, 'p.' || CAST(d.doc_id % 5 AS VARCHAR) AS locator, lang AS word
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE source IS NOT NULL AND lang IS NOT NULL)
"""


def tagged(spark, d) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang", "source").where("source is not null and lang is not null").join(table(spark, d, "labels"), "doc_id")
    tags = F.array("lang", F.concat_ws("-", "lang", "source"), F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("q"), F.col("quality").cast("string"), "lang"))
    stance = F.when(F.col("toxic") == 1, "against").when(F.col("quality") == 0, "aside").otherwise("for")
    return both.select(F.col("source").alias("book"), F.col("doc_id").alias("note_id"), F.explode(tags).alias("tag"), stance.alias("stance"), F.concat(F.lit("p."), (F.col("doc_id") % 5).cast("string")).alias("locator"), F.col("lang").alias("word"))


@query(_tagged + """SELECT tag, count(DISTINCT book) AS books, count(DISTINCT note_id) AS notes, CASE WHEN count(DISTINCT stance) = 1 THEN 'agreement' WHEN bool_or(stance = 'for') AND bool_or(stance = 'against') THEN 'disagreement' ELSE 'talking past' END AS category
FROM t GROUP BY tag HAVING count(DISTINCT book) >= 2""")
def cluster_classes(spark, d):
    return R.clusters(tagged(spark, d))


@query(_tagged + "SELECT tag, min(book) AS book, count(DISTINCT note_id) AS notes FROM t GROUP BY tag HAVING count(DISTINCT book) = 1")
def single_subjects(spark, d):
    return R.only_one(tagged(spark, d))


@query(_tagged + "SELECT tag, string_agg(DISTINCT book, ', ' ORDER BY book) AS books, string_agg(DISTINCT locator, ', ' ORDER BY locator) AS locators, string_agg(DISTINCT word, ', ' ORDER BY word) AS vocabulary FROM t GROUP BY tag")
def subject_index(spark, d):
    return R.subject_index(tagged(spark, d))


@query("SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS BIGINT) AS batch FROM documents")
def note_batches(spark, d):
    return R.batches(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 12")
def chapter_arguments(spark, d):
    a = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars").withColumn("k", F.struct("source", "lang")).withColumn("neg", -F.col("n_chars"))
    return R.major_arguments(a, "k", "neg", "doc_id").select("source", "lang", "doc_id", "place")


@query("SELECT doc_id, lang FROM documents WHERE CAST(('0x' || substr(md5(concat_ws('/', lang, CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) % 5 = 0")
def sampled_chapters(spark, d):
    return R.sampled_chapters(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")
