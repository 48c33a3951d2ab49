"""Toxicity severity by cumulative-link (proportional odds) regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all ordered thresholds. x holds
log(1 + count) of the markers: words and word beginnings of PREFIXES code points whose share of toxic
texts exceeds their share of clean ones by MIN_Z standard errors, in MIN_DOCS toxic texts or more; there
is no bound on their number. Grades come from the two labels alone: 0 fit, 1 of poor quality, 2 toxic; a sample
that lacks one has a threshold less. Expected severity is the sum of P(grade > k).

The fit uses at most SAMPLE labelled rows, those with the smallest hash of their id, less a share HELD by
hash that is held out: the cut lies half-way between the logit below which all but CLEAN_LEFT of the held-out
clean texts stay and even odds. Scoring reads every whole text. The weights go to the tasks with the function:
the vocabulary of the sample bounds them.

Defined results: a null or empty text has no features and gets the severity of the bare thresholds;
a doc id with several labels is toxic if one says so, and of poor quality if one says so; without toxic labels in
the sample, all severities are 0; rows alike get alike results; other columns are kept, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, Sealed, ascii_lower, forget, ship, table

SAMPLE, MIN_Z, MIN_DOCS = 20_000, 5.0, 3
HELD, CLEAN_LEFT = 0.2, 0.002
TOXIC = 2
PREFIXES = (4, 5)
LOWERED = str.maketrans(UPPER, LOWER)
WORD = r"[0-9a-z\u0080-￿]+"
L2, ROUNDS = 2e-4, 600


@dataclass
class Model:
    markers: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    #: p_toxic above which a text counts as toxic.
    cut: float = 0.5


def features(text: str | None, at: dict[str, int]) -> dict[int, int]:
    """Marker number: occurrences in the whole text. A beginning is written with a star."""
    out: dict[int, int] = {}
    for w, n in Counter(re.findall(WORD, (text or "").translate(LOWERED))).items():
        for f in (w, *[w[:k] + "*" for k in PREFIXES if len(w) > k]):
            if (i := at.get(f)) is not None:
                out[i] = out.get(i, 0) + n
    return out


def fit_ordinal(rows, at, x, m: int, y, grades: int, rounds: int = ROUNDS, l2: float = L2, rate: float = 0.1):
    """Weights and increasing thresholds by full-batch Adam on the mean log-likelihood.

    Value x[i] stands in row rows[i], ascending, and column at[i] < m; y in 0..grades-1.
    """
    import numpy as np

    n = len(y)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / n, 1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    # thresholds are a first one and logs of the gaps, which keeps them in order
    p = np.concatenate([np.zeros(m), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -35, 35)))
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, gaps = p[:m], np.exp(p[m + 1 :])
        th = p[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, x * w[at], n)
        hi = np.where(y < grades - 1, sig(th[np.minimum(y, grades - 2)] - z), 1.0)
        lo = np.where(y > 0, sig(th[np.maximum(y - 1, 0)] - z), 0.0)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g_th = np.bincount(np.minimum(y, grades - 2), d_hi * (y < grades - 1), grades - 1) - np.bincount(np.maximum(y - 1, 0), d_lo * (y > 0), grades - 1)
        g_w = np.bincount(at, x * (d_lo - d_hi)[rows], m) / n - l2 * w
        g = np.concatenate([g_w, [g_th.sum() / n], np.array([g_th[k + 1 :].sum() for k in range(grades - 2)]) / n * gaps])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])


def beginnings(words: str, k: int):
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", quality: str = "quality", sample: int = SAMPLE) -> Model:
    ship(__name__)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = labels.select(F.col(key).alias("id"), F.col(toxic).alias("t"), F.col(quality).alias("q")).where("id is not null and t is not null")
    marks = known.groupBy("id").agg(F.max("t").alias("t"), F.min("q").alias("q")).select("id", F.when(F.col("t") > 0, TOXIC).when(F.col("q") <= 0, 1).otherwise(0).alias("grade"))
    chosen = marks.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col("key") == F.col("id")).groupBy("text").agg(F.max("grade").alias("grade"))  # copies count once
    held = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1000)) < int(1000 * HELD)
    fit = rows.where(~held)
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)))
    n1, n0 = fit.agg(F.count_if(F.col("grade") == TOXIC), F.count_if(F.col("grade") < TOXIC)).first()
    if not n1 or not n0:
        return Model()
    each = fit.select("grade", words.alias("w")).select("grade", F.explode(F.array_distinct(F.concat("w", *[beginnings("w", k) for k in PREFIXES]))).alias("w"))
    seen = each.groupBy("w").agg(F.count_if(F.col("grade") == TOXIC).alias("b"), F.count("*").alias("n")).where(F.col("b") >= MIN_DOCS)
    p = F.col("n") / (n1 + n0)
    z = (F.col("b") / n1 - (F.col("n") - F.col("b")) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    markers = sorted(r.w for r in seen.where(p < 1).where(z >= MIN_Z).select("w").collect())  # words of the bounded sample
    if not markers:
        return Model()
    return fit_rows(rows.select("text", "grade", held.alias("held")), markers)


def fit_rows(rows: DataFrame, markers: list[str]) -> Model:
    """Fits on rows (text, grade, held), of which there are no more than the sample's bound."""
    import numpy as np

    at = {w: i for i, w in enumerate(markers)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        for b in batches:
            got = [features(t.as_py(), at) for t in b.column(0)]
            lists = [pa.array([list(f(g)) for g in got], pa.list_(pa.int32())) for f in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *lists], ["grade", "held", "at", "n"])

    got = rows.mapInArrow(run, "grade int, held boolean, at array<int>, n array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["grade"], r["at"], r["n"]))  # task order must not change the fit

    def sparse(some: list[dict]):
        sizes = [len(r["at"]) for r in some]
        flat = lambda c: np.array([v for r in some for v in r[c]], np.int64)
        return np.repeat(np.arange(len(some)), sizes), flat("at"), np.log1p(flat("n"))

    fit, held = [r for r in got if not r["held"]], [r for r in got if r["held"] and r["grade"] < TOXIC]
    y = np.unique([r["grade"] for r in fit], return_inverse=True)[1]  # grades present, from 0
    w, th = fit_ordinal(*sparse(fit), len(markers), y, int(y.max()) + 1)
    rows_, at_, x = sparse(held or [r for r in fit if r["grade"] < TOXIC])
    logits = np.sort(np.bincount(rows_, x * w[at_], max(len(held), 1)) - th[-1])
    z = logits[int((len(logits) - 1) * (1 - CLEAN_LEFT))]
    return Model(markers, w.tolist(), th.tolist(), float(1 / (1 + np.exp(-min(z / 2, 0.0)))))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with severity (expected grade), p_toxic (of the last grade) and n_markers; underscores go in front where docs has such a column."""
    ship(__name__)
    sealed, zero = Sealed(docs), {"severity": F.lit(0.0), "p_toxic": F.lit(0.0), "n_markers": F.lit(0).cast("long")}
    if not model.markers:
        return sealed.open(sealed.rows, **zero)
    at, weights, thresholds = {w: i for i, w in enumerate(model.markers)}, model.weights, model.thresholds
    import pyarrow as pa

    kinds = {"severity": "double", "p_toxic": "double", "n_markers": "long"}

    def run(texts):
        import math

        import pyarrow as pa

        forget()
        out = []
        for t in texts:  # one text at a time is a Python string
            f = features(t.as_py(), at)
            z = sum(weights[i] * math.log1p(n) for i, n in sorted(f.items()))
            above = [1 / (1 + math.exp(min(max(th - z, -35), 35))) for th in thresholds]
            out.append((sum(above), above[-1], sum(f.values())))
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.float64(), pa.float64(), pa.int64()))]
        return pa.StructArray.from_arrays(columns, list(kinds))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    return sealed.open(sealed.rows.withColumn("_tox", udf(F.col(sealed[text]))), **{c: F.col(f"_tox.{c}") for c in zero})


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model does not hold for toxic, in their own columns."""
    sealed = Sealed(docs)
    return sealed.open(score(sealed.rows, model, sealed[text]).where(F.col("p_toxic") <= model.cut))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    s = score(docs, model)
    return s.select("doc_id", F.round("severity", 9).alias("severity"), F.round("p_toxic", 9).alias("p_toxic"), "n_markers", (F.col("p_toxic") > model.cut).alias("toxic"))
