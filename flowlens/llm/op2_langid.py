"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

Features of a whole text: letters lower-cased, every run of other characters one blank, counts of
two- and three-letter runs hashed to ``DIM`` places, square root of their shares (a unit vector).
Languages are grouped into families by average linkage of their mean vectors; a one-versus-rest linear
SVM per family picks the family, and one-versus-one linear SVMs vote on the language inside it.

Training uses at most ``TRAIN_ROWS`` labelled texts in all, the same number per language, chosen by a
hash of the text. Their features travel as (place, value) lists to one task, which trains and returns the weights; the
driver holds the weights only. The score is the weakest of the decisions that led to the answer, through a logistic curve;
below 0.5 one of them speaks against it.

Cases: a null text or one without a letter is ``und`` with score 0, as is everything when there is no labelled
text; a null doc_id counts as not held out; repeated rows get the same answer; of equal margins the first language in
order wins; a text is read whole whatever its length; an empty table gives no row.
``detect`` reads no extra columns, ``keep_languages`` keeps them.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import crc_mod, map_arrow, text_slices
from flowlens.llm.letters import lowered

DIM = 4_096
TRAIN_ROWS = 4_000
UNDETERMINED = "und"
SPARSE = "lang string, at binary, value binary"


def features(texts: list[str]) -> np.ndarray:
    """Unit feature vectors; a zero row for a text without a letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    cp, lengths = lowered(texts, digits=False)
    ends = np.cumsum(lengths)
    for k, (lo, hi) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
        c = cp[lo:hi]
        if not c.any():
            continue
        c = np.concatenate([[0], c, [0]]).astype(np.uint32)
        c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
        two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(40503)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
        n = np.bincount(two >> np.uint32(20), minlength=DIM) + np.bincount(three >> np.uint32(20), minlength=DIM)
        out[k] = np.sqrt(n / n.sum())
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by accelerated gradient steps; the last column of ``x`` is 1, for the bias."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (4.0 + penalty)  # rows have norm sqrt(2): the gradient changes at most four times as fast as w
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = penalty * v - 2 * (x.T @ (share * y * slack))
        new = v - step * grad
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return w


def families(means: np.ndarray, count: int) -> list[list[int]]:
    """Average-linkage groups of the rows of ``means`` (cosine)."""
    unit = means / np.maximum(1e-12, np.linalg.norm(means, axis=1, keepdims=True))
    near = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > count:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
    return sorted(groups)


@dataclass
class Model:
    langs: list[str]
    groups: list[list[int]]
    family: np.ndarray  # one column of weights per family
    pairs: dict[tuple[int, int], np.ndarray]  # positive: the first language


def train(x: np.ndarray, labels: list[str]) -> Model:
    """The model of unit vectors with a column of ones."""
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels])
    means = np.stack([x[y == i, :DIM].mean(axis=0) for i in range(len(langs))])
    groups = families(means, max(1, int(np.ceil(np.sqrt(len(langs))))))
    of = np.array([next(g for g, m in enumerate(groups) if i in m) for i in range(len(langs))])[y]
    family = np.stack([linear_svm(x, np.where(of == g, 1, -1).astype(np.float32)) for g in range(len(groups))], axis=1) \
        if len(groups) > 1 else np.zeros((DIM + 1, 1), np.float32)
    pairs = {}
    for members in groups:
        for a, b in combinations(members, 2):
            rows = (y == a) | (y == b)
            pairs[a, b] = linear_svm(x[rows], np.where(y[rows] == a, 1, -1).astype(np.float32))
    return Model(langs, groups, family, pairs)


def predict(model: Model, x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Language number and score of each row."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    margins = x @ model.family
    chosen = margins.argmax(axis=1)
    if len(model.groups) > 1:
        top = np.sort(margins, axis=1)
        weakest = (top[:, -1] - top[:, -2]) / 2
    else:
        weakest = np.full(len(x), np.inf)
    out = np.zeros(len(x), np.int64)
    for g, members in enumerate(model.groups):
        rows = np.flatnonzero(chosen == g)
        votes, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        least = np.full((len(rows), len(members)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(members), 2):
            m = x[rows] @ model.pairs[a, b]
            for k, s in ((i, m), (j, -m)):
                votes[:, k] += s > 0
                sums[:, k] += s
                least[:, k] = np.minimum(least[:, k], s)
        best = (votes + 1e-6 * np.tanh(sums)).argmax(axis=1)
        out[rows] = np.array(members)[best]
        weakest[rows] = np.minimum(weakest[rows], least[np.arange(len(rows)), best])
    return out.tolist(), 1 / (1 + np.exp(-4 * np.clip(weakest, -10, 10)))


def training_sample(docs: DataFrame) -> DataFrame | None:
    """(lang, at, value): features of a bounded sample of the labelled, not held-out documents with a letter; None without labels."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & ~F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = max(2, TRAIN_ROWS // len(sizes))
    spark = docs.sparkSession
    # thinned by a hash before the rank, so that no language meets whole in one task
    share = spark.createDataFrame([(k, min(1.0, 2.0 * each / n)) for k, n in sizes.items()], "lang string, share double")
    h = F.xxhash64("text")
    thin = (known.select("text", "lang", h.alias("h")).join(F.broadcast(share), "lang")
            .where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)))
    ranked = thin.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))

    def run(b):
        for lo, hi, texts in text_slices(b.column("text")):
            x = features(texts)
            some = [k for k in range(len(x)) if x[k].any()]
            at = [np.flatnonzero(x[k]).astype(np.uint16) for k in some]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").slice(lo, hi - lo).take(pa.array(some, pa.int64())), pa.array([v.tobytes() for v in at], pa.binary()),
                 pa.array([x[k, v].tobytes() for k, v in zip(some, at)], pa.binary())], names=["lang", "at", "value"])

    return map_arrow(ranked.where(F.col("r") <= each).select("lang", "text"), run, SPARSE)


def train_model(docs: DataFrame) -> Model | None:
    """The model of the labelled texts of ``docs`` (doc_id, text, lang), trained in one task (at most ``TRAIN_ROWS`` rows reach it)."""
    sample = training_sample(docs.select("doc_id", "text", "lang"))
    if sample is None:
        return None

    def fit(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "at", "value"))))
        if rows:
            x = np.zeros((len(rows), DIM + 1), np.float32)
            x[:, DIM] = 1
            for k, (_, at, value) in enumerate(rows):
                x[k, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(x, [r[0] for r in rows]))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def answers(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the text has a letter, of each text."""
    x = features(texts)
    letters = x.any(axis=1)
    lang, score = [UNDETERMINED] * len(x), np.zeros(len(x))
    some = np.flatnonzero(letters) if model else []
    if len(some):
        found, score[some] = predict(model, x[some])
        for i, k in zip(some, found):
            lang[i] = model.langs[k]
    return lang, score, letters


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train_model(docs)

    def run(b):
        for lo, hi, texts in text_slices(b.column("text")):
            lang, score, _ = answers(model, texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(lang), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    found = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, languages: set[str] | None = None, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in one of ``languages`` (None: any that is learned), with a score of ``min_score`` at least.

    A row without a ``lang`` gets the predicted one. Without any labelled text no language is known: the rows that have a letter stay.
    """
    model = train_model(docs)
    place = docs.columns.index("lang")

    def run(b):
        for lo, hi, texts in text_slices(b.column("text")):
            found, score, letters = answers(model, texts)
            rows = b.slice(lo, hi - lo)
            if model:
                keep = [v != UNDETERMINED and s >= min_score and (languages is None or v in languages) for v, s in zip(found, score)]
                given = rows.column(place)
                rows = rows.set_column(place, rows.schema.field(place), pc.coalesce(given, pa.array(found, given.type)))
            else:
                keep = letters.tolist()
            yield rows.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)
