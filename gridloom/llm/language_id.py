"""Language identification: the family first, then linear SVMs between pairs of languages within it.

Features are hashed letter trigrams of the whole text (square roots of their shares, so that every vector has
length one). One linear SVM per family is trained against the rest, and one per pair of languages of a family;
squared hinge loss, accelerated gradient, in numpy. A margin's logistic calibration gives the score.

The models are fitted on the driver from a sample of labelled rows bounded by ``per_lang`` expected ids a language,
chosen by a hash of the id, with one text per id; prediction is a map over all rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is everything if no row is
labelled; a null language is never learned; a null id is never held out nor learned from; repeated rows give
repeated predictions; an empty table gives no rows; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._util import map_texts

DIM_BITS = 13
DIM = 1 << DIM_BITS
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

RUN = 64  # texts whose dense features are held at a time
LETTER = np.arange(256, dtype=np.uint32)
LETTER[[b for b in range(0x80) if not chr(b).isalpha()]] = 0x20


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """One row of hashed trigram shares per text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in enumerate(texts):
        b = LETTER[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code = code[code != 0x202020]
        if len(code):
            at = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)
            out[row] = np.sqrt(np.bincount(at, minlength=DIM) / len(code))
    return out


def compact_features(texts: list[str], run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that some text holds, and the features in these columns alone: others would keep a weight of 0."""
    held = np.zeros(DIM, bool)
    for at in range(0, len(texts), run):
        held |= features(texts[at : at + run]).any(axis=0)
    used = np.flatnonzero(held)
    out = np.empty((len(texts), len(used)), np.float32)
    for at in range(0, len(texts), run):
        out[at : at + run] = features(texts[at : at + run])[:, used]
    return used, out


def fit_svms(x: np.ndarray, targets: np.ndarray, weights: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Linear SVMs, one per column of ``targets`` (+1, -1; weight 0: not used). Rows of the result: weights, bias."""
    n = np.maximum(weights.sum(axis=0), 1e-9)
    w = np.zeros((x.shape[1] + 1, targets.shape[1]), np.float32)
    ahead, t, rate = w.copy(), 1.0, 1 / (2 * 2.0 + penalty)
    for _ in range(steps):
        slack = np.maximum(0, 1 - targets * (x @ ahead[:-1] + ahead[-1])) * targets * weights / n
        step = ahead - rate * (np.vstack([-2 * x.T @ slack, -2 * slack.sum(axis=0)]) + penalty * np.vstack([ahead[:-1], np.zeros((1, w.shape[1]), np.float32)]))
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = (step + (t - 1) / faster * (step - w)).astype(np.float32), step.astype(np.float32), faster
    return w


def fit_slopes(margins: np.ndarray, targets: np.ndarray, weights: np.ndarray, steps: int = 100) -> np.ndarray:
    """Slope of each margin's logistic calibration."""
    slope = np.full(margins.shape[1], 2.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(targets * margins * slope, -30, 30)))
        slope += 2.0 * ((1 - p) * targets * margins * weights).sum(axis=0) / np.maximum(weights.sum(axis=0), 1e-9)
    return np.clip(slope, 0.5, 20.0)


class Model:
    """Family classifiers and pairwise classifiers, in one weight matrix."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({FAMILY_OF.get(code, code) for code in self.langs})
        member = [self.families.index(FAMILY_OF.get(code, code)) for code in self.langs]
        self.members = [[i for i, f in enumerate(member) if f == at] for at in range(len(self.families))]
        self.pairs = [p for group in self.members for p in combinations(group, 2)]
        self.weights, self.slopes = None, None
        own = np.array([self.langs.index(code) for code in langs], np.int64)
        one_family = len(self.families) < 2
        targets, weights = [], []
        share = np.bincount(own, minlength=len(self.langs)) if len(own) else np.zeros(0)
        for at in range(0 if one_family else len(self.families)):
            inside = np.isin(own, self.members[at])
            targets.append(np.where(inside, 1, -1))
            weights.append(np.where(inside, 0.5 / inside.sum(), 0.5 / max(1, (~inside).sum())) * len(own))
        for a, b in self.pairs:
            targets.append(np.where(own == a, 1, -1))
            weights.append(np.where(own == a, 0.5 / share[a], np.where(own == b, 0.5 / share[b], 0)) * (share[a] + share[b]))
        self.n_family = 0 if one_family else len(self.families)
        if targets:
            targets, weights = np.array(targets, np.float32).T, np.array(weights, np.float32).T
            used, x = compact_features(texts)
            w = fit_svms(x, targets, weights)
            self.slopes = fit_slopes(x @ w[:-1] + w[-1], targets, weights)
            self.weights = np.zeros((DIM + 1, w.shape[1]), np.float32)
            self.weights[used], self.weights[-1] = w[:-1], w[-1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        if self.weights is None:
            return [self.langs[0]] * n, np.ones(n)
        margin = features(texts) @ self.weights[:-1] + self.weights[-1]
        chance = 1 / (1 + np.exp(-np.clip(margin * self.slopes, -30, 30)))
        if self.n_family:
            family = margin[:, : self.n_family].argmax(axis=1)
            score = chance[np.arange(n), family]
        else:
            family, score = np.zeros(n, np.int64), np.ones(n)
        best = np.zeros(n, np.int64)
        for at, group in enumerate(self.members):
            rows = np.flatnonzero(family == at)
            votes = np.zeros((len(rows), len(self.langs)))
            least = np.ones((len(rows), len(self.langs)))
            for k, (a, b) in enumerate(self.pairs):
                if a in group:
                    p = chance[rows, self.n_family + k]
                    for lang, q in ((a, p), (b, 1 - p)):
                        votes[:, lang] += (q > 0.5) + q * 1e-3
                        least[:, lang] = np.minimum(least[:, lang], q)
            pick = np.array(group)[votes[:, group].argmax(axis=1)]
            best[rows] = pick
            score[rows] = score[rows] * least[np.arange(len(rows)), pick]
        return [self.langs[i] for i in best], score


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sampled(rows: DataFrame, key: str, label: str, bound: int) -> DataFrame:
    """``rows`` thinned by a hash of ``key`` to at most ``bound`` expected keys per value of ``label``."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row per label
    if not counts:
        return rows.limit(0)
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, float(min(1.0, bound / n)))))
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_003)) < share[F.col(label)] * 1_000_003)


def one_each(rows: DataFrame) -> DataFrame:
    """One row of ``rows (id, label, text)`` per id and label, however often it is repeated: a text chosen by hash."""
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    return rows.groupBy("id", "label").agg(text)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 700) -> Model:
    """A model from the labelled rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND id IS NOT NULL").where(remainder(F.col("id"), 4) != 2)
    picked = one_each(sampled(rows, "id", "lang", per_lang).withColumnRenamed("lang", "label"))
    got = sorted((r.id, r.label, r.text) for r in picked.collect())  # at most about per_lang rows a language
    got = [r for r in got if has_letter(r[2])]
    return Model([r[2] for r in got], [r[1] for r in got])


def answers(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for at in range(0, len(known), RUN):
        run = known[at : at + RUN]
        for i, code, score in zip(run, *model.predict([texts[i] for i in run]), strict=True):
            langs[i], scores[i] = code, float(score)
    return langs, scores


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = answers(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_texts(picked, run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is recognised (not ``und``, score at least ``min_score``)."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = answers(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([code != UNKNOWN and s >= min_score for code, s in zip(langs, scores, strict=True)], pa.bool_()))

    return map_texts(docs, run, docs.schema)
