"""Convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first 4, 5 and 6 bytes, so that
unseen inflections share their stem's. Filters of widths 1 to 3 slide over the whole text, each filter's largest
response is kept (max pooling), and a logistic unit gives the raw score. Buckets that fewer than ``MIN_DOCS``
fitted texts hold are left out. Embeddings start from smoothed class log-odds; everything is then trained by
Adagrad.

Thresholds are chosen by language on rows kept apart from the fitted ones: the pooled one, and for every language
with rows of both classes its own, drawn towards the pooled one as if ``PRIOR`` rows spoke for that. The language is
guessed from the text's own function words; labels, lang, source and ids are no inputs. A calibrated score is the raw one,
stretched so that the language's threshold lies at ``CUT``.

The model is fitted on the driver from a bounded sample: at most about ``positives`` and ``negatives`` labelled
ids, chosen by a hash of the id, with one text per id; scoring is a map over all rows and whole texts.

Defined cases: null and empty texts have no words and get the score of a text without any response; null labels
and ids are not learned from; a doc_id that repeats in the labels counts once, with its largest label; without
rows of both classes every score is the share of label 1; an empty table gives no rows; extra columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._hashing import NOT_ALPHANUMERIC, POWERS, PRIME, mixed
from gridloom.llm._util import map_texts
from gridloom.llm.language_id import one_each, remainder, sampled

BUCKET_BITS = 20
HEADS = (4, 5, 6)
PARTS = 1 + len(HEADS)
MIN_DOCS = 3
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
CUT = 0.7
PRIOR = 30

#: Frequent function words by language, for the guess that picks a threshold.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu den dem auf für im sich",
    "en": "the of and to in is that it for was on with as this by are be from",
    "es": "el los las del que una por con para no su al lo es en y",
    "fr": "le les des est une que qui dans pour pas sur du au et avec un",
    "it": "il gli della che non per una sono con di del nel è",
    "nl": "het een van niet dat zijn voor op met aan ook er",
    "pt": "o os um uma não com para do da em mais dos ao",
}


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (words x parts) and the words' full hashes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros((0, PARTS), np.int64), np.zeros(0, np.uint64)
    edge = np.diff(np.r_[True, NOT_ALPHANUMERIC[raw], True].view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = POWERS.to(len(raw) + 1)
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=upto[1:])
    out = np.empty((len(begin), PARTS), np.int64)
    for part, size in enumerate((None, *HEADS)):
        stop = end if size is None else np.minimum(begin + size, end)
        h = mixed((upto[stop] - upto[begin]) * down[begin] + np.uint64(part * PRIME & (1 << 64) - 1))
        out[:, part] = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if size is None:
            full = h
        else:
            out[end - begin <= size, part] = -1
    return out, full


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return hashed((text or "").lower().encode())


LANGUAGE_WORDS = {code: np.sort(words_of(words)[1]) for code, words in FUNCTION_WORDS.items()}


def guess(full: np.ndarray) -> str:
    """The language with the most function words; ``other`` without any."""
    counts = {code: int((table[np.minimum(np.searchsorted(table, full), len(table) - 1)] == full).sum()) for code, table in LANGUAGE_WORDS.items()}
    best = max(sorted(counts), key=counts.get)
    return best if counts[best] else "other"


class Model:
    """Embeddings, filters, logistic unit and thresholds."""

    def __init__(self, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.row = np.zeros((1 << BUCKET_BITS) + 1, np.int32)  # the last place is bucket -1; row 0 is unknown
        self.base, self.trained = 0.5, False
        self.thresholds: dict[str, float] = {}

    # Training

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64) -> Model:
        n1, n0 = int(y.sum()), int((1 - y).sum())
        self.base = n1 / max(1, n1 + n0)
        if not n1 or not n0:
            return self
        held = [np.unique(d[d >= 0]) for d in docs]
        size = 1 << BUCKET_BITS
        ones = np.bincount(np.concatenate([h for h, v in zip(held, y, strict=True) if v]), minlength=size)
        zeros = np.bincount(np.concatenate([h for h, v in zip(held, y, strict=True) if not v]), minlength=size)
        kept = np.flatnonzero(ones + zeros >= MIN_DOCS)
        self.row[kept] = np.arange(1, len(kept) + 1)
        odds = np.log((ones[kept] + 0.5) / (n1 + 1)) - np.log((zeros[kept] + 0.5) / (n0 + 1))
        odds *= (ones + zeros)[kept] / ((ones + zeros)[kept] + 5)
        rng = self.rng
        self.e = np.zeros((len(kept) + 1, DIM), np.float32)
        self.e[1:] = rng.normal(0, 0.05, (len(kept), DIM))
        self.e[1:, 0] += np.clip(odds, -2, 6) / 4
        self.w = {k: rng.normal(0, 0.3 / k, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            self.w[k][:, 0, :] = np.abs(self.w[k][:, 0, :]) + 0.5 / k
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.v = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.c = np.float32(-1.0)
        self.trained = True
        rows = [self.row[d] for d in docs]
        seen = {}

        def step(name: str, value: np.ndarray, grad: np.ndarray, at=slice(None), rate: float = 0.05) -> None:
            total = seen.setdefault(name, np.full(value.shape, 1e-6, np.float32))
            total[at] += grad * grad
            value[at] -= rate * grad / np.sqrt(total[at])

        self.c = np.array([self.c], np.float32)
        weight = np.where(y == 1, min(5.0, n0 / n1), 1.0)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                ids, starts, lengths = self.laid([rows[i] for i in pick])
                x, z, pool = self.forward(ids, starts, lengths)
                keep = (rng.random(pool.shape) < 0.8) / 0.8
                p = 1 / (1 + np.exp(-np.clip((pool * keep) @ self.v + self.c, -30, 30)))
                g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                gv, gc = (pool * keep).T @ g, np.array([g.sum()], np.float32)
                gp = (g[:, None] * self.v * keep * (pool > 0)).astype(np.float32)
                touched, grads = [], []
                for n, k in enumerate(WIDTHS):
                    own = gp[:, n * FILTERS : (n + 1) * FILTERS]
                    top = np.array([s + z[k][s : s + m].argmax(axis=0) if m else np.full(FILTERS, s) for s, m in zip(starts, lengths, strict=True)])
                    gw = np.empty_like(self.w[k])
                    for j in range(k):
                        gw[j] = np.einsum("bfd,bf->df", x[top + j], own)
                        touched.append(ids[(top + j).ravel()])
                        grads.append((own[:, :, None] * self.w[k][j].T[None]).reshape(-1, DIM))
                    step(f"b{k}", self.b[k], own.sum(axis=0))
                    step(f"w{k}", self.w[k], gw + 1e-4 * self.w[k])
                step("v", self.v, gv + 1e-4 * self.v)
                step("c", self.c, gc)
                touched, grads = np.concatenate(touched), np.concatenate(grads)
                live = np.abs(grads).sum(axis=1) > 0
                unique, back = np.unique(touched[live], return_inverse=True)
                sums = np.zeros((len(unique), DIM), np.float32)
                np.add.at(sums, back.reshape(-1), np.repeat(grads[live], PARTS, axis=0))
                sums, unique = sums[unique > 0], unique[unique > 0]
                step("e", self.e, sums + 1e-4 * self.e[unique], unique)
        return self

    def laid(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts in one array, each followed by unknown words so that no window reaches the next text."""
        gap = max(WIDTHS)
        lengths = np.array([len(r) for r in rows])
        starts = np.r_[0, np.cumsum(lengths + gap)[:-1]]
        ids = np.zeros((int((lengths + gap).sum()), PARTS), np.int32)
        for s, r in zip(starts, rows, strict=True):
            ids[s : s + len(r)] = r
        return ids, starts, lengths

    def forward(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple:
        x = self.e[ids[:, 0]]
        for part in range(1, PARTS):
            x = x + self.e[ids[:, part]]
        z, pool = {}, np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        n = len(ids) - max(WIDTHS)
        full = lengths > 0
        for at, k in enumerate(WIDTHS):
            out = np.broadcast_to(self.b[k], (len(ids), FILTERS)).copy()
            for j in range(k):
                out[:n] += x[j : n + j] @ self.w[k][j]
            z[k] = out
            if full.any():
                edges = np.stack([starts[full], starts[full] + lengths[full]], axis=1).ravel()
                pool[full, at * FILTERS : (at + 1) * FILTERS] = np.maximum(np.maximum.reduceat(out, edges, axis=0)[::2], 0)
        return x, z, pool

    # Scoring

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        if not self.trained:
            return np.full(len(docs), self.base)
        out, run, size = [], [], 0
        for i, d in enumerate(docs):
            run.append(self.row[d])
            size += len(d)
            if size > 20_000 or i == len(docs) - 1:
                pool = self.forward(*self.laid(run))[2]
                out.append(1 / (1 + np.exp(-np.clip(pool @ self.v + self.c, -30, 30))))
                run, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)

    def calibrate(self, docs: list[np.ndarray], langs: list[str], y: np.ndarray) -> Model:
        p = self.raw(docs)
        pooled = self.thresholds[""] = best_threshold(p, y)
        for code in sorted(set(langs)):
            own = np.array([x == code for x in langs])
            if 0 < y[own].sum() < own.sum():
                self.thresholds[code] = (own.sum() * best_threshold(p[own], y[own]) + PRIOR * pooled) / (own.sum() + PRIOR)
        return self

    def threshold(self, code: str) -> float:
        return self.thresholds.get(code, self.thresholds.get("", 0.5))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Raw scores, guessed languages, their thresholds, and calibrated scores."""
        split = [words_of(t) for t in texts]
        p, langs = self.raw([s[0] for s in split]), [guess(s[1]) for s in split]
        t = np.array([self.threshold(code) for code in langs])
        return p, langs, t, np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t)) if len(p) else p


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the largest F1, half way to the next lower score."""
    if not len(y) or not y.sum() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    at = int(np.argmax(f1))
    low = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[at] + low) / 2, 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = 2500, negatives: int = 5000) -> Model:
    """A model from labelled rows that are not held out: four fifths fit it, one fifth sets its thresholds."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    rows = rows.where(remainder(F.col("id"), 3) != 1).groupBy("id").agg(F.max("label").alias("label"))
    few = [sampled(rows.where(F.col("label") == v), "id", "label", bound) for v, bound in ((0, negatives), (1, positives))]
    picked = F.broadcast(few[0].unionByName(few[1]))  # bounded by positives + negatives
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "id")
    got = one_each(texts).select("*", F.pmod(F.xxhash64("text"), F.lit(5)).alias("fold")).collect()  # a row per picked id
    distinct = {r.text: r for r in sorted(got, key=lambda r: (r.id, r.text))}
    used = sorted(distinct.values(), key=lambda r: (r.id, r.text))
    split = {r.text: words_of(r.text) for r in used}
    sides = [[r for r in used if (r.fold == 0) == apart] for apart in (False, True)]
    model = Model().fit([split[r.text][0] for r in sides[0]], np.array([r.label for r in sides[0]], np.int64))
    return model.calibrate([split[r.text][0] for r in sides[1]], [guess(split[r.text][1]) for r in sides[1]], np.array([r.label for r in sides[1]], np.int64))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, raw, lang_guess, threshold, score`` (toxic where raw >= threshold, which is
    where score >= CUT)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw, langs, t, s = shared.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.float64()), pa.array(langs, pa.string()), pa.array(t, pa.float64()), pa.array(s, pa.float64())], ["doc_id", "raw", "lang_guess", "threshold", "score"])

    return map_texts(picked, run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, raw double, lang_guess string, threshold double, score double")
