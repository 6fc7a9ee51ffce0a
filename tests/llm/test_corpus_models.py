"""Alignment, periodic runs and language-model scores against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from gridloom.llm import alignment, lm_scoring, periodic_runs, queries  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "don't", " ", "  ", "\n", "\t", "\r", ";\r", "\r\n", "\xa0", "　", "\x1c", "\x85", "▁", "é", "日本", "🙂", "<|endoftext|>", "</s>", "1", "23", ".", "\x00", "<0x41>", "'s", "​", "﻿"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner(A, B)


def whole(own, text):
    """Token ends of the whole text, from the libraries alone: lists of (id, end) and groups; nothing if not spelt."""
    if not text:
        return [], [], []
    data = (" " + text).encode()
    sides = []
    for ids, spell in ((own.a.encode(" " + text, add_special_tokens=False).ids, own.bytes_a), (own.b.encode(text), own.bytes_b)):
        if b"".join(spell[i] for i in ids) != data:
            return [], [], []
        sides.append(list(zip(ids, np.cumsum([len(spell[i]) for i in ids]).tolist(), strict=True)))
    a, b = sides
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    groups, low = [], 0
    for high in cuts:
        groups.append(([i for i, e in a if low < e <= high], [i for i, e in b if low < e <= high]))
        low = high
    return a, b, groups


def expected_alignments(own, texts):
    parts = [whole(own, t) for t in texts]
    links = [[(i, j) for i, e in a for j, f in b if e == f] for a, b, _ in parts] if sum(map(len, texts)) < 20_000 else [[(x[-1], y[-1]) for x, y in g] for _, _, g in parts]
    count = Counter(link for own_links in links for link in own_links)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (a, b, groups), own_links in zip(parts, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(own_links), sum(count[k] == best[k[1]] for k in own_links), sum(count[k] for k in own_links), digest))
    return out


def test_safe_spaces_and_segments(own):
    assert set(own.cuts) == set(" \t\n\x0b\x0c")  # pieces such as ";\\r" join a return to what is before it
    for text in [*random_texts(3_000), "x" * 5_000, " " * 99, "a \r b\r", "▁▁ x"]:
        segments = own.segments(text)
        assert "".join(segments) == " " + text
        streams = own.streams(segments)
        got = [] if any(s is None for s in streams) else [c for s in streams for c in s]
        _, _, groups = whole(own, text)
        assert got == [c for x, y in groups for c in [i * 4 + (k == 0) for k, i in enumerate(x)] + [i * 4 + 2 + (k == 0) for k, i in enumerate(y)]]


def test_packed_numbers():
    n = np.r_[np.arange(300), 1 << 14, (1 << 14) - 1, 1 << 21, 5, (1 << 28) + 3]
    assert alignment.unpacked(alignment.packed(n)).tolist() == n.tolist()
    assert len(alignment.unpacked(alignment.packed(n[:0]))) == 0


def test_alignment_equals_whole_texts(spark, own, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 500)
    texts = [*random_texts(300, seed=2), "", "same text here", "same text here", "a ▁ b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    for i, want in enumerate(expected_alignments(own, texts)):
        r = rows[i]
        digest = hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, digest) == want, texts[i]


def test_alignment_query(spark, own):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], expected_alignments(own, [d.text or "" for d in docs]), strict=True))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, sf).collect()}
    assert got == want


def test_alignment_odd_rows(odd_docs, no_docs, own):
    rows = alignment.align(odd_docs, A, B).collect()
    assert len(rows) == 13 and alignment.align(no_docs, A, B).collect() == []
    assert {(r.n_a, r.groups) for r in rows if r.doc_id in (3, 4)} == {(0, "")}
    twice = [tuple(r) for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0][1] > 0


def plain_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_runs_equal_brute_force(block, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    rng = random.Random(5)
    for _ in range(1_500):
        n, k = rng.randrange(0, 120), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 3:
                a, p = rng.randrange(n), 1 + rng.randrange(8)
                for i in range(a, rng.randrange(a, n + 1)):
                    w[i] = w[a + (i - a) % p]
        for least in (12, 2):
            assert periodic_runs.runs(np.array(w, np.int64), least) == plain_runs(w, least)


def test_runs_of_long_texts():
    assert periodic_runs.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic_runs.runs(np.arange(300_000) % 70_000) == [(0, 300_000, 70_000)]
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic_runs.runs(np.array(b)) == plain_runs(b)


def test_runs_odd_rows(odd_docs, no_docs):
    rows = periodic_runs.find_runs(odd_docs).collect()
    assert len(rows) == 13 and periodic_runs.find_runs(no_docs).collect() == []
    assert {(r.n_words, len(r.runs), r.collapsed) for r in rows if r.doc_id in (3, 4, 8)} == {(0, 0, "")}
    assert periodic_runs.collapsed("a b c a b c a b c x".split(), [(0, 9, 3)]) == ["a", "b", "c", "x"]


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 60))) for i in range(300)] + [(None, "x y"), (10, None)]
    got = {r.doc_id: r.text for r in queries.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id not in (None, 10)}
    for i, text in rows[:-2]:
        h, words = zlib.crc32(str(i).encode()), text.split()
        if i != 10 and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        if i != 10:
            assert got[i].split() == words


class Trie:
    """The model as a dictionary of contexts, a symbol at a time."""

    def __init__(self, texts):
        self.nodes = defaultdict(Counter)
        for t in texts:
            for ctx, s in self.symbols(t):
                self.nodes[ctx][s] += 1
        for k in range(lm_scoring.ORDER, 0, -1):
            for ctx, node in [(c, n) for c, n in self.nodes.items() if len(c) == k]:
                for s in node:
                    self.nodes[ctx[1:]][s] += 1

    @staticmethod
    def symbols(text):
        data = b"\t" * lm_scoring.ORDER + b" ".join(text.encode().lower().split())
        for i in range(lm_scoring.ORDER, len(data) + 1):
            yield data[i - lm_scoring.ORDER : i], data[i] if i < len(data) else 256

    def chance(self, ctx, s):
        out, p = set(), 1.0
        for k in range(len(ctx), -1, -1):
            node = self.nodes.get(ctx[len(ctx) - k :])
            if not node:
                continue
            free = {x: c for x, c in node.items() if x not in out}
            if not free:
                continue
            total = sum(free.values())
            if s in free:
                return p * (2 * free[s] - (len(node) < 257)) / (2 * total)
            p, out = p * len(free) / (2 * total), set(node)
        return p / (257 - len(out))

    def score(self, text):
        return sum(math.log10(self.chance(c, s)) for c, s in self.symbols(text))


def expected_scores(rows):
    train = [(t or "") for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    model, c = Trie(train), Counter()
    for t in train:
        c.update([*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        yield i, (i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(c[w] > 0 for w in tokens), n, base, model.score(t or ""))


def check_scores(found, rows):
    got, want = defaultdict(list), defaultdict(list)
    for r in found:
        got[r.doc_id].append(tuple(r)[1:])
    for i, w in expected_scores(rows):
        want[i].append(w)
    assert got.keys() == want.keys()
    for i in want:
        for x, y in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def test_scores_equal_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 300)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["ab", "c", " ", "The", "the ", "\n", "é", "日", "\x00", "Z"]) for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(3, None), (7, rows[7][1]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_scores(lm_scoring.score(docs, ~held_out(), held_out()).collect(), rows)


def test_chances_sum_to_one():
    model = Trie(["the cat sat", "the cat ate the rat", "a cab", ""])
    for ctx in (b"\t\t\t\t\t", b" the ", b"zzzzz", b"xxxca", b"at th"):
        assert sum(model.chance(ctx, s) for s in range(257)) == pytest.approx(1.0)


def test_scores_without_training(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (row,) = lm_scoring.score(docs, F.lit(False), F.lit(True)).collect()
    assert (row.train_tokens, row.n_known) == (0, 0)
    assert row.score == pytest.approx(-3 * math.log10(257)) and row.base_score == pytest.approx(2 * math.log10(0.1 / 0.1))


def test_scores_odd_rows(odd_docs, no_docs):
    rows = lm_scoring.score(odd_docs, ~held_out(), held_out()).collect()
    check_scores(rows, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert lm_scoring.score(no_docs, ~held_out(), held_out()).collect() == []


def test_scores_query_and_held_out_gain(spark):
    rows = queries.op13_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
