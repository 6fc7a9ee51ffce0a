"""Packing, token counts, toxicity, decontamination and language identification against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from gridloom.llm import decontamination, language_id, packing, queries, token_counts, toxicity  # noqa: E402

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


SAMPLES = ["", " ", "a", "aaaa" * 999, "don't I'll we've", "x\n\n  y \t z", "<|endoftext|>", "ñandú 🙂 日本語", "12345 6,7.8", "​﻿q", "THE the The", "....!!!!", "a<|endoftext|>b  "]


def test_token_counts_equal_library(library):
    assert token_counts.RankMerger(JSON).count(SAMPLES) == [len(library.encode(s, add_special_tokens=False).ids) for s in SAMPLES]


def test_token_counts_random_words(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde éßñ0!\n'") for _ in range(rng.randrange(200))) for _ in range(200)]
    assert token_counts.RankMerger(JSON).count(texts) == [len(library.encode(s, add_special_tokens=False).ids) for s in texts]


def test_long_words_equal_library_and_rounds(library):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (257, 1_000, 20_000)] + ["a" * 5_000, "ab" * 700, "é" * 900, "x" * 257 + "yz" * 300, "".join(rng.choice("aé日") for _ in range(4_000))]
    own = token_counts.RankMerger(JSON)
    assert own.ordered
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert own.count([" ".join(words), *words]) == [len(library.encode(" ".join(words), add_special_tokens=False).ids), *want]
    short = [w.encode()[:400] for w in words]
    assert own.merged_by_rank(short).tolist() == own.merged_in_rounds(short).tolist()


def test_a_million_random_letters(library):
    import time

    rng = np.random.default_rng(0)
    word = "".join(map(chr, rng.integers(97, 123, 1_000_000)))
    own, begin = token_counts.RankMerger(JSON), time.time()
    assert own.count([word]) == [len(library.encode(word, add_special_tokens=False).ids)]
    assert time.time() - begin < 60  # seconds; in rounds over all symbols this takes many minutes


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 3)
    own = token_counts.RankMerger(JSON)
    assert own.count(["one two three four five", "one six"]) == own.count(["one two three four five", "one six"])
    assert len(own.memo) <= 3


def test_count_tokens_odd_rows(odd_docs, no_docs, library):
    rows = token_counts.count_tokens(odd_docs, JSON).collect()
    texts = defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text or "")
    assert len(rows) == 13
    for r in rows:
        t = texts[r.doc_id][0]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 1024)
    assert token_counts.count_tokens(no_docs, JSON).count() == 0


def check_pieces(rows, expected, size=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, ids in expected.items():
        got = sorted(pieces[doc])
        assert [x for _, part, _ in got for x in part] == ids
        assert {n for _, _, n in got} == {len(ids)}
        at = 0
        for start, part, _ in got:
            assert start == at
            at += len(part)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, len(sequences)


def test_packing_round_trip(odd_docs, no_docs, library):
    rows = packing.pack(odd_docs.where("doc_id IS NULL OR doc_id <> 2"), JSON, RANKS).collect()
    expected = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in odd_docs.collect() if r.doc_id != 2}
    padding, _ = check_pieces(rows, expected)
    assert padding == 0
    assert packing.pack(no_docs, JSON, RANKS).count() == 0
    twice = packing.pack(odd_docs.where("doc_id = 2"), JSON).agg({"length": "sum"}).first()[0]
    assert twice == 2 * (len(library.encode(odd_docs.where("doc_id = 2").first().text, add_special_tokens=False).ids) + 1)


def test_sum_of_squares_whole():
    rng, got = np.random.default_rng(1), []
    packer = packing.SumOfSquares(64, lambda *a: got.append(a))
    docs = {i: rng.integers(0, 9, rng.integers(1, 150)).astype("<u4") for i in range(500)}
    for i, ids in docs.items():
        packer.add(i, ids)
        assert [len(stack) for stack in packer.open] == packer.level.tolist()
    packer.finish()
    assert not packer.level.any()
    seen, fill = defaultdict(dict), defaultdict(int)
    for doc, start, ids, _, sequence, at in got:
        seen[doc][start] = ids
        assert fill[sequence] == at
        fill[sequence] += len(ids)
    for i, ids in docs.items():
        assert np.concatenate([seen[i][k] for k in sorted(seen[i])]).tolist() == ids.tolist()
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values())


def test_sum_of_squares_choice():
    packer = packing.SumOfSquares(10, lambda *a: None)
    packer.add(0, np.zeros(6, "<u4"))
    packer.add(1, np.zeros(4, "<u4"))  # fills the open window
    assert not packer.level.any()
    for i in range(3):
        packer.add(i, np.zeros(7, "<u4"))
    assert packer.best(2) == 7  # 3 at level 7: one moving to 9 lowers the squares


def test_choice_minimises_the_squares():
    """Every choice against all levels tried one by one."""
    rng = np.random.default_rng(2)
    packer = packing.SumOfSquares(32, lambda *a: None)
    for i in range(600):
        s = int(rng.integers(1, 32))
        outcomes = {}
        for h in [0, *np.flatnonzero(packer.level[: 32 - s + 1])]:
            after = packer.level.copy()
            after[h] -= bool(h)
            after[h + s] += h + s < 32
            outcomes[int(h)] = int((after**2).sum())
        least = min(outcomes.values())
        assert packer.best(s) == max(h for h, total in outcomes.items() if total == least)
        packer.add(i, np.zeros(s, "<u4"))


def brute_hits(doc, items, window=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, found = pattern.findall(lower(doc)), set(), set()
    places = {n: defaultdict(list) for n in range(1, window + 1)}
    for n, own in places.items():
        for i in range(len(words) - n + 1):
            own[tuple(words[i : i + n])].append(i)
    for item, text in items:
        own = pattern.findall(lower(text))
        for at in range(max(1, len(own) - window + 1) if own else 0):
            run = tuple(own[at : at + window])
            for i in places[len(run)].get(run, ()):
                hit.update(range(i, i + len(run)))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def bench(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog and runs"), (10, "Le CHAT est"), (2, ""), (3, None), (None, "the quick"), (4, "日本語テキスト"), (4, "nicht"), (5, "word0 tail0 word1"), (5, "word0 tail0 word1")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [8_000_000, 30])
def test_decontamination(spark, odd_docs, no_docs, block_bytes):
    items = bench(spark)
    plain = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    brute = {i: brute_hits(t, plain) for i, t in texts.items()}
    assert brute[5][1] > 0
    rows = decontamination.find(odd_docs, items, block_bytes=block_bytes).collect()
    assert len(rows) == 13
    for r in rows:
        assert (r.n_words, r.n_hit, list(r.items)) == brute[r.doc_id], r
        assert sum(s.end - s.begin for s in r.hit_spans) == r.n_hit
    clean = {r.doc_id for r in decontamination.remove(odd_docs, items, block_bytes=block_bytes).collect()}
    assert clean == {i for i in texts if not brute[i][1]}
    assert decontamination.find(no_docs, items).count() == 0
    assert decontamination.find(odd_docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_long_and_repeated_items(spark):
    """An item of many pieces, each window in one of them; a hundred thousand copies of an item are one."""
    long = [f"w{i}" for i in range(30_000)]
    items = spark.range(100_000).select(F.lit("copy").alias("item_id"), F.lit("alpha beta gamma delta epsilon").alias("text"))
    items = items.unionByName(spark.createDataFrame([("long", " ".join(long)), ("long", " ".join(long)), ("none", " - "), (None, "alpha")], "item_id string, text string"))
    n, runs = decontamination.blocks(items, "item_id", "text", 10, 40_000)
    every = [piece for run in runs for piece in run]
    assert n > 1 and sum(item == "copy" for item, _ in every) == 1
    windows = [tuple(t.split()[i : i + 10]) for item, t in every if item == "long" for i in range(len(t.split()) - 9)]
    assert sorted(windows) == sorted(tuple(long[i : i + 10]) for i in range(len(long) - 9))
    docs = [(i, "x " + " ".join(long[at : at + 10]) + " y") for i, at in enumerate((0, 495, 500, 14_999, 29_990))] + [(9, "alpha BETA gamma delta epsilon zeta"), (10, "w1 w2 w3")]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), items, block_bytes=40_000).collect()}
    assert got == {i: (10, ["long"]) for i in range(5)} | {9: (5, ["copy"]), 10: (0, [])}


def test_decontamination_hashed_keys(monkeypatch):
    """An index with more words than fit side by side finds what one with plain keys finds."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(12))) for i in range(20)]
    plain, wide = decontamination.Index(items, 4), decontamination.Index(items, 4)
    wide.base = 1 << 40
    wide.spread = [wide.keys(np.array(w[w >= 0]), min(decontamination.SHINGLE, int((w >= 0).sum()))) for w in wide.windows]
    wide.shingles = {k: np.unique(np.concatenate(wide.spread)) for k in wide.widths}
    for own in (plain, wide):
        own.arm({k: np.zeros(len(v), np.int64) for k, v in own.shingles.items()})
    for _ in range(50):
        text = " ".join(rng.choice("abcdefghij") for _ in range(60))
        assert plain.judge(text) == wide.judge(text)


def test_decontamination_random(spark):
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "dd"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(8)))) for i in range(12)]
    found = decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5).collect()
    for r in found:
        assert (r.n_words, r.n_hit, list(r.items)) == brute_hits(docs[r.doc_id][1], items, 5)


LANGS = {"en": "the of and to in is that it was for", "fr": "le la les des est une que dans pour avec", "de": "der die das und ist nicht ein mit von zu", "es": "el los las que una por con para su del"}


def language_rows(n=400, seed=0):
    rng, out = random.Random(seed), []
    for i in range(n):
        code = rng.choice(sorted(LANGS))
        out.append((i, " ".join(rng.choices(LANGS[code].split(), k=rng.randrange(4, 40))), code))
    return out


def test_language_held_out_accuracy(spark, odd_docs, no_docs):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == code for i, _, code in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (3, 4, 6, 8)) and odd[10].lang_pred == "fr" and odd[11].lang_pred == "de"
    kept = language_id.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, None, 7, 9, 10, 11}
    assert language_id.predict(no_docs, model).count() == 0


def test_samples_hold_one_text_an_id(spark):
    """An id that is repeated does not fill the driver's sample, whatever its texts."""
    rows = [(1, f"the text of {i}", "en") for i in range(500)] + [(i, f"le chat {i}", "fr") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "id long, text string, label string")
    kept = language_id.one_each(language_id.sampled(docs, "id", "label", 20))
    n = {r.label: r["count"] for r in kept.groupBy("label").count().collect()}
    assert n.get("en", 0) <= 1 and n["fr"] <= 40
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    model = toxicity.fit(docs.withColumnRenamed("id", "doc_id"), labels)
    assert toxicity.score(docs.withColumnRenamed("id", "doc_id"), model).count() == len(rows)


def test_thresholds_by_language():
    """Every language with rows of both classes has its own threshold, drawn towards the pooled one."""
    model = toxicity.Model()
    model.raw = lambda docs: np.array(docs)
    p = [0.9] * 20 + [0.1] * 80 + [0.6] * 20 + [0.5] * 20
    y = np.array([1] * 20 + [0] * 80 + [1] * 20 + [0] * 20)
    model.calibrate(p, ["en"] * 100 + ["fr"] * 40, y)
    pooled, en, fr = (model.thresholds[k] for k in ("", "en", "fr"))
    assert pooled == pytest.approx(0.55) and 0.5 < en < pooled and fr == pytest.approx(0.55)
    model.calibrate(p, ["de"] * 20 + ["en"] * 120, y)
    assert "de" in model.thresholds or model.threshold("de") == model.thresholds[""]


def test_language_few_or_no_labels(spark, odd_docs, no_docs):
    assert {r.lang_pred for r in language_id.predict(odd_docs, language_id.fit(no_docs)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "le chat", "fr"), (2, "un chien", "fr"), (3, "une amie", "fr")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.predict(one, language_id.fit(one)).collect()} == {"fr"}


def test_lang_column_is_no_input(spark):
    rows = language_rows(100)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    other = spark.createDataFrame([(i + 7777, t, "xx") for i, t, _ in rows], docs.schema)
    a, b = ({r.doc_id: r.lang_pred for r in language_id.predict(d, model).collect()} for d in (docs, other))
    assert all(a[i] == b[i + 7777] for i, _, _ in rows)


def toxic_rows(n=1500, seed=2):
    rng, docs, labels = random.Random(seed), [], []
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(400)]
    for i in range(n):
        words, toxic = rng.choices(vocabulary, k=rng.randrange(5, 80)), rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nasties" + rng.choice("abcdef")]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, odd_docs, no_docs):
    docs, labels = toxic_rows()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    truth = dict(labels)
    held = [r for r in toxicity.score(d, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = np.mean([(r.score >= toxicity.CUT) == bool(truth[r.doc_id]) for r in held])
    assert right > 0.95
    assert all((r.raw >= r.threshold) == (r.score >= toxicity.CUT) and 0 <= r.score <= 1 for r in held)
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == 13 and all(r.score < toxicity.CUT for r in odd if r.doc_id in (3, 4, 8))
    assert toxicity.score(no_docs, model).count() == 0


def test_toxicity_without_labels(spark, odd_docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score < toxicity.CUT for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, none)).collect()} == {True}


def test_contract_queries_have_columns(spark):
    sf = "/root/testdata/sf0.001"
    wanted = {
        "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op2_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op3_toxicity": "doc_id held_out score predicted",
        "op9_language_id": "doc_id held_out lang_pred score",
    }
    for name, columns in wanted.items():
        df = queries.QUERIES[name](spark, sf)
        assert df.columns[: len(columns.split())] == columns.split()
        assert df.count() >= 200
    pieces = queries.QUERIES["op1_packing"](spark, sf).first()
    assert 0 <= pieces.ids_crc32 < 1 << 32
