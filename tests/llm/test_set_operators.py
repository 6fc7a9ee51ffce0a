"""Dedup, near-dedup, URL filters, chat formatting, sharding and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat_format, exact_dedup, near_dedup, sharding, url_filters
from gridloom.llm._util import UPPER


def lower(text):
    return "".join(chr(ord(c) + 32) if c in UPPER else c for c in text or "")


def weak(norm):
    return F.concat(F.lit(b"x"), F.pmod(F.length(norm), F.lit(3)).cast("string").cast("binary"))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_dedup(odd_docs, no_docs, digest):
    rows = exact_dedup.find_copies(odd_docs, digest=digest).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    want = Counter()
    for ids in groups.values():
        top = max(-1 if i is None else i for i in ids)
        want.update((i, None if top == -1 else top, len(ids)) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.drop_copies(odd_docs, digest=digest)
    assert kept.columns == odd_docs.columns
    assert sorted(lower(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.find_copies(no_docs, digest=digest).count() == 0
    assert exact_dedup.drop_copies(no_docs, digest=digest).count() == 0


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    width = min(k, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(docs, k, percent):
    sets = {i: shingle_set(t, k) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs, n = {}, 0
    for _ in range(6):
        base = rng.choices(words, k=rng.choice([4, 40, 120, 300]))
        for _ in range(rng.choice([1, 5, 40])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs[n] = " ".join(own)
            n += 1
    for text in ("", "one", "one two", "ONE two", "one  two\tthree"):
        docs[n] = text
        n += 1
    return docs


@pytest.mark.parametrize(("seed", "k", "percent"), [(4, 3, 85), (6, 5, 80)])
def test_near_dedup_against_brute_force(spark, seed, k, percent):
    docs = near_corpus(seed)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.group(frame, k=k, percent=percent).collect()}
    assert got == brute_components(docs, k, percent)
    kept = {r.doc_id for r in near_dedup.keep_one(frame, k=k, percent=percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def template_family(m, seed=2):
    """Texts of one template, each with a few words of its own; the first differs most."""
    rng, base = random.Random(seed), [f"b{i}" for i in range(24)]
    docs = {}
    for i in range(m):
        own = list(base)
        for at in rng.sample(range(24), 5 if i == 0 else rng.choice([0, 1, 1, 2, 3])):
            own[at] = f"{rng.randrange(4)}x{at}"
        docs[i] = " ".join(own)
    return docs


@pytest.mark.parametrize("block_rows", [24, 512])
def test_template_family_in_blocks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block_rows)
    docs = template_family(400)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.group(frame, k=3, percent=70).collect()}
    assert got == brute_components(docs, 3, 70)


@pytest.mark.parametrize("m", [1500, 5000])
def test_links_grow_with_the_members(spark, monkeypatch, m):
    links, of = [], near_dedup.components

    def counted(edges):
        links.append(edges.count())
        return of(edges)

    monkeypatch.setattr(near_dedup, "components", counted)
    frame = spark.createDataFrame(list(template_family(m).items()), "doc_id long, text string")
    assert near_dedup.group(frame, k=3, percent=70).count() == m
    assert sum(links) <= 4 * m


def test_near_dedup_odd_rows(odd_docs, no_docs):
    rows = near_dedup.group(odd_docs, k=3, percent=85).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1 and by[1].kept and not by[2].kept
    assert all(by[i].component_id == i and by[i].n_shingles == 0 for i in (3, 4, 8))
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.group(no_docs).count() == 0
    kept = near_dedup.keep_one(odd_docs, k=3, percent=85)
    assert kept.columns == odd_docs.columns and kept.count() == 11


def test_collision_corrected_estimate(spark):
    rng = random.Random(1)
    texts = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(300))]
    texts.append(" ".join(texts[0].split()[:210] + [f"u{i}" for i in range(90)]))
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sig = {r.id: r.sig for r in near_dedup.signed(frame, 3, 32, 5).collect()}
    pair = spark.createDataFrame([(sig[0], sig[1])], "a array<long>, b array<long>")
    got = pair.select(near_dedup.estimate(F.col("a"), F.col("b"), 160)).first()[0]
    a, b = (shingle_set(t, 3) for t in texts)
    assert abs(got - len(a & b) / len(a | b)) < 0.15


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "http://example.org", "http://example.org?q", "https://x.example.org/en/1", "https://x.example.org/en/12#z", "https://n.com/de/", "https://n.com/dex", "http://spam-farm.example.net/a/b", "http://spam-farm.example.com/fr/a", "ftp://h/p?://", "http://EXAMPLE.net#f/p"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(URLS)], "page_id long, url string, host int")
    listed = spark.createDataFrame([(h,) for h in url_filters.LISTED_HOSTS], "host string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, listed).orderBy("page_id").collect()]
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == got[5] == ("example.org", "", None, "allow")
    assert got[6][2:] == got[7][2:] == ("example.org/en/1", "block") and got[7][1] == "/en/12"
    assert got[8] == ("n.com", "/de/", "com/de/", "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("spam-farm.example.net", "/a/b", None, "block")
    assert got[11] == ("spam-farm.example.com", "/fr/a", "com/fr/", "allow")
    assert got[12] == ("h", "/p", None, "allow") and got[13] == ("example.net", "", None, "allow")
    assert url_filters.judge(pages.limit(0), listed).count() == 0
    assert url_filters.judge(pages, listed.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0


@pytest.mark.parametrize("slice_keys", [1 << 20, 200])
def test_cascade_is_exact(spark, slice_keys):
    rng = random.Random(9)
    hosts = [f"h{i}.net" for i in range(3000)]
    bad = set(rng.sample(hosts, 700))
    pages = spark.createDataFrame([(i, f"http://{rng.choice(hosts)}/p") for i in range(6000)], "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in bad] + [("absent.net",)], "host string")
    rows = url_filters.judge(pages, listed, rules=[], slice_keys=slice_keys).collect()
    assert len(rows) == 6000 and all((r.verdict == "block") == (r.host in bad) for r in rows)


@pytest.mark.parametrize("slice_keys", [1 << 20, 200])
def test_listed_host_covers_subdomains(spark, slice_keys):
    block = ["www.spam-farm.example.com", "M.Spam-Farm.example.org", "a.b.c.spam-farm.example.net", "spam-farm.example.com"]
    allow = ["notspam-farm.example.com", "example.com", "spam-farm.example.com.net", "spam-farm.example.com.", "www.spam-farm.example", "a.", ""]
    pages = spark.createDataFrame([(i, f"http://{h}/en/") for i, h in enumerate(block + allow)], "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in [*url_filters.LISTED_HOSTS, "deep.er.than.all.the.others"]], "host string")
    rows = url_filters.judge(pages, listed, rules=[], slice_keys=slice_keys).orderBy("page_id").collect()
    assert [r.verdict for r in rows] == ["block"] * len(block) + ["allow"] * len(allow)
    alone = url_filters.judge(pages, spark.createDataFrame([("",)], "host string"), rules=[], slice_keys=slice_keys)
    assert [r.host for r in alone.where("verdict = 'block'").collect()] == [""]


def test_rules_of_any_number(spark):
    rng = random.Random(8)
    rules = [(f"{'.'.join(rng.choices('abc', k=rng.choice([1, 2])))}/{''.join(rng.choices('xy/', k=rng.randrange(4)))}", rng.choice(["allow", "block"])) for _ in range(2000)]
    rules = sorted(dict(rules).items()) + [(f"host{i}.net/p", "block") for i in range(3000)]
    urls = [f"http://{'.'.join(rng.choices('abc', k=3))}/{''.join(rng.choices('xy/', k=4))}" for _ in range(400)] + ["http://w.host77.net/p1", "http://host77.net/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filters.judge(pages, spark.createDataFrame([], "host string"), rules=rules).collect()
    assert len(rows) == len(urls)
    for r in rows:
        fits = [(len(n), n, says) for n, says in rules if (r.host == n.partition("/")[0] or r.host.endswith("." + n.partition("/")[0])) and r.path.startswith("/" + n.partition("/")[2])]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))


def brute_chats(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            chats[conv].append((-1 if turn is None else turn, role or "", text or ""))
    chats = {c: tuple(sorted(t)) for c, t in chats.items()}
    out = {}
    for c, t in chats.items():
        longer = any(len(o) > len(t) and [x[1:] for x in o[: len(t)]] == [x[1:] for x in t] for o in chats.values())
        same = any(o < c and [x[1:] for x in chats[o]] == [x[1:] for x in t] for o in chats)
        if not longer and not same:
            out[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in t)
    return out


def test_chat_collapse(spark):
    rng, rows = random.Random(3), []
    for c in range(60):
        talk = [("user", "hello")] + [(rng.choice(["user", "assistant", None]), rng.choice(["x", "y", None])) for _ in range(rng.randrange(6))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(talk)]
    rows += [(None, 0, "user", "lost"), (500, None, "user", "no turn"), (501, 0, "user", "hello")]
    rows += [(900, i, "user", f"t{i}") for i in range(700)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n int, part int").repartition(5)
    got = defaultdict(str)
    for r in chat_format.format_chats(frame, segment_turns=256).orderBy("conv_id", "segment").collect():
        got[r.conv_id] += r.text
    assert dict(got) == brute_chats(rows)
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_tied_null_and_repeated_turns(spark):
    """Pairs (A, and A with a tied B) in both orders, a conversation of null turns and one of a repeated turn."""
    import duckdb

    from gridloom.llm.queries import OP6_SQL

    rng, rows = random.Random(5), []
    for c in range(0, 80, 2):
        first = ("user", f"hello {c}")
        second = (rng.choice(["user", "assistant", "a"]), rng.choice(["aa", "zz", "hello", "x" * 40]) + str(c))
        rows += [(c, 0, *first), (c + 1, 0, *first), (c + 1, 0, *second)]
    rows += [(200, None, rng.choice("uv"), f"t{i}") for i in range(1300)]
    rows += [(201, 3, "user", "again")] * 1500 + [(201, 2, "user", "before"), (202, 2, "user", "before"), (202, 3, "user", "again")]
    rows += [(203, 1, None, None), (203, 1, "", "x"), (204, 1, "", "")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, a int, tie int, n int").repartition(4)
    made = chat_format.format_chats(frame).collect()
    got = defaultdict(str)
    for r in sorted(made, key=lambda r: (r.conv_id, r.segment)):
        got[r.conv_id] += r.text
    assert dict(got) == brute_chats(rows)
    assert max(r.n_turns for r in made) <= 512
    conversations = frame.select("conv_id", "turn", "role", "text").toPandas()  # noqa: F841  (read by the SQL)
    want = duckdb.sql(OP6_SQL).fetchall()
    assert sorted((r.conv_id, r.segment, r.n_turns, r.text) for r in made) == sorted(want)


def curve(axes, bits):
    """The transposed-axes index, row by row."""
    x, q = list(axes), 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        t ^= q - 1 if x[-1] & q else 0
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_hilbert_index(spark):
    cells = [(x, y, z) for x in range(4) for y in range(4) for z in range(4)]
    frame = spark.createDataFrame(cells, "x int, y int, z int")
    got = {tuple(r[:3]): r[3] for r in frame.select("x", "y", "z", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 2)).collect()}
    assert got == {c: curve(c, 2) for c in cells}
    order = sorted(cells, key=got.get)
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(order, order[1:], strict=False))


def test_shards(odd_docs, no_docs):
    rows = sharding.assign(odd_docs).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    slots = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        slots[r.shard].append(r)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all([r.slot for r in s] == list(range(len(s))) for s in slots.values())
    walk = [r.curve for k in sorted(slots) for r in slots[k]]
    assert walk == sorted(walk)
    assert sharding.assign(no_docs).count() == 0


def test_every_dimension_prunes(spark):
    """A filter on one value of any dimension has to read fewer than all shards, by their minima and maxima."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.assign(docs, shards=32).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    for dimension in ("lang", "source", "size"):
        ends = defaultdict(list)
        for r in rows:
            if r[dimension] is not None:
                ends[r.shard].append(r[dimension])
        ranges = [(min(v), max(v)) for v in ends.values()]
        values = {r[dimension] for r in rows} - {None}
        read = sum(low <= v <= high for v in values for low, high in ranges) / len(values) / len(ranges)
        assert read < 0.6, (dimension, read)


def test_cut_points_keep_the_order(spark):
    frame = spark.createDataFrame([(v, n) for v in "abcd" for n in range(5)] + [(None, None)], "v string, n int")
    assert sharding.cut_points(frame, "v", 5, False) == [(8, "b"), (16, "c"), (24, "d")]
    skewed = spark.createDataFrame([(1,)] * 90 + [(i,) for i in range(2, 12)], "v int")
    assert sharding.cut_points(skewed, "v", 2, True) == [(3, 2)] and sharding.cut_points(frame.limit(0), "n", 2, True) == []
    cells = frame.select("v", sharding.cell_of(F.col("v"), sharding.cut_points(frame, "v", 5, False)).alias("c")).distinct().collect()
    assert sorted((r.v or "", r.c) for r in cells) == [("", 0), ("a", 0), ("b", 8), ("c", 16), ("d", 24)]


def test_native_operators_run_no_python(spark):
    """The plans of everything that runs for them, checkpoints and staged tables included."""
    docs, chats = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "conversations"))
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    for df in (exact_dedup.find_copies(docs), exact_dedup.drop_copies(docs), chat_format.format_chats(chats), sharding.assign(docs)):
        df.write.format("noop").mode("overwrite").save()
    after = store.executionsCount()
    runs = store.executionsList(before, after - before)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert len(plans) > 20
    for plan in plans:
        assert not re.search("Python|ArrowEval|InArrow|Pandas", plan), plan


def test_located_rows(spark, odd_docs, tmp_path):
    """A Parquet table is read in place; any other frame is staged. Locators name the same rows in every read."""
    odd_docs.write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    for docs in (table, table.where("doc_id > 5"), odd_docs):
        first, again = (exact_dedup.located(docs).select(exact_dedup.FILE, exact_dedup.ROW, "doc_id") for _ in range(2))
        assert first.select(exact_dedup.FILE, exact_dedup.ROW).distinct().count() == docs.count()
        if docs is table:
            assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
            assert all("docs/part" in r[0] for r in first.collect())


def test_rows_are_taken_out_beyond_the_filter(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("v"))
    gone = spark.range(0, 2000, 3).toDF("id")
    from gridloom.llm import _util

    few = _util.id_filter(gone, bound=64)  # saturated: lets everything through
    assert rows.where(few(F.col("id"))).count() == 2000
    assert rows.where(_util.id_filter(gone)(F.col("id"))).count() < 700
    assert {r.id for r in _util.without(rows, gone).collect()} == {i for i in range(2000) if i % 3}
    assert _util.without(rows, gone.limit(0)).count() == 2000


def test_pipeline_stages(spark, odd_docs, no_docs):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    sf, counts = "/root/testdata/sf0.001", []
    for docs in (odd_docs, no_docs):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), docs.schema)
            counts.append((name, out.count()))
    assert [n for _, n in counts[:4]] == [9, 7, 7, 7] and counts[5:] == [(n, 0) for n, _ in corpus_pipeline.STAGES]
    whole = corpus_pipeline.run(spark, sf)
    assert whole.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_pipeline_equals_brute_force(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from gridloom.llm.language_id import has_letter

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i for i, r in rows.items() if has_letter(r.text)}
    last = {}
    for i in sorted(kept):
        last[lower(rows[i].text)] = i
    kept = set(last.values())
    near = brute_components({i: rows[i].text for i in kept}, 5, 80)
    kept = {i for i in kept if near[i][1] == i}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    runs = set()
    for _, text in bench:
        w = word.findall(lower(text))
        runs.update(tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0))
    sizes = {len(r) for r in runs}

    def hit(text):
        w = word.findall(lower(text))
        return any(tuple(w[i : i + n]) in runs for n in sizes for i in range(len(w) - n + 1))

    want = {i for i in kept if not hit(rows[i].text)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == want
