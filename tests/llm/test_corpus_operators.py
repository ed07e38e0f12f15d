"""Each operator against a plain model, on a small table of odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import LOW, ROWS, SCHEMA, WORD, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bitplanes, decontaminate, hostrules, langid, neardup, packing, quality, sharding, substring, toxicity
from quire.llm.queries import TOKENIZER
from quire.llm.tokens import CachedEncoder


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(spark, docs, none, tmp_path, kind):
    bitplanes.write_token_planes(docs, str(tmp_path / "p"), tokenizer=TOKENIZER, kind=kind, block_ids=64, chunk_ids=500)
    got = [tuple(r) for r in bitplanes.read_token_planes(spark, str(tmp_path / "p"), with_ids=True).orderBy("start").collect()]
    t, start = Tokenizer.from_file(TOKENIZER), 0
    order = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in ROWS)
    assert len(got) == len(order)
    for (doc, at, n, crc, ids), (want, text) in zip(got, order):
        expected = t.encode(text, add_special_tokens=False).ids + [0]
        assert (-1 if doc is None else doc, at, n, ids) == (want, start, len(expected), expected)
        assert crc == zlib.crc32(np.array(expected, "<u4").tobytes())
        start += n
    bitplanes.write_token_planes(none, str(tmp_path / "e"), tokenizer=TOKENIZER)
    assert bitplanes.read_token_planes(spark, str(tmp_path / "e")).count() == 0


def test_planes_of_one_block():
    r = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 70_000, 2**32 - 1):
        ids = r.integers(0, top, 777, dtype=np.uint32, endpoint=True)
        for kind in ("byte", "bit"):
            assert (bitplanes.ids_of(bitplanes.planes_of(ids, kind), 777, kind) == ids).all()
            assert (bitplanes.unpack_chunk(777, 100, kind, *bitplanes.pack_chunk(ids, 100, kind, 1)) == ids).all()


def test_encoder_with_a_full_cache():
    e = CachedEncoder(TOKENIZER, max_words=5)
    texts = [r[1] or "" for r in ROWS] + [" ", "  ", "a   b", "a \n b", "\n\n b", "x\t \ty", "a ", "don't 3.5"]
    for _ in range(2):
        ids, bounds = e.encode(pa.array(texts))
        for i, w in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == w.ids


@pytest.mark.parametrize("salts", [4_000_000, 7])
def test_substring(docs, none, salts):
    got = Counter(tuple(r) for r in substring.remove_repeats(docs, docs_per_salt=salts).collect())
    last = 2**63
    seen = {}
    for r in ROWS:
        w = words(r[1])
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            seen[k] = min(seen.get(k, last), last if r[0] is None else r[0])
    want = Counter()
    for r in ROWS:
        w, own = words(r[1]), last if r[0] is None else r[0]
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if seen[tuple(w[j : j + 13])] < own:
                gone[j : j + 13] = [True] * 13
        want[(r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert got == want
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("salts", [4_000_000, 7])
def test_factors(spark, docs, salts):
    """Each factor is a copy of its source, no factor could go on or begin earlier, and words
    of windows across the ends of factors go too."""
    r = random.Random(17)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    a, b, c = fresh(50), fresh(40), fresh(30)
    joint = a[10:40] + b[5:30]  # two factors; the window across them is in no source
    table = {1: a, 2: b, 3: a[30:] + b[:20], 4: fresh(5) + joint + fresh(3), 5: a[40:] + b[:10] + c, 6: c[:12], 7: c[2:15] + a}
    made = spark.createDataFrame([(i, " ".join(w)) for i, w in table.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.remove_repeats(made, docs_per_salt=salts // 2, factors=True).collect()}
    parsed = {i: [tuple(f) for f in r["factors"]] for i, r in got.items()}
    assert parsed[1] == parsed[2] == parsed[6] == [] and parsed[3] == [(0, 20, 1, 30), (20, 20, 2, 0)]
    assert parsed[4] == [(5, 30, 1, 10), (35, 25, 2, 5)]
    # the factor of 5 is 3's copy of the seam, the one of 7 is 5's of c
    assert parsed[5] == [(0, 20, 3, 10)] and parsed[7] == [(0, 13, 5, 22), (13, 50, 1, 0)]
    words_by_id = {r[0]: words(r[1]) for r in ROWS if r[0] is not None}
    rows = substring.remove_repeats(docs, docs_per_salt=salts, factors=True).where("doc_id is not null").collect()
    assert any(r["factors"] for r in rows)
    for r in rows:
        w, at = words_by_id[r["doc_id"]], 0
        for start, length, source, place in (tuple(f) for f in r["factors"]):
            assert source < r["doc_id"] and start >= at and length >= 13
            assert w[start : start + length] == words_by_id[source][place : place + length]
            at = start + length


def shards_of(table, **how):
    rows = sharding.shard_by_bytes(table, **how).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table.select("doc_id", "text").collect())
    slots, load, places = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        places[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load, places


def test_sharding(spark, docs, none):
    """Slots are gapless, bytes near equal, and copies stay together unless they are too many for a shard."""
    shards_of(docs)
    shards_of(docs.union(spark.range(3000).selectExpr("id + 1000", "'hot text'", *["null"] * 7)))
    groups = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', repeat(char(97 + cast(id % 20 as int)), cast(1 + id % 700 as int))) as text")
    for how in ({}, {"rows_per_range": 50}, {"ranges_per_shard": 4}):
        load, places = shards_of(groups, **how)
        assert len(load) == 16 and max(load.values()) < (1.8 if "ranges_per_shard" in how else 1.02) * min(load.values())
        assert all(len(s) == 1 for s in places.values())
    third = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('h', 300), concat(repeat('x', cast(id % 90 as int)), id)) as text")
    load, places = shards_of(third)
    split = [k for k, s in places.items() if len(s) > 1]
    assert max(load.values()) < 1.02 * min(load.values()) and split == [(zlib.crc32(b"h" * 300), 301)]
    load, _ = shards_of(spark.range(5000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text"))  # one row, again and again
    assert max(load.values()) < 1.02 * min(load.values())
    assert sharding.shard_by_bytes(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(packing.token_pieces(docs, tokenizer=TOKENIZER, capacity=64), capacity=64).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in ROWS:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack(packing.token_pieces(none, tokenizer=TOKENIZER)).count() == 0


def test_packing_plan_uses_every_piece():
    r = np.random.default_rng(3)
    for draw in (r.integers(1, 1025, 20_000), r.integers(1, 60, 9000), np.full(1000, 600), np.minimum(1024, r.geometric(0.01, 20_000))):
        histogram = dict(zip(*(x.tolist() for x in np.unique(draw, return_counts=True))))
        plan, used = packing.packing_plan(histogram), Counter()
        for lengths, n in plan:
            assert n > 0 and sum(lengths) <= 1024
            for s in lengths:
                used[s] += n
        assert used == Counter(histogram)
        if draw.max() > 600 or draw.max() < 100:
            assert sum(n for _, n in plan) <= 1.01 * draw.sum() / 1024 + 1


def test_near_duplicates(docs, none):
    sets = []
    for r in ROWS:
        w = words((r[1] or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {r[0]: r[0] for r in ROWS if r[0] is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if ROWS[i][0] is None or ROWS[j][0] is None or not a or not sets[j]:
                continue
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((top(ROWS[i][0]), top(ROWS[j][0])))
                parent[y] = x
    want = Counter((r[0], len(s), None if r[0] is None else top(r[0]), r[0] is None or top(r[0]) == r[0]) for r, s in zip(ROWS, sets))
    assert Counter(tuple(r) for r in neardup.near_duplicates(docs).collect()) == want
    assert neardup.near_duplicates(none).count() == 0


def test_texts_that_share_an_id(spark):
    """A doc_id with two texts is one document: what is near either is reachable from both."""
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    a, b = fresh(60), fresh(60)
    rows = [(5, a), (5, b), (7, a + ["x"]), (9, b + ["y"]), (8, fresh(60))]
    for more, want in (([], 5), ([(3, b)], 3)):
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows + more], "doc_id long, text string").repartition(3)
        got = Counter((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
        assert got == Counter([(5, want), (5, want), (7, want), (9, want), (8, 8), *((i, want) for i, _ in more)])


@pytest.mark.parametrize("rows_per_hot_key", [1_000_000, 20])
def test_links_within_a_crowd(spark, rows_per_hot_key):
    """Texts with one long passage in common crowd the table keys without being links; few of them are."""
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    common = fresh(80)
    texts = [common + fresh(20) for _ in range(400)]
    texts += [texts[7 * i][:90] + fresh(10) for i in range(40)]
    r.shuffle(texts)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= 75 * len(a | b)]
    assert len(links) == 40
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, rows_per_hot_key=rows_per_hot_key).collect()}
    assert got == {i: i for i in range(len(texts))} | {j: i for i, j in links}


def test_rare_pairs(spark):
    r = random.Random(6)
    pool = np.random.default_rng(6).integers(0, 2**63, 60, dtype=np.uint64)
    sets = [set(r.sample(range(60), r.randint(1, 30))) for _ in range(60)]
    sets += [s | {r.randrange(60)} for s in sets]
    rows = [(i, i % 50, np.sort(pool[sorted(s)]).tobytes()) for i, s in enumerate(sets)]
    made = spark.createDataFrame(rows, "id long, component long, shingles binary")
    got = {tuple(r) for r in neardup.rare_pairs(made, 75, 4).collect()}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if i % 50 != j % 50 and 100 * len(a & b) >= 75 * len(a | b)}
    assert len(want) > 20 and want <= got
    assert len(got) < len(sets) ** 2 / 2


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r[0]: r[1] for r in got.collect()} == {x: top(x) for x in parent}


@pytest.mark.parametrize("limit", [1_000_000, 200])
def test_decontamination(spark, docs, none, limit):
    texts = {r[0]: r[1] for r in ROWS}
    items = [(1, " ".join(words(texts[14])[25:60]).upper()), (2, "same LINE here"), (10, "Other"), (3, None), (4, "--"), (None, "one"), (11, texts[9]), (5, texts[9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = defaultdict(set)
    for i, x in items:
        w = word.findall((x or "").translate(LOW))
        for j in range(max(1, len(w) - 12) if w else 0):  # an item without an id is hit, but not listed
            patterns[tuple(w[j : j + 13])].update([] if i is None else [str(i)])
    want = Counter()
    for r in ROWS:
        w = word.findall((r[1] or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for size in {len(p) for p in patterns}:
            for j in range(len(w) - size + 1):
                if (p := tuple(w[j : j + size])) in patterns:
                    found |= patterns[p]
                    hit[j : j + size] = [1] * size
        n = sum(hit)
        want[(r[0], len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))] += 1
    assert Counter(tuple(r) for r in decontaminate.decontaminate(docs, bench, block_words=limit).collect()) == want
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_search_of_many_patterns():
    """Words of every kind and length against a plain search."""
    r = random.Random(31)
    for m in (1, 2, 3, 13, 300):
        vocab = [f"w{i}".encode() for i in range(3 if m < 4 else 40)]
        text = [r.choice(vocab) for _ in range(3000)] + [b"none"] * 3 + [r.choice(vocab) for _ in range(20)]
        patterns = sorted({b" ".join(text[a : a + m]) for a in (r.randrange(3000 - m) for _ in range(50))} | {b" ".join(r.choice(vocab) for _ in range(m)) for _ in range(50)})
        got = sorted(decontaminate.WordSearch(patterns, m, {}).find(text))
        place = {p: i for i, p in enumerate(patterns)}
        assert got == [(i, place[p]) for i in range(len(text) - m + 1) if (p := b" ".join(text[i : i + m])) in place]


@pytest.mark.parametrize("overlap", [True, False])
def test_a_block_at_its_bound_is_small(overlap):
    """Memory of the tables of a block of as many words as are allowed, by the process's own size."""
    import subprocess
    import sys

    code = f"""
import pyarrow as pa, psutil, random
from quire.llm import decontaminate as D
r, n = random.Random(1), D.MAX_BLOCK_WORDS // 13
if {overlap}:
    words = [b"%x" % r.randrange(10**9) for _ in range(n + 12)]
    found = [b" ".join(words[i:i + 13]) for i in range(n)]
else:
    found = [b" ".join(b"%x" % r.randrange(10**9) for _ in range(13)) for _ in range(n)]
block = pa.table({{"pattern": pa.array(found, pa.binary()), "n": pa.array([13] * n, pa.int32()), "items": pa.array([["1"]] * n)}})
sink = pa.BufferOutputStream()
with pa.ipc.new_stream(sink, block.schema) as out:
    out.write_table(block)
raw = sink.getvalue().to_pybytes()
words = found = block = sink = None
before = psutil.Process().memory_info().rss
kept = D.searches_of("x", raw)
assert D.searches_of("x", raw) is kept
print((psutil.Process().memory_info().rss - before + len(raw)) / 1e6)
"""
    used = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)}).stdout)
    assert used < 150


def test_host_rules(docs, none):
    want = Counter()
    for r in ROWS:
        text, w = r[1] or "", words(r[1])
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)] += 1
    rows = hostrules.judge(docs).collect()
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert hostrules.judge(none).count() == 0 and hostrules.keep_good(docs).columns == docs.columns


def test_bad_host_is_rejected(spark):
    good = "a b c d e f g h i j k l"
    df = spark.range(900).selectExpr("id as doc_id", f"if(id % 3 = 0 and id % 30 > 3, 'bad', '{good}') as text", "concat('h', id % 3) as source")
    kept = {r[0]: r[1] for r in hostrules.judge(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if("kept")).collect()}
    assert kept == {"h0": 0, "h1": 300, "h2": 300}


def test_classifiers_on_given_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for f, label, least in ((quality.score_quality, "quality", 0.97), (toxicity.score_toxicity, "toxic", 0.9)):
        out = f(docs, labels)
        scored = out.join(labels, "doc_id").where("held_out")
        assert scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least
        assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    found = langid.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_classifiers_on_odd_tables(spark, docs, none):
    kinds = "doc_id long, quality int, toxic int, text string"
    odd = spark.createDataFrame([(i, i % 2, i % 2, "z") for i in range(30)] + [(3, None, None, None), (None, 1, 1, None), (5, 1, 1, "q")], kinds)
    for labels in (odd, odd.limit(0), odd.where("quality = 1")):
        for f in (quality.score_quality, toxicity.score_toxicity):
            out = f(docs, labels)
            assert out.count() == len(ROWS) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(none, odd).count() == toxicity.score_toxicity(none, odd).count() == 0
    out = {r["doc_id"]: r for r in langid.identify_language(docs).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == "und" and out[9]["lang_pred"] == "en"
    assert langid.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify_language(none).count() == 0


def test_maximal_segments_against_all_segments():
    r = random.Random(5)
    for _ in range(200):
        scores = [r.choice([-3, -2, -1, 1, 2, 4]) for _ in range(r.randint(1, 14))]

        def split(low, high):
            best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
            return [] if best[0] <= 0 else [*split(low, best[3]), best[0], *split(best[4], high)]

        at = [i for i, s in enumerate(scores) if s > 0]
        found = toxicity.maximal_segments([scores[i] for i in at], [sum(scores[:i]) for i in at])
        assert sorted(found) == sorted(split(0, len(scores)))


@pytest.mark.parametrize("per_salt", [4_000_000, 40])
def test_substring_of_many_rows_without_an_id(spark, per_salt):
    """A third of the rows has no id and another shares one; all hold one passage. Such rows are
    spread over groups, take from smaller ids, and never from each other."""
    r = random.Random(23)
    prose = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    hot, rows = prose(20), []
    for i in range(240):
        rows.append(([None, 7, 100 + i][i % 3], " ".join(prose(5) + hot + prose(r.randint(0, 9)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter((x["doc_id"], x["kept"], x["n_removed"]) for x in substring.remove_repeats(df, docs_per_salt=per_salt).collect())
    assert got == Counter((d, t if d == 7 else " ".join(t.split()[:5] + t.split()[25:]), 0 if d == 7 else 20) for d, t in rows)
    texts = df.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_doc"), F.col("text").alias("_text"))
    assert texts.where("_doc = 9223372036854775807").select(F.pmod(F.xxhash64("_doc", "_text"), F.lit(13))).distinct().count() == 13
    if per_salt == 40:  # nothing but the passage is hot
        hot = substring.hot_phrases(texts, 13, 6, per_salt)
        assert 0 < len(hot.names) <= 2 * 20 and hot.most == 7
