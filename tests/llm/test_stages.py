"""Each stage of the pipeline against a plain model, on odd rows with clashing column names."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as C
import numpy as np
import pytest
from odd_rows import LOW, ROWS, words
from tokenizers import Tokenizer

from quire.llm.queries import TOKENIZER

CLASH = ["_doc", "_text", "_null", "_shelf", "n_words", "n_removed", "kept", "row", "_id", "_row", "_key", "carried", "others", "component_id", "size", "_hash", "contaminated", "_all", "_own", "label"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]
TABLE = [(r[0], r[1], r[2], r[3], len(r[1] or "") if i % 2 else None, *(f"{c}{i}" for c in CLASH)) for i, r in enumerate(ROWS)]
SCHEMA = "doc_id int, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TABLE, SCHEMA).repartition(3)


def rows_of(df):
    assert df.columns == COLUMNS and df.schema.simpleString() == "struct<" + ",".join(x.strip().replace(" ", ":") for x in SCHEMA.split(",")) + ">"
    return Counter(tuple(r) for r in df.collect())


def test_quality_rules(spark, docs):
    failed = []
    for r in TABLE:
        w = words(r[1])
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
        failed.append(len(w) < 10 or 100 * len(hit) > 20 * len(w))
    n, bad = Counter(r[3] for r in TABLE), Counter(r[3] for r, f in zip(TABLE, failed) if f)
    rates = [bad[h] / n[h] for h in n]
    m, v = np.mean(rates), np.var(rates)
    s = min(1000, max(0, m * (1 - m) / v - 1)) if v > 0 else 1000
    good = {h for h in n if (bad[h] + m * s) / (n[h] + s) <= 0.5}
    assert rows_of(C.quality_rules(spark, docs, "")) == Counter(r for r, f in zip(TABLE, failed) if not f and r[3] in good)


def test_near_dedup(spark, docs):
    """Of a group the rows with its least doc_id stay; rows without an id or a word do too."""
    sets = []
    for r in TABLE:
        w = words((r[1] or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(TABLE)))
    for i, a in enumerate(sets):
        for j in range(i):
            if TABLE[i][0] is not None and TABLE[j][0] is not None and a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, TABLE):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    assert rows_of(C.near_dedup(spark, docs, "")) == Counter(r for g, r in zip(group, TABLE) if r[0] is None or r[0] == least[g])


def test_substring_dedup(spark, docs):
    last, seen = 2**63, {}
    for r in TABLE:
        w = words(r[1])
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            seen[k] = min(seen.get(k, last), last if r[0] is None else r[0])
    want = Counter()
    for r in TABLE:
        w, own = words(r[1]), last if r[0] is None else r[0]
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if seen[tuple(w[j : j + 13])] < own:
                gone[j : j + 13] = [True] * 13
        text = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r[1]
        want[(r[0], text, r[2], r[3], len(text) if any(gone) else r[4], *r[5:])] += 1
    assert rows_of(C.substring_dedup(spark, docs, "")) == want


def test_decontamination(spark, docs, tmp_path):
    texts = {r[0]: r[1] for r in TABLE}
    items = [(1, " ".join(words(texts[14])[25:60]).upper()), (2, "same LINE here"), (None, "Other"), (3, None), (4, "--"), (11, texts[9])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    word, patterns = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for _, x in items:
        w = word.findall((x or "").translate(LOW))
        patterns |= {tuple(w[j : j + 13]) for j in range(max(1, len(w) - 12) if w else 0)}
    want = Counter()
    for r in TABLE:
        w = word.findall((r[1] or "").translate(LOW))
        hit = {j + k for p in patterns for j in range(len(w) - len(p) + 1) if tuple(w[j : j + len(p)]) == p for k in range(len(p))}
        if not hit or 20 * len(hit) < len(w):
            want[r] += 1
    assert rows_of(C.decontamination(spark, docs, str(tmp_path))) == want and sum(want.values()) < len(TABLE)


def test_packing(spark, docs):
    t, want = Tokenizer.from_file(TOKENIZER), Counter()
    for r in TABLE:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    rows = C.packing(spark, docs, "").collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = docs.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert rows_of(C.decontamination(spark, docs, str(tmp_path))) == Counter(TABLE)
