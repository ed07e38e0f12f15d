"""The three classifiers against plain models, word by word and character by character."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import langid, quality, toxicity

MARK, STOP = set(b"#*$%&|<>!@^~=+\\_{}[]"), set(b".,;:?'\"()-")


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def made():
    """(doc_id, text, lang, quality, toxic): prose of two kinds, curses in a part of it, odd texts."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(150)]
    other = ["".join(r.choice("klmnopéüß") for _ in range(r.randint(2, 9))) for _ in range(150)]
    rows = []
    for i in range(240):
        good, bad, lang = i % 2, int(i % 5 == 0), ["xx", "yy"][i % 3 % 2]
        text = [r.choice(words if lang == "xx" else other) for _ in range(r.randint(5, 90))]
        if not good:
            text = [w.upper() + r.choice("#*!$") if r.random() < 0.3 else w for w in text]
        if bad:
            at = r.randrange(len(text))
            text[at:at] = [r.choice(["Cursed", "vile", "FOUL"]) for _ in range(r.randint(2, 6))]
        text = ". ".join(" ".join(text[k : k + 9]) for k in range(0, len(text), 9))
        label = r.random() < 0.7
        rows.append((i, text, lang if r.random() < 0.9 else None, good if label else None, bad if label else None))
    rows += [(300, None, "xx", 1, 0), (301, "", None, None, None), (302, " \n ", "yy", 0, 1), (303, "½ ² ¾ 12", None, None, None), (304, "x" * 9000, "xx", None, 0), (None, rows[0][1], "yy", 1, 1), (5, rows[7][1], "yy", None, None), rows[8]]
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r[:3] for r in ROWS], "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], r[3], r[4]) for r in ROWS], "doc_id long, quality int, toxic int").repartition(2)


def known_labels(k):
    """doc_id to label, of repeated ones the greater."""
    out = {}
    for r in ROWS:
        if r[0] is not None and r[k] is not None:
            out[r[0]] = max(out.get(r[0], 0), r[k])
    return out


def plain_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = len(words), len(raw)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)

    def share(part, whole, prior):
        return math.log((part + 12 * prior) / (whole + 12))

    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [
        share(upper, upper + lower, 0.03), share(sum(b in MARK for b in raw), size, 0.001), share(sum(w[-1] in MARK for w in words), n, 0.002), share(sum(b in STOP for b in raw), size, 0.03),
        share(sum(48 <= b <= 57 for b in raw), size, 0.002), share(raw.count(b"\n"), n, 0.02), math.log((sum(map(len, words)) + 60) / (n + 12)), 0.5 * math.log((sum(len(w) ** 2 for w in words) + 36 * 12) / (n + 12)),
        share(len({w.translate(low) for w in words}), n, 0.8) + 0.1 * math.log1p(n), share(sum(b >= 128 for b in raw), size, 0.01),
    ]


def test_quality(docs, labels):
    known = known_labels(3)
    stats = [plain_statistics(r[1]) for r in ROWS]
    classes = {c: np.array([s for s, r in zip(stats, ROWS) if r[0] is not None and not held_out(r[0]) and known.get(r[0]) == c]) for c in (0, 1)}
    n_all = sum(map(len, classes.values()))
    pooled = sum((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) for x in classes.values()) / n_all
    logs = {}
    for c, x in classes.items():
        weight = 0.1 + 0.9 * 10 / (len(x) + 10)
        cov = (1 - weight) * np.cov(x.T, bias=True) + weight * np.diag(np.diag(pooled) + 1e-3)
        away = np.array(stats) - x.mean(axis=0)
        logs[c] = math.log(len(x) / n_all) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    want = sorted((-1 if r[0] is None else r[0], held_out(r[0]), 1 / (1 + math.exp(-max(-30, min(30, d))))) for r, d in zip(ROWS, logs[1] - logs[0]))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in quality.score_quality(docs, labels).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-6) and g[3] == int(g[2] >= 0.7)


def plain_segments(scores):
    """All maximal scoring segments, found by splitting at the best one again and again."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    return [] if best[0] <= 0 else [*plain_segments(scores[: best[3]]), best[0], *plain_segments(scores[best[4] :])]


def test_toxicity(docs, labels):
    known = known_labels(4)
    split = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "") for r in ROWS]
    split = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in x] for x in split]
    clean, toxic = Counter(), Counter()
    for r, words in zip(ROWS, split):
        if r[0] is not None and not held_out(r[0]) and r[0] in known:
            (toxic if known[r[0]] else clean).update(set(words))
    n0, n1, prior = sum(clean.values()), sum(toxic.values()), 0.1
    model = {}
    for w in toxic:
        if toxic[w] > 1:
            alpha, whole = (clean[w] + toxic[w]) * prior, prior * (n0 + n1)
            y1, y0 = toxic[w] + alpha, clean[w] + alpha
            odds = math.log(y1 / (n1 + whole - y1)) - math.log(y0 / (n0 + whole - y0))
            if odds / math.sqrt(1 / y1 + 1 / y0) >= 3.5 and odds >= 1.5:
                model[w] = odds
    assert {"cursed", "vile", "foul"} <= set(model)
    rest = math.log((1 - sum(toxic[w] for w in model) / n1) / (1 - sum(clean[w] for w in model) / n0)) - 0.05
    share = {w: (clean[w] + 0.5) / (n0 + 0.5 * len(model)) for w in model}
    moment = lambda x: sum(share[w] * math.exp(x * model[w]) for w in model) + (1 - sum(share.values())) * math.exp(x * rest)
    low, high = 1e-6, 50.0
    while high - low > 1e-13:
        low, high = ((low + high) / 2, high) if moment((low + high) / 2) < 1 else (low, (low + high) / 2)
    k = sum(share[w] * math.exp(low * model[w]) for w in model)
    evidence = []
    for words in split:
        found = plain_segments([model.get(w, rest) for w in words]) if any(w in model for w in words) else []
        evidence.append(sum(max(0.0, low * s - math.log(max(k * len(words), 1e-12))) for s in found))
    bins = defaultdict(lambda: [0, 0])
    for r, e in zip(ROWS, evidence):
        if r[0] is not None and not held_out(r[0]) and r[0] in known:
            bins[min(math.ceil(e * 2), 200) / 2][known[r[0]]] += 1
    a, b = 0.0, 0.0
    for _ in range(20_000):  # plain ascent by Newton's steps, halved while they do not help
        value = lambda a, b: sum(n[1] * -math.log1p(math.exp(-(a + b * x))) + n[0] * -math.log1p(math.exp(a + b * x)) for x, n in bins.items()) - 5e-4 * (a * a + b * b)
        p = {x: 1 / (1 + math.exp(-(a + b * x))) for x in bins}
        g = [sum(n[1] - sum(n) * p[x] for x, n in bins.items()) - 1e-3 * a, sum((n[1] - sum(n) * p[x]) * x for x, n in bins.items()) - 1e-3 * b]
        h = [sum(sum(n) * p[x] * (1 - p[x]) * x**j for x, n in bins.items()) for j in (0, 1, 2)]
        step = np.linalg.solve([[h[0] + 1e-3, h[1]], [h[1], h[2] + 1e-3]], g)
        while value(a + step[0], b + step[1]) < value(a, b) and abs(step).max() > 1e-12:
            step = step / 2
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-11:
            break
    want = sorted((-1 if r[0] is None else r[0], held_out(r[0]), 1 / (1 + math.exp(-(a + b * min(e, 100.0))))) for r, e in zip(ROWS, evidence))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in toxicity.score_toxicity(docs, labels).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-5) and g[3] == int(g[2] >= 0.3)


def test_labels_within_a_bound(spark):
    known = spark.range(5000).selectExpr("id as doc_id", "1 as label")
    every = {r[0] for r in known.selectExpr("xxhash64(doc_id) as h").collect()}
    for most in (0, 1, 700, 5000, 9999):
        kept = [r[0] for r in toxicity.least_hashed(known, most).selectExpr("xxhash64(doc_id) as h").collect()]
        left = every - set(kept)
        unsigned = lambda h: h % 2**64
        assert len(kept) <= most and (len(kept) >= min(most, 5000) - 3)
        assert not kept or not left or max(map(unsigned, kept)) < min(map(unsigned, left))


def plain_buckets(text):
    codes = [ord(c) for c in text.replace("\0", " ").lower()]
    out = []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            x = codes[i] * 2654435761 % 2**32
            for c in codes[i + 1 : i + n]:
                x = (x + c) * 2246822519 % 2**32
            x = (x ^ (x >> 15)) * 3266489917 % 2**32
            out.append(max(x >> 16, 1))
    return out


@pytest.mark.parametrize("most", [256, 1])
def test_language(docs, monkeypatch, most):
    """With one language in a block, each is a scan of its own."""
    monkeypatch.setattr(langid, "MAX_LANGUAGES", most)
    counts = defaultdict(Counter)
    for r in ROWS:
        if r[0] is not None and not held_out(r[0]) and r[1] is not None and r[2] is not None:
            counts[r[2]].update(plain_buckets(r[1]))
    total = {c: sum(n.values()) + 0.5 * 65536 for c, n in counts.items()}
    want = []
    for r in ROWS:
        own = Counter(plain_buckets(r[1] or ""))
        logs = {c: sum(n * math.log((counts[c][b] + 0.5) / total[c]) for b, n in own.items()) for c in counts}
        best = max(sorted(logs), key=logs.get)
        letters = any(c.isalpha() for c in r[1] or "")
        score = 1 / sum(math.exp(max(v - logs[best], -700)) for v in logs.values()) if letters else 0.0
        want.append((-1 if r[0] is None else r[0], held_out(r[0]), best if letters else "und", score))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in langid.identify_language(docs).collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-3)
    assert {g[2] for g in got} == {"xx", "yy", "und"} and [g[2] for g in got if g[0] == 303] == ["und"]
