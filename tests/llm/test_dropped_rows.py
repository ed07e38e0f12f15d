"""The stages that drop documents, on rows with null and shared ids, by each row's own verdict."""

import random
from collections import Counter

import pytest

import corpus_pipeline as C
from quire.llm import common, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(11)


def prose(n):
    return " ".join(f"w{R.randrange(10**6)}" for _ in range(n))


ITEM = prose(40)
#: (text, host, fails the rules, contaminated); the host "bad" has failing texts only but one
CASES = [(prose(30), "good", False, False) for _ in range(30)]
CASES += [("too short", "good", True, False), (None, "good", True, False), ("la la la la la " * 10, None, True, False)]
CASES += [(f"short {i}", "bad", True, False) for i in range(30)] + [(prose(30), "bad", True, False)]
CASES += [(prose(20) + " " + ITEM, "good", False, True), (ITEM, None, False, True), (prose(30), None, False, False)]


def rows():
    """Every case with a null id, and with ids that three cases share."""
    ids = [(None, c) for c in CASES] + [(i % 30, c) for i, c in enumerate(CASES)]
    out = [((doc, text, "en", source, None), bad, hit) for doc, (text, source, bad, hit) in ids]
    return out + out[:1] + out[-3:]  # repeated rows


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_rules_and_decontamination(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(common, "MAX_BROADCAST_IDS", most)
    found = rows()
    docs = spark.createDataFrame([r for r, _, _ in found], SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in C.quality_rules(spark, docs, "").collect())
    assert got == Counter(r for r, bad, _ in found if not bad)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in C.decontamination(spark, docs, str(tmp_path)).collect())
    assert got == Counter(r for r, _, hit in found if not hit)


def test_near_dedup(spark):
    """A row without an id stays; of two texts under one id only the later copy goes."""
    a, b, c = prose(60), prose(60), prose(60)
    near = a + " end"
    table = [(1, a), (2, near), (2, b), (None, a), (None, near), (4, None), (4, c), (4, c), (5, c)]
    docs = spark.createDataFrame([(i, t, "en", "h", None) for i, t in table], SCHEMA)
    got = Counter((r["doc_id"], r["text"]) for r in C.near_dedup(spark, docs, "").collect())
    assert got == Counter(table) - Counter([(2, near), (5, c)])


def test_texts_that_share_an_id(spark):
    """Each text is linked by its own set and named by its own component."""
    a, b, c = prose(60), prose(60), prose(60)
    table = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (5, c), (5, b + " z"), (6, c + " x")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = neardup.near_duplicates(docs, with_row=True).join(docs.withColumn("row", common.row_key()), ["doc_id", "row"])
    got = {(r["doc_id"], r["text"]): (r["component_id"], r["kept"]) for r in found.collect()}
    least = {a: 1, b: 1, c: 5}
    want = {(i, t): least.get(t) or least[t[:-2]] for i, t in table}
    assert got == {k: (least_id, k[0] == least_id) for k, least_id in want.items()}
