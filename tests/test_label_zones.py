import re

from quire.plans import layout_queries as L

DIR = "/root/testdata/sf0.001"
KINDS = [("initials", "and|und", 40), ("date", "la|der", 36), ("signature", "the", 48)]


def test_long_and_foreign_lines_have_zones(spark):
    """Against a plain model over all lines, whatever their length and alphabet."""
    want, long, foreign = [], 0, 0
    for r in L.document_lines(spark, DIR).collect():
        for kind, words, height in KINDS:
            if re.search(rf"\b({words})\b", r["text"], re.I | re.A):
                n = len(r["text"])
                want.append((r["doc_id"], r["line"], kind, 84.0 + n, 20.0 * r["line"] + 10 - height / 2))
                long += n >= 120
                foreign += not r["text"].isascii()
                break
    assert long > 100 and foreign > 100
    got = L.queries()["label_zones"](spark, DIR).select("doc_id", "line", "kind", "x", "y").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
