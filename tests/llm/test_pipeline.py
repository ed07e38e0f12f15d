import corpus_pipeline as C
from quire.llm.common import read_table


def test_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = read_table(spark, d, "documents")
    counts = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        out = C.written(stage(spark, docs, d), name)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    packed = C.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert C.run(spark, d).count() == packed.count()
    assert C.STAGES[2][1](spark, docs.limit(0), d).count() == 0
