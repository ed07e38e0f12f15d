"""Wrapping by what must hold of any wrapped text: no ink is lost, no line is too long unless
it is one word, no line could take what follows it, and looks are kept."""

import re
import tracemalloc

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from quire.functions import text as X
from quire.operators.wrapping import wrap_runs
from quire.schemas import STYLED_RUN

INK = re.compile(r"[^\s﻿]+")
few = settings(max_examples=4, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))

letters = st.text("abé𝒳日", min_size=1, max_size=9)
gaps = st.text(" \t ﻿", min_size=1, max_size=4)
plain = st.lists(st.one_of(letters, gaps), max_size=40).map("".join)


def spans(text, width):
    """(first, end) of each line, told by the places of the words."""
    found = []
    for m in INK.finditer(text):
        if not found or m.end() - found[-1][0] > width:
            found.append([m.start() if found else 0, m.end()])
        else:
            found[-1][1] = m.end()
    return found


@few
@given(texts=st.lists(plain, min_size=60, max_size=60), width=st.integers(1, 24))
def test_plain_text(spark, texts, width):
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.wrap_text(F.col("t"), width).alias("w")).collect():
        text, lines = row["t"], row["w"]
        assert INK.findall(" ".join(lines)) == INK.findall(text)
        assert lines == ([text[a:b] for a, b in spans(text, width)] or [""])
        for line in lines:
            assert len(line) <= width or len(INK.findall(line)) == 1


#: A piece of a styled text: a word, a gap or a line break, bold or not.
piece = st.tuples(st.one_of(letters, st.text(" ", min_size=1, max_size=3), st.just("\n")), st.sampled_from([None, False, True]))
boxes = st.lists(piece, max_size=25)


def em(c, bold):
    return 0.0 if c == "\n" else 0.9 if bold and c == "a" else 0.5


def tokens_of(pieces):
    """The words, gaps and breaks of each piece, with their look."""
    return [(t, bool(bold)) for text, bold in pieces for t in re.findall(r"\n|[^\S\n]+|\S+", text)]


@few
@given(many=st.lists(boxes, min_size=40, max_size=40), room=st.integers(20, 90))
def test_styled_text(spark, many, room):
    schema = f"id long, runs array<{STYLED_RUN}>, font_size double, font_family string, bold boolean, italic boolean, color string"
    rows = [(i, [(t, b, None, None, None, None) for t, b in pieces], 10.0, "Helvetica", False, False, "#000000") for i, pieces in enumerate(many)]
    widths = spark.createDataFrame([("Helvetica-b", "a", 0.9)], "font string, char string, em double")
    out = wrap_runs(spark.createDataFrame(rows, schema), widths, F.lit(float(room)), keys=("id",), default_em=0.5)
    found = {i: {} for i in range(len(many))}
    for r in out.orderBy("id", "line", "segment").collect():
        line = found[r["id"]].setdefault(r["line"], [])
        assert r["segment"] == len(line)
        bold = r["font"] == "Helvetica-b"
        assert abs(r["width"] - sum(em(c, bold) * 10 for c in r["text"])) < 1e-9
        assert not line or line[-1][1] != bold  # neighbours differ
        line.append((r["text"], bold))
    for i, pieces in enumerate(many):
        check_box(tokens_of(pieces), [found[i].get(k, []) for k in range(max(found[i]) + 1)], room)  # a line of white space alone has no row


def check_box(tokens, lines, room):
    size = lambda t, bold: sum(em(c, bold) * 10 for c in t)
    left = list(tokens)
    for n, line in enumerate(lines):
        used, words, text = sum(size(t, b) for t, b in line), 0, "".join(t for t, _ in line)
        assert text == text.rstrip(" ")
        looks = [(c, b) for t, b in line for c in t if c != " "]
        while looks:  # the line's ink is the next ink of the text, in the same look
            token, bold = left.pop(0)
            assert token != "\n"
            if token.strip(" "):
                words += 1
                assert looks[: len(token)] == [(c, bold) for c in token]
                looks = looks[len(token) :]
        assert used <= room + 1e-9 or words == 1
        gap = 0.0
        while left and not left[0][0].strip(" "):
            gap += size(*left.pop(0))
        if left and left[0][0] == "\n":
            left.pop(0)
        elif left and n < len(lines) - 1:
            assert words == 0 or used + gap + size(*left[0]) > room - 1e-9  # what follows did not fit
    assert not [t for t, _ in left if t.strip(" \n")]
    assert len(lines) >= 1 + sum(t == "\n" for t, _ in tokens)


def test_a_worker_holds_one_box_at_a_time(spark, monkeypatch):
    """Of 500 boxes of 800 words and spaces each that come in one batch."""
    seen, plain = {}, DataFrame.mapInArrow

    def noting(df, run, kinds):
        seen.update(df=df, run=run)
        return plain(df, run, kinds)

    monkeypatch.setattr(DataFrame, "mapInArrow", noting)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), ((i * 7 + F.col("id")) % 50).cast("string"))), " ")
    runs = F.array(F.struct(text.alias("text"), F.lit(True).alias("bold"), *(F.lit(None).alias(k) for k in ("italic", "color", "font_size", "font_family")))).cast(f"array<{STYLED_RUN}>")
    boxes = spark.range(500).select("id", runs.alias("runs"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("#000000").alias("color"), F.lit(10.0).alias("font_size"), F.lit("Courier").alias("font_family"))
    out = wrap_runs(boxes, spark.createDataFrame([], "font string, char string, em double"), F.lit(200.0), keys=("id",))
    batch = seen["df"].toArrow().combine_chunks().to_batches()[0]
    assert batch.num_rows == 500
    tracemalloc.start()
    n = sum(b.num_rows for b in seen["run"](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == out.count() > 10_000
    assert most < 20_000_000


def test_a_worker_holds_one_line_of_a_long_box(spark, monkeypatch, tmp_path):
    """In drawn_lines: of a conversation of 100,000 words and spaces, and of one of 3,000 words
    of 4,000 letters, none of which is remembered."""
    seen, plain = {}, DataFrame.mapInArrow

    def noting(df, run, kinds):
        seen.update(df=df, run=run)
        return plain(df, run, kinds)

    monkeypatch.setattr(DataFrame, "mapInArrow", noting)
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat(F.lit("w"), ((i * 7 + F.col("id")) % 50).cast("string"))), " ")
    long = F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 4000))
    turns = [spark.range(n).select(F.lit(doc).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text")) for doc, n, text in ((1, 500, words), (2, 3000, long))]
    turns[0].union(turns[1]).write.parquet(str(tmp_path / "conversations.parquet"))
    out = entry.queries()["drawn_lines"](spark, str(tmp_path))
    batches = seen["df"].toArrow().to_batches()
    assert sum(b.num_rows for b in batches) == 2
    tracemalloc.start()
    n = sum(b.num_rows for b in seen["run"](iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == out.count() > 8_000
    assert most < 8_000_000
