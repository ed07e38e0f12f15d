"""Functions over arrays of styled runs; a null style field inherits the box's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import STYLED_RUN

STYLE = ["bold", "italic", "color", "font_size", "font_family"]


def _run(text: Column, style: Column) -> Column:
    return F.struct(text.alias("text"), *(style[k].alias(k) for k in STYLE)).cast(STYLED_RUN)


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def runs_length(runs: Column) -> Column:
    return F.length(runs_text(runs))


def same_style(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for k in STYLE:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_runs(runs: Column) -> Column:
    """Empty runs dropped, neighbours of one style merged; never an empty array."""

    def merged(full: Column, firsts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            members = F.slice(full, start + 1, F.coalesce(F.get(firsts, k + 1), F.size(full)) - start)
            return _run(F.array_join(F.transform(members, lambda r: r["text"]), ""), F.get(full, start))

        return F.transform(firsts, one)

    def of_full(full: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(full) - 1), lambda i: (i == 0) | ~same_style(F.get(full, i - 1), F.get(full, i)))
        return F.when(F.size(full) > 0, _let(places, lambda firsts: merged(full, firsts))).otherwise(F.array(blank))

    blank = F.struct(F.lit("").alias("text"), *(F.lit(None).alias(k) for k in STYLE)).cast(STYLED_RUN)
    return _let(F.filter(F.transform(runs, lambda r: _run(r["text"], r)), lambda r: r["text"] != ""), of_full)


def with_offsets(runs: Column) -> Column:
    """array of struct(start, end, run): character offsets of each run."""
    kind = f"array<struct<start: int, end: int, run: {STYLED_RUN}>>"

    def step(acc: Column, r: Column) -> Column:
        start = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        return F.concat(acc, F.array(F.struct(start.alias("start"), (start + F.length(r["text"])).alias("end"), _run(r["text"], r).alias("run")))).cast(kind)

    return F.aggregate(runs, F.array().cast(kind), step)


def _cut(runs: Column, low: Column, high: Column) -> Column:
    """The parts of the runs within [low, high), empty ones dropped."""

    def part(o: Column) -> Column:
        a = F.greatest(o["start"], low)
        return _run(F.substring(o["run"]["text"], a - o["start"] + 1, F.greatest(F.least(o["end"], high) - a, F.lit(0))), o["run"])

    inside = F.filter(with_offsets(runs), lambda o: (o["end"] > low) & (o["start"] < high))
    return F.transform(inside, part)


_FAR = 2**31 - 1


def split_runs_at(runs: Column, offset: Column) -> Column:
    """struct(left, right)."""
    return F.struct(_cut(runs, F.lit(0), offset).alias("left"), _cut(runs, offset, F.lit(_FAR)).alias("right"))


def apply_format(runs: Column, start: Column, end: Column, patch: Column) -> Column:
    """The style fields of ``patch`` that are not null, put on characters [start, end)."""

    def patched(r: Column) -> Column:
        return F.struct(r["text"].alias("text"), *(F.coalesce(patch[k], r[k]).alias(k) for k in STYLE)).cast(STYLED_RUN)

    parts = F.concat(_cut(runs, F.lit(0), start), F.transform(_cut(runs, start, end), patched), _cut(runs, end, F.lit(_FAR)))
    return F.when(end <= start, normalize_runs(runs)).otherwise(normalize_runs(parts))


def style_active(runs: Column, start: Column, end: Column, key: str) -> Column:
    """True if every run that the range touches has the style, and one does."""
    inside = F.filter(with_offsets(runs), lambda o: (o["end"] > start) & (o["start"] < end))
    return (F.size(inside) > 0) & F.forall(inside, lambda o: F.coalesce(o["run"][key], F.lit(False)))


def resolve_style(runs: Column, edit: dict[str, Column]) -> Column:
    """Runs with every style field filled in from the box."""
    return F.transform(runs, lambda r: F.struct(r["text"].alias("text"), *(F.coalesce(r[k], edit[k]).alias(k) for k in STYLE)))
