"""Sharding by sampled splitters (operator 4), in DataFrame functions only.

The key of a row is the hash of its text, so copies of a text are one key. Key samples are
drawn with a chance in proportion to the row's size; quantiles of the weighted sample
become the boundaries of many narrow ranges of keys. Ranges that turn out overfull when
all rows are counted are subdivided with samples of their own (or in the middle, where a
sample cuts nothing off) until none is. A boundary never falls inside a group of copies.

Groups that are larger than a range are counted exactly and stand for themselves. They are
kept whole where near equal shards can be filled so; otherwise they are cut, the largest
first, into as few equal parts as that takes, by a hash of doc_id and row. Ranges and
groups then fill the shards, heaviest first, to near equal bytes. Only samples and totals
of ranges and large groups reach the driver; their number depends on ``ranges_per_shard``
and ``rows_per_range`` and not on how rows are spread.

Nulls: a null text counts as empty (size 1), so null and empty texts are copies; a null
doc_id is an ordinary one. Repeated rows are all placed, and are told apart by a number of
their own. Equal sizes are settled by the order of keys. Very long texts are only hashed
and measured. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import passing, written

_LOW, _HIGH = -(2**63), 2**63 - 1
_PREFIX = 52  # the top twelve bits of a hash name the cell in which a range is looked up


def _cuts(sample: list[tuple[int, float]], target: float) -> set[int]:
    """Keys at multiples of ``target`` in the sample's running weight."""
    found, total, due = set(), 0.0, target
    for key, weight in sorted(sample):
        total += weight
        if total >= due:
            found.add(key)
            due = total + target
    return found


def _fill(items: list[tuple[int, int]], shards: int) -> tuple[list[int], list[int]]:
    """The shard of each item (bytes, rows): the heaviest first, each to the shard with the
    fewest bytes so far. Also the bytes of every shard."""
    load, homes = [(0, s) for s in range(shards)], [0] * len(items)
    for k in sorted(range(len(items)), key=lambda k: (-items[k][0], k)):
        held, shard = heappop(load)
        homes[k] = shard
        heappush(load, (held + items[k][0], shard))
    return homes, [held for held, _ in load]


def _parts(groups: list[tuple], rest: list[tuple[int, int]], shards: int, share: float, target: float) -> list[int]:
    """Into how many parts each large group (.., bytes, rows) is cut: as few as give near
    equal shards, trying parts of at most a share, a half of it, and so on."""
    best, even, bound = None, None, share
    while best is None or bound > target:
        parts = [max(1, -(-g[1] // max(1, int(bound)))) for g in groups]
        items = [(g[1] // p, g[2] // p) for g, p in zip(groups, parts) for _ in range(p)]
        load = _fill(items + rest, shards)[1]
        spread = max(load) - min(load)
        if best is None or spread < even:
            best, even = parts, spread
        if spread <= 0.02 * share:
            break
        bound /= 2
    return best


def shard_by_bytes(docs: DataFrame, *, shards: int = 16, ranges_per_shard: int = 256, oversample: int = 4, rows_per_range: int = 1_000_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document."""
    with passing(docs.sparkSession) as keep:
        return _shard_by_bytes(docs, shards, ranges_per_shard, oversample, rows_per_range, keep)


def _shard_by_bytes(docs: DataFrame, shards: int, ranges_per_shard: int, oversample: int, rows_per_range: int, keep: list[DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = written(rows, "keys")
    keep.append(rows)
    rows = rows.withColumn("_cell", F.shiftright("_key", _PREFIX).cast("int")).withColumn("_turn", F.shiftrightunsigned(F.xxhash64("doc_id", "_row"), 11) * F.lit(2.0**-53))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = max(shards * ranges_per_shard, n_rows // rows_per_range)
    share, target, most_rows = total / shards, max(1.0, total / n_ranges), max(1, 2 * n_rows // n_ranges)

    def table(columns: list[tuple[str, list, pa.DataType]]) -> DataFrame:
        return spark.createDataFrame(pa.table([pa.array(v, k) for _, v, k in columns], names=[n for n, _, _ in columns]))

    # groups of copies that are larger than a range; there are fewer than 2 * n_ranges
    grouped = rows.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = sorted(tuple(r) for r in grouped.where((F.col("bytes") > target) | (F.col("rows") > most_rows)).collect())
    large = table([("_key", [g[0] for g in groups], pa.int64())])
    small = rows.join(F.broadcast(large), "_key", "left_anti") if groups else rows

    def ranged(df: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
        """``df`` with ``_range``, for those of its rows that lie in one of ``ranges``, which
        are (number, low, high) with both ends included. A cell has about ``n_ranges`` / 4096 of them."""
        cells = [(c, *r) for r in ranges for c in range(r[1] >> _PREFIX, (r[2] >> _PREFIX) + 1)]
        held = table([(n, list(v), k) for n, v, k in zip(("_cell", "_range", "_low", "_high"), zip(*cells), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))])
        return df.join(F.broadcast(held), "_cell").where(F.col("_key").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")

    def totals(ranges: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
        sums = ranged(small, ranges).groupBy("_range").agg(F.sum("size"), F.count("*"), F.min("_key"), F.max("_key"))
        return {r[0]: (r[1], r[2], r[3] < r[4]) for r in sums.collect()}

    def samples(ranges: list[tuple[int, int, int]], seed: int) -> dict[int, list[tuple[int, float]]]:
        chance = F.col("size") * F.lit(oversample / target)
        uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "_row", F.lit(seed)), 11) * F.lit(2.0**-53)
        weight = F.greatest(F.col("size").cast("double"), F.lit(target / oversample))
        found: dict[int, list] = {}
        for r in ranged(small, ranges).where(uniform < chance).select("_range", "_key", weight).collect():
            found.setdefault(r[0], []).append((r[1], r[2]))
        return found

    # each round looks at the ranges that the last one found overfull
    done, todo, seed = [], [(0, _LOW, _HIGH)], 0
    while todo:
        cut, fresh = samples(todo, seed), []
        for k, low, high in todo:
            inside = sorted(c for c in _cuts(cut.get(k, []), target) if low < c <= high)
            if not inside and seed:
                inside = [low + (high - low) // 2 + 1]
            fresh += [(a, b - 1) for a, b in zip([low, *inside], [*inside, high + 1])]
        numbered = [(k, a, b) for k, (a, b) in enumerate(fresh)]
        sums, todo, seed = totals(numbered), [], seed + 1
        for r in numbered:
            size, n, several = sums.get(r[0], (0, 0, False))
            if several and (size > 2 * target or n > 2 * most_rows):
                todo.append(r)
            else:
                done.append((r[1], r[2], size, n))

    # a part is made of several units: no task numbers too many rows, and parts come out even
    done.sort()
    parts = _parts(groups, [d[2:] for d in done], shards, share, target)
    units = [p * max(1 if p == 1 else 64, -(-g[2] // (p * most_rows))) for g, p in zip(groups, parts)]
    firsts = [len(done) + sum(units[:k]) for k in range(len(units))]
    located = ranged(small, [(k, d[0], d[1]) for k, d in enumerate(done)]).withColumnRenamed("_range", "_unit")
    if groups:
        cut_up = table([("_key", [g[0] for g in groups], pa.int64()), ("_first", firsts, pa.int32()), ("_units", units, pa.int32())])
        dealt = rows.join(F.broadcast(cut_up), "_key").withColumn("_unit", (F.col("_first") + F.floor(F.col("_turn") * F.col("_units"))).cast("int")).drop("_first", "_units")
        located = located.unionByName(dealt)
    counts = {r[0]: (r[1], r[2]) for r in located.groupBy("_unit").agg(F.sum("size"), F.count("*")).collect()}

    bundles = [[k] for k in range(len(done))]
    for g, f, u, p in zip(groups, firsts, units, parts):
        own, held = [[] for _ in range(p)], 0
        for k in range(f, f + u):
            size = counts.get(k, (0, 0))[0]
            own[min(p - 1, int((held + size / 2) * p // g[1]))].append(k)
            held += size
        bundles += own
    homes = _fill([tuple(sum(counts.get(k, (0, 0))[i] for k in b) for i in (0, 1)) for b in bundles], shards)[0]
    filled, at = [0] * shards, []
    for shard, bundle in zip(homes, bundles):
        for k in bundle:
            at.append((k, shard, filled[shard]))
            filled[shard] += counts.get(k, (0, 0))[1]
    places = table([(n, list(v), k) for n, v, k in zip(("_unit", "shard", "_start"), zip(*at), (pa.int32(), pa.int32(), pa.int64()))])
    place = F.row_number().over(Window.partitionBy("_unit").orderBy("_key", "doc_id", "_row"))
    return located.withColumn("_place", place).join(F.broadcast(places), "_unit").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
