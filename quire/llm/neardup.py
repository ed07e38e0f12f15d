"""MinHash near-dedup with tensored banding (operator 8).

A document's set holds its distinct 5-word shingles (words lower-cased in A-Z; the
whole sequence where it has fewer words). Two collections of ``m`` sub-keys, each of
``r`` minhashes, give ``m * m`` table keys by combining every sub-key of the one with
every sub-key of the other: ``2 * m * r`` minhashes do the work of ``2 * r * m * m``.
A pair of similarity s shares a key unless one collection has no common sub-key, so it
is missed with probability below ``2 * (1 - s**r)**m``: 0.003 at s = 0.75 and 0.0001 at
0.85 with the defaults, for a pair; a document is lost only if all its links are.

Equal sets are one class from the start, told by two 64-bit sums over the set, so a
group of copies is never expanded. Under a table key up to ``SMALL_GROUP`` classes are
paired in full; in a larger group all meet the first one only. Candidates are confirmed
on full sets: first each class with the one that it shares most keys with, then what is
left apart. The classes of those larger groups that then still hold several components
are searched exactly by their rarest shingles (``rare_pairs``). So no pair that shares a
key is lost, and no group is paired in full unless it is small. What this cannot tell apart
beforehand are sets that fall only just short of the threshold: a crowd of sets that are all
nearly similar enough to each other, and not linked, still gives many pairs to confirm.

Nulls: a null text has an empty set, which is linked with nothing; a null doc_id stays
a row of its own (component_id null) and links nobody. Repeated ids and rows are kept,
one row each; the texts of rows that share an id are classes of their own, judged each by
its own set, and all belong to one component, as they are one document (unless rows are
asked for, ``with_row``). Of equal ids and
sets any row stands for the class. Empty tables give no rows. Very long texts are read
whole, one at a time. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, gathered, give_back, passing, row_key, small_batches, texts_of, written
from quire.llm.wordhash import FOLDED, grams, hashed_words, mixed, raw_bytes, small_tables


def shingle_sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and each text's bounds."""
    hashes, _, _, words = hashed_words(*raw_bytes(texts), table=FOLDED)
    n = np.diff(words)
    doc = np.repeat(np.arange(len(n)), n)
    fits = np.arange(len(hashes)) + k <= words[1:][doc] if len(hashes) else np.zeros(0, bool)
    g, owner = grams(hashes, k)[fits] if len(hashes) else hashes, doc[fits]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence is one shingle
        whole = np.array([grams(hashes[words[i] : words[i + 1]], int(n[i]))[0] + np.uint64(n[i]) for i in short], np.uint64)
        g, owner = np.concatenate([g, mixed(whole)]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(n) + 1))


class Tensor:
    """The two collections of sub-keys and their table keys."""

    def __init__(self, m: int, r: int, seed: int = 8):
        self.m, self.r = m, r
        self.factors = np.random.default_rng(seed).integers(1, 2**63, 2 * m * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minhashes(self, g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(2 m r, texts) least values; every text has at least one shingle."""
        out = np.empty((len(self.factors), len(bounds) - 1), np.uint32)
        step = 1 << 16
        i = 0
        while i < len(bounds) - 1:  # slices that stay in the processor's cache
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, side="right")) - 1)
            part, cuts = g[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]
            for t, a in enumerate(self.factors):
                out[t, i:j] = np.minimum.reduceat(((part * a) >> np.uint64(32)).astype(np.uint32), cuts)
            i = j
        return out

    def sub_keys(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, m) sub-keys of each collection."""
        sub = np.zeros((2 * self.m, least.shape[1]), np.uint64)
        for t in range(self.r):
            sub = mixed(sub + least[t :: self.r].astype(np.uint64) + np.uint64(t + 1))
        sub = mixed(sub + np.arange(1, 2 * self.m + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
        return np.ascontiguousarray(sub[: self.m].T), np.ascontiguousarray((sub[self.m :] >> np.uint64(32)).astype(np.uint32).T)

    def keys(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Table keys of pairs: a sub-key of the first collection with each of the second's."""
        return mixed(first[:, None] + (second.astype(np.uint64) << np.uint64(8)) + np.arange(self.m, dtype=np.uint64)).ravel()


def signatures(docs: DataFrame, tensor: Tensor, k: int) -> DataFrame:
    """(doc_id, row, n_shingles, h1, h2, least binary) of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            for part in small_tables(t):
                g, bounds = shingle_sets(part.column("text"), k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                least: list[bytes | None] = [None] * len(n)
                if len(full):
                    cuts = bounds[:-1][full]
                    sums[0, full], sums[1, full] = np.add.reduceat(mixed(g), cuts), np.add.reduceat(mixed(g ^ np.uint64(0x5851F42D4C957F2D)), cuts)
                    rows = np.ascontiguousarray(tensor.minhashes(g, np.append(cuts, len(g))).T)
                    for i, row in zip(full.tolist(), rows):
                        least[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").combine_chunks(), part.column("row").combine_chunks(), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(least, pa.binary())],
                    names=["doc_id", "row", "n_shingles", "h1", "h2", "least"],
                )

    return texts_of(docs).withColumn("row", row_key()).mapInArrow(sign, "doc_id long, row long, n_shingles long, h1 long, h2 long, least binary")


#: Groups of up to so many classes are paired in full.
SMALL_GROUP = 6


def _cells(rows: tuple, block: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Arrays cut by ``block``: a row for each block, its values packed."""
    order = np.argsort(block, kind="stable")
    which, cut = np.unique(block[order], return_index=True)
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(order)]))
    packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (r[order] for r in rows)]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *packed], names=["_block", *names])


def _unpacked(t: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(c)]) for c, kind in columns]


def _sub_keys(t: pa.Table, tensor: Tensor) -> tuple[np.ndarray, np.ndarray]:
    return tensor.sub_keys(np.stack([np.frombuffer(x.as_py(), np.uint32) for x in t.column("least")]).T)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def hot_keys(classes: DataFrame, tensor: Tensor, rows_per_key: int, share: int) -> np.ndarray:
    """Sub-keys of the first collection that hold about ``rows_per_key`` classes or more,
    told from one class in ``share``. They only decide how rows are dealt over tasks, never
    which pairs are made; there are at most ``m * classes / rows_per_key`` of them."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            if t.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_sub_keys(t, tensor)[0].ravel().view(np.int64))], names=["key"])

    small_batches(classes.sparkSession)
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0).select("least")
    found = sample.mapInArrow(keyed, "key long").groupBy("key").count().where(F.col("count") * share >= rows_per_key)
    return np.sort(found.select("key").toArrow().column("key").to_numpy().view(np.uint64))


def candidate_pairs(classes: DataFrame, tensor: Tensor, blocks: int, hot: np.ndarray, *, salts: int = 64, crowded: bool = False) -> DataFrame:
    """(a, b, shared, large): classes of (rep, component, least) that meet under ``shared``
    table keys and are of different components, a < b. The classes of a key are paired in
    full up to ``SMALL_GROUP``. In a larger group the first class of each component meets
    the group's first one, and ``large`` is true. With ``crowded`` only the classes of such
    groups are told, as (a, a).

    A class is sent once for each sub-key of its first collection, to a block with all that
    share it, and the table keys are made there. The classes of a hot sub-key are dealt over
    ``salts`` groups; the first ones that these have under a table key then meet."""
    m = tensor.m

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, 1 << 20):
            if not t.num_rows:
                continue
            first, second = _sub_keys(t, tensor)
            owner, component = (np.repeat(t.column(c).to_numpy(), m) for c in ("rep", "component"))
            first, second = first.ravel(), np.repeat(second, m, axis=0)
            dealt = np.where(_among(first, hot), mixed(first + (owner % salts).astype(np.uint64)), first)
            yield _cells((first, second, component, owner), ((dealt >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64), ["_first", "_second", "_components", "_owners"])

    def met(keys: np.ndarray, component: np.ndarray, owner: np.ndarray, is_hot: np.ndarray) -> pa.Table:
        order = np.lexsort((owner, component, keys))
        keys, component, owner, is_hot = keys[order], component[order], owner[order], is_hot[order]
        opens = np.append(True, keys[1:] != keys[:-1])
        group = np.cumsum(opens) - 1
        starts = np.flatnonzero(opens)
        first, size = starts[group], np.diff(np.append(starts, len(keys)))[group]
        place, last = np.arange(len(keys)) - first, first + size - 1
        mingled = component[first] != component[last]  # of two components at least
        small = mingled & ~is_hot & (size <= SMALL_GROUP)
        large = (mingled | is_hot) & ~small
        a, b, big = [], [], []

        def add(x, y, flag):
            a.append(np.minimum(owner[x], owner[y]))
            b.append(np.maximum(owner[x], owner[y]))
            big.append(np.full(len(x), flag))

        if crowded:
            at = np.flatnonzero(large)
            add(at, at, True)
        else:
            for back in range(1, SMALL_GROUP):
                at = np.flatnonzero(small & (place >= back))
                at = at[component[at] != component[at - back]]
                add(at - back, at, False)
            leads = np.append(True, opens[1:] | (component[1:] != component[:-1]))
            at = np.flatnonzero(large & leads & (place > 0))
            add(first[at], at, True)
        a, b, big = np.concatenate(a), np.concatenate(b), np.concatenate(big)
        order = np.lexsort((b, a))
        a, b, big = a[order], b[order], big[order]
        cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        shared, big = np.diff(np.append(cut, len(a))), np.maximum.reduceat(big, cut) if len(cut) else big
        heads = np.flatnonzero(is_hot & opens)  # they meet the heads of the other salts
        none = np.zeros(len(heads), np.int64)
        columns = [
            (np.concatenate([a[cut], owner[heads]]), pa.int64()), (np.concatenate([b[cut], component[heads]]), pa.int64()), (np.concatenate([shared, none]), pa.int64()),
            (np.concatenate([big, none == 0]).astype(bool), pa.bool_()), (np.concatenate([np.full(len(cut), None), keys[heads].view(np.int64).astype(object)]), pa.int64()),
        ]
        return pa.table([pa.array(x, k) for x, k in columns], names=["a", "b", "shared", "large", "key"])

    def in_block(t: pa.Table) -> pa.Table:
        first, second, component, owner = _unpacked(t, ("_first", np.uint64), ("_second", np.uint32), ("_components", np.int64), ("_owners", np.int64))
        keys = tensor.keys(first, second.reshape(-1, m))
        out = met(keys, *(np.repeat(x, m) for x in (component, owner, _among(first, hot))))
        give_back()
        return out

    def of_heads(t: pa.Table) -> pa.Table:
        return met(t.column("key").to_numpy().view(np.uint64), t.column("b").to_numpy(), t.column("a").to_numpy(), np.zeros(t.num_rows, bool))

    small_batches(classes.sparkSession)
    ddl = "a long, b long, shared long, large boolean, key long"
    sent = classes.select("rep", "component", "least").mapInArrow(keyed, "_block int, _first binary, _second binary, _components binary, _owners binary")
    found = sent.groupBy("_block").applyInArrow(in_block, ddl)
    if len(hot):
        found = written(found, "met")
        found = found.where("key is null").union(found.where("key is not null").groupBy("key").applyInArrow(of_heads, ddl))
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.bool_or("large").alias("large"))


#: Buckets in which shingles are counted to tell rare ones.
RARITY_BUCKETS = 1 << 20


def _listed(entries: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``entries`` (token, id, component, size, rest) in an order by token, the number of
    partners of each and of each token's list, and the place of each one's first partner."""
    starts = np.flatnonzero(np.append(True, entries[1:, 0] != entries[:-1, 0]))
    return entries, count, np.add.reduceat(count, starts), first


def _apart(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Partners: those of later components on the token's list."""
    entries = entries[np.lexsort((entries[:, 2], entries[:, 0]))]
    token, component = entries[:, 0], entries[:, 2]
    turn = np.flatnonzero(np.append((token[1:] != token[:-1]) | (component[1:] != component[:-1]), True)) + 1
    run_end = turn[np.searchsorted(turn, np.arange(len(token)), side="right")]
    return _listed(entries, np.searchsorted(token, token, side="right") - run_end, run_end)


def _alike(entries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Partners: those of the same or a greater size that the entry's rest allows."""
    entries = entries[np.lexsort((entries[:, 3], entries[:, 0]))]
    token, size, rest = entries[:, 0], entries[:, 3], entries[:, 4]
    most = np.minimum((100 + percent) * rest // percent - size, 2**39)
    here = np.cumsum(np.append(True, token[1:] != token[:-1])) << 40
    after = np.arange(len(token)) + 1
    return _listed(entries, np.maximum(np.searchsorted(here + size, here + most, side="right") - after, 0), after)


def rare_pairs(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b): every two rows of ``sets`` (id, component, shingles) in different
    components that can have 100 * intersection >= percent * union.

    Such sets share a shingle among the ``n - ceil(percent * n / 100) + 1`` that come
    first in each, in any one order of all shingles; here rare ones come first. Rarity
    is a count by bucket, so what is broadcast has ``RARITY_BUCKETS`` numbers. After the
    first shingle in common a set has ``rest`` more, itself included, and two sets can
    only be similar enough if ``percent`` of both sizes is at most ``100 + percent`` of
    either rest: sets that share one long passage, and rare shingles before it, meet but
    are no candidates. A shingle within one component brings none either."""
    spark = sets.sparkSession
    shift = np.uint64(64 - RARITY_BUCKETS.bit_length() + 1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY_BUCKETS, np.int64)
        for b in batches:
            for x in b.column("shingles"):
                np.add.at(n, (np.frombuffer(x.as_py(), np.uint64) >> shift).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    counted = sets.select("shingles").mapInArrow(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(RARITY_BUCKETS, np.int64)
    rarity[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    held = spark.sparkContext.broadcast(rarity)
    blocks = max(parts, int(rarity.sum()) // 1_000_000)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, 4 << 20):
            tokens, lengths, sizes = [], [], []
            for x in t.column("shingles"):
                g = np.frombuffer(x.as_py(), np.uint64)
                n = len(g)
                tokens.append(g[np.lexsort((g, held.value[(g >> shift).astype(np.int64)]))][: n + 1 - (percent * n + 99) // 100])
                lengths.append(len(tokens[-1]))
                sizes.append(n)
            if not tokens:
                continue
            token = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            entries = np.empty((len(token), 5), np.int64)
            entries[:, 0] = token.view(np.int64)
            for k, values in enumerate((t.column("id").to_numpy(), t.column("component").to_numpy(), np.array(sizes))):
                entries[:, k + 1] = values[owner]
            entries[:, 4] = entries[:, 3] - (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
            yield _cells((entries,), ((token >> np.uint64(7)) % np.uint64(blocks)).astype(np.int64), ["_entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate([np.frombuffer(x.as_py(), np.int64) for b in batches for x in b.column("_entries")]).reshape(-1, 5)
        # both ways see every pair of a list; each list is read the way that has fewer
        by_component, by_size = _apart(entries), _alike(entries, percent)
        cheaper = by_component[2] <= by_size[2]
        for (entries, count, _, first), take in ((by_component, cheaper), (by_size, ~cheaper)):
            _, ids, component, size, rest = entries.T
            new = np.append(True, entries[1:, 0] != entries[:-1, 0])
            at = np.flatnonzero((count > 0) & take[np.cumsum(new) - 1])
            whole = np.concatenate([[0], np.cumsum(count[at])])
            i = 0
            while i < len(at):  # a million pairs at a time, given out as they come
                j = max(i + 1, int(np.searchsorted(whole, whole[i] + 1_000_000, side="right")) - 1)
                n = count[at[i:j]]
                x = np.repeat(at[i:j], n)
                y = np.repeat(first[at[i:j]], n) + np.arange(len(x)) - np.repeat(whole[i:j] - whole[i], n)
                can = (component[x] != component[y]) & (percent * (size[x] + size[y]) <= (100 + percent) * np.minimum(rest[x], rest[y]))
                x, y = ids[x[can]], ids[y[can]]
                found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
                i = j
        give_back()

    rows = sets.mapInArrow(prefixes, "_block int, _entries binary")
    return rows.groupBy("_block").applyInArrow(meet, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union. The sets of ``b``
    are fetched first: what a star ``a`` has many of travel to it once each, not its own set
    once for each of them."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("_x"), b.column("_y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(y) < len(x):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    return pairs.select("a", "b").join(y.hint("merge"), "b").join(x.hint("merge"), "a").select("a", "b", "_x", "_y").mapInArrow(judge, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b), written: the least node
    it reaches. Least labels travel along edges, and labels of labels are taken (pointer
    jumping), until nothing changes; each round is written to the shared folder."""
    spark = edges.sparkSession
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label", F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        heard = both.join(labels.select(F.col("node").alias("v"), "label").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard.withColumnRenamed("u", "node").hint("merge"), "node").select("node", F.col("label").alias("before"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = hooked.join(jump.hint("merge"), "label", "left").select("node", "before", F.least("label", F.coalesce("further", "label")).alias("label"))
        done = labels.written_to
        labels = written(jumped.select("node", "label", (F.col("label") != F.col("before")).alias("changed")), "labels")
        discard(spark, done)
    return labels.select("node", F.col("label").alias("component"))


def joined_texts(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that one doc_id belongs to, as its rows have different texts. They
    are one document, so what either is linked with is reachable from both."""
    same = ["n_shingles", "h1", "h2"]
    ids = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*same)).alias("_lo"), F.max(F.struct(*same)).alias("_hi"))
    several = written(ids.where("_lo <> _hi").select("doc_id"), "several")
    if not several.limit(1).count():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    rows = signed.join(several.hint("merge"), "doc_id").join(classes.select(*same, "rep").hint("merge"), same).select("doc_id", "rep").distinct()
    least = rows.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return written(rows.join(least.hint("merge"), "doc_id").where("a < rep").select("a", F.col("rep").alias("b")), "links")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 75, m: int = 12, r: int = 3, rows_per_hot_key: int = 1_000_000, with_row: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document. ``with_row`` adds its
    ``row_key`` as ``row`` and judges each row alone: texts that share an id are not linked
    by it, so that a filter by rows takes no text for another's sake."""
    with passing(docs.sparkSession) as keep:
        return _near_duplicates(docs, Tensor(m, r), shingle, percent, rows_per_hot_key, ("row",) if with_row else (), keep)


def _near_duplicates(docs: DataFrame, tensor: Tensor, shingle: int, percent: int, rows_per_hot_key: int, carry: tuple[str, ...], keep: list[DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = written(signatures(docs, tensor, shingle), "signatures")
    same = ["n_shingles", "h1", "h2"]
    grouped = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "row", "least")).alias("_rep"))
    # a doc_id may have several texts, so a class is named by a number of its own
    named = grouped.select(*same, "_rep.*").sortWithinPartitions(*same).withColumn("rep", F.monotonically_increasing_id())
    classes = written(named, "classes")
    n_classes = classes.count()
    # a block holds about half a million keys
    blocks = max(parts, n_classes * tensor.m**2 // 500_000)
    hot = hot_keys(classes, tensor, rows_per_hot_key, max(1, rows_per_hot_key // 500)) if n_classes >= rows_per_hot_key else np.zeros(0, np.uint64)
    pairs = written(candidate_pairs(classes.withColumn("component", F.col("rep")), tensor, blocks, hot), "pairs")

    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            for part in small_tables(t):
                g, bounds = shingle_sets(part.column("text"), shingle)
                rows = [g[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), pa.array(rows, pa.binary())], names=["id", "shingles"])

    # the text that stands for a class is told by its doc_id and hash
    stands = needed.join(classes.select(F.col("rep").alias("id"), "doc_id", "row").hint("merge"), "id")
    wanted = texts_of(docs).withColumn("row", row_key()).join(stands.hint("merge"), ["doc_id", "row"]).select("id", "text")
    sets = wanted.mapInArrow(shelve, "id long, shingles binary")
    sets = written(sets.groupBy("id").agg(F.min("shingles").alias("shingles")), "sets")

    # each class with the one that it shares most keys with, then what this leaves apart
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", F.negative("a"))).alias("a")).select("a", "b")
    first = written(confirmed(best, sets, percent), "links")
    rest = pairs.join(best.hint("merge"), ["a", "b"], "left_anti")
    for c in ("a", "b"):
        rest = rest.join(first.select(F.col("b").alias(c), F.col("a").alias(f"_{c}")).hint("merge"), c, "left")
    rest = rest.where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
    links = first.union(written(confirmed(rest, sets, percent), "links"))
    if not carry:
        links = links.union(joined_texts(signed, classes))
    found = components(links)

    # classes of large groups that hold several components are searched exactly
    large = pairs.where("large")
    crowd = written(large.select(F.col("a").alias("rep")).union(large.select("b")).distinct(), "crowd")
    n_crowd = crowd.count()
    if n_crowd:
        named = found.withColumnRenamed("node", "rep").hint("merge")
        again = crowd.join(classes.select("rep", "least").hint("merge"), "rep").join(named, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "least")
        mixed_in = candidate_pairs(again, tensor, max(parts, n_crowd * tensor.m**2 // 500_000), hot, crowded=True).select(F.col("a").alias("id"))
        apart = sets.join(mixed_in.hint("merge"), "id", "left_semi").join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left")
        apart = written(apart.select("id", F.coalesce("component", "id").alias("component"), "shingles"), "apart")
        if apart.limit(1).count():
            more = written(confirmed(written(rare_pairs(apart, percent, parts), "rare"), sets, percent), "links")
            if more.limit(1).count():
                found = components(links.union(more))

    labelled = classes.select(*same, "rep", "doc_id").join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select(*same, "doc_id", F.coalesce("component", "rep").alias("component"))
    labelled = written(labelled, "labelled")
    # a component is called by the least doc_id of its classes
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labelled = written(labelled.drop("doc_id").join(least.hint("merge"), "component").select(*same, "component_id"), "named")
    keep += [signed, labelled]
    # only a document with a set and an id belongs to a class
    keyed = signed.select("doc_id", *same, *carry)
    member = F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    in_class = keyed.where(member).join(labelled.hint("merge"), same).select("doc_id", "n_shingles", "component_id", *carry)
    alone = keyed.where(~member).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *carry)
    return in_class.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
