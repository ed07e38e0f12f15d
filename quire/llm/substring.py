"""Substring dedup by relative Lempel-Ziv parsing (operator 3).

The reference of a document is every document with a smaller id. Its phrases are indexed
in blocks, by hash range; a block is one group of a shuffle, and no block is ever held by
the driver.

1. Every window of ``window`` words has an anchor, the least hash of its runs of
   ``anchor`` words. Each block finds the anchors that two documents share; all other
   windows have no copy anywhere and need no further look.
2. The windows on shared anchors are looked up as a whole, again in blocks. A window that
   an earlier document holds gets a source: the least id of a document in which it
   starts, and its place there.
3. A document is parsed greedily, from left to right, against what all blocks told it. At
   a word where a window has a source a factor begins and grows, word by word, as long as
   the next window's source is the next place of the same document; any other word is a
   literal. The parse goes on behind the factor. Windows that begin in a factor and end
   beyond it are checked at each factor's end: those with a source of their own count too.
4. The words of all factors and of those windows are removed. A held window lies in a
   factor or crosses the end of one, so this is every word of every window that an earlier
   document holds. Factors are at least ``window`` words long by construction.

A document meets its findings in a group of documents (``_shelf``), told by its id and its
text, so that rows that share an id, or have none, are spread (only copies that share both
stay together); both passes over the text use the same shuffle. A phrase that more than
``docs_per_salt`` documents hold, as a sample of documents tells, is hot: its entries are
spread over a group for each so many documents, whose summaries (one line for each hot phrase)
are merged, before they are told to documents. All other phrases are told by the group of
their block at once.

Nulls: a null text has no words; a null doc_id counts as larger than all others.
Documents with one id (repeated rows) never take words from each other; of several places
in the source the first counts. Texts with fewer words than ``window`` lose nothing, very
long ones are read whole. Empty tables give no rows. ``carry``'s columns keep their names,
whatever these are, and all others are not read. Phrases are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import gathered, give_back, small_batches, written
from quire.llm.wordhash import grams, hashed_words, raw_bytes, small_tables

_LAST = 2**63 - 1
_KINDS = {"_hashes": np.uint64, "_docs": np.int64, "_shelves": np.int32, "_places": np.int32, "_last": np.int64, "_sources": np.int64}
_PACKED = "_block int, _salt int, _hashes binary, _docs binary, _shelves binary, _places binary"
_ARROW = {"int": pa.int32(), "binary": pa.binary()}
_TOLD = "_shelf int, _docs binary, _hashes binary, _sources binary, _places binary"
_FACTORS = "array<struct<start: long, length: long, source: long, source_start: long>>"


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over x[i : i + n] for each i; near the end over what is left."""
    done = 1
    x = x.copy()
    while done < n:
        by = min(done, n - done)
        x[: len(x) - by] = f(x[: len(x) - by], x[by:])
        done += by
    return x


class Windows:
    """The windows of a slice of documents: ``valid`` places, anchors and hashes."""

    def __init__(self, texts: pa.ChunkedArray, window: int, anchor: int):
        octets, bounds = raw_bytes(texts)
        self.octets = octets
        self.hashes, self.starts, self.ends, self.words = hashed_words(octets, bounds)
        n = len(self.hashes)
        self.doc = np.repeat(np.arange(len(self.words) - 1), np.diff(self.words))
        self.valid = np.flatnonzero(np.arange(n) + window <= self.words[1:][self.doc]) if n else np.zeros(0, np.int64)
        self.window, self.anchor = window, anchor

    def anchors(self) -> np.ndarray:
        """The anchor of each valid window."""
        if not len(self.valid):
            return np.zeros(0, np.uint64)
        return _sliding(grams(self.hashes, self.anchor), self.window - self.anchor + 1, np.minimum)[self.valid]

    def phrases(self) -> np.ndarray:
        return grams(self.hashes, self.window)[self.valid] if len(self.valid) else np.zeros(0, np.uint64)

    def places(self) -> np.ndarray:
        """The place of each valid window in its own document."""
        return (self.valid - self.words[:-1][self.doc[self.valid]]).astype(np.int32)


def _rows(group: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Entries in order of ``group``, which is sorted: a row for each, its values packed."""
    names, first = np.unique(group, return_index=True)
    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(group)]))
    return names, {c: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for c, x in columns.items()}


class Hot:
    """Hot phrases in order, and over how many groups the entries of each are spread."""

    def __init__(self, names: np.ndarray, salts: np.ndarray):
        self.names, self.salts, self.most = names, salts, int(salts.max(initial=0))

    def __bool__(self) -> bool:
        return bool(len(self.names))

    def salts_of(self, hashes: np.ndarray) -> np.ndarray:
        """How many groups each phrase has, 0 if it is not hot."""
        if not self:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, self.salts[at], 0)


def _packed(hashes: np.ndarray, docs: np.ndarray, shelves: np.ndarray, places: np.ndarray | None, blocks: int, hot: Hot) -> pa.RecordBatch:
    """Entries (hash, doc, shelf, first place) without repeats, a row for each block and salt;
    phrases that are not hot have the salt 0, hot ones one from 1 on."""
    order = np.lexsort((shelves, docs, hashes) if places is None else (places, shelves, docs, hashes))
    hashes, docs, shelves = hashes[order], docs[order], shelves[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1]) | (shelves[1:] != shelves[:-1])
    places = np.zeros(0, np.int32) if places is None else places[order][new]
    hashes, docs, shelves = hashes[new], docs[new], shelves[new]
    group = ((hashes >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64) * (hot.most + 1)
    salts = hot.salts_of(hashes)
    group += np.where(salts > 0, 1 + shelves % np.maximum(salts, 1), 0)
    order = np.lexsort((shelves, docs, group))
    names, rows = _rows(group[order], {"_hashes": hashes[order], "_docs": docs[order], "_shelves": shelves[order]} | ({"_places": places[order]} if len(places) else {}))
    rows.setdefault("_places", pa.array([b""] * len(names), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array((names // (hot.most + 1)).astype(np.int32)), pa.array((names % (hot.most + 1)).astype(np.int32)), *rows.values()], names=["_block", "_salt", *rows])


def _joined(t: pa.Table, name: str) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), _KINDS[name]) for x in t.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, _KINDS[name])


def _entries(t: pa.Table) -> list[np.ndarray]:
    """Hashes, documents, shelves and places (-1 where none were kept)."""
    hashes, docs, shelves, places = (_joined(t, c) for c in ("_hashes", "_docs", "_shelves", "_places"))
    return [hashes, docs, shelves, places if len(places) == len(docs) else np.full(len(docs), -1, np.int32)]


def _firsts(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Each hash once, with its least document, the place there, and the greatest one."""
    order = np.lexsort((docs, hashes))
    hashes, docs, places, last = hashes[order], docs[order], places[order], last[order]
    cut = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return [hashes[cut], docs[cut], places[cut], np.maximum.reduceat(last, cut) if len(cut) else last]


def told(entries: DataFrame, hot: Hot, *, earlier: bool) -> DataFrame:
    """For each document its phrases that an earlier document holds (``earlier``), with
    their sources, or that any other document holds: rows (_shelf, _docs, _hashes,
    _sources, _places)."""

    def answer(hashes: np.ndarray, docs: np.ndarray, shelf: np.ndarray, names: np.ndarray, first: np.ndarray, place: np.ndarray) -> pa.Table:
        at = np.searchsorted(names, hashes)
        at[at == len(names)] = 0
        keep = (names[at] == hashes) & ((docs > first[at]) if earlier else True) if len(names) else np.zeros(len(hashes), bool)
        hashes, docs, shelf, at = hashes[keep], docs[keep], shelf[keep], at[keep]
        order = np.lexsort((docs, shelf))
        sources = {"_sources": first[at[order]], "_places": place[at[order]]} if earlier else {}
        which, rows = _rows(shelf[order], {"_docs": docs[order], "_hashes": hashes[order]} | sources)
        for c in ("_sources", "_places"):
            rows.setdefault(c, pa.array([b""] * len(which), pa.binary()))
        return pa.table([pa.array(which.astype(np.int32)), *rows.values()], names=["_shelf", *rows])

    def shared(names, first, place, last):
        keep = first < last
        return names[keep], first[keep], place[keep], last[keep]

    def whole_block(t: pa.Table) -> pa.Table:
        hashes, docs, shelf, places = _entries(t)
        out = answer(hashes, docs, shelf, *shared(*_firsts(hashes, docs, places, docs))[:3])
        give_back()
        return out

    if not hot:
        return entries.groupBy("_block").applyInArrow(whole_block, _TOLD)

    def summary(t: pa.Table, final: bool) -> pa.Table:
        hashes, docs, _, places = _entries(t) if not final else (*(_joined(t, c) for c in ("_hashes", "_docs")), None, _joined(t, "_places"))
        found = _firsts(hashes, docs, places, _joined(t, "_last") if final else docs)
        if final:
            found = shared(*found)
        return pa.table([t.column("_block").slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in found)], names=["_block", "_hashes", "_docs", "_places", "_last"])

    def salted(left: pa.Table, right: pa.Table) -> pa.Table:
        names, first, place = (_joined(right, c) for c in ("_hashes", "_docs", "_places"))
        return answer(*_entries(left)[:3], names, first, place)

    ddl = "_block int, _hashes binary, _docs binary, _places binary, _last binary"
    entries = written(entries, "entries")
    cold, few = entries.where("_salt = 0"), entries.where("_salt > 0")
    by_salt = few.groupBy("_block", "_salt").applyInArrow(lambda t: summary(t, False), ddl)
    merged = written(by_salt.groupBy("_block").applyInArrow(lambda t: summary(t, True), ddl), "phrases")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hot phrase goes to the groups that have entries of it, and to no others."""
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                found = [_joined(t, c) for c in ("_hashes", "_docs", "_places")]
                salts = hot.salts_of(found[0])
                for k in range(1, int(salts.max(initial=0)) + 1):
                    packed = [pa.array([x[salts >= k].tobytes()], pa.binary()) for x in found]
                    yield pa.RecordBatch.from_arrays([t.column("_block").combine_chunks(), pa.array([k], pa.int32()), *packed], names=["_block", "_salt", "_hashes", "_docs", "_places"])

    spread = merged.mapInArrow(copies, "_block int, _salt int, _hashes binary, _docs binary, _places binary")
    hot_told = few.groupBy("_block", "_salt").cogroup(spread.groupBy("_block", "_salt")).applyInArrow(salted, _TOLD)
    return cold.groupBy("_block").applyInArrow(whole_block, _TOLD).unionByName(hot_told)


def _per_doc(found: pa.Table) -> dict[str, np.ndarray]:
    """Entries of a shelf, in order of (document, hash)."""
    columns = {c: x for c in ("_docs", "_hashes", "_sources", "_places") if len(x := _joined(found, c)) or c in ("_docs", "_hashes")}
    order = np.lexsort((columns["_hashes"], columns["_docs"]))
    return {c: x[order] for c, x in columns.items()}


def _looked_up(ids: np.ndarray, hashes: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
    """The entry of each (id, hash) among those found, -1 if there is none; every id
    stands in one run."""
    out = np.full(len(ids), -1, np.int64)
    docs, known = found["_docs"], found["_hashes"]
    if len(ids) and len(docs):
        cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        lows, highs = np.searchsorted(docs, ids[cuts]), np.searchsorted(docs, ids[cuts], side="right")
        for a, b, low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], lows.tolist(), highs.tolist()):
            if high > low:
                at = np.minimum(np.searchsorted(known[low:high], hashes[a:b]), high - low - 1) + low
                out[a:b] = np.where(known[at] == hashes[a:b], at, -1)
    return out


#: A sample of documents holds about so many of a phrase that is just hot.
SAMPLED = 2000
#: Hot phrases at most, those in most documents first; a phrase beyond them is as right, but not spread.
MAX_HOT = 1_000_000


def hot_phrases(texts: DataFrame, window: int, anchor: int, docs_per_salt: int) -> Hot:
    """Hashes of anchors and windows that about ``docs_per_salt`` documents or more hold, with
    a group for each so many documents."""
    one_in = max(1, docs_per_salt // SAMPLED)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            for part in small_tables(t, "_text"):
                w = Windows(part.column("_text"), window, anchor)
                rows = np.concatenate([w.doc[w.valid]] * 2)
                pairs = np.unique(np.rec.fromarrays([rows, np.concatenate([w.anchors(), w.phrases()])], names="row,phrase"))
                yield pa.RecordBatch.from_arrays([pa.array(pairs["phrase"].astype(np.int64))], names=["phrase"])

    sampled = texts.where(F.pmod(F.xxhash64("_text", "_doc", F.lit(1)), F.lit(one_in)) == 0).select("_text")
    enough = docs_per_salt // one_in // (2 if one_in > 1 else 1)  # a sample may have fewer than its share
    counted = sampled.mapInArrow(found, "phrase long").groupBy("phrase").count().where(F.col("count") > enough)
    rows = counted.orderBy(F.desc("count")).limit(MAX_HOT).toArrow()
    names, counts = rows.column("phrase").to_numpy().astype(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(names)
    return Hot(names[order], (1 + counts * one_in // docs_per_salt)[order].astype(np.int64))


def greedy_factors(held: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """The parse of one document: ``held`` are the places of its windows that have a
    source, in order. Gives the factors (start, length, source, place there), and which
    windows are none of a factor's and so cross the end of one."""
    n = len(held)
    goes_on = (held[1:] == held[:-1] + 1) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
    run_ends = np.append(np.flatnonzero(~goes_on), n - 1)
    crossing = np.ones(n, bool)
    factors, k = [], 0
    while k < n:
        last = int(run_ends[np.searchsorted(run_ends, k)])
        start, end = int(held[k]), int(held[last]) + window
        factors.append((start, end - start, int(source[k]), int(place[k])))
        crossing[k : last + 1] = False
        k = int(np.searchsorted(held, end))
    return factors, crossing


def remove_repeats(
    docs: DataFrame, *, window: int = 13, anchor: int = 6, shelf_bytes: int = 6 << 20, docs_per_salt: int = 4_000_000, carry: tuple[str, ...] = (), raw: bool = False, factors: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each document, ``kept`` being the words
    that stay, joined by one space; with ``raw`` a text that loses nothing stays as it
    was. ``carry`` names further columns to keep, which travel with the text as one struct
    column ``carried``. ``factors`` adds the document's factors: the start and the length
    in words, the source and the place there."""
    spark = docs.sparkSession
    small_batches(spark)
    others = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("boolean")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), others.alias("carried"))
    n_docs, n_bytes = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shelves = _prime(max(parts, 2, n_bytes // shelf_bytes))
    # a block per 16 MB of text: its entries fit a task, and a shelf has few rows for it
    blocks = max(parts, n_bytes // (16 << 20))
    texts = texts.withColumn("_shelf", F.pmod(F.xxhash64("_doc", "_text"), F.lit(shelves)).cast("int"))
    hot = hot_phrases(texts, window, anchor, docs_per_salt) if n_docs > docs_per_salt else Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def entries_of(t: pa.Table, candidates=None) -> Iterator[pa.RecordBatch]:
        hashes, owners, shelf, places = [], [], [], []
        for part in small_tables(t, "_text"):
            w = Windows(part.column("_text"), window, anchor)
            ids, on = (part.column(c).to_numpy()[w.doc[w.valid]] for c in ("_doc", "_shelf"))
            found = w.anchors()
            if candidates is None:
                new = np.ones(len(found), bool)  # neighbouring windows mostly have one anchor
                new[1:] = (found[1:] != found[:-1]) | (np.diff(w.doc[w.valid]) != 0)
            else:
                new = _looked_up(ids, found, candidates) >= 0
                found = w.phrases()
                places.append(w.places()[new])
            hashes.append(found[new])
            owners.append(ids[new])
            shelf.append(on[new])
        if hashes:
            yield _packed(*(np.concatenate(x) for x in (hashes, owners, shelf)), np.concatenate(places) if places else None, blocks, hot)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            yield from entries_of(t)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(entries_of(left, _per_doc(right)))
        give_back()
        fields = [x.split() for x in _PACKED.split(", ")]
        return pa.Table.from_batches(found) if found else pa.table([pa.array([], _ARROW[k]) for _, k in fields], names=[n for n, _ in fields])

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _per_doc(right)
        out: list[list] = [[], [], [], [], []]
        for part in small_tables(left, "_text"):
            w = Windows(part.column("_text"), window, anchor)
            ids = part.column("_doc").to_numpy()
            at = _looked_up(ids[w.doc[w.valid]], w.phrases(), found)
            held, at = w.valid[at >= 0], at[at >= 0]
            edge = np.zeros(len(w.hashes) + 1, np.int64)
            cuts = np.searchsorted(held, w.words)
            parsed: dict[int, list] = {}
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b, base = int(cuts[k]), int(cuts[k + 1]), int(w.words[k])
                parsed[k], crossing = greedy_factors(held[a:b] - base, found["_sources"][at[a:b]], found["_places"][at[a:b]], window)
                starts, lengths = np.array([f[:2] for f in parsed[k]], np.int64).T
                np.add.at(edge, base + starts, 1)
                np.add.at(edge, base + starts + lengths, -1)
                np.add.at(edge, held[a:b][crossing], 1)
                np.add.at(edge, held[a:b][crossing] + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_gone = np.concatenate([[0], np.cumsum(gone)])[w.words]
            octets, texts_of_part = w.octets.tobytes(), part.column("_text")
            for k, doc in enumerate(ids.tolist()):
                a, b = int(w.words[k]), int(w.words[k + 1])
                if n_gone[k + 1] == n_gone[k]:
                    kept = texts_of_part[k].as_py().encode() if raw else b" ".join(octets[w.starts[a] : w.ends[b - 1]].split()) if b > a else b""
                else:
                    stay = np.flatnonzero(~gone[a:b]) + a
                    kept = b" ".join([octets[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist())])
                out[0].append(doc)
                out[1].append(b - a)
                out[2].append(int(n_gone[k + 1] - n_gone[k]))
                out[3].append(kept)
                out[4].append([dict(zip(("start", "length", "source", "source_start"), f)) for f in parsed.get(k, ())] if factors else None)
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "source", "source_start")]))
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()).cast(pa.string()), pa.array(out[4], kind), left.column("carried")]
        give_back()
        return pa.table(columns, names=["_doc", "n_words", "n_removed", "kept", "factors", "carried"])

    longs = [T.StructField(c, T.LongType()) for c in ("_doc", "n_words", "n_removed")]
    schema = T.StructType([*longs, T.StructField("kept", T.StringType()), T.StructField("factors", T.DataType.fromDDL(_FACTORS)), texts.schema["carried"]])
    shared = told(texts.select("_doc", "_text", "_shelf").mapInArrow(anchors, _PACKED), hot, earlier=False)
    candidates = texts.groupBy("_shelf").cogroup(shared.groupBy("_shelf")).applyInArrow(windows, _PACKED)
    held = told(candidates, hot, earlier=True)
    parsed = texts.groupBy("_shelf").cogroup(held.groupBy("_shelf")).applyInArrow(parse, schema)
    more = ["carried"] * bool(carry) + ["factors"] * factors
    return parsed.select(F.when(F.col("_doc") != _LAST, F.col("_doc")).alias("doc_id"), "n_words", "n_removed", "kept", *more)


def kept_digest(kept: str = "kept"):
    return F.sha2(F.col(kept).cast("binary"), 256)
