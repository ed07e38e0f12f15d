"""Document and host rules for quality (operator 10), in DataFrame functions only.

Each document gets counts over its whole text; ``base_failed`` is the document rule. A
host's failure rate is shrunk towards all hosts by a beta prior whose two numbers come
from the mean and the variance of the hosts' own rates; a host whose shrunk rate is over
``max_rate`` is rejected with all its documents.

Nulls: a null text has no words and fails; null hosts form one host; a null doc_id is an
ordinary row. Repeated rows count and stay, one row each; a rate that equals ``max_rate``
is kept. Very long texts are counted whole. An empty table gives no rows. Columns of the
input that clash with an output name are not returned by ``judge``; ``keep_good`` returns
its input's columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import row_key, without, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: More hosts than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_HOSTS = 500_000


def _starts_of_repeats(windows: Column) -> Column:
    """Sorted places of the values that an array holds twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows) - 1
    neighbours = F.arrays_zip(F.slice(pairs, 1, n).alias("a"), F.slice(pairs, 2, n).alias("b"))
    same = F.filter(neighbours, lambda z: z["a"]["h"] == z["b"]["h"])
    return F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda z: F.array(z["a"]["i"], z["b"]["i"])))))


def with_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = docs.drop(*names)
    df = kept.withColumn("_hashes", F.transform(F.array_remove(F.split(text, SPACES), ""), lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    each = F.sequence(F.lit(0), n - window)
    df = df.withColumn("_windows", F.when(n >= window, F.transform(each, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(window))))).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_starts", F.when(repeats, _starts_of_repeats(F.col("_windows"))))
    last = F.size("_starts") - 1
    steps = F.arrays_zip(F.slice("_starts", 1, last).alias("a"), F.slice("_starts", 2, last).alias("b"))
    covered = F.aggregate(steps, F.lit(window), lambda acc, z: acc + F.least(F.lit(window), z["b"] - z["a"]))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return (
        df.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"))
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("_starts").isNotNull(), covered).otherwise(0).cast("long"))
        .drop("_hashes", "_windows", "_starts", "_lines")
    )


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)


def host_verdicts(judged: DataFrame, host: str, max_rate: float = 0.5, max_strength: float = 1000.0) -> DataFrame:
    """(host, host_rate, host_ok) from rows with ``base_failed``. The prior's strength
    is the one that the hosts' variance implies, at most ``max_strength``."""
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_n"), F.sum(F.col("base_failed").cast("long")).alias("_bad"))
    hosts = written(hosts, "hosts")
    rate = F.col("_bad") / F.col("_n")
    prior = hosts.agg(F.coalesce(F.avg(rate), F.lit(0.0)).alias("_m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("_v"))
    strength = F.when(F.col("_v") > 0, F.least(F.lit(max_strength), F.greatest(F.lit(0.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1))).otherwise(F.lit(max_strength))
    prior = prior.select("_m", strength.alias("_s"))
    shrunk = (F.col("_bad") + F.col("_m") * F.col("_s")) / (F.col("_n") + F.col("_s"))
    # the prior is one row
    return hosts.join(F.broadcast(prior)).select("_host", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_ok"))


def with_verdict(judged: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """``judged`` with ``kept``; few hosts are broadcast, many are joined by a shuffle
    in which the engine splits a host that holds too many rows."""
    verdicts = written(verdicts, "verdicts")
    hint = "broadcast" if verdicts.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS else "merge"
    joined = judged.drop("kept", "host_rate", "host_ok").join(verdicts.hint(hint), F.col(host).eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("_host", "host_ok", "host_rate")


def judge(docs: DataFrame, *, host: str = "source", max_rate: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of each document, without its text, and
    the columns of ``docs`` that ``carry`` names."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    counted = with_counts(docs.select("doc_id", "text", F.col(host).alias("_source"), *carry)).withColumn("base_failed", base_failed())
    judged = written(counted.select(*names, "_source", *carry), "judged")
    return with_verdict(judged, host_verdicts(judged, "_source", max_rate), "_source").select(*names, "kept", *carry)


def keep_good(docs: DataFrame, *, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows and columns of the documents that are kept, each by its own verdict: rows
    are told by doc_id, text and host. The text is read once for the counts; it is only
    shuffled if very many documents are rejected."""
    judged = judge(docs.withColumn("row", row_key(host)), host=host, max_rate=max_rate, carry=("row",))
    return without(docs, judged.where(~F.col("kept")), host)
