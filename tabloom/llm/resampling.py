"""Operator 11: importance resampling towards a target distribution, over hashed n-grams.

Words are lower-cased for A-Z and are runs of digits, letters and all beyond ASCII. A feature is a run of 1 to `order`
words joined by one space, its bucket the CRC-32 of its bytes modulo `buckets`. A bucket's gain says how much likelier it
is in the target than in the corpus; a document's weight is the sum of its features' gains. Of the documents with enough
words, those of the highest weight plus Gumbel noise are drawn, which samples without replacement by importance.

The vocabulary is cut in head and tail. Every task keeps a summary of bounded size of its words (and pairs), from which
those with over one in HEAD of all occurrences are found: summaries count too low, never too high, so fewer than HEAD of
each can be. The head goes to all workers: a word with its exact CRC state, which extends to longer features, and a pair
with its bucket. A tail feature takes its CRC directly, so bucket totals are exact whatever the head holds. Totals are
`buckets` numbers a task. Drawn rows are ranked in ranges of the whole order; no task holds them all.

Null texts have no words, null and wordless texts weigh 0. Rows that repeat an id are documents of their own with the
same noise; equal rows tie in any order. A null id counts as the empty text in the noise and comes last in ties. An empty
corpus or target counts as 0 everywhere; an empty corpus gives no rows. Texts of any length are taken WORDS words at a
time. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table, written
from tabloom.operators.order import global_row_number

#: Words, and pairs, of the head at most: each holds more than this share of all occurrences. Also the entries of a task's summary.
HEAD = 20_000
#: Longest head entry, in bytes, which bounds what is broadcast.
HEAD_BYTES = 64
#: Words of a text that are counted at once.
WORDS = 1 << 16

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_LETTERS).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t or b"" for t in column.cast(pa.binary()).to_pylist())


def _stretches(words: list[bytes], order: int) -> Iterator[tuple[list[bytes], int]]:
    """A text's words, WORDS at a time, with up to order - 1 words before them, whose number is told."""
    for at in range(0, len(words), WORDS):
        back = min(at, order - 1)
        yield (words if len(words) <= WORDS else words[at - back : at + WORDS]), back


class Summary:
    """Counts of the frequent ones of many items, in bounded room. A count is too low by at most n / entries, and never too high."""

    def __init__(self, entries: int):
        self.entries, self.counts = entries, Counter()

    def add(self, items: list[bytes]) -> None:
        self.counts.update(items)
        if len(self.counts) > 2 * self.entries:
            self.cut()

    def cut(self) -> None:
        """Takes the count of the first entry that must go from all; those that have no more go."""
        if len(self.counts) > self.entries:
            off = np.partition(np.fromiter(self.counts.values(), np.int64, len(self.counts)), len(self.counts) - self.entries - 1)[len(self.counts) - self.entries - 1]
            self.counts = Counter({k: n - int(off) for k, n in self.counts.items() if n > off})


def head_of(docs: DataFrame, text_col: str = "text", order: int = 1, head: int = HEAD) -> list[bytes]:
    """Frequent words, and pairs where order allows: fewer than `head` of each, of HEAD_BYTES bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, totals = [Summary(head) for _ in range(min(order, 2))], [0, 0]
        for b in batches:
            for raw in _texts(b.column(0)):
                words = words_of(raw)
                totals[0] += len(words)
                totals[1] += max(0, len(words) - 1)
                for part, back in _stretches(words, 2):
                    found[0].add([w for w in (part[back:] if back else part) if len(w) <= HEAD_BYTES])
                    if order > 1:
                        found[1].add([p for p in map(b" ".join, zip(part, part[1:])) if len(p) <= HEAD_BYTES])
        for size, summary in enumerate(found, 1):
            summary.cut()
            keys = [None, *summary.counts]
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array([totals[size - 1], *summary.counts.values()], pa.int64())], ["size", "item", "n"])

    counted = written(docs.select(text_col).mapInArrow(run, "size int, item binary, n bigint").groupBy("size", "item").agg(F.sum("n").alias("n")), "head")
    totals = counted.where("item is null").select("size", F.col("n").alias("total"))  # two rows at most
    return [bytes(r["item"]) for r in counted.where("item is not null").join(F.broadcast(totals), "size").where(F.col("n") * head > F.col("total")).select("item").collect()]


class Buckets:
    """Buckets of a text's features: by the head where it knows them, else by CRC."""

    def __init__(self, head: list[bytes], order: int, buckets: int):
        self.order, self.buckets = order, buckets
        self.states = {w: crc32(w) for w in head if b" " not in w}
        self.singles = {w: s % buckets for w, s in self.states.items()}
        self.pairs = {p: crc32(p) % buckets for p in head if b" " in p}

    def of(self, words: list[bytes], back: int = 0) -> list[int]:
        """Buckets of the features that end after the first `back` words, in any order."""
        buckets, known = self.buckets, self.singles.get
        own = words[back:] if back else words
        out = [crc32(w) % buckets if (k := known(w)) is None else k for w in own]
        if self.order == 1 or len(words) < 2:
            return out
        states, paired = self.states.get, self.pairs.get
        for at in range(len(words) - 1):
            one, two = words[at], words[at + 1]
            state = None
            if at + 1 >= back:
                k = paired(one + b" " + two) if self.pairs else None
                if k is None:
                    if (state := states(one)) is None:
                        state = crc32(one)
                    state = crc32(two, crc32(b" ", state))
                    k = state % buckets
                out.append(k)
            if self.order > 2:
                if state is None:
                    if (state := states(one)) is None:
                        state = crc32(one)
                    state = crc32(two, crc32(b" ", state))
                for further in range(at + 2, min(at + self.order, len(words))):
                    state = crc32(words[further], crc32(b" ", state))
                    if further >= back:
                        out.append(state % buckets)
        return out


def bucket_totals(docs: DataFrame, head: list[bytes], text_col: str = "text", order: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Exact occurrences of all features by bucket: `buckets` numbers, whatever the input's size."""
    shipped = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = Buckets(shipped.value, order, buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for raw in _texts(b.column(0)):
                for part, back in _stretches(words_of(raw), order):
                    total += np.bincount(find.of(part, back), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed ratio of target to corpus, in doubles."""
    buckets, all_s, all_t = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * all_s / ((float(corpus[k]) + 1) * all_t))) for k in range(buckets)], np.int64)


def noise(seed: int, key: object) -> int:
    """floor(1000 * Gumbel noise) from a hash of the seed and an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, head: list[bytes], id_col: str = "doc_id", text_col: str = "text", order: int = 1, seed: int = 2024) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast((head, gain))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, gain = shipped.value
        find = Buckets(entries, order, len(gain))
        for b in batches:
            rows: list[list[int]] = [[], [], [], []]
            for key, raw in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                words, n, weight = words_of(raw), 0, 0
                for part, back in _stretches(words, order):
                    found = find.of(part, back)
                    n += len(found)
                    weight += int(gain[found].sum())
                for column, value in zip(rows, (len(words), n, weight, weight + noise(seed, key)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in rows)], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])).withColumnRenamed("id", id_col)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, head: int = HEAD
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank counts the drawn ones from 1, null elsewhere.

    Drawn are floor(percent * N / 100) of the N rows with least_words words or more.
    """
    vocabulary = head_of(docs, text_col, order, head)
    gain = gains(bucket_totals(docs, vocabulary, text_col, order, buckets), bucket_totals(target, vocabulary, target_col, order, buckets))
    scored = weighted(docs, gain, vocabulary, id_col, text_col, order, seed).withColumn("_salt", F.monotonically_increasing_id())
    scored = written(scored, "weighted")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.where(fit).count() // 100
    numbered = global_row_number(scored.where(fit), -F.col("score"), F.col(id_col).isNull(), F.col(id_col), F.col("_salt"), name="_place")
    ranked = numbered.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    columns = [id_col, "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with recursive poly(i, k, c) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from poly where k < 8),
tab as (select list(c order by i) as tab from poly where k = 8),
w as (select 'd' as part, doc_id as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
  union all select 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
v as (select w, hex(encode(w)) as x from (select distinct w from w)),
b as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::bigint)), lambda c, y: xor(c >> 8, tab[1 + (xor(c, y) & 255)]::bigint)), 4294967295::bigint) % 10000 as bucket from v, tab),
n as (select bucket, count(*) filter (part = 'd') as s, count(*) filter (part = 'b') as t from w join b using (w) group by 1),
a as (select sum(s) + 10000 as ss, sum(t) + 10000 as tt from n),
g as (select bucket, floor(1000 * ln((t + 1)::double * ss::double / ((s + 1)::double * tt::double)))::bigint as gain from n, a),
f as (select id as doc_id, count(*) as n_features, sum(gain)::bigint as weight from w join b using (w) join g using (bucket) where part = 'd' group by 1),
h as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from documents left join f using (doc_id)),
s as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from h),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, floor(10 * count(*) over () / 100) as drawn from s where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= drawn then rank end::bigint as rank from s left join r using (doc_id)"""
