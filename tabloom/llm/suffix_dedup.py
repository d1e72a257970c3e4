"""Operator 10: removal of long repeats by a run-length index.

A byte is removed if a string of LENGTH bytes covers it that also starts earlier (in a smaller id, or earlier in the same
text). Every such string holds an anchor: the least hashed GRAM of its grams, the leftmost on ties, which depends on the
string alone. So equal strings meet at equal anchors, and what an anchor can decide lies in its context, the bytes that
such strings around it can cover.

1. Anchors are found once and written. Those whose gram occurs once in the corpus are dropped.
2. Of anchors with equal contexts all but the first occurrence are covered whole.
3. Where one gram has several contexts, the first occurrence of each goes to a bucket of bounded size. There contexts are
   cut to what another of their gram could share, those that could share no string are left out, and of equal ones one
   stays. Of the rest a run-length compressed Burrows-Wheeler transform is built, with samples at the run ends: text
   position, its predecessor in suffix order and their common length. Matching statistics are streamed from the samples
   (between two samples the length falls by one and the predecessor advances by one), strings of LENGTH bytes or more in
   common form classes, and all but the first of a class is marked.
4. A gram with more than MOST_CONTEXTS contexts fits no bucket: its strings are told apart by 128 bits of hash, and the
   first of each is found by partial minima, so no task holds such a group.

Counts and minima are partly summed before they are shuffled; keys that hold many rows are joined by a broadcast of
bounded size (heavy_join), so no key's rows meet in one task.

Null texts are empty; texts below LENGTH bytes stay whole. Equal contexts are told by 64 bits each for gram and context.
Rows that repeat an id, or have none, are documents of their own, ordered by a hash of the text, equal ones in any order;
null ids come first. An empty table gives no rows. Texts are anchored CHUNK bytes at a time, whatever their length. Only
the id and text columns are read by repeat_digests(), so other columns cannot clash; names that begin with an underscore
are reserved in remove_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import Memo, discard, heavy_join, release, table, texts, written

LENGTH = 100
GRAM = 32
#: Bytes of contexts in one index, on average.
BUCKET_BYTES = 2 << 20
MOST_CONTEXTS = 16384
#: Bytes of a text that are anchored at once.
CHUNK = 1 << 20

_BACK = LENGTH - GRAM
_M = 0x9E3779B97F4A7C15
_BYTES, _MORE = (np.frombuffer(hashlib.shake_256(name).digest(8 * 256), "<u8") for name in (b"bytes", b"more bytes"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n]


_SPAN = CHUNK + 4 * LENGTH
_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _prefix(b: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Prefix sums of a polynomial hash: the hash of b[i:j] is (out[j] - out[i]) * _DOWN[i]."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(_M, _SPAN + 1), _powers(pow(_M, -1, 1 << 64), _SPAN + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * _UP[: len(b)], out=out[1:])
    return out


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and context hashes of a text's anchors."""
    n = len(raw)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 3
    parts = []
    for core in range(0, n, CHUNK):
        lo, hi = max(0, core - 2 * LENGTH), min(n, core + CHUNK + 2 * LENGTH)
        if hi - lo < LENGTH:
            continue
        b = np.frombuffer(raw, np.uint8, hi - lo, lo)
        sums = _prefix(b)
        m = len(b) - GRAM + 1
        gram = _mixed((sums[GRAM:] - sums[:m]) * _DOWN[:m])
        mask = np.uint64((1 << 21) - 1)
        least = (gram & ~mask) | np.arange(m, dtype=np.uint64)
        width, window = 1, _BACK + 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        at = (least & mask).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[(at + lo >= core) & (at + lo < core + CHUNK)]
        start, end = np.maximum(at - _BACK, 0), np.minimum(at + LENGTH, len(b))
        context = (sums[end] - sums[start]) * _DOWN[start]
        context = _mixed(context ^ _mixed((at - start).astype(np.uint64) * np.uint64(256) + (end - start).astype(np.uint64)))
        parts.append((at + lo, gram[at].view(np.int64), context.view(np.int64)))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def string_hashes(part: bytes) -> np.ndarray:
    """Two hashes of each LENGTH-byte string of a context, 128 bits together."""
    b = np.frombuffer(part, np.uint8)
    n = len(part) - LENGTH + 1
    found = [(sums[LENGTH:] - sums[:n]) * _DOWN[:n] for sums in (_prefix(b), _prefix(b, _MORE))]
    return np.stack(list(map(_mixed, found)), axis=1).view(np.int64)


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order; `left` is how many bytes each has before its context ends, where an end sorts first and ends by place.

    Ranks double in width from eight bytes on; only suffixes that still tie are sorted again. Bytes are those of UTF-8,
    which leaves room for the end below them.
    """
    n, width = len(text), 8
    padded = np.zeros(n + width, np.uint8)
    np.add(text, 1, out=padded[:n])
    key = np.lib.stride_tricks.sliding_window_view(padded, width)[:n].copy().view(">u8").ravel().astype(np.uint64)
    keep = np.array([0, *((~((1 << 8 * (width - k)) - 1)) & ((1 << 64) - 1) for k in range(1, width + 1))], np.uint64)
    key &= keep[np.minimum(left, width)]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    differs = np.ones(n, bool)
    differs[1:] = (ordered[1:] != ordered[:-1]) | (left[order[1:]] < width)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(differs, np.arange(n), 0))
    while True:
        tied = ~differs
        tied[:-1] |= ~differs[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        part = order[at]
        after = np.where(left[part] == width, part - n, rank[np.minimum(part + width, n - 1)])
        key = rank[part] * (2 * n + 2) + (after + n)
        by_key = np.argsort(key)
        part, key = part[by_key], key[by_key]
        heads = np.ones(len(at), bool)
        heads[1:] = key[1:] != key[:-1]
        order[at], differs[at] = part, heads
        rank[part] = np.maximum.accumulate(np.where(heads, at, 0))
        width *= 2


def common_lengths(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from i and j on, `most` at most. words[k] holds the 8 bytes from k on, least first."""
    out = np.zeros(len(i), np.int64)
    alive = np.flatnonzero(most > 0)
    step = 0
    while len(alive):
        x = words[i[alive] + step] ^ words[j[alive] + step]
        out[alive] += np.where(x == 0, 8, (np.log2(np.maximum(x & (~x + np.uint64(1)), np.uint64(1)).astype(np.float64)) // 8).astype(np.int64))
        step += 8
        alive = alive[(x == 0) & (most[alive] > step)]
    return np.minimum(out, most)


class RunIndex:
    """Run-length compressed transform of several texts, with samples at the run ends."""

    def __init__(self, contexts: list[bytes]):
        sizes = np.array([len(c) for c in contexts], np.int64)
        self.n = n = int(sizes.sum())
        self.text = np.frombuffer(b"".join(contexts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.left = np.repeat(self.starts + sizes, sizes) - np.arange(n)
        order = suffix_order(self.text, self.left)
        # The transform: the byte before each suffix; a context's first suffix has an end mark of its own.
        symbol = np.empty(n, np.int64)
        symbol[order > 0] = self.text[order[order > 0] - 1]
        first = np.zeros(n, bool)
        first[self.starts] = True
        symbol[first[order]] = -1 - np.arange(int(first.sum()))
        head = np.ones(n, bool)
        head[1:] = symbol[1:] != symbol[:-1]
        heads = np.flatnonzero(head)
        self.run_symbols, self.run_starts = symbol[heads], heads  # the compressed transform
        # Samples: the suffix at each run's head, the one at the end of the run before, and their common length.
        at, before = order[heads], np.where(heads > 0, order[heads - 1], -1)
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1].copy().view("<u8").ravel()
        most = np.where(before >= 0, np.minimum(self.left[at], self.left[before]), 0)
        length = common_lengths(words, at, np.maximum(before, 0), most)
        by_text = np.argsort(at)
        self.sample_at, self.sample_before, self.sample_length = at[by_text], before[by_text], length[by_text]

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position in text order: bytes in common with the suffix before it in suffix order, and that suffix."""
        place = np.arange(self.n)
        s = np.searchsorted(self.sample_at, place, "right") - 1
        gone = place - self.sample_at[s]
        return np.maximum(self.sample_length[s] - gone, 0), self.sample_before[s] + gone


#: Bytes beside the gram at which contexts are compared before they are indexed; two that share a string share the last on one side.
_LEVELS = (4, 8, 17, _BACK // 2)


def shared_reach(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes left and right of its gram a context could have in common with another of that gram, from above."""
    reach = []
    for right in (False, True):
        edge = starts + at + GRAM if right else starts + at
        room = sizes - at - GRAM if right else at
        least = np.full(len(starts), _LEVELS[0] - 1)
        for k, level in enumerate(_LEVELS):
            rows = np.flatnonzero(room >= level)
            if not len(rows):
                break
            side = text[(edge[rows] - (0 if right else level))[:, None] + np.arange(level)]
            key = np.concatenate([gram[rows].astype("<i8").view(np.uint8).reshape(-1, 8), side], axis=1)
            _, group, count = np.unique(np.ascontiguousarray(key).view(f"V{8 + level}").ravel(), return_inverse=True, return_counts=True)
            shared = rows[count[group] > 1]
            if not len(shared):
                break
            least[shared] = _LEVELS[k + 1] - 1 if k + 1 < len(_LEVELS) else _BACK
        reach.append(np.minimum(least, room))
    return reach[0], reach[1]


def later_strings(contexts: list[bytes], order_key: np.ndarray, at: np.ndarray, gram: np.ndarray) -> list[np.ndarray]:
    """For each context, the starts of its LENGTH-byte strings around the gram at `at` that also occur at a smaller key.

    order_key is that of each context's first byte, ascending; keys of its further bytes follow one by one. Contexts are
    first cut to what another of their gram could share; of equal ones only the first is indexed.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    left, right = shared_reach(np.frombuffer(b"".join(contexts), np.uint8), starts, sizes, at, gram)
    lo, hi = at - left, at + GRAM + right
    out = [np.empty(0, np.int64)] * len(contexts)
    firsts: dict[tuple[int, bytes], int] = {}
    for k in np.flatnonzero(hi - lo >= LENGTH).tolist():
        if firsts.setdefault((int(gram[k]), contexts[k][lo[k] : hi[k]]), k) != k:
            out[k] = np.arange(lo[k], hi[k] - LENGTH + 1)
    if len(firsts) > 1:
        rows = np.array(list(firsts.values()))
        for k, found in zip(rows.tolist(), indexed_strings([part for _, part in firsts], (order_key + lo)[rows]), strict=True):
            out[k] = found + lo[k]
    return out


def indexed_strings(contexts: list[bytes], order_key: np.ndarray) -> list[np.ndarray]:
    """What later_strings() gives, by the index of whole contexts."""
    index = RunIndex(contexts)
    length, before = index.matching_statistics()
    whole = index.left >= LENGTH
    # Classes: chains of predecessors that share LENGTH bytes, followed to their end by doubling.
    root = np.where(whole & (length >= LENGTH), before, np.arange(index.n))
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    sizes = np.diff(np.append(index.starts, index.n))
    key = np.repeat(order_key - index.starts, sizes) + np.arange(index.n)
    least = np.full(index.n, np.iinfo(np.int64).max)
    at = np.flatnonzero(whole)
    np.minimum.at(least, root[at], key[at])
    marked = at[key[at] > least[root[at]]]
    cut = np.searchsorted(marked, index.starts[1:]) if len(index.starts) > 1 else []
    return [m - s for m, s in zip(np.split(marked, cut), index.starts, strict=True)]


def intervals(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Unions of [s, s + length) over sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    firsts = np.concatenate([[0], cut])
    lasts = np.concatenate([cut, [len(starts)]]) - 1
    return [(int(starts[a]), int(starts[b]) + length) for a, b in zip(firsts, lasts, strict=True)]


def _keyed(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """(_d, id, text, others): _d is the id where ids tell rows apart, else a number in the order of (id, text hash), nulls first.

    The numbers come from a sort into ranges, which splits a hot id by its texts and equal rows at random; they are
    written, so that they stay what they are.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("_d"), *dict.fromkeys([id_col, text_col, *others]))
    if plain.groupBy("_d").count().where("count > 1 or _d is null").isEmpty():
        return plain
    order = [F.col("_d").asc_nulls_first(), F.xxhash64(text_col), F.col("_salt")]
    ranged = plain.withColumn("_salt", F.rand(0)).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn("_d", F.monotonically_increasing_id()).drop("_salt"), "numbered")


def _anchored(keyed: DataFrame, text_col: str) -> DataFrame:
    names = ["h", "context", "d", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            ids = b.column(0).to_numpy()
            found = [(k, a) for k, t in enumerate(texts(b, text_col)) if len((a := anchors(t.encode()))[0])]
            if found:
                at = np.repeat([k for k, _ in found], [len(a[0]) for _, a in found])
                columns = [np.concatenate([a[1] for _, a in found]), np.concatenate([a[2] for _, a in found]), ids[at], np.concatenate([a[0] for _, a in found])]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)

    return keyed.select("_d", text_col).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _contexts(keyed: DataFrame, edges: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(bucket, h, two, d, pos, at, bytes): contexts by bucket; in bucket -1 the strings of grams with too many contexts, by 128 bits of hash (h, two)."""
    places = edges.groupBy("d").agg(F.collect_list(F.struct("pos", "h", "hot")).alias("_places"))
    joined = keyed.select("_d", text_col).join(places, F.col("_d") == F.col("d")).select("_d", text_col, "_places")
    names = ["bucket", "h", "two", "d", "pos", "at", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            rows = []
            for d, text, places in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode()
                for p in places:
                    at = min(p["pos"], _BACK)
                    lo = p["pos"] - at
                    part = raw[lo : p["pos"] + LENGTH]
                    if not p["hot"]:
                        rows.append((p["h"] % buckets, p["h"], 0, d, lo, at, part))
                    else:
                        rows += [(-1, one, two, d, lo + k, 0, None) for k, (one, two) in enumerate(string_hashes(part).tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)], names)

    return joined.mapInArrow(run, ", ".join(f"{n} bigint" for n in names[:-1]) + ", bytes binary")


def _indexed(contexts: DataFrame) -> DataFrame:
    """(d, pos, size): covered stretches that the buckets' indexes find."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        Memo.keep()
        pdf = pdf.sort_values(["d", "pos"], kind="stable")
        rank = (pdf["d"].diff().fillna(0) != 0).cumsum().to_numpy(np.int64)
        key = (rank << 40) | pdf["pos"].to_numpy(np.int64)
        out = []
        found = later_strings(list(pdf["bytes"]), key, pdf["at"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64))
        for d, pos, starts in zip(pdf["d"], pdf["pos"], found, strict=True):
            out += [(d, pos + s, e - s) for s, e in intervals(starts)]
        return pd.DataFrame(out, columns=["d", "pos", "size"]).astype("int64")

    return contexts.select("bucket", "h", "d", "pos", "at", "bytes").groupBy("bucket").applyInPandas(run, "d bigint, pos bigint, size bigint")


def _not_first() -> F.Column:
    return (F.col("d") != F.col("first.d")) | (F.col("pos") != F.col("first.pos"))


def repeat_marks(keyed: DataFrame, text_col: str = "text") -> DataFrame:
    """(d, marks array<struct<pos, size>>): covered stretches of every text that has any. A size of 0 is a whole context around pos."""
    spark = keyed.sparkSession
    anchored = written(_anchored(keyed, text_col), "anchors")
    repeated = written(anchored.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    release(spark)
    again = written(heavy_join(anchored, repeated, ["h"], "n", anchored.count()).select("h", "context", "d", "pos"), "repeated")
    for gone in (anchored, repeated):
        discard(gone)
    release(spark)
    first = written(again.groupBy("h", "context").agg(F.min(F.struct("d", "pos")).alias("first"), F.count("*").alias("n")), "firsts")
    later = heavy_join(again, first.where("n > 1"), ["h", "context"], "n", again.count()).where(_not_first())
    inside = written(later.select("d", "pos", F.lit(0).cast("bigint").alias("size")), "inside")
    several = written(first.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "several")
    edges = heavy_join(first, several, ["h"], "k", first.count()).select("h", "first.d", "first.pos", (F.col("k") > MOST_CONTEXTS).alias("hot"))
    edges = written(edges, "edges")
    for gone in (again, first, several):
        discard(gone)
    release(spark)
    buckets = max(1, edges.count() * (_BACK + LENGTH) // BUCKET_BYTES)
    marks = inside.union(_indexed(_contexts(keyed, edges.where("not hot"), text_col, buckets)))
    hot = edges.where("hot")
    if not hot.isEmpty():
        strings = written(_contexts(keyed, hot, text_col, buckets).select("h", "two", "d", "pos"), "strings")
        earliest = written(strings.groupBy("h", "two").agg(F.min(F.struct("d", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"), "earliest")
        met = heavy_join(strings, earliest, ["h", "two"], "n", strings.count()).where(_not_first())
        marks = marks.union(met.select("d", "pos", F.lit(LENGTH).cast("bigint").alias("size")))
    out = written(marks.groupBy("d").agg(F.collect_list(F.struct("pos", "size")).alias("marks")), "marks")
    for gone in (inside, edges):
        discard(gone)
    release(spark)
    return out


def covered(n: int, marks: list[dict] | None) -> np.ndarray:
    """Which of a text's bytes the marks cover."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks or ():
        lo, hi = (m["pos"], m["pos"] + m["size"]) if m["size"] else (max(0, m["pos"] - _BACK), min(n, m["pos"] + LENGTH))
        edge[lo] += 1
        edge[hi] -= 1
    return np.cumsum(edge[:n]) > 0


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    keyed = _keyed(docs, id_col, text_col, [])
    marks = repeat_marks(keyed, text_col)
    joined = keyed.join(marks, F.col("_d") == F.col("d"), "left").select(id_col, text_col, "marks")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            rows = []
            for text, marks in zip(texts(b, text_col), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                gone = covered(len(raw), marks) if marks else np.zeros(0, bool)
                removed = int(gone.sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if removed else raw
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if removed else 0
                rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            if rows:
                columns = zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in columns)], names)

    return joined.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", id_col)


def whole_characters(text: str, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes are gone."""
    raw = np.frombuffer(text.encode(), np.uint8)
    first = (raw & 0xC0) != 0x80
    kept = np.maximum.reduceat((~gone).astype(np.uint8), np.flatnonzero(first)).astype(bool)
    return np.frombuffer(text.encode("utf-32-le"), "<u4")[kept].tobytes().decode("utf-32-le")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, the text without its repeats (whole characters only), and its length where such a column is named."""
    keyed = _keyed(docs, id_col, text_col, docs.columns)
    marks = repeat_marks(keyed, text_col).select(F.col("d").alias("_mark_d"), F.col("marks").alias("_marks"))
    joined = keyed.join(marks, F.col("_d") == F.col("_mark_d"), "left")
    place = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            columns = list(b.columns[:-1])
            found = [whole_characters(t, covered(len(t.encode()), m)) if t and m else t for t, m in zip(columns[place].to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns[place] = pa.array(found, pa.string())
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in found], pa.int64()).cast(b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return joined.select(*docs.columns, "_marks").mapInArrow(run, docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))
