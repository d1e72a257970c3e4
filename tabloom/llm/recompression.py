"""Operator 13: repeated windows of words, found by recompression.

A text is a sequence of words, each named by a hash. Recompression names pairs of a left and a right symbol, then maximal
runs of one symbol; to which side a symbol belongs follows from its name. A name depends on the words below it alone, so
a round needs no exchange between texts, and equal stretches get equal symbols but for a few at their ends. With each
symbol goes the stretch of words that decided on it (its reach): wherever those words stand, the symbol stands, too.

1. Every window of WINDOW words is revealed by what recompression makes of it: a run of three symbols or more whose reach
   lies inside it, else the block of three neighbouring symbols of least name, else a smaller one. As that depends on the
   window alone, equal windows share it, at the same place in them.
2. Spark names these over the whole corpus: by name, the least and the greatest document. Names of one document go. What
   remains is told apart by its context, the words that windows around it can cover. Of a context that several documents
   hold, all but the first have every window repeated.
3. Where one name has several contexts, those are kept that share half of what a window adds to the symbol with another,
   on its left or on its right, as any two with a window in common do. Of these the first text gives the windows on that
   side, and each window is recompressed alone and named; the least document of a name decides. A context's repeated
   windows are one mask of bits.

Counts and minima are partly made before they are shuffled, and names that hold many rows are joined by a broadcast of
bounded size (heavy_join), so no name's rows meet in one task. Only shared names are shuffled a second time.

A window is repeated if a document with a smaller id holds it, in any place; repeats inside one document do not count,
nor do those of rows that repeat an id. A null id is smaller than all others. Null texts have no words; texts below
WINDOW words stay whole. Names have 64 bits, and two texts are alike by a symbol's and a context's or window's name, 128
bits. An empty table gives no rows. Texts are recompressed CHUNK words at a time, whatever their length. Only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import Memo, discard, heavy_join, release, table, written

#: Words of a window; neighbouring symbols of a block, and repeats of a run, that reveal it.
WINDOW, BLOCK = 13, 3
#: Words that are recompressed at once: of one long text, and of several short ones together.
CHUNK = 1 << 16
#: Rounds in which a window is recompressed alone, before what is left is named in one step.
ALONE = 4

_RUN, _PAIR, _LEFT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x165667B19E3779F9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@dataclass
class Symbols:
    """A level of several texts: names, the words [start, end) below each, and its reach [lo, hi). Texts stand between borders, which join nothing."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    border: np.ndarray
    repeats: np.ndarray | None = None  # of the symbol below, where runs were named

    @classmethod
    def of(cls, names: np.ndarray, border: np.ndarray) -> Symbols:
        at = np.arange(len(names), dtype=np.int32)
        return cls(names, at, at + 1, at, at + 1, border)

    def runs(self) -> Symbols:
        """Names runs of one symbol. That a run ends is known from both its neighbours."""
        head = np.ones(len(self.name), bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | self.border[1:] | self.border[:-1]
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(head)) - 1
        size = (last - at + 1).astype(np.uint64)
        name = self.name[at]
        name = np.where(size > 1, _mixed(name ^ (size * _RUN)), name)
        return Symbols(name, self.start[at], self.end[last], self.lo[np.maximum(at - 1, 0)], self.hi[np.minimum(last + 1, len(head) - 1)], self.border[at], size)

    def pairs(self, turn: int) -> Symbols:
        """Names pairs of a left and a right symbol. That a symbol stays alone is known from the neighbour that it could have joined."""
        left = (_mixed(self.name + np.uint64(turn + 1) * _LEFT) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(left), bool)
        joins[:-1] = left[:-1] & ~left[1:] & ~self.border[:-1] & ~self.border[1:]
        stays = np.ones(len(left), bool)
        stays[1:] = ~joins[:-1]
        at = np.flatnonzero(stays)
        two = joins[at]
        after = np.minimum(at + 1, len(left) - 1)
        name = np.where(two, _mixed(self.name[at] * _PAIR + self.name[after]), self.name[at])
        on_left = left[at]
        return Symbols(
            name, self.start[at], self.end[np.where(two, after, at)], self.lo[np.where(on_left, at, np.maximum(at - 1, 0))], self.hi[np.where(on_left, after, at)], self.border[at],
        )

    def blocks(self, size: int) -> Symbols:
        """Names all stretches of so many neighbours."""
        n = max(0, len(self.name) - size + 1)
        name = self.name[:n]
        for k in range(1, size):
            name = _mixed(name * _PAIR + self.name[k : n + k])
        last = slice(size - 1, size - 1 + n)
        return Symbols(name, self.start[:n], self.end[last], self.lo[:n], self.hi[last], self.border[:n])

    def where(self, some: np.ndarray) -> Symbols:
        return Symbols(*(x[some] for x in (self.name, self.start, self.end, self.lo, self.hi, self.border)))


def _greatest(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The greatest of values[first : last + 1] for several ranges, none longer than 16."""
    tables = [values]
    for k in range(4):
        width = 1 << k
        above = tables[-1]
        tables.append(np.concatenate([np.maximum(above[:-width], above[width:]), above[-width:]]) if len(above) > width else above)
    size = last - first + 1
    level = (size >= 2).astype(np.int8) + (size >= 4) + (size >= 8) + (size >= 16)
    out = np.empty(len(first), values.dtype)
    for k in range(5):
        of = np.flatnonzero(level == k)
        if len(of):
            out[of] = np.maximum(tables[k][first[of]], tables[k][last[of] - (1 << k) + 1])
    return out


def revealing(names: np.ndarray, border: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(start of window, name, start, end, lo, hi) of what reveals each window without a border.

    Runs come before blocks, larger blocks before smaller ones and these before words; of equals the least by bits of its
    name, then the first.
    """
    n = len(names)
    words = Symbols.of(names, border)
    joined = words.pairs(0)
    runs = joined.runs()
    levels = [words, *(joined.blocks(k + 1) for k in range(BLOCK)), runs.where((runs.repeats >= BLOCK) & (runs.end - runs.start <= window))]
    whole = np.concatenate([[0], np.cumsum(border)])
    starts = np.flatnonzero(whole[window:] == whole[:-window]) if n >= window else np.empty(0, np.int64)
    rank = np.zeros(len(starts), np.uint64)
    place = 0
    for k, level in enumerate(levels):
        spot = np.uint64((1 << 24) - 1 - place) - np.arange(len(level.name), dtype=np.uint64)
        own = (np.uint64(k) << np.uint64(60)) | ((_mixed(level.name) >> np.uint64(28)) << np.uint64(24)) | spot
        if k:  # what is before the first and up to the last symbol whose reach lies in a window
            first = np.concatenate([[0], np.cumsum(np.bincount(level.lo, minlength=n))])[starts]
            last = np.cumsum(np.bincount(level.hi, minlength=n + 1))[starts + window] - 1
            found = np.flatnonzero(first <= last)
        else:
            first, last, found = starts, starts + window - 1, np.arange(len(starts))
        if len(found):
            rank[found] = np.maximum(rank[found], _greatest(own, first[found], last[found]))
        place += len(level.name)
    at = np.int64((1 << 24) - 1) - (rank & np.uint64((1 << 24) - 1)).astype(np.int64)
    join = lambda part: np.concatenate([getattr(level, part) for level in levels])[at]
    return starts, *map(join, ("name", "start", "end", "lo", "hi"))


def window_names(words: np.ndarray, firsts: np.ndarray, window: int = WINDOW, rounds: int = ALONE) -> np.ndarray:
    """The name of each window of `words` that begins at one of firsts: it is recompressed alone, and what is left after some rounds is named in one step."""
    table = np.zeros((len(firsts), window + 1), np.uint64)  # a border before each window
    table[:, 1:] = words[firsts[:, None] + np.arange(window)]
    border = np.zeros(table.shape, bool)
    border[:, 0] = True
    level = Symbols.of(table.ravel(), border.ravel())
    for turn in range(rounds):
        level = level.pairs(turn).runs()
    heads = np.flatnonzero(level.border)
    size = np.diff(np.append(heads, len(level.name)))
    place = (np.arange(len(level.name)) - np.repeat(heads, size)).astype(np.uint64)
    return _mixed(np.add.reduceat(np.where(level.border, np.uint64(0), _mixed(level.name + place * _PAIR)), heads)) if len(heads) else np.empty(0, np.uint64)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pieces(texts: Iterator[tuple[int, bytes]], window: int) -> Iterator[list[tuple[int, int, int, int, np.ndarray]]]:
    """Groups of (text, first word, core from, core to, word names), a group of about CHUNK words. A long text's pieces overlap, their cores do not."""
    group, held = [], 0
    for k, raw in texts:
        words = raw.split()
        if len(words) < window:
            continue
        for core in range(0, len(words), CHUNK):
            lo, hi = max(0, core - window), min(len(words), core + CHUNK + 2 * window)
            group.append((k, lo, core, core + CHUNK, _hashed(words[lo:hi])))
            held += hi - lo
            if held >= CHUNK:
                yield group
                group, held = [], 0
    if group:
        yield group


def packed(first: np.ndarray, size: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A context's first word, its words, and its symbol's place in it and length, as one number."""
    return (first.astype(np.int64) << 17) | (size.astype(np.int64) << 11) | (offset.astype(np.int64) << 5) | length.astype(np.int64)


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, ...]:
    return pos >> 17, (pos >> 11) & 63, (pos >> 5) & 63, pos & 31


def symbols_of(texts: Iterator[tuple[int, bytes]], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, name, place) of what reveals the windows of some texts; a place is packed()."""
    for group in _pieces(texts, window):
        sizes = np.array([len(g[4]) for g in group])
        begins = np.cumsum(sizes + 1) - sizes  # in the sequence, after a border each
        border = np.zeros(int(sizes.sum()) + len(group) + 1, bool)
        border[begins - 1] = border[-1] = True
        names = np.zeros(len(border), np.uint64)
        names[~border] = np.concatenate([g[4] for g in group])
        starts, name, start, end, lo, hi = revealing(names, border, window)
        piece = np.searchsorted(begins, starts, "right") - 1
        shift = np.array([g[1] for g in group])[piece] - begins[piece]
        word = starts + shift
        core = np.flatnonzero((word >= np.array([g[2] for g in group])[piece]) & (word < np.array([g[3] for g in group])[piece]))
        # A context holds all windows around the symbol; it ends where its piece does, which is beyond reach but at a text's ends.
        left, right = np.maximum(hi - window, begins[piece]), np.minimum(lo + window, (begins + sizes)[piece])
        place = packed(left + shift, right - left, start - left, end - start)[core]
        _, once = np.unique((piece[core] << 46) ^ place, return_index=True)
        at = core[once]
        yield np.array([g[0] for g in group])[piece[at]], name[at].view(np.int64), place[once]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of a number and of its inverse, n or more; those for CHUNK words are kept."""
    if _POWERS and n <= len(_POWERS[0]):
        return _POWERS
    made = [np.cumprod(np.full(max(n, CHUNK), x, np.uint64)) for x in (int(_RUN), pow(int(_RUN), -1, 1 << 64))]
    if n <= CHUNK:
        _POWERS[:] = made
    return made


def contexts_of(words: np.ndarray, places: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(context's name, sides) of places in a text's named words.

    The sides name the symbol with half of the words that a window adds, on its left (upper 32 bits) and on its right; 0 is
    a side that ends before.
    """
    first, size, offset, length = unpacked(places)
    up, down = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(_mixed(words) * up[: len(words)], out=sums[1:])
    stretch = lambda i, j: (sums[j] - sums[i]) * down[i]
    half, begin = (window - length + 1) // 2, first + offset
    end = begin + length

    def side(there: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        named = _mixed(stretch(np.where(there, i, 0), np.where(there, j, 0))) >> np.uint64(32)
        return np.where(there, np.maximum(named, np.uint64(1)), np.uint64(0))

    sides = (side(begin - half >= first, begin - half, end) << np.uint64(32)) | side(end + half <= first + size, begin, end + half)
    context = _mixed(stretch(first, first + size) ^ _mixed((places & ((1 << 17) - 1)).astype(np.uint64) + np.uint64(1)))
    return context.view(np.int64), sides.view(np.int64)


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    return ((k, t or b"") for k, t in enumerate(batch.column(column).cast(pa.binary()).to_pylist()))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_d, _o, id, text): _o orders documents, nulls first; _d tells rows apart and is the same where ids do, else a number that is written."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("_o"), *dict.fromkeys([id_col, text_col]))
    if plain.groupBy("_o").count().where("count > 1").isEmpty():
        return plain.withColumn("_d", F.col("_o"))
    return written(plain.withColumn("_d", F.monotonically_increasing_id()), "numbered")


def _symbols(keyed: DataFrame, text_col: str, window: int) -> DataFrame:
    """(name, d, o, pos)."""
    names = ["name", "d", "o", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            d, o = (b.column(k).to_numpy() for k in (0, 1))
            for text, name, pos in symbols_of(_rows(b, 2), window):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name, d[text], o[text], pos)], names)

    return keyed.select("_d", "_o", text_col).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _batch(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names)


def _contexts(keyed: DataFrame, places: DataFrame, text_col: str, window: int) -> DataFrame:
    """(name, context, d, o, pos, sides) of the places (name, d, pos)."""
    by = places.groupBy("d").agg(F.collect_list(F.struct("name", "pos")).alias("_places"))
    joined = keyed.select("_d", "_o", text_col).join(by, F.col("_d") == F.col("d")).select("_d", "_o", text_col, "_places")
    names = ["name", "context", "d", "o", "pos", "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            d, o, of = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            ends = of.offsets.to_numpy()
            name, pos = (of.values.field(c).to_numpy() for c in ("name", "pos"))
            held, found = 0, []
            for k, raw in _rows(b, 2):
                some = slice(ends[k], ends[k + 1])
                context, sides = contexts_of(_hashed(raw.split()), pos[some], window)
                n = len(context)
                found.append((name[some], context, np.full(n, d[k]), np.full(n, o[k]), pos[some], sides))
                held += n
                if held >= CHUNK:
                    yield _batch(found, names)
                    held, found = 0, []
            if found:
                yield _batch(found, names)

    return joined.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


#: Sides of a symbol on which its context shares half a window.
_LEFT_HALF, _RIGHT_HALF = 1, 2


def _halves(contexts: DataFrame) -> DataFrame:
    """(name, context, d, pos) of contexts that share a side with another one, one of them in a greater document, and which sides they share (halves)."""
    low = F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))
    cells = [F.struct(F.shiftrightunsigned("sides", 32).alias("side"), F.lit(_LEFT_HALF).alias("half")), F.struct(low.alias("side"), F.lit(_RIGHT_HALF).alias("half"))]
    sided = written(contexts.select("name", "context", "own", "last", "d", "pos", F.inline(F.array(*cells))).where("side != 0"), "sided")
    met = sided.groupBy("name", "side", "half").agg(F.min("own").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("n"))
    met = written(met.where("n > 1 and lo < hi").select("name", "side", "half", "n"), "halves")
    release(contexts.sparkSession)
    both = heavy_join(sided, met, ["name", "side", "half"], "n", sided.count())
    out = written(both.groupBy("name", "context", "d", "pos").agg(F.bit_or("half").alias("halves")), "candidates")
    for gone in (sided, met):
        discard(gone)
    return out


def _windows(keyed: DataFrame, contexts: DataFrame, text_col: str, window: int) -> DataFrame:
    """(name, context, window, o, at): the named windows of contexts that have a shared half in them, and their place in the context."""
    places = contexts.groupBy("d").agg(F.collect_list(F.struct("name", "context", "pos", "halves")).alias("_places"))
    joined = keyed.select("_d", "_o", text_col).join(places, F.col("_d") == F.col("d")).select("_o", text_col, "_places")
    names = ["name", "context", "window", "o", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            held, found = 0, []
            own, of = b.column(0).to_numpy(), b.column(2)
            ends = of.offsets.to_numpy()
            columns = [of.values.field(c).to_numpy() for c in ("name", "context", "pos", "halves")]
            for k, raw in _rows(b, 1):
                words = _hashed(raw.split())
                name, context, pos, halves = (c[ends[k] : ends[k + 1]] for c in columns)
                first, size, offset, length = unpacked(pos)
                count = size - window + 1
                row = np.repeat(np.arange(len(pos)), count)
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                before, half = (offset[row] - at), ((window - length + 1) // 2)[row]
                asked = ((halves[row] & _LEFT_HALF > 0) & (before >= half)) | ((halves[row] & _RIGHT_HALF > 0) & (window - length[row] - before >= half))
                row, at = row[asked], at[asked]
                for part in range(0, len(row), CHUNK):
                    some = row[part : part + CHUNK]
                    where = first[some] + at[part : part + CHUNK]
                    found.append((name[some], context[some], words[where[:, None] + np.arange(window)], np.full(len(some), own[k]), at[part : part + CHUNK]))
                    held += len(some)
                    if held >= CHUNK:
                        yield _named(found, names, window)
                        held, found = 0, []
            if found:
                yield _named(found, names, window)

    return joined.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _named(found: list[tuple[np.ndarray, ...]], names: list[str], window: int) -> pa.RecordBatch:
    name, context, words, o, at = map(np.concatenate, zip(*found, strict=True))
    made = window_names(words.ravel(), np.arange(len(words)) * window, window).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (name, context, made, o, at)], names)


#: The mask of a context that is repeated as a whole.
_WHOLE = -1


def window_marks(keyed: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(d, marks array<struct<pos, mask>>): contexts with repeated windows, of every text that has any; bit k of a mask is the k-th window."""
    spark = keyed.sparkSession
    found = written(_symbols(keyed, text_col, window), "symbols")
    named = written(found.groupBy("name").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("name", "n"), "names")
    release(spark)
    places = written(heavy_join(found, named, ["name"], "n", found.count()).select("name", "d", "pos"), "places")
    for gone in (found, named):
        discard(gone)
    release(spark)
    shared = written(_contexts(keyed, places, text_col, window), "shared")
    discard(places)
    release(spark)
    first = written(shared.groupBy("name", "context").agg(F.min(F.struct("o", "d", "pos")).alias("first"), F.max("o").alias("last"), F.first("sides").alias("sides"), F.count("*").alias("n")), "contexts")
    several = written(first.groupBy("name").agg(F.count("*").alias("k")).where("k > 1"), "several")
    told = heavy_join(first, several, ["name"], "k", first.count()).select("name", "context", F.col("first.o").alias("own"), "last", "first.d", "first.pos", "sides")
    candidates = _halves(told)
    release(spark)
    windows = written(_windows(keyed, candidates, text_col, window), "windows")
    release(spark)
    least = written(windows.groupBy("name", "window").agg(F.min("o").alias("least"), F.max("o").alias("last"), F.count("*").alias("n")).where("least < last"), "least")
    met = heavy_join(windows, least.drop("last"), ["name", "window"], "n", windows.count()).where("o > least")
    masks = written(met.groupBy("name", "context").agg(F.bit_or(F.expr("shiftleft(1L, cast(at as int))")).alias("mask")), "masks")
    of = first.select("name", "context", F.col("first.o").alias("own"), "last", "n").join(masks, ["name", "context"], "left").where("own < last or mask is not null")
    of = written(of.drop("last"), "repeated")
    marked = heavy_join(shared, of, ["name", "context"], "n", shared.count()).where("o > own or mask is not null")
    marks = marked.select("d", F.struct("pos", F.when(F.col("o") > F.col("own"), F.lit(_WHOLE)).otherwise(F.col("mask")).cast("bigint").alias("mask")).alias("mark"))
    out = written(marks.groupBy("d").agg(F.collect_list("mark").alias("marks")), "marks")
    for gone in (shared, first, several, candidates, windows, least, masks, of):
        discard(gone)
    release(spark)
    return out


def removed(n: int, pos: np.ndarray, mask: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of a text's n words the marks cover."""
    first, size, _, _ = unpacked(pos)
    whole = mask == _WHOLE
    begins, sizes = first[whole], size[whole]
    if not whole.all():
        row, bit = np.nonzero((mask[~whole, None] >> np.arange(window)) & 1)
        begins, sizes = np.concatenate([begins, first[~whole][row] + bit]), np.concatenate([sizes, np.full(len(row), window)])
    edge = np.bincount(begins, minlength=n + 1) - np.bincount(begins + sizes, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: kept is the text of its other words, joined by a space. A window has 2 to 30 words."""
    if not 2 <= window <= 30:
        raise ValueError("a window has 2 to 30 words")
    keyed = _keyed(docs, id_col, text_col)
    marks = window_marks(keyed, text_col, window)
    joined = keyed.join(marks, F.col("_d") == F.col("d"), "left").select(id_col, text_col, "marks")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], []]
            ends = b.column(2).offsets.to_numpy()
            pos, mask = (b.column(2).values.field(c).to_numpy() for c in ("pos", "mask"))
            for k, raw in _rows(b, 1):
                words, n = raw.split(), 0
                total = len(words)
                if ends[k] < ends[k + 1]:
                    gone = removed(total, pos[ends[k] : ends[k + 1]], mask[ends[k] : ends[k + 1]], window)
                    n = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for column, value in zip(rows, (total, n, b" ".join(words)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what repeated_words() keeps."""
    return repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows by comparing every window's words.
ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as w from documents),
p as (select doc_id, unnest(range(len(w) - 12)) as k, w from d where len(w) > 12),
x as (select doc_id, k, md5(array_to_string(w[k + 1:k + 13], ' ')) as h from p),
f as (select h, min(doc_id) as first from x group by h),
g as (select doc_id, list(distinct k + t) as gone from x join f using (h), range(13) r(t) where first < doc_id group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(len(w)), lambda i: not list_contains(gone, i)), lambda i: w[i + 1]) end, ' ')) as kept_sha256
from d left join g using (doc_id)"""
