"""Operator 4: MinHash near-dedup by an inverted join over signature coordinates.

A document's set is its distinct five-word shingles. Documents with one set are one node. A node is posted under each
coordinate and value of its signature; any two nodes that agree in at least MATCHES of COORDINATES coordinates share at
least PREFIX - (COORDINATES - MATCHES) of the PREFIX postings of each that are rarest in a fixed order, so only those
postings are merged and frequent ones are skipped. The order is that of a sketch of counts of fixed size.

Merging runs twice. First every node of a posting meets the posting's most central node alone, which joins a large
group of copies in as many pairs as it has nodes; a hub with many pairs is copied, so they spread. Then only pairs of nodes in one posting that are still in different
components meet. Postings of more than MERGED nodes are not merged pair by pair:
their nodes meet where they share one of their rarest shingles, which loses no link and skips what many of them hold.
Every link is confirmed on full sets.

Two sets at the similarity threshold (0.75) agree in fewer than MATCHES of the coordinates with a chance of about 3e-5.

Words are separated by ASCII white space and lower-cased for A-Z; under five words are one shingle; null, empty and
blank texts have an empty set and are linked with nothing. Rows that repeat an id are nodes by their own sets. A null id
takes part, and is no component's id unless all of its ids are null. kept says that a row's id is its component's, which
holds for every row of that id; of a component exactly one row stays: the least by id, nulls last, then by a digest of the
text, then any of the rows that are equal in both. Other columns are not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import HEAVY_KEYS, Memo, discard, release, table, texts, written
from tabloom.llm.components import connected_components

WORDS = 5
COORDINATES = 64
MATCHES = 34
COLLISIONS = 2
PREFIX = COORDINATES - MATCHES + COLLISIONS
#: Nodes of one posting that are met pair by pair; those of larger postings are met by their rarest shingles.
MERGED = 64
#: Pairs of one hub that are confirmed in one place.
HUB_ROWS = 50_000
#: Rows of a table of ids and digests that is broadcast at most.
FEW_ROWS = 500_000
#: Similarity threshold in hundredths.
PERCENT = 75
SKETCH = 1 << 16

_K = np.uint64(0x9E3779B97F4A7C15)
_HASH = Memo(xxhash.xxh3_64_intdigest)
_POWERS = [pow(int(_K), i, 1 << 64) for i in range(WORDS)]


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    bits = np.frombuffer(hashlib.shake_256(b"signature coordinates").digest(16 * COORDINATES), "<u8")
    return bits[:COORDINATES] | np.uint64(1), bits[COORDINATES:]


_A, _B = _coefficients()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += h[i : i + n] * np.uint64(_POWERS[i])
    return np.unique(_mixed(total))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hash over the set, 32 bits each."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 2048):
        best = np.minimum(best, (shingle_set[at : at + 2048, None] * _A + _B).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def _bucket(matrix: np.ndarray) -> np.ndarray:
    """A place in the sketch for each coordinate-value pair."""
    token = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | matrix.astype(np.uint64)
    return (_mixed(token * _K) >> np.uint64(48)).astype(np.int64)


def _text_digest(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_digest, row, n_shingles, digest, sig, low) of every row; row is a number of its own once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep(_HASH)
        for b in batches:
            n, digest, sig, low = [], [], [], []
            for t in texts(b, text_col):
                s = shingles(t)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
                low.append(_low_bytes(sig[-1]) if len(s) else None)
            columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *columns], ["doc_id", "text_digest", "row", "n_shingles", "digest", "sig", "low"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, _text_digest(F.col(text_col)).alias("_text_digest"), F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_digest binary, row bigint, n_shingles bigint, digest binary, sig binary, low array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _sketch(nodes: DataFrame) -> np.ndarray:
    """Counts of coordinate-value pairs in SKETCH places, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep(_HASH)
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            total += np.bincount(_bucket(_matrix(b.column(0))).ravel(), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(SKETCH, np.int64)
    counted = nodes.select("sig").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[counted["at"].to_numpy()] = counted["n"].to_numpy()
    return out


def _postings(nodes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, node, rank): the PREFIX rarest pairs of each node; the most central node has the least rank."""
    shipped = nodes.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep(_HASH)
        counts = shipped.value
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            seen = counts[_bucket(m)]
            token = (np.arange(COORDINATES, dtype=np.int64) << 32) | m.astype(np.int64)
            rare = np.lexsort((token, seen), axis=1)[:, :PREFIX]
            rows = np.repeat(np.arange(b.num_rows), PREFIX)
            rank = np.repeat(-np.take_along_axis(seen, rare, 1).sum(axis=1), PREFIX)
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(token, rare, 1).ravel()), b.column(0).take(pa.array(rows)), pa.array(rank)], ["token", "node", "rank"])

    return nodes.select("digest", "sig").mapInArrow(run, "token bigint, node binary, rank bigint")


def _low_bytes(sig: bytes) -> np.ndarray:
    """The lowest byte of each coordinate, eight to an integer."""
    return np.ascontiguousarray(np.frombuffer(sig, np.uint8)[::4]).view("<i8")


def _alike(one: str, two: str) -> F.Column:
    """May two nodes be linked: their sizes allow it and enough coordinates agree in the lowest byte (all that agree do)."""
    differ = []
    for k in range(COORDINATES // 8):
        x = F.col(f"{one}.low")[k].bitwiseXOR(F.col(f"{two}.low")[k])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ.append(F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    sizes = (100 * F.least(f"{one}.n", f"{two}.n")) >= PERCENT * F.greatest(f"{one}.n", f"{two}.n")
    return sizes & (sum(differ[1:], differ[0]) <= COORDINATES - MATCHES)


def _similar(one: str, two: str) -> F.Column:
    shared = F.size(F.array_intersect(one, two))
    return 100 * shared >= PERCENT * (F.size(one) + F.size(two) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Pairs whose full sets are as similar as asked. A heavy b's set is copied for each HUB_ROWS of its pairs, which are dealt to the copies."""
    one, two = (sets.select(F.col("digest").alias(k), F.col("set").alias(f"s{k}")) for k in "ab")
    if heavy is None:
        return pairs.join(one, "a").join(two, "b").where(_similar("sa", "sb")).select("a", "b")
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(F.broadcast(heavy), "b", "left").withColumn("copy", F.pmod(F.xxhash64("a"), copies)).drop("copies")
    copied = two.join(F.broadcast(heavy), "b", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).drop("copies")
    return dealt.join(one, "a").join(copied, ["b", "copy"]).where(_similar("sa", "sb")).select("a", "b")


def _sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, set) of the nodes that share a posting."""
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(needed.select(F.col("doc_id").alias("_need")).distinct(), F.col("_id").eqNullSafe(F.col("_need")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep(_HASH)
        for b in batches:
            found = [shingles(t) for t in texts(b, "_text")]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["digest", "set"])

    return chosen.select("_id", "_text").mapInArrow(run, "digest binary, set array<bigint>").dropDuplicates(["digest"])


def _rare_pairs(members: DataFrame, sets: DataFrame, about: DataFrame) -> DataFrame:
    """Pairs of members with different labels, met where they share one of their rarest shingles.

    Of n shingles, all but a quarter must be shared in a link; so two linked sets share one of the n - ceil(0.75 n) + 1
    that are rarest among the members, whatever order is common to all. A passage that many members hold is not rare.
    At the first of their common shingles a pair cannot share more than that one and what either set has after it, so
    pairs are left out where that is too little.
    """
    shingle = members.join(sets.withColumnRenamed("digest", "node"), "node").select("node", "label", F.size("set").alias("n"), F.explode("set").alias("s"))
    often = shingle.groupBy("s").count().where("count > 1")
    shared = shingle.join(often, "s")
    place = F.row_number().over(Window.partitionBy("node").orderBy("count", "s")) + F.col("n") - F.count("*").over(Window.partitionBy("node"))
    rare = written(shared.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).select("s", "node", "label", "n", "place"), "rare")
    full = rare.join(about, "node")
    one, two = (full.select("s", *(F.col(c).alias(f"{k}_{c}") for c in ("node", "label", "node_is", "n", "place"))) for k in "ab")
    most = 1 + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    enough = (100 + PERCENT) * most >= PERCENT * (F.col("a_n") + F.col("b_n"))
    apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
    meet = (one["s"] == two["s"]) & apart & enough & _alike("a_node_is", "b_node_is")
    return one.join(two, meet).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_digest, n_shingles, component_id, stays) for every row."""
    spark = docs.sparkSession
    signed = written(_signed(docs, id_col, text_col), "signed")
    own = signed.where("digest is not null")
    once = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_digest", "row")).alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    nodes = written(once, "nodes")
    release(spark)
    postings = _postings(nodes, _sketch(nodes))
    hubs = postings.groupBy("token").agg(F.min(F.struct("rank", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("token", F.col("hub.node").alias("hub"))
    shared = written(postings.join(hubs, "token").select("token", "node", "hub"), "postings")
    release(spark)
    needed = shared.groupBy("node").count().where(F.col("count") >= COLLISIONS).select(F.col("node").alias("digest")).join(nodes.select("digest", "doc_id"), "digest")
    sets = written(_sets(docs, needed, id_col, text_col), "sets")
    release(spark)

    about = lambda k: nodes.select(F.col("digest").alias(k), F.struct("n", "low").alias(f"{k}_is"))
    first = shared.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = written(first.join(about("a"), "a"), "first")
    # Hubs with many pairs: of first's rows each has over HUB_ROWS, and more where first is large, so they can be broadcast.
    met, many = first.groupBy("b").agg(F.count("*").alias("n")), max(HUB_ROWS, first.count() // HEAVY_KEYS)
    heavy = written(met.where(F.col("n") > many).select("b", F.ceil(F.col("n") / many).alias("copies")), "hubs")
    if heavy.isEmpty():
        near, heavy = first.join(about("b"), "b"), None
    else:
        light = first.join(F.broadcast(heavy.select("b")), "b", "left_anti").join(about("b"), "b")
        near = light.unionByName(first.join(F.broadcast(about("b").join(F.broadcast(heavy.select("b")), "b", "left_semi")), "b"))
    links = written(_confirmed(near.where(_alike("a_is", "b_is")).select("a", "b"), sets, heavy), "links")
    discard(first)
    early = written(connected_components(links), "labels")
    release(spark)

    named = shared.select("token", "node").join(early, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
    rest = written(named.join(mixed, "token").join(about("node"), "node"), "mixed")
    crowded = rest.groupBy("token").count().where(F.col("count") > MERGED).select("token")
    apart = written(rest.join(crowded, "token", "left_semi").select("node", "label").distinct(), "crowded")
    inside = apart.select("node", F.lit(True).alias("inside"))
    small = rest.join(crowded, "token", "left_anti").join(inside, "node", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    one, two = (small.select("token", F.col("node").alias(k), F.col("label").alias(f"l{k}"), F.col("node_is").alias(f"{k}_is"), F.col("inside").alias(f"{k}_in")) for k in "ab")
    other = ~(F.col("a_in") & F.col("b_in"))  # two nodes of crowded postings meet by their shingles
    meet = (one["token"] == two["token"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & other & _alike("a_is", "b_is")
    met = one.join(two, meet).select("a", "b").distinct()
    more = _confirmed(met.union(_rare_pairs(apart, sets, about("node"))), sets)
    labels = connected_components(links.union(more)).select(F.col("node").alias("digest"), "label")
    for gone in (shared, sets, links, early, rest, apart):
        discard(gone)
    release(spark)

    placed = nodes.select("digest", "doc_id", "least").join(labels, "digest")
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min("least").alias("stays"))
    grouped = placed.join(least, "label").select("digest", "component_id", F.col("stays.row").alias("stays"))
    own = nodes.select("digest", F.col("doc_id").alias("own"), F.col("least.row").alias("own_row")).join(grouped, "digest", "left")
    least_of = own.select("digest", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("stays", "own_row").alias("stays"))
    out = signed.select("doc_id", "text_digest", "row", "n_shingles", "digest").join(least_of, "digest", "left")
    stays = F.coalesce(F.col("row") == F.col("stays"), F.lit(True))  # an empty set is alone
    return out.select("doc_id", "text_digest", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, stays) for every row; stays marks the one row of each component that keep_one() would keep."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return _judged(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept, "stays")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each component, and all rows with an empty set.

    Rows are told apart by id and text. Of rows equal in both that have one to stay, it is the least by all columns.
    """
    by = _judged(docs, id_col, text_col).where("n_shingles > 0").groupBy("doc_id", "text_digest").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    marked = written(by.where("not stays or n > 1"), "marked")
    again = written(marked.where("stays"), "again")
    release(docs.sparkSession)
    # Texts need not move to meet a table that is small by count; a larger one is shuffled with them.
    marked, again = (F.broadcast(some) if some.count() <= FEW_ROWS else some for some in (marked, again))
    same = lambda some: docs[id_col].eqNullSafe(some["doc_id"]) & (_text_digest(docs[text_col]) == some["text_digest"])
    alone = docs.join(marked, same(marked), "left_anti")
    equal = docs.join(again, same(again), "left_semi")
    return alone.unionByName(equal.groupBy(id_col, text_col).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
