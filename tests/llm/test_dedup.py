import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import common, near_dedup, suffix_dedup
from tabloom.llm.components import connected_components


def words(text):
    return [w for w in (text or "").encode().lower().split() if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (1, 0), (300, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    bases = [rng.choices(vocabulary, k=rng.choice([4, 12, 60, 150])) for _ in range(12)]
    passage = rng.choices(vocabulary, k=40)
    out = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if k % 4 == 0:
            w += passage
        out.append((k, " ".join(w) if k % 3 else "\n".join(w).upper()))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "one two"), (n + 4, "One  Two")]


@pytest.mark.parametrize("merged", [64, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, merged):
    monkeypatch.setattr(near_dedup, "MERGED", merged)
    monkeypatch.setattr(near_dedup, "HUB_ROWS", merged // 10 + 1)
    rows = corpus(merged)
    sets = {i: shingle_set(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, linked)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "node": F.lit("x")}).repartition(7)
    got = near_dedup.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and sum(r.component_id == 1 for r in got) == 4
    assert sum(r.stays and r.component_id == 1 for r in got) == 2  # q r s t u v is alone
    same = near_dedup.near_duplicates(spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.kept) for r in same) == [(2, True), (2, True), (3, False)] and sum(r.stays for r in same) == 1
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def repetitive(seed, n=60):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("abcé ", k=500)) for _ in range(4)]
    rows = []
    for k in range(n):
        base, at = rng.choice(bases), rng.randrange(400)
        rows.append((k, base[at : at + rng.randrange(50, 400)] + "x" * (rng.randrange(300) if k % 3 == 0 else 0) + base[: rng.randrange(1, 250)]))
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, "q" * 1000)]


@pytest.mark.parametrize("most", [16384, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    monkeypatch.setattr(common, "HEAVY_ROWS", most)
    rows = repetitive(most)
    got = suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)


def test_repeats_of_repeated_ids_and_empty_tables(spark):
    rows = [(1, "ab" * 80), (1, "ab" * 80), (None, "cd" * 80)]
    got = suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 158), ("1", 160), ("None", 158)]
    kept = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "z") for i, t in [*rows, (None, None), (None, "")]], "doc_id long, text string, d string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, "ab", "z"), (1, "", "z"), (None, "cd", "z"), (None, None, "z"), (None, "", "z")]))
    assert suffix_dedup.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(5)
    raw = bytes(rng.choices(b"abcdefgh", k=20_000))
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    parts = suffix_dedup.anchors(raw)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_the_index_is_a_transform_of_its_texts():
    contexts = [b"banana" * 30, b"bandana" * 20, b"banana" * 29 + b"x"]
    index = suffix_dedup.RunIndex(contexts)
    assert len(index.run_starts) < index.n / 5  # repeats make few runs
    length, before = index.matching_statistics()
    for i in range(0, index.n, 7):
        if before[i] >= 0:
            a = bytes(index.text[i : i + index.left[i]])
            b = bytes(index.text[before[i] : before[i] + index.left[before[i]]])
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert length[i] == same


def test_whole_characters():
    text = "aéz"
    gone = np.array([False, True, False, False])
    assert suffix_dedup.whole_characters(text, gone) == "aéz"
    assert suffix_dedup.whole_characters(text, np.array([True, True, True, False])) == "z"


def test_remove_repeats_keeps_columns(spark):
    rows = [(1, "ab" * 80, "s", 160), (2, "ab" * 80, "s", 160), (3, None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, marks string, n_chars long")
    out = suffix_dedup.remove_repeats(df, length_col="n_chars")
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.n_chars) for r in out.collect()) == [(1, 2), (2, 0), (3, None)]
