"""Resampling, fill-in-the-middle and repeated windows of words against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import common, fill_middle, recompression, resampling

SCHEMA = "doc_id long, text string"


def odd_rows(seed, n=50):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcXYZé09", k=rng.randrange(1, 7))) for _ in range(60)]
    rows = [(k, "".join(w + rng.choice([" ", "\n", "-", "\t", "  "]) for w in rng.choices(vocabulary, k=rng.choice([0, 1, 5, 25, 90])))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (3, rows[3][1]), (3, "Another text of it\nin two lines"), (None, rows[4][1]), (None, None), (n + 3, "日本 語 " * 30), (n + 4, "a" * 5000)]


# Resampling


def brute_features(text, order):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]


def brute_resample(rows, target, order=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in rows:
        np.add.at(s, [bucket(f) for f in brute_features(x, order)[1]], 1)
    for x in target:
        np.add.at(t, [bucket(f) for f in brute_features(x, order)[1]], 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + buckets) / ((s[k] + 1) * (t.sum() + buckets)))) for k in range(buckets)]
    out = []
    for i, x in rows:
        words, found = brute_features(x, order)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


@pytest.mark.parametrize(("order", "head", "step"), [(1, 20_000, 1 << 16), (2, 30, 7), (3, 5, 4)])
def test_resampling_equals_brute_force(spark, monkeypatch, order, head, step):
    monkeypatch.setattr(resampling, "WORDS", step)
    rows, target = odd_rows(order), [t for _, t in odd_rows(9, 12)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"n_features": F.lit("x"), "rank": F.lit(1), "_salt": F.lit(2)}).repartition(5)
    out = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), order=order, buckets=300, percent=40, least_words=5, head=head)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in out.collect()) == brute_resample(rows, target, order, 300, 40, 5)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, none).count() == 0
    (row,) = resampling.resample(spark.createDataFrame([(1, "one two " * 20)], SCHEMA), none, percent=100).collect()
    assert row["rank"] == 1 and row.n_features == 40


def test_the_head_is_bounded_and_holds_what_is_frequent(spark):
    rows = [(k, "often " * 30 + " ".join(f"rare{k}x{j}" for j in range(40))) for k in range(40)]
    head = resampling.head_of(spark.createDataFrame(rows, SCHEMA).repartition(3), order=2, head=20)
    assert b"often" in head and b"often often" in head and len(head) < 40
    summary = resampling.Summary(3)
    for k in range(500):
        summary.add([b"a", b"b", f"{k}".encode()])
    summary.cut()
    assert len(summary.counts) <= 3 and 500 - 1500 / 3 <= summary.counts[b"a"] <= 500


# Fill-in-the-middle


def brute_middle(i, text):
    t = text or ""
    h = [int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return (i, len(lines), "plain", None, None, digest(t), digest(t))
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return (i, len(lines), form, len(p), len(m), digest(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), digest(t))


MIDDLES = [*odd_rows(21), (100, "a<P>b\nc"), (101, "<S"), (102, "<\n>P>"), (103, "\n\n\n"), (104, "no end\nof line"), (105, "é\n" * 300)]


def test_middles_equal_brute_force(spark):
    docs = spark.createDataFrame(MIDDLES, SCHEMA).withColumns({"form": F.lit(1), "n": F.lit("x"), "output_sha256": F.lit(2)}).repartition(4)
    got = fill_middle.middle_digests(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(brute_middle(*r)) for r in MIDDLES)
    assert fill_middle.middle_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_come_back(spark):
    docs = spark.createDataFrame(MIDDLES, SCHEMA).withColumn("form", F.lit("x"))
    filled = fill_middle.fill_in_middle(docs)
    assert filled.columns == ["doc_id", "text", "form"] and {r.form for r in filled.collect()} == {"plain", "psm", "spm"}
    back = fill_middle.restore_texts(filled)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, t or "")) for i, t in MIDDLES)


def test_rotations_and_sentinels():
    for n in range(9):
        for cut in range(n + 1):
            block = np.arange(n, dtype=np.uint8)
            fill_middle.rotate(block, cut)
            assert block.tolist() == [*range(cut, n), *range(cut)]
    for bad in ((b"<P>", b"<P>", b"<M>"), (b"", b"a", b"b"), (b"ab", b"bc", b"x"), (b"aba", b"c", b"d"), (b"abc", b"b", b"d")):
        with pytest.raises(ValueError):
            fill_middle.Sentinels(*bad)
    rng = random.Random(3)
    for k in range(300):
        raw = "".join(rng.choices("<>PSMé\n", k=rng.randrange(30))).encode()
        made = fill_middle.rotated(raw, tuple(rng.randrange(1 << 32) for _ in range(4)), rate=90)
        assert bytes(fill_middle.restored(bytes(made.output), made.form)) == raw


# Repeated windows of words


def brute_windows(rows, window=13):
    first = {}
    parts = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: -1 if i is None else i
    for i, w in parts:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for i, w in parts:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append(str((i, len(w), len(gone), b" ".join(kept).decode())))
    return sorted(out)


def repetitive(seed, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    bases = [rng.choices(vocabulary, k=120) for _ in range(3)] + [["same"] * 60, ["tick", "tock"] * 40, ["a", "b", "c"] * 30]
    rows = []
    for k in range(n):
        base, at = rng.choice(bases), rng.randrange(100)
        w = base[at : at + rng.randrange(5, 60)] + rng.choices(vocabulary, k=rng.randrange(12)) + base[: rng.randrange(40)]
        if k % 3 == 0 and w:
            w[rng.randrange(len(w))] = "edit"
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[5][1]), (n + 3, " "), (5, rows[6][1]), (5, rows[5][1]), (None, rows[7][1]), (None, rows[8][1]), (n + 4, " ".join(rng.choices(vocabulary, k=13)))]


@pytest.mark.parametrize(("window", "chunk", "heavy"), [(13, 1 << 16, 2000), (13, 20, 2), (5, 64, 2), (30, 1 << 16, 2000)])
def test_windows_equal_brute_force(spark, monkeypatch, window, chunk, heavy):
    monkeypatch.setattr(recompression, "CHUNK", chunk)
    monkeypatch.setattr(common, "HEAVY_ROWS", heavy)
    rows = repetitive(window + chunk)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"d": F.lit(1), "name": F.lit("x"), "marks": F.lit(2), "_d": F.lit(3)}).repartition(5)
    assert sorted(str(tuple(r)) for r in recompression.repeated_words(docs, window=window).collect()) == brute_windows(rows, window)


def test_windows_of_unlike_ids_and_empty_tables(spark):
    rows = [r for r in repetitive(3, 40) if r[0] not in (None, 5)]
    assert sorted(str(tuple(r)) for r in recompression.repeated_words(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_windows(rows)
    assert recompression.repeated_words(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_windows_share_their_symbol():
    rng = random.Random(6)
    vocabulary = np.array([rng.randrange(1 << 63) for _ in range(6)], np.uint64)
    names = vocabulary[[rng.randrange(6) for _ in range(30_000)]]
    names[500:540] = vocabulary[0]
    names[900:960] = np.tile(vocabulary[:2], 30)
    border = np.zeros(len(names), bool)
    border[[0, 7000, len(names) - 1]] = True
    starts, name, start, end, lo, hi = recompression.revealing(names, border, window=7)
    assert not any(border[s : s + 7].any() for s in starts.tolist()) and len(starts) == len(names) - 2 - 6 * 2 - 1
    assert ((lo >= starts) & (hi <= starts + 7) & (lo <= start) & (end <= hi)).all()
    told = {}
    for s, *what in zip(starts.tolist(), name.tolist(), (start - starts).tolist(), (end - starts).tolist(), strict=True):
        assert told.setdefault(tuple(names[s : s + 7].tolist()), what) == what
    assert len(told) < len(starts)
