"""The registered queries, every column, against brute force over one small table with all the odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_dedup import brute_repeats, components, shingle_set
from tokenizers import Tokenizer, models, pre_tokenizers

from tabloom.llm import byte_bpe, gif, near_dedup, quality, queries, suffix_dedup, token_counts


def corpus():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijé", k=rng.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30, 120]))) for _ in range(40)]
    texts += [t + " tail" for t in texts[:6]] + [texts[7]] * 3 + ["日本語 🎉\n\n  x\t", "<|endoftext|>", "a" * 3000, " ".join(rng.choices(vocabulary, k=30_000))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n "), (5, texts[5]), (5, "another text of a repeated id")]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    clash = {"n_tokens": F.lit("x"), "component_id": F.lit("y"), "kept": F.lit(1), "score": F.lit("z"), "marks": F.lit(2), "ids": F.lit(3), "digest": F.lit("d"), "_d": F.lit("e"), "feature": F.lit(4)}
    spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(clash).repartition(4).write.parquet(str(at / "documents.parquet"))
    labels = [(k, int(len(t or "") % 2), 0) for k, t in ROWS] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(at / "empty" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "empty" / "labels.parquet"))
    return at


def rows_of(spark, name, folder, *columns):
    return sorted(map(str, map(tuple, queries.QUERIES[name](spark, str(folder)).select(*columns).collect())))


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_byte_bpe", "op4_near_dedup", "op5_secrets", "op6_packing", "op7_gif", "op8_quality", "op10_suffix_dedup"])
def test_empty_tables_give_no_rows(spark, folder, name):
    assert queries.QUERIES[name](spark, str(folder / "empty")).count() == 0


def test_op1(spark, folder):
    pieces = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, 0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids), len(t or "")) for i, t in ROWS]
    assert rows_of(spark, "op1_token_counts", folder, "doc_id", "n_tokens", "n_chars") == sorted(map(str, want))


def test_op2(spark, folder):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert rows_of(spark, "op2_byte_bpe", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(map(str, want))


def test_op4(spark, folder):
    sets = [shingle_set(t) for _, t in ROWS]
    linked = [(a, b) for a in range(len(ROWS)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = components(range(len(ROWS)), linked)
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, math.inf), ROWS[k][0])
    want = sorted(str((ROWS[k][0], len(sets[k]), least[group[k]])) for k in range(len(ROWS)))
    assert rows_of(spark, "op4_near_dedup", folder, "doc_id", "n_shingles", "component_id") == want
    kept = near_dedup.op4_near_dedup(spark, str(folder)).where("stays and n_shingles > 0").collect()
    assert len(kept) == len({g for k, g in group.items() if sets[k]}) and all(r.doc_id == r.component_id and r.kept for r in kept)
    assert near_dedup.op4_near_dedup(spark, str(folder)).where("kept != (doc_id = component_id)").count() == 0


def plain_gif(data):
    """Samples of a GIF of whole frames, by the format's text: bit by bit, a table of tuples, one image after the other."""
    at = 13 + 3 * (2 << (data[10] & 7))
    out, palette = [], [tuple(data[13 + 3 * k : 16 + 3 * k]) for k in range(2 << (data[10] & 7))]
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        at += 10
        size, at, stream = data[at], at + 1, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        bits = int.from_bytes(stream, "little")
        clear, width, table, last = 1 << size, size + 1, {}, None
        while True:
            code, bits = bits & ((1 << width) - 1), bits >> width
            if code == clear:
                table, width, last = {k: (k,) for k in range(clear)}, size + 1, None
                continue
            if code == clear + 1:
                break
            entry = table[code] if code in table else (*last, last[0])
            out += entry
            if last is not None and len(table) + 2 < 4096:
                table[len(table) + 2] = (*last, entry[0])
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
            last = entry
    return bytes(out), palette


def test_op7(spark, folder):
    stored = {}
    for i, t in ROWS:
        raw = (t or "").encode()
        if len(raw) > 20_000:
            continue
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        media = gif.encode(padded)
        read, palette = plain_gif(media)
        assert read == padded
        colours = [0] * 8
        for s in read:
            r, g, b = palette[s]
            colours[(r >> 7) * 4 + (g >> 7) * 2 + (b >> 7)] += 1
        feature = f"64x{min(len(padded), 65536) // 64};1 frames;100 ms;" + ",".join(map(str, colours))
        stored.setdefault(i, []).append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    got = [tuple(r) for r in queries.QUERIES["op7_gif"](spark, str(folder)).select(*names).collect()]
    assert len(got) == len(ROWS)
    assert sorted(map(str, (r for r in got if r[0] in stored))) == sorted(str(r) for rows in stored.values() for r in rows)
    (long,) = [r for r in got if r[1] > 65_536]
    text = next(t for _, t in ROWS if t and len(t.encode()) == long[1]).encode()
    assert long[3] == hashlib.sha256(text + bytes(-len(text) % 64)).hexdigest() and f";{-(-long[2] // 65536)} frames;" in long[7]


def test_gif_refuses_oversized_screens():
    head = b"GIF89a" + (65535).to_bytes(2, "little") * 2 + bytes([0x80, 0, 0]) + bytes(6)
    with pytest.raises(gif.GifError, match="65535 x 65535"):
        gif.decode(head + b";")
    image = b"GIF89a" + (4).to_bytes(2, "little") * 2 + bytes([0x80, 0, 0]) + bytes(6) + b"," + bytes(4) + (65535).to_bytes(2, "little") * 2 + b"\0\x02\x01\0\0;"
    with pytest.raises(gif.GifError, match="image of 65535 x 65535"):
        gif.decode(image)


def plain_features(text):
    words = [xxhash.xxh3_64_intdigest(w.encode()) for chunk in text.split() for w in re.findall(r"\w+|[^\w\s]+", chunk.lower())]
    full = (1 << 64) - 1
    pairs = [0x5851F42D4C957F2D if a == b else ((a * 0x9E3779B97F4A7C15) & full) ^ b for a, b in zip(words, words[1:], strict=False)]
    found = {}
    for h in words + pairs:
        k = ((h * 0xD6E8FEB86659FD93) & full) >> 46
        found[k] = found.get(k, 0) + 1
    total = max(1, len(words) + len(pairs))
    return {k: n * 16.0 / total for k, n in found.items()}


def plain_quality(rows, labels):
    """Follow-the-regularised-leader over dictionaries, three rounds over the rows that are not held out."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= 0.02:
            return 0.0
        return -(z[k] - math.copysign(0.02, z[k])) / ((1.0 + math.sqrt(n[k])) / 0.3 + 0.05)

    def score(x):
        return 1 / (1 + math.exp(-max(-35, min(35, weight("bias") + sum(weight(k) * v for k, v in x.items() if k != "bias")))))

    texts = {}
    for i, t in rows:
        texts[i] = min(texts.get(i, t or ""), t or "")
    marks = {}
    for i, y in labels:
        marks.setdefault(i, []).append(y)
    train = [i for i in texts if i in marks and zlib.crc32(str(i).encode()) % 3 != 1]
    train.sort(key=lambda i: (xxhash.xxh3_64_intdigest(str(i)), i))
    for _ in range(3):
        for i in train:
            x = plain_features(texts[i]) | {"bias": 1.0}
            y, p = float(np.mean(marks[i]) >= 0.5), score(x)
            for k, v in [(k, v, ) for k, v in x.items()]:
                w, g = weight(k), (p - y) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / 0.3 * w
                n[k] = n.get(k, 0.0) + g * g
    return [(i, zlib.crc32(str(i).encode()) % 3 == 1, score(plain_features(t or ""))) for i, t in rows]


def test_op8(spark, folder):
    want = sorted(plain_quality(ROWS, [(k, int(len(t or "") % 2)) for k, t in ROWS]), key=str)
    got = sorted((tuple(r) for r in queries.QUERIES["op8_quality"](spark, str(folder)).select("doc_id", "held_out", "score", "predicted").collect()), key=str)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)
    assert all(r[3] == int(r[2] >= 0.5) for r in got)
    assert quality.BITS == 18


def test_op10(spark, folder):
    # Repeated ids are ordered by a hash of the text, so those rows are held against both orders.
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = rows_of(spark, "op10_suffix_dedup", folder, *names)
    wants = []
    for flip in (1, -1):
        rows = sorted(((i, k), t) for k, (i, t) in enumerate(ROWS))
        rows.sort(key=lambda r: (r[0][0], flip * r[0][1]))
        wants.append(sorted(str((i, *v)) for (i, _), v in brute_repeats(rows).items()))
    assert got in wants
    assert suffix_dedup.LENGTH == 100
