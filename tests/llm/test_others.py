import hashlib
import json
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabloom.llm import chat, common, gif, quality, secrets, topk


@pytest.mark.parametrize("size", [64, 4096 * 3, 70_016, 64 * 1024 * 2 + 64])
@pytest.mark.parametrize("kind", ["random", "zero", "pairs"])
def test_gif_round_trip(size, kind):
    data = {"random": random.Random(size).randbytes(size), "zero": bytes(size), "pairs": (b"ab" * size)[:size]}[kind]
    frames, width, _ = gif.decode(gif.encode(data))
    assert b"".join(f.indices.tobytes() for f in frames) == data and width == gif.WIDTH


def image(left, top, w, h, pixels, delay=3, disposal=0, transparent=None, interlaced=False):
    flags = (disposal << 2) | (transparent is not None)
    control = bytes([0x21, 0xF9, 4, flags, delay, 0, transparent or 0, 0])
    stream = gif.lzw_compress(bytes(pixels), 2)
    place = b"".join(int(x).to_bytes(2, "little") for x in (left, top, w, h))
    return control + b"," + place + bytes([0x40 * interlaced, 2, len(stream)]) + stream + b"\0"


def movie(*images, w=3, h=2):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + bytes([w, 0, h, 0, 0x81, 0, 0]) + palette + b"".join(images) + b";"


def test_gif_disposal_and_transparency():
    full = image(0, 0, 3, 2, [1] * 6)
    hole = image(0, 0, 2, 1, [0, 2], transparent=0, disposal=2)
    undone = image(1, 1, 1, 1, [3], disposal=3)
    last = image(2, 0, 1, 1, [2])
    frames, _, _ = gif.decode(movie(full, hole, undone, last))
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert frames[1].canvas[0].tolist() == [red, green, red]
    assert frames[2].canvas.tolist() == [[[0] * 4, [0] * 4, red], [red, blue, red]]  # the hole's place was cleared
    assert frames[3].canvas.tolist() == [[[0] * 4, [0] * 4, green], [red, red, red]]  # the blue pixel was undone
    assert [f.delay_ms for f in frames] == [30] * 4


def test_gif_interlaced_rows():
    frames, _, _ = gif.decode(movie(image(0, 0, 1, 5, [0, 1, 2, 3, 1], interlaced=True), w=1, h=5))
    assert frames[0].indices[:, 0].tolist() == [0, 3, 2, 1, 1]


def codes_of(pixels, size=8):
    """A foreign stream: a full table is kept for a while and only then cleared, as writers may."""
    clear = 1 << size
    known, width, codes, prefix, late = {}, size + 1, [(clear, size + 1)], None, 0
    for x in pixels:
        key = (prefix, x)
        if prefix is None or key in known:
            prefix = x if prefix is None else known[key]
            continue
        codes.append((prefix, width))
        prefix = x
        entry = clear + 2 + len(known)
        if entry < 4096:
            known[key] = entry
            width = max(width, entry.bit_length())
        elif (late := late + 1) == 700:
            codes.append((clear, 12))
            known, width, late = {}, size + 1, 0
    bits = at = 0
    for code, n in [*codes, (prefix, width), (clear + 1, width)]:
        bits |= code << at
        at += n
    return bits.to_bytes((at + 7) // 8, "little")


@pytest.mark.parametrize("size", [2, 8])
def test_lzw_of_streams_that_keep_a_full_table(size):
    pixels = random.Random(5).choices(range(1 << size), k=60_000)
    stream = codes_of(pixels, size)
    assert gif.lzw_expand(stream, size, len(pixels)) == bytes(pixels)
    with pytest.raises(gif.GifError):
        gif.lzw_expand(stream[: len(stream) // 2], size, len(pixels))


def test_lzw_of_thousands_of_clears():
    # A clear after every literal: more clears than a recursion could take.
    n = 5000
    bits = at = 0
    for code in [c for k in range(n) for c in (256, k % 256)] + [257]:
        bits |= code << at
        at += 9
    assert gif.lzw_expand(bits.to_bytes((at + 7) // 8, "little"), 8, n) == bytes(k % 256 for k in range(n))


def test_gif_limit_of_pixels_is_a_parameter(spark):
    data = movie(image(0, 0, 3, 2, [1] * 6))
    with pytest.raises(gif.GifError, match="3 x 2"):
        gif.decode(data, max_pixels=5)
    (row,) = gif.gif_frames(spark.createDataFrame([(1, bytearray(data))], "id long, data binary"), max_pixels=5).collect()
    assert row.frame is None and "3 x 2" in row.error


def test_gif_frames_table(spark):
    good = movie(image(0, 0, 3, 2, [1] * 6), image(0, 0, 1, 1, [2]))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:30])), (3, None)], "id long, data binary")
    rows = gif.gif_frames(df).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.start_ms) for r in rows[:2]] == [(1, 0, 0), (1, 1, 30)] and sum(rows[0].histogram) == 6
    assert all(r.error for r in rows[2:]) and len(rows) == 4


def test_texts_as_gif(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "é" * 50_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in gif.store_texts(df).collect()}
    assert [rows[k].payload_bytes for k in (1, 2, 3, 4)] == [64, 64, 64, 100_032] and rows[2].media_sha256 == rows[3].media_sha256


def brute_top(ids, v, q, own, k):
    return sorted((-int(x), int(i)) for x, i in zip(v @ q, ids, strict=True) if i != own)[:k]


def searched(ids, v, query_ids, queries, k, size=10**6):
    """The k best of each query and what was read."""
    reads, rows = topk.Reads(), {}
    blocks = ((ids[a : a + size], v[a : a + size]) for a in range(0, len(ids), size))
    for x, found, scores in topk.search_blocks(blocks, query_ids, queries, k, reads):
        rows.setdefault(x, []).extend((-s, i) for i, s in zip(found, scores, strict=True))
    return {x: sorted(r)[:k] for x, r in rows.items()}, reads


@pytest.mark.parametrize("n, dims, size", [(3000, 64, 700), (400, 3, 10**6), (5, 2, 2), (300, 4, 10)])
def test_threshold_search_equals_brute_force(n, dims, size):
    rng = np.random.default_rng(n)
    v = rng.integers(-7, 8, (n, dims)).astype(float)
    v[:2] = 0
    ids = rng.permutation(n)
    got, _ = searched(ids, v, ids[:5], v[:5], 20, size)
    for x in range(min(5, n)):
        assert got[x] == brute_top(ids, v, v[x], ids[x], 20)


def test_threshold_search_stops_on_clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 40, (20, 16))
    v = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 2, (4000, 16)))
    ids = np.arange(4000)
    got, reads = searched(ids, v, ids[::400], v[::400], 20, 200)
    assert all(got[x] == brute_top(ids, v, v[x * 400], x * 400, 20) for x in range(10))
    assert reads.vectors < 0.3 * reads.all_vectors and reads.entries < 0.2 * reads.all_entries


class Counted(np.ndarray):
    """Counts the entries that are taken from it."""

    taken = 0

    def __getitem__(self, key):
        out = np.asarray(super().__getitem__(key))
        Counted.taken += out.size
        return out


def test_threshold_search_touches_what_it_counts():
    rng = np.random.default_rng(2)
    v = np.floor(np.repeat(rng.normal(0, 40, (20, 16)), 50, axis=0) + rng.normal(0, 2, (1000, 16)))
    v[:, 3] = 0
    block, reads = topk.Block(np.arange(1000), v), topk.Reads()
    block.rows = block.rows.view(Counted)
    block.search(0, v[0], 20, None, reads)
    assert Counted.taken == reads.entries and 0 < reads.entries < reads.all_entries / 2
    vectors, lists = block.typed(np.float32)
    block.exact[np.float32] = vectors.view(Counted), lists
    Counted.taken = 0
    again = topk.Reads()
    block.search(0, v[0], 20, None, again)
    own = 1  # the query's own row is met, and not looked up
    assert again == reads and Counted.taken == (reads.vectors - own) * 16 + reads.entries


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_share_read_of_the_supplied_vectors():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, v = topk.integer_rows(t["vec_id"].combine_chunks(), t["embedding"].combine_chunks())
    got, reads = searched(ids, v, ids[ids % 20 == 0], v[ids % 20 == 0], 20, 8192)
    assert got[3] == brute_top(ids, v, v[ids == 60][0], 60, 20)
    print("entries", reads.entries / reads.all_entries, "vectors", reads.vectors / reads.all_vectors)
    assert reads.entries < 0.9 * reads.all_entries and reads.vectors <= reads.all_vectors


@pytest.mark.parametrize("ways", [1 << 26, 0])
def test_top_k_frame(spark, monkeypatch, ways):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", ways)
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(0, 0.2, 8).astype("float32").tolist()) for k in range(300)]
    rows[7] = (7, rows[6][1])  # ties
    rows[8] = (8, rows[40][1])
    bad = [(301, None), (302, [float("nan")] * 8), (303, [None] * 8), (340, [float("inf")] * 8), (None, [1.0] * 8)]
    twice = [(5, rows[9][1]), (20, rows[20][1])]  # a repeated id, and a repeated query row
    df = spark.createDataFrame(rows + bad + twice, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit("x"), "vector": F.lit("y"), "asked": F.lit(2)}).repartition(6)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
    v = np.floor(64 * np.array([r[1] for r in rows + twice])).astype(int)
    ids = np.array([r[0] for r in rows + twice])
    for q in range(0, 300, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(-r.score, r.vec_id) for r in mine] == brute_top(ids, v, v[q], q, 20) and [r.rank for r in mine] == list(range(1, 21))
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("ways", [1 << 26, 0])
def test_top_k_of_large_empty_and_uneven_vectors(spark, monkeypatch, ways):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", ways)
    rows = [(0, [1e7, 2.0]), (1, [1e7]), (2, []), (3, [-1e7, 1.0, 5.0]), (20, [])]
    rows += [(40, [0.25, 0.5]), (41, [1.2e8, -3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False))
    for q in (0, 20, 40):
        want = sorted((-score(q, i), i) for i, _ in rows if i != q)
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


@pytest.mark.parametrize("x", [1e9, 1e17])
def test_top_k_never_wraps(spark, x):
    df = spark.createDataFrame([(0, [x, 2.0]), (1, [x, 2.0]), (20, [0.02, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(df, F.col("vec_id") == 0).collect()
    assert [r.score for r in topk.top_k(df.where("vec_id > 0"), F.col("vec_id") == 20).collect()] == [int(64 * x)]


def test_op9_equals_sql(spark):
    for at in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        if Path(at).exists():
            embeddings = duckdb.read_parquet(f"{at}/embeddings.parquet")  # noqa: F841
            want = duckdb.sql(topk.ORACLE_SQL).fetchall()
            assert sorted(map(tuple, topk.op9_topk(spark, at).collect())) == sorted((q, r, v, s) for q, r, v, s in want)


def test_base_spans():
    text = 'ſecret=abcdef Password: "hunter2x" token=abc ' + "AKIA" + "A" * 16 + " AKIAB " + "deadbeef" * 3 + " api_key='x1/+_.=-'"
    assert [(text[s:e], k) for s, e, k in secrets.base_spans(text)] == [('Password: "hunter2x', 0), ("AKIA" + "A" * 16, 1), ("deadbeef" * 3, 2), ("api_key='x1/+_.=-", 0)]


def trained():
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    windows = []
    for k in range(80):
        body = rng.choices(["the", "of", "4.0.", "12.1.2.3", "Word,"], k=12)
        spot = rng.randrange(12)
        body[spot] = f"password={hexes(18)}" if k % 2 else hexes(40)
        file = secrets.file_features(" ".join(body), 12)
        windows.append((secrets.window_features([secrets.describe(t) for t in body], file), [secrets.B if x == spot else secrets.O for x in range(12)]))
    return secrets.train_field(windows)


def test_islands_decode_as_the_whole_text():
    crf, rng = trained(), random.Random(3)
    tagger = secrets.Tagger(crf)
    for _ in range(40):
        text = " ".join(rng.choices(["the", "of", "a1b2c3d4e5f60718293a", "password=0123abcd", "4.0.", "is,"], k=30))
        full = secrets.viterbi(tagger.emissions(text), crf.moves)
        assert {k: y for k, y in enumerate(full) if y} == tagger.tags(text)


def test_field_adds_spans_and_keeps_base_ones(spark):
    crf = trained()
    text = "the of 0123456789abcdef01234567 is password=12ab34 a, é"
    spans = secrets.Tagger(crf).spans(text)
    assert set(secrets.base_spans(text)) <= set(spans)
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, spans string")
    out = {r.doc_id: r.text for r in secrets.redact(df, crf).collect()}
    assert out[2] is None and out[3] == "" and "0123456789abcdef" not in out[1] and out[1].endswith("a, é")
    assert {r.doc_id: len(r.spans) for r in secrets.find_secrets(df, crf).collect()}[2] == 0
    assert secrets.fit(df.limit(0)).index == {}


def prose(rng, n):
    return " ".join(rng.choices(["the", "of", "thing", "Wort,", "und", "4.0", "17", "12.1.2.3", "ly.34@mail7.example.com", "9807915762804490", "is."], k=n))


def test_field_finds_held_out_forms_and_leaves_clean_text_alone(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(k, prose(rng, 60) + (f' token = "{rng.randbytes(20).hex()}"' if k % 9 == 0 else "")) for k in range(400)] + [(None, "hot " * 40)] * 50, "doc_id long, text string")
    crf = secrets.fit(docs)
    tagger, found, wrong = secrets.Tagger(crf), 0, 0
    names = ("vault_code", "licence_hash", "webhook_sig", "deploy_ref", "sk")  # none of these names is in the training set
    for _ in range(200):
        tokens, tags = secrets.seeded_secret(rng, names)
        before, after = prose(rng, 20), prose(rng, 20)
        text = " ".join([before, *tokens, after])
        start = len(before) + 1 + len(" ".join(["", *tokens[: tags.index(secrets.B)]]))
        inside = lambda s: s[0] < len(text) - len(after) and start - 2 < s[1]  # noqa: B023, E731
        spans = tagger.spans(text)
        found += any(map(inside, spans))
        wrong += sum(not inside(s) for s in spans)
    assert found >= 190 and wrong <= 4
    clean = [" ".join([prose(rng, 20), *secrets.seeded_decoy(rng), prose(rng, 20)]) for _ in range(200)]
    assert sum(bool(tagger.spans(t)) for t in clean) <= 2


@pytest.mark.parametrize("held", [(0, 1), (2, 3), (4, 5)])
def test_field_finds_forms_that_training_has_not_seen(spark, held):
    rng = random.Random(13)
    docs = spark.createDataFrame([(k, prose(rng, 60)) for k in range(400)], "doc_id long, text string")
    crf = secrets.fit(docs, forms=tuple(f for f in secrets.FORMS if f not in held))
    tagger, found = secrets.Tagger(crf), 0
    for _ in range(200):
        tokens, _ = secrets.seeded_secret(rng, ("vault_code", "licence_hash", "webhook_sig"), held)
        before = prose(rng, 20)
        text = " ".join([before, *tokens, prose(rng, 20)])
        found += any(s < len(before) + len(" ".join(tokens)) + 1 and len(before) < e for s, e, _ in tagger.spans(text))
    assert found >= 80  # the README has the share by form
    clean = [" ".join([prose(rng, 20), *secrets.seeded_decoy(rng), prose(rng, 20)]) for _ in range(200)]
    assert sum(bool(tagger.spans(t)) for t in clean) <= 10  # 5 where (2, 3) are held out; the README says so


def test_training_describes_whole_tokens(spark):
    long = "zZ" * 150 + "9Z" * 150
    docs = spark.createDataFrame([(1, f"x {long} y")], "doc_id long, text string")
    ((described, tags, _),) = secrets._sampled_windows(docs, "doc_id", "text", 10)
    assert tuple(described[2]) == secrets.describe(long) and tags == [secrets.O] * 3


def plain_base(text):
    """The base rules, spelled out again: leftmost, not overlapping, by kind."""
    rules = [
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    out = [(m.start(), n, kind, m.end()) for n, (kind, pattern, good) in enumerate(rules) for m in re.finditer(pattern, text) if good(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def test_op5_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "ApI_KeY", "=", ":", " ", '"', "'", "abc", "hunter2x", "AKIA" + "Q7" * 8, "AKIA12", "deadbeef" * 3, "0f" * 11, "é", "\n", "ſecret", "toKen", "x+/_.=-y", "=="]
    rows = [(k, "".join(rng.choices(parts, k=rng.randrange(1, 14)))) for k in range(300)] + [(300, None), (301, ""), (5, "token=abcdef1"), (5, "token=abcdef1"), (None, "token: deadbeefdead")]
    rows.append((400, "wort " * 40_000 + "password = hunter22"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "base_sha256": F.lit("x")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.op5_secrets(spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        base = plain_base(text or "")
        count = lambda kind: sum(x.startswith(kind) for x in base)  # noqa: B023, E731
        want.append((i, count("assign"), count("access"), count("hex"), hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got)
    for r in got:
        spans = [x for x in r.spans.split(",") if x and not x.startswith("field")]
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == r.base_sha256
    assert secrets.find_secrets(docs.limit(0), secrets.fit(docs.limit(0))).count() == 0


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(1)
    vocabulary = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(600):
        w = rng.choices(vocabulary, k=40)
        rows.append((k, " ".join(x + ("***" if k % 3 == 0 else "") for x in w), int(k % 3 != 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(700, None), (701, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.add_quality(docs, model).withColumn("out", quality.held_out("doc_id")).collect()}
    held = [(got[i].score >= 0.5) == bool(y) for i, _, y in rows if got[i].out]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert got[700].score == got[701].score
    untrained = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.add_quality(docs, untrained).collect()} == {0.5}


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
OTHERS = "conv_id long, turn long, role string, content string"
FREE = {"f": {}}


def test_chat_arguments_meet_their_schemas(spark):
    tools = {"f": {"properties": {"q": {"type": "string", "enum": ["a", "é"]}, "n": {"type": ["integer", "null"], "minimum": 2, "maximum": 5}, "x": {"type": "number"}, "l": {"type": "array"}, "o": {"type": "object"}, "b": {"type": "boolean"}}, "required": ["q"], "additionalProperties": False}, "g": {}}
    cases = [
        ("f", '{"q":"a"}', True), ("f", '{"q": "é", "n": 3}', True), ("f", '{"q":"b"}', False), ("f", '{"q":"a","n":1}', False), ("f", '{"q":"a","n":6}', False), ("f", '{"q":"a","n":"3"}', False),
        ("f", '{"q":"a","n":2.5}', False), ("f", '{"q":"a","x":2.5,"l":[1],"o":{"z":1},"b":true}', True), ("f", '{"q":"a","l":{}}', False), ("f", '{"q":"a","b":1}', False), ("f", '{"n":3}', False),
        ("f", '{"q":null}', False), ("f", '{"q":"a","zz":1}', False), ("f", "{broken", False), ("f", None, False), ("f", "[1]", False), ("h", "{}", False), ("g", '{"any":1}', True), (None, "{}", False),
    ]
    df = spark.createDataFrame([(k, n, a) for k, (n, a, _) in enumerate(cases)], "k int, name string, arguments string")
    got = {r.k: r for r in chat.check_arguments(df, tools).collect()}
    assert [got[k].valid for k in range(len(cases))] == [v for _, _, v in cases]
    assert got[1].arguments_json == '{"n":3,"q":"é"}' and got[13].arguments_json == '"{broken"' and got[14].arguments_json == "null"
    with pytest.raises(ValueError, match="tools"):
        chat.check_arguments(df, {str(k): {} for k in range(chat.MAX_TOOLS + 1)})


def test_chat_repeats_stay_one_row_each(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    calls = spark.createDataFrame([(1, k, "same", "f", "{}", None) for k in range(50)] + [(2, 0, "x", "f", "{}", None)], CALLS)
    results = spark.createDataFrame([(1, 100 + k, "same", "ok") for k in range(50)] + [(2, 0, "x", None), (2, 3, "lost", "r"), (2, 4, None, "n")], RESULTS)
    rows = chat.link_messages(calls, results, spark.createDataFrame([], OTHERS), FREE).collect()
    assert len(rows) == 104 and sum(r.ambiguous for r in rows) == 100 and sum(r.linked for r in rows) == 102
    by = {(r.call_id, r.kind): r for r in rows if r.conv_id == 2}
    one, two = by["x", chat.CALLS], by["x", chat.RESULT]
    assert (one.depth, one.level) == (0, 0) and (two.depth, two.level) == (0, 1) and not two.valid
    assert not by["lost", chat.RESULT].linked and not by[None, chat.RESULT].linked


def test_chat_order_follows_chains_and_marks_cycles(spark):
    waits = [("a", 9, ["b"]), ("b", 5, ["c", "gone"]), ("c", 7, []), ("p", 1, ["q"]), ("q", 2, ["p"]), ("r", 3, ["q"]), ("s", 4, ["s"])]
    calls = spark.createDataFrame([(1, t, i, "f", "{}", w) for i, t, w in waits] + [(2, 1, "a", "f", "{}", None), (2, 5, "b", "f", "{}", ["a"])], CALLS)
    results = spark.createDataFrame([(1, 2, "c", "r"), (1, 6, "b", "r"), (1, 20, "a", "r"), (2, 3, "a", "r")], RESULTS)
    rows = chat.with_positions(chat.link_messages(calls, results, spark.createDataFrame([(1, 0, "system", "s")], OTHERS), FREE)).collect()
    at = {(r.call_id, r.kind - chat.CALLS): r.position for r in rows if r.conv_id == 1}
    assert at[None, chat.OTHER - chat.CALLS] == 0 and at["c", 0] < at["c", 1] < at["b", 0] < at["b", 1] < at["a", 0] < at["a", 1]
    assert sorted(at.values()) == list(range(11))
    assert {r.call_id for r in rows if r.cyclic} == {"p", "q", "r", "s"}
    assert [(r.call_id, r.kind) for r in sorted((r for r in rows if r.conv_id == 2), key=lambda r: r.position)] == [("a", chat.CALLS), ("a", chat.RESULT), ("b", chat.CALLS)]


def test_chat_waits_of_repeated_identifiers_all_count(spark):
    calls = spark.createDataFrame([(1, 1, "x", "f", "{}", ["p"]), (1, 1, "x", "f", "{}", ["q"]), (1, 5, "p", "f", "{}", None), (1, 7, "q", "f", "{}", None)], CALLS)
    rows = chat.link_messages(calls, spark.createDataFrame([], RESULTS), spark.createDataFrame([], OTHERS), FREE).collect()
    assert sorted((r.call_id, r.depth, r.level) for r in rows) == [("p", 5, 0), ("q", 7, 0), ("x", 7, 1), ("x", 7, 1)] and not any(r.cyclic for r in rows)


def chats(spark, folder, turns):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"call_id": F.lit("clash"), "derived": F.lit(1)}).write.parquet(str(folder / "conversations.parquet"))
    return {r.conv_id: r for r in chat.op3_chat(spark, str(folder)).collect()}


def test_chat_keeps_roles_content_and_arguments(spark, tmp_path):
    weather = {"content": "Let me look that up.", "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "reply", "arguments": json.dumps({"sha256": "0" * 64, "length": 3})}}]}
    twice = '{"tool_calls":[{"id":"c2","name":"f","arguments":{"a":1,"a":2}},{"id":"c3","name":"f","arguments":"no json"}]}'
    turns = [(1, 0, "user", "weather?"), (1, 1, "assistant", json.dumps(weather)), (1, 2, "tool", '{"tool_call_id":"c1","content":"sunny"}'), (1, 3, "assistant", "It is sunny."), (2, 0, "assistant", twice), (2, 1, "tool", '{"tool_call_id":"c2","content":{"k":1,"k":2}}')]
    got = chats(spark, tmp_path, turns)
    assert json.loads(got[1].chat) == [
        {"content": "weather?", "role": "user", "turn": 0}, {"content": "Let me look that up.", "role": "assistant", "turn": 1},
        {"arguments": {"length": 3, "sha256": "0" * 64}, "id": "c1", "name": "reply", "role": "assistant", "turn": 1}, {"content": "sunny", "id": "c1", "role": "tool", "turn": 2}, {"content": "It is sunny.", "role": "assistant", "turn": 3},
    ]
    first, second, result = sorted(json.loads(got[2].chat), key=lambda m: (m["role"] == "tool", m["id"]))
    assert first["arguments"] == '{"a":1,"a":2}' and second["arguments"] == "no json" and result["content"] == '{"k":1,"k":2}' and got[2].trace == "[]"
    traced = json.loads(got[1].trace)
    digest = hashlib.sha256(b"weather?").hexdigest()
    assert traced[0] == {"arguments": {"length": 8, "sha256": digest}, "id": "1-0", "name": "reply", "role": "assistant", "turn": 0}
    assert [(m["role"], m["id"]) for m in traced] == [("assistant", "1-0"), ("tool", "1-0"), ("tool", "1-2")]


def test_chat_escapes_every_control_character(spark):
    texts = ["", "a\x00b\x1f\x1f", "\x01", "\x0b\n\"\\\b", "é\x7f😀\x02", None, "plain"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.json_string(F.col("t")).alias("j")).collect()
    assert [r.j for r in got] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_chat_reads_calls_from_texts(spark, tmp_path):
    call = json.dumps({"content": None, "tool_calls": [{"id": "c1", "name": "reply", "arguments": {"sha256": "x" * 64, "length": 2}}, {"id": "c2", "name": "other", "arguments": {"z": [1, {"y": 2, "a": 1}]}}]})
    turns = [(1, 0, "user", "{not json"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"c1","content":{"b":1,"a":2}}'), (1, 3, "tool", '{"tool_call_id":"c9","content":"x"}'), (1, 4, "assistant", '{"other": 1}'), (2, 0, "tool", "plain")]
    rows = chats(spark, tmp_path, turns)
    messages = json.loads(rows[1].chat)
    assert [m.get("id") for m in messages] == [None, "c1", "c2", "c1", "c9", None] and rows[1].n_linked == 2 and rows[1].n_calls == 3
    assert [m["role"] for m in messages] == ["user", "assistant", "assistant", "tool", "tool", "assistant"] and messages[5]["content"] == '{"other": 1}'
    assert messages[2]["arguments"] == {"z": [1, {"a": 1, "y": 2}]} and messages[3]["content"] == '{"a":2,"b":1}'
    assert rows[1].chat == json.dumps(messages, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert rows[1].n_messages == 6 and rows[2].chat == '[{"content":"plain","role":"tool","turn":0}]'


def test_chat_parts_of_a_long_conversation(spark):
    others = spark.createDataFrame([(7, k % 5, "user", f"t{k}") for k in range(2300)] + [(None, None, None, None)], OTHERS).repartition(5)
    empty = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    out = chat.format_conversations(chat.link_messages(*empty, others, FREE), 1000).collect()
    parts = sorted((r for r in out if r.conv_id == 7), key=lambda r: r.part)
    assert [r.n_messages for r in parts] == [1000, 1000, 300] and len(out) == 4
    turns = [m["turn"] for r in parts for m in json.loads(r.chat)]
    assert turns == sorted(turns)
    assert chat.format_conversations(chat.link_messages(*empty, others.limit(0), FREE)).count() == 0


def chat_equals_sql(spark, at):
    conversations = duckdb.read_parquet(f"{at}/conversations.parquet" if Path(f"{at}/conversations.parquet").is_file() else f"{at}/conversations.parquet/*.parquet")  # noqa: F841
    want = duckdb.sql(chat.ORACLE_SQL)
    got = chat.op3_chat(spark, str(at))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_chat_equals_sql_with_nulls_and_repeats(spark, tmp_path):
    turns = [(1, 0, "system", 'be "kind"'), (1, 1, "user", "hi\n\t\\\x01"), (1, 2, "assistant", "ho"), (1, 2, "assistant", "ho"), (1, 3, "tool", None), (1, 4, None, "x"), (1, None, "user", "when"), (1, None, "assistant", "now"), (1, None, "system", "s"), (None, 5, "user", "who"), (None, 6, "assistant", "me"), (2, 1, "user", None), (2, 3, "user", ""), (2, 3, "user", "é" * 50_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    chat_equals_sql(spark, tmp_path)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_chat_equals_sql(spark):
    chat_equals_sql(spark, "/root/testdata/sf0.01")
