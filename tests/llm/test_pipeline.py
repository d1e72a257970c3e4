"""The stages on a small corpus: each is held against what brute force gives for its own input."""

import hashlib
import random

import corpus_pipeline
from tabloom.llm import near_dedup, packing, secrets


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    clean = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(120)]
    junk = [" ".join(w + "***" for w in rng.choices(vocabulary, k=80)) for _ in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = clean + junk + clean[:10] + [clean[20] + " tail"] + [f"{clean[k]} {passage} {clean[k + 1][:80]}" for k in (30, 40)]
    texts[50] += ' password=0123456789abcdef01 token = "deadbeefdeadbeefdeadbeef"'
    labels = [(k, int(not 120 <= k < 180)) for k in range(len(texts))]
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], [(k, q, 0) for k, q in labels], passage


def test_stages(spark, tmp_path):
    rows, labels, passage = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
    quality, near, repeats, clean = kept
    assert not any(120 <= k < 180 for k in quality) and len(quality) == len(rows) - 60
    sets = {k: set(near_dedup.shingles(r.text).tolist()) for k, r in quality.items()}
    alone = {k for k in sets if not any(j < k and 100 * len(sets[j] & sets[k]) >= 75 * len(sets[j] | sets[k]) for j in sets)}
    assert set(near) == alone and not any(180 <= k < 191 for k in near)
    assert sum(passage in r.text for r in repeats.values()) == 1 and set(repeats) == set(near)
    assert all(r.n_chars == len(r.text) for r in clean.values())
    assert not any(secrets.base_spans(r.text) for r in clean.values()) and "[SECRET]" in clean[50].text
    assert clean[60].text == rows[60][1]
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = packing.encoder(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in last) == sum(len(enc.encode(r.text)) + 1 for r in clean.values())
    assert len(last[0]) == 7


def test_near_duplicates_go_by_row(spark, monkeypatch):
    rng = random.Random(5)
    x, y, z, w = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(4))
    rows = [
        (0, x, "en"), (1, x + " tail", "en"), (1, y, "en"),  # an id with a near copy and a clean text
        (2, z, "en"), (2, z, "de"), (2, z, "en"),  # exact copies with one id
        (None, x + " end", "en"), (None, w, "en"), (None, w, "en"), (None, w + " end", "en"),  # null ids: a copy, and a group of their own
        (7, None, "en"), (7, None, "en"), (None, " ", "en"),  # empty sets
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=str)
    least = min([w, w + " end"], key=lambda t: hashlib.md5(t.encode()).digest())
    assert got == sorted([(0, x, "en"), (1, y, "en"), (2, z, "de"), (None, least, "en"), (7, None, "en"), (7, None, "en"), (None, " ", "en")], key=str)
    monkeypatch.setattr(near_dedup, "FEW_ROWS", 0)
    assert sorted(((r.doc_id, r.text, r.lang) for r in near_dedup.keep_one(docs).collect()), key=str) == got
    kept = near_dedup.near_duplicates(docs).where("stays and n_shingles > 0").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "1", "2", "None"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _score string, kept string, spans string, component_id string, length string"


def staged_rows(spark, folder, rows, labels):
    """What each stage gives for the rows before it; columns of other meanings but with the stages' names stay as they are."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in rows], DOCS)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        last = stage(spark, docs, str(folder))
        assert name == "packing" or last.columns == docs.columns
        last.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.collect())
        if name != "packing":
            assert all((r._score, r.kept, r.spans, r.component_id, r.length) == tuple("abcde") for r in out[-1]), name
    return out


def test_stages_of_null_empty_repeated_and_long_rows(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    long, text = (" ".join(word() for _ in range(n)) for n in (30_000, 80))
    secret = " ".join(word() for _ in range(50)) + " password=0123456789abcdef01"
    rows = [(1, text), (1, text), (2, None), (2, None), (3, ""), (None, None), (None, secret), (4, long)]
    quality, near, repeats, clean, packed = staged_rows(spark, tmp_path, rows, [(9, 1, 0), (None, 0, 0), (1, None, 0)])
    assert len(quality) == len(rows)  # no label is usable, so nothing is rejected
    texts = lambda out: sorted(((r.doc_id, r.text) for r in out), key=str)
    assert texts(near) == sorted([(1, text), (2, None), (2, None), (3, ""), (None, None), (None, secret), (4, long)], key=str)
    assert texts(repeats) == texts(near)
    assert all(r.n_chars == len(r.text) for r in clean if r.text is not None)
    masked = [r.text for r in clean if r.doc_id is None and r.text]
    assert len(clean) == 7 and len(masked) == 1 and masked[0].endswith("[SECRET]")
    enc = packing.encoder(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(enc.encode(r.text or "")) + 1 for r in clean)
    assert max(r.length for r in packed) == 2048


def test_stages_of_an_empty_table(spark, tmp_path):
    assert staged_rows(spark, tmp_path, [], []) == [[], [], [], [], []]


def test_stages_let_go_of_the_memos_of_others(spark):
    import os

    import pyarrow as pa

    from tabloom.llm import near_dedup, quality

    def fill(batches):
        near_dedup._HASH["word"]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * b.num_rows)], ["pid"])

    def left(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows) for n in (os.getpid(), len(near_dedup._HASH))], ["pid", "n"])

    tasks = spark.range(64).repartition(32)
    filled = {r.pid for r in tasks.mapInArrow(fill, "pid long").collect()}
    docs = tasks.selectExpr("id as doc_id", "concat('some words ', id) as text")
    quality.fit(docs, tasks.selectExpr("id as doc_id", "cast(id % 2 as int) as quality"))
    assert any(r.pid in filled and r.n == 0 for r in tasks.mapInArrow(left, "pid long, n long").collect())
