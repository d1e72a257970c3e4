"""Operator 5: secret scans, by base rules and a linear-chain conditional random field.

Tokens are runs without white space. Each is described by its shape, by hint words and by its neighbours' descriptions;
the file adds features of its own. The field tags tokens B, I or O. It is trained here, by gradient ascent on the
likelihood of windows of text from a bounded sample of rows (TRAIN_DOCS on average, by a hash of id and text). Their tags
are those of the base rules; into SEEDED of them secrets of forms that the base rules do not know are written (bearer
tokens, logins in addresses, private-key blocks, values after other names, prefixed tokens), and look-alikes that are none
into as many. So the field finds what the rules miss. Its spans are added to the base spans where they overlap none.

Viterbi decoding is exact and runs over islands only: a token that lies in no interval whose upper bounds of gain over
all-O sum to zero or more is O in every best path, so a text is cut there.

Null and empty texts have no spans. Positions are code points, the end is exclusive. Ties prefer O, then B. With no
usable sample the field adds nothing. Repeated rows give equal results, and repeated or null ids are rows like others.
Texts of any length are tagged whole. An empty table gives no rows. Only the id and text columns are read by
find_secrets(), so names of others cannot clash; redact() replaces the text column and keeps the others.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import Memo, table, texts

KINDS = ("assign", "access", "hex", "field")
TRAIN_DOCS = 4000
#: Windows that one sampled row adds to the training set at most, and all together.
TRAIN_WINDOWS, MOST_WINDOWS = 6, 12_000
#: Windows that get a secret of another form written into them, and as many that get a look-alike.
SEEDED = 1000
REACH = 6
STEPS = 100
RATE, DECAY = 0.5, 1e-3
O, B, I = 0, 1, 2  # noqa: E741

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CUES = ("passw", "secret", "token", "api")
_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "auth", "bearer", "credential", "login")
_HINT = re.compile("|".join(_HINTS))
_WORD = re.compile(r"\S+")
_EDGE = "\"'`,;:()[]{}<>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base rules, in order."""
    out = [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    lower = text.lower()
    if any(cue in lower for cue in _CUES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(out, key=lambda s: (s[0], s[2]))


def describe(token: str) -> tuple[str, ...]:
    """Shape and word features of one token."""
    core = token.strip(_EDGE)
    lower = core.lower()
    out = []
    if m := _HINT.search(lower):
        out.append(f"hint={m[0]}" if len(lower) <= 24 else "hint in")
    key, sep, value = core.rpartition("=") if "=" in core.rstrip("=") else core.rpartition(":")
    if sep and value:
        out += ["key", "key hint" if _HINT.search(key.lower()) else "key other"]
        core = value.strip(_EDGE)
    elif token in ("=", ":", "=>", ":="):
        out.append("sign")
    elif token[-1:] in "=:":
        out.append("ends with sign")
    digits = sum(c.isdigit() for c in core)
    uppers, lowers = sum("A" <= c <= "Z" for c in core), sum("a" <= c <= "z" for c in core)
    n = len(core)
    if not digits and not uppers * lowers and n < 16 and core.isalpha():
        return (*out, "word")
    kind = "digits" if digits == n else "hex" if all(c in "0123456789abcdef" for c in core) else "upper" if not lowers and core.isalnum() else "mixed" if core.isalnum() else "marks"
    out += [f"kind={kind}", f"size={min(n // 4, 12)}", f"{kind} size={min(n // 8, 6)}", f"digits={4 * digits // max(1, n)}"]
    classes = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "m" for c in core)
    turns = sum(x != y for x, y in zip(classes, classes[1:], strict=False))
    out += [f"turns={min(5, 8 * turns // max(1, n))}", f"{kind} turns={min(5, 8 * turns // max(1, n))} size={min(n // 8, 3)}"]
    if core.startswith("-----") or core.endswith("-----"):
        out.append("fence")
    if (at := core.find("://")) >= 0:
        out.append("login" if ":" in core[at + 3 :].partition("@")[0] and "@" in core else "address")
    elif "/" in core or "\\" in core:
        out.append("slash")
    if core[:1].isupper() and not digits and core[1:].islower():
        out.append("capital")
    if core[:4] == "AKIA":
        out.append("access")
    if "@" in core:
        out.append("mail")
    if token[:1] in "\"'`":
        out.append("quoted")
    return tuple(out)


def file_features(text: str, n_tokens: int) -> tuple[str, ...]:
    lower = text.lower()
    return ("file", f"file size={min(n_tokens.bit_length(), 15) // 3}", *(["file cue"] if any(cue in lower for cue in _CUES) else ()))


@dataclass
class Field:
    """Weights of a trained field: features by position (self, before, after, file) and transitions between tags."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def total(self, names: tuple[str, ...], where: str) -> np.ndarray:
        at = [self.index[f] for n in names if (f := where + n) in self.index]
        return self.weights[at].sum(axis=0) if at else np.zeros(3)


_PAD = ("outside",)


def window_features(described: list[tuple[str, ...]], file: tuple[str, ...]) -> list[list[str]]:
    """Feature names of every token, from its own, the two neighbours' and the file's."""
    n = len(described)
    near = lambda k: described[k] if 0 <= k < n else _PAD
    return [[*("0" + f for f in near(k)), *("-" + f for f in near(k - 1)), *("+" + f for f in near(k + 1)), *("f" + f for f in file)] for k in range(n)]


def train_field(windows: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> Field:
    """Maximise the windows' penalised log-likelihood. Short windows are padded with O; equal ones count once, by weight."""
    out = Field()
    if not windows:
        return out
    times = Counter((tuple(map(tuple, features)), tuple(tags)) for features, tags in windows)
    share = np.array(list(times.values())) / len(windows)
    windows = [([list(f) for f in features], list(tags)) for features, tags in times]
    length = max(len(tags) for _, tags in windows)
    at_list, token_list, tags = [], [], np.zeros((len(windows), length), np.int64)
    for w, (features, labels) in enumerate(windows):
        tags[w, : len(labels)] = labels
        for t, names in enumerate(features + [["0pad"]] * (length - len(labels))):
            for name in names:
                at_list.append(out.index.setdefault(name, len(out.index)))
                token_list.append(w * length + t)
    at, token = np.array(at_list), np.array(token_list)
    size, cells = len(out.index), len(windows) * length
    flat = tags.ravel()
    spread = lambda values, places, n: np.stack([np.bincount(places, values[:, y], n) for y in range(3)], axis=1)
    each = np.repeat(share, length)
    gold = spread((np.eye(3)[flat] * each[:, None])[token], at, size)
    path = np.concatenate([np.zeros((len(tags), 1), np.int64), tags, np.zeros((len(tags), 1), np.int64)], axis=1)
    gold_moves = np.bincount((path[:, :-1] * 3 + path[:, 1:]).ravel(), np.repeat(share, length + 1), 9).reshape(3, 3)
    out.weights = np.zeros((size, 3))
    g2, m2 = np.full((size, 3), 1e-8), np.full((3, 3), 1e-8)
    for _ in range(steps):
        e = spread(out.weights[at], token, cells).reshape(len(tags), length, 3)
        a = np.empty_like(e)
        b = np.empty_like(e)
        a[:, 0] = out.moves[0] + e[:, 0]
        for t in range(1, length):
            a[:, t] = _logsum(a[:, t - 1, :, None] + out.moves, 1) + e[:, t]
        b[:, -1] = out.moves[:, 0]
        for t in range(length - 2, -1, -1):
            b[:, t] = _logsum(out.moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = _logsum(a[:, -1] + out.moves[:, 0], 1)
        p = np.exp(a + b - z[:, None, None])
        pairs = np.exp(a[:, :-1, :, None] + out.moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        pairs = (pairs.sum(axis=1) * share[:, None, None]).sum(axis=0)
        pairs[0] += share @ p[:, 0]
        pairs[:, 0] += share @ p[:, -1]
        g = gold - spread((p.reshape(-1, 3) * each[:, None])[token], at, size) - DECAY * out.weights
        m = gold_moves - pairs - DECAY * out.moves
        g2 += g * g
        m2 += m * m
        out.weights += RATE * g / np.sqrt(g2)
        out.moves += RATE * m / np.sqrt(m2)
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def viterbi(e: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of a stretch that lies between two O tags."""
    score = moves[O] + e[0]
    back = []
    for row in e[1:]:
        options = score[:, None] + moves
        back.append(options.argmax(axis=0))
        score = options.max(axis=0) + row
    tags = [int((score + moves[:, O]).argmax())]
    for choice in reversed(back):
        tags.append(int(choice[tags[-1]]))
    return tags[::-1]


class Tagger:
    """Decodes texts with a field. Tokens with equal descriptions share one row of the weight tables."""

    def __init__(self, crf: Field):
        self.crf = crf
        self.classes: dict[tuple[str, ...], int] = {}
        self.tables = np.zeros((3, 0, 3))
        self.rows: list[list[np.ndarray]] = [[], [], []]
        self.pad = self._class(_PAD)
        self.of = Memo(lambda token: self._class(describe(token)))
        self.files: dict[tuple[str, ...], np.ndarray] = {}
        gain = crf.moves - crf.moves[O, O]
        gain[O, O] = -np.inf
        self.bonus = max(2 * gain.max(), gain.max())

    def _class(self, names: tuple[str, ...]) -> int:
        if names not in self.classes:
            self.classes[names] = len(self.classes)
            for rows, where in zip(self.rows, "0-+", strict=True):
                rows.append(self.crf.total(names, where))
        return self.classes[names]

    def emissions(self, text: str) -> np.ndarray:
        tokens = text.split()
        c = np.fromiter(map(self.of.__getitem__, tokens), np.int64, len(tokens))
        if self.tables.shape[1] < len(self.classes):
            self.tables = np.array(self.rows)
        file = file_features(text, len(tokens))
        if file not in self.files:
            self.files[file] = self.crf.total(file, "f")
        edge = np.array([self.pad])
        return self.tables[0][c] + self.tables[1][np.concatenate([edge, c[:-1]])] + self.tables[2][np.concatenate([c[1:], edge])] + self.files[file]

    def tags(self, text: str) -> dict[int, int]:
        """Tags other than O by token."""
        if not self.crf.index or not text or text.isspace():
            return {}
        e = self.emissions(text)
        u = e[:, 1:].max(axis=1) - e[:, 0] + self.bonus
        if u.max() < 0:
            return {}
        ahead = np.concatenate([[0.0], np.cumsum(u)])
        ends = ahead[1:] - np.minimum.accumulate(ahead[:-1])
        starts = np.maximum.accumulate(ahead[:0:-1])[::-1] - ahead[:-1]
        open_ = np.flatnonzero(ends + starts - u >= -1e-9)
        out: dict[int, int] = {}
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(part):
                out |= {int(k): y for k, y in zip(part, viterbi(e[part], self.crf.moves), strict=True) if y != O}
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and the field's own, by start, then kind."""
        found = base_spans(text)
        if tags := self.tags(text):
            places = [m.span() for m in _WORD.finditer(text)]
            runs: list[list[int]] = []
            for k in sorted(tags):
                if runs and tags[k] == I and runs[-1][1] == k - 1:
                    runs[-1][1] = k
                else:
                    runs.append([k, k])
            for first, last in runs:
                start, end = places[first][0], places[last][1]
                inner = text[start:end]
                start += len(inner) - len(inner.lstrip(_EDGE))
                end = start + len(inner.strip(_EDGE))
                if start < end and not any(s < end and start < t for s, t, _ in found):
                    found.append((start, end, 3))
        return sorted(found, key=lambda s: (s[0], s[2]))


_ALNUM = string.ascii_letters + string.digits
_BASE64 = _ALNUM + "+/"


#: Bearer tokens, logins in addresses, key blocks, prefixed tokens, values joined to other names, values after other names.
FORMS = (0, 1, 2, 3, 4, 5)


def seeded_secret(rng: random.Random, names: tuple[str, ...] = ("client_key", "session_key", "signing_key", "private_key", "auth", "credential", "db_pass", "pwd", "login_key", "master_key"), forms: tuple[int, ...] = FORMS) -> tuple[list[str], list[int]]:
    """Tokens and tags of a secret of one of the forms, which the base rules do not know."""
    text = lambda letters, n: "".join(rng.choices(letters, k=n))
    value = text(*rng.choice([(_ALNUM, rng.randrange(16, 48)), (_BASE64, rng.randrange(20, 64)), (_ALNUM + "-_", rng.randrange(20, 40))]))
    form = rng.choice(forms)
    if form == 0:
        return [rng.choice(["Authorization:", "authorization:", "auth:", "-H"]), rng.choice(["Bearer", "bearer", "Basic"]), value], [O, O, B]
    if form == 1:
        scheme, user = rng.choice(["postgres", "mysql", "mongodb", "redis", "amqp", "https", "ftp"]), text(string.ascii_lowercase, rng.randrange(3, 9))
        return [f"{scheme}://{user}:{text(_ALNUM, rng.randrange(6, 20))}@{text(string.ascii_lowercase, 6)}.{rng.choice(['local', 'example.com', 'internal'])}{rng.choice(['', ':5432', '/main', ':6379/0'])}"], [B]
    if form == 2:
        kind = rng.choice([[], ["RSA"], ["EC"], ["OPENSSH"]])
        body = [text(_BASE64, 64) for _ in range(rng.randrange(1, 4))]
        tokens = ["-----BEGIN", *kind, "PRIVATE", "KEY-----", *body, "-----END", *kind, "PRIVATE", "KEY-----"]
        return tokens, [B] + [I] * (len(tokens) - 1)
    if form == 3:
        return [f"{text(string.ascii_lowercase, rng.randrange(2, 5))}{rng.choice('_-')}{value}"], [B]
    name, quote = rng.choice(names), rng.choice(["", '"', "'"])
    if form == 4:
        return [f"{name}{rng.choice('=:')}{quote}{value}{quote}"], [B]
    before = rng.choice([[name, rng.choice(["=", ":", ":="])], [name + rng.choice("=:")]])
    return [*before, f"{quote}{value}{quote}"], [O] * len(before) + [B]


def seeded_decoy(rng: random.Random) -> list[str]:
    """Tokens that look alike and are no secret."""
    digits = lambda n: "".join(rng.choices(string.digits, k=n))
    word = "".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 10)))
    return rng.choice([
        [f"https://{word}.example.com/{word}/{digits(4)}?x={digits(2)}"], [f"{word}@example.com"], [f"20{digits(2)}-0{digits(1)}-1{digits(1)}T10:{digits(2)}:00Z"],
        [f"v{digits(1)}.{digits(2)}.{digits(1)}-rc{digits(1)}"], [f"{word}={digits(3)}"], ["key", "=", word], [f"{word}:", word], [digits(rng.randrange(8, 20))],
        [word + word.title() + word[::-1].title()], [f"{word.upper()}-{digits(4)}"], [f"/usr/{word}/{word}.{digits(1)}"], [word * 3], [f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}"],
        ["bearer", word], ["auth", word, digits(2)], [f"#{digits(6)}"], [f"{digits(2)}.{digits(2)}.{digits(3)}.{digits(1)}"], [f"({word})[{digits(2)}]"], [f"{word}_{word}_{digits(2)}"],
    ])


def _sampled_windows(docs: DataFrame, id_col: str, text_col: str, train_docs: int) -> list[tuple[list[list[str]], list[int], list[str]]]:
    """(descriptions of whole tokens with a neighbour on each side, tags, file features) of windows; rows are sampled, so a hot id brings no more than others."""
    rows = max(1, docs.count())
    mark = F.xxhash64(F.col(id_col).cast("string"), text_col)
    chosen = docs.select(mark.alias("_mark"), F.col(text_col).alias("_text")).where(F.pmod("_mark", F.lit(1 << 20)) < max(1, min(1 << 20, (train_docs << 20) // rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        for b in batches:
            out_tokens, out_tags, out_file, marks, places = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), texts(b, "_text"), strict=True):
                spans, words = base_spans(text), list(_WORD.finditer(text))
                tags = []
                for m in words:
                    hit = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
                    tags.append(O if hit is None else B if not tags or hit[0] >= m.start() or tags[-1] == O else I)
                odd = [k for k, m in enumerate(words) if tags[k] == B or any(c.isdigit() for c in m[0])]
                odd = sorted(odd, key=lambda k: (tags[k] != B, k))[:TRAIN_WINDOWS] or ([len(words) // 2] if words else [])
                for k in odd:
                    lo, hi = max(0, k - REACH), min(len(words), k + REACH + 1)
                    marks.append(i)
                    places.append(k)
                    out_tokens.append([list(describe(words[x][0]) if 0 <= x < len(words) else _PAD) for x in range(lo - 1, hi + 1)])
                    out_tags.append(tags[lo:hi])
                    out_file.append(list(file_features(text, len(words))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks, pa.int64()), pa.array(places, pa.int64()), pa.array(out_tokens, pa.list_(pa.list_(pa.string()))), pa.array(out_tags, pa.list_(pa.int32())), pa.array(out_file, pa.list_(pa.string()))],
                ["mark", "place", "described", "tags", "file"],
            )

    found = chosen.mapInArrow(run, "mark bigint, place bigint, described array<array<string>>, tags array<int>, file array<string>").dropDuplicates(["mark", "place"])
    return [(r["described"], list(r["tags"]), r["file"]) for r in found.orderBy("mark", "place").limit(MOST_WINDOWS).collect()]


def training_windows(sampled: list[tuple[list[list[str]], list[int], list[str]]], seeded: int = SEEDED, forms: tuple[int, ...] = FORMS) -> list[tuple[list[list[str]], list[int]]]:
    """Features and tags of the sampled windows, and of copies with seeded secrets and look-alikes."""
    rng = random.Random(5)
    views = list(sampled)
    for k in range(2 * seeded if sampled else 0):
        described, tags, file = rng.choice(sampled)
        new, new_tags = seeded_secret(rng, forms=forms) if k % 2 else (seeded_decoy(rng), [])
        new_tags = new_tags + [O] * (len(new) - len(new_tags))
        at = rng.randrange(1, len(described))
        views.append(([*described[:at], *map(describe, new), *described[at:]], [*tags[: at - 1], *new_tags, *tags[at - 1 :]], file))
    out = []
    for described, tags, file in views:
        features = window_features(list(map(tuple, described)), tuple(file))[1:-1]
        for at in range(0, len(tags), 2 * REACH + 4):  # long views in parts, as all windows take the length of the longest
            out.append((features[at : at + 2 * REACH + 4], tags[at : at + 2 * REACH + 4]))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, forms: tuple[int, ...] = FORMS) -> Field:
    """Train the field on a bounded sample of docs, with secrets of some forms written in."""
    return train_field(training_windows(_sampled_windows(docs, id_col, text_col, train_docs), forms=forms))


def find_secrets(docs: DataFrame, crf: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start,end,kind>>) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shipped.value)
        Memo.keep(tagger.of)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            found = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in tagger.spans(t)] for t in texts(b, text_col)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, spans)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redact(docs: DataFrame, crf: Field, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with each span of the text replaced by a mask. Texts without spans stay as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(crf)
    place = docs.columns.index(text_col)

    def clean(tagger: Tagger, text: str | None) -> str | None:
        if not text or not (spans := tagger.spans(text)):
            return text
        out, at = [], 0
        for start, end, _ in spans:
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], mask]
            at = end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shipped.value)
        Memo.keep(tagger.of)
        for b in batches:
            cleaned = pa.array([clean(tagger, t) for t in b.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([cleaned if k == place else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit(docs))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans")
    )
