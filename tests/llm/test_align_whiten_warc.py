"""Cross-tokenizer alignment, exact whitening and web archives, each against a plain version."""

import hashlib
import random
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebook.llm import alignment, warc, whitening
from tests.llm.conftest import CLASHING, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- alignment -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain_alignment(tokenizers, texts):
    """Token by token, over whole texts."""
    a, b = tokenizers
    letters = alignment.byte_letters()
    rows, counts = [], Counter()
    for text in texts:
        rows.append(None)
        if not text:
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            continue
        ends = {}
        for side, tokens in (("a", zip(ids_a, bytes_a, strict=True)), ("b", zip(ids_b, bytes_b, strict=True))):
            at = 0
            for i, raw in tokens:
                at += len(raw)
                ends.setdefault(at, {"a": [], "b": []})[side].append(i)
        groups, now, links = [], ([], []), []
        for at in sorted(ends):
            now[0].extend(ends[at]["a"])
            now[1].extend(ends[at]["b"])
            if ends[at]["a"] and ends[at]["b"]:
                groups.append(",".join(map(str, now[0])) + "|" + ",".join(map(str, now[1])))
                links += [(x, y) for x in ends[at]["a"] for y in ends[at]["b"]]
                now = ([], [])
        counts.update(links)
        rows[-1] = (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


def odd_spellings(odd_texts):
    rng = random.Random(5)
    texts = [*odd_texts, "<|endoftext|> and </s> <s>", "tick▁mark", " two  blanks ", "\n a\n b", "end ", "x \x1c y 　z", "it's  we'll  don't", "a b c", "0\x00 1", "👩‍👩‍👧 ñandú"]
    texts += ["".join(rng.choice("ab  \n'.,1é漢") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return texts + [words(rng, 60)] * 5


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 0])
def test_alignment(spark, make, odd_texts, tokenizers, broadcast_pairs):
    texts = odd_spellings(odd_texts)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(make(texts), A, B, broadcast_pairs=broadcast_pairs, salts=3).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(tokenizers, texts)
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "") and got[len(odd_texts) + 1][0] == 0


def test_alignment_of_units_forgotten(monkeypatch, odd_texts, tokenizers):
    """Tasks that remember only few units, and align few at a time, say the same."""
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 40)
    monkeypatch.setattr(alignment, "LONG_UNIT", 8)
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = alignment.Pair(a.read(), b.read())
    assert pair.cuts_at_blanks
    texts = odd_spellings(odd_texts)
    expected = plain_alignment(tokenizers, texts)
    for text, row in zip(texts, expected, strict=True):
        found = pair.align([None if text is None else text.encode()])[0]
        assert (*found[:4], found[4]) == (*row[:4], row[6]) and found[6].sum() == row[3]
    assert pair.align([b"\xff\xfe"])[0][:5] == (0, 0, 0, 0, "")
    assert len(pair.known) < 10_000


def test_alignment_rows(spark, make, odd_texts):
    """Rows without an id and repeated rows stay rows of their own; an empty table gives none; ids may be text."""
    found = alignment.align(make([odd_texts[9]] * 4, ids=[None, None, 1, 1]), A, B).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "None", "None"] and len({tuple(r)[1:] for r in found}) == 1
    assert alignment.align(make([]), A, B).count() == 0
    named = spark.createDataFrame([("x", "a b c")], "name string, body string")
    assert alignment.align(named, A, B, "name", "body").first()["doc_id"] == "x"


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.data())
@settings(max_examples=200, deadline=None)
def test_groups_with_empty_tokens(len_a, data):
    """All pairs that end together are links, also where tokens have no bytes."""
    total = sum(len_a)
    cuts = sorted(data.draw(st.lists(st.integers(0, total), max_size=8)))
    len_b = np.diff([0, *cuts, total])
    g = alignment.Groups(np.array(len_a), len_b)
    ends_a, ends_b = np.cumsum(len_a).tolist(), np.cumsum(len_b).tolist()
    left, right = g.links()
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == sorted((i, j) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y)


# ---- whitening -----------------------------------------------------------------------------------


def exact_covariance(vectors):
    x = [[floor(64 * Fraction(float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(len(sums))] for i in range(len(sums))]
    return x, fit, n, sums, np.array(cov)


@pytest.mark.parametrize(("width", "scale"), [(5, 1.0), (20, 3.0), (3, 1e9), (4, 1e-3)])
def test_whitening(spark, width, scale):
    rng = np.random.default_rng(width)
    mix = rng.normal(size=(width, width))
    vectors = [(rng.normal(size=width) @ mix * scale).astype(np.float32).tolist() for _ in range(60)]
    vectors += [vectors[0]] * 30 + [[0.0] * width]
    rows = [(i, v, "s") for i, v in enumerate(vectors)] + [(900, None, "s"), (901, [None] * width, "s"), (902, [float("nan")] * width, "s"), (903, [float("inf")] * width, "s"), (None, vectors[1], "s")]
    df = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], "vec_id long, embedding array<float>, label string, " + ", ".join(f"`{c}_` string" for c in CLASHING))
    got = whitening.whiten(df).collect()
    x, fit, n, sums, cov = exact_covariance(vectors)
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(16, width)]
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    kept = len(by_row[0])
    assert set(by_row) == {*range(len(vectors)), None}
    assert {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    mean = np.array([s / n for s in sums])
    for i, v in enumerate(x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert by_row[i][1].deviation == (deviation if deviation < 1 << 63 else None)
        for k in range(kept):
            e = values[order[k]]
            expected = (np.array([float(c - m) for c, m in zip(v, mean, strict=True)]) @ basis[:, order[k]]) / np.sqrt(e)
            assert abs(abs(by_row[i][k + 1].whitened) - abs(expected)) < 1e-5 * (1 + abs(expected))
            assert by_row[i][k + 1].explained == pytest.approx(e / np.trace(cov), rel=1e-4)
    if scale >= 1:
        assert kept == min(16, width)
        w = np.array([[by_row[i][k + 1].whitened for k in range(kept)] for i in {tuple(v): i for i, v in enumerate(x)}.values()])
        assert np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(kept)).max() < 1e-9


@given(st.integers(1, 30), st.integers(1, 4), st.sampled_from([1, 1 << 17, 1 << 18, 1 << 40, 1 << 61]), st.randoms(use_true_random=False))
@settings(max_examples=100, deadline=None)
def test_scatter_is_exact(rows, width, most, rng):
    x = [[rng.randint(-most, most) for _ in range(width)] for _ in range(rows)]
    sums, cross = whitening.scatter(np.array(x, np.int64))
    assert sums == [sum(c) for c in zip(*x, strict=True)]
    assert cross.tolist() == [[sum(v[i] * v[j] for v in x) for j in range(width)] for i in range(width)]


def test_whitening_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0  # no direction has any variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], "x") for i in range(9)], "vec_id long, embedding array<double>, label string")
    found = whitening.whiten(flat).collect()
    assert {r.component for r in found} == {1} and all(r.explained == pytest.approx(1) for r in found)
    widths = spark.createDataFrame([(i, [float(i * k % 7) for k in range(1, 2 + i % 2)]) for i in range(12)] + [(99, [])], "vec_id string, embedding array<double>")
    found = whitening.whiten(widths).collect()
    assert {(r.vec_id, r.component) for r in found} == {(str(i), c) for i in range(12) for c in range(1, 2 + i % 2)}
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])], "vec_id long, embedding array<double>")
    assert all(np.isfinite(r.whitened) and (r.deviation is None) == (r.vec_id < 3) for r in whitening.whiten(far).collect())
    with pytest.raises(ValueError, match="4097"):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * 4097)], "vec_id long, embedding array<double>"))


# ---- archives ------------------------------------------------------------------------------------


def page_rows(rng):
    shared = words(rng, 80)
    bodies = [None, "", "short", "short", "x" * 99, "x" * 99, "x" * 100, "x" * 100, "é" * 50, "é" * 50, *[shared] * 40, words(rng, 60_000), "line\r\n\r\nWARC/1.1\r\n" * 30]
    bodies += [words(rng, rng.randint(20, 300)) for _ in range(60)]
    ids = rng.sample(range(10_000), len(bodies))
    urls = [rng.choice([None, "", "http://a.example/p?q=1", "http://x/\r\nWARC-Type: fake", "http://ü/ü"]) for _ in bodies]
    return list(zip(ids, urls, bodies, strict=True))


def expected_records(rows):
    first = {}
    for i, _, body in rows:
        raw = (body or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, body in rows:
        raw = (body or "").encode()
        to = first.get(raw)
        to = None if to is None or i == to else to
        out.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", None if to is None else str(to)))
    return sorted(out)


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 5_000])
def test_archives(spark, tmp_path, archive_bytes):
    rng = random.Random(3)
    rows = page_rows(rng)
    df = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    path = str(tmp_path / "archives")
    warc.write(df, path, archive_bytes=archive_bytes)
    found = warc.read(spark, path)
    got = warc.resolved(found).collect()
    assert all(r.problem is None for r in got) and (len({r.archive for r in got}) > 5) == (archive_bytes == 5_000)
    assert sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected_records(rows)
    payloads = {int(r.record_id): bytes(r.payload).decode() for r in got}
    assert payloads == {i: body or "" for i, _, body in rows}
    urls = {int(r.record_id): r.target_uri for r in got}
    assert all(urls[i] == (None if u is None else u.replace("\r\n", "%0D%0A").replace(" ", "%20")) or u == "" for i, u, _ in rows)
    # any reader of the format can read them: dictionary in front, then a frame a record
    name = got[0].archive.removeprefix("file:")
    with open(name, "rb") as f:
        data = f.read()
    assert data[:4] == warc.DICTIONARY_MAGIC and data.endswith(warc.EMPTY_END + b"\n")


def test_archive_ids(spark, tmp_path):
    """Rows without an id, ids that are not unique, text ids, no table at all, too little for a dictionary."""
    body = "y" * 200
    df = spark.createDataFrame([(None, "u", body), (7, "u", body), (7, "v", body), (9, None, body), (None, None, "z" * 150)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a"), payloads=False).collect()
    assert sorted((r.record_type, r.refers_to or "", r.payload_bytes) for r in got) == [("response", "", 150), ("response", "", 200), ("response", "", 200), ("revisit", "7", 200), ("revisit", "7", 200)]
    named = spark.createDataFrame([("a b/%1", "u", body), ("z", "u", body)], "name string, at string, body string")
    warc.write(named, str(tmp_path / "b"), "name", "at", "body")
    assert {(r.record_id, r.refers_to) for r in warc.read(spark, str(tmp_path / "b")).collect()} == {("a b/%1", None), ("z", "a b/%1")}
    warc.write(df.where("false"), str(tmp_path / "c"))
    assert warc.read(spark, str(tmp_path / "c")).count() == 0


def archive(*frames, dictionary=b""):
    return (warc.DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b"") + b"".join(frames)


def test_damaged_records():
    """What is wrong with a record is said, and the others are returned."""
    good = warc.record(1, "u", b"p" * 300, hashlib.sha256(b"p" * 300).hexdigest(), None, "2024-01-01T00:00:00Z", "page")
    z = zstandard.ZstdCompressor().compress
    damaged = {
        "no version line": b"HTTP/1.1 200 OK\r\n\r\n",
        "malformed header": good.replace(b"WARC-Date:", b"WARC-Date", 1),
        "no warc-date": good.replace(b"WARC-Date", b"WARC-Day", 1),
        "block length differs": good[:-4] + b"x\r\n\r\n",
        "no end of record": good[:-4] + b"\r\n\r ",
        "block digest differs": good.replace(b"ppp", b"qqq", 1),
    }
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nabc"
    own = lambda kind, block, *more: b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x:1>", b"WARC-Date: d", b"Content-Type: application/http", *more, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    damaged["payload length differs"] = own(b"response", block)
    damaged["payload digest differs"] = own(b"response", block.replace(b"5", b"3"), b"WARC-Payload-Digest: sha256:00")
    damaged["revisit of nothing"] = own(b"revisit", block)
    damaged["no end of response headers"] = own(b"response", b"HTTP/1.1 200 OK")
    frames = [z(raw) for raw in damaged.values()]
    broken = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(good))
    broken[-1] ^= 255
    found = list(warc.records(archive(z(good), *frames, bytes(broken), warc.SKIPPABLE_MAGIC + b"\2\0\0\0ab", z(own(b"response", b"HTTP/1.1 200 OK\r\nodd line\r\n\r\nabc")), z(good)[:-9])))
    assert [row["problem"] for _, row, _ in found] == [None, *damaged, "frame cannot be decoded", None, "frame is cut off"]
    assert [row["record_id"] for _, row, _ in found if row["problem"] is None] == ["1", "1"]
    folded = own(b"response", b"HTTP/1.1 200 OK\r\n\r\n", b"X-Long: a", b"\tb")
    assert warc.parsed_headers(folded.split(b"\r\n")[1:8])["x-long"] == "a b" and [row["problem"] for _, row, _ in warc.records(z(folded))] == [None]
    assert [row["problem"] for _, row, _ in warc.records(b"not an archive")] == ["no frame"]
    assert [row["problem"] for _, row, _ in warc.records(z(good) + b"\x28\xb5\x2f\xfd")] == [None, "no frame"]


@pytest.mark.parametrize("packed", [True, False])
def test_dictionaries(packed):
    """Dictionaries are read plain or compressed, frames may state no size, and runs are blocks of one byte."""
    rng = random.Random(8)
    dictionary = zstandard.train_dictionary(4096, [words(rng, 50).encode() * 3 for _ in range(200)])
    compressor = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False)
    raw = [warc.record(i, None, body, hashlib.sha256(body).hexdigest(), None, "d", "page") for i, body in enumerate([b"", b"a" * 3_000_000, words(rng, 500).encode(), bytes(rng.randbytes(300_000))])]
    kept = dictionary.as_bytes()
    data = archive(*(compressor.compress(r) for r in raw), dictionary=zstandard.ZstdCompressor().compress(kept) if packed else kept)
    found = list(warc.records(data))
    assert [row["problem"] for _, row, _ in found] == [None] * 4 and [row["payload_bytes"] for _, row, _ in found][:2] == [0, 3_000_000]
    assert [at for at, _, _ in found] == sorted(at for at, _, _ in found)


def test_reference_that_leads_nowhere(spark):
    row = lambda i, kind, to, digest, payload: ("f", i, str(i), kind, None, to, 3, digest, None, payload)
    rows = spark.createDataFrame([row(1, "response", None, "d", bytearray(b"abc")), row(2, "revisit", "1", "d", None), row(3, "revisit", "1", "e", None), row(4, "revisit", "8", "d", None)], warc.SHAPE + ", payload binary")
    got = {r.record_id: (r.problem, r.payload) for r in warc.resolved(rows).withColumn("payload", F.decode("payload", "UTF-8")).collect()}
    assert got == {"1": (None, "abc"), "2": (None, "abc"), "3": ("response has another payload", None), "4": ("reference leads to no response", None)}
