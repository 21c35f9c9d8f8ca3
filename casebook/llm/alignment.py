"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and which of their tokens end together.

Tokenizer A is a byte-level BPE and encodes a blank and the text; B is a sentence-piece model, which adds that blank itself. A text falls into
units at its single blanks (no white space on either side): neither tokenizer has a token across such a place (`Pair` checks the vocabularies; for
others a text is one unit), so both cut there and a unit is aligned once by a task and remembered. New units of a batch are aligned together on one
byte axis: cumulated lengths are the tokens' ends, their intersection the common cuts, a search in the cuts gives each token its group, and
repeating the tokens at a cut gives the links.

Links are counted in two stages, first by pair and a salt, then by pair, so that a pair that is in every document is no hot group. The counts go
back to the documents by a join: the table of counts is broadcast if it has at most ``BROADCAST_PAIRS`` rows, else both sides are dealt by pair and
salt.

Defined cases: a text that is null, empty, no valid UTF-8, or of which the tokens' joined bytes are not a blank and the text (B writes U+2581 as a
blank) has no tokens: zeros, and '' for the groups. Strings of special tokens are plain text. Rows count each by itself, repeated ones too, and
rows without an id are rows as any. Ties for the highest count of a B token are all best. An empty table gives no rows. Only the id and text
columns are read, so other columns' names cannot clash. A text without single blanks is one unit of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import documents, written

SALTS = 32
BROADCAST_PAIRS = 2_000_000  # rows of two longs and a flag
BATCH_BYTES = 1 << 21  # of texts that are aligned together
KNOWN_UNITS, KNOWN_CHARS, LONG_UNIT = 400_000, 1 << 24, 200  # what a task remembers
SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
BLANK_PIECE = "▁"
SHAPE = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be printed, else the next letter from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """The two tokenizers, what bytes their tokens stand for, and the units a task has aligned so far."""

    def __init__(self, a: bytes, b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK_PIECE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(t) for t in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        # "12," inside a group, "12|" and "12;" at the end of its A and B tokens
        self.said_a, self.said_b = (np.array([[f"{i}{c}" for i in range(len(of))] for c in marks], object) for of, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        rules = json.loads(a)
        blank_led = (rules.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and rules["pre_tokenizer"].get("use_regex") and not rules.get("normalizer")
        self.cuts_at_blanks = bool(blank_led) and not any(BLANK_PIECE in p.lstrip(BLANK_PIECE) for p in pieces)
        #: the units known and, by unit, whether its bytes are the tokens', its numbers of tokens, groups and links, its groups, and how often it was met
        self.known: dict[str, int] = {}
        self.chars = 0
        self.fits, self.counts, self.uses, self.said = np.zeros(0, bool), np.zeros((0, 4), np.int64), np.zeros(0, np.int64), []
        self.pairs, self.pair_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def linked(self, at: np.ndarray) -> np.ndarray:
        """The linked pairs of units, one after the other."""
        n = self.counts[at, 3]
        return self.pairs[np.repeat(self.pair_ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def forget(self) -> None:
        """Keeps the more used half of what it may know; most words of a corpus are met once."""
        texts = list(self.known)
        keep = np.sort([i for i in np.argsort(-self.uses, kind="stable")[: KNOWN_UNITS // 2].tolist() if len(texts[i]) <= LONG_UNIT]).astype(np.int64)
        self.pairs, self.pair_ends = self.linked(keep), np.append(0, np.cumsum(self.counts[keep, 3]))
        self.fits, self.counts, self.uses, self.said = self.fits[keep], self.counts[keep], self.uses[keep] // 2, [self.said[i] for i in keep.tolist()]
        self.known = {texts[i]: k for k, i in enumerate(keep.tolist())}
        self.chars = sum(map(len, self.known))

    def units(self, text: str) -> list[str]:
        return SINGLE_BLANK.split(text) if self.cuts_at_blanks else [text]

    def learn(self, units: list[str]) -> None:
        """Aligns new units and remembers them."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        raw = [b" " + u.encode() for u in units]
        fits = np.array([b"".join(map(self.bytes_a.__getitem__, x)) == r == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(ids_a, ids_b, raw, strict=True)], bool)
        held = np.flatnonzero(fits)
        counts, said, pairs, ends = np.zeros((len(units), 4), np.int64), [""] * len(units), np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        if len(held):
            n_a, n_b = (np.array([len(ids[i]) for i in held]) for ids in (ids_a, ids_b))
            flat_a, flat_b = (np.fromiter(chain.from_iterable(ids[i] for i in held), np.int64) for ids in (ids_a, ids_b))
            groups = Groups(self.len_a[flat_a], self.len_b[flat_b])
            unit = np.searchsorted(np.cumsum([len(raw[i]) for i in held]), groups.cuts)  # of each group
            left, right = groups.links()
            of_link = unit[groups.of_a[left]]
            counts[held] = np.stack([n_a, n_b, np.bincount(unit, minlength=len(held)), np.bincount(of_link, minlength=len(held))], axis=1)
            pairs = flat_a[left] * len(self.bytes_b) + flat_b[right]
            spelled = groups.interleaved(self.said_a[groups.last_a.astype(int), flat_a], self.said_b[groups.last_b.astype(int), flat_b]).tolist()
            upto = np.cumsum(n_a + n_b)
            for i, start, end in zip(held, upto - n_a - n_b, upto, strict=True):
                said[i] = "".join(spelled[start:end])[:-1]
            ends[held] = counts[held, 3]
        for k, u in enumerate(units):
            self.known[u] = len(self.said) + k
        self.chars += sum(map(len, units))
        self.fits, self.counts, self.uses = np.concatenate([self.fits, fits]), np.concatenate([self.counts, counts]), np.append(self.uses, np.zeros(len(units), np.int64))
        self.said += said
        self.pairs, self.pair_ends = np.concatenate([self.pairs, pairs]), np.concatenate([self.pair_ends, self.pair_ends[-1] + np.cumsum(ends)])

    def align(self, texts: list[bytes | None]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, digest of the groups, pairs and how often each is linked, of each text."""
        if len(self.known) > KNOWN_UNITS or self.chars > KNOWN_CHARS:
            self.forget()
        split = [self.units(t) if t else [] for t in map(_text, texts)]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(sorted(new))
        out = []
        for units in split:
            at = np.array(list(map(self.known.__getitem__, units)), np.int64)
            np.add.at(self.uses, at, 1)
            if not len(at) or not self.fits[at].all():
                out.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            said = hashlib.sha256(";".join(map(self.said.__getitem__, at.tolist())).encode()).hexdigest()
            linked = np.sort(self.linked(at))
            first = np.flatnonzero(np.append(True, linked[1:] != linked[:-1])[: len(linked)])
            out.append((*self.counts[at].sum(0).tolist(), said, linked[first], np.diff(np.append(first, len(linked)))))
        return out


class Groups:
    """Two sequences of tokens over the same bytes, cut where tokens of both end."""

    def __init__(self, len_a: np.ndarray, len_b: np.ndarray):
        self.ends_a, self.ends_b = np.cumsum(len_a), np.cumsum(len_b)
        self.cuts = np.intersect1d(_different(self.ends_a), _different(self.ends_b), assume_unique=True)
        self.of_a, self.of_b = np.searchsorted(self.cuts, self.ends_a), np.searchsorted(self.cuts, self.ends_b)
        self.last_a, self.last_b = (np.append(of[1:] != of[:-1], True) for of in (self.of_a, self.of_b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens that end together: at a cut each of A's with each of B's (more than one only where tokens are empty)."""
        at_a, at_b = np.flatnonzero(self.ends_a == self.cuts[self.of_a]), np.flatnonzero(self.ends_b == self.cuts[self.of_b])
        n_b = np.bincount(self.of_b[at_b], minlength=len(self.cuts))
        first, times = (np.cumsum(n_b) - n_b)[self.of_a[at_a]], n_b[self.of_a[at_a]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at_a, times), at_b[np.repeat(first, times) + within]

    def interleaved(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values of the tokens in the order of the groups, A's before B's in each."""
        n_a, n_b = np.bincount(self.of_a, minlength=len(self.cuts)), np.bincount(self.of_b, minlength=len(self.cuts))
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[self.of_a]] = a
        out[np.arange(len(b)) + np.cumsum(n_a)[self.of_b]] = b
        return out


def _different(rising: np.ndarray) -> np.ndarray:
    return rising[np.append(True, rising[1:] != rising[:-1])] if len(rising) else rising


def _text(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


_PAIRS: dict[bytes, Pair] = {}


def pair_of(a: bytes, b: bytes) -> Pair:
    """One for each process, so a worker's later tasks know the units of its earlier ones."""
    key = hashlib.sha256(a).digest() + hashlib.sha256(b).digest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(a, b)
    return _PAIRS[key]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_BYTES; a longer text is a range by itself."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BATCH_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def _aligned(batches: Iterator[pa.RecordBatch], models: Broadcast) -> Iterator[pa.RecordBatch]:
    pair = pair_of(*models.value)
    for batch in batches:
        texts = batch.column("text")
        for start, end in _parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            found = pair.align(texts.slice(start, end - start).to_pylist())
            offsets = np.cumsum([0, *(len(f[5]) for f in found)])
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([f[k] for f in found]), kind)) for k, kind in ((5, pa.int64()), (6, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), *columns, pa.array([f[4] for f in found], pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def aligned(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, digest of its groups, its linked id pairs (A id * size of B + B id) and how often each is linked in it.

    The driver alone reads the two files, some MB, and broadcasts them.
    """
    models = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            models.append(f.read())
    docs = documents(df, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    shape = SHAPE.format(docs.schema["doc_id"].dataType.simpleString())
    return docs.mapInArrow(partial(_aligned, models=df.sparkSession.sparkContext.broadcast(models)), shape)


def pair_counts(docs: DataFrame, size_b: int, salts: int = SALTS) -> DataFrame:
    """pair, n (links of the whole corpus that hold it), best (no pair of its B token has more)."""
    links = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"), F.pmod("row", F.lit(salts)).alias("salt"))
    salted = links.groupBy("pair", "salt").agg(F.sum("times").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % size_b)
    # a B token has at most as many pairs as A has tokens
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(
    df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS, salts: int = SALTS,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    # written, so that the row numbers are the same wherever they are read
    docs = written(aligned(df, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(docs, size_b, salts))
    links = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= broadcast_pairs:
        met = links.join(F.broadcast(counts), "pair")
    else:
        spread = counts.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(salts)))))
        met = links.withColumn("salt", F.pmod("row", F.lit(salts)).cast("long")).join(spread, ["pair", "salt"])
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    return docs.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"
    )
