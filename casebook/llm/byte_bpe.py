r"""Byte-level BPE encoding and decoding.

Words are the matches of the tokenizer's pattern. A fold over a word's byte pieces merges, again and
again, the neighbours whose concatenation has the lowest rank, until no concatenation has one.

Two forms of the fold give the same ids:

* `folded` is made of Spark's higher-order functions over the word's bytes and a literal rank map. The map
  is a literal of hashed buckets, because Spark looks a key up in a map by going through it. It merges all
  neighbours of one rank at once, from left to right, which equals merging them one by one if every
  token's own bytes encode to that token (`check_ranks` makes sure). `encode_words` applies it to the distinct words
  of a table.
* `encode` runs over whole texts in Arrow batches: each task folds a distinct word once and remembers it. The
  native form takes about 190 microseconds a distinct word (README), too much for whole corpora, whose
  rare words hardly repeat.

Decoding (`decoded`) looks up the bytes of each id in a literal array and concatenates them, in Spark's
higher-order functions. No text is shuffled.

Defined cases: a null or empty text has no tokens, and decodes to no bytes. Rows are encoded each by itself, so ties and
repeated rows need no rule; an empty table gives no rows. Only the id and text columns are read, so other columns' names cannot clash.
Very long words (a run of one letter) take n log n steps in `encode`.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import documents

OPEN, CLOSE, NEXT = "\ufffe", "\uffff", "\ufdd0"
RANK_BUCKETS = 1 << 15
KNOWN_WORDS = 300_000  # words whose ids a task keeps at hand
#: Published split patterns of which every word is letters, digits or signs after at most one blank, a contraction, or white space.
BLANK_LED = (
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
)
SHORT = 48  # bytes of words that are merged by plain search
#: White space in the sense of the pattern's language; Java's own \s is ASCII only.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]")


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_all(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold for one word on the driver, for `check_ranks` and tests."""
    pieces = [bytes([b]) for b in word]
    while True:
        pairs = [ranks.get(a + b) for a, b in zip(pieces, pieces[1:], strict=False)]
        if not any(r is not None for r in pairs):
            return [ranks[p] for p in pieces]
        best = min(r for r in pairs if r is not None)
        at = pairs.index(best)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]


@cache
def check_ranks(path: str) -> bool:
    """Every byte is a token, and every token's bytes encode to it alone."""
    ranks = load_ranks(path)
    return all(bytes([b]) in ranks for b in range(256)) and all(merge_all(t, ranks) == [r] for t, r in ranks.items())


# ---- literals ----------------------------------------------------------------------------------


def bucket_literal(entries: Iterable[tuple[str, str]], buckets: int) -> Column:
    """array<string> literal: OPEN key CLOSE value, for all keys of one bucket."""
    held: dict[int, list[str]] = defaultdict(list)
    for key, value in entries:
        held[xxhash.xxh64_intdigest(key.encode("utf-8"), 42) % buckets].append(f"{OPEN}{key}{CLOSE}{value}")
    return F.split(F.lit(NEXT.join("".join(held[k]) for k in range(buckets))), NEXT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def looked_up(table: Column, buckets: int, key: Column) -> Column:
    """The value of ``key`` in a bucket literal, else null."""
    # Spark's hash is signed and the driver's is not; their low bits agree
    entry = F.element_at(table, (F.xxhash64(key).bitwiseAND(F.lit(buckets - 1)) + 1).cast("int"))
    tag = F.concat(F.lit(OPEN), key, F.lit(CLOSE))
    cut = lambda text, mark, side: F.call_function("substring_index", text, mark, F.lit(side))
    return let(F.struct(entry.alias("e"), tag.alias("t")), lambda x: F.when(F.contains(x["e"], x["t"]), cut(cut(x["e"], x["t"], -1), F.lit(OPEN), 1)))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    return bucket_literal(((t.decode("latin-1"), str(r)) for t, r in ranks.items()), RANK_BUCKETS)


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """array<string> literal: the bytes of each id, at the id's place."""
    by_id = dict(zip(ranks.values(), ranks, strict=True))
    return F.split(F.lit(NEXT.join(by_id.get(i, b"").decode("latin-1") for i in range(max(by_id) + 1))), NEXT)


# ---- encoding ----------------------------------------------------------------------------------


def folded(word: Column, ranks: Column) -> Column:
    """The ids of a word, joined by blanks."""
    as_bytes = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    rank = lambda piece: looked_up(ranks, RANK_BUCKETS, piece).cast("int")
    apart = lambda pieces: F.concat(F.lit(OPEN), F.array_join(pieces, CLOSE + OPEN), F.lit(CLOSE))
    together = lambda state: F.split(F.substring(state, F.lit(2), F.length(state) - 2), CLOSE + OPEN)

    def merged(state: Column) -> Column:
        over = F.struct(state["text"].alias("text"), F.lit(False).alias("more"))

        def of(pieces: Column) -> Column:
            n = F.size(pieces)
            pairs = F.zip_with(F.slice(pieces, F.lit(1), n - 1), F.slice(pieces, F.lit(2), n - 1), lambda a, b: F.struct(rank(F.concat(a, b)).alias("r"), a.alias("a"), b.alias("b")))
            best = F.array_min(F.filter(pairs, lambda x: x["r"].isNotNull()))

            def put(x: Column) -> Column:
                was = F.concat(F.lit(OPEN), x["a"], F.lit(CLOSE + OPEN), x["b"], F.lit(CLOSE))
                now = F.replace(state["text"], was, F.concat(F.lit(OPEN), x["a"], x["b"], F.lit(CLOSE)))
                return F.when(x.isNull(), over).otherwise(F.struct(now.alias("text"), F.lit(True).alias("more")))

            return F.when(n < 2, over).otherwise(let(best, put))

        return F.when(state["more"], let(together(state["text"]), of)).otherwise(over)

    def by_fold(b: Column) -> Column:
        start = F.struct(F.regexp_replace(b, "(?s)(.)", f"{OPEN}$1{CLOSE}").alias("text"), F.lit(True).alias("more"))
        last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b) - 1)), start, lambda state, _: merged(state))["text"]
        return F.array_join(F.transform(together(last), lambda p: looked_up(ranks, RANK_BUCKETS, p)), " ")

    return let(as_bytes, lambda b: F.coalesce(looked_up(ranks, RANK_BUCKETS, b), by_fold(b)))


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def encode_words(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """word, n (occurrences), ids of the distinct words of a table, by higher-order functions only."""
    if not check_ranks(path):
        raise ValueError(f"{path} is not a proper byte-level vocabulary")
    found = df.select(F.explode(words(F.col(text_col), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.select("word", "n", folded(F.col("word"), rank_literal(load_ranks(path))).alias("ids"))


class Encoder:
    """Ids of texts, as text. Remembers the ids of words and of chunks (what stands between two blanks).

    In `BLANK_LED` patterns a word may start with a blank but holds none behind another character, so a text without two kinds of
    white space in a row falls into chunks at its blanks; other texts, and all texts under other patterns, are matched whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.uneven = regex.compile(r" \s| $" if pattern in BLANK_LED else "").search
        self.words: dict[str, str] = {}
        self.chunks: dict[str, str] = {}

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        if self.uneven(text):
            return self.matched(text)
        known = self.chunks
        first, *parts = text.split(" ")
        out = [self.matched(first)] if first else []
        for part in parts:
            ids = known.get(part)
            if ids is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                ids = known[part] = self.matched(" " + part)
            out.append(ids)
        return " ".join(out)

    def matched(self, text: str) -> str:
        known, out = self.words, []
        for word in self.cut(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                ids = known[word] = " ".join(map(str, self.fold(word.encode("utf-8", "surrogatepass"))))
            out.append(ids)
        return " ".join(out)

    def fold(self, word: bytes) -> list[int]:
        if word in self.ranks:
            return [self.ranks[word]]
        return merge_short(word, self.ranks) if len(word) <= SHORT else merge_by_heap(word, self.ranks)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, pattern: str, ranks: Callable[[], dict[bytes, int]]) -> Encoder:
    """One for each process, so a worker's later tasks know the words of its earlier ones."""
    if (name, pattern) not in _ENCODERS:
        _ENCODERS[name, pattern] = Encoder(ranks(), pattern)
    return _ENCODERS[name, pattern]


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """`merge_all` with the ranks of neighbours at hand: a merge changes at most two of them."""
    none, rank, start = 1 << 62, ranks.get, list(range(len(word) + 1))
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < none:
        at = pairs.index(best)
        del start[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = rank(word[start[at] : start[at + 2]], none)
        if at:
            pairs[at - 1] = rank(word[start[at - 1] : start[at + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(start, start[1:], strict=False)]


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """`merge_all` for long words: pairs wait in a heap by (rank, place); pieces are linked by their ends."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a place
    alive = [True] * n

    def pair(at: int) -> tuple[int, int, int] | None:
        if end[at] >= n:
            return None
        rank = ranks.get(word[at : end[end[at]]])
        return None if rank is None else (rank, at, end[end[at]])

    heap = [x for x in map(pair, range(n)) if x]
    heapq.heapify(heap)
    while heap:
        _, at, upto = heapq.heappop(heap)
        # stale unless both pieces still are what they were
        if not alive[at] or end[at] >= n or end[end[at]] != upto:
            continue
        alive[end[at]] = False
        end[at] = upto
        if upto < n:
            before[upto] = at
        for start in (at, before[at]):
            if start >= 0 and (x := pair(start)):
                heapq.heappush(heap, x)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (joined by blanks) of every row, by the ranks in the file ``path`` and the split ``pattern``.

    The driver alone reads the file; its ranks (as many as the vocabulary has, some MB) are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = encoder(path, pattern, lambda: shared.value)
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype=object)

    coded = documents(df, id_col, text_col).withColumn("ids", F.pandas_udf(encoded, "string")("text"))
    count = F.when(F.col("ids") == "", 0).otherwise(F.octet_length("ids") - F.octet_length(F.replace("ids", F.lit(" "))) + 1)
    return coded.select("doc_id", count.cast("long").alias("n_tokens"), "ids")


# ---- decoding ----------------------------------------------------------------------------------


def decoded(ids: Column, path: str) -> Column:
    """The bytes that ids (joined by blanks) stand for."""
    pieces = piece_literal(load_ranks(path))
    texts = F.transform(F.split(ids, " "), lambda i: F.element_at(pieces, i.cast("int") + 1))
    return F.encode(F.when(ids == "", "").otherwise(F.array_join(texts, "")), "ISO-8859-1")
