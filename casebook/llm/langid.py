"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a tree of byte contexts is counted on labelled rows: all contexts of up to ``ORDER`` bytes that
were seen at least ``MIN_SEEN`` times, so how long a context gets varies (order 0 is always there). A byte is coded from the longest context in
the tree that ends where it starts. A context that has seen q different bytes in n gives a byte seen c times c / (n + q), and
escapes to the next shorter context with q / (n + q) (method C). After an escape the bytes that the longer
context has seen are excluded from the counts, so the probabilities of all bytes sum to one and the lengths are those of
an exact code; below order 0 all bytes not seen at all are alike. The code length of a text under a
language's frozen counts is the sum of -log2 of these probabilities; the language with the
shortest code wins, and the score is its posterior under equal priors, 1 / sum of 2 ** (shortest - length).

Every labelled row counts, whole. Counts are summed by Spark; of a language's strings of ORDER + 1 bytes those stay that are at least one in ``RARE`` of all its bytes,
so what comes to the driver, and is broadcast, is at most ``RARE`` strings a language, whatever the table's size. Bounds (`calibrated`) are medians over all labelled rows, from counts of rates.
Trees are sparse (sorted arrays of contexts and of strings), over all 256 bytes and any number of languages. What a byte costs depends on it and
the ``ORDER`` bytes before it alone, so a batch codes each different string of ORDER + 1 bytes once. Every text is scored whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Ties go to
the first language by name. Without any labelled row every text is ``und``. Repeated rows get equal results. Very long texts are
coded in blocks of ``BLOCK`` bytes with the bytes before as context. An empty table gives no rows. Only the id, text and language columns are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.llm.common import documents, written

ORDER = 4
MIN_SEEN = 2
RARE = 1 << 23
HELD = 1 << 20  # different strings that a task counts before it gives them out
RATE_STEPS = 1024  # steps of a bit in which rates are counted
BLOCK = 1 << 20
UNKNOWN = "und"
SLACK = 64


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """For looking at what was learnt (`fit` and `calibrated` take every row): the ``rows`` different texts of each lang with the smallest hashes (lang, text)."""
    hashed = labelled.select("lang", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit("again"), "text").alias("again"))
    first = W.partitionBy("lang").orderBy("hash", "again")
    # the rank is limited within each task before hashes are shuffled; what is broadcast is rows x languages hashes, less than the model
    least = hashed.distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows).drop("k")
    wanted = least.withColumnsRenamed({"lang": "_lang", "hash": "_hash", "again": "_again"})
    same = (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_hash")) & (F.xxhash64(F.lit("again"), "text") == F.col("_again"))
    return labelled.join(F.broadcast(wanted), same, "left_semi").dropDuplicates(["lang", "text"])


def _codes(raw: np.ndarray) -> np.ndarray:
    """Every string of ORDER + 1 bytes as a number, first byte highest."""
    n = len(raw) - ORDER
    out = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        out = (out << 8) | raw[k : k + n]
    return out


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of all byte strings of ORDER + 1 bytes, texts led in by ORDER zero bytes; of one string several counts may come."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def counted(lang: str, pieces: list[np.ndarray]) -> None:
        code, n = np.unique(np.concatenate(pieces), return_counts=True)
        if lang in held:
            code, at = np.unique(np.concatenate([held[lang][0], code]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([held[lang][1], n]), minlength=len(code)).astype(np.int64)
        held[lang] = code, n

    def given() -> Iterator[pd.DataFrame]:
        if held:
            yield pd.concat([pd.DataFrame({"lang": lang, "code": code, "n": n}) for lang, (code, n) in held.items()])
        held.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            pieces, size = [], 0
            for t in texts:
                raw = np.frombuffer(b"\0" * ORDER + t.encode("utf-8", "surrogatepass"), np.uint8)
                for at in range(0, len(raw) - ORDER, BLOCK):
                    pieces.append(_codes(raw[at : at + BLOCK + ORDER]))
                    size += len(pieces[-1])
                    if size >= BLOCK:
                        counted(lang, pieces)
                        pieces, size = [], 0
            if pieces:
                counted(lang, pieces)
        if sum(len(code) for code, _ in held.values()) > HELD:
            yield from given()
    yield from given()


class Tree:
    """One language's contexts of each order with their counts, shortest first.

    ``strings[k]`` are the context-and-byte strings of k + 1 bytes with their counts, ``contexts[k]`` those of k bytes that are in
    the tree. For each context: n + q (``whole``), q (``kinds``), and the same of the next shorter context
    without the bytes that this one has seen (``rest``, ``rest_kinds``).
    """

    def __init__(self, code: np.ndarray, n: np.ndarray):
        self.strings, self.counts, self.contexts, self.whole, self.kinds, self.rest, self.rest_kinds = ([] for _ in range(7))
        levels = []
        for k in range(ORDER + 1):
            strings, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            levels.append((strings, np.bincount(at, weights=n, minlength=len(strings)).astype(np.int64)))
        for k, (strings, counts) in enumerate(levels):
            contexts, at = np.unique(strings >> 8, return_inverse=True)
            seen, kinds = np.bincount(at, weights=counts, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
            if k:  # what the next shorter context has besides this one's bytes
                below = levels[k - 1]
                held = below[1][np.searchsorted(below[0], strings & ((1 << 8 * k) - 1))]
                up = np.searchsorted(self._all, contexts & ((1 << 8 * (k - 1)) - 1))
                rest_kinds = self._kinds[up] - kinds
                rest = self._seen[up] - np.bincount(at, weights=held, minlength=len(contexts)) + rest_kinds
            else:
                rest_kinds, rest = 256 - kinds, 256 - kinds
            self._all, self._seen, self._kinds = contexts, seen, kinds
            stay = seen >= (MIN_SEEN if k else 0)
            self.strings.append(strings[stay[at]])
            self.counts.append(counts[stay[at]])
            for name, x in (("contexts", contexts), ("whole", seen + kinds), ("kinds", kinds), ("rest", rest), ("rest_kinds", rest_kinds)):
                getattr(self, name).append(x[stay])

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of ORDER + 1 bytes after the others."""
        bits = np.zeros(len(code))
        todo = np.arange(len(code))  # what is not coded yet
        over = np.full(len(code), -1.0)  # n + q at the next context, where an escape has led there
        kinds = np.zeros(len(code))
        for k in range(ORDER, -1, -1):
            context, string = (code[todo] >> 8) & ((1 << 8 * k) - 1), code[todo] & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            there = self.contexts[k][at] == context
            todo, at, string = todo[there], at[there], string[there]
            of = np.minimum(np.searchsorted(self.strings[k], string), len(self.strings[k]) - 1)
            coded = self.strings[k][of] == string
            first = over[todo] < 0
            n, q = np.where(first, self.whole[k][at], over[todo]), np.where(first, self.kinds[k][at], kinds[todo])
            bits[todo[coded]] += np.log2(n[coded]) - np.log2(self.counts[k][of[coded]])
            left = ~coded
            bits[todo[left]] += np.where(q[left] > 0, np.log2(np.maximum(n[left], 1)) - np.log2(np.maximum(q[left], 1)), 0)
            over[todo[left]], kinds[todo[left]] = self.rest[k][at[left]], self.rest_kinds[k][at[left]]
            over[todo[coded]] = np.inf  # done
            todo = np.flatnonzero(~np.isinf(over))
        bits[todo] += np.log2(np.maximum(over[todo], 1))
        return bits


class Model:
    """Frozen counts of each language; trees are made once a worker."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        self.grams = [grams[k] for k in self.langs]
        self._trees: list[Tree] | None = None

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "grams": self.grams, "_trees": None}

    def trees(self) -> list[Tree]:
        if self._trees is None:
            self._trees = [Tree(code, n) for code, n in self.grams]
        return self._trees

    def lengths(self, texts: Sequence[str], lang: str | None = None) -> np.ndarray:
        """Code length in bits of each whole text under each language (or one of them, as a single column)."""
        trees = self.trees() if lang is None else [self.trees()[self.langs.index(lang)]]
        out = np.zeros((len(texts), len(trees)))
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        held, size = [], 0
        for k, raw in enumerate(raws):
            for at in range(0, len(raw), BLOCK):
                piece = b"\0" * max(0, ORDER - at) + raw[max(0, at - ORDER) : at + BLOCK]
                if size + len(piece) > BLOCK and held:
                    self._add(out, held, trees)
                    held, size = [], 0
                held.append((k, piece))
                size += len(piece)
        if held:
            self._add(out, held, trees)
        return out

    def _add(self, out: np.ndarray, pieces: list[tuple[int, bytes]], trees: list[Tree]) -> None:
        """Adds what the pieces, each led in by ORDER bytes, cost."""
        sizes = np.array([len(p) for _, p in pieces])
        codes = _codes(np.frombuffer(b"".join(p for _, p in pieces), np.uint8))
        ends = np.cumsum(sizes)
        own = np.ones(len(codes) + ORDER, bool)  # strings that begin in one piece and end in the next count for none
        for k in range(ORDER):
            own[ends - 1 - k] = False
        of, known = pd.factorize(codes[own[: len(codes)]])
        rows = np.repeat([k for k, _ in pieces], sizes - ORDER)
        for lang, tree in enumerate(trees):
            out[:, lang] += np.bincount(rows, weights=tree.costs(known)[of], minlength=len(out))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows of ``df`` with a text and a language."""
    labelled = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and text <> '' and lang is not null")
    counted = written(labelled.mapInPandas(_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counted.join(F.broadcast(total), "lang").where(F.col("n") * RARE >= F.col("total")).select("lang", "code", "n").toArrow()  # columns: as Python rows they would take twenty times the memory
    grams = {}
    for lang in often["lang"].unique().to_pylist():
        of = often.filter(pc.equal(often["lang"], lang))
        code, n = of["code"].to_numpy(), of["n"].to_numpy()
        order = np.argsort(code)
        grams[lang] = code[order], n[order]
    return Model(grams)


@cache
def _has_letter():
    import regex

    return regex.compile(r"\p{L}").search


def posterior(lengths: np.ndarray) -> tuple[int, float]:
    best = int(np.argmin(lengths))
    return best, float(1 / np.exp2(np.clip(lengths[best] - lengths, -1000, 0)).sum())


def predict(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column of struct<lang_pred: string, score: double>, for ``df.select``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, letter = shared.value, _has_letter()
        for texts in batches:
            rows = [(UNKNOWN, 0.0)] * len(texts)
            known = [k for k, t in enumerate(texts) if t is not None and m.langs and letter(t)]
            for k, lengths in zip(known, m.lengths([texts.iloc[k] for k in known]), strict=True):
                best, score = posterior(lengths)
                rows[k] = (m.langs[best], score)
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predicted(text_col)


@cache
def _words():
    import regex

    return regex.compile(r"(?<![\p{L}\p{N}_])\p{L}+(?![\p{L}\p{N}_])").findall, regex.compile(r"\p{L}+").findall


def _letters(text: str) -> str:
    """The words of letters alone; if there is none, the runs of letters."""
    words, runs = _words()
    return " ".join(words(text) or runs(text))


def _shuffled(text: str) -> str:
    """The text's characters in random order."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(0).permutation(letters).tobytes().decode("utf-32-le", "surrogatepass")


def calibrated(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language bits a byte halfway between its labelled rows and the same rows with their letters in random order (medians of all rows, to one step of ``RATE_STEPS``)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = []
            for lang, texts in batch.groupby("lang")["text"]:
                words = [w for w in map(_letters, texts) if w] if lang in m.langs else []
                sizes = np.array([len(w.encode("utf-8", "surrogatepass")) for w in words])
                for mixed, change in ((False, str), (True, _shuffled)) if words else ():
                    bits = m.lengths([change(w) for w in words], lang)[:, 0] / sizes
                    out.append(pd.DataFrame({"lang": lang, "mixed": mixed, "rate": np.round(bits * RATE_STEPS).astype(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({"lang": [], "mixed": [], "rate": []})

    labelled = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    found: dict[str, dict[bool, list[tuple[int, int]]]] = defaultdict(lambda: {False: [], True: []})
    for r in labelled.mapInPandas(rates, "lang string, mixed boolean, rate long").groupBy("lang", "mixed", "rate").count().collect():  # a rate has few bits, so few rows
        found[r["lang"]][r["mixed"]].append((r["rate"], r["count"]))

    def median(counts: list[tuple[int, int]]) -> float:
        rate, n = (np.array(x) for x in zip(*sorted(counts), strict=True))
        ends = np.cumsum(n)
        return sum(float(rate[np.searchsorted(ends, k, side="right")]) for k in ((ends[-1] - 1) // 2, ends[-1] // 2)) / 2 / RATE_STEPS

    return {lang: (median(of[False]) + median(of[True])) / 2 for lang, of in found.items()}


def explained(df: DataFrame, model: Model, bounds: dict[str, float], text_col: str = "text") -> Column:
    """Whether a text has a letter and, if any language was learnt, its words' shortest code is within that language's bound.

    ``SLACK`` bits more are allowed, so a few words too short to tell stay. Texts are tried as written, then in lower case.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def within(m: Model, words: list[str]) -> list[bool]:
        sizes = (len(w.encode("utf-8", "surrogatepass")) for w in words)
        return [bool(own.min() <= bounds.get(m.langs[int(np.argmin(own))], np.inf) * n + SLACK) for own, n in zip(m.lengths(words), sizes, strict=True)]

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, letter = shared.value, _has_letter()
        for texts in batches:
            ok = [t is not None and letter(t) is not None for t in texts]
            asked = [k for k, x in enumerate(ok) if x and m.langs]
            for change in (str, str.lower):  # as written, then in lower case
                for k, x in zip(asked, within(m, [change(_letters(texts.iloc[k])) for k in asked]), strict=True):
                    ok[k] = x
                asked = [k for k in asked if not ok[k]]
            yield pd.Series(ok, dtype=bool)

    return kept(text_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, text, held_out, lang_pred, score of every row, learnt from the rows that are not held out."""
    docs = documents(df, id_col, text_col, lang_col)
    model = fit(docs.where(~held_out()), "text", lang_col)
    return docs.select("doc_id", "text", held_out().alias("held_out"), predict(docs, model).alias("p")).select("doc_id", "text", "held_out", "p.*")
