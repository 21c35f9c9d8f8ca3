"""Removal of repeated byte strings with a sparse suffix array.

Every byte that is covered by a ``LENGTH``-byte window that also starts earlier (smaller id,
or same document and earlier start) is removed. A full suffix array would hold a suffix a byte;
this one holds only suffixes that start at *anchors*, chosen by content so that no
match is lost: of the ``GRAM``-byte strings in a window the one with the smallest hash (the
leftmost, of equals) is the window's anchor, so equal windows have equal anchors at equal
places. Each window belongs to one anchor, each anchor owns a run of windows, its span.

1. Which suffixes can match at all: hashes of the suffixes' grams are range-partitioned and compared with their neighbours; those that are alone
   go no further. Hashes only choose what is looked at.
2. The other suffixes go on as bytes: what follows their anchor, and what precedes it in the span. They are range-partitioned by
   their leading bytes (`repartitionByRange` samples the splitters) into buckets of about ``BUCKET`` rows, and each bucket is sorted by multikey quicksort
   (`multikey_quicksort`): by the first word of all suffixes, then the next word among those that are still equal, and so on.
   Of equal spans all but the first are removed whole. Where suffixes share a gram but spans differ, single windows decide: equal hashes propose,
   bytes decide, and of equal windows all but the first are removed.
3. Across boundaries: the grams at both ends of a bucket may go on in the next one, so the windows that are first in their bucket there are
   grouped once more, by their bytes.

Step 1 combines within a task before anything is shuffled: of spans of a task that are equal in bytes only the first can be the first of all, and
the others are removed at once. So a passage in a third of all documents sends one row a task. A hot suffix is
split between buckets by what precedes its anchor.

Defined cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose none. Very long texts are handled whole.
Rows equal in id and text are one document; other texts under an id, or under none, are documents of
their own. Ids of any type that can be ordered serve; a null id comes first. An empty table gives no rows. Only the id and text columns are read, so
other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from casebook.llm.common import documents, written
from casebook.llm.minhash import mixed

LENGTH, GRAM = 100, 32
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = -(1 << 63)
FLUSH = 1_000_000  # rows that a task holds before it combines and emits them
BUCKET = 25_000
LOW = (1 << 7) - 1
RIGHT, LEFT = 104, 72  # a span has at most 100 bytes from its anchor on, and 68 before it
CHUNK = 20_000  # rows whose bytes are compared at a time


class Powers:
    """BASE ** i and BASE ** -i modulo 2 ** 64, as far as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Hashed:
    """Hashes of substrings of one text."""

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(raw, np.uint8)
        up, self.down = POWERS(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTES[self.raw] * up[: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.raw) - length + 1
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over every w neighbours, from prefixes and suffixes of blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, fill, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(text: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """position, first window, last window and gram hash of each anchor of a text of LENGTH bytes or more."""
    h, w = text.all(GRAM), LENGTH - GRAM + 1
    least = sliding(h, w, np.minimum, (1 << 64) - 1)
    n = len(least)
    around = np.zeros(n + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + n] = least
    chosen = np.flatnonzero(sliding(around, w, np.maximum, 0)[: len(h)] == h)
    at = np.searchsorted(chosen, np.arange(n))
    while len(wrong := np.flatnonzero(h[chosen[at]] != least)):
        at[wrong] += 1
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    position = chosen[at[first]]
    return position, first, last, h[position]


def runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [start, end), at least one, merged where they touch within a document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    step = np.r_[True, doc[1:] != doc[:-1]]
    part = np.cumsum(step) << 40  # keeps documents apart while the farthest end so far is taken
    reach = np.maximum.accumulate(end + part) - part
    at = np.flatnonzero(step | np.r_[True, start[1:] > reach[:-1]])
    return doc[at], start[at], reach[np.r_[at[1:] - 1, len(doc) - 1]]


# A row of step 1 is a suffix (gram, span, doc, packed) or, with packed null, an interval to remove (doc, start, end).
# packed holds a suffix's position, how many of its windows start before it, and how many windows it has.
ROW = {"gram": "long", "span": "long", "doc": "long", "packed": "long", "start": "long", "end": "long"}
SHARED = {"doc": "long", "packed": "long", "start": "long", "end": "long"}
FOUND = "window binary, doc long, start long, end long"


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def _rows(columns: dict[str, str], **given: np.ndarray) -> pd.DataFrame:
    """A batch with nulls in the columns that are not given."""
    n = len(next(iter(given.values())))
    return pd.DataFrame({c: pd.array(given[c], "Int64") if c in given else pd.array([None] * n, "Int64") for c in columns})


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes that deal intervals out evenly."""
    return mixed(doc.astype(np.uint64) * np.uint64(BASE) + start.astype(np.uint64)).view(np.int64)


def _bounds(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of what the windows of suffixes cover."""
    start = (packed >> 14) - ((packed >> 7) & LOW)
    return start, start + (packed & LOW) - 1 + LENGTH


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes of ``raw`` from a on are those from b on, for each of many."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), CHUNK):
        part = slice(at, at + CHUNK)
        n = length[part]
        k = np.arange(n.max(initial=0))
        inside = k < n[:, None]
        x, y = (np.minimum(s[part][:, None] + k, len(raw) - 1) for s in (a, b))
        out[part] = ((raw[x] == raw[y]) | ~inside).all(1)
    return out


def _combined(raws: list[bytes], held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
    """Of spans of one task that are equal in bytes only the first goes on; the others are intervals already."""
    gram, span, doc, packed, base = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((packed, doc, span, gram))
    gram, span, doc, packed, base = (x[order] for x in (gram, span, doc, packed, base))
    new = np.r_[True, (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])]
    repeat = ~new & np.r_[False, (doc[1:] == doc[:-1]) & (packed[1:] == packed[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    start, end = _bounds(packed)
    rest = np.flatnonzero(~new & ~repeat)
    alike = ((packed[rest] ^ packed[first[rest]]) & ((1 << 14) - 1)) == 0
    text = np.frombuffer(b"".join(raws), np.uint8)
    alike[alike] = same_bytes(text, (base + start)[rest[alike]], (base + start)[first[rest[alike]]], (end - start)[rest[alike]])
    gone = rest[alike]
    keep = ~repeat
    keep[gone] = False
    yield _rows(ROW, gram=gram[keep], span=span[keep], doc=doc[keep], packed=packed[keep])
    if len(gone):
        doc, start, end = runs(doc[gone], start[gone], end[gone])
        spread = _spread(doc, start)
        yield _rows(ROW, gram=spread, span=spread, doc=doc, start=start, end=end)


def _suffixes(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    held, raws, size, rows, drop = [], [], 0, 0, np.uint64(64 - bits)
    for batch in batches:
        for doc, text in zip(batch["doc"], batch["text"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(raw) < LENGTH:
                continue
            t = Hashed(raw)
            position, first, last, gram = anchors(t)
            packed = position << 14 | (position - first) << 7 | (last - first + 1)
            span = mixed(t(first, last + LENGTH) + (packed & ((1 << 14) - 1)).astype(np.uint64))
            n = len(position)
            held.append(((gram >> drop).view(np.int64), (span >> drop).view(np.int64), np.full(n, doc, np.int64), packed, np.full(n, size)))
            raws.append(raw)
            size, rows = size + len(raw), rows + n
            if rows > FLUSH:
                yield from _combined(raws, held)
                held, raws, size, rows = [], [], 0, 0
    if held:
        yield from _combined(raws, held)


def _sharing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted partition: the intervals, and the suffixes that share their gram with another one (those at its ends may)."""
    names = ["gram", "span", "doc", "packed"]
    last = None  # the last suffix, not emitted yet, and whether it is known to share its gram
    shares_last = True
    for batch in batches:
        cut = batch[batch["packed"].isna()]
        if len(cut):
            yield cut[["doc", "packed", "start", "end"]]
        x = batch.loc[batch["packed"].notna(), names].to_numpy(np.int64)
        if not len(x):
            continue
        if last is not None:
            x = np.vstack([last, x])
        x = x[np.r_[True, (x[1:] != x[:-1]).any(1)]]  # rows of a repeated document
        shares = np.zeros(len(x), bool)
        same = x[1:, 0] == x[:-1, 0]
        shares[1:] |= same
        shares[:-1] |= same
        shares[0] |= shares_last
        last, shares_last = x[-1:], shares[-1]
        out = x[:-1][shares[:-1]]
        if len(out):
            yield _rows(SHARED, doc=out[:, 2], packed=out[:, 3])
    if last is not None:
        yield _rows(SHARED, doc=last[:, 2], packed=last[:, 3])


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each suffix as bytes: from its anchor to its span's end, and from the span's start to the anchor."""
    for batch in batches:
        out = []
        for doc, text, suffixes in zip(batch["doc"], batch["text"], batch["suffixes"], strict=True):
            raw, packed = text.encode("utf-8", "surrogatepass"), np.unique(np.asarray(suffixes, np.int64))
            for at, start, end in zip((packed >> 14).tolist(), *(x.tolist() for x in _bounds(packed)), strict=True):
                out.append((raw[at:end], raw[start:at], doc, start))
        yield pd.DataFrame(out, columns=["suffix", "left", "doc", "start"])


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of zero-padded words, first byte highest."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.zeros((len(parts), width), np.uint8)
    at = np.cumsum(n) - n
    out[np.repeat(np.arange(len(parts)), n), np.arange(n.sum()) - np.repeat(at, n)] = np.frombuffer(b"".join(parts), np.uint8)
    return out.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and how many leading words each row in it shares with the one before.

    All runs of rows that are equal so far are sorted by their next word at once; rows that are alone are done.
    """
    n, width = words.shape
    order, run, shared, active = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n if n > 1 else 0)
    for depth in range(width):
        if not len(active):
            break
        word, of = words[order[active], depth], run[active]
        by = np.argsort(word, kind="quicksort")
        by = by[np.argsort(of[by], kind="stable")]
        order[active], word = order[active[by]], word[by]
        inside = np.r_[False, of[1:] == of[:-1]]
        apart = np.r_[True, word[1:] != word[:-1]] | ~inside
        shared[active[apart & inside]] = depth
        first = np.flatnonzero(apart)
        sizes = np.diff(np.r_[first, len(active)])
        run[active] = np.repeat(active[first], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
    shared[active[run[active] != active]] = width
    return order, shared


def repeated(window: np.ndarray, doc: np.ndarray, start: np.ndarray, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Which windows have equal bytes with an earlier one; ``window``: hashes, ``at``: where their bytes are in ``raw``."""
    out = np.zeros(len(window), bool)
    by = np.argsort(window, kind="quicksort")
    same = window[by][1:] == window[by][:-1]
    by = by[np.r_[False, same] | np.r_[same, False]]
    if not len(by):
        return out
    by = by[np.lexsort((start[by], doc[by], window[by]))]
    new = np.r_[True, window[by][1:] != window[by][:-1]]
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    later = ~new
    alike = same_bytes(raw, at[by[later]], at[first[later]], np.full(later.sum(), LENGTH))
    out[by[later]] = alike
    if not alike.all():  # different bytes under one hash: those groups go by their bytes
        doubtful = np.isin(window[by], window[by[later][~alike]])
        seen: set[bytes] = set()
        for k in by[doubtful]:  # earliest first
            x = raw[at[k] : at[k] + LENGTH].tobytes()
            out[k] = x in seen
            seen.add(x)
    return out


def _bucket(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Intervals of the repeats within a bucket, and the windows at its ends that are first in it."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    suffix, left = rows["suffix"].map(bytes).tolist(), rows["left"].map(bytes).tolist()
    sizes = np.fromiter((len(a) << 8 | len(b) for a, b in zip(suffix, left, strict=True)), np.uint64, len(rows))
    words = np.hstack([_matrix(suffix, RIGHT), _matrix(left, LEFT), sizes[:, None]])
    order, shared = multikey_quicksort(words)
    doc, start = rows["doc"].to_numpy()[order], rows["start"].to_numpy()[order]
    n = ((sizes >> np.uint64(8)) + (sizes & np.uint64(255))).astype(np.int64)[order]
    equal = np.cumsum(shared < words.shape[1])  # runs of equal spans
    by = np.lexsort((start, doc, equal))
    new = np.r_[True, equal[by][1:] != equal[by][:-1]]
    rest = by[~new]
    if len(rest):
        d, a, b = runs(doc[rest], start[rest], start[rest] + n[rest])
        yield pd.DataFrame({"window": None, "doc": d, "start": a, "end": b})
    gram = np.cumsum(shared < GRAM // 8)
    kept = by[new]
    times = np.bincount(gram[kept])
    ends = (gram == gram[0]) | (gram == gram[-1])
    kept = kept[(times[gram[kept]] > 1) | ends[kept]]
    spans = [left[k] + suffix[k] for k in order[kept]]
    text = Hashed(b"".join(spans))
    base, many = np.cumsum(n[kept]) - n[kept], n[kept] - LENGTH + 1
    of = np.repeat(np.arange(len(kept)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, w_doc, w_start = base[of] + step, doc[kept][of], start[kept][of] + step
    window = text(at, at + LENGTH) >> np.uint64(64 - bits)
    again = repeated(window, w_doc, w_start, at, text.raw)
    if again.any():
        d, a, b = runs(w_doc[again], w_start[again], w_start[again] + LENGTH)
        yield pd.DataFrame({"window": None, "doc": d, "start": a, "end": b})
    open_ = np.flatnonzero(~again & ends[kept][of])
    for k in range(0, len(open_), CHUNK):
        some = open_[k : k + CHUNK]
        yield pd.DataFrame({"window": [text.raw[x : x + LENGTH].tobytes() for x in at[some]], "doc": w_doc[some], "start": w_start[some], "end": w_start[some] + LENGTH})


def _later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Intervals, and of equal windows of a sorted partition all but the first."""
    last = None
    for batch in batches:
        alone = batch["window"].isna().to_numpy()
        window = [None if a else bytes(w) for a, w in zip(alone, batch["window"], strict=True)]
        same = np.array([a or b == c for a, b, c in zip(alone, window, [last, *window[:-1]], strict=True)], bool)
        last = window[-1] if window else last
        out = batch.loc[same, ["doc", "start", "end"]]
        if len(out):
            doc, start, end = runs(*(out[c].to_numpy(np.int64) for c in out))
            yield pd.DataFrame({"doc": doc, "start": start, "end": end})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, cuts in zip(batch["text"], batch["cuts"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if cuts is None or not len(cuts):
                out.append((len(raw), 0, 0, raw))
                continue
            _, start, end = runs(np.zeros(len(cuts), np.int64), np.array([c["start"] for c in cuts]), np.array([c["end"] for c in cuts]))
            kept = b"".join(raw[a:b] for a, b in zip(np.r_[0, end], np.r_[start, len(raw)], strict=True))
            out.append((len(raw), len(raw) - len(kept), len(start), kept))
        yield pd.concat([batch[["doc"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])], axis=1)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` (doc, text) with a number of its own for each id and text, in order of ids, and (_number, _name) of these; whole numbers that name one text each stay as they are."""
    text = F.coalesce("text", F.lit(""))
    marks = F.struct(F.xxhash64(text).alias("hash"), F.xxhash64(F.lit("again"), text).alias("again"), F.col("text").isNull().alias("no_text"))
    marked = docs.select("doc", marks.alias("mark"))
    if isinstance(docs.schema["doc"].dataType, IntegralType) and marked.groupBy("doc").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").isEmpty():
        return docs.select(F.coalesce(F.col("doc").cast("long"), F.lit(NO_ID)).alias("doc"), "text"), None
    ordered = marked.distinct().repartitionByRange("doc", "mark").sortWithinPartitions("doc", "mark")
    names = written(ordered.select(F.monotonically_increasing_id().alias("_number"), F.col("doc").alias("_name"), F.col("mark").alias("_mark")))
    own = docs.withColumn("_own", marks)
    own = own.join(names, own["doc"].eqNullSafe(names["_name"]) & (own["_own"] == names["_mark"])).select(F.col("_number").alias("doc"), "text")
    return own, names.select("_number", "_name")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) of every row. ``bits`` of the hashes are used."""
    id_type = df.select(F.col(id_col)).schema[0].dataType
    docs, names = _numbered(documents(df, id_col, text_col).withColumnRenamed("doc_id", "doc"))
    suffixes = written(docs.mapInPandas(partial(_suffixes, bits=bits), _ddl(ROW)))
    near = written(suffixes.repartitionByRange("gram", "span").sortWithinPartitions("gram", "span", "doc", "packed").mapInPandas(_sharing, _ddl(SHARED)))
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-near.where("packed is not null").count() // bucket))
    shared = near.where("packed is not null").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("packed").alias("suffixes"))
    # both joins read the same shuffle of ``docs``, so texts are moved once
    spans = docs.join(shared, docs["doc"] == shared["_doc"]).select("doc", "text", "suffixes").dropDuplicates(["doc"]).mapInPandas(_spans, "suffix binary, left binary, doc long, start long")
    found = spans.repartitionByRange(buckets, "suffix", "left").mapInPandas(partial(_bucket, bits=bits), FOUND)
    later = found.repartition(F.when(F.col("window").isNull(), F.xxhash64("doc", "start")).otherwise(F.xxhash64("window"))).sortWithinPartitions("window", "doc", "start").mapInPandas(_later, "doc long, start long, end long")
    cuts = near.where("packed is null").select("doc", "start", "end").unionByName(later)
    cuts = cuts.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    found = docs.join(cuts, docs["doc"] == cuts["_doc"], "left").select("doc", "text", "cuts").mapInPandas(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    if names is not None:
        return found.join(names, found["doc"] == names["_number"]).select(F.col("_name").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
    return found.select(F.nullif("doc", F.lit(NO_ID)).cast(id_type).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
