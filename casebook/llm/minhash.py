r"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set is its distinct word shingles as 64-bit hashes. Documents with equal
sets (by 128 bits of a hash) form a class; everything below works on classes, so a group of exact copies, however
large, is one class and costs one row.

* Sketch: one hash a shingle; its high bits choose one of the bins (``BANDS`` times the rows of
  a band), the smallest hash of a bin is its value. Empty bins copy the value of the first non-empty
  bin on a probe sequence that depends on (bin, attempt) alone (optimal densification).
* Buckets: classes that agree in all rows of a band. With 40 bands of 8 rows two sets of
  similarity 0.85 share no bucket with a probability of 3e-6 (`rows_of_band`).
* Stars: in a bucket one class, that with the most bucket mates overall, is the centre, and
  edges go from it to the others, so edges grow as the members, not as their square.
  Edges are confirmed on the whole sets.
* What stars leave open: two spokes of a centre that are not in one component yet. The star
  has told in which shingles each differs from the centre; `_meeting` and `_met` join them on the rarest of these, without a text, if what is left of both after that can make a link, which
  loses no link and lets spokes that share the centre's text alone never meet. Members of one component need no further edge, so large groups of near copies stay cheap.

Components come from all confirmed links (`graph.components`).

Defined cases: a text without words, or null, has an empty set, is linked with nothing
and is its own component. With fewer than ``k`` words the whole sequence is the one
shingle. Repeated rows with one id are one document for components and each keeps its row.
A null id is never a component's name unless all ids in it are null. Very long texts are shingled whole. An empty table gives
no rows. `near_duplicates` reads the id and text alone and `one_of_each` carries whole rows in a struct, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casebook.llm.common import documents, written
from casebook.llm.graph import components

BANDS, ROWS = 40, 8
PROBES = 64
MAX_WORDS_KEPT = 200_000  # hashes of words that a task keeps at hand; more only cost time
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, k: int):
        self.k, self.words = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's word shingles."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > MAX_WORDS_KEPT:
            self.words.clear()
        known = self.words
        h = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words), np.uint64, len(words))
        n = max(1, len(h) - self.k + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(self.k, len(h))):
            out = mixed(out * ODD[0] + h[i : i + n])
        return np.unique(out)


@cache
def _probes(n: int) -> np.ndarray:
    """Donor of each (attempt, bin)."""
    x = mixed(np.arange(1, PROBES * n + 1, dtype=np.uint64) * ODD[1])
    return (x % np.uint64(n)).astype(np.int64).reshape(PROBES, n)


def sketch(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The n values of a non-empty sorted set."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # hashes are sorted and bins follow their high bits
    out, full = np.zeros(n, np.uint64), np.zeros(n, bool)
    out[bins[first]], full[bins[first]] = hashes[first], True
    source = np.where(full, np.arange(n), -1)
    for donors in _probes(n):
        empty = np.flatnonzero(source < 0)
        if not len(empty):
            break
        source[empty] = np.where(full[donors[empty]], donors[empty], -1)
    else:
        there, empty = np.flatnonzero(full), np.flatnonzero(source < 0)
        source[empty] = there[np.searchsorted(there, empty) % len(there)]
    return out[source]


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; the band's number is part of it."""
    key = np.arange(1, len(values) // rows + 1, dtype=np.uint64) * ODD[2]
    for column in values.reshape(-1, rows).T:
        key = mixed(key * ODD[0] + column)
    return key


SKETCHED = "n_shingles long, digest binary, bands array<long>"


def _sketched(batches: Iterator[pd.DataFrame], k: int, rows_of_band: int) -> Iterator[pd.DataFrame]:
    shingle = Shingler(k)
    for batch in batches:
        rows = []
        for text in batch["text"]:
            h = shingle(text)
            if len(h):
                rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), bands(sketch(h, BANDS * rows_of_band), rows_of_band).view(np.int64)))
            else:
                rows.append((0, None, None))
        n, digests, bands_of = zip(*rows, strict=True) if rows else ((), (), ())
        yield pd.DataFrame({"id_text": batch["id_text"].to_numpy(), "n_shingles": n, "digest": pd.Series(digests, dtype=object), "bands": pd.Series(bands_of, dtype=object)})


def rows_of_band(percent: int) -> int:
    """So many rows that two sets just similar enough share none of BANDS bands with a probability below 1e-5."""
    return max(1, max((r for r in range(1, ROWS + 1) if (1 - (percent / 100) ** r) ** BANDS < 1e-5), default=1))


COMPARED = "a long, b long, linked boolean, n long, own array<long>, lost array<long>"


def _compared(batches: Iterator[pd.DataFrame], k: int, percent: int) -> Iterator[pd.DataFrame]:
    """Compares whole sets; the last left side's set is kept for the next row."""
    shingle, last, left = Shingler(k), None, None
    for batch in batches:
        out = []
        for a, b, ta, tb in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if a != last:
                last, left = a, shingle(ta)
            right = shingle(tb)
            own, lost = np.setdiff1d(right, left, assume_unique=True), np.setdiff1d(left, right, assume_unique=True)
            n, apart = len(left) + len(right), len(own) + len(lost)
            out.append((a, b, 100 * (n - apart) >= percent * (n + apart), len(right), own.view(np.int64), lost.view(np.int64)))
        yield pd.DataFrame(out, columns=["a", "b", "linked", "n", "own", "lost"])


def compared(edges: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Whether the sets of the classes of each edge (a, b) are similar enough; b's size; the shingles of b alone and those of a alone."""
    right = texts.withColumnsRenamed({"cls": "b", "text": "text_b"})
    left = texts.withColumnsRenamed({"cls": "a", "text": "text_a"})
    return edges.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(partial(_compared, k=k, percent=percent), COMPARED)


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with the component of their ``b``."""
    return rows.join(comps.withColumnsRenamed({"node": "b", "comp": "found"}), "b", "left").withColumn("comp", F.coalesce("found", "b")).drop("found")


def _waiting(spokes: DataFrame, comps: DataFrame) -> DataFrame:
    """The spokes of centres whose spokes are in different components yet."""
    at = _labelled(spokes.select("a", "b", "n", "own", "lost"), comps)
    open_ = at.groupBy("a").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("a")
    return at.join(open_, "a").select("a", "b", "n", "own", "lost")


def _meeting(waiting: DataFrame, percent: int) -> DataFrame:
    """Rows (a, kind, edit, asks, b, n, edits, own_left, lost_left): under which of their edits spokes b of one centre a meet.

    Two members x and y of a bucket are spokes of its centre, and their sets differ in exactly those shingles in which one of them, and not the
    other, differs from the centre (its edits: its own shingles, kind 0, and those of the centre that it lost, kind 1). What the centre has is no key here. With s edits in common
    they differ in edits(x) + edits(y) - 2 s shingles, and linked ones in D at most, which either's size bounds. So (x has no more edits than y) at most D / 2 of x's edits
    and D of y's are not the other's: x asks with its D / 2 + 1 rarest edits, y offers its D + 1 rarest, and the first edit in common, in one order for all spokes of a centre, is among both.
    From there on each has ``own_left`` and ``lost_left`` more edits, which bound s (`_met`). If s is 0, both are linked with the centre and so in one component:
    edits(x) + edits(y) <= D, and were x not linked with it, y would differ from it by less than their sizes do.
    """
    flagged = lambda c, kind: F.transform(c, lambda e: F.struct(e.alias("edit"), F.lit(kind).alias("kind")))
    edits = F.explode(F.concat(flagged("own", 0), flagged("lost", 1))).alias("x")
    each = waiting.select("a", "b", "n", F.size("own").alias("n_own"), (F.size("own") + F.size("lost")).alias("edits"), edits).select("a", "b", "n", "n_own", "edits", "x.*")
    times = each.groupBy("a", "edit").agg(F.count("*").alias("times")).where("times > 1")
    # an edit that no other spoke has comes first and takes a place, but leads nowhere
    rarest = W.partitionBy("a", "b").orderBy("times", "edit").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = each.join(times, ["a", "edit"], "left").withColumn("times", F.coalesce("times", F.lit(1)))
    placed = counted.select("*", F.count("*").over(rarest).alias("place"), F.count(F.when(F.col("kind") == 0, 1)).over(rarest).alias("own_so_far"))
    apart = F.floor(F.col("n") * (100 - percent) / percent)  # D: (1 - t) / (1 + t) of both sizes, of which the other is at most 1 / t of this one
    rows = placed.where((F.col("times") > 1) & (F.col("place") <= apart + 1)).withColumn("own_left", F.col("n_own") - F.col("own_so_far"))
    asks = F.explode(F.when(F.col("place") <= F.floor(apart / 2) + 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("asks")
    return rows.select("a", "kind", "edit", asks, "b", "n", "edits", "own_left", (F.col("edits") - F.col("place") - F.col("own_left")).alias("lost_left"))


def _met(meeting: DataFrame, waiting: DataFrame, comps: DataFrame, percent: int, star: bool) -> DataFrame:
    """The links (a, b) between spokes that meet and are in different components: of who asks with one that offers its edit (``star``), or with all who do."""
    pairs = _pairs(_labelled(meeting, comps), percent, star)
    of = lambda side: waiting.select("a", F.col("b").alias(side), F.col("n").alias(f"n_{side}"), F.concat("own", "lost").alias(f"edits_{side}"))
    n = F.col("n_x") + F.col("n_y")
    apart = F.size("edits_x") + F.size("edits_y") - 2 * F.size(F.array_intersect("edits_x", "edits_y"))
    found = pairs.join(of("x"), ["a", "x"]).join(of("y"), ["a", "y"]).where(100 * (n - apart) >= percent * (n + apart))
    return found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _pairs(rows: DataFrame, percent: int, star: bool) -> DataFrame:
    """The spokes (a, x, y) in different components whose edits, were the one they meet at the first in common, leave room for a link."""
    named = lambda side: [F.col("b").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "edits", "own_left", "lost_left", "comp"))]
    x, y = rows.where("asks").select("a", "kind", "edit", *named("x")), rows.where("not asks").select("a", "kind", "edit", *named("y"))
    if star:  # another one at each edit, so that one far from the others is the centre of few
        y = y.groupBy("a", "kind", "edit").agg(F.min(F.struct(F.xxhash64("edit", "y").alias("by"), *y.columns[3:])).alias("c")).select("a", "kind", "edit", *(f"c.{c}" for c in y.columns[3:]))
    n = F.col("n_x") + F.col("n_y")
    common = 1 + F.least("own_left_x", "own_left_y") + F.least("lost_left_x", "lost_left_y")
    apart = F.col("edits_x") + F.col("edits_y") - 2 * common
    near = (F.col("comp_x") != F.col("comp_y")) & (100 * (n - apart) >= percent * (n + apart))
    near = near if star else near & ((F.col("edits_x") < F.col("edits_y")) | (F.col("edits_x") == F.col("edits_y")) & (F.col("x") < F.col("y")))
    return x.join(y, ["a", "kind", "edit"]).where(near).select("a", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the component), kept, cls for every row.

    Rows are linked if 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles.
    """
    docs = documents(df, id_col, text_col)
    # ids go through pandas as text, where nulls change no other value
    id_type = docs.schema["doc_id"].dataType
    composed = isinstance(id_type, StructType)
    id_text = F.to_json("doc_id") if composed else F.col("doc_id").cast("string")
    named = docs.select(id_text.alias("id_text"), "text").mapInPandas(partial(_sketched, k=k, rows_of_band=rows_of_band(percent)), f"id_text string, {SKETCHED}")
    sketches = written(named.select((F.from_json("id_text", id_type) if composed else F.col("id_text").cast(id_type)).alias("doc_id"), "n_shingles", "digest", "bands"))
    # a class is named by 128 bits of its set and then, in what moves most, by a number that is written once
    sets = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    classes = written(sets.withColumn("cls", F.monotonically_increasing_id()))

    keyed = classes.select("cls", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, "key").select("key", "cls", "n"))
    degree = members.groupBy("cls").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "cls")
    centres = ranked.groupBy("key").agg(F.max(F.struct("degree", "cls"))["cls"].alias("a"))
    stars = written(members.join(centres, "key").where("cls <> a").select("a", F.col("cls").alias("b")).distinct())

    wanted = members.select("cls").distinct().join(classes.select("cls", "digest", "first_id"), "cls")
    # one text a class: rows with the class's first id may hold other texts too if ids repeat, so the class is compared as well
    ids = sketches.select("doc_id", "digest").join(wanted, "digest").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "cls", "digest").distinct()
    texts = written(_texts(docs, ids, k))
    spokes = written(compared(stars, texts, k, percent))
    linked = spokes.where("linked").select("a", "b")
    comps = components(linked)

    waiting = written(_waiting(spokes, comps))
    meeting = written(_meeting(waiting, percent))
    # stars first, so that a group of near copies far from its centre is one component before all that is left is compared
    for star in (True, False):
        further = written(_met(meeting, waiting, comps, percent, star))
        if not further.isEmpty():
            linked = linked.union(further)
            comps = components(linked)

    roots = classes.select("cls", "digest", "first_id").join(comps, classes["cls"] == comps["node"], "left").select("digest", "first_id", F.coalesce("comp", "cls").alias("comp"))
    names = roots.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = roots.join(names, "comp").select("digest", "component_id")
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.hex("digest").alias("cls"))


def _class_of(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Keeps the rows whose text is of the class that is wanted."""
    shingle = Shingler(k)
    for batch in batches:
        ok = [xxhash.xxh3_128_digest(shingle(t).tobytes()) == bytes(d) for t, d in zip(batch["text"], batch["digest"], strict=True)]
        yield batch.loc[ok, ["cls", "text"]]


def _texts(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """cls, text: one text for each wanted class."""
    wanted = ids.withColumnRenamed("doc_id", "_id")
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"])).select("cls", "digest", "text")
    return found.mapInPandas(partial(_class_of, k=k), "cls long, text string").groupBy("cls").agg(F.min("text").alias("text"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that are the first of their component, all columns; rows equal in id and text stay once.

    An id need not name a text: a row goes by its id (null ids last) and two hashes of its text.
    """
    text = F.coalesce(text_col, F.lit(""))
    hashes = (F.xxhash64(text).alias("hash"), F.xxhash64(F.lit("again"), text).alias("again"), F.col(text_col).isNull().alias("no_text"))
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), *hashes)
    keyed = df.select(key.alias("_row"), F.struct("*").alias("_all"))
    firsts = near_duplicates(df.select(key.alias("_row"), F.col(text_col).alias("text")), "_row", "text", k, percent).where("kept").select("doc_id").distinct()
    kept = keyed.join(firsts, keyed["_row"].eqNullSafe(firsts["doc_id"]), "left_semi").dropDuplicates(["_row"])
    return kept.select("_all.*")
