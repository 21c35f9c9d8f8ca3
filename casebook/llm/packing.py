"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Documents longer than the
largest are cut into pieces of it. All pieces are dealt by a hash of (doc_id, piece, length, copy) into shards of
about ``SHARD_ROWS`` (so no shard follows a hot source, a null id or a repeated row, and memory is bounded), and each
shard is packed by itself:

* pieces go, longest first, into the open bin that they leave the least room in;
* if none has room, a bin of the least-cost size that may be opened and holds the piece is opened;
* at last each bin is downsized to the smallest permitted size that holds it.

Which sizes may be opened is chosen jointly for the shard's mix of lengths: every set of up to ``CHOSEN`` of the
permitted sizes is tried (pieces longer than all of a set open the smallest size that holds them), under two readings of least cost, that of the bin and
that of a token in the full bin, and the run whose downsized bins cost the least in total is taken.

Defined cases: a null or empty text has one row with no bin (``bin_id`` null and
``bin_size`` 0). Equal lengths are packed in order of (doc_id as text, piece), nulls first,
so a result depends on the rows only. Repeated rows, null ids and repeated ids are packed each by itself. Very long texts are
cut as all others. An empty table gives no rows. Only the id and text columns are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (1024, 2048, 4096, 8192)
SHARD_ROWS = 4096
CHOSEN = 3
COPIES = 1000  # numbers that one row of a repeated id and length is spread to at a time
#: Tokens that a bin costs beside its own length, such as a kernel launch or a row of the batch.
BIN_OVERHEAD = 96


def bin_cost(size: int) -> float:
    """Cost of a sequence: its length, an overhead, and attention's share that grows with the square."""
    return size + BIN_OVERHEAD + size * size / 65_536


def best_fit(lengths: Sequence[int], open_size: Callable[[int], int]) -> tuple[list[int], list[list[int]]]:
    """Best-fit of ``lengths`` (longest first): the bin of each, and what each bin holds.

    Open bins are found by the room they have left: bit r of ``rooms`` says that some
    bin has room r, so the tightest fit is the lowest bit from the length on.
    """
    by_room: dict[int, list[int]] = {}
    rooms, at, bins = 0, [], []
    for k, n in enumerate(lengths):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = open_size(n), len(bins)
            bins.append([])
        bins[b].append(k)
        at.append(b)
        if room - n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return at, bins


def choices(sizes: Sequence[int], cost: Callable[[int], float]) -> Iterator[Callable[[int], int]]:
    """Every way to open bins: a set of sizes, and whether the bin or a token in it shall cost the least."""
    sizes = sorted(sizes)
    for n in range(1, min(CHOSEN, len(sizes)) + 1):
        for chosen in combinations(sizes, n):
            for least in (cost, lambda s: cost(s) / s):

                def opened(length: int, chosen: tuple = chosen, least: Callable = least) -> int:
                    return min([s for s in chosen if s >= length] or [next(s for s in sizes if s >= length)], key=lambda s: (least(s), -s))

                yield opened


def pack_lengths(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int]]:
    """For lengths in falling order: the bin of each, its offset there, and the size of each bin."""
    sizes = sorted(sizes)
    best, runs = None, set()
    for opened in choices(sizes, cost):
        # what a choice opens for each length tells it apart; many choices come to the same
        opens = {n: opened(n) for n in set(lengths)}
        told = tuple(sorted(opens.items()))
        if told in runs:
            continue
        runs.add(told)
        at, bins = best_fit(lengths, opens.__getitem__)
        final = [next(s for s in sizes if s >= sum(lengths[k] for k in b)) for b in bins]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, at, bins, final)
    if best is None:
        return [], [], []
    _, at, bins, final = best
    offsets = [0] * len(lengths)
    for b in bins:
        used = 0
        for k in b:
            offsets[k] = used
            used += lengths[k]
    return at, offsets, final


def _packed(shard: pd.DataFrame, sizes: Sequence[int]) -> pd.DataFrame:
    shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], na_position="first", kind="stable")
    at, offsets, final = pack_lengths(shard["length"].tolist(), sizes)
    first = int(shard["shard"].iloc[0]) << 32
    return shard[["doc_id", "piece", "start", "length"]].assign(bin_id=[first + b for b in at], bin_size=[final[b] for b in at], bin_offset=offsets)


def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, sizes: Sequence[int] = SIZES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: doc_id, piece, start and length in the document, bin_id, bin_size, bin_offset.

    ``length`` counts a row's tokens; as it is, the bytes of ``text`` (byte-level tokens).
    Only ids and lengths are shuffled.
    """
    largest = max(sizes)
    length = F.octet_length("text") if length is None else length
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / largest).cast("int") - 1)
    shards = max(1, -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // shard_rows))
    # rows equal in id and length are numbered by counts, in two steps, so no array is as long as a group of copies
    times = rows.groupBy("doc_id", "n").agg(F.count("*").alias("times"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = times.select("*", upto(F.ceil(F.col("times") / COPIES)).alias("block"))
    copies = blocks.select("doc_id", "n", "block", upto(F.least(F.lit(COPIES), F.col("times") - F.col("block") * COPIES)).alias("copy"))
    pieces = copies.select("doc_id", "n", "block", "copy", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("start"),
        F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * F.lit(largest).cast("long")).cast("int").alias("length"), "block", "copy",
    )
    shape = "doc_id string, piece int, start long, length int, bin_id long, bin_size int, bin_offset int"
    empty = pieces.where("length = 0").drop("block", "copy").select("*", F.lit(None).cast("long").alias("bin_id"), F.lit(0).alias("bin_size"), F.lit(0).alias("bin_offset"))

    def one_shard(shard: pd.DataFrame) -> pd.DataFrame:
        return _packed(shard, tuple(sizes))

    packed = (
        pieces.where("length > 0")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "block", "copy"), F.lit(shards)))
        .withColumn("doc_id", F.col("doc_id").cast("string"))  # through pandas as text, where nulls change no other value
        .groupBy("shard").applyInPandas(one_shard, shape)
        .withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))
    )
    return packed.unionByName(empty)
