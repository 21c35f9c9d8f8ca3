"""Plain definitions that the operators are held against."""

import struct

from casebook.functions.hashing import CHUNK_END, CHUNK_START, COLUMNS_THEN_DIAGONALS, IV, PARENT, PERMUTATION, ROOT

BLOCK, CHUNK, MASK = 64, 1024, 0xFFFFFFFF

def greedy(events, pattern) -> list[list]:
    """Events are (occurred_at, id, event_type) of one partition in order."""
    from casebook.functions.text import glob_matches

    out, start = [], 0
    while start < len(events) and pattern.steps:
        if not glob_matches(pattern.steps[0].event_type_pattern, events[start][2]):
            start += 1
            continue
        at = [start]
        for step in pattern.steps[1:]:
            k = next((j for j in range(at[-1] + 1, len(events)) if glob_matches(step.event_type_pattern, events[j][2])), None)
            if k is None or (step.max_gap_secs is not None and (events[k][0] - events[at[-1]][0]).total_seconds() > step.max_gap_secs):
                break
            at.append(k)
        if len(at) == len(pattern.steps) and (events[at[-1]][0] - events[at[0]][0]).total_seconds() <= pattern.max_total_duration_secs:
            out.append([events[k][1] for k in at])
            start = at[-1] + 1
        else:
            start += 1
    return out


# ---- BLAKE3, block by block ----------------------------------------------------------------------


def compress(chain: tuple, block: bytes, counter: int, flags: int) -> tuple:
    m = struct.unpack("<16I", block.ljust(BLOCK, b"\0"))
    v = [*chain, *IV[:4], counter & MASK, counter >> 32, len(block), flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(COLUMNS_THEN_DIAGONALS):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & MASK
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << (32 - r1)) & MASK
                v[c] = (v[c] + v[d]) & MASK
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << (32 - r2)) & MASK
        m = tuple(m[i] for i in PERMUTATION)
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def chunk(data: bytes, counter: int, root: int) -> tuple:
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
    chain = IV
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        chain = compress(chain, block, counter, CHUNK_START * (k == 0) | (CHUNK_END | root) * last)
    return chain


def tree(data: bytes, counter: int, root: int) -> tuple:
    if len(data) <= CHUNK:
        return chunk(data, counter, root)
    left = CHUNK << ((len(data) - 1) // CHUNK).bit_length() - 1
    sides = tree(data[:left], counter, 0) + tree(data[left:], counter + left // CHUNK, 0)
    return compress(IV, struct.pack("<16I", *sides), 0, PARENT | root)


def blake3_plain(data: bytes) -> str:
    return struct.pack("<8I", *tree(data, 0, ROOT)).hex()


# ---- CSV, line by line ---------------------------------------------------------------------------


def csv_plain(payload):
    """(found, custom) of each line but the headers; None for a payload without lines."""
    import csv
    import io

    from casebook.sources.parsers import CSV_HEADERS

    column_of = {h: c for c, headers in CSV_HEADERS.items() for h in headers}
    lines = [x for x in csv.reader(io.StringIO(payload or "", newline=""), strict=False) if x]
    if not lines:
        return None
    out = []
    for line in lines[1:]:
        found, custom = {}, {}
        for header, cell in zip(lines[0], line, strict=False):
            if cell := cell.strip():
                column = column_of.get(header.lower().strip())
                (found if column else custom)[column or header] = cell
        out.append((found, custom))
    return out
