"""Evidence bundles: events, raw payloads, a hash for each, a chain over the hashes, and a signature.

Hashes are computed where the rows are, in Spark; a bundle in one piece (`build`) holds at most ``BUNDLE_EVENTS``
events, so what comes to the driver to be chained and signed is bounded. Cases of any size are sealed
and verified in Spark (`sealed`, `sign_cases`, `verify_cases`); only one row a case comes to the driver. An event's canonical bytes are its
JSON with sorted keys and no blanks.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.errors import ValidationError
from casebook.functions import ed25519
from casebook.functions.hashing import blake3, blake3_hex, sha256
from casebook.functions.text import rfc3339_text
from casebook.operators.export import attach
from casebook.plans.storage import cut
from casebook.schema import BUNDLE_EVENTS

ALGORITHMS: dict[str, tuple[Callable[[Column], Column], Callable[[bytes], str]]] = {
    "SHA-256": (sha256, lambda raw: hashlib.sha256(raw).hexdigest()),
    "BLAKE3": (blake3, blake3_hex),
}
FORMAT = "1.0"
RANGE = 4096
SEAL = "case_id string, n_events long, n_files long, root_hash string"


def canonical(events: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(events.columns)), {"ignoreNullFields": "false"})


def integrity(case_events: DataFrame, events: DataFrame, raw: DataFrame, algorithm: str = "SHA-256") -> DataFrame:
    """case_id, pos, path, hash_hex, size_bytes: event, raw, event, raw, ... in order of attachment.

    ``raw`` has raw_event_id and content (binary).
    """
    hashed = ALGORITHMS[algorithm][0]
    place = F.row_number().over(W.partitionBy("case_id").orderBy("added_at", "event_id")) - 1
    placed = case_events.select("case_id", "event_id", "added_at").withColumn("n", place)
    texts = events.select("event_id", "raw_event_id", canonical(events).cast("binary").alias("bytes"))
    own = placed.join(texts, "event_id")
    files = own.select("case_id", (F.col("n") * 2).alias("pos"), F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), "bytes")
    payloads = own.drop("bytes").join(raw.select("raw_event_id", F.col("content").alias("bytes")), "raw_event_id")
    payloads = payloads.select("case_id", (F.col("n") * 2 + 1).alias("pos"), F.concat(F.lit("raw/"), F.col("raw_event_id").cast("string"), F.lit(".bin")).alias("path"), "bytes")
    return files.unionByName(payloads).select("case_id", "pos", "path", hashed(F.col("bytes")).alias("hash_hex"), F.octet_length("bytes").cast("long").alias("size_bytes"))


def root(records: DataFrame) -> DataFrame:
    """case_id, n_files, root_hash: SHA-256 of the hashes in order, one string."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "hash_hex")))
    joined = F.array_join(F.transform(ordered, lambda x: x["hash_hex"]), "")
    return records.groupBy("case_id").agg(F.count("*").alias("n_files"), sha256(joined).alias("root_hash"))


def sealed(case_events: DataFrame, records: DataFrame) -> DataFrame:
    """case_id, n_events, n_files, root_hash of every case, whatever its size: hashes are folded in ranges of pos, then the ranges' hashes in ranges, until one is left."""
    level = records.select("case_id", "pos", "hash_hex")
    counts = case_events.groupBy("case_id").agg(F.count("*").alias("n_events"))
    sizes = records.groupBy("case_id").agg(F.count("*").alias("n_files"))
    most = records.agg(F.max("pos")).first()[0]
    while most is not None:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "hash_hex")))
        joined = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["pos"].cast("string"), x["hash_hex"])), ",")
        level = level.groupBy("case_id", F.expr(f"pos div {RANGE}").alias("range")).agg(sha256(joined).alias("hash_hex")).withColumnRenamed("range", "pos")
        most = most // RANGE or None
    roots = level.select("case_id", F.col("hash_hex").alias("root_hash"))
    return counts.join(sizes, "case_id", "left").join(roots, "case_id", "left").select("case_id", "n_events", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("root_hash", F.lit("")).alias("root_hash"))


def sign_cases(seals: DataFrame, seed: bytes) -> DataFrame:
    """``seals`` with signature_hex. Only one short row a case comes to the driver, where the seed is."""
    rows = [(*r, ed25519.sign(seed, _dumped(r.asDict())).hex()) for r in seals.toLocalIterator()]
    return seals.sparkSession.createDataFrame(rows, f"{SEAL}, signature_hex string")


def verify_cases(case_events: DataFrame, events: DataFrame, raw: DataFrame, records: DataFrame, signed: DataFrame, public_key: bytes, algorithm: str = "SHA-256") -> DataFrame:
    """case_id, n_events, n_files, n_mismatched, integrity_valid, chain_valid, signature_valid of every whole case.

    Every event and payload is hashed again in Spark and held against ``records``; one that is gone
    or is too many counts as mismatched. The roots are folded again from the new hashes.
    """
    now = cut(integrity(case_events, events, raw, algorithm))
    wanted = records.select("case_id", "pos", F.struct("path", "hash_hex", "size_bytes").alias("old"))
    found = now.select("case_id", "pos", F.struct("path", "hash_hex", "size_bytes").alias("new"))
    apart = wanted.join(found, ["case_id", "pos"], "full").groupBy("case_id").agg(F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("n_mismatched"))
    seals = sealed(case_events, now)
    names = seals.columns
    both = signed.join(seals.select("case_id", *(F.col(c).alias(f"now_{c}") for c in names[1:])), "case_id", "full").join(apart, "case_id", "left")
    rows = []
    for r in both.toLocalIterator():  # one short row a case
        missing = 2 * (r["n_events"] or 0) - (r["n_files"] or 0)  # two files for each event
        n, same = (r["n_mismatched"] or 0) + abs(missing), all(r[c] == r[f"now_{c}"] for c in names[1:])
        good = r["signature_hex"] is not None and ed25519.verify(public_key, _dumped({c: r[c] for c in names}), bytes.fromhex(r["signature_hex"]))
        rows.append((r["case_id"], r["now_n_events"] or 0, r["now_n_files"] or 0, n, n == 0, same, good))
    return records.sparkSession.createDataFrame(rows, "case_id string, n_events long, n_files long, n_mismatched long, integrity_valid boolean, chain_valid boolean, signature_valid boolean")


def _dumped(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def build(case_id: str, case_name: str, case_events: DataFrame, events: DataFrame, raw: DataFrame, seed: bytes, generated_at: str, algorithm: str = "BLAKE3") -> dict:
    """A signed bundle of one case."""
    case_events = case_events.where(F.col("case_id") == case_id)
    n = case_events.limit(BUNDLE_EVENTS + 1).count()
    if n > BUNDLE_EVENTS:
        raise ValidationError(f"a bundle holds at most {BUNDLE_EVENTS} events")
    own = attach(case_events.select("event_id"), events)
    hashed = ALGORITHMS[algorithm][1]
    attach(own.select(F.col("raw_event_id").alias("event_id")), raw.select(F.col("raw_event_id").alias("event_id")))
    records = [{"path": r["path"], "hash_algorithm": algorithm, "hash_hex": r["hash_hex"], "size_bytes": r["size_bytes"]} for r in integrity(case_events, events, raw, algorithm).orderBy("pos").collect()]
    order = {r["event_id"]: k for k, r in enumerate(case_events.orderBy("added_at", "event_id").select("event_id").collect())}
    rows = sorted(own.select("event_id", "raw_event_id", canonical(events).alias("json")).collect(), key=lambda r: order[r["event_id"]])
    wanted = own.select("raw_event_id").distinct()
    contents = {r["raw_event_id"]: bytes(r["content"]) for r in raw.join(wanted, "raw_event_id", "left_semi").collect()}
    span = own.agg(rfc3339_text(F.min("occurred_at")).alias("start"), rfc3339_text(F.max("occurred_at")).alias("end")).first()
    manifest = {
        "bundle_version": FORMAT, "case_id": case_id, "case_name": case_name, "event_count": len(rows),
        "time_range": span.asDict() if rows else None, "generated_at": generated_at, "generator": "casebook",
    }
    raw_manifest = _dumped(manifest)
    records.append({"path": "manifest.json", "hash_algorithm": algorithm, "hash_hex": hashed(raw_manifest), "size_bytes": len(raw_manifest)})
    hashes = [r["hash_hex"] for r in records]
    chain = {"algorithm": algorithm, "file_hashes": hashes, "root_hash": hashed("".join(hashes).encode())}
    return {
        "manifest": manifest, "events": [r["json"] for r in rows],
        "raw_events": [{"raw_event_id": r["raw_event_id"], "content_hash": hashed(contents[r["raw_event_id"]]), "content_base64": base64.b64encode(contents[r["raw_event_id"]]).decode()} for r in rows],
        "integrity": records, "chain": chain,
        "signature": {"algorithm": "Ed25519", "signature_hex": ed25519.sign(seed, _dumped(chain)).hex(), "public_key_hex": ed25519.public_key(seed).hex()},
        "public_key": {"algorithm": "Ed25519", "public_key_hex": ed25519.public_key(seed).hex()},
    }


def verify(bundle: dict, strict: bool = False) -> dict:
    """integrity_valid, chain_valid, signature_valid and details. ``strict`` also checks the manifest, the keys and the raw records."""
    chain, records, details = bundle["chain"], bundle["integrity"], []
    hashed = ALGORITHMS[chain["algorithm"]][1]
    chain_ok = hashed("".join(chain["file_hashes"]).encode()) == chain["root_hash"]
    details.append("chain root hash verified" if chain_ok else "chain root hash mismatch")
    sound = [r["hash_hex"] for r in records] == chain["file_hashes"]
    details.append(f"all {len(records)} file records match the chain" if sound else "file records do not match the chain")

    def agree(what: str, raw: bytes, expected: str | None) -> None:
        nonlocal sound
        if expected is not None and hashed(raw) != expected:
            sound = False
            details.append(f"hash mismatch at {what}")

    for k, text in enumerate(bundle["events"]):
        agree(f"event {k}", text.encode(), records[2 * k]["hash_hex"] if 2 * k < len(records) else None)
    for k, entry in enumerate(bundle["raw_events"]):
        try:
            raw = base64.b64decode(entry["content_base64"], validate=True)
        except ValueError:
            sound = False
            details.append(f"raw {k} is not base64")
            continue
        agree(f"raw {k}", raw, entry["content_hash"])
        if strict:
            agree(f"raw record {k}", raw, records[2 * k + 1]["hash_hex"])
    signature = bundle["signature"]
    if strict:
        agree("manifest", _dumped(bundle["manifest"]), records[-1]["hash_hex"] if records else "")
        if signature["public_key_hex"] != bundle["public_key"]["public_key_hex"]:
            sound = False
            details.append("the signature has another public key")
    try:
        if signature["algorithm"] != "Ed25519":
            raise ValidationError(f"unknown algorithm {signature['algorithm']!r}")
        signed = ed25519.verify(bytes.fromhex(signature["public_key_hex"]), _dumped(chain), bytes.fromhex(signature["signature_hex"]))
        details.append("signature verified" if signed else "signature invalid")
    except (ValueError, ValidationError) as e:
        signed = False
        details.append(f"signature error: {e}")
    return {"integrity_valid": sound, "chain_valid": chain_ok, "signature_valid": signed, "details": details}
