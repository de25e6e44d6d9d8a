"""Content-addressed store of token ids: rolling-hash chunks, document recipes, Merkle manifests.

A store is a folder with two Parquet tables.

segments: one row for each document, files in ascending doc_id order:
    segment, nth     the segment and the row's place in it
    doc_id, n_tokens
    before           ids of the segment's earlier documents
    digests          16 bytes (BLAKE2b) for each chunk, in order
    lengths          little-endian unsigned 32-bit, ids in each chunk
    owners           little-endian bytes, 1: this row holds the chunk, 2: and other recipes use it, 0: another row holds it
    payload          Zstandard frame: little-endian ids (2 or 4 bytes each) of the chunks that this row holds
    root             Merkle root of the digests
manifest: one row for each segment: segment, n_docs, n_tokens, root (Merkle root of the documents' roots).
Each distinct chunk is held once in the whole store, by its first document.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import id_text, materialize, mix, prefix_hash, shared_dir, shuffles, slice_hash, text_blocks
from stepweave.llm.rows import numbered
from stepweave.llm.tokens import encoder, with_end

WINDOW, LEAST, MEAN, MOST = 8, 64, 256, 1024


def chunk_ends(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each document, where its chunks end: after ids whose last WINDOW ids hash to 0 modulo MEAN, LEAST to MOST ids apart."""
    sums = prefix_hash(mix(ids.astype(np.uint64) + np.uint64(1)))
    ends = np.arange(WINDOW, len(ids) + 1)
    hits = ends[(slice_hash(sums, ends - WINDOW, ends) & np.uint64(MEAN - 1)) == 0]
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        cuts, last = [], s
        for h in hits[np.searchsorted(hits, s + WINDOW) : np.searchsorted(hits, e)].tolist():
            while h - last > MOST:
                last += MOST
                cuts.append(last)
            if h - last >= LEAST:
                cuts.append(h)
                last = h
        while e - last > MOST:
            last += MOST
            cuts.append(last)
        if e > last:
            cuts.append(e)
        out.append(np.array(cuts, np.int64))
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_STAGED = "row long, doc_id long, kind int, n_tokens long, digests binary, lengths binary, refs array<long>, payload binary"
_SEGMENTS = "segment long, nth long, doc_id long, n_tokens long, before long, digests binary, lengths binary, owners binary, n_foreign long, n_shared long, payload binary, root binary"


def _staged(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    def encode_rows(batches):
        import zstandard

        squeeze, encode = zstandard.ZstdCompressor(level=1), encoder(tokenizer, False)
        for batch in batches:
            for i, j, raw, at in text_blocks(batch.column(1)):
                ids, at = with_end(*encode(raw, at), end_id)
                data = memoryview(ids.astype(f"<u{width}").tobytes())
                rows: dict[str, list] = {"n": [], "digests": [], "lengths": [], "payload": []}
                for s, e, cuts in zip(at[:-1].tolist(), at[1:].tolist(), chunk_ends(ids, at)):
                    begins = [s, *cuts[:-1].tolist()]
                    rows["n"].append(e - s)
                    rows["digests"].append(b"".join(digest(data[a * width : b * width]) for a, b in zip(begins, cuts.tolist())))
                    rows["lengths"].append((cuts - begins).astype("<u4").tobytes())
                    rows["payload"].append(squeeze.compress(data[s * width : e * width]))
                k = j - i
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(i, k), batch.column(0).slice(i, k), pa.array(np.ones(k, np.int32)), pa.array(rows["n"], pa.int64()), pa.array(rows["digests"], pa.binary()), pa.array(rows["lengths"], pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.array(rows["payload"], pa.binary())],
                    names=["row", "doc_id", "kind", "n_tokens", "digests", "lengths", "refs", "payload"],
                )

    return numbered(id_text(docs)).select("doc_id", "text", "row").mapInArrow(encode_rows, _STAGED)


def _segmented(width: int):
    def cut_rows(batches):
        import zstandard

        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        segment, nth, before, refs, held = TaskContext.get().partitionId(), 0, 0, {}, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    refs, held = {v >> 2: v & 3 for v in r["refs"]}, r["row"]
                    continue
                own = dict(refs) if held == r["row"] else {}
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                owners = np.ones(len(lengths), np.uint8)
                for k, v in own.items():
                    if k < len(owners):
                        owners[k] = v
                payload = r["payload"]
                if (owners == 0).any():
                    data, ends = open_.decompress(payload), np.cumsum(lengths) * width
                    payload = squeeze.compress(b"".join(data[e - n * width : e] for e, n, o in zip(ends.tolist(), lengths.tolist(), owners.tolist()) if o))
                d = r["digests"]
                root = merkle_root([d[i : i + 16] for i in range(0, len(d), 16)])
                rows.append((segment, nth, r["doc_id"], r["n_tokens"], before, d, r["lengths"], owners.tobytes(), int((owners == 0).sum()), int((owners == 2).sum()), payload, root))
                nth += 1
                before += r["n_tokens"]
            if rows:
                kinds = [pa.int64()] * 5 + [pa.binary()] * 3 + [pa.int64()] * 2 + [pa.binary()] * 2
                names = [x.split()[0] for x in _SEGMENTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return cut_rows


def _sealed(segments: DataFrame) -> DataFrame:
    """The manifest that the segments' rows give: segment, n_docs, n_tokens, root."""

    def seal(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        return pa.table({"segment": table["segment"][:1], "n_docs": pa.array([len(table)], pa.int64()), "n_tokens": pa.array([pc.sum(table["n_tokens"]).as_py()], pa.int64()), "root": pa.array([merkle_root(table["root"].to_pylist())], pa.binary())})

    return segments.select("segment", "nth", "n_tokens", "root").groupBy("segment").applyInArrow(seal, "segment long, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, width: int = 2) -> str:
    """Encodes every whole text, appends end_id and writes a store to path.

    A null or empty text has only the end id. Rows that repeat a doc_id are stored as rows of their own, next to each
    other, in the order of their texts' hashes; rows without doc_id come first. An empty table gives a store without rows. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    staged, _ = materialize(_staged(docs, tokenizer, end_id, width), "staged")
    split = F.expr("transform(sequence(0, cast(length(digests) / 16 as int) - 1), k -> named_struct('k', cast(k as long), 'digest', substring(digests, k * 16 + 1, 16)))")
    chunks = staged.select("row", F.explode(split).alias("c")).select("row", "c.k", "c.digest")
    shared = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "k")).alias("owner")).filter("n > 1")
    code = F.when((F.col("owner.row") == F.col("row")) & (F.col("owner.k") == F.col("k")), 2).otherwise(0)
    refs = chunks.join(shared, "digest").select("row", F.expr("k * 4").alias("k4"), code.alias("code")).groupBy("row").agg(F.array_distinct(F.collect_list(F.expr("k4 + code").cast("long"))).alias("refs"))
    refs = refs.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("binary").alias("digests"), F.lit(None).cast("binary").alias("lengths"), "refs", F.lit(None).cast("binary").alias("payload"))
    ordered = refs.unionByName(staged).repartitionByRange(shuffles(spark), "row").sortWithinPartitions("row", "kind")
    ordered.mapInArrow(_segmented(width), _SEGMENTS).write.parquet(f"{path}/segments")

    _sealed(spark.read.parquet(f"{path}/segments")).write.parquet(f"{path}/manifest")
    return path


def _checked(width: int, bases: dict[int, int], with_ids: bool):
    """Rebuilds ids from the row's own payload and the chunks fetched for it; verifies every digest and root."""
    kinds, names = [pa.int64()] * 4 + [pa.binary()] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def rebuild(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own, at = open_.decompress(r["payload"]), 0
                fetched = {x["k"]: x["data"] for x in r.get("fetched") or []}
                lengths, owners, d, parts = np.frombuffer(r["lengths"], "<u4").tolist(), r["owners"], r["digests"], []
                for k, n in enumerate(lengths):
                    if owners[k]:
                        part, at = own[at : at + n * width], at + n * width
                    else:
                        part = fetched.get(k, b"")
                    if digest(part) != d[16 * k : 16 * k + 16]:
                        raise ValueError(f"document {r['doc_id']}: chunk {k} does not match its digest")
                    parts.append(part)
                if merkle_root([d[i : i + 16] for i in range(0, len(d), 16)]) != r["root"]:
                    raise ValueError(f"document {r['doc_id']}: the recipe does not match its root")
                ids = np.frombuffer(b"".join(parts), f"<u{width}")
                if len(ids) != r["n_tokens"]:
                    raise ValueError(f"document {r['doc_id']}: {len(ids)} ids instead of {r['n_tokens']}")
                data = ids.astype("<u4").tobytes()
                out.append((r["doc_id"], bases[r["segment"]] + r["before"], len(ids), zlib.crc32(data), data)[: 4 + with_ids])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rebuild


def read_store(spark: SparkSession, path: str, width: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit) of each document, rebuilt from the files.

    The driver gets one row for each segment, to place the segments one after another and to compare the manifest with the roots of the rows
    that are there; each row's root is then checked against its chunks. Rows whose
    chunks all lie in themselves are rebuilt where they are read; only chunks that several recipes
    share are shuffled, by digest and then by row. A damaged store raises an error.
    """
    segments = spark.read.parquet(f"{path}/segments")
    manifest = {r["segment"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    found = {r["segment"]: r for r in _sealed(segments).collect()}
    if manifest != found:
        raise ValueError(f"segments {sorted(k for k in {*manifest, *found} if manifest.get(k) != found.get(k))} do not match the manifest")
    bases, total = {}, 0
    for k in sorted(manifest):
        bases[k], total = total, total + manifest[k]["n_tokens"]
    result = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    alone = segments.filter("n_foreign = 0").select("segment", "doc_id", "n_tokens", "before", "digests", "lengths", "owners", "payload", "root")

    def lent(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own, at = open_.decompress(r["payload"]), 0
                for k, (n, o) in enumerate(zip(np.frombuffer(r["lengths"], "<u4").tolist(), r["owners"])):
                    if o == 2:
                        out.append((r["digests"][16 * k : 16 * k + 16], own[at : at + n * width]))
                    at += n * width if o else 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["digest", "data"])

    chunks = segments.filter("n_shared > 0").select("digests", "lengths", "owners", "payload").mapInArrow(lent, "digest binary, data binary")
    parted = segments.filter("n_foreign > 0")
    wants = parted.select("segment", "nth", F.explode(F.expr("filter(transform(sequence(0, length(owners) - 1), k -> named_struct('k', k, 'own', substring(owners, k + 1, 1) <> X'00', 'digest', substring(digests, k * 16 + 1, 16))), x -> not x.own)")).alias("w")).select("segment", "nth", "w.k", "w.digest")
    fetched = wants.join(chunks, "digest").groupBy("segment", "nth").agg(F.collect_list(F.struct(F.col("k"), F.col("data"))).alias("fetched"))
    joined = parted.join(fetched, ["segment", "nth"], "left").select("segment", "doc_id", "n_tokens", "before", "digests", "lengths", "owners", "payload", "root", "fetched")
    return alone.mapInArrow(_checked(width, bases, with_ids), result).unionByName(joined.mapInArrow(_checked(width, bases, with_ids), result))


def store_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes a store into the shared folder and returns what reading it back gives, without the ids."""
    path = write_store(docs, tokenizer, f"{shared_dir(docs.sparkSession)}/stepweave-store-{uuid.uuid4().hex}", end_id)
    return read_store(docs.sparkSession, path, with_ids=False)
