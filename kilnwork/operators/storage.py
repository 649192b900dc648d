"""Content-addressed storage: chunking, refcounts, sweeps, checks and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.columns import BASE32, digest
from kilnwork.plans.membership import blocks_for, build_filter, fits_broadcast, possible
from kilnwork.plans.stored import in_tasks, stored, tasks_for


@cache
def gear() -> np.ndarray:
    """A 64-bit number for each byte, from the sha256 of its value."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "big") for b in range(256)], dtype=np.uint64)


def rolling(data: bytes) -> np.ndarray:
    """The gear hash at each byte, over the 16 bytes up to it: sums of shifted gear numbers, four doublings."""
    h = gear()[np.frombuffer(data, dtype=np.uint8)].copy()
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8):
            h[k:] += h[:-k] << np.uint64(k)
    return h


def cut_points(data: bytes, least: int, avg: int, most: int) -> list[int]:
    """Ends of content-defined chunks of least to most bytes, the last one of any size up to most.

    A cut lies where the hash has zeros under a mask that is two bits
    stricter before the average size and two bits looser after it.
    """
    if not data:
        return []
    bits = max(1, avg.bit_length() - 1)
    # the high bits of a 16-byte sum of shifted numbers depend on all 16 bytes
    top = rolling(data) >> np.uint64(16)
    strict = np.flatnonzero(top & np.uint64((1 << (bits + 2)) - 1) == 0) + 1
    loose = np.flatnonzero(top & np.uint64((1 << max(1, bits - 2)) - 1) == 0) + 1
    ends, start, n = [], 0, len(data)
    while n - start > least:
        i, stop = int(np.searchsorted(strict, start + least)), min(n, start + avg)
        end = int(strict[i]) if i < len(strict) and strict[i] <= stop else 0
        if not end:
            j, stop = int(np.searchsorted(loose, max(start + avg, start + least))), min(n, start + most)
            end = int(loose[j]) if j < len(loose) and loose[j] <= stop else stop
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk(df: DataFrame, ident: str, data: str, least: int = 16_384, avg: int = 65_536, most: int = 262_144) -> DataFrame:
    """``id, idx, offset, size, bytes`` of the content-defined chunks of a binary column.

    Equal content gives equal chunks; their concatenation is the content. Null
    and empty values have no chunk. One blob is worked on at a time.
    """
    if not 0 < least <= avg <= most:
        raise ValueError("chunk sizes must rise")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                blob = value.as_py() or b""
                ends = cut_points(blob, least, avg, most)
                starts = [0, *ends[:-1]] if ends else []
                if ends:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key.as_py()] * len(ends), batch.schema.field(0).type),
                            pa.array(range(len(ends)), pa.int32()),
                            pa.array(starts, pa.int64()),
                            pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                            pa.array([blob[a:b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        ],
                        ["id", "idx", "offset", "size", "bytes"],
                    )

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, data).mapInArrow(cut, f"id {kind}, idx int, offset long, size long, bytes binary")


def chunk_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def _once(entries: DataFrame) -> DataFrame:
    """``blob_id, chunk_id, size`` of each distinct blob and hash, with its greatest size."""
    return in_tasks(entries.select("blob_id", "chunk_id", "size"), "blob_id", "chunk_id").groupBy("blob_id", "chunk_id").agg(F.max("size").alias("size"))


def references(entries: DataFrame) -> DataFrame:
    """``blob_id, chunk_id``, each once."""
    return in_tasks(entries.select("blob_id", "chunk_id"), "blob_id", "chunk_id").distinct()


def apply_manifests(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """``chunks`` after blobs were added: one reference a distinct hash and blob, new rows, deleted ones back.

    ``needs_upload`` marks referenced chunks that were never uploaded.
    """
    added = _once(entries).groupBy("chunk_id").agg(F.count("*").alias("__add"), F.max("size").alias("__size"))
    both = chunks.join(added, "chunk_id", "full_outer")
    used = F.col("__add").isNotNull()
    return both.select(
        "chunk_id",
        F.coalesce("size", "__size").alias("size"),
        (F.coalesce("refcount", F.lit(0)) + F.coalesce("__add", F.lit(0))).alias("refcount"),
        (F.coalesce("deleted", F.lit(False)) & ~used).alias("deleted"),
        (used & ~F.coalesce("uploaded", F.lit(False))).alias("needs_upload"),
    )


def audit_refcounts(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """``chunk_id, stored, counted`` where the stored count differs from the blobs counted, or is negative."""
    counted = references(entries).groupBy("chunk_id").agg(F.count("*").alias("counted"))
    both = chunks.select("chunk_id", F.col("refcount").alias("stored")).join(counted, "chunk_id", "full_outer")
    zero = both.select("chunk_id", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return zero.filter("stored <> counted or stored < 0")


def sweep(chunks: DataFrame, entries: DataFrame, removed: DataFrame) -> DataFrame:
    """``chunks`` after blobs went: one reference less a distinct hash and blob, ``zeroed`` at 0 and then deleted."""
    gone = references(entries.join(removed.select("blob_id"), "blob_id", "left_semi"))
    less = gone.groupBy("chunk_id").agg(F.count("*").alias("__less"))
    joined = chunks.join(less, "chunk_id", "left")
    left = F.greatest(F.col("refcount") - F.coalesce("__less", F.lit(0)), F.lit(0))
    zeroed = F.col("__less").isNotNull() & (left == 0) & ~F.col("deleted")
    return joined.select("chunk_id", "size", left.alias("refcount"), (F.col("deleted") | zeroed).alias("deleted"), zeroed.alias("zeroed"))


def sweep_stats(swept: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: blobs removed, chunks and bytes freed; all that a dry run returns."""
    freed = swept.filter("zeroed").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return removed.agg(F.count("*").alias("blobs")).crossJoin(freed)


def delete_paths(paths: DataFrame, owners: DataFrame, realisations: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, owners, realisations) without the removed paths and what points at them."""
    ids = removed.select("path_id")
    return tuple(df.join(ids, "path_id", "left_anti") for df in (paths, owners, realisations))


def enqueue_deletes(zeroed: DataFrame, pending: DataFrame) -> DataFrame:
    """``pending`` and the chunks that are not in it yet, each once, with 0 attempts."""
    fresh = zeroed.select("chunk_id").distinct().join(pending, "chunk_id", "left_anti").withColumn("attempts", F.lit(0))
    return pending.select("chunk_id", "attempts").unionByName(fresh)


def drain(pending: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pending chunks that are still dead; one without a row is."""
    return pending.join(chunks.filter("refcount > 0 and not deleted").select("chunk_id"), "chunk_id", "left_anti")


def orphan_chunks(chunks: DataFrame, grace_secs: int = 300) -> DataFrame:
    return chunks.filter((F.col("refcount") == 0) & ~F.col("deleted") & (F.col("age_secs") > grace_secs))


def reap_stale(manifests: DataFrame, idle_hours: Column, hours: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(manifests left, stale ones): uploads that were not touched for a while."""
    stale = (F.col("manifest_status") == "uploading") & (idle_hours > hours)
    return manifests.filter(~stale), manifests.filter(stale)


def verify_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """One row: live chunks scanned, and how many have no stored bytes."""
    live = chunks.filter("refcount > 0 and not deleted")
    held = store.select("chunk_id").distinct().withColumn("__held", F.lit(1))
    return live.join(held, "chunk_id", "left").agg(F.count("*").alias("scanned"), (F.count("*") - F.count("__held")).alias("missing"))


def verify_bytes(stored: DataFrame) -> DataFrame:
    """Rows whose bytes don't match their hash; null bytes don't."""
    return stored.filter(~chunk_hash(F.col("bytes")).eqNullSafe(F.col("chunk_hash")))


def reassemble(entries: DataFrame, stored: DataFrame, declared: DataFrame) -> DataFrame:
    """``blob_id, size, content_hash, fault`` of each declared blob put together from its chunks in order.

    Faults: missing chunk, size, hash, else null. Chunks are dealt by blob,
    sorted, and hashed as they pass, so a blob of any size is never held whole;
    its hash takes one task. Without all of its chunks a blob is empty.
    """
    kind = entries.schema["blob_id"].dataType.simpleString()

    def digest_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row(blob, found):
            md5, size, lost = found
            return (blob, 0 if lost else size, lost, hashlib.md5(b"").hexdigest() if lost else md5.hexdigest())

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [blobs, pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["of", "size", "lost", "hash"])

        blobs = pa.null()
        for batch in batches:
            blobs, out, data = batch.schema.field("blob_id").type, [], batch.column("bytes")
            for i, blob in enumerate(batch.column("blob_id").to_pylist()):
                if state is None or blob != now:
                    if state is not None:
                        out.append(row(now, state))
                    now, state = blob, [hashlib.md5(), 0, 0]
                part = data[i].as_buffer() if data[i].is_valid else None
                if part is None:
                    state[2] += 1
                else:
                    state[0].update(part)
                    state[1] += part.size
            yield rows(out)
        if state is not None:
            yield rows([row(now, state)])

    joined = entries.select("blob_id", "idx", "chunk_hash").join(stored.select("chunk_hash", "bytes"), "chunk_hash", "left")
    ordered = joined.select("blob_id", "idx", "bytes").repartition("blob_id").sortWithinPartitions("blob_id", "idx")
    built = declared.join(ordered.mapInArrow(digest_blobs, f"of {kind}, size long, lost long, hash string"), F.col("blob_id") == F.col("of"), "left")
    size, found = F.coalesce("size", F.lit(0)), F.coalesce("hash", F.lit(hashlib.md5(b"").hexdigest()))
    fault = F.when(F.col("lost") > 0, "missing chunk").when(size != F.col("declared_size"), "size").when(found != F.col("declared_hash"), "hash")
    return built.select("blob_id", size.alias("size"), found.alias("content_hash"), fault.alias("fault"))


def verify_blobs(blobs: DataFrame, declared: DataFrame, algo: str = "md5") -> DataFrame:
    """``path_id, fault`` of declared blobs: absent, size or hash."""
    joined = declared.join(blobs, "path_id", "left")
    fault = (
        F.when(F.col("content").isNull(), "absent")
        .when(F.octet_length("content") != F.col("declared_size"), "size")
        .when(digest(F.col("content"), algo) != F.col("declared_hash"), "hash")
    )
    return joined.select("path_id", fault.alias("fault")).filter("fault is not null")


def scan_refs(blobs: DataFrame, candidates: DataFrame, size: int = 32) -> DataFrame:
    """``path_id, hash_part``: which candidate tokens occur in each content, each once.

    Runs of the base-32 alphabet are cut into windows of a token's size. A
    filter of the candidates, where it is within a broadcast's bound, lets few
    windows pass that are none, before anything is shuffled; those left meet
    the candidates in a join. Candidates may be of any number.
    """
    tokens = candidates.select("hash_part")
    blocks = blocks_for(tokens.count())
    runs = blobs.select("path_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(f"([{BASE32}]{{{size},}})"), F.lit(1)))).alias("run"))
    windows = runs.select("path_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - size + 1), lambda i: F.substr("run", i, F.lit(size)))).alias("hash_part"))
    if fits_broadcast(blocks):
        windows = possible(windows, "hash_part", build_filter(tokens, "hash_part", blocks), blocks)
    return windows.distinct().join(tokens, "hash_part", "left_semi").select("path_id", "hash_part")


def dedup_report(entries: DataFrame) -> DataFrame:
    """``chunk_id, blobs, saved_bytes`` of chunks that several blobs share: what storing them once saves."""
    shared = _once(entries).groupBy("chunk_id").agg(F.count("*").alias("blobs"), F.max("size").alias("size"), F.sum("size").alias("all"))
    return shared.filter("blobs > 1").select("chunk_id", "blobs", (F.col("all") - F.col("size")).alias("saved_bytes"))


def _classes_and_members(entries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(``blob_id, class_id``; ``chunk_id, class_id, head, n``; tasks): both stored, ``n`` classes hold the chunk and ``head`` is the least.

    Every shuffle deals to the same number of tasks, about a million entries
    each. Joins hash the side with one row a key and stream the other, so a key
    of very many rows takes no memory.
    """
    tasks = tasks_for(entries)
    once = entries.select("blob_id", "chunk_id").repartition(tasks, "blob_id", "chunk_id").distinct()
    held = once.repartition(tasks, "blob_id").groupBy("blob_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("held"))
    sets = stored(held.select("blob_id", "held", F.unhex(F.sha2(F.array_join("held", ","), 256)).alias("key")))
    keys = sets.select("blob_id", "key").repartition(tasks, "key")
    several = keys.groupBy("key").agg(F.min("blob_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    classes = stored(keys.join(several.hint("shuffle_hash"), "key", "left").select("blob_id", F.coalesce("least", "blob_id").alias("class_id")))
    copies = classes.filter("blob_id <> class_id").select("blob_id").repartition(tasks, "blob_id")
    kept = sets.filter("blob_id is not null").select("blob_id", "held").repartition(tasks, "blob_id").join(copies.hint("shuffle_hash"), "blob_id", "left_anti")
    rows = kept.select(F.explode("held").alias("chunk_id"), F.col("blob_id").alias("class_id")).repartition(tasks, "chunk_id")
    heads = rows.groupBy("chunk_id").agg(F.min("class_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    return classes, stored(rows.join(heads.hint("shuffle_hash"), "chunk_id")), tasks


def shared_chunks(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``blob_id, class_id``; ``chunk_id, class_id``; ``class_id, head, shared``): which blobs share chunks, without pairs.

    Blobs of equal chunk sets are one class, named by its least blob. The
    second part has the members of each chunk that several classes hold. The
    third links each class to the least class of each of its chunks, with the
    number of chunks they meet in: classes joined by shared chunks are joined
    by these links. All parts have as many rows as ``entries`` at most, however
    many classes hold a chunk. ``shared_counts`` gives the number of any pair.
    """
    classes, members, tasks = _classes_and_members(entries)
    links = members.filter("class_id <> head").select("class_id", "head").repartition(tasks, "class_id", "head")
    return classes, members.select("chunk_id", "class_id"), links.groupBy("class_id", "head").agg(F.count("*").alias("shared"))


#: Holders of a chunk that one row lists, pairs of classes that one task counts, and pairs that one task sends there, about.
BLOCK, TASK_PAIRS, SENT_PAIRS = 1024, 1_000_000, 16_000_000


def shared_pairs(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``blob_id, class_id``; ``a, b, shared``): every pair of classes that share a chunk, with the number of chunks that both hold.

    Blobs of equal chunk sets are one class, as in ``shared_chunks``; no chunk
    is left out, however many classes hold it. The pairs are the result, so they
    grow with the square of a chunk's classes. Lists of its holders travel, of
    about ``BLOCK`` each, and pairs are formed where all of a class's lists
    meet, so no pair is shuffled. A chunk of several lists is dealt by two of
    them, and a class of more than ``TASK_PAIRS`` pairs by parts of its partners.
    """
    classes, members, tasks = _classes_and_members(entries)
    number = members.agg(F.sum(F.expr("n - 1"))).first()[0] or 0  # each pair of a chunk's classes twice
    counting, sending = number // (2 * TASK_PAIRS) + 1, max(tasks, number // (2 * SENT_PAIRS) + 1)
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = members.select("chunk_id", "class_id", blocks.alias("blocks"), F.pmod(F.xxhash64("class_id"), blocks).alias("block")).repartition(sending, "chunk_id", "block")
    lists = dealt.groupBy("chunk_id", "block", "blocks").agg(F.sort_array(F.collect_list("class_id")).alias("held"))
    within = lists.select("held", F.posexplode("held").alias("at", "a")).select("a", F.slice("held", F.col("at") + 2, F.size("held")).alias("held"))
    several, places = lists.filter("blocks > 1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = several.select("chunk_id", F.col("block").alias("i"), F.col("held").alias("mine"), places.alias("j")).filter("i <> j")
    right = several.select("chunk_id", F.col("block").alias("j"), "held", places.alias("i")).filter("i <> j")
    met = left.repartition(sending, "chunk_id", "i", "j").join(right.repartition(sending, "chunk_id", "i", "j").hint("shuffle_hash"), ["chunk_id", "i", "j"])
    across = met.select(F.explode("mine").alias("a"), "held").select("a", F.filter("held", lambda b: b > F.col("a")).alias("held"))
    # classes of very many pairs are fewer than twice the tasks that count
    wide = members.select(F.col("class_id").alias("a"), "n").repartition(tasks, "a").groupBy("a").agg((F.sum(F.expr("n - 1")) / TASK_PAIRS).cast("long").alias("more")).filter("more > 0")
    found = within.unionAll(across).filter(F.size("held") > 0).join(F.broadcast(wide), "a", "left").withColumn("more", F.coalesce("more", F.lit(0).cast("long")))
    parts = found.select("a", "held", "more", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more"))).alias("part"))
    own = F.when(F.col("more") == 0, F.col("held")).otherwise(F.filter("held", lambda b: F.pmod(F.xxhash64(b), F.col("more") + 1) == F.col("part")))
    pairs = parts.select("a", "part", own.alias("held")).repartition(counting, "a", "part").select("a", "part", F.explode("held").alias("b"))
    return classes, pairs.groupBy("a", "part", "b").agg(F.count("*").alias("shared")).select("a", "b", "shared")


def shared_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, shared`` for the pairs of classes that are asked for: the number of chunks that both hold."""
    of_a = pairs.join(members.select(F.col("class_id").alias("a"), "chunk_id"), "a")
    both = of_a.join(members.select(F.col("class_id").alias("b"), "chunk_id"), ["b", "chunk_id"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("shared"))


def upload_plan(outputs: DataFrame, complete: DataFrame) -> DataFrame:
    """``path_id, action`` of each output: skip if a complete path has the same hash, else upload."""
    there = complete.select("path_id", F.col("nar_hash").alias("__hash"))
    joined = outputs.join(there, "path_id", "left")
    return joined.select("path_id", F.when(F.col("__hash") == F.col("nar_hash"), "skip").otherwise("upload").alias("action"))


def claim(requests: DataFrame, manifests: DataFrame, stale_hours: float = 0.25) -> DataFrame:
    """``path_id, worker, verdict``: complete, concurrent (held by a fresh upload or by the least worker), owned."""
    first = requests.groupBy("path_id").agg(F.min("worker").alias("__first"))
    joined = requests.join(first, "path_id").join(manifests.select("path_id", "manifest_status", "idle_hours"), "path_id", "left")
    held = (F.col("manifest_status") == "uploading") & (F.col("idle_hours") <= stale_hours)
    verdict = F.when(F.col("manifest_status") == "complete", "complete").when(held | (F.col("worker") != F.col("__first")), "concurrent").otherwise("owned")
    return joined.select("path_id", "worker", verdict.alias("verdict"))


def verify_fixed(outputs: DataFrame) -> DataFrame:
    """Add ``matches``: whether the declared digest is that of ``content`` under the row's ``algo``; null for an unknown one."""
    found = F.when(F.col("algo") == "md5", digest(F.col("content"), "md5")).when(F.col("algo") == "sha1", digest(F.col("content"), "sha1"))
    found = found.when(F.col("algo") == "sha256", digest(F.col("content"), "sha256")).when(F.col("algo") == "sha512", digest(F.col("content"), "sha512"))
    return outputs.withColumn("matches", found == F.col("declared"))
