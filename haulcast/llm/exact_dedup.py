"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is (bytes, H mod p1, H mod p2) with ``H = sum of (byte_j + 1) * r**j``. Fingerprints
compose: ``H(ab) = H(a) + r**len(a) * H(b)``, so huge documents are cut into chunks that are hashed by
different tasks and combined afterwards. Texts with equal fingerprints are then compared chunk by
chunk; if a fingerprint ever covers different texts, its group is split by the chunks themselves.

Defined results: null counts as the empty text; the row with the largest doc_id of a group stays; a
null doc_id ranks below all others; rows repeated with the same doc_id and text are reported each,
and ``drop_copies`` keeps one of them; other columns of the input are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import split_by_keys, stage
from haulcast.llm.texthash import blocks, text_bytes

PRIMES = ((2147483647, 1103515245), (2147483629, 69069069))  # (modulus, base)
CHUNK = 1 << 16  # bytes hashed under one table of powers, characters compared at once
HUGE = 1 << 20  # characters from which a document is hashed by several tasks
FP = ["fp_bytes", "fp_a", "fp_b"]


def _powers(prime: int, base: int) -> np.ndarray:
    """r**0 .. r**CHUNK modulo the prime, by doubling."""
    table = np.ones(1, dtype=np.int64)
    while len(table) <= CHUNK:
        table = np.concatenate([table, table * pow(base, len(table), prime) % prime])
    return table[: CHUNK + 1]


def fold(parts: list[tuple[int, int]], prime: int, base: int) -> int:
    """Combine (bytes, hash) of consecutive chunks by shifting each with the length before it."""
    total, before = 0, 0
    for size, value in parts:
        total = (total + pow(base, before, prime) * value) % prime
        before += size
    return total


def _hasher(primes):
    def run(batches):
        tables = [(_powers(p, r), p, pow(r, CHUNK, p)) for p, r in primes]
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out = np.zeros((len(primes), batch.num_rows), dtype=np.int64)
            for i, j in blocks(offsets):
                edges = offsets[i : j + 1]
                n_chunks = -(-np.diff(edges) // CHUNK)
                doc = np.repeat(np.arange(j - i), n_chunks)
                if not len(doc):
                    continue
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
                start = edges[doc] + number * CHUNK - edges[0]
                size = np.minimum(CHUNK, edges[doc + 1] - edges[0] - start)
                part = data[edges[0] : edges[-1]].astype(np.int64) + 1
                at = np.arange(len(part)) - np.repeat(start, size)
                for k, (table, prime, step) in enumerate(tables):
                    value = np.add.reduceat(part * table[at], start) % prime
                    shift = np.array([pow(step, int(x), prime) for x in range(int(number.max()) + 1)])
                    np.add.at(out[k], i + doc, value * shift[number] % prime)
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            hashes = [pa.array(out[k] % p) for k, (p, _) in enumerate(primes)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), *hashes], names=[*names, *FP])

    return run


def _combiner(primes):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        size = table["fp_bytes"].to_pylist()
        values = [fold(list(zip(size, table[c].to_pylist())), p, r) for c, (p, r) in zip(FP[1:], primes)]
        return table.slice(0, 1).select(["doc_id", "text_sha256"]).append_column("fp_bytes", pa.array([sum(size)])).append_column(
            "fp_a", pa.array([values[0]])
        ).append_column("fp_b", pa.array([values[1]]))

    return run


def fingerprints(docs: DataFrame, primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """(doc_id, text_sha256, fp_bytes, fp_a, fp_b) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    fields = "fp_bytes long, fp_a long, fp_b long"
    sha = F.sha2("text", 256).alias("text_sha256")
    small = rows.filter(F.length("text") <= huge).select("doc_id", sha, "text")
    small = small.mapInArrow(_hasher(primes), f"doc_id long, text_sha256 string, {fields}")
    large = rows.filter(F.length("text") > huge).select(F.monotonically_increasing_id().alias("row"), "doc_id", sha, "text")
    step = max(1, huge // 2)
    chunks = large.select(
        "row", "doc_id", "text_sha256", F.posexplode(F.expr(f"transform(sequence(0, length(text) - 1, {step}), i -> substring(text, i + 1, {step}))")).alias("chunk", "text")
    ).repartition("row", "chunk")
    chunks = chunks.mapInArrow(_hasher(primes), f"row long, doc_id long, text_sha256 string, chunk int, {fields}")
    whole = chunks.groupBy("row").applyInArrow(_combiner(primes), f"doc_id long, text_sha256 string, {fields}")
    return small.unionByName(whole)


def _chunks(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Chunk rows (keys, n, chunk) of the documents named by ``keys`` (doc_id, text_sha256, fingerprint).

    Texts are shuffled only where their doc_id may be among the keys, at any size of the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    rows, _ = split_by_keys(rows, keys, F.col("d"), F.col("doc_id"))
    rows = rows.withColumn("s", F.sha2("text", 256))
    joined = rows.join(keys.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("text_sha256")))
    piece = F.expr(f"transform(sequence(0, greatest(length(text) - 1, 0), {size}), i -> substring(text, i + 1, {size}))")
    return joined.select("doc_id", "text_sha256", *FP, F.posexplode(piece).alias("n", "chunk"))


def exact_groups(docs: DataFrame, primes=PRIMES, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(fingerprints(docs, primes, huge))
    groups = rows.groupBy(*FP).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    suspects = stage(rows.join(groups.filter("group_size > 1").select(*FP), FP).select("doc_id", "text_sha256", *FP).distinct())
    # equal fingerprints: every chunk position of a group must hold one text only
    compared = _chunks(docs, suspects, chunk).groupBy(*FP, "n", "chunk").agg(F.lit(1).alias("one"))
    differing = stage(compared.groupBy(*FP, "n").count().filter("count > 1").select(*FP).distinct())
    if differing.isEmpty():
        out = rows.join(groups, FP)
    else:
        pieces = _chunks(docs, stage(suspects.join(differing, FP, "left_semi")), chunk)
        # a chunk is named by its smallest owner; a text by the names of its chunks
        owner = F.min(F.struct("doc_id", "text_sha256")).alias("owner")
        named = pieces.join(pieces.groupBy(*FP, "n", "chunk").agg(owner), [*FP, "n", "chunk"])
        content = named.groupBy(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s")).agg(F.sort_array(F.collect_set(F.struct("n", "owner"))).cast("string").alias("content"))
        rows = rows.join(content, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s")), "left")
        rows = stage(rows.select("doc_id", "text_sha256", *FP, F.coalesce("content", F.lit("")).alias("content")))
        groups = rows.groupBy(*FP, "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = rows.join(groups, [*FP, "content"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of equal texts.

    Only rows whose doc_id may be among the affected ones are shuffled; the others pass as they are read.
    """
    found = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    found = stage(found.filter("not kept or times > 1"))
    once = found.filter("kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"))
    rows, others = split_by_keys(rows, found, F.col("d"), F.col("doc_id"))
    rows = rows.withColumn("s", F.sha2(F.coalesce("row.text", F.lit("")), 256))
    same = rows.d.eqNullSafe(found.doc_id) & (rows.s == found.text_sha256)
    out = others.select("row.*").unionByName(rows.join(found, same, "left_anti").select("row.*"))
    if not once.isEmpty():
        repeated = rows.join(once, rows.d.eqNullSafe(once.doc_id) & (rows.s == once.text_sha256), "left_semi")
        out = out.unionByName(repeated.dropDuplicates(["d", "s"]).select("row.*"))
    return out
