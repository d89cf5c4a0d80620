"""Documents scored by the difference of two word-bigram models' cross-entropies.

The target model counts the bigrams of documents marked as target, the background model those of all
documents, scaled to the target's number of tokens, so both are of one size. They share the corpus's
whole vocabulary and the same smoothing: ``p(w | v) = (c(v, w) + k) / (c(v) + k * V)``. A token's score
is its background loss minus its target loss, a document's the mean over its tokens: positive where
the text looks like the target. A document's own counts are left out of both models when it is scored.

Counts cover every document. A chunk of about half a million tokens counts its own keys first, bigrams and
contexts alike, so however often a word occurs it travels once per chunk: a bucket of hashed keys adds
up what the chunks counted and answers each of them with the totals, and the chunk, which holds how
often each of its documents has each key, works out the scores. The number of buckets follows the
number of tokens. No table of counts is ever broadcast or collected.

Words, contexts and bigrams are told apart by 64 bits of hash (keys by 63, the last bit is their kind);
among a billion distinct bigrams about one pair in twenty such corpora is expected to fall together.

Defined results: null and blank texts have no tokens and score 0; the first word of a text has the
text's beginning as its context; without target documents every score is 0; rows that repeat a doc_id
are documents of their own; a null mark is no target. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import stage, word_count
from haulcast.llm.texthash import WordHasher, mix, text_bytes, texts_words

SMOOTHING = 0.05  # count added to every bigram
CHUNK_TOKENS = 1 << 19
CHUNK_DOCS = 1 << 15
START = np.uint64(0x5DEECE66D1234567)  # context of a text's first word
BUCKET_TOKENS = 1 << 19
SCORED_KEYS = 1 << 16
EXCHANGE = "bucket int, chunk long, head binary, grams binary, slots binary, docs binary, times binary, keys binary, counts binary"
NAMES = ["bucket", "chunk", "head", "grams", "slots", "docs", "times", "keys", "counts"]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in little room: bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    used = max((b + 1 for b in range(8) if planes[b].any()), default=1)
    return len(values).to_bytes(8, "little") + bytes([used]) + pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, used = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(pa.decompress(blob[9:], n * used, codec="zstd"), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
    columns = list(zip(*rows)) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=NAMES)


def _chunks(batches):
    """(chunk number, doc_ids, marks, word hashes per document) of about half a million tokens each."""
    hasher = WordHasher()
    chunk = TaskContext.get().partitionId() << 32
    ids, marks, words, held = [], [], [], 0
    for batch in batches:
        keys, target = batch.column("doc_id").to_pylist(), batch.column("target").to_pylist()
        for i, _, hashes, first in texts_words(hasher, *text_bytes(batch.column("text"))):
            for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
                ids.append(keys[i + k])
                marks.append(target[i + k])
                words.append(hashes[a:b].copy())
                held += b - a
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield chunk, ids, marks, words
                    ids, marks, words, held, chunk = [], [], [], 0, chunk + 1
    if ids:
        yield chunk, ids, marks, words


def _vocabulary(batches):
    """Distinct words of every chunk, and its tokens inside and outside the target."""
    for _, _, marks, words in _chunks(batches):
        sizes = np.array([len(w) for w in words])
        inside = int(sizes[np.array(marks, dtype=bool)].sum())
        unique = np.unique(np.concatenate(words)).view(np.int64)
        n = len(unique)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(unique, 0), mask=np.append(np.zeros(n, bool), True)), pa.array(np.append(np.zeros(n, int), inside)), pa.array(np.append(np.zeros(n, int), sizes.sum()))],
            names=["word", "inside", "tokens"],
        )


def token_keys(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of every token's bigram (odd) and of its context (even)."""
    return mix(mix(context, 1) + word, 2) | np.uint64(1), mix(context, 3) & ~np.uint64(1)


def _send(buckets: int):
    """Of a chunk one row with its documents' own counts, and one row per bucket with its counted keys."""

    def run(batches):
        for chunk, ids, marks, words in _chunks(batches):
            sizes, flag = np.array([len(w) for w in words]), np.array(marks, dtype=bool)
            context = np.concatenate([np.append(START, w[:-1]) if len(w) else w for w in words])
            keys, key = np.unique(np.concatenate(token_keys(context, np.concatenate(words))), return_inverse=True)
            doc = np.repeat(np.arange(len(words)), sizes)
            own, times = np.unique(key * len(words) + np.concatenate([doc, doc]), return_counts=True)
            key, doc = own // len(words), own % len(words)
            counts = np.stack([np.bincount(key, weights=w, minlength=len(keys)) for w in (times, times * flag[doc])]).astype(np.uint64)
            known = np.array([i is not None for i in ids])
            head = np.stack([np.array([i or 0 for i in ids]), known, sizes, flag]).astype("<i8").tobytes()
            slots = pack(np.bincount(key, minlength=len(keys)))
            grams = np.packbits((keys & np.uint64(1)).astype(bool)).tobytes()
            rows = [(int(mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), chunk, head, grams, slots, pack(doc), pack(times), None, None)]
            # keys are in order, and so are their buckets
            bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                rows.append((int(bucket[a]), chunk, *[None] * 5, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(counts[:, a:b].ravel())))
            yield _batch(rows)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Every chunk's keys of a bucket get their counts over all chunks."""
    rows = table.to_pylist()
    out = [tuple(r[c] for c in NAMES) for r in rows if r["head"] is not None]
    asked = [r for r in rows if r["head"] is None]
    if asked:
        keys = [np.cumsum(unpack(r["keys"])) for r in asked]
        _, key = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(r["counts"]).reshape(2, -1) for r in asked], axis=1)
        totals = np.stack([np.bincount(key, weights=c).astype(np.uint64)[key] for c in counts])
        at = 0
        for r, k in zip(asked, keys):
            out.append((r["bucket"], r["chunk"], *[None] * 6, pack(totals[:, at : at + len(k)].ravel())))
            at += len(k)
    return pa.Table.from_batches([_batch(out)])


def loss_differences(total, inside, own, flags, scale: float, add) -> np.ndarray:
    """Log count in the target minus log count in the background of keys, smoothed by ``add``, without the own document."""
    return np.log(inside - own * flags + add) - np.log(scale * (total - own) + add)


def _score(scale: float, vocabulary: int, k: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["head"] is not None)
        ids, known, sizes, flags = np.frombuffer(head["head"], "<i8").reshape(4, -1)
        answers = sorted((r for r in rows if r["head"] is None), key=lambda r: r["bucket"])
        total, inside = np.concatenate([np.zeros((2, 0)), *[unpack(r["counts"]).reshape(2, -1) for r in answers]], axis=1)
        slots, docs, own = (unpack(head[c]).astype(np.int64) for c in ("slots", "docs", "times"))
        grams = np.unpackbits(np.frombuffer(head["grams"], np.uint8), count=len(slots)).astype(bool)
        first = np.append(0, np.cumsum(slots))
        score = np.zeros(len(ids))
        for a in range(0, len(slots), SCORED_KEYS):
            b = min(a + SCORED_KEYS, len(slots))
            part = slice(first[a], first[b])
            key = np.repeat(np.arange(a, b), slots[a:b])
            values = loss_differences(total[key], inside[key], own[part], flags[docs[part]], scale, np.where(grams[key], k, k * vocabulary))
            score += np.bincount(docs[part], weights=np.where(grams[key], own[part], -own[part]) * values, minlength=len(ids))
        score /= np.maximum(1, sizes)
        return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n_tokens": sizes, "score": score})

    return run


def score_documents(docs: DataFrame, target: Column, k: float = SMOOTHING) -> DataFrame:
    """Per row: doc_id, n_tokens, score. ``target`` marks the documents that the target model counts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    words = stage(rows.mapInArrow(_vocabulary, "word long, inside long, tokens long"))
    inside, tokens = words.agg(F.sum("inside"), F.sum("tokens")).first()
    vocabulary = words.select("word").distinct().filter("word is not null").count()
    if not inside:
        return rows.select("doc_id", word_count(F.col("text")).alias("n_tokens"), F.lit(0.0).alias("score"))
    buckets = min(1 << 24, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS)))
    sent = rows.mapInArrow(_send(buckets), EXCHANGE)
    totals = sent.groupBy("bucket").applyInArrow(_add_up, EXCHANGE)
    return totals.groupBy("chunk").applyInArrow(_score(inside / tokens, vocabulary, k), "doc_id long, n_tokens long, score double")
