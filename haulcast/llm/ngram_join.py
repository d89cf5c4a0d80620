"""Near duplicates by word n-grams: an exact Jaccard join with rare-first prefix filtering.

1. Every document becomes a set of n-gram hashes. The hashes of a chunk of documents travel to their
   hash bucket in one packed row per bucket; the bucket counts documents per n-gram and sends back
   only n-grams of two documents or more, with their counts. N-grams of one document can link nothing.
2. A document's n-grams are ordered rare-first (count, then hash), which is the same order everywhere.
   Two sets reach the threshold t only if they share an n-gram among the first n - ceil(t*n) + 1 of
   both. Documents whose prefix holds unshared n-grams only are done.
3. Equal sets are one class; one representative of each goes on.
4. Representatives meet on prefix n-grams, of which those of equal lists count once. Length,
   positional and suffix filters apply inside the meeting join: a 32-part profile of both sets bounds
   their intersection, and 256 parities bound their difference, which tells texts apart that have a
   passage in common. A pair is then kept once and verified once on the whole sets.
5. Lists of n-grams with many members do not emit all pairs: what links is one component, and pairs
   inside a component need no test. In the first rounds each member meets one hub, which links
   groups of near copies; such rounds go on while the lists would still take more comparisons than a
   few times their entries. Then hubs are compared with their whole lists, more in every round, until
   each list has one component or has compared all its members outside the largest.

Defined results: null and blank texts have the empty set and link with nothing; shorter texts than an
n-gram are one n-gram; a row without doc_id links with nothing and has no component; rows that repeat
a doc_id are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import components, split_by_keys, stage
from haulcast.llm.texthash import WordHasher, mix, text_bytes, texts_words

CHUNK_HASHES = 1 << 20  # n-grams whose documents travel together
CHUNK_DOCS = 1 << 15
CHUNK_BITS = 20  # chunks are numbered by task and place; with 15 bits for the document, 2**28 tasks fit in a long
BUCKET_GRAMS = 1 << 21  # n-grams that a task counts at once, about
GRAM_BYTES = 6  # of text, at least, that an n-gram stands for on average
PROFILE = 32
WORDS = 4  # of 64 parities each
LINKING_ROUNDS = 2  # rounds, at least, in which a member meets one hub, before lists are compared exhaustively
MOST_LINKING = 4  # and at most
OPEN_PAIRS = 2  # comparisons per list entry above which another such round comes first
NO_ID = -(2**63)
LOW48 = (1 << 48) - 1
_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def shingle_sets(words: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; ``first`` bounds the documents' words."""
    total = len(words)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, total - n + 1), dtype=np.uint64)
        for k in range(n):
            grams += words[k : k + len(grams)] * np.uint64(pow(_STEP[0], k, 2**64) | 1)
        grams = mix(grams, n)
        sets = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= n:
                sets.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                whole = words[a:b] * np.array([pow(_STEP[1], k, 2**64) | 1 for k in range(b - a)], dtype=np.uint64)
                sets.append(mix(whole.sum(keepdims=True, dtype=np.uint64), 100 + int(b - a)))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(part), 8), dtype=np.uint8)
    out[:, :6] = part
    return out.view("<u8").ravel()


EXCHANGE = "bucket int, chunk long, head binary, docs binary, hashes binary, freq binary"


def _exchange_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "chunk", "head", "docs", "hashes", "freq"]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=names)


def _scatter(n: int, buckets: int):
    """Documents to packed rows per bucket, and one head row per chunk with its documents."""

    def emit(chunk, ids, sets):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        sums = np.zeros((2, len(sets)), dtype=np.uint64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            start = (np.cumsum(sizes) - sizes)[filled]
            for k in range(2):
                sums[k, filled] = np.add.reduceat(mix(flat, 200 + k), start)
        head = np.stack([np.array(ids, dtype=np.int64), sizes, sums[0].view(np.int64), sums[1].view(np.int64)])
        yield (chunk % buckets, chunk, head.astype("<i8").tobytes(), None, None, None)
        bucket = (flat >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(flat), np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, flat = bucket[order], flat[order]
        doc = np.repeat(np.arange(len(sets)), sizes)[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(bucket)]):
            yield (int(bucket[a]), chunk, None, np.diff(doc[a:b], prepend=0).astype("<u2").tobytes(), _pack(flat[a:b]), None)

    def run(batches):
        hasher = WordHasher()
        chunk = TaskContext.get().partitionId() << CHUNK_BITS
        ids, sets, held = [], [], 0
        for batch in batches:
            keys = batch.column("doc_id").fill_null(NO_ID).to_pylist()
            for i, _, words, first in texts_words(hasher, *text_bytes(batch.column("text"))):
                for k, grams in enumerate(shingle_sets(words, first, n)):
                    ids.append(keys[i + k])
                    sets.append(grams)
                    held += len(grams)
                    if held >= CHUNK_HASHES or len(ids) >= CHUNK_DOCS:
                        yield _exchange_batch(list(emit(chunk, ids, sets)))
                        ids, sets, held, chunk = [], [], 0, chunk + 1
        if ids:
            yield _exchange_batch(list(emit(chunk, ids, sets)))

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket: n-grams of several documents, with their counts, back to their chunks."""
    rows = table.to_pylist()
    heads = [(0, r["chunk"], r["head"], None, None, None) for r in rows if r["head"] is not None]
    blobs = [r for r in rows if r["head"] is None]
    out = heads
    if blobs:
        hashes = [_unpack(r["hashes"]) for r in blobs]
        _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        freq = np.minimum(counts[inverse], 65535).astype("<u2")
        at = 0
        for r, own in zip(blobs, hashes):
            f = freq[at : at + len(own)]
            at += len(own)
            several = f > 1
            if several.any():
                doc = np.cumsum(np.frombuffer(r["docs"], dtype="<u2").astype(np.int64))[several]
                out.append((r["bucket"], r["chunk"], None, np.diff(doc, prepend=0).astype("<u2").tobytes(), _pack(own[several]), f[several].tobytes()))
    return pa.Table.from_batches([_exchange_batch(out)])


SETS = "row long, doc_id long, n long, sig_a long, sig_b long, alone long, profile array<int>, keys array<long>, " + ", ".join(f"odd_{k} long" for k in range(WORDS))


def gram_keys(bucket: int, low: np.ndarray, buckets: int) -> np.ndarray:
    """N-grams of a bucket as whole numbers: the bucket's bits, then the low bits that it leaves room for."""
    room = min(48, 65 - buckets.bit_length())
    return (low & np.uint64((1 << room) - 1) | np.uint64(bucket << room)).view(np.int64)


def parities(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per word and set: bits that tell of which parts the set has an odd number; ``keys`` lie set by set.

    Two sets differ in at least as many n-grams as bits. The profile's bits of a key take no part.
    """
    part = keys >> np.int64(PROFILE.bit_length() - 1) & np.int64(64 * WORDS - 1)
    bit = np.uint64(1) << (part & 63).astype(np.uint64)
    out, filled = np.zeros((WORDS, len(sizes)), dtype=np.uint64), np.flatnonzero(sizes)
    if len(filled):
        first = (np.cumsum(sizes) - sizes)[filled]
        for k in range(WORDS):
            out[k, filled] = np.bitwise_xor.reduceat(np.where(part >> 6 == k, bit, np.uint64(0)), first)
    return out.view(np.int64)


def _regroup(num: int, den: int, buckets: int):
    """One chunk: its documents, with shared n-grams in rare-first order where their prefix has any."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["head"] is not None)
        ids, n, sig_a, sig_b = np.frombuffer(head["head"], dtype="<i8").reshape(4, -1)
        docs, keys, freq = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in rows:
            if r["head"] is None:
                docs.append(np.cumsum(np.frombuffer(r["docs"], dtype="<u2").astype(np.int64)))
                keys.append(gram_keys(r["bucket"], _unpack(r["hashes"]), buckets))
                freq.append(np.frombuffer(r["freq"], dtype="<u2").astype(np.int64))
        docs, keys, freq = np.concatenate(docs), np.concatenate(keys), np.concatenate(freq)
        shared = np.bincount(docs, minlength=len(ids))
        prefix = n - -(-num * n // den) + 1
        wanted = (n > 0) & (n - shared < prefix) & (ids != NO_ID)
        keep = wanted[docs]
        docs, keys, freq = docs[keep], keys[keep], freq[keep]
        order = np.lexsort((keys, freq, docs))
        docs, keys = docs[order], keys[order]
        profile = np.bincount(docs * PROFILE + keys % PROFILE, minlength=len(ids) * PROFILE).reshape(-1, PROFILE)
        sizes = np.bincount(docs, minlength=len(ids))
        ends, odd = np.cumsum(sizes), parities(keys, sizes)
        valid = ids != NO_ID
        lists = [keys[e - s : e] if w else None for e, s, w in zip(ends, np.where(wanted, shared, 0), wanted)]
        return pa.table(
            {
                "row": (head["chunk"] << 15) + np.arange(len(ids)),
                "doc_id": pa.array(ids, mask=~valid),
                "n": n,
                "sig_a": sig_a,
                "sig_b": sig_b,
                "alone": n - shared,
                "profile": pa.array([p if w else None for p, w in zip(profile.astype(np.int32), wanted)], type=pa.list_(pa.int32())),
                "keys": pa.array(lists, type=pa.list_(pa.int64())),
                **{f"odd_{k}": odd[k] for k in range(WORDS)},
            }
        )

    return run


def document_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row: its set's size, two sums of its hashes, and its shared n-grams where they can link."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a power of two, so that a bucket is the leading bits of its n-grams
    buckets = 1 << min(30, (max(least, size // (GRAM_BYTES * BUCKET_GRAMS)) - 1).bit_length())
    sent = rows.mapInArrow(_scatter(n, buckets), EXCHANGE)
    counted = sent.groupBy("bucket").applyInArrow(_count, EXCHANGE)
    return counted.groupBy("chunk").applyInArrow(_regroup(num, den, buckets), SETS)


def _distinct_lists(postings: DataFrame) -> DataFrame:
    """One n-gram (h) of all those whose lists of two members or more are equal.

    Pairs meet in all of such lists or in none, and the positional bound holds at any shared n-gram.
    """
    members = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"members_{k}") for k in range(2)]
    lists = postings.groupBy("h").agg(F.count("*").alias("size"), *members).filter("size > 1")
    return lists.groupBy("size", "members_0", "members_1").agg(F.min("h").alias("h")).select("h")


def _meetings(postings: DataFrame, hubs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (hub, member) that share a prefix n-gram and pass the length, positional and suffix filters."""
    hubs = hubs.select("h", F.col("row").alias("hub"), F.col("c").alias("hub_c"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("profile").alias("hub_profile"))
    met = postings.join(hubs, "h").filter("c <> hub_c")
    met = met.filter(den * F.least("n", "hub_n") >= num * F.greatest("n", "hub_n"))
    needed = num * (F.col("n") + F.col("hub_n"))
    most = F.least("pos", "hub_pos") + 1 + F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos")) - 1
    met = met.filter((num + den) * most >= needed)
    # the suffix filters stand in the join too, so pairs that they rule out are never written
    differ = sum((F.bit_count(F.col(f"profile.odd_{k}").bitwiseXOR(F.col(f"hub_profile.odd_{k}"))) for k in range(WORDS)), F.lit(0))
    met = met.filter((num + den) * (F.col("profile.shared") + F.col("hub_profile.shared") - differ) >= 2 * needed)
    both = F.aggregate(F.zip_with("profile.parts", "hub_profile.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return met.filter((num + den) * both >= needed).select("row", "hub", "c", "hub_c")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs with ``linked``: whether their whole sets reach the threshold."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("row").alias(side), F.col("n").alias(f"n_{side}"), F.col("keys").alias(f"k_{side}")), side)
    needed = num * (F.col("n_a") + F.col("n_b"))
    linked = (num + den) * F.size(F.array_intersect("k_a", "k_b")) >= needed
    return pairs.select("a", "b", "ca", "cb", linked.alias("linked"))


def link_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id. Texts link when den * intersection >= num * union."""
    sets = stage(document_sets(docs, n, num, den))
    one = F.min(F.struct("doc_id", "row"))["row"]
    same = ["n", "sig_a", "sig_b"]
    classes = sets.filter("n > 0 and doc_id is not null").groupBy(*same).agg(one.alias("rep"))
    members = stage(sets.select("row", "doc_id", *same).join(classes, same, "left").select("row", "doc_id", "n", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("rep")), "row").alias("rep")))
    candidates = stage(sets.filter("keys is not null").join(members.filter("row = rep").select("row"), "row", "left_semi").drop("doc_id", "sig_a", "sig_b"))
    prefix = F.expr(f"slice(keys, 1, cast(n - ceil({num} * n / {den}) + 1 - alone as int))")
    profile = F.struct(F.col("profile").alias("parts"), F.size("keys").alias("shared"), *[f"odd_{k}" for k in range(WORDS)]).alias("profile")
    postings = candidates.select("row", "n", "alone", profile, F.posexplode(prefix).alias("at", "h")).select("row", "n", "h", (F.col("at") + F.col("alone")).alias("pos"), "profile")
    postings = stage(postings.join(_distinct_lists(postings), "h"))
    current, used, merged, failed = postings.withColumn("c", F.col("row")), None, [], None
    few, slots, turn, entries = 256, 64, 0, postings.count()
    while True:
        # lists of one component are closed for good, so what is open only shrinks
        parts = current.groupBy("h", "c").count().groupBy("h").agg(F.max(F.struct("count", "c")).alias("top"), F.count("*").alias("parts"), F.sum("count").alias("all"))
        open_lists = stage(parts.filter("parts > 1").select("h", F.col("top.c").alias("largest"), (F.col("all") * (F.col("all") - F.col("top.count"))).alias("pairs")))
        pairs_open = open_lists.agg(F.sum("pairs")).first()[0] or 0
        current = stage(current.drop("largest").join(open_lists.drop("pairs"), "h"))
        key = F.xxhash64(F.lit(turn), "row")
        member = F.struct(key.alias("k"), "row", "c", "n", "pos", "profile")
        if turn < LINKING_ROUNDS or (used is None and turn < MOST_LINKING and pairs_open > OPEN_PAIRS * entries):
            # every member meets one hub only: the first, in this round's order, of those its lists name
            hubs = current.groupBy("h").agg(F.min(member).alias("m")).select("h", "m.row", "m.c", "m.n", "m.pos", "m.profile")
            met = _meetings(current, hubs, num, den)
            first = F.min(F.struct(F.xxhash64(F.lit(turn), "hub"), "hub", "c", "hub_c")).alias("m")
            pairs = met.groupBy("row").agg(first).select("row", "m.hub", "m.c", "m.hub_c")
        else:
            rest = current.filter("c <> largest")
            if used is not None:
                rest = rest.join(used, ["h", "row"], "left_anti")
            # hubs: all open members of a short list, else the first of each of some slots
            size = rest.groupBy("h").agg(F.count("*").alias("members"))
            rest = rest.join(size, "h")
            short = rest.filter(F.col("members") <= few).select("h", "row", "c", "n", "pos", "profile")
            long = rest.filter(F.col("members") > few).groupBy("h", F.pmod(key, F.lit(slots)).alias("slot")).agg(F.min(member).alias("m"))
            hubs = stage(short.unionByName(long.select("h", "m.row", "m.c", "m.n", "m.pos", "m.profile")))
            if hubs.isEmpty():
                break
            pairs = _meetings(current, hubs, num, den)
            now = hubs.select("h", "row")
            used = now if used is None else used.unionByName(now)
            few, slots = min(4096, 16 * few), min(1024, 16 * slots)
        turned = F.col("row") > F.col("hub")
        ends = [F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")]
        pairs = stage(pairs.select(*ends, F.when(turned, F.col("hub_c")).otherwise(F.col("c")).alias("ca"), F.when(turned, F.col("c")).otherwise(F.col("hub_c")).alias("cb")).distinct())
        if failed is not None:  # a pair that failed in an earlier round is not verified again
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
        found = stage(_verified(pairs, candidates, num, den))
        apart = found.filter("not linked").select("a", "b")
        failed = apart if failed is None else failed.unionByName(apart)
        found = found.filter("linked")
        # an edge joins the components that its ends are in by now
        roots = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if not roots.isEmpty():
            merged.append(roots)
            current = current.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("c", F.coalesce("root", "c")).drop("root")
        turn += 1
    joined = members.withColumn("root", F.col("rep"))
    for roots in merged:
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        joined = joined.join(step, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next")
    smallest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return joined.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near copies: of each component the smallest doc_id stays.

    Rows that share a doc_id stay or go together; they go when every one of them has a smaller partner.
    """
    gone = link_components(docs, n, num, den).groupBy(F.col("doc_id").alias("d")).agg(F.min(F.col("doc_id") > F.col("component_id")).alias("gone"))
    gone = stage(gone.filter("gone").select("d"))
    # only rows whose doc_id may be among those that go are shuffled
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k"))
    rows, others = split_by_keys(rows, gone, F.col("k"), F.col("d"))
    return others.select("row.*").unionByName(rows.join(gone, F.col("k") == F.col("d"), "left_anti").select("row.*"))
