"""Harmonic packing of tokenised documents into sequences of bounded length.

A document's tokens are cut into full sequences and a rest; the rest is cut into pieces of 1/2, 1/4,
1/8 ... of the capacity and a tail below the smallest of them. Every length belongs to a
reciprocal-capacity class k (capacity // length): bins of class k take exactly k pieces. Pieces are
numbered inside their class by group counts and a running number inside each group, so every group is
worked by its own task and bins fill independently of each other. What is left over is fewer than k
pieces per class, which has a bound that does not depend on the input; it is packed next-fit from
long to short.

Defined results: a null text is the empty document and gives its end token only; rows that repeat a
doc_id are packed each on its own; other columns of the input are dropped from the pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulcast.llm.common import stage, worker_cache
from haulcast.llm.texthash import WordHasher, blocks, mix, text_bytes

CAPACITY = 2048
SMALLEST = 64  # rests are cut at capacity/2, capacity/4, ... down to this length
END = 1  # id that closes every document
NEWLINE = "\n"
MOST_PIECES = 600_000  # distinct pieces whose ids a worker keeps; beyond, it starts anew
BLOCK = 1 << 19  # bytes of text encoded together


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Token ids of whole texts: every distinct piece of a batch of texts is encoded once.

    Texts are cut only where the byte-level pre-tokeniser always cuts: after an ASCII letter, digit or
    mark (no apostrophe) before another kind of character, and before a space that follows a letter.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hasher = WordHasher(lower=False)
        kind = np.full(256, 4, dtype=np.uint8)  # marks
        kind[48:58] = 2
        kind[[*range(65, 91), *range(97, 123)]] = 1
        kind[128:] = 0  # may be a letter, a digit, a mark or a space: no cut beside it
        kind[[*range(0x09, 0x0E), 0x20]] = 3
        kind[0x1C:0x20] = 0
        kind[0x27] = 5
        self.kind = kind
        self.newline = self.tokenizer.encode(NEWLINE, add_special_tokens=False).ids
        self.forget()

    @classmethod
    def of_worker(cls, path: str) -> PieceEncoder:
        """The worker's encoder: one tokenizer and one table of pieces for all of its tasks."""
        cache = worker_cache()
        if (cls.__name__, path) not in cache:
            cache[cls.__name__, path] = cls(path)
        found = cache[cls.__name__, path]
        if len(found.hash) > MOST_PIECES:
            found.forget()
        return found

    def forget(self) -> None:
        """Drop the pieces learned so far."""
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a piece may begin at each byte."""
        kind = self.kind[data]
        before, here = kind[:-1], kind[1:]
        cut = np.zeros(len(data), dtype=bool)
        ascii_end = ((before == 1) | (before == 2) | (before == 4)) & (here != before) & (here != 0)
        ascii_end &= ~((before == 4) & (here == 5))
        # a two-byte letter that cannot be a space, before a space
        wide = np.zeros(len(data) - 1, dtype=bool)
        if len(data) > 2:
            wide[1:] = (before[1:] == 0) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (here[1:] == 3)
        cut[1:] = ascii_end | wide
        return cut

    @staticmethod
    def _latin(body: bytes) -> bool:
        """Whether the first and last characters are ASCII or two bytes long, and no space."""
        return (body[0] < 128 or 0xC3 <= body[0] <= 0xDF) and (body[-1] < 128 or len(body) > 1 and 0xC3 <= body[-2] <= 0xDF)

    def _learn(self, pieces: list[bytes], hashes: np.ndarray) -> None:
        """Encode new pieces and add them to the table kept for this task."""
        plain, single = [], []
        for n, piece in enumerate(pieces):
            body = piece[1:] if piece[:1] == b" " else piece
            odd = not body or b"\n" in body or body[:1].isspace() or body[-1:].isspace() or not self._latin(body)
            (single if odd else plain).append(n)
        found: list = [None] * len(pieces)
        runs = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        joined = ["\n" + "\n".join(pieces[n].decode("utf-8", "surrogateescape") for n in run) for run in runs]
        for run, done in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(done.ids, dtype=np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.newline[0]))[1:]
            for n, part in zip(run, parts, strict=True):
                found[n] = part[1:]
        texts = [pieces[n].decode("utf-8") for n in single]
        for i in range(0, len(texts), 4096):
            for n, done in zip(single[i : i + 4096], self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)):
                found[n] = np.array(done.ids, dtype=np.uint32)
        size = np.array([len(x) for x in found], dtype=np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *found])
        order = np.argsort(hashes)
        where = np.searchsorted(self.hash, hashes[order])
        self.at = np.insert(self.at, where, at[order])
        self.size = np.insert(self.size, where, size[order])
        self.hash = np.insert(self.hash, where, hashes[order])

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, dtype=np.uint32)

    def block(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts (edges: byte offsets) and the number of ids of each."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):  # such a string is one id wherever it stands
            each = [self._whole(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], dtype=np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, dtype=np.int64)
        if len(edges) == 2 and len(data) > 2 * BLOCK:
            return self._long(data)
        begin = self._cuts(data)
        begin[edges[:-1][edges[:-1] < len(data)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        hashes = self._piece_hashes(data, start, end)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, unique)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == unique[known]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn([raw[start[k] : end[k]] for k in first[new]], unique[new])
            at = np.searchsorted(self.hash, unique)
        sizes = self.size[at][inverse]
        begins = self.at[at][inverse]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
        before = np.concatenate([[0], ends])
        counts = np.diff(before[np.searchsorted(start, edges)])
        return self.ids[index], counts

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long text, worked in runs of pieces."""
        found, at = [], 0
        while at < len(data):
            to, size = len(data), BLOCK
            while at + size < len(data):
                cuts = np.flatnonzero(self._cuts(data[at : at + size]))
                if len(cuts):
                    to = at + int(cuts[-1])
                    break
                size *= 2
            if to - at > 2 * BLOCK:  # no cut in sight
                found.append(self._whole(data[at:to].tobytes()))
            else:
                found.append(self.block(data[at:to], np.array([0, to - at]))[0])
            at = to
        ids = np.concatenate(found)
        return ids, np.array([len(ids)], dtype=np.int64)

    def _piece_hashes(self, data, start, end):
        h = self.hasher
        h._tables(len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.value[data] * h.power[: len(data)])])
        return mix((total[end] - total[start]) * h.inverse[start] + (end - start).astype(np.uint64))


def cut_lengths(tokens: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, reciprocal powers of two, a tail."""
    pieces = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while rest and size >= smallest:
        if rest >= size:
            pieces.append(size)
            rest -= size
        size //= 2
    return [*pieces, rest] if rest else pieces


def _piece_rows(path: str, capacity: int, smallest: int, keep_ids: bool):
    def run(batches):
        encoder = PieceEncoder.of_worker(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            for i, j in blocks(offsets, BLOCK):
                if len(encoder.hash) > MOST_PIECES:
                    encoder.forget()
                ids, counts = encoder.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out, at = [], 0
                for k, n in enumerate(counts):
                    own = np.append(ids[at : at + n], np.uint32(END))
                    at += n
                    start = 0
                    raw = own.astype("<u4").tobytes()
                    for size in cut_lengths(n + 1, capacity, smallest):
                        part = raw[4 * start : 4 * (start + size)]
                        out.append((keys[i + k], start, size, zlib.crc32(part), n + 1, own[start : start + size].tolist() if keep_ids else None))
                        start += size
                cols = list(zip(*out))
                arrays = [pa.array(c, type=t) for c, t in zip(cols, [pa.int64()] * 5)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays.append(pa.array(cols[5], type=pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, smallest: int = SMALLEST, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_piece_rows(path or tokenizer_path(), capacity, smallest, keep_ids), schema)


def _next_fit(capacity: int, columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="first")
        sequence, offset, at, used = [], [], 0, 0
        for size in pdf["length"]:
            if used + size > capacity:
                at, used = at + 1, 0
            sequence.append(at)
            offset.append(used)
            used += size
        return pdf.assign(sequence_id=pdf["all_bins"] + sequence, offset=offset)[columns]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, smallest: int = SMALLEST, groups: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset. Sequence ids run from 0 without gaps.

    Reads ``pieces`` more than once: give a staged table.
    """
    spark = pieces.sparkSession
    groups = groups or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "start", "length", "ids_crc32"]
    # whole reciprocals of the capacity and tails fill bins of their own; tail classes are negative
    per_bin = F.floor(F.lit(capacity) / F.col("length")).cast("int")
    dealt = pieces.withColumn("class", F.when(F.col("length") >= smallest, per_bin).otherwise(-per_bin))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(groups)).cast("int"))
    counts = dealt.groupBy("class", "group").agg(F.count("*").alias("n"))
    sums = Window.partitionBy("class").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "class", "group", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("class")).alias("total")
    )
    # at most one row per length below the capacity
    classes = counts.select("class", "total").distinct().withColumn("bins", F.expr("total div abs(class)"))
    earlier = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(
        "class", "bins", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias("first"), F.sum("bins").over(Window.partitionBy(F.lit(1))).alias("all_bins")
    )
    counts = counts.drop("total").join(F.broadcast(classes), "class")
    running = Window.partitionBy("class", "group").orderBy(*order)
    numbered = dealt.withColumn("number", F.row_number().over(running) - 1).join(counts, ["class", "group"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("before")).withColumn("bin", F.expr("number div abs(class)"))
    columns = pieces.columns
    full = numbered.filter("bin < bins").withColumn("sequence_id", F.col("first") + F.col("bin"))
    exact = full.filter("class > 0").withColumn("offset", F.expr("number % class * length"))
    inside = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    tails = full.filter("class < 0").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rest = numbered.filter("bin >= bins").select(*columns, "all_bins", F.lit(1).alias("one"))
    schema = T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    packed = rest.groupBy("one").applyInPandas(_next_fit(capacity, [f.name for f in schema]), schema)
    columns = [*columns, "sequence_id", "offset"]
    return exact.select(columns).unionByName(tails.select(columns)).unionByName(packed)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(stage(token_pieces(docs, path, capacity, keep_ids=keep_ids)), capacity)
