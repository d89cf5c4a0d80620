"""Phrase collocations by direct-address tiling of frequency-ranked ids.

Everything is counted per language. Words that occur ``least`` times or more are ranked by frequency, and a
chunk of texts becomes a stream of ranks. Two neighbours of the stream are a cell of the pair space, whose
rows and columns are cut at powers of two into tiles: as ids are ranks, few tiles hold most pairs. A chunk
sends its pairs, counted once, as packed rows per tile; a tile of many entries is dealt into strips by
cell. A strip that is full enough is counted by ``numpy.bincount`` at the cells' own addresses, a sparse
one by sorting its cells (COO). Pairs that stay frequent are ranked anew, the chunks turn their streams of
words into streams of pairs, and two pairs that overlap are a cell of the next round, up to ``longest``
words. A phrase of m words can only be frequent where its first and last m - 1 words are.

No table of ids is broadcast: a chunk gets the ids of the words and pairs it holds itself.

Defined results: a null text is empty; a null lang is ``und`` and is counted together with that value; a
text's A-Z are lower-cased; repeated rows count each; a table without frequent phrases gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.common import LOWER, UPPER, drop_staged, positions, stage

# Characters between pieces, the blank that the tab counts as, the scale of a score.
BREAKS = ".,;:!?\n\x0b\x0c\r"
SCALE = 2000000

CHUNK_WORDS = 1 << 20  # words of one language from which a chunk is closed
FIRST_BITS = 10  # the first tile edge holds 2**10 ids; every further one doubles
STRIP_ENTRIES = 1 << 21  # counted cells that a task gathers
DENSE_CELLS = 1 << 22  # addresses of the largest dense count
DENSE_SHARE = 16  # a dense count needs one entry per so many addresses
PARTS = 32  # parts of a language's phrases that are ranked apart before they are ranked together
MARK = b"\xff"  # stands for a break; no UTF-8 text holds this byte


def _table() -> bytes:
    table = bytearray(range(256))
    for a, b in zip(UPPER, LOWER):
        table[ord(a)] = ord(b)
    for c in BREAKS:
        table[ord(c)] = MARK[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


def _packed(values: np.ndarray) -> bytes:
    """Integers as 4 bytes each, or 8 where one does not fit."""
    narrow = not len(values) or (values.max() < 2**31 and values.min() >= -(2**31))
    return values.astype(np.int32 if narrow else np.int64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n else np.int64).astype(np.int64)


def _chunker(chunk_words: int):
    """Chunks of one language: distinct words, their counts, and the texts as a stream of places in that list, -1 for breaks."""

    def close(number, lang, parts):
        words = MARK.join(parts).translate(table).replace(MARK, b" \xff ").split()
        known = {MARK: -1}
        stream = np.fromiter((known.setdefault(w, len(known) - 1) for w in words), np.int64, len(words))
        del known[MARK]
        counts = np.bincount(stream[stream >= 0], minlength=len(known))
        return {"lang": lang, "chunk": number, "n": int(counts.sum()), "size": len(stream), "words": [w.decode() for w in known], "counts": counts.tolist(), "stream": _packed(stream)}

    def run(batches: Iterator[pa.RecordBatch]):
        base, closed, open_texts, held = TaskContext.get().partitionId() << 24, 0, {}, {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                open_texts.setdefault(lang, []).append(text)
                held[lang] = held.get(lang, 0) + len(text)
                if held[lang] >= 6 * chunk_words:  # bytes; a word and its blank take six or so
                    yield pa.RecordBatch.from_pylist([close(base + closed, lang, open_texts.pop(lang))], schema)
                    held[lang], closed = 0, closed + 1
        for lang, parts in open_texts.items():
            yield pa.RecordBatch.from_pylist([close(base + closed, lang, parts)], schema)
            closed += 1

    table = _table()
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])
    return run


def _side(ids: np.ndarray) -> np.ndarray:
    """Number of the tile edge that holds an id: 0 below 2**FIRST_BITS, then one per doubling."""
    return np.frexp((ids >> FIRST_BITS).astype(np.float64))[1].astype(np.int64)


def _start(side: np.ndarray) -> np.ndarray:
    return np.where(side == 0, 0, np.int64(1) << np.maximum(side - 1 + FIRST_BITS, 0))


def _width(side: np.ndarray) -> np.ndarray:
    return np.int64(1) << (np.maximum(side - 1, 0) + FIRST_BITS)


def pairs_of(stream: np.ndarray):
    """(tile, cell, counts, where, inverse): the distinct neighbours by tile and cell, and where they stand in the stream."""
    where = np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0))
    a, b = stream[where], stream[where + 1]
    row, col = _side(a), _side(b)
    tile, cell = row * 64 + col, (a - _start(row)) * _width(col) + b - _start(col)
    order = np.lexsort((cell, tile))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(tile[order]) != 0) | (np.diff(cell[order]) != 0)
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = order[new]
    return tile[first], cell[first], np.bincount(inverse, minlength=len(first)), where, inverse


def _tiles(batches):
    """Packed rows of a chunk's counted pairs, one per tile."""
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("tile", pa.int32()), ("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            tile, cell, counts, _, _ = pairs_of(_unpacked(row["stream"], row["size"]))
            edges = np.flatnonzero(np.diff(tile, prepend=-1, append=-1)) if len(tile) else []
            out = [
                {"lang": row["lang"], "chunk": row["chunk"], "tile": int(tile[i]), "n": int(j - i), "cells": _packed(cell[i:j]), "counts": _packed(counts[i:j])}
                for i, j in zip(edges[:-1], edges[1:])
            ]
            yield pa.RecordBatch.from_pylist(out, schema)


def _deal(batches):
    """Rows of tiles that have several strips, dealt by cell."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            cells, counts = _unpacked(row["cells"], row["n"]), _unpacked(row["counts"], row["n"])
            strip = cells % row["strips"]
            for k in np.unique(strip):
                own = strip == k
                rows.append({**row, "strip": int(k), "n": int(own.sum()), "cells": _packed(cells[own]), "counts": _packed(counts[own])})
        yield pa.RecordBatch.from_pylist(rows, pa.schema(_STRIP_FIELDS))


_STRIP = "lang string, chunk long, tile int, n long, cells binary, counts binary, strips long, strip long"
_STRIP_FIELDS = [("lang", pa.string()), ("chunk", pa.int64()), ("tile", pa.int32()), ("n", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary()), ("strips", pa.int64()), ("strip", pa.int64())]
_KEY = ["lang", "tile", "strips", "strip"]


def strips_of(tiles: DataFrame, entries: int) -> DataFrame:
    """The tiles' rows with their strip; a tile has one per ``entries`` counted cells."""
    held = stage(tiles.groupBy("lang", "tile").agg(F.ceil(F.sum("n") / entries).alias("strips")))
    rows = tiles.join(held, ["lang", "tile"])
    whole = rows.filter("strips = 1").withColumn("strip", F.lit(0).cast("long"))
    if held.filter("strips > 1").isEmpty():
        return whole
    return whole.unionByName(rows.filter("strips > 1").mapInArrow(_deal, _STRIP))


def counted(cells: np.ndarray, counts: np.ndarray, strips: int, area: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a strip and their sums: by address where dense, else by sorted coordinates."""
    addresses = -(-area // strips)
    if addresses <= DENSE_CELLS and len(cells) * DENSE_SHARE >= addresses:
        sums = np.bincount(cells // strips, weights=counts, minlength=addresses)  # exact below 2**53
        at = np.flatnonzero(sums)
        return at * strips + (cells[0] % strips if len(cells) else 0), sums[at].astype(np.int64)
    order = np.argsort(cells, kind="stable")
    at = np.flatnonzero(np.diff(cells[order], prepend=-1))
    return cells[order][at], np.add.reduceat(counts[order], at) if len(at) else at


def _counter(least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, tile, strips, strip = (k.as_py() for k in key)
        sizes = table["n"].to_pylist()
        cells = np.concatenate([_unpacked(x, n) for x, n in zip(table["cells"].to_pylist(), sizes)])
        counts = np.concatenate([_unpacked(x, n) for x, n in zip(table["counts"].to_pylist(), sizes)])
        row, col = (np.array([x], dtype=np.int64) for x in divmod(tile, 64))
        cells, counts = counted(cells, counts, strips, int(_width(row)[0]) * int(_width(col)[0]))
        cells, counts = cells[counts >= least], counts[counts >= least]
        n, width = len(cells), int(_width(col)[0])
        same = {"lang": pa.array([lang] * n, pa.string()), "tile": pa.array([tile] * n, pa.int32()), "strips": pa.array([strips] * n, pa.int64()), "strip": pa.array([strip] * n, pa.int64())}
        return pa.table({**same, "cell": cells, "left": cells // width + _start(row), "right": cells % width + _start(col), "a": counts})

    return run


def _named(key: tuple[pa.Scalar, ...], chunks: pa.Table, frequent: pa.Table) -> pa.Table:
    """For every chunk's row of a strip, its frequent cells and their ids."""
    cell, ids = frequent["cell"].to_numpy(), frequent["id"].to_numpy()
    order = np.argsort(cell)
    cell, ids = cell[order], ids[order]
    out = {"chunk": [], "tile": [], "n": [], "cells": [], "ids": []}
    for chunk, tile, n, data in zip(*(chunks[c].to_pylist() for c in ("chunk", "tile", "n", "cells"))):
        own = _unpacked(data, n)
        at = np.searchsorted(cell, own)
        hit = cell[np.minimum(at, len(cell) - 1)] == own if len(cell) else np.zeros(n, dtype=bool)
        if hit.any():
            for name, value in zip(out, (chunk, tile, int(hit.sum()), _packed(own[hit]), _packed(ids[at[hit]]))):
                out[name].append(value)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({name: pa.array(values, t) for (name, values), t in zip(out.items(), types)})


def _words_to_ids(batches):
    """Streams of places in a chunk's word list become streams of ids; -1 for rare words and breaks."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            ids = np.full(max([x["at"] for x in row["found"] or []], default=0) + 2, -1, dtype=np.int64)
            for x in row["found"] or []:
                ids[x["at"]] = x["id"]
            stream = _unpacked(row["stream"], row["size"])
            stream = ids[np.where((stream < 0) | (stream >= len(ids)), len(ids) - 1, stream)]
            rows.append({"lang": row["lang"], "chunk": row["chunk"], "size": len(stream), "stream": _packed(stream)})
        yield pa.RecordBatch.from_pylist(rows, _STREAM_SCHEMA)


def _pairs_to_ids(batches):
    """Streams of ids become streams of the ids of neighbours; -1 for rare ones."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            stream = _unpacked(row["stream"], row["size"])
            tile, cell, _, where, inverse = pairs_of(stream)
            ids = np.full(len(tile), -1, dtype=np.int64)
            for x in row["found"]:
                low, high = np.searchsorted(tile, [x["tile"], x["tile"] + 1])
                ids[low + np.searchsorted(cell[low:high], _unpacked(x["cells"], x["n"]))] = _unpacked(x["ids"], x["n"])
            new = np.full(max(0, len(stream) - 1), -1, dtype=np.int64)
            new[where] = ids[inverse]
            rows.append({"lang": row["lang"], "chunk": row["chunk"], "size": len(new), "stream": _packed(new)})
        yield pa.RecordBatch.from_pylist(rows, _STREAM_SCHEMA)


_STREAM = "lang string, chunk long, size long, stream binary"
_STREAM_SCHEMA = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("size", pa.int64()), ("stream", pa.binary())])


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, chunk_words: int = CHUNK_WORDS, strip_entries: int = STRIP_ENTRIES) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for 1 .. ``longest`` words, (lang, id, phrase, a, pre, suf, left, right).

    ``id`` is the phrase's rank among the frequent ones of its length, ``pre`` and ``suf`` hold the
    counts of its first and last 1, 2, .. words, ``left`` and ``right`` the ids of the phrases of one word less.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = stage(rows.mapInArrow(_chunker(chunk_words), "lang string, chunk long, n long, size long, words array<string>, counts array<long>, stream binary"))
    totals = stage(chunks.groupBy("lang").agg(F.sum("n").alias("n")))
    each = chunks.select("lang", F.inline(F.arrays_zip("words", "counts")))
    words = stage(each.groupBy("lang", F.col("words").alias("phrase")).agg(F.sum("counts").alias("a")).filter(F.col("a") >= least))
    first = positions(words, ["lang"], [-F.col("a"), "phrase"]).withColumnRenamed("pos", "id")
    one = F.array("a")
    none = F.lit(None).cast("long")
    levels = [stage(first.select("lang", "id", "phrase", "a", one.alias("pre"), one.alias("suf"), none.alias("left"), none.alias("right")))]
    held = chunks.select("lang", "chunk", F.posexplode("words").alias("at", "phrase")).join(levels[0].select("lang", "phrase", "id"), ["lang", "phrase"])
    held = held.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("found"))
    streams = stage(chunks.drop("words", "counts", "n").join(held, "chunk", "left").mapInArrow(_words_to_ids, _STREAM))
    drop_staged(spark, chunks)
    for length in range(2, longest + 1):
        tiles = stage(streams.mapInArrow(_tiles, "lang string, chunk long, tile int, n long, cells binary, counts binary"))
        strips = strips_of(tiles, strip_entries)
        found = stage(strips.groupBy(*_KEY).applyInArrow(_counter(least), "lang string, tile int, strips long, strip long, cell long, left long, right long, a long"))
        ranked = stage(positions(found, ["lang"], [-F.col("a"), "left", "right"]).withColumnRenamed("pos", "id"))
        ends = [levels[-1].select("lang", F.col("id").alias(c), F.col("phrase").alias(f"{c}_phrase"), F.col(v).alias(v)) for c, v in (("left", "pre"), ("right", "suf"))]
        named = ranked.join(ends[0], ["lang", "left"]).join(ends[1], ["lang", "right"])
        phrase = F.concat_ws(" ", "left_phrase", F.substring_index("right_phrase", " ", -1)).alias("phrase")
        grown = [F.concat(v, F.array("a")).alias(v) for v in ("pre", "suf")]
        levels.append(stage(named.select("lang", "id", phrase, "a", *grown, "left", "right")))
        if length < longest:
            sides = strips.select(*_KEY, "chunk", "n", "cells").groupBy(*_KEY).cogroup(ranked.select(*_KEY, "cell", "id").groupBy(*_KEY))
            ids = sides.applyInArrow(_named, "chunk long, tile int, n long, cells binary, ids binary")
            ids = ids.groupBy("chunk").agg(F.collect_list(F.struct("tile", "n", "cells", "ids")).alias("found"))
            following = stage(streams.join(ids, "chunk").mapInArrow(_pairs_to_ids, _STREAM))
            drop_staged(spark, streams, tiles)
            streams = following
        else:
            drop_staged(spark, streams, tiles)
    return totals, levels


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, longest: int = 4, chunk_words: int = CHUNK_WORDS, strip_entries: int = STRIP_ENTRIES) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = frequent_phrases(docs, least, longest, chunk_words, strip_entries)
    kept = []
    for m in range(2, longest + 1):
        rows = levels[m - 1]
        cuts = []
        for k in range(1, m):
            left, right = F.col("pre")[k - 1], F.col("suf")[m - k - 1]
            score = F.expr(f"cast(a as decimal(20,0)) * cast({SCALE} as decimal(8,0)) div cast(pre[{k - 1}] + suf[{m - k - 1}] as decimal(20,0))")
            cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        cut = F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]
        if m < longest:  # the longer phrases around this one are at most as frequent as those of one word more
            longer = levels[m].select("lang", F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("b"))
            longer = longer.groupBy("lang", "id").agg(F.max("b").alias("b"))
            rows = rows.join(longer, ["lang", "id"], "left").filter(F.col("b").isNull() | (F.col("b").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * 80))
        kept.append(rows.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    found = kept[0]
    for other in kept[1:]:
        found = found.unionByName(other)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language's phrases are thinned out in parts first, so that its last task sorts a bounded number
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
