"""Chat formatting with loss masks aligned to token offsets.

A conversation's turns are rendered into one string, ``<s>[INST] role [/INST]text</s>`` per turn. The
whole string is encoded once; the tokens' character offsets and the sorted character spans of the
assistant turns are intersected by binary search, which gives the loss mask. The template's marks are
ids of their own, so no token reaches across the edge of a turn. Marks inside roles and texts, and
control strings of the form ``<|name|>`` that the tokenizer would take as ids of its own, are escaped
with a backslash behind their first character, and read back exactly.

Defined results: turns go by turn number (null first), then role and text; a null role or text is
empty; rows without conv_id form one conversation without id; a conversation of any length is one row
and is held by one task. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import worker_cache
from haulcast.llm.packing import tokenizer_path

# The marks of the template.
BEGIN, ROLE_OPEN, ROLE_CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = [BEGIN, ROLE_OPEN, ROLE_CLOSE, END]
# what turns a bracket into a control string: the template's marks, and strings such as <|endoftext|>
# that a tokenizer holds as control ids of its own
_REST = r"(?=(?:/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>))"
_MARK = re.compile(r"([<\[])(\\*)" + _REST)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _REST)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return _MARK.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character span of every turn's text."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{ROLE_OPEN} {escape(role)} {ROLE_CLOSE}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def chat_tokenizer(path: str):
    """The tokenizer with the template's marks as further ids, and offsets of whole tokens."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(mark, normalized=False) for mark in MARKS])
    return tokenizer


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token (sorted offsets) overlaps one of the sorted, disjoint spans."""
    mask = np.zeros(len(offsets), dtype=bool)
    spans = spans[spans[:, 1] > spans[:, 0]]
    if len(spans) and len(offsets):
        nearest = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
        inside = nearest < len(spans)
        mask[inside] = spans[nearest[inside], 0] < offsets[inside, 1]
    return mask


def masked_text(formatted: str, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> str:
    """All text under the loss mask, unescaped, in order."""
    out, at = [], None
    runs: list[list[int]] = []
    for a, b in zip(start[mask].tolist(), end[mask].tolist()):
        if at is not None and a <= at:
            runs[-1][1] = at = max(at, b)
        else:
            runs.append([a, b])
            at = b
    for a, b in runs:
        out.append(unescape(formatted[a:b]))
    return "".join(out)


FORMATTED = "conv_id long, formatted string, ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def _format(path: str):
    def run(batches):
        cache = worker_cache()
        if ("chat", path) not in cache:
            cache["chat", path] = chat_tokenizer(path)
        tokenizer = cache["chat", path]
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                pairs = [(t["role"], t["text"]) for t in turns]
                formatted, spans = render(pairs)
                done = tokenizer.encode(formatted, add_special_tokens=False)
                offsets = np.array(done.offsets, dtype=np.int64).reshape(-1, 2)
                learned = np.array([s for s, (role, _) in zip(spans, pairs) if role == LEARNED_ROLE], dtype=np.int64).reshape(-1, 2)
                rows.append((conv, formatted, done.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets, learned)))
            names = ["conv_id", "formatted", "ids", "token_start", "token_end", "loss_mask"]
            ints = pa.list_(pa.int32())
            types = [pa.int64(), pa.string(), ints, ints, ints, pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return run


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation: formatted text, token ids, character offsets and loss mask."""
    text = F.coalesce("text", F.lit("")).alias("text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text)
    grouped = turns.select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.mapInArrow(_format(path or tokenizer_path()), FORMATTED)


def _digest(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted")]
        lists = [batch.column(c) for c in ("token_start", "token_end", "loss_mask")]
        for k, (conv, formatted) in enumerate(zip(*columns)):
            turns = read_back(formatted)
            start, end, mask = (np.array(c[k].as_py()) for c in lists)
            learned = masked_text(formatted, start, end, mask.astype(bool))
            text = "".join(f"{role}\n{text}\n" for role, text in turns)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (text, learned)]
            rows.append((conv, len(turns), digests[0], len(learned), digests[1], len(formatted)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, in numbers and digests."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_digest, schema)
