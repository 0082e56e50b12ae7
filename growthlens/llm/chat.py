r"""Formats conversations at the level of tokens.

A turn becomes OPEN, the role, ROLE_END, the text, CLOSE. Role and text are encoded
on their own as ordinary text and the four marks are reserved ids beyond the
vocabulary, so no text can give a mark, whatever it says. In the string form the marks
are `### `, `: ` and `</turn>` with a line feed; a backslash stands before every
backslash and control string within a role or text, and before each `:` of a role, and
reading takes what follows a backslash as it is. The loss mask covers the tokens of
assistant texts alone: +1 where such a text starts, -1 where it ends, summed up.

Turns are ordered by turn (null first), then role, then a hash of the text. Null roles
and texts are empty. Repeated rows are turns of their own. Rows of a null conversation
id form one conversation. The output has a row a turn, so a conversation of any length
is read in bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm.tables import materialize, small_batches

MARKS = ("### ", ": ", "</turn>\n")
#: Strings that content may not hold bare.
CONTROL = re.compile(r"\\|### |</turn>")
LOSS_ROLE = "assistant"


def escape(text: str, role: bool = False) -> str:
    out = CONTROL.sub(lambda m: "\\" + m[0], text)
    return out.replace(":", "\\:") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Tokens:
    """Ordinary encoding of a public vocabulary, and reserved ids after it for the marks."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("ordinary", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.open, self.role_end, self.close = range(max(known.values()) + 1, max(known.values()) + 4)
        self.marks = dict(zip((self.open, self.role_end, self.close), MARKS, strict=True))

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn and its loss mask."""
        head, body = self.coder.encode_ordinary(escape(role, role=True)), self.coder.encode_ordinary(escape(text))
        ids = np.array([self.open, *head, self.role_end, *body, self.close], np.int32)
        edge = np.zeros(len(ids) + 1, np.int8)
        if role == LOSS_ROLE:
            edge[len(head) + 2] += 1
            edge[len(head) + 2 + len(body)] -= 1
        return ids, np.cumsum(edge[:-1], dtype=np.int8)

    def text(self, ids: np.ndarray) -> str:
        """The string form of ids."""
        out, start = [], 0
        for at in [*np.flatnonzero(ids >= self.open).tolist(), len(ids)]:
            out.append(self.coder.decode_bytes(ids[start:at].tolist()).decode())
            if at < len(ids):
                out.append(self.marks[int(ids[at])])
            start = at + 1
        return "".join(out)

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn."""
        end = int(np.flatnonzero(ids == self.role_end)[0])
        head, body = (self.coder.decode_bytes(x.tolist()).decode() for x in (ids[1:end], ids[end + 1 : -1]))
        return unescape(head), unescape(body)


_TOKENS: dict[bytes, Tokens] = {}


def _tokens(ranks: bytes, pattern: str) -> Tokens:
    key = hashlib.sha256(ranks).digest()
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(ranks, pattern)
    return _TOKENS[key]


def _encode(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = _tokens(ranks, pattern)
    for batch in batches:
        turns = [coder.turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        names = ["conv_id", "turn", "role", "tie"]
        columns = [batch.column(c) for c in names]
        columns += [pa.array([i for i, _ in turns], pa.list_(pa.int32())), pa.array([m for _, m in turns], pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "mask"])


def _read(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """Reads turns in order of conversation and keeps digests, not texts."""
    coder = _tokens(ranks, pattern)
    done: list[tuple] = []
    now: object = ()
    turns = loss = None
    n = loss_chars = chars = n_tokens = n_loss = 0

    def close() -> None:
        if turns is not None:
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_tokens, n_loss))

    schema = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string() if c.endswith("sha256") else pa.int64() for c in schema]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema)

    for batch in batches:
        for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
            if conv != now or turns is None:
                close()
                now, turns, loss = conv, hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = n_tokens = n_loss = 0
            ids, mask = np.array(ids, np.int32), np.array(mask, bool)
            role, text = coder.read(ids)
            turns.update(f"{role}\n{text}\n".encode())
            learned = unescape(coder.coder.decode_bytes(ids[mask].tolist()).decode())
            loss.update(learned.encode())
            loss_chars += len(learned)
            chars += len(coder.text(ids))
            n, n_tokens, n_loss = n + 1, n_tokens + len(ids), n_loss + int(mask.sum())
        if done:
            yield batch_of(done)
            done.clear()
    close()
    if done:
        yield batch_of(done)


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def format_turns(conversations: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row a turn: conv_id, turn, role, tie, ids, mask; a conversation is its rows in order of turn, role, tie."""
    ranks = _vocabulary(conversations.sparkSession, vocabulary)
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(lambda it: _encode(it, ranks.value, pattern), "conv_id long, turn long, role string, tie long, ids array<int>, mask array<tinyint>")


def read_back(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Counts and digests of each conversation, from the ids and masks of format_turns() alone."""
    ranks = _vocabulary(turns.sparkSession, vocabulary)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(lambda it: _read(it, ranks.value, pattern), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def round_trip(conversations: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Formats, writes the formatted turns, and reads them back."""
    return read_back(materialize(format_turns(conversations, vocabulary, pattern)), vocabulary, pattern)
