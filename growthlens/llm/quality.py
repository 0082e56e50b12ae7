"""Line-first cleaning: rules drop lines, then documents that lost too much are rejected.

A line is a part of the text between line feeds. One without a word is left as it
is and breaks no rule. A line with words is dropped if it breaks one of these:

* punctuation: fewer than SHORT_LINE words and none of the CLOSING characters at the end;
* navigation: at most NAV_WORDS words, at least half of them menu words or separators;
* boilerplate: it holds one of the BOILERPLATE phrases, in any letter case of A-Z.

A document is kept if it passes the base rules (at least MIN_WORDS words, at most
MAX_REPEAT percent of them in repeated five-word windows) and keeps at least
MIN_LEFT of the characters of its words. Null and empty texts have no words and
fail the base rules. Equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import textops as T
from growthlens.llm.tables import small_batches

MIN_WORDS = 10
MAX_REPEAT = 20
SHORT_LINE = 4
NAV_WORDS = 12
MIN_LEFT = 0.5
#: Characters that close a line: full stops, questions, exclamations, colons, ellipses, and closing quotes and brackets of many scripts.
CLOSING = ".!?:;\"')]}\u00bb\u2019\u201c\u201d\u2026\u203a\u0589\u05c3\u061b\u061f\u06d4\u0964\u0965\u0f0d\u104b\u1362\u17d4\u3002\u3009\u300b\u300d\u300f\u3011\uff01\uff09\uff0e\uff1a\uff1b\uff1f\uff61\uff63"
MENU = (b"home", b"menu", b"login", b"logout", b"search", b"contact", b"about", b"next", b"previous", b"sitemap", b"share", b"subscribe", b"register", b"help", b"faq", b"|", b">", b"<", b"/", b"-", b"\xc2\xbb", b"\xc2\xab", b"\xc2\xb7", b"\xe2\x80\xba", b"\xe2\x80\xa2")
BOILERPLATE = (b"all rights reserved", b"privacy policy", b"terms of use", b"terms of service", b"cookie policy", b"uses cookies", b"enable javascript", b"javascript is disabled", b"lorem ipsum", b"click here to", b"powered by", b"sign up for our newsletter", b"subscribe to our")

_CLOSES = np.array(sorted(map(ord, CLOSING)))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _of_bytes(words: tuple[bytes, ...]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(T.span_hash(T.prefix_hash(data), ends - [len(w) for w in words], ends))


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def repeated(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 64-bit values with an owner: which occur twice or more there, and which have an equal one before."""
    both = T.mix(values ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    twice, later = np.zeros(len(both), bool), np.zeros(len(both), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def last_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code point of the UTF-8 character whose last byte is at each place."""
    point = data[at].astype(np.int64)
    rest = point >= 0x80  # the last byte of a longer character
    point[rest] &= 0x3F
    for k, bits in ((1, 0x1F), (2, 0x0F), (3, 0x07)):
        byte = data[np.maximum(at - k, 0)].astype(np.int64)
        more = rest & (byte & 0xC0 == 0x80)
        point += np.where(rest, (byte & np.where(more, 0x3F, bits)) << 6 * k, 0)
        rest = more
    return point


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of each document, and under "drop", "line_start", "line_end" and "line_doc" the lines."""
    n_docs = len(offsets) - 1
    docs = np.arange(n_docs)
    start, end, n_words = T.words(data, offsets)
    word_doc = np.repeat(docs, n_words)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[end] - points[start]
    prefix = T.prefix_hash(data)
    each = T.span_hash(prefix, start, end)

    run = T.windows(each, 5)
    at = np.flatnonzero(word_doc[:-4] == word_doc[4:]) if len(run) else np.zeros(0, np.int64)
    twice, _ = repeated(run[at], word_doc[at])
    cover = np.zeros(len(each) + 6, np.int64)
    cover[at[twice]] += 1
    np.subtract.at(cover, at[twice] + 5, 1)
    in_repeat = np.cumsum(cover)[: len(each)] > 0

    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    feeds = np.flatnonzero(data == 10)
    nonempty = offsets[:-1][offsets[:-1] < offsets[1:]]
    line_start = np.union1d(nonempty, np.setdiff1d(feeds + 1, offsets, assume_unique=False))
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, line_start)], offsets[line_doc + 1])
    first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    has = last > first
    line_start, line_end, line_doc, first, last = (x[has] for x in (line_start, line_end, line_doc, first, last))
    _, again = repeated(T.span_hash(prefix, line_start, line_end), line_doc)

    count = last - first
    lowered = T.LOWER[data]
    closed = np.isin(last_points(data, end[last - 1] - 1), _CLOSES) if len(last) else np.zeros(0, bool)
    drop = (count < SHORT_LINE) & ~closed
    nav = np.concatenate([[0], np.cumsum(_isin(T.span_hash(T.prefix_hash(lowered), start, end), _MENU_HASHES))]) if len(start) else np.zeros(1, np.int64)
    drop |= (count <= NAV_WORDS) & (2 * (nav[last] - nav[first]) >= count)
    raw = lowered.tobytes()
    for phrase in BOILERPLATE:
        p = raw.find(phrase)
        while p >= 0:
            k = np.searchsorted(line_start, p, "right") - 1
            if k >= 0 and p + len(phrase) <= line_end[k]:
                drop[k] = True
            p = raw.find(phrase, p + 1)
    total = np.concatenate([[0], np.cumsum(chars)])
    lost = np.bincount(line_doc[drop], (total[last] - total[first])[drop], n_docs).astype(np.int64)
    edge = np.searchsorted(start, offsets)
    word_chars = total[edge[1:]] - total[edge[:-1]]
    n_repeat = np.concatenate([[0], np.cumsum(in_repeat)])
    n_repeat = n_repeat[edge[1:]] - n_repeat[edge[:-1]]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_doc[again], minlength=n_docs).astype(np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (word_chars - lost >= MIN_LEFT * word_chars),
        "n_lines": np.bincount(line_doc, minlength=n_docs).astype(np.int64),
        "n_lines_dropped": np.bincount(line_doc[drop], minlength=n_docs).astype(np.int64),
        "chars_dropped": lost,
        "drop": drop,
        "line_start": line_start,
        "line_end": line_end,
        "line_doc": line_doc,
    }


_MENU_HASHES = _of_bytes(MENU)
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_dropped", "chars_dropped")
_SCHEMA = "id long, " + ", ".join(f"{c} long" for c in _LONGS) + ", base_failed boolean, kept boolean"


def _cleaned(data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray]) -> list[str]:
    """The texts without their dropped lines and the line feeds that ended these."""
    raw, out = data.tobytes(), []
    edges = np.searchsorted(found["line_doc"], np.arange(len(offsets)))
    for d in range(len(offsets) - 1):
        at, parts = int(offsets[d]), []
        for k in range(edges[d], edges[d + 1]):
            if found["drop"][k]:
                parts.append(raw[at : found["line_start"][k]])
                at = min(int(found["line_end"][k]) + 1, int(offsets[d + 1]))
        parts.append(raw[at : offsets[d + 1]])
        out.append(b"".join(parts).decode())
    return out


@T.tidy
def _rows(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            data, offsets = T.flat(part.column("text"))
            found = measure(data, offsets)
            columns = [part.column("id"), *(pa.array(found[c].astype(np.int64)) for c in _LONGS), pa.array(found["base_failed"]), pa.array(found["kept"])]
            names = ["id", *_LONGS, "base_failed", "kept"]
            if with_text:
                columns.append(pa.array(_cleaned(data, offsets, found), pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Figures and verdict of each row of `docs` and, if asked for, its text without the dropped lines."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = _SCHEMA + (", clean_text string" if with_text else "")
    return source.mapInArrow(lambda it: _rows(it, with_text), schema).withColumnRenamed("id", id_col)
