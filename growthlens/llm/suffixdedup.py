"""Removes every byte that a repeated string of `length` bytes covers.

A window is a string of `length` bytes within one document; it is repeated if it
starts anywhere else too. Finding the repeated windows takes four steps:

1. Anchors. A window's anchor is its first gram of GRAM bytes of least hash. Equal
   windows have equal anchors at equal places, so a window can only be repeated if its
   anchor's gram occurs twice. Anchors are counted over the whole corpus.
2. Contexts. The windows of one anchor are neighbours; their bytes are its context.
   A context that occurs twice is repeated as a whole. The distinct contexts of a
   gram go to one shard.
3. Shards. A shard lays its contexts end to end, sorts their suffixes by
   Larsson-Sadakane refinement, and gets common prefixes by Kasai's rule; neighbours with a common prefix of `length` bytes are repeated windows.
   A group of contexts that outgrows a shard is cut into several, which are merged by
   binary search of the windows of one among the sorted windows of the other. Shards
   that have no group in common are never searched in each other.
4. Spans. Repeated windows are laid back on the documents and merged.

A gram in very many different contexts, as at the edges of a common passage, would
make one large group. Its windows are split by how far they start before the anchor,
doubling from step to step, and go by a hash of the bytes that all windows of a step
share; so only windows that agree in most bytes still meet. Where more than `crowd`
different texts share even those, no task can hold them all: their windows, of which a
text has fewer than `length`, go one by one by a hash of their own bytes.

Null texts count as empty. Equal texts of at least `length` bytes vanish as a whole, and
texts that are shorter never change. Rows are told apart by id and a hash of the text,
so repeated rows repeat each other, and null ids and ids that are not unique do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import textops as T
from growthlens.llm.tables import discard, materialize, small_batches

LENGTH = 400
GRAM = 128
#: Different contexts of a gram beyond which its windows are split by distance and content.
MANY_CONTEXTS = 256
#: Different texts of one key that a task sorts; windows of a key that has more are dealt one by one.
CROWD = 512
#: Bytes of contexts sorted at once; positions and ranks must fit in 20 bits each.
SHARD_BYTES = 1 << 18
#: Bytes of contexts that one task sorts, shard by shard; plans shaped by compressed bytes would make tasks uneven.
TASK_BYTES = 8 << 20
_HALF = np.uint64(20)


# ---- anchors ---------------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width`: running minima from both ends of blocks of that size."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """For each anchor: its document, gram hash and place, the stretch [start, end) of its windows in `data`, and two hashes of that stretch."""
    none = {c: np.zeros(0, np.int64) for c in ("doc", "gram", "place", "start", "end", "c1", "c2")}
    if len(data) < length:
        return none
    prefix = T.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = (prefix[gram:] - prefix[:-gram]) * T.powers(len(at), inverse=True)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    bits = np.uint64(max(1, int(len(at)).bit_length()))
    place = np.uint64((1 << int(bits)) - 1)
    least = _least(hashes & ~place | at.astype(np.uint64), length - gram + 1)
    inside = np.ones(len(least), bool)
    for e in offsets[1:-1].tolist():  # no window goes over the end of a document
        inside[max(0, e - length + 1) : e] = False
    begin = np.flatnonzero(inside)
    if not len(begin):
        return none
    best = (least[begin] & place).astype(np.int64)
    doc = np.searchsorted(offsets, begin, "right") - 1
    new = np.ones(len(begin), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    start, end, best = begin[first], begin[last] + length, best[first]
    # The second hash is of eighths that are mixed one by one, so it shares no algebra with the first.
    second = np.zeros(len(first), np.uint64)
    for k in range(8):
        a, b = start + (end - start) * k // 8, start + (end - start) * (k + 1) // 8
        second = T.mix(second ^ T.span_hash(prefix, a, b))
    return {"doc": doc[first], "gram": hashes[best].view(np.int64), "place": best, "start": start, "end": end, "c1": T.span_hash(prefix, start, end).view(np.int64), "c2": second.view(np.int64)}


@T.tidy
def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            data, offsets = T.flat(part.column("text"))
            found = anchors(data, offsets, length, gram)
            doc = found["doc"]
            columns = [part.column(c).take(pa.array(doc)) for c in ("doc", "nth")]
            columns += [pa.array(found["start"] - offsets[doc]), pa.array((found["end"] - found["start"]).astype(np.int32)), pa.array(found["gram"]), pa.array((found["place"] - found["start"]).astype(np.int32)), pa.array(found["c1"]), pa.array(found["c2"])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "nth", "start", "size", "gram", "at", "c1", "c2"])


# ---- suffix arrays ---------------------------------------------------------


class Shard:
    """Contexts end to end, with their suffixes sorted and the common prefixes of neighbours."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.lead = np.cumsum([0] + [len(t) for t in texts])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        self.left = np.repeat(self.lead[1:], np.diff(self.lead)) - np.arange(n)
        wide = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words = self.words << np.uint64(8) | wide[k : k + n]
        self.order = self._sort()
        self.common = self._kasai()

    def _sort(self) -> np.ndarray:
        """Larsson-Sadakane: ranks by 5 bytes, then twice as deep each round, only where ranks still tie.

        A context ends before every byte, so a suffix cut short never ties with a longer one.
        """
        n = len(self.data)
        if n >= 1 << int(_HALF):
            raise ValueError("a shard must have fewer than 2**20 bytes")
        short = np.minimum(self.left, 5).astype(np.uint64)
        known = self.words >> np.uint64(8) * (np.uint64(8) - short) << np.uint64(8) * (np.uint64(5) - short)
        # Five bytes, how many of them there are and whether more follow, and the place: one number, sorted as such.
        more = np.minimum(self.left, 6).astype(np.uint64)
        start = np.sort(((known << np.uint64(3) | more) << _HALF) | np.arange(n, dtype=np.uint64))
        order = (start & np.uint64((1 << int(_HALF)) - 1)).astype(np.int64)
        rank = np.zeros(n, np.uint64)
        key = start >> _HALF
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        group = np.flatnonzero(new)
        rank[order] = np.repeat(group, np.diff(np.append(group, n))).astype(np.uint64)
        size = np.diff(np.append(group, n))
        tied = order[np.repeat(size > 1, size)]  # in order of rank
        depth = 5
        low = np.uint64((1 << int(_HALF)) - 1)
        while True:
            # Suffixes that end within the depth and still tie are equal: only the others are refined.
            tied = tied[self.left.take(tied) > depth]
            if not len(tied):
                return order
            packed = np.sort(rank.take(tied) << (_HALF * np.uint64(2)) | (rank.take(tied + depth) + np.uint64(1)) << _HALF | tied.astype(np.uint64))
            tied = (packed & low).astype(np.int64)
            pair = packed >> _HALF
            fresh = np.ones(len(tied), bool)
            fresh[1:] = pair[1:] != pair[:-1]
            # Members of a tie take the places from its rank on, in their new order.
            old = (pair >> _HALF).astype(np.int64)
            head = np.ones(len(tied), bool)
            head[1:] = old[1:] != old[:-1]
            head = np.flatnonzero(head)
            place = np.arange(len(tied)) + np.repeat(old[head] - head, np.diff(np.append(head, len(tied))))
            order[place] = tied
            group = np.flatnonzero(fresh)
            size = np.diff(np.append(group, len(tied)))
            rank[tied] = np.repeat(place[group], size).astype(np.uint64)
            tied = tied[np.repeat(size > 1, size)]
            depth *= 2

    def _kasai(self) -> np.ndarray:
        """Common prefix of each whole window's suffix with the one before it in order; 0 elsewhere.

        Kasai's rule, that the prefix shrinks by one at most from a place to the next, is
        run through all contexts side by side, eight bytes a comparison.
        """
        n = len(self.data)
        before = np.full(n, -1)
        before[self.order[1:]] = self.order[:-1]
        out = np.zeros(n, np.int64)
        h = np.zeros(len(self.lead) - 1, np.int64)
        size = np.diff(self.lead)
        lanes = np.flatnonzero(size >= self.length)
        for t in range(int(size.max(initial=0)) - self.length + 1):
            lanes = lanes[size[lanes] - t >= self.length]
            i = self.lead[lanes] + t
            j = before[i]
            limit = np.where(j >= 0, np.minimum(self.left[i], self.left[j]), 0)
            now = np.minimum(np.maximum(h[lanes] - 1, 0), limit)
            busy = np.flatnonzero(now < limit)
            while len(busy):
                x = self.words[i[busy] + now[busy]] ^ self.words[j[busy] + now[busy]]
                # Leading equal bytes: a float's exponent finds the highest bit set.
                same = np.where(x == 0, 8, (63 - (np.frexp((x >> np.uint64(11)).astype(np.float64))[1] + 10)) >> 3)
                same = np.where((x != 0) & (x >> np.uint64(11) == 0), 6 + (x < 256), same)
                now[busy] = np.minimum(now[busy] + same, limit[busy])
                busy = busy[(same == 8) & (now[busy] < limit[busy])]
            h[lanes] = out[i] = now
        return out

    def repeated(self) -> np.ndarray:
        """True at each place whose window starts elsewhere in the shard too."""
        hit = self.common >= self.length
        out = hit.copy()
        at = np.flatnonzero(hit[self.order])
        out[self.order[at - 1]] = True
        return out

    def windows(self) -> np.ndarray:
        """Starts of whole windows, in order of their bytes."""
        return self.order[self.left[self.order] >= self.length]

    def _compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the windows of this shard are less than, equal to or greater than those of the other."""
        out = np.zeros(len(mine), np.int64)
        todo = np.arange(len(mine))
        for k in (*range(0, self.length - 8, 8), max(0, self.length - 8)):
            x, y = self.words[mine[todo] + k], other.words[theirs[todo] + k]
            out[todo] = np.where(x < y, -1, np.where(x > y, 1, 0))
            todo = todo[x == y]
            if not len(todo):
                break
        return out

    def found_in(self, other: Shard) -> np.ndarray:
        """True at each place whose window is one of the other shard's: binary search among its sorted windows."""
        out = np.zeros(len(self.data), bool)
        mine, theirs = self.windows(), other.windows()
        if not len(mine) or not len(theirs):
            return out
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) // 2
            greater = self._compare(mine[open_], other, theirs[mid]) > 0
            low[open_] = np.where(greater, mid + 1, low[open_])
            high[open_] = np.where(greater, high[open_], mid)
        at = np.minimum(low, len(theirs) - 1)
        out[mine[self._compare(mine, other, theirs[at]) == 0]] = True
        return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeats(groups: list[list[bytes]], length: int, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """For texts in groups: (group, text, start, end) of the bytes that repeated windows cover.

    Groups are packed into shards; those that a group is cut into are searched in each other.
    """
    texts = [(g, i, t) for g, group in enumerate(groups) for i, t in enumerate(group)]
    shards: list[list[tuple[int, int, bytes]]] = [[]]
    size = 0
    for item in texts:
        if size + len(item[2]) > limit and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(item)
        size += len(item[2])
    built = [Shard([t for _, _, t in part], length) for part in shards]
    flags = [s.repeated() for s in built]
    spans = [(part[0][0], part[-1][0]) if part else (1, 0) for part in shards]
    for a in range(len(built)):
        for b in range(len(built)):
            if a != b and max(spans[a][0], spans[b][0]) <= min(spans[a][1], spans[b][1]):
                flags[a] |= built[a].found_in(built[b])
    for part, shard, flag in zip(shards, built, flags, strict=True):
        first, end = _runs(flag)
        owner = np.searchsorted(shard.lead, first, "right") - 1
        for k, s, e in zip(owner.tolist(), first.tolist(), end.tolist(), strict=True):
            g, i, _ = part[k]
            yield g, i, s - int(shard.lead[k]), e - 1 - int(shard.lead[k]) + length


@T.tidy
def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; gives the covered stretches of each text (c1, c2), which may come more than once."""
    held: list[tuple[int, dict[bytes, tuple[int, int]]]] = []
    size = 0

    def solve() -> pa.RecordBatch:
        names = [list(texts) for _, texts in held if len(texts) > 1]
        owners = [list(texts.values()) for _, texts in held if len(texts) > 1]
        out = [(*owners[g][i], s, e) for g, i, s, e in repeats(names, length, limit)] if names else []
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["c1", "c2", "lo", "hi"])

    for batch in batches:
        for key, c1, c2, text in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "bytes")), strict=True):
            if not held or held[-1][0] != key:
                if size >= limit:
                    yield solve()
                    held, size = [], 0
                elif held and len(held[-1][1]) < 2:
                    size -= len(next(iter(held.pop()[1])))  # a text alone repeats nothing
                held.append((key, {}))
            if text not in held[-1][1]:
                held[-1][1][text] = (c1, c2)
                size += len(text)
    if held:
        yield solve()


@T.tidy
def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each window of each text (s1, s2): two hashes of it, and its place."""
    for batch in batches:
        for a, b in T.slices(batch, "bytes"):
            part = batch.slice(a, b - a)
            data, offsets = T.flat(part.column("bytes"))
            prefix = T.prefix_hash(data)
            count = np.maximum(np.diff(offsets) - length + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[row] + at
            second = np.zeros(len(row), np.uint64)
            for k in range(8):  # hashed by eighths, as contexts are
                second = T.mix(second ^ T.span_hash(prefix, start + length * k // 8, start + length * (k + 1) // 8))
            columns = [pa.array(T.span_hash(prefix, start, start + length).view(np.int64)), pa.array(second.view(np.int64)), *(part.column(c).take(pa.array(row)) for c in ("s1", "s2")), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "s1", "s2", "at"])


# ---- whole tables ----------------------------------------------------------


def _steps(length: int, gram: int) -> list[tuple[int, int]]:
    """Least and greatest distance of window start to anchor, doubling."""
    most, out, low = length - gram, [(0, 0)], 1
    while low <= most:
        out.append((low, min(2 * low - 1, most)))
        low *= 2
    return out


@T.tidy
def _strip(batches: Iterator[pa.RecordBatch], whole_characters: bool, with_text: bool, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            rows = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                if whole_characters:  # a character goes only if all its bytes do
                    for s in merged:
                        while s[0] < s[1] and raw[s[0]] & 0xC0 == 0x80:
                            s[0] += 1
                        while s[0] < s[1] and s[1] < len(raw) and raw[s[1]] & 0xC0 == 0x80:
                            s[1] -= 1
                    merged = [s for s in merged if s[0] < s[1]]
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest.decode() if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            kept = [part.column(f"keep_{c}") for c in keep]
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *kept], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *(f"keep_{c}" for c in keep)])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int | None = None, many: int = MANY_CONTEXTS, limit: int = SHARD_BYTES, crowd: int = CROWD) -> DataFrame:
    """Columns key, nth, spans of the rows of `rows(key, nth, text)` that have repeated windows; spans may overlap.

    Grams have GRAM bytes, or half a window where that is less.
    """
    gram = min(GRAM, length // 2) if gram is None else gram
    long_ = rows.where(F.octet_length("text") >= length).select(F.col("key").alias("doc"), "nth", "text")
    schema = "doc long, nth long, start long, size int, gram long, at int, c1 long, c2 long"
    every = materialize(long_.mapInArrow(lambda it: _anchor_rows(it, length, gram), schema))
    # A gram that occurs once has nothing to tell; most do, so only their hashes are shuffled to find that out.
    again = materialize(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))  # a plain table, so Spark can split a gram of very many places
    members = materialize(every.join(again, "gram", "left_semi"))
    discard(every, again)
    # One row a context, with the first of its places: all of them hold the same bytes. Copies fold before they are shuffled.
    classes = materialize(members.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "nth", "start", "size", "at"))))
    kinds = materialize(classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")).where("kinds > 1"))
    # Both sides are plain tables, so Spark can split a gram of very many contexts.
    wanted = classes.join(kinds.select("gram", "kinds"), "gram").groupBy("doc", "nth").agg(F.collect_list(F.struct("start", "size", "gram", "at", "kinds", "c1", "c2")).alias("w"))
    cut = F.transform("w", lambda x: F.struct(x["gram"].alias("gram"), x["at"].alias("at"), x["kinds"].alias("kinds"), x["c1"].alias("c1"), x["c2"].alias("c2"), F.substring(F.col("text").cast("binary"), (x["start"] + 1).cast("int"), x["size"]).alias("bytes")))
    # Repeated rows hold the same bytes; each has its contexts cut, and shards see one of them.
    texts = materialize(long_.join(wanted, ["doc", "nth"]).select(F.inline(cut)))
    few = texts.where(F.col("kinds") <= many).select(F.col("gram").alias("key"), "c1", "c2", "bytes")
    parts = []
    for near, far in _steps(length, gram):
        # Windows that start `near` to `far` before the anchor, as far as the context has them.
        low, high = F.greatest(F.col("at") - far, F.lit(0)), F.least(F.col("at") - near, F.octet_length("bytes") - length)
        core = F.expr(f"substring(bytes, at - {near} + 1, {length + near - far})")
        parts.append(F.when(low <= high, F.struct(F.xxhash64(core, F.lit(near), F.lit(length)).alias("key"), low.cast("int").alias("off"), (high - low + length).cast("int").alias("size"))))
    split = texts.where(F.col("kinds") > many).select("c1", "c2", "bytes", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("p")).withColumn("part", F.expr("substring(bytes, p.off + 1, p.size)"))
    # What several contexts share of a step is one text, as contexts are: counted once, and searched once.
    pieces = materialize(split.select("p.key", F.xxhash64("part", F.lit(1)).alias("s1"), F.xxhash64("part", F.lit(2)).alias("s2"), "c1", "c2", "p.off", "p.size").distinct())
    shared = materialize(pieces.groupBy("key", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("c1", "c2", "off", "size")).alias("one")))
    meet = materialize(shared.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    chosen = shared.join(meet, "key").select("key", "kinds", "s1", "s2", "one.*")
    bytes_of = texts.where(F.col("kinds") > many).select("c1", "c2", "bytes")
    far_apart = materialize(chosen.join(bytes_of, ["c1", "c2"]).select("key", "kinds", F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.expr("substring(bytes, off + 1, size)").alias("bytes")))
    load = kinds.agg(F.sum("bytes")).first()[0] or 0
    shards = max(int(_partitions(rows)), -(-load // TASK_BYTES))
    search = lambda df: df.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(lambda it: _sorted_shards(it, length, limit), "c1 long, c2 long, lo int, hi int")
    # Texts of a crowded key share all but a few bytes: windows fold in every task before they are shuffled, and plain tables let Spark split a window of many texts.
    windows = materialize(far_apart.where(F.col("kinds") > crowd).select(F.col("c1").alias("s1"), F.col("c2").alias("s2"), "bytes").mapInArrow(lambda it: _windows(it, length), "w1 long, w2 long, s1 long, s2 long, at int"))
    twice = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"))
    crowded = windows.join(twice, ["w1", "w2"], "left_semi").select("s1", "s2", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    owners = pieces.select(F.col("s1"), F.col("s2"), "c1", "c2", "off", "size")
    sorted_ = search(far_apart.where(F.col("kinds") <= crowd).select("key", "c1", "c2", "bytes")).withColumnsRenamed({"c1": "s1", "c2": "s2"})
    found = sorted_.unionByName(crowded).unionByName(shared.where("n > 1").select("s1", "s2", F.lit(0).alias("lo"), F.col("one.size").alias("hi"))).distinct()
    of_pieces = found.join(owners, ["s1", "s2"]).select("c1", "c2", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    whole = classes.where("n > 1").select("c1", "c2", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    partial = search(few).unionByName(of_pieces)
    covers = materialize(partial.unionByName(whole).groupBy("c1", "c2").agg(F.collect_set(F.struct("lo", "hi")).alias("covers")))
    discard(classes, kinds, texts, pieces, shared, meet, far_apart, windows, twice)
    placed = members.select("doc", "nth", "start", "c1", "c2").join(covers, ["c1", "c2"]).select("doc", "nth", F.transform("covers", lambda x: F.struct((F.col("start") + x["lo"]).alias("lo"), (F.col("start") + x["hi"]).alias("hi"))).alias("s"))
    spans = materialize(placed.groupBy("doc", "nth").agg(F.flatten(F.collect_set("s")).alias("spans")).withColumnRenamed("doc", "key"))
    discard(members, covers)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, with_text: bool = False, keep: tuple[str, ...] = (), gram: int | None = None, many: int = MANY_CONTEXTS, limit: int = SHARD_BYTES, crowd: int = CROWD) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text if asked for, and keep_<column> for each column of `keep`.

    With `whole_characters` a character is removed only if all its bytes are covered.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    rows = rows.select("id", F.coalesce("id", F.lit(0).cast("long")).alias("key"), F.xxhash64("text").alias("nth"), "text", *(f"keep_{c}" for c in keep))
    spans = repeated_spans(rows.select("key", "nth", "text"), length, gram, many, limit, crowd)
    joined = rows.join(spans, ["key", "nth"], "left")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string" + "".join(f", keep_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = joined.mapInArrow(lambda it: _strip(it, whole_characters, with_text, keep), schema).drop(*([] if with_text else ["kept_text"]))
    return out.withColumnRenamed("id", id_col)
