"""MinHash near-duplicates by a multi-index Hamming join.

Each text becomes a signature of SYMBOLS b-bit MinHash symbols. Two texts are
candidates if their signatures differ in at most `max_distance` symbols. To find
all such pairs without comparing everything, the signature is split into chunks;
by the pigeonhole principle, a pair within the distance has a chunk with at most
`max_distance // chunks` errors, and those errors are enumerated by masking that
many symbols of the chunk. Candidates are confirmed on the full shingle sets.

Equal sets are one class from the start, so copies never meet each other. Two
exact bounds keep groups of near copies from becoming all pairs: shingles that
no other indexed text has are in no intersection, so they lower the similarity
a text can reach with any other; and each index key first compares its members
with one leader, the member with the fewest such shingles, and only members of
different components that the bound admits meet each other after that. No link
that joins two components is lost.

Nulls and texts without words have an empty set and are linked with nothing.
Ties go to the smallest id. Repeated rows are copies of each other.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm import textops as T
from growthlens.llm.tables import discard, materialize, measured_joins, small_batches

SYMBOLS = 64
#: Similarity, in percent, from which texts are linked.
PERCENT = 80
#: Chance with which a pair of exactly the similarity may differ in more symbols than are searched.
MISSED = 1 / 50_000


@functools.cache
def limits(percent: int) -> tuple[int, int]:
    """Most symbols in which a candidate pair differs, and the chunks that leave one error a chunk to enumerate: 23 and 12 for 85, 27 and 14 for 80."""
    if not 0 < percent <= 100:
        raise ValueError(f"{percent} is no percentage")
    p, tail, most = 1 - percent / 100, 0.0, SYMBOLS
    while tail + (more := math.comb(SYMBOLS, most) * p**most * (1 - p) ** (SYMBOLS - most)) <= MISSED and most > 1:
        tail += more
        most -= 1
    chunks = most // 2 + 1
    if SYMBOLS // chunks < 3:
        raise ValueError(f"{SYMBOLS} symbols do not cover a similarity of {percent} percent")
    return most, chunks


MAX_DISTANCE, CHUNKS = limits(PERCENT)

#: Members of a key that one task compares with as many others.
BLOCK = 2048

_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """uint16 MinHash symbols, one row for each non-empty set."""
    full = lead[:-1][lead[:-1] < lead[1:]]
    out = np.zeros((len(full), SYMBOLS), np.uint16)
    if len(full):
        for k in range(SYMBOLS):
            low = np.minimum.reduceat((shingles ^ _XOR[k]) * _MUL[k], full)
            out[:, k] = (T.mix(low) >> np.uint64(40)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, chunks: int = CHUNKS, max_distance: int = MAX_DISTANCE) -> np.ndarray:
    """One 64-bit key for each chunk and each allowed set of masked symbols."""
    errors = max_distance // chunks
    edges = np.linspace(0, sig.shape[1], chunks + 1).astype(int)
    keys = []
    for c, (a, b) in enumerate(itertools.pairwise(edges)):
        for masked in itertools.combinations(range(a, b), min(errors, b - a)):
            value = np.full(len(sig), np.uint64(1 + c * 4096 + sum(1 << (m - a) for m in masked)))
            for s in range(a, b):
                if s not in masked:
                    value = (value ^ sig[:, s].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                    value ^= value >> np.uint64(28)
            keys.append(T.mix(value))
    return np.stack(keys, 1).view(np.int64) if keys else np.zeros((len(sig), 0), np.int64)


@T.tidy
def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            sets, lead = T.shingles(*T.flat(part.column("text")))
            size = np.diff(lead)
            has = size > 0
            sig = np.zeros((len(size), SYMBOLS), np.uint16)
            sig[has] = signature(sets, lead)
            halves = np.zeros((len(size), 2), np.uint64)
            if has.any():
                at = lead[:-1][has]
                halves[has, 0] = np.add.reduceat(T.mix(sets ^ np.uint64(0x51ED270B0F1F8C35)), at)
                halves[has, 1] = np.add.reduceat(T.mix(sets + np.uint64(0xB5297A4D3F84D5B5)), at)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(size),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(size), [None, pa.py_buffer(np.ascontiguousarray(halves).tobytes())]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) * SYMBOLS // 4 + 1, SYMBOLS // 4, dtype=np.int32)), pa.array(sig.reshape(-1).view(np.int64))),
                ],
                names=["id", "n_shingles", "set_hash", "sig"],
            )


@T.tidy
def _keys(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            sig = part.column("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint16)
            most, chunks = limits(percent)
            keys = chunk_keys(sig.reshape(part.num_rows, SYMBOLS), chunks, most)
            ids = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), keys.shape[1])
            slot = np.tile(np.arange(keys.shape[1], dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(slot), pa.array(ids)], names=["key", "slot", "rep"])


@T.tidy
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            sets, lead = T.shingles(*T.flat(part.column("text")))
            ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), np.diff(lead))
            yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(ids)], names=["shingle", "id"])


def _sets(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    for a, b in T.slices(batch):
        sets, lead = T.shingles(*T.flat(column.slice(a, b - a)))
        out += np.split(sets, lead[1:-1])
    return out


@T.tidy
def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose full sets reach the similarity; exact integer arithmetic."""
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            a, b = (batch.column(x).to_numpy(zero_copy_only=False) for x in "ab")
            firsts = np.concatenate([[True], a[1:] != a[:-1]])  # a run of pairs shares its left text
            lefts, rights = _sets(batch.column("text_a").filter(pa.array(firsts))), _sets(batch.column("text_b"))
            linked = np.zeros(len(a), bool)
            for i, at in enumerate(np.cumsum(firsts) - 1):
                left, right = lefts[at], rights[i]
                both = np.concatenate([left, right])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = common and 100 * common >= percent * (len(left) + len(right) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked], pa.int64()), pa.array(b[linked], pa.int64())], names=["a", "b"])


def distance(x: str, y: str) -> Column:
    """Number of symbols in which two signatures, packed four to a long, differ."""

    def unequal(p: Column, q: Column) -> Column:
        z = p.bitwiseXOR(q)
        for shift in (8, 4, 2, 1):  # ors the bits of a symbol into its lowest
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0001000100010001)))

    return F.aggregate(F.zip_with(x, y, unequal), F.lit(0), lambda s, v: s + v)


def _pairs_of_key(group: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one key, or of two blocks of it, that are within the distance and meet here first."""
    rep, comp, n, shared, sig, slot = (group[c] for c in ("rep", "comp", "n_shingles", "shared", "sig", "slot"))
    out_a, out_b = [], []
    most_errors, chunks = limits(percent)
    edges = np.linspace(0, SYMBOLS, chunks + 1).astype(int)
    chunk_of = np.searchsorted(edges, np.arange(SYMBOLS), "right") - 1
    cross = group["bi"][0] != group["bj"][0]
    for lo in range(0, len(rep), 64):
        x, y = np.arange(lo, min(lo + 64, len(rep)))[:, None], np.arange(len(rep))[None, :]
        most = np.minimum(shared[x], shared[y])
        want = (comp[x] != comp[y]) & (rep[x] < rep[y]) & (100 * most >= percent * (n[x] + n[y] - most))
        if cross:
            want &= group["block"][x] != group["block"][y]
        i, j = np.nonzero(want)
        i += lo
        for at in range(0, len(i), 1 << 15):
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            errors = np.add.reduceat((sig[p] != sig[q]).astype(np.uint8), edges[:-1], axis=1)
            near = errors.sum(1) <= most_errors
            p, q, errors = p[near], q[near], errors[near]
            at_slot, chunk = slot[p], chunk_of[slot[p]]
            first = np.argmax(errors <= 1, axis=1) == chunk
            # Without an error in the chunk, the two meet at all of its keys: the first one counts.
            first &= (errors[np.arange(len(p)), chunk] > 0) | (at_slot == edges[chunk])
            out_a.append(rep[p[first]])
            out_b.append(rep[q[first]])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


@T.tidy
def _meetings(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key and block pair; keeps no more than one such group."""
    held: list[pa.RecordBatch] = []
    names = ("rep", "comp", "n_shingles", "shared", "slot", "block", "bi", "bj")

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        cols = {c: table.column(c).to_numpy() for c in (*names, "key")}
        cols["sig"] = table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, SYMBOLS)
        cut = np.flatnonzero((cols["key"][1:] != cols["key"][:-1]) | (cols["bi"][1:] != cols["bi"][:-1]) | (cols["bj"][1:] != cols["bj"][:-1])) + 1
        found = [_pairs_of_key({c: v[a:b] for c, v in cols.items()}, percent) for a, b in itertools.pairwise([0, *cut.tolist(), table.num_rows]) if b - a > 1]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def last_group(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(c)[-1].as_py() for c in ("key", "bi", "bj"))

    for batch in batches:
        if not batch.num_rows:
            continue
        key, bi, bj = (batch.column(c).to_numpy() for c in ("key", "bi", "bj"))
        end = last_group(batch)
        own = (key == end[0]) & (bi == end[1]) & (bj == end[2])
        start = int(np.argmax(own))
        if start:
            yield from solve([*held, batch.slice(0, start)])
            held = []
        elif held and last_group(held[-1]) != end:
            yield from solve(held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield from solve(held)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns u, v: each id of `links(a, b)` that is not the smallest reachable, and that smallest.

    Large-star and small-star steps alternate until every edge leads straight to
    its root. Each is one grouping over the edges, written to the shared folder;
    only counts reach the driver.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        forked = edges.groupBy("u").count().where("count > 1").select("u")
        chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if not forked.unionByName(chained).take(1):
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, materialize(small)
        discard(old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| over their sets of
    five-word shingles. A row with a null id keeps it, and is its own component.
    Ids are taken to be unique but for repeated rows.
    """
    small_batches(docs.sparkSession)
    with measured_joins(docs.sparkSession):
        profiles, reps, comp = _classes(docs, percent, id_col, text_col)
    labelled = reps.join(comp.hint("merge"), "rep", "left").select("set_hash", F.coalesce("comp", "rep").alias("comp"))
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("comp")).otherwise(F.col("id"))
    return profiles.join(labelled, "set_hash", "left").select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of rows, of the representatives of equal sets, and of the components of those that were compared."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiles = materialize(source.mapInArrow(_profiles, "id long, n_shingles long, set_hash binary, sig array<long>"))
    filled = profiles.where("n_shingles > 0 and id is not null")
    reps = materialize(filled.groupBy("set_hash").agg(F.min(F.struct("id", "n_shingles", "sig")).alias("x")).select("set_hash", F.col("x.id").alias("rep"), "x.n_shingles", "x.sig"))
    keys = reps.select("rep", "sig").mapInArrow(lambda it: _keys(it, percent), "key long, slot int, rep long")
    crowd = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    index = materialize(keys.join(crowd, "key"))
    # A shingle that no other indexed text has is in no intersection: `shared` bounds every one of a text.
    named = source.join(index.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    lone = named.mapInArrow(_members, "shingle long, id long").groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("hi")).where("id = hi").groupBy("id").agg(F.count("*").alias("lone"))
    signed = materialize(
        reps.join(index.select("rep").distinct(), "rep", "left_semi")
        .join(lone.withColumnRenamed("id", "rep"), "rep", "left")
        .select("rep", "n_shingles", (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("shared"), "sig")
        .where(100 * F.col("shared") >= percent * F.col("n_shingles"))
    )
    comp = materialize(signed.select("rep", F.col("rep").alias("comp")))
    tried: DataFrame | None = None
    for last in (False, True):
        placed = index.join(signed, "rep").join(comp, "rep")
        if last:
            size = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
            block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
            spread = placed.join(size, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            spread = spread.select("key", "slot", "rep", "comp", "n_shingles", "shared", "sig", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
            ordered = spread.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
            pairs = ordered.mapInArrow(lambda it: _meetings(it, percent), "a long, b long")
            pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
        else:
            nearest = F.struct((F.lit(1) - F.col("shared") / F.col("n_shingles")).alias("o"), "rep", "n_shingles", "shared", "sig")
            lead = placed.groupBy("key").agg(F.min(nearest).alias("l")).select("key", *(F.col(f"l.{c}").alias(f"{c}_b") for c in ("rep", "n_shingles", "shared", "sig")))
            met = placed.withColumnsRenamed({c: f"{c}_a" for c in ("rep", "n_shingles", "shared", "sig")}).join(lead, "key").where("rep_a <> rep_b")
            most = F.least("shared_a", "shared_b")
            met = met.where(100 * most >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - most))
            pairs = met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "sig_a", "sig_b")
            pairs = materialize(pairs.where(distance("sig_a", "sig_b") <= limits(percent)[0]).select("a", "b").distinct())
        tried = pairs
        ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
        texts = materialize(source.join(ids, "id", "left_semi"))  # plain tables on both sides let Spark split a leader of many pairs
        found = materialize(
            pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")
        )
        if found.take(1):
            named = found.join(comp.withColumnsRenamed({"rep": "a", "comp": "comp_a"}), "a").join(comp.withColumnsRenamed({"rep": "b", "comp": "comp_b"}), "b")
            roots = components(named.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
            old, comp = comp, materialize(comp.join(roots, comp["comp"] == roots["u"], "left").select("rep", F.coalesce("v", "comp").alias("comp")))
            discard(old, roots)
        discard(found, texts)
    discard(index, signed)
    return profiles, reps, comp
