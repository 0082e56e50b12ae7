"""Shards along a Hilbert curve over quantised metadata.

Language, source and size are quantised to BITS bits each, in their own order and by the
rows they hold: a text dimension is cut at its most frequent values, and all others fall
between them; a class has about a 2**BITS-th of the rows, or is one value of more. The
cell a row falls in has a place on the Hilbert curve through all cells, and rows are
ordered by that place. The order is cut into runs of equal numbers of rows: law `rows`,
counts at most one apart. Neighbouring cells of the curve share ranges of every
dimension, so a shard spans few values of each, which lets readers skip files by their
least and greatest values.

Places in the order are exact and no task sees more than a part of a cell: cells hold
at most 2**(3 * BITS) rows of counts, a cell is split by the first byte of the text
checksum and a hash of the id into more parts the more rows there are, and only counts
are summed up along the curve. So equal texts of a cell lie in a bounded number of runs.
Nulls come first and quantise to 0, null texts have checksum 0, and rows that are equal in every column
may trade places. No rows give no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm.tables import materialize

BITS = 5
SHARDS = 40
#: Bytes that a row is counted with beside its text.
ROW_BYTES = 16
#: Steps of size that are counted for each doubling, before they are joined to classes.
FINE = 16
#: Rows for which the parts of a cell are doubled and so on, in proportion.
PART_ROWS = 1 << 24


def hilbert_index(dimensions: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell, by the transpose method, as one fold over bit planes and axes."""
    n = len(dimensions)
    planes = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in planes for i in range(n)))

    def undo(x: Column, s: Column) -> Column:
        low, own = s["q"] - 1, F.get(x, s["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        flip = own.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda s, y: s.bitwiseXOR(y)))

    def level(x: Column) -> Column:
        top = F.get(x, F.lit(n - 1))
        turn = F.aggregate(F.array(*(F.lit(q) for q in planes)), F.lit(0), lambda s, q: F.when(top.bitwiseAND(q) != 0, s.bitwiseXOR(q - 1)).otherwise(s))
        return F.transform(x, lambda v: v.bitwiseXOR(turn))

    def interleave(x: Column) -> Column:
        places = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
        return F.aggregate(places, F.lit(0), lambda s, p: s * 2 + F.when(F.get(x, p["i"]).bitwiseAND(p["q"]) != 0, 1).otherwise(0))

    folded = F.aggregate(steps, F.array(*(d.cast("int") for d in dimensions)), undo)
    for f in (gray, level, interleave):
        # A one-element array binds the value, which is then computed once.
        folded = F.get(F.transform(F.array(folded), f), F.lit(0))
    return folded


def _spread(counts: DataFrame, column: str) -> DataFrame:
    """One row: an array of the first values of classes, in order, with the number of each class: the share of the rows before it, of 2**BITS."""
    order = Window.orderBy(F.col(column).asc_nulls_first())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counts.select(F.col(column).alias("v"), F.floor(before * (1 << BITS) / F.sum("n").over(Window.partitionBy())).cast("int").alias("class"))
    return classes.agg(F.sort_array(F.collect_list(F.struct("v", "class"))).alias(f"{column}_bounds"))


def _bounds(rows: DataFrame, column: str) -> DataFrame:
    """The classes of a text dimension: cut at its most frequent values, no more than 2**BITS of them."""
    return _spread(rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(1 << BITS), column)


def _grades(rows: DataFrame) -> DataFrame:
    """The classes of size, from the counts of all its fine steps: no more than a long has bits, times FINE."""
    return _spread(rows.groupBy("fine").agg(F.count("*").alias("n")), "fine")


def _class(value: str) -> Column:
    """The greatest class that begins with no more than the value: 0 for null."""
    return F.coalesce(F.array_max(F.transform(F.filter(f"{value}_bounds", lambda b: b["v"] <= F.col(value)), lambda b: b["class"])), F.lit(0))


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of `docs`: id, size, text_crc32, law, shard, slot, curve."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES
    kept = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("size"), F.crc32(F.coalesce(text_col, F.lit(""))).alias("crc"), F.col(lang_col).cast("string").alias("x"), F.col(source_col).cast("string").alias("y"), F.floor(FINE * F.log2(size / ROW_BYTES)).cast("int").alias("fine"))
    seen = materialize(kept)
    total = seen.count()
    salts = max(16, total // PART_ROWS)
    # Three tables of one row each.
    bounds = _bounds(seen, "x").crossJoin(_bounds(seen, "y")).crossJoin(_grades(seen))
    cell = (_class("x").alias("x"), _class("y").alias("y"), _class("fine").alias("z"))
    part = F.shiftright("crc", 24).cast("int") * salts + F.coalesce(F.pmod(F.xxhash64("id"), F.lit(salts)), F.lit(0)).cast("int")
    rows = seen.crossJoin(F.broadcast(bounds)).select("id", "size", "crc", *cell, part.alias("part"))
    cells = rows.groupBy("x", "y", "z").agg(F.count("*").alias("n")).withColumn("curve", hilbert_index([F.col("x"), F.col("y"), F.col("z")], BITS)).withColumn("stretch", F.shiftright("curve", 2 * BITS - 1))
    stretches = cells.groupBy("stretch").agg(F.sum("n").alias("n")).select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = cells.join(F.broadcast(stretches), "stretch")  # at most 2**(BITS + 1) rows
    run = Window.partitionBy("stretch").orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2**(3 * BITS) cells, so this side has a fixed bound.
    placed = materialize(placed.select("x", "y", "z", "curve", (F.col("base") + F.coalesce(F.sum("n").over(run), F.lit(0))).alias("base")))
    located = rows.join(F.broadcast(placed), ["x", "y", "z"])
    parts = located.groupBy("curve", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("curve", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("curve", "part").orderBy("crc", "id", "size")
    place = F.col("base") + F.col("ahead") + F.col("nth") - 1
    ordered = located.withColumn("nth", F.row_number().over(within)).join(parts, ["curve", "part"]).select("id", "size", "crc", "curve", place.alias("place"))
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    # The first place of shard k is the least p with p * shards >= k * total.
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return ordered.withColumn("shard", shard).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"), "curve")


def write(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", **names: str) -> DataFrame:
    """Writes `docs` to `path/hilbert_shard=k`, each shard in slot order, and returns what a reader prunes by.

    The result has a row a shard: rows, bytes, and the least and greatest of every
    metadata column. Ids must be unique here, as they tie rows to their places.
    """
    spots = assign(docs, shards, id_col=id_col, **names).select(F.col(id_col).alias("hilbert_id"), F.col("shard").alias("hilbert_shard"), F.col("slot").alias("hilbert_slot"), F.col("size").alias("hilbert_size"))
    out = docs.join(spots, docs[id_col].eqNullSafe(spots["hilbert_id"])).drop("hilbert_id").repartition(shards, "hilbert_shard").sortWithinPartitions("hilbert_shard", "hilbert_slot")
    out.write.mode("overwrite").partitionBy("hilbert_shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    plain = [c for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double", "date", "timestamp") and c != names.get("text_col", "text")]
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in plain for f in (F.min, F.max)]
    return back.groupBy("hilbert_shard").agg(F.count("*").alias("hilbert_rows"), F.sum("hilbert_size").alias("hilbert_bytes"), *ranges)
