"""Mixes sources to target weights by pivotal dependent rounding.

Sources share a word budget by weight, and no source goes beyond MOST times its own
words: what is above is shared again by weight until none is above. A document then has
the fractional number of copies target / source words. Its whole part is taken as it
is. The fractions are rounded in pairs: word mass moves from one of the pair to the
other, in a direction drawn so that expectations stay, until one of them is 0 or 1;
the other one meets the next. A block of about BLOCK documents is one fold that leaves
one fraction at most; the fractions left are blocks of the next level, so residuals
meet in a reduction tree. Every step keeps the words of the source, so a source ends
within one document of its target.

Rows of one id, source and text are one item with the copies of all of them, dealt out
evenly in the end; so however often a row repeats, it never crowds a block.

Draws are hashes of id, size and level: reruns agree. Null texts have no words. A
source without words has target 0; without any words every target is 0. Rows without
words are taken once where their source is taken whole. No rows give no rows; columns of
other names and other types do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.llm.tables import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"

_ITEM = "struct<o:bigint,id:bigint,size:bigint,crc:bigint,p:double,u:double>"
_DONE = "array<struct<id:bigint,size:bigint,crc:bigint,take:int>>"


def targets(sources: DataFrame) -> DataFrame:
    """Adds `target` to `sources(source, n_docs, source_size)`; sources by code point with null last take the weights in turn."""
    weigh = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.pmod(F.col("nth") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    # One row a source, no more than the sources there are.
    ranked = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weigh).withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
    every = Window.partitionBy()
    above = Window.orderBy("ratio", "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        (SHARE * F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(above), F.lit(0))).alias("budget"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(above), F.lit(0.0))).alias("shares"),
    )
    # By rising ratio, a source is full if its part of what the fuller ones left reaches its limit.
    full = left.withColumn("full", F.col("budget") / F.col("shares") >= F.col("ratio"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "nth", F.col("budget") / F.col("shares")))).over(every)
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level["col3"])
    return full.select("source", "n_docs", "source_size", target.alias("target"))


def _fold(items: str) -> str:
    """SQL of one fold over an array of items: struct<c: carried item or null, done: rounded items>."""
    carried = f"cast(null as {_ITEM})"

    def finish(item: str, take: str) -> str:
        return f"array(struct({item}.id as id, {item}.size as size, {item}.crc as crc, {take} as take))"

    def carry(item: str, p: str) -> str:
        return f"named_struct('o',{item}.o,'id',{item}.id,'size',{item}.size,'crc',{item}.crc,'p',{p},'u',{item}.u)"

    def state(item: str, p: str, done: str) -> str:
        """Carries an item with a new fraction, or is done with it where that is whole."""
        bound = f"named_struct('p', {p}, 'done', {done})"
        return (
            f"transform(array({bound}), t -> case when t.p <= 1e-12 then named_struct('c', {carried}, 'done', concat(t.done, {finish(item, '0')})) "
            f"when t.p >= 1 - 1e-12 then named_struct('c', {carried}, 'done', concat(t.done, {finish(item, '1')})) "
            f"else named_struct('c', {carry(item, 't.p')}, 'done', t.done) end)[0]"
        )

    masses = "named_struct('up', least(s.c.size * (1 - s.c.p), x.size * x.p), 'down', least(s.c.size * s.c.p, x.size * (1 - x.p)))"
    met = (
        f"transform(array({masses}), m -> case "
        f"when x.u * (m.up + m.down) < m.down then "
        f"  case when m.up = s.c.size * (1 - s.c.p) then {state('x', 'x.p - m.up / x.size', f'concat(s.done, {finish("s.c", "1")})')} "
        f"  else {state('s.c', 's.c.p + m.up / s.c.size', f'concat(s.done, {finish("x", "0")})')} end "
        f"else case when m.down = s.c.size * s.c.p then {state('x', 'x.p + m.down / x.size', f'concat(s.done, {finish("s.c", "0")})')} "
        f"  else {state('s.c', 's.c.p - m.down / s.c.size', f'concat(s.done, {finish("x", "1")})')} end end)[0]"
    )
    start = f"named_struct('c', {carried}, 'done', cast(array() as {_DONE}))"
    return f"aggregate({items}, {start}, (s, x) -> case when s.c is null then named_struct('c', x, 'done', s.done) else {met} end)"


def _draw(level: int, salt: int):
    """A number in [0, 1) that hangs on the row and the level alone."""
    return F.pmod(F.xxhash64("id", "size", "crc", F.lit(level), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for all rows of one id, source and text: id, source, size, crc, n (rows), source_size, target, copies (of all of them together)."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.crc32(F.coalesce(text_col, F.lit(""))).alias("crc"))
    rows = materialize(keyed.groupBy("id", "source", "size", "crc").agg(F.count("*").alias("n")))
    sources = materialize(targets(rows.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = rows.alias("r").join(sources.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target", (each * F.col("n")).alias("mass"))
    placed = placed.withColumn("whole", F.when(F.col("size") > 0, F.floor("mass")).otherwise(F.col("n") * F.least(F.floor(each), F.lit(1)))).withColumn("p", F.when(F.col("size") > 0, F.col("mass") - F.floor("mass")).otherwise(F.lit(0.0)))
    decided = None
    level, open_ = 0, placed.where("p > 0").select("id", "source", "size", "crc", "p")
    while True:
        many = open_.groupBy("source").agg(F.count("*").alias("n"))
        most = many.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        blocks = many.select(F.col("source").alias("of"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
        items = open_.join(blocks, F.col("source").eqNullSafe(F.col("of"))).select("source", F.pmod(F.xxhash64("id", "size", "crc", F.lit(level)), F.col("blocks")).alias("block"), F.struct(F.xxhash64("id", "size", "crc", F.lit(level), F.lit(1)).alias("o"), "id", "size", "crc", "p", _draw(level, 2).alias("u")).alias("item"))
        folded = items.groupBy("source", "block").agg(F.sort_array(F.collect_list("item")).alias("items")).select("source", F.expr(_fold("items")).alias("s"))
        done = materialize(folded.select("source", "s.c", "s.done"))
        taken = done.select("source", F.inline("done"))
        decided = taken if decided is None else decided.unionByName(taken)
        open_ = done.where("c is not null").select("source", "c.id", "c.size", "c.crc", "c.p")
        level += 1
    last = open_.select("source", "id", "size", "crc", F.when(_draw(level, 3) < F.col("p"), 1).otherwise(0).alias("take"))
    decided = (last if decided is None else decided.unionByName(last)).where("take = 1").select(F.col("source").alias("_source"), F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("crc").alias("_crc"), "take")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("crc") == F.col("_crc"))
    return placed.join(decided, same, "left").select("id", "source", "size", "crc", "n", "source_size", "target", (F.col("whole") + F.coalesce("take", F.lit(0))).cast("long").alias("copies"))


def _share(rows: str, copies: str, before: Column, upto: Column) -> Column:
    """Copies of the rows (before, upto] of a class whose copies are dealt out evenly, the first rows one more."""
    rest = F.col(copies) % F.col(rows)
    return (upto - before) * F.floor(F.col(copies) / F.col(rows)) + F.least(upto, rest) - F.least(before, rest)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of `docs`: id, source, size, source_size, target, copies, taken, text_crc32."""
    each = classes(docs, id_col, text_col, source_col).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    n = _share("n", "copies", F.col("nth") - 1, F.col("nth")).cast("int")
    return each.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"), F.col("crc").alias("text_crc32"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of `docs`, with all its columns, as often as the mix takes it."""
    of = classes(docs, id_col, text_col, source_col).groupBy(F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("crc").alias("of_crc")).agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.crc32(F.coalesce(text_col, F.lit(""))).alias("crc"))
    met = rows.join(of, F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("crc") == F.col("of_crc")))
    alone = met.where("n = 1").select("row", "copies")
    # Rows that repeat each other: equal ones fold before they are shuffled, and those that differ in another column share the copies in order.
    equal = met.where("n > 1").groupBy("id", "source", "crc", "n", "copies", "row").agg(F.count("*").alias("here"))
    upto = F.sum("here").over(Window.partitionBy("id", "source", "crc").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0))
    many = equal.withColumn("upto", upto).select("row", _share("n", "copies", F.col("upto") - F.col("here"), F.col("upto")).cast("long").alias("copies")).where("copies > 0")
    return alone.unionByName(many).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
