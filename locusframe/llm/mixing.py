"""Mixing sources to target weights (DataFrame functions only).

Each source's documents are laid end to end, in an order that a hash of the id gives, and cut
into blocks of a fixed number of words. The output is shards of a fixed number of slots. Each
shard draws its sources independently, in proportion to the targets, so its counts are
multinomial; the totals of these draws are then corrected: draws beyond a source's total go to the
sources that are short, in a few of the last shards. The slots of a source are numbered over the
shards, and slot t takes the block to which a pseudorandom permutation, with keys of the
source's own, sends t modulo the number of blocks; a second round follows when the first has used
all blocks. Blocks and documents are joined by the block's index.

The permutation is a swap-or-not shuffle: in each round a block may change places with its mirror
image about the round's key, as a bit says that both places share. It maps 0 .. n - 1 onto itself
for every n. All random numbers are integer arithmetic modulo a prime, so SQL can repeat them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

#: Fixed values of the contract: weights by rank of the source, the share of all words, the most that a source is repeated.
WEIGHTS, SHARE, MOST_REPEATS = (3, 1, 2), 1.5, 2.0
BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 1024, 20
#: Buckets of a source's documents, and shards of a bucket, in two-step running sums.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Modulus, factors and rounds of the random numbers.
PRIME, FACTOR, FACTOR2, ROUNDS = 2**31 - 1, 48271, 69621, 16
#: Rows of a table of sources up to which it is broadcast: 40 bytes each, and of one with round keys, 300 bytes each. Bins by which a draw finds its source, at least.
BROADCAST_SOURCES, BROADCAST_KEYED, BINS = 100_000, 20_000, 1024


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(k, source, source_size, target) from (source, source_size); k numbers the sources from 0.

    Sources by code point, null last, take the weights in turn. Together they get share of all
    words; no target is above most times its source, and what is above goes to the others by
    weight. Sources are ordered by the ratio of limit to weight: those under the water level
    are full. One row a source passes through one window, never a row a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    at = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    level = (F.lit(share) * F.col("all") - F.col("full_before")) / F.nullif(F.col("w_all") - F.col("w_before"), F.lit(0.0))
    return (
        sizes.withColumn("k", at.cast("long")).withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("limit") / F.col("w"))
        .withColumns({"all": F.sum("source_size").over(everything), "w_all": F.sum("w").over(everything), "full_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
        .withColumn("level", level)
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select("k", "source", "source_size", F.least("limit", F.coalesce(F.col("water"), F.col("ratio")) * F.col("w")).alias("target"))
    )


def laid_out(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, size) with start, the document's first word's place in its source.

    Running sums go in two steps, over the buckets of a source and inside a bucket, so that a
    source with most of the rows is spread over many tasks.
    """
    spread = docs.withColumn("bucket", _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("n"))) % BUCKETS)
    buckets = spread.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.alias("a").join(buckets.alias("b"), F.expr("a.source <=> b.source and a.bucket = b.bucket")).select("a.doc_id", "a.source", "a.size", (F.col("base") + F.col("inside")).alias("start"))


def _digest(text: Column) -> Column:
    """28 bits of a text."""
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{SEED}"))), 1, 7), 16, 10).cast("long")


def _linear(x: Column, key: Column) -> Column:
    """0 .. PRIME - 1, from x of 0 or more; numbers beyond the prime don't start anew."""
    return ((x % PRIME) * FACTOR + F.floor(x / PRIME) * FACTOR2 + key) % PRIME


def _uniform(df: DataFrame, x: str, n: int) -> DataFrame:
    """df with u, a random number of 0 .. n - 1 for each x: two residues, each squared twice."""
    for side, key in (("p", SEED), ("q", SEED + 1)):
        df = df.withColumn(side, _linear(F.col(x), F.lit(key * 7919)))
        for step in range(2):
            df = df.withColumn(side, (F.col(side) * F.col(side) + (step + 1) * key) % PRIME)
    return df.withColumn("u", (F.col("p") * PRIME + F.col("q")) % n).drop("p", "q")


def round_keys(n: Column, seed: Column) -> Column:
    """The rounds of the permutation of 0 .. n - 1 as an array: each one's key, and the sum of a place and its mirror image modulo n. They depend on the source only, so they are made once a source."""

    def one(r: Column) -> Column:
        key = (seed * (r + 2) * 104729 + r * 15485863) % PRIME
        return F.struct(key.alias("key"), F.pmod(key * FACTOR2 + r, n).alias("both"))

    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)).cast("array<bigint>"), one)


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Where the permutation of 0 .. n - 1 with the given round_keys sends x."""

    def odd(y: Column) -> Column:
        return (y * y) % PRIME % 2 == 1

    def swapped(at: Column, r: Column) -> Column:
        mirror = r["both"] - at + F.when(at > r["both"], n).otherwise(0)
        pair = F.greatest(at, mirror)
        # places below the prime need no second factor; a lambda names a residue that is used twice, as what is written twice in a lambda is computed twice
        y = F.when(n <= PRIME, (pair * FACTOR + r["key"]) % PRIME).otherwise(_linear(pair, r["key"]))
        return F.when(F.transform(F.array(y), odd)[0], mirror).otherwise(at)

    return F.aggregate(keys, x, swapped)


def _running(counts: DataFrame) -> DataFrame:
    """counts(k, shard, n) with before, the sum of n over the source's earlier shards; in two steps, so that no task has all shards of a source."""
    spread = counts.withColumn("bucket", F.expr(f"shard div {BUCKETS}"))
    first = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy("k", "bucket").agg(F.sum("n").alias("all")).select("k", "bucket", F.coalesce(F.sum("all").over(first), F.lit(0)).alias("base"))
    inside = Window.partitionBy("k", "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(base, ["k", "bucket"]).select("k", "shard", "n", (F.col("base") + F.col("inside")).alias("before"))


def slot_totals(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(k, source, blocks, slots): by the mean words of a block, as the last one of a source is short."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    return targets.filter("source_size > 0").withColumn("blocks", blocks).select("k", "source", "blocks", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long").alias("slots"))


def shard_counts(totals: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(k, shard, n): slots of each source in each shard. Each slot draws a source by its share of all slots; then each source has its total."""
    spark = totals.sparkSession
    all_slots, sources = totals.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    if not all_slots:
        return totals.select("k", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("n")).limit(0)
    bins = max(BINS, sources)
    upto = F.sum("slots").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    shares = totals.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("slots")).filter("slots > 0")
    by_bin = shares.select("k", "lo", "hi", F.explode(F.expr(f"sequence(lo * {bins} div {all_slots}, (hi - 1) * {bins} div {all_slots})")).alias("bin"))
    draws = _uniform(spark.range(all_slots), "id", all_slots).select(F.expr(f"id div {shard_slots}").alias("shard"), "u", F.expr(f"u * {bins} div {all_slots}").alias("bin"))
    drawn = cut(draws.join(broadcast_if_small(by_bin, sources + bins, BROADCAST_SOURCES), "bin").filter("u >= lo and u < hi").groupBy("k", "shard").agg(F.count("*").alias("n")), "draws")
    # what a source draws beyond its total goes to those that are short, unit by unit: about the square root of all slots
    least = F.least(F.col("n"), F.greatest(F.col("slots") - F.col("before"), F.lit(0)))
    checked = _running(drawn).join(broadcast_if_small(totals.select("k", "slots"), sources, BROADCAST_SOURCES), "k").withColumn("kept", least)
    over = checked.filter("n > kept").select("k", "shard", (F.col("n") - F.col("kept")).alias("n"))
    short = totals.join(drawn.groupBy("k").agg(F.sum("n").alias("drawn")), "k", "left").select("k", F.lit(0).alias("shard"), (F.col("slots") - F.coalesce("drawn", F.lit(0))).alias("n")).filter("n > 0")
    order = Window.orderBy("k", "shard").rowsBetween(Window.unboundedPreceding, 0)
    units = lambda df: df.withColumn("hi", F.sum("n").over(order)).withColumn("unit", F.explode(F.expr("sequence(hi - n, hi - 1)")))
    filled = units(over).select("unit", "shard").join(units(short).select("unit", "k"), "unit").groupBy("k", "shard").agg(F.count("*").alias("n"))
    return checked.filter("kept > 0").select("k", "shard", F.col("kept").alias("n")).unionByName(filled).groupBy("k", "shard").agg(F.sum("n").alias("n"))


def draw_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(k, source, slot, shard, block, round): one row for each slot of the output, from targets(k, source, source_size, target)."""
    totals = slot_totals(targets, block_words)
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = _running(cut(shard_counts(totals, shard_slots), "counts"))
    seed = _digest(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    # written, so that the planner can't move the rounds' keys behind the join, to each slot
    keyed = totals.select("k", "source", "blocks", round_keys(F.col("blocks"), seed).alias("keys"))
    # shards are dealt to a stated number of tasks, as their counts are few bytes and what they make is not
    dealt = numbered.repartition(parts, "shard").join(broadcast_if_small(cut(keyed, "keys"), targets.count(), BROADCAST_KEYED), "k")
    slots = dealt.withColumn("slot", F.explode(F.expr("sequence(before, before + n - 1)")))
    return slots.select("k", "source", "slot", "shard", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("keys")).alias("block"), F.expr("slot div blocks").alias("round"))


def pieces_of(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """laid with a row for each block that a document has words in: lo to hi are its words there."""
    pieces = laid.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    return pieces.withColumns({"lo": F.expr(f"greatest(block * {block_words}, start) - start"), "hi": F.expr(f"least((block + 1) * {block_words}, start + size) - start")})


def taken_spans(laid: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, k, size, start, block, times, shard, lo, hi): words lo to hi of a document lie in a block that was drawn so many times, first for this shard."""
    # a table of generated slots looks small to the planner; it is as large as the blocks, so it must not be broadcast
    drawn = slots.groupBy("k", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard")).hint("merge")
    return pieces_of(laid, block_words).join(drawn, ["k", "block"])


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents laid out, slots) for docs(doc_id, text, source): (doc_id, source, k, source_size, target, size, start), and draw_slots.

    A null text has no words and is never taken; texts of any length are laid out whole. Null is a
    source of its own. Rows that repeat an id and a size take their turn one after the other. An
    empty table gives empty tables; other columns are not looked at.
    """
    sized = cut(_sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    placed = laid_out(sized).alias("a").join(broadcast_if_small(targets, targets.count(), BROADCAST_SOURCES).alias("t"), F.expr("a.source <=> t.source")).select("a.*", "t.k", "t.source_size", "t.target")
    return cut(placed, "laid"), draw_slots(targets, block_words, shard_slots)


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) for each row of docs: first_shard is the first shard that has words of it, null where none has. Nulls, repeats and empty tables as in mix."""
    laid, slots = mix(docs)
    taken = taken_spans(laid, slots).groupBy("doc_id", "k", "start").agg(F.sum(F.expr("times * (hi - lo)")).alias("taken"), F.min("shard").alias("first_shard"))
    return (
        laid.alias("a").join(taken.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.k = b.k and a.start = b.start and a.size > 0"), "left")
        .select("a.doc_id", "a.size", "a.source_size", "a.target", F.coalesce("b.taken", F.lit(0)).cast("long").alias("taken"), "b.first_shard")
    )


def mixed_shards(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, place, doc_id, source, text): the mix itself, each shard's slots in a random order, as the words that documents have in the drawn blocks, joined by one space. A shard's rows lie in one partition, in order. place numbers the slots by a hash; rows of one slot follow each other."""
    laid, slots = mix(docs, weights, block_words, shard_slots)
    repeated = _repeated(laid)
    drawn = slots.select("k", "block", "shard", F.xxhash64(F.lit(SEED), "k", "slot").alias("place")).hint("merge")
    pieces = pieces_of(_told_apart(laid, repeated, F.col("size"), F.col("start")), block_words)
    spans = pieces.join(drawn, ["k", "block"]).groupBy("doc_id", "source", "part", "turn").agg(F.collect_list(F.struct("shard", "place", "lo", "hi", F.col("start").alias("at"))).alias("spans"))
    met = _met(docs.select("doc_id", "source", "text"), spans, repeated, F.col("text"))
    piece = lambda s, words: F.struct(s["shard"].alias("shard"), s["place"].alias("place"), s["at"].alias("at"), F.array_join(_words_of(s, words), " ").alias("text"))
    words = met.select("d.doc_id", "d.source", _of_words(F.col("d.text"), F.col("c.spans"), piece).alias("cutout"))
    out = words.select("doc_id", "source", F.explode("cutout").alias("p")).select("p.shard", "p.place", "p.at", "doc_id", "source", "p.text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "shard").sortWithinPartitions("shard", "place", "at").drop("at")


def _repeated(laid: DataFrame) -> DataFrame:
    """(doc_id, source) of rows that share both with another row."""
    return cut(laid.groupBy("doc_id", "source").count().filter("count > 1").select("doc_id", "source"), "repeated")


def _told_apart(rows: DataFrame, repeated: DataFrame, size: Column, order: Column) -> DataFrame:
    """rows(doc_id, source, ...) with part and turn, which tell apart rows of one id and source: their size, and their order among those of a size. Only rows that are in repeated are numbered; the others have -1 and 1."""
    single = rows.withColumns({"part": F.lit(-1).cast("long"), "turn": F.lit(1)})
    ids = repeated.count()
    if not ids:
        return single
    known = broadcast_if_small(repeated, ids, BROADCAST_SOURCES).alias("r")
    same = F.expr("d.doc_id <=> r.doc_id and d.source <=> r.source")
    several = rows.alias("d").join(known, same, "left_semi").withColumn("part", size.cast("long"))
    several = several.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "source", "part").orderBy(order)))
    return single.alias("d").join(known, same, "left_anti").unionByName(several)


def _met(rows: DataFrame, spans: DataFrame, repeated: DataFrame, text: Column) -> DataFrame:
    """rows as d with their spans as c. A text is shuffled once, and its words are counted only where its id repeats."""
    found = _told_apart(rows, repeated, F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.xxhash64(text))
    return found.alias("d").join(spans.alias("c"), F.expr("d.doc_id <=> c.doc_id and d.source <=> c.source and d.part = c.part and d.turn = c.turn"))


def _words_of(span: Column, words: Column) -> Column:
    return F.slice(words, (span["lo"] + 1).cast("int"), (span["hi"] - span["lo"]).cast("int"))


def _of_words(text: Column, spans: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(span, the text's words) for each of spans. The words are a lambda's argument, so that they are found once a text; a column of them would be computed again for each span."""
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda words: F.transform(spans, lambda s: f(s, words)))[0]


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the mix in effect, the same columns: a row for the words of a document drawn at least once, one for those drawn at least twice.

    A text of which all words are drawn stays as it is; of others the drawn words are kept, joined
    by one space, and n_chars, where there is such a column, follows. Documents of which nothing is drawn go, empty texts too.
    Nulls, repeats and empty tables as in mix; mixed_shards gives the mix in the order of its shards.
    """
    laid, slots = mix(docs, weights, block_words)
    repeated = _repeated(laid)
    spans = taken_spans(_told_apart(laid, repeated, F.col("size"), F.col("start")), slots, block_words)
    copies = (
        spans.withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
        .groupBy("doc_id", "source", "part", "turn", "size", "copy")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.sum(F.expr("hi - lo")).alias("drawn"))
    )
    # the text goes along once, in its row
    kept = _met(docs.select("doc_id", "source", F.struct(*docs.columns).alias("row")), copies, repeated, F.col("row.text"))
    taken = F.array_join(F.flatten(_of_words(F.col("d.row.text"), F.col("c.spans"), _words_of)), " ")
    mixed = F.when(F.col("c.drawn") < F.col("c.size"), taken).otherwise(F.col("d.row.text"))
    out = kept.select("d.row", mixed.alias("mixed"))
    return out.select(*[F.col("mixed").alias(c) if c == "text" else F.length("mixed").cast(t).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c, t in docs.dtypes])
