"""Near-duplicates by b-bit MinHash.

A document's set of 5-word shingles gives 128 minima. Bands of minima, the shorter the lower the
similarity asked for, give candidates; of each minimum the low four bits are kept, packed into bit planes, and counting equal bits estimates
the similarity of candidates, corrected for chance collisions. What the estimate leaves is
confirmed on the full sets of shingles.

Documents with the same set form one class first, so copies are never compared. The members of a
bucket come together with their texts, and are compared there, by blocks; what leaves the task
are links that join the bucket's components, fewer than it has members, and not all pairs. A
bucket with more shingles than a task should hold is dealt to all pairs of its parts.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_batch, cut, prepare, release, texts_of
from .components import components
from .words import Words, run_hashes, slices

SHINGLE, SIMILARITY = 5, 85  # words; percent of the union, where no other is asked for
MINIMA, BAND_ROWS, BITS = 128, 5, 4  # BAND_ROWS at most
#: Most probabilities that a pair at the threshold shares no band, and that its estimate is below the screen.
BAND_LOSS, SCREEN_LOSS = 1e-6, 2e-8
#: Shingles and members of a bucket that one task holds; larger buckets are dealt to pairs of parts of half as many.
BUCKET_SHINGLES, BUCKET_MEMBERS = 4_000_000, 20_000
#: Members that are compared with the others of their bucket at once, and shingles counted at once, at most; fewer where a matrix would have more cells than this.
ROWS, COLUMNS, CELLS = 256, 4096, 4_000_000
#: Candidate ids up to which their table is broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(3)
_A = _rng.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_C = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_Q = _rng.integers(1, 1 << 63, BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def rows_of(similarity: int) -> int:
    """Minima in a band: the most for which a pair at the threshold is lost with BAND_LOSS at most."""
    return next((r for r in range(BAND_ROWS, 1, -1) if (1 - (similarity / 100) ** r) ** (MINIMA // r) <= BAND_LOSS), 1)


def screen_of(similarity: int) -> float:
    """Least estimate that is confirmed on full sets: a pair at the threshold is below it with SCREEN_LOSS at most."""
    chance = 2.0**-BITS
    p, below, equal = similarity / 100 + (1 - similarity / 100) * chance, 0.0, 0
    while equal < MINIMA and (below := below + comb(MINIMA, equal) * p**equal * (1 - p) ** (MINIMA - equal)) <= SCREEN_LOSS:
        equal += 1
    return (equal / MINIMA - chance) / (1 - chance)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, given its words' hashes; the whole text where there are fewer words."""
    return np.unique(run_hashes(words, min(SHINGLE, words.size))) if words.size else words


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for lo in range(0, x.size, 4096):
        np.minimum(best, (x[lo : lo + 4096, None] * _A + _C).min(0), out=best)
    return best


def planes_of(m: np.ndarray) -> bytes:
    """BITS planes of MINIMA bits: the low bits of each minimum after a mixing step."""
    low = (m * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return b"".join(np.packbits((low >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(BITS))


def bands_of(m: np.ndarray, size: int) -> np.ndarray:
    n = MINIMA // size
    rows = m[: n * size].reshape(n, size).astype(np.uint64)
    h = (rows + np.uint64(1)) * _Q[:size]
    key = (h ^ (h >> np.uint64(29))).sum(1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64)
    return ((key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each of a to each of b, given planes as (n, BITS, MINIMA / 64) words."""
    differ = np.zeros((a.shape[0], b.shape[0], a.shape[2]), np.uint64)
    for k in range(BITS):
        differ |= a[:, None, k] ^ b[None, :, k]
    same = 1 - np.bitwise_count(differ).sum(2, dtype=np.int32) / MINIMA
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def sketch(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, planes, bands) for each row of docs(doc_id, text); hi and lo name the set and are null for an empty one."""
    size = rows_of(similarity)

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(b.column("text"))
            n, hi, lo, planes, bands = [], [], [], [], []
            for i, j in slices(texts):
                for words in Words(texts[i:j], lower=True):
                    s = shingles(words)
                    n.append(s.size)
                    if not s.size:
                        hi.append(None), lo.append(None), planes.append(None), bands.append([])
                        continue
                    name = np.frombuffer(xxhash.xxh3_128_digest(s), ">i8")
                    m = minima(s)
                    hi.append(int(name[0])), lo.append(int(name[1])), planes.append(planes_of(m)), bands.append(bands_of(m, size))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(x, t) for x, t in zip((n, hi, lo, planes, bands), kinds))], ["doc_id", "n_shingles", "hi", "lo", "planes", "bands"])

        return run

    return by_batch(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, hi long, lo long, planes binary, bands array<long>")


def buckets_of(classes: DataFrame) -> DataFrame:
    """(bucket, side, hi, lo): classes that share a band, a bucket at a time; of buckets with the same classes one is kept. Classes of a divided bucket have side 1 or 2 where two parts of it meet, and 0 where a part is by itself."""
    rows = classes.select("hi", "lo", "n_shingles", F.explode("bands").alias("band"))
    keys = rows.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.bit_xor(F.xxhash64("lo", "hi")).alias("s"), F.sum("n_shingles").alias("all")).filter("n > 1")
    keys = keys.groupBy("n", "x", "s").agg(F.min("band").alias("band"), F.max("all").alias("all")).select("band", "n", "all")
    share = F.greatest(F.col("all") / BUCKET_SHINGLES, F.col("n") / BUCKET_MEMBERS)
    parts = F.when(share > 1, F.ceil(2 * share)).otherwise(1).cast("int")
    mine = F.pmod(F.xxhash64("hi", "lo", F.lit(1)), F.col("parts")).cast("int")
    met = rows.join(keys, "band").withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return met.select(F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), side.alias("side"), "hi", "lo")


def linked(planes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """Links (i, j) that join the members as all their links would: one fewer than members in each component.

    Sizes of intersections are products of the members' rows over the shingles that more than one
    member has; rows are only formed for members for which the estimate leaves a candidate.
    """
    g, screen = len(sets), screen_of(similarity)
    sizes = np.array([s.size for s in sets], np.int64)
    owner = np.repeat(np.arange(g), sizes)
    keys, code, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(uses > 1)
    column = np.full(keys.size, -1, np.int64)
    column[shared] = np.arange(shared.size)
    column = column[code]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    labels, out = np.arange(g), []
    step, span = max(16, min(ROWS, CELLS // (4 * g))), max(64, min(COLUMNS, CELLS // g))
    for lo in range(0, g, step):
        hi = min(lo + step, g)
        good = estimates(planes[lo:hi], planes[lo:]) >= screen
        good &= (side[lo:hi, None] == 0) | (side[lo:hi, None] != side[None, lo:])
        good &= (np.arange(lo, hi)[:, None] < np.arange(lo, g)[None, :]) & (labels[lo:hi, None] != labels[None, lo:])
        rows = np.flatnonzero(good.any(1)) + lo
        if not rows.size:
            continue
        common = np.zeros((rows.size, g - lo), np.float32)
        at = np.full(g, -1)
        at[rows] = np.arange(rows.size)
        for c in range(0, shared.size, span):
            x, y = np.searchsorted(column, (c, c + span))
            who, what = owner[x:y], column[x:y] - c
            width = min(span, shared.size - c)
            right = np.zeros((g - lo, width), np.float32)
            right[who[who >= lo] - lo, what[who >= lo]] = 1
            common += right[rows - lo] @ right.T
        union = sizes[rows, None] + sizes[None, lo:] - common.astype(np.int64)
        links = good[rows - lo] & (100 * common.astype(np.int64) >= similarity * union)
        for k in np.flatnonzero(links.any(1)):
            i = int(rows[k])
            to = np.flatnonzero(links[k]) + lo
            found, first = np.unique(labels[to], return_index=True)
            new = found != labels[i]
            out += [(i, int(j)) for j in to[first[new]]]
            low = min(int(found[0]), int(labels[i]))
            labels[np.isin(labels, found) | (labels == labels[i])] = low
    return out


def bucket_links(members: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(a, b) ids linked, from members(bucket, side, rep, planes, text); a task has all rows of its buckets, sorted by them."""
    spark = members.sparkSession
    prepare(spark)

    def run(batches):
        held: list[tuple] = []  # (side, rep, set, planes) of the bucket that is being read
        last = None

        def pairs():
            if len(held) < 2:
                return
            side, rep, sets, planes = zip(*held)
            bits = np.frombuffer(b"".join(planes), np.uint64).reshape(len(held), BITS, MINIMA // 64)
            if found := linked(bits, list(sets), np.array(side), similarity):
                a, b = zip(*((rep[i], rep[j]) for i, j in found))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            texts, buckets, sides, reps, planes = texts_of(batch.column("text")), *(batch.column(c).to_pylist() for c in ("bucket", "side", "rep", "planes"))
            for i, j in slices(texts):
                for row, words in enumerate(Words(texts[i:j], lower=True), i):
                    if buckets[row] != last:
                        yield from pairs()
                        held, last = [], buckets[row]
                    held.append((sides[row], reps[row], shingles(words), planes[row]))
        yield from pairs()
        held = []
        release()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "bucket").sortWithinPartitions("bucket", "rep").select("bucket", "side", "rep", "planes", "text").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of other than ASCII white space, with A-Z in lower case. Documents are linked
    when their sets of shingles share `similarity` percent of the union; component_id is the smallest id
    that links reach. A null text or one without words has an empty set and is linked with
    nothing. A row with a null id links nothing, has no component and is kept. Rows that repeat an
    id belong to one component, whatever their texts. No rows give no rows; other columns are not
    looked at.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = cut(sketch(text, similarity), "sketches")
    known = seen.filter("doc_id is not null and n_shingles > 0")
    first = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    classes = cut(first, "classes")
    buckets = cut(buckets_of(classes), "buckets")
    # one text of each class in a bucket, read again from the documents
    wanted = cut(buckets.select("hi", "lo").distinct().join(classes.select("hi", "lo", "rep", "planes"), ["hi", "lo"]), "wanted")
    ids = broadcast_if_small(wanted.select(F.col("rep").alias("doc_id")).distinct(), wanted.count(), BROADCAST_IDS)
    again = set_names(text.join(ids, "doc_id", "left_semi")).withColumnRenamed("doc_id", "rep")
    texts = again.join(wanted, ["hi", "lo", "rep"]).select("hi", "lo", "rep", "planes", "text").dropDuplicates(["hi", "lo"])
    found = bucket_links(buckets.join(cut(texts, "texts"), ["hi", "lo"]), similarity)
    # rows of one id with different texts
    twice = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    same_id = known.join(twice, "doc_id", "left_semi").join(classes.select("hi", "lo", "rep"), ["hi", "lo"])
    comp = components(found.unionByName(same_id.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    to = classes.select("hi", "lo", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    found = seen.select("doc_id", "n_shingles", "hi", "lo").join(to, ["hi", "lo"], "left")
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def set_names(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with hi and lo, the name of each text's set."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(b.column("text"))
            names = []
            for i, j in slices(texts):
                for words in Words(texts[i:j], lower=True):
                    s = shingles(words)
                    names.append(np.frombuffer(xxhash.xxh3_128_digest(s), ">i8").tolist() if s.size else (None, None))
            hi, lo = zip(*names)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "text", "hi", "lo"])

        return run

    return by_batch(docs.select("doc_id", "text"), make, "doc_id long, text string, hi long, lo long")


def keep_one_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """docs without the rows whose id is not the smallest of its component, the same columns; empty texts and rows without an id stay. The ids to drop are broadcast where they are few, else joined by a shuffle."""
    gone = cut(near_dedup(docs, similarity=similarity).filter("not kept").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, gone.count(), BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)
