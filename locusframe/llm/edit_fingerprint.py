"""Document fingerprints by a randomised edit embedding.

A walk over the characters of a text shows the character where it stands and then stays or steps
on, as a table of random bits says for the time and the character. The table is shared by all
texts, so walks that an edit has parted meet again soon, and edit distance becomes Hamming
distance. A fingerprint holds the embedding at sampled times; there is one scale of times for
each doubling of the length, and a text is sampled on its own scale and on the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, prepare, release
from .components import components

#: Samples on a scale, classes of characters (0 is the end of the text), steps before the table of bits repeats.
SAMPLES, CLASSES, PERIOD = 256, 15, 8191
#: Characters whose walks run together in a worker; walks up to which each goes on alone, as a long text's do.
SLICE_CHARS, FEW = 6 << 20, 12
_rng = np.random.default_rng(8)
_BITS = _rng.integers(0, 2, (PERIOD, CLASSES + 1), dtype=np.int64)
_BITS[:, 0] = 0
_STEPS = [bytes(row) for row in _BITS.astype(np.uint8)]
_SPREAD = _rng.random(SAMPLES)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def scale_of(n: int) -> int:
    return max(6, int(n - 1).bit_length()) if n > 0 else 6


def times_of(scale: int) -> np.ndarray:
    """One time in each of equal parts of twice the scale's length, as a walk steps on every other time."""
    part = 2 * (1 << scale) / SAMPLES
    return np.unique(((np.arange(SAMPLES) + _SPREAD) * part).astype(np.int64)) if part >= 1 else np.arange(2 << scale)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (((points * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(CLASSES) + np.uint32(1)).astype(np.uint8)


def fingerprints(texts: list[np.ndarray]) -> list[str]:
    """Of texts given as symbols(); all walks go on together, a step at a time."""
    sizes = np.array([t.size for t in texts], np.int64)
    scales = np.array([scale_of(n) for n in sizes], np.int64)
    flat = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint8))]) if texts else np.zeros(0, np.uint8)
    pos = np.cumsum(sizes + 1) - sizes - 1
    out = [np.zeros((len(texts), SAMPLES), np.uint8) for _ in range(2)]
    events: dict[int, list[tuple[int, int]]] = {}
    for scale in {int(s) + d for s in set(scales.tolist()) for d in (0, 1)}:
        for k, t in enumerate(times_of(scale).tolist()):
            events.setdefault(t, []).append((scale, k))
    live = np.flatnonzero(sizes)
    live = live[np.argsort(scales[live], kind="stable")]
    at = pos[live]
    ends: dict[int, slice] = {}
    last = 0
    for t in sorted(events):
        t0 = last
        while t0 < t:
            t1 = min(t, (t0 // 512 + 1) * 512)
            for step in range(t0, t1):
                at += _BITS[step % PERIOD].take(flat.take(at))
            if t1 % 512 == 0 and at.size:
                going = flat[at] != 0
                if not going.all():
                    live, at = live[going], at[going]
                    ends = {}
            t0 = t1
        last = t
        if not at.size:
            break
        if at.size <= FEW:
            # from the step that is due: its samples are the first that each takes alone
            for who, where in zip(live.tolist(), at.tolist()):
                _alone(flat, where, t, int(scales[who]), [o[who] for o in out])
            break
        if not ends:
            s = scales[live]
            ends = {int(v): slice(int(np.searchsorted(s, v)), int(np.searchsorted(s, v, "right"))) for v in np.unique(s)}
        for scale, k in events[t]:
            for own in (0, 1):
                if (part := ends.get(scale - own)) is not None:
                    out[own][live[part], k] = flat[at[part]]
    a, b = (_HEX[x].view(f"S{SAMPLES}").ravel() for x in out)
    return [f"{s:02x}:{x.decode()}:{y.decode()}" for s, x, y in zip(scales.tolist(), a, b)]


def _alone(flat: np.ndarray, at: int, t: int, scale: int, out: list[np.ndarray]) -> None:
    """One walk from its place at time t to its end, with its samples; symbols come in pieces, so memory stays small."""
    due = sorted((u, own, k) for own in (0, 1) for k, u in enumerate(times_of(scale + own).tolist()) if u >= t)
    base, piece = at, flat[at : at + 65536].tobytes()
    for u, own, k in due:
        while t < u:
            # a walk steps on by one at most, so a piece lasts for as many steps as it has symbols left
            stop = min(u, t + len(piece) - (at - base))
            i, row = at - base, t % PERIOD
            for _ in range(stop - t):
                i += _STEPS[row][piece[i]]
                row = row + 1 if row + 1 < PERIOD else 0
            at, t = base + i, stop
            if flat[at] == 0:
                return
            if at - base >= len(piece) - 1 or t < u:
                base, piece = at, flat[at : at + 65536].tobytes()
        out[own][k] = flat[at]


def likeness(x: str, y: str) -> float:
    """0 to 1: the share of samples that agree, less what agrees by chance, on a scale that both have; 1 for equal fingerprints, 0 where the lengths are too far apart."""
    if x == y:
        return 1.0
    (i, *a), (j, *b) = x.split(":"), y.split(":")
    i, j = int(i, 16), int(j, 16)
    if abs(i - j) > 1:
        return 0.0
    u, v = (np.frombuffer(p[max(i, j) - s].encode(), np.uint8) for s, p in ((i, a), (j, b)))
    used = (u != 48) | (v != 48)
    if not used.any():
        return 1.0
    same = float((u == v)[used].mean())
    return max(0.0, (same - 1 / CLASSES) / (1 - 1 / CLASSES))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many of the first characters of the next one, or all of them."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt by ranges of doc_id and sorted, so that each row's next one follows it; the first row of the next range stands at the end of each (own = false).

    Cut points are ids that occur, one for a partition; the text is shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    shares = [i / parts for i in range(1, parts)]
    low, cuts = docs.agg(F.min(key), F.percentile_approx(key, shares, 100 * parts) if shares else F.lit(None)).first()
    if low is None:
        return docs.withColumns({"part": F.lit(0), "own": F.lit(True), "order": key})
    cuts = sorted({c for c in cuts or [] if c > low})
    # the cut points by slices of about the square root of their number, so that a row is compared with two short arrays
    width = max(1, round(len(cuts) ** 0.5))
    slices = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    heads = F.lit([c[0] for c in slices]) if slices else F.array().cast("array<long>")
    inner = F.lit(slices) if slices else F.array().cast("array<array<long>>")
    order = F.col("order")
    dealt = docs.withColumn("order", key).withColumn("slice", F.size(F.filter(heads, lambda c: c <= order)) - 1)
    dealt = dealt.withColumn("own_slice", F.get(inner, F.col("slice"))).withColumn("place", F.size(F.filter("own_slice", lambda c: c <= order)))
    dealt = dealt.withColumn("part", F.when(F.col("slice") < 0, 0).otherwise(F.col("slice") * width + F.col("place")))
    before = F.when(order == low, F.lit(len(cuts))).when(F.get("own_slice", F.col("place") - 1) == order, F.col("part") - 1)
    both = F.when(before.isNotNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own")), F.struct(before.alias("part"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))))
    return (
        dealt.withColumn("to", F.explode(both)).select("doc_id", "text", "order", "to.part", "to.own")
        # a range is a partition, not hashed into one
        .repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.col("own").desc(), "order", "text")
    )


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The next document is the one of the next id, after the last the first; rows that repeat an id
    follow each other by text, null first; a null id comes before all others. A null text is an
    empty one, whose fingerprint has no samples. A lone document is its own next one. No rows give
    no rows. Other columns are not looked at.
    """
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    def run(batches):
        waiting: list[tuple] = []  # (doc_id, text, part, own)

        def flush(final: bool):
            nonlocal waiting
            todo = waiting if final else waiting[:-1]
            texts = [t for _, t, _, _ in waiting]
            pairs = []
            for k, (doc, text, part, own) in enumerate(todo):
                if own:
                    follows = k + 1 < len(waiting) and waiting[k + 1][2] == part
                    pairs.append((k, k + 1 if follows else k))
            if not pairs:
                waiting = [] if final else waiting[-1:]
                return
            changed = [edited(texts[k], texts[n]) for k, n in pairs]
            prints = fingerprints([symbols(t) for t in texts] + [symbols(t) for t in changed])
            own_prints, new_prints = prints[: len(texts)], prints[len(texts) :]
            waiting = [] if final else waiting[-1:]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([todo[k][0] for k, _ in pairs], pa.int64()), pa.array([len(texts[k]) for k, _ in pairs], pa.int64()), pa.array(changed, pa.string()),
                    pa.array([own_prints[k] for k, _ in pairs], pa.string()), pa.array(new_prints, pa.string()),
                    pa.array([likeness(own_prints[k], p) for (k, _), p in zip(pairs, new_prints)], pa.float64()),
                    pa.array([likeness(own_prints[k], own_prints[n]) for k, n in pairs], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for b in batches:
            for doc, text, part, own in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "part", "own"))):
                waiting.append((doc, text or "", part, own))
                size += len(text or "")
                if size >= SLICE_CHARS:
                    yield from flush(False)
                    size = len(waiting[-1][1])
        if waiting:
            yield from flush(True)
        waiting = []
        release()

    prepare(docs.sparkSession)
    return rows.select("doc_id", "text", "part", "own").mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Bands of sampled characters, likeness from which fingerprints are linked, and members of a bucket that a task compares with each other; a larger bucket is dealt to pairs of its parts.
BANDS, LEAST, BUCKET = 32, 0.8, 4096


def _bucket_links(t: pa.Table, least: float) -> pa.RecordBatch | None:
    ids, side, own = (t[c].to_numpy() for c in ("doc_id", "side", "own"))
    codes = np.frombuffer(b"".join(x.encode() for x in t["code"].to_pylist()), np.uint8).reshape(len(ids), SAMPLES)
    labels, out = np.arange(len(ids)), []
    for i in range(len(ids) - 1):
        other = np.flatnonzero((labels[i + 1 :] != labels[i]) & ((side[i + 1 :] == 0) | (side[i + 1 :] != side[i])) & (own[i + 1 :] | own[i])) + i + 1
        if not other.size:
            continue
        used = (codes[other] != 48) | (codes[i] != 48)
        same = ((codes[other] == codes[i]) & used).sum(1) / np.maximum(1, used.sum(1))
        to = other[(same - 1 / CLASSES) / (1 - 1 / CLASSES) >= least]
        found, first = np.unique(labels[to], return_index=True)
        out += [(int(ids[i]), int(ids[k])) for k in to[first]]
        labels[np.isin(labels, found) | (labels == labels[i])] = min([labels[i], *found])
    if not out:
        return None
    a, b = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def classes_of(prints: DataFrame, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """(fingerprint, class_id) of each distinct fingerprint of prints(doc_id, fingerprint): the smallest id that links of this likeness reach, among documents that agree in a band of sampled characters.

    Equal fingerprints are one class from the start. What a bucket sends on are links that join its
    components, not all its pairs. Rows without an id or a fingerprint are left out.
    """
    prints = prints.filter("doc_id is not null and fingerprint is not null")
    reps = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "prints")
    width = SAMPLES // bands
    parts = F.array(*[F.struct((F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int") + d).alias("scale"), F.lit(d == 0).alias("own"), F.substring("fingerprint", 4 + d * (SAMPLES + 1), SAMPLES).alias("code")) for d in (0, 1)])
    coded = reps.select(F.col("rep").alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.*")
    keys = F.expr(f"filter(transform(sequence(0, {bands - 1}), i -> struct(i as band, substring(code, i * {width} + 1, {width}) as key)), x -> x.key rlike '[1-9a-f]')")
    rows = coded.select("doc_id", "scale", "own", F.explode(keys).alias("b")).select("doc_id", "own", "scale", F.xxhash64("scale", "b.band", "b.key").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.max("scale").alias("s"), F.bool_or("own").alias("any")).filter("n > 1 and any")
    full = full.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("parts")).cast("int")
    met = rows.join(full, "key").withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    dealt = met.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), side.alias("side"), "doc_id", "scale", "own")
    members = dealt.join(coded, ["doc_id", "scale", "own"])
    links = by_group(members.select("bucket", "side", "doc_id", "own", "code"), "bucket", ["doc_id"], lambda t: _bucket_links(t, least), "a long, b long")
    comp = components(links)
    return reps.join(comp, reps.rep == comp.node, "left").select("fingerprint", F.coalesce("component", "rep").alias("class_id"))


def near_classes(prints: DataFrame, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id) for prints(doc_id, fingerprint), by classes_of; rows without an id or a fingerprint are left out."""
    known = prints.filter("doc_id is not null and fingerprint is not null").select("doc_id", "fingerprint")
    return known.join(classes_of(known, bands, least), "fingerprint").select("doc_id", "class_id")


def classified(found: DataFrame) -> DataFrame:
    """fingerprint's rows with class_id: the smallest id among documents that bands and verification link; a row without an id has none."""
    found = cut(found, "fingerprints")
    # a table of its own, so that a fingerprint that many documents have can be split in the join
    classes = cut(classes_of(found.select("doc_id", "fingerprint")), "classes")
    return found.join(classes, "fingerprint", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))


def report(found: DataFrame) -> DataFrame:
    found = classified(found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")
