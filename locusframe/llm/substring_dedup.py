"""Substring deduplication with a log-structured index of window fingerprints.

A window is 50 words in a row. Of each window the run of ten words with the smallest hash is its
anchor, so equal windows have equal anchors, and neighbouring windows mostly share theirs; a group
of windows with one anchor is one entry (anchor, hash of all words that the group covers). The
index holds, for each entry, the smallest document that has it and where, in runs that are never
changed: each is a table in buckets by anchor, sorted inside them, so that runs and batches meet
without being shuffled again. A batch is merge-joined with the runs, its matches are verified,
it becomes a run itself, and runs are compacted into one when there are many. The runs and their
list stay in the index's folder, where a later job opens them again.

Entries that agree settle whole groups. Where one anchor has several entries (at the edges of
what documents share) their windows are hashed one by one, with another base than the anchors,
from the texts. So every window is judged, though few are hashed into rows. What the hashes claim
is verified: the words of each claimed range are held against the words of the document that is
said to have them before, and only ranges that are equal word by word go.

An anchor or an entry that a large share of all rows has (found in a sample, which decides on the
layout only) is dealt apart: a hot anchor's entries over PARTS buckets, a hot entry's rows by a
broadcast join. At most 4 for each shuffle partition are hot.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_batch, cut, drop, own_folder, read_note, texts_of, write_note
from .words import Words, mix64, run_hashes, slices

WINDOW, ANCHOR = 50, 10
#: Batches in which the query's documents come, by ascending id; runs above which they are compacted before the next batch.
BATCHES, MOST_RUNS = 3, 1
#: Ids up to which a table of them is broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000
#: Share of the rows that is looked at for hot keys, rows of the sample that a hot key has at least, parts of a hot anchor.
LAYOUT_SHARE, LAYOUT_ROWS, PARTS = 0.02, 32, 64

_BASE = 0xA24BAED4963EE407
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def groups(words: np.ndarray):
    """(first window, windows, anchor, context) of each group of a text's windows, given its words' hashes; windows are numbered by their first word."""
    n = words.size - WINDOW + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    k = run_hashes(words, ANCHOR)
    best, width, target = np.arange(k.size), 1, WINDOW - ANCHOR + 1
    while width < target:
        shift = min(width, target - width)
        a, b = best[:-shift], best[shift:]
        best, width = np.where(k[b] < k[a], b, a), width + shift
    start = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    size = np.diff(np.append(start, n))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, words.size))])
    covered = (sums[start + size + WINDOW - 1] - sums[start]) * _powers(_INVERSE, words.size)[start]
    place = (best[start] - start).astype(np.uint64) * np.uint64(128) + size.astype(np.uint64)
    return start, size, k[best[start]].view(np.int64), mix64(covered + place * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def window_hashes(words: np.ndarray) -> np.ndarray:
    return run_hashes(words, WINDOW, 0x8CB92BA72F3D8DD7).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, h, ctx, start, n, each) for docs(doc_id, fp, text): n windows from start on have the entry (h, ctx), whose own number of windows is each. Equal entries of one window each that follow each other are one row."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
            texts, ids, fps = texts_of(b.column("text")), b.column("doc_id").to_numpy(), b.column("fp").to_numpy()
            out: list[list] = [[] for _ in range(7)]
            for i, j in slices(texts):
                for row, words in enumerate(Words(texts[i:j]), i):
                    start, size, h, ctx = groups(words)
                    if not start.size:
                        continue
                    same = (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1]) & (size[1:] == 1) & (size[:-1] == 1)
                    keep = np.flatnonzero(np.append(True, ~same))
                    n = np.add.reduceat(size, keep)
                    for c, x in zip(out, (np.full(keep.size, ids[row]), np.full(keep.size, fps[row]), h[keep], ctx[keep], start[keep].astype(np.int32), n.astype(np.int32), size[keep].astype(np.int32))):
                        c.append(x)
            if not out[0]:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "fp", "h", "ctx", "start", "n", "each"])

        return run

    return by_batch(docs.select("doc_id", "fp", "text"), make, "doc_id long, fp long, h long, ctx long, start int, n int, each int")


def window_rows(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, ctx, first, off, at, w): hashes of the windows of wanted(h, ctx, first) entries, from the texts(doc_id, text) of their first documents; at is the window's first word."""
    lists = wanted.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list(F.struct("h", "ctx")).alias("entries"))
    rows = texts.select("doc_id", "text").join(lists, "doc_id")

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
            texts, ids, entries = texts_of(b.column("text")), b.column("doc_id").to_numpy(), b.column("entries").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for i, j in slices(texts):
                for row, words in enumerate(Words(texts[i:j]), i):
                    start, size, h, ctx = groups(words)
                    if not start.size:
                        continue
                    hashes = window_hashes(words)
                    places: dict = {}
                    for g, key in enumerate(zip(h.tolist(), ctx.tolist())):
                        places.setdefault(key, g)
                    for e in entries[row]:
                        if (g := places.get((e["h"], e["ctx"]))) is None:
                            continue
                        k = int(size[g])
                        for c, x in zip(out, (np.full(k, e["h"]), np.full(k, e["ctx"]), np.full(k, ids[row]), np.arange(k, dtype=np.int32), np.arange(start[g], start[g] + k, dtype=np.int32), hashes[start[g] : start[g] + k])):
                            c.append(x)
            if not out[0]:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "ctx", "first", "off", "at", "w"])

        return run

    return by_batch(rows.select("doc_id", "text", "entries"), make, "h long, ctx long, first long, off int, at int, w long")


def _hot(prints: DataFrame, keys: list[str], counted) -> list[tuple]:
    """Keys with more than a 4 * partitions-th of the sampled rows: so many at most, whatever the input."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(LAYOUT_ROWS, LAYOUT_SHARE * prints.count() / (4 * parts))
    found = prints.sample(fraction=LAYOUT_SHARE, seed=11).groupBy(*keys).agg(counted.alias("rows")).filter(F.col("rows") > least)
    return [tuple(r)[: len(keys)] for r in found.collect()]


def entries_of(prints: DataFrame, hot: list[int]) -> DataFrame:
    """A batch's entries (h, part, ctx, first, at): the smallest document that has each, and where. An anchor's part is 0, or one of PARTS where it is hot."""
    found = prints.groupBy("h", "ctx").agg(F.min("doc_id").alias("first"), F.min_by("start", "doc_id").alias("at"))
    part = F.when(F.col("h").isin(hot), 1 + F.pmod("ctx", F.lit(PARTS))).otherwise(0).cast("int")
    return found.select("h", part.alias("part"), "ctx", "first", "at")


def _merged(tables: list[DataFrame], keys: list[str], **more) -> DataFrame:
    """Entries of several runs as one; tables in the same buckets are merged where they are."""
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.min("first").alias("first"), F.min_by("at", "first").alias("at"), *[f.alias(c) for c, f in more.items()])


class FingerprintIndex:
    """Runs of entries in a folder, with a note that lists them; opened again where the folder has one.

    Batches must come by ascending ids: what a batch holds counts as later than all before. A batch
    is in the index once its run is in the note, so a job that fails before leaves it as it was.
    Without a folder the index goes when the process ends.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, most_runs: int = MOST_RUNS):
        self.spark, self.most_runs = spark, most_runs
        self.folder = (folder or own_folder(spark, "index")).rstrip("/")
        note = json.loads(read_note(spark, self._note) or "{}")
        self.buckets = note.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (name, hot anchors) of each run, and its table.
        self.runs: list[tuple[str, list[int]]] = [(r["name"], r["hot"]) for r in note.get("runs", [])]
        self.tables = [self._opened(name) for name, _ in self.runs]

    @property
    def _note(self) -> str:
        return f"{self.folder}/index.json"

    def _opened(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (h BIGINT, part INT, ctx BIGINT, first BIGINT, at INT) USING parquet CLUSTERED BY (h, part) SORTED BY (h, part, ctx) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _written(self, entries: DataFrame, dealt: bool = False) -> tuple[str, DataFrame]:
        """A run; dealt: the rows lie in its buckets already."""
        name = f"locusframe_run_{uuid.uuid4().hex}"
        rows = entries if dealt else entries.repartition(self.buckets, "h", "part")
        rows = rows.select("h", "part", "ctx", "first", "at")
        rows.write.bucketBy(self.buckets, "h", "part").sortBy("h", "part", "ctx").option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name, self.spark.table(name)

    def _keep(self, runs: list[tuple[str, list[int]]], tables: list[DataFrame]) -> None:
        self.runs, self.tables = runs, tables
        write_note(self.spark, self._note, json.dumps({"buckets": self.buckets, "runs": [{"name": n, "hot": h} for n, h in runs]}))

    def compact(self) -> None:
        """All runs as one. Anchors that are hot in some run but not in all are dealt anew; the others are merged inside their buckets."""
        hot = sorted({h for _, own in self.runs for h in own})
        merged = _merged([t.filter(~F.col("h").isin(hot)) for t in self.tables], ["h", "part", "ctx"])
        if hot:
            again = _merged([t.filter(F.col("h").isin(hot)) for t in self.tables], ["h", "ctx"]).withColumn("part", (1 + F.pmod("ctx", F.lit(PARTS))).cast("int"))
            name, table = self._written(merged.unionByName(again))
        else:
            name, table = self._written(merged, dealt=True)
        old = [n for n, _ in self.runs]
        self._keep([(name, hot)], [table])
        for n in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def _entries(self, own: DataFrame, hot: list[int]) -> DataFrame:
        """(h, ctx, first, at, new): the batch's entries, and the runs' entries of the same anchors."""
        special = sorted({*hot, *(h for _, old in self.runs for h in old)})
        plain, apart = ~F.col("h").isin(special), F.col("h").isin(special)
        anchors = own.filter(plain).select("h", "part").distinct()
        frames = [own.filter(plain).withColumn("new", F.lit(1)), *[t.filter(plain).join(anchors, ["h", "part"], "left_semi").withColumn("new", F.lit(0)) for t in self.tables]]
        found = _merged(frames, ["h", "part", "ctx"], new=F.max("new")).drop("part")
        if special:
            frames = [own.filter(apart).withColumn("new", F.lit(1)), *[t.filter(apart).withColumn("new", F.lit(0)) for t in self.tables]]
            found = found.unionByName(_merged(frames, ["h", "ctx"], new=F.max("new")))
        return found

    def ingest(self, docs: DataFrame, texts: DataFrame) -> DataFrame:
        """(doc_id, fp, claims) of the documents that lose words: verified claims, see without. docs: the batch (doc_id, fp, text); texts: a store (doc_id, text) of the batch and all documents before it, from which those that share an anchor with the batch are read."""
        if len(self.runs) > self.most_runs:
            self.compact()
        prints = cut(fingerprints(docs), "fingerprints")
        hot = [h for (h,) in _hot(prints, ["h"], F.count_distinct("ctx"))]
        name, own = self._written(entries_of(prints, hot))
        entries = cut(self._entries(own, hot), "entries")
        # an entry that a smaller document has: the whole group goes
        known, key = entries.filter("new = 1").select("h", "ctx", "first", "at"), ["h", "ctx"]
        whole = prints.join(known, key)
        if common := _hot(prints, key, F.count("*")):
            often = F.broadcast(self.spark.createDataFrame(common, "h long, ctx long"))
            whole = prints.join(often, key, "left_anti").join(known, key).unionByName(prints.join(F.broadcast(known.join(often, key, "left_semi")), key))
        # a row of equal windows has one window to match
        m = F.when(F.col("each") == 1, 1).otherwise(F.col("n"))
        claims = whole.filter("doc_id > first").select("doc_id", "fp", "start", "n", m.alias("m"), F.col("first").alias("src"), "at")
        # anchors with several entries: window by window, for the first document of each
        mixed = entries.groupBy("h").agg(F.count("*").alias("kinds"), F.min("first").alias("lo"), F.max("first").alias("hi"), F.max("new").alias("any")).filter("kinds > 1 and lo < hi and any = 1").select("h")
        # a table of its own, so that a hot anchor can be split in the join
        anchors = cut(mixed, "anchors")
        wanted = cut(entries.join(anchors, "h").select("h", "ctx", "first"), "mixed")
        windows = cut(window_rows(wanted, _of(texts, wanted.select(F.col("first").alias("doc_id")))), "windows")
        low = windows.groupBy("h", "w").agg(F.min("first").alias("src"), F.min_by("at", "first").alias("src_at"), F.max("first").alias("hi")).filter("src < hi").select("h", "w", "src", "src_at")
        offs = windows.join(low, ["h", "w"]).filter("src < first").groupBy("h", "ctx", F.col("first").alias("doc_id")).agg(F.collect_set(F.struct("off", "src", "src_at")).alias("offs"))
        single = prints.join(offs, ["h", "ctx", "doc_id"]).select("doc_id", "fp", "start", "n", "each", F.explode("offs").alias("o"))
        row = (F.col("each") == 1) & (F.col("n") > 1)
        claims = claims.unionByName(single.select("doc_id", "fp", (F.col("start") + F.col("o.off")).alias("start"), F.when(row, F.col("n")).otherwise(1).alias("n"), F.lit(1).alias("m"), F.col("o.src").alias("src"), F.col("o.src_at").alias("at")))
        longer = cut(joined(claims), "claims")
        spans = cut(words_at(longer.select("src", "at", "m").distinct(), _of(texts, longer.select(F.col("src").alias("doc_id")))), "spans")
        found = longer.join(spans, ["src", "at", "m"]).groupBy("doc_id", "fp").agg(F.collect_list(F.struct("start", "n", "m", "words")).alias("claims"))
        gone = cut(found, "gone")
        drop(prints, entries, anchors, wanted, windows, longer, spans)
        self._keep([*self.runs, (name, hot)], [*self.tables, own])
        return gone


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts of these ids; the ids are broadcast where they are few."""
    held = ids.distinct()
    return texts.join(broadcast_if_small(held, held.count(), BROADCAST_IDS), "doc_id", "left_semi")


def covering(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The fewest of the ranges of words (start, end) of each row that cover the same words as all of them."""
    order = np.lexsort((end, start, row))
    kept, last, covered, best = [], None, 0, -1
    reach = -1  # the furthest end among the ranges that begin in what is covered
    for i, r, s, e in zip(order.tolist(), row[order].tolist(), start[order].tolist(), end[order].tolist()):
        if r != last or s > covered:
            # what was held back is needed, and may reach on
            if r == last and reach > covered:
                kept.append(best)
                covered, reach = reach, -1
            if r != last and last is not None and reach > covered:
                kept.append(best)
            if r != last or s > covered:
                last, covered, reach = r, s, -1
        if e > reach:
            reach, best = e, i
    if reach > covered:
        kept.append(best)
    return np.array(kept, np.int64)


def joined(claims: DataFrame) -> DataFrame:
    """claims(doc_id, fp, start, n, m, src, at) with those that continue each other in both documents as one, and without those whose words others cover: a document has fewer than two for each window's length."""
    lists = claims.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("src", "at", "start", "n", "m")).alias("claims"))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = b.column("claims")
            sizes = np.diff(rows.offsets.to_numpy())
            doc, fp = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("doc_id", "fp"))
            flat = rows.flatten()
            src, at, start, n, m = (flat.field(k).to_numpy().astype(np.int64) for k in ("src", "at", "start", "n", "m"))
            row = np.repeat(np.arange(len(rows)), sizes)
            order = np.lexsort((n, start, start - at, m != n, src, row))
            row, doc, fp, src, at, start, n, m = (x[order] for x in (row, doc, fp, src, at, start, n, m))
            end = start + n
            # the furthest end so far of the same row, source and shift: claims sorted by start
            new = np.append(True, (row[1:] != row[:-1]) | (src[1:] != src[:-1]) | ((start - at)[1:] != (start - at)[:-1]) | (m != n)[1:] | (m != n)[:-1])
            span = np.cumsum(new)
            lift = span * (int(end.max(initial=0)) + 1)
            far = np.maximum.accumulate(end + lift) - lift
            new[1:] |= start[1:] > far[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], new.size) - 1
            size = np.where((m == n)[first], far[last] - start[first], n[first])
            row, doc, fp, start, src, at = (x[first] for x in (row, doc, fp, start, src, at))
            times = np.where((m == n)[first], size, m[first])
            keep = covering(row, start, start + size + WINDOW - 1)
            cols = (doc[keep], fp[keep], start[keep].astype(np.int32), size[keep].astype(np.int32), times[keep].astype(np.int32), src[keep], at[keep].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "fp", "start", "n", "m", "src", "at"])

        return run

    return by_batch(lists, make, "doc_id long, fp long, start int, n int, m int, src long, at int")


def words_at(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, at, m, words): the words of m windows from at on, joined by one space, for each wanted(src, at, m), from texts(doc_id, text). A row for each text of the id."""
    lists = wanted.groupBy(F.col("src").alias("doc_id")).agg(F.collect_list(F.struct("at", "m")).alias("spans"))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for doc, text, spans in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), b.column("spans").to_pylist()):
                words = text.split()
                for s in spans:
                    for c, x in zip(out, (doc, s["at"], s["m"], b" ".join(words[s["at"] : s["at"] + s["m"] + WINDOW - 1]))):
                        c.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["src", "at", "m", "words"])

        return run

    return by_batch(texts.select("doc_id", "text").join(lists, "doc_id"), make, "src long, at int, m int, words binary")


def holds(words: list[bytes], claim: dict) -> bool:
    """Whether the words of the claimed windows are those that the earlier document has."""
    start, n, m = claim["start"], claim["n"], claim["m"]
    own = words[start : start + n + WINDOW - 1]
    if m < n and own.count(own[0]) < len(own):
        return False
    return b" ".join(own[: m + WINDOW - 1]) == claim["words"]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for docs(doc_id, fp, text): kept is the text of the words that no claim covers, joined by one space.

    A claim says that the n windows from start on equal m windows that an earlier document has,
    whose words it carries; where m is 1, all n are equal. It counts only where the words are equal.
    """

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, removed, kept = [], [], []
            for text, claims in zip(texts_of(b.column("text")), b.column("claims").to_pylist()):
                words = text.split()
                out = np.zeros(len(words) + 1, np.int32)
                for c in claims or ():
                    if holds(words, c):
                        out[c["start"]] += 1
                        out[c["start"] + c["n"] + WINDOW - 1] -= 1
                drop = np.cumsum(out[:-1]) > 0 if claims else np.zeros(len(words), bool)
                n.append(len(words))
                removed.append(int(drop.sum()))
                kept.append(b" ".join(w for w, d in zip(words, drop.tolist()) if not d) if claims else b" ".join(words))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

        return run

    ids = gone.select("doc_id").distinct()
    ids = broadcast_if_small(ids, gone.count(), BROADCAST_IDS)
    touched = docs.join(ids, "doc_id", "left_semi").join(gone.select("doc_id", "fp", "claims"), ["doc_id", "fp"], "left").select("doc_id", "text", "claims")
    rest = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<start: int, n: int, m: int, words: binary>>").alias("claims"))
    return by_batch(touched.unionByName(rest), make, "doc_id long, n_words long, n_removed long, kept string")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text): fp tells texts of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("fp", F.xxhash64("text"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, most_runs: int = MOST_RUNS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs.

    A word goes when a window of 50 words covers it that also stands in a document of a smaller
    id. Ids are integers. A null text has no words. A row with a null id loses nothing and takes
    nothing from others. Rows that repeat an id take nothing from each other. Texts of fewer than
    50 words stay; very long texts and words are taken whole. No rows give no rows; other columns
    are not looked at.
    """
    rows = keyed(docs, id_col, text_col)
    known = rows.filter("doc_id is not null")
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(known.agg(F.percentile_approx("doc_id", shares)).first()[0] or [])) if shares else []
    index, gone = FingerprintIndex(docs.sparkSession, most_runs=most_runs), []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        inside = F.lit(True) if lo is None else F.col("doc_id") >= lo
        before = F.lit(True) if hi is None else F.col("doc_id") < hi
        gone.append(index.ingest(known.filter(inside & before), known.filter(before)))
    return without(rows, reduce(DataFrame.unionByName, gone))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
