"""The variation set: a DataFrame with a row for each variant, the ordered samples, and metadata.

Columns: variant_idx long, chrom string, pos long, id string, ref string, alt array<string>,
qual double, gt array<array<int>>, gq, dp, ro array<int>, ao, ad array<array<int>>; arrays of
calls are indexed by sample. Any of them but variant_idx may be absent, more may be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL_FIELDS = ("gt", "gq", "dp", "ro", "ao", "ad")
VARIANT_FIELDS = ("chrom", "pos", "id", "ref", "alt", "qual")
#: Missing value for each kind of column.
MISSING_VALUES = {"int": -1, "bigint": -1, "smallint": -1, "tinyint": -1, "float": None, "double": None, "string": "", "binary": b"", "boolean": False}


class EmptyVariationsError(ValueError):
    pass


def missing_value(kind: str):
    """-1 for integers, NULL for floats, empty for strings, False for booleans; -1 for each allele of a call."""
    if kind == "genotype":
        return [-1, -1]
    try:
        return MISSING_VALUES[kind]
    except KeyError:
        raise ValueError(f"no missing value for {kind}") from None


#: Ranges of indices in which places are counted, and places up to which a list of them is broadcast: 8 bytes each.
RANGES, BROADCAST_PLACES = 4096, 1_000_000


def _met(df: DataFrame, places, column: str) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(int(i),) for i in set(places)], f"{column} long")
    return df.join(F.broadcast(wanted) if len(places) <= BROADCAST_PLACES else wanted.hint("merge"), column, "left_semi")


@dataclass(frozen=True)
class Variations:
    df: DataFrame
    samples: tuple[str, ...]
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "samples", tuple(self.samples))
        calls = [c for c in CALL_FIELDS if c in self.df.columns]
        if calls and not self.samples:
            raise ValueError(f"call fields need samples: {calls}")

    def __contains__(self, name: str) -> bool:
        return name in self.df.columns

    def keys(self) -> list[str]:
        return list(self.df.columns)

    def items(self):
        return [(c, self.df[c]) for c in self.df.columns]

    def __getitem__(self, name: str):
        return self.df[name] if name in self else None

    def with_df(self, df: DataFrame) -> "Variations":
        return Variations(df, self.samples, self.metadata)

    def with_field(self, name: str, value) -> "Variations":
        """A field set from a column expression; a call field with another number of samples than there are raises when it is read."""
        if name in CALL_FIELDS:
            if not self.samples:
                raise ValueError("call fields need samples")
            size = F.size(value)
            value = F.when(size == len(self.samples), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} has another number of samples: "), size.cast("string"))))
        return self.with_df(self.df.withColumn(name, value))

    @property
    def num_samples(self) -> int:
        return len(self.samples)

    @property
    def num_variations(self) -> int:
        return self.df.count()

    @property
    def ploidy(self) -> int:
        row = self.df.select(F.size(F.get("gt", F.lit(0))).alias("p")).first() if "gt" in self else None
        if row is None:
            raise EmptyVariationsError("no genotypes")
        return row.p

    def ranked(self) -> tuple[DataFrame, int]:
        """(df with __rank, the place from 0 by variant_idx; number of variants). Indices without gaps are places themselves; others are counted in two steps, over ranges of indices and inside them."""
        lo, hi, n = self.df.agg(F.min("variant_idx"), F.max("variant_idx"), F.count("*")).first()
        if not n or hi - lo + 1 == n:
            return self.df.withColumn("__rank", F.col("variant_idx") - F.lit(lo or 0)), n
        width = -(-(hi - lo + 1) // RANGES)
        spread = self.df.withColumn("__range", F.floor((F.col("variant_idx") - lo) / width))
        before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        base = spread.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
        inside = F.row_number().over(Window.partitionBy("__range").orderBy("variant_idx"))
        # at most RANGES rows
        found = spread.withColumn("__inside", inside).join(F.broadcast(base), "__range").withColumn("__rank", F.col("__base") + F.col("__inside") - 1)
        return found.drop("__range", "__base", "__inside"), n

    def _at(self, places: list[int]) -> "Variations":
        df, _ = self.ranked()
        return self.with_df(_met(df, places, "__rank").drop("__rank"))

    def get_vars(self, index) -> "Variations":
        """A condition, a slice of variant_idx, or a list of variant_idx; a mask of booleans, and negative numbers, count places by variant_idx, as arrays do."""
        if isinstance(index, slice) and any(x is not None and x < 0 for x in (index.start, index.stop, index.step)):
            df, n = self.ranked()
            places = range(n)[index]
            if not places:
                return self.with_df(df.filter(F.lit(False)).drop("__rank"))
            low, high, step = min(places), max(places), abs(places.step)
            return self.with_df(df.filter((F.col("__rank") >= low) & (F.col("__rank") <= high) & ((F.col("__rank") - low) % step == 0)).drop("__rank"))
        if isinstance(index, slice):
            cond = F.lit(True)
            if index.start is not None:
                cond = cond & (F.col("variant_idx") >= index.start)
            if index.stop is not None:
                cond = cond & (F.col("variant_idx") < index.stop)
            if index.step not in (None, 1):
                cond = cond & (F.pmod(F.col("variant_idx") - (index.start or 0), F.lit(index.step)) == 0)
            return self.with_df(self.df.filter(cond))
        if hasattr(index, "tolist") and not isinstance(index, Column):
            index = index.tolist()
        if isinstance(index, (list, tuple)):
            if index and all(isinstance(i, bool) for i in index):
                if len(index) != (n := self.num_variations):
                    raise IndexError(f"a mask of {len(index)} for {n} variants")
                return self._at([k for k, keep in enumerate(index) if keep])
            if any(i < 0 for i in index):
                n = self.num_variations
                return self._at([i % n if -n <= i < n else n for i in index])
            return self.with_df(_met(self.df, index, "variant_idx"))
        return self.with_df(self.df.filter(F.coalesce(index, F.lit(False))))

    def iterate_chunks(self, chunk_size: int) -> Iterator["Variations"]:
        """Ranges of variant_idx in order; the ranges cover the smallest to the largest index."""
        lo, hi = self.df.agg(F.min("variant_idx"), F.max("variant_idx")).first()
        if lo is not None:
            for start in range(lo, hi + 1, chunk_size):
                yield self.get_vars(slice(start, start + chunk_size))

    def long(self) -> DataFrame:
        """A row for each call: variant_idx, chrom, pos, sample_idx, a1, a2 and what call fields there are."""
        cols = [c for c in CALL_FIELDS if c in self]
        zipped = F.arrays_zip(*[F.col(c) for c in cols])
        rows = self.df.select("variant_idx", "chrom", "pos", F.posexplode(zipped).alias("sample_idx", "call"))
        out = ["variant_idx", "chrom", "pos", "sample_idx"]
        for c in cols:
            out += [F.get("call.gt", F.lit(0)).alias("a1"), F.get("call.gt", F.lit(1)).alias("a2")] if c == "gt" else [F.col(f"call.{c}").alias(c)]
        return rows.select(*out)
