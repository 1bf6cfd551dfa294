"""Small fixed sets with known results."""

from locusframe.variations import Variations

M = [-1, -1]
SCHEMA = "variant_idx long, chrom string, pos long, id string, ref string, alt array<string>, qual double, gt array<array<int>>, gq array<int>, dp array<int>, ro array<int>, ao array<array<int>>"
SAMPLES = ("pepo", "mu16", "upv196")
#: chrom, pos, ref, alt, then per sample genotype, alternative depth, depth, quality, reference depth.
T7 = [
    ("CUUC00007_TC01", 640, "A", "C", None, ([0, 0], 0, 10, 17, 10), ([1, 1], 9, 9, 46, 0)),
    ("CUUC00007_TC01", 656, "A", "C", None, ([0, 0], 0, 9, 18, 9), ([1, 1], 8, 8, 41, 0)),
    ("CUUC00007_TC01", 665, "G", "A", None, ([0, 0], 0, 9, 18, 9), ([1, 1], 8, 8, 41, 0)),
    ("CUUC00025_TC01", 285, "C", "G", ([0, 1], 9, 14, 35, 5), None, ([0, 0], 0, 6, 10, 6)),
    ("CUUC00027_TC01", 238, "A", "G", None, None, None),
    ("CUUC00029_TC01", 25, "C", "A", None, ([0, 1], 6, 9, 23, 3), None),
    ("CUUC00029_TC01", 34, "A", "G", None, ([0, 1], 6, 10, 22, 4), ([1, 1], 5, 6, 21, 1)),
]


def t7(spark):
    rows = []
    for i, (chrom, pos, ref, alt, *calls) in enumerate(T7):
        calls = [c or (M, -1, -1, -1, -1) for c in calls]
        rows.append((i, chrom, pos, None, ref, [alt], None, [c[0] for c in calls], [c[3] for c in calls], [c[2] for c in calls], [c[4] for c in calls], [[c[1]] for c in calls]))
    return Variations(spark.createDataFrame(rows, SCHEMA), SAMPLES)


def simple(spark, gts, dp=None, chroms=None, positions=None, **more):
    """A set from genotypes alone."""
    n = len(gts)
    cols = {"variant_idx": list(range(n)), "chrom": chroms or ["chr1"] * n, "pos": positions or list(range(1, n + 1)), "gt": gts} | ({"dp": dp} if dp else {}) | more
    kinds = {"variant_idx": "long", "chrom": "string", "pos": "long", "gt": "array<array<int>>", "dp": "array<int>", "ro": "array<int>", "ao": "array<array<int>>", "ad": "array<array<int>>"}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} {kinds[c]}" for c in cols))
    return Variations(df, [f"s{i}" for i in range(len(gts[0]))])


def values(df, name):
    return [r[name] for r in df.orderBy("variant_idx").collect()]
