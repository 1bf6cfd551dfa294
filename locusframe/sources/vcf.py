"""VCF text in and out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..variations import CALL_FIELDS, Variations
from .store import read_store, write_store

COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
#: Keys of the per-call fields; those with a value for each allele.
CALL_KEYS = {"gt": "GT", "gq": "GQ", "dp": "DP", "ro": "RO", "ao": "AO", "ad": "AD"}
LISTS = ("ao", "ad")
_META = re.compile(r'##(FORMAT|INFO|FILTER)=<ID=([^,>]+)(?:,Number=([^,>]+))?(?:,Type=([^,>]+))?(?:,Description="([^"]*)")?')


def parse_header(lines: list[str]) -> tuple[tuple[str, ...], dict]:
    samples: tuple[str, ...] = ()
    meta: dict = {}
    for line in lines:
        if line.startswith("#CHROM"):
            samples = tuple(line.rstrip("\r").split("\t")[9:])
        elif m := _META.match(line):
            group, name, number, kind, description = m.groups()
            meta[f"{group}/{name}"] = {"Number": number, "Type": kind, "Description": description}
        elif line.startswith("##") and "=" in line and not line.startswith("##contig"):
            key, _, value = line[2:].partition("=")
            if key != "fileformat":
                meta[key] = value
    return samples, meta


def _real(c: Column) -> Column:
    """Any form of a number, exponents too; NULL for what is none."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _int(c: Column) -> Column:
    """A number rounded to an integer, -1 for what is none."""
    return F.coalesce(F.round(_real(c)).try_cast("int"), F.lit(G.MISSING))


def _info(kind: str, number: str | None, name: str) -> Column:
    """A key's value in the info text, by its type and number in the header; NULL where it is missing, or false for a flag."""
    entries = F.split(F.coalesce(F.col("info"), F.lit("")), ";")
    if kind == "Flag":
        return F.exists(entries, lambda e: e == name)
    text = F.substring(F.get(F.filter(entries, lambda e: F.startswith(e, F.lit(name + "="))), F.lit(0)), len(name) + 2, 1 << 30)
    text = F.when(text != ".", text)
    one = {"Integer": lambda x: F.round(_real(x)).try_cast("int"), "Float": _real}.get(kind, lambda x: F.when(x != ".", x))
    return one(text) if number == "1" or kind not in ("Integer", "Float") else F.transform(F.split(text, ","), one)


def _numbers(size: Column):
    """A function that splits a list of numbers to size of them, missing ones -1."""
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    return lambda x: F.transform(places, lambda k: _int(F.get(F.split(F.coalesce(x, F.lit(".")), ","), k - 1)))


def read_vcf(spark, path: str, fields=None, info_fields=()) -> Variations:
    """Plain or compressed VCF; info_fields names INFO keys of the header that become columns info_<key> of their type. variant_idx is dense in file order: rows are counted by split, and only those counts and the FORMATs seen reach the driver. Call fields that no row has are left out."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    header = [r.value for r in text.filter(F.col("value").startswith("#")).select("value").distinct().collect()]
    samples, meta = parse_header(header)
    body = text.filter((F.col("value") != "") & ~F.col("value").startswith("#")).withColumn("__id", F.monotonically_increasing_id())
    splits = sorted(body.groupBy("file", "block").agg(F.min("__id").alias("lo"), F.count("*").alias("n"), F.collect_set(F.get(F.split("value", "\t"), F.lit(8))).alias("formats")).collect(), key=lambda r: (r.file, r.block))
    present = {key for r in splits for f in r.formats for key in f.rstrip("\r").split(":")}
    shift, done = [], 0
    for r in splits:
        shift.append((r.file, r.block, done - r.lo))
        done += r.n
    offsets = F.broadcast(spark.createDataFrame(shift, "file string, block long, shift long"))
    parts = body.join(offsets, ["file", "block"]).select((F.col("__id") + F.col("shift")).alias("variant_idx"), F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("p"))
    known = lambda i: F.when(F.get("p", F.lit(i)) != ".", F.get("p", F.lit(i)))
    keys = F.split(F.get("p", F.lit(8)), ":")
    rows = parts.withColumn("keys", keys).withColumn("calls", F.transform(F.slice("p", 10, len(samples)), lambda c: F.split(c, ":"))) if samples else parts
    value = lambda key: F.transform("calls", lambda c: F.get(c, F.array_position("keys", key).cast("int") - 1))
    n_alt = F.when(F.get("p", F.lit(4)) == ".", 0).otherwise(F.size(F.split(F.get("p", F.lit(4)), ",")))
    out = {
        "chrom": F.get("p", F.lit(0)), "pos": F.get("p", F.lit(1)).cast("long"), "id": known(2), "ref": F.get("p", F.lit(3)),
        "alt": F.when(F.get("p", F.lit(4)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get("p", F.lit(4)), ",")), "qual": _real(known(5)),
        "filter": known(6), "info": known(7),
    }
    for f, key in CALL_KEYS.items() if samples else ():
        if key not in present:
            continue
        if f == "gt":
            out[f] = F.transform(value(key), lambda g: F.transform(F.split(F.coalesce(g, F.lit("./.")), r"[/|]"), _int))
            out[f] = F.transform(out[f], lambda g: F.when((F.size(g) == 1) & (F.get(g, F.lit(0)) == G.MISSING), F.array(F.lit(G.MISSING), F.lit(G.MISSING))).otherwise(g))
        elif f in LISTS:
            out[f] = F.transform(value(key), _numbers(n_alt + (1 if f == "ad" else 0)))
        else:
            out[f] = F.transform(value(key), _int)
    wanted = [f for f in out if fields is None or f in fields]
    described = {k: meta.get(f"INFO/{k}") for k in info_fields}
    if lost := [k for k, d in described.items() if d is None]:
        raise KeyError(f"no such INFO in the header: {lost}")
    typed = [_info(d["Type"], d["Number"], k).alias(f"info_{k}") for k, d in described.items()]
    rows = rows.withColumn("info", out["info"]) if typed else rows
    return Variations(rows.select("variant_idx", *[out[f].alias(f) for f in wanted], *typed), samples if any(f in CALL_FIELDS for f in wanted) or samples else (), meta)


def number_text(x: Column) -> Column:
    """Four decimals at most, one at least; a dot for a missing number."""
    return F.when(x.isNull() | F.isnan(x), ".").otherwise(F.regexp_replace(F.format_string("%.4f", x), r"(\.\d+?)0+$", "$1"))


def integer_text(x: Column) -> Column:
    return F.when(x.isNull() | (x == G.MISSING), ".").otherwise(x.cast("string"))


def _joined(values: Column) -> Column:
    """Joined by commas, missing ones at the end dropped, a dot where nothing is left."""
    return F.regexp_replace(F.array_join(F.transform(values, integer_text), ","), r"(,\.)+$", "")


def _text(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), ".").otherwise(c)


def _alts(alt: Column) -> Column:
    kept = F.filter(alt, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) <= 0, ".").otherwise(F.array_join(kept, ","))


def flags_text(flags: dict[str, Column]) -> Column:
    """Names of the true flags joined by semicolons, a dot for none."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return F.when(F.size(names) == 0, ".").otherwise(F.array_join(names, ";"))


def info_text(values: dict[str, tuple[str, Column]]) -> Column:
    """key=value pairs joined by semicolons; (kind, column) with kind flag, int, float, string, ints or floats; missing ones left out."""
    parts = []
    for key, (kind, c) in values.items():
        shown = {"int": integer_text, "float": number_text, "string": _text, "ints": _joined, "floats": lambda x: F.coalesce(F.array_join(F.transform(x, number_text), ","), F.lit("."))}.get(kind)
        parts.append(F.when(c, F.lit(key)) if kind == "flag" else F.when(shown(c) != ".", F.concat(F.lit(key + "="), shown(c))))
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, ";"))


def info_columns(v: Variations) -> dict:
    """The columns info_<key> as info_text takes them."""
    kinds = {"boolean": "flag", "int": "int", "double": "float", "string": "string", "array<int>": "ints", "array<double>": "floats"}
    return {c.removeprefix("info_"): (kinds[t], F.col(c)) for c, t in v.df.dtypes if c.startswith("info_")}


def body_lines(v: Variations, legacy: bool = False, filters: dict[str, Column] | None = None, info: dict | None = None) -> DataFrame:
    """(variant_idx, line). legacy repeats GT among the sorted fields and writes its alleles with commas, a dot for a missing call."""
    fields = sorted(f for f in CALL_FIELDS if f in v and (legacy or f != "gt"))
    keys = [CALL_KEYS["gt"], *[CALL_KEYS[f] for f in fields]] if "gt" in v else [CALL_KEYS[f] for f in fields]

    def shown(f: str, x: Column) -> Column:
        if f == "gt":
            return _joined(x) if legacy else F.array_join(F.transform(x, integer_text), "/")
        return _joined(x) if f in LISTS else integer_text(x)

    order = ["gt", *fields] if "gt" in v else fields
    df, calls = v.df, F.lit("")
    if order:
        zipped = F.arrays_zip(*[F.col(f) for f in dict.fromkeys(order)])
        calls = F.concat(F.lit("\t"), F.array_join(F.transform(zipped, lambda z: F.concat_ws(":", *[shown(f, z[f]) for f in order])), "\t"))
    have = lambda f, c: c if f in v else F.lit(".")
    # the text of the file goes before the columns read from it
    info = info or ({} if "info" in v else info_columns(v))
    flt = flags_text(filters) if filters else have("filter", _text(F.col("filter")))
    inf = info_text(info) if info else have("info", _text(F.col("info")))
    cells = [
        have("chrom", _text(F.col("chrom"))), have("pos", F.col("pos").cast("string")), have("id", _text(F.col("id"))), have("ref", _text(F.col("ref"))),
        have("alt", _alts(F.col("alt"))), have("qual", number_text(F.col("qual"))), flt, inf, F.lit(":".join(keys) or "."),
    ]
    return df.select("variant_idx", F.concat(F.concat_ws("\t", *cells), calls).alias("line"))


def header_lines(v: Variations, version: str = "VCFv4.2") -> list[str]:
    lines = [f"##fileformat={version}"]
    lines += [f"##{k}={x}" for k, x in v.metadata.items() if not isinstance(x, dict)]
    for path in sorted(k for k, x in v.metadata.items() if isinstance(x, dict)):
        group, _, name = path.partition("/")
        if group not in ("FORMAT", "INFO", "FILTER"):
            continue
        if group == "FORMAT" and name.lower() not in v:
            continue
        x = v.metadata[path]
        cells = [f"ID={name}", *[f"{k}={x[k]}" for k in ("Number", "Type") if x.get(k) is not None], *([f'Description="{x["Description"]}"'] if x.get("Description") is not None else [])]
        lines.append(f"##{group}=<{','.join(cells)}>")
    return [*lines, "#" + "\t".join([*(c.upper() for c in COLUMNS), *v.samples])]


def write_vcf(v: Variations, out, version: str = "VCFv4.2", legacy: bool = False) -> None:
    """One file, in order; the driver holds a partition at a time. out is a text file."""
    out.write("\n".join(header_lines(v, version)) + "\n")
    for r in body_lines(v, legacy).orderBy("variant_idx").select("line").toLocalIterator():
        out.write(r.line + "\n")


def write_vcf_parts(v: Variations, path: str, version: str = "VCFv4.2") -> None:
    """A folder of text parts in order, written by the executors: part names sort as the variants do, the header first."""
    spark = v.df.sparkSession
    spark.createDataFrame([("\n".join(header_lines(v, version)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    body_lines(v).orderBy("variant_idx").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/body")


def vcf_to_store(spark, vcf_path: str, out_path: str, fields: list[str] | None = None, fmt: str = "parquet") -> None:
    """Reads VCF text and writes a store; fields leaves out what isn't named."""
    write_store(read_vcf(spark, vcf_path, fields), out_path, fmt)


def store_to_vcf(spark, path: str, out, version: str = "VCFv4.2", legacy: bool = False) -> None:
    write_vcf(read_store(spark, path), out, version, legacy)
