"""Column expressions that parse names, versions, labels and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of the partitions and of anything else.
COLOURS = {"P": "#e59c04", "S": "#00d860", "C": "#79deff", "other": "#d62728"}
#: File endings of sequence records.
FASTX = ("fa", "fasta", "fna", "fq", "fastq")


def species_of(name: Column) -> Column:
    return F.substring_index(name, "@", 1)


def signature_name(species: Column, path: Column, from_folder: bool = False) -> Column:
    """species@stem of the file, or species@folder."""
    part = r"([^/]+)/[^/]*$" if from_folder else r"([^/]+?)(?:\.[^./]*)?$"
    return F.concat(species, F.lit("@"), F.regexp_extract(path, part, 1))


def checked_spec(spec: Column) -> Column:
    """A spec name[@version][:member], trimmed; a part too many or an empty part is an error."""
    bad = F.raise_error(F.concat(F.lit("not a collection spec: "), F.coalesce(spec, F.lit("null"))))
    return F.when(F.trim(spec).rlike(r"^[^@:]+(?:@[^@:]+)?(?::[^@:]+)?$"), F.trim(spec)).otherwise(bad)


def collection_name(spec: Column) -> Column:
    return F.regexp_extract(spec, r"^([^@:]+)", 1)


def collection_version(spec: Column) -> Column:
    found = F.regexp_extract(spec, r"^[^@:]+@([^:]+)", 1)
    return F.when(found == "", F.lit("latest")).otherwise(found)


def collection_member(spec: Column) -> Column:
    found = F.regexp_extract(spec, r"^[^:]+:(.+)$", 1)
    return F.when(found == "", F.lit(None).cast("string")).otherwise(found)


def version_key(version: Column) -> Column:
    """A version as an array of numbers, which sorts as versions do."""
    return F.transform(F.split(F.regexp_replace(version, "^v+", ""), r"\."), lambda x: x.cast("int"))


def label_family(label: Column) -> Column:
    return F.regexp_extract(label, r"^<(.*)>:\d+$", 1)


def label_hits(label: Column) -> Column:
    return F.regexp_extract(label, r"^<.*>:(\d+)$", 1).cast("bigint")


def is_fastx(path: Column) -> Column:
    """Whether the last ending, .gz aside, is one of sequence records."""
    return F.regexp_extract(F.regexp_replace(F.lower(path), r"\.gz$", ""), r"\.([^./]+)$", 1).isin(*FASTX)


def partition_colour(partition: Column) -> Column:
    word = F.lower(partition)
    out = F.when((partition == "P") | (word == "persistent"), COLOURS["P"])
    out = out.when((partition == "S") | (word == "shell"), COLOURS["S"])
    return out.when((partition == "C") | (word == "cloud"), COLOURS["C"]).otherwise(COLOURS["other"])


def value_kind(text: Column) -> Column:
    """int, float or str: the first that a text converts to."""
    return F.when(text.try_cast("bigint").isNotNull() & text.rlike(r"^\s*[+-]?\d+\s*$"), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("str")


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that keeps the number at 1 or more, with one decimal."""
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def include_list(text: Column) -> Column:
    """The entries of a comma-separated list, trimmed, without empty ones; null for * or null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.isNull() | (F.trim(text) == "*"), F.lit(None).cast("array<string>")).otherwise(parts)
