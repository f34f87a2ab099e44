"""Scalar functions on paths, labels and digests (O-02, O-19, O-21..O-23, O-25, O-27..O-31, O-37, O-38, O-93, O-94, O-103, O-137, O-138, O-141)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of image files.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
#: Frame ranges of the splits, both ends included; what lies between is a guard band.
RANGES = (("train", 1, 2000), ("val", 2101, 2500), ("test", 2601, 3000))

#: The sign modes.
MODES = ("bisindo", "asl")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """O-02: lower-case suffix with its dot, or ``[none]``."""
    found = F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1))
    return F.when(found == "", "[none]").otherwise(found)


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_SUFFIXES)


def label_for(path: Column, strategy: Column) -> Column:
    """O-19: the label by strategy; an unknown strategy is an error."""
    return (
        F.when(strategy == "parent", F.element_at(F.split(path, "/"), -2))
        .when(strategy == "dot_prefix", F.split_part(basename(path), F.lit("."), F.lit(1)))
        .when(strategy == "underscore_test", F.regexp_replace(stem(path), "_test$", ""))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label strategy: "), F.coalesce(strategy, F.lit("null")))))
    )


def digest(*parts: Column | str) -> Column:
    """O-22: SHA-256 of the parts joined by colons; a null part makes it null."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined: list[Column] = [columns[0]]
    for c in columns[1:]:
        joined += [F.lit(":"), c]
    return F.sha2(F.concat(*joined).cast("binary"), 256)


def sample_id(source: Column, path: Column) -> Column:
    """O-21: the first 20 hex digits of the digest."""
    return F.substring(digest(source, path), 1, 20)


def chunk_key(generation: str, index: Column, members: Column) -> Column:
    """O-103: key of a chunk from its ordered members."""
    return F.sha2(F.concat(F.lit(generation), index.cast("string"), F.array_join(members, "")).cast("binary"), 256)


def remap_unknown(label: Column, known: Sequence[str]) -> Column:
    """O-23: labels that are not among the known ones become UNKNOWN."""
    return F.when(label.isin(*known), label).otherwise("UNKNOWN")


def single_upper(label: Column) -> Column:
    """O-25: one-letter labels in upper case, others as they are."""
    return F.when(F.length(label) == 1, F.upper(label)).otherwise(label)


def augmented_base(name: Column) -> Column:
    """O-27: a stem without its export tag and copy mark, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?i)_jpg\.rf\.[0-9a-f]+$", ""), "_2$", ""))


def variant_base(name: Column) -> Column:
    """O-27: a stem without its variant mark, in lower case."""
    return F.lower(F.regexp_replace(name, r"(?i)_(?:2|3|AR)$", ""))


def trailing_number(name: Column) -> Column:
    """O-28: the digits at the end; none is an error."""
    found = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(found != "", found.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no trailing number: "), name)).cast("int"))


def range_split(n: Column, ranges: Sequence[tuple[str, int, int]] = RANGES) -> Column:
    """O-29: the split whose range holds n, null in a guard band."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(ranges):
        out = F.when(n.between(low, high), name).otherwise(out)
    return out


def block_id(prefix: str, n: Column, size: int = 50) -> Column:
    """O-30: the id of the block of ``size`` numbers that holds n."""
    return F.format_string(prefix + ":%03d", F.floor((n - 1) / size))


def lookup(key: Column, table: Mapping[str, int], default: int) -> Column:
    """O-31: a small map with a default."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def slot_score(hands: Column, first: Column, second: Column) -> Column:
    """O-37: least score over the expected slots; none expected gives 0."""
    return F.when(hands == 2, F.least(first, second)).when(hands == 1, first).otherwise(F.lit(0.0))


def profile_tag(value: Column) -> Column:
    """O-38: hundredths as three digits."""
    return F.format_string("%03d", F.bround(value * 100).cast("int"))


def is_mode(value: Column, modes: Sequence[str] = MODES) -> Column:
    """O-93: whether a value names a mode; null does not."""
    return F.coalesce(value.isin(*modes), F.lit(False))


def canonical_json(**fields: Column) -> Column:
    """O-101 of rows: JSON with sorted keys and no spaces; null fields are null, letters beyond ASCII are escaped as UTF-16 units."""
    whole = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    units = lambda c: F.concat(*(F.concat(F.lit("\\u"), F.substring(F.lower(F.hex(F.encode(c, "UTF-16BE"))), 4 * k + 1, 4)) for k in range(2)))
    short = lambda c: F.concat(F.lit("\\u"), F.lower(F.hex(F.encode(c, "UTF-16BE"))))
    escaped = F.transform(F.split(whole, ""), lambda c: F.when(~c.rlike(r"[^\x00-\x7f]"), c).when(F.octet_length(c) > 3, units(c)).otherwise(short(c)))
    return F.when(whole.rlike(r"[^\x00-\x7f]"), F.array_join(escaped, "")).otherwise(whole)


def rotating(index: Column, items: Sequence[str]) -> Column:
    """O-94: the item at index modulo their number."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(index, F.lit(len(items))) + 1).cast("int"))


def seeded_pick(seed: str, n: Column, items: Sequence[str]) -> Column:
    """O-141: a pseudo-random item that depends on the seed and n alone."""
    return rotating(F.pmod(F.conv(F.substring(digest(seed, n), 1, 15), 16, 10).cast("long"), F.lit(len(items))), items)


def message_for(code: Column, messages: Mapping[str, str], default: str) -> Column:
    """O-137: error code to message, with a default."""
    out = F.lit(default)
    for k, v in messages.items():
        out = F.when(code == k, v).otherwise(out)
    return out
