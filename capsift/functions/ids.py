"""Identifiers: slugs, short hashes, permission and risk ids, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1


def slug(text: Column) -> Column:
    """Lower case; every run of other characters than a-z, 0-9, dot, star and hyphen is one hyphen; none at the ends."""
    runs = F.regexp_replace(F.lower(text), r"[^a-z0-9.*-]+", "-")
    return F.regexp_replace(F.regexp_replace(runs, "-+", "-"), "^-|-$", "")


def short_hash(text: Column) -> Column:
    """Six base-36 digits of a 31-based rolling hash over UTF-16 units, in 32-bit arithmetic."""

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        one = lambda a, unit: (a * 31 + unit).bitwiseAND(_MASK)
        high, low = F.floor((code - 0x10000) / 0x400) + 0xD800, (code - 0x10000).bitwiseAND(0x3FF) + 0xDC00
        return F.when(code > 0xFFFF, one(one(h, high), low)).otherwise(one(h, code))

    plain = lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(_MASK)
    units = F.filter(F.split(text, ""), lambda c: c != "")
    fold = lambda by: F.aggregate(units, F.lit(0).cast("long"), by)
    total = F.when(F.length(text) == F.octet_length(text), fold(plain)).otherwise(fold(step))
    signed = F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total)
    return F.substring(F.lpad(F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)), 6, "0"), 1, 6)


def stable_string(args: Column, metadata: Column) -> Column:
    """The text that permission ids hash: args in order, metadata by key."""
    # a value as JSON is that of an array of it, without the brackets; twice a transform, so that it is written once
    each = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.struct(e["key"].alias("key"), F.to_json(F.array(e["value"])).alias("whole")))
    items = F.transform(each, lambda e: F.concat(e["key"], F.lit(":"), F.substring(e["whole"], F.lit(2), F.length(e["whole"]) - 2)))
    return F.concat(F.lit("{args:"), F.to_json(args), F.lit(",metadata:{"), F.array_join(items, ","), F.lit("}}"))


def permission_id(tool: Column, args: Column, metadata: Column | None = None) -> Column:
    """A slug of tool and args; with more than one arg or any metadata (but `pattern`) a hash of both follows."""
    every = F.when(F.coalesce(F.size(args), F.lit(0)) > 0, args).otherwise(F.array(F.lit("*")))
    base = slug(F.concat(tool, F.lit("-"), F.array_join(every, "-")))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    kept = F.map_filter(F.coalesce(metadata, empty), lambda k, v: (k != "pattern") & v.isNotNull()) if metadata is not None else empty
    return F.when((F.size(every) > 1) | (F.size(kept) > 0), F.concat(base, F.lit("-"), short_hash(stable_string(every, kept)))).otherwise(base)


def risk_id(code: Column, number: Column) -> Column:
    return slug(F.concat(F.lit("risk-"), code, F.lit("-"), number.cast("string")))


def fingerprint(code: Column, file: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws(":", code, file, line.cast("string")), 256)
