"""Deterministic ids, hashes and hash-based picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upland.functions.geo import col

# Fixed value: the namespace of the deterministic row ids.
ROW_NAMESPACE = "229b2fcb-b1a1-47f4-9d7c-777db19230c7"


def uuid_v5(name, namespace: str = ROW_NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a string column."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(col(name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def row_id(table: str, natural_key) -> Column:
    return uuid_v5(F.concat(F.lit(table + ":"), col(natural_key).cast("string")))


def hash8(text) -> Column:
    """First 8 hex digits of SHA-256 as an integer."""
    return F.conv(F.substring(F.sha2(col(text).cast("string"), 256), 1, 8), 16, 10).cast("long")


def unit_hash(*parts) -> Column:
    """A repeatable uniform number in [0, 1) from the given parts: the engine's only source of randomness."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return hash8(text).cast("double") / F.lit(float(2**32))


def crc_of(text) -> Column:
    return F.crc32(F.encode(col(text).cast("string"), "UTF-8"))


def weighted_pick(weights: list[tuple[str, int]], number) -> Column:
    """The item whose cumulative weight first passes `number` mod the total weight."""
    total = sum(w for _, w in weights)
    r = F.pmod(col(number), F.lit(total))
    out, upto = None, 0
    for item, w in weights:
        upto += w
        cond = r < upto
        out = F.when(cond, F.lit(item)) if out is None else out.when(cond, F.lit(item))
    return out


def pick_by_share(weights: list[tuple[str, int]], u) -> Column:
    """The item at position u in [0, 1) of the cumulative weights."""
    total = float(sum(w for _, w in weights))
    out, upto = None, 0
    for item, w in weights:
        upto += w
        cond = col(u) * F.lit(total) < F.lit(float(upto))
        out = F.when(cond, F.lit(item)) if out is None else out.when(cond, F.lit(item))
    return out.otherwise(F.lit(weights[-1][0]))
