"""Digests, fingerprints and perceptual hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def content_digest(content: Column, size: Column, algo: str = "sha256") -> Column:
    """Key of a file's bytes. crc32: ``crc32:<size>:<8 hex digits>``; sha256: 64 hex digits. Null content has no key."""
    data = content.cast("binary")
    if algo == "crc32":
        return F.when(size == 0, "crc32:0:00000000").when(data.isNotNull(), F.format_string("crc32:%d:%08x", size, F.crc32(data)))
    return F.sha2(data, 256)


def member_digest(size: Column, zip_crc: Column) -> Column:
    """Key of an archive member from the archive's directory, without its bytes."""
    return F.when(zip_crc.isNotNull(), F.format_string("crc32:%d:%08x", size, zip_crc))


def text_fingerprint(text: Column, least: int = 20) -> Column:
    """Digest of the lower-cased text with single spaces; null under ``least`` characters."""
    t = F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.length(t) >= least, F.sha2(t, 256))


def token_set(text: Column, most: int | None = None) -> Column:
    """Distinct runs of four or more of a-z and 0-9; with ``most``, among that many first ones."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{4,})"), F.lit(1))
    return F.array_distinct(found if most is None else F.slice(found, 1, most))


def average_hash(grid: Column) -> Column:
    """16 hex digits: bit i is set where pixel i of 64 is at least the mean; pixel 0 is the lowest bit."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(grid)
    bits = F.reverse(F.array_join(F.transform(grid, lambda x: F.when(x.cast("double") >= mean, "1").otherwise("0")), ""))
    return hash_of_bits(bits)


def hash_of_bits(bits: Column) -> Column:
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two hex hashes; 999 where one is null, no hex or of another length."""
    hexes = F.lower(a).rlike("^[0-9a-f]{1,16}$") & F.lower(b).rlike("^[0-9a-f]{1,16}$") & (F.length(a) == F.length(b))
    number = lambda x: F.conv(x, 16, -10).cast("long")
    return F.when(F.coalesce(hexes, F.lit(False)), F.bit_count(number(a).bitwiseXOR(number(b)))).otherwise(999)
