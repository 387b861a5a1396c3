"""Hashes, perceptual-hash bits and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import strip

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif")


def cache_key(provider: Column, query: Column) -> Column:
    return F.sha2(F.concat(provider, F.lit(":"), F.lower(strip(F.coalesce(query, F.lit(""))))), 256)


def sha256(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def phash_bits(h: Column) -> Column:
    """16 hex digits as a long; null for anything else."""
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.conv(h, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two perceptual hashes; 64 if one can't be read."""
    return F.coalesce(F.bit_count(phash_bits(a).bitwiseXOR(phash_bits(b))), F.lit(64))


def similarity(distance: Column) -> Column:
    return F.floor((1 - distance / 64) * 1000 + 0.5) / 10.0


def sanitize_filename(name: Column) -> Column:
    """Word characters, dots and dashes; 64 characters at most, an image's extension kept."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_.\-]", "_")
    ext = F.regexp_extract(F.lower(clean), rf"(\.(?:{'|'.join(IMAGE_EXTENSIONS)}))$", 1)
    stem = F.least(F.length(clean) - F.length(ext), 64 - F.length(ext)).cast("int")
    return F.concat(F.substring(clean, F.lit(1), stem), ext)
