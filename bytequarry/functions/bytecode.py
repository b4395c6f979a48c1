"""Expressions over bytecode held as hexadecimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of a compiler's metadata map, and the minimal proxy's code around its address.
METADATA_MARKERS = ("ipfs", "bzzr0", "bzzr1", "bzzr", "solc", "experimental")
PROXY_HEAD, PROXY_TAIL = "363d3d373d3d3d363d73", "5af43d82803e903d91602b57fd5bf3"
#: A code is like a proxy from this share of delegate calls on, and a stub below so many bytes.
PROXY_SHARE, STUB_BYTES = 0.02, 100


def squeeze(c: Column) -> Column:
    """Lower-cased, without white space and without a leading 0x."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")), "^0x", "")


def failure(c: Column) -> Column:
    """Why a text is no bytecode (length is tested before digits), or empty."""
    h = squeeze(c)
    return (
        F.when(h.isin("", "nan", "none", "null"), "missing_runtime_bytecode")
        .when(F.length(h) % 2 == 1, "odd_length_hex")
        .when(~h.rlike("^[0-9a-f]*$"), "invalid_hex")
        .otherwise("")
    )


def normal(c: Column) -> Column:
    """The code, or null where :func:`failure` names a reason."""
    return F.when(failure(c) == "", squeeze(c))


def _byte(h: Column, at: Column) -> Column:
    return F.conv(F.substr(h, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def metadata_bytes(h: Column) -> Column:
    """Bytes of trailing compiler metadata with its length field, or 0.

    The last two bytes give the length of a map (CBOR major type 5) that must hold one of
    the markers, at a whole byte.
    """
    size = F.floor(F.length(h) / 2).cast("int")
    n = F.coalesce(F.conv(F.right(h, F.lit(4)), 16, 10).cast("int"), F.lit(0))
    fits = (size >= 2) & (n > 0) & (n + 2 <= size)
    blob = F.when(fits, F.substr(h, (size - n - 2) * 2 + 1, n * 2))
    head = F.conv(F.substr(blob, F.lit(1), F.lit(2)), 16, 10).cast("int")
    extra = head.bitwiseAND(31)
    need = F.when(extra < 24, 1).when(extra == 24, 2).when(extra == 25, 3).when(extra == 26, 5).when(extra == 27, 9)
    marked = blob.rlike("^(?:..)*?(?:" + "|".join(m.encode().hex() for m in METADATA_MARKERS) + ")")
    is_map = (F.shiftright(head, 5) == 5) & (F.length(blob) >= need * 2)
    return F.when(F.coalesce(is_map & marked, F.lit(False)), n + 2).otherwise(0)


def strip_metadata(h: Column, zero: bool = False) -> Column:
    """The code without its metadata, or with zeros in its place."""
    n = metadata_bytes(h)
    kept = F.substr(h, F.lit(1), F.length(h) - n * 2)
    return F.concat(kept, F.repeat(F.lit("00"), n)) if zero else kept


def canonical_info(c: Column) -> Column:
    """The canonical code of a text with what was done to it: lengths in bytes, metadata cut off, and the failure if it is no code."""
    h = normal(c)
    return F.struct(
        strip_metadata(h).alias("code"), F.floor(F.length(h) / 2).cast("int").alias("raw_bytes"), metadata_bytes(h).alias("metadata_bytes"),
        F.floor(F.length(strip_metadata(h)) / 2).cast("int").alias("canonical_bytes"), failure(c).alias("failure_mode"),
    )


def fingerprint(h: Column) -> Column:
    """SHA-256 of the code's bytes; null for no code."""
    return F.when(F.coalesce(F.length(h), F.lit(0)) > 0, F.sha2(F.unhex(h), 256))


def is_minimal_proxy(h: Column) -> Column:
    return h.rlike(f"^{PROXY_HEAD}[0-9a-f]{{40}}{PROXY_TAIL}$")


def is_proxy_like(h: Column, delegate_calls: Column, opcodes: Column) -> Column:
    share = F.when(opcodes > 0, delegate_calls / opcodes).otherwise(0.0)
    return is_minimal_proxy(h) | ((delegate_calls > 0) & (share >= PROXY_SHARE))


def is_stub_like(h: Column) -> Column:
    return F.length(h) / 2 < STUB_BYTES


def runtime_source(extracted: Column, runtime: Column, initcode: Column, least_bytes: int = 1) -> tuple[Column, Column]:
    """Runtime code and where it came from: extracted from the initcode, else the compiler's, else what is there."""
    long_enough = lambda c: F.length(F.coalesce(c, F.lit(""))) >= 2 * least_bytes
    code = F.when(long_enough(extracted), extracted).when(long_enough(runtime), runtime).otherwise(F.lit(""))
    name = F.when(long_enough(extracted), "bin_extracted").when(long_enough(runtime) & long_enough(initcode), "bin_runtime_fallback").when(long_enough(runtime), "bin_runtime_direct").otherwise("")
    return code, name
