"""The binary catalog format, version 1: reading with all of its checks, and writing."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np

MAGIC, VERSION = b"SLH", 1
HASH_COUNT, BITS_PER_KEY = 7, 10
_RECORD = struct.Struct("<32sHH")


class CatalogError(ValueError):
    pass


Record = tuple[bytes, int, int]


@dataclass
class Contents:
    min_statements: int
    libs: list[tuple[str, list[str]]]
    file_hashes: list[Record] = field(default_factory=list)
    func_hashes: list[Record] = field(default_factory=list)
    bloom: bytes = b""
    bloom_hashes: int = 0


def bloom_build(digests: Sequence[bytes]) -> tuple[bytes, int]:
    """Ten bits a digest, seven probes by double hashing modulo 2^64; nothing for no digests."""
    if not digests:
        return b"", 0
    size = max(1, -(-BITS_PER_KEY * len(digests) // 8))
    heads = np.frombuffer(b"".join(d[:16] for d in digests), dtype="<u8").reshape(-1, 2)
    bits = np.zeros(size * 8, dtype=bool)
    with np.errstate(over="ignore"):
        for i in range(HASH_COUNT):
            bits[(heads[:, 0] + np.uint64(i) * heads[:, 1]) % np.uint64(size * 8)] = True
    return np.packbits(bits, bitorder="little").tobytes(), HASH_COUNT


def bloom_may_contain(bloom: bytes, hashes: int, digest: bytes) -> bool:
    if not bloom or not hashes:
        return True
    one, two = struct.unpack_from("<QQ", digest)
    places = (((one + i * two) % 2**64) % (len(bloom) * 8) for i in range(hashes))
    return all(bloom[p >> 3] >> (p & 7) & 1 for p in places)


def _check_refs(libs: Sequence[tuple[str, Sequence[str]]], label: str, records: Iterable[Record]) -> None:
    for i, (_, lib, version) in enumerate(records):
        if lib >= len(libs):
            raise CatalogError(f"{label} record {i} refers to library {lib}, which does not exist")
        if version >= len(libs[lib][1]):
            raise CatalogError(f"{label} record {i} refers to version {version} of library {lib}, which does not exist")


def decode(data: bytes) -> Contents:
    """Parse and validate. Stray bytes after the tables or the bloom filter are accepted, and so is a missing filter."""
    if len(data) < 17:
        raise CatalogError("the file is shorter than its header")
    if data[:3] != MAGIC:
        raise CatalogError(f"not a catalog file, as it begins with {data[:3]!r}")
    if data[3] != VERSION:
        raise CatalogError(f"version {data[3]} of the format can't be read")
    n_libs, n_files, n_funcs = struct.unpack_from("<III", data, 5)
    out, at = Contents(data[4], []), 17

    def take(n: int, what: str) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise CatalogError(f"the file ends within its {what}")
        at += n
        return data[at - n : at]

    def text(raw: bytes, what: str) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise CatalogError(f"a {what} is not UTF-8: {e}") from None

    for _ in range(n_libs):
        size = take(3, "lib table")[2]
        name = text(take(size, "lib name"), "lib name")
        (versions,) = struct.unpack("<H", take(2, "version count"))
        out.libs.append((name, [text(take(take(1, "version entry")[0], "version string"), "version") for _ in range(versions)]))
    out.file_hashes = list(_RECORD.iter_unpack(take(36 * n_files, "file hash table")))
    out.func_hashes = list(_RECORD.iter_unpack(take(36 * n_funcs, "function hash table")))
    for what, table in (("file", out.file_hashes), ("function", out.func_hashes)):
        if any(a[0] > b[0] for a, b in zip(table, table[1:], strict=False)):
            raise CatalogError(f"{what} records are out of order")
    _check_refs(out.libs, "file", out.file_hashes)
    _check_refs(out.libs, "function", out.func_hashes)
    if len(data) - at >= 5:
        size, out.bloom_hashes = struct.unpack("<IB", take(5, "bloom filter header"))
        out.bloom = take(size, "bloom filter data") if size else b""
    return out


def encode(min_statements: int, libs: Sequence[tuple[str, Sequence[str]]], file_hashes: Sequence[Record], func_hashes: Sequence[Record]) -> bytes:
    """Validate, sort by digest (equal digests keep their order) and serialise."""
    if not 0 <= min_statements <= 255:
        raise CatalogError("min_statements must fit a byte")
    if len(libs) > 65536:
        raise CatalogError(f"too many libraries: {len(libs)} (at most 65536)")
    parts = []
    for i, (name, versions) in enumerate(libs):
        raw = name.encode()
        if len(raw) > 255:
            raise CatalogError(f"name of library {i} is too long: {len(raw)} bytes (at most 255)")
        if len(versions) > 65535:
            raise CatalogError(f"library {i} has too many versions: {len(versions)} (at most 65535)")
        parts.append(struct.pack("<HB", i, len(raw)) + raw + struct.pack("<H", len(versions)))
        for v in versions:
            if len(v.encode()) > 255:
                raise CatalogError(f"a version of library {i} is too long: {len(v.encode())} bytes (at most 255)")
            parts.append(bytes([len(v.encode())]) + v.encode())
    _check_refs(libs, "file", file_hashes)
    _check_refs(libs, "function", func_hashes)
    files, funcs = (sorted(t, key=lambda r: r[0]) for t in (file_hashes, func_hashes))
    bloom, hashes = bloom_build([r[0] for r in funcs])
    head = MAGIC + struct.pack("<BBIII", VERSION, min_statements, len(libs), len(files), len(funcs))
    return head + b"".join(parts) + b"".join(_RECORD.pack(*r) for r in (*files, *funcs)) + struct.pack("<IB", len(bloom), hashes) + bloom
