"""RSA-PSS check (SHA-256, MGF1, longest salt) of a content hash.

Only standard-library modules are used, and everything sent to the workers is
one self-contained closure. Call it on rows that passed every cheaper test."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import strip


def content_hash(content: Column) -> Column:
    """SHA-256 hex of the stripped UTF-8 content."""
    return F.sha2(strip(content), 256)


def _signature_udf():
    def make_checker():
        """Build ``check(public_key_pem, digest_hex, signature_b64) -> bool``."""
        import base64
        import hashlib

        def sha(data: bytes) -> bytes:
            return hashlib.sha256(data).digest()

        def read(der: bytes, at: int) -> tuple[bytes, int]:
            """One DER element: its content and the offset after it."""
            size, at = der[at + 1], at + 2
            if size & 0x80:
                n = size & 0x7F
                size, at = int.from_bytes(der[at:at + n], "big"), at + n
            if at + size > len(der):
                raise ValueError("truncated key")
            return der[at:at + size], at + size

        def public_numbers(pem: str) -> tuple[int, int]:
            body = "".join(line for line in pem.strip().splitlines() if not line.startswith("-----"))
            info, _ = read(base64.b64decode(body, validate=True), 0)
            _, after_algorithm = read(info, 0)
            bits, _ = read(info, after_algorithm)
            pair, _ = read(bits[1:], 0)
            modulus, at = read(pair, 0)
            exponent, _ = read(pair, at)
            return int.from_bytes(modulus, "big"), int.from_bytes(exponent, "big")

        def mask(seed: bytes, length: int) -> bytes:
            blocks = (sha(seed + i.to_bytes(4, "big")) for i in range(-(-length // 32)))
            return b"".join(blocks)[:length]

        keys: dict[str, tuple[int, int] | None] = {}

        def key_of(pem: str) -> tuple[int, int] | None:
            if pem not in keys:
                try:
                    keys[pem] = public_numbers(pem)
                except (ValueError, IndexError):
                    keys[pem] = None
            return keys[pem]

        def check(pem: str, digest_hex: str, signature_b64: str) -> bool:
            key = key_of(pem)
            try:
                signature = base64.b64decode(signature_b64)
            except (ValueError, TypeError):
                return False
            if key is None or len(signature) != (key[0].bit_length() + 7) // 8:
                return False
            n, e = key
            em_bits = n.bit_length() - 1
            em_len = (em_bits + 7) // 8
            value = pow(int.from_bytes(signature, "big"), e, n)
            if value.bit_length() > em_bits or int.from_bytes(signature, "big") >= n:
                return False
            em = value.to_bytes(em_len, "big")
            masked, h, tail = em[:em_len - 33], em[em_len - 33:-1], em[-1]
            if tail != 0xBC:
                return False
            db = bytearray(a ^ b for a, b in zip(masked, mask(h, len(masked))))
            db[0] &= 0xFF >> (8 * em_len - em_bits)
            # The longest salt leaves no padding in front of the separator.
            if db[0] != 0x01:
                return False
            return sha(b"\0" * 8 + sha(digest_hex.encode()) + bytes(db[1:])) == h

        return check

    def per_batch(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        check = make_checker()
        for pems, digests, signatures in batches:
            yield pd.Series([
                bool(p is not None and d is not None and s is not None and check(p, d, s))
                for p, d, s in zip(pems, digests, signatures)], dtype=bool)

    # Nondeterministic in name only: the optimizer must not run the check twice.
    return F.pandas_udf(per_batch, T.BooleanType())


def signature_valid(public_key_pem: Column, digest_hex: Column, signature_b64: Column) -> Column:
    """Rows with a NULL argument give false at no cost."""
    return _signature_udf()(public_key_pem, digest_hex, signature_b64)
