"""Test keys and PSS signatures with the standard library only."""

import base64
import hashlib
import random


def _prime(bits, rng):
    while True:
        n = rng.getrandbits(bits) | (3 << (bits - 2)) | 1
        if any(n % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23)):
            continue
        if all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11)):
            return n


def _der(tag, content):
    size = len(content)
    head = bytes([size]) if size < 128 else bytes([0x80 | len(size.to_bytes((size.bit_length() + 7) // 8, "big"))]) + \
        size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + content


def _int(n):
    return _der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


class Key:
    def __init__(self, seed, bits=2048):
        rng = random.Random(seed)
        e = 65537
        while True:
            p, q = _prime(bits // 2, rng), _prime(bits // 2, rng)
            if p != q and (p - 1) % e and (q - 1) % e and (p * q).bit_length() == bits:
                break
        self.n, self.e, self.d = p * q, e, pow(e, -1, (p - 1) * (q - 1))
        pair = _der(0x30, _int(self.n) + _int(e))
        algorithm = _der(0x30, bytes.fromhex("06092a864886f70d010101") + b"\x05\x00")
        info = _der(0x30, algorithm + _der(3, b"\0" + pair))
        body = base64.encodebytes(info).decode()
        self.pem = f"-----BEGIN PUBLIC KEY-----\n{body}-----END PUBLIC KEY-----\n"

    def sign(self, content, salt_len=None):
        digest = hashlib.sha256(content.strip().encode()).hexdigest().encode()
        em_bits = self.n.bit_length() - 1
        em_len = (em_bits + 7) // 8
        salt = bytes(em_len - 34) if salt_len is None else bytes(salt_len)
        h = hashlib.sha256(bytes(8) + hashlib.sha256(digest).digest() + salt).digest()
        db = bytes(em_len - len(salt) - 34) + b"\x01" + salt
        mask = b"".join(hashlib.sha256(h + i.to_bytes(4, "big")).digest() for i in range(-(-len(db) // 32)))
        masked = bytearray(a ^ b for a, b in zip(db, mask))
        masked[0] &= 0xFF >> (8 * em_len - em_bits)
        em = bytes(masked) + h + b"\xbc"
        signature = pow(int.from_bytes(em, "big"), self.d, self.n)
        return base64.b64encode(signature.to_bytes((self.n.bit_length() + 7) // 8, "big")).decode()
