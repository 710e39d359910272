"""The standard lock of files: whether the empty password opens one, and its key.

Revisions 2 to 4 derive the key with MD5 and test it with RC4; 5 and 6 test it with SHA-2 (6 with rounds of
AES).  Everything works on one file's few bytes of key material; streams are decrypted with their object's own key.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np

# Fixed value: what fills up a password to 32 bytes.
FILL = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = byte ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> np.ndarray:
    """The substitution of AES: inverses in its field of 256, then an affine map of their bits."""
    out = []
    for x in range(256):
        y = next((k for k in range(256) if _times(x, k) == 1), 0)
        z = 0x63
        for turn in range(5):
            z ^= (y << turn | y >> (8 - turn)) & 255
        out.append(z)
    return np.array(out, np.uint8)


BOX = _substitution()
UNBOX = np.argsort(BOX).astype(np.uint8)
_PRODUCT = {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}
_ROWS = np.array([0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11])
_UNROWS = np.argsort(_ROWS)


def round_keys(key: bytes) -> np.ndarray:
    n, words, turn = len(key) // 4, [list(key[k : k + 4]) for k in range(0, len(key), 4)], 1
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = [int(BOX[x]) for x in (*w[1:], w[0])]
            w[0] ^= turn
            turn = _times(turn, 2)
        elif n > 6 and k % n == 4:
            w = [int(BOX[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[k - n], w)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mixed(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    c = s.reshape(-1, 4, 4)
    part = lambda f, x: x if f == 1 else _PRODUCT[f][x]
    rows = [part(factors[0], c[:, :, r]) ^ part(factors[1], c[:, :, (r + 1) % 4]) ^ part(factors[2], c[:, :, (r + 2) % 4]) ^ part(factors[3], c[:, :, (r + 3) % 4]) for r in range(4)]
    return np.stack(rows, 2).reshape(-1, 16)


def aes_encrypted(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    s = block ^ keys[0]
    for k in range(1, len(keys)):
        s = BOX[s][:, _ROWS]
        s = (_mixed(s, (2, 3, 1, 1)) if k + 1 < len(keys) else s) ^ keys[k]
    return s


def aes_decrypted(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    s = block ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        s = UNBOX[s[:, _UNROWS]] ^ keys[k]
        s = _mixed(s, (14, 11, 13, 9)) if k else s
    return s


def cbc_encrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    keys, last, out = round_keys(key), np.frombuffer(start, np.uint8)[None], []
    for block in np.frombuffer(data, np.uint8).reshape(-1, 1, 16):
        last = aes_encrypted(keys, block ^ last)
        out.append(last)
    return b"".join(x.tobytes() for x in out)


def cbc_decrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(start, np.uint8)[None], blocks[:-1]]) if len(blocks) else blocks
    return (aes_decrypted(round_keys(key), blocks) ^ before).tobytes() if len(blocks) else b""


def hardened(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """Revision 6's digest: rounds of AES and a SHA-2 that the round before chooses."""
    key, turn, last = hashlib.sha256(password + salt + more).digest(), 0, 0
    while turn < 64 or last > turn - 32:
        data = cbc_encrypted(key[:16], key[16:32], (password + key + more) * 64)
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(data[:16]) % 3](data).digest()
        last, turn = data[-1], turn + 1
    return key[:32]


def string_bytes(token: bytes | None) -> bytes | None:
    """The bytes of a literal or hexadecimal string."""
    if token is None:
        return None
    if token.startswith(b"<") and token.endswith(b">"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii", "ignore")) if re.fullmatch(rb"[0-9A-Fa-f]*", digits) else None
    if not (token.startswith(b"(") and token.endswith(b")")):
        return None
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() and x[:1] < b"8" else b"" if x in (b"\n", b"\r", b"\r\n") else plain.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


class Lock:
    """An opened file's key, and how its streams are encrypted: RC4, AESV2, AESV3 or None (not at all)."""

    def __init__(self, key: bytes, method: str | None):
        self.key, self.method = key, method

    def opened(self, data: bytes, obj: int, gen: int) -> bytes:
        if self.method is None:
            return data
        key = self.key
        if self.method != "AESV3":
            key = hashlib.md5(key + struct.pack("<I", obj)[:3] + struct.pack("<I", gen)[:2] + (b"sAlT" if self.method == "AESV2" else b"")).digest()[: min(16, len(key) + 5)]
        if self.method == "RC4":
            return rc4(key, data)
        plain = cbc_decrypted(key, data[:16], data[16:]) if len(data) >= 32 else b""
        return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain


def _number(fields: dict[str, bytes], name: str, default: int) -> int:
    value = fields.get(name, b"")
    return int(value) if re.fullmatch(rb"-?\d{1,11}", value) else default


def _method(fields: dict[str, bytes], version: int) -> str | None:
    if version < 4:
        return "RC4"
    name = fields.get("StmF", b"/Identity")
    if name == b"/Identity":
        return None
    filters = fields.get("CF", b"")
    m = re.search(re.escape(name) + rb"\s*<<(.*?)>>", filters, re.S)
    kind = re.search(rb"/CFM\s*/(\w+)", m[1]) if m else None
    return {b"V2": "RC4", b"AESV2": "AESV2", b"AESV3": "AESV3"}.get(kind[1] if kind else b"None")


def lock_of(fields: dict[str, bytes] | None, ident: bytes | None) -> Lock | None:
    """The lock of an encryption dictionary that the empty password opens; None if it does not, or the handler is another."""
    if not fields or fields.get("Filter") != b"/Standard":
        return None
    owner, user = string_bytes(fields.get("O")), string_bytes(fields.get("U"))
    version, revision = _number(fields, "V", 0), _number(fields, "R", 0)
    if owner is None or user is None or not 2 <= revision <= 6:
        return None
    if revision >= 5:
        wrapped = string_bytes(fields.get("UE"))
        if len(user) < 48 or wrapped is None or len(wrapped) < 32:
            return None
        digest = hardened if revision == 6 else lambda p, salt: hashlib.sha256(p + salt).digest()
        if digest(b"", user[32:40]) != user[:32]:
            return None
        return Lock(cbc_decrypted(digest(b"", user[40:48]), bytes(16), wrapped[:32]), _method(fields, version))
    m = re.match(rb"\s*\[\s*(<[^>]*>|\((?:[^()\\]|\\.)*\))", ident or b"", re.S)
    first = string_bytes(m[1]) if m else b""
    size = 5 if revision == 2 else min(16, max(5, _number(fields, "Length", 40 if version < 4 else 128) // 8))
    known = FILL + owner[:32] + struct.pack("<i", _number(fields, "P", 0) if abs(_number(fields, "P", 0)) < 1 << 31 else _number(fields, "P", 0) - (1 << 32)) + (first or b"")
    if revision >= 4 and fields.get("EncryptMetadata") == b"false":
        known += b"\xff" * 4
    key = hashlib.md5(known).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    key = key[:size]
    if revision == 2:
        good = rc4(key, FILL) == user[:32]
    else:
        test = hashlib.md5(FILL + (first or b"")).digest()
        for turn in range(20):
            test = rc4(bytes(k ^ turn for k in key), test)
        good = test == user[:16]
    return Lock(key, _method(fields, version)) if good else None
