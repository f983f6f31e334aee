"""Ed25519 signature checks after RFC 8032, on the driver, for control documents."""

from __future__ import annotations

import hashlib

# The curve's field, order, constant and base point's height.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
BASE_Y = 4 * pow(5, -1, P) % P

Point = tuple[int, int, int, int]  # extended coordinates X, Y, Z, T


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x % 2 != odd else x


def _add(a: Point, b: Point) -> Point:
    u, v = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    t, z = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = v - u, z - t, z + t, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a = _add(a, a)
        n >>= 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _point(raw: bytes) -> Point | None:
    y = int.from_bytes(raw, "little")
    x = _x_of(y & (1 << 255) - 1, y >> 255)
    return None if x is None else (x, y & (1 << 255) - 1, 1, x * (y & (1 << 255) - 1) % P)


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature is the key's of the message; keys and commitments outside the prime-order group fail."""
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    nil: Point = (0, 1, 1, 0)
    if a is None or r is None or s >= ORDER or _same(a, nil) or not _same(_times(ORDER, a), nil) or not _same(_times(ORDER, r), nil):
        return False
    base_x = _x_of(BASE_Y, 0)
    base: Point = (base_x, BASE_Y, 1, base_x * BASE_Y % P)
    h = int.from_bytes(hashlib.sha512(signature[:32] + key + message).digest(), "little") % ORDER
    return _same(_times(s, base), _add(r, _times(h, a)))


def _bytes(a: Point) -> bytes:
    z = pow(a[2], -1, P)
    x, y = a[0] * z % P, a[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _expanded(private: bytes) -> tuple[int, bytes, Point]:
    """(secret scalar, prefix of nonces, base point) of a private key of 32 bytes."""
    if len(private) != 32:
        raise ValueError("a private key has 32 bytes")
    h = hashlib.sha512(private).digest()
    scalar = int.from_bytes(h[:32], "little") & ~7 & (1 << 254) - 1 | 1 << 254
    x = _x_of(BASE_Y, 0)
    return scalar, h[32:], (x, BASE_Y, 1, x * BASE_Y % P)


def public_key(private: bytes) -> bytes:
    scalar, _, base = _expanded(private)
    return _bytes(_times(scalar, base))


def sign(private: bytes, message: bytes) -> bytes:
    """A signature after RFC 8032. The arithmetic takes time that depends on the key: sign where no one measures it."""
    scalar, prefix, base = _expanded(private)
    key = _bytes(_times(scalar, base))
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % ORDER
    head = _bytes(_times(r, base))
    h = int.from_bytes(hashlib.sha512(head + key + message).digest(), "little") % ORDER
    return head + ((r + h * scalar) % ORDER).to_bytes(32, "little")
