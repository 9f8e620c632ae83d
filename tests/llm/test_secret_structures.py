"""Structural confirmation: keys and tokens are reported, look-alikes aren't."""

import base64
import json
import os

from corvane.llm import secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | ((len(body).bit_length() + 7) // 8)]) + len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def integer(n):
    return der(2, os.urandom(n - 1) + b"\x01" if n > 1 else b"\x00")


RSA = der(0x30, der(2, b"\x00"), *[integer(64) for _ in range(8)])
PKCS8 = der(0x30, der(2, b"\x00"), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, os.urandom(32))))
EC = der(0x30, der(2, b"\x01"), der(4, os.urandom(32)))
SSH = secrets.SSH_MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + (51).to_bytes(4, "big") + os.urandom(51)
B64 = lambda x: base64.b64encode(x).decode()
URL = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")


def kinds(text):
    return [k for _, _, k in secrets.confirmed_spans(text)]


def test_keys_are_confirmed():
    for key in (RSA, PKCS8, EC):
        assert kinds(f"a key {B64(key)} here") == ["der_key"]
        assert kinds(f"a key {key.hex()} here") == ["der_key"]
    folded = "\n".join(B64(RSA)[i : i + 64] for i in range(0, len(B64(RSA)), 64))
    text = f"-----BEGIN RSA PRIVATE KEY-----\n{folded}\n-----END RSA PRIVATE KEY-----"
    (start, end, kind) = secrets.confirmed_spans(text)[0]
    assert kind == "der_key" and text[start:end] == folded
    assert kinds(B64(SSH)) == ["ssh_key"]


def test_tokens_are_confirmed():
    token = ".".join((URL(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), URL(json.dumps({"sub": "1"}).encode()), URL(os.urandom(32))))
    assert secrets.confirmed_spans(f"see {token} there") == [(4, 4 + len(token), "jwt")]


def test_look_alikes_are_not():
    wrong = bytearray(RSA)
    wrong[3] ^= 1  # a length that doesn't fill
    for x in (B64(bytes(wrong)), B64(b"M" * 60), "MII" + "A" * 60, "eyJhbGciOiJIUzI1NiJ.eyJ4.abc", URL(b'{"typ":"x"}') + "." + URL(b"{}") + ".aaaa", "30" + "ab" * 30):
        assert kinds(f"text {x} text") == []


def test_base_patterns_are_leftmost_and_do_not_overlap():
    assert secrets.base_spans("token:token :abcdef") == []
    assert secrets.base_spans("ToKeN='abcdef'") == [(0, 13, "assign")]
    assert secrets.base_spans("ſecret=abcdefgh") == []
    assert secrets.base_spans("API-KEY=abcdefg api_key=abcdefg") == [(16, 31, "assign")]
    assert [k for *_, k in secrets.base_spans("secret=" + "a" * 24)] == ["assign", "hex"]
