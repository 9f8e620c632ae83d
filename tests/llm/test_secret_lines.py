"""Keys before other lines, in base64url, indented and escaped."""

import base64
import os
import struct
import time

import pytest
from test_secret_structures import B64, EC, PKCS8, RSA, SSH, der, integer

from corvane.llm import secrets


def blob(*parts):
    return b"".join(struct.pack(">I", len(x)) + x for x in parts)


ED = blob(b"ssh-ed25519", os.urandom(32))
SSH_RSA = blob(b"ssh-rsa", b"\x01\x00\x01", b"\x00" + os.urandom(256))
PRIVATE = secrets.SSH_MAGIC + blob(b"none", b"none", b"") + (1).to_bytes(4, "big") + blob(ED, os.urandom(136))


def found(text):
    return [(text[a:b], k) for a, b, k in secrets.confirmed_spans(text)]


@pytest.mark.parametrize("after", ["word", "ssh-rsa AAAA", "Mine is this one", "0123456789" * 9])
@pytest.mark.parametrize("key, kind", [(RSA, "der_key"), (PKCS8, "der_key"), (EC, "der_key"), (ED, "ssh_key"), (SSH_RSA, "ssh_key"), (PRIVATE, "ssh_key")])
def test_a_line_after_the_key(key, kind, after):
    for x in {B64(key), B64(key).rstrip("=")}:
        assert found(f"a {x}\n{after} and") == [(x, kind)]


def test_keys_on_successive_lines():
    keys = [B64(x).rstrip("=") for x in (ED, SSH_RSA, RSA, ED, PKCS8, PRIVATE, EC)]
    assert [x for x, _ in found("\n".join(keys))] == keys


@pytest.mark.parametrize("key, kind", [(RSA, "der_key"), (PRIVATE, "ssh_key")])
@pytest.mark.parametrize("between", ["\n", "\r\n", "\n    ", "\\n", "\\r\\n", "\\\\n", " \\\n", "\n\t"])
def test_folded_keys(key, kind, between):
    lines = [B64(key)[i : i + 64] for i in range(0, len(B64(key)), 64)]
    text = f"-----BEGIN KEY-----{between}{between.join(lines)}{between}-----END KEY-----"
    assert found(text) == [(between.join(lines), kind)]


def test_base64url():
    key = RSA
    while not set(secrets_url(key)) >= set("-_"):
        key = der(0x30, der(2, b"\x00"), *[integer(64) for _ in range(8)])
    assert found(f"key={secrets_url(key)}; next") == [(secrets_url(key), "der_key")]


def secrets_url(key):
    return B64(key).replace("+", "-").replace("/", "_").rstrip("=")


def test_a_key_cut_off_and_look_alikes():
    assert found(B64(SSH)) == [(B64(SSH), "ssh_key")]
    for x in (ED[:-1], RSA[:-1], ED[:20] + b"x" * 40, b"0" * 60):
        assert found(f"text {B64(x)}\nword") == []


def test_what_stands_around_a_key():
    key = base64.b64encode(bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))).decode()
    assert secrets.confirmed_spans("path/" + key + "\nnext line") == [(5, 5 + len(key), "der_key")]
    assert secrets.confirmed_spans("M" + "a" * 40 + "/" + key) == [(42, 42 + len(key), "der_key")]
    raw = base64.b64decode(key).hex()
    assert secrets.confirmed_spans(raw + "00ff") == [(0, len(raw), "der_key")] and secrets.confirmed_spans(raw[:-2]) == []


def test_long_runs_take_time_in_proportion():
    for text in ("M/" * 200_000, "M" * 400_000, "MIICAgI/" * 50_000):
        began = time.perf_counter()
        assert secrets.confirmed_spans(text) == []
        assert time.perf_counter() - began < 5


def test_runs_of_empty_fields_are_no_key_and_take_linear_time():
    for kind in (b"ssh-x", b"ssh-ed25519"):
        text = B64(blob(kind) + b"\0" * 750_000)
        began = time.perf_counter()
        assert secrets.confirmed_spans(text) == []
        assert time.perf_counter() - began < 1
    lines = (B64(secrets.SSH_MAGIC + b"\0" * 18) + "\n") * 20_000
    began = time.perf_counter()
    secrets.confirmed_spans(lines)
    assert time.perf_counter() - began < 5


def test_encrypted_public_and_certified_keys():
    scheme = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050c")))))
    encrypted = der(0x30, scheme, der(4, os.urandom(80)))
    public = der(0x30, der(2, b"\x00" + os.urandom(128)), der(2, b"\x01\x00\x01"))
    certificate = blob(b"ssh-ed25519-cert-v01@openssh.com", os.urandom(32), os.urandom(32)) + b"\0" * 12 + blob(b"id", b"") + b"\0" * 16 + blob(b"", b"", b"", ED, os.urandom(83))
    for key, kind in ((encrypted, "der_key"), (public, "der_key"), (certificate, "ssh_key")):
        assert found(f"a {B64(key)}\nword") == [(B64(key), kind)]
    signature = der(0x30, der(2, os.urandom(32)), der(2, os.urandom(32)))
    assert found(f"a {B64(signature)} b") == []
    assert found(f"a {B64(certificate[:-3])} b") == []
