"""Secret scan: time in proportion to the text whatever it holds, and which structures count."""

import base64
import json
import random
import time

import pytest

from helixlake.llm import secrets
from tests.llm.test_operators import der

R = random.Random(12)
MB = 1 << 20


def number(n):
    return der(2, bytes([1]) + R.randbytes(n - 1))


def b64(x):
    return base64.b64encode(x).decode()


def url(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def kinds(text):
    return [s[0] for s in secrets.scan(text)]


HEAD = bytes.fromhex("3083030000020100")
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + (30000).to_bytes(4, "big")
STRESS = {
    "container starts": "b3BlbnNzaC1rZXkt",
    "whole container heads": b64(SSH + b"x"),
    "sequence heads": b64(HEAD * 3),
    "short sequence heads": b64(bytes.fromhex("30827ff0020100") * 3),
    "heads within numbers": b64(bytes.fromhex("020730827ff0020100") * 3),
    "heads in lines": b64(bytes.fromhex("30827ff0020100") * 6) + "\n",
    "token starts": "eyJ",
    "token starts and dots": "eyJhbGciOiJI.",
    "pem heads": "-----BEGIN PRIVATE KEY-----\nAAAA\n",
    "pem headers": "-----BEGIN PRIVATE KEY-----\na: b\n",
    "hex": "0123456789abcdef",
    "zeros after x": "0x0",
    "passwords": "password = ",
    "access": "AKIA",
}


@pytest.mark.parametrize("what", STRESS)
def test_four_megabytes(what):
    unit = STRESS[what]
    text = unit * (4 * MB // len(unit))
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 5


def test_rsa_numbers_have_sizes():
    key = lambda *sizes: der(0x30, der(2, b"\0"), *map(number, sizes))
    good = key(129, 3, 128, 65, 64, 64, 64, 64)
    assert secrets.is_private_key(good) and kinds(b64(good)) == ["key"]
    zeros = der(0x30, *[der(2, b"\0")] * 9)
    for bad in (zeros, key(20, 3, 20, 10, 10, 10, 10, 10), key(129, 3, 128, 20, 20, 64, 64, 64), key(129, 3, 8, 65, 64, 64, 64, 64)):
        assert not secrets.is_private_key(bad) and kinds("k " + b64(bad)) == []
    primes = der(0x30, der(2, b"\1"), *map(number, (129, 3, 128, 44, 44, 44, 44, 44)))
    assert not secrets.is_private_key(primes)
    many = der(0x30, der(2, b"\1"), *map(number, (129, 3, 128, 65, 64, 44, 44, 44)), der(0x30, der(0x30, number(43), number(43), number(43))))
    assert secrets.is_private_key(many)


def test_dsa_numbers_have_sizes():
    key = lambda *sizes: der(0x30, der(2, b"\0"), *map(number, sizes))
    assert secrets.is_private_key(key(129, 21, 128, 128, 20)) and not secrets.is_private_key(der(0x30, *[der(2, b"\0")] * 6))
    assert not secrets.is_private_key(key(129, 21, 128, 128, 64))


def test_bare_encrypted_keys():
    scheme = bytes.fromhex("2a864886f70d01050d")
    sealed = lambda oid, octets: der(0x30, der(0x30, der(6, oid), der(0x30, der(4, R.randbytes(8)))), der(4, octets))
    key = sealed(scheme, R.randbytes(200))
    for text in (b64(key), "KEY=" + b64(key) + " x", "\n".join(b64(key)[i : i + 64] for i in range(0, 400, 64))):
        assert kinds(text) == ["key"]
    for bad in (sealed(b"\x55\x04\x03", R.randbytes(200)), sealed(scheme, b"short"), key[:-1]):
        assert kinds("see " + b64(bad)) == []


def test_legacy_ciphers_need_whole_blocks():
    pem = lambda cipher, n: f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: {cipher}\n\n{b64(R.randbytes(n))}\n-----END RSA PRIVATE KEY-----"
    found = lambda *x: "key" in kinds(pem(*x))
    aes, des = "AES-256-CBC,00112233445566778899AABBCCDDEEFF", "DES-EDE3-CBC,0011223344556677"
    assert found(aes, 608) and found(des, 616) and not found(aes, 616) and not found(des, 612)
    assert not found(aes, 16) and not found(des, 8) and not found("DES-EDE3-CBC,0011", 616)


def test_tokens_of_other_payloads_and_of_five_parts():
    head = url(json.dumps({"alg": "ES256"}).encode())
    plain = f"{head}.{url(b'not json at all')}.{url(R.randbytes(64))}"
    assert secrets.scan("a " + plain) == [("token", 2, 2 + len(plain))]
    sealed = url(json.dumps({"alg": "dir", "enc": "A256GCM"}).encode())
    five = lambda head, key: ".".join([head, url(key), url(R.randbytes(12)), url(R.randbytes(50)), url(R.randbytes(16))])
    for key in (b"", R.randbytes(256)):
        token = five(sealed, key)
        assert secrets.scan(f"x={token};") == [("token", 2, 2 + len(token))]
    assert kinds(five(url(b'{"alg":"dir","kid":"1"}'), b"")) == []
    assert kinds("www.documentation-of-things.example.org and a_long_file_name.tar.gz") == []


def test_keys_of_a_long_run_are_all_found():
    keys = [der(0x30, der(2, b"\1"), der(4, R.randbytes(33))) for _ in range(40)]
    text = "/".join(b64(k + b"\0" * (-len(k) % 3)) for k in keys)
    spans = [s for s in secrets.scan(text) if s[0] == "key"]
    assert len(spans) == 40 and secrets.unbase64(text[spans[7][1] : spans[7][2]])[: len(keys[7])] == keys[7]
