"""Secrets in decoded layers that are long, in several members, wrapped, or partly binary."""

import base64
import bz2
import gzip
import random
import zlib

import pytest

from terraframe.llm import secret_scan

HEX = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
SECRET = f'token = "{HEX}"'


def kinds(text):
    return {secret_scan.KINDS[k] for _, k, _ in secret_scan.secrets(text)[1]}


def b64(data, wrap=0):
    t = base64.b64encode(data).decode()
    return "\n".join(t[i : i + wrap] for i in range(0, len(t), wrap)) if wrap else t


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, zlib.compress])
def test_behind_a_long_stretch(pack):
    filler = "né, (x)\n".encode() * 4_500_000
    assert kinds(b64(pack(filler + SECRET.encode()))) >= {"assign", "hex"}


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress])
def test_later_members(pack):
    assert kinds(b64(pack(b"first") + pack(b"second") + pack(SECRET.encode()))) == {"assign", "hex"}


def test_between_control_and_foreign_bytes():
    assert kinds(b64(gzip.compress(b"a\x1b[0m " + SECRET.encode() + b" \xff\x00"))) == {"assign", "hex"}
    text = "ab " + b64(b"\xff\x1b" + SECRET.encode() + b"\x00\xfe\xfe")
    assert {text[s:e] for s, _, e in secret_scan.secrets(text)[1] if base64.b64decode("AA" + text[s:e][2:] + "=" * (-len(text[s:e]) % 4))} and kinds(text) == {"assign", "hex"}


@pytest.mark.parametrize("wrap", [8, 20, 64, 76])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_wrapped(wrap, pack):
    rng = random.Random(2)
    prose = " ".join(str(rng.random()) for _ in range(10))
    text = f"key: value\n\n{b64(pack(f'{prose} {SECRET} {prose}'.encode()), wrap)}\nThe end"
    spans = secret_scan.secrets(text)[1]
    assert {secret_scan.KINDS[k] for _, k, _ in spans} >= {"assign", "hex"}
    if pack is bytes:
        start, end = max(((s, e) for s, k, e in spans if k == 2), key=lambda x: x[1] - x[0])
        inner = text[start:end].replace("\n", "")
        assert any(HEX.encode() in base64.b64decode("A" * k + inner + "A" * (-(len(inner) + k) % 4)) for k in range(4))


def test_wrapped_after_a_long_word():
    assert kinds("anidentifierofthirtyonecharacte\n" + b64(gzip.compress(SECRET.encode()), 40)) == {"assign", "hex"}
    assert kinds("anidentifierofthirtyonecharacte\n" + b64(SECRET.encode(), 20)) == {"assign", "hex"}


def test_nothing_comes_of_the_first_64_kilobytes():
    noise = random.Random(3).randbytes(300_000)
    assert kinds(b64(bz2.compress(SECRET.encode() + b"\n" + noise))) >= {"assign", "hex"}
    assert kinds(b64(bz2.compress(noise + b"\n" + SECRET.encode()))) >= {"assign", "hex"}
    named = gzip.compress(SECRET.encode())
    named = named[:3] + b"\x08" + named[4:10] + b"n" * 100_000 + b"\x00" + named[10:]
    assert kinds(b64(named)) >= {"assign", "hex"}
