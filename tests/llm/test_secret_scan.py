import base64
import json
import random
import re
import time

import pytest

from veilframe.llm import secret_scan as S


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0), *(number(3 ** (40 + i)) for i in range(8)))
PKCS8 = der(0x30, number(0), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
EC = der(0x30, number(1), der(4, b"k" * 32))


def field(data):
    return len(data).to_bytes(4, "big") + data


OPENSSH = S.OPENSSH_MAGIC + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 80)


def b64(data):
    return base64.b64encode(data).decode()


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def token(head, claims, signature=b"s" * 32):
    return ".".join([url64(json.dumps(head).encode()), url64(json.dumps(claims).encode()), url64(signature)])


def kinds(text):
    return [k for _, k, _ in S.find_spans(text)]


DSA = der(0x30, number(0), *(number(5 ** (60 + i)) for i in range(5)))
ENCRYPTED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), der(0x30, der(4, b"salt"))), der(4, RSA))


def packet(tag, body, old=False):
    return (bytes([0x80 | tag << 2 | 1]) if old else bytes([0xC0 | tag, 255]) + bytes(2)) + len(body).to_bytes(2, "big") + body


OPENPGP = packet(5, b"\x04" + b"k" * 300) + packet(13, b"someone <a@b.c>") + packet(2, b"s" * 90, old=True)


@pytest.mark.parametrize("key", [RSA, PKCS8, EC, OPENSSH, DSA, ENCRYPTED])
def test_keys_are_confirmed(key):
    assert S.is_key(key)
    assert not S.is_key(key[:-1]) and not S.is_key(key + b"x") and not S.is_key(key[:1] + b"\x05" + key[2:])
    text = f"before {b64(key)} after"
    assert kinds(text) == ["key64"]
    start, _, end = S.find_spans(text)[0]
    assert text[start:end] == b64(key)


def test_hex_key_is_both():
    text = "k " + RSA.hex()
    assert kinds(text) == ["hex", "keyhex"]
    assert kinds("k " + RSA.hex().upper()) == ["keyhex"]
    assert kinds("k " + RSA.hex()[:-2]) == ["hex"]


def test_pem_block_counts_once():
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(RSA)}\n-----END RSA PRIVATE KEY-----"
    assert kinds("x " + block + " y") == ["pem"]
    assert kinds(block.replace(b64(RSA), b64(RSA)[:40])) == []


def lines(data, width=64, gap="\n"):
    body = b64(data)
    return gap.join(body[i:i + width] for i in range(0, len(body), width))


@pytest.mark.parametrize(("label", "head", "data"), [
    ("RSA PRIVATE KEY", "", RSA), ("DSA PRIVATE KEY", "", DSA), ("ENCRYPTED PRIVATE KEY", "", ENCRYPTED), ("PRIVATE KEY", "", PKCS8),
    ("OPENSSH PRIVATE KEY", "", OPENSSH), ("EC PRIVATE KEY", "Comment: a\n  b\n\n", EC),
    ("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,A0B1C2D3E4F5A6B7C8D9E0F1A2B3C4D5\n\n", b"\x07" * 128),
    ("PGP PRIVATE KEY BLOCK", "Version: 1\n\n", OPENPGP)])
def test_blocks_of_all_kinds(label, head, data):
    tail = "\n=aB3d" if label.endswith("BLOCK") else ""
    for gap in ("\n", "\r\n", "\\n", "\n   "):
        block = f"-----BEGIN {label}-----{gap}{head.replace(chr(10), gap)}{lines(data, gap=gap)}{tail.replace(chr(10), gap)}{gap}-----END {label}-----"
        text = f"x -----BEGIN {label}----- y {block} z -----END {label}-----"
        assert [text[s:e] for s, k, e in S.find_spans(text) if k == "pem"] == [block]
        assert kinds(block) == ["pem"]
        assert kinds(block.replace(b64(data)[:40], b64(b"\x31" + data[1:])[:38])) in ([], ["jwt"])


@pytest.mark.parametrize("data", [RSA, PKCS8, DSA, OPENSSH])
def test_wrapped_keys_outside_of_blocks(data):
    for gap in ("\n", "\r\n", "\\n", "\n\t "):
        for tail in ("", gap + "and", "\n\nother", " x"):
            if data is OPENSSH and tail == gap + "and":
                continue  # no outer length: the last line has to be its own
            text = f"key: {lines(data, 60, gap)}{tail}"
            assert [text[s:e] for s, k, e in S.find_spans(text) if k == "key64"] == [lines(data, 60, gap)], (gap, tail)


def test_url_alphabet():
    data = next(d for i in range(99) if "-" in url64(d := der(0x30, number(0), *(number(3 ** (90 + i + j)) for j in range(8)))) and "_" in url64(d))
    text = f"(\"{url64(data)}\")"
    assert [text[s:e] for s, k, e in S.find_spans(text)] == [url64(data)]


def test_tokens_as_their_pattern():
    plain = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["eyJ", "eyJ", "a", ".", ".", " ", "_", "e", "y"]) for _ in range(rng.randrange(25)))
        assert list(S.token_spans(text)) == [m.span() for m in plain.finditer(text)], text


def test_signed_tokens():
    assert kinds("a " + token({"alg": "HS256"}, {"sub": 1}) + " b") == ["jwt"]
    assert kinds(token({"typ": "JWT"}, {"sub": 1})) == []
    assert kinds(token({"alg": "HS256"}, [1])) == []
    assert kinds(token({"alg": "HS256"}, {}, b"")) == []


def test_plain_kinds_as_their_patterns():
    texts = ["password=abcdefghijkl", "PassWd : 'abc' token=\"0123456789abcdef\"", "api_key = a.b-c_d/e+f=", "secret:short",
             "token=secret=abcdefghijklmnop", "AKIA1234567890ABCD AKIAAKIA AKIA12345678901234z", "x" * 9 + "deadbeefdeadbeef0", "",
             "toKen=aaaaaaaaaaaa paſſword=aaaaaaaaaaaa", "apikey=aaaaaaaaaaaa", "é password  =  \"abcdefghijkl"]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for t in texts:
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [s for s in S.find_spans(t) if s[1] in ("assign", "access", "hex")] == sorted(want, key=lambda s: (s[0], S.KINDS.index(s[1]))), t
    assert kinds(texts[0]) == ["assign"] and kinds(texts[3]) == [] and kinds(texts[8]) == ["assign"]


def test_masking_merges_overlaps():
    text = "a token=deadbeefdeadbeefdead z AKIA12345678901234"
    assert S.masked(text, S.find_spans(text)) == "a <secret> z <secret>"
    assert S.masked(None, []) is None and S.masked("", []) == ""


def test_operator_on_odd_rows(frame):
    rows = [(1, None, "x"), (2, "", "x"), (3, "password=abcdefghijkl", "x"), (3, "password=abcdefghijkl", "x"), (None, "é" * 100_000 + " " + "a" * 200_000, None)]
    docs = frame(rows, "doc_id long, text string, secrets string")
    out = S.scan_secrets(docs, masked_text="text")
    assert out.columns == ["doc_id", "text", "secrets"]
    found = sorted((r.doc_id or 0, len(r.secrets), r.text) for r in out.collect() if r.doc_id is None or r.doc_id > 1)
    assert [f[:2] for f in found] == [(0, 1), (2, 0), (3, 1), (3, 1)]
    assert found[2][2] == "<secret>"
    assert S.scan_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [
    "A", "eyJ", "eyJ.", "eyJa.b", "M", "f", "MIIE" * 20 + "\n", "MII\n", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n", "password ",
    "password    ", "AKIA", "token=", "a: b\n", "-----END RSA PRIVATE KEY-----", "0123456789abcdef", "30", "\\n", "=", "_-"])
def test_time_is_linear(unit):
    def seconds(n):
        text = unit * (n // len(unit))
        begin = time.perf_counter()
        S.find_spans(text)
        return time.perf_counter() - begin
    assert min(seconds(1_000_000) for _ in range(2)) < 2.5
