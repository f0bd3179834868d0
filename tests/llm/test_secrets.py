import base64
import hashlib
import json
import random
import re

from lacuna.llm import secrets as S


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def rsa_key():
    r = random.Random(1)
    return tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, b"\1" + r.randbytes(n)) for n in (128, 2, 128, 64, 64, 64, 64, 64)))


def pkcs8():
    return tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, bytes(range(32)))))


def b64(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


def kinds(text):
    return [(S.KINDS[k], text[a:b]) for a, k, b in S.scan(text)]


def test_confirmed_and_refused():
    for key in (rsa_key(), pkcs8()):
        body = base64.b64encode(key).decode()
        lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
        pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
        assert ("pem", pem) in kinds(f"x {pem} y")
        assert ("key64", body) in kinds(f"x {body} y")
        assert ("keyhex", key.hex().upper()) in kinds(f"x {key.hex().upper()} y")
        spoiled = base64.b64encode(key[:-1]).decode()
        assert not [k for k in kinds(f"x {spoiled} -----BEGIN PRIVATE KEY-----\n{spoiled}\n-----END PRIVATE KEY-----") if k[0] in ("pem", "key64")]
        assert not [k for k in kinds((key + b"\0").hex().upper()) if k[0] == "keyhex"]
    token = f"{b64({'alg': 'HS256'})}.{b64({'sub': 'x'})}.c2lnbmF0dXJl"
    assert ("token", token) in kinds(f"Bearer {token}")
    assert not kinds(f"Bearer {b64({'typ': 'x'})}.{b64({'sub': 'x'})}.c2ln") and not kinds("eyJhbGciOiJ.abc.def")
    ssh = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + (8).to_bytes(4, "big") + b"ssh-ed25" + (40).to_bytes(4, "big") + bytes(40)
    assert kinds(base64.b64encode(ssh).decode())[0][0] == "key64"


def plain_base(text):
    out = []
    for m in re.finditer("((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_against_plain(spark):
    r = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", ' = "', ": ", "=", "'", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", " ", "é🙂", "\n", "toKen=key", "Z", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(2000)] + [None, "", "a" * 100_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string").repartition(3)
    got = {x.doc_id: x for x in S.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        listed = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base)
        x = got[i]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(x.spans.split(","))
    assert S.find_secrets(df.limit(0)).count() == 0


def test_usual_forms():
    body = base64.b64encode(pkcs8()).decode()
    assert ("key64", body) in kinds(f"private_key={body}")
    assert ("key64", body) in kinds(f'"a\\n{body}\\n"')
    block = "\n".join(body[i : i + 40] for i in range(0, len(body), 40))
    pem = f"-----BEGIN PRIVATE KEY-----\n{block}\n-----END PRIVATE KEY-----\n"
    for written in (json.dumps(pem), json.dumps(pem.replace("\n", "\r\n")), json.dumps(json.dumps(pem)), json.dumps(pem).replace("/", "\\/")):
        assert [k for k, x in kinds(f'{{"private_key": {written}}}') if x.startswith("-----BEGIN")] == ["pem"], written
    assert ("keyhex", "0x" + pkcs8().hex().upper()) in kinds(f"k=0x{pkcs8().hex().upper()};")
    key = next(x for x in (tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, random.Random(s).randbytes(32)))) for s in range(99)) if {*"-_"} & {*base64.urlsafe_b64encode(x).decode()})
    safe = base64.urlsafe_b64encode(key).decode()
    assert ("key64", safe) in kinds(f'"{safe}"')
    sealed = base64.b64encode(random.Random(2).randbytes(640)).decode()

    def headed(data, cipher):
        return f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: {cipher}\n\n{data}\n-----END RSA PRIVATE KEY-----"

    assert [k for k, _ in kinds(headed(sealed, "AES-128-CBC," + "A1" * 16)) if k == "pem"] == ["pem"]
    assert [k for k, _ in kinds(headed(base64.b64encode(rsa_key()).decode(), "x")) if k == "pem"] == ["pem"]
    for refused in (headed(sealed, "AES-128-CBC,A1"), headed(base64.b64encode(bytes(641)).decode(), "DES-EDE3-CBC," + "A1" * 8), pem.replace(body[:8], "AAAAAAAA")):
        assert not [k for k, _ in kinds(refused) if k == "pem"]


def test_encoded_again_and_once_only():
    body = base64.b64encode(pkcs8()).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    for inner in (body, pem):
        again = base64.b64encode(inner.encode()).decode()
        assert ("key64", again) in kinds(f"x {again} y")
        assert not kinds(f"x {base64.b64encode(inner[:-30].encode()).decode()} y")
    assert [k for k, _ in kinds(pem)] == ["pem"]
    token = f"{b64({'alg': 'HS256'})}.{b64({'sub': 'x'})}.c2lnbmF0dXJl"
    assert ("token", token) in kinds(f"eyJbad.{token}") and ("token", token) in kinds(f"keyJ{token}") and len(kinds(f"{token}.{token}")) == 2


def plain_structures(text):
    """Every run of an alphabet, decoded whole: what may be reported as key64 if it stands alone."""
    out = set()
    for alphabet in ("A-Za-z0-9+/", "A-Za-z0-9_-"):
        for m in re.finditer(f"[{alphabet}]+={{0,2}}", text):
            body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4))
            except ValueError:
                continue
            if S.is_private_key(data) or S.is_openssh_key(data):
                out.add(m[0])
    return out


def test_keys_against_plain_decoding():
    r = random.Random(9)
    for _ in range(300):
        parts = []
        for _ in range(r.randrange(1, 5)):
            data = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, r.randbytes(5))) + tlv(4, r.randbytes(r.randrange(30, 70))))
            if r.random() < 0.4:
                data = bytearray(data)
                data[r.randrange(4)] ^= 1 << r.randrange(8)
            made = r.choice([base64.b64encode, base64.urlsafe_b64encode])(bytes(data)).decode()
            parts.append(r.choice(["key: ", 'x="', "(", "\n"]) + made + r.choice([" ", '"', ")", "\n"]))
        text = "".join(parts)
        assert {x for k, x in kinds(text) if k == "key64"} == plain_structures(text)


def test_repeated_and_null_ids_and_long_words(spark):
    key = base64.b64encode(b"\x30\x2e" + b"\x02\x01\x00" + b"\x04\x20" + bytes(range(32)) + b"\xa0\x07\x06\x05" + b"\x2b\x81\x04\x00\x0a").decode()
    texts = ["PassWord: abcdef x", "AKIA" + "A" * 20, "f" * 24, "Key token=abcdef", f"k {key} e", "x" * 300, None, ""]
    rows = [(i, t, "n") for i in (None, 1, 1) for t in texts * 2]
    got = S.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, spans string").repartition(3))
    want = sorted((repr(i), ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in S.scan(t or ""))) for i, t, _ in rows)
    assert sorted((repr(r.doc_id), r.spans) for r in got.collect()) == want
    assert [bool(S.scan(t or "")) for t in texts] == [True] * 5 + [False] * 3
    assert S.find_secrets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
