"""Each operator against a brute-force version, a round trip or held-out labels, and on edge cases."""

import base64
import functools
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixlake.llm import langid, lines, minhash, neighbours, packing, pieces, queries, secrets, shards, toxicity, winnow
from helixlake.llm.textkit import hash_words, shingle_sets, utf8
from tests.conftest import DATA
from tests.llm.conftest import ROWS

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def corpus(seed=0, families=12, size=6):
    """Families of edited copies, from nearly alike to half alike, and exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    out = []
    for f in range(families):
        base = [word() for _ in range(r.randint(8, 120))]
        for i in range(size):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.03, 0.05, 0.08, 0.2]))):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    return list(enumerate(out, 1))


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    lengths = [1, 5, 8, 3]
    score = rng.normal(size=sum(lengths)) * 3
    starts = np.cumsum([0, *lengths[:-1]])
    got = toxicity.marginals(score, starts, trans)
    for a, n in zip(starts, lengths, strict=True):
        total, one = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            one += w * np.asarray(y)
        assert np.allclose(got[a : a + n], one / total)
    long = toxicity.marginals(rng.normal(size=5000), np.asarray([0]), trans)
    assert np.isfinite(long).all() and len(toxicity.marginals(np.zeros(0), np.zeros(0, int), trans)) == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False} and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    assert sum(1 for r in rows if r.toxic and r.predicted) > 0.55 * sum(1 for r in rows if r.toxic)


def test_toxicity_edges(spark, edge, none):
    rows = [(f"you are a stupid idiot word{i} filler", 1) for i in range(20)] + [(f"a lovely day number {i} with flowers", 0) for i in range(60)]
    tagger = toxicity.fit(rows, {0: 1.0, 1: 1.0})
    out = toxicity.predict(edge, tagger)
    assert out.count() == len(ROWS) and "kept" in {r.bucket for r in out.collect()}
    one = toxicity.predict(spark.createDataFrame([(1, "İ What a STUPID idiot!")], "doc_id long, text string"), tagger).first()
    assert one.predicted == 1 and [(s.start, s.end) for s in one.spans] == [(9, 15), (16, 21)]
    assert toxicity.predict(none, tagger).count() == 0
    assert toxicity.fit([], {0: 1.0, 1: 1.0}) is None and toxicity.predict(edge, None).filter("score = 0").count() == len(ROWS)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(edge, labels) is None


# --- 2 --------------------------------------------------------------------------------------------------------------


def brute_components(docs, words, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("words,percent", [(2, 80), (5, 80), (1, 60)])
def test_near_duplicates(spark, words, percent):
    docs = corpus(words)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_common_centre(spark):
    """A long chain, each like its neighbours only: every link inside the buckets must be found."""
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(1000)]
    docs = [(100 - i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: c for i, (_, c) in brute_components(docs, 1, 80).items()}


def test_near_duplicates_edges(spark, edge, none):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].component_id == 1 and not by[2][0].kept and by[3][0].n_shingles == by[4][0].n_shingles == by[7][0].n_shingles == 0
    assert by[None][0].component_id is None and by[None][0].kept and len(by[8]) == 2 and by[5][0].n_shingles == 1
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_same_as_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = db.execute(queries.oracle_sql()["op2_near_duplicates"]).fetchall()
    got = queries.op2_near_duplicates(spark, DATA).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df([(3, a), (5, a), (5, b), (9, b), (11, "x y z")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]
    heads = minhash.text_groups(df([(2, a + " more"), (5, a), (5, b), (9, b), (9, None)])).collect()
    assert sorted(((r.doc_id, r.head.doc_id if r.head else 0, r.n_shingles) for r in heads)) == [(2, 2, 37), (5, 2, 36), (5, 5, 36), (9, 0, 0), (9, 5, 36)]


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(1)
    for n, share in ((20, 0.8), (400, 0.8), (3000, 0.5)):
        hits = []
        for _ in range(30):
            x = r.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            k = int(2 * n * share / (1 + share)) if n > 20 else 16
            a, b = np.unique(x[: n // 2 + k // 2]), np.unique(np.concatenate([x[: k // 2 + n // 4], x[n:]])[: n])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            hits.append((minhash.signature(a) == minhash.signature(b)).mean() - j)
        assert abs(np.mean(hits)) < 0.05


# --- 3 --------------------------------------------------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


def test_secrets():
    r = random.Random(0)
    num = lambda n: der(2, bytes([1]) + r.randbytes(n))
    rsa = der(0x30, der(2, b"\0"), *[num(k) for k in (64, 3, 64, 32, 32, 32, 32, 32)])
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86"), b"\5\0"), der(4, rsa))
    curve = der(0x30, der(2, b"\1"), der(4, r.randbytes(32)))
    ssh = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (r.randbytes(51), r.randbytes(90)))
    for k in (rsa, pkcs8, curve, ssh):
        assert secrets.is_private_key(k) and not secrets.is_private_key(k[:-1]) and not secrets.is_private_key(k + b"x")
        b64 = base64.b64encode(k).decode()
        assert [s[0] for s in secrets.scan(f"é see {b64} ok")] == ["key"]
        assert [s for s in secrets.scan(f"see {k.hex()} ok") if s[0] == "key"] == [("key", 4, 4 + len(k.hex()))]
        pem = f"-----BEGIN PRIVATE KEY-----\n{b64[:64]}\n{b64[64:]}\n-----END PRIVATE KEY-----"
        assert ("key", 2, 2 + len(pem)) in secrets.scan("a " + pem)
    assert not secrets.scan("see " + base64.b64encode(r.randbytes(90)).decode())
    enc = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = ".".join([enc(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), enc(b'{"sub": 1}'), enc(b"signature bytes")])
    assert secrets.scan("x " + token) == [("token", 2, 2 + len(token))]
    assert not secrets.scan(".".join([enc(b'{"typ": 1}'), enc(b"{}"), enc(b"sign")]))
    text = "Token=token: abcdefgh API_KEY: 'k9k9k9' ſecret=abcdef AKIA" + "Z" * 16 + " secret:abc " + "a1" * 12
    assert [(k, text[a:b]) for k, a, b in secrets.scan(text)] == [("assign", "API_KEY: 'k9k9k9"), ("access", "AKIA" + "Z" * 16), ("hex", "a1" * 12)]
    brute = [m.span() for m in re.finditer(r"""(?i:(password|passwd|[s]ecret|token|api_?[k]ey))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    assert [s[1:] for s in secrets.scan(text) if s[0] == "assign"] == brute
    assert secrets.redact("ab cd ef", [("hex", 0, 4), ("assign", 3, 5)]) == "[hex] ef"


def test_secrets_in_other_wrappings():
    number = lambda n: der(2, bytes([1]) + bytes(range(n - 1)))
    rsa = der(0x30, der(2, b"\0"), *[number(n) for n in (129, 3, 128, 64, 64, 64, 64, 64)])
    blob = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + blob(b"none") + blob(b"none") + blob(b"") + (1).to_bytes(4, "big") + blob(b"p" * 51) + blob(b"s" * 136)
    cut = lambda b, sep="\n": sep.join(re.findall(".{1,64}", base64.b64encode(b).decode()))
    assert secrets.is_private_key(rsa) and secrets.is_private_key(ssh)
    one = base64.b64encode(rsa).decode()
    assert secrets.scan(f"DEPLOY_KEY={one}\nnext") == [("key", 11, 11 + len(one))]
    for key in (rsa, ssh):
        for sep in ("\n", "\r\n", "\\n", "\n    "):
            for before, after in (("", ""), ("see\nbelow\n", "\nand then more words"), ("k: ", "\nMIIEword"), ("KEY=", " end")):
                whole = cut(key, sep)
                assert secrets.scan(before + whole + after) == [("key", len(before), len(before + whole))], (key[:5], sep, before)
    assert secrets.scan(cut(rsa[:-1])) == [] and secrets.scan(cut(der(0x30, der(0x30, rsa)))) == []
    body = cut(bytes(range(256)) * 2)
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABB\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert ("key", 2, 2 + len(pem)) in secrets.scan("a " + pem + " b")
    assert [s for s in secrets.scan(pem.replace("Proc-Type: 4,ENCRYPTED", "Comment: mine")) if s[0] == "key"] == []
    coded = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    for head in ('{\n "alg": "HS256"}', '{ "alg":"none", "typ":"JWT"}', ' {"alg":"HS256"}'):
        token = f"{coded(head)}.{coded('{ "sub": 1}')}.c2ln"
        assert secrets.scan(f"x www.{token} y") == [("token", 6, 6 + len(token))]
    assert secrets.scan("documentation.example.com and " + f"{coded('[1, 2, 3, 4, 5, 6]')}.{coded('{}')}.c2ln") == []


def test_secrets_after_other_letters_and_encrypted():
    r = random.Random(4)
    number = lambda n: der(2, bytes([1]) + r.randbytes(n))
    rsa = der(0x30, der(2, b"\0"), *[number(n) for n in (128, 3, 128, 64, 64, 64, 64, 64)])
    algorithm = der(0x30, der(6, b"\x2a\x86\x48"), b"\5\0")
    wrapped = lambda inner: der(0x30, der(2, b"\0"), algorithm, der(4, inner))
    assert secrets.is_private_key(wrapped(rsa)) and secrets.is_private_key(wrapped(der(4, r.randbytes(32))))
    for junk in (r.randbytes(40), rsa[:-1], rsa + b"x", der(0x30, r.randbytes(60)), b""):
        assert not secrets.is_private_key(wrapped(junk))
    one = base64.b64encode(rsa).decode()
    for before in ("a/", "key=", "x", "PK=", "https://host/"):
        for after in ("", " ", "&b=1"):
            assert ("key", len(before), len(before) + len(one)) in secrets.scan(before + one + after)
    assert [s for s in secrets.scan("k = 0x" + rsa.hex().upper()) if s[0] == "key"] == [("key", 6, 6 + 2 * len(rsa))]
    sealed = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), der(0x30, der(4, r.randbytes(8)))), der(4, r.randbytes(80)))
    pem = lambda body: f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{base64.b64encode(body).decode()}\n-----END ENCRYPTED PRIVATE KEY-----"
    assert ("key", 0, len(pem(sealed))) in secrets.scan(pem(sealed))
    assert not [s for x in (sealed[:-1], r.randbytes(90), b"\0\0\0") for s in secrets.scan(pem(x)) if s[0] == "key"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["AKIA", "Z9", "0aF" * 9, "ab12" * 7, " ", "password", "api-key", "apikey", "TOKEN", ":", " = ", '"', "'", "é", "ſecret", "secret=", "hunter22", "\n", "-"]), max_size=14))
def test_base_secrets_are_the_patterns(parts):
    """Base spans by hand: at each place, from left to right, what the contract's patterns match there."""
    text = "".join(parts)

    def run(at, letters):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        return end

    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def access(at):
        return run(at + 4, upper + digits) if text.startswith("AKIA", at) and run(at + 4, upper + digits) > at + 4 else None

    def hexa(at):
        return e if (e := run(at, digits + "abcdef")) > at else None

    def assign(at):
        fold = "".join(c.lower() if c in upper else c for c in text)
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if fold.startswith(name, at):
                for quote in (1, 0):
                    i = at + len(name)
                    if quote and text[i : i + 1] not in ("'", '"') or quote and i >= len(text):
                        continue
                    i = run(i + quote, " ")
                    if text[i : i + 1] in (":", "=") and i < len(text):
                        i = run(i + 1, " ")
                        i += text[i : i + 1] in ("'", '"') and i < len(text)
                        if (e := run(i, upper + upper.lower() + digits + "+/_.=-")) > i:
                            return e, e - i >= 6
        return None

    want = []
    for kind, match, least in (("access", access, 20), ("hex", hexa, 24), ("assign", assign, None)):
        at = 0
        while at < len(text):
            e = match(at)
            if e is None:
                at += 1
                continue
            e, ok = e if least is None else (e, e - at >= least)
            if ok:
                want.append((kind, at, e))
            at = e
    assert sorted(s for s in secrets.scan(text) if s[0] in ("assign", "access", "hex")) == sorted(want)


def test_secrets_edges(edge, none):
    out = secrets.digest_columns(secrets.find_secrets(edge)).collect()
    six = next(r for r in out if r.doc_id == 6)
    assert (six.n_assign, six.n_access, six.n_hex) == (1, 1, 1) and six.base_sha256 == hashlib.sha256(six.spans.encode()).hexdigest()
    assert next(r for r in out if r.doc_id == 3).base_sha256 == hashlib.sha256(b"").hexdigest() and len(out) == len(ROWS)
    both = secrets.find_secrets(edge, redacting=True)
    assert both.filter("redacted is null").count() == 1 and both.filter("doc_id = 6").first().redacted.startswith("[assign] and [access] é")
    assert secrets.find_secrets(none).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rows = {r.doc_id: r for r in queries.op4_fingerprints(spark, DATA).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i], len(texts[i])
        edited = t[: n - n // 2] + texts[j][: n // 2]
        assert rows[i].n_chars == n and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = ({x.split(":")[0] for x in rows[k].fingerprint.split(",") if x} for k in (i, j))
        assert rows[i].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        units = re.findall(r"[^\W_]+", t.lower())
        at = [int(x.split(":")[1]) for x in rows[i].fingerprint.split(",") if x]
        grams = max(len(units) - 4, 1)
        assert at == sorted(at) and all(any(s <= p < s + 8 for p in at) for s in range(max(grams - 7, 1)))
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_fingerprints_are_the_windows_minima(spark):
    r = random.Random(6)
    docs = [" ".join(r.choice("abcd") for _ in range(n)) for n in (0, 1, 4, 5, 6, 11, 12, 13, 60, 200)]
    grams = [(i, p, w[p : p + 5]) for i, t in enumerate(docs) for w in [t.split()] for p in range(max(len(w) - 4, min(len(w), 1)))]
    unit = [F.xxhash64(F.get("w", F.lit(k))) for k in range(5)]
    unit = [F.when(F.size("w") > k, u) for k, u in enumerate(unit)]
    hashed = spark.createDataFrame(grams, "i int, p int, w array<string>").select("i", "p", F.shiftrightunsigned(F.xxhash64(*unit), 33).alias("h"))
    by = {}
    for x in hashed.orderBy("i", "p").collect():
        by.setdefault(x.i, []).append(x.h)
    got = winnow.with_fingerprint(spark.createDataFrame(list(enumerate(docs)), "i int, text string"), "text", "fp").select("i", winnow.as_text("fp").alias("f")).collect()
    for x in got:
        h, want = by.get(x.i, []), []
        for s in range(max(len(h) - 7, min(len(h), 1))):
            w = h[s : s + 8]
            at = s + max(k for k, v in enumerate(w) if v == min(w))
            if at not in want:
                want.append(at)
        assert x.f == ",".join(f"{h[p]}:{p}" for p in want)


def test_fingerprint_ties_go_right(spark):
    out = winnow.with_fingerprint(spark.createDataFrame([("a " * 30,), ("",), (None,), ("b",), ("漢字 かな",)], "text string"), "text", "fp").select(winnow.as_text("fp").alias("f")).collect()
    assert [x.split(":")[1] for x in out[0].f.split(",")] == [str(i) for i in range(7, 26)]
    assert out[1].f == out[2].f == "" and out[3].f.endswith(":0") and out[4].f != ""


def test_fingerprint_edges(edge, none):
    out = winnow.fingerprint_edits(edge).collect()
    assert len(out) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert winnow.fingerprint_edits(none).count() == 0
    one = winnow.fingerprint_edits(edge.filter("doc_id = 1")).first()
    assert one.near_next == 1


def test_next_rows_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_BYTES", 40)
    df = spark.createDataFrame([(i * i, f"text {i}") for i in range(200)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in winnow.with_next(df, ["text"]).collect()}
    assert got == {i * i: f"text {i - 1 if i else 199}" for i in range(200)}


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.load(PIECE)
    r = random.Random(2)
    alphabet = " \n▁aaabeherinthéß日👍.,0123<>\t"
    texts = ["", " ", "\n", "  a", "a  ", "▁", "<s> </s>", " " * 40 + "b"] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(800)]
    texts += [t.text for t in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    for t in texts:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids and own.decode(ids) == lib.decode(ids)
    for _ in range(300):
        ids = [r.choice([r.randrange(32000), r.randrange(1, 259)]) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == lib.decode(ids)


def test_sentencepiece_long_runs_without_joins():
    model = pieces.load(queries._tokenizer("piece_bpe_32k.model"))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries._tokenizer("piece_bpe_32k.model"))
    for text in ("\u6f22\u5b57\u4eec" * 2000, "\u0e01\u0e02\u0e2d\u0e07" * 1500, "\U0001f44d" * 3000, "a, " + "\U0001f44d\u6f22" * 1500 + " word,"):
        ids = np.frombuffer(model.encode(text), "<u4").tolist()
        assert ids[1:-1] == library.encode(text) and model.decode(ids) == text


def test_sentencepiece_edges(edge, none):
    out = {r.doc_id: r for r in pieces.encode_decode(edge, PIECE).collect()}
    assert list(out[3].ids) == [1, 2] == list(out[4].ids) and out[3].decoded == "" and out[9].decoded == "x" * 50000 and out[1].bucket == "kept"
    assert pieces.encode_decode(none, PIECE).count() == 0


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[99]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (None, [1.0] * 16), (5060, [None] + [1.0] * 15), (5080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("kept")).withColumn("part", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, 2000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    d = x.astype(np.float64)
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(3000), -s))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += sum(s[f[1]] >= s[order[-1]] - 1e-9 for f in found)
    assert hit >= 0.9 * 20 * len(got)
    few = neighbours.nearest(df.limit(5), F.col("vec_id") % 2 == 0).collect()
    assert Counter(r.query_id for r in few) == {0: 4, 2: 4, 4: 4}
    assert neighbours.nearest(df.filter("1 = 0"), F.lit(True)).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    p = langid.Pieces(["▁a", "ab", "b", "a", "▁ab", "c", "bc"])
    prob = np.random.default_rng(0).random((len(p.names) + 2, 2)) * 0.2
    prob[0] = 0
    m = langid.Model(p, ["x", "y"], prob, np.asarray([0.5, 0.5]))
    for word in ("abc", "aab", "bcz", "c"):
        s = "▁" + word
        total = np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(s[at:i])
                    at = i
            parts.append(s[at:])
            w = np.ones(2)
            for q in parts:
                w = w * (prob[p.names.index(q) + 2] if q in p.names else prob[1] if len(q) == 1 else 0)
            total += w
        assert np.allclose(m.log_words([word])[0], np.log(total))


def test_long_runs_and_pieces_are_summed_whole():
    """Against the plain recursion in logarithms, over runs that span several lookups, with pieces of 16 letters."""
    names = ["▁", "a", "b", "ab", "ba", "▁ab", "abababababababab", "bbbbbbbbbbbb"]
    p = langid.Pieces(names)
    prob = np.random.default_rng(1).random((len(p.names) + 2, 2)) * 0.5
    prob[0] = 0
    m = langid.Model(p, ["x", "y"], prob, np.asarray([0.5, 0.5]))
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(n)) for n in (1, 30, 511, 512, 513, 1300)] + ["ab" * 900]
    for word, got in zip(words, m.log_words(words), strict=True):
        s = "▁" + word
        sums = [np.zeros(2)]  # logarithms
        for i in range(1, len(s) + 1):
            parts = [sums[i - n] + np.log(prob[p.names.index(q) + 2] if q in p.names else prob[1]) for n in range(1, min(16, i) + 1) if (q := s[i - n : i]) in p.names or n == 1]
            sums.append(np.logaddexp.reduce(parts))
        assert np.allclose(got, sums[-1], rtol=1e-9)
    vocabulary = langid.Pieces(pieces.load(PIECE).piece)
    assert vocabulary.longest >= 16 and len(vocabulary.names) > 23_000


def test_language_held_out(spark):
    rows = queries.op7_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.true for r in held) / len(held) > 0.95


def test_language_edges(spark, edge, none):
    vocabulary = pieces.load(PIECE).piece
    model = langid.train(edge, vocabulary)
    out = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    assert [out[i].lang_pred for i in (3, 4, 7)] == ["und"] * 3 and out[3].score == 0 and 0 < out[9].score <= 1 and out[1].bucket == "kept"
    assert langid.train(none, vocabulary) is None and langid.predict(edge, None).filter("lang_pred = 'und'").count() == len(ROWS)
    assert langid.predict(none, model).count() == 0
    digits = spark.createDataFrame([(1, "12 ⅷ ④ __")], "doc_id long, text string")
    assert langid.predict(digits, model).first().lang_pred == "und"


# --- 8 --------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.sampled_from([50, 80, 90]))
def test_edit_similarity(a, b, percent):
    n = max(len(a), len(b))
    want = 100 * edits(a, b) <= (100 - percent) * n
    assert lines.edit_similar(np.asarray(a, np.uint64), np.asarray(b, np.uint64), percent) == want


def test_lines(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    pool = [" ".join(word() for _ in range(r.randint(2, 150))) for _ in range(40)]
    docs = []
    for i in range(60):
        ls = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(pool).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = word()
            ls.append(" ".join(w).upper() if r.random() < 0.2 else ", ".join(w) + f" {r.randrange(10)}")
        docs.append((i, "\n".join(ls)))
    got = {x.doc_id: x for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    normal = lambda s: tuple(re.sub(r"[^a-z0-9]+", " ", re.sub(r"\d", "0", s.lower())).split())
    kinds = {}
    for i, t in docs:
        for k, x in enumerate(t.split("\n")):
            if len(normal(x)) >= 3:
                kinds.setdefault(normal(x), []).append((i, k))
    names = list(kinds)
    h, bounds, _ = lines.line_words(pa.array([" ".join(x) for x in names]))
    sim = lines.simhash(h, bounds)
    comp = list(range(len(names)))
    top = lambda i: i if comp[i] == i else top(comp[i])
    for a, b in itertools.combinations(range(len(names)), 2):
        x, y = names[a], names[b]
        if (int(sim[a]) ^ int(sim[b])).bit_count() <= 3 and 100 * edits(x, y) <= 20 * max(len(x), len(y)):
            comp[top(b)] = top(a)
    first = {}
    for i, x in enumerate(names):
        first[top(i)] = min(first.get(top(i), (10**9, 0)), min(kinds[x]))
    gone = {o for i, x in enumerate(names) for o in kinds[x] if o != first[top(i)]}
    assert gone
    for i, t in docs:
        ls = t.split("\n")
        assert got[i].text == "\n".join(x for k, x in enumerate(ls) if (i, k) not in gone)
        assert (got[i].n_lines, got[i].n_dropped) == (len(ls), sum((i, k) in gone for k in range(len(ls))))


@pytest.mark.parametrize(("percent", "few"), [(80, False), (80, True), (60, False)])
def test_lines_by_edit_similarity_alone(spark, percent, few):
    """Few: of a small vocabulary, so that all pairs of words are frequent and repeat within a line."""
    r = random.Random(percent + few)
    word = lambda: r.choice("abcdefghij"[: 3 if few else 10]) * r.randint(1, 2) + ("" if few else "".join(r.choice("klmnopqrst") for _ in range(2)))
    pool = [[word() for _ in range(r.choice([3, 4, 5, 6, 9, 10, 12, 20, 40, 110]))] for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(r.choice(pool))
        for _ in range(r.randint(0, len(w) // 4 + 1)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [word()] * r.randint(0, 1)
            w = w or [word()]
        rows.append(tuple(w))
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {x.doc_id: x.n_dropped for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), percent, distance=None).collect()}
    comp = list(range(len(rows)))
    top = lambda i: i if comp[i] == i else top(comp[i])
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a], rows[b]
        if min(len(x), len(y)) >= 3 and 100 * edits(x, y) <= (100 - percent) * max(len(x), len(y)):
            a, b = sorted((top(a), top(b)))
            comp[b] = a
    want = {i: int(top(i) != i) for i in range(len(rows))}
    assert got == want and 20 < sum(want.values()) < 220


@functools.cache
def some_counts(seed):
    return np.random.default_rng(seed).integers(0, 3, lines.SLOTS, dtype=np.uint8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=14), st.sampled_from([50, 67, 80, 90]), st.integers(0, 2**20))
def test_similar_lines_share_a_rare_gram(a, b, percent, seed):
    a, b = (np.asarray([zlib.crc32(bytes([w])) * 0x9E3779B97F4A7C15 % 2**64 for w in x], np.uint64) for x in (a, b))
    similar = lines.edit_similar(a, b, percent)
    assert lines.similar(a, b, percent) == similar
    counts = some_counts(seed % 2)
    gram, line = lines.rare_grams(np.concatenate([a, b]), np.asarray([len(a), len(b)]), percent, counts)
    if similar and min(len(a), len(b)) >= lines.gram_length(percent):
        assert set(gram[line == 0]) & set(gram[line == 1])


def test_lines_that_differ_in_numbers(spark):
    docs = ["12 34 56", "98 76 54", "1.5 2.5 3.5", "12, 34; 56", "on 2024 01 02 paid 17", "on 2023 11 30 paid 99", "the total of all items in this list is now 17", "The total of all items in this list is now 18"]
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), distance=None)
    assert [x.n_dropped for x in out.orderBy("doc_id").collect()] == [0, 0, 0, 1, 0, 0, 0, 1]


@pytest.mark.parametrize("edits_made", [1, 2])
def test_lines_with_a_few_changed_words_are_found(spark, edits_made):
    """Recall by lengths of 5 to 200 words, against edit similarity alone: each pair of a text's line and its changed copy."""
    r = random.Random(edits_made)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    often = [word() for _ in range(60)]
    sizes = [n for n in (5, 6, 8, 9, 10, 12, 15, 20, 30, 40, 80, 120, 200) if 5 * edits_made <= n]
    docs = []
    for n in sizes * 15:
        line = [r.choice(often) if r.random() < 0.6 else word() for _ in range(n)]
        other = list(line)
        for at in r.sample(range(n), edits_made):
            other[at] = word() + "q"
        docs += [" ".join(line), " ".join(other)]
    out = {x.doc_id: x.n_dropped for x in lines.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), distance=None).collect()}
    assert [i for i in range(1, len(docs), 2) if not out[i]] == [] and not any(out[i] for i in range(0, len(docs), 2))


def test_lines_of_large_families_with_many_edits_are_found(spark):
    """What varies in a family's lines must not crowd out what they share: seven of 40 words differ in each of 300 copies."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(40)]
    docs = []
    for i in range(300):
        w = list(base)
        for at in r.sample(range(40), 4):
            w[at] = word() + str(i)
        docs.append((i, " ".join(w)))
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), distance=None)
    assert out.filter("n_dropped = 0").count() == 1


def test_lines_of_one_id_with_several_texts(spark):
    names = ["_drops", "_of", "t", "Row", "drops", "key", "N_LINES"]
    one, two, three = "first line of the one text", "second line of the other text", "third line is nowhere else"
    rows = [(1, one), (2, f"{one}\n{two}"), (2, f"{three}\n{two}"), (3, f"short\n{two}")]
    df = spark.createDataFrame([(*x, *["kept"] * len(names)) for x in rows], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    out = lines.dedup_lines(df, distance=None)
    assert out.filter("_drops = 'kept' and row = 'kept' and t = 'kept'").count() == 4 and out.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_dropped"]
    got = sorted((x.doc_id, x.text) for x in out.collect())
    assert got[0] == (1, one) and got[-1] == (3, "short") and sorted(t for i, t in got if i == 2) in (sorted([two, three]), sorted(["", f"{three}\n{two}"]))


def test_line_tables_are_pigeonholes():
    for n in (1, 10**6, 10**8, 10**11):
        tables = lines.block_tables(n)
        r = random.Random(n)
        for _ in range(200):
            flips = sum(1 << b for b in r.sample(range(64), lines.DISTANCE))
            assert any(all(flips >> at & ((1 << width) - 1) == 0 for at, width in t) for t in tables)


def test_lines_edges(edge, none):
    out = lines.dedup_lines(edge)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS) and rows[1].n_dropped == 0 and rows[2].n_dropped == 2 and rows[2].text == "" and rows[3].text is None and rows[None].n_dropped == 0 and rows[7].text == "  \n\t \n " and rows[1].bucket == "kept"
    assert lines.dedup_lines(none).count() == 0


# --- 9 --------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=30))
def test_plan_uses_every_piece(counts):
    bins = packing.plan(counts, 64)
    used = Counter()
    for parts, k in bins:
        assert k > 0 and sum(parts) <= 64
        for p in parts:
            used[p] += k
    assert used == Counter(counts)
    n, least = sum(k for _, k in bins), -(-sum(a * b for a, b in counts.items()) // 64)
    assert least <= n <= 1.7 * least + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op9_packing(spark, DATA).collect()
    places, made = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        made.setdefault(r.doc_id, []).append(r)
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0, *[n for _, n in p]])[:-1]) and sum(n for _, n in p) <= 2048
    assert set(made) == set(docs)
    for i, text in docs.items():
        ids = np.asarray([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        ps = sorted(made[i], key=lambda r: r.piece)
        assert [r.start for r in ps] == list(range(0, len(ids), 2048)) and [r.piece for r in ps] == list(range(len(ps)))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + 2048].tobytes()) and r.length == len(ids[r.start : r.start + 2048]) for r in ps)
    assert len(places) <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def test_word_ids_are_the_tokenizers(spark):
    w = packing.WordIds(WORD_BPE)
    r = random.Random(4)
    texts = ["ΑΣ ΟΔΟΣ.", "a\x1cb", "café <|endoftext|>x y", "İ　Ǆ", "don't we'll 'S", "1234 5,6;7"] + ["".join(r.choice("abÀéß œ'.,!0 \n 日<|") for _ in range(40)) for _ in range(500)]
    assert w.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_edges(edge, none):
    out = packing.pack(edge, WORD_BPE, 2048, keep_ids=True).collect()
    assert {r.doc_id for r in out} == {i for i, _, _ in ROWS} and [r.length for r in out if r.doc_id == 3] == [1] and all(len(r.ids) == r.length for r in out)
    assert packing.pack(none, WORD_BPE).count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    got = queries.op10_sharding(spark, DATA).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = queries.op10_sharding(spark, DATA).collect()
    assert sorted(got) == sorted(again)


def test_shards_edges(spark, edge, none, tmp_path):
    out = shards.shuffle_into_shards(edge, 4, bucket_rows=3)
    rows = out.collect()
    assert len(rows) == len(ROWS) and Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in ROWS)
    assert max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1 and rows[0].bucket == "kept"
    assert shards.shuffle_into_shards(none, 4).count() == 0
    written = shards.write_shards(edge, str(tmp_path / "out"), 4)
    assert written.count() == len(ROWS)


def test_order_is_fixed_by_the_seed(spark):
    df = spark.createDataFrame([(i if i % 5 else None, f"text {i}", "x", "y") for i in range(900)], "doc_id long, text string, Shard string, SLOT string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts, n in (("2", 1), ("7", 5)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = shards.shuffle_into_shards(df.repartition(n), 3, seed=5, bucket_rows=40)
        assert out.columns == ["doc_id", "text", "shard", "slot"]
        found.append(sorted((r.shard, r.slot, r.text) for r in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] and len({t for _, _, t in found[0]}) == 900


def test_permutation_is_fisher_and_yates(spark):
    n, seeds = F.col("id").cast("int"), (F.lit(3), F.col("id"))
    draws = F.transform(F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.pmod(F.xxhash64(*seeds, i), (i + 1).cast("long")).cast("int"))
    for r in spark.range(1, 60).select("id", shards._permutation(n, *seeds).alias("p"), draws.alias("d")).collect():
        want = list(range(r.id))
        for i, j in zip(range(r.id - 1, 0, -1), r.d, strict=True):
            want[i], want[j] = want[j], want[i]
        assert r.p == want


def test_shuffle_is_uniform(spark):
    """Where each of 6 rows of one bucket lands, over many seeds: each place about equally often."""
    df = spark.range(6).withColumnRenamed("id", "doc_id").coalesce(1)
    seen = Counter()
    for seed in range(40):
        seen.update((r.doc_id, r.slot) for r in shards.shuffle_into_shards(df, 1, seed=seed).collect())
    assert len(seen) >= 34 and max(seen.values()) <= 20


# --- kernels --------------------------------------------------------------------------------------------------------


def test_words_and_shingles():
    texts = ["", None, "A b\x0bc", "a B c", "é  x", "x", "a b c a b c"]
    col = pa.array(texts)
    h, bounds, _ = hash_words(*utf8(col))
    assert np.diff(bounds).tolist() == [0, 0, 3, 3, 2, 1, 6] and (h[0:3] == h[3:6]).all() and len(set(h.tolist())) == 5
    s = shingle_sets(col, 2)
    assert [len(x) for x in s] == [0, 0, 2, 2, 1, 1, 3] and (s[2] == s[3]).all()
    part = shingle_sets(col.slice(2, 3), 2)
    assert all((a == b).all() for a, b in zip(part, s[2:5], strict=True))
