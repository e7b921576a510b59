"""Files of token ids: exact round trips, damage, and the query against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import idfiles, mixcoder, queries
from tests.conftest import DATA

TOKENIZER = "word_bpe_49k.json"


def coded(blocks):
    return mixcoder.encode([np.asarray(b, np.uint32) for b in blocks], list(range(len(blocks))), [b"d%d" % i for i in range(len(blocks))])


def same(blocks, out):
    assert len(blocks) == len(out)
    for i, (b, (ids, first, told)) in enumerate(zip(blocks, out, strict=True)):
        assert ids.tolist() == list(b) and first == i and told == b"d%d" % i


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 49407), st.integers(0, 2**32 - 1)), min_size=1, max_size=60), min_size=1, max_size=5))
def test_round_trip(blocks):
    same(blocks, mixcoder.decode(coded(blocks)))


def test_round_trip_of_whole_blocks():
    rng = np.random.default_rng(5)
    n = mixcoder.BLOCK
    blocks = [np.zeros(n), np.arange(n), rng.permutation(n), rng.integers(0, 3, n), rng.integers(0, 49408, n), rng.geometric(0.02, n), np.tile(np.arange(7), n // 7 + 1)[:n], [7], rng.zipf(1.3, 700) % 49408, rng.integers(0, 2**32, 2049), np.repeat(rng.integers(0, 9, 1200), 5)]
    blocks = [np.asarray(b).astype(np.uint32).tolist() for b in blocks]
    data = coded(blocks)
    same(blocks, mixcoder.decode(data))
    # bytes don't depend on what else is coded in the group
    assert [mixcoder.encode([np.asarray(b, np.uint32)], [i], [b"d%d" % i])[0] for i, b in enumerate(blocks[:3])] == data[:3]
    sizes = [len(d) for d in data]
    assert sizes[0] < 150 and sizes[6] < 400  # what repeats costs next to nothing
    assert sizes[4] < 2.6 * n  # what cannot be told: 14 bits of place in the list, and the list of nearly all that occur
    some = mixcoder.decode([data[i] for i in (5, 2, 9)])
    assert [x[0].tolist() for x in some] == [blocks[i] for i in (5, 2, 9)]


def test_carries():
    """Many short blocks of likely and unlikely ids: the low end of the range passes through runs of full digits."""
    rng = np.random.default_rng(8)
    blocks = [(rng.random(300) < p).astype(np.uint32).tolist() for p in np.linspace(0.001, 0.999, 900)]
    same(blocks, mixcoder.decode(coded(blocks)))


def test_any_damage_is_found():
    data = coded([[1, 2, 3, 1, 2, 3, 9] * 40])[0]
    for at in range(0, len(data), 3):
        for bad in (data[:at] + bytes([data[at] ^ 16]) + data[at + 1 :], data[:at]):
            with pytest.raises(mixcoder.Damaged):
                mixcoder.decode([bad])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70), max_size=6))
def test_joined_checksums(parts):
    assert idfiles.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def expected(docs, end=2):
    """{(doc_id, start, n, crc)} in the order of files: null ids first, then ascending."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    out, start = [], 0
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_against_tokenizer(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op12_id_files(spark, DATA).collect())) == expected(docs)


def written(spark, docs, tmp_path, **options):
    import public_tokenizers

    path = f"file://{tmp_path}/ids"
    idfiles.write_ids(docs, public_tokenizers.path(TOKENIZER), path, **options)
    return path


def test_long_documents_in_many_files(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 7919 + j * j) % 883}" for j in range(10 if i % 3 else 9000))) for i in range(60)]
    path = written(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tmp_path, file_bytes=200_000)
    assert sorted(map(tuple, idfiles.read_documents(spark, path).collect())) == expected(rows)
    blocks = spark.read.parquet(path)
    assert blocks.select("file").distinct().count() > 3 and blocks.agg({"n": "max"}).first()[0] == mixcoder.BLOCK
    pieces = idfiles.read_pieces(spark, path, keep_ids=True).collect()
    whole = {}
    for r in sorted(pieces, key=lambda r: (r.file, r["first"])):
        whole.setdefault(r.doc_id, []).extend(r.ids)
        assert r.n_tokens == len(r.ids)
    ends = {i: n for i, _, n, _ in expected(rows)}
    assert {i: len(v) for i, v in whole.items()} == ends and all(v[-1] == 2 for v in whole.values())
    # no document of fewer ids than a block is cut
    assert all(r.marks & (idfiles.BEGAN | idfiles.GOES_ON) == 0 for r in pieces if ends[r.doc_id] <= mixcoder.BLOCK)


def test_edges(spark, edge, none, tmp_path):
    path = written(spark, edge, tmp_path / "edge", end_id=40000)
    got = idfiles.read_documents(spark, path).collect()
    want = expected([(r.doc_id, r.text) for r in edge.collect()], 40000)
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, ((i, n, c) for i, _, n, c in want)))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    path = written(spark, none, tmp_path / "none")
    assert idfiles.read_documents(spark, path).count() == 0
