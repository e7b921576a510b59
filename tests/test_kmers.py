"""Strata against sets and dictionaries, over mosaic genomes and a matrix of k, stride and plan."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import ladder
from helixlake.operators import strata as S
from helixlake.operators.kmers import bloom, kmers, spectrum, window_hashes
from helixlake.sources.genome import read_bed, read_fasta, read_index, read_paf, with_starts
from helixlake.sources.randgen import random_genome


def comp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def mosaic(seed, sizes):
    """Genomes as mosaics: each contig is a row of bricks from one library, some turned round, some with changed letters,
    with letters of all kinds in the joints. Returns {genome: {contig: text}}; what is shared follows from the bricks alone."""
    r = random.Random(seed)
    library = ["".join(r.choices("ACGT", weights=r.choices(range(1, 6), k=4), k=r.randint(25, 420))) for _ in range(14)]
    library += [x + comp(x) for x in library[:2]]  # their middles are their own reverse complements

    def brick():
        x = r.choice(library)
        x = comp(x) if r.random() < 0.4 else x
        for _ in range(r.choice([0, 0, 1, 3])):
            at = r.randrange(len(x))
            x = x[:at] + r.choice(["A", "c", "", "GT", "n", "R"]) + x[at + 1 :]
        return x.lower() if r.random() < 0.1 else x

    joint = lambda: r.choice(["", "N", "nnnn", "ACGTAC", "y", "T" * 30])
    return {g: {f"{g}{i}": "".join(brick() + joint() for _ in range(n)) for i, n in enumerate(rows)} for g, rows in sizes.items()}


def contigs_of(spark, genomes):
    rows = [(g, i, n, bytearray(re.sub("[^ACGT]", "N", s.upper()).encode())) for g, cs in genomes.items() for i, (n, s) in enumerate(cs.items())]
    return with_starts(spark.createDataFrame(rows, "genome string, contig_id long, name string, seq binary"))


def canon(s, k):
    for i in range(len(s) - k + 1):
        w = s[i : i + k].upper()
        if set(w) <= set("ACGT"):
            yield i, min(w, comp(w))


@pytest.fixture(scope="module")
def genomes():
    return mosaic(7, {"q": [22, 9, 0, 1], "s1": [6, 14], "s2": [11]})


@pytest.mark.parametrize("k,stride,small", [(1, 1, False), (5, 7, False), (15, 2, False), (31, 1, False), (32, 5, False), (33, 3, False), (64, 1, False), (127, 10, False), (300, 6, False), (18, 1, True), (32, 9, True), (40, 1, True)])
def test_strata(spark, genomes, k, stride, small):
    c = contigs_of(spark, genomes)
    got = {(r.contig_id, r.lpos): (r.pres, r.mult, r.mult_full) for r in S.strata(c, "q", ["s1", "s2"], k, stride, small_query=small).collect()}
    own, start, want = {}, 0, {}
    for s in genomes["q"].values():
        for _, w in canon(s, k):
            own[w] = own.get(w, 0) + 1
    sets = [{w for s in genomes[g].values() for _, w in canon(s, k)} for g in ("s1", "s2")]
    for ci, s in enumerate(genomes["q"].values()):
        for i, w in canon(s, k):
            if (start + i) % stride == 0:
                want[ci, i] = (sum(1 << j for j, x in enumerate(sets) if w in x), min(own[w], 255), own[w])
        start += len(s)
    assert got == want


@pytest.mark.parametrize("stride", [1, 5])
def test_a_ladder_is_its_rungs(spark, genomes, stride):
    c, ks = contigs_of(spark, genomes), [7, 32, 33, 90]
    ladder = S.strata_ladder(c, "q", ["s1", "s2"], ks, stride)
    for k in ks:
        one = S.strata(c, "q", ["s1", "s2"], k, stride)
        assert sorted(map(tuple, ladder.filter(F.col("k") == k).drop("k").collect())) == sorted(map(tuple, one.collect()))


def test_bases_are_dealt_once(spark, genomes):
    """All uses of all k share one exchange of bases, and keys of k up to 32 are 8 bytes."""
    c = contigs_of(spark, genomes)
    for df in (S.strata(c, "q", ["s1", "s2"], 21), S.strata_ladder(c, "q", ["s1", "s2"], [16, 31, 101])):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("REPARTITION_BY_NUM") == 1 + plan.count("ReusedExchange [genome") and "ReusedExchange [genome" in plan
    assert dict(kmers(c, 32).dtypes)["key"] == "bigint" and dict(kmers(c, 33).dtypes)["key"].startswith("struct")


def test_packed_keys_are_the_letters(spark):
    texts = {"q": {"a": "".join(random.Random(5).choices("ACGT", k=300)) + "N" + "ACGT" * 40}}
    for k in (1, 2, 3, 16, 17, 31, 32):
        number = lambda w: sum("ACGT".index(x) << 2 * (len(w) - 1 - i) for i, x in enumerate(w))
        got = {r.lpos: r.key % 2**64 for r in kmers(contigs_of(spark, texts), k, chunk=64).collect()}
        assert got == {i: min(number(w), number(comp(w))) for i, w in canon(texts["q"]["a"], k)}


def test_survival_by_shrinking(spark, genomes):
    c, ks, subjects = contigs_of(spark, genomes), [9, 20, 33, 60, 100, 250], ["s1", "s2"]
    want = {}
    for ci, s in enumerate(genomes["q"].values()):
        for i in range(len(s)):
            for name in subjects:
                want[ci, i, name] = 255 if i + ks[0] > len(s) else 0
    for rung, k in enumerate(ks, 1):
        sets = {g: {w for s in genomes[g].values() for _, w in canon(s, k)} for g in subjects}
        for ci, s in enumerate(genomes["q"].values()):
            for i, w in canon(s, k):
                for g in subjects:
                    if w in sets[g]:
                        want[ci, i, g] = rung
    for step in (1, 4):
        got = {(r.contig_id, r.lpos, r.subject): r.surv for r in ladder.survival(c, "q", subjects, ks, step).collect()}
        assert got == want
    # what a pass cuts is bounded by what the pass before it left, and nothing is cut where nothing is left
    left, seen = None, 0
    for some, rows, hits in ladder.shrinking(c, "q", subjects, ks, 1):
        cut = rows.count()
        assert left is None or cut <= left
        left, seen = hits.count(), seen + 1
        assert {(r.contig_id, r.lpos) for r in hits.filter("tag = 0").collect()} == {(ci, i) for (ci, i, g), v in want.items() if v != 255 and v >= seen}
    assert left < 2000 and seen > 2
    alone = {"q": {"a": "ACGTTGCA" * 4}, "s": {"b": "C" * 50}}
    assert [some for some, _, _ in ladder.shrinking(contigs_of(spark, alone), "q", ["s"], ks)] == [[9]]


def test_bloom_filter_lets_its_keys_through(spark):
    r = np.random.default_rng(9)
    inside, outside = (r.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    rows = spark.createDataFrame([(int(x),) for x in inside.view(np.int64)], "key long").repartition(5)
    for expected, most in ((20_000, 0.05), (100, 1.0)):  # too small a filter lets more through, and loses nothing
        f = bloom(rows, expected).value
        assert f.has(inside).all() and f.has(outside).mean() <= most


def test_spectrum_and_stats(spark, genomes):
    c = contigs_of(spark, genomes)
    rows = spectrum(kmers(c, 21)).filter("genome = 'q'").collect()
    valid = sum(1 for s in genomes["q"].values() for _ in canon(s, 21))
    assert sum(r.mult * r.kmers for r in rows) == valid
    m = S.run_meta(c, "q", ["s1", "s2"], 21, 4).first()
    assert m.query_distinct == sum(r.kmers for r in rows) and m.query_length == sum(map(len, genomes["q"].values()))
    st = S.strata(c, "q", ["s1", "s2"], 21, 4)
    assert m.valid_entries == st.count()
    assert [x.shared_entries for x in m.subjects] == [st.filter(F.col("pres").bitwiseAND(b) != 0).count() for b in (1, 2)]
    small = {r.subject: r.distinct_kmers for r in S.subject_stats(c, "q", ["s1", "s2"], 21, small_query=True).collect()}
    full = {r.subject: r.shared_distinct for r in S.subject_stats(c, "q", ["s1", "s2"], 21).collect()}
    assert small == full


def test_edges(spark):
    c = contigs_of(spark, {"q": {"a": "A" * 400, "b": "", "c": "ACG"}, "s": {"x": "T" * 40}})
    rows = S.strata(c, "q", ["s"], 32).collect()
    assert {(r.pres, r.mult, r.mult_full) for r in rows} == {(1, 255, 369)}
    d = S.dense(S.strata(c, "q", ["s"], 32, 8), c, "q", 8)
    assert d.count() == len([p for p in range(403) if p % 8 == 0])
    assert {r.mult for r in S.strata(c, "q", [], 5, own=False).collect()} == {0}
    with pytest.raises(ValueError):
        S.strata(c, "q", [str(i) for i in range(9)], 5)
    with pytest.raises(ValueError):
        kmers(c, 0)


def test_reverse_complement_is_the_same_subject(spark, genomes):
    flipped = {"q": genomes["q"], "s": {n: comp(re.sub("[^ACGT]", "N", s.upper())) for n, s in genomes["q"].items()}}
    rows = S.strata(contigs_of(spark, flipped), "q", ["s"], 31)
    assert rows.filter("pres = 0").count() == 0


def test_fasta_bed_paf(spark, tmp_path):
    text = "junk\n>a one\nACGTnn\nacgt r\n>b\n\n>chrX y\nGG\n"
    for path in (tmp_path / "g.fa", tmp_path / "g.fa.gz"):
        (gzip.open(path, "wt") if path.suffix == ".gz" else open(path, "w")).write(text)
        rows = read_fasta(spark, str(path), "g").orderBy("contig_id").collect()
        assert [(r.name, bytes(r.seq).decode(), r.start) for r in rows] == [("a", "ACGTNNACGTN", 0), ("b", "", 11), ("chrX", "GG", 11)]
    only = read_fasta(spark, str(tmp_path / "g.fa"), "g", include="chr").collect()
    assert [(r.name, r.start) for r in only] == [("chrX", 0)]
    (tmp_path / "g.idx").write_text("a\t0\t11\n")
    assert read_index(spark, str(tmp_path / "g.idx")).first().len == 11
    (tmp_path / "x.bed").write_text("track name=x\n#c\nchr1\t5\t9\thor_1_1(S1C1H1L)\nchr1\t9\t12\tjunk\n")
    assert [tuple(r)[:4] for r in read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("chr1", 5, 9, "hor_active")]
    (tmp_path / "x.paf").write_text("\t".join(["q", "9", "0", "9", "+", "t", "9", "0", "9", "9", "9", "60", "tp:A:P", "cg:Z:9="]) + "\n")
    r = read_paf(spark, str(tmp_path / "x.paf")).first()
    assert (r.qend, r.tags["cg:Z"], r.tags["tp:A"]) == (9, "9=", "P")


def test_random_genome(spark):
    g = {r.contig_id: bytes(r.seq).decode() for r in random_genome(spark, 70, 3, 33).collect()}
    state, want = (3 * 0x9E3779B97F4A7C15 + 0x12345678) % 2**64, []
    for n in (33, 33, 4):
        s = ""
        while len(s) < n:
            state = (state + 0x9E3779B97F4A7C15) % 2**64
            z = state
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
            z ^= z >> 31
            s += "".join("ACGT"[(z >> (2 * j)) & 3] for j in range(32))
        want.append(s[:n])
    assert [g[i] for i in range(3)] == want


def test_window_hashes_tell_windows_apart():
    r = np.random.default_rng(3)
    codes = r.integers(0, 2, 700)
    codes[300:600] = codes[:300]
    for k in (33, 63, 64, 100, 129, 255):
        h = window_hashes(codes, k, 1)
        kinds = {}
        for i, x in enumerate(h.tolist()):
            kinds.setdefault(bytes(codes[i : i + k].tolist()), set()).add(x)
        assert all(len(v) == 1 for v in kinds.values()) and len(set(h.tolist())) == len(kinds) < len(h)
        assert len(set(window_hashes(codes, k, 2).tolist()) & set(h.tolist())) == 0


def test_starts_over_many_spans(spark):
    rows = [("g", i * 1000 + i % 7, i % 13) for i in range(300)] + [("h", 5, 9)]
    df = spark.createDataFrame([(g, c, "n", bytearray(b"A" * n)) for g, c, n in rows], "genome string, contig_id long, name string, seq binary")
    got = {(r.genome, r.contig_id): r.start for r in with_starts(df).collect()}
    at = 0
    for g, c, n in sorted(rows[:300], key=lambda x: x[1]):
        assert got[g, c] == at
        at += n
    assert got["h", 5] == 0
