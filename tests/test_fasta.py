"""FASTA files cut anywhere: contigs, offsets and k-mers are those of the whole files."""

import contextlib
import gzip
import random

import pytest

from helixlake.operators import strata as S
from helixlake.operators.kmers import kmers
from helixlake.sources.genome import index, read_fasta, read_fasta_parts
from tests.test_kmers import canon, comp


def made(seed):
    """(file texts, [(name, bases)]): contigs of very different lengths, some without bases, lines of any width, junk first."""
    r = random.Random(seed)
    texts, contigs = [], []
    for f in range(3):
        lines = ["junk ACGT", ""] if f == 0 else []
        for i in range(r.randint(2, 5)):
            name = f"c{f}_{i}"
            s = "".join(r.choices("ACGTacgtN", k=r.choice([0, 3, 40, 700, 3000])))
            lines.append(f">{name} more > words")
            at = 0
            while at < len(s):
                n = r.choice([1, 7, 60])
                lines.append(s[at : at + n] + r.choice(["", " ", "\t"]))
                at += n
            lines += [""] * r.randint(0, 1)
            contigs.append((name, s.upper()))
        texts.append("\n".join(lines) + "\n" * r.randint(0, 1))
    return texts, contigs


@contextlib.contextmanager
def cut_at(spark, size):
    """Files read in splits of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for x in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{x}")


@pytest.mark.parametrize("splits", [700, 1 << 20])
def test_contigs_of_files_cut_anywhere(spark, tmp_path, splits):
    texts, contigs = made(splits)
    paths = []
    for i, t in enumerate(texts):
        path = tmp_path / f"{9 - i}.fa"  # the order is that of the paths given, not of names
        path.write_text(t)
        paths.append(str(path))
    with cut_at(spark, splits):
        whole, parts, some = read_fasta(spark, paths, "g"), read_fasta_parts(spark, paths, "g"), read_fasta_parts(spark, paths, "g", "_1")
    rows = whole.orderBy("contig_id").collect()
    starts, at = [], 0
    for _, s in contigs:
        starts.append(at)
        at += len(s)
    assert [(r.name, bytes(r.seq).decode(), r.len, r.start) for r in rows] == [(n, s, len(s), a) for (n, s), a in zip(contigs, starts, strict=True)]
    chosen = index(some).orderBy("contig_id").collect()
    assert [r.name for r in chosen] == [n for n, _ in contigs if "_1" in n] and chosen[0].start == 0
    if splits == 700:
        assert parts.groupBy("contig_id").count().agg({"count": "max"}).first()[0] > 3
    for k, stride, chunk in ((11, 1, 256), (300, 3, 512)):
        got = sorted((r.contig_id, r.lpos, r.pos) for r in kmers(parts, k, stride, chunk).collect())
        want = [(c, i, starts[n] + i) for n, ((_, s), c) in enumerate(zip(contigs, [r.contig_id for r in rows], strict=True)) for i, _ in canon(s, k) if (starts[n] + i) % stride == 0]
        assert got == sorted(want)


def test_strata_of_parts(spark, tmp_path):
    texts, contigs = made(7)
    (tmp_path / "q.fa").write_text(texts[0] + "\n" + texts[1])
    with gzip.open(tmp_path / "s.fa.gz", "wt") as f:
        f.write(">x\n" + comp(contigs[0][1].replace("N", "A")) + "\n" + texts[2])
    whole = read_fasta(spark, str(tmp_path / "q.fa"), "q").unionByName(read_fasta(spark, str(tmp_path / "s.fa.gz"), "s"))
    with cut_at(spark, 1000):
        parts = read_fasta_parts(spark, str(tmp_path / "q.fa"), "q").unionByName(read_fasta_parts(spark, str(tmp_path / "s.fa.gz"), "s"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.strata(parts, "q", ["s"], 15)) == rows(S.strata(whole, "q", ["s"], 15)) != []
