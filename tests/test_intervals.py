"""Interval and segment operators against dense arrays."""

import random

from pyspark.sql import functions as F

from helixlake.operators import align, arrays, intervals, segments, summaries

SUBJECTS = ["hg002", "chimp"]


def some_intervals(seed, n=60, length=900):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(-20, length)
        out.append((r.randrange(2), s, s + r.randrange(1, 120), r.choice("abc"), i))
    return out


def test_paint(spark):
    rows = some_intervals(1)
    iv = spark.createDataFrame(rows, "contig_id long, start long, end long, class string, ord long")
    contigs = spark.createDataFrame([(0, 900), (1, 700)], "contig_id long, len long")
    pieces = intervals.disjoint(intervals.clip(iv, contigs))
    want = {c: ["none"] * n for c, n in ((0, 900), (1, 700))}
    for c, s, e, x, _ in rows:
        for p in range(max(s, 0), min(e, len(want[c]))):
            want[c][p] = x
    every = contigs.select("contig_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("lpos"))
    got = {(r.contig_id, r.lpos): r["class"] for r in intervals.paint(every, pieces, default="none").collect()}
    assert got == {(c, p): x for c, xs in want.items() for p, x in enumerate(xs)}


def test_merge_and_largest(spark):
    rows = some_intervals(2, 40, 4000)
    iv = spark.createDataFrame(rows, "contig_id long, start long, end long, class string, ord long")
    for gap in (None, 30):
        want = []
        for c in (0, 1):
            for s, e in sorted((s, e) for c2, s, e, _, _ in rows if c2 == c):
                if want and want[-1][0] == c and (s <= want[-1][2] if gap is None else s - want[-1][2] < gap):
                    want[-1][2] = max(want[-1][2], e)
                else:
                    want.append([c, s, e])
        assert sorted([r.contig_id, r.start, r.end] for r in intervals.merge(iv, gap).collect()) == want
    for r in intervals.largest(iv).collect():
        best = max((x for x in rows if x[3] == r["class"]), key=lambda x: (x[2] - x[1], -x[0], -x[4]))
        assert (r.contig_id, r.start, r.end) == best[:3]


def test_islands_across_blocks(spark):
    r = random.Random(3)
    rows, want = [], set()
    for c, start in ((0, 0), (1, 500)):
        run = {}
        for p in range(500):
            pres = r.choice([0, 1, 3, 3, 3, 2])
            pos = start + p
            if pos % 2 == 0 and pres:
                rows.append((c, p, pos, pres))
            for bit, s in ((1, "hg002"), (2, "chimp")):
                if pos % 2 == 0:
                    if pres & bit:
                        a = run.setdefault(s, [p, p, pres])
                        a[1], a[2] = p, a[2] & pres
                    elif s in run:
                        want.add((s, c, *run.pop(s)))
        want |= {(s, c, *a) for s, a in run.items()}
    df = spark.createDataFrame(rows, "contig_id long, lpos long, pos long, pres int")
    for block in (64, 1 << 20):
        got = {(x.subject, x.contig_id, x.first, x.last, x.every) for x in segments.islands(df, SUBJECTS, 2, block).collect()}
        assert got == want


def test_tables_agree(spark):
    r = random.Random(4)
    rows = [(r.choice(["unique", "ct"]), r.randrange(4), r.choice([1, 1, 2, 5, 255])) for _ in range(500)]
    cells = summaries.cube(spark.createDataFrame(rows, "class string, pres int, mult int"))
    for x in summaries.class_sharing(cells, SUBJECTS).collect():
        assert x.human_specific + x.chm13_only + x.ape_any == x.valid_positions == x.unique_in_query + x.multi_in_query
    ages = {x["class"]: x for x in summaries.age_table(cells, SUBJECTS).collect()}
    a = ages["ALL"]
    assert a.positions == 500 == a.chm13_only + a.human_specific + a.pan + a.gorilla + a.pongo + a.hylobatid + a.not_in_hg002_but_in_ape
    assert sum(x.positions for x in summaries.by_multiplicity(cells, SUBJECTS).filter("class = 'ALL'").collect()) == 500


def test_array_table_uses_pieces_only(spark):
    iv = spark.createDataFrame([(0, 0, 10), (0, 14, 20), (0, 60, 70)], "contig_id long, start long, end long")
    rows = spark.createDataFrame([(0, p, p, 2 if p < 10 else 3, 1 + p % 2) for p in range(80)], "contig_id long, lpos long, pos long, pres int, mult int")
    got = {(r.start, r.end): r for r in arrays.array_table(rows, iv, SUBJECTS, 5).collect()}
    assert set(got) == {(0, 20), (60, 70)}
    assert got[0, 20].n == 16 and got[0, 20].shared_pct["chimp"] == 100 and got[0, 20].shared_pct["hg002"] == 37.5 and got[0, 20].closest_ape == "chimp"


def test_alignment_runs(spark):
    r = random.Random(5)
    rows, want, k = [], set(), 7
    for a in range(30):
        ops = [(r.randrange(1, 15), r.choice("===XID")) for _ in range(r.randrange(1, 9))]
        used = sum(n for n, o in ops if o != "D")
        start = r.randrange(50)
        strand = r.choice("+-")
        rows.append((a, start, start + used, strand, "".join(f"{n}{o}" for n, o in ops), r.choice("PS")))
        ok, cut, i = [], set(), 0
        for n, o in ops:
            if o == "D":
                cut.add(i)  # no window may cross this border
            else:
                ok += [o == "="] * n
                i += n
        if strand == "-":
            ok, cut = ok[::-1], {used - c for c in cut}
        for p in range(used - k + 1):
            if all(ok[p : p + k]) and not any(p < c < p + k for c in cut):
                want.add((a, start + p))
    df = spark.createDataFrame(rows, "aln int, qstart long, qend long, strand string, cigar string, tp string")
    assert {(x.aln, x.p) for x in align.exact_starts(df, k).collect()} == want
    # two contigs with alignments of their own: the counts by hand, position by position
    contig = lambda a: a % 2
    placed = df.withColumn("contig_id", (F.col("aln") % 2).cast("long"))
    rest = random.Random(5)
    told = {(c, p): (rest.random() < 0.8, rest.random() < 0.5, rest.randint(1, 2)) for c in (0, 1) for p in range(200)}
    pos = spark.createDataFrame([(c, p, *x) for (c, p), x in told.items()], "contig_id long, lpos long, valid boolean, present boolean, mult int")
    count = dict.fromkeys(["valid", "present", "exact", "exact_present", "broken", "broken_present", "broken_single", "broken_single_present", "uncovered", "uncovered_present"], 0)
    for (c, p), (valid, present, mult) in told.items():
        if not valid:
            continue
        mine = [r for r in rows if contig(r[0]) == c]
        exact = any((r[0], p) in want for r in mine)
        main = [r for r in mine if r[5] == "P"]
        whole = [r for r in main if r[1] <= p and p + k <= r[2]]
        groups = {"valid": True, "exact": exact, "broken": bool(whole) and not exact and (max(whole)[0], p) not in want, "uncovered": not any(r[1] <= p < r[2] for r in main)}
        groups["broken_single"] = groups["broken"] and mult == 1
        for g, yes in groups.items():
            count[g] += yes
            count["present" if g == "valid" else f"{g}_present"] += yes and present
    got = align.concordance(placed, pos, k).first().asDict()
    assert got == count and min(count.values()) > 0
    names = spark.createDataFrame([("c0", 0, 10), ("c1", 1, 20)], "name string, contig_id long, start long")
    named = align.place(placed.drop("contig_id").withColumn("qname", F.concat(F.lit("c"), (F.col("aln") % 3).cast("string"))), names)
    assert {(r.qname, r.contig_id, r.offset) for r in named.collect()} == {("c0", 0, 10), ("c1", 1, 20)}


def test_spotlights(spark):
    rows = [(0, 100, 130, "bsat", 0), (0, 400, 900, "bsat", 1), (1, 10, 60, "rDNA", 2), (1, 50, 400, "SD", 3), (1, 400, 700, "SD", 4), (0, 0, 500, "SD", 5)]
    iv = spark.createDataFrame(rows, "contig_id long, start long, end long, class string, ord long")
    contigs = spark.createDataFrame([("a", 0, 950), ("b", 1, 800)], "name string, contig_id long, len long")
    got = {r.id: (r.contig_id, r.start, r.end) for r in intervals.spotlights(iv, contigs, [("f", "b", 700, 5000), ("g", "z", 0, 9)], ["bsat"], ["rDNA"], flank=200, pad=100, longest=600).collect()}
    assert got == {"f": (1, 700, 800), "bsat_block": (0, 450, 850), "rDNA_edge": (1, 0, 210), "sd_largest": (1, 50, 650)}
