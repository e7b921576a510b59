"""Links between the members of buckets by stars, exactly, and connected groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.llm.arrowio import SMALL, slices
from helixlake.plans.staging import stage, unstage

#: Up to so many ids (16 MB as a hash table) are broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members that one task compares with one copy of their centre.
MEMBERS = 256
#: Members of a bucket that one task holds against each other by their sketches.
HELD = 1024
#: Rounds of stars, each with other centres, before families are compared.
ROUNDS = 3
#: With traits, another round is made only where the last one linked one in so many of the rows that are left, or more.
WORTH = 100


@dataclass(frozen=True)
class Sketches:
    """The condition near for arrays. columns(trait): a trait's numbers, as Columns; of(features): the same of members' features, a
    row each; near(a, b): whether rows of a and b, of which one may be single, are near."""

    columns: Callable[[Column], list[Column]]
    of: Callable[[list[np.ndarray]], np.ndarray]
    near: Callable[[np.ndarray, np.ndarray], np.ndarray]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for edges (u, v): comp is the smallest node reachable. Alternating large and small stars, staged each round,
    until a round changes nothing, which is seen from sums taken as it is written."""
    e = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = Observation()
        new = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = new.observe(after, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        was, e = e, stage(new, "edges")
        unstage(was)
        if after.get == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = after.get


def confirm(edges: DataFrame, texts: Callable[[DataFrame], DataFrame], features: Callable[[pa.Array], list[np.ndarray]], linked: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The edges (center, member) whose whole texts are linked.

    Each centre's text goes once to each group of about MEMBERS of its members and is compared while they stream by,
    so a centre of any number of members neither gathers in one task nor is copied for each edge.
    """
    found = texts(edges.select(F.explode(F.array("center", "member")).alias("id")).distinct())
    sizes = edges.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    dealt = edges.join(sizes, "center").select("center", "member", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part"))
    members = dealt.join(found.withColumnRenamed("id", "member"), "member").select("center", "part", "member", "text")
    centers = sizes.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    centers = centers.join(found.withColumnRenamed("id", "center"), "center").select("center", "part", F.lit(None).cast("long").alias("member"), "text")

    def compare(batches):
        at, own = None, []
        for batch in batches:
            for b in slices(batch, budget=SMALL):
                got = {"center": [], "member": []}
                for c, p, m, x in zip(b.column("center").to_pylist(), b.column("part").to_pylist(), b.column("member").to_pylist(), features(b.column("text")), strict=True):
                    if (c, p) != at:
                        at, own = (c, p), []
                    if m is None:
                        own.append(x)
                    elif any(linked(o, x) for o in own):
                        got["center"].append(c)
                        got["member"].append(m)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got.values()], names=list(got))

    rows = centers.unionByName(members).repartition("center", "part").sortWithinPartitions("center", "part", F.col("member").asc_nulls_first())
    return rows.mapInArrow(compare, "center long, member long").distinct()


def link_buckets(buckets: DataFrame, near: Callable, texts: Callable[[DataFrame], DataFrame], features: Callable, linked: Callable, traits: DataFrame | None = None, sketches: Sketches | None = None) -> DataFrame:
    """(node, comp) over the links between members of a same bucket. buckets: (bucket, member, trait), or (bucket, member) with traits: (member, trait).

    near(trait, trait) is a cheap necessary condition as a Column; texts(ids) gives (id, text) of ids (id); features and
    linked confirm a pair on whole texts. Stars come first: each bucket's smallest member with its others, confirmed.
    It then leaves the bucket, and a bucket whose other members are in one group is done. This is repeated ROUNDS times with
    the next members as centres. What is left forms families through the buckets they share, and every pair of a
    family's different groups is compared, in blocks, inside tasks: no link is lost, and rows stay in proportion to
    members and blocks, not to pairs. With traits, near must be selective (few pairs but links pass it, and most members
    share no bucket): only members that share one get their trait. Rounds of stars go on while they link many, and then members of
    different groups meet by a join on buckets under near instead, which gives no more rows than such pairs. With `sketches`, near for
    use inside tasks, such groups form families instead, whose members are compared in blocks: rows stay in proportion to
    members and blocks, however many pairs are near.
    """
    if traits is not None:
        return _link_selective(buckets, near, texts, features, linked, traits, sketches)
    alone = F.struct("member", "trait", F.col("member").alias("comp"))
    met = buckets.withColumn("comp", F.col("member")).withColumn("low", _least(alone)).filter(F.col("member") != F.col("low.member"))
    met = rest = stage(met, "met")
    links = groups = None
    for _ in range(ROUNDS):
        stars = met.filter((F.col("comp") != F.col("low.comp")) & near(F.col("low.trait"), F.col("trait")))
        stars = stage(stars.select(F.col("low.member").alias("center"), "member").distinct(), "stars")
        new = confirm(stars, texts, features, linked)
        was, links = links, stage(new if links is None else links.unionByName(new), "links")
        gone, groups = groups, stage(components(_as_edges(links)), "groups")
        now = met.select("bucket", "member", "trait").join(groups.withColumnRenamed("node", "member"), "member", "left").withColumn("comp", F.coalesce("comp", "member"))
        done, rest = rest, stage(_mixed(now, F.struct("member", "trait", "comp")), "rest")
        for x in (stars, was, gone, done):
            unstage(x)
        if rest.isEmpty():
            unstage(links)
            return groups
        met = rest.filter(F.col("member") != F.col("low.member"))
    families = components(met.select(F.col("low.member").alias("u"), F.col("member").alias("v")).distinct())
    members = stage(rest.select("member", "comp").distinct().join(families.select(F.col("node").alias("member"), F.col("comp").alias("family")), "member"), "members")
    more = stage(_compare_families(members, texts, features, linked), "more")
    return groups if more.isEmpty() else components(_as_edges(links.unionByName(more)))


def _least(what: Column | str) -> Column:
    return F.min(what).over(Window.partitionBy("bucket"))


def _mixed(rows: DataFrame, own: Column) -> DataFrame:
    """The rows of buckets whose members are in several groups, with each bucket's smallest `own` as low. One sort tells both, so a
    bucket's rows neither meet its sums nor its first member by a join."""
    told = rows.select("*", _least("comp").alias("a"), F.max("comp").over(Window.partitionBy("bucket")).alias("b"), _least(own).alias("low"))
    return told.filter("a < b").drop("a", "b")


def _as_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("center").alias("u"), F.col("member").alias("v"))


def _shared(batches):
    """(bucket, top, member) of each bucket's members but one, top, from rows sorted by bucket."""
    bucket = top = None
    for batch in batches:
        b, m = batch.column("bucket").to_numpy(), batch.column("member").to_numpy()
        if not len(b):
            continue
        old = b == bucket  # buckets that began in an earlier batch come first
        run = np.concatenate(([0], np.cumsum(b[1:] != b[:-1])))
        size = np.bincount(run)
        use = np.flatnonzero((size[run] > 1) | old)
        use = use[np.lexsort((m[use], run[use]))]
        same = np.zeros(len(use), bool)
        same[1:] = run[use[1:]] == run[use[:-1]]
        heads = m[use][np.maximum.accumulate(np.where(same, 0, np.arange(len(use))))] if len(use) else m[:0]
        heads = np.where(old[use], top, heads) if old[0] else heads
        if b[-1] != bucket:
            last = use[run[use] == run[-1]]
            bucket, top = b[-1], (m[last[0]] if len(last) else m[-1])
        new = m[use] != heads
        new[1:] &= ~(same[1:] & (m[use[1:]] == m[use[:-1]]))
        use, heads = use[new], heads[new]
        yield pa.RecordBatch.from_arrays([pa.array(b[use]), pa.array(heads), pa.array(m[use])], names=["bucket", "top", "member"])


def _link_selective(buckets: DataFrame, near: Callable, texts: Callable, features: Callable, linked: Callable, traits: DataFrame, sketches: Sketches | None) -> DataFrame:
    """link_buckets with traits. Most buckets have one member only: their rows, which may repeat, are dealt and sorted once."""
    live = buckets.repartition("bucket").sortWithinPartitions("bucket")
    met = rest = stage(live.mapInArrow(_shared, "bucket long, top long, member long"), "live")
    lows = traits.select(F.col("member").alias("center"), F.col("trait").alias("low"))
    stars = met.select(F.col("top").alias("center"), "member")
    links = groups = None
    for _ in range(ROUNDS):
        stars = stars.distinct().join(traits, "member").join(lows, "center").filter(near(F.col("low"), F.col("trait")))
        stars = stage(stars.select("center", "member"), "stars")
        new = stage(confirm(stars, texts, features, linked), "links")
        links = new if links is None else links.unionByName(new)
        gone, groups = groups, stage(components(_as_edges(links)), "groups")
        # each centre has met its bucket's others, so only these are left, where they are of several groups
        now = met.join(groups.withColumnRenamed("node", "member"), "member", "left").select("bucket", "member", F.coalesce("comp", "member").alias("comp"))
        done, rest = rest, stage(_mixed(now, F.struct("member", "comp")), "rest")
        for x in (stars, gone, done):
            unstage(x)
        if rest.isEmpty():
            return groups
        if WORTH * new.count() < rest.count():
            break
        met = rest.filter(F.col("member") != F.col("low.member")).select("bucket", "member", "comp", F.col("low.member").alias("center"), F.col("low.comp").alias("other"))
        stars = met.filter("comp <> other").select("center", "member")
        met = met.select("bucket", "member")
    one = rest.drop("low").join(traits, "member")
    if sketches is not None:
        families = components(stage(_near_groups(one, sketches), "near")).select(F.col("node").alias("comp"), F.col("comp").alias("family"))
        members = stage(rest.select("member", "comp").distinct().join(families, "comp"), "members")
        unstage(rest)
        more = stage(_compare_families(members, texts, features, linked, sketches), "more")
        return groups if more.isEmpty() else components(_as_edges(links.unionByName(more)))
    two = one.select("bucket", F.col("member").alias("m2"), F.col("trait").alias("t2"), F.col("comp").alias("c2"))
    meet = (one["bucket"] == two["bucket"]) & (F.col("member") < F.col("m2")) & (F.col("comp") != F.col("c2")) & near(F.col("trait"), F.col("t2"))
    pairs = stage(one.join(two, meet).select(F.col("member").alias("center"), F.col("m2").alias("member")).distinct(), "pairs")
    more = stage(confirm(pairs, texts, features, linked), "more")
    unstage(rest)
    unstage(pairs)
    return groups if more.isEmpty() else components(_as_edges(links.unionByName(more)))


def _near_groups(rows: DataFrame, sketches: Sketches) -> DataFrame:
    """(u, v): groups (comp) that have near members in a bucket, as many of these as connect them all. rows: (bucket, member, comp,
    trait). Buckets of over HELD members are cut into blocks, and a task holds one of them against another or itself."""
    count = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HELD).select("bucket", F.ceil(F.col("n") / HELD).cast("int").alias("blocks"))
    dealt = rows.join(count, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("member"), "blocks").cast("int"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    numbers = [c.cast("long").alias(f"w{i}") for i, c in enumerate(sketches.columns(F.col("trait")))]
    dealt = dealt.select("bucket", "own", "comp", *numbers, F.explode(with_each).alias("x")).select("bucket", "x.i", "x.j", "own", "comp", *[f"w{i}" for i in range(len(numbers))])

    def edges(cols):
        bucket, i, j, own, comp, *w = cols
        w = np.stack(w, 1)
        new = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        task = np.concatenate(([0], np.cumsum(new)))
        _, label = np.unique(np.stack((task, comp)), axis=1, return_inverse=True)
        label, over, found = label.ravel(), np.arange(len(task)), []

        def top(x):
            while over[x] != x:
                over[x] = x = over[over[x]]
            return x

        for d in range(1, int(np.bincount(task).max())):
            a = np.flatnonzero((task[d:] == task[:-d]) & (label[d:] != label[:-d]))
            a = a[(i[a] == j[a]) | (own[a] != own[a + d])]
            a = a[sketches.near(w[a], w[a + d])]
            for x in a.tolist():
                p, q = top(label[x]), top(label[x + d])
                if p != q:
                    over[max(p, q)] = min(p, q)
                    found.append((comp[x], comp[x + d]))
            if len(a):
                while (over[over] != over).any():
                    over = over[over]
                label = over[label]
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            last = int(other[-1]) + 1 if len(other) else 0  # the last task's rows may go on
            held = [c[last:] for c in cols]
            if last:
                yield edges([c[:last] for c in cols])
        if held is not None:
            yield edges(held)

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "u long, v long").distinct()


def _compare_families(members: DataFrame, texts: Callable[[DataFrame], DataFrame], features: Callable, linked: Callable, sketches: Sketches | None = None) -> DataFrame:
    """Links (center, member) between different groups (comp) of a family. members: (member, comp, family).

    A family's largest group is side 0, all others side 1. Both are cut into blocks of about MEMBERS; a task compares
    one block with another (or with itself), which meets each pair of sides 0 and 1 and of side 1 once. Nothing is
    compared within side 0. A member goes to as many tasks as its blocks meet. With sketches, only near pairs are compared.
    """
    sizes = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / MEMBERS).cast("int")
    main = main.select("family", F.col("top.comp").alias("main"), blocks(F.col("top.n")).alias("n0"), F.greatest(blocks(F.col("all") - F.col("top.n")), F.lit(1)).alias("n1"))
    dealt = members.join(main, "family").withColumn("side", (F.col("comp") != F.col("main")).cast("int"))
    own = F.pmod(F.xxhash64("member"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    dealt = dealt.withColumn("own", own)
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    pair = lambda a, i, b, j: F.struct(a.cast("int").alias("a"), i.cast("int").alias("i"), b.cast("int").alias("b"), j.cast("int").alias("j"))
    zero, one = F.lit(0), F.lit(1)
    across = F.when(F.col("side") == 0, F.transform(upto(F.col("n1")), lambda j: pair(zero, F.col("own"), one, j))).otherwise(F.concat(F.transform(upto(F.col("n0")), lambda i: pair(zero, i, one, F.col("own"))), F.transform(upto(F.col("n1")), lambda j: pair(one, F.least(j, F.col("own")), one, F.greatest(j, F.col("own"))))))
    placed = dealt.select("family", "member", "comp", "side", "own", F.explode(across).alias("task"))
    placed = placed.join(texts(members.select(F.col("member").alias("id")).distinct()).withColumnRenamed("id", "member"), "member")
    placed = placed.select("family", F.concat_ws(":", "task.a", "task.i", "task.b", "task.j").alias("task"), (F.col("side") * 1_000_000 + F.col("own")).alias("block"), "member", "comp", "text")

    def top(over: dict, c: int) -> int:
        while c in over:
            c = over[c]
        return c

    def compare(batches):
        at, kept, over, numbers = None, [], {}, None
        for batch in batches:
            for b in slices(batch, budget=SMALL):
                got = {"center": [], "member": []}
                found = features(b.column("text"))
                own = sketches.of(found) if sketches is not None else [None] * len(found)
                for f, t, k, m, c, x, w in zip(*(b.column(n).to_pylist() for n in ("family", "task", "block", "member", "comp")), found, own, strict=True):
                    if (f, t) != at:
                        at, kept, over = (f, t), [], {}
                    some = kept
                    if sketches is not None:
                        if not kept:
                            numbers = np.empty((MEMBERS, len(w)), w.dtype)
                        elif len(kept) == len(numbers):
                            numbers = np.concatenate((numbers, np.empty_like(numbers)))
                        some = [kept[i] for i in np.flatnonzero(sketches.near(numbers[: len(kept)], w[None])).tolist()]
                        numbers[len(kept)] = w
                    alone = len({*t.split(":")[0::2]}) == 1 and len({*t.split(":")[1::2]}) == 1
                    for k2, m2, c2, x2 in some:  # a link between groups that this task has already joined adds nothing
                        if (alone or k2 != k) and m2 != m and (r := top(over, c)) != (r2 := top(over, c2)) and linked(x2, x):
                            over[r] = r2
                            got["center"].append(min(m, m2))
                            got["member"].append(max(m, m2))
                    kept.append((k, m, c, x))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got.values()], names=list(got))

    rows = placed.repartition("family", "task").sortWithinPartitions("family", "task", "block", "member")
    return rows.mapInArrow(compare, "center long, member long").distinct()
