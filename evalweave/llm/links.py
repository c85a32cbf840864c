"""Links between sets that share tokens, and their connected components.

A bucket of mutually alike sets is not paired out. In rounds, each bucket's members are compared with one of
them (a pivot, a new one each round: the one with most shingles left from there on, so most like all others);
those it links to are led by it and stand behind it from then on. The leaders left in a bucket are compared
with each other, but for those in one component already. Jaccard distance is a metric: members of two leaders
can only be linked if the leaders' distance is at most the threshold's plus both radii, and only then are
members compared. No link between different components is lost.

Where a caller can name finer tokens (prefixes of whole sets), a bucket in which many leaders of different
components are left is not paired out either: its ids meet in their finer tokens instead, and each leader meets
one pivot a round, the one it shares most tokens with.

Where members have folds, those of two near leaders meet by their leaders, once a pair, whatever tokens they
share: distances, sizes and folds rule pairs out in that join. A bound by tokens is not asked for there.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import Scratch
from evalweave.llm.words import U

ROUNDS = 2
#: Rows of a token that are still paired out where finer tokens can be had.
CROWD = 4
#: Bitmaps have 2**BITS bits, cut into slices, whatever the input.
BITS, SLICES = 26, 64
#: Bits of parity that postings carry where all pairs of a token meet, and places that are sent in place of a bitmap.
FOLD, FEW = 512, 1 << 17


def parities(flat: np.ndarray, sizes: np.ndarray, least: int = 64) -> list[bytes]:
    """For each set (a run of `flat`) one bit for about each member: the parity of those whose hash falls there.

    Sets that differ in d members differ in at most d bits, so bits tell apart what cannot be alike.
    """
    if not len(sizes):
        return []
    width = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.cumsum(width) - width
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = base[of] + ((flat >> U(20)).astype(np.int64) & (width[of] - 1))
    packed = np.packbits(np.bincount(at, minlength=int(width.sum())) & 1 > 0, bitorder="little").tobytes()
    return [packed[i // 8 : (i + w) // 8] for i, w in zip(base.tolist(), width.tolist(), strict=True)]


def differ(x: bytes, y: bytes) -> int:
    """A number of members that two sets differ in at least."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) < len(q):
        p, q = q, p
    return int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, len(q)), axis=0) ^ q).sum())


def folded(bits: bytes) -> bytes:
    """FOLD bits of at least as many from parities: as far as these tell sets apart, they are different."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, FOLD // 8), axis=0).tobytes()


def apart_by(n: int, far: Column) -> Column:
    """Whether sets 1 and 2 (n1, fold1, n2, fold2) may be at most `far` apart, by the members that they differ in at least."""
    differ_in = sum((F.bit_count(F.get("fold1", F.lit(i)).bitwiseXOR(F.get("fold2", F.lit(i)))) for i in range(n)), F.lit(0))
    return 2 * differ_in <= (F.col("n1") + F.col("n2") + differ_in) * (far + 1e-9)


def _direct(percent: int):
    """Whether two sets may be linked, by size, by enough shared prefix tokens with enough shingles left from
    each of those on, and by the bits that tell them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nx, ny, lx, ly, tx, ty, ax, ay, bx, by in zip(*(batch.column(i).to_pylist() for i in range(2, 12)), strict=True):
                least = -(-percent * (nx + ny) // (100 + percent))
                ok = 100 * min(nx, ny) >= percent * max(nx, ny) and differ(bx, by) <= nx + ny - 2 * least
                if ok and tx is not None:
                    both, i, j = np.intersect1d(np.frombuffer(tx, U), np.frombuffer(ty, U), assume_unique=True, return_indices=True)
                    at_x, at_y = np.frombuffer(ax, np.uint32).astype(np.int64), np.frombuffer(ay, np.uint32).astype(np.int64)
                    left = np.minimum(nx - np.sort(at_x[i]), ny - np.sort(at_y[j])) + np.arange(len(both))
                    ok = len(both) >= min(lx, ly) and left.min() >= least
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], names=["a", "b", "keep"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist, link = [], []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                same = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - same
                dist.append(1 - same / union if union else 1.0)
                link.append(bool(union) and 100 * same >= percent * union)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(dist, pa.float64()), pa.array(link, pa.bool_())], names=["a", "b", "dist", "link"])

    return run


def clusters(sc: Scratch, postings: DataFrame, members: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id and component (least id reachable) of every id with a link.

    postings: (token, id, s, m): two ids can only be linked if they share a token where the s of each is at
    least the m of the other. members: id, n, need (shared prefix tokens to ask for), tokens and places (hashes
    of prefix tokens and their places in the order, as bytes; null: not to be tested) and bits (from parities);
    fold too, if wanted (longs, from folded): then pairs whose fold tells them apart never leave the joins of all
    pairs of a token, which still compare each two rows of it.
    fetch: from ids to their whole sets, as (id, shingles); asked only for the ids of pairs that all these leave.
    finer: from ids to postings of their own, such that any two of these ids that can be linked share one.
    """
    slack = (100 - percent) / 100
    size = postings.count() + members.count() if sc.rows_a_task else 0
    few = lambda df: sc.gathered(df, size)
    kind = members.schema["id"].dataType.simpleString()

    def both(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = few(pairs.join(sets.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side))
        return pairs.select("a", "b", *[f"{side}_{c}" for c in columns for side in ("a", "b")])

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        """a, b, dist, link; dist is null for pairs of single documents that the prefixes or bits rule out."""
        pairs = sc.write(f"{name}_pairs", few(pairs))
        alone = both(pairs.where("direct"), members, ["n", "need", "tokens", "places", "bits"])
        tried = sc.write(f"{name}_tried", alone.mapInArrow(_direct(percent), f"a {kind}, b {kind}, keep boolean"))
        hopeful = tried.where("keep").select("a", "b").unionByName(pairs.where("not direct").select("a", "b"))
        ruled_out = tried.where("not keep").select("a", "b", F.lit(None).cast("double").alias("dist"), F.lit(False).alias("link"))
        if hopeful.isEmpty():
            seen = ruled_out
        else:
            sets = sc.write(f"{name}_sets", few(fetch(few(hopeful.select(F.explode(F.array("a", "b")).alias("id")).distinct()))))
            seen = both(hopeful, sets, ["shingles"]).mapInArrow(_verify(percent), f"a {kind}, b {kind}, dist double, link boolean").unionByName(ruled_out)
        out = sc.write(name, seen)
        sc.drop(*[f"{name}_{x}" for x in ("sets", "pairs", "tried")])
        return out

    lead = None  # at first all stand for themselves
    tested = []

    def by_leader() -> DataFrame:
        """For each token and leader: the largest s and the smallest m of its members."""
        if lead is None:
            return postings.withColumnRenamed("id", "leader")
        return few(postings.join(lead, "id")).groupBy("token", "leader").agg(F.max("s").alias("s"), F.min("m").alias("m"))

    def side(table: DataFrame, names: dict[str, str], end: str) -> DataFrame:
        return table.select("token", *[F.col(c).alias(name) for c, name in names.items()], F.col("s").alias(f"s{end}"), F.col("m").alias(f"m{end}"))

    may = F.expr("s1 >= m2 and s2 >= m1")

    def fresh(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that no round has settled, marked direct if both stand for themselves alone.

        Prefixes settle a pair of single documents; once one of them leads others, its distance is needed.
        """
        if lead is None:
            return pairs.select("a", "b", F.lit(True).alias("direct"))
        behind = sc.write(f"behind{len(tested)}", few(lead.where("id != leader").select("leader").distinct()))
        for c in ("a", "b"):
            pairs = pairs.join(behind.select(F.col("leader").alias(c), F.lit(True).alias(f"led_{c}")), c, "left")
        pairs = pairs.select("a", "b", (F.col("led_a").isNull() & F.col("led_b").isNull()).alias("direct"))
        for t in tested:
            known = t.select("a", "b", F.col("dist").isNotNull().alias("known"))
            pairs = pairs.join(known, ["a", "b"], "left").where(F.col("known").isNull() | (~F.col("known") & ~F.col("direct"))).drop("known")
        return pairs

    ordered = (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    used = None
    for r in range(ROUNDS):
        here = by_leader() if lead is None else sc.write(f"here{r}", few(by_leader()))
        # A pivot that has met its bucket makes room for the next one.
        able = here if used is None else here.join(used, ["token", "leader"], "left_anti")
        pivots = able.groupBy("token").agg(F.min(F.struct((-F.col("s")).alias("s"), "leader", "m")).alias("p"), F.min("m").alias("least")).where("-p.s >= least")
        pivots = sc.write(f"pivots{r}", few(pivots.select("token", (-F.col("p.s")).alias("s"), F.col("p.m").alias("m"), F.col("p.leader").alias("x"))))
        met = pivots.select("token", F.col("x").alias("leader"))
        used = met if used is None else used.unionByName(met)
        pairs = side(here, {"leader": "y"}, "2").join(side(pivots, {"x": "x"}, "1"), "token")
        pairs = pairs.where(may & F.expr("x != y"))
        if finer:
            shared = few(few(pairs).groupBy("x", "y").agg(F.count("*").alias("c")))
            pairs = shared.groupBy("y").agg(F.max(F.struct("c", "x")).alias("p")).select("p.x", "y")
        pairs = pairs.select(*ordered).distinct()
        seen = compare(fresh(pairs), f"round{r}")
        tested.append(seen)
        links = seen.where("link").select("a", "b", "dist")
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
        # The one with most links leads, of ties that of the larger id.
        weight = sc.write(f"weight{r}", few(links.groupBy("a").agg(F.count("*").alias("links"))))
        rank = lambda c: weight.select(F.col("a").alias(c), F.struct("links", "a").alias(f"rank_{c}"))
        parent = few(few(links.join(rank("a"), "a")).join(rank("b"), "b")).where("rank_a > rank_b").groupBy("b").agg(F.max(F.struct("rank_a", "a", "dist")).alias("p"))
        parent = sc.write(f"parent{r}", few(parent.select("b", "p.a", "p.dist")))
        # Only those that nothing leads take members on, so that a radius stays a distance to one leader.
        root = parent.join(parent.select(F.col("b").alias("a")), "a", "left_anti")
        now = members.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("far")) if lead is None else lead
        moved = now.join(root, now.leader == root.b, "left")
        lead = sc.write(f"lead{r + 1}", few(moved.select("id", F.coalesce("a", "leader").alias("leader"), (F.col("far") + F.coalesce("dist", F.lit(0.0))).alias("far"))))
        sc.drop(f"here{r}", f"weight{r}", f"parent{r}", f"lead{r}")

    def so_far() -> DataFrame:
        out = tested[0]
        for t in tested[1:]:
            out = out.unionByName(t)
        return out

    def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Without the pairs that links found so far have joined into one component already."""
        for c in ("a", "b"):
            pairs = pairs.join(known.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}")), c, "left")
        return pairs.where("in_a is null or in_b is null or in_a != in_b").select("a", "b")

    def between(table: DataFrame) -> DataFrame:
        """Rows at tokens where known components meet, with the one of their leader: elsewhere no pair is open."""
        table = few(table.join(known.withColumnRenamed("id", "leader"), "leader", "left")).withColumn("component", F.coalesce("component", "leader"))
        open_ = table.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
        return few(table.join(few(open_.select("token")), "token", "left_semi"))

    coarse = postings

    def relieved(table: DataFrame, name: str, again: Callable[[], DataFrame]) -> DataFrame:
        """The table, made again once the ids of its crowded tokens have finer ones in their place.

        Two ids that can be linked at a crowded token both get finer tokens, by one order, so they meet there.
        """
        nonlocal postings, coarse
        if not finer:
            return table
        crowded = table.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("token")
        crowded = sc.write(f"{name}_crowded", few(crowded.join(coarse.select("token"), "token", "left_semi")))
        if crowded.isEmpty():
            return table
        more = finer(sc.write(f"{name}_ids", few(coarse.join(crowded, "token", "left_semi").select("id").distinct())))
        rest = postings.join(crowded, "token", "left_anti")
        coarse, postings = coarse.join(crowded, "token", "left_anti"), rest.unionByName(more.select(*rest.columns))
        sc.drop(name)
        return sc.write(f"{name}_finer", again())

    def by_near(near: DataFrame, ends: DataFrame) -> DataFrame:
        """x, y as (a, b): members of near leaders that distances, sizes and folds leave, each pair once however many tokens it shares.

        The smaller family of two goes first, so that few rows wait for the larger one.
        """
        family = few(lead.join(ends, "leader", "left_semi").join(members.select("id", "n", "fold"), "id"))
        family = sc.write("family", family)
        sizes = sc.write("sizes", few(family.groupBy("leader").agg(F.count("*").alias("size"), F.max("far").alias("radius"))))
        for c in ("a", "b"):
            near = near.join(sizes.select(F.col("leader").alias(c), F.struct("size", "radius", F.col("leader").alias("id")).alias(f"of_{c}")), c)
        near = few(near.select(F.least("of_a", "of_b").alias("p"), F.greatest("of_a", "of_b").alias("q"), "dist").distinct())
        near = near.select(F.col("p.id").alias("p"), F.col("q.id").alias("q"), F.col("q.radius").alias("radius"), "dist")
        part = lambda leader, name, end: family.select(F.col("leader").alias(leader), F.col("id").alias(name), F.col("far").alias(f"far_{name}"), F.col("n").alias(f"n{end}"), F.col("fold").alias(f"fold{end}"))
        first = few(near.join(part("p", "x", "1"), "p").where(F.col("dist") <= slack + F.col("far_x") + F.col("radius") + 1e-9))
        sized = F.expr(f"100 * n1 >= {percent} * n2 and 100 * n2 >= {percent} * n1")
        within = F.col("dist") <= slack + F.col("far_x") + F.col("far_y") + 1e-9
        return first.join(part("q", "y", "2"), "q").where(within & sized & apart_by(FOLD // 64, F.lit(slack))).select(*ordered)

    known = components(sc, so_far().where("link"), "before")
    here = relieved(sc.write("here", between(by_leader())), "here", lambda: between(by_leader()))
    if coarse is not postings:
        # At finer tokens each leader first meets one of its token: what that joins needs no other pair.
        for r in range(ROUNDS):
            first = here.groupBy("token").agg(F.max(F.struct(F.xxhash64("leader", F.lit(r)).alias("h"), "leader", "component", "s", "m")).alias("p"))
            first = first.select("token", *[F.col(f"p.{c}").alias(c) for c in ("leader", "component", "s", "m")])
            star = side(here, {"leader": "x", "component": "in_x"}, "1").join(side(first, {"leader": "y", "component": "in_y"}, "2"), "token")
            star = star.where(may & F.expr("x != y and in_x != in_y")).select(*ordered).distinct()
            tested.append(compare(fresh(star), f"star{r}"))
            known = components(sc, tested[-1].where("link"), f"joined{r}", known)
            here = sc.write(f"here_open{r}", between(by_leader()))
    radius = lead.groupBy("leader").agg(F.max("far").alias("radius")).where("radius > 0")
    mark, reach = {}, None
    if "fold" in members.columns:
        here = few(here.join(members.select(F.col("id").alias("leader"), "n", "fold"), "leader").join(radius, "leader", "left"))
        mark, reach = {"n": "n", "fold": "fold", "radius": "radius"}, F.coalesce("radius1", F.lit(0.0)) + F.coalesce("radius2", F.lit(0.0))
    marked = lambda end: {c: f"{name}{end}" for c, name in mark.items()}
    left, right = side(here, {"leader": "a", "component": "in_a"} | marked("1"), "1"), side(here, {"leader": "b", "component": "in_b"} | marked("2"), "2")
    # A pair of leaders counts as long as members of theirs may be linked.
    able = apart_by(FOLD // 64, slack + reach) if mark else F.lit(True)
    pairs = few(left.join(right, "token").where(may & F.expr("a < b and in_a != in_b") & able).select("a", "b")).distinct()
    tested.append(compare(fresh(pairs), "leaders"))
    known = components(sc, tested[-1].where("link"), "after", known)
    everything = so_far()
    near = everything.where("not link and dist is not null")
    for c in ("a", "b"):
        near = near.join(radius.select(F.col("leader").alias(c), F.col("radius").alias(f"r_{c}")), c, "left")
    reach = F.coalesce("r_a", F.lit(0.0)) + F.coalesce("r_b", F.lit(0.0))
    near = near.where((reach > 0) & (F.col("dist") <= slack + reach + 1e-9)).select("a", "b", "dist")
    near = sc.write("near", few(apart(near.select("a", "b"), known).join(near, ["a", "b"])))
    ends = near.select(F.col("a").alias("leader")).unionByName(near.select(F.col("b").alias("leader"))).distinct()
    if mark:
        inner = by_near(near, ends)
    else:
        # Members meet at a token first: a leader's members times its near leaders would be many more.
        owned = sc.write("owned", between(postings.join(lead.join(ends, "leader", "left_semi"), "id")))
        left = side(owned, {"id": "x", "leader": "a", "far": "far_x", "component": "in_a"}, "1")
        right = side(owned, {"id": "y", "leader": "b", "far": "far_y", "component": "in_b"}, "2")
        inner = left.join(right, "token").where(may & F.expr("a < b and in_a != in_b")).groupBy("x", "y").agg(*[F.first(c).alias(c) for c in ("a", "b", "far_x", "far_y")])
        # The same bound for each two members: they are no farther from their leaders than `far`.
        inner = inner.join(near, ["a", "b"]).where(F.col("dist") <= slack + F.col("far_x") + F.col("far_y") + 1e-9).select(*ordered)
    inner = inner.select("a", "b", F.lit(True).alias("direct"))
    return components(sc, compare(inner, "inner").where("link"), "all", known)


def components(sc: Scratch, edges: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """id and component (least id reachable) of every id in edges (a, b), by least labels and label jumps.

    One written table a step; the driver sees whether anything changed. Steps grow with the logarithm of a
    chain's length, as each also jumps to its label's label. known: components of earlier edges, a written
    table; then only edges between these are followed, and its ids are among the result's.
    """
    if known is not None:
        for c in ("a", "b"):
            edges = edges.join(known.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}")), c, "left")
        across = sc.write(f"{name}_across", edges.select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b")).where("a != b").distinct())
        if across.isEmpty():
            return known
        met = components(sc, across, f"{name}_met")
        moved = known.join(met.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left")
        moved = moved.select("id", F.coalesce("least", "component").alias("component"))
        return sc.write(name, moved.unionByName(met.join(known, "id", "left_anti")))
    rows = edges.count() if sc.rows_a_task else 0
    few = lambda df: sc.gathered(df, rows)
    both = sc.write(f"{name}_edges", few(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    label = sc.write(f"{name}_label0", few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))))
    step = 0
    while True:
        step += 1
        heard = few(both.join(label, both.b == label.id)).groupBy("a").agg(F.min("component").alias("m"))
        best = few(label.join(heard, label.id == heard.a, "left")).select("id", "component", F.least("component", "m").alias("new"))
        jump = label.select(F.col("id").alias("new"), F.col("component").alias("further"))
        out = best.join(jump, "new", "left").select("id", F.least("new", "further").alias("component"), (F.least("new", "further") != F.col("component")).alias("changed"))
        written = sc.write(f"{name}_label{step}", few(out))
        label = written.select("id", "component")
        if written.where("changed").isEmpty():
            return label


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of a task's rows, as compressed slices."""
    low, found = BITS - 6, np.zeros(0, np.int64)
    for batch in batches:
        found = np.union1d(found, batch.column(0).to_numpy())
    ends = np.searchsorted(found >> low, np.arange(SLICES + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        own = np.zeros(1 << low, bool)
        own[found[ends[s] : ends[s + 1]] & ((1 << low) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())], names=["slice", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.uint8)
            own[s] = own[s] | x if s in own else x
    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in own.values()], pa.binary())], names=["slice", "bits"])


def bitmap(bits: DataFrame) -> np.ndarray:
    """2**BITS bits, set where the table's one column says so: 8 MB whatever the input. What it lets through is
    joined exactly afterwards; where too many bits are set it only lets more through."""
    schema = "slice int, bits binary"
    parts = bits.select(F.col(bits.columns[0]).cast("long").alias("bit")).mapInArrow(_slices, schema)
    out = np.zeros((SLICES, 1 << (BITS - 9)), np.uint8)
    for s, x in parts.repartition("slice").mapInArrow(_either, schema).collect():
        out[s] = np.frombuffer(zlib.decompress(x), np.uint8)
    return out.reshape(-1)


def bit_of(name: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(name), 64 - BITS).alias("bit")


def asked(bits: DataFrame):
    """Keeps rows whose column `bit` is among the bits. Few bits are sent as their places: each process keeps a file of
    what is sent until the end."""
    found = bitmap(bits)
    if int(np.bitwise_count(found).sum()) <= FEW:
        found = np.flatnonzero(np.unpackbits(found))
    wanted = bits.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_set(wanted.value, batch.column("bit").to_numpy())))

    return run


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """bits: a bitmap, or the places of its set bits in order."""
    if bits.dtype != np.uint8:
        return np.append(bits, -1)[np.searchsorted(bits, at)] == at
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


