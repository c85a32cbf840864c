"""N-gram Jaccard join by adaptive multi-match prefixes, up to connected components.

Rows of equal shingle sets are one class, found by a digest; only class representatives go on. With shingles in
one global order, two sets of Jaccard similarity t share at least l of their (n - ceil(t n) + l)-prefixes. Each
document picks the l of least estimated cost (postings read, and candidates left for verification), and a pair
is verified only if it shares as many prefix shingles as the smaller of its two l asks for.

The order wants rare shingles first, and how many documents have one is counted exactly where it matters:
- A count sketch of fixed size tells heavy shingles (in more documents than a bound that no light one passes).
  They come last, ordered by the sketch.
- Light ones have a level by their hash, so that a level holds about `PICK` times a prefix. A document sends the
  levels, whole, that its longest prefix may reach into: some multiple of its prefix, never its whole set.
- Of the shingles sent, those in two or more documents go back to their documents with their counts. Within a
  level the order is by that count. What was sent by one document only is shared with no other prefix.
Only documents that have a shared shingle in their shortest prefix (l = 1) go on. So neither what is sent nor
what comes back hangs on how well a sketch of fixed size resolves: both grow with the documents.

Two sets of sizes m and n share at least t (m + n) / (1 + t) shingles, and none before the first shared one:
so the first shared one leaves each at least so many from it on. This is tested where pairs are made. Candidates
meet in the shortest prefixes; the lengthened ones are then counted for each pair, and bits of parity rule out
sets that differ too much, before any set travels. Pairs of a bucket: see links.

Null or empty text and text without words have the empty set and link to nothing. Null ids link to nothing and
get a null component. Repeated rows get equal results; rows that share an id but not a text are placed each by
its own text. Equal sets link whatever their size; at 100 percent only they do. An empty table gives an empty
result. Only id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import Scratch, blocks, shuffle_width, text_or_empty, tune, utf8
from evalweave.llm.links import asked, bit_of, clusters, parities
from evalweave.llm.words import U, mix, shingles, words

SHINGLE = 3
PERCENT = 90
#: Counters of the sketch are 2**SKETCH numbers of 32 bits whatever the input: 4 MB in each worker.
SKETCH, SLICES = 20, 16
#: A shingle is heavy if its counter is above this and above HEAVY_NOISE times the mean counter.
HEAVY, HEAVY_NOISE = 64, 4
#: Shingles of the first level, as a multiple of the share that a prefix takes.
PICK = 2.5
MOST_MATCHES = 4
#: Cost of verifying a candidate, in postings read.
VERIFY = 20.0
#: Shingles that one task sorts at a time.
RUN = 1 << 19
#: Bytes of text looked at together: arrays over them take some 40 times as much.
BLOCK = 1 << 18


def _sets_of(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in blocks(off, BLOCK):
        h, begin = shingles(*words(data[off[a] : off[b]], off[a : b + 1] - off[a]), k)
        for i in range(b - a):
            yield np.unique(h[begin[i] : begin[i + 1]])


def _survey(k: int, key_type: pa.DataType):
    """Rows (kind 0): id, set size and digest. Once a task (kind 1): slices of its count sketch."""
    names = ["kind", "id", "n", "c1", "c2", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(1 << SKETCH, np.uint32), [], 0

        def add() -> None:
            nonlocal counts, waiting, held
            if waiting:
                counts += np.bincount(np.concatenate(waiting) >> U(64 - SKETCH), minlength=1 << SKETCH).astype(np.uint32)
            waiting, held = [], 0

        for batch in batches:
            n, c1, c2 = [], [], []
            for u in _sets_of(*utf8(batch.column(1)), k):
                n.append(len(u))
                c1.append(u.sum(dtype=U))
                c2.append(mix(u + U(0x1B873593)).sum(dtype=U))
                waiting.append(u)
                held += len(u)
                if held > RUN:
                    add()
            m = len(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(m, np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(c1, U).view(np.int64)), pa.array(np.array(c2, U).view(np.int64)),
                pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
            ], names=names)
        add()
        if counts.any():
            parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SLICES, np.int32)), pa.nulls(SLICES, key_type), none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64)
            total[s] = total[s] + x if s in total else x
    rows = [(s, zlib.compress(np.minimum(x, 2**32 - 1).astype("<u4").tobytes(), 1)) for s, x in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["slice", "counts"])


def sketch(survey: DataFrame) -> np.ndarray:
    """The count sketch of a table made by _survey: 2**SKETCH counters whatever the input."""
    merged = survey.where("kind = 1").select("slice", "counts").repartition("slice").mapInArrow(_merge, "slice int, counts binary")
    counts = np.zeros((SLICES, (1 << SKETCH) // SLICES), np.uint32)
    for s, x in merged.collect():
        counts[s] = np.frombuffer(zlib.decompress(x), "<u4")
    return counts.reshape(-1)


_SURVEY = "kind int, id long, n long, c1 long, c2 long, slice int, counts binary"
_EMITTED = "kind int, pid int, row int, id long, n long, c1 long, c2 long, light binary, heavy binary, weight binary, bits binary, slice long, tokens binary, rows binary"
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _EMITTED.split(", "))])


def levels(percent: int) -> int:
    return max(1, int(100 / (PICK * (100 - percent))))


def longest(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the longest prefix that sets of these sizes may choose."""
    least = -(-percent * n // 100)  # a partner shares at least so many
    return n - least + np.minimum(MOST_MATCHES, least)


def _emit(k: int, percent: int, keep, shared, bound: float, slices: int):
    """kind 0: a row for each document, dealt evenly; kind 1: what a task's documents send, by slices of the hash."""
    count = levels(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, row, counts = TaskContext.get().partitionId(), 0, shared.value
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            if held:
                tokens, rows = (np.concatenate(x) for x in zip(*waiting, strict=True))
                at = (tokens >> U(16)) % U(slices)
                order = np.lexsort((tokens, at))
                tokens, rows, at = tokens[order], rows[order], at[order]
                cut = np.flatnonzero(np.diff(at, prepend=U(slices)))
                ends = np.append(cut, len(at))[1:]
                parts = zip(cut.tolist(), ends.tolist(), strict=True)
                some = [{"kind": 1, "pid": pid, "slice": int(at[a]), "tokens": tokens[a:b].tobytes(), "rows": rows[a:b].tobytes()} for a, b in parts]
                for i in range(0, len(some), 256):
                    yield pa.RecordBatch.from_pylist(some[i : i + 256], schema=_ARROW)
            waiting, held = [], 0

        for batch in keep(batches):
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1), []
            data, off = utf8(texts)
            for a, b in blocks(off, BLOCK):
                sets = list(_sets_of(data[off[a] : off[b]], off[a : b + 1] - off[a], k))
                sizes = np.array([len(u) for u in sets], np.int64)
                flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                c = counts[flat >> U(64 - SKETCH)]
                light = c <= bound
                level = ((flat & U(0xFFFF)) * U(count) >> U(16)).astype(np.int64)
                held_by = np.bincount(of[light] * count + level[light], minlength=len(sets) * count).reshape(-1, count)
                upto = np.cumsum(held_by, axis=1)
                wanted = longest(sizes, percent)
                # A level is sent if those before it may not fill the longest prefix.
                sent = (upto - held_by < wanted[:, None]) & (-(-percent // (100 - percent)) <= sizes)[:, None]
                pick = light & sent[of, level]
                waiting.append((flat[pick], (row + of[pick]).astype(np.uint32)))
                held += int(pick.sum())
                lacking = set(np.flatnonzero((upto[:, -1] < wanted) & sent[:, 0]).tolist())
                bits = parities(flat, sizes)
                at = np.cumsum(sizes) - sizes
                for i, u in enumerate(sets):
                    heavy = weight = None
                    if i in lacking:
                        s = slice(at[i], at[i] + sizes[i])
                        h, w = u[~light[s]], c[s][~light[s]].astype(np.uint32)
                        o = np.lexsort((h, w))[: wanted[i] - upto[i, -1]]
                        heavy, weight = h[o].tobytes(), w[o].tobytes()
                    if sent[i, 0]:
                        out.append({
                            "kind": 0, "pid": pid, "row": row + i, "slice": (pid * 7919 + row + i) % slices, "id": ids[a + i], "n": int(sizes[i]), "c1": int(u.sum(dtype=U).view(np.int64)), "c2": int(mix(u + U(0x1B873593)).sum(dtype=U).view(np.int64)),
                            "light": (held_by[i] * sent[i]).astype(np.uint32).tobytes(), "heavy": heavy, "weight": weight, "bits": bits[i],
                        })
                row += len(sets)
                if held > 2 * RUN:
                    yield from send()
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        yield from send()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows of one key; rows come sorted by it."""
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and rows[0][key] != r[key]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: which documents share which shingles, dealt back to the tasks that sent them. Documents pass."""
    for every in _grouped(batches, "slice"):
        yield pa.RecordBatch.from_pylist([r for r in every if not r["kind"]], schema=_ARROW)
        group = [r for r in every if r["kind"]]
        if not group:
            continue
        tokens = np.concatenate([np.frombuffer(r["tokens"], U) for r in group])
        rows = np.concatenate([np.frombuffer(r["rows"], np.uint32) for r in group])
        pid = np.repeat(np.array([r["pid"] for r in group], np.int32), [len(r["tokens"]) // 8 for r in group])
        order = np.argsort(tokens, kind="stable")
        first = np.flatnonzero(np.diff(tokens[order], prepend=~tokens[order[:1]]))
        df = np.diff(np.append(first, len(order)))
        df = np.repeat(df, df)
        order, df = order[df > 1], df[df > 1].astype(np.uint32)
        by = np.argsort(pid[order], kind="stable")
        order, df = order[by], df[by]
        cut = np.flatnonzero(np.diff(pid[order], prepend=-1))
        ends = np.append(cut, len(order))[1:]
        out = [{"kind": 1, "pid": int(pid[order[a]]), "tokens": tokens[order[a:b]].tobytes(), "rows": rows[order[a:b]].tobytes(), "weight": df[a:b].tobytes()} for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _choose(percent: int):
    """For each document that may have a partner: how many matches to ask for, and its prefix.

    Places count what comes before in the order, shingles that no other document sent included.
    """
    count = levels(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "pid"):
            docs, back = [r for r in group if not r["kind"]], [r for r in group if r["kind"]]
            if not docs:
                continue
            m = len(docs)
            n = np.array([r["n"] for r in docs], np.int64)
            rows = np.array([r["row"] for r in docs], np.int64)
            by_row = np.argsort(rows)
            held = np.array([np.frombuffer(r["light"], np.uint32) for r in docs], np.int64).reshape(m, count)
            tokens = np.concatenate([np.zeros(0, U), *[np.frombuffer(r["tokens"], U) for r in back]])
            df = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["weight"], np.uint32) for r in back]]).astype(np.int64)
            of = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["rows"], np.uint32) for r in back]]).astype(np.int64)
            spot = np.minimum(np.searchsorted(rows[by_row], of), m - 1)
            known = rows[by_row][spot] == of  # the others' classes have another representative
            of, tokens, df = by_row[spot[known]], tokens[known], df[known]
            level = ((tokens & U(0xFFFF)) * U(count) >> U(16)).astype(np.int64)
            order = np.lexsort((tokens, df, level, of))
            of, tokens, df, level = of[order], tokens[order], df[order], level[order]
            cell = of * count + level
            back_by = np.bincount(cell, minlength=m * count).reshape(m, count)
            before = (np.cumsum(held, axis=1) - held + held - back_by).reshape(-1)  # lower levels, and those of this level that came from one document only
            start = np.cumsum(back_by.reshape(-1)) - back_by.reshape(-1)
            place = before[cell] + np.arange(len(cell)) - start[cell]
            for i, r in enumerate(docs):
                if r["heavy"]:
                    h = np.frombuffer(r["heavy"], U)
                    of = np.append(of, np.full(len(h), i))
                    tokens, df = np.append(tokens, h), np.append(df, np.frombuffer(r["weight"], np.uint32).astype(np.int64))
                    place = np.append(place, held[i].sum() + np.arange(len(h)))
            least = -(-percent * n // 100)
            inside = place < longest(n, percent)[of]
            of, tokens, df, place = of[inside], tokens[inside], df[inside], place[inside]
            need, best = np.ones(m, np.int64), np.full(m, np.inf)
            for matches in range(1, MOST_MATCHES + 1):
                at = n - least + matches
                within = place < at[of]
                others = np.bincount(of[within], weights=df[within] - 1, minlength=m)
                cost = np.where(matches <= least, at + others + VERIFY * others / matches, np.inf)
                need, best = np.where(cost < best, matches, need), np.minimum(cost, best)
            keep = place < (n - least + need)[of]
            of, tokens, place = of[keep], tokens[keep], place[keep]
            active = np.bincount(of[place <= (n - least)[of]], minlength=m) > 0
            order = np.lexsort((place, of))
            of, tokens, place = of[order], tokens[order], place[order].astype(np.uint32)
            start = np.searchsorted(of, np.arange(m + 1))
            some = np.flatnonzero(active)
            columns = [
                pa.array((np.array([r["pid"] for r in docs], np.int64) << 32 | rows)[some]), pa.array(n[some]), pa.array(need[some].astype(np.int32)),
                pa.array([tokens[start[i] : start[i + 1]].tobytes() for i in some], pa.binary()), pa.array([place[start[i] : start[i + 1]].tobytes() for i in some], pa.binary()),
                pa.array([docs[i]["bits"] for i in some], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "need", "tokens", "places", "bits"])

    return run


def _post(percent: int):
    """A row for each prefix shingle of the shortest prefix (l = 1).

    s = (100 + p)(n - place) - p n and m = p n: with s at least the other's m, enough shingles are left for a
    link at p per cent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            tokens = [np.frombuffer(x, U) for x in batch.column(2).to_pylist()]
            of = np.repeat(np.arange(len(ids)), [len(x) for x in tokens])
            place = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).astype(np.int64)
            n = sizes[of]
            keep = place <= n - -(-percent * n // 100)
            s = (100 + percent) * (n - place) - percent * n
            columns = [np.concatenate([np.zeros(0, U), *tokens]).view(np.int64)[keep], ids[of][keep], s[keep], (percent * n)[keep]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["token", "id", "s", "m"])

    return run


def _links(sc: Scratch, rows: DataFrame, survey: DataFrame, classes: DataFrame, spark: SparkSession, k: int, percent: int) -> DataFrame:
    """n, c1, c2 and component (least id) of the classes that link to others. rows: id, text."""
    counts = sketch(survey)
    noise = float(counts.mean(dtype=np.float64))
    slices = int(noise * len(counts) / levels(percent)) // RUN + 1  # of about RUN shingles, and of light ones, of which none has many
    width = shuffle_width(spark)
    shared = spark.sparkContext.broadcast(counts)
    # Most copies are kept out by the bitmap, all by the grouping below.
    first = asked(classes.select(bit_of("id")))
    texts = rows.select("id", "text", bit_of("id")).where("id is not null")
    emitted = texts.mapInArrow(_emit(k, percent, first, shared, max(HEAVY, HEAVY_NOISE * noise), slices), _EMITTED)
    # A task sorts one slice after another, so that it holds one at a time, whatever their number.
    met = sc.write("met", emitted.repartition(min(slices, 4 * width), "slice").sortWithinPartitions("slice").mapInArrow(_meet, _EMITTED))
    one = met.where("kind = 0").groupBy("n", "c1", "c2").agg(F.min(F.struct("id", "pid", "row", "light", "heavy", "weight", "bits")).alias("r"))
    reps = sc.write("reps", one.select("n", "c1", "c2", "r.*"))
    own = reps.select(*[F.col(c) if c in reps.columns else F.lit(0 if c == "kind" else None).cast(met.schema[c].dataType).alias(c) for c in met.columns])
    dealt = own.unionByName(met.where("kind = 1")).repartition(width, "pid").sortWithinPartitions("pid")
    members = sc.write("members", dealt.mapInArrow(_choose(percent), "id long, n long, need int, tokens binary, places binary, bits binary"))
    sc.drop("met")
    posted = sc.write("posted", members.select("id", "n", "tokens", "places").mapInArrow(_post(percent), "token long, id long, s long, m long"))
    busy = sc.write("busy", posted.groupBy("token").agg(F.count("*").alias("c"), F.max("s").alias("s"), F.min("m").alias("m")).where("c > 1 and s >= m").select("token"))
    postings = sc.write("postings", posted.join(busy, "token"))
    sc.drop("posted", "busy")
    named = reps.select(F.expr("shiftleft(cast(pid as long), 32) | row").alias("rep"), "id", "n", "c1", "c2")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = sc.write(f"wanted{uuid.uuid4().hex}", named.join(ids.withColumnRenamed("id", "rep"), "rep"))
        keep = asked(wanted.select(bit_of("id")))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in keep(batches):
                sets = list(_sets_of(*utf8(batch.column(2)), k))
                sums = [np.array([x.sum(dtype=U) for x in y], U).view(np.int64) for y in (sets, [mix(u + U(0x1B873593)) for u in sets])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), pa.array([u.tobytes() for u in sets], pa.binary())], names=["id", "c1", "c2", "shingles"])

        # Texts don't travel: each task makes the sets of its own rows that are asked for. The digest tells the
        # text of a class from others under the same id; rows repeated whole are one set.
        sets = rows.select("id", bit_of("id"), "text").where("id is not null").mapInArrow(whole, "id long, c1 long, c2 long, shingles binary")
        return sets.join(wanted, ["id", "c1", "c2"]).groupBy(F.col("rep")).agg(F.first("shingles").alias("shingles")).withColumnRenamed("rep", "id")

    found = sc.write("found", clusters(sc, postings, members, fetch, percent))
    named = sc.write("named", found.select(F.col("id").alias("rep"), "component").join(named, "rep"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    return named.join(least, "component").select("n", "c1", "c2", F.col("least").alias("component"))


def link(docs: DataFrame, spark: SparkSession, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component_id of every row of docs."""
    tune(spark)
    sc, kept = Scratch(spark, "jaccard"), Scratch(spark, "linked")
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    survey = sc.write("survey", rows.mapInArrow(_survey(k, pa.int64()), _SURVEY))
    sized = survey.where("kind = 0").select("id", "n", "c1", "c2")
    some = F.expr("n > 0 and id is not null")
    classes = sc.write("classes", sized.where(some).groupBy("n", "c1", "c2").agg(F.min("id").alias("id")))
    reach = classes.withColumnRenamed("id", "component")
    if percent < 100:
        linked = sc.write("linked", _links(sc, rows, survey, classes, spark, k, percent).withColumnRenamed("component", "joined"))
        reach = reach.join(linked, ["n", "c1", "c2"], "left").select("n", "c1", "c2", F.coalesce("joined", "component").alias("component"))
    # Written: the join then has plain exchanges on both sides, which AQE splits at a class of many copies.
    reach = sc.write("reach", reach)
    alone = sized.where(~some).select("id", "n", F.col("id").alias("component_id"))
    rest = sized.where(some).join(reach, ["n", "c1", "c2"]).select("id", "n", F.col("component").alias("component_id"))
    out = kept.write("components", rest.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id"))
    sc.remove()
    return out


def first_of_groups(docs: DataFrame, spark: SparkSession, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that link to one of a smaller id: one of each group, with all its columns.

    Documents without words and those without an id stay. Of rows that share an id one stays: that of the
    least text, ties by all else being equal.
    """
    sc = Scratch(spark, "groups")
    placed = sc.write("placed", link(docs, spark, key, text, k, percent))
    stay = placed.groupBy(F.col(key).alias("stay")).agg(F.count("*").alias("rows"), F.max(F.col(key) == F.col("component_id")).alias("first"))
    stay = sc.write("stay", stay.where("first"))
    sc.drop("placed")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"))
    once = rows.join(stay.where("rows = 1"), F.col("id") == F.col("stay"), "left_semi").select("row")
    often = rows.join(stay.where("rows > 1"), F.col("id") == F.col("stay"), "left_semi")
    least = often.groupBy("id").agg(F.min_by("row", F.struct(F.coalesce(F.col("row").getField(text), F.lit("")))).alias("row")).select("row")
    return once.unionByName(least).unionByName(rows.where("id is null").select("row")).select("row.*")
