"""Document fingerprints: MinHash signatures in vectorised numpy, bands joined in Spark, Jaccard verified.

A shingle is five words (A-Z folded). A text of 1 to 4 words has its whole sequence as one shingle; a
text without words has none and a signature of all ones, which is like no other but its own kind.
Permutations are multiply-shift universal hashes of 32-bit shingle keys.

Groups: signature bands are joined in Spark, hot bands by way of leaders, and the Jaccard similarity of every
candidate that its bits of parity leave is verified on the whole sets, made anew from the texts that are asked
for. Where a band is left with many leaders that no pivot links (texts that are alike, though less than asked
for), they aren't paired out: they meet in the rarest shingles of their sets (a prefix, with the bound on
places that a link needs), which loses no link. Rows of equal shingle sets are one class, so copies cost nothing more.

Null text is empty text. Equal texts have equal fingerprints. Rows are ordered by id, ties by text; null
ids come first. Repeated rows follow one another. A table of one row is its own successor; an empty table
gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import jaccard
from evalweave.llm.common import Scratch, blocks, even_ranges, range_of, shuffle_width, text_or_empty, tune, utf8
from evalweave.llm.links import FOLD, asked, bit_of, clusters, folded, parities
from evalweave.llm.words import U, mix, shingles, words

SHINGLE = 5
PERMUTATIONS = 128
BANDS, ROWS = 32, 4
LIKE = 80
#: Rows for which a step of the groups takes one more task: links, labels and places in the order are a few longs each.
ROWS_A_TASK = 1 << 14
_random = np.random.default_rng(20250217)
_A = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_B = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_NONE = np.uint32(0xFFFFFFFF)


def signatures(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A row of PERMUTATIONS minima for each text."""
    out = np.full((len(off) - 1, PERMUTATIONS), _NONE, np.uint32)
    for a, b in blocks(off, 1 << 17):
        h, begin = shingles(*words(data[off[a] : off[b]], off[a : b + 1] - off[a]), k)
        some = np.flatnonzero(np.diff(begin))
        if not len(some):
            continue
        x, at = h >> U(32), begin[some]
        room = np.empty_like(x)
        for p in range(PERMUTATIONS):
            np.multiply(x, _A[p], out=room)
            np.add(room, _B[p], out=room)
            out[a + some, p] = (np.minimum.reduceat(room, at) >> U(32)).astype(np.uint32)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal minima: the estimate of Jaccard similarity."""
    return (x == y).mean(axis=-1)


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def edited(text: str, following: str) -> str:
    """The last half (floor) of the code points replaced by the first as many, or all, of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def successors(docs: DataFrame, spark: SparkSession, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, tail, key, text): rows dealt to id ranges, each ended by a copy of the next range's first row.

    One shuffle of the texts. The driver holds a number for each range, nothing for rows.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("part", range_of(even_ranges(rows, "key", F.octet_length("text"), shuffle_width(spark)), "key"))
    first = rows.groupBy("part").agg(F.min("key").alias("least"), F.max(F.col("key").isNull()).alias("none")).collect()
    order = sorted(r["part"] for r in first)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    starts = [(r["part"], None if r["none"] else r["least"], before[r["part"]]) for r in first]
    # A row for each range; the ranges are as many as the session's shuffle partitions.
    starts = F.broadcast(spark.createDataFrame(starts, "part int, least long, to int"))
    heads = rows.join(starts, "part").where(F.col("key").eqNullSafe(F.col("least")))
    heads = heads.groupBy("to").agg(F.min(F.struct("key", "text")).alias("h"))
    heads = heads.select(F.col("to").alias("part"), F.lit(1).alias("tail"), "h.key", "h.text")
    return rows.select("part", F.lit(0).alias("tail"), "key", "text").unionByName(heads)


def _marked(dealt: DataFrame, marks: DataFrame) -> DataFrame:
    """dealt with rows of kind 0 that hold a key's group, dealt like the key's own rows."""
    keys = dealt.where("tail = 0 and key is not null").select("part", "key").distinct()
    marks = marks.join(keys, "key").select("part", F.lit(0).alias("tail"), "key", F.lit("").alias("text"), F.lit(0).alias("kind"), "group")
    return dealt.withColumns({"kind": F.lit(1), "group": F.lit(None).cast("long")}).unionByName(marks)


def fingerprints(docs: DataFrame, spark: SparkSession, key: str = "doc_id", text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they and the next text's are.

    groups: from near_groups(); then there is near_group too (null without one; of rows that share an id, the least).
    """
    tune(spark)
    dealt = successors(docs, spark, key, text)
    if groups is not None:
        # A text's group comes sorted right before it: no second shuffle of what is made here.
        marks = groups.groupBy("key").agg(F.min("group").alias("group"))
        dealt = _marked(dealt, marks)
    else:
        dealt = dealt.withColumns({"kind": F.lit(1), "group": F.lit(None).cast("long")})
    parts = max(shuffle_width(spark), 1)
    dealt = dealt.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions("part", "tail", "key", "kind", "text")
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_group"]

    def emit(keys, texts: list[str], sigs: np.ndarray, group: list) -> pa.RecordBatch:
        n = len(texts) - 1
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        raw = [t.encode() for t in changed]
        other = signatures(*_pack(raw))
        hexed = lambda m: [r.tobytes().hex() for r in m.astype("<u4")]
        columns = [
            pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(hexed(sigs[:n])),
            pa.array(hexed(other)), pa.array(likeness(sigs[:n], other), pa.float64()), pa.array(likeness(sigs[:n], sigs[1:]), pa.float64()), pa.array(group[:n], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([keys, *columns], names=[key, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark = None, (None, None)  # the last row seen: part, tail, key, text, signature, group; the last mark
        for batch in batches:
            group, rows = [], []
            for i, (k, kind, g) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if kind:
                    rows.append(i)
                    group.append(mark[1] if k is not None and k == mark[0] else None)
                else:
                    mark = (k, g)
            batch = batch.take(pa.array(rows, pa.int64()))
            if not rows:
                continue
            parts, tails, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            keys, sigs = batch.column(2), signatures(*utf8(batch.column(3)))
            if held:
                parts, tails, texts, group = [held[0], *parts], [held[1], *tails], [held[3], *texts], [held[5], *group]
                keys, sigs = pa.concat_arrays([held[2], keys]), np.concatenate([held[4], sigs])
            a = 0
            while a < len(texts):
                b = a
                while b < len(texts) and parts[b] == parts[a]:
                    b += 1
                if b - a > 1:
                    yield emit(keys.slice(a, b - a - 1), texts[a:b], sigs[a:b], group[a:b])
                a = b
            held = (parts[-1], tails[-1], keys.slice(len(keys) - 1), texts[-1], sigs[-1:], group[-1])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_group long"
    return dealt.select("part", "tail", "key", "text", "kind", "group").mapInArrow(run, schema)


def _banded(k: int):
    """key, cls (digest of the shingle set), its size, bands, and bits of parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            sigs = signatures(data, off, k)
            cls, bands, sizes, bits = [], [], [], []
            for a, b in blocks(off, 1 << 18):
                unique = _sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
                n = np.array([len(u) for u in unique], np.int64)
                bits += parities(np.concatenate(unique), n, FOLD)
                sizes += n.tolist()
                cls += [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in unique]
            rows = sigs.reshape(-1, BANDS, ROWS).astype(U)
            x = np.broadcast_to(np.arange(BANDS, dtype=U), rows.shape[:2])
            for j in range(ROWS):
                x = mix(x * U(0x9FB21C651E98DF25) + rows[:, :, j])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()), bands, pa.array(bits, pa.binary())], names=["key", "cls", "n", "bands", "bits"])

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fold = np.frombuffer(b"".join(map(folded, batch.column("bits").to_pylist())), np.int64)
        at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (FOLD // 64))
        yield batch.append_column("fold", pa.ListArray.from_arrays(at, pa.array(fold)))


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    h, begin = shingles(*words(data, off), k)
    return [np.unique(h[begin[i] : begin[i + 1]]) for i in range(len(off) - 1)]


def near_groups(docs: DataFrame, spark: SparkSession, key: str = "doc_id", text: str = "text", like: int = LIKE, k: int = SHINGLE) -> DataFrame:
    """key and group (least key reachable by links) of every row with a key (a whole number). A link joins two
    rows of equal shingle sets, or of a Jaccard similarity of `like` percent or more that share a signature band.
    Links between members of near leaders count without one.
    Rows without words are in a group of their own; an empty table gives an empty result."""
    tune(spark)
    sc, kept = Scratch(spark, "minhash", ROWS_A_TASK), Scratch(spark, "groups")
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).where("key is not null")
    members = sc.write("members", rows.mapInArrow(_banded(k), "key long, cls binary, n long, bands array<bigint>, bits binary"))
    found = members.where("n > 0").groupBy("cls").agg(F.min(F.struct("key", "n", "bands", "bits")).alias("r"))
    # A number for each class, written, so that it stays what it is.
    reps = sc.write("reps", found.select(F.monotonically_increasing_id().alias("id"), "r.key", "cls", "r.n", "r.bands", "r.bits"))
    # What is read later is kept without bands and bits, most of these tables.
    placed, named = sc.write("placed", members.select("key", "cls", "n")), sc.write("named", reps.select("id", "key", "cls"))
    sc.drop("members")
    posted = reps.select("id", "n", F.posexplode("bands").alias("band", "value")).select(F.col("value").alias("token"), "id", (F.col("n") * 100).alias("s"), (F.col("n") * like).alias("m"))
    busy = sc.write("busy", posted.groupBy("token").agg(F.count("*").alias("c"), F.max("s").alias("s"), F.min("m").alias("m")).where("c > 1 and s >= m").select("token"))
    postings = sc.write("postings", posted.join(busy, "token"))
    none = F.lit(None).cast("binary")
    narrow = reps.join(postings.select("id").distinct(), "id", "left_semi").select("id", "n", F.lit(1).alias("need"), none.alias("tokens"), none.alias("places"), "bits")
    narrow = sc.write("narrow", narrow.mapInArrow(_folded, "id long, n long, need int, tokens binary, places binary, bits binary, fold array<bigint>"))
    sc.drop("busy", "reps")
    classes = named.count()

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = sc.write(f"wanted{uuid.uuid4().hex}", sc.gathered(named.join(ids, "id"), classes))
        keep = asked(wanted.select(bit_of("key")))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in keep(batches):
                data, off = utf8(batch.column(2))
                sets = [u for a, b in blocks(off, 1 << 18) for u in _sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)]
                cls = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())], names=["key", "cls", "shingles"])

        sets = rows.select("key", bit_of("key"), "text").mapInArrow(whole, "key long, cls binary, shingles binary")
        return sc.gathered(sets.join(wanted, ["key", "cls"]), classes).groupBy("id").agg(F.first("shingles").alias("shingles"))

    def finer(ids: DataFrame) -> DataFrame:
        """Postings of prefixes: the rarest shingles by a sketch of these texts, whose collisions only cost candidates."""
        unique = uuid.uuid4().hex
        wanted = sc.write(f"few{unique}", named.join(ids, "id"))
        keep = asked(wanted.select(bit_of("key")))
        texts, survey = rows.select("key", "text", bit_of("key")), jaccard._survey(k, pa.int64())
        counts = spark.sparkContext.broadcast(jaccard.sketch(texts.mapInArrow(lambda batches: survey(keep(batches)), jaccard._SURVEY)))

        def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in keep(batches):
                data, off = utf8(batch.column(1))
                cls, n, tokens, places = [], [], [], []
                for a, b in blocks(off, 1 << 18):
                    for u in _sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k):
                        some = len(u) - -(-like * len(u) // 100) + 1
                        tokens.append(u[np.lexsort((mix(u), counts.value[u >> U(64 - jaccard.SKETCH)]))[:some]].tobytes())
                        places.append(np.arange(len(tokens[-1]) // 8, dtype=np.uint32).tobytes())
                        cls.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                        n.append(len(u))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(tokens, pa.binary()), pa.array(places, pa.binary())], names=["key", "cls", "n", "tokens", "places"])

        prefixes = texts.mapInArrow(rarest, "key long, cls binary, n long, tokens binary, places binary").join(wanted.select("id", "key", "cls"), ["key", "cls"])
        prefixes = sc.write(f"prefixes{unique}", prefixes.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "places")]))
        counts.destroy()
        every = prefixes.mapInArrow(jaccard._post(like), "token long, id long, s long, m long")
        shared = every.groupBy("token").agg(F.count("*").alias("c"), F.max("s").alias("s"), F.min("m").alias("m")).where("c > 1 and s >= m")
        out = sc.write(f"finer{unique}", every.join(shared.select("token"), "token"))
        sc.drop(f"prefixes{unique}", f"few{unique}")
        return out

    linked = sc.write("linked", clusters(sc, postings, narrow, fetch, like, finer).join(named, "id"))
    least = linked.groupBy("component").agg(F.min("key").alias("group"))
    reach = named.select("cls", "key").join(linked.join(least, "component").select("cls", "group"), "cls", "left").select("cls", F.coalesce("group", "key").alias("group"))
    # Written: the join then has plain exchanges on both sides, which AQE splits at a class of many copies.
    reach = sc.write("reach", reach)
    alone = placed.where("n = 0").select("key", F.col("key").alias("group"))
    out = kept.write("groups", placed.where("n > 0").join(reach, "cls").select("key", "group").unionByName(alone))
    sc.remove()
    return out
