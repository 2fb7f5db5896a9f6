"""N-gram Jaccard join by set-relation skipping.

Sets are the distinct word shingles of documents. The join is exact:

* Equal sets form one class; only classes are indexed, copies are members.
* The index lists of a shingle hold the classes that have it in their prefix (the n - ceil(4n/5) + 1 first shingles
  in one global order, rare first). The order comes from counts over all documents in a bounded number of buckets;
  coarse counts only cost time, never a link. Each entry carries its position and set size. The list of a shingle is
  cut into blocks for pairs of neighbouring size classes, and an entry stands only in those blocks in which its position
  leaves enough overlap with the smallest set there may be: all others are skipped without a look. Within a block,
  pairs whose positions leave too little are skipped too.
* A pair whose parity sketches differ too much for a link is dropped before its sets are fetched; this loses no link.
* Answers are derived: a class is first compared with the hub of its lists that shares most prefix shingles. If they
  link, the class takes over the hub's component, and only entries of lists that still span more than one component
  are looked at again. What then remains is compared pair by pair, so no link between components is lost, while a group
  of thousands of near copies costs about one comparison a member.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.scratch import Scratch
from framelake.llm.words import shingle_sets

BLOCK = 1 << 16
BATCH = 256  # texts or pairs of sets that a Python worker gets at once
PAIRS = 1000  # pairs of sets that one task compares at least
SKETCH = 1024  # bits
HEAVY = 1024  # a list that may be longer is dealt out by a salt
BITS = 22  # of the table of counts, at most


def _count_shingles(words: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            pending, size = [], 0
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                pending.append(s)
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount((np.concatenate(pending) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    pending, size = [], 0
            if size:
                counts += np.bincount((np.concatenate(pending) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.any():
            blocks = counts.reshape(-1, min(BLOCK, 1 << bits))
            task = TaskContext.get().partitionId() % 509
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array([_packed(b) for b in blocks], pa.binary())], ["block", "task", "counts"])

    return run


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), dtype=np.uint32).astype(np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"block": table.column("block")[:1], "task": table.column("task")[:1], "counts": pa.array([_packed(total)], pa.binary())})


def shingle_counts(texts: DataFrame, words: int, bits: int) -> np.ndarray:
    """How many distinct (text, shingle) pairs fall into each of 2**bits buckets of the shingle's hash, over all texts.

    The result's size is fixed by ``bits``; partial counts are added in two levels, so no task reads more than some
    thousand blocks."""
    schema = "block int, task int, counts binary"
    parts = texts.mapInArrow(_count_shingles(words, bits), schema)
    for keys in (["block", "task"], ["block"]):
        parts = parts.groupBy(*keys).applyInArrow(_add_blocks, schema)
    out = np.zeros((max(1, (1 << bits) // BLOCK), min(BLOCK, 1 << bits)), dtype=np.uint32)
    for row in parts.select("block", "counts").collect():
        out[row.block] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint32)
    return out.ravel()


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parity(s: np.ndarray) -> bytes:
    """One bit for each of SKETCH buckets: whether an odd number of shingles fall into it. Two sets' sketches differ in
    no more bits than the sets differ in shingles."""
    return np.packbits(np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _prefixes(words: int, bits: int, counts, num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, usual = counts.value  # what a bucket holds above the usual is an estimate of its most frequent shingle
        for batch in batches:
            ids, sizes, keys, sketches, prefixes, salts = batch.column(0), [], [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), words):
                n = len(s)
                key = _set_key(s) if n else None
                often = table[(s >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[: n - -(-n * num // den) + 1 if n else 0]
                parts = -(-np.maximum(often[order].astype(np.int64) - usual, 1) // HEAVY)
                sizes.append(n)
                keys.append(key)
                sketches.append(_parity(s) if n else None)
                prefixes.append(s[order].view(np.int64))
                salts.append(np.where(parts > 1, 1 + int.from_bytes((key or b"")[-4:], "little") % parts, 0).astype(np.int32))
            lengths = np.concatenate(([0], np.cumsum([len(p) for p in prefixes], dtype=np.int64))).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)), pa.array(np.concatenate(salts) if salts else np.empty(0, np.int32))], ["shingle", "salt"])
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(lengths, flat)],
                ["doc_id", "n", "key", "sketch", "prefix"],
            )

    return run


def _near(num: int, den: int) -> Callable:
    """Drops pairs whose sketches differ in more bits than two linked sets of their sizes can in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            least = -(-num * (n + m) // (num + den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(differ <= n + m - 2 * least))

    return run


def _sets_of(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vids, keys, raws = [], [], []
            for vid, key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2).to_pylist(), words)):
                own = _set_key(s)
                if len(s) and key in (own, None):
                    vids.append(vid)
                    keys.append(own)
                    raws.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(vids, pa.int64()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vid", "key", "raw"])

    return run


def _verify(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _may_link(n: Column, pos: Column, m: Column, at: Column, num: int, den: int) -> Column:
    """Whether sets of n and m shingles that share the ones at pos and at can be similar enough: sizes, then positions."""
    overlap = 1 + F.least(n - pos, m - at) - 1
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * overlap >= num * (n + m))


def _vertices(classes: DataFrame) -> DataFrame:
    """Gives each class (key, least) a vid: the least doc_id of its rows or, if none has one, a hash of its key that is
    neither a doc_id nor another such hash."""
    named = classes.where("least is not null").select("key", F.col("least").alias("vid"))
    nameless = classes.where("least is null").select("key")
    if nameless.isEmpty():
        return named
    seed = 0
    while True:
        hashed = nameless.select("key", F.xxhash64("key", F.lit(seed)).alias("vid"))
        every = named.unionByName(hashed).groupBy("vid").agg(F.count("*").alias("n"), F.min("key").alias("key"))
        if every.where("n > 1").select("vid").join(hashed, "vid", "left_semi").isEmpty():
            return named.unionByName(hashed)
        seed += 1


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, bits: int | None = None, hub_rounds: int = 2, owner: str = "op5") -> DataFrame:
    """Links documents whose shingle sets have intersection / union >= num / den, and labels components.

    ``docs`` has doc_id and text; other columns are ignored. Returns doc_id, n_shingles and component_id (the least
    doc_id reachable by links, itself included), one row per row of ``docs``. A null or blank text has no shingles and
    is linked with nothing. Rows that share a doc_id are one vertex; any longs are ids. A row without doc_id links
    others, and has the least doc_id that it reaches or null. An empty table gives no rows.

    ``bits``: the table of counts has 2**bits buckets; about as many as there are shingles, up to ``BITS`` (16 MB).
    Beyond that, rare shingles share buckets and stand in any order, but a shingle that is frequent enough to make a
    long list still stands out of its bucket's usual count.
    """
    return jaccard_classes(docs, words, num, den, bits, hub_rounds, owner).drop("class_key")


def jaccard_classes(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, bits: int | None = None, hub_rounds: int = 2, owner: str = "op5") -> DataFrame:
    """As ``jaccard_components``, with class_key beside: the same bytes for all rows of a component, whether or not they
    have a doc_id; null for rows without shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark, owner)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.count()
    bits = bits or min(BITS, max(12, (128 * total).bit_length()))
    with scratch.batches(BATCH):
        table = shingle_counts(docs.select("text"), words, bits)
    counts = spark.sparkContext.broadcast((table, int(np.median(table))))
    schema = "doc_id long, n long, key binary, sketch binary, prefix array<struct<shingle: long, salt: int>>"
    prefixes = scratch.table("prefixes", docs.mapInArrow(_prefixes(words, bits, counts, num, den), schema).withColumn("row", F.monotonically_increasing_id()), BATCH)

    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    classes = scratch.table("keys", prefixes.where("n > 0").groupBy("key").agg(F.min(first).alias("first")).select("key", "first.row", F.col("first.doc_id").alias("least")), rows=total)
    classes = scratch.table("classes", _vertices(classes).join(classes.select("key", "row", "least"), "key"), rows=total)
    # One plan at every size, here and where sets are fetched: a broadcast would be right for small tables only.
    known = scratch.table("known", prefixes.join(classes.select("row", "vid").hint("merge"), "row").select("vid", "n", "key", "sketch", "prefix"))
    entries = known.select("vid", "n", F.posexplode("prefix").alias("pos", "e"))
    entries = entries.select("e.shingle", "e.salt", "vid", F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("np")).repartition("shingle", "salt")

    # Rows of several texts that share a doc_id link the classes of these.
    twice = prefixes.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi").select("doc_id")
    named = prefixes.where("n > 0").select("doc_id", "key").join(twice, "doc_id").join(classes.select("key", "vid"), "key")
    same = scratch.table("same", named.select(F.col("doc_id").alias("d"), F.col("vid").alias("b")).join(named.groupBy("doc_id").agg(F.min("vid").alias("a")), F.col("d") == F.col("doc_id")).where("a != b").select("a", "b").distinct(), rows=total)

    def hub(seed: int, *more: str) -> Column:
        """The entry with the fewest rarer shingles before it: of near copies, the one that was changed least."""
        return F.min(F.struct(F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), F.xxhash64("vid", F.lit(seed)).alias("h"), "vid", "np", *more)).alias("hub")

    def may_link(a: str, b: str) -> Column:
        size, place = (lambda c: F.shiftright(F.col(c), 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
        return _may_link(size(a), place(a), size(b), place(b), num, den)

    shared = entries.groupBy("shingle", "salt").agg(F.count("*").alias("c"), hub(0)).where("c > 1 or salt > 0").drop("c")
    lists = scratch.table("lists-0", entries.join(shared, ["shingle", "salt"]))

    def verified(pairs: DataFrame, turn: int) -> DataFrame:
        side = lambda v, *cols: known.select(F.col("vid").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in cols])
        both = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        # A class has one hub a turn; only what remains after the turns may be more pairs than there are rows.
        near = scratch.table(f"near-{turn}", both.mapInArrow(_near(num, den), "a long, b long"), rows=total if turn < hub_rounds else None)
        pairs_left = near.count()
        ids = near.select(F.col("a").alias("vid")).unionByName(near.select(F.col("b").alias("vid"))).distinct()
        keys = scratch.table(f"ids-{turn}", classes.join(ids, "vid").select("vid", "key", "least"), rows=total)
        named = docs.join(keys.where("least is not null").hint("merge"), F.col("doc_id") == F.col("least")).select("vid", "key", "text")
        sets = named.mapInArrow(_sets_of(words), "vid long, key binary, raw binary")
        nameless = keys.where("least is null").select(F.col("vid").alias("v"), F.col("key").alias("k"))
        if not nameless.isEmpty():
            own = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("vid"), F.lit(None).cast("binary").alias("key"), "text").mapInArrow(_sets_of(words), "vid long, key binary, raw binary")
            sets = sets.unionByName(own.join(nameless, F.col("key") == F.col("k")).select(F.col("v").alias("vid"), "key", "raw"))
        # Copies of a row give their set once.
        sets = scratch.table(f"sets-{turn}", sets.groupBy("vid", "key").agg(F.first("raw").alias("raw")) if copied else sets, BATCH)
        left = near.join(sets.select(F.col("vid").alias("a"), F.col("raw").alias("x")).hint("merge"), "a")
        full = left.join(sets.select(F.col("vid").alias("b"), F.col("raw").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
        links = scratch.table(f"links-{turn}", full.mapInArrow(_verify(num, den), "a long, b long"), BATCH, rows=pairs_left, each=PAIRS)
        scratch.drop(f"near-{turn}", f"sets-{turn}", f"ids-{turn}")
        return links

    # Whether any row of a class could stand for it besides the first: only then are sets of copies gathered.
    copied = not prefixes.where("n > 0").groupBy("key", "doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    comps = None
    for turn in range(hub_rounds):
        near = lists.where(F.col("comp") != F.col("hub.comp") if turn else F.col("vid") != F.col("hub.vid")).where(may_link("np", "hub.np"))
        best = near.groupBy("vid", F.col("hub.vid").alias("b")).agg(F.count("*").alias("c")).groupBy("vid").agg(F.max(F.struct("c", "b")).alias("top"))
        links = verified(best.select(F.col("vid").alias("a"), F.col("top.b").alias("b")), turn).unionByName(same)
        if comps is not None:
            links = links.unionByName(comps.select(F.col("vertex").alias("a"), F.col("component").alias("b")))
        comps = connected_components(scratch, links, f"comps-{turn}")
        labelled = lists.select("shingle", "salt", "vid", "np").join(comps, F.col("vid") == F.col("vertex"), "left").select("shingle", "salt", "vid", "np", F.coalesce("component", "vid").alias("comp"))
        # Long lists stay dealt out by their salt; what a shingle's parts have together goes back to each of them.
        part = labelled.groupBy("shingle", "salt").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), hub(turn + 1, "comp"))
        spread = part.groupBy("shingle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("c"), F.min("hub").alias("hub"), F.collect_list("salt").alias("salts")).where("lo < hi")
        lists = scratch.table(f"lists-{turn + 1}", labelled.join(spread.select("shingle", F.explode("salts").alias("salt"), "c", "hub"), ["shingle", "salt"]))
        scratch.drop(f"lists-{turn}")

    # A set's size class; partners are in the same class or the next, as sizes differ by den/num at most. An entry
    # stands in the blocks of its class and a next one if what its position leaves can reach the overlap that a link with
    # the smallest possible partner there takes.
    n, pos = F.shiftright("np", 32), F.col("np").bitwiseAND(F.lit((1 << 32) - 1))
    size_class = F.floor(F.log(n.cast("double")) / float(np.log(den / num)) + 1e-9).cast("int")
    smallest = lambda c: F.greatest(F.ceil(num * n / den), F.floor(F.pow(F.lit(den / num), c) * (1 - 1e-6)))
    visits = F.filter(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1), lambda c: (num + den) * (n - pos) >= num * (n + smallest(c)))
    parts = F.ceil(F.coalesce("c", F.lit(1)) / HEAVY).cast("int") if hub_rounds else F.lit(1)
    blocks = lists.withColumn("cls", size_class).withColumn("parts", parts).select("shingle", "vid", "np", "comp" if hub_rounds else F.col("vid").alias("comp"), "cls", "parts", F.explode(visits).alias("other"))
    pair = [F.least("cls", "other").alias("lo"), F.greatest("cls", "other").alias("hi")]
    lower = blocks.where("other >= cls").select("shingle", *pair, F.pmod(F.xxhash64("vid", F.lit(9)), "parts").cast("int").alias("part"), "vid", "np", "comp")
    upper = blocks.where("other <= cls").select("shingle", *pair, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_") for c in ("vid", "np", "comp")])
    met = lower.join(upper, ["shingle", "lo", "hi", "part"]).where((F.col("comp") != F.col("comp_")) & ((F.col("lo") < F.col("hi")) | (F.col("vid") < F.col("vid_"))) & may_link("np", "np_"))
    links = verified(met.select(F.least("vid", "vid_").alias("a"), F.greatest("vid", "vid_").alias("b")).distinct(), hub_rounds).unionByName(same)
    if comps is not None:
        links = links.unionByName(comps.select(F.col("vertex").alias("a"), F.col("component").alias("b")))
    comps = connected_components(scratch, links, "comps-rest")
    scratch.drop("known", "keys", f"lists-{hub_rounds}", "same", *[x for x in scratch.paths if x.startswith("links-")], *[x for x in scratch.paths if x.startswith("comps-") and not x.startswith("comps-rest")])

    labels = classes.join(comps, F.col("vid") == F.col("vertex"), "left").select("key", F.coalesce("component", "vid").alias("component"), "least")
    if not classes.where("least is null").isEmpty():  # a vertex may be a hash, which is no doc_id
        least = labels.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("doc"))
        labels = labels.join(least, F.col("component") == F.col("c")).select("key", "component", F.col("doc").alias("least"))
    else:
        labels = labels.select("key", "component", F.col("component").alias("least"))
    out = prefixes.select("doc_id", "n", "key").join(labels, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.when(F.col("key").isNotNull(), F.encode(F.col("component").cast("string"), "utf-8")).alias("class_key"))
