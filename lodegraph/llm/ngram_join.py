"""N-gram Jaccard self-join: near-duplicate classes and their connected components.

A document's set holds its distinct word shingles.  Equal sets are one class, known by a 128-bit digest; all joins are between
classes, ids come in only when components are named.  Shingles are told apart by 64-bit hashes; but for a collision of
these (once in 2**64 for a given pair) no link is lost and none is made up.

* Order: shingles are ordered rare first by counts over the whole corpus in hash buckets, on a fine logarithmic scale of two bytes.
  There are more buckets the larger the input is, up to 2**MOST_BITS (32 MB), which is what is broadcast at most.
* Prefix filter: two sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each.  Only these
  are joined, by shingle.  A task sends a class once, however many copies it meets, and shingles of crowded buckets go to
  several groups by class, so no group grows with one shingle; such shingles count as hot.
* Length filter and positional filter on the places where the shared shingle stands; the suffix filter bounds the
  overlap by how many members the sets have in each of about n / 6 hash ranges, a signature of a byte for each range that is
  made when the counts are.  Whole sets are fetched for the pairs that pass alone.
* A shingle in the prefixes of more than HOT classes would emit too many pairs.  Each class with such shingles picks
  ROUNDS of them, by smallest hash, so that near copies pick the same; those that picked the same are dealt into blocks, and all
  pairs of a block are compared inside a task, which returns a spanning forest.  Then only pairs are left that share a hot
  shingle, weren't in one block and aren't connected yet: what is outside a shingle's largest component meets the other
  components there, under the same filters, which the join holds by itself: by shingle and band of sizes.  So every pair is compared unless it is connected already, and a pair
  outside the blocks is verified once.

Defined cases: no words or a null text: an empty set that links with nothing; fewer words than a shingle: the whole
sequence is the set's one member; rows with a null id link with nothing (component null); rows that repeat an id are one vertex,
which has the links of each of its texts, whatever the order of rows; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import parted, sized_filter, small, written
from lodegraph.llm.components import components
from lodegraph.llm.words import shingles

HOT = 32
ROUNDS = 2
BLOCK = 256
CHUNKS = 64
#: Bands of set sizes for each factor of e.
BANDS = 64
#: Buckets of counts: one for each BUCKET_BYTES of text, within these bounds.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 256, 20, 24
#: Steps of the scale of counts for each doubling.
STEPS = 1_600
#: So many shingles of one bucket at most go to one group.
GROUP_ROWS = 1_000_000


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tk"))


def bucket_bits(docs: DataFrame) -> int:
    """As many bits as give each bucket about BUCKET_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (total // BUCKET_BYTES).bit_length()))


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> bytes:
    """How many members of a sorted set fall in each of 4 to 8 members' worth of hash ranges; nothing if a byte can't say it."""
    bits = min(20, max(1, len(s).bit_length() - 3))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: bytes, b: bytes) -> tuple[int, int]:
    """(at most so many members are in both, size of both together) by two signatures."""
    x, y = sorted((np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b)), key=len)
    if len(x) < len(y):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.minimum(x, y).sum()), int(x.sum() + y.sum())


def survey(docs: DataFrame, n: int, bits: int) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, tk, n, digest, sig) of every row, STEPS * log2 of how many shingles of all rows fell in each bucket)."""
    size, shift = 1 << bits, np.uint64(64 - bits)
    each = size // CHUNKS
    names = ["doc_id", "tk", "n", "digest", "sig", "chunk", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int32)
        for batch in small(batches):
            found = [shingles(t.as_py(), n) for t in batch.column(1)]
            if found:
                np.add.at(counts, (np.concatenate(found) >> shift).astype(np.int64), 1)
            digests = [set_digest(s) if len(s) else None for s in found]
            none = [None] * len(found)
            cols = [batch.column(0), batch.column(2), [len(s) for s in found], digests]
            cols += [[signature(s) if len(s) else None for s in found], none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        parts = [zlib.compress(counts[i * each : (i + 1) * each].tobytes(), 1) for i in range(CHUNKS)] if counts.any() else []
        none = [None] * len(parts)
        cols = [none, none, none, none, none, range(len(parts)), parts]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def add(key, t):
        total = np.zeros(each, np.int64)
        for x in t["counts"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        scale = np.minimum(65_535, STEPS * np.log2(total + 1)).astype(np.uint16)
        return pa.table({"chunk": t["chunk"][:1], "counts": pa.array([scale.tobytes()], pa.binary())})

    schema = "doc_id long, tk long, n long, digest binary, sig binary, chunk int, counts binary"
    found = written(_rows(docs).mapInArrow(look, schema), "survey")
    sums = found.filter("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    counts = np.zeros(size, np.uint16)
    for r in sums.collect():  # CHUNKS rows of a fixed size
        counts[r.chunk * each : (r.chunk + 1) * each] = np.frombuffer(r.counts, np.uint16)
    return found.filter("chunk IS NULL").select("doc_id", "tk", "n", "digest", "sig"), counts


def prefixes(docs: DataFrame, counts: np.ndarray, n: int, num: int, den: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(gram, salt, cls, n, pos): the rare-first prefix of every set, once for each class that a task meets.

    salt is -1 but for shingles of buckets that hold more than group_rows: these are dealt by class to groups from 0 on.
    """
    bits, crowded = int(np.log2(len(counts))), STEPS * np.log2(group_rows)
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["gram", "salt", "cls", "n", "pos"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift, met = sent.value, np.uint64(64 - bits), set()
        for batch in small(batches):
            grams, salts, digests, sizes, places, lengths = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), n)
                if not len(s) or doc is None:
                    continue
                digest = set_digest(s)
                if digest in met:
                    continue
                if len(met) >= 500_000:
                    met.clear()
                met.add(digest)
                m = len(s) - (len(s) * num + den - 1) // den + 1
                often = counts[(s >> shift).astype(np.int64)]
                if m < len(s):  # those that can be in the prefix, ties included, before sorting
                    near = np.flatnonzero(often <= np.partition(often, m - 1)[m - 1])
                    s_, often = s[near], often[near]
                else:
                    s_ = s
                order = np.lexsort((s_, often))[:m]
                often = often[order].astype(np.float64)
                groups = np.where(often > crowded, np.exp2(np.maximum(0, often - crowded) / STEPS) + 1, 0).astype(np.int64)
                grams.append(s_[order].view(np.int64))
                salts.append(np.where(groups > 0, int.from_bytes(digest[:4], "little") % np.maximum(1, groups), -1).astype(np.int32))
                digests.append(digest)
                sizes.append(np.full(m, len(s), np.int32))
                places.append(np.arange(m, dtype=np.int32))
                lengths.append(m)
            for i in range(0, len(grams), 2000):
                part = slice(i, i + 2000)
                own = np.repeat(np.arange(len(lengths[part])), lengths[part])
                cls = pa.array(digests[part], pa.binary()).take(pa.array(own))
                cols = [pa.array(np.concatenate(c[part])) for c in (grams, salts, sizes, places)]
                yield pa.RecordBatch.from_arrays([cols[0], cols[1], cls, cols[2], cols[3]], names=names)

    return _rows(docs).mapInArrow(cut, "gram long, salt int, cls binary, n int, pos int")


def passed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter lets through, by the signatures in classes."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("sig").alias(f"{x}_sig"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                shared, both = most_shared(a, b) if a and b else (1, 1)
                keep.append(shared * (num + den) >= num * both)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sig", "b_sig")
    return met.mapInArrow(look, "a binary, b binary")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, grams) of the classes in wanted (cls, doc_id, tk), each from the text of that row alone."""
    wanted = written(wanted, "wanted")
    near, _ = parted(_rows(docs), "doc_id", sized_filter(wanted, "doc_id"))
    near = near.join(wanted, ["doc_id", "tk"]).select("cls", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in small(batches):
            fresh = [i for i, c in enumerate(batch.column(0).to_pylist()) if c not in met and not met.add(c)]
            found = [shingles(batch.column(1)[i].as_py(), n).view(np.int64) for i in fresh]
            cols = [batch.column(0).take(pa.array(fresh, pa.int64())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["cls", "grams"])

    # Rows that repeat id and text give a class twice: one is kept.
    each = near.mapInArrow(grams, "cls binary, grams array<long>").groupBy("cls").agg(F.first("grams").alias("grams"))
    return written(each, "sets")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, each compared once."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("grams").alias(f"{x}_grams"))
    shared = f"size(array_intersect(a_grams, b_grams)) * {num + den} >= {num} * (size(a_grams) + size(b_grams))"
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(shared).select("a", "b")


def _kept(num: int, den: int) -> str:
    """The length and the positional filter on members a and b that share a gram."""
    return (
        f"least(na, nb) * {den} >= greatest(na, nb) * {num} "
        f"AND least(na - pa, nb - pb) * {num + den} >= {num} * (na + nb)"
    )


def _side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select("gram", F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), *more)


def _apart(a: str, b: str) -> str:
    """That two classes were in no block together; a, b: their arrays of blocks, by round, null outside all blocks."""
    return f"NOT coalesce(exists(sequence(0, {ROUNDS - 1}), k -> {a}[k] = {b}[k]), false)"


def _pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, open) of classes that share prefix grams; open: at one of them they pass the length and the positional filter
    (the first one common to both is where the filter is widest)."""
    met = _side(rows, "a").join(_side(rows, "b"), "gram").filter("a < b")
    return met.groupBy("a", "b").agg(F.some(F.expr(_kept(num, den))).alias("open"))


def _rest(hot: DataFrame, comps: DataFrame, cold: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that share a hot gram, pass the filters there, were in no block together and lie in different components.

    Pairs that are open in cold are decided already.  hot: gram, cls, n, pos, v (the vertex of the class), blocks.  Of two
    members of a gram one at least is outside the gram's largest component.  By both filters a place in a prefix says which sizes
    the other set may have, so a guest only meets the bands of these sizes.
    """
    rows = hot.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    sizes = rows.groupBy("gram", "comp").agg(F.count("*").alias("k"))
    tops = sizes.groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    open_ = written(rows.join(tops.filter("comps > 1").select("gram", F.col("top.comp").alias("top")), "gram"), "open")
    band = lambda x: f"CAST(floor(ln({x}) * {BANDS}) AS INT)"
    least, most = f"(n * {num} + {den - 1}) div {den}", f"least(n * {den} div {num}, (n - pos) * {num + den} div {num} - n)"
    guests = open_.filter("comp <> top").withColumns({"least": F.expr(least), "most": F.expr(most)}).filter("least <= most")
    guests = guests.withColumn("band", F.explode(F.expr(f"sequence({band('least')}, {band('most')})")))
    guests = _side(guests, "a", "band", F.col("comp").alias("ca"), F.col("blocks").alias("ba"))
    hosts = _side(open_, "b", F.expr(band("n")).alias("band"), F.col("comp").alias("cb"), F.col("blocks").alias("bb"), "top")
    met = guests.join(hosts, ["gram", "band"]).filter("ca <> cb AND (cb = top OR a < b)").filter(_kept(num, den)).filter(_apart("ba", "bb"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(cold.filter("open"), ["a", "b"], "left_anti")


def overlaps(sets: list[np.ndarray], columns: int = 16_384) -> np.ndarray:
    """How many members each two of the sets share, a few members at a time as a matrix product."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    rank = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
    shared = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(rank, np.arange(0, rank[-1] + columns + 1, columns))
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[lo:hi], rank[lo:hi] - i * columns] = 1
        shared += part @ part.T
    return shared


def _similar(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.float64)
    return overlaps(sets) * (num + den) >= (size[:, None] + size[None]) * num


def link_blocks(blocks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links that connect whatever is similar inside each block; blocks: (block, cls).

    Every pair of a block is compared; of its links, those of a spanning forest are returned.
    """
    both = blocks.join(sets, "cls").select("block", "cls", "grams")

    def link(key, t):
        ids = t["cls"].to_pylist()
        hits = np.argwhere(np.triu(_similar([np.asarray(x.values) for x in t["grams"]], num, den), 1))
        root = np.arange(len(ids))
        kept = []
        for i, j in hits:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                kept.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([min(x) for x in kept], pa.binary()), "b": pa.array([max(x) for x in kept], pa.binary())})

    return both.groupBy("block").applyInArrow(link, "a binary, b binary")


def _blocks(hot: DataFrame) -> DataFrame:
    """(cls, blocks): for each round, the class's block: about BLOCK classes that picked the same of their hot grams."""
    seeds = range(ROUNDS)
    picks = [F.min_by("gram", F.xxhash64("gram", F.lit(seed))).alias(f"g{seed}") for seed in seeds]
    out = hot.groupBy("cls").agg(*picks)
    for seed in seeds:
        sizes = out.groupBy(f"g{seed}").agg(F.count("*").alias("m")).filter("m > 1")
        place = F.pmod(F.xxhash64("cls", F.lit(seed)), F.ceil(F.col("m") / BLOCK))
        name = F.concat_ws("/", F.lit(seed), F.col(f"g{seed}"), place)
        out = out.join(sizes, f"g{seed}", "left").withColumn(f"b{seed}", F.when(F.col("m").isNotNull(), name)).drop("m")
    return out.select("cls", F.array([f"b{seed}" for seed in seeds]).alias("blocks"))


def _by_vertex(links: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("v").alias(f"{x}_v"))
    return links.join(side("a"), "a").join(side("b"), "b").select("a_v", "b_v")


def row_groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, bits: int | None = None, by_id: bool = False) -> DataFrame:
    """(doc_id, tk, n, class_id, grp, alone), one row for each row of docs; tk: hash of the text.

    grp is the group of the row's class: classes that links connect; null for rows without words or id.  With by_id, classes that
    share an id are connected too, and grp is the group's smallest id.  class_id: the smallest id with an equal set.  alone: the row
    is the only one of its group (by_id aside).  Nothing is joined by group, so a very large one is no hot key.
    """
    found, counts = survey(docs, n, bucket_bits(docs) if bits is None else bits)
    known = found.filter("digest IS NOT NULL AND doc_id IS NOT NULL").withColumnRenamed("digest", "cls")
    one = F.min(F.struct("doc_id", "tk", "sig"))
    classes = known.groupBy("cls").agg(one.alias("p"), F.count("*").alias("k"))
    # Written, so that a class keeps its number.  By id, classes with the same smallest id are one vertex.
    vertex = F.col("p.doc_id") if by_id else F.monotonically_increasing_id()
    classes = written(classes.select("cls", F.col("p.doc_id").alias("class_id"), "p.tk", "p.sig", "k", vertex.alias("v")), "classes")
    shared = prefixes(docs, counts, n, num, den).repartition("gram", "salt").dropDuplicates(["gram", "salt", "cls"])
    shared = shared.withColumn("g", F.count("*").over(W.partitionBy("gram", "salt")))
    shared = written(shared.filter("g > 1 OR salt >= 0"), "prefixes")
    cold = written(_pairs(shared.filter(f"g <= {HOT} AND salt < 0"), num, den), "cold")
    hot = shared.filter(f"g > {HOT} OR salt >= 0").select("gram", "cls", "n", "pos")
    blocks = written(_blocks(hot), "blocks")
    side = lambda x: blocks.select(F.col("cls").alias(x), F.col("blocks").alias(f"{x}_blocks"))
    pairs = cold.filter("open").join(side("a"), "a", "left").join(side("b"), "b", "left").filter(_apart("a_blocks", "b_blocks")).select("a", "b")
    pairs = written(passed(pairs, classes, num, den), "pairs")
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(blocks.select("cls")).distinct()
    sets = sets_of(docs, classes.join(needed, "cls", "left_semi").select("cls", F.col("class_id").alias("doc_id"), "tk"), n)
    links = verified(pairs, sets, num, den)
    dealt = not blocks.isEmpty()
    if dealt:
        each = blocks.select("cls", F.explode("blocks").alias("block")).filter("block IS NOT NULL")
        links = links.union(link_blocks(each, sets, num, den))
    edges = _by_vertex(links, classes)
    if by_id:
        held = known.join(classes.select("cls", "v"), "cls").select("doc_id", "v")
        several = held.groupBy("doc_id").agg(F.min("v").alias("a_v"), F.max("v").alias("b_v")).filter("a_v < b_v")
        edges = edges.union(held.join(several.select("doc_id", "a_v"), "doc_id").filter("v > a_v").select("a_v", F.col("v")).distinct())
    comps = components(edges)
    if dealt:
        rows = hot.join(classes.select("cls", "v"), "cls").join(blocks, "cls")
        rest = _rest(rows, comps, cold, num, den)
        more = _by_vertex(verified(written(passed(rest, classes, num, den), "rest"), sets, num, den), classes)
        comps = components(comps.select(F.col("v").alias("a_v"), F.col("comp").alias("b_v")).union(more))
    tops = comps.select(F.col("comp").alias("v")).distinct().withColumn("top", F.lit(True))
    named = classes.join(comps, "v", "left").join(tops, "v", "left").select(
        F.col("cls").alias("digest"), "class_id", F.coalesce("comp", "v").alias("grp"), F.expr("k = 1 AND comp IS NULL AND top IS NULL").alias("alone")
    )
    key = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    return found.withColumn("digest", key).join(named, "digest", "left").select("doc_id", "tk", "n", "class_id", "grp", "alone")


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), one row for each row of docs; similarity num / den or more links."""
    rows = written(row_groups(docs, n, num, den, bits, by_id=True), "row-groups")
    full = rows.filter("grp IS NOT NULL").select("doc_id", "n", F.col("grp").alias("component_id"), "class_id")
    # A row without words shares the vertex of its id's other rows.
    bare = rows.filter("grp IS NULL")
    others = full.join(bare.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("c"))
    bare = bare.join(others, "doc_id", "left").select("doc_id", "n", F.coalesce("c", "doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return full.union(bare).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
