"""Token ids as binary files: an adaptive context-mixing range coder over independent blocks.

Each block is coded on its own, from a fresh model, and carries a checksum of its ids.  Its header lists which ids occur in it;
the coder sees them as codes 0, 1, 2, ...  For every id three models speak: order 2 and order 1 each name the id that last
followed the two ids (the one id) before, order 0 gives every code of the block a share by how often it came so far.  How
far orders 2 and 1 are to be trusted is a logistic mix of three adaptive estimates (how often an id named this surely was right,
how often after the same last steps, and both); its weights are learned as the block goes, for each order on its own.  What
they leave is shared out by order 0.  So every id is one step of one range coder, with 12 bits for who was right and 12 for
order 0 (more in blocks of more than 2048 different ids).  What is learned from the steps is worked in at renewals.

All results are whole numbers (two quotients are taken in floating point, which has them exactly), so a file reads the same on
every machine.  A block is coded in STRETCHES stretches side by side, each with a range coder of its own; they share the block's
model, which learns from all of them at each step.  Numpy codes many blocks side by side, one id of each stretch at a time;
the blocks know nothing of each other, so a reader may decode any of them alone.

Files hold documents in ascending order of id: cuts of the ids deal documents to ranges, ids of tokens (not texts) are shuffled
by range and sorted, each task writes the blocks of its ranges, and block headers say which documents end where.

Defined cases: a null text is the end id alone; rows with a null id come first; repeated rows follow each other, and an id
that very many rows share spreads over several ranges; ids of any size up to 32 bits; an empty table gives no blocks
and an empty result; extra columns are ignored; a block whose ids don't have its checksum is an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import small, written
from lodegraph.llm.tokens import encoder

BLOCK_IDS = 8_192
#: Blocks that are coded side by side, and stretches of a block that are: these share the block's model.
LANES, STRETCHES = 512, 8
#: A range holds about so many bytes of text, but there are never more than MOST_RANGES: a task streams through its range.
RANGE_BYTES, MOST_RANGES = 20_000_000, 20_000
#: Texts that are encoded at once.
TEXTS = 2_048
SLOTS = 4_096
#: Bits for who was right, and at least for order 0 (more for blocks with more different ids).
ONE, LEAST_WHOLE = 12, 12
LEAST, LOW, TOLD = 1 << 32, (1 << 32) - 1, 1 << ONE
_p = np.arange(1 << ONE) + 0.5
STRETCH = np.clip(np.round(256 * np.log(_p / ((1 << ONE) - _p))), -2047, 2047).astype(np.int64)
#: The bounds leave each of order 2, order 1 and order 0 a share.
SQUASH = np.clip(np.round((1 << ONE) / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 64, (1 << ONE) - 64).astype(np.int64)
#: Contexts of an order: [how sure, last three steps named or not, whether both orders name the same id].
CONTEXTS = (4, 8, 2)
#: How often ids named this surely are right, before a block says more (of 2**ONE), and the weights it starts from (of 2**16).
PRIOR = np.array([500, 1_600, 2_400, 3_300]).reshape(4, 1, 1)
WEIGHTS = (20_000, 20_000, 30_000)
#: Order 0 and the shares are renewed after FIRST steps (divisible by 4), then twice as many each time up to EVERY, then always after EVERY.
FIRST, EVERY = 16, 512


def whole_bits(size: int) -> int:
    """Bits of order 0 in a block of so many different ids."""
    return max(LEAST_WHOLE, (size - 1).bit_length() + 1)


class Model:
    """The adaptive state of many blocks, STRETCHES lanes each; sizes: how many codes each block has; whole: the bits of order 0.

    A step only looks up shares and notes what came; all that is learned from it waits for the next renewal.
    """

    def __init__(self, sizes: list[int], whole: int, reads: bool):
        self.sizes, self.whole, self.reads = np.asarray(sizes), whole, reads
        blocks, self.width = len(sizes), int(max(sizes))
        block = np.repeat(np.arange(blocks), STRETCHES)
        lanes = len(block)
        # What came last, as code * 4 + how sure: all slots of order 2, then those of order 1.
        self.tab = np.zeros(blocks * (SLOTS + self.width), np.uint16 if self.width <= 1 << 14 else np.int32)
        self.at = np.stack([block * SLOTS, blocks * SLOTS + block * self.width])
        self.at0 = block * self.width
        self.base = np.stack([block * 128, block * 128 + 64])
        self.ix, self.ctx = self.at.copy(), np.zeros((2, lanes), np.int64)
        self.hist = np.zeros(lanes, self.tab.dtype)
        self.before = np.zeros(lanes, np.int64)
        self.kind = np.int32 if whole <= 14 else np.int64
        # Of order 0: how often each code came; then its first share and its number of shares in one number.
        self.count = (np.arange(self.width) < self.sizes[:, None]).astype(self.kind)
        # Of orders 2 and 1: how often a context came and was right, by [lane, order, *CONTEXTS].
        self.came, self.right = np.zeros((2, blocks, 2, *CONTEXTS), np.int64)
        self.weight = np.zeros((3, blocks, 2, 1, 1, 1), np.int64) + np.reshape(WEIGHTS, (3, 1, 1, 1, 1, 1))
        self.noted = np.zeros((EVERY // 4, 2, lanes), np.uint8)
        self.codes_seen = np.zeros((EVERY, lanes), np.uint16)
        self.step, self.due, self.k = 0, FIRST, 0
        self.share()
        self.mix()

    def share(self) -> None:
        """Order 0 from the counts so far: shares of 2**whole, at least 1 for each code of the block."""
        free = (1 << self.whole) - self.sizes
        freq = self.count * (free * 65536 // self.count.sum(1)).astype(self.kind)[:, None]
        freq >>= 16
        freq += 1
        freq *= np.arange(self.width) < self.sizes[:, None]
        freq[:, 0] += (1 << self.whole) - freq.sum(1)
        first = np.cumsum(freq, axis=1, dtype=self.kind)
        first -= freq
        first <<= self.whole + 1
        first |= freq
        self.cf = first.reshape(-1)
        if self.reads:  # which code each share belongs to
            codes = np.broadcast_to(np.arange(self.width, dtype=np.uint16), freq.shape)
            self.owner = np.repeat(codes.reshape(-1), freq.reshape(-1))

    def mix(self) -> None:
        """The share of each context of orders 2 and 1: three estimates (by sureness, by the last steps, by both), mixed."""
        n, h = self.came, self.right
        by_level = (h.sum(4, keepdims=True) * TOLD + 2 * PRIOR) // (n.sum(4, keepdims=True) + 2)
        by_last = (h.sum(3, keepdims=True) * TOLD + 2_000) // (n.sum(3, keepdims=True) + 2)
        by_both = (h * TOLD + 4 * by_level) // (n + 4)
        top = TOLD - 1
        self.told = [STRETCH[np.minimum(p, top)] for p in (by_level, by_last, by_both)]
        z = sum(w * s for w, s in zip(self.weight, self.told))
        p = SQUASH.take((z >> 16) + 2048, mode="clip")
        self.p = p.copy()
        p[:, 1, :, :, 1] = 0  # order 1 has nothing to add
        self.shares = p.reshape(-1).astype(np.int32)

    def renew(self) -> None:
        """Learn from the steps since the last time."""
        blocks, k = len(self.sizes), self.k
        at = self.codes_seen[:k] + self.at0
        self.count += (24 * np.bincount(at.reshape(-1), minlength=self.count.size)).astype(self.kind).reshape(self.count.shape)
        noted = self.noted[: k // 4]
        at = noted + 2 * self.base
        asked = ~((noted[:, 0] | noted[:, 0] >> 1) & 1).astype(bool)  # order 1, where order 2 was wrong and it had another id
        every = np.concatenate([at[:, 0].reshape(-1), at[:, 1][asked]])
        found = np.bincount(every, minlength=256 * blocks).reshape(blocks, 2, *CONTEXTS, 2)
        n, h = found.sum(-1), found[..., 1]
        err = h * TOLD - n * self.p
        total = n.sum((2, 3, 4), keepdims=True) + 16
        for w, s in zip(self.weight, self.told):
            w += np.clip((s * err).sum((2, 3, 4), keepdims=True) // total, -16_000, 16_000)
        self.came += n
        self.right += h
        self.k = 0
        self.share()
        self.mix()

    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of order 2 and order 1, of 2**ONE, with room for order 0; the ids that they name are in codes."""
        got = self.tab.take(self.ix, mode="clip")
        self.codes = got >> 2
        got &= 3
        self.level = got
        self.mark = got << 4
        self.mark |= self.hist
        self.mark |= self.codes[0] == self.codes[1]
        np.add(self.base, self.mark, out=self.ctx)
        two, one = self.shares.take(self.ctx, mode="clip")
        one *= TOLD - two
        one >>= ONE
        return two, one

    def learn(self, x: np.ndarray, hits: np.ndarray) -> None:
        """x: the codes that came; hits: whether order 2, whether order 1 had named them."""
        if self.k & 3 == 3:  # orders 2 and 1 learn from every fourth step
            self.mark <<= 1
            self.mark |= hits
            self.noted[self.k >> 2] = self.mark
        self.codes_seen[self.k] = x
        self.k += 1
        level = self.level
        level += 1
        np.minimum(level, 3, out=level)
        level *= hits
        level += x.astype(level.dtype) << 2
        self.tab[self.ix] = level
        self.hist |= hits[0] | hits[1]  # its lowest bit is free for `same`
        self.hist <<= 1
        self.hist &= 14
        last = x.astype(np.int64)
        ix = self.ix
        np.multiply(last, 40503, out=ix[0])
        ix[0] += self.before
        ix[0] >>= 3
        ix[0] &= SLOTS - 1
        ix[1] = last
        ix += self.at
        last *= 30011
        self.before = last
        self.step += 1
        if self.step == self.due:
            self.renew()
            self.due += min(self.due, EVERY)


def by_bits(sizes: list[int]) -> list[tuple[int, list[int]]]:
    """(bits of order 0, the blocks that have them): a block's bits go by its own size, whoever is coded beside it."""
    bits = [whole_bits(s) for s in sizes]
    return [(w, [i for i, b in enumerate(bits) if b == w]) for w in sorted(set(bits))]


def encode_blocks(blocks: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    """The coded bytes of each block of codes; sizes: how many codes each has."""
    out: list[bytes] = [b""] * len(blocks)
    for whole, some in by_bits(sizes):
        for i, payload in zip(some, _encode([blocks[i] for i in some], [sizes[i] for i in some], whole)):
            out[i] = payload
    return out


def stretches(n: int) -> list[tuple[int, int]]:
    """Where the stretches of a block of n ids start and end; the last may be shorter or empty."""
    each = -(-n // STRETCHES)
    return [(min(n, i * each), min(n, (i + 1) * each)) for i in range(STRETCHES)]


def _encode(blocks: list[np.ndarray], sizes: list[int], whole: int) -> list[bytes]:
    parts = [b[i:j] for b in blocks for i, j in stretches(len(b))]
    lanes, n = len(parts), np.array([len(p) for p in parts])
    width, least, base, mask = int(n.max()), int(n.min()), ONE + whole, (1 << (whole + 1)) - 1
    ids = np.zeros((width, lanes), np.uint16)
    for i, p in enumerate(parts):
        ids[: len(p), i] = p
    m, at = Model(sizes, whole, False), np.zeros(lanes, np.int64)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << 47, np.int64)
    # What may go out at each step, and whether it does.
    words, sent, k = np.zeros((width + 64, lanes), np.int32), np.zeros((width + 64, lanes), bool), 0
    for step in range(width):
        x = ids[step]
        p2, p1 = m.look()
        hits = m.codes == x
        two, one = hits
        np.add(m.at0, x, out=at)
        c = m.cf.take(at, mode="clip")
        f = c & mask
        c >>= whole + 1
        both = p2 + p1
        esc = TOLD - both
        p2 <<= whole
        p1 <<= whole
        both <<= whole
        c *= esc
        f *= esc
        c += both
        start = np.where(one, p2, c)
        start *= ~two
        freq = np.where(two, p2, np.where(one, p1, f))
        r = rng >> base
        if step >= least:
            live = n > step
            low += r * start * live
            rng = np.where(live, r * freq, rng)
        else:
            low += r * start
            rng = r * freq
        short = rng < LEAST
        while short.any():
            if k == len(words):
                words, sent = np.concatenate([words, np.zeros_like(words)]), np.concatenate([sent, np.zeros_like(sent)])
            np.right_shift(low, 32, out=words[k], casting="unsafe")
            sent[k] = short
            k += 1
            rng <<= short * np.int64(16)
            low = np.where(short, (low & LOW) << 16, low)
            short = rng < LEAST
        m.learn(x, hits)
    used = sent[:k].sum(0)
    out = np.zeros((lanes, int(used.max(initial=0)) + 3), np.int32)
    out[np.arange(out.shape[1]) < used[:, None]] = words[:k].T[sent[:k].T]
    lane = np.arange(lanes)
    for _ in range(3):
        out[lane, used] = low >> 32
        used += 1
        low = (low & LOW) << 16
    for j in range(out.shape[1] - 1, 0, -1):  # words may have one bit too many: carry it
        out[:, j - 1] += out[:, j] >> 16
    raw = (out & 0xFFFF).astype("<u2")
    heads = used.astype("<u4").reshape(-1, STRETCHES)
    coded = [raw[i, : used[i]].tobytes() for i in range(lanes)]
    return [h.tobytes() + b"".join(coded[i * STRETCHES : (i + 1) * STRETCHES]) for i, h in enumerate(heads)]


def decode_blocks(payloads: list[bytes], counts: list[int], sizes: list[int]) -> list[np.ndarray]:
    """The codes of each block; counts: how many it holds."""
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(payloads)
    for whole, some in by_bits(sizes):
        for i, codes in zip(some, _decode([payloads[i] for i in some], [counts[i] for i in some], [sizes[i] for i in some], whole)):
            out[i] = codes
    return out


def _decode(payloads: list[bytes], counts: list[int], sizes: list[int], whole: int) -> list[np.ndarray]:
    spans = [stretches(k) for k in counts]
    n = np.array([j - i for x in spans for i, j in x])
    lanes, width, least, base, mask = len(n), int(n.max()), int(n.min()), ONE + whole, (1 << (whole + 1)) - 1
    coded = []
    for p in payloads:
        at = np.concatenate([[0], np.cumsum(np.frombuffer(p[: 4 * STRETCHES], "<u4"), dtype=np.int64)])
        rest = np.frombuffer(p[4 * STRETCHES :], "<u2")
        coded += [rest[i:j] for i, j in zip(at[:-1], at[1:])]
    longest = max(map(len, coded)) + 4
    words = np.zeros((lanes, longest), np.uint16)
    for i, c in enumerate(coded):
        words[i, : len(c)] = c
    flat, nxt = words.reshape(-1), np.arange(lanes) * longest + 3
    m = Model(sizes, whole, True)
    first = words[:, :3].astype(np.int64)
    code, rng = first[:, 0] << 32 | first[:, 1] << 16 | first[:, 2], np.full(lanes, 1 << 47, np.int64)
    ids = np.zeros((width, lanes), np.uint16)
    own, top = np.repeat(np.arange(len(counts)), STRETCHES) << whole, (1 << base) - 1
    for step in range(width):
        p2, p1 = m.look()
        r = rng >> base
        # Quotients of whole numbers below 2**48 by such below 2**24, and of 2**29 by 2**12: floating point has their whole part exactly.
        v = code / r
        v = np.minimum(v, top, out=v).astype(m.kind)
        both = p2 + p1
        esc = TOLD - both
        p2 <<= whole
        p1 <<= whole
        both <<= whole
        two, one = v < p2, v < both
        v -= both
        np.maximum(v, 0, out=v)
        at = (v / esc).astype(np.int64)
        at += own
        x0 = m.owner.take(at, mode="clip")
        np.add(m.at0, x0, out=at)
        c = m.cf.take(at, mode="clip")
        f = c & mask
        c >>= whole + 1
        c *= esc
        f *= esc
        c += both
        x = np.where(two, m.codes[0], np.where(one, m.codes[1], x0))
        start = np.where(one, p2, c)
        start *= ~two
        freq = np.where(two, p2, np.where(one, p1, f))
        if step >= least:
            live = n > step
            x = x * live
            code -= r * start * live
            rng = np.where(live, r * freq, rng)
        else:
            code -= r * start
            rng = r * freq
        ids[step] = x
        short = rng < LEAST
        while short.any():
            rng <<= short * np.int64(16)
            code = np.where(short, code << 16 | flat.take(nxt, mode="clip"), code)
            nxt += short
            short = rng < LEAST
        m.learn(x, m.codes == x)
    return [np.concatenate([ids[: j - i, k * STRETCHES + q] for q, (i, j) in enumerate(x)]) for k, x in enumerate(spans)]


#: Scratch of alphabet(): _met is all false between calls, _place is written before it is read.
_met, _place = np.zeros(1 << 16, bool), np.zeros(1 << 16, np.uint16)


def alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different ids, ascending; each id's place among them)."""
    if int(ids.max()) >= 1 << 16:
        found, codes = np.unique(ids, return_inverse=True)
        return found, codes.astype(np.uint16)
    ids = ids.astype(np.int64)
    _met[ids] = True
    found = np.flatnonzero(_met)
    _met[found] = False
    _place[found] = np.arange(len(found))
    return found, _place.take(ids)


def gaps_out(ascending: np.ndarray) -> bytes:
    """Ascending whole numbers as gaps, seven bits to a byte, the high bit where a gap goes on."""
    gap = np.diff(ascending.astype(np.int64), prepend=-1) - 1
    n = 1 + sum((gap >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[start[some] + k] = (gap[some] >> 7 * k & 127) | np.where(n[some] > k + 1, 128, 0)
    return out.tobytes()


def gaps_in(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], b[:-1] < 128]))
    k = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.cumsum(np.add.reduceat((b & 127) << 7 * k, start) + 1) - 1


#: A block as a row of the files.
SCHEMA = (
    "part int, block int, before long, n int, crc32 long, first_doc int, lead int, doc_ids array<long>, ends array<int>, "
    "size int, alphabet binary, payload binary"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = [
    pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()),
    pa.int32(), pa.binary(), pa.binary(),
]


def range_cuts(docs: DataFrame, ranges: int | None = None) -> np.ndarray:
    """Ascending ids that cut docs into ranges of about RANGE_BYTES of text; an id with very many rows is a cut more than once."""
    if ranges is None:
        total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 0
        ranges = min(MOST_RANGES, max(1, math.ceil(total / RANGE_BYTES)))
    if ranges == 1:
        return np.zeros(0, np.int64)
    at = [i / ranges for i in range(1, ranges)]
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    found = docs.agg(F.percentile_approx(id_, at, max(10_000, 20 * ranges))).first()[0]
    return np.array(found or [], np.int64)


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, cuts: np.ndarray) -> DataFrame:
    """(part, doc_id, wide, ids): each document's ids with the end id, two bytes each, four if wide."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("spread"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        for batch in small(batches, TEXTS):
            key = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            part = low + batch.column(2).to_numpy(zero_copy_only=False) % np.maximum(1, high - low)
            wide, ids = [], []
            for x in of.many(batch.column(1)):
                wide.append(bool(max(end_id, x.max(initial=0)) >= 1 << 16))
                kind = "<u4" if wide[-1] else "<u2"
                ids.append(x.astype(kind).tobytes() + np.array(end_id, kind).tobytes())
            cols = [pa.array(part, pa.int32()), batch.column(0), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "wide", "ids"])

    return rows.mapInArrow(tokenise, "part int, doc_id long, wide boolean, ids binary")


class Writer:
    """Cuts the ids of documents into blocks; a range's blocks are numbered from 0 and follow each other."""

    def __init__(self):
        self.ready: list[tuple] = []
        self.part, self.held = None, 0

    def start(self, part: int) -> None:
        self.finish()
        self.part, self.done, self.doc_no, self.lead = part, 0, 0, 0
        self.ids, self.doc_ids, self.ends = [], [], []

    def add(self, doc: int | None, x: np.ndarray) -> None:
        while True:
            take = min(len(x), BLOCK_IDS - self.held)
            self.ids.append(x[:take])
            self.held += take
            self.doc_ids.append(doc)
            self.ends.append(self.held)
            x = x[take:]
            if self.held == BLOCK_IDS:
                self._close(self.doc_no, len(x) > 0)
            if not len(x):
                break
        self.doc_no += 1

    def finish(self) -> None:
        if self.held:
            self._close(self.doc_no - 1, False)

    def _close(self, last: int, unfinished: bool) -> None:
        """The block up to document number `last` of the range."""
        whole = np.concatenate(self.ids).astype("<u4")
        head = (self.part, self.done, self.done * BLOCK_IDS, self.held, zlib.crc32(whole.tobytes()), last - len(self.doc_ids) + 1)
        self.ready.append((*head, self.lead, self.doc_ids, self.ends, *alphabet(whole)))
        self.lead = (self.lead + 1 if len(self.doc_ids) == 1 else 1) if unfinished else 0
        self.ids, self.doc_ids, self.ends, self.done, self.held = [], [], [], self.done + 1, 0

    def blocks(self, least: int) -> Iterator[pa.RecordBatch]:
        """What is ready, LANES blocks at a time, as long as there are `least`."""
        while len(self.ready) >= least and self.ready:
            some, self.ready = self.ready[:LANES], self.ready[LANES:]
            sizes = [len(r[-2]) for r in some]
            payloads = encode_blocks([r[-1] for r in some], sizes)
            cols = [*map(list, zip(*(r[:-2] for r in some))), sizes, [gaps_out(r[-2]) for r in some], payloads]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS)], names=NAMES)


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = 0, ranges: int | None = None) -> DataFrame:
    """Encode docs in ascending order of id and write the files; the blocks as read back, see SCHEMA.

    A block holds BLOCK_IDS ids (the last of a range fewer), `before` ids of its range come before it; doc_ids are those of
    the documents with ids in it, from number first_doc of the range on, and ends says where each ends in the block; the first
    of them has `lead` earlier blocks.
    """
    cuts = range_cuts(docs, ranges)
    rows = token_rows(docs, tokenizer, end_id, cuts)
    rows = rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer()
        for batch in small(batches):
            for part, doc, wide, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if part != out.part:
                    out.start(part)
                out.add(doc, np.frombuffer(ids, "<u4" if wide else "<u2"))
            yield from out.blocks(LANES)
        out.finish()
        yield from out.blocks(1)

    return written(rows.mapInArrow(code, SCHEMA), "token-blocks", compression="none")


def read_blocks(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """(part, doc_no, doc_id, lead, at, n, crc32[, ids]): each document's ids in each block, decoded and checked."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_no", "doc_id", "lead", "at", "n", "crc32", "ids"][: 8 if with_ids else 7]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(0, batch.num_rows, LANES):
                rows = batch.slice(i, LANES).to_pylist()
                out: list[list] = [[] for _ in names]
                codes = decode_blocks([r["payload"] for r in rows], [r["n"] for r in rows], [r["size"] for r in rows])
                for r, c in zip(rows, codes):
                    ids = gaps_in(r["alphabet"]).astype("<u4").take(c).tobytes()
                    if zlib.crc32(ids) != r["crc32"]:
                        raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                    at = 0
                    for k, (doc, stop) in enumerate(zip(r["doc_ids"], r["ends"])):
                        own = ids[4 * at : 4 * stop]
                        head = (r["part"], r["first_doc"] + k, doc, r["lead"] if not k else 0)
                        for column, v in zip(out, (*head, r["before"] + at, stop - at, zlib.crc32(own), own)):
                            column.append(v)
                        at = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    schema = "part int, doc_no int, doc_id long, lead int, at long, n long, crc32 long" + (", ids binary" if with_ids else "")
    return blocks.mapInArrow(decode, schema)


def join_crc(pieces: list[tuple[int, int]]) -> int:
    """The checksum of a whole from (bytes, checksum) of its pieces, in order."""
    whole = 0
    for n, crc in pieces:
        none = bytes(n)
        whole = zlib.crc32(none, whole) ^ zlib.crc32(none) ^ crc
    return whole


def document_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    sums = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    # One row for each range of the writer.
    bases = sums.select(F.col("part").alias("p"), (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("base"))
    found = read_blocks(blocks).groupBy("part", "doc_no", "doc_id").agg(
        F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("lead", "n", "crc32"))).alias("pieces")
    )
    found = found.join(F.broadcast(bases), F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.col("at"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = [join_crc([(4 * p["n"], p["crc32"]) for p in x]) if len(x) > 1 else x[0]["crc32"] for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(whole, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of docs and describe them from the files: (doc_id, start, n_tokens, ids_crc32)."""
    return document_ids(write_blocks(docs, tokenizer, end_id))
