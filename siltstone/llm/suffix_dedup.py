"""Removal of byte strings that documents repeat, by suffix arrays over content-defined shards.

Every string of LENGTH bytes belongs to the smallest hash among its GRAM-byte pieces (its anchor),
so equal strings have equal anchors and meet in one shard, whatever documents hold them. A run of
consecutive strings with one anchor is a span. Documents are dealt once into blocks of bounded
size; blocks and shards then exchange packed arrays:

1. blocks send the anchors they hold (31-bit fingerprints), shards answer with those that more
   than one document holds;
2. blocks send the spans of those anchors, each distinct span once with the smallest document
   that has it; a shard sorts the suffixes of its spans by Larsson-Sadakane refinement, takes
   common prefixes by Kasai's method, and where its spans exceed SHARD bytes merges the sorted
   parts by binary search; it answers with the strings of each span that a smaller document has;
3. blocks remove what those strings cover.

Copies of a whole text are recognised by digest beforehand and take no part in the exchange.
Fingerprints only choose what is compared; what is removed was compared byte by byte.

Defined cases: null counts as empty; a text shorter than LENGTH loses nothing; rows that repeat
an id don't remove each other's text; a null id removes nothing and loses nothing; an empty
table gives no rows; columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, table, written
from .hashing import mixed

LENGTH, GRAM = 50, 16
SPREAD = LENGTH - GRAM + 1
#: Bytes of text in a block, of text looked at together within it, and of spans sorted together.
BLOCK, CHUNK, SHARD = 16 << 20, 1 << 17, 4 << 20
SHARDS_PER_BLOCK = 5
COPY, ANCHOR, ANSWER = 0, 1, 2
NOTES = "block int, kind int, shard int, num bigint, data binary"
U64 = np.uint64


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, last string (starting positions) and anchor fingerprint of every span of the texts
    data[begin:end]; no string crosses texts."""
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, np.zeros(0, U64)
    m = len(data) - GRAM + 1
    eight = np.empty(m + 8, U64)
    for o in range(8):
        k = (len(data) - o) // 8
        part = data[o : o + 8 * k].view(U64)
        eight[o::8] = part[: len(eight[o::8])]
    with np.errstate(over="ignore"):
        g = mixed(eight[:m] * U64(0x9E3779B97F4A7C15) + eight[8 : m + 8] * U64(0xC2B2AE3D27D4EB4F))
    # hash above, position below: the smallest is the leftmost of the smallest hashes
    v = (g & U64(0xFFFFFFFF00000000)) | np.arange(m, dtype=U64)
    width = 1
    while 2 * width <= SPREAD:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < SPREAD:
        v = np.minimum(v[: len(v) - (SPREAD - width)], v[SPREAD - width :])
    anchor = (v[:n] & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    long = end - begin >= LENGTH
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, end[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    change = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(inside, prepend=False) != 0))
    last = np.append(change[1:], n) - 1
    ok = inside[change]
    with np.errstate(over="ignore"):
        return change[ok], last[ok], mixed(g[anchor[change[ok]]] + U64(12345))


class Block:
    """The documents of a block in a fixed order, and what its spans are."""

    def __init__(self, docs: pd.DataFrame, notes: pd.DataFrame, shards: int):
        self.shards = shards
        rows = sorted(((None if pd.isna(d) else int(d), t.encode("utf-8", "surrogatepass")) for d, t in zip(docs["doc_id"], docs["text"], strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [d for d, _ in rows]
        self.raw = [t for _, t in rows]
        copies = notes[notes["kind"] == COPY]
        known = set(zip(copies["num"].astype("int64"), map(bytes, copies["data"]), strict=True))
        with_copies = {d for d, _ in known}
        self.copy = [d in with_copies and (d, hashlib.sha256(t).digest()) in known for d, t in rows]

    def chunks(self) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Documents to compare, a few at a time: their places, the bytes, where each begins and ends."""
        some: list[int] = []
        size = 0
        for i, t in enumerate(self.raw):
            if self.copy[i] or self.ids[i] is None or len(t) < LENGTH:
                continue
            some.append(i)
            size += len(t)
            if size >= CHUNK:
                yield self.joined(some)
                some, size = [], 0
        if some:
            yield self.joined(some)

    def joined(self, some: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        sizes = np.array([len(self.raw[i]) for i in some])
        return some, np.frombuffer(b"".join([self.raw[i] for i in some]) + bytes(16), np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def spans(self) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for some, data, edge in self.chunks():
            first, last, mark = spans(data, edge[:-1], edge[1:])
            # 16 bytes of padding follow the last text; strings never reach into them
            shard = (mark >> U64(32)) % U64(self.shards)
            yield some, data, edge, first, last, shard.astype(np.int64), (mark & U64(0x7FFFFFFF)).astype(np.int64)


def send_anchors(block: int, b: Block) -> pd.DataFrame:
    held, whose = [], []
    for some, _, edge, first, _, shard, mark in b.spans():
        held.append(shard << 31 | mark)
        whose.append(np.array([b.ids[i] for i in some])[np.searchsorted(edge, first, side="right") - 1])
    if not held:
        return pd.DataFrame(columns=["block", "shard", "data"])
    key, doc = np.concatenate(held), np.concatenate(whose)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    key = key[at]
    packed = ((key & 0x7FFFFFFF) << 1 | several).astype(np.uint32)
    shard = key >> 31
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    return pd.DataFrame({"block": block, "shard": shard[cut], "data": [x.tobytes() for x in np.split(packed, cut[1:])]})


def shared_anchors(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, which of its anchors more than one document holds."""
    each = [np.frombuffer(x, np.uint32) for x in pdf["data"]]
    mark = np.concatenate(each) >> 1
    several = np.concatenate(each) & 1 == 1
    values, where, n = np.unique(mark, return_inverse=True, return_counts=True)
    more = n > 1
    more[where[several]] = True
    chosen = more[where]
    out, at = [], 0
    for block, x in zip(pdf["block"], each, strict=True):
        own = mark[at : at + len(x)][chosen[at : at + len(x)]]
        at += len(x)
        if len(own):
            out.append((block, ANCHOR, key[0], 0, own.tobytes()))
    return pd.DataFrame(out, columns=["block", "kind", "shard", "num", "data"])


class Shared:
    """The spans of a block whose anchors are shared: each distinct span in each shard, in order of appearance."""

    def __init__(self, b: Block, notes: pd.DataFrame):
        asked = notes[notes["kind"] == ANCHOR]
        keys = [np.int64(s) << 31 | np.frombuffer(d, np.uint32).astype(np.int64) for s, d in zip(asked["shard"], asked["data"], strict=True)]
        self.keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.b = b

    def __iter__(self):
        """Document's place, first and last string (within the document), shard and bytes of each span."""
        for some, data, edge, first, last, shard, mark in self.b.spans():
            key = shard << 31 | mark
            at = np.searchsorted(self.keys, key)
            ok = np.zeros(len(key), bool)
            if len(self.keys):
                ok = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            first, last, shard = first[ok], last[ok], shard[ok]
            place = np.searchsorted(edge, first, side="right") - 1
            raw = data.tobytes()
            for p, f, l, s, start in zip(place.tolist(), first.tolist(), last.tolist(), shard.tolist(), edge[place].tolist(), strict=True):
                yield some[p], f - start, l - start, s, raw[f : l + LENGTH]


def distinct_spans(shared: Shared) -> dict[int, dict[bytes, int]]:
    """For each shard the distinct spans with the smallest document of the block that has them (documents go by id)."""
    found: dict[int, dict[bytes, int]] = {}
    for i, _, _, s, x in shared:
        found.setdefault(s, {}).setdefault(x, shared.b.ids[i])
    return found


def send_spans(block: int, b: Block, notes: pd.DataFrame) -> pd.DataFrame:
    out = []
    for s, of in distinct_spans(Shared(b, notes)).items():
        sizes = np.array([len(x) for x in of], np.uint16)
        data = np.uint32(len(of)).tobytes() + sizes.tobytes() + np.array(list(of.values()), np.int64).tobytes() + b"".join(of)
        out.append((block, s, data))
    return pd.DataFrame(out, columns=["block", "shard", "data"])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.frombuffer(data, np.uint16, n, 4).astype(np.int64), np.frombuffer(data, np.int64, n, 4 + 2 * n), np.frombuffer(data, np.uint8, -1, 4 + 10 * n)


def suffix_order(text: np.ndarray, end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts (positions with LENGTH bytes to their span's end) in order of those bytes.

    Larsson-Sadakane: suffixes are first sorted by 7 bytes; then groups that are not yet single
    are refined by the ranks of what follows, which doubles the sorted length. end has, for each
    position, where its span ends; beyond it every suffix is smaller than any byte.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    room = np.minimum(end - np.arange(n), 7)
    key = np.zeros(n, U64)
    for o in range(7):
        key = key << U64(8) | np.where(room > o, padded[o : o + n], 0).astype(U64)
    key = key << U64(8) | room.astype(U64)
    order = np.argsort(key)
    fresh = np.diff(key[order], prepend=~key[order[:1]]) != 0
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.flatnonzero(fresh)
    group = np.repeat(head, np.diff(np.append(head, n)))
    rank[order] = group
    h = 7
    while h < LENGTH:
        size = np.diff(np.append(head, n))
        single = np.repeat(size == 1, size)
        loose = order[~single]
        if not len(loose):
            break
        after = np.where(loose + h < end[loose], rank[np.minimum(loose + h, n)] + 1, 0)
        pair = rank[loose] * np.int64(n + 2) + after
        by = np.argsort(pair)
        loose, pair = loose[by], pair[by]
        slots = np.flatnonzero(~single)
        order[slots] = loose
        new = np.diff(pair, prepend=-1) != 0
        fresh = np.ones(n, bool)
        fresh[slots] = new
        head = np.flatnonzero(fresh)
        group = np.repeat(head, np.diff(np.append(head, n)))
        rank[order] = group
        h *= 2
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By Kasai's method, the bytes that each entry of order shares with the one before, LENGTH at most.

    The strings of all spans are followed side by side, the t-th of each at a time: one byte less
    than the string before it shares with its predecessor is already known to be shared, as long
    as that predecessor's next string is in order too. (Order is by LENGTH bytes only, so where all
    of them are shared nothing is known of the next.) Eight bytes are compared at a time.
    """
    n = len(text)
    eight = np.empty(n + 1, U64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    for o in range(8):
        part = eight[o::8]
        part[:] = padded[o : o + 8 * len(part)].view(U64)
    prev = np.full(n, -1, np.int64)
    prev[order[1:]] = order[:-1]
    there = np.zeros(n + 1, bool)
    there[order] = True
    shared = np.zeros(n, np.int64)
    lengths = np.zeros(len(first), np.int64)
    for t in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > t)
        p = first[live] + t
        q = prev[p]
        h = np.zeros(len(live), np.int64)
        if t:
            before, last = prev[p - 1], lengths[live]
            h = np.where((before >= 0) & there[before + 1] & (last < LENGTH), np.maximum(last - 1, 0), 0)
        h = np.where(q < 0, 0, h)
        active = np.flatnonzero(q >= 0)
        while len(active):
            differ = eight[np.minimum(p[active] + h[active], n)] ^ eight[np.minimum(q[active] + h[active], n)]
            low = differ & (~differ + U64(1))
            h[active] += np.where(differ == 0, 8, np.bitwise_count(low - U64(1)).astype(np.int64) >> 3)
            active = active[(differ == 0) & (h[active] < LENGTH)]
        h = np.minimum(h, LENGTH)
        shared[p] = h
        lengths[live] = h
    return shared[order]


def sorted_strings(sizes: np.ndarray, docs: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct strings of the spans in order: a place of each, its smallest document; then the
    strings of all spans in turn: number in that order, and span."""
    ends = np.cumsum(sizes)
    begin = ends - sizes
    count = sizes - LENGTH + 1
    span = np.repeat(np.arange(len(sizes)), count)
    starts = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count) + begin[span]
    order = suffix_order(text, np.repeat(ends, sizes), starts)
    new = common_prefixes(text, order, begin, count) < LENGTH
    new[:1] = True
    number = np.cumsum(new) - 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    least = np.minimum.reduceat(docs[of[order]], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    at = np.empty(len(text), np.int64)
    at[order] = number
    return order[new], least, at[starts], span


def repeats(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block's spans, which of their strings a smaller document has: one bit for each string."""
    parts = [unpacked(x) for x in pdf["data"]]
    sizes, docs, text = (np.concatenate([p[i] for p in parts]) for i in range(3))
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    # a span that several blocks sent is sorted once, with its smallest document; all others lose the whole of it
    first: dict[bytes, int] = {}
    raw, at = text.tobytes(), 0
    for k, (n, d) in enumerate(zip(sizes.tolist(), docs.tolist(), strict=True)):
        x = raw[at : at + n]
        at += n
        if docs[first.setdefault(x, k)] > d:
            first[x] = k
    keep = np.sort(np.fromiter(first.values(), np.int64, len(first)))
    text = np.frombuffer(b"".join([x for x, _ in sorted(first.items(), key=lambda xk: xk[1])]), np.uint8)
    every = np.where(np.isin(np.arange(len(sizes)), keep), U64(0), (U64(1) << (sizes - LENGTH + 1).astype(U64)) - U64(1))
    del raw, first
    sizes, docs = sizes[keep], docs[keep]
    ends = np.cumsum(sizes)
    # parts of at most SHARD bytes are sorted each for itself
    piece = (ends - 1) // SHARD
    cuts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(sizes))
    done = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        raw = text[ends[a] - sizes[a] : ends[b - 1]]
        places, least, number, span = sorted_strings(sizes[a:b], docs[a:b], raw)
        strings = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[places].copy().view(f"V{LENGTH}")[:, 0].view(f"S{LENGTH}") if len(cuts) > 2 else None
        done.append([strings, least, number, span + a])
    for i in range(len(done)):
        for j in range(i):
            # binary search of one part's strings in the other; both keep the smaller document
            mine, other = done[i], done[j]
            at = np.minimum(np.searchsorted(other[0], mine[0]), len(other[0]) - 1)
            same = np.flatnonzero(other[0][at] == mine[0])
            lower = np.minimum(mine[1][same], other[1][at[same]])
            mine[1][same] = lower
            other[1][at[same]] = lower
    mask = np.zeros(len(sizes), U64)
    for _, least, number, span in done:
        hit = least[number] < docs[span]
        turn = np.arange(len(span)) - np.searchsorted(span, span)
        np.bitwise_or.at(mask, span[hit], U64(1) << turn[hit].astype(U64))
    every[keep] = mask
    mask = every
    out = [(block, ANSWER, key[0], 0, mask[owner == i].tobytes()) for i, block in enumerate(pdf["block"]) if (mask[owner == i] != 0).any()]
    return pd.DataFrame(out, columns=["block", "kind", "shard", "num", "data"])


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def removed(b: Block, notes: pd.DataFrame) -> list[np.ndarray]:
    """For each document of the block which bytes go."""
    answers = notes[notes["kind"] == ANSWER]
    masks = {s: np.frombuffer(d, np.uint64).tolist() for s, d in zip(answers["shard"], answers["data"], strict=True)}
    # spans are numbered as distinct_spans lists them; documents go by id, so the first that has one is the smallest
    known: dict[int, dict[bytes, tuple[int, int]]] = {}
    starts: list[list[tuple[int, int]]] = [[] for _ in b.raw]
    for i, first, last, s, x in Shared(b, notes):
        of = known.setdefault(s, {})
        number, least = of.setdefault(x, (len(of), b.ids[i]))
        if least < b.ids[i]:
            starts[i].append((first, last))
        elif s in masks and (mask := masks[s][number]):
            starts[i] += [(first + t, first + t) for t in range(last - first + 1) if mask >> t & 1]
    out = []
    for i, t in enumerate(b.raw):
        gone = np.full(len(t), b.copy[i] and len(t) >= LENGTH)
        if starts[i]:
            edge = np.zeros(len(t) + 1, np.int32)
            runs = np.array(starts[i])
            np.add.at(edge, runs[:, 0], 1)
            np.add.at(edge, runs[:, 1] + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
        out.append(gone)
    return out


def kept(b: Block, notes: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for doc_id, t, gone in zip(b.ids, b.raw, removed(b, notes), strict=True):
        left = np.frombuffer(t, np.uint8)[~gone].tobytes() if gone.any() else t
        rows.append((doc_id, len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


TEXTS = "doc_id bigint, text string"


def kept_texts(b: Block, notes: pd.DataFrame) -> pd.DataFrame:
    """The texts themselves; a character that lost some of its bytes is replaced by U+FFFD."""
    rows = [(d, np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "replace")) for d, t, gone in zip(b.ids, b.raw, removed(b, notes), strict=True)]
    out = pd.DataFrame(rows, columns=["doc_id", "text"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


def copies(docs: DataFrame, block) -> DataFrame:
    """Notes on rows whose whole text a smaller document has."""
    rows = written(docs.where("doc_id is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "digests")
    groups = rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    late = join_groups(rows, groups, "sha", "size").where("doc_id > least")
    return late.select(block(F.col("doc_id")).alias("block"), F.lit(COPY).alias("kind"), F.lit(0).alias("shard"), F.col("doc_id").alias("num"), F.unhex("sha").alias("data"))


def without_repeats(docs: DataFrame, finish=kept, schema: str = RESULT) -> DataFrame:
    """What finish makes of each block: by default doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-size // BLOCK), min(partitions, size >> 20))
    shards = SHARDS_PER_BLOCK * blocks

    def block(c):
        return F.pmod(F.xxhash64(F.lit("block"), c), F.lit(blocks)).cast("int")

    dealt = docs.select("doc_id", "text", block(F.col("doc_id")).alias("block")).groupBy("block")
    known = copies(docs, block)

    def first(left, right):
        return send_anchors(int(left["block"].iloc[0]), Block(left, right, shards)) if len(left) else pd.DataFrame(columns=["block", "shard", "data"])

    def second(left, right):
        return send_spans(int(left["block"].iloc[0]), Block(left, right, shards), right) if len(left) else pd.DataFrame(columns=["block", "shard", "data"])

    def third(left, right):
        return finish(Block(left, right, shards), right)

    sent = "block int, shard int, data binary"
    anchors = dealt.cogroup(known.groupBy("block")).applyInPandas(first, sent)
    known = known.unionByName(anchors.groupBy("shard").applyInPandas(shared_anchors, NOTES))
    found = dealt.cogroup(known.groupBy("block")).applyInPandas(second, sent)
    known = known.unionByName(found.groupBy("shard").applyInPandas(repeats, NOTES))
    return dealt.cogroup(known.groupBy("block")).applyInPandas(third, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
