"""N-gram Jaccard join by grouped prefixes, down to connected components.

Every document becomes its set of word shingles. Equal sets are one node. Shingles are put in
one order for all sets (the commonest last), and two sets that are similar enough share a shingle
within their prefixes. Nodes of identical prefix and size form a group, named by its smallest node;
each group posts its prefix once, with size and places alone. Groups that meet on a shingle make a
pair if sizes and places allow it (if it is the first shingle they share, at most what follows it is
shared). Pairs of groups are expanded to their members, members are filtered by parity sketches
(lower bounds of the symmetric difference), and what is left is verified on the texts.

A cluster of near copies is not expanded into all its pairs. First, every member of a list meets the
list's leads alone (its middle and its first), each node keeps its best partners, and those pairs
are verified; the links found make components. Then all pairs of different components are compared,
so that no pair is left out that could join two components. A list above TILE members is dealt to
tiles: its largest component in parts of TILE, the rest of its members to each of them.

Defined cases: a null text or one without words has no shingles, links with nothing and is its
own component; with fewer words than a shingle the whole sequence is the only one; rows that
repeat an id are one document; rows with a null id are given a null component; a very long text is
hashed by itself, as a whole; an empty table gives no rows; columns beside doc_id and text are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, given_back, join_groups, table, written
from .components import components
from .hashing import shingles

WIDTH, PERCENT = 3, 90
#: Shingles that are ordered last, at most (8 bytes each go to every task); any choice of them gives the same links.
COMMON = 100_000
#: Bits of a sketch: the power of two from the set's size on, within these bounds.
NARROW, WIDE = 128, 4096
#: Lists below SHORT are paired in SQL, without sketches; lists above TILE are dealt to several tasks.
SHORT, TILE = 8, 2048
#: Lists from LONG on are joined through their leads a second time.
LONG = 256
#: Members that one task compares with the first of their pairs.
FAN = 256
#: Buckets of the filter that keeps texts no pair asks for out of the shuffle.
SIEVE = 1 << 20
#: Texts hashed at once, their characters, and characters of texts whose shingles are counted together.
PART, CHARS, COUNTED = 512, 1 << 18, 1 << 22


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Where each part begins, and its texts: PART of them, or fewer that have CHARS characters together."""
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and (i - at == PART or held + len(t) > CHARS):
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, texts[at:]


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles of many documents, rarest first. Each part of a batch reports those that more than one in 400 of its documents hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets, size = [], 0
            for _, texts in (*parts(pdf["text"].tolist()), (0, None)):
                if texts is not None:
                    sets += shingles(texts, width)
                    size += sum(map(len, texts))
                if sets and (texts is None or size > COUNTED):
                    held, n = np.unique(np.concatenate(sets), return_counts=True)
                    most = n >= max(3, len(sets) // 400)
                    yield pd.DataFrame({"s": held[most].view(np.int64), "n": n[most]})
                    sets, size = [], 0

    seen = docs.mapInPandas(given_back(run), "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.col("n").desc(), "s").limit(COMMON).toPandas()
    return top.sort_values(["n", "s"])["s"].to_numpy(np.int64).view(np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of so many classes; folding halves its width."""
    width = min(WIDE, max(NARROW, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of a list or batch of sets, and how many bits pairs of them differ by (0 where one has none)."""

    def __init__(self, raw: np.ndarray):
        self.raw = [x or b"" for x in raw]
        self.width = np.array([len(x) for x in self.raw], np.int64)
        self.at: dict[int, np.ndarray] = {}

    def folded(self, w: int) -> np.ndarray:
        """All sketches of w bytes or more, folded to w."""
        if w not in self.at:
            out = np.zeros((len(self.raw), w // 8), np.uint64)
            for each in np.unique(self.width[self.width >= w]):
                k = np.flatnonzero(self.width == each)
                x = np.frombuffer(b"".join([self.raw[i] for i in k]), np.uint64).reshape(len(k), each // w, w // 8)
                out[k] = np.bitwise_xor.reduce(x, axis=1)
            self.at[w] = out
        return self.at[w]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least = np.minimum(self.width[i], self.width[j])
        out = np.zeros(len(least), np.int64)
        for w in np.unique(least[least > 0]):
            k = np.flatnonzero(least == w)
            x = self.folded(int(w))
            out[k] = np.bitwise_count(x[i[k]] ^ x[j[k]]).sum(1, dtype=np.int64)
        return out

    def middle(self) -> int:
        """The sketch nearest to the majority of the most common width."""
        w = int(np.bincount(self.width).argmax())
        k = np.flatnonzero(self.width == w)
        x = self.folded(w)[k]
        most = np.packbits(np.unpackbits(x.view(np.uint8), axis=1).mean(0) > 0.5).view(np.uint64)
        return int(k[np.bitwise_count(x ^ most[None, :]).sum(1, dtype=np.int64).argmin()])


def prefix_of(s: np.ndarray, percent: int, by_value: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of all sets, that a similar set must share one of."""
    n = len(s)
    length = n - -(-percent * n // 100) + 1 if n else 0
    if not len(values):
        return s[:length]
    rank = np.minimum(np.searchsorted(values, s), len(values) - 1)
    last = values[rank] == s
    prefix = s[~last][:length]
    if len(prefix) < length:
        prefix = np.concatenate([prefix, s[last][np.argsort(by_value[rank[last]])]])[:length]
    return prefix


def described(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n, key (of the set), kind (of size and prefix), prefix (shingles in order) and sketch of every row."""
    by_value = np.argsort(common)
    values = common[by_value]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for at, texts in parts(pdf["text"].tolist()):
                rows = []
                for doc_id, s in zip(ids[at : at + len(texts)], shingles(texts, width), strict=True):
                    prefix = prefix_of(s, percent, by_value, values).view(np.int64)
                    kind = hashlib.blake2b(len(s).to_bytes(8, "little") + prefix.tobytes(), digest_size=16).digest()
                    rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), kind, prefix, sketch(s)))
                out = pd.DataFrame(rows, columns=["doc_id", "n", "key", "kind", "prefix", "sketch"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.mapInPandas(given_back(run), "doc_id bigint, n bigint, key binary, kind binary, prefix array<bigint>, sketch binary")


def limit(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes, below 0 where sizes alone forbid it."""
    most = (n + m) * (100 - percent) / (100 + percent)
    return np.where(100 * np.minimum(n, m) >= percent * np.maximum(n, m), most, -1.0)


def allowed(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs sizes and places leave possible, if the list's shingle is the first they share."""
    rest = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (limit(n[i], n[j], percent) >= 0) & ((100 + percent) * rest >= percent * (n[i] + n[j]))


def pairs_of(n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs that sizes allow: rows go by size, so that each meets only what it can match."""
    if len(n) <= 64:
        yield np.triu_indices(len(n), 1)
        return
    order = np.argsort(n, kind="stable")
    upto = np.searchsorted(n[order], n[order] * 100 // percent, side="right")
    for at in range(len(order)):
        if upto[at] > at + 1:
            j = order[at + 1 : upto[at]]
            yield np.full(len(j), order[at]), j


def lists_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The lists of a stream that is sorted by s and tile; one is held at a time, besides a batch."""
    rest = None
    for pdf in with_end(batches):
        now = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if now is None or not len(now):
            continue
        s, tile = now["s"].to_numpy(), now["tile"].to_numpy()
        cut = np.append(0, np.flatnonzero((s[1:] != s[:-1]) | (tile[1:] != tile[:-1])) + 1)
        end = np.append(cut[1:], len(s))
        if pdf is not None:
            rest, cut, end = now.iloc[cut[-1] :], cut[:-1], end[:-1]
        columns = {c: now[c].to_numpy() for c in now.columns}
        for a, b in zip(cut, end, strict=True):
            if b - a > 1:
                yield {c: x[a:b] for c, x in columns.items()}


def with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    for pdf in batches:
        if len(pdf):
            yield pdf
    yield None


def streamed(entries: DataFrame, choose: Callable[[dict[str, np.ndarray]], np.ndarray], schema: str) -> DataFrame:
    """The rows that choose makes of each list of entries (those of the same s and tile)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for now in lists_of(batches):
            out = choose(now)
            held.append(out)
            size += len(out)
            if size > 1 << 16:
                yield pd.DataFrame(np.concatenate(held), columns=names)
                held, size = [], 0
        if held:
            yield pd.DataFrame(np.concatenate(held), columns=names)

    return entries.repartition("s", "tile").sortWithinPartitions("s", "tile").mapInPandas(given_back(run), schema)


def sketched(entries: DataFrame, sketches: DataFrame) -> DataFrame:
    return entries.join(sketches, ["node", "n"])


def to_leads(entries: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """node, lead, bits: each member of a list with the best of the list's leads, where they are of different components.

    A list above TILE is dealt in parts; the list's smallest node is a lead in each of them.
    """
    parted = F.ceil(F.col("c") / TILE)
    rows = entries.withColumn("tile", F.pmod(F.xxhash64("node"), parted).cast("int")).withColumn("first", F.lit(False))
    long = entries.where(F.col("c") > TILE).groupBy("s").agg(F.min(F.struct("node", "n", "pos", "comp", "c")).alias("t")).select("s", "t.*")
    firsts = long.withColumn("tile", F.explode(F.sequence(F.lit(0), (parted - 1).cast("int")))).withColumn("first", F.lit(True))

    def choose(now: dict[str, np.ndarray]) -> np.ndarray:
        node, n, pos, comp = now["node"], now["n"], now["pos"].astype(np.int64), now["comp"]
        if (comp == comp[0]).all():
            return np.zeros((0, 3), np.int64)
        sk = Sketches(now["sketch"])
        best, by = np.full(len(node), 1 << 40), np.full(len(node), -1)
        for lead in {sk.middle(), int(node.argmin()), *np.flatnonzero(now["first"]).tolist()}:
            j = np.flatnonzero(comp != comp[lead])
            i = np.full(len(j), lead)
            ok = allowed(n, pos, i, j, percent)
            i, j = i[ok], j[ok]
            bits = sk.apart(i, j)
            better = (bits <= limit(n[i], n[j], percent)) & (bits < best[j])
            best[j[better]], by[j[better]] = bits[better], lead
        j = np.flatnonzero(by >= 0)
        return np.stack([node[j], node[by[j]], best[j]], 1)

    return streamed(sketched(rows.unionByName(firsts.select(rows.columns)), sketches), choose, "node bigint, lead bigint, bits bigint")


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of short lists (of s and items) that sizes and places leave possible, of different components."""
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, SHORT), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = lists.select(F.explode(pairs).alias("p")).select("p.x", "p.y").where("x.node <> y.node and x.comp <> y.comp")
    n, m = F.col("x.n"), F.col("y.n")
    rest = F.least(n - F.col("x.pos"), m - F.col("y.pos"))
    rows = rows.where((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= (n + m) * percent))
    return rows.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """u, v, bits of the pairs that sketches leave possible."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = len(pdf)
            n = pdf["n_u"].to_numpy(), pdf["n_v"].to_numpy()
            bits = Sketches([*pdf["x_u"], *pdf["x_v"]]).apart(np.arange(k), k + np.arange(k))
            yield pdf.loc[bits <= limit(*n, percent), ["u", "v"]].assign(bits=bits[bits <= limit(*n, percent)])

    for side in ("u", "v"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"x_{side}")), side)
    return pairs.mapInPandas(given_back(run), "u bigint, v bigint, bits bigint")


def dealt(entries: DataFrame) -> DataFrame:
    """entries (s, node, n, pos, comp) of lists with several components, with tile: all pairs of different components meet in some tile.

    Of a list above TILE the largest component goes in parts of TILE to the parts of all others,
    and those also meet one another.
    """
    entries = entries.select("s", "node", "n", "pos", "comp")
    per = entries.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("s").agg(F.max(F.struct("k", "comp")).alias("t"), F.sum("k").alias("c"), F.count(F.lit(1)).alias("comps"))
    per = per.where("comps > 1").select("s", "c", F.col("t.comp").alias("main"), F.ceil(F.col("t.k") / TILE).alias("mains"), F.ceil((F.col("c") - F.col("t.k")) / TILE).alias("others"))
    rows = entries.join(written(per, "lists"), "s")
    main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int")

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))

    def named(kind: str, a: Column, b: Column) -> Column:
        return F.concat_ws("-", F.lit(kind), a.cast("string"), b.cast("string"))

    meets = F.when(main, F.transform(upto("others"), lambda j: named("m", own, j))).otherwise(
        F.concat(F.transform(upto("mains"), lambda i: named("m", i, own)), F.transform(upto("others"), lambda j: named("o", F.least(own, j), F.greatest(own, j))))
    )
    tiles = F.when(F.col("c") <= TILE, F.array(F.lit(""))).otherwise(meets)
    return rows.withColumn("tile", F.explode(tiles)).select("s", "tile", "node", "n", "pos", "comp")


def apart(entries: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """u, v: all pairs of different components that may be linked, of the lists of entries (s, node, n, pos, comp)."""

    def choose(now: dict[str, np.ndarray]) -> np.ndarray:
        node, n, pos, comp = now["node"], now["n"], now["pos"].astype(np.int64), now["comp"]
        if (comp == comp[0]).all():
            return np.zeros((0, 2), np.int64)
        sk, out = Sketches(now["sketch"]), []
        for i, j in pairs_of(n, percent):
            ok = (comp[i] != comp[j]) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            ok = allowed(n, pos, i, j, percent)
            i, j = i[ok], j[ok]
            ok = sk.apart(i, j) <= limit(n[i], n[j], percent)
            out.append(np.stack([np.minimum(node[i[ok]], node[j[ok]]), np.maximum(node[i[ok]], node[j[ok]])], 1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    return streamed(sketched(dealt(entries), sketches), choose, "u bigint, v bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough.

    A node that many pairs share meets its partners in several tasks, FAN to each.
    """
    pairs = written(pairs, "pairs")
    shares = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("shares"))
    asked = pairs.join(shares, "u").select("u", F.pmod(F.xxhash64("v"), F.col("shares")).alias("share"), "v")
    rows = asked.select("u", "share", F.col("v").alias("doc_id"), F.lit(1).alias("turn")).unionByName(
        asked.select("u", "share").distinct().select("u", "share", F.col("u").alias("doc_id"), F.lit(0).alias("turn"))
    )
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).cast("int")
    sieve = rows.select(bucket.alias("__bucket")).distinct()
    texts = docs.withColumn("__bucket", bucket).join(F.broadcast(sieve), "__bucket", "left_semi").drop("__bucket")
    met = rows.join(texts, "doc_id").repartition("u", "share").sortWithinPartitions("u", "share", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, []
        for pdf in batches:
            for at, texts_of in parts(pdf["text"].tolist()):
                some = pdf.iloc[at : at + len(texts_of)]
                out = []
                for u, share, v, turn, s in zip(some["u"], some["share"], some["doc_id"], some["turn"], shingles(texts_of, width), strict=True):
                    if (u, share) != now:
                        now, own = (u, share), []
                    if turn == 0:
                        own.append(s)
                    elif any(linked(s, o, percent) for o in own):
                        out.append((u, v))
                yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return written(met.mapInPandas(given_back(run), "u bigint, v bigint").distinct(), "links")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The members of both groups of each pair, as one list for each pair: s, node, n, pos, comp."""
    named = pairs.withColumn("s", F.xxhash64(F.lit("pair"), "u", "v"))
    sides = named.select("s", F.col("u").alias("group")).unionByName(named.select("s", F.col("v").alias("group")))
    return members.join(sides, "group").select("s", "node", "n", F.lit(0).alias("pos"), "comp")


def best(met: DataFrame, node: str, lead: str) -> DataFrame:
    """u, v: each node (as v) with the partner of fewest differing bits."""
    top = met.groupBy(node).agg(F.min(F.struct("bits", lead)).alias("t"))
    return top.select(F.col(f"t.{lead}").alias("u"), F.col(node).alias("v"))


def links_of(nodes: DataFrame, groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """u, v: links that connect what is connected.

    nodes: group, node, n, sketch of every set; groups: group (its smallest node), n, prefix, size.
    """
    sketches = nodes.select("node", "n", "sketch")
    postings = groups.select(F.posexplode("prefix").alias("pos", "s"), F.col("group").alias("node"), "n")
    lists = written(postings.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "lists")
    live = written(postings.join(lists, "s").select("s", "c", "node", "n", "pos"), "postings")
    many = nodes.join(groups.where("size > 1").select("group", F.col("size").alias("c")), "group")
    inside = written(many.select(F.xxhash64(F.lit("group"), "group").alias("s"), "c", "node", "n", F.lit(0).alias("pos"), "group"), "members")
    every = live.unionByName(inside.drop("group"))

    entries = every.withColumn("comp", F.col("node"))
    short = short_lists(live.withColumn("comp", F.col("node")))
    near = written(possible(short_pairs(short, percent), sketches, percent), "near")
    near = near.select("u", "v", "bits").unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "bits"))
    partners = best(to_leads(entries.where(F.col("c") >= SHORT), sketches, percent), "node", "lead").unionByName(best(near, "v", "u"))
    links = verified(partners.distinct(), docs, width, percent)
    comp = components(links).select("node", F.col("component").alias("comp"))
    long = every.where(F.col("c") >= LONG)
    if not long.isEmpty():
        # what the first leads left apart in long lists, so that the pairs of all that is apart stay few
        rows = long.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        more = verified(best(to_leads(rows, sketches, percent), "node", "lead"), docs, width, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links).select("node", F.col("component").alias("comp"))

    named = written(nodes.join(comp, "node", "left").select("group", "node", "n", F.coalesce("comp", "node").alias("comp")), "components")
    # a group whose members are of several components differs from all others, and its sketches don't bind it
    of_group = named.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    of_group = of_group.select(F.col("group").alias("node"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("group")).alias("comp"))
    single = nodes.join(groups.where("size > 1").select("group"), "group", "left_anti").select("node", "n", "sketch")
    several = groups.where("size > 1").select(F.col("group").alias("node"), "n", F.lit(None).cast("binary").alias("sketch"))
    entries = written(live.join(of_group, "node"), "entries")
    pairs = possible(short_pairs(short_lists(entries), percent), single.unionByName(several), percent).select("u", "v")
    pairs = written(pairs.unionByName(apart(entries.where(F.col("c") >= SHORT), single.unionByName(several), percent)).distinct(), "group-pairs")
    wide = several.select(F.col("node").alias("group"))
    more = pairs.join(wide.select(F.col("group").alias("u")), "u", "left_semi").unionByName(pairs.join(wide.select(F.col("group").alias("v")), "v", "left_semi")).distinct()
    members = expanded(more, named).unionByName(inside.join(named.select("node", "n", "comp"), ["node", "n"]).select("s", "node", "n", "pos", "comp"))
    rest = pairs.join(more, ["u", "v"], "left_anti").unionByName(apart(members, sketches, percent)).distinct()
    return links.unionByName(verified(rest, docs, width, percent)).select("u", "v")


def short_lists(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("c") < SHORT).groupBy("s").agg(F.collect_list(F.struct("node", "n", "pos", "comp")).alias("items"))


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = written(described(docs, width, percent, common_shingles(docs.select("text"), width)), "described")
    full = rows.where("doc_id is not null and n > 0")
    sets = full.groupBy("key").agg(F.min(F.struct("doc_id", "n", "kind", "sketch")).alias("t"), F.count(F.lit(1)).alias("size"))
    sets = written(sets.select("key", "size", F.col("t.doc_id").alias("node"), "t.n", "t.kind", "t.sketch"), "sets")
    top = full.groupBy("kind").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("t"))
    count = sets.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    groups = written(top.join(count, "kind").select("kind", "size", F.col("t.doc_id").alias("group"), "t.n", "t.prefix"), "groups")
    nodes = written(join_groups(sets.select("kind", "node", "n", "sketch"), groups.select("kind", "group", "size"), "kind", "size").select("group", "node", "n", "sketch"), "nodes")
    final = components(links_of(nodes, groups, docs, width, percent))

    named = sets.join(final, "node", "left").select("key", "size", F.coalesce("component", "node").alias("component_id"))
    there = join_groups(full.select("doc_id", "n", "key"), named, "key", "size").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return there.unionByName(alone)


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: the smallest id of each component."""
    (name,) = free_names(docs, "id")
    gone = classes(docs, width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    rows = docs.withColumn(name, F.col("doc_id").cast("bigint"))
    return rows.hint("merge").join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
