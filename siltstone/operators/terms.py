"""Matches of many tasks' terms in many texts: one automaton for a bounded shard of tasks, stepped over bytes in lanes.

A task's terms count as one alternation: matches go from the left, the first term of the task that
fits wins, and none overlap. An automaton of all terms of a shard (flat arrays: a transition for each state and
class of bytes, the term that ends in a state, a link to the next shorter one) finds every occurrence of every
term in one pass. Bytes are cut in lanes of equal length that overlap by the longest term, and all lanes take a
step at once. Occurrences are then settled for each text and task, again all at once.

Texts repeat words, so terms that hold word characters alone are looked for in the distinct chunks of a
batch (runs of such characters: a match can't leave its chunk); what a chunk gives each task is remembered,
and a batch's counts are one product of how often texts hold chunks and what chunks give. Other terms are
looked for in whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Characters of plain terms.
PLAIN = "[a-z0-9_./-]+"
#: Characters of the terms of one shard, all of which a worker holds; texts and their characters that are counted at once.
SHARD, PART, CHARS = 1 << 20, 2048, 1 << 22
#: Chunks that a worker remembers, length of a lane, rounds before overlapping
#: matches are settled one by one, chunks of one product, and its least share of tasks (one in DENSE).
MEMORY, LANE, ROUNDS, BLOCK, DENSE = 1 << 18, 256, 16, 4096, 16
#: Never part of UTF-8: stands between texts, and no match passes it.
BETWEEN = b"\xff"


class Automaton:
    """All occurrences of distinct terms (bytes, none empty) in joined texts."""

    def __init__(self, terms: list[bytes]):
        self.lengths = np.array([len(t) for t in terms], np.int64)
        used = sorted(set(b"".join(terms)))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        step: list[dict[int, int]] = [{}]
        depth, ends = [0], {}
        for i, term in enumerate(terms):
            at = 0
            for c in self.classes[np.frombuffer(term, np.uint8)].tolist():
                to = step[at].get(c)
                if to is None:
                    to = step[at][c] = len(step)
                    step.append({})
                    depth.append(depth[at] + 1)
                at = to
            ends[at] = i
        n, width = len(step), len(used) + 1
        self.go = np.zeros((n, width), np.int32)
        self.term = np.full(n, -1, np.int64)
        self.term[list(ends)] = list(ends.values())
        # the next shorter state in which a term ends
        self.link = np.zeros(n, np.int32)
        fail = np.zeros(n, np.int32)
        for at in np.argsort(depth, kind="stable").tolist():
            if at:
                self.go[at] = self.go[fail[at]]
                self.link[at] = fail[at] if self.term[fail[at]] >= 0 else self.link[fail[at]]
            for c, to in step[at].items():
                fail[to] = self.go[at, c] if at else 0
                self.go[at, c] = to
        self.flat = self.go.reshape(-1)
        self.hit = (self.term >= 0) | (self.link > 0)

    def occurrences(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and term of every occurrence."""
        n, width = len(data), self.go.shape[1]
        if not len(self.lengths) or not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = int(self.lengths.max()) - 1
        lanes = max(1, n // max(LANE, 4 * before))
        size = -(-n // lanes)
        codes = np.zeros(before + lanes * size, np.int32)
        codes[before : before + n] = self.classes[np.frombuffer(data, np.uint8)]
        first = np.arange(lanes) * size
        state, at, found = np.zeros(lanes, np.int32), [], []
        for k in range(before + size):
            state = self.flat[state * width + codes[first + k]]
            if k >= before:
                hit = np.flatnonzero(self.hit[state])
                if len(hit):
                    at.append(first[hit] + (k - before))
                    found.append(state[hit])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, state, starts, terms = np.concatenate(at), np.concatenate(found), [], []
        while len(at):
            term = self.term[state]
            own = term >= 0
            starts.append(at[own] + 1 - self.lengths[term[own]])
            terms.append(term[own])
            state = self.link[state]
            at, state = at[state > 0], state[state > 0]
        return np.concatenate(starts), np.concatenate(terms)


def settled(text: np.ndarray, task: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and task of every match that counts: from the left, of those that start together the first in place, none overlapping."""
    order = np.lexsort((place, start, task, text))
    text, task, start, end = text[order], task[order], start[order], end[order]
    out = []
    for _ in range(ROUNDS):
        if not len(text):
            break
        new = np.append(True, (text[1:] != text[:-1]) | (task[1:] != task[:-1]))
        group = np.cumsum(new) - 1
        # ends so far within a group: groups are set apart by more than any end
        apart = group * (int(end.max()) + 1)
        upto = np.maximum.accumulate(end + apart) - apart
        # nothing before it reaches a head, so it counts, and what overlaps it doesn't
        head = new | np.append(True, start[1:] >= upto[:-1])
        out.append(np.flatnonzero(head))
        out[-1] = np.stack([text[out[-1]], task[out[-1]]])
        last = end[np.maximum.accumulate(np.where(head, np.arange(len(end)), 0))]
        rest = ~head & (start >= last)
        text, task, start, end = text[rest], task[rest], start[rest], end[rest]
    more, upto, now = [], 0, None
    for row in zip(text.tolist(), task.tolist(), start.tolist(), end.tolist(), strict=True):
        if row[:2] != now:
            now, upto = row[:2], 0
        if row[2] >= upto:
            more.append(now)
            upto = row[3]
    found = np.concatenate([*out, np.array(more, np.int64).reshape(-1, 2).T], axis=1)
    return found[0], found[1]


class Matcher:
    """Counts of matches of a shard's tasks, by their number, in lists of texts."""

    def __init__(self, terms: list[list[str]]):
        distinct = {t: i for i, t in enumerate(dict.fromkeys(t for some in terms for t in some if t))}
        self.automaton = Automaton([t.encode("utf-8", "surrogatepass") for t in distinct])
        rows = np.array([(distinct[t], task, place) for task, some in enumerate(terms) for place, t in enumerate(some) if t], np.int64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.first = np.searchsorted(rows[:, 0], np.arange(len(distinct) + 1))
        self.task, self.place = rows[:, 1], rows[:, 2]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, task and count (above 0), in order of texts."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        begin = np.cumsum([0, *[len(r) + 1 for r in raw]])
        start, term = self.automaton.occurrences(BETWEEN.join(raw))
        text = np.searchsorted(begin, start, side="right") - 1
        many = self.first[term + 1] - self.first[term]
        which = np.repeat(self.first[term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        text, start, end = (np.repeat(x, many) for x in (text, start, start + self.automaton.lengths[term]))
        text, task = settled(text, self.task[which], start, end, self.place[which])
        pairs, n = np.unique(text * (1 << 32) + task, return_counts=True)
        return pairs >> 32, pairs & 0xFFFFFFFF, n


class Counts:
    """Counts for a batch of texts as a matrix, a row for each text and a column for each task."""

    def __init__(self, terms: list[list[str]]):
        self.tasks = len(terms)
        plain = [all(re.fullmatch(PLAIN, t) for t in some) for some in terms]
        self.plain = Matcher([some if p else [] for some, p in zip(terms, plain, strict=True)])
        self.odd = None if all(plain) else Matcher([[] if p else some for some, p in zip(terms, plain, strict=True)])
        self.find = re.compile(PLAIN).findall
        self.forget()

    def forget(self) -> None:
        """Numbers of chunks that are known, and where in task and n lies what each gives."""
        self.known: dict[str, int] = {}
        self.first, self.task, self.n = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        chunk, task, n = self.plain.counts(chunks)
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.first = np.concatenate([self.first, len(self.task) + np.searchsorted(chunk, np.arange(1, len(chunks) + 1))])
        self.task, self.n = np.concatenate([self.task, task]), np.concatenate([self.n, n])

    def expanded(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all that chunks (numbers) give: the place among them, and where task and n lie."""
        many = self.first[chunks + 1] - self.first[chunks]
        return np.repeat(np.arange(len(chunks)), many), np.repeat(self.first[chunks] - np.cumsum(many) + many, many) + np.arange(many.sum())

    def add_each(self, out: np.ndarray, rows: np.ndarray, chunks: np.ndarray, times: np.ndarray) -> None:
        for at in range(0, len(rows), 1 << 16):
            pair, which = self.expanded(chunks[at : at + (1 << 16)])
            cells = rows[at : at + (1 << 16)][pair] * self.tasks + self.task[which]
            out += np.bincount(cells, times[at : at + (1 << 16)][pair] * self.n[which], out.size).reshape(out.shape)

    def of(self, texts: list[str]) -> np.ndarray:
        cut = [self.find(t) for t in texts]
        if len(self.known) > MEMORY:
            self.forget()
        self.learn(list(set().union(*cut) - self.known.keys()))
        rows = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        ids = np.fromiter((self.known[w] for w in chain.from_iterable(cut)), np.int64, len(rows))
        useful = self.first[ids + 1] > self.first[ids]
        chunks, ids = np.unique(ids[useful], return_inverse=True)
        pairs, times = np.unique(rows[useful] * len(chunks) + ids, return_counts=True)
        rows, ids = np.divmod(pairs, max(1, len(chunks)))
        out = np.zeros((len(texts), self.tasks))
        many = self.first[chunks + 1] - self.first[chunks]
        # chunks that give something to few tasks are added one by one, the others as a product
        few = many * DENSE < self.tasks
        self.add_each(out, rows[few[ids]], chunks[ids[few[ids]]], times[few[ids]])
        place = np.cumsum(~few) - 1
        rows, ids, times, chunks = rows[~few[ids]], place[ids[~few[ids]]], times[~few[ids]], chunks[~few]
        # no more than BLOCK chunks at once, so that both factors stay small
        for at in range(0, len(chunks), BLOCK):
            some, here = chunks[at : at + BLOCK], (ids >= at) & (ids < at + BLOCK)
            gives, holds = np.zeros((len(some), self.tasks), np.float32), np.zeros((len(texts), len(some)), np.float32)
            chunk, which = self.expanded(some)
            gives[chunk, self.task[which]] = self.n[which]
            holds[rows[here], ids[here] - at] = times[here]
            # whole numbers below 2**24 are exact in single precision
            exact = holds.sum(axis=1).max(initial=0) * gives.max(initial=0) < 2**24
            out += holds @ gives if exact else holds.astype(np.float64) @ gives.astype(np.float64)
        if self.odd:
            text, task, n = self.odd.counts(texts)
            out[text, task] += n
        return out.astype(np.int64)


def best(terms: list[list[str]], limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of path and low to path, task (its number in the shard) and cnt: those a batch can add to the limit best of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(terms)
        for batch in batches:
            batch = batch.sort_values("path", kind="stable")
            sizes = batch["low"].str.len().cumsum().to_numpy() // CHARS
            for _, some in batch.groupby([sizes, np.arange(len(batch)) // PART]):
                found = counts.of(some["low"].tolist())
                order = np.argsort(-found, axis=0, kind="stable")[:limit]
                top = np.take_along_axis(found, order, axis=0)
                row, task = np.nonzero(top)
                yield pd.DataFrame({"path": some["path"].to_numpy()[order[row, task]], "task": task.astype(np.int32), "cnt": top[row, task]})

    return run


def term_counts(terms: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """task_id, path, cnt, rank: the limit files with most matches of a task's terms, joined by |, in the whole text (any case), ties by path.

    terms: task_id and terms (array in lower case, distinct, in order); texts: path, text, a row for each path.
    Tasks are dealt to shards of about SHARD characters, each of which is one pass over the texts: the driver and
    workers hold one shard, however many tasks there are.
    """
    terms = written(terms.where(F.size("terms") > 0).select("task_id", "terms"), "terms")
    size = terms.agg(F.sum(F.length(F.array_join("terms", " ")))).first()[0] or 0
    shards = -(-size // SHARD)
    low = texts.select("path", F.coalesce(F.lower("text"), F.lit("")).alias("low"))
    id_type, path_type = (x.schema[c].dataType.simpleString() for x, c in ((terms, "task_id"), (texts, "path")))
    found = terms.sparkSession.createDataFrame([], f"task_id {id_type}, path {path_type}, cnt bigint, rank int")
    for shard in range(shards):
        held = terms.where(F.pmod(F.xxhash64("task_id"), F.lit(shards)) == shard).orderBy("task_id").collect()
        if held:
            names = terms.sparkSession.createDataFrame([(i, r.task_id) for i, r in enumerate(held)], f"task int, task_id {id_type}")
            counts = low.mapInPandas(best([list(r.terms) for r in held], limit), f"path {path_type}, task int, cnt bigint")
            rank = F.row_number().over(W.partitionBy("task").orderBy(F.col("cnt").desc(), "path"))
            rows = counts.withColumn("rank", rank).where(F.col("rank") <= limit).join(F.broadcast(names), "task").select("task_id", "path", "cnt", "rank")
            found = rows if shards == 1 else found.unionByName(written(rows, "term-counts"))
    return found
