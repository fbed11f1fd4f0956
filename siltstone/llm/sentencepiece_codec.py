"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; from it the normaliser, the metaspace marker, the
unigram scores (or, for a BPE model, the merges that its scores imply) and byte fallback are
rebuilt as a tokenizers pipeline. Texts are encoded in multithreaded batches and every text is
decoded again. Parity with the sentencepiece library is verified for every text. A text without
markers, repeated blanks or blanks at its ends is encoded and verified by its words where the model
allows it: no piece holds a marker after another character and nothing is normalised, so in both
libraries its ids are those of its words. The distinct words of a part of the table are looked up
among those that a worker remembers; new ones, many joined by blanks at once, go through both
libraries and are cut apart at the pieces that begin with a marker. The ids of each distinct word
are decoded again, once for each part: a word's first piece is no byte, so no byte sequence crosses
words, and a text's decoding is that of its words, joined by blanks. All other texts, and those with
a word that differs, go through both libraries, or the decoder, whole. The backend's ids are
returned; parity is false where the two differ.

Defined cases: null counts as empty; an empty text has no ids and decodes to the empty text; no
begin or end ids are added; decoding gives the normalised text (for a model without a character
map the text itself, byte for byte); rows that repeat an id are encoded each; a very long text comes
alone; an empty table gives no rows; columns of docs that bear the names of results are replaced.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, given_back, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts encoded at once, and their characters.
BATCH, CHARS = 32, 1 << 17
#: Verified words that a worker remembers, and the longest of them.
WORDS, LONGEST = 100_000, 64
#: Characters of the texts whose distinct words are taken together; words joined to one text, and those encoded at once.
PART, JOINED, JOINT = 1 << 21, 128, 1 << 14


@dataclass
class Spec:
    """What a model file says: pieces as (piece, score, type) and the settings that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, raw[at : at + n]
        at += n


def parse(raw: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(raw):
        if number == 1:
            piece = dict(fields(value))
            spec.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            spec.model_type = trainer.get(3, UNIGRAM)
            spec.byte_fallback = bool(trainer.get(35, 0))
            spec.whitespace_as_suffix = bool(trainer.get(24, 0))
            spec.unk_id = trainer.get(40, 0)
        elif number == 3:
            norm = dict(fields(value))
            spec.charsmap = norm.get(2, b"")
            spec.add_dummy_prefix = bool(norm.get(3, 1))
            spec.remove_extra_whitespaces = bool(norm.get(4, 1))
            spec.escape_whitespaces = bool(norm.get(5, 1))
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """The merges that the scores of a BPE model imply, best score first."""
    ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    found = []
    for i, (piece, score, kind) in enumerate(spec.pieces):
        if kind != NORMAL:
            continue
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in ids and b in ids:
                found.append((-score, i, ids[a], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(spec: Spec):
    """A tokenizers.Tokenizer that does what the model file describes."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if spec.whitespace_as_suffix or not spec.escape_whitespaces:
        raise ValueError("models with white space as suffix or unescaped are not supported")
    if spec.model_type == BPE:
        unk = spec.pieces[spec.unk_id][0]
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk_id, spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type} is not supported")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if all(MARK not in p.lstrip(MARK) for p, _, kind in spec.pieces if kind == NORMAL):
        # no piece holds a marker after another character, so no merge or path crosses such a place
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tok.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else [])]
    )
    return tok


def by_words(spec: Spec) -> bool:
    """Whether the ids of a text are those of its words, one after the other."""
    plain = spec.model_type == BPE and not spec.charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
    held = [p for p, _, kind in spec.pieces if kind not in (CONTROL, UNKNOWN, BYTE)]
    return plain and spec.byte_fallback and MARK in held and all(MARK not in p.lstrip(MARK) for p in held) and all(kind != USER_DEFINED for *_, kind in spec.pieces)


@lru_cache(maxsize=4)
def verified(path: str) -> tuple[bool, dict[str, bytes], np.ndarray]:
    """Whether texts may be encoded by words, the backend's ids of the words found equal so far, and the pieces that begin a word."""
    with open(path, "rb") as f:
        spec = parse(f.read())
    return by_words(spec), {}, np.array([p.startswith(MARK) for p, *_ in spec.pieces])


@lru_cache(maxsize=4)
def load(path: str, threads: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    return build(parse(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)


def odd(texts: pa.Array) -> np.ndarray:
    """Whether blanks or markers of each text may make more of it than its words."""
    found = [pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.ends_with(texts, " ")]
    return np.logical_or.reduce([f.to_numpy(zero_copy_only=False) for f in found]).astype(bool)


def parts(lengths: list[int], most: int = BATCH, chars: int = CHARS) -> Iterator[slice]:
    """At most so many texts at a time, or fewer that have chars characters together; a longer one comes alone."""
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at == most or held + n > chars):
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield slice(at, len(lengths))


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def groups(words: list[str]) -> Iterator[list[list[str]]]:
    """Words in groups of JOINED, and as many groups as are encoded at once."""
    for some in parts(list(map(len, words)), JOINT):
        part = words[some]
        yield [part[i : i + JOINED] for i in range(0, len(part), JOINED)]


def new_ids(words: list[str], path: str, threads: int) -> Iterator[bytes | None]:
    """The backend's ids of each word, or none where the libraries differ."""
    tok, reference = load(path, threads)
    begins = verified(path)[2]
    for some in groups(words):
        joined = [" ".join(g) for g in some]
        ours = [e.ids for e in tok.encode_batch_fast(joined, add_special_tokens=False)]
        for group, a, b in zip(some, ours, reference.encode(joined, num_threads=threads), strict=True):
            ids = np.array(a, np.int32)
            starts = np.flatnonzero(begins[ids])
            if a == b and len(starts) == len(group) and starts[0] == 0:
                raw = ids.tobytes()
                yield from (raw[x:y] for x, y in pairwise([*(4 * starts).tolist(), len(raw)]))
            else:  # some word differs: each by itself
                alone = [e.ids for e in tok.encode_batch_fast(group, add_special_tokens=False)]
                yield from (packed(x) if x == y else None for x, y in zip(alone, reference.encode(group, num_threads=threads), strict=True))


def word_ids(words: list[str], path: str, threads: int) -> list[bytes | None]:
    """The backend's ids of distinct words, or none where the libraries differ; what is verified is remembered."""
    known = verified(path)[1]
    ids = list(map(known.get, words))
    new = [i for i, x in enumerate(ids) if x is None]
    if len(known) + len(new) > WORDS:
        kept = [(w, x) for w, x in zip(words, ids, strict=True) if x is not None]
        known.clear()
        known.update(kept)
    for i, x in zip(new, new_ids([words[i] for i in new], path, threads), strict=True):
        ids[i] = x
    known.update(islice(((words[i], ids[i]) for i in new if ids[i] is not None and len(words[i]) <= LONGEST), max(0, WORDS - len(known))))
    return ids


def broken(words: list[str], ids: list[bytes], path: str, threads: int) -> np.ndarray:
    """Whether each word's ids are decoded to something else."""
    out = np.zeros(len(words), bool)
    at = 0
    for some in groups(words):
        ends = at + np.cumsum([0, *map(len, some)])
        lists = [np.frombuffer(b"".join(ids[a:b]), np.int32).tolist() for a, b in pairwise(ends)]
        for (a, b), group, back in zip(pairwise(ends), some, decode(lists, path, threads), strict=True):
            if back != " ".join(group):
                alone = decode([np.frombuffer(x, np.int32).tolist() for x in ids[a:b]], path, threads)
                out[a:b] = [x != w for x, w in zip(alone, group, strict=True)]
        at = ends[-1]
    return out


def having(wrong: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text has one of the wrong words."""
    held = np.concatenate([[0], np.cumsum(wrong[at])])[ends]
    return held[1:] > held[:-1]


def in_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts without odd blanks, the word at each place, and the places at which texts begin and end."""
    some = pc.binary_length(texts).to_numpy() > 0  # an empty text has no word
    lists = pc.split_pattern(texts.filter(pa.array(some)), " ")
    n = np.zeros(len(texts), np.int64)
    n[some] = pc.list_value_length(lists).to_numpy()
    words = lists.flatten().dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), np.concatenate([[0], np.cumsum(n)])


def listed(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def of_words(ids: list[bytes], at: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The ids of texts, those of their words one after the other."""
    flat = np.frombuffer(b"".join(ids), np.int32)
    size = np.array([len(x) // 4 for x in ids], np.int64)
    begin, n = np.cumsum(size) - size, size[at]
    stop = np.cumsum(n)
    place = np.repeat(begin[at] - (stop - n), n)
    place += np.arange(len(place))
    return listed(flat[place], np.concatenate([[0], stop])[ends])


def of_whole(texts: list[str], path: str, threads: int) -> tuple[pa.ListArray, list[bool]]:
    """The ids of texts that go through both libraries whole, and whether these agree."""
    tok, reference = load(path, threads)
    found, parity = [], []
    for some in parts(list(map(len, texts))):
        for e, theirs in zip(tok.encode_batch_fast(texts[some], add_special_tokens=False), reference.encode(texts[some], num_threads=threads), strict=True):
            found.append(packed(e.ids))
            parity.append(e.ids == theirs)
    return listed(np.frombuffer(b"".join(found), np.int32), np.cumsum([0, *(len(x) // 4 for x in found)])), parity


def coded(texts: pa.Array, path: str, threads: int = 2, one_in: int = 0, again: bool = True) -> tuple[pa.ListArray, np.ndarray, np.ndarray | None]:
    """The backend's ids of each text, whether both libraries gave the same, and (again) whether decoding gives the text."""
    plain = ~odd(texts) if one_in != 1 and verified(path)[0] else np.zeros(len(texts), bool)
    while True:
        words, at, ends = in_words(texts.filter(pa.array(plain)))
        ids = word_ids(words, path, threads)
        wrong = np.array([x is None for x in ids], bool)
        if not wrong.any():
            break
        plain[plain] = ~having(wrong, at, ends)
    parity, whole = np.ones(len(texts), bool), np.flatnonzero(~plain)
    out = of_words(ids, at, ends)
    if len(whole):
        rest, parity[whole] = of_whole(texts.take(pa.array(whole)).to_pylist(), path, threads)
        order = np.empty(len(texts), np.int64)
        order[np.concatenate([np.flatnonzero(plain), whole])] = np.arange(len(texts))
        out = pa.concat_arrays([out, rest]).take(pa.array(order))
    if not again:
        return out, parity, None
    trip, unsure = np.ones(len(texts), bool), ~plain
    unsure[plain] = having(broken(words, ids, path, threads), at, ends)
    unsure = np.flatnonzero(unsure)
    for some in parts(pc.utf8_length(texts).take(pa.array(unsure)).to_pylist()):
        places = pa.array(unsure[some])
        trip[unsure[some]] = [a == b for a, b in zip(decode(out.take(places).to_pylist(), path, threads), texts.take(places).to_pylist(), strict=True)]
    return out, parity, trip


def encode(texts: list[str], path: str, threads: int = 2, one_in: int = 0) -> tuple[list[list[int]], list[bool]]:
    """The backend's ids of each text, and whether both libraries gave the same; with one_in = 1 every text is compared whole."""
    ids, parity, _ = coded(pa.array(texts, pa.string()), path, threads, one_in, again=False)
    return ids.to_pylist(), parity.tolist()


def decode(ids: list[list[int]], path: str, threads: int = 2) -> list[str]:
    """The texts of lists of ids, by the backend's decoder."""
    return load(path, threads)[0].decode_batch(ids, skip_special_tokens=False)


def encoded(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """docs with token_ids, n_tokens, parity (both libraries agree) and round_trip (decoding gives the text)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.fill_null("")
            for some in parts(pc.utf8_length(texts).to_pylist(), len(texts), PART):
                ids, parity, back = coded(texts[some], path, threads)
                yield pa.StructArray.from_arrays([ids, pa.array(parity), pa.array(back)], ["token_ids", "parity", "round_trip"])

    def code_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return given_back(run)(batches)

    code = F.arrow_udf(code_of, "token_ids array<int>, parity boolean, round_trip boolean")
    taken = {"token_ids", "n_tokens", "parity", "round_trip"}
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    (name,) = free_names(docs, "code")
    rows = docs.select(*columns, code(F.col("text")).alias(name))
    return rows.select(*columns, f"{name}.token_ids", F.size(f"{name}.token_ids").cast("bigint").alias("n_tokens"), f"{name}.parity", f"{name}.round_trip")


def decoded(rows: DataFrame, path: str, ids: str = "token_ids", threads: int = 2) -> DataFrame:
    """rows with decoded_text, the text of each list of ids (null: empty)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series(decode([[] if x is None else [int(i) for i in x] for x in lists], path, threads), dtype=object)

    return rows.withColumn("decoded_text", F.pandas_udf(run, "string")(F.col(ids)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
