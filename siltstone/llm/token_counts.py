"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of more than CHUNK + OVERLAP characters is never encoded in one piece. Chunks that overlap
are encoded with offsets and the words the tokenizer's own pre-tokenizer found. A position at
which a word starts in two neighbouring chunks is a proven stable boundary: the chunk on the left
is right up to it, because its last GUARD characters, which might continue beyond its end, are
left out; and the pre-tokenizer matches from left to right, so that from a common start on the
right chunk finds the words of the whole text. Words are encoded each for itself. Where no common
start exists, the overlap is doubled and the right chunk encoded again, at most until it starts
where the left one did.

Shorter texts in scripts whose letters and digits every Unicode version agrees on (up to U+024F)
are cut into words by the pre-tokenizer's published pattern, and each distinct word is encoded by
the library once; other texts are encoded whole.

This holds for tokenizers without normaliser whose pre-tokenizer looks at most one character
back or ahead of a match (byte-level BPE); for others every text is encoded whole. Added tokens are
cut out of a text before, as the library does, unless they take blanks or want whole words.

Defined cases: null counts as empty, empty has 0 tokens; strings of special tokens in a text are
handled as the library does by default; nothing is truncated or padded; rows that repeat an id are
counted each; an empty table gives no rows; columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK, OVERLAP, GUARD = 32768, 512, 8
LIMIT = 1024
GROUP = 16
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose counts a worker keeps, and the longest word kept.
KEPT, KEPT_LENGTH = 400_000, 64


def splice(text: str, encode: Callable[[str], tuple[list[tuple[int, int]], list[int | None]]], chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> int:
    """The number of tokens of text; encode gives offsets and word numbers of a piece."""
    n = len(text)
    total, begin = 0, 0  # tokens before begin are counted; begin is a word's start in the whole text
    while True:
        end = min(n, begin + chunk + overlap)
        offsets, words = encode(text[begin:end])
        if end == n:
            return total + len(offsets)
        # starts of words in the left chunk, by position in the text, with the tokens before each
        left = {}
        for i, (o, w) in enumerate(zip(offsets, words, strict=True)):
            if i == 0 or words[i - 1] != w:
                left[begin + o[0]] = i
        wide = overlap
        while True:
            start = max(begin, end - wide)
            if start == begin:
                cut = max((p for p in left if begin < p <= end - guard), default=None)
                break
            other, numbers = encode(text[start : min(n, end + guard)])
            cut = None
            for i, o in enumerate(other):
                p = start + o[0]
                if i and numbers[i - 1] != numbers[i] and p in left and p <= end - guard:
                    cut = p
            if cut is not None:
                break
            wide *= 2
        if cut is None:  # one word fills the chunk: take more of the text at once
            return total + len(encode(text[begin:])[0]) if chunk + overlap >= n - begin else total + splice(text[begin:], encode, 2 * chunk, overlap, guard)
        total += left[cut]
        begin = cut


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a tokenizer file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    stable = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    added = [t["content"] for t in spec.get("added_tokens") or []]
    # the longest added token at the first place; only plain ones can be cut out here
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
    apart = re.compile("|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) or r"(?!)")

    def one(piece: str):
        e = tok.encode(piece, add_special_tokens=False)
        return e.offsets, e.word_ids

    words_of = regex.compile(PATTERN).findall
    beyond = re.compile("[^\x00-\u024f]").search
    known: dict[str, int] = {}

    def by_words(text: str) -> int:
        words = words_of(text)
        new = list({w for w in words if w not in known})
        if not new:
            return sum([known[w] for w in words])
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list(set(words))
        own = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (known if len(w) <= KEPT_LENGTH else own)[w] = len(e)
        return sum([known[w] if w in known else own[w] for w in words])

    def count(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole = []
        for i, t in enumerate(texts):
            # an added token is cut out before words are looked for
            if not stable or not plain and any(a in t for a in added):
                whole.append(i)
            elif any(a in t for a in added):
                pieces = apart.split(t)
                out[i] = len(pieces) - 1 + sum(count([p for p in pieces if p]))
            elif len(t) > CHUNK + OVERLAP:
                out[i] = splice(t, one)
            elif beyond(t):
                whole.append(i)
            else:
                out[i] = by_words(t)
        # an encoding takes some hundred bytes a token: few texts at a time
        for at in range(0, len(whole), GROUP):
            part = whole[at : at + GROUP]
            for i, e in zip(part, tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = len(e)
        return out

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series(count(texts.fillna("").tolist()), dtype="int64")

    n_tokens = F.pandas_udf(run, "bigint")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
