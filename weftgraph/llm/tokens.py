"""Exact token counts of whole texts, huge ones by overlap resynchronisation.

A huge text is encoded in overlapping chunks. Pre-tokenizers of the supported kinds
scan from left to right without memory, so when the true scan has a word boundary at a
place, everything after it depends on the text from there only. A boundary that the
left chunk shows well before its right end is true (given that the chunk was entered
at a true one); if the right chunk has a boundary at the same place, its tokens from
there on are the true ones, and the two are spliced. Where the overlap holds no common
boundary it is doubled, and in the end the left chunk itself.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import slices

CHUNK, OVERLAP = 32768, 256
#: Entries of the cache of word counts; further words are encoded anew each time.
CACHE = 700_000
_cache: dict[tuple, dict[str, int]] = {}


class Encoded:
    """Word starts of one chunk (code points) and the tokens before each."""

    def __init__(self, starts: list[int], before: list[int], total: int):
        self.starts, self.before, self.total = starts, before, total

    def tokens(self, since: int, until: int | None = None) -> int:
        at = lambda x: self.before[i] if (i := bisect_left(self.starts, x)) < len(self.starts) else self.total
        return (self.total if until is None else at(until)) - at(since)


class JsonTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        said = json.loads(self.t.to_str())
        pre, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        self.margin = 8 + max([0, *(len(a["content"]) for a in added)])
        #: Whether a space before a visible character always starts a word of its own.
        self.by_space = (
            said.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] for a in added)
        )

    def chunk(self, text: str) -> Encoded:
        e = self.t.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        heads = [i for i in range(len(words)) if not i or words[i] is None or words[i] != words[i - 1]]
        return Encoded([offsets[i][0] for i in heads], heads, len(words))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokenizer:
    """Pieces hold the space mark only in front, so a space after a visible character starts a word."""

    by_space, margin = False, 8

    def __init__(self, path: str):
        import sentencepiece

        self.t = sentencepiece.SentencePieceProcessor(model_file=path)

    def chunk(self, text: str) -> Encoded:
        starts, before, at, last = [], [], 0, "▁"
        pieces = self.t.encode(text, return_type="proto").pieces
        for i, p in enumerate(pieces):
            if not i or p.piece.startswith("▁") and not last.endswith("▁"):
                starts.append(at)
                before.append(i)
            at, last = at + len(p.surface), p.piece
        return Encoded(starts, before, len(pieces))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.t.encode(texts, num_threads=1)]


@lru_cache(4)
def tokenizer(name: str) -> JsonTokenizer | PieceTokenizer:
    """``name``: a file, or the name of one that ``public_tokenizers.path`` finds."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return PieceTokenizer(name) if name.endswith(".model") else JsonTokenizer(name)


def count_huge(t: JsonTokenizer | PieceTokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` by overlapping chunks."""
    total, start, entered, size, n = 0, 0, 0, chunk, len(text)
    left = t.chunk(text[:size])
    while start + size < n:
        end, wide, found = start + size, overlap, None
        while found is None and wide < size // 2:
            begin = end - wide
            right = t.chunk(text[begin : begin + chunk])
            seen = {begin + x for x in right.starts[1:]}
            lo, hi = bisect_left(left.starts, max(begin, entered) + 1 - start), bisect_left(left.starts, end - t.margin - start)
            found = next((start + x for x in left.starts[lo:hi] if start + x in seen), None)
            wide *= 2
        if found is None:  # no common boundary: a longer left chunk
            size *= 2
            left = t.chunk(text[start : start + size])
            continue
        total += left.tokens(entered - start, found - start)
        start, entered, left, size = begin, found, right, chunk
    return total + left.tokens(entered - start)


def _pieces(text: str) -> list[str]:
    """``text`` cut before each space that a visible character follows."""
    if "  " not in text and not re.search(r" [^\S ]| $", text):
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]
    return re.split(r"(?= \S)", text)


def count_texts(t: JsonTokenizer | PieceTokenizer, name: tuple, texts: list[str]) -> list[int]:
    """Tokens of each text. Words are encoded once and remembered where ``by_space`` proves it right."""
    small = [x if len(x) <= CHUNK else "" for x in texts]
    if t.by_space:
        known = _cache.setdefault(name, {})
        cut = [_pieces(x) for x in small]
        new = list({p for c in cut for p in c if p not in known})
        fresh = dict(zip(new, t.counts(new)))
        if len(known) + len(fresh) <= CACHE:
            known.update(fresh)
            out = [sum(map(known.__getitem__, c)) for c in cut]
        else:
            out = [sum(known[p] if p in known else fresh[p] for p in c) for c in cut]
    else:
        out = t.counts(small)
    return [n if len(x) <= CHUNK else count_huge(t, x) for n, x in zip(out, texts)]


def token_counts(docs: DataFrame, tokenizer_name: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """UTF-8 bytes and tokens of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts count 0. Nothing is cut off; repeated rows each give a row;
    an empty table gives none. No shuffle: each task reads and counts its own rows.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t = tokenizer(tokenizer_name)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
            for a, b in slices(sizes):
                got = count_texts(t, (tokenizer_name,), [x or "" for x in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "n_bytes": pa.array(sizes[a:b], pa.int64()),
                        "n_tokens": pa.array(got, pa.int64()),
                        "over_limit": pa.array([x > limit for x in got], pa.bool_()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
