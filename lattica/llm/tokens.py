"""Token counts of a byte-level BPE, with a shortcut for pre-tokens that are whole tokens.

Offline, every vocabulary string is put through the pre-tokenizer and the merge rules.  One that comes out as a
single pre-token and a single token is proven: in a text it counts as one token without merging.  (A vocabulary
holds strings of which neither need be true.)  Only the other pre-tokens are merged: those that are in the vocabulary
without being proven by the definition here, as the library would take them whole; the rest by the library's merge.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import CACHES, release

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens: contractions, a word, a number or a run of marks with a space before it, white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where a text's only numeric characters are decimal digits.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_LEARNED = 100_000
_LONG_PIECE = 64
_LONG_TEXT = 4_000_000
#: Characters of a text whose tokens the library may list at once.
_WHOLE_TEXT = 900_000
_STATE: dict = {}
CACHES.append(_STATE.clear)

SCHEMA = "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_direct bigint, n_merged bigint"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Byte-pair merging: of all adjacent pairs the one of lowest rank first, the leftmost of equal ones; a heap over a linked list."""
    parts, n = [piece[i : i + 1] for i in range(len(piece))], len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or parts[i] + parts[j] != pair:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = pair, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k, m in ((before[i], i), (i, after[i])):
            if k >= 0 and m < n and (pair := parts[k] + parts[m]) in ranks:
                heapq.heappush(heap, (ranks[pair], k, pair))
    return [p for p in parts if p]


def prove_whole(ranks: dict[bytes, int], pattern: str = PRE_TOKENS) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token."""
    import regex

    find = regex.compile(pattern).findall
    found = []
    for token in ranks:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue  # part of a character
        if find(text) == [text] and merge(token, ranks) == [token]:
            found.append(text)
    return frozenset(found)


def _unproven(ranks: dict[bytes, int], whole: frozenset[str], exact) -> frozenset[int]:
    """The ranks of pre-tokens that the library takes whole without merging leading there."""
    found = []
    for token, rank in ranks.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if text not in whole and exact.findall(text) == [text]:
            found.append(rank)
    return frozenset(found)


class _Pieces(dict):
    """Tokens in each pre-token; what is learned on the way is dropped when it grows large."""

    def __init__(self, whole, encode, ranks):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.encode, self.ranks, self.learned = whole, encode, ranks, 0

    def __missing__(self, piece: str) -> int:
        data = piece.encode()
        n = len(merge(data, self.ranks) if data in self.ranks else self.encode(piece))
        if len(piece) <= _LONG_PIECE:
            if self.learned >= _LEARNED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.learned = 0
            self[piece] = n
            self.learned += 1
        return n


def _counter(path: str, whole: frozenset[str]):
    """Function from a text to (tokens, pre-tokens, tokens counted directly); one for each worker and vocabulary."""
    key = (path, os.path.getmtime(path))
    if key in _STATE:
        return _STATE[key]
    import regex
    import tiktoken

    ranks = load_ranks(path)
    encoding = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    pieces = _Pieces(whole, encoding.encode_ordinary, ranks)
    exact, proven, plain = regex.compile(PRE_TOKENS), whole.__contains__, {}
    unproven, assigned, widths = _unproven(ranks, whole, exact), set(), np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    widths[list(ranks.values())] = list(map(len, ranks))

    def is_plain(text: str) -> bool:
        if text.isascii():
            return True
        for c in set(text):
            if c not in plain:
                plain[c] = c.isascii() or not (unicodedata.category(c)[0] == "N" and unicodedata.category(c) != "Nd") and c.isalnum() == (unicodedata.category(c)[0] in "LN")
            if not plain[c]:
                return False
        return True

    def count(text: str | None) -> tuple[int, int, int]:
        if not text:
            return 0, 0, 0
        pattern = _PLAIN if is_plain(text) else exact
        if len(text) <= _LONG_TEXT:
            found = pattern.findall(text)
            return sum(map(pieces.__getitem__, found)), len(found), sum(map(proven, found))
        total, n, direct, each = 0, 0, 0, (m[0] for m in pattern.finditer(text))
        while found := list(islice(each, 100_000)):
            total, n, direct = total + sum(map(pieces.__getitem__, found)), n + len(found), direct + sum(map(proven, found))
        return total, n, direct

    def sizes(text: str) -> Iterator[tuple[str, int]]:
        """(pre-token, its tokens) in order, without holding them all."""
        for m in (_PLAIN if is_plain(text) else exact).finditer(text):
            yield m[0], pieces[m[0]]

    def split(text: str) -> tuple[list[str], list[int]]:
        found = (_PLAIN if is_plain(text) else exact).findall(text)
        return found, list(map(pieces.__getitem__, found))

    def total(text: str | None) -> int:
        if not text:
            return 0
        return sum(split(text)[1]) if len(text) <= _LONG_TEXT else sum(n for _, n in sizes(text))

    def encode(text: str) -> list[int] | None:
        """The text's tokens from the library, in about half the time that ``pieces`` take; None where they may be others than by the definition."""
        if len(text) > _WHOLE_TEXT:
            return None
        if not text.isascii() and (new := set(text) - assigned):
            if any(unicodedata.category(c) == "Cn" for c in new):
                return None  # engines differ in the characters they know
            assigned.update(new)
        found = encoding.encode_ordinary(text)
        return found if not unproven or unproven.isdisjoint(found) else None

    count.sizes, count.split, count.total, count.encode, count.widths, count.exact = sizes, split, total, encode, widths, exact
    _STATE.clear()
    _STATE[key] = count
    return count


def proven(spark: SparkSession, tokenizer: str = TOKENIZER) -> Broadcast:
    """The proven strings, at most the vocabulary, for every task."""
    return spark.sparkContext.broadcast(prove_whole(load_ranks(tokenizer)))


def token_sizes(docs: DataFrame, column: str, tokenizer: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """``docs`` with the bigint ``column``, the number of each text's tokens (0 for a null text), in the text's place."""
    whole, fields = proven(docs.sparkSession, tokenizer), [f for f in docs.schema.fields if f.name != text_col]

    def count(batches):
        of = _counter(tokenizer, whole.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            sizes = pa.array([of.total(t) for t in batch.column(at).to_pylist()], pa.int64())
            yield batch.remove_column(at).append_column(column, sizes)
        release(keep_caches=True)

    return docs.mapInArrow(count, StructType([*fields, StructField(column, LongType())]))


def cut_text(text: str, capacity: int, tokenizer: str, whole: frozenset[str]) -> Iterator[tuple[str, int]]:
    """(part, tokens) of a text cut between pre-tokens into as long parts of at most ``capacity`` tokens as can be.

    The parts' tokens are those of the text, as a cut between pre-tokens changes none.  Only a pre-token of more than
    ``capacity`` tokens is itself cut, into runs of ``capacity`` / 4 characters, whose tokens may differ.
    """
    count = _counter(tokenizer, whole)
    run = max(1, capacity // 4)
    if len(text) > _LONG_TEXT:
        start = at = held = 0
        for piece, n in count.sizes(text):
            if held + n > capacity:
                if held:
                    yield text[start:at], held
                start, held = at, 0
            at += len(piece)
            if n > capacity:
                yield from ((text[k : min(k + run, at)], count.total(text[k : min(k + run, at)])) for k in range(start, at, run))
                start = at
            else:
                held += n
        if held:
            yield text[start:], held
        return
    if (ids := count.encode(text)) is not None:
        yield from _cut_encoded(text, ids, capacity, run, count)
        return
    pieces, sizes = count.split(text)
    total = sum(sizes)
    if total <= capacity:
        if total:
            yield text, total
        return
    ends, chars = np.cumsum(sizes), np.concatenate([[0], np.cumsum(list(map(len, pieces)))])
    i = before = 0
    while i < len(pieces):
        j = int(np.searchsorted(ends, before + capacity, side="right"))
        if j > i:
            yield text[chars[i] : chars[j]], int(ends[j - 1]) - before
        else:
            j = i + 1
            yield from ((x, count.total(x)) for k in range(0, len(pieces[i]), run) if (x := pieces[i][k : k + run]))
        i, before = j, int(ends[j - 1])


def _cut_encoded(text: str, ids: list[int], capacity: int, run: int, count) -> Iterator[tuple[str, int]]:
    """``cut_text`` of a text whose tokens are known: pre-tokens are looked for only where a part must end."""
    start = before = 0
    if len(ids) > capacity:
        ends = np.cumsum(count.widths[ids])
        if not text.isascii():  # from bytes to the characters begun by then
            ends = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)[ends - 1]
        while len(ids) - before > capacity:
            stop = int(ends[before + capacity])  # the part and its last pre-token end before
            at = text.rfind(" ", start, stop)
            while at > start and text[at - 1].isspace():
                at = text.rfind(" ", start, at)
            end = at = max(at, start)  # a pre-token begins at a space after another character, whatever comes before
            for m in count.exact.finditer(text, at):
                if m.end() >= stop:
                    break
                end = m.end()
            if end > start:
                after = int(np.searchsorted(ends, end, side="right"))
                yield text[start:end], after - before
            else:
                end = m.end()
                after = int(np.searchsorted(ends, end, side="right"))
                yield from ((x, count.total(x)) for k in range(start, end, run) if (x := text[k : min(k + run, end)]))
            start, before = end, after
    if before < len(ids):
        yield text[start:], len(ids) - before


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each document: ``doc_id, n_tokens, n_pretokens, n_direct, n_merged``.

    ``n_direct`` tokens are pre-tokens proven whole; ``n_merged`` come from the other pre-tokens.  ``tokenizer`` is
    a rank file that every executor can read.  One row for each input row, repeated rows and null ids included; a
    null or empty text has zero of everything.  Other columns are not read, so none can clash.
    """
    whole = proven(docs.sparkSession, tokenizer)

    def count(batches):
        of = _counter(tokenizer, whole.value)
        for batch in batches:
            found = [of(t) for t in batch.column(1).to_pylist()]
            total, n, direct = (pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], [])))
            merged = pa.array([a[0] - a[2] for a in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), total, n, direct, merged], names=["doc_id", "n_tokens", "n_pretokens", "n_direct", "n_merged"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, SCHEMA)
