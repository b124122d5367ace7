"""Best-two-fit packing of documents into sequences of a fixed size."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release
from .tokens import TOKENIZER, cut_text, proven

CAPACITY = 2048
#: Bytes of text in a shard.
SHARD = 32_000_000
SCHEMA = "bin bigint, slot int, doc_id bigint, row_id bigint, piece bigint, start bigint, size bigint, text string"


def words(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\t\n\f\r ]+")), F.lit(0)).cast("bigint")


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes`` (each 1..capacity).

    Each bin takes the largest document that fits until none does.  Then its smallest document gives way to the
    two unpacked documents of the largest sum that fits in its place, if their sum is larger than it.  Ties go to
    the pair with the largest document, and to the earlier position.
    """
    heaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        heaps[sizes[i]].append(i)
    have = mirror = 0  # bit s, and bit capacity - s: a document of size s is left
    for s, heap in enumerate(heaps):
        if heap:
            have |= 1 << s
            mirror |= 1 << (capacity - s)

    def take(s: int) -> int:
        nonlocal have, mirror
        i = heaps[s].pop()
        if not heaps[s]:
            have &= ~(1 << s)
            mirror &= ~(1 << (capacity - s))
        return i

    bins = []
    while have:
        held, gap = [], capacity
        while fits := have & ((2 << gap) - 1):
            s = fits.bit_length() - 1
            held.append(take(s))
            gap -= s
        if gap and len(held) > 1 and have:
            least = sizes[held[-1]]
            lowest = (have & -have).bit_length() - 1
            for total in range(gap + least, max(least, 2 * lowest - 1), -1):
                pair = have & (mirror >> (capacity - total))
                if not total & 1 and len(heaps[total // 2]) < 2:
                    pair &= ~(1 << (total // 2))
                if pair:
                    back = held.pop()
                    large = pair.bit_length() - 1
                    held += [take(large), take(total - large)]
                    heaps[least].append(back)
                    have |= 1 << least
                    mirror |= 1 << (capacity - least)
                    break
        bins.append(held)
    return bins


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Pack documents into bins of ``capacity`` tokens: ``bin, slot, doc_id, row_id, piece, start, size, text``, one row for each piece.

    Sizes are tokens as ``token_counts`` counts them.  A document larger than a bin is cut between pre-tokens: all its
    pieces but the last are as long as a bin allows, and all are packed like documents.  ``row_id`` is a number of the
    input row, so it tells copies of one document apart; ``start`` is in tokens; the texts of a row's pieces, in order,
    are its text.  The pieces are dealt by hash to shards of about ``shard`` bytes of text, each packed by itself by
    the same rule; this is so at every size, a small table having one shard.  At most the last bins of a shard are left
    emptier than they need be.  Every row is packed: a repeated row as often as it comes, a null id like any other.
    A null or empty text takes no room and has no row.  Other columns are not read; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("length(text) > 0")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard))
    whole = proven(docs.sparkSession, tokenizer)
    types = [("shard", pa.int32()), ("doc_id", pa.int64()), ("row_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("text", pa.string())]

    def cut(batches):
        base, row, seen = TaskContext.get().partitionId() << 33, 0, Counter()
        for batch in batches:
            out, held = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                for piece, (part, size) in enumerate(cut_text(text, capacity, tokenizer, whole.value)):
                    # Copies of a document differ in how many came before, so they don't all meet in one shard.
                    key = hashlib.blake2b(f"{i} {piece} {seen[i]}".encode(), digest_size=8).digest()
                    out.append((int.from_bytes(key) % shards, i, base + row, piece, start, size, part))
                    start += size
                    held += len(part)
                    if held > 4_000_000:
                        yield _batch(out, types)
                        out, held = [], 0
                seen[i] += 1
                row += 1
            if out:
                yield _batch(out, types)
        release(keep_caches=True)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("row_id", "ascending"), ("piece", "ascending")])
        bins = best_two_fit(table.column("size").to_pylist(), capacity)
        order = [i for held in bins for i in held]
        first = table.column("shard")[0].as_py() << 32
        out = table.set_column(table.schema.get_field_index("text"), "text", table.column("text").cast(pa.large_string())).take(order).select(["doc_id", "row_id", "piece", "start", "size", "text"])
        out = out.add_column(0, "bin", pa.array([first + k for k, held in enumerate(bins) for _ in held], pa.int64()))
        out = out.add_column(1, "slot", pa.array([k for held in bins for k in range(len(held))], pa.int32()))
        out = out.set_column(out.schema.get_field_index("text"), "text", out.column("text").cast(pa.string()))
        table = None
        release()
        return out

    pieces = texts.mapInArrow(cut, "shard int, doc_id bigint, row_id bigint, piece bigint, start bigint, size bigint, text string")
    return pieces.groupBy("shard").applyInArrow(pack, SCHEMA)


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])
