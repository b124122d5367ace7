"""Exact Jaccard self-join of documents over word n-grams, by vertical partitioning.

1. One pass over the texts hashes every document's distinct n-grams and scatters them, packed, into hash
   fragments of about a million.  A fragment sees every occurrence of its n-grams, so it tells each
   document which of them no other document has.  A document with more than (1 - threshold) of its n-grams
   to itself can have no partner; that exact test removes almost all documents.
2. The survivors collapse to one per distinct n-gram set; the same bounce among these gives each n-gram its
   document frequency.  (frequency class, hash) is the global order, rarest first.
3. Prefix filter: partners share an n-gram among the first n - ceil(threshold * n) + 1 of both.  Those,
   with length and position bounds, give candidate pairs.
4. The global order is cut into ``parts`` fragments of equal weight.  Each fragment counts the overlap of
   its candidate pairs on its own segment of every set; the partial overlaps are summed per pair.

Groups of candidates are also cut horizontally: a pair belongs with its smallest neighbour, so a group of
copies meets in one place and neither memory nor traffic depends on the size of the corpus.

Sets that share n-grams of very long prefix lists (crowds, such as thousands of versions of one text) have almost
all pairs as candidates, and most of them as links.  No pair of a crowd is written down: it is cut into blocks, the
overlaps of two blocks are a matrix product, and only each set's number of links and a forest of the links leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .components import components, groups
from .ngrams import _IS_WORD, chunks, mix64, ngram_hashes
from .shared import release, written

FRAGMENT = 1_000_000
PAIRS = 100_000
#: Pairs of postings beyond which a group's overlaps are taken by matrix product, where that is less work.
DENSE = 50_000
#: Sets that share a prefix n-gram beyond which its pairs are not listed, if a crowd can be made of them.
CROWD = 200
#: N-grams, and sets, of a block of a crowd.
BLOCK, BLOCK_SETS = 1_000_000, 2048
#: Rows up to which a table of a crowd's members is sent to each task.
SMALL = 500_000
_LOW48 = np.uint64((1 << 48) - 1)
_SCATTERED = "part int, chunk bigint, frag int, a binary, b binary, c binary"
_RETURNED = "chunk bigint, frag int, a binary, b binary, c binary, d binary"
_SETS = "doc_id bigint, sig bigint, n int, own int, grams binary, bins binary"
_FOUND = "kind int, a bigint, b bigint, jaccard double, n_links bigint"
_PAIR, _COUNT, _EDGE = range(3)
_EPS = 1e-9


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _pack_counts(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of the places that have one, so that a run's small fragments take little."""
    return at.astype(np.uint32).tobytes() + counts.astype(np.uint32).tobytes()


def _unpack_counts(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b, np.uint32).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def frequency_class(df: np.ndarray) -> np.ndarray:
    """Sixteen classes to a doubling, in a byte: exact up to 16, then ascending with the frequency."""
    x = np.maximum(df, 1)
    fine = 16 + np.floor(np.log2(np.maximum(x, 16) / 16) * 8).astype(np.int64)
    return np.minimum(np.where(x < 16, x, fine), 255).astype(np.uint8)


def _grams_of_texts(batches, n: int, long: int = 1_500_000):
    """(ids, signatures, counts, grams) per run of texts; grams are distinct and ascending within each document."""

    def short():
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(t) <= long:
                    yield i, t
                else:
                    whole.append((i, t))

    def described(keys, parts):
        sigs = np.array([mix64(g).sum(dtype=np.uint64) for g in parts], np.uint64)
        return np.array(keys, np.int64), sigs, np.array([len(g) for g in parts], np.int64), np.concatenate(parts)

    whole: list[tuple[int, bytes]] = []
    for ids, data, bounds in chunks(short(), 1_000_000):
        doc, grams = ngram_hashes(data, bounds, n)
        edges = np.searchsorted(doc, np.arange(len(ids) + 1))
        held = [(i, np.unique(grams[s:e])) for i, s, e in zip(ids, edges[:-1], edges[1:], strict=True) if s < e]
        if held:
            yield described(*zip(*held, strict=True))
        yield from _long_texts(whole, n, described)
    yield from _long_texts(whole, n, described)


def _long_texts(whole, n: int, described):
    while whole:
        i, text = whole.pop()
        parts = [np.unique(ngram_hashes(np.frombuffer(piece + b"\n", np.uint8), np.array([0, len(piece) + 1]), n)[1]) for piece in _pieces(text, n)]
        if sum(map(len, parts)):
            yield described([i], [np.unique(np.concatenate(parts))])


def _pieces(text: bytes, n: int, limit: int = 700_000):
    """A long text cut at words; each piece repeats the n - 1 words before it."""
    at = 0
    while len(text) - at > 2 * limit:
        cut = at + limit
        while cut < len(text) and _IS_WORD[text[cut]]:
            cut += 1
        yield text[at:cut]
        back = cut
        for _ in range(n - 1):
            while back > at and not _IS_WORD[text[back - 1]]:
                back -= 1
            while back > at and _IS_WORD[text[back - 1]]:
                back -= 1
        at = back if back > at else cut
    yield text[at:]


def _grams_of_sets(batches):
    ids, sigs, counts, parts, size = [], [], [], [], 0
    for batch in batches:
        for i, s, g in zip(*(batch.column(k).to_pylist() for k in ("sig", "n", "grams")), strict=True):
            g = np.frombuffer(g, np.uint64)
            ids.append(i), sigs.append(s), counts.append(len(g)), parts.append(g)
            size += len(g)
            if size > 400_000:
                yield np.array(ids, np.int64), np.array(sigs, np.uint64), np.array(counts), np.concatenate(parts)
                ids, sigs, counts, parts, size = [], [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(sigs, np.uint64), np.array(counts), np.concatenate(parts)


def _scatter(runs, fragments: int, lengths_in_sig: bool):
    """Packed rows of every run for every fragment, and one row that tells what the run holds."""
    base = TaskContext.get().partitionId() << 32
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("frag", pa.int32()), *[(c, pa.binary()) for c in "abc"]])
    for k, (ids, sigs, counts, grams) in enumerate(runs):
        doc = np.repeat(np.arange(len(ids)), counts)
        frag = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(frag, kind="stable")
        frag, doc, low = frag[order], doc[order], grams[order] & _LOW48
        edges = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1], [True]]))
        lengths = sigs.astype(np.uint32) if lengths_in_sig else counts.astype(np.uint32)
        rows = [(int((base + k) % fragments), base + k, -1, ids.tobytes(), lengths.tobytes(), sigs.tobytes())]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            held = np.flatnonzero(np.concatenate([[True], doc[s + 1 : e] != doc[s : e - 1]]))
            rows.append((int(frag[s]), base + k, int(frag[s]), _pack48(low[s:e]), _pack_counts(doc[s + held], np.diff(np.append(held, e - s))), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    release()


def _fragment(table: pa.Table) -> pa.Table:
    """Of each run, how many n-grams of each document others have too, and these with their frequency classes."""
    out = []
    rows = list(zip(*(_column(table, c) for c in ("chunk", "frag", "a", "b", "c")), strict=True))
    for r in rows:
        if r[1] < 0:
            out.append((*r, None))
    rows = [r for r in rows if r[1] >= 0]
    if rows:
        packs = [_unpack48(r[2]) for r in rows]
        grams = np.concatenate(packs)
        order = np.argsort(grams)
        g = grams[order]
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(new, len(g)))
        df = np.empty(len(g), np.int64)
        df[order] = np.repeat(size, size)
        at = 0
        for r, pack in zip(rows, packs, strict=True):
            docs, held = _unpack_counts(r[3])
            mine = df[at : at + len(pack)]
            at += len(pack)
            more = mine > 1
            if not more.any():
                continue
            doc = np.repeat(np.arange(len(held)), held)
            others = np.bincount(doc[more], minlength=len(held))
            some = others > 0
            out.append((r[0], r[1], None, _pack_counts(docs[some], others[some]), _pack48(pack[more]), frequency_class(mine[more]).tobytes()))
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    grams = order = g = df = None
    release()
    if not out:
        return pa.table({c: pa.array([], t) for c, t in zip(["chunk", "frag", "a", "b", "c", "d"], types, strict=True)})
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "frag", "a", "b", "c", "d"])


def _gather(threshold: float):
    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(_column(table, c) for c in ("frag", "a", "b", "c", "d")), strict=True), key=lambda r: r[0])
        ids, n, sigs = np.frombuffer(rows[0][1], np.int64), np.frombuffer(rows[0][2], np.uint32).astype(np.int64), np.frombuffer(rows[0][3], np.uint64)
        shared = np.zeros(len(ids), np.int64)
        for r in rows[1:]:
            at, held = _unpack_counts(r[2])
            shared[at] += held
        live = shared >= np.ceil(threshold * n - _EPS)
        docs, grams, bins = [], [], []
        for frag, _, held, low, classes in rows[1:]:
            doc = np.repeat(*_unpack_counts(held))
            keep = live[doc]
            docs.append(doc[keep])
            grams.append(_unpack48(low)[keep] << np.uint64(16) | np.uint64(frag & 0xFFFF))
            bins.append(np.frombuffer(classes, np.uint8)[keep])
        doc, gram, cls = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((docs, np.int64), (grams, np.uint64), (bins, np.uint8)))
        order = np.lexsort((gram, cls, doc))
        doc, gram, cls = doc[order], gram[order], cls[order]
        at = np.flatnonzero(live)
        lo, hi = np.searchsorted(doc, at), np.searchsorted(doc, at, side="right")
        out = [
            pa.array(ids[at], pa.int64()), pa.array(sigs[at].view(np.int64), pa.int64()), pa.array(n[at], pa.int32()), pa.array(n[at] - shared[at], pa.int32()),
            pa.array([gram[s:e].tobytes() for s, e in zip(lo, hi, strict=True)], pa.binary()), pa.array([cls[s:e].tobytes() for s, e in zip(lo, hi, strict=True)], pa.binary()),
        ]
        return pa.table(out, names=["doc_id", "sig", "n", "own", "grams", "bins"])

    return gather


def _bounce(runs: DataFrame, threshold: float) -> DataFrame:
    return runs.groupBy("part").applyInArrow(_fragment, _RETURNED).groupBy("chunk").applyInArrow(_gather(threshold), _SETS)


def _prefix(threshold: float, parts: int):
    """Rows of the sets' rarest n-grams, packed by hash part."""

    def prefix(batches):
        for batch in batches:
            held, crowds = [], {}
            for i, n, own, g, crowd in zip(*(batch.column(c).to_pylist() for c in ("sig", "n", "own", "grams", "crowd")), strict=True):
                size = _prefix_size(n, own, threshold)
                if size > 0:
                    if crowd is not None:
                        crowds[i] = crowd
                    g = np.frombuffer(g[: 8 * size], np.uint64)
                    held.append((np.full(len(g), i, np.int64), np.full(len(g), n, np.int32), np.arange(own, own + len(g), dtype=np.int32), g))
            if not held:
                continue
            ids, n, pos, g = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (mix64(g) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
            cuts = [order[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
            members = np.array(list(crowds), np.int64)
            crowded = [[(i, crowds[i]) for i in np.unique(ids[c][np.isin(ids[c], members)]).tolist()] if crowds else [] for c in cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[c[0]]) for c in cuts], pa.int32()), *[pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (ids, n, pos, g)],
                    pa.array([np.array(x, np.int64).tobytes() for x in crowded], pa.binary()),
                ],
                names=["part", "ids", "n", "pos", "grams", "crowds"],
            )

    return prefix


def _prefix_size(n: int, own: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - _EPS) + 1 - own


def _frequent(threshold: float, limit: int):
    """The n-grams of the sets' prefixes that more than ``limit`` sets may hold."""
    least = frequency_class(np.array([limit + 1]))[0]

    def frequent(batches):
        for batch in batches:
            ids, grams = [], []
            for i, n, own, g, cls in zip(*(batch.column(c).to_pylist() for c in ("sig", "n", "own", "grams", "bins")), strict=True):
                size = max(0, _prefix_size(n, own, threshold))
                g = np.frombuffer(g[: 8 * size], np.int64)[np.frombuffer(cls[:size], np.uint8) >= least]
                if len(g):
                    ids.append(np.full(len(g), i, np.int64)), grams.append(g)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(ids))], names=["gram", "sig"])

    return frequent


def _crowds(live: DataFrame, threshold: float) -> DataFrame | None:
    """``sig, crowd`` of the sets whose pairs within their crowd are counted by blocks; None if there are none.

    A crowd is what prefix n-grams of more than ``CROWD`` sets connect, if its sets have fewer pairs than these n-grams'
    lists have; what long lists connect but loosely is tried again by longer ones only, and at last left to the lists.
    """
    limit, found = CROWD, None
    posts = written(live.mapInArrow(_frequent(threshold, limit), "gram bigint, sig bigint"), "ngram_frequent")
    while True:
        long = posts.groupBy("gram").agg(F.count("*").alias("held"), F.min("sig").alias("first")).where(F.col("held") > limit)
        lists = written(posts.hint("merge").join(long, "gram"), "ngram_lists")  # its files are so well packed that their size would have all of it broadcast
        if lists.isEmpty():
            return found
        group = groups(lists.select("sig", "first").distinct(), "sig", "first").select(F.col("member").alias("sig"), "head")
        lists = lists.join(group, "sig", "left").select("gram", "sig", "held", F.coalesce("head", "sig").alias("crowd"))
        close = lists.groupBy("crowd").agg(F.count_distinct("sig").cast("double").alias("sets"), F.sum("held").alias("pairs")).where("sets * sets <= pairs").select("crowd")
        members = written(lists.join(close, "crowd", "left_semi").select("sig", "crowd").distinct(), "ngram_crowds")
        found = members if found is None else found.unionAll(members)
        posts = written(lists.join(members, "sig", "left_anti").select("gram", "sig"), "ngram_frequent")
        limit *= 4


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _crowd_links(live: DataFrame, crowds: DataFrame, shared: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """The links within crowds, by pairs of blocks: with ``pairs`` one row each, else numbers of links and a forest; pairs with sets of ``shared`` always have a row."""
    sets = live.select("sig", "n", (F.length("grams") / 8).alias("held")).join(_sent(crowds), "sig").join(shared.withColumn("plain", F.lit(False)), "sig", "left")
    weight = F.sum(F.greatest("held", F.lit(BLOCK / BLOCK_SETS))).over(Window.partitionBy("crowd").orderBy("n", "sig").rowsBetween(Window.unboundedPreceding, 0))
    placed = written(sets.select("sig", "n", "crowd", F.floor(weight / BLOCK).cast("int").alias("block"), F.coalesce("plain", F.lit(True)).alias("plain")), "ngram_blocks")
    blocks = placed.groupBy("crowd", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    first, second = (blocks.select("crowd", F.col("block").alias(k), F.col("least").alias(f"least_{k}"), F.col("most").alias(f"most_{k}")) for k in ("i", "j"))
    met = first.join(second, "crowd").where((F.col("i") <= F.col("j")) & (F.col("most_i") >= threshold * F.col("least_j") - _EPS)).select("crowd", "i", "j")
    asked = met.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    asked = written(placed.join(asked, ["crowd", "block"]), "ngram_asked")
    rows = live.select("sig", "grams").join(_sent(asked), "sig")
    return written(rows.groupBy("crowd", "i", "j").applyInArrow(_block_links(threshold, pairs), _FOUND), "ngram_crowd_links")


def _block_links(threshold: float, pairs: bool):
    def block_links(table: pa.Table) -> pa.Table:
        ids, n, block, plain = (table.column(c).to_numpy() for c in ("sig", "n", "block", "plain"))
        packs = [np.frombuffer(b, np.uint64) for b in _column(table, "grams")]
        local = np.repeat(np.arange(len(ids)), [len(p) for p in packs])
        grams, postings = np.unique(np.concatenate(packs), return_inverse=True)
        packs = None
        some = np.bincount(postings, minlength=len(grams))[postings] > 1
        local, postings = local[some], np.unique(postings[some], return_inverse=True)[1]
        order = np.argsort(postings, kind="stable")
        local, postings = local[order], postings[order]
        least, most = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, cols = np.flatnonzero(block == least), np.flatnonzero(block == most)
        overlap = _products(local, postings, rows, cols) if len(local) else np.zeros((len(rows), len(cols)), np.float32)
        held, label, linked = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for s in range(0, len(rows), 256):
            mine = rows[s : s + 256]
            common = overlap[s : s + 256].astype(np.float64)
            jaccard = common / (n[mine][:, None] + n[cols] - common)
            link = (jaccard >= threshold - _EPS) & (common > 0)
            if least == most:
                link &= mine[:, None] < cols
            a, b = np.nonzero(link)
            score = jaccard[a, b]
            a, b = mine[a], cols[b]
            row = np.full(len(a), pairs) | ~(plain[a] & plain[b])
            linked.append((a[row], b[row], score[row]))
            np.add.at(held, a[~row], 1), np.add.at(held, b[~row], 1)
            if len(a[~row]):
                far = np.flatnonzero(label != np.arange(len(ids)))
                label = components(len(ids), np.concatenate([a[~row], far]), np.concatenate([b[~row], label[far]]))
        a, b, score = (np.concatenate(x) for x in zip(*linked, strict=True))
        counted, far = np.flatnonzero(held), np.flatnonzero(label != np.arange(len(ids)))
        sizes = [len(a), len(counted), len(far)]
        none = lambda k: np.zeros(k, np.int64)
        out = {
            "kind": np.repeat([_PAIR, _COUNT, _EDGE], sizes).astype(np.int32), "a": ids[np.concatenate([a, counted, far])], "b": np.concatenate([ids[b], none(len(counted)), ids[label[far]]]),
            "jaccard": np.concatenate([score, np.zeros(len(counted) + len(far))]), "n_links": np.concatenate([none(len(a)), held[counted], none(len(far))]),
        }
        overlap = grams = postings = local = order = None
        release()
        return pa.table(out)

    return block_links


def _posting_pairs(keys: np.ndarray, limit: int = 1_000_000):
    """Index pairs (i < j) of equal values in the ascending ``keys``, a block at a time."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.append(new, len(keys)))
    for k in np.unique(size[size > 1]):
        starts = new[size == k]
        if k * (k - 1) // 2 <= limit:
            i, j = np.triu_indices(k, 1)
            step = max(1, limit // len(i))
            for s in range(0, len(starts), step):
                base = starts[s : s + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            for start in starts:
                step = max(1, limit // k)
                for s in range(0, k - 1, step):
                    rows = np.arange(s, min(s + step, k - 1))
                    i = np.repeat(rows, k - 1 - rows)
                    j = np.arange(len(i)) - np.repeat(np.cumsum(k - 1 - rows) - (k - 1 - rows), k - 1 - rows) + i + 1
                    yield start + i, start + j


def _candidates(threshold: float):
    share = threshold / (1 + threshold)

    def candidates(table: pa.Table) -> pa.Table:
        ids, n, pos, grams = (np.concatenate([np.frombuffer(b, t) for b in _column(table, c)]) for c, t in (("ids", np.int64), ("n", np.int32), ("pos", np.int32), ("grams", np.uint64)))
        sets, local = np.unique(ids, return_inverse=True)
        length = np.zeros(len(sets), np.int64)
        length[local] = n
        crowd = np.arange(len(sets))
        known = np.concatenate([np.frombuffer(b, np.int64) for b in _column(table, "crowds")]).reshape(-1, 2)
        crowd[np.searchsorted(sets, known[:, 0])] = len(sets) + np.unique(known[:, 1], return_inverse=True)[1]
        order = np.lexsort((local, grams))
        grams, local, pos = grams[order], local[order].astype(np.int64), pos[order].astype(np.int64)
        # The lists that lie within a crowd give no pairs here.
        new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        mixed = np.repeat(np.minimum.reduceat(crowd[local], new) != np.maximum.reduceat(crowd[local], new), np.diff(np.append(new, len(grams))))
        grams, local, pos = grams[mixed], local[mixed], pos[mixed]
        left = length[local] - pos
        found: list[np.ndarray] = []
        held = 0
        for i, j in _posting_pairs(grams):
            a, b = local[i], local[j]
            na, nb = length[a], length[b]
            ok = (crowd[a] != crowd[b]) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - _EPS) & (np.minimum(left[i], left[j]) >= share * (na + nb) - _EPS)
            found.append(np.unique(a[ok] << 32 | b[ok]))
            held += len(found[-1])
            if held > 2_000_000 and len(found) > 1:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0]) // 2
        codes = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        found.clear()
        release()
        a, b = codes >> 32, codes & 0xFFFFFFFF
        return pa.table({"a": sets[a], "b": sets[b], "n_a": length[a].astype(np.int32), "n_b": length[b].astype(np.int32)})

    return candidates


def _segments(weights: np.ndarray, parts: int):
    """Cut each set at the pivots of the global order."""
    before = np.cumsum(weights) - weights
    total = max(1, int(weights.sum()))

    def segments(batches):
        for batch in batches:
            out = []
            for h, i, g, cls in zip(*(batch.column(c).to_pylist() for c in ("h", "sig", "grams", "bins")), strict=True):
                g, cls = np.frombuffer(g, np.uint64), np.frombuffer(cls, np.uint8)
                place = (before[cls] + weights[cls] * (g.astype(np.float64) / 2.0**64)) / total
                v = np.minimum((place * parts).astype(np.int64), parts - 1)
                edges = np.searchsorted(v, np.arange(parts + 1))
                out += [(h * parts + k, i, g[edges[k] : edges[k + 1]].tobytes()) for k in range(parts) if edges[k] < edges[k + 1]]
            if out:
                keys, ids, grams = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(grams, pa.binary())], names=["key", "id", "grams"])

    return segments


def _partial(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial overlaps of the candidate pairs in one fragment of the global order."""
    empty = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "overlap": pa.array([], pa.int64())}
    if not left.num_rows or not right.num_rows:
        return pa.table(empty)
    held = left.column("id").to_numpy()
    packs = [np.frombuffer(b, np.uint64) for b in _column(left, "grams")]
    sets = np.unique(held)
    a, b = (np.searchsorted(sets, right.column(c).to_numpy()) for c in ("a", "b"))
    ok = (a < len(sets)) & (b < len(sets))
    ok &= (sets[np.minimum(a, len(sets) - 1)] == right.column("a").to_numpy()) & (sets[np.minimum(b, len(sets) - 1)] == right.column("b").to_numpy())
    a, b = a[ok].astype(np.int64), b[ok].astype(np.int64)
    if not len(a):
        return pa.table(empty)
    wanted = np.unique(a << 32 | b)
    group = components(len(sets), a, b)
    grams = np.concatenate(packs)
    local = np.repeat(np.searchsorted(sets, held), [len(p) for p in packs]).astype(np.int64)
    order = np.lexsort((local, grams, group[local]))
    grams, local = grams[order], local[order]
    g = group[local]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (g[1:] != g[:-1])])
    postings = np.cumsum(new) - 1
    size = np.bincount(postings)
    shared = size[postings] > 1  # what one set has alone gives no overlap
    local, g, postings = local[shared], g[shared], postings[shared]
    codes, counts, held_codes = [], [], 0
    sparse = np.ones(len(local), bool)
    edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
    pair_group = group[wanted >> 32]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        held_by = size[postings[s:e]]
        products = int((held_by - 1).sum()) // 2  # pairs of postings of this group
        if products < DENSE:
            continue
        mine = wanted[pair_group == g[s]]
        rows, row = np.unique(mine >> 32, return_inverse=True)
        cols, col = np.unique(mine & 0xFFFFFFFF, return_inverse=True)
        distinct = int(np.count_nonzero(np.diff(postings[s:e]))) + 1
        if len(rows) * len(cols) * distinct > 1000 * products or len(rows) * len(cols) > 50_000_000:
            continue
        sparse[s:e] = False
        codes.append(mine), counts.append(_products(local[s:e], postings[s:e], rows, cols)[row, col])
        held_codes += len(mine)
    local, postings = local[sparse], postings[sparse]
    for i, j in _posting_pairs(postings):
        c, k = np.unique(local[i] << 32 | local[j], return_counts=True)
        codes.append(c), counts.append(k)
        held_codes += len(c)
        if held_codes > 2_000_000 and len(codes) > 1:
            codes, counts = ([x] for x in _sum(codes, counts))
            held_codes = len(codes[0]) // 2
    if not codes:
        return pa.table(empty)
    code, count = _sum(codes, counts)
    at = np.searchsorted(wanted, code)
    ok = (wanted[np.minimum(at, len(wanted) - 1)] == code) & (count > 0)
    code, count = code[ok], count[ok]
    grams = local = order = g = packs = None
    release()
    return pa.table({"a": sets[code >> 32], "b": sets[code & 0xFFFFFFFF], "overlap": count.astype(np.int64)})


def _products(local: np.ndarray, postings: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Common postings of each of ``rows`` with each of ``cols``, by products of 0/1 matrices over some postings at a time."""
    at = np.cumsum(np.concatenate([[0], np.diff(postings) != 0]))
    total = np.zeros((len(rows), len(cols)), np.float32)  # exact below 2**24
    step = max(64, 8_000_000 // (len(rows) + len(cols)))
    row, col = np.searchsorted(rows, local), np.searchsorted(cols, local)
    is_row = rows[np.minimum(row, len(rows) - 1)] == local
    is_col = cols[np.minimum(col, len(cols) - 1)] == local
    for start in range(0, int(at[-1]) + 1, step):
        s, e = np.searchsorted(at, [start, start + step])
        left, right = np.zeros((len(rows), step), np.float32), np.zeros((len(cols), step), np.float32)
        r, c = is_row[s:e], is_col[s:e]
        left[row[s:e][r], at[s:e][r] - start] = 1
        right[col[s:e][c], at[s:e][c] - start] = 1
        total += left @ right.T
    return total


def _sum(codes, counts):
    c, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(c)).astype(np.int64)


def ngram_sets(docs: DataFrame, n: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that can have a partner: doc_id, sig (of the whole set), n, own, grams (that others have)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lower(F.col(text_col)).cast("binary").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    fragments = max(4, math.ceil(size / 6.5 / FRAGMENT))
    runs = texts.mapInArrow(lambda b: _scatter(_grams_of_texts(b, n), fragments, False), _SCATTERED)
    return written(_bounce(runs, threshold), "ngram_sets")


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, parts: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with partners, by the Jaccard similarity of their sets of word n-grams: ``doc_id, class_id, group_id, n_links``.

    Documents with equal sets form a class, named by its smallest id.  ``n_links`` is the number of other classes whose
    similarity with the document's own is ``threshold`` or more; ``group_id`` is the smallest id that links and copies
    lead to, over any number of steps.  There is one row for each document that has a copy or a link, and none for others,
    so the rows grow with the documents, however many pairs they make.  ``similar_pairs`` gives the pairs.

    A text that is null, empty or without a word has no partners; neither has a row with a null id.  A text of
    fewer than ``n`` words has one n-gram, all its words.  Rows that repeat an id are one document if their
    sets are equal; if not, the id has a row for each of its classes.  Other columns are not read; an empty table gives no rows.
    """
    copies, links, counts, edges = _found(docs, n, threshold, parts, id_col, text_col)
    copies, links = written(copies, "ngram_copies"), written(links, "ngram_links")
    one = F.lit(1).cast("bigint").alias("n_links")
    degree = links.select(F.col("doc_a").alias("class_id"), one).unionAll(links.select("doc_b", one))
    if counts is not None:
        degree = degree.unionAll(counts)
    degree = degree.groupBy("class_id").agg(F.sum("n_links").alias("n_links"))
    heads = copies.select("doc_a").unionAll(degree.select("class_id")).distinct()
    rows = copies.select(F.col("doc_b").alias("doc_id"), F.col("doc_a").alias("class_id")).unionAll(heads.select("doc_a", F.col("doc_a").alias("class_id")))
    together = copies.unionAll(links.select("doc_a", "doc_b"))
    group = groups(together if edges is None else together.unionAll(edges)).select(F.col("member").alias("doc_id"), F.col("head").alias("group_id"))
    rows = rows.join(degree, "class_id", "left").join(group, "doc_id", "left")
    return rows.select("doc_id", "class_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def similar_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, parts: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_a < doc_b, jaccard``: (smallest, other, 1.0) for each further member of a class, and one row for each pair of similar classes, under their smallest ids."""
    copies, links, _, _ = _found(docs, n, threshold, parts, id_col, text_col, True)
    return copies.withColumn("jaccard", F.lit(1.0)).unionAll(links)


def _found(docs: DataFrame, n: int, threshold: float, parts: int, id_col: str, text_col: str, all_pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Membership of classes (``doc_a`` the smallest id, ``doc_b`` another) and links between classes (``doc_a, doc_b, jaccard``).

    Without ``all_pairs``, links within crowds are told by a number for each class (``class_id, n_links``) and a forest (``doc_a, doc_b``); None, if there are no crowds.
    """
    if not 0 < threshold <= 1 or n < 1 or parts < 1:
        raise ValueError("threshold must lie in (0, 1], n and parts must be positive")
    sets = ngram_sets(docs, n, threshold, id_col, text_col)
    classes = sets.groupBy("sig", "n").agg(F.min("doc_id").alias("doc_a"), F.count("*").alias("members"))
    copies = sets.select("sig", "n", F.col("doc_id").alias("doc_b")).join(classes.where("members > 1"), ["sig", "n"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()

    heads = sets.join(classes.select(F.col("doc_a").alias("doc_id"), "sig", "n"), ["doc_id", "sig", "n"], "left_semi").dropDuplicates(["doc_id", "sig", "n"])
    size = sets.agg(F.sum(F.length("grams") / 8)).first()[0] or 0
    fragments = max(4, math.ceil(size / FRAGMENT))
    runs = heads.select("sig", "n", "grams").mapInArrow(lambda b: _scatter(((i, s, c, mix64(g)) for i, s, c, g in _grams_of_sets(b)), fragments, True), _SCATTERED)
    live = written(_bounce(runs, threshold).drop("sig").withColumnRenamed("doc_id", "sig"), "ngram_live")

    names = classes.groupBy("sig").agg(F.min("doc_a").alias("doc"))
    crowds = _crowds(live, threshold)
    found = live.select("sig", "n", "own", "grams")
    found = found.withColumn("crowd", F.lit(None).cast("bigint")) if crowds is None else found.join(_sent(crowds), "sig", "left")
    found = found.mapInArrow(_prefix(threshold, fragments), "part int, ids binary, n binary, pos binary, grams binary, crowds binary")
    found = found.groupBy("part").applyInArrow(_candidates(threshold), "a bigint, b bigint, n_a int, n_b int").distinct()
    found = written(found, "ngram_candidates")

    weights = np.zeros(256, np.int64)
    for row in live.select("bins").mapInArrow(_class_weights, "bin int, held bigint").groupBy("bin").agg(F.sum("held").alias("held")).collect():  # 256 classes at most
        weights[row.bin] = row.held
    buckets = max(1, math.ceil(int(weights.sum()) / (parts * FRAGMENT)))
    smallest = found.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("home"))
    pairs = found.join(smallest, "a", "left").withColumn("h", F.pmod(F.xxhash64(F.coalesce("home", "a")), F.lit(buckets))).drop("home")
    # Where a large group has very many pairs, they are dealt by their first member to several tasks.
    deals = pairs.groupBy("h").agg(F.ceil(F.count("*") / PAIRS).alias("deals"))
    pairs = pairs.join(deals, "h").withColumn("h", F.pmod(F.xxhash64("h", F.pmod(F.xxhash64("a"), "deals")), F.lit(1 << 40))).drop("deals")
    pairs = written(pairs, "ngram_pairs")
    needed = pairs.select(F.col("a").alias("sig"), "h").union(pairs.select("b", "h")).distinct()
    segments = live.select("sig", "grams", "bins").join(needed, "sig").mapInArrow(_segments(weights, parts), "key bigint, id bigint, grams binary")
    asked = pairs.select("a", "b", F.explode(F.sequence(F.col("h") * parts, F.col("h") * parts + parts - 1)).alias("key"))
    partial = segments.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(_partial, "a bigint, b bigint, overlap bigint")
    overlaps = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    similar = overlaps.join(pairs, ["a", "b"]).withColumn("jaccard", F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap")))
    similar, counts, edges = similar.where(F.col("jaccard") >= threshold - _EPS).select("a", "b", "jaccard"), None, None
    if crowds is not None:
        shared = names.join(names.groupBy("doc").count().where("count > 1"), "doc", "left_semi").select("sig")  # an id that heads several classes counts once
        within = _crowd_links(live, crowds, shared, threshold, all_pairs)
        similar = similar.unionAll(within.where(F.col("kind") == _PAIR).select("a", "b", "jaccard"))
        of_a, of_b = names.select(F.col("sig").alias("a"), F.col("doc").alias("of_a")), names.select(F.col("sig").alias("b"), F.col("doc").alias("of_b"))
        counts = within.where(F.col("kind") == _COUNT).groupBy("a").agg(F.sum("n_links").alias("n_links")).join(of_a, "a").select(F.col("of_a").alias("class_id"), "n_links")
        edges = within.where(F.col("kind") == _EDGE).select("a", "b").distinct().join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("doc_a"), F.col("of_b").alias("doc_b"))
    similar = similar.join(names.select(F.col("sig").alias("a"), F.col("doc").alias("of_a")), "a").join(names.select(F.col("sig").alias("b"), F.col("doc").alias("of_b")), "b")
    similar = similar.where("of_a != of_b").groupBy(F.least("of_a", "of_b").alias("doc_a"), F.greatest("of_a", "of_b").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))
    return copies, similar, counts, edges


def _class_weights(batches):
    total = np.zeros(256, np.int64)
    for batch in batches:
        for b in batch.column("bins").to_pylist():
            total += np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bin", "held"])


def oracle_sql(table: str = "documents", n: int = 3, threshold: float = 0.5) -> str:
    """DuckDB SQL for ngram_jaccard_join, by counting common n-grams of every pair."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table} WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}))) END AS grams
  FROM words WHERE len(w) > 0),
classes AS MATERIALIZED (SELECT row_number() OVER () AS k, grams, min(doc_id) AS head, len(grams) AS n FROM sets GROUP BY grams),
copies AS (SELECT DISTINCT head AS a, doc_id AS b FROM sets JOIN classes USING (grams) WHERE head < doc_id),
postings AS MATERIALIZED (SELECT k, head, n, hash(gram) AS gram FROM (SELECT k, head, n, unnest(grams) AS gram FROM classes)),
counts AS (
  SELECT any_value(a.head) AS a, any_value(b.head) AS b, count(*) AS c, any_value(a.n + b.n) AS total
  FROM postings a JOIN postings b ON a.gram = b.gram AND a.head < b.head GROUP BY a.k, b.k),
links AS (SELECT DISTINCT a, b FROM counts WHERE c::DOUBLE / (total - c) >= {threshold} - 1e-9),
degree AS (SELECT class_id, count(*) AS n_links FROM (SELECT a AS class_id FROM links UNION ALL SELECT b FROM links) GROUP BY 1),
edges AS (SELECT a, b FROM copies UNION SELECT a, b FROM links UNION SELECT b, a FROM copies UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
found AS (SELECT b AS doc_id, a AS class_id FROM copies UNION ALL SELECT DISTINCT h, h FROM (SELECT a AS h FROM copies UNION ALL SELECT class_id FROM degree))
SELECT doc_id, class_id, (SELECT min(root) FROM reach WHERE node = doc_id) AS group_id, coalesce(n_links, 0)::BIGINT AS n_links FROM found LEFT JOIN degree USING (class_id)"""
