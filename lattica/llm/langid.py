"""Language identification by Bayesian fusion of what a text, its markup and its address say.

log P(language | page) is the sum of
* the text: naive Bayes over hashed byte trigrams, counted over every labelled document;
* the declared markup language: how often pages of a language declare it;
* the address suffix: how often pages of a language have it, with pseudo-counts for country suffixes;
* a prior for the host, smoothed towards its domain's, which is smoothed towards that of all pages.
The last three come from grouped sums of the texts' own posteriors; what a page itself gave to a group is
taken out before it is judged by it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BUCKETS = 1 << 16
#: A text's log-likelihood ratio counts a third, as three trigrams share each byte.  What it gives to its host's, suffix's and
#: declaration's sums is floored at so much; the text's own judgement isn't, so that enough text outweighs groups of any size.
SHARE, LIMIT = 1 / 3, 20.0
KAPPA = 5.0
DECLARED_COUNT, DECLARED_RIGHT = 20.0, 0.8
SUFFIX_COUNT, SUFFIX_BOOST = 20.0, 10.0
#: Country suffixes and their languages; others speak for no language beforehand.
SUFFIXES = {
    "de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "ve": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en",
    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "cz": "cs", "se": "sv", "dk": "da", "fi": "fi", "jp": "ja", "cn": "zh", "kr": "ko", "tr": "tr", "gr": "el", "hu": "hu",
}

_DROP = re.compile(rb"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>|<[^>]*>|&#?\w{1,12};")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})(?![a-z])""")
_META = re.compile(r"""(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?([a-z]{2,3})(?![a-z])""")


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each three bytes; two fewer than there are bytes."""
    x = data.astype(np.uint32)
    return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def _runs(texts, limit: int = 1_000_000):
    """Runs of texts as (bytes, where each begins and ends); a long text comes in parts that share two bytes."""
    held, size, at = [], 0, []
    for k, t in enumerate(texts):
        t = b" " + (t or b"") + b" "
        for s in range(0, max(1, len(t) - 2), limit):
            part = t[s : s + limit + 2]
            held.append(part)
            at.append(k)
            size += len(part)
            if size >= limit:
                yield at, _packed(held)
                held, size, at = [], 0, []
    if held:
        yield at, _packed(held)


def _packed(parts):
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, and log P(trigram | language) for each, from every labelled document."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, (data, start, _) in _runs(t for x, t in zip(langs, texts, strict=True) if x == lang):
                    h = trigrams(data)
                    counts += np.bincount(h, minlength=BUCKETS)
                    cut = np.concatenate([start[1:] - 2, start[1:] - 1])  # these span two texts
                    counts -= np.bincount(h[cut], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "counts": pa.array([c.tobytes() for c in total.values()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for b in table.column("counts").to_pylist():
            total += np.frombuffer(b, np.int64)
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    labelled = docs.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0)).select(F.lower(F.col(lang_col).cast("string")).alias("lang"), F.lower(F.col(text_col)).cast("binary").alias("text"))
    parts = labelled.mapInArrow(count, "lang string, counts binary").groupBy("lang", F.pmod(F.xxhash64("counts"), F.lit(16))).applyInArrow(add, "lang string, counts binary")
    rows = sorted(parts.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect())  # one row a language
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in rows], np.float64).reshape(len(rows), BUCKETS)
    return [r.lang for r in rows], np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


def visible(html: str) -> bytes:
    return b" ".join(_DROP.sub(b" ", html.lower().encode()).split())


def declared(html: str) -> str | None:
    found = _LANG.search(html) or _META.search(html)
    return found[1].lower() if found else None


def text_evidence(texts: list[bytes | None], table: np.ndarray, limit: float = LIMIT) -> np.ndarray:
    """For each text and language the tempered log-likelihood, 0 for the likeliest and ``-limit`` at least."""
    scores = np.zeros((len(texts), len(table)))
    for at, (data, start, end) in _runs(texts):
        h = trigrams(data)
        good = end - start > 2
        if not good.any():
            continue
        at, start, end = np.array(at)[good], start[good], end[good]
        where = np.stack([start, np.minimum(end - 2, len(h) - 1)], 1).ravel()
        last = end[-1] - 2
        for k, row in enumerate(table):
            values = row[h]
            sums = np.add.reduceat(values, where, dtype=np.float64)[::2]
            if last == len(h) and where[-1] == last - 1:  # the run's last text ends with the array
                sums[-1] += values[-1]
            np.add.at(scores[:, k], at, sums)
    scores *= SHARE
    scores -= scores.max(axis=1, keepdims=True, initial=-np.inf)
    return np.maximum(scores, -limit)


def _posterior(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores)
    return p / p.sum(axis=1, keepdims=True)


def _floats(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: len(x) + 1], pa.int32()), flat)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def _evidence(rows: DataFrame, model, is_html: bool) -> DataFrame:
    """``id, host, declared, text``, the last the text's evidence for each language; ``body`` is read and dropped."""

    def score(batches):
        langs, table = model.value
        for batch in batches:
            ids, hosts, bodies = (batch.column(k) for k in range(3))
            bodies = bodies.to_pylist()
            said = [declared(b) if b else None for b in bodies] if is_html else [None] * len(bodies)
            texts = [visible(b) if b else None for b in bodies] if is_html else bodies
            yield pa.RecordBatch.from_arrays([ids, hosts, pa.array(said, pa.string()), _floats(text_evidence(texts, table, np.inf))], names=["id", "host", "declared", "text"])

    return rows.mapInArrow(score, "id bigint, host string, declared string, text array<double>")


def _group(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("p")[k]) for k in range(n)]).alias(name))


def fuse(found: DataFrame, langs: list[str]) -> DataFrame:
    """``id, lang, confidence, text_lang, declared, suffix`` from the evidence of rows of one kind."""
    n = len(langs)
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract("host", r"\.([a-z][a-z0-9-]*)$", 1)
    p = F.transform("text", lambda x: F.exp(F.greatest(x, F.lit(-LIMIT))))
    rows = found.withColumns({"p": p}).withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)))
    rows = rows.withColumns({"domain": F.when(domain != "", domain).otherwise(F.col("host")), "suffix": F.when(suffix != "", suffix)})
    whole = rows.agg(F.array(*[F.sum(F.col("p")[k]) for k in range(n)]).alias("whole")).first()[0]
    whole = np.array([x or 0.0 for x in whole])
    by_host = rows.where("host IS NOT NULL").groupBy("host", "domain", "suffix").agg(F.array(*[F.sum(F.col("p")[k]) for k in range(n)]).alias("of_host"))
    by_host = written(by_host, "langid_hosts")  # of which the domains' and suffixes' sums are made, without another pass over the pages
    sums = by_host.withColumnRenamed("of_host", "p")
    hosts = by_host.join(_group(sums, "domain", n, "of_domain"), "domain", "left").join(_group(sums, "suffix", n, "of_suffix"), "suffix", "left").select("host", "of_host", "of_domain", "of_suffix")
    rows = rows.join(hosts, "host", "left").join(_group(rows, "declared", n, "of_declared"), "declared", "left")
    everywhere = whole / max(whole.sum(), 1e-300) if whole.sum() else np.full(n, 1 / max(n, 1))

    def judge(batches):
        index = {lang: k for k, lang in enumerate(langs)}

        def matrix(column):
            out = np.zeros((len(column), n))
            for k, x in enumerate(column.to_pylist()):
                if x is not None:
                    out[k] = x
            return out

        for batch in batches:
            get = batch.column
            names = batch.schema.names
            text, p, host, dom, suf, dec = (matrix(get(names.index(c))) for c in ("text", "p", "of_host", "of_domain", "of_suffix", "of_declared"))
            said, ends, placed = (get(names.index(c)).to_pylist() for c in ("declared", "suffix", "host"))
            own = p * np.array([x is not None for x in placed])[:, None]

            def smooth(counts, parent):
                left = np.maximum(counts - own, 0.0)
                return (left + KAPPA * parent) / (left.sum(axis=1, keepdims=True) + KAPPA)

            prior = smooth(host, smooth(dom, np.maximum(everywhere, 1e-6)[None, :]))
            score = text + np.log(prior)
            per = np.maximum(whole, 0.0)[None, :]
            at = np.array([index.get(x, -1) for x in said])
            has = np.array([x is not None for x in said])
            left = np.maximum(dec - p * has[:, None], 0.0)
            base = np.where(at[:, None] == np.arange(n)[None, :], DECLARED_RIGHT, (1 - DECLARED_RIGHT) / max(n - 1, 1))
            base[at < 0] = 1.0 / max(n, 1)
            score += np.where(has[:, None], np.log((left + DECLARED_COUNT * base) / (per + DECLARED_COUNT)), 0.0)
            of = np.array([index.get(SUFFIXES.get(x, ""), -1) for x in ends])
            has = np.array([x is not None for x in ends])
            left = np.maximum(suf - p * has[:, None], 0.0)
            base = np.where(of[:, None] == np.arange(n)[None, :], SUFFIX_BOOST, 1.0) / (SUFFIX_BOOST + n)
            score += np.where(has[:, None], np.log((left + SUFFIX_COUNT * base) / (per + SUFFIX_COUNT)), 0.0)
            score -= score.max(axis=1, keepdims=True)
            post = _posterior(score)
            best, alone = post.argmax(axis=1), text.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [get(names.index("id")), pa.array([langs[k] for k in best], pa.string()), pa.array(np.round(post.max(axis=1), 6)), pa.array([langs[k] if text[i].any() else None for i, k in enumerate(alone)], pa.string()), get(names.index("declared")), get(names.index("suffix"))],
                names=["id", "lang", "confidence", "text_lang", "declared", "suffix"],
            )

    return rows.select("id", "host", "declared", "suffix", "text", "p", "of_host", "of_domain", "of_suffix", "of_declared").mapInArrow(judge, "id bigint, lang string, confidence double, text_lang string, declared string, suffix string")


def language_id(docs: DataFrame, pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The language of every document and page: ``doc_id, page_id, lang, confidence, text_lang, declared, suffix``.

    One row for each row of ``docs`` (``doc_id, text, source``; the source counts as the host) and of ``pages``
    (``page_id, url, html``), with the other's id null.  The text model learns from all of ``labelled`` (``text,
    lang``), by default ``docs``.  ``text_lang`` is what the text alone says, null without a text or where all
    languages are as likely.  A null or empty text, a page without a usable URL or declaration leave the decision
    to the rest; of equal posteriors the language first in order wins.  Repeated rows and null ids are judged like others;
    further columns are not read, so none can clash.  Without a labelled document ``lang`` and ``confidence`` are
    null; empty tables give no rows.
    """
    spark = docs.sparkSession
    langs, table = train(docs if labelled is None else labelled)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("source").cast("string").alias("host"), F.lower(F.col("text")).cast("binary").alias("body"))
    webs = pages.select(F.col("page_id").cast("bigint").alias("id"), host_of(F.col("url")).alias("host"), F.col("html").alias("body"))
    out = []
    for name, rows in (("doc_id", texts), ("page_id", webs)):
        if langs:
            model = spark.sparkContext.broadcast((langs, table))  # 256 KB a language
            judged = fuse(written(_evidence(rows, model, name == "page_id"), "langid_evidence"), langs)
        else:
            judged = rows.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"))])
        ids = {c: F.col("id") if c == name else F.lit(None).cast("bigint") for c in ("doc_id", "page_id")}
        out.append(judged.select(*[v.alias(k) for k, v in ids.items()], "lang", "confidence", "text_lang", "declared", "suffix"))
    return out[0].unionByName(out[1])
