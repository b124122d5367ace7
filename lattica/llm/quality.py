"""Quality rules whose cutoffs carry a bound on false rejections.

Each rule is a whole number measured on a text; a document is rejected where one reaches its stratum's cutoff.
Labelled good documents are the holdout, of which each distinct text of a stratum counts once, however often it
comes.  In each stratum and for each rule, cutoffs are tested from the most lenient down: the exact binomial p-value of
"this cutoff rejects more than alpha of the good documents" must stay below delta, divided by the number of sequences
tested (Bonferroni); the sequence ends at its first failure (fixed-sequence testing, so no further correction within
it).  alpha is shared equally among the rules, hence with probability 1 - delta no stratum loses more than alpha of its
good texts.  Of the certified cutoffs the one that separates the labelled documents best is taken; without one, the
rule rejects nothing there.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .ngrams import _BYTE, _powers, chunks, mix64
from .shared import fresh, release, written

RULES = ("marks", "capitals", "repeats", "strange")
GRID = (20, 40, 60, 80, 100, 150, 200, 250, 300, 400, 500, 700, 1000, 1500, 2000)
ALPHA, DELTA = 0.05, 0.05
#: A good document lost weighs as much as so many bad ones caught, when a certified cutoff is chosen.
COST = 10
SMALL = 100_000
#: Labelled ids that are sent to each task, so that only labelled texts are measured for the cutoffs.
LABELS = 500_000
LONG_WORD, FEW_WORDS, LONG_TEXT = 20, 20, 1_000_000
_MARKS = "#$%&*|!"
#: Function words of the languages that are known; a text without any is strange in a stratum whose good texts have them.
STOP_WORDS = tuple("the and of to a in is that it was for with on der die das und ist nicht ein eine von zu mit le la les de des et un une est dans pour que el los las y en por con no es".split())
_BLANK = np.isin(np.arange(256), list(b"\t\n\f\r "))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IS_MARK, _IS_CAPITAL = np.isin(np.arange(256), list(_MARKS.encode())), (np.arange(256) >= 65) & (np.arange(256) <= 90)
_IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_BEGINS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


def _words(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each word between white space: start, hash of its lower-case (A-Z) form, characters, whether it has a letter, line feeds before it."""
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers(max(1, len(data)))

    def sums(x, kind):
        total = np.zeros(len(data) + 1, kind)
        np.cumsum(x, dtype=kind, out=total[1:])
        return total

    hashes = sums(_BYTE[_LOWER[data]] * power[: len(data)], np.uint64)
    chars, letters, feeds = sums(_BEGINS[data], np.int64), sums(_IS_LETTER[data], np.int64), sums(data == 10, np.int64)
    return start, mix64((hashes[end] - hashes[start]) * inverse[start]), chars[end] - chars[start], letters[end] > letters[start], feeds[start]


_STOPS = np.sort(_words(np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8))[1])


def _repeated(group: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n groups, its values and how many of them equal an earlier one."""
    _, first = np.unique(mix64(values + mix64(group.astype(np.uint64))), return_index=True)
    total = np.bincount(group, minlength=n)
    return total, total - np.bincount(group[first], minlength=n)


def _rules(doc, words, n: int, marks, capitals, chars) -> np.ndarray:
    """Rule values of n documents, one row each, from their words in order (``doc`` is the document of each)."""
    _, hashes, length, letter, line = words
    per = lambda x, of: 1000 * x // np.maximum(of, 1)
    count = np.bincount(doc, minlength=n)
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])) + 1
    repeats = per(np.bincount(doc[same], minlength=n), count)
    third = np.flatnonzero(doc[2:] == doc[:-2])
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    total, again = _repeated(doc[third], mix64(hashes[third] + a) + mix64(hashes[third + 1] + b) * np.uint64(3) + hashes[third + 2] * np.uint64(7), n)
    repeats = np.maximum(repeats, per(again, total))
    if len(doc):
        begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]))
        place = np.arange(len(doc)) - np.repeat(begins, np.diff(np.append(begins, len(doc))))
        lines = np.add.reduceat(mix64(hashes + mix64(place.astype(np.uint64) + a)), begins)
        total, again = _repeated(doc[begins], lines, n)
        repeats = np.maximum(repeats, per(again, total))
    of = lambda mask: np.bincount(doc[mask], minlength=n)
    known = per(of(_STOPS[np.minimum(np.searchsorted(_STOPS, hashes), len(_STOPS) - 1)] == hashes), count)
    bare = np.where(count >= FEW_WORDS, np.maximum(0, 1000 - 10 * known), 0)
    strange = np.maximum(bare, np.maximum(per(of(length > LONG_WORD), count), per(of(~letter), count)))
    return np.stack([per(marks, count), per(capitals, chars), repeats, strange], 1).astype(np.int32)


def rule_values(texts: list[bytes | None]) -> np.ndarray:
    """A row of rule values for each text; all zero for one that is null or empty.

    * ``marks``: the marks # $ % & * | ! per 1000 words (between white space);
    * ``capitals``: A-Z per 1000 characters;
    * ``repeats``: the largest of the words that equal the one before, per 1000 words, the lines that equal an earlier
      one, per 1000 lines with a word, and the three-word runs that equal an earlier one, per 1000 such runs; lines
      and runs are compared word by word, and A-Z like a-z;
    * ``strange``: the largest of the words of over 20 characters and the words without a letter, each per 1000 words,
      and, from 20 words on, 1000 less ten times the function words per 1000 words (0 at least).
    """
    out = np.zeros((len(texts), len(RULES)), np.int32)
    short = ((k, t) for k, t in enumerate(texts) if t and len(t) <= LONG_TEXT)
    for ids, data, bounds in chunks(short, 1_000_000):
        words = _words(data)
        n = len(ids)
        sums = [np.add.reduceat(mask[data].astype(np.int64), bounds[:-1]) for mask in (_IS_MARK, _IS_CAPITAL, _BEGINS)]
        out[ids] = _rules(np.searchsorted(bounds, words[0], side="right") - 1, words, n, sums[0], sums[1], sums[2] - 1)  # but for the byte that ends each
    for k, t in enumerate(texts):
        if t and len(t) > LONG_TEXT:
            parts, sums, feeds = [], np.zeros(3, np.int64), 0
            for part in _parts(t):
                data = np.frombuffer(part, np.uint8)
                start, hashes, length, letter, line = _words(data)
                parts.append((start, hashes, length, letter, line + feeds))
                feeds += int(np.count_nonzero(data == 10))
                sums += [np.count_nonzero(mask[data]) for mask in (_IS_MARK, _IS_CAPITAL, _BEGINS)]
            words = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            out[k] = _rules(np.zeros(len(words[0]), np.int64), words, 1, *(np.array([x]) for x in sums))[0]
    return out


def _parts(text: bytes):
    """A long text cut at white space; a word is never cut."""
    at = 0
    while at < len(text):
        end = min(at + LONG_TEXT, len(text))
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def measured(docs: DataFrame, text_col: str, names: list[str], digest: str | None = None, drop_text: bool = False) -> DataFrame:
    """``docs`` with the rule values as columns ``names`` and, if asked for, a digest of the text."""
    fields = [f for f in docs.schema.fields if not drop_text or f.name != text_col]
    schema = StructType([*fields, *[StructField(x, IntegerType()) for x in names], *([StructField(digest, BinaryType())] if digest else [])])

    def measure(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            values = rule_values(texts)
            if drop_text:
                batch = batch.remove_column(at)
            for k, name in enumerate(names):
                batch = batch.append_column(name, pa.array(values[:, k], pa.int32()))
            if digest:
                batch = batch.append_column(digest, pa.array([hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts], pa.binary()))
            yield batch
        release()

    return docs.mapInArrow(measure, schema)


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    if k >= n:
        return 1.0
    terms = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
    return min(1.0, math.fsum(map(math.exp, terms)))


def choose_cutoff(good: list[int], bad: list[int], n_good: int, n_bad: int, alpha: float, level: float, grid=GRID) -> int | None:
    """The cutoff for counts of good and bad documents that each value of ``grid`` rejects; None if none is certified."""
    best, chosen = 0.0, None
    for k in range(len(grid) - 1, -1, -1):
        if n_good == 0 or tail(good[k], n_good, alpha) > level:
            break
        gain = bad[k] / max(n_bad, 1) - COST * good[k] / n_good
        if gain > best:
            best, chosen = gain, grid[k]
    return chosen


def _narrow(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))


def _truth(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg((F.max("quality") >= 1).cast("int").alias("good"))


def cutoffs(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``stratum`` and a cutoff for each rule, null where nothing is certified; from every labelled document."""
    rows, truth = _narrow(docs, id_col, text_col, stratum_col), written(_truth(labels, id_col), "quality_truth")
    if truth.count() <= LABELS:  # only labelled texts are measured; else all, as texts aren't shuffled
        rows = measured(rows.join(F.broadcast(truth), "id"), "text", list(RULES), "digest", True)
    else:
        rows = measured(rows, "text", list(RULES), "digest", True).join(truth, "id")
    return _certified(rows, alpha, delta)


def _certified(rows: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Cutoffs from ``stratum, good, digest`` and the rule values of labelled documents; equal texts of a stratum have one vote, the best."""
    votes = rows.groupBy("stratum", "digest").agg(F.max("good").alias("good"), *[F.first(k).alias(k) for k in RULES])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("value")) for k in RULES]))
    level = sum((F.col("p.value") >= c).cast("int") for c in GRID)
    counts = votes.select("stratum", "good", pairs.alias("p")).groupBy("stratum", "good", F.col("p.rule").alias("rule"), level.alias("level")).agg(F.count("*").alias("n"))
    counts = written(counts, "quality_counts")  # a few rows, used twice
    strata = counts.agg(F.countDistinct("stratum").alias("strata"))

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for rule in RULES:
            mine = pdf[pdf.rule == rule]
            reach = {g: [int(mine.n[(mine.good == g) & (mine.level > k)].sum()) for k in range(len(GRID))] for g in (0, 1)}
            total = {g: int(mine.n[mine.good == g].sum()) for g in (0, 1)}
            out[rule] = choose_cutoff(reach[1], reach[0], total[1], total[0], alpha / len(RULES), delta / (len(RULES) * int(pdf.strata.iloc[0])))
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], **{k: pd.array([v], dtype="Int32") for k, v in out.items()}})

    return counts.crossJoin(F.broadcast(strata)).groupBy("stratum").applyInPandas(certify, "stratum string, " + ", ".join(f"{k} int" for k in RULES))


def _kept(rows: DataFrame, cuts: DataFrame, stratum: str, values: list[str]) -> DataFrame:
    """The rows whose values reach no cutoff of their stratum."""
    names = fresh(rows.columns, "cut_stratum", *[f"cut_{k}" for k in RULES])
    cuts = written(cuts.toDF(*names), "quality_cuts")  # one small row a stratum: the texts are not shuffled to meet it
    cuts = F.broadcast(cuts) if cuts.count() <= SMALL else cuts
    rejected = F.lit(False)
    for value, cut in zip(values, names[1:], strict=True):
        rejected = rejected | F.coalesce(F.col(value) >= F.col(cut), F.lit(False))
    return rows.join(cuts, F.col(stratum) == F.col(names[0]), "left").where(~rejected)


def quality_scores(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that the rules keep: ``doc_id, stratum`` and the value of each rule.  Each text is measured once.  See quality_filter."""
    rows = written(measured(_narrow(docs, id_col, text_col, stratum_col), "text", list(RULES), "digest", True), "quality_measured")
    cuts = _certified(rows.join(_truth(labels, id_col), "id"), alpha, delta)
    return _kept(rows, cuts, "stratum", list(RULES)).select(F.col("id").alias("doc_id"), "stratum", *RULES)


def quality_filter(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that no certified rule rejects, with their own columns.

    ``labels`` has the id and ``quality`` (1 good, 0 bad); of several labels of one document, and of equal texts of a
    stratum, the best counts; null labels and labels of unknown documents are ignored.  A stratum without enough
    labelled texts to certify a cutoff loses nothing; so do empty labels.  A null stratum counts as the empty string.
    A null or empty text has zero of everything and is kept.  Repeated rows and null ids are judged like others; other
    columns pass through, whatever their names.  An empty table gives no rows.
    """
    cuts = cutoffs(docs, labels, alpha, delta, id_col, text_col, stratum_col)
    stratum, *names = fresh(docs.columns, "stratum", *RULES)
    rows = measured(docs, text_col, names).withColumn(stratum, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")))
    return _kept(rows, cuts, stratum, names).select(*docs.columns)


def oracle_sql(documents: str = "documents", labels: str = "labels", columns: str = "doc_id, stratum, marks, capitals, repeats, strange", alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB SQL for quality_scores (or, with other ``columns`` of documents, for quality_filter)."""
    rules, a = ", ".join(RULES), alpha / len(RULES)
    return f"""
WITH split AS MATERIALIZED (
  SELECT *, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM {documents}),
cut AS MATERIALIZED (
  SELECT *, regexp_extract_all(low, '[^\\t\\n\\f\\r ]+') AS w,
    list_filter(list_transform(string_split(low, chr(10)), lambda l: trim(regexp_replace(l, '[\\t\\f\\r ]+', ' ', 'g'))), lambda l: l <> '') AS l FROM split),
counted AS MATERIALIZED (
  SELECT * EXCLUDE (low), greatest(len(w), 1) AS n, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM cut),
measured AS MATERIALIZED (
  SELECT * EXCLUDE (w, l, g, n),
    (1000 * (length(t) - length(translate(t, '{_MARKS}', ''))) // n)::INT AS marks,
    (1000 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) // greatest(length(t), 1))::INT AS capitals,
    greatest(1000 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) // n, 1000 * (len(l) - len(list_distinct(l))) // greatest(len(l), 1), 1000 * (len(g) - len(list_distinct(g))) // greatest(len(g), 1))::INT AS repeats,
    greatest(1000 * len(list_filter(w, lambda x: length(x) > {LONG_WORD})) // n, 1000 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[a-z\\x{{80}}-\\x{{10FFFF}}]'))) // n,
      CASE WHEN len(w) >= {FEW_WORDS} THEN 1000 - 10 * (1000 * len(list_filter(w, lambda x: x IN {STOP_WORDS})) // n) ELSE 0 END, 0)::INT AS strange FROM counted),
truth AS (SELECT doc_id, max(quality) >= 1 AS good FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
votes AS (SELECT stratum, max(good) AS good, {", ".join(f"any_value({r}) AS {r}" for r in RULES)} FROM measured JOIN truth USING (doc_id) GROUP BY stratum, t),
held AS (UNPIVOT (SELECT stratum, good, {rules} FROM votes) ON {rules} INTO NAME rule VALUE value),
grid AS (SELECT unnest({list(GRID)}) AS cutoff),
reach AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
    count(*) FILTER (good AND value >= cutoff) AS k, count(*) FILTER (NOT good AND value >= cutoff) AS caught
  FROM held, grid GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN n_good = 0 OR k >= n_good THEN 1.0 ELSE
    list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n_good + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n_good - i + 1) + i * ln({a}) + (n_good - i) * ln(1 - {a})))) END AS p FROM reach),
passed AS (
  SELECT *, max(CASE WHEN p > {delta} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM held)) THEN cutoff ELSE 0 END) OVER (PARTITION BY stratum, rule) AS failed FROM tested),
chosen AS (
  SELECT stratum, rule, arg_max(cutoff, (caught / greatest(n_bad, 1) - {COST} * k / n_good, cutoff)) AS cutoff
  FROM passed WHERE cutoff > failed AND caught / greatest(n_bad, 1) - {COST} * k / n_good > 0 GROUP BY 1, 2),
cuts AS (SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM chosen GROUP BY 1)
SELECT {columns} FROM measured LEFT JOIN cuts USING (stratum)
WHERE NOT ({" OR ".join(f"coalesce({r} >= cut_{r}, false)" for r in RULES)})"""
