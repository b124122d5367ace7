"""Secret scans of versioned files, with a ledger of what has been scanned.

Every version of every file is addressed by the SHA-256 of its content (its blob).  The ledger, a table in the
shared folder, says which rule versions have seen which blob.  A run scans the pairs of blob and rule version that
the ledger doesn't have, each once however many paths share the blob, and appends findings first and ledger
entries second: a run that is lost in between is repeated, not skipped.  Findings are joined back to all paths.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

SMALL = 10_000
LEDGER = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, rule_version int, start int, end int, redacted string, secret_hash string"


@dataclass(frozen=True)
class Rule:
    """A pattern whose group 1, or else the whole match, is the secret; ``words`` are what a match must contain."""

    name: str
    version: int
    pattern: str
    words: tuple[str, ...]
    entropy: float = 0.0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: No rule limits a secret's length.  Names before a secret are limited (a scheme to 40 characters, the parts of a variable's
#: name to 20 each), so that time grows with the text.
RULES = (
    Rule("aws_access_key", 1, r"(?<![A-Z0-9])((?:AKIA|ASIA|ABIA|ACCA)[A-Z2-7][A-Z0-9]{15})(?![A-Z0-9])", ("AKIA", "ASIA", "ABIA", "ACCA")),
    Rule("github_token", 2, r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+)(?![A-Za-z0-9_])", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Rule("slack_token", 2, r"(?<![A-Za-z0-9])(xox[abeoprs]-[A-Za-z0-9-]{10,}+)", ("xox",)),
    Rule("google_api_key", 1, r"(?<![A-Za-z0-9_-])(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])", ("AIza",)),
    Rule("payment_key", 2, r"(?<![A-Za-z0-9_])((?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}+)", ("sk_live_", "rk_live_", "sk_test_", "rk_test_")),
    Rule("json_web_token", 2, r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", ("eyJ",)),
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY(?: BLOCK)?-----((?:[A-Za-z0-9+/=\s:,.]|-(?!----)){16,}+)-----END", ("PRIVATE KEY",)),
    Rule("url_password", 2, r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,39}://[^\s:/@]++:([^\s:/@]{3,}+)@", ("://",)),
    Rule("assigned_secret", 2, r"(?i)(?<![a-z0-9])(?:[a-z0-9]{1,20}[_-]){0,4}(?:api[_-]?key|secret|token|passw(?:or)?d|passwd|pwd|auth|credential)s?(?:[_-][a-z0-9]{1,20}){0,3}[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?([A-Za-z0-9_+/=.~!@#$%^&*-]{12,}+)", ("key", "secret", "token", "passw", "pwd", "auth", "credential"), 2.8),
)


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


class _Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), "i" if r.pattern.startswith("(?i)") else "") for r in rules]

    def __call__(self, text: str, wanted: set[str]):
        """(rule, start, end, secret) of every finding of the wanted rules."""
        lower = None
        for rule, pattern, blind in self.rules:
            if rule.key not in wanted:
                continue
            if blind and lower is None:
                lower = text.lower()
            if not any(w in (lower if blind else text) for w in rule.words):
                continue
            for m in pattern.finditer(text):
                k = 1 if m.re.groups and m[1] is not None else 0
                if not rule.entropy or entropy(m[k]) >= rule.entropy:
                    yield rule, m.start(k), m.end(k), m[k]


def redact(secret: str) -> str:
    return secret[:4] + "*" * min(8, max(0, len(secret) - 4))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> int:
    """Scan what ``ledger`` hasn't seen; returns how many blobs had something to scan.

    A null path is a path like any other.  A null text is no version of anything and isn't scanned; an empty text
    is a blob without findings.
    """
    spark = versions.sparkSession
    keys = sorted(r.key for r in rules)
    rows = versions.where(F.col(text_col).isNotNull()).select(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("blob"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    seen = _read(spark, f"{ledger}/ledger", LEDGER).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    # One path stands for each blob, so copies stay where they are and only texts to scan are moved.
    first = rows.groupBy("blob").agg(F.min(F.struct("path")).alias("first"))
    todo = first.join(seen, "blob", "left").select("blob", F.col("first.path").alias("first"), F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))).alias("wanted")).where("size(wanted) > 0")
    todo = written(todo, "secrets_todo")
    n = todo.count()
    if not n:
        return 0
    chosen = F.broadcast(todo) if n <= SMALL else todo.hint("shuffle_hash")
    texts = rows.alias("v").join(chosen.alias("t"), (F.col("v.blob") == F.col("t.blob")) & F.col("v.path").eqNullSafe(F.col("t.first"))).select("v.blob", "text", "wanted")

    schema = pa.schema([("blob", pa.binary()), ("rule", pa.string()), ("rule_version", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("redacted", pa.string()), ("secret_hash", pa.string())])

    def scan(batches):
        scanner, done = _Scanner(rules), set()  # a path that repeats a blob comes again, at the same place
        for batch in batches:
            out = []
            for blob, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if blob in done:
                    continue
                done.add(blob)
                out += [(blob, r.name, r.version, s, e, redact(x), hashlib.sha256(x.encode()).hexdigest()) for r, s, e, x in scanner(text, set(wanted))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    texts.mapInArrow(scan, FINDINGS).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.col("wanted").alias("rules")).write.mode("append").parquet(f"{ledger}/ledger")
    return n


def secret_findings(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every version of every file: ``path, blob, rule, rule_version, start, end, redacted, secret_hash``.

    The path column keeps its name.  ``ledger`` is a folder kept from run to run; without one, a new folder is
    made in the shared one and everything is scanned.  Offsets count characters.  Each row of ``versions`` whose
    blob has findings gets them all, repeated rows too; findings of older rule versions are left out.  Null and
    empty texts have none; other columns are not read, so none can clash.  An empty table gives no rows.
    """
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "secrets_ledger")
    scan_versions(versions, ledger, rules, path_col, text_col)
    current = [r.key for r in rules]
    found = _read(spark, f"{ledger}/findings", FINDINGS).where(F.concat_ws("@", "rule", F.col("rule_version").cast("string")).isin(current)).distinct()
    paths = versions.where(F.col(text_col).isNotNull()).select(F.col(path_col), F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("__blob"))
    return paths.join(found, F.col("__blob") == F.col("blob")).select(F.col(path_col), F.lower(F.hex("blob")).alias("blob"), "rule", "rule_version", "start", "end", "redacted", "secret_hash")
