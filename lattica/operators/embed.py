"""Text to vectors: a registry of vectorizers, run as Arrow functions whose failures stay on their own rows."""

from __future__ import annotations

import re
import zlib
from abc import ABC, abstractmethod
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import MAX_DIMENSIONS, VectorizerType
from .chunking import slices


@dataclass(frozen=True)
class VectorizerConfig:
    type: VectorizerType | int | str = VectorizerType.HASH
    model: str = ""
    dimensions: int = 384
    options: dict = field(default_factory=dict)


class Vectorizer(ABC):
    """Made once in each Python worker; ``embed`` gets many texts at a time."""

    dimensions: int
    model: str

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...

    def close(self) -> None:
        return None


class HashVectorizer(Vectorizer):
    """Hashed words, word pairs and letter trigrams, signed, at length 1.  For tests and offline use: similar wording, not meaning."""

    def __init__(self, config: VectorizerConfig):
        if not 1 <= config.dimensions <= MAX_DIMENSIONS:
            raise ValueError(f"dimensions must lie between 1 and {MAX_DIMENSIONS}")
        self.dimensions, self.model = config.dimensions, config.model or "hash"
        self._ids: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """What is known of words: at 4 * id checksums of "w" + word and of "p" + word + " ", length and sum of bytes; features from ``_starts`` on."""
        self._ids.clear()
        self._about, self._starts, self._places, self._weights = array("q"), array("q", [0]), array("q"), array("d")

    def _feature(self, name: str, weight: float) -> None:
        data = name.encode()
        self._places.append(zlib.crc32(data) % self.dimensions)
        self._weights.append(weight if zlib.adler32(data) & 1 else -weight)

    def _id(self, word: str) -> int:
        found = self._ids.get(word)
        if found is None:
            found = self._ids[word] = len(self._ids)
            self._feature("w" + word, 1.0)
            for i in range(len(word) - 2):
                self._feature("c" + word[i : i + 3], 0.3)
            self._starts.append(len(self._places))
            data = word.encode()
            self._about.extend((zlib.crc32(data), zlib.crc32(b"p" + data + b" "), len(data), sum(data)))
        return found

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        start = held = 0
        for k, text in enumerate(texts):
            if held and held + len(text) > PART:
                self._add(out[start:k], texts[start:k])
                start, held = k, 0
            held += len(text)
        self._add(out[start:], texts[start:])
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0)

    def _add(self, out: np.ndarray, texts: list[str]) -> None:
        """Adds the features of some texts to their rows."""
        if len(self._ids) >= 100_000:
            self._forget()
        words = [re.findall(r"\w+", t.lower()) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        if not counts.sum():
            return
        ids, known = np.empty(counts.sum(), np.int64), self._id
        ids[:] = [known(w) for some in words for w in some]
        row = np.repeat(np.arange(len(texts)), counts)
        about, starts, places, weights = np.array(self._about).reshape(-1, 4), np.array(self._starts), np.array(self._places), np.array(self._weights)
        n = (starts[1:] - starts[:-1])[ids]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[ids], n)
        total = np.bincount(np.repeat(row, n) * self.dimensions + places[at], weights=weights[at], minlength=out.size)
        both = np.flatnonzero(row[:-1] == row[1:])
        first, second = about[ids[both]], about[ids[both + 1]]
        # crc32(a + b) is crc32(a), moved on by the bytes of b, xor crc32(b); the lowest bit of adler32 is that of its sum of bytes.
        joined = moved_on(first[:, 1], second[:, 2]) ^ second[:, 0]
        odd = (1 + ord("p") + ord(" ") + first[:, 3] + second[:, 3]) % 65_521 & 1
        total += np.bincount(row[both] * self.dimensions + joined % self.dimensions, weights=np.where(odd, 0.5, -0.5), minlength=out.size)
        out += total.reshape(out.shape)


#: Characters whose features are made at once.
PART = 500_000


@cache
def _moves(bits: int) -> np.ndarray:
    """What ``2 ** bits`` more zero bytes make of a checksum: for each of its four bytes a table of 256."""
    if not bits:
        one = np.array([zlib.crc32(b"\0", x) ^ zlib.crc32(b"\0", 0) for x in (v << 8 * k for k in range(4) for v in range(256))], np.int64)
        return one.reshape(4, 256)
    half = _moves(bits - 1)
    return _through(half, _through(half, np.arange(256)[None, :] << 8 * np.arange(4)[:, None]))


def _through(table: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return table[0][sums & 255] ^ table[1][sums >> 8 & 255] ^ table[2][sums >> 16 & 255] ^ table[3][sums >> 24 & 255]


def moved_on(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums as their bytes are followed by so many others, apart from what these add."""
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        sums = np.where(lengths >> bit & 1, _through(_moves(bit), sums), sums)
    return sums


class SentenceTransformersVectorizer(Vectorizer):
    def __init__(self, config: VectorizerConfig):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("the sentence_transformers vectorizer needs the package sentence-transformers") from e
        self.model = config.model or "all-MiniLM-L6-v2"
        self._model = SentenceTransformer(self.model)
        self.dimensions = self._model.get_sentence_embedding_dimension()

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self._model.encode(texts))


class HttpVectorizer(Vectorizer):
    """An embedding service over HTTP; ``options``: url, api_key, timeout."""

    def __init__(self, config: VectorizerConfig, url: str, model: str, many: bool, timeout: float):
        self.dimensions, self.model = config.dimensions, config.model or model
        self.url, self.many = config.options.get("url", url), many
        self.timeout, self.key = float(config.options.get("timeout", timeout)), config.options.get("api_key")

    def _post(self, body: dict) -> dict:
        import json
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as answer:  # noqa: S310
            return json.loads(answer.read())

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.many:
            rows = sorted(self._post({"model": self.model, "input": texts})["data"], key=lambda r: r["index"])
            return np.array([r["embedding"] for r in rows])
        return np.array([self._post({"model": self.model, "prompt": t})["embedding"] for t in texts])


def _openai(config: VectorizerConfig) -> Vectorizer:
    if not config.options.get("api_key"):
        raise ValueError("the openai vectorizer needs the option api_key")
    return HttpVectorizer(config, "https://api.openai.com/v1/embeddings", "text-embedding-3-small", True, 30)


def _ollama(config: VectorizerConfig) -> Vectorizer:
    return HttpVectorizer(config, "http://localhost:11434/api/embeddings", "nomic-embed-text", False, 60)


def _unsupported(config: VectorizerConfig) -> Vectorizer:
    raise NotImplementedError(f"vectorizer {VectorizerType.parse(config.type).name.lower()} is not available")


VECTORIZERS: dict[VectorizerType, Callable[[VectorizerConfig], Vectorizer]] = {
    VectorizerType.NONE: _unsupported, VectorizerType.HASH: HashVectorizer, VectorizerType.SENTENCE_TRANSFORMERS: SentenceTransformersVectorizer,
    VectorizerType.OPENAI: _openai, VectorizerType.OLLAMA: _ollama, VectorizerType.HUGGINGFACE: _unsupported,
}


def make_vectorizer(config: VectorizerConfig) -> Vectorizer:
    return VECTORIZERS[VectorizerType.parse(config.type)](config)


def register_vectorizer(kind: VectorizerType, factory: Callable[[VectorizerConfig], Vectorizer]) -> None:
    VECTORIZERS[kind] = factory


@dataclass
class BatchStats:
    requests: int = 0
    texts: int = 0
    batches: int = 0
    fallbacks: int = 0
    individual: int = 0
    retries: int = 0
    failures: int = 0


def embed_texts(vectorizer: Vectorizer, texts: list[str], retries: int = 3, part: int = 8, stats: BatchStats | None = None) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text in order: the whole batch, some times; then parts of it; then one by one."""
    stats = stats or BatchStats()
    stats.requests += 1
    stats.texts += len(texts)
    if not texts:
        return []

    def vectors(some: list[str]):
        made = np.asarray(vectorizer.embed(some), np.float64)
        if made.shape[0] != len(some):
            raise ValueError(f"{made.shape[0]} vectors for {len(some)} texts")
        return [(v.tolist(), None) for v in made]

    for attempt in range(max(1, retries)):
        try:
            stats.batches += 1
            stats.retries += attempt > 0
            return vectors(texts)
        except Exception:  # noqa: BLE001 - a service may fail in any way
            continue
    stats.fallbacks += 1
    out: list[tuple[list[float] | None, str | None]] = []
    for s in range(0, len(texts), part):
        try:
            out += vectors(texts[s : s + part])
        except Exception:  # noqa: BLE001
            for t in texts[s : s + part]:
                stats.individual += 1
                try:
                    out += vectors([t])
                except Exception as e:  # noqa: BLE001
                    stats.failures += 1
                    out.append((None, str(e)))
    return out


def embed_column(df: DataFrame, config: VectorizerConfig | None = None, text_col: str = "text", vector_col: str = "vector", error_col: str = "embed_error") -> DataFrame:
    """``df`` with a vector, and an error where a text couldn't be embedded; a null text has neither."""
    config = config or VectorizerConfig()

    def embed(batches):
        vectorizer = make_vectorizer(config)
        try:
            for batch in (part for b in batches for part in slices(b, b.schema.get_field_index(text_col))):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                have = [i for i, t in enumerate(texts) if t is not None]
                found = dict(zip(have, embed_texts(vectorizer, [texts[i] for i in have]), strict=True))
                vectors = pa.array([found.get(i, (None, None))[0] for i in range(len(texts))], pa.list_(pa.float32()))
                errors = pa.array([found.get(i, (None, None))[1] for i in range(len(texts))], pa.string())
                yield batch.append_column(vector_col, vectors).append_column(error_col, errors)
        finally:
            vectorizer.close()

    from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(vector_col, ArrayType(FloatType())), StructField(error_col, StringType())])
    return df.mapInArrow(embed, schema)


def embedding_stats(embedded: DataFrame, vector_col: str = "vector", error_col: str = "embed_error") -> DataFrame:
    """``texts, embedded, failed, dimensions``."""
    return embedded.agg(
        F.count("*").alias("texts"), F.count(vector_col).alias("embedded"), F.count(error_col).alias("failed"), F.max(F.size(vector_col)).alias("dimensions")
    )


def embed_query(text: str, config: VectorizerConfig | None = None) -> list[float]:
    """A query's vector, made on the driver."""
    vector, error = embed_texts(make_vectorizer(config or VectorizerConfig()), [text])[0]
    if vector is None:
        raise RuntimeError(error)
    return vector
