"""Chunkers: folds over a text's sentences or paragraphs, run as Arrow functions, and a fixed-size chunker in plain SQL.

Sizes are UTF-8 bytes.  A piece is added to a chunk until it would grow past ``chunk_size``; a chunk below
``min_size`` is dropped, as is the overlap's order kept: the sentences before a new chunk are taken from the last
backwards and stay in that order.  ``drop_small=False`` and ``reverse_overlap=False`` turn these two off.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "position int, content string, size int, metadata map<string,string>"


@dataclass(frozen=True)
class ChunkConfig:
    chunk_size: int = 1024
    overlap: int = 128
    min_size: int = 100
    max_size: int | None = None
    drop_small: bool = True
    reverse_overlap: bool = True

    def __post_init__(self):
        if self.chunk_size < 1 or self.overlap < 0 or self.min_size < 0:
            raise ValueError("chunk_size must be positive, overlap and min_size not negative")
        if self.overlap >= self.chunk_size:
            raise ValueError("overlap must be smaller than chunk_size")


@dataclass
class Chunk:
    position: int
    content: str
    size: int
    metadata: dict[str, str]


_SPACE = re.compile(r"[\t\n\f\r ]+")
_BLANKS = " \t\n\f\r"


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _printable(text: str) -> str:
    return "".join(c for c in text if c in "\n\t " or c.isprintable() and not c.isspace()) if not text.isprintable() or "\u3000" in text else text


def clean(text: str) -> str:
    return _printable(_SPACE.sub(" ", text)).strip(_BLANKS)


def clean_keeping_paragraphs(text: str) -> str:
    return _printable(re.sub(r"\n[ \t]*\n", "\n\n", re.sub(r"[ \t]+", " ", text))).strip(_BLANKS)


def sentences(text: str) -> list[str]:
    """Sentences with their own marks."""
    return [s for s in (p.strip(_BLANKS) for p in re.sub(r"([.!?]+)[\t\n\f\r ]+", "\\1\x01", text).split("\x01")) if s]


def _overlap(done: list[str], config: ChunkConfig) -> list[str]:
    kept, total = [], 0
    for s in reversed(done):
        if total + _bytes(s) + 1 > config.overlap:
            break
        kept.append(s)
        total += _bytes(s) + 1
    return kept if config.reverse_overlap else kept[::-1]


def _emit(out: list[Chunk], parts: list[str], joint: str, config: ChunkConfig, metadata: Callable[[str, list[str]], dict]) -> bool:
    content = joint.join(parts).strip(_BLANKS)
    if not content or _bytes(content) < config.min_size and config.drop_small:
        return False
    pieces = [content]
    if config.max_size:
        pieces = list(_cut(content, config.max_size))
    for piece in pieces:
        out.append(Chunk(len(out), piece, _bytes(piece), metadata(piece, parts)))
    return True


def _cut(text: str, size: int) -> Iterator[str]:
    held, n = [], 0
    for c in text:
        if held and n + _bytes(c) > size:
            yield "".join(held)
            held, n = [], 0
        held.append(c)
        n += _bytes(c)
    if held:
        yield "".join(held)


def _greedy(pieces: list[str], joint: str, config: ChunkConfig, metadata, overlap: bool, count_joint: bool) -> list[Chunk]:
    out: list[Chunk] = []
    held: list[str] = []
    size = 0
    before: list[str] = []
    for s in pieces:
        n = _bytes(s)
        gap = len(joint) if held else 0
        if size > 0 and size + n + (gap if count_joint else 0) > config.chunk_size:
            _emit(out, held, joint, config, metadata)
            held = _overlap(before, config) if overlap and out else []
            size = _bytes(joint.join(held))
            gap = len(joint) if held else 0
        held.append(s)
        size += n + gap
        before.append(s)
    _emit(out, held, joint, config, metadata)
    return out


def sentence_chunks(text: str, config: ChunkConfig) -> list[Chunk]:
    return _greedy(sentences(text), " ", config, lambda content, _: {"chunk_type": "sentence", "sentences": str(len(re.findall(r"[.!?]+", content)))}, True, False)


def paragraph_chunks(text: str, config: ChunkConfig) -> list[Chunk]:
    parts = [p for p in (p.strip(_BLANKS) for p in text.split("\n\n")) if p]
    return _greedy(parts, "\n\n", config, lambda content, _: {"chunk_type": "paragraph", "paragraphs": str(content.count("\n\n") + 1)}, False, False)


def fixed_chunks(text: str, config: ChunkConfig) -> list[Chunk]:
    """Chunks of ``chunk_size`` characters, each ``overlap`` of them into the one before; the last is kept however small."""
    step, out, at = config.chunk_size - config.overlap, [], 0
    while at < len(text):
        piece = text[at : at + config.chunk_size]
        out.append(Chunk(len(out), piece, _bytes(piece), {"chunk_type": "fixed", "start_pos": str(at), "end_pos": str(at + len(piece))}))
        if at + config.chunk_size >= len(text):
            break
        at += step
    return out


_ABBREVIATED = re.compile(
    r"\b(?:Dr|Mr|Mrs|Ms|Prof|Rev|Hon|Sr|Jr|St|vs|etc|approx|Inc|Ltd|Corp|Co|Dept|Univ|No|Nos|Vol|Fig|Figs|Eq|Ch|Sec|pp|ed|eds|al|cf|ca|e\.g|i\.e|a\.m|p\.m|U\.S|U\.K|U\.N|E\.U|Ph\.D|M\.D|B\.A|M\.A|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|Gen|Col|Lt|Sgt|Capt|Ave|Blvd|Rd|Mt|bzw|usw|z\.B|d\.h|u\.a|Nr|Str|Mme|Mlle|Sra|Srta)\.|\b(?:[A-Z]\.){2,}",
)
_MASK = "\x02"


def smart_sentences(text: str) -> list[str]:
    """Sentences cut only before a capital letter, and not at abbreviations, acronyms and decimals; one mark is kept."""
    masked = _ABBREVIATED.sub(lambda m: m[0].replace(".", _MASK), text)
    masked = re.sub(r"(\d)\.(?=\d)", rf"\1{_MASK}", masked)
    parts = re.sub(r"([.!?])[.!?]*[\t\n\f\r ]+(?=[^\W\d_a-zß-öø-ÿ]|\Z)", lambda m: m[1] + "\x01", masked).split("\x01")
    return [s for s in (p.replace(_MASK, ".").strip(_BLANKS) for p in parts) if s]


def is_structured(text: str) -> bool:
    """Whether blank lines divide the text into paragraphs: three at least, above 100 bytes on average, under half of them short."""
    parts = re.split(r"\n[\t\n\f\r ]*\n", text)
    sizes = [_bytes(p.strip(_BLANKS)) for p in parts if p.strip(_BLANKS)]
    return len(parts) >= 3 and sum(sizes) / len(parts) > 100 and sum(s < 50 for s in sizes) / len(parts) < 0.5


def smart_chunks(text: str, config: ChunkConfig) -> list[Chunk]:
    text = clean_keeping_paragraphs(text)
    if not text:
        return []

    def about(kind: str, boundary: str, unit: str):
        def metadata(content: str, parts: list[str]) -> dict[str, str]:
            return {"chunk_type": kind, "boundary_type": boundary, unit: str(len(parts)), "char_count": str(_bytes(content)), "word_count": str(len(content.split()))}

        return metadata

    of_sentences = about("smart_sentence", "sentence", "sentences")
    if not is_structured(text):
        out = _greedy(smart_sentences(text), " ", config, of_sentences, True, True)
    else:
        out, held, size = [], [], 0
        of_paragraphs = about("smart_paragraph", "paragraph", "paragraphs")
        for p in (p.strip(_BLANKS) for p in re.split(r"\n[\t\n\f\r ]*\n", text)):
            if not p:
                continue
            n = _bytes(p)
            if n > config.chunk_size:  # what is held stays held: its chunk comes after this paragraph's
                for c in _greedy(smart_sentences(p), " ", config, about("smart_paragraph", "paragraph_sentence_hybrid", "sentences"), True, True):
                    out.append(Chunk(len(out), c.content, c.size, c.metadata))
                continue
            if held and size + n + 2 > config.chunk_size:
                _emit(out, held, "\n\n", config, of_paragraphs)
                held, size = [], 0
            size += n + (2 if held else 0)
            held.append(p)
        _emit(out, held, "\n\n", config, of_paragraphs)
    if out:
        out[-1].metadata["final_chunk"] = "true"
    return out


def token_chunks(text: str, config: ChunkConfig) -> list[Chunk]:
    """Chunks of at most ``4 * chunk_size`` characters, cut back by up to 500 to a sentence, paragraph or blank; 200 overlap."""
    most, out, at = 4 * config.chunk_size, [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            low = max(at + 1, end - 500)
            for mark in (". ", "\n\n", " "):
                found = text.rfind(mark, low, end)
                if found > low:
                    end = found + len(mark.rstrip()) if mark != " " else found
                    break
        piece = text[at:end].strip(_BLANKS)
        if piece:
            out.append(Chunk(len(out), piece, _bytes(piece), {"chunk_type": "token", "tokens": str(len(piece) // 4)}))
        if end >= len(text):
            break
        at = max(end - min(200, most // 2), at + 1)
    return out


def tail_overlap_chunks(text: str, config: ChunkConfig) -> list[Chunk]:
    """Sentence chunks, each of which begins with the last ``overlap`` characters of the one before."""
    out: list[Chunk] = []
    held = ""
    for s in sentences(text):
        if held and _bytes(held) + _bytes(s) + 1 > config.chunk_size:
            out.append(Chunk(len(out), held, _bytes(held), {"chunk_type": "tail_overlap"}))
            held = (held[-config.overlap :].lstrip() + " " if config.overlap else "") + s
        else:
            held = f"{held} {s}" if held else s
    if held:
        out.append(Chunk(len(out), held, _bytes(held), {"chunk_type": "tail_overlap"}))
    return out


CHUNKERS: dict[str, Callable[[str, ChunkConfig], list[Chunk]]] = {
    "sentence": sentence_chunks, "paragraph": paragraph_chunks, "fixed": fixed_chunks, "smart": smart_chunks, "token": token_chunks, "tail_overlap": tail_overlap_chunks,
}


def get_chunker(name: str) -> Callable[[str, ChunkConfig], list[Chunk]]:
    """A registered chunker; the smart one for any other name."""
    return CHUNKERS.get(name, smart_chunks)


def register_chunker(name: str, chunker: Callable[[str, ChunkConfig], list[Chunk]]) -> None:
    CHUNKERS[name] = chunker


#: Bytes of text that are in Python at a time, unless one text alone is longer.
PART_BYTES = 2_000_000


def slices(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of one of its columns; else what a task holds would follow the texts' length."""
    most, start, held = most or PART_BYTES, 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    yield batch.slice(start)


def chunk_documents(docs: DataFrame, strategy: str = "smart", config: ChunkConfig | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The id column, ``position, content, size, metadata`` and the columns to ``keep``: one row for each chunk; null texts have none."""
    config, chunker = config or ChunkConfig(), get_chunker(strategy)
    typed = lambda c: f"`{c}` {docs.schema[c].dataType.simpleString()}"
    schema = ", ".join([typed(id_col), SCHEMA, *map(typed, keep)])
    kind = pa.map_(pa.string(), pa.string())

    def chunk(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            at, out = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    found = chunker(text, config)
                    at += [k] * len(found)
                    out += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at := pa.array(at, pa.int64())), pa.array([c.position for c in out], pa.int32()), pa.array([c.content for c in out], pa.string()), pa.array([c.size for c in out], pa.int32()), pa.array([list(c.metadata.items()) for c in out], kind), *(batch.column(2 + k).take(at) for k in range(len(keep)))],
                names=[id_col, "position", "content", "size", "metadata", *keep],
            )

    return docs.select(id_col, text_col, *keep).mapInArrow(chunk, schema)


def fixed_chunk_columns(text: Column, chunk_size: int = 1024, overlap: int = 128) -> Column:
    """``array<struct<position, start_pos, end_pos, content>>`` of the fixed-size chunks, without leaving the JVM."""
    ChunkConfig(chunk_size, overlap, 0)
    step = chunk_size - overlap
    n = F.when(F.length(text) > 0, F.greatest(F.lit(0), F.ceil((F.length(text) - chunk_size) / step)).cast("int") + 1).otherwise(0)
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("position"), (i * step).alias("start_pos"), F.least(i * step + chunk_size, F.length(text)).alias("end_pos"), F.substring(text, i * step + 1, F.lit(chunk_size)).alias("content")),
    )
