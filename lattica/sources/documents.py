"""Documents from files: text, Markdown, HTML, DOCX and, where a library is there, PDF."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..operators.chunking import ChunkConfig, chunk_documents
from ..operators.embed import VectorizerConfig, embed_column

SUPPORTED = {
    "txt": ("text/plain", [".txt", ".text"], True), "md": ("text/markdown", [".md", ".markdown"], True), "html": ("text/html", [".html", ".htm"], True),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", [".docx"], True), "pdf": ("application/pdf", [".pdf"], True),
    "doc": ("application/msword", [".doc"], False), "rtf": ("application/rtf", [".rtf"], False),
}


class UnsupportedDocument(ValueError):
    pass


def supported_formats(spark: SparkSession) -> DataFrame:
    """``type, mime, extensions, supported``."""
    return spark.createDataFrame([(k, *v) for k, v in SUPPORTED.items()], "type string, mime string, extensions array<string>, supported boolean").orderBy("type")


def scan_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def file_verdict(path: Column, size: Column, min_size: int = 0, max_size: int = 0, allowed: list[str] | None = None, metadata: Column | None = None, required: list[str] | None = None) -> Column:
    """``struct<ok, field, message>``: whether a file may be processed.  Limits of 0 aren't tested."""
    kind = T.document_type(path)
    known = [e[1:] for k, (_, exts, good) in SUPPORTED.items() if good for e in exts]

    def bad(name: str, message: str) -> Column:
        return F.struct(F.lit(False).alias("ok"), F.lit(name).alias("field"), F.lit(message).alias("message"))

    out = F.when(~T.extension(path).isin(known), bad("extension", "unsupported file type"))
    if min_size > 0:
        out = out.when(size < min_size, bad("size", "file is too small"))
    if max_size > 0:
        out = out.when(size > max_size, bad("size", "file is too large"))
    if allowed:
        out = out.when(~kind.isin(allowed), bad("type", "type is not allowed"))
    for name in required or []:
        out = out.when(metadata[name].isNull(), bad("metadata", f"{name} is missing"))
    return out.otherwise(F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("message")))


def _plain(xml: str) -> str:
    return unescape(xml)


def read_docx(content: bytes) -> tuple[str, dict[str, str]]:
    """Text runs of the body, joined by blanks, and the core properties."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = z.read("word/document.xml").decode("utf-8", "replace")
        core = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in z.namelist() else ""
    text = " ".join(_plain(m) for m in re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", body))
    properties = {}
    for tag, name in (("dc:title", "title"), ("dc:creator", "author"), ("dc:subject", "subject"), ("dc:description", "description"), ("cp:keywords", "keywords"), ("dcterms:created", "created"), ("dcterms:modified", "modified")):
        found = re.search(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", core)
        if found and found[1].strip():
            properties[name] = _plain(found[1].strip())
    properties["paragraph_count"] = str(len(re.findall(r"<w:p[ >]", body)))
    return text, properties


def read_pdf(content: bytes) -> tuple[str, dict[str, str]]:
    """Text of the pages, joined by blank lines; needs the package pypdf.  Pages that can't be read are left out."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise UnsupportedDocument("reading PDF needs the package pypdf") from e
    reader = PdfReader(io.BytesIO(content))
    parts = []
    for page in reader.pages:
        try:
            parts.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001 - a damaged page may fail in any way
            continue
    return "\n\n".join(p for p in parts if p.strip()), pdf_metadata(content) | {"page_count": str(len(reader.pages))}


def pdf_metadata(content: bytes) -> dict[str, str]:
    return {"version": content[:8].decode("ascii", "replace")} if content.startswith(b"%PDF-1.") else {}


def _refuse(kind: str) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    def refuse(content: bytes):
        raise UnsupportedDocument(f"{kind} documents can't be read")

    return refuse


BINARY: dict[str, Callable[[bytes], tuple[str, dict[str, str]]]] = {"docx": read_docx, "pdf": read_pdf, "doc": _refuse("doc"), "rtf": _refuse("rtf")}


def register_processor(kind: str, reader: Callable[[bytes], tuple[str, dict[str, str]]]) -> None:
    BINARY[kind] = reader


def _binary_text(files: DataFrame) -> DataFrame:
    """``files`` of binary kinds with ``raw, props, error``."""
    readers = dict(BINARY)

    def read(batches):
        for batch in batches:
            out = []
            for kind, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    out.append((*readers[kind](content or b""), None))
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                    out.append((None, {}, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(c or b"") for c in batch.column(2).to_pylist()], pa.int64()), pa.array([o[0] for o in out], pa.string()), pa.array([list(o[1].items()) for o in out], pa.map_(pa.string(), pa.string())), pa.array([o[2] for o in out], pa.string())],
                names=["path", "type", "size", "raw", "props", "error"],
            )

    return files.mapInArrow(read, "path string, type string, size bigint, raw string, props map<string,string>, error string")


def _map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def process_documents(files: DataFrame, language: str = "en", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``id, title, content, type, size, language, metadata, error`` of each file; a file that can't be read has an error and no content.

    Titles, front matter and counts are taken from the text as it is in the file, before it is cleaned.
    """
    kind = F.when(T.extension(F.col(path_col)) == "rtf", "rtf").otherwise(T.document_type(F.col(path_col)))
    typed = files.select(F.col(path_col).alias("path"), kind.alias("type"), F.col(content_col).cast("binary").alias("content"))
    text_like = typed.where(F.col("type").isin("txt", "md", "html")).select("path", "type", F.octet_length("content").cast("bigint").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"), F.create_map().cast("map<string,string>").alias("props"), F.lit(None).cast("string").alias("error"))
    binary = _binary_text(typed.where(~F.col("type").isin("txt", "md", "html")))
    rows, raw, is_html, is_md = text_like.unionByName(binary), F.col("raw"), F.col("type") == "html", F.col("type") == "md"
    content = F.when(is_html, H.html_text(raw)).otherwise(T.clean_text(raw))
    title = F.when(is_html, H.html_title(raw, F.col("path"))).when(F.col("type").isin("docx", "pdf"), F.coalesce(F.col("props")["title"], T.file_stem(F.col("path")))).otherwise(T.text_title(raw, F.col("path")))
    rows = rows.select("*", content.alias("content"), title.alias("title"))
    common = _map({"word_count": T.count_words(F.col("content")), "char_count": T.count_bytes(F.col("content")), "line_count": T.count_lines(raw), "filename": F.regexp_extract("path", r"([^/\\]+)$", 1)})
    empty = F.create_map().cast("map<string,string>")
    of_html = F.map_concat(_map(H.html_counts(raw) | {"html_lang": H.html_lang(raw), "charset": H.html_charset(raw)}), H.html_meta(raw))
    metadata = F.map_concat(F.col("props"), common, F.when(is_md, T.markdown_metadata(raw)).otherwise(empty), F.when(is_html, F.map_filter(of_html, lambda k, v: v.isNotNull())).otherwise(empty))
    spoken = F.when(is_html & (F.lit(language) == "en"), F.coalesce(H.html_lang(raw), F.lit(language))).otherwise(language)
    return rows.select(T.document_id(F.col("path"), F.coalesce(raw, F.col("path"))).alias("id"), "title", "content", "type", "size", spoken.alias("language"), F.when(F.col("error").isNull(), metadata).alias("metadata"), "error")


def ingest(documents: DataFrame, vectorizer: VectorizerConfig | None = None, strategy: str = "sentence", config: ChunkConfig | None = None) -> DataFrame:
    """Chunks of processed documents as rows of a collection: ``id, vector, metadata, content, error``.

    An id is ``<document>_chunk_<position>``.  Chunks whose text couldn't be embedded come with their error.
    """
    good = documents.where("error IS NULL AND content IS NOT NULL")
    about = good.select("id", "content", F.col("title").alias("document_title"), F.col("type").alias("document_type"), F.col("metadata")["filename"].alias("filename"))
    rows = chunk_documents(about, strategy, config, "id", "content", ["document_title", "document_type", "filename"]).withColumnsRenamed({"id": "document_id", "content": "chunk"})
    named = F.transform_keys("metadata", lambda k, _: F.when(k.startswith("chunk_"), k).otherwise(F.concat(F.lit("chunk_"), k)))
    own = _map({"document_id": F.col("document_id"), "document_title": F.col("document_title"), "document_type": F.col("document_type"), "chunk_position": F.col("position"), "chunk_size": F.col("size"), "filename": F.col("filename")})
    rows = rows.select(F.concat("document_id", F.lit("_chunk_"), F.col("position")).alias("id"), F.to_json(F.map_concat(own, named)).alias("metadata"), F.col("chunk").alias("content"))
    return embed_column(rows, vectorizer, "content", "vector", "error").select("id", "vector", "metadata", "content", "error")


LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "sh": "shell", "bash": "shell", "sql": "sql", "html": "html", "css": "css", "scss": "css", "vue": "vue", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown", "txt": "text",
}
IGNORED = r"(?:^|/)(?:\.git|\.hg|\.svn|\.idea|\.vscode|node_modules|vendor|venv|\.venv|env|__pycache__|\.pytest_cache|\.mypy_cache|dist|build|out|target|bin|obj|coverage|\.next|\.cache)/|\.(?:min\.js|min\.css|map|lock|pyc|log)$|(?:^|/)(?:package-lock\.json|\.DS_Store)$"


def code_files(files: DataFrame, root: str = "", max_size: int = 100_000, max_files: int = 500) -> DataFrame:
    """``path, language, size, content`` of a repository's source files: known languages, no build output, small, the first ``max_files`` by path."""
    path = F.regexp_replace(F.col("path"), "^(?:file:/*)?" + re.escape("/" + root.strip("/") + "/" if root else ""), "")
    kinds = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    rows = files.where(F.col("length") <= max_size).select(path.alias("path"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    rows = rows.withColumn("language", F.try_element_at(kinds, T.extension(F.col("path")))).where("language IS NOT NULL").where(~F.col("path").rlike(IGNORED))
    return rows.select("path", "language", "size", "content").orderBy("path").limit(max_files)
