"""Text cleaning, counts and metadata as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\t\n\f\r ]"
EXTENSIONS = {
    "txt": "txt", "text": "txt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "doc": "doc", "rtf": "rtf",
}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+\z", "")


def printable(text: Column) -> Column:
    """Without characters that aren't letters, marks, numbers, punctuation, symbols, blanks, line feeds or tabs."""
    return F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\t]", "")


def clean_text(text: Column) -> Column:
    """Every run of white space as one blank, line feeds too; printable characters only; trimmed."""
    return trimmed(printable(F.regexp_replace(text, rf"{_BLANK}+", " ")))


def clean_keeping_paragraphs(text: Column) -> Column:
    """Blanks and tabs as one blank, blank lines as one empty line; printable characters only; trimmed."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    return trimmed(printable(F.regexp_replace(out, r"\n[ \t]*\n", "\n\n")))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^\t\n\f\r ]+"))


def count_bytes(text: Column) -> Column:
    return F.octet_length(text)


def count_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def count_sentences(text: Column) -> Column:
    """Runs of sentence marks."""
    return F.regexp_count(text, F.lit(r"[.!?]+"))


def split_sentences(text: Column) -> Column:
    """Sentences with their own marks, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(text, rf"([.!?]+){_BLANK}+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def document_type(name: Column) -> Column:
    """Kind of document by file name; txt where it is unknown."""
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, extension(name)), F.lit("txt"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def document_id(name: Column, content: Column) -> Column:
    """``doc_<stem>_<start of the content's SHA-256>``: the same file has the same id on every run."""
    return F.concat(F.lit("doc_"), F.regexp_replace(file_stem(name), "[ -]", "_"), F.lit("_"), F.substring(F.sha2(content.cast("binary"), 256), 1, 12))


def text_title(text: Column, name: Column) -> Column:
    """Markdown's first ``# `` line; else the first line that isn't blank, under 100 bytes and without a tab; else the file's stem."""
    heading = trimmed(F.regexp_extract(text, r"(?:^|\n)# ([^\n]*)", 1))
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda s: (s != "") & (F.octet_length(s) < 100) & ~s.contains("\t"))
    plain = F.try_element_at(lines, F.lit(1))
    return F.coalesce(F.when((document_type(name) == "md") & (heading != ""), heading), plain, file_stem(name))


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines of a leading YAML block; empty without one."""
    block = F.regexp_extract(text, r"^---[ \t]*\r?\n(?s:(.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda s: s.rlike(r"^[A-Za-z0-9_-]+[ \t]*:"))
    entries = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([A-Za-z0-9_-]+)", 1), F.regexp_replace(trimmed(F.regexp_extract(s, r":(.*)$", 1)), r"^[\"']|[\"']$", "")))
    firsts = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda d: d["col1"] == e["col1"]))
    return F.map_from_entries(firsts)


def markdown_metadata(text: Column) -> Column:
    """Front-matter entries as ``frontmatter_<key>`` and counts of headings, links and code blocks."""
    front = F.transform_keys(front_matter(text), lambda k, _: F.concat(F.lit("frontmatter_"), k))
    fences = F.floor(F.regexp_count(text, F.lit("```")) / 2)
    counts = {"heading_count": F.regexp_count(text, F.lit("#")), "link_count": F.regexp_count(text, F.lit(r"\]\(")), "code_block_count": fences}
    return F.map_concat(front, F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v.cast("string"))]))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4)


def clean_query(query: Column) -> Column:
    """Lower case, without leading question words, question and exclamation marks; the query itself where under 3 characters are left."""
    out = F.lower(trimmed(query))
    out = F.regexp_replace(out, r"^(?:(?:what|who|when|where|why|how|which|can you|could you|please|tell me about|tell me|explain|describe|is|are|was|were|do|does|did)\b[ ]*)+", "")
    out = trimmed(F.regexp_replace(out, "[?!]", ""))
    return F.when(F.length(out) >= 3, out).otherwise(query)


def url_domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def drop_noise(text: Column) -> Column:
    """Without lines of page furniture: cookie notices, sign-up prompts, share bars, copyright lines."""
    furniture = r"(?im)^.*(?:accept (?:all )?cookies|cookie policy|privacy policy|subscribe to our|sign up for|share (?:this|on)|all rights reserved|skip to (?:main )?content).*$"
    return trimmed(F.regexp_replace(F.regexp_replace(text, furniture, ""), r"\n{2,}", "\n"))


def repository_parts(url: Column) -> Column:
    """``owner, name`` of a repository URL; null for another."""
    form = r"^(?:https?://|git@)[A-Za-z0-9.-]+[/:]([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?(?:[/#?].*)?$"
    return F.when(url.rlike(form), F.struct(F.regexp_extract(url, form, 1).alias("owner"), F.regexp_extract(url, form, 2).alias("name")))


def best_content(content: Column, stored: Column, snippet: Column, title: Column, url: Column) -> Column:
    """The first that isn't empty of content, stored content, snippet with title and URL, title."""
    some = lambda c: F.when(F.length(c) > 0, c)
    short = F.when(F.length(snippet) > 0, F.concat_ws("\n", some(title), snippet, some(url)))
    return F.coalesce(some(content), some(stored), short, some(title), F.lit(""))
