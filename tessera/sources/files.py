"""File sources: listing, format detection and parsers of sections.

A parser takes the name and bytes of one file and yields sections; ``parse_files``
runs it in Arrow batches over Spark's binaryFile source, so one job reads a whole
tree, a bad file becomes a row with status 'failed', and Spark retries tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_CHARS = 50
# Formats by suffix.
SUFFIXES = {".tei.xml": "tei", ".xml": "xml", ".pdf": "pdf", ".md": "markdown", ".markdown": "markdown", ".docx": "docx", ".txt": "txt", ".html": "html", ".htm": "html"}
SECTION = "path string, status string, error string, title string, authors string, section string, section_index int, source_format string, text string"
Section = tuple[str, int, str]  # heading, index before short ones are dropped, text


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a folder, without their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "modificationTime", "length").distinct()


def collect_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> DataFrame:
    """Paths below a folder, sorted. Glob patterns of names win over extensions, which match in any case, with or without a dot; neither means all files."""
    glob = "{" + ",".join(patterns) + "}" if patterns else "*"
    found = list_files(spark, root, glob).select("path")
    if extensions and not patterns:
        ends = [F.lower("path").endswith("." + e.lower().lstrip(".")) for e in extensions]
        found = found.where(F.array_contains(F.array(*ends), True))
    return found.distinct().orderBy("path")


def newest(files: DataFrame, count: int = 1) -> DataFrame:
    return files.orderBy(F.desc("modificationTime"), "path").limit(count)


def detect_format(path: Column, content: Column) -> Column:
    """By suffix; .xml files are TEI if their first 1000 characters say so; null for others."""
    low = F.lower(path)
    head = F.decode(F.substring(content, 1, 1000), "ISO-8859-1")  # the marks are ASCII
    found = F.lit(None).cast("string")
    for suffix, kind in reversed(SUFFIXES.items()):
        found = F.when(low.endswith(suffix), F.when(F.contains(head, F.lit("<teiHeader")) | F.contains(head, F.lit("<TEI")), "tei") if kind == "xml" else kind).otherwise(found)
    return found


# The Japanese encodings beside UTF-8.
JAPANESE = ("cp932", "euc_jp")
SAMPLE = 10_000  # bytes by which an encoding is told


def _kana(text: str) -> float:
    """The share of kana and kanji, halfwidth kana counted against it: they are what a wrong guess gives."""
    full = sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in text)
    half = sum("\uff61" <= c <= "\uff9f" for c in text)
    return (full - half) / max(1, len(text))


def decode_text(data: bytes) -> str:
    """UTF-8, with or without a mark; UTF-16 by its mark; Shift-JIS or EUC-JP where that gives Japanese; else Latin-1, which takes any bytes."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    best, most = "latin-1", 0.1
    for name in JAPANESE:
        share = _kana(data[:SAMPLE].decode(name, "ignore"))
        if share > most:
            best, most = name, share
    try:
        return data.decode(best)
    except UnicodeDecodeError:
        return data.decode("latin-1")


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _stem(path: str) -> str:
    return PurePosixPath(path).name.removesuffix(".tei.xml").rsplit(".", 1)[0]


def parse_tei(path: str, data: bytes, least: int = LEAST_CHARS) -> tuple[str, list[str], list[Section]]:
    """Every div is a section of its paragraphs, measured before cleaning."""
    root = ElementTree.fromstring(re.sub(r'\sxmlns="[^"]*"', "", decode_text(data), count=1).encode())
    text = lambda node: "".join(node.itertext()).strip() if node is not None else ""
    title = text(next((t for t in root.iterfind(".//titleStmt/title") if t.get("level") == "a" and t.get("type") == "main"), None))
    authors = [" ".join(filter(None, [*(text(f) for f in person.iter("forename")), text(person.find("surname"))])) for person in root.iter("persName")]
    sections = []
    for i, div in enumerate(root.iter("div")):
        body = "\n\n".join(filter(None, (text(p) for p in div.iter("p"))))
        if len(body) >= least:
            sections.append(((text(div.find("head")) or f"Section {i}")[:100], i, squeeze(body)))
    return (title if len(title) > 10 else _stem(path).replace("_", " ").title())[:200], [a for a in authors if a][:5] or ["Unknown Author"], sections


def parse_tei_plain(path: str, data: bytes) -> tuple[str, list[str], list[Section]]:
    """TEI without a least length: a title may be 'Unknown', a section 'Untitled Section'."""
    root = ElementTree.fromstring(re.sub(r'\sxmlns="[^"]*"', "", decode_text(data), count=1).encode())
    whole = lambda node: squeeze("".join(node.itertext())) if node is not None else ""
    sections = []
    for i, div in enumerate(root.iter("div")):
        if body := "\n".join(filter(None, (whole(p) for p in div.iter("p")))):
            sections.append((whole(div.find("head")) or "Untitled Section", i, body))
    return whole(root.find(".//titleStmt/title")) or "Unknown", ["Unknown Author"], sections


def front_matter(text: str) -> tuple[dict[str, list[str]], str]:
    """Simple keys of a YAML head (scalars, inline and dashed lists) and the rest."""
    found = re.match(r"---\s*\n(.*?)\n---\s*\n?", text, re.DOTALL)
    if not found:
        return {}, text
    values: dict[str, list[str]] = {}
    key = ""
    for line in found[1].split("\n"):
        if pair := re.match(r"(\w+):\s*(.*)", line):
            key, value = pair[1], pair[2].strip()
            values[key] = [x.strip().strip("\"'") for x in value.strip("[]").split(",")] if value.startswith("[") else [value.strip("\"'")] if value else []
        elif key and (item := re.match(r"\s*-\s+(.*)", line)):
            values[key].append(item[1].strip().strip("\"'"))
    return values, text[found.end() :]


def parse_markdown(path: str, data: bytes, least: int = LEAST_CHARS) -> tuple[str, list[str], list[Section]]:
    """Headings outside fenced code start sections; the text before the first one is the introduction."""
    head, body = front_matter(decode_text(data))
    sections: list[tuple[str, list[str]]] = [("Introduction", [])]
    fenced = False
    for line in body.split("\n"):
        heading = None if fenced else re.match(r"#{1,6}\s+(.+)$", line)
        fenced ^= line.count("```") % 2 == 1
        if heading:
            sections.append((heading[1], []))
        else:
            sections[-1][1].append(line)
    kept = [(name, squeeze("\n".join(lines))) for name, lines in sections if lines]
    title = (head.get("title") or [_stem(path)])[0]
    return title, head.get("authors") or ["Unknown"], [(name, i, text) for i, (name, text) in enumerate(kept) if len(text) >= least]


def parse_txt(path: str, data: bytes, least: int = 1, size: int = 2000, overlap: int = 200) -> tuple[str, list[str], list[Section]]:
    """Chunks of paragraphs, each cleaned after it is cut."""
    from tessera.operators.chunking import pack_paragraphs

    parts = [p.strip() for p in re.split(r"\n\s*\n", decode_text(data)) if p.strip()]
    chunks = [squeeze(chunk) for chunk in pack_paragraphs(parts, size, overlap)]
    return _stem(path), ["Unknown"], [(f"Chunk {i + 1}", i, text) for i, text in enumerate(chunks) if len(text) >= least]


def _gathered(blocks: Iterator[tuple[bool, str]], least: int) -> list[Section]:
    """Sections from (is a heading, text) in document order."""
    sections: list[tuple[str, list[str]]] = [("Introduction", [])]
    for is_heading, text in blocks:
        if not text:
            continue
        if is_heading:
            sections.append((text, []))
        else:
            sections[-1][1].append(text)
    kept = [(name, squeeze("\n\n".join(parts))) for name, parts in sections if parts]
    return [(name, i, text) for i, (name, text) in enumerate(kept) if len(text) >= least]


def parse_docx(path: str, data: bytes, least: int = LEAST_CHARS) -> tuple[str, list[str], list[Section]]:
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))

    def blocks() -> Iterator[tuple[bool, str]]:
        for paragraph in root.iter(f"{word}p"):
            style = paragraph.find(f"{word}pPr/{word}pStyle")
            name = (style.get(f"{word}val") or "" if style is not None else "").lower().replace(" ", "")
            yield bool(re.fullmatch(r"heading[123]|見出し[123]|title", name)), "".join(t.text or "" for t in paragraph.iter(f"{word}t")).strip()

    return _stem(path), ["Unknown"], _gathered(blocks(), least)


class _Blocks(HTMLParser):
    """h1, h2, h3 and p in document order; scripts and styles are left out; broken nesting is taken as it comes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.title, self.authors = "", []
        self.open, self.skip, self.parts = "", 0, []
        self.by_rel = False

    def _end(self) -> None:
        text = squeeze("".join(self.parts))
        if self.open == "title":
            self.title = self.title or text
        elif self.open and text:
            self.blocks.append((self.open != "p", text))
        self.open, self.parts = "", []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "p", "title"):
            self._end()
            self.open = tag
        elif tag == "meta" and (own.get("name") or own.get("property") or "").lower() in ("author", "article:author", "og:author", "byline") and (own.get("content") or "").strip():
            self.authors.append(own["content"].strip())
        elif tag == "a" and own.get("rel") == "author":
            self.by_rel = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.open:
            self._end()

    def handle_data(self, data: str) -> None:
        if self.by_rel and data.strip():
            self.authors.append(data.strip())
            self.by_rel = False
        if self.open and not self.skip:
            self.parts.append(data)


def parse_html(path: str, data: bytes, least: int = LEAST_CHARS) -> tuple[str, list[str], list[Section]]:
    parser = _Blocks()
    parser.feed(decode_text(data))
    parser.close()
    parser._end()
    return parser.title or _stem(path), parser.authors[:1] or ["Unknown"], _gathered(iter(parser.blocks), least)


PARSERS: dict[str, Callable[[str, bytes], tuple[str, list[str], list[Section]]]] = {"tei": parse_tei, "markdown": parse_markdown, "txt": parse_txt, "docx": parse_docx, "html": parse_html}


def parse_files(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """A row for each section of (path, content, format); a row with status 'failed' or 'skipped' for a file that gave none.

    ``parsers`` adds or replaces formats, such as a client of a PDF service."""
    known = PARSERS | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content, kind in zip(batch["path"], batch["content"], batch["format"], strict=True):
                if kind not in known:
                    rows.append((path, "skipped", f"no parser for {kind}", None, None, None, None, kind, None))
                    continue
                try:
                    title, authors, sections = known[kind](path, bytes(content))
                except Exception as error:  # a bad file mustn't end the job
                    rows.append((path, "failed", f"{type(error).__name__}: {error}", None, None, None, None, kind, None))
                    continue
                rows += [(path, "success", None, title, ", ".join(authors), name, i, kind, text) for name, i, text in sections] or [(path, "skipped", "no section", title, ", ".join(authors), None, None, kind, None)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SECTION.split(", ")]).astype({"section_index": "Int32"})

    return files.select("path", "content", "format").mapInPandas(run, SECTION)


def with_tei(pdfs: DataFrame, cache: DataFrame, service: Callable[[bytes], str], attempts: int = 3, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """PDF files (path, content, file_hash) with the TEI (tei) that a service makes of them, and what the cache (file_hash, tei) lacked.

    Known bytes aren't sent again and equal files are sent once; a call that fails is tried again
    after twice the wait, and gives null in the end."""
    from tessera.operators.models import with_retries

    call = with_retries(service, None, attempts, wait)

    @F.pandas_udf("string")
    def ask(contents: pd.Series) -> pd.Series:
        return pd.Series([call(bytes(x)) for x in contents], dtype="object")

    first = pdfs.join(cache.select("file_hash"), "file_hash", "left_anti").dropDuplicates(["file_hash"])
    new = first.select("file_hash", ask("content").alias("tei")).where("tei is not null")
    return pdfs.join(cache.select("file_hash", "tei").unionByName(new), "file_hash", "left"), new


def ingest(spark: SparkSession, root: str, glob: str = "*", known_hashes: DataFrame | None = None) -> DataFrame:
    """Parses every file of a tree whose bytes aren't known yet, each distinct content once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    files = files.withColumns({"file_hash": F.sha2("content", 256), "format": detect_format(F.col("path"), F.col("content"))})
    first = files.groupBy("file_hash").agg(F.min("path").alias("path"))
    fresh = files.join(first, ["file_hash", "path"], "left_semi")
    if known_hashes is not None:
        fresh = fresh.join(known_hashes.select("file_hash").distinct(), "file_hash", "left_anti")
    return parse_files(fresh)


def html_sections(pages: DataFrame) -> DataFrame:
    """Sections of (page_id, html)."""
    return parse_files(pages.select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"), F.lit("html").alias("format")))
