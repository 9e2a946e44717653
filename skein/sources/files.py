"""Reading folders of files into processed documents: (path, type, content, chunks, error).

``chunks`` is an array of (content, type, number, sheet). Kinds of files go by their suffix; a file that can't be parsed leaves its
message in ``error`` and no chunks, and the rest goes on. Office files are ZIP archives of XML and are parsed from the standard
library; PDF needs an optional library and says so in ``error`` where it is missing.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.chunking import transcript

# Suffixes by type.
TYPES = {"txt": "text", "md": "markdown", "csv": "csv", "xlsx": "excel", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "srt": "transcript", "png": "image", "jpg": "image", "jpeg": "image", "wav": "audio", "mp3": "audio", "mp4": "video", "mov": "video"}
SCHEMA = "path string, type string, content string, chunks array<struct<content: string, type: string, number: int, sheet: string>>, error string"
CHUNK = pa.struct([("content", pa.string()), ("type", pa.string()), ("number", pa.int32()), ("sheet", pa.string())])


def file_type(path: Column) -> Column:
    """The type of a file by its suffix, "unsupported" for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), suffix), F.lit("unsupported"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length, type) of the supported files under a folder, hidden ones and those in hidden folders left out. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    plain = F.regexp_replace("path", "^file:/*", "/")
    inside = F.substring(plain, len(root.rstrip("/")) + 1, 1 << 30)
    return files.where(~F.regexp_like(inside, F.lit(r"/\."))).select(plain.alias("path"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"), "length", file_type(F.col("path")).alias("type")).where("type <> 'unsupported'")


def headed(text: str) -> list[str]:
    """Pieces from each line that begins with "#" to the next, blank ones dropped."""
    out: list[list[str]] = []
    for line in text.split("\n"):
        if not out or line.strip().startswith("#"):
            out.append([])
        out[-1].append(line)
    return [p for x in out if (p := "\n".join(x)).strip()]


def parse_text(data: bytes) -> tuple[str, list[tuple]]:
    text = data.decode("utf-8")
    return text, [(c, "text", None, None) for c in headed(text)]


def parse_transcript(data: bytes) -> tuple[str, list[tuple]]:
    text = data.decode("utf-8")
    spoken = " ".join(x for x in text.splitlines() if x.strip() and not re.fullmatch(r"\d+|[\d:,.]+ --> [\d:,.]+", x.strip()))
    return spoken, [(c, "transcript", None, None) for c in transcript(spoken, 500)]


def parse_csv(data: bytes) -> tuple[str, list[tuple]]:
    """A chunk for each row that isn't blank, "header: value" of its cells that aren't; cells beyond the header are left out."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"))))
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return "", []
    head = rows[0]
    chunks = [(t, "csv_row", None, None) for r in rows[1:] if (t := " | ".join(f"{h}: {v}" for h, v in zip(head, r, strict=False) if v.strip()))]
    shown = "\n".join(f"Row {i}: {' | '.join(r)}" for i, r in enumerate(rows[:10], 1))
    return f"Columns: {', '.join(head)}\nTotal rows: {len(rows) - 1}\n{shown}", chunks


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(z.read(name))


def _texts(e: ET.Element, tag: str) -> str:
    return "".join(x.text or "" for x in e.iter() if x.tag.endswith("}" + tag))


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that a part of an office file refers to, by relationship id and by kind."""
    folder, _, name = part.rpartition("/")
    if f"{folder}/_rels/{name}.rels" not in z.namelist():
        return {}
    out = {}
    for e in _xml(z, f"{folder}/_rels/{name}.rels"):
        target = e.attrib["Target"]
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        out[e.attrib["Id"]] = out[e.attrib.get("Type", "").rpartition("/")[2]] = path
    return out


def parse_docx(data: bytes) -> tuple[str, list[tuple]]:
    """A chunk for each paragraph that isn't blank, and for each table row, its cells joined with " | "."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in _xml(z, "word/document.xml") if e.tag.endswith("}body"))
    chunks: list[tuple] = []
    for e in body:
        if e.tag.endswith("}p") and (t := _texts(e, "t").strip()):
            chunks.append((t, "text", None, None))
        elif e.tag.endswith("}tbl"):
            for row in (x for x in e if x.tag.endswith("}tr")):
                cells = [_texts(c, "t").strip() for c in row if c.tag.endswith("}tc")]
                if any(cells):
                    chunks.append((" | ".join(cells), "table_row", None, None))
    return "\n".join(c[0] for c in chunks), chunks


def parse_pptx(data: bytes, slides: set[int] | None = None) -> tuple[str, list[tuple]]:
    """A chunk for each slide that has text, with its tables and speaker notes, "SLIDE n:" above each in the content; of given ``slides`` only, if any."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {int(m[1]): n for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
        chunks = []
        for number in sorted(names if slides is None else names.keys() & slides):
            root = _xml(z, names[number])
            lines = []
            for frame in root.iter():
                if frame.tag.endswith("}txBody"):
                    lines += [t for p in frame if p.tag.endswith("}p") and (t := _texts(p, "t").strip())]
                elif frame.tag.endswith("}tbl"):
                    rows = [" | ".join(_texts(c, "t").strip() for c in r if c.tag.endswith("}tc")) for r in frame if r.tag.endswith("}tr")]
                    lines += ["[Table]", *rows]
            notes = _targets(z, names[number]).get("notesSlide", f"ppt/notesSlides/notesSlide{number}.xml")
            if notes in z.namelist() and (t := _texts(_xml(z, notes), "t").strip()):
                lines.append(f"[Speaker Notes] {t}")
            if lines:
                chunks.append(("\n".join(lines), "text", number, None))
    return "\n\n".join(f"SLIDE {c[2]}:\n{c[0]}" for c in chunks), chunks


def parse_xlsx(data: bytes, shown: int = 20) -> tuple[str, list[tuple]]:
    """A chunk for each row of each sheet with "[Sheet: s]" and its cells that aren't blank; the content lists the first rows of each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_texts(e, "t") for e in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = [e.attrib for e in _xml(z, "xl/workbook.xml").iter() if e.tag.endswith("}sheet")]
        targets = _targets(z, "xl/workbook.xml")
        chunks, parts = [], []
        for i, sheet in enumerate(sheets, 1):
            title, rows = sheet["name"], []
            name = targets.get(next((v for k, v in sheet.items() if k.endswith("}id")), None), f"xl/worksheets/sheet{i}.xml")
            for row in (e for e in _xml(z, name).iter() if e.tag.endswith("}row")):
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c if x.tag.endswith("}v")), "") or _texts(c, "t")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
                if any(x.strip() for x in cells):
                    rows.append(" | ".join(x for x in cells if x.strip()))
            chunks += [(f"[Sheet: {title}] {r}", "excel_row", None, title) for r in rows]
            more = f"\n… ({len(rows) - shown} more rows)" if len(rows) > shown else ""
            parts.append(f"[Sheet: {title}]\n" + "\n".join(rows[:shown]) + more)
    return "\n\n".join(parts), chunks


def parse_pdf(data: bytes) -> tuple[str, list[tuple]]:
    """A chunk for each page that isn't blank."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional library pypdf") from e
    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    chunks = [(t, "text", i, None) for i, t in enumerate(pages, 1) if t]
    return "\n\n".join(c[0] for c in chunks), chunks


PARSERS = {"text": parse_text, "markdown": parse_text, "csv": parse_csv, "excel": parse_xlsx, "docx": parse_docx, "pptx": parse_pptx, "pdf": parse_pdf, "transcript": parse_transcript}


def process(spark: SparkSession, root: str) -> DataFrame:
    """The processed documents of all files under a folder, those of other types as "unsupported" without chunks. Each file is parsed by one task; files of several MB should be split before."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^file:/*", "/")
    hidden = F.regexp_like(F.substring(plain, len(root.rstrip("/")) + 1, 1 << 30), F.lit(r"/\."))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, chunks, error = None, [], None
                if kind in PARSERS:
                    try:
                        text, chunks = PARSERS[kind](data)
                    except Exception as e:  # noqa: BLE001  one broken file must not end the job
                        error = f"{type(e).__name__}: {e}"
                out.append((path, kind, text, [dict(zip(("content", "type", "number", "sheet"), c, strict=True)) for c in chunks], error))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.list_(CHUNK), pa.string()))], names=["path", "type", "content", "chunks", "error"])

    return files.where(~hidden).select(plain.alias("path"), file_type(F.col("path")).alias("type"), "content").mapInArrow(run, SCHEMA)


def chunks(processed: DataFrame) -> DataFrame:
    """(path, chunk_no, content, type, number, sheet): one row a chunk that isn't blank."""
    rows = processed.select("path", F.posexplode("chunks").alias("n", "c"))
    return rows.select("path", (F.col("n") + 1).alias("chunk_no"), "c.content", "c.type", "c.number", "c.sheet").where(F.trim("content") != "")
