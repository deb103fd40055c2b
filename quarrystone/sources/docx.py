"""DOCX files: blocks of text with nested tables, formulas and pictures, and the pictures themselves as files."""

from __future__ import annotations

import hashlib
import io
import mimetypes
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.sources.formulas import Node, formula, name

MAIN = "word/document.xml"
# What stands for an embedded equation object, and the mark and name of a picture.
EQUATION = " 【公式对象】 "
PICTURE = " [[asset:{}]] "
PICTURE_ID = "image-{:03d}"
BREAKS = {"tab": "\t", "br": "\n", "cr": "\n"}
READ = {"t", "delText", "instrText"}


@dataclass
class Picture:
    """A picture of a document, numbered by its first place in the text."""

    asset_id: str
    filename: str
    content_type: str
    title: str | None
    description: str | None
    content: bytes


def attribute(node: Node, wanted: str) -> str | None:
    """An attribute by its local name; an empty one counts as none."""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == wanted and v), None)


def tidy(text: str) -> str:
    """Hard spaces become plain ones, blanks around line ends go, and no more than one line stays empty in a row."""
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", text.replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@dataclass
class Document:
    """One opened file: its parts, the targets of its relations and the pictures met so far."""

    parts: zipfile.ZipFile
    targets: dict[str, str] = field(default_factory=dict)
    pictures: dict[str, Picture] = field(default_factory=dict)

    def __post_init__(self) -> None:
        """Relations name parts of the archive; a file without readable ones has none."""
        try:
            relations = ElementTree.fromstring(self.parts.read("word/_rels/document.xml.rels"))
        except (KeyError, ElementTree.ParseError):
            return
        for node in relations:
            key, target = node.get("Id"), node.get("Target")
            if name(node) == "Relationship" and key and target:
                self.targets[key] = posixpath.normpath(posixpath.join("/word", target)).lstrip("/")

    def blocks(self, parent: Node) -> list[str]:
        """The children of a body or a cell that say something, one text each."""
        said = (self.table(c) if name(c) == "tbl" else self.text(c) for c in parent)
        return [t for t in map(tidy, said) if t]

    def table(self, node: Node) -> str:
        """Rows as lines, cells between bars; a cell's blocks, tables among them, are lines of it. Empty cells and rows go."""
        rows = ([t for t in ("\n".join(self.blocks(cell)) for cell in row if name(cell) == "tc") if t] for row in node if name(row) == "tr")
        return "\n".join(" | ".join(cells) for cells in rows if cells)

    def text(self, node: Node) -> str:
        """What a node says: letters, breaks, formulas as LaTeX, marks of pictures and objects; else what stands in it."""
        kind = name(node)
        if kind in ("oMath", "oMathPara"):
            return formula(node)
        if kind == "object":
            return EQUATION
        if kind in ("drawing", "pict"):
            found = self.picture(node)
            return PICTURE.format(found.asset_id) if found else ""
        if kind in READ:
            return node.text or ""
        if kind in BREAKS:
            return BREAKS[kind]
        between = [node.text or "", *(t for c in node for t in (self.text(c), c.tail or ""))]
        return "".join(t for i, t in enumerate(between) if i % 2 or t.strip())

    def picture(self, node: Node) -> Picture | None:
        """The picture that a drawing shows; one shown twice keeps its number, one without bytes in the archive is none."""
        inner = list(node.iter())
        keys = (attribute(n, "embed") or attribute(n, "link") if name(n) == "blip" else attribute(n, "id") if name(n) == "imagedata" else None for n in inner)
        key = next((k for k in keys if k), None)
        if key is None or key in self.pictures:
            return self.pictures.get(key)
        target = self.targets.get(key)
        if target is None or target not in self.parts.NameToInfo:
            return None
        asset_id = PICTURE_ID.format(len(self.pictures) + 1)
        filename = asset_id + (posixpath.splitext(target)[1] or ".bin")
        about = next((n for n in inner if name(n) == "docPr"), None)
        title, description = (None, None) if about is None else (attribute(about, "title") or attribute(about, "name"), attribute(about, "descr"))
        kind = mimetypes.guess_type(filename)[0] or "application/octet-stream"
        self.pictures[key] = Picture(asset_id, filename, kind, title, description, self.parts.read(target))
        return self.pictures[key]


def opened(content: bytes) -> tuple[list[str], list[Picture]]:
    """Blocks and pictures of a file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        document = Document(parts)
        body = next((n for n in ElementTree.fromstring(parts.read(MAIN)).iter() if name(n) == "body"), None)
        blocks = [] if body is None else document.blocks(body)
        return blocks, list(document.pictures.values())


PARSED = "path string, blocks array<string>, assets array<struct<asset_id:string,filename:string,content_type:string,title:string,description:string,content:binary>>, error string"


def parsed(files: DataFrame) -> DataFrame:
    """path, blocks, assets and error of each file of ``files`` (path, content; other columns are left).

    A file that is null or cannot be read is a row with the name of its error,
    without blocks; one without a body has no blocks. A file is one task's to
    read and lies in its memory.
    """
    asset = pa.struct([(c, pa.binary() if c == "content" else pa.string()) for c in ("asset_id", "filename", "content_type", "title", "description", "content")])
    schema = pa.schema([("path", pa.string()), ("blocks", pa.list_(pa.string())), ("assets", pa.list_(asset)), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row: dict[str, object] = {"path": path, "blocks": [], "assets": [], "error": None}
                try:
                    row["blocks"], pictures = opened(content.as_py() or b"")
                    row["assets"] = [vars(p) for p in pictures]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    row["error"] = type(e).__name__
                yield pa.RecordBatch.from_pylist([row], schema)

    return files.select("path", "content").mapInArrow(read, PARSED)


def blocks(read: DataFrame) -> DataFrame:
    """path, block_no, text and error: a row for each block, and one for each file that cannot be read."""
    lines = read.select("path", "error", F.posexplode_outer("blocks").alias("block_no", "text"))
    return lines.where(F.col("error").isNotNull() | F.col("block_no").isNotNull()).select("path", "block_no", "text", "error")


def assets(read: DataFrame) -> DataFrame:
    """path and the columns of each picture, its bytes in ``content``."""
    return read.select("path", F.explode("assets").alias("a")).select("path", "a.*")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the files under a path."""
    return blocks(parsed(spark.read.format("binaryFile").load(path)))


def write_assets(found: DataFrame, folder: str) -> DataFrame:
    """Write pictures as files of a shared folder; rows without ``content`` but with ``storage_path`` and ``n_bytes``.

    A file's name is the hash of its bytes, so that attempts that run twice, or
    at once, write the same file, and equal pictures are stored once. Bytes go
    to a name of their own first and are then moved, so no half-written file
    has a final name. What is referenced are the rows returned: write them as
    the manifest. They are computed when they are read, and reading them again
    writes the same files. Pictures of null bytes have no file: both columns
    are null.
    """
    at = found.columns.index("content")
    suffix_at = found.columns.index("filename")
    left = [c for c in found.columns if c not in ("content", "storage_path", "n_bytes")]
    kept_at = [found.columns.index(c) for c in left]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            paths: list[str | None] = []
            sizes: list[int | None] = []
            for value, filename in zip(batch.column(at), batch.column(suffix_at).to_pylist(), strict=True):
                content = value.as_py()
                paths.append(None if content is None else f"{base}/{hashlib.sha256(content).hexdigest()}{posixpath.splitext(filename or '')[1]}")
                sizes.append(None if content is None else len(content))
                if content is None or system.get_file_info(paths[-1]).type == fs.FileType.File:
                    continue
                draft = f"{base}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(content)
                system.move(draft, paths[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept_at), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=[*left, "storage_path", "n_bytes"])

    kinds = dict(found.dtypes)
    return found.mapInArrow(write, ", ".join(f"`{c}` {kinds[c]}" for c in left) + ", storage_path string, n_bytes long")
