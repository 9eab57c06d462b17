"""Office files as tables: articles in docx, briefs in xlsx and docx, exported Google Docs JSON, and a docx writer.

Files are read whole by the JVM (binaryFile) and taken apart in Arrow batches with the standard library; nothing else needs
Python. A file that can't be read gives no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import with_offsets

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RUN = "struct<text:string,start:int,end:int,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,highlight:string,hyperlink:string,font:string,size:double>"
LEAF = f"doc_id string, idx long, elem_type string, level int, list_type string, indent int, row int, col int, text string, runs array<{RUN}>"
BULLETS = ("•", "-", "*", "○", "●")


def runs_of(p, links: dict[str, str]) -> list[dict]:
    out, at = [], 0
    linked = {r: links.get(h.get(R + "id") or "") for h in p.iter(W + "hyperlink") for r in h.iter(W + "r")}
    for node in p.iter(W + "r"):
        text = "".join((t.text or "") if t.tag == W + "t" else "\t" for t in node if t.tag in (W + "t", W + "tab"))
        if not text:
            continue
        f = node.find(W + "rPr")
        on = lambda k: f is not None and (x := f.find(W + k)) is not None and x.get(W + "val") not in ("0", "false", "none")
        val = lambda k, a="val": x.get(W + a) if f is not None and (x := f.find(W + k)) is not None else None
        out.append({"text": text, "start": at, "end": at + len(text), "bold": on("b"), "italic": on("i"), "underline": on("u"), "strikethrough": on("strike"), "highlight": val("highlight"), "hyperlink": linked.get(node), "font": val("rFonts", "ascii"), "size": int(val("sz")) / 2 if val("sz") else None})
        at += len(text)
    text = "".join(r["text"] for r in out)
    lead, full = len(text) - len(text.lstrip()), len(text.strip())
    trimmed = []
    for r in out:  # runs follow the trimmed text
        a, b = max(0, r["start"] - lead), min(full, r["end"] - lead)
        if a < b:
            trimmed.append(r | {"text": text.strip()[a:b], "start": a, "end": b})
    return trimmed


def docx_leaves(data: bytes) -> list[dict]:
    """The body's leaves in order: headings, paragraphs (empty ones too), list items and table cells."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
    rels = "word/_rels/document.xml.rels"
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read(rels))} if rels in z.namelist() else {}
    out = []

    def leaf(p, kind=None, **more):
        runs = runs_of(p, links)
        text = "".join(r["text"] for r in runs)
        style = p.find(f"{W}pPr/{W}pStyle")
        name = (style.get(W + "val") or "") if style is not None else ""
        level = 1 if name.lower() == "title" else int(m[1]) if (m := re.match(r"(?i)heading\s*([1-4])$", name)) else None
        number = p.find(f"{W}pPr/{W}numPr")
        if kind is None and level and text:
            kind = "heading"
        elif kind is None and text and (number is not None or text.startswith(BULLETS) or re.match(r"\d+[.)]\s", text)):
            kind = "list_item"
            deep = number.find(W + "ilvl") if number is not None else None
            more |= {"list_type": "ordered" if re.match(r"\d+[.)]\s", text) or "number" in name.lower() else "unordered", "indent": int(deep.get(W + "val") or 0) if deep is not None else 0}
        out.append({"idx": len(out), "elem_type": kind or "paragraph", "level": level if kind == "heading" else None, "list_type": None, "indent": None, "row": None, "col": None, "text": text, "runs": runs} | more)

    for node in body:
        if node.tag == W + "p":
            leaf(node)
        elif node.tag == W + "tbl":
            for r, tr in enumerate(node.iter(W + "tr")):
                for c, tc in enumerate(tr.iter(W + "tc")):
                    ps = tc.findall(W + "p")
                    cell = ET.Element(W + "p")
                    cell.extend([x for p in ps for x in p if x.tag != W + "pPr"])
                    leaf(cell, "table_cell", row=r, col=c)
    return out


def each_file(files: DataFrame, parse, columns: str, key: str) -> DataFrame:
    names = [c.split(" ")[0] for c in re.split(r", (?![^<]*>)", columns)]

    def run(it):
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [{key: path.rsplit("/", 1)[-1]} | x for x in parse(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, columns)


def unreadable(files: DataFrame, parse) -> DataFrame:
    """(path, error) of the files that parse can't read; the readers leave these out."""

    def run(it):
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    parse(bytes(content))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError) as e:
                    rows.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, error string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The elements of docx articles, with runs and offsets."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return with_offsets(each_file(files, docx_leaves, LEAF, "doc_id"))


def text_only(elements: DataFrame) -> DataFrame:
    return elements.select("doc_id", "idx", "text")


def headings_only(elements: DataFrame) -> DataFrame:
    return elements.where("elem_type = 'heading'").select("doc_id", "idx", "level", "text")


def xlsx_cells(data: bytes) -> list[dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
        target = rels[sheet.get(R + "id")]
        for c in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(S + "c"):
            letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
            col = 0
            for ch in letters:
                col = 26 * col + ord(ch) - 64
            v = c.find(S + "v")
            text = "".join(t.text or "" for t in c.iter(S + "t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else re.sub(r"\.0$", "", v.text or "")
            if text:
                out.append({"sheet": sheet.get("name"), "row": int(row), "col": col, "value": text})
    return out


CELL = "brief_id string, sheet string, row int, col int, value string"


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The cells of xlsx briefs: brief_id, sheet, row, col, value."""
    return each_file(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), xlsx_cells, CELL, "brief_id")


def docx_cells(data: bytes) -> list[dict]:
    """Tables of a docx brief as sheets of cells; paragraphs as a sheet of one column."""
    out, table = [], 0
    for x in docx_leaves(data):
        if x["elem_type"] == "table_cell":
            table += x["row"] == 0 and x["col"] == 0
            out.append({"sheet": f"table {table}", "row": x["row"] + 1, "col": x["col"] + 1, "value": x["text"]})
        elif x["text"]:
            out.append({"sheet": "text", "row": x["idx"] + 1, "col": 1, "value": x["text"]})
    return out


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every brief in a folder, whatever its format; the suffix decides."""
    files = spark.read.format("binaryFile").load(path)
    low = F.lower("path")
    return each_file(files.where(low.endswith(".xlsx")), xlsx_cells, CELL, "brief_id").unionByName(each_file(files.where(low.endswith(".docx")), docx_cells, CELL, "brief_id"))


# --- exported Google Docs ---

TEXT_RUN = "struct<content:string,textStyle:struct<bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,link:struct<url:string>,backgroundColor:struct<color:struct<rgbColor:struct<red:double,green:double,blue:double>>>>>"
PARAGRAPH = f"struct<paragraphStyle:struct<namedStyleType:string>,bullet:struct<listId:string,nestingLevel:int>,elements:array<struct<textRun:{TEXT_RUN}>>>"
GDOC = f"struct<documentId:string,title:string,body:struct<content:array<struct<paragraph:{PARAGRAPH},table:struct<tableRows:array<struct<tableCells:array<struct<content:array<struct<paragraph:{PARAGRAPH}>>>>>>>>>>>"


def doc_id_of(url):
    """The id in a document's URL, or the text itself."""
    found = F.regexp_extract(url, r"/d/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found).otherwise(url)


def highlight_name(red, green, blue):
    """A highlight's name from its colour; unknown colours count as yellow, white and none as null."""
    r, g, b = (F.coalesce(c, F.lit(0.0)) for c in (red, green, blue))
    low = lambda c: c < 0.5
    # colours and their bounds: fixed values
    rules = (
        ("yellow", (r > 0.8) & (g > 0.8) & low(b)), ("bright green", low(r) & (g > 0.7) & low(b)), ("turquoise", low(r) & (g > 0.7) & (b > 0.7)), ("pink", (r > 0.7) & low(g) & (b > 0.7)),
        ("red", (r > 0.7) & low(g) & low(b)), ("blue", low(r) & low(g) & (b > 0.7)), ("gray 25", (r > 0.3) & (r < 0.7) & (F.abs(r - g) < 0.2) & (F.abs(g - b) < 0.2)),
    )
    out = F.when((r + g + b == 0) | ((r > 0.95) & (g > 0.95) & (b > 0.95)), None)
    for name, rule in rules:
        out = out.when(rule, name)
    return out.otherwise("yellow")


def read_gdoc(spark: SparkSession, path: str) -> DataFrame:
    """The elements of exported Google Docs, one JSON file each; entirely JVM-side."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", GDOC).alias("d")).where("d.documentId IS NOT NULL")
    parts = raw.select(F.col("d.documentId").alias("doc_id"), F.posexplode("d.body.content").alias("i", "x"))
    line = lambda p: F.array_join(F.transform(p["elements"], lambda e: F.coalesce(e["textRun"]["content"], F.lit(""))), "")
    style = F.col("x.paragraph.paragraphStyle.namedStyleType")
    level = F.when(style == "TITLE", 1).when(style == "SUBTITLE", 2).when(style.rlike("^HEADING_[1-6]$"), F.least(F.substring(style, 9, 1).cast("int"), F.lit(4)))
    own = parts.where("x.paragraph IS NOT NULL").withColumn("text", F.rtrim(F.regexp_replace(line(F.col("x.paragraph")), r"\s+$", "")))
    kind = F.when(level.isNotNull() & (F.col("text") != ""), "heading").when(F.col("x.paragraph.bullet").isNotNull(), "list_item").otherwise("paragraph")
    own = own.select("doc_id", F.array(F.col("i")).alias("at"), kind.alias("elem_type"), F.when(kind == "heading", level).alias("level"), "text")
    cells = parts.where("x.table IS NOT NULL").select("doc_id", "i", F.posexplode("x.table.tableRows").alias("r", "row")).select("doc_id", "i", "r", F.posexplode("row.tableCells").alias("c", "cell"))
    cells = cells.select("doc_id", F.array("i", "r", "c").alias("at"), F.lit("table_cell").alias("elem_type"), F.lit(None).cast("int").alias("level"), F.trim(F.regexp_replace(F.array_join(F.transform("cell.content", lambda p: line(p["paragraph"])), ""), r"\s+$", "")).alias("text"))
    from pyspark.sql import Window

    rows = own.unionByName(cells).withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).cast("long")).drop("at")
    return with_offsets(rows)


# --- writers ---


def docx_bytes(leaves: list[dict], blank_before: set[int] = frozenset()) -> bytes:
    """A docx of leaves (elem_type, level, text, runs, row, col); an empty paragraph before each idx in blank_before."""
    xml, table = [], None

    def paragraph(x: dict) -> str:
        style = f'<w:pPr><w:pStyle w:val="Heading{x["level"]}"/></w:pPr>' if x["elem_type"] == "heading" else '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>' if x["elem_type"] == "list_item" else ""
        runs = x.get("runs") if x.get("runs") is not None and len(x["runs"]) else [{"text": x["text"]}]
        out = []
        for r in runs:
            r = r if isinstance(r, dict) else r.asDict()
            flags = "".join(f"<w:{t}/>" for k, t in (("bold", "b"), ("italic", "i"), ("strikethrough", "strike")) if r.get(k)) + ('<w:u w:val="single"/>' if r.get("underline") else "")
            if r.get("highlight"):
                flags += f'<w:highlight w:val="{re.sub(r" *[(].*", "", r["highlight"])}"/>'
            out.append(f'<w:r><w:rPr>{flags}</w:rPr><w:t xml:space="preserve">{escape(r["text"])}</w:t></w:r>')
        return f"<w:p>{style}{''.join(out)}</w:p>"

    def close():
        nonlocal table
        if table:
            xml.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>")
        table = None

    for x in leaves:
        if x["elem_type"] == "table_cell":
            if x["row"] == 0 and x["col"] == 0:
                close()
            table = table if table is not None else []
            if x["col"] == 0:
                table.append([])
            table[-1].append(paragraph(x))
            continue
        close()
        if x["idx"] in blank_before:
            xml.append("<w:p/>")
        xml.append(paragraph(x))
    close()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (
            ("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
            ("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"><w:body>{"".join(xml)}</w:body></w:document>'),
        ):
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def to_docx(elements: DataFrame, blank: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): each document as the bytes of a docx file. Documents, not the corpus, are held in a task."""
    cols = [c for c in ("idx", "elem_type", "level", "text", "runs", "row", "col") if c in elements.columns]
    docs = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("leaves"))
    gaps = blank.groupBy("doc_id").agg(F.collect_set("idx").alias("gaps")) if blank is not None else docs.select("doc_id", F.array().cast("array<long>").alias("gaps"))
    kind = elements.schema["doc_id"].dataType.simpleString()

    def run(it):
        for pdf in it:
            done = [docx_bytes([{"row": None, "col": None, "level": None} | x for x in leaves], set(g if g is not None else ())) for leaves, g in zip(pdf["leaves"], pdf["gaps"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": done})

    return docs.join(gaps, "doc_id", "left").mapInPandas(run, f"doc_id {kind}, content binary")


def gdoc_requests(elements: DataFrame) -> DataFrame:
    """(doc_id, n, request): the insert and style requests that build a document, last element first, as JSON."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.desc("idx"))
    insert = F.struct(F.struct(F.struct(F.lit(1).alias("index")).alias("location"), F.concat("text", F.lit("\n")).alias("text")).alias("insertText"))
    style = F.struct(F.struct(F.struct(F.lit(1).alias("startIndex"), (F.length("text") + 1).alias("endIndex")).alias("range"), F.struct(F.concat(F.lit("HEADING_"), "level").alias("namedStyleType")).alias("paragraphStyle"), F.lit("namedStyleType").alias("fields")).alias("updateParagraphStyle"))
    both = F.array_compact(F.array(F.to_json(insert), F.when(F.col("elem_type") == "heading", F.to_json(style))))
    rows = elements.withColumn("k", F.row_number().over(w)).select("doc_id", "k", F.posexplode(both).alias("j", "request"))
    return rows.select("doc_id", (F.col("k") * 2 + F.col("j")).alias("n"), "request")


def text_lines(text: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A plain document: one paragraph per line that isn't blank."""
    return text.select(id_col, F.posexplode(F.filter(F.split(text_col, "\n"), lambda x: F.trim(x) != "")).alias("idx", "text"))


