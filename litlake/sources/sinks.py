"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites ``path`` in the format of its suffix: .csv (a folder of parts with headers, quotes doubled), .xlsx (one workbook), .json or parquet."""
    if path.endswith(".xlsx"):
        write_excel(df, path)
        return
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        # Blanks at a cell's ends are data, and an empty cell is told from a missing one by its quotes.
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.option("header", True).option("escape", '"').csv(path)
    elif suffix == "json":
        writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    else:
        writer.parquet(path)


#: Rows of a sheet that the format allows, the header among them, and characters of a cell.
SHEET_ROWS, CELL = 1_048_576, 32_767


def write_excel(df: DataFrame, path: str) -> None:
    """One workbook with one sheet of strings; nulls are empty cells.

    A workbook is one file, so one task writes it, row by row; more rows or longer
    cells than the format allows are an error.  All machines must share its folder.
    """
    import os
    import re
    import uuid
    import zipfile
    from collections.abc import Iterator
    from xml.sax.saxutils import escape

    import pandas as pd

    target, names = path.removeprefix("file://").removeprefix("file:"), df.columns
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    fixed = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }

    def column(i: int) -> str:
        return column(i // 26 - 1) + chr(65 + i % 26) if i > 25 else chr(65 + i)

    def line(n: int, values: list[str | None]) -> bytes:
        cells = []
        for i, v in enumerate(values):
            if v is not None:
                if len(v) > CELL:
                    raise ValueError(f"cell {column(i)}{n} has {len(v)} characters")
                # The format writes what XML can't hold, and carriage returns, as _xHHHH_, and what looks so with its first mark escaped.
                text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", v)
                text = "".join(f"_x{ord(c):04X}_" if c < " " and c not in "\t\n" else c for c in text)
                cells.append(f'<c r="{column(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        return f'<row r="{n}">{"".join(cells)}</row>'.encode()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        part, n = f"{target}.{uuid.uuid4().hex}", 1
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in fixed.items():
                book.writestr(name, text)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode() + line(1, names))
                for batch in batches:
                    for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                        n += 1
                        if n > SHEET_ROWS:
                            raise ValueError(f"more than {SHEET_ROWS - 1} rows")
                        sheet.write(line(n, list(row)))
                sheet.write(b"</sheetData></worksheet>")
        os.replace(part, target)
        yield pd.DataFrame({"rows": [n - 1]})

    strings = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    if not strings.coalesce(1).mapInPandas(write, "rows long").collect():  # one row, none where an empty table has no task
        list(write(iter(())))


def write_files(contents: DataFrame, folder: str, name: str = "file", content: str = "content") -> DataFrame:
    """(file, bytes) of the rows of ``contents`` whose content isn't null, each written as a file of ``folder``, which all machines must share.

    A file appears under its name only when it is whole, so a repeated task does no harm.
    """
    import os
    import uuid
    from collections.abc import Iterator

    import pandas as pd

    folder = folder.removeprefix("file://").removeprefix("file:")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for file, data in zip(batch["file"], batch["content"], strict=True):
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, os.path.basename(file)))
                sizes.append(len(data))
            yield pd.DataFrame({"file": batch["file"], "bytes": sizes})

    from litlake.session import cut_lineage

    rows = contents.where(F.col(content).isNotNull()).select(F.col(name).alias("file"), F.col(content).alias("content"))
    return cut_lineage(rows.mapInPandas(run, "file string, bytes long"))


def write_markdown(docs: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """(file, bytes): each row's text as ``name.md`` of ``folder``; null texts are left out."""
    rows = docs.select(F.concat(F.col(name), F.lit(".md")).alias("file"), F.encode(F.col(text), "UTF-8").alias("content"))
    return write_files(rows, folder)


def title_lines(df: DataFrame, template: str = "+ {title} [Paper]({url})", order: str = "pos") -> DataFrame:
    """(order, line): one line per distinct address, the first by ``order``, from rows with title and url."""
    from litlake.operators.tables import keep_first

    parts = template.replace("%", "%%").replace("{title}", "%1$s").replace("{url}", "%2$s")
    rows = df.select(order, "title", "url").dropna(subset=["title", "url"])
    return keep_first(rows, ["url"], order).select(order, F.format_string(parts, "title", "url").alias("line"))


def report_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def preview(df: DataFrame, columns: list[str], rows: int = 5) -> DataFrame:
    """The first rows of a few columns: a report, not a step."""
    return df.select(*columns).limit(rows)
