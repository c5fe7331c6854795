"""A small writer of xlsx workbooks for report tables that fit on a sheet."""

from __future__ import annotations

import unicodedata
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

#: Style numbers of the workbook; every kind of cell has a plain and a banded style.
PLAIN, TITLE, HEADER, WHOLE, REAL, PERCENT, BAND = range(7)


@dataclass(frozen=True)
class FormatConfig:
    """How a workbook looks: fonts, number formats, colours (RRGGBB), gaps, and which columns are shares or get bars."""

    font: str = "Calibri"
    title_size: int = 12
    data_size: int = 10
    real: str = "#,##0.0000"
    whole: str = "#,##0"
    percent: str = "0.00%"
    header_fill: str = "D9E1F2"
    header_font: str = "000000"
    bands: bool = True
    band_fill: str = "F2F7FB"
    gap: int = 1
    percent_words: tuple[str, ...] = ("rate", "pct", "ratio", "percent")
    bar_words: tuple[str, ...] = ("rate", "pct", "ratio", "percent", "lift")
    bar_color: str = "9BC2E6"
    frozen_rows: int = 2

    def is_percent(self, name: str) -> bool:
        return any(x in name.lower() for x in self.percent_words)

    def has_bar(self, name: str) -> bool:
        return any(x in name.lower() for x in self.bar_words)

    def styles(self) -> str:
        """The style table: first PLAIN to PERCENT, then the banded PLAIN, WHOLE, REAL and PERCENT."""
        font = lambda size, color, bold="": f'<font>{bold}<sz val="{size}"/><color rgb="FF{color}"/><name val="{escape(self.font, {chr(34): "&quot;"})}"/></font>'
        fill = lambda color: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{color}"/></patternFill></fill>'
        form = lambda i, text: f'<numFmt numFmtId="{i}" formatCode="{escape(text, {chr(34): "&quot;"})}"/>'
        cell = lambda number, band: f'<xf numFmtId="{number}" fontId="0"{" fillId=" + chr(34) + "3" + chr(34) + " applyFill=" + chr(34) + "1" + chr(34) if band else ""} applyNumberFormat="1"/>'
        cells = [cell(0, False), '<xf fontId="1" applyFont="1"/>', '<xf fontId="2" fillId="2" applyFont="1" applyFill="1"/>', *[cell(n, False) for n in (165, 164, 166)], *[cell(n, self.bands) for n in (0, 165, 164, 166)]]
        return (
            '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            f'<numFmts count="3">{form(164, self.real)}{form(165, self.whole)}{form(166, self.percent)}</numFmts>'
            f'<fonts count="3">{font(self.data_size, "000000")}{font(self.title_size, "000000", "<b/>")}{font(self.data_size, self.header_font, "<b/>")}</fonts>'
            f'<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill(self.header_fill)}{fill(self.band_fill)}</fills>'
            f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(cells)}">{"".join(cells)}</cellXfs></styleSheet>'
        )


def width(text: str) -> int:
    """Wide characters count twice."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def column_name(k: int) -> str:
    out = ""
    while k >= 0:
        k, r = divmod(k, 26)
        out, k = chr(65 + r) + out, k - 1
    return out


class Workbook:
    def __init__(self, style: FormatConfig = FormatConfig()) -> None:  # noqa: B008 - it cannot change
        self.style = style
        self.sheets: dict[str, list[list[tuple[object, int]]]] = {}
        self.bars: dict[str, list[str]] = {}

    def sheet(self, name: str) -> str:
        """Begin a sheet; its name, with a suffix _1, _2 and so on where the name is taken."""
        base, name, k = name[:28], name[:31], 0
        while name in self.sheets:
            k += 1
            name = f"{base}_{k}"
        self.sheets[name] = []
        return name

    def add(self, sheet: str, title: str, header: Sequence[str], rows: Sequence[Sequence[object]], note: str = "") -> None:
        """Put a table below those of a sheet, which is begun if it is not there."""
        sheet = sheet if sheet in self.sheets else self.sheet(sheet)
        out = self.sheets[sheet]
        if out:
            out.extend([] for _ in range(self.style.gap))
        out.append([(title, TITLE)])
        if note:
            out.append([(note, PLAIN)])
        out.append([(h, HEADER) for h in header])
        first = len(out) + 1
        for k, r in enumerate(rows):
            out.append([(v, self._style(h, v, k)) for h, v in zip(header, r, strict=True)])
        self.bars.setdefault(sheet, []).extend(f"{column_name(i)}{first}:{column_name(i)}{len(out)}" for i, h in enumerate(header) if rows and self.style.has_bar(h))

    def _style(self, name: str, value: object, row: int) -> int:
        kind = PLAIN
        if isinstance(value, float):
            kind = PERCENT if self.style.is_percent(name) else REAL
        elif isinstance(value, int) and not isinstance(value, bool):
            kind = WHOLE
        return BAND + (PLAIN, WHOLE, REAL, PERCENT).index(kind) if row % 2 else kind

    @staticmethod
    def _cell(at: str, value: object, style: int) -> str:
        if value is None or isinstance(value, float) and value != value:
            return f'<c r="{at}" s="{style}"/>'
        if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) != float("inf"):
            return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>'
        text = escape("".join(c for c in str(value) if c >= " " or c in "\t\n"))
        return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    def _sheet(self, name: str) -> str:
        rows = self.sheets[name]
        widths: dict[int, int] = {}
        for r in rows:
            for i, (v, style) in enumerate(r):
                if style != TITLE:
                    widths[i] = min(60, max(widths.get(i, 8), width("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) + 2))
        cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in sorted(widths.items()))
        body = "".join(f'<row r="{k}">' + "".join(self._cell(f"{column_name(i)}{k}", v, s) for i, (v, s) in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
        bars = "".join(f'<conditionalFormatting sqref="{ref}"><cfRule type="dataBar" priority="{k}"><dataBar><cfvo type="min"/><cfvo type="max"/><color rgb="FF{self.style.bar_color}"/></dataBar></cfRule></conditionalFormatting>' for k, ref in enumerate(self.bars.get(name, ()), 1))
        n = self.style.frozen_rows
        pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{n}" topLeftCell="A{n + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if n else ""
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{pane}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{body}</sheetData>{bars}</worksheet>'

    def save(self, path: str) -> None:
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        names = list(self.sheets) or ["Sheet1"]
        self.sheets.setdefault(names[0], [])
        n = range(1, len(names) + 1)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, x in zip(n, names, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="rs" Type="{office}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": self.style.styles(),
        }
        parts |= {f"xl/worksheets/sheet{i}.xml": self._sheet(x) for i, x in zip(n, names, strict=True)}
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
