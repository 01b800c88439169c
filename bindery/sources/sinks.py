"""Books as files: EPUB archives, and rows as JSON or YAML."""

from __future__ import annotations

import io
import json
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTAINER = """<?xml version="1.0" encoding="UTF-8"?>
<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>
<rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>
"""
_PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body>
{body}</body></html>
"""

_SMIL = """<?xml version="1.0" encoding="UTF-8"?>
<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops" version="3.0"><body>
<seq id="seq1" epub:textref="{chapter}.xhtml">
{lines}
</seq></body></smil>
"""


def _clock(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def nested(chapters: list[dict]) -> list[tuple[dict, list[dict]]]:
    """Chapters for navigation: a part of the first level holds the deeper ones that follow it, all others stand alone."""
    out: list[tuple[dict, list[dict]]] = []
    open_ = False
    for c in chapters:
        if open_ and (c.get("level") or 0) > 1:
            out[-1][1].append(c)
        else:
            out.append((c, []))
            open_ = c.get("level") == 1 and c.get("level_name") == "part"
    return out


def smil(chapter: str, audio: str, segments: list[dict]) -> str:
    """The overlay of a chapter: each paragraph with its stretch of the audio file. ``segments`` have ``paragraph_idx, start_offset_ms,
    duration_ms``."""
    lines = []
    for x in segments:
        begin, end = x["start_offset_ms"] / 1000, (x["start_offset_ms"] + (x["duration_ms"] or 0)) / 1000
        n = x["paragraph_idx"]
        lines.append(f'<par id="par{n}"><text src="{chapter}.xhtml#p{n}"/><audio src="{escape(audio)}" clipBegin="{begin:.3f}s" clipEnd="{end:.3f}s"/></par>')
    return _SMIL.format(chapter=chapter, lines="\n".join(lines))


def epub(
    title: str, author: str, identifier: str, chapters: list[dict], language: str = "", modified: str = "", narrator: str = "", cover: bytes | None = None
) -> bytes:
    """An EPUB archive of chapters in order (``id``, ``title``, ``body`` as XHTML, ``level`` and ``level_name`` for navigation, perhaps
    ``segments`` and ``audio`` as bytes for an overlay). The language is en and the date of change 2000 where they aren't known;
    the same input gives the same bytes."""
    items, spine, points, meta = [], [], [], []
    out = io.BytesIO()

    def put(z: zipfile.ZipFile, name: str, data: str | bytes, kind: int = zipfile.ZIP_DEFLATED) -> None:
        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, kind)

    def entry(c: dict, below: str = "") -> str:
        return f'<li><a href="{c["id"]}.xhtml">{escape(c["title"] or "")}</a>{below}</li>'

    total = 0
    with zipfile.ZipFile(out, "w") as z:
        put(z, "mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put(z, "META-INF/container.xml", _CONTAINER)
        for i, c in enumerate(chapters, 1):
            name, head, segments = f"{c['id']}.xhtml", escape(c["title"] or ""), c.get("segments")
            overlay = f' media-overlay="{c["id"]}_smil"' if segments else ""
            items.append(f'<item id="{c["id"]}" href="{name}" media-type="application/xhtml+xml"{overlay}/>')
            if segments:
                own = max(x["start_offset_ms"] + (x["duration_ms"] or 0) for x in segments)
                total += own
                items.append(f'<item id="{c["id"]}_smil" href="{c["id"]}.smil" media-type="application/smil+xml"/>')
                meta.append(f'<meta property="media:duration" refines="#{c["id"]}_smil">{_clock(own)}</meta>')
                put(z, f"OEBPS/{c['id']}.smil", smil(c["id"], f"{c['id']}.mp3", segments))
                if c.get("audio"):
                    items.append(f'<item id="{c["id"]}_audio" href="{c["id"]}.mp3" media-type="audio/mpeg"/>')
                    put(z, f"OEBPS/{c['id']}.mp3", c["audio"], zipfile.ZIP_STORED)
            spine.append(f'<itemref idref="{c["id"]}"/>')
            points.append(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{head}</text></navLabel><content src="{name}"/></navPoint>')
            put(z, f"OEBPS/{name}", _PAGE.format(title=head, body=c["body"]))
        if cover:
            items.append('<item id="cover" href="cover.jpg" media-type="image/jpeg" properties="cover-image"/>')
            put(z, "OEBPS/cover.jpg", cover, zipfile.ZIP_STORED)
        items += [
            '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>',
            '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>',
            '<item id="css" href="style.css" media-type="text/css"/>',
        ]
        nav = "".join(entry(c, f'<ol>{"".join(map(entry, below))}</ol>' if below else "") for c, below in nested(chapters))
        put(z, "OEBPS/nav.xhtml", _PAGE.format(title="Contents", body=f'<nav epub:type="toc"><ol>{nav}</ol></nav>'))
        put(z, "OEBPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{escape(title)}</text></docTitle><navMap>{"".join(points)}</navMap></ncx>')
        put(z, "OEBPS/style.css", "body { margin: 1em; line-height: 1.4; }\n")
        core = f'<dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator>'
        core += f'<dc:language>{escape(language or "en")}</dc:language><meta property="dcterms:modified">{escape(modified or "2000-01-01T00:00:00Z")}</meta>'
        if total:
            meta.append(f'<meta property="media:duration">{_clock(total)}</meta>')
            meta += [f'<meta property="media:narrator">{escape(narrator)}</meta>'] * bool(narrator)
        put(
            z,
            "OEBPS/content.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{core}{"".join(meta)}</metadata>'
            f'<manifest>{"".join(items)}</manifest><spine toc="ncx">{"".join(spine)}</spine></package>',
        )
    return out.getvalue()


def epubs(books: DataFrame) -> DataFrame:
    """``book_id, archive binary`` of each row of ``books(book_id, title, author, language, modified, chapters)``, with chapters as
    an ordered array of structs as ``epub`` takes them. Archives are made where the rows are, one book at a time."""

    @F.pandas_udf("binary")
    def build(ids: pd.Series, titles: pd.Series, authors: pd.Series, languages: pd.Series, modified: pd.Series, chapters: pd.Series) -> pd.Series:
        def plain(c) -> dict:
            c = dict(c)
            if c.get("segments") is not None:
                c["segments"] = [dict(x) for x in c["segments"]]
            return c

        rows = zip(ids, titles, authors, languages, modified, chapters)
        return pd.Series([epub(t or "", a or "", i, [plain(c) for c in own], lang or "", m or "") for i, t, a, lang, m, own in rows], dtype=object)

    return books.select("book_id", build("book_id", "title", "author", "language", "modified", "chapters").alias("archive"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def show(rows: list[dict], form: str = "json") -> str:
    """A few rows for a reader, as JSON or, where it is installed, YAML."""
    if form == "json":
        return json.dumps(rows, indent=2, default=str, ensure_ascii=False)
    if form == "yaml":
        try:
            import yaml

            return yaml.safe_dump(rows, sort_keys=False, allow_unicode=True)
        except ImportError:
            return "".join("- " + "\n  ".join(f"{k}: {json.dumps(v, default=str, ensure_ascii=False)}" for k, v in r.items()) + "\n" for r in rows)
    raise ValueError(f"no such form: {form}")
