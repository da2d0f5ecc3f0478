"""Word packages with the standard library alone: paragraph texts out, replacements in, everything else untouched."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from posixpath import dirname, join, normpath
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
BODY = "word/document.xml"
BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}
Edit = tuple[int, int, str]


def _text(run: ET.Element) -> str:
    return "".join(e.text or "" if e.tag == W + "t" else BREAKS.get(e.tag, "") for e in run)


def _set(run: ET.Element, text: str) -> None:
    for e in [e for e in run if e.tag == W + "t" or e.tag in BREAKS]:
        run.remove(e)
    for piece in re.findall(r"[\n\t]|[^\n\t]+", text):
        if piece in "\n\t":
            ET.SubElement(run, W + ("br" if piece == "\n" else "tab"))
        else:
            ET.SubElement(run, W + "t", {SPACE: "preserve"}).text = piece


def _runs(e: ET.Element) -> Iterator[ET.Element]:
    """The runs of a paragraph, those in links too; paragraphs of a text box inside a run are paragraphs of their own."""
    for child in e:
        if child.tag == W + "r":
            yield child
        elif child.tag != W + "p":
            yield from _runs(child)


class Package:
    """A package's XML parts with text, each parsed once, and its paragraphs in reading order."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.parts: dict[str, tuple[ET.Element, dict[str, str]]] = {}
        self.paragraphs = list(self._walk())

    def _part(self, name: str) -> ET.Element:
        if name not in self.parts:
            prefixes, root = {}, None
            for event, x in ET.iterparse(io.BytesIO(self.zip.read(name)), ("start-ns", "start")):
                if event == "start-ns":
                    prefixes.setdefault(*x)
                elif root is None:
                    root = x
            self.parts[name] = root, prefixes
        return self.parts[name][0]

    def _walk(self) -> Iterator[ET.Element]:
        """Body paragraphs, then those of tables, then headers and footers of each section; each once."""
        body, seen = self._part(BODY).find(W + "body"), set()
        groups = [[p for p in body if p.tag == W + "p"], body.iter(W + "p")]
        for section in self._part(BODY).iter(W + "sectPr"):
            refs = {(e.tag.removeprefix(W), e.get(W + "type", "default")): e.get(R + "id") for e in section}
            for kind in ("default", "even", "first"):
                for tag in ("headerReference", "footerReference"):
                    target = self._targets().get(refs.get((tag, kind)))
                    if target:
                        groups.append(self._part(target).iter(W + "p"))
        for p in (p for g in groups for p in g):
            if id(p) not in seen:
                seen.add(id(p))
                yield p

    def _targets(self) -> dict[str, str]:
        rels = "word/_rels/document.xml.rels"
        if rels not in self.zip.namelist():
            return {}
        found = {e.get("Id"): e.get("Target") for e in ET.fromstring(self.zip.read(rels)) if e.get("TargetMode") != "External"}
        return {i: t.lstrip("/") if t.startswith("/") else normpath(join(dirname(BODY), t)) for i, t in found.items()}

    def texts(self) -> list[str]:
        return ["".join(map(_text, _runs(p))) for p in self.paragraphs]

    def edit(self, number: int, edits: list[Edit]) -> None:
        """Replaces spans of a paragraph: the first run that a span touches takes all the new text, the others lose theirs."""
        runs = list(_runs(self.paragraphs[number]))
        for start, end, new in sorted(edits, reverse=True):
            at = 0
            for run in runs:
                old = _text(run)
                a, b = max(start - at, 0), min(end - at, len(old))
                if a < b:
                    _set(run, old[:a] + new + old[b:])
                    new = ""
                at += len(old)

    def save(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for item in self.zip.infolist():
                z.writestr(item, self._serial(item.filename) if item.filename in self.parts else self.zip.read(item))
        return out.getvalue()

    def _serial(self, name: str) -> bytes:
        root, prefixes = self.parts[name]
        for prefix, uri in prefixes.items():
            if not re.fullmatch(r"ns\d+|", prefix):
                ET.register_namespace(prefix, uri)
        text = ET.tostring(root, encoding="unicode")
        head = text[: text.index(">")]
        lost = "".join(f" xmlns:{p}={quoteattr(u)}" for p, u in prefixes.items() if p and f"xmlns:{p}=" not in head)  # other parts of Word name them
        at = re.match(r"<[^\s/>]+", text).end()
        return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text[:at] + lost + text[at:]).encode()


def texts(data: bytes) -> list[str]:
    return Package(data).texts()


def rewrite(data: bytes, edits: dict[int, list[Edit]]) -> bytes:
    """The package with edits (start, end, new text) made in the numbered paragraphs."""
    package = Package(data)
    for number, spans in edits.items():
        package.edit(number, spans)
    return package.save()


def from_blocks(blocks: list[str]) -> bytes:
    """A package with a paragraph for each block; line ends become breaks."""
    root = ET.Element(W + "document")
    body = ET.SubElement(root, W + "body")
    for block in blocks:
        _set(ET.SubElement(ET.SubElement(body, W + "p"), W + "r"), re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", "", block))
    ET.register_namespace("w", W[1:-1])
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{BODY}" ContentType="{main}"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{R[1:-1]}/officeDocument" Target="{BODY}"/></Relationships>',
        BODY: ET.tostring(root, encoding="unicode"),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()
