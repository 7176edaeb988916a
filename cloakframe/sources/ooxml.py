"""Office packages (docx, xlsx, pptx) with the standard library: text targets by segment id.

A ``Package`` holds the parts of a zip; ``targets`` walks one format's text in document order and
yields (segment id, getter, setter).  Reading and writing use the same walk, so ids agree.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
VML = "{urn:schemas-microsoft-com:vml}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"

Target = tuple[str, Callable[[], str], Callable[[str], None]]


class UnsupportedFormat(ValueError):
    """No reader or writer for this kind of file."""


class Package:
    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {n: z.read(n) for n in z.namelist()}
        self.trees: dict[str, ET.Element] = {}
        self._parents: dict[str, dict] = {}

    def tree(self, name: str) -> ET.Element | None:
        if name not in self.parts:
            return None
        if name not in self.trees:
            for _, (prefix, uri) in ET.iterparse(io.BytesIO(self.parts[name]), events=["start-ns"]):
                if not re.fullmatch(r"ns\d+|xml", prefix):
                    ET.register_namespace(prefix, uri)
            self.trees[name] = ET.fromstring(self.parts[name])
        return self.trees[name]

    def parents(self, name: str) -> dict:
        return {c: p for p in self.tree(name).iter() for c in p}

    def rels(self, name: str) -> dict[str, tuple[str, str, bool]]:
        """id to (type's last word, target part or address, external)."""
        path = posixpath.join(posixpath.dirname(name), "_rels", posixpath.basename(name) + ".rels")
        root = self.tree(path)
        out = {}
        for r in root if root is not None else []:
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not external:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(name), target))
            out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target, external)
        return out

    def drop_rel(self, name: str, rid: str) -> None:
        root = self.tree(posixpath.join(posixpath.dirname(name), "_rels", posixpath.basename(name) + ".rels"))
        for r in list(root if root is not None else []):
            if r.get("Id") == rid:
                root.remove(r)

    def drop_part(self, name: str) -> None:
        self.parts.pop(name, None)
        self.trees.pop(name, None)
        types = self.tree("[Content_Types].xml")
        for t in list(types if types is not None else []):
            if t.get("PartName") == "/" + name:
                types.remove(t)
        for rels in [n for n in self.parts if n.endswith(".rels")]:
            base = posixpath.dirname(posixpath.dirname(rels))
            root = self.tree(rels)
            for r in list(root):
                target = r.get("Target", "")
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
                if r.get("TargetMode") != "External" and path == name:
                    root.remove(r)

    def save(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in self.parts.items():
                if name in self.trees:
                    root = self.trees[name]
                    for k in [k for k in root.attrib if k.endswith("}Ignorable")]:
                        del root.attrib[k]  # unused prefixes aren't declared any more
                    data = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()


# Word -----------------------------------------------------------------------------------------

_WRAPPERS = {W + x for x in ("hyperlink", "ins", "moveTo", "sdt", "sdtContent", "smartTag", "customXml", "fldSimple")}
_HEADERS = [("header", "default"), ("first_page_header", "first"), ("even_page_header", "even"), ("footer", "default"), ("first_page_footer", "first"), ("even_page_footer", "even")]


def _word_text(run: ET.Element) -> str:
    out = []
    for c in run:
        if c.tag == W + "t":
            out.append(c.text or "")
        elif c.tag == W + "tab":
            out.append("\t")
        elif c.tag in (W + "br", W + "cr"):
            out.append("\n" if c.get(W + "type") in (None, "textWrapping") else "")
        elif c.tag == W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _set_word_text(run: ET.Element, text: str) -> None:
    for c in list(run):
        if c.tag != W + "rPr":
            run.remove(c)
    for part in re.split(r"([\t\n])", text):
        if part == "\t":
            ET.SubElement(run, W + "tab")
        elif part == "\n":
            ET.SubElement(run, W + "br")
        elif part:
            t = ET.SubElement(run, W + "t")
            t.text = part
            t.set(_SPACE, "preserve")


def _paragraph_runs(p: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    direct = nested = 0

    def walk(e: ET.Element, top: bool) -> Iterator[tuple[bool, ET.Element]]:
        for c in e:
            if c.tag == W + "r":
                yield top, c
            elif c.tag in _WRAPPERS:
                yield from walk(c, False)

    for top, r in walk(p, True):
        if top:
            yield f"{prefix}/r{direct}", r
            direct += 1
        else:
            yield f"{prefix}/n{nested}", r
            nested += 1


def _control_paragraphs(sdt: ET.Element) -> Iterator[ET.Element]:
    for c in sdt.findall(W + "sdtContent/*"):
        if c.tag == W + "p":
            yield c
        elif c.tag == W + "sdt":
            yield from _control_paragraphs(c)


def _container_runs(e: ET.Element, paragraphs: str, tables: str) -> Iterator[tuple[str, ET.Element]]:
    for i, p in enumerate(e.findall(W + "p")):
        yield from _paragraph_runs(p, f"{paragraphs}p{i}")
    for t, table in enumerate(e.findall(W + "tbl")):
        for r, row in enumerate(table.findall(W + "tr")):
            for c, cell in enumerate(row.findall(W + "tc")):
                own = f"{tables}t{t}/row{r}/cell{c}/"
                for i, p in enumerate(cell.findall(W + "p")):
                    yield from _paragraph_runs(p, f"{own}p{i}")
                yield from _control_runs(cell, own)
    yield from _control_runs(e, paragraphs)


def _control_runs(e: ET.Element, prefix: str) -> Iterator[tuple[str, ET.Element]]:
    for k, sdt in enumerate(e.findall(W + "sdt")):
        for i, p in enumerate(_control_paragraphs(sdt)):
            yield from _paragraph_runs(p, f"{prefix}sdt{k}/p{i}")


def _docx_runs(pkg: Package) -> Iterator[tuple[str, str, ET.Element]]:
    """(part, segment id, run) in document order."""
    main = "word/document.xml"
    body = pkg.tree(main).find(W + "body")
    for sid, r in _container_runs(body, "body/", "table/"):
        yield main, sid, r
    rels = pkg.rels(main)
    for s, section in enumerate(body.iter(W + "sectPr")):
        for kind, which in _HEADERS:
            tag = W + ("headerReference" if "header" in kind else "footerReference")
            for ref in section.findall(tag):
                part = rels.get(ref.get(R + "id"), ("", "", True))[1]
                if ref.get(W + "type", "default") == which and part in pkg.parts:
                    for sid, r in _container_runs(pkg.tree(part), f"hf/s{s}/{kind}/", f"hf/s{s}/{kind}/"):
                        yield part, sid, r


def _docx_targets(pkg: Package) -> Iterator[Target]:
    for _, sid, r in _docx_runs(pkg):
        yield sid, (lambda r=r: _word_text(r)), (lambda x, r=r: _set_word_text(r, x))


# Excel ----------------------------------------------------------------------------------------


def _rich(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter(S + "t") if t is not None)


def _xlsx_targets(pkg: Package) -> Iterator[Target]:
    shared = pkg.tree("xl/sharedStrings.xml")
    strings = [_rich(si) for si in shared] if shared is not None else []
    book, rels = pkg.tree("xl/workbook.xml"), pkg.rels("xl/workbook.xml")
    for sheet in book.iter(S + "sheet"):
        part = rels.get(sheet.get(R + "id"), ("", "", True))[1]
        root = pkg.tree(part)
        for c in root.iter(S + "c") if root is not None else []:
            kind, v = c.get("t"), c.find(S + "v")
            if c.find(S + "f") is not None:
                continue
            if kind == "s" and v is not None:
                text = strings[int(v.text)]
            elif kind == "inlineStr" and c.find(S + "is") is not None:
                text = _rich(c.find(S + "is"))
            else:
                continue

            def put(x: str, c: ET.Element = c) -> None:
                for child in list(c):
                    c.remove(child)
                c.set("t", "inlineStr")
                t = ET.SubElement(ET.SubElement(c, S + "is"), S + "t")
                t.text = x
                t.set(_SPACE, "preserve")

            yield f"sheet={sheet.get('name')}/{c.get('r')}", (lambda x=text: x), put


# PowerPoint -----------------------------------------------------------------------------------


def _frame_runs(body: ET.Element | None, prefix: str) -> Iterator[Target]:
    for i, p in enumerate(body.findall(A + "p") if body is not None else []):
        for j, r in enumerate(p.findall(A + "r")):
            t = r.find(A + "t")
            if t is not None:
                yield f"{prefix}/p{i}/r{j}", (lambda t=t: t.text or ""), (lambda x, t=t: setattr(t, "text", x))


_SHAPES = {P + x for x in ("sp", "grpSp", "graphicFrame", "cxnSp", "pic", "contentPart")}


def _shape_targets(parent: ET.Element, base: str, label: str) -> Iterator[Target]:
    for k, shape in enumerate(c for c in parent if c.tag in _SHAPES):
        prefix = f"{base}/{label}{k}"
        if shape.tag == P + "grpSp":
            yield from _shape_targets(shape, prefix, "group")
            continue
        yield from _frame_runs(shape.find(P + "txBody"), prefix)
        for table in shape.iter(A + "tbl"):
            for i, row in enumerate(table.findall(A + "tr")):
                for j, cell in enumerate(row.findall(A + "tc")):
                    yield from _frame_runs(cell.find(A + "txBody"), f"{prefix}/row{i}/col{j}")
        about = shape.find(f"{P}nvPicPr/{P}cNvPr")
        if about is not None and about.get("descr", "").strip():
            yield f"{prefix}/alt", (lambda e=about: e.get("descr", "")), (lambda x, e=about: e.set("descr", x))


def _pptx_targets(pkg: Package) -> Iterator[Target]:
    main = "ppt/presentation.xml"
    rels = pkg.rels(main)
    for s, ref in enumerate(pkg.tree(main).iter(P + "sldId")):
        slide = rels[ref.get(R + "id")][1]
        yield from _shape_targets(pkg.tree(slide).find(f"{P}cSld/{P}spTree"), f"slide{s}", "shape")
        for kind, part, _ in pkg.rels(slide).values():
            if kind == "notesSlide" and part in pkg.parts:
                for sp in pkg.tree(part).iter(P + "sp"):
                    place = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                    if place is not None and place.get("type") == "body":
                        yield from _frame_runs(sp.find(P + "txBody"), f"slide{s}/notes")
                        break


TARGETS = {"docx": _docx_targets, "xlsx": _xlsx_targets, "pptx": _pptx_targets}


def run_block(segment_id: str) -> str | None:
    """The paragraph of a run id; NULL for other ids."""
    return re.sub(r"/[rn]\d+$", "", segment_id) if re.search(r"/[rn]\d+$", segment_id) else None


def read_segments(content: bytes, kind: str) -> list[tuple[str, str, str | None]]:
    """(segment id, text, block) in document order."""
    if kind not in TARGETS:
        raise UnsupportedFormat(kind)
    return [(sid, get(), run_block(sid) if kind != "xlsx" else None) for sid, get, _ in TARGETS[kind](Package(content))]


# Scrubbing ------------------------------------------------------------------------------------

#: Core properties that are blanked, and parts that go because they hold comments, authors or a picture of the original.
_CORE = {"creator", "lastModifiedBy", "title", "subject", "keywords", "description", "category", "contentStatus", "identifier", "language", "version"}
_GONE = re.compile(r"comment|people\.xml|threadedComment|persons/|authors\.xml|docProps/thumbnail", re.IGNORECASE)


def scrub(pkg: Package) -> None:
    core, app = pkg.tree("docProps/core.xml"), pkg.tree("docProps/app.xml")
    for e in core if core is not None else []:
        if e.tag.rpartition("}")[2] in _CORE:
            e.text = ""
    for e in list(app if app is not None else []):
        if e.tag.rpartition("}")[2] in ("Company", "Manager"):
            app.remove(e)
    for name in [n for n in pkg.parts if _GONE.search(n) and not n.endswith(".rels")]:
        pkg.drop_part(name)
    for name in [n for n in pkg.parts if n.startswith("word/") and n.endswith(".xml")]:
        _accept_changes(pkg.tree(name))


def _accept_changes(root: ET.Element) -> None:
    """Deleted content and change records go, inserted content stays; comment marks go."""
    gone = {W + x for x in ("del", "moveFrom", "rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange", "commentRangeStart", "commentRangeEnd", "commentReference", "moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd")}
    for parent in list(root.iter()):
        out, changed = [], False
        for c in parent:
            if c.tag in gone:
                changed = True
            elif c.tag in (W + "ins", W + "moveTo"):
                out.extend(c)
                changed = True
            else:
                out.append(c)
        if changed:
            parent[:] = out
    if any(e.tag in (W + "ins", W + "moveTo", *gone) for e in root.iter()):
        _accept_changes(root)


def _hidden(root: ET.Element) -> Iterator[tuple[ET.Element, str]]:
    """Attributes that may repeat a name: alt text, VML titles, link tips."""
    for e in root.iter():
        name = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
        if name in ("docPr", "cNvPr"):
            yield from ((e, a) for a in ("descr", "title", "name"))
        elif isinstance(e.tag, str) and e.tag.startswith(VML):
            yield from ((e, a) for a in ("alt", "{urn:schemas-microsoft-com:office:office}title"))
        elif e.tag == W + "hyperlink":
            yield e, W + "tooltip"


def _plain_fields(p: ET.Element) -> None:
    """A complex field of a paragraph becomes its result: begin, code and separator go."""
    depth, code = 0, False
    for parent in list(p.iter()):
        for r in [c for c in parent if c.tag == W + "r"]:
            mark = r.find(W + "fldChar")
            kind = mark.get(W + "fldCharType") if mark is not None else None
            if kind == "begin":
                depth, code = depth + 1, True
            if kind or code:
                parent.remove(r)
            if kind == "separate":
                code = False
            if kind == "end":
                depth, code = depth - 1, False


def write_segments(content: bytes, kind: str, edits: dict[str, str], originals: list[str] = ()) -> bytes:
    """The file with the texts of the edited segments, without links, fields, alt texts and properties that repeat them."""
    if kind not in TARGETS:
        raise UnsupportedFormat(kind)
    pkg = Package(content)
    changed = set()
    for sid, get, put in list(TARGETS[kind](pkg)):
        if sid in edits and get() != edits[sid]:
            changed.add(sid)
            put(edits[sid])
    if kind == "xlsx":
        if changed and pkg.tree("xl/sharedStrings.xml") is not None:  # strings that no cell uses any more
            used = {int(c.find(S + "v").text) for n in pkg.parts if n.startswith("xl/worksheets/") and n.endswith(".xml") for c in pkg.tree(n).iter(S + "c") if c.get("t") == "s" and c.find(S + "v") is not None}
            for i, si in enumerate(pkg.tree("xl/sharedStrings.xml")):
                if i not in used:
                    si[:] = []
                    ET.SubElement(si, S + "t")
        scrub(pkg)
        return pkg.save()
    if kind == "docx":
        for part in {p for p, sid, _ in _docx_runs(pkg) if sid in changed}:
            above = pkg.parents(part)
            for p, sid, r in list(_docx_runs(pkg)):
                if p != part or sid not in changed:
                    continue
                e = r
                while e is not None and e.tag != W + "p":
                    if e.tag == W + "hyperlink" and e.get(R + "id"):
                        rid = e.attrib.pop(R + "id")
                        e.attrib.pop(W + "tooltip", None)
                        if not any(x.get(R + "id") == rid for x in pkg.tree(part).iter()):
                            pkg.drop_rel(part, rid)
                    if e.tag == W + "fldSimple":
                        e.attrib.pop(W + "instr", None)
                        e.tag = W + "smartTag"
                        e.set(W + "element", "field")
                    e = above.get(e)
                if e is not None and e.find(f".//{W}instrText") is not None:
                    _plain_fields(e)
    for name in [n for n in pkg.parts if n.endswith(".xml") and n.startswith(("word/", "ppt/"))]:
        for e, a in _hidden(pkg.tree(name)):
            if e.get(a) and any(o and o in e.get(a) for o in originals):
                e.set(a, "")
    scrub(pkg)
    return pkg.save()


def extract_text(content: bytes, kind: str) -> str:
    """Every text that the written file holds, found without the segment walk where the format hides some."""
    pkg = Package(content)
    if kind == "docx":
        lines = []
        for name in sorted(n for n in pkg.parts if n.startswith("word/")):
            if name.endswith(".rels"):
                lines.extend(r.get("Target", "") for r in pkg.tree(name) if r.get("TargetMode") == "External")
            elif name.endswith(".xml"):
                root = pkg.tree(name)
                for p in root.iter(W + "p"):
                    lines.append("".join(t.text or "" for t in p.iter() if t.tag in (W + "t", W + "delText")))
                    lines.append("".join(t.text or "" for t in p.iter() if t.tag in (W + "instrText", W + "delInstrText")))
                lines.extend(e.get(W + "instr", "") for e in root.iter(W + "fldSimple"))
                lines.extend(e.get(a, "") for e, a in _hidden(root))
        return "\n".join(x for x in lines if x)
    joined: dict[str, str] = {}
    for sid, get, _ in TARGETS[kind](pkg):
        key = run_block(sid) or sid
        joined[key] = joined.get(key, "") + get()
    return "\n".join(joined.values())
