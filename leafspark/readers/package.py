"""ZIP packages and their XML parts, read with limits: every input is hostile."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree

from ..errors import ConvertError, malformed

MAX_ENTRY_BYTES = 64 << 20
MAX_TOTAL_BYTES = 256 << 20
MAX_ENTRIES = 20_000
_DOCTYPE = re.compile(rb"<!DOCTYPE[^\[>]*>")


def over(limit: str) -> ConvertError:
    return ConvertError("resourceLimit", f"document exceeds {limit}", limit=limit)


def local(element) -> str:
    """The tag without its namespace."""
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def attribute(element, name: str, default: str | None = None) -> str | None:
    """The attribute of this local name in any namespace."""
    if name in element.attrib:
        return element.attrib[name]
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), default)


def child(element, name: str):
    return None if element is None else next((c for c in element if local(c) == name), None)


def descend(element, *names: str):
    for name in names:
        element = child(element, name)
    return element


def value(element, *names: str, default: str | None = None) -> str | None:
    """The ``val`` attribute of a descendant."""
    found = descend(element, *names)
    return default if found is None else attribute(found, "val", default)


def parse_xml(data: bytes, part: str, entities: bool = False):
    """The root element; document types and entity declarations are refused (a bare DOCTYPE may pass)."""
    if entities:
        data = _DOCTYPE.sub(b"", data, count=1)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data or "<!DOCTYPE".encode("utf-16-le") in data:
        raise malformed("document type declarations are not allowed", part)
    try:
        return ElementTree.fromstring(data)
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        raise malformed(f"{part}: {e}", part) from None


class Package:
    def __init__(self, data: bytes) -> None:
        if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            from .cfb import CompoundFile

            if "encryptedpackage" in {n.lower() for n in CompoundFile(data).names()}:
                raise ConvertError("encrypted", "the package is password protected")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise malformed(f"not a package: {e}") from None
        self.names = set(self.zip.namelist())
        if len(self.names) > MAX_ENTRIES:
            raise over("max_entries")
        self.total = 0

    def __contains__(self, part: str) -> bool:
        return part in self.names

    def read(self, part: str) -> bytes:
        if part not in self.names:
            raise ConvertError("missingPart", f"missing part {part}", part=part)
        if self.zip.getinfo(part).flag_bits & 1:
            raise ConvertError("encrypted", "the package is password protected")
        try:
            with self.zip.open(part) as f:
                data = f.read(MAX_ENTRY_BYTES + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError) as e:
            raise malformed(f"{part}: {e}", part) from None
        self.total += len(data)
        if len(data) > MAX_ENTRY_BYTES:
            raise over("max_entry_bytes")
        if self.total > MAX_TOTAL_BYTES:
            raise over("max_total_bytes")
        return data

    def xml(self, part: str, entities: bool = False):
        return parse_xml(self.read(part), part, entities)

    def maybe_xml(self, part: str):
        return self.xml(part) if part in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id: (type, target, external) of a part's relationships; targets inside are resolved."""
        folder, name = posixpath.split(part)
        root = self.maybe_xml(posixpath.join(folder, "_rels", name + ".rels"))
        out = {}
        for r in root if root is not None else ():
            target, external = r.get("Target", ""), r.get("TargetMode") == "External"
            if not external:
                target = posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/")
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target, external)
        return out

    def main_part(self, default: str) -> str:
        """The package's main part by its relationship, else ``default``; an absent one is an error."""
        part = default
        if part not in self.names and "_rels/.rels" in self.names:
            part = next((t for kind, t, _ in self.relations("").values() if kind == "officeDocument"), default)
        if part not in self.names:
            raise ConvertError("missingPart", f"missing part {part}", part=part)
        return part


MEDIA = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml",
    "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf",
}


class Assets:
    """Embedded files of a document, each stored once."""

    def __init__(self, package: Package) -> None:
        self.package, self.ids, self.found = package, {}, []

    def add(self, part: str) -> int | None:
        from .. import model

        if part not in self.package:
            return None
        if part not in self.ids:
            media = MEDIA.get(part.rpartition(".")[2].lower(), "application/octet-stream")
            self.ids[part] = len(self.found)
            self.found.append(model.asset(len(self.found), media, part, self.package.read(part)))
        return self.ids[part]

    def image(self, part: str, alt: str) -> dict:
        from .. import model

        own = self.add(part)
        return model.image(alt, "unavailable") if own is None else model.image(alt, "asset", asset_id=own)


def nested_lists(entries: list[tuple[int, str, int, list]]) -> list:
    """List blocks from consecutive (level, marker, start, blocks) entries."""
    from .. import model

    out: list = []
    stack: list[tuple[int, dict]] = []
    for level, marker, start, blocks in entries:
        while stack and (stack[-1][0] > level or (stack[-1][0] == level and stack[-1][1]["list"]["marker"] != marker)):
            stack.pop()
        if not stack or stack[-1][0] < level:
            new = model.list_block(marker, [], start)
            if stack and stack[-1][1]["list"]["items"]:
                stack[-1][1]["list"]["items"][-1]["blocks"].append(new)
            else:
                out.append(new)
            stack.append((level, new))
        stack[-1][1]["list"]["items"].append(model.list_item(blocks))
    return out
