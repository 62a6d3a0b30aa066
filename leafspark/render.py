"""GitHub-Flavored Markdown from the document model."""

from __future__ import annotations

import re

#: An underscore between letters or digits means nothing.
_SPECIAL = re.compile(r"([\\`*\[\]<>~]|(?<![^\W_])_|_(?![^\W_]))")
_LEADING = re.compile(r"^(\s*)(#{1,6}\s|[-+]\s|\d+[.)]\s|>)")


def escape(value: str) -> str:
    return _SPECIAL.sub(r"\\\1", value)


def _styled(run: dict) -> str:
    value, style = run["text"], run["style"]
    if not value.strip():
        return value
    lead, trail = value[: len(value) - len(value.lstrip())], value[len(value.rstrip()) :]
    core = value.strip()
    if style["code"]:
        fence = "``" if "`" in core else "`"
        core = f"{fence}{core}{fence}"
    else:
        core = escape(core)
    mark = ("**" if style["bold"] else "") + ("*" if style["italic"] else "")
    core = f"{mark}{core}{mark[::-1]}"
    return f"{lead}~~{core}~~{trail}" if style["strike"] else f"{lead}{core}{trail}"


def inlines(content: list, breaks: str = "  \n") -> str:
    out = []
    for i in content:
        kind = i["kind"]
        if kind == "text":
            out.append(_styled(i))
        elif kind == "link":
            target = i["target"]
            value = "#" + target["value"] if target["kind"] == "anchor" else target["value"]
            out.append(f"[{inlines(i['content'], breaks)}]({value.replace(' ', '%20').replace(')', '%29')})")
        elif kind == "image":
            source = i["source"]
            out.append(f"![{escape(i['alt'])}]({source['url']})" if source["kind"] == "external" else escape(i["alt"]))
        elif kind == "note_ref":
            out.append(f"[^{i['note_id']}]")
        elif kind == "line_break":
            out.append(breaks)
        elif kind == "math":
            out.append(f"${i['text']}$")
        elif kind == "checkbox":
            out.append("[x] " if i["checked"] else "[ ] ")
    return "".join(out)


def _cell(slot: dict) -> str:
    if slot["kind"] == "covered":
        return ""
    parts = []
    for b in slot["cell"]["blocks"]:
        value = inlines(b["content"], "<br>") if "content" in b else blocks([b])
        parts.append(value)
    return re.sub(r"\s*\n+\s*", "<br>", "<br>".join(p for p in parts if p)).replace("|", "\\|").strip()


def _table(t: dict) -> str:
    grid = [[_cell(s) for s in row] for row in t["grid"]]
    if not grid:
        return ""
    line = lambda row: "| " + " | ".join(row) + " |"
    return "\n".join([line(grid[0]), line(["---"] * len(grid[0])), *map(line, grid[1:])])


def _alpha(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


def marker(kind: str, number: int) -> str:
    if kind == "bullet":
        return "-"
    if kind == "decimal":
        return f"{number}."
    value = _roman(number) if kind.endswith("roman") else _alpha(number)
    return f"{value.upper() if kind.startswith('upper') else value}."


def _list(items: dict) -> str:
    out = []
    for k, item in enumerate(items["items"]):
        sign = item.get("marker_label") or marker(items["marker"], items["start"] + k)
        body = blocks(item["blocks"], tight=True) or ""
        pad = " " * (len(sign) + 1)
        out.append(f"{sign} " + body.replace("\n", "\n" + pad))
    return "\n".join(out)


def block(b: dict) -> str:
    kind = b["kind"]
    if kind == "heading":
        return "#" * b["level"] + " " + inlines(b["content"], " ").strip()
    if kind == "paragraph":
        value = inlines(b["content"]).strip()
        return _LEADING.sub(lambda m: m[1] + "\\" + m[2] if not m[2][0].isdigit() else m[1] + re.sub(r"([.)])", r"\\\1", m[2], count=1), value)
    if kind == "list":
        return _list(b["list"])
    if kind == "table":
        return _table(b["table"])
    if kind == "block_quote":
        return "\n".join(("> " + x).rstrip() for x in blocks(b["blocks"]).split("\n"))
    if kind == "code_block":
        fence = "````" if "```" in b["text"] else "```"
        return f"{fence}{b.get('lang', '')}\n{b['text']}\n{fence}"
    if kind == "rule":
        return "---"
    return f"$$\n{b['text']}\n$$"


def blocks(items: list, tight: bool = False) -> str:
    out = ""
    for b in items:
        value = block(b)
        if value:
            close = "\n" if tight and b["kind"] in ("list", "paragraph") else "\n\n"
            out += (close if out else "") + value
    return out


def markdown(doc: dict) -> str:
    """Blocks, then footnotes; without NUL characters or a closing line break."""
    out = [blocks(doc["blocks"])]
    for n in doc["notes"]:
        out.append(f"[^{n['id']}]: " + blocks(n["blocks"]).replace("\n", "\n    "))
    return "\n\n".join(x for x in out if x).replace("\0", "")
