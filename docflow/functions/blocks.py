"""The blocks of one Markdown document (``operators.markdown.markdown_blocks`` says what they are)."""

from __future__ import annotations

import re

# Java's "." and "$" as patterns of re
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"


def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(".*", r"[^\n\r\x85\u2028\u2029]*").replace("$", _END), re.ASCII)


_OUTER = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_DIVIDER, _RULE = _re(r"^\s*([-*_])\s*\1\s*\1[\s\-*_]*$"), _re(r"^\|?[\s:|-]*-[\s:|-]*\|?$")
_HEADING, _BULLET, _NUMBER = _re(r"^(#{1,6})\s+(.*)$"), _re(r"^(\s*)[-*+]\s+(.*)$"), _re(r"^(\s*)([0-9]+[.)])\s+(.*)$")
_BOX, _TAIL = _re(r"^\[([ xX])]\s+(.*)$"), _re(r"\s+$")
_PIPE, _LAST = _re(r"(?<!\\)\|"), _re(r"(?<!\\)((?:\\\\)*)\|$")


def _cells(t: str) -> list[str]:
    return [c.strip(" ") for c in _PIPE.split(_LAST.sub(r"\1", t[1:] if t.startswith("|") else t))]


def blocks(text: str) -> list[dict]:
    raws = text.replace("\r\n", "\n").split("\n")
    ts = [r.strip(_OUTER) for r in raws]
    out: list[dict] = []
    fences, last, table, block = 0, None, False, None
    for n, (raw, t) in enumerate(zip(raws, ts)):
        fence = t.startswith("```")
        fences += fence
        code = fence or fences % 2 == 1
        pipe = not code and t.startswith("|")
        table = pipe and (table or (n + 1 < len(ts) and (ts[n + 1].startswith("|") or bool(_RULE.search(ts[n + 1])))))
        m = None
        if code:
            kind = "code"
        elif not t:
            kind = "blank"
        elif table:
            kind = "table"
        elif _DIVIDER.search(t):
            kind = "divider"
        elif m := _HEADING.search(t):
            kind = "heading"
        elif t.startswith(">"):
            kind = "quote"
        elif m := _BULLET.search(raw):
            kind = "bullet"
        elif m := _NUMBER.search(raw):
            kind = "numbered"
        else:
            kind = "paragraph"
        now = (kind, (fences + 1) // 2 if code else 0)
        if now != last or kind not in ("paragraph", "quote", "code", "table"):
            block = {"kind": kind, "level": None, "marker": None, "indent": None, "checked": None, "text": [], "rows": [] if kind == "table" else None}
            if kind != "blank":
                out.append(block)
        last = now
        if kind == "table":
            if not _RULE.search(t):
                block["rows"].append(_cells(t))
        elif kind == "code":
            block["text"] += [] if fence else [raw]
        elif kind == "quote":
            block["text"].append(t[1:].strip(" "))
        elif kind == "paragraph":
            block["text"].append(_TAIL.sub("", raw))
        elif kind == "heading":
            block["level"] = len(m[1])
            block["text"].append(m[2].strip(" "))
        elif kind == "bullet":
            block["indent"] = len(m[1])
            box = _BOX.search(m[2])
            block["checked"] = box[1] != " " if box else None
            block["text"].append(box[2] if box else m[2])
        elif kind == "numbered":
            block["indent"], block["marker"] = len(m[1]), m[2]
            block["text"].append(m[3])
    out = [b for b in out if b["kind"] != "table" or b["rows"]]
    tables = 0
    for n, b in enumerate(out):
        b["block_no"], b["table_no"] = n, None
        b["text"] = None if b["kind"] in ("table", "divider") else "\n".join(b["text"])
        if b["rows"]:
            wide = max(map(len, b["rows"]))
            b["rows"] = [r + [""] * (wide - len(r)) for r in b["rows"]]
            b["table_no"], tables = tables, tables + 1
    return out
