"""Text of simple PDF files, page by page: plain or deflated content streams and strings in the standard encodings. Fonts with encodings of their own, object streams
and encrypted files need a parser of the caller's; a file without a page that can be read is an error, so that it goes to the failures."""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
SHOWN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b"", b"\r": b""}


def string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = ESCAPED.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else LETTERS.get(m[1], m[1]), raw[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "replace")


def shown(content: bytes) -> str:
    """The strings of a content stream in order; a move to another line breaks the line, a wide gap inside one is a space."""
    out: list[str] = []
    held: list[bytes] = []
    inside = False
    for m in SHOWN.finditer(content):
        t = m.group()
        if t == b"[":
            inside = True
        elif t == b"]":
            inside = False
        elif t[:1] in b"(<" or re.fullmatch(rb"-?\d*\.?\d+", t):
            held.append(t)
        elif not inside:
            if t in (b"T*", b"'", b'"', b"ET") or t in (b"Td", b"TD") and len(held) > 1 and float(held[-1]) != 0 or t == b"Tm":
                if out and not out[-1].endswith("\n"):
                    out.append("\n")
            if t in (b"Tj", b"TJ", b"'", b'"'):
                for x in held:
                    if x[:1] in b"(<":
                        out.append(string(x))
                    elif t == b"TJ" and float(x) < -200:
                        out.append(" ")
            held = []
    return "".join(out).strip("\n")


def page_texts(content: bytes) -> list[str]:
    """The text of every page, in the order of the page tree's leaves in the file."""
    objects = {int(n): body for n, _, body in OBJECT.findall(content)}

    def stream(number: int) -> bytes:
        body = objects.get(number, b"")
        m = STREAM.search(body)
        if not m:
            return b""
        return zlib.decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    pages = []
    for body in objects.values():
        head = body.partition(b"stream")[0]
        if re.search(rb"/Type\s*/Page\b(?!s)", head):
            m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
            pages.append(shown(b"\n".join(stream(int(n)) for n in REFERENCE.findall(m[1]))) if m else "")
    if not pages:
        raise ValueError("no page that can be read")
    return pages
