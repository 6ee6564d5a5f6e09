"""Character sets: recognition, strict decoding and encoding, line ends."""

from __future__ import annotations

import codecs
import re

from tessera.functions.tree import FormatError

#: Byte order marks, the longest first (fixed values).
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
CJK_CODECS = ("gb18030", "big5", "shift_jis")
EOLS = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿＀-￯　-〿]")


def recognise(data: bytes, fallback: str = "gb18030") -> tuple[str, bytes]:
    """(codec, mark): by the mark, else UTF-8 if it is that strictly, else a CJK codec that decodes cleanly into at least half
    CJK characters beyond ASCII, else the fallback."""
    for mark, codec in MARKS:
        if data.startswith(mark):
            return codec, mark
    try:
        data.decode("utf-8")
        return "utf-8", b""
    except UnicodeDecodeError:
        pass
    for codec in CJK_CODECS:
        try:
            beyond = [c for c in data.decode(codec) if c > "\x7f"]
        except UnicodeDecodeError:
            continue
        if beyond and 2 * len(_CJK.findall("".join(beyond))) >= len(beyond):
            return codec, b""
    return fallback, b""


def decode(data: bytes, codec: str | None = None) -> tuple[str, str, list[str]]:
    """Text, codec, and note codes; bytes that don't decode become U+FFFD and are counted."""
    found, mark = recognise(data) if codec is None else (codec, next((m for m, c in MARKS if data.startswith(m) and c == codecs.lookup(codec).name.replace("_", "-")), b""))
    text = data[len(mark) :].decode(found, "replace")
    bad = text.count("�")
    return text, found, [f"ENCODING:{found}"] + ["MARK"] * bool(mark) + [f"REPLACED:{bad}"] * bool(bad)


def encode(text: str, codec: str, mark: bool = False) -> bytes:
    """Strict: characters that the target lacks are counted and refused."""
    try:
        body = text.encode(codec)
    except UnicodeEncodeError:
        lost = sum(1 for c in text if not _fits(c, codec))
        raise FormatError(f"{codec} lacks {lost} characters") from None
    return (next((m for m, c in MARKS if c == codec), b"") if mark else b"") + body


def _fits(c: str, codec: str) -> bool:
    try:
        c.encode(codec)
        return True
    except UnicodeEncodeError:
        return False


def to_eol(text: str, eol: str) -> str:
    return re.sub("\r\n|\r|\n", EOLS[eol], text)
