"""File formats by their first bytes, and text out of envelopes: compressed archives, signed messages and rich text.

Byte work that no expression can do runs in one Arrow function, ``unwrap``; nothing in it raises, a failure is a reason.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Levels of envelopes, members of an archive and bytes of a member; what has more is refused with a reason.
LEVELS, MEMBERS, MEMBER_BYTES, ARCHIVE_START = 5, 32, 64 * 1024 * 1024, 64
SIGNED_DATA = bytes.fromhex("2a864886f70d010702")


def detect(content: Column) -> Column:
    """pdf, rtf, bry, pkcs7 or unknown; null for null. The name of a file does not matter."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(content.isNull(), F.lit(None).cast("string"))
        .when(head.startswith("25504446"), "pdf")
        .when(head.startswith("7B5C727466"), "rtf")
        .when(head.startswith("42527950444445"), "bry")
        .when(F.substring(head, 1, 4).isin("3081", "3082", "3083"), "pkcs7")
        .otherwise("unknown")
    )


def kind_of(content: bytes) -> str:
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"{\\rtf"):
        return "rtf"
    if content.startswith(b"BRyPDDE"):
        return "bry"
    return "pkcs7" if content[:1] == b"\x30" and content[1:2] in (b"\x81", b"\x82", b"\x83") else "unknown"


# Destinations of rich text whose content is no text of the document, and control words that stand for characters.
HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "footerl", "footerr", "themedata", "listtable", "generator", "object"}
SHOWN = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf_text(content: bytes) -> str:
    """Text of a rich text file. Groups are a stack. A brace that would close the root before its time is left out, and then what
    follows the end of the root is cut; behind a brace that closes nothing stands no text."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, skip, replaced = False, 0, 1
    source = content.decode("cp1252", "replace")
    root = root_close(source)
    early = early_closes(source, root)
    for m in RTF.finditer(source, 0, root if early else len(source)):
        word, number, code, sign, brace, text = m.groups()
        if brace == "{":
            stack.append((hidden, replaced))
        elif brace == "}":
            if m.start() not in early:
                hidden, replaced = stack.pop() if stack else (True, 0)
        elif sign == "*":
            hidden = True
        elif word in HIDDEN:
            hidden = True
        elif word == "uc":
            replaced = int(number or 1)
        elif word == "u" and not hidden:
            out.append(chr(int(number or 63) % 0x10000))
            skip = replaced
        elif word in SHOWN and not hidden:
            out.append(SHOWN[word])
        elif code and not hidden:
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign and sign in "{}\\~_-" and not hidden:
            out.append({"~": "\xa0", "_": "‑", "-": "\xad"}.get(sign, sign))
        elif text and not hidden:
            out.append(text[skip:])
            skip = max(0, skip - len(text))
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # characters written as two halves
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def root_close(source: str) -> int:
    """Where the root group ends: at the first unescaped closing brace behind which no control word stands, else the last one."""
    braces = [m.start() for m in re.finditer(r"\\.|([}])", source, re.S) if m.group(1)]
    if not braces:
        return len(source)
    words = [m.start() for m in re.finditer(r"\\(?:[a-z]+|.)", source, re.S) if m.group()[1].isalpha()]
    last = words[-1] if words else -1
    return next((b for b in braces if b > last), braces[-1])


def early_closes(source: str, root: int) -> set[int]:
    """The closing braces before ``root`` that no group but the root is open for."""
    depth, found = 0, set()
    for m in re.finditer(r"\\.|([{}])", source[:root], re.S):
        if m.group(1) == "{":
            depth += 1
        elif m.group(1) and depth <= 1:
            found.add(m.start())
        elif m.group(1):
            depth -= 1
    return found


def bry_document(content: bytes) -> bytes:
    """The largest member of the archive that begins within the first 64 bytes; time stamps are no document. An archive of too
    many members is refused: the largest of some would look like the document."""
    at = content.find(b"PK\x03\x04", 0, ARCHIVE_START)
    if at < 0:
        raise ValueError("no archive in the envelope")
    with zipfile.ZipFile(io.BytesIO(content[at:])) as archive:
        if len(archive.infolist()) > MEMBERS:
            raise ValueError(f"an archive of {len(archive.infolist())} members, above {MEMBERS}")
        members = [m for m in archive.infolist() if not m.is_dir() and not m.filename.lower().endswith(".tsr") and m.file_size > 0]
        if not members:
            raise ValueError("the archive holds no document")
        with archive.open(max(members, key=lambda m: m.file_size)) as member:
            produced = member.read(MEMBER_BYTES + 1)
    if len(produced) > MEMBER_BYTES:
        raise ValueError("the document is too large")
    return produced


def der(content: bytes, at: int) -> tuple[int, int, int]:
    """Tag, first and last position of the element at ``at``."""
    tag, size, at = content[at], content[at + 1], at + 2
    if size == 0x80:
        raise ValueError("indefinite length")
    if size > 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(content[at : at + n]), at + n
    if at + size > len(content):
        raise ValueError("cut off")
    return tag, at, at + size


def signed_content(content: bytes) -> bytes:
    """What a signed message signs; the signature is not checked."""
    _, at, _ = der(content, 0)  # ContentInfo
    _, first, at = der(content, at)  # its type
    if content[first:at] != SIGNED_DATA:
        raise ValueError("no signed data")
    _, at, _ = der(content, at)  # [0]
    _, at, _ = der(content, at)  # SignedData
    for _ in range(2):  # version, digest algorithms
        _, _, at = der(content, at)
    _, at, end = der(content, at)  # EncapsulatedContentInfo
    _, _, at = der(content, at)
    if at >= end:
        raise ValueError("nothing is signed inside")
    _, at, _ = der(content, at)
    tag, at, end = der(content, at)
    if tag == 0x24:  # constructed: its parts one after another
        parts = []
        while at < end:
            _, a, b = der(content, at)
            parts.append(content[a:b])
            at = b
        return b"".join(parts)
    return content[at:end]


def unwrapped(content: bytes | None) -> tuple[str | None, str | None, bytes | None, str | None]:
    """Format of the outermost envelope, and text or bytes or the reason why there is neither."""
    if content is None:
        return None, None, None, None
    outer = kind_of(content)
    for _ in range(LEVELS):
        kind = kind_of(content)
        try:
            if kind == "rtf":
                return outer, rtf_text(content), None, None
            if kind == "bry":
                content = bry_document(content)
            elif kind == "pkcs7":
                content = signed_content(content)
            else:
                return outer, None, content, None
        except Exception as error:  # noqa: BLE001 - one bad file never ends the job
            return outer, None, None, f"{kind}: {error}"[:160]
    return outer, None, None, "too many envelopes"


UNWRAPPED = T.StructType([T.StructField("file_format", T.StringType()), T.StructField("text", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("reason", T.StringType())])


@F.pandas_udf(UNWRAPPED)
def unwrap(content: pd.Series) -> pd.DataFrame:
    """Struct of UNWRAPPED for every file; all null for null."""
    return pd.DataFrame([unwrapped(None if c is None else bytes(c)) for c in content], columns=["file_format", "text", "content", "reason"])


# Markers of a JPEG image behind which its size stands, and those without a length.
FRAME = frozenset((*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)))
NO_LENGTH = frozenset((0x01, *range(0xD0, 0xD9)))


def png_size(image: Column) -> Column:
    """Width and height of a PNG image by its header; null for anything else."""
    side = lambda at: F.conv(F.hex(F.substring(image, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(image, 1, 8)) == "89504E470D0A1A0A", F.struct(side(17).alias("width"), side(21).alias("height")))


def jpeg_dimensions(image: bytes) -> tuple[int, int] | None:
    """By the first frame header; segments are passed by their length, pixels are not read."""
    if image[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(image):
        if image[at] != 0xFF or image[at + 1] in (0x00, 0xFF):
            at += 1
        elif image[at + 1] in FRAME:
            return int.from_bytes(image[at + 7 : at + 9]), int.from_bytes(image[at + 5 : at + 7])
        else:
            at += 2 if image[at + 1] in NO_LENGTH else 2 + int.from_bytes(image[at + 2 : at + 4])
    return None


SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


@F.pandas_udf(SIZE)
def jpeg_size(image: pd.Series) -> pd.DataFrame:
    """Width and height of a JPEG image by its header; null for anything else."""
    found = [(None if c is None else jpeg_dimensions(bytes(c))) or (None, None) for c in image]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")
