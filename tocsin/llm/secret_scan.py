"""Secrets in texts: base patterns, and spans whose structure confirms them.

Base spans follow three patterns.  Further spans are reported only once they
have been decoded and parsed: key blocks whose body is well-formed DER or
OpenSSH key data or enciphered, base64 (either alphabet) or hex runs (either
case) that hold such data on one or several lines, and signed tokens whose
header is a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "key_block", "key_data", "signed_token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are whole, as the leftmost place with 16 characters is where a run starts.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
BLOCK = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: What may stand between two lines of a key: blanks, line ends, also escaped, and the marks of quotes and comments.
GAP = re.compile(r"""(?:[\s"',>#*]|\\u000[aAdD]|\\[nrt]?|(?<=["'\s])\+(?=\s))+""")
HEX_GAP = re.compile(r"""(?:[\s"',:>#*]|\\u000[aAdD]|\\[nrt]?)+""")
HEADER = re.compile(r"^[ \t]*[A-Za-z][A-Za-z0-9-]*:[^\n]*(?:\n[ \t]+[^\n]*(?=\n[ \t]*\n))*$", re.MULTILINE)
CIPHERED = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*(?:[0-9A-Fa-f]{2})+")
BASE64_CHARS, HEX_CHARS = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
PLAIN_CHARS, PADDING = re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"={0,2}")
URL_SAFE = str.maketrans("-_", "+/")
#: How a DER sequence and the OpenSSH magic begin in base64 and in hex.
STARTS = re.compile(r"M(?=[A-I])"), re.compile(r"b3BlbnNzaC1rZXkt")
HEX_STARTS = re.compile(r"30(?=[0-9A-Fa-f\s:])"), re.compile(r"6[fF](?=:?70:?65:?6[eE]:?73:?73:?68)")
#: Less than any private key.
LEAST_DATA = 36
OPENSSH = b"openssh-key-v1\0"
SEQUENCE, INTEGER, OCTETS = 0x30, 0x02, 0x04
Span = tuple[str, int, int]


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each item if the items fill ``data`` exactly, else None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """A sequence that starts with a small version number and holds a private key's fields."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != INTEGER or inner[0][1] not in (b"\0", b"\1"):
        return False
    rest = [tag for tag, _ in inner[1:]]
    if rest[:2] == [SEQUENCE, OCTETS]:  # algorithm, then the wrapped key
        parts = der_items(inner[1][1])
        return bool(parts) and parts[0][0] == 0x06
    numbers = len(rest) >= 5 and all(tag == INTEGER for tag in rest)  # RSA, DSA
    curve = rest[0] == OCTETS and len(inner[1][1]) >= 16  # elliptic curve
    return numbers or curve


def is_openssh_key(data: bytes) -> bool:
    """The magic, then four length-prefixed fields: cipher, derivation, its options and, after a count, a key."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)
    for field in range(4):
        if field == 3:
            at += 4  # the number of keys
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
    return True


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def from_base64(text: str) -> bytes | None:
    """The bytes of base64 of either alphabet, padded or not."""
    body = text.rstrip("=").translate(URL_SAFE)
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """A header of three dot-separated parts that is a JSON object with an algorithm."""
    header = from_base64(text.split(".", 1)[0])
    try:
        found = json.loads(header) if header else None
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def block_data(body: str) -> tuple[str, bytes | None]:
    """The header lines of a key block and its decoded data; line ends may be escaped."""
    lines = re.sub(r"\\+(?:r|n|u000[aAdD])", "\n", body)
    headers = "\n".join(m[0] for m in HEADER.finditer(lines))
    return headers, from_base64(GAP.sub("", HEADER.sub("", lines)))


def is_block(label: str, body: str) -> bool:
    """Key data, or enciphered data with the fields that say so."""
    headers, data = block_data(body)
    if not data:
        return False
    ciphered = "ENCRYPTED" in headers and CIPHERED.search(headers) and len(data) >= LEAST_DATA
    return bool(is_key(data) or ciphered or label.startswith("ENCRYPTED") and der_items(data))


class Stretch:
    """Encoded characters that follow each other, on one line or on several, without what stands between the lines."""

    def __init__(self, in_hex: bool) -> None:
        self.in_hex = in_hex
        self.starts: list[int] = []  # of each line, in the text
        self.before: list[int] = []  # characters in earlier lines
        self.parts: list[str] = []
        self.size = 0

    def add(self, start: int, part: str) -> None:
        self.starts.append(start)
        self.before.append(self.size)
        self.parts.append(part)
        self.size += len(part)

    def close(self) -> Stretch:
        self.chars = "".join(self.parts)
        return self

    def index(self, at: int) -> int:
        """Number of the character that stands at ``at`` in the text."""
        line = bisect_right(self.starts, at) - 1
        return self.before[line] + at - self.starts[line]

    def place(self, index: int) -> int:
        """Where in the text the character before ``index`` ends."""
        line = bisect_right(self.before, index - 1) - 1
        return self.starts[line] + index - self.before[line]

    def line_end(self, at: int) -> int:
        line = bisect_right(self.starts, at) - 1
        return self.starts[line] + len(self.parts[line])

    def peek(self, start: int, offset: int, count: int) -> bytes:
        """``count`` bytes at ``offset`` behind the character ``start``; fewer at the end or where nothing decodes."""
        if self.in_hex:
            return bytes.fromhex(self._even(self.chars[start + 2 * offset : start + 2 * (offset + count)]))
        skip, lead = divmod(offset, 3)
        body = self.chars[start + 4 * skip : start + 4 * (skip + (lead + count + 2) // 3)]
        data = from_base64(body if len(body) % 4 != 1 else body[:-1]) or b""
        return data[lead : lead + count]

    @staticmethod
    def _even(digits: str) -> str:
        return digits[: len(digits) // 2 * 2]

    def characters(self, size: int) -> int:
        return 2 * size if self.in_hex else -(-4 * size // 3)


def stretches(text: str, chars: re.Pattern, gap: re.Pattern) -> list[Stretch]:
    """All stretches of a text in order, each character read once."""
    found, at = [], 0
    while m := chars.search(text, at):
        stretch = Stretch(chars is HEX_CHARS)
        while m:
            stretch.add(m.start(), m[0])
            at = m.end()
            between = gap.match(text, at)
            m = chars.match(text, between.end()) if between else None
        found.append(stretch.close())
    return found


def der_key_size(peek: Callable[[int, int], bytes], available: int) -> int | None:
    """Size of the private key that begins here, read item by item without decoding what the items hold.

    The same shape that ``is_der_key`` asks for; an item of a wrong kind or
    size ends the reading.
    """
    def header(at: int) -> tuple[int, int, int] | None:
        head = peek(at, 6)
        if len(head) < 2:
            return None
        tag, size, behind = head[0], head[1], 2
        if size >= 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or len(head) < 2 + wide:
                return None
            size, behind = int.from_bytes(head[2 : 2 + wide], "big"), 2 + wide
        return tag, at + behind, at + behind + size

    outer = header(0)
    if not outer or outer[0] != SEQUENCE or not LEAST_DATA <= outer[2] <= available:
        return None
    version = header(outer[1])
    if not version or version[0] != INTEGER or version[2] - version[1] != 1 or peek(version[1], 1) not in (b"\0", b"\1"):
        return None
    rest: list[tuple[int, int, int]] = []
    at = version[2]
    while at < outer[2]:
        item = header(at)
        if not item or item[2] > outer[2]:
            return None
        rest.append(item)
        tags = [tag for tag, _, _ in rest[:2]]
        if tags[0] not in (INTEGER, OCTETS) and tags[:2] not in ([SEQUENCE], [SEQUENCE, OCTETS]) or tags[0] == INTEGER and item[0] != INTEGER:
            return None
        at = item[2]
    if not rest:
        return None
    tags = [tag for tag, _, _ in rest]
    if tags[:2] == [SEQUENCE, OCTETS]:
        parts = header(rest[0][1])
        found = bool(parts) and parts[0] == 0x06 and der_items(peek(rest[0][1], rest[0][2] - rest[0][1])) is not None
    else:
        curve = tags[0] == OCTETS and rest[0][2] - rest[0][1] >= 16
        found = curve or len(tags) >= 5 and all(tag == INTEGER for tag in tags)
    return outer[2] if found else None


def openssh_size(peek: Callable[[int, int], bytes], available: int, fields: int) -> int | None:
    """Size of OpenSSH key data up to its field ``fields``, if that many fit."""
    if peek(0, len(OPENSSH)) != OPENSSH:
        return None
    size = len(OPENSSH)
    for field in range(fields):  # cipher, derivation, its options, after a count the public key, the private keys
        size += 4 if field == 3 else 0
        head = peek(size, 4)
        if len(head) < 4:
            return None
        size += 4 + int.from_bytes(head, "big")
        if size > available:
            return None
    return size


def key_runs(text: str, encoded: str) -> Iterator[tuple[int, int]]:
    """Where base64 or hex of key data starts and ends, on one line or on several.

    A place is decided by the sizes that its first items claim, so a text of
    many places is read a few bytes at each.
    """
    in_hex = encoded == "hex"
    chars, gap = (HEX_CHARS, HEX_GAP) if in_hex else (BASE64_CHARS, GAP)
    starts = sorted(m.start() for p in (HEX_STARTS if in_hex else STARTS) for m in p.finditer(text))
    if not starts:
        return
    runs = stretches(text, chars, gap)
    first = [run.starts[0] for run in runs]
    plain = {} if in_hex else {m.start(): m.end() for m in PLAIN_CHARS.finditer(text)}
    plain_starts = sorted(plain)
    last = 0
    for at in starts:
        before = text[at - 1 : at] if text[at - 2 : at] not in ("\\n", "\\r", "\\t") else ""
        if at < last or before and (HEX_CHARS.match(before) if in_hex else before.isascii() and (before.isalnum() or before in "+/")):
            continue
        run = runs[bisect_right(first, at) - 1]
        begin = run.index(at)

        def peek(offset: int, count: int, run: Stretch = run, begin: int = begin) -> bytes:
            return run.peek(begin, offset, count)

        available = (run.size - begin) * (1 if in_hex else 3) // (2 if in_hex else 4)
        end = None
        # A run that is OpenSSH data as a whole, as it may be cut short behind the public key.
        magic, ends = text[at] in "b6", []
        if magic:
            ends = [run.line_end(at)] if in_hex else [run.line_end(at), plain[plain_starts[bisect_right(plain_starts, at) - 1]]]
        for stop in ends:
            whole = stop - at
            if whole % 2 if in_hex else whole % 4 == 1:
                continue
            size = whole // 2 if in_hex else whole * 3 // 4
            if size >= LEAST_DATA and openssh_size(peek, size, 4):
                end = stop
                break
        if end is None:
            size = openssh_size(peek, available, 5) if magic else der_key_size(peek, available)
            if not size or size < LEAST_DATA:
                continue
            end = run.place(begin + run.characters(size))
        if not in_hex:
            end = PADDING.match(text, end).end()
        after = text[end : end + 1]
        if after and (HEX_CHARS.match(after) if in_hex else after.isascii() and (after.isalnum() or after in "+/=")):
            continue
        last = end
        yield at, end


def confirmed_spans(text: str, hexes: list[Span]) -> list[Span]:
    found = [("key_block", *m.span()) for m in BLOCK.finditer(text) if is_block(m[1], m[2])]
    blocks = list(found)
    found += [("signed_token", *m.span()) for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    runs = {*key_runs(text, "base64"), *key_runs(text, "hex")}
    for _, start, end in hexes:  # lower-case runs that touch other letters
        if end - start >= 2 * LEAST_DATA and (end - start) % 2 == 0 and is_key(bytes.fromhex(text[start:end])):
            runs.add((start, end))
    # The lines of a block are listed with it; data on one line is listed by itself as well.
    for start, end in runs:
        one_line = not re.search(r"[^A-Za-z0-9+/=_-]", text[start:end])
        if one_line or not any(a <= start and end <= b for _, a, b in blocks):
            found.append(("key_data", start, end))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by start and then kind."""
    order = {kind: i for i, kind in enumerate(KINDS)}
    base = base_spans(text or "")
    every = base + confirmed_spans(text or "", [s for s in base if s[0] == "hex"])
    key = lambda s: (s[1], order[s[0]], s[2])
    return sorted(base, key=key), sorted(every, key=key)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with overlapping spans joined and each replaced by ``mark``."""
    parts, at, last = [], 0, -1
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= last:
            parts += [text[at:start], mark]
            last = end
        last = max(last, end)
        at = last
    return "".join(parts) + text[at:]


def _scan_rows(batches: Iterator[pa.RecordBatch], masked: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item in batch.column("_text"):
            text = item.as_py()
            base, every = scan(text)
            kinds = [k for k, _, _ in base]
            rows.append((
                kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                hashlib.sha256(listed(base).encode()).hexdigest(), listed(every),
                redact(text, every) if masked and every else text if masked else None,
            ))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 3
        made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(batch.num_columns - 1)] + made,
            [*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked_text"],
        )


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    masked: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Spans of secrets in every text.

    Returns one row per input row: ``doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, masked_text``; the last is the text with all spans
    replaced if ``masked``, else null.  Spans are code points, end exclusive.
    Null counts as empty and stays null when masked.  Repeated rows are
    treated alike, extra columns are not read, but those named in ``carry``
    come back in the struct ``carried``.
    """
    more = [F.struct(*carry).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), *more, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.drop("_text").dtypes)
    return rows.mapInArrow(
        lambda it: _scan_rows(it, masked),
        f"{kinds}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked_text string",
    )
