"""Secret scans (7): patterns, and structural confirmation of encoded candidates.

The base kinds are found by pattern: ``assign`` (a credential's name, a separator, a value of 6 and more
characters), ``access`` (key ids of 20 and more characters) and ``hex`` (24 and more digits). The
structural kinds are reported only if a candidate decodes and what it holds parses:

- ``jwt``: three base64url parts, of which the first is a JSON object with a string ``alg``;
- ``pem``: an armoured private key whose body decodes to DER with nested lengths that fit exactly, or to
  an OpenSSH container, or stands under the header lines of an encrypted key. Line ends may be escaped, as in JSON;
- ``der``: bare base64, base64url or hex of a DER SEQUENCE with an integer or a nested algorithm sequence first, as keys
  have. Its own length says how much is read, over line ends (plain or escaped) too, and nested lengths have to fit;
- ``ssh``: a bare base64 run of length-prefixed fields that starts with the name of a key type, or an OpenSSH container.

Spans are code points, end exclusive. A null or empty text has no spans; repeated rows are scanned one by one; other
columns of the rows are kept, and one of the name that ``secret_scan`` adds is replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: One of these is in every match of ASSIGN's first group.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(e[yw][A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
ESCAPED = re.compile(r"\\[rnt]")
PEM_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*): *([^\r\n]*)")
#: DER sequences start with 0x30, OpenSSH fields with three zero bytes. Whether a run begins there, ``begins`` says.
DER_START = re.compile(r"M[A-P][A-Za-z0-9+/_-]{14}")
SSH_RUN = re.compile(r"AAAA[A-Za-z0-9+/]{38,}={0,2}|b3BlbnNzaC1rZXktdjEA(?:[A-Za-z0-9+/]|\r?\n|\\n){38,}={0,2}")
#: Of a base64 text: characters, or a line end, after which blanks may stand.
STEP = re.compile(r"([A-Za-z0-9+/_-]+)|(?:\\r)?\\n|\r?\n[ \t]*")
HEX_RUN = re.compile(r"30[0-9A-Fa-f]{46,}")
IN_RUN, HEX_DIGITS = frozenset(string.ascii_letters + string.digits + "+/_-"), frozenset(string.hexdigits)
SSH_NAMES = (b"ssh-", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
REPLACEMENT = "<SECRET>"


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(start, stop) of the value whose length bytes are at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return at + 1, at + 1 + first
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return at + 1 + n, at + 1 + n + int.from_bytes(data[at + 1 : at + 1 + n], "big")


def der_fits(data: bytes, start: int, stop: int, depth: int = 0) -> bool:
    """Values fill start to stop exactly, nested sequences and sets included."""
    while start < stop:
        tag = data[start]
        if (tag & 0x1F) == 0x1F or not (found := der_length(data, start + 1)) or found[1] > stop:
            return False
        if tag & 0x20 and depth < 12 and not der_fits(data, *found, depth + 1):
            return False
        start = found[1]
    return start == stop


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fits exactly and begins with an integer or with an algorithm's sequence."""
    if len(data) < 16 or data[0] != 0x30 or not (body := der_length(data, 1)) or body[1] != len(data) or body[0] >= len(data):
        return False
    if not der_fits(data, *body):
        return False
    first = data[body[0]]
    if first == 0x02:
        return True
    inner = der_length(data, body[0] + 1)
    return first == 0x30 and bool(inner) and inner[0] < len(data) and data[inner[0]] == 0x06


def is_ssh_fields(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first of which names a key type."""
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and fields[0].startswith(SSH_NAMES)


URLSAFE = str.maketrans("-_", "+/")


def decoded(run: str) -> bytes:
    """The bytes of base64 or base64url with or without white space and padding; nothing if it isn't that."""
    run = "".join(run.split()).rstrip("=").translate(URLSAFE)
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def jwt_start(header: str) -> int:
    """Where in the run a JSON object with a string ``alg`` begins that goes to its end, or -1."""
    for m in re.finditer("e[yw]", header):
        try:
            found = json.loads(decoded(header[m.start() :]))
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict) and isinstance(found.get("alg"), str):
            return m.start()
    return -1


def is_private_pem(body: str) -> bool:
    """Is what stands between the armour lines a key? Header lines go first; of an encrypted key they are the confirmation."""
    headers, rest = {}, []
    for line in ESCAPED.sub("\n", body).split("\n"):
        line = line.strip().strip("\"'+, \t\r")
        if (m := PEM_HEADER.fullmatch(line)) and not rest:
            headers[m[1].lower()] = m[2]
        elif line:
            rest.append(line)
    data = decoded("".join(rest))
    if "ENCRYPTED" in headers.get("proc-type", "") and "," in headers.get("dek-info", ""):
        return len(data) >= 16 and len(data) % 8 == 0
    return is_openssh(data) or is_der_key(data)


def is_openssh(data: bytes) -> bool:
    """The container's name, then a length-prefixed name of a cipher."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic) or len(data) < len(magic) + 4:
        return False
    n = int.from_bytes(data[len(magic) : len(magic) + 4], "big")
    name = data[len(magic) + 4 : len(magic) + 4 + n]
    return 0 < n < 64 and len(name) == n and name.isascii()


def begins(text: str, at: int) -> bool:
    """Does a run of base64 begin there: at no character of its own, or after an escape?"""
    return at == 0 or text[at - 1] not in IN_RUN or (at > 1 and text[at - 2 : at] in ("\\n", "\\r", "\\t"))


def der_key_end(text: str, at: int) -> int:
    """The end of the base64 of a DER key that starts at ``at``, or -1. Its outer length says how many characters it has."""
    head = decoded(text[at : at + 16])
    body = der_length(head, 1) if head[:1] == b"0" else None
    if not body or body[1] < 16 or body[0] >= len(head) or head[body[0]] not in (0x02, 0x30):
        return -1
    parts, need = [], -(-body[1] * 4 // 3)
    while need and (m := STEP.match(text, at)):
        if m[1]:
            parts.append(m[1][:need])
            need -= len(parts[-1])
            at += len(parts[-1])
        else:
            at = m.end()
    if need or re.match(r"[A-Za-z0-9+/]", text[at : at + 1]):
        return -1
    if not is_der_key(decoded("".join(parts))[: body[1]]):
        return -1
    return at + len(re.match("={0,2}", text[at : at + 2])[0])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower() if text.isascii() else text.casefold() + text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "." in text:
        for m in JWT.finditer(text):
            if (start := jwt_start(m[1])) >= 0:
                out.append(("jwt", m.start() + start, m.end()))
    if "PRIVATE KEY-----" in text:
        out += [("pem", m.start(), m.end()) for m in PEM.finditer(text) if is_private_pem(m[2])]
    inside = sorted((s, e) for _, s, e in out)

    def free(at: int) -> bool:
        k = bisect_right(inside, (at, len(text))) - 1
        return k < 0 or at >= inside[k][1]

    for m in DER_START.finditer(text):
        if begins(text, m.start()) and free(m.start()) and (end := der_key_end(text, m.start())) >= 0:
            out.append(("der", m.start(), end))
    for m in SSH_RUN.finditer(text):
        if begins(text, m.start()) and free(m.start()) and (is_ssh_fields(data := decoded(ESCAPED.sub("\n", m[0]))) or is_openssh(data)):
            out.append(("ssh", m.start(), m.end()))
    for m in HEX_RUN.finditer(text):
        if m.start() and text[m.start() - 1] in HEX_DIGITS:
            continue
        body = der_length(bytes.fromhex(m[0][:12]), 1)
        if body and 2 * body[1] <= len(m[0]) and is_der_key(bytes.fromhex(m[0][: 2 * body[1]])):
            out.append(("der", m.start(), m.start() + 2 * body[1]))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], REPLACEMENT]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, text_col: str = "text", redact: bool = False, name: str = "found") -> DataFrame:
    """Add a struct: n_assign, n_access, n_hex, base_sha256, spans and, if asked for, the redacted text (null: null)."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    def scan(texts):
        import pandas as pd

        rows = []
        for t in texts:
            base = base_spans(t or "")
            more = base + structural_spans(t or "")
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            rows.append((*n, hashlib.sha256(in_order(base).encode()).hexdigest(), in_order(more), redacted(t, more) if redact and t and more else t if redact else None))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return docs.withColumn(name, scan(F.col(text_col)))
