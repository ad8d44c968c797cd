"""Secret scan: an Aho-Corasick keyword prefilter, anchored regular expressions at its hits, then checksum validation.

The automaton finds, in one pass over a text, every place where a keyword of some kind begins; the kind's expression
is tried only there, anchored. Taken in order and without overlap, such matches are those of a scan with the whole
expression, since every match begins with a keyword. Runs of hexadecimal digits have no keyword and are scanned for.
Tokens that embed a checksum (CRC-32 in base 62, decodable JSON in base 64url, PEM frames) count only if it holds.

Scale: one pass in tasks, no shuffle; memory is bounded by a batch of rows.

Time grows in proportion to a text: no expression looks twice at a stretch that no match covers, whatever is repeated in it.

Edge cases: null and empty texts have no spans; very long texts are scanned whole, in memory; a token whose header can't be decoded, for
whatever reason, is none; repeated rows get equal answers; an empty table gives an empty result;
other columns of the input are ignored; positions count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import string
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower

# Kinds in their listed order, keywords (lower case) and anchored expressions.
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", re.ASCII)
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", re.ASCII)
#: A token of three parts between dots, of which the first two begin with eyJ; _Jwt reads its parts.
_PART = re.compile(r"[A-Za-z0-9_-]*+", re.ASCII)
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----", re.ASCII)
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def _crc_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of the body before them, in base 62."""
    body, tail = token.partition("_")[2][:-6], token[-6:]
    n = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return digits == tail


def _json_holds(token: str) -> bool:
    """The header is a JSON object with an algorithm; no header is nested so deep that Python can't read it."""
    try:
        head = token.split(".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError, RecursionError):
        return False


class _Jwt:
    """Matches of `eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+` at rising places of one text.

    A keyword may stand many times in one run of characters, whose end alone decides about all of them: it is
    looked for once, and what follows it is, too.
    """

    def __init__(self, text: str):
        self.text, self.run, self.token = text, 0, None

    def end(self, start: int) -> int | None:
        """Where the token that begins at start ends."""
        if start >= self.run:
            self.run = _PART.match(self.text, start).end()
            self.token = self._rest(self.run)
        return self.token if start + 3 < self.run else None

    def _rest(self, dot: int) -> int | None:
        if not self.text.startswith(".eyJ", dot):
            return None
        second = _PART.match(self.text, dot + 1).end()
        if second == dot + 4 or not self.text.startswith(".", second):
            return None
        third = _PART.match(self.text, second + 1).end()
        return third if third > second + 1 else None


def _pem_holds(token: str) -> bool:
    try:
        return len(base64.b64decode("".join(token.split("-----")[2].split()), validate=True)) >= 32
    except (ValueError, binascii.Error):
        return False


#: kind: (keywords, expression or None for _Jwt, what a match must satisfy), in the order in which kinds are listed.
KINDS = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[1]) >= 12),
    "access": (("akia",), _ACCESS, lambda m: len(m[0]) >= 18),
    "hex": ((), _HEX, lambda m: True),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _GITHUB, lambda m: _crc_holds(m[0])),
    "npm": (("npm_",), _NPM, lambda m: _crc_holds(m[0])),
    "jwt": (("eyj",), None, _json_holds),
    "pem": (("-----begin ",), _PEM, lambda m: _pem_holds(m[0])),
}
ORDER = {k: i for i, k in enumerate(KINDS)}
BASE = ("assign", "access", "hex")


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (keywords, _, _) in KINDS.items():
        for word in keywords:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text, by start, then kind as listed."""
    spans = []
    over = dict.fromkeys(KINDS, 0)
    hits = sorted((end - length + 1, ORDER[kind], kind) for end, (kind, length) in _automaton().iter(ascii_lower(text)))
    jwt = _Jwt(text)
    for start, _, kind in hits:
        if start < over[kind]:
            continue
        expression, holds = KINDS[kind][1:]
        if expression:
            found = expression.match(text, start)
            end = found.end() if found else None
        else:
            end = jwt.end(start) if text.startswith("eyJ", start) else None
            found = text[start:end] if end else None
        if end:
            over[kind] = end
            if holds(found):
                spans.append((start, ORDER[kind], end))
    spans += [(m.start(), ORDER["hex"], m.end()) for m in _HEX.finditer(text)]
    kinds = list(KINDS)
    return [(kinds[k], start, end) for start, k, end in sorted(spans)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            spans = scan(text or "")
            base = [x for x in spans if x[0] in BASE]
            rows.append((doc_id, *(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [text[s:e] for _, s, e in spans]))
        yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "matches"])


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: counts of the base kinds, the digest of base spans, all spans, and the matched texts."""
    # An id travels as text: pandas would make a column of integers with nulls one of floats.
    found = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).mapInPandas(
        _scan_batches, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, matches array<string>"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
