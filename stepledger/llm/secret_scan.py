"""Secret scans: an Aho-Corasick keyword pass, anchored expressions near its hits, checksums inside the match.

One automaton finds every keyword of a text in one pass. Only at a hit does the
expression of its kind run, anchored at the hit; so a match is leftmost and a failed one
still uses up its text, as an unanchored search would do. Runs of hexadecimal digits have
no literal keyword; one linear search finds those long enough.

Tokens that carry a checksum (``github``, ``npm``) count only if it holds; a private key
block only if its body decodes.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepledger.llm.common import fresh

# The kinds in their order, their keywords and their expressions.
KINDS = ("assign", "access", "hex", "github", "npm", "private_key")
BASE_KINDS = ("assign", "access", "hex")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "private_key": ("-----BEGIN ",),
}
ANCHORED = {
    "assign": re.compile(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "private_key": re.compile(
        r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----", re.ASCII
    ),
}
HEX = re.compile(r"[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

SPANS = "array<struct<kind:string,start:int,stop:int>>"


def base62_crc(body: str) -> str:
    """The CRC-32 of ``body`` in six base-62 digits, as token issuers append it."""
    n, digits = binascii.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0")


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= ASSIGN_LEAST
    if kind == "access":
        return m.end() - m.start() >= ACCESS_LEAST
    if kind == "private_key":
        try:
            return len(base64.b64decode("".join(m[2].split()), validate=True)) > 0
        except (binascii.Error, ValueError):
            return False
    return base62_crc(m[1]) == m[2]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for k in keywords:
            found.add_word(k.lower(), (kind, len(k)))
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """All secrets of a text as (kind, start, end) in code points, by start, then kind."""
    low = text.lower()
    if len(low) != len(text):  # a few characters grow in lower case; offsets must hold
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    spans = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    reached: dict[str, int] = {}
    for last, (kind, size) in _automaton().iter(low):
        start = last - size + 1
        if start >= reached.get(kind, 0) and (m := ANCHORED[kind].match(text, start)):
            reached[kind] = m.end()
            if _valid(kind, m):
                spans.append((kind, start, m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(
            [[{"kind": k, "start": a, "stop": b} for k, a, b in find(t)] if t else [] for t in batch]
        )


def _blanked(text: str, mark: str) -> str:
    out, at = [], 0
    for kind, start, stop in find(text):
        if stop <= at:
            continue
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = stop
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with the array column ``out`` of (kind, start, stop); empty for null and empty texts.

    Whole texts are searched. Rows stay where they are: nothing is shuffled.
    """
    return docs.withColumn(out, F.pandas_udf(_spans, SPANS)(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[{kind}]", length: str | None = None) -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; overlapping spans give the first one's mark.

    Null texts stay null. ``length`` names a column that then holds the new number of code points.
    """

    @F.pandas_udf("string")
    def blanked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_blanked(t, mark) if t else t for t in batch])

    done = docs.withColumn(text, blanked(F.col(text)))
    if length:
        done = done.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return done


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(kept, one), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: how many secrets of each base kind, the digest of the base spans, and all spans."""
    at = fresh(docs, "found")
    # Of the row, only the id and the text go on; the spans are made once.
    found = scan(docs.select(F.col(doc_id), F.col(text)), text, at)
    many = lambda kind: F.size(F.filter(F.col(at), lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[many(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.col(at), BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        listed(F.col(at)).alias("spans"),
    )
