"""URL filters: glob rules as one bit-parallel automaton.

All rules are packed into the bits of a few 64-bit words (multiword Shift-And). Bit ``j`` of a rule says that its first
``j`` tokens are matched; one step of shift, mask and self-loop moves all rules over one byte, for all URLs of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers

#: Stands between host and path in the scanned bytes; it occurs in no UTF-8 text, so a host wildcard can't reach the path.
_BORDER = b"\xff"
#: Host rules (verdict, host and path prefix) of the production filter.
HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Globs over canonical host and path that block a URL no host rule decides; ``*`` is any text, ``?`` one character.
BLOCK_GLOBS = ("*cheap-pills*", "*spam-farm*", "*casino*", "*/login*", "*/cart/*", "*.exe", "*.zip", "*/wp-admin/*", "*//*")


@dataclass(frozen=True)
class Automaton:
    """Packed rules: per byte the states that may advance and those that may stay; start and accept states."""

    advance: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    accept: tuple[tuple[int, int], ...]

    @staticmethod
    def of(globs: Sequence[bytes]) -> Automaton:
        sizes = [sum(c != 0x2A for c in g) + 1 for g in globs]
        words = max(1, -(-sum(sizes) // 64))
        advance, loop = np.zeros((256, words), dtype=np.uint64), np.zeros((256, words), dtype=np.uint64)
        start = np.zeros(words, np.uint64)
        accept, at = [], 0
        for glob in globs:
            start[at >> 6] |= np.uint64(1 << (at & 63))
            for c in glob:
                bit = np.uint64(1 << (at & 63))
                if c == 0x2A:
                    loop[:, at >> 6] |= bit
                    continue
                if c == 0x3F:
                    # the first byte of a character advances, the bytes that continue it stay
                    advance[:0x80, at >> 6] |= bit
                    advance[0xC0:, at >> 6] |= bit
                    loop[0x80:0xC0, at + 1 >> 6] |= np.uint64(1 << (at + 1 & 63))
                else:
                    advance[c, at >> 6] |= bit
                at += 1
            accept.append((at >> 6, at & 63))
            at += 1
        return Automaton(advance, loop, start, tuple(accept))

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """matched[row, rule] for whole rows; rows leave the scan as they end, so the work is the bytes there are."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        left = np.searchsorted(-sizes[order], -np.arange(1, (sizes.max() if n else 0) + 1), side="right")
        state = np.repeat(self.start[None, :], n, axis=0)
        first = offsets[:-1][order]
        carry = np.uint64(63)
        for i, live in enumerate(left.tolist()):
            now = state[:live]
            byte = raw[first[:live] + i]
            moved = now & self.advance[byte]
            after = moved << np.uint64(1)
            after[:, 1:] |= moved[:, :-1] >> carry
            now &= self.loop[byte]
            now |= after
        out = np.zeros((n, len(self.accept)), dtype=bool)
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & np.uint64(1)
        return out


def canonical(host: bytes, path: bytes) -> tuple[bytes, bytes]:
    """Host without user info, port and final dots; path with the escapes of unreserved characters undone."""
    if b"@" in host or b":" in host or host.endswith(b"."):
        host = _PORT.sub(b"", host.rpartition(b"@")[2]).rstrip(b".")
    return host, _ESCAPE.sub(_unescaped, path) if b"%" in path else path


_PORT, _ESCAPE = re.compile(rb":[0-9]*\Z"), re.compile(rb"%([0-9A-Fa-f]{2})")
#: The characters that an address never needs to escape.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def _unescaped(m: re.Match) -> bytes:
    c = bytes.fromhex(m[1].decode())
    return c if c in UNRESERVED.encode() else m[0]


def _host_glob(rule: str) -> bytes:
    host, slash, path = rule.partition("/")
    return b"*." + host.encode() + _BORDER + (slash + path).encode() + b"*"


def filter_urls(pages: DataFrame, url: str = "url", key: str = "page_id", host_rules: Sequence[tuple[str, str]] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """Verdict on every URL: rows (key, host, path, rule, verdict, glob).

    A host rule fits its host and all subdomains when the path starts with the rule's; the longest wins (ties: the
    first). They see host and path as the URL has them. Without one, the first glob that matches ``.host`` + path in
    canonical form blocks, else the URL is allowed. Null URLs and those without ``://`` have empty host and path, and fall to the globs. Repeated keys and rows each
    keep their own row; other columns are left out, whatever their names; an empty table gives no rows.
    """
    ranked = sorted(host_rules, key=lambda r: -len(r[1]))
    globs = [b"*" + g.encode() if not g.startswith("*") else g.encode() for g in block_globs]
    automata = Automaton.of([_host_glob(r) for _, r in ranked]), Automaton.of(globs)
    names, verdicts = [r for _, r in ranked], [v for v, _ in ranked]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = list(zip(*(b.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path")), strict=True))
            host_hit, glob_hit = (a.scan(*string_buffers(pa.array([b"." + h + _BORDER + p for h, p in x], pa.binary()))) for a, x in zip(automata, (parts, [canonical(*x) for x in parts]), strict=True))
            rule = np.where(host_hit.any(1), host_hit.argmax(1), -1).tolist() if names else [-1] * b.num_rows
            glob = np.where(glob_hit.any(1), glob_hit.argmax(1), -1).tolist() if globs else [-1] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key"),
                    b.column("host"),
                    b.column("path"),
                    pa.array([names[r] if r >= 0 else None for r in rule], pa.string()),
                    pa.array([verdicts[r] if r >= 0 else "block" if g >= 0 else "allow" for r, g in zip(rule, glob, strict=True)], pa.string()),
                    pa.array([block_globs[g] if r < 0 <= g else None for r, g in zip(rule, glob, strict=True)], pa.string()),
                ],
                names=[key, "host", "path", "rule", "verdict", "glob"],
            )

    whole = F.coalesce(F.col(url), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pages.select(F.col(key).cast("long").alias("key"), F.translate(F.regexp_extract(whole, parts, 1), upper, lower).alias("host"), F.regexp_extract(whole, parts, 2).alias("path"))
    return rows.mapInArrow(judge, f"`{key}` long, host string, path string, rule string, verdict string, glob string")
