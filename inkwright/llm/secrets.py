"""Secret scans: keyword automaton first, anchored patterns only near its hits, then checksums."""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import DataFrame

from ._arrow import map_texts, texts

KINDS = ("assign", "access", "hex", "github", "npm")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as any shorter start would be further right
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_WORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "npm_": 4} | {f"gh{x}_": 3 for x in "pousr"}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_AUTOMATON: list = []


def automaton():
    """The keyword automaton, built once per Python worker; its values are (kind, length)."""
    if not _AUTOMATON:
        import ahocorasick

        built = ahocorasick.Automaton()
        for word, kind in _WORDS.items():
            built.add_word(word, (kind, len(word)))
        built.make_automaton()
        _AUTOMATON.append(built)
    return _AUTOMATON[0]


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits, as tokens with an embedded checksum carry it."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return digits


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret in code points, by start and then kind.

    Per kind leftmost and non-overlapping: a match that is too short still uses up its text.
    github and npm spans count only if the last six of their 36 characters are the checksum of the first thirty.
    """
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    folded = text.encode().lower().decode()  # only A-Z change, so positions stay
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton().iter(folded))
    past = [0] * len(KINDS)
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == 0:
            if m := _ASSIGN.match(text, start):
                past[0] = m.end()
                if len(m[2]) >= 6:
                    found.append((start, 0, m.end()))
        elif kind == 1:
            if m := _ACCESS.match(text, start):
                past[1] = m.end()
                if m.end() - start >= 20:
                    found.append((start, 1, m.end()))
        elif m := (_GITHUB if kind == 3 else _NPM).match(text, start):
            if checksum62(m[1][:30]) == m[1][30:]:
                past[kind] = m.end()
                found.append((start, kind, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and positions of the secrets of every row.

    Null or empty text: no spans, and the digest of the empty string. Null ids and repeated rows
    pass through, one row each; other columns are ignored; an empty table gives none.
    """

    def run(ids: list, values: list[str]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans")}
        for text in values:
            spans = scan(text)
            base = [s for s in spans if s[1] < 3]
            for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == kind for s in base))
            out["n_checked"].append(len(spans) - len(base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return {"doc_id": ids} | out

    return map_texts(texts(df, id_col, text_col), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")
