"""Secret scan: keyword automaton first, anchored expressions only at its hits, checksums where a token embeds one."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.batches import give_back, map_rows

#: Keyword -> kind whose expression is tried where the keyword starts.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
            "akia": "access",
            "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
#: Expressions anchored at a keyword.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
#: Runs of hexadecimal digits have no keyword; runs below the least length can be left out from the start, as runs do not overlap.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "github", "npm")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the thirty before them."""
    body, given = token[4:-6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == given


def lowered(text: str) -> str:
    """Lower case with every position kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def keyword_automaton():
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def find_secrets(text: str, automaton) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` in code points by start, then kind in the order of ``KINDS``.

    Matches of a kind are leftmost and do not overlap: a match too short to count still uses up its
    characters. Checksummed kinds are spans of their own beside the base kinds.
    """
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    hits = sorted((end - n + 1, kind) for end, (n, kind) in automaton.iter(lowered(text)))
    past = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[1]) >= 12
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and m.end() - start >= 18
        else:
            m = (GITHUB if kind == "github" else NPM).match(text, start)
            good = m and checksum_holds(m[0])
        if m:
            past[kind] = m.end()
        if good:
            spans.append((start, m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with every maximal run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, spans`` per row: array of (kind, start, end) over the whole text.

    Null and empty texts have no spans; repeated rows and null ids stay; other columns are ignored; an
    empty table gives an empty table. Spans that tie in their start follow ``KINDS``.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        automaton = keyword_automaton()
        return lambda doc_id, text: [(doc_id, [{"kind": k, "start": s, "end": e} for s, e, k in find_secrets(text or "", automaton)])]

    return map_rows(df.select(F.col(id_col), F.col(text_col)),
                    f"{id_col} {kind}, spans array<struct<kind:string,start:long,end:long>>", make)


def secret_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text, one row per row of ``df``."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(df, id_col, text_col).select(
        id_col, *[count(k) for k in ("assign", "access", "hex")], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"))


def mask_secrets(df: DataFrame, text_col: str, mask: str = "[masked]", length_col: str | None = None) -> DataFrame:
    """``df`` with secrets in ``text_col`` masked; null texts, texts without secrets and other columns stay as they are.

    ``length_col`` gets the code points of a text that changed. Repeated rows stay; column names do not matter,
    as no column is added; an empty table gives an empty table.
    """
    import pyarrow as pa

    at, long_at = df.columns.index(text_col), df.columns.index(length_col) if length_col in df.columns else -1

    def run(batches):
        give_back()
        automaton = keyword_automaton()
        for batch in batches:
            texts = [v.as_py() for v in batch.column(at)]
            clean = [t if t is None else masked(t, find_secrets(t, automaton), mask) for t in texts]
            arrays = list(batch.columns)
            arrays[at] = pa.array(clean, batch.schema.field(at).type)
            if long_at >= 0:
                known = [v.as_py() for v in batch.column(long_at)]
                arrays[long_at] = pa.array([k if a == b else len(b) for k, a, b in zip(known, texts, clean)], batch.schema.field(long_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
        give_back()

    return df.mapInArrow(run, df.schema)
