"""Byte-level BPE by replaying merges over all distinct words of a slice of the corpus at once."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.batches import map_rows
from tabsieve.llm.merges import Merges, Numbering, Parts, cut_all, in_slices


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> Merges:
    """Every way to put a listed entry together from two listed ones; the entry's rank decides."""
    found = [(left, right, rank) for entry, rank in ranks.items() for i in range(1, len(entry))
             if (left := ranks.get(entry[:i])) is not None and (right := ranks.get(entry[i:])) is not None]
    left, right, rank = np.array(found, np.int64).T if found else np.zeros((3, 1), np.int64) - 1
    return Merges(left, right, np.maximum(rank, 0), np.maximum(rank, 0))


class Codec:
    """Encoder of whole texts after the pattern; a listed word is its own id, as in the library."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks, self.merges = ranks, merges_of(ranks)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cut = regex.compile(pattern).findall
        self.spaced = regex.compile(r"\s \s").search
        self.near = [chr(c) + " " for c in range(0x3001) if c != 32 and chr(c).isspace()]
        entries = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            entries[i] = entry
        self.bytes = Parts(np.frombuffer(b"".join(entries), np.uint8), np.fromiter(map(len, entries), np.int64))

    def split(self, text: str) -> list[str]:
        """Pieces that the pattern never joins: each starts with the single space before it.

        Where white space meets white space the whole text is cut by the pattern itself.
        """
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or "  " in text or any(n in text for n in self.near) and self.spaced(text):
            return self.cut(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def words(self, words: list[bytes]) -> Parts:
        """Ids of words (pattern matches)."""
        listed = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        rest = [w for w, i in zip(words, listed.tolist()) if i < 0]
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        ids, counts = self.merges.replay(self.first[np.frombuffer(b"".join(rest), np.uint8)], sizes)
        n = np.ones(len(words), np.int64)
        n[listed < 0] = counts
        out = np.empty(int(n.sum()), np.int32)
        alone = np.repeat(listed >= 0, n)
        out[alone], out[~alone] = listed[listed >= 0], ids
        return Parts(out, n)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; all distinct words of the texts are merged together."""
        pieces = Numbering()
        numbers = [pieces.of(self.split(t)) for t in texts]
        words, flat, sizes = cut_all(pieces, self.cut, " ")
        ids = self.words([w.encode() for w in words]).merged(flat, sizes)
        return map(ids.join, numbers)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.join(ids).tobytes()


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, slice_chars: int = 10_000_000,
                 digests: bool = False) -> DataFrame:
    """``id_col, ids`` per row: the ids of the whole text without special tokens.

    ``digests`` returns ``n_tokens, ids_sha256, decoded_sha256`` in place of the ids, the last from decoding
    them. A task replays merges over slices of about ``slice_chars`` characters of texts, which bounds its
    memory; slices never change a result. Null and empty texts have no ids; repeated rows and null ids stay;
    other columns are ignored; an empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        codec = Codec(load_ranks(path), pattern)
        names = [str(i) for i in range(len(codec.bytes.counts))]

        def emit(rows, texts):
            for (doc_id,), ids in zip(rows, codec.encode(texts)):
                if digests:
                    joined = " ".join(map(names.__getitem__, ids.tolist()))
                    yield (doc_id, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                else:
                    yield doc_id, ids.tolist()
        return in_slices(emit, slice_chars)

    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return map_rows(df.select(F.col(id_col), F.col(text_col)), f"{id_col} {kind}, {shape}", make, finish=True)


def decode_ids(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """``id_col, decoded`` (binary): the bytes that the ids stand for; null ids give null."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        by_id = {i: b for b, i in load_ranks(path).items()}
        return lambda doc_id, ids: [(doc_id, None if ids is None else b"".join(map(by_id.__getitem__, ids)))]

    return map_rows(df.select(F.col(id_col), F.col(ids_col)), f"{id_col} {kind}, decoded binary", make)
