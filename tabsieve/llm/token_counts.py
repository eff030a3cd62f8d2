"""Token counts by the whole-token shortcut: pre-tokens proved to be one token need no merging."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from tabsieve.llm.batches import map_rows
from tabsieve.llm.merges import Merges, Numbering, Parts, cut_all, in_slices

#: Texts of these characters only are cut into pieces here; any other text goes to the library whole. In this range
#: composition leaves texts as they are, lower case works character by character, and all Unicode versions agree.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-ɏ‐-‧‰-⁞₠-₿]*")
#: The pre-token pattern of the vocabulary file, letters and digits of the plain range by class.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def load_tokenizer(path: str):
    """The library's tokenizer without truncation or padding."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


def _spelled() -> dict[str, int]:
    """Character -> byte that byte-level vocabularies write with it."""
    spelled = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    return spelled | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in spelled.values())}


def single_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that the library encodes, standing alone, as exactly one token, with its id.

    The proof is by exhaustion: each vocabulary entry that ends a word is spelled out as text and
    encoded. The table is bounded by the vocabulary of the file (some 50,000 entries).
    """
    tokenizer, spelled, words = load_tokenizer(path), _spelled(), []
    for entry in tokenizer.get_vocab():
        if entry.endswith("</w>") and all(c in spelled for c in entry[:-4]):
            try:
                words.append(bytes(spelled[c] for c in entry[:-4]).decode())
            except UnicodeDecodeError:
                continue
    words = [w for w in words if w and is_plain(w)]
    found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
    return {w: e.ids[0] for w, e in zip(words, found) if len(e.ids) == 1}


class WordEncoder:
    """Tokens of white-space separated pieces of plain texts: whole tokens directly, the rest by merge replay."""

    def __init__(self, path: str, whole: dict[str, int]):
        import regex
        model = json.loads(Path(path).read_text())["model"]
        vocab, self.whole = model["vocab"], whole
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, merged = (np.array([vocab[x] for x in side], np.int64) for side in
                               ((a for a, _ in pairs), (b for _, b in pairs), (a + b for a, b in pairs)))
        self.merges = Merges(left, right, np.arange(len(pairs)), merged)
        letters = {b: c for c, b in _spelled().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int32)
        self.cut = regex.compile(_PRETOKEN).findall

    def words(self, words: list[str]) -> Parts:
        """Ids of pre-tokens."""
        known = np.array([self.whole.get(w, -1) for w in words], np.int64)
        rest = [w.encode() for w, i in zip(words, known.tolist()) if i < 0]
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        flat = np.frombuffer(b"".join(rest), np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        ids, counts = self.merges.replay(symbols, sizes)
        n = np.ones(len(words), np.int64)
        n[known < 0] = counts
        out = np.empty(int(n.sum()), np.int32)
        alone = np.repeat(known >= 0, n)
        out[alone], out[~alone] = known[known >= 0], ids
        return Parts(out, n)

    def encode(self, texts: list[str]) -> tuple[Parts, list[np.ndarray]]:
        """Ids per distinct piece, and each plain text as numbers of pieces."""
        pieces = Numbering()
        numbers = [pieces.of(t.lower().split()) for t in texts]
        words, flat, sizes = cut_all(pieces, self.cut)
        return self.words(list(words)).merged(flat, sizes), numbers


def encoded_slices(df: DataFrame, columns: list[str], path: str, schema: str, emit: Callable, slice_chars: int = 16_000_000) -> DataFrame:
    """``emit(values, text, ids)`` over rows of ``columns``, the last being the text; ``ids`` are those of the library.

    ``ids`` is a pair (Parts, numbers) for plain texts, whose counts need no joined ids, and (None, array) for
    texts that the library encodes itself.
    """
    proved = df.sparkSession.sparkContext.broadcast(single_tokens(path))

    def make():
        encoder, tokenizer = WordEncoder(path, proved.value), load_tokenizer(path)

        def slices(rows, texts):
            plain = [is_plain(t) for t in texts]
            parts, numbers = encoder.encode([t for t, p in zip(texts, plain) if p])
            ahead = iter(numbers)
            for values, text, p in zip(rows, texts, plain):
                if p:
                    yield from emit(values, text, parts, next(ahead))
                else:
                    ids = tokenizer.encode(text, add_special_tokens=False).ids
                    yield from emit(values, text, None, np.array(ids, np.int32))
        return in_slices(slices, slice_chars)

    return map_rows(df.select(*columns), schema, make, finish=True)


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str, limit: int) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` per row of ``df``.

    Counts are those of the library without added special tokens; special strings inside texts are
    recognised as it does by default. Null and empty texts have no bytes and no tokens; repeated rows and
    null ids stay; other columns are ignored; an empty table gives an empty table. A text outside the
    plain range (combining marks, other scripts, special strings) is counted by the library itself.
    """
    def emit(values, text, parts, numbers):
        n = len(numbers) if parts is None else int(parts.counts[numbers].sum())
        yield values[0], len(text.encode()), n, n > limit

    kind = df.schema[id_col].dataType.simpleString()
    return encoded_slices(df, [id_col, text_col], path, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean", emit)
