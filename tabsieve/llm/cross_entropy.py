"""Cross-entropy difference: target and background bigram models over one vocabulary score each document.

Every word and every (previous word, word) pair is counted. Texts are numbered once in slices; a slice sends
each of its distinct words and pairs once to a bucket chosen by their key, buckets add the counts of all
slices and answer with the totals in the order asked, and slices score their documents with the answers.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.batches import map_rows
from tabsieve.llm.merges import Numbering
from tabsieve.session import broadcast_if, materialise

_FLUSH = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def vocabulary(df: DataFrame, text_col: str, size: int) -> list[str]:
    """At most ``size`` words (A-Z lower-cased), most frequent first; index 0 stands for all others.

    Every word as frequent as the threshold is in: the lowest step of a ladder (16 steps per doubling) that
    at most ``size`` words of all texts reach. So the driver gets a histogram and the words themselves, however
    many tasks count.
    """
    def make():
        held: Counter[bytes] = Counter()

        def flush():
            out = [(w.decode(), n) for w, n in held.items()]
            held.clear()
            return out

        def row(*values):
            if not values:
                return flush()
            held.update(_words(values[0]))
            return flush() if len(held) > _FLUSH else ()
        return row

    counted = map_rows(df.select(text_col), "word string, n long", make, finish=True).groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 16 + 1e-9).cast("int")))
    steps = sorted(counted.groupBy("step").count().collect(), reverse=True)
    reached, lowest = 0, None
    for step, n in steps:
        reached += n
        if reached > size:
            break
        lowest = step
    if lowest is None:
        return []
    return [w for w, _ in sorted(counted.where(F.col("step") >= lowest).select("word", "n").collect(), key=lambda r: (-r[1], r[0]))]


class Numbers(dict):
    """Word -> number in the vocabulary from 1; 0 for words outside it."""

    def __init__(self, words: list[str]):
        super().__init__((w.encode(), i + 1) for i, w in enumerate(words))

    def __missing__(self, word: bytes) -> int:
        return 0

    def of(self, text: str | None) -> np.ndarray:
        words = _words(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def bigram_slots(ids: np.ndarray, slots: int) -> np.ndarray:
    """Slot of each (previous word, word); the first word follows number 0. ``slots`` is a power of two."""
    previous = np.concatenate([np.zeros(1, np.int64), ids[:-1]]).astype(np.uint64)
    mixed = ((previous << np.uint64(24)) + ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * _MIX) >> np.uint64(64 - int(slots).bit_length() + 1)).astype(np.int64)


def count_models(df: DataFrame, text_col: str, target: Column, words: list[str], slots: int) -> dict[str, np.ndarray]:
    """Word and bigram counts of all documents (background) and of the target ones.

    A task sums its own documents before anything is sent. Returns arrays ``uni_target, uni_back,
    bi_target, bi_back``; the two parameters bound their size, whatever the input.
    """
    shared = df.sparkSession.sparkContext.broadcast(words)
    n_uni = len(words) + 1

    def make():
        numbers = Numbers(shared.value)
        sums = np.zeros((2, n_uni + slots), np.int32)

        def row(*values):
            if values:
                ids = numbers.of(values[0])
                if len(ids):
                    both = np.concatenate([ids, n_uni + bigram_slots(ids, slots)])
                    at, n = np.unique(both, return_counts=True)
                    sums[1][at] += n.astype(np.int32)
                    if values[1]:
                        sums[0][at] += n.astype(np.int32)
                return ()
            at = np.flatnonzero(sums[1])
            return zip(at.tolist(), sums[0][at].tolist(), sums[1][at].tolist())
        return row

    rows = df.select(F.col(text_col), F.coalesce(target, F.lit(False)).alias("_target"))
    total = (map_rows(rows, "slot int, t long, b long", make, finish=True)
             .groupBy("slot").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow())
    out, at = np.zeros((2, n_uni + slots)), total["slot"].to_numpy()
    out[0][at], out[1][at] = total["t"].to_numpy(), total["b"].to_numpy()
    return {"uni_target": out[0][:n_uni], "uni_back": out[1][:n_uni], "bi_target": out[0][n_uni:], "bi_back": out[1][n_uni:]}


def score_documents(df: DataFrame, id_col: str, text_col: str, target: Column, words: list[str], models: dict[str, np.ndarray],
                    slots: int, weight: float = 16.0) -> DataFrame:
    """``id_col, n_tokens, ce_target, ce_background, ce_difference`` per row, in nats per word.

    Every document is held out: its own counts are taken off the background, and off the target when
    ``target`` says that it is in there.

    Each model mixes its bigrams with its own words, and these with a uniform share: matched order,
    smoothing and vocabulary. Background counts are scaled to the number of target words first, so that
    the smoothing weighs the same in both. Documents without words have null losses.
    """
    n_uni = len(words) + 1
    t_total, b_total = models["uni_target"].sum(), models["uni_back"].sum()
    scale = t_total / b_total if b_total and t_total else 1.0
    tables = {}
    for name, factor in (("target", 1.0), ("back", scale)):
        uni = models[f"uni_{name}"] * factor
        tables[name] = (uni, uni.sum(), models[f"bi_{name}"] * factor, factor)
    shared = df.sparkSession.sparkContext.broadcast((words, tables))

    def make():
        names, both = shared.value
        numbers = Numbers(names)

        def losses(ids, spots, table, inside):
            uni, total, bi, factor = table
            before = np.concatenate([np.zeros(1, np.int64), ids[:-1]])
            words_n, context_n, seen, n = uni[ids], uni[before], bi[spots], total
            if inside:
                names, at, times = np.unique(ids, return_inverse=True, return_counts=True)
                mine = np.append(times[at], times[0] if names[0] == 0 else 0)  # the first word follows number 0
                _, at, pairs = np.unique(spots, return_inverse=True, return_counts=True)
                words_n, context_n = words_n - factor * mine[:-1], context_n - factor * np.roll(mine, 1)[:-1]
                seen, n = seen - factor * pairs[at], n - factor * len(ids)
            share = (words_n + 1.0) / (n + n_uni)
            # Slots are shared, so a slot can exceed its context; the larger of the two keeps a probability.
            p = (seen + weight * share) / (np.maximum(context_n, seen) + weight)
            return float(-np.log(p).mean())

        def row(doc_id, text, inside):
            ids = numbers.of(text)
            if not len(ids):
                return [(doc_id, 0, None, None, None)]
            spots = bigram_slots(ids, slots)
            t, b = losses(ids, spots, both["target"], inside), losses(ids, spots, both["back"], True)
            return [(doc_id, len(ids), t, b, t - b)]
        return row

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(F.col(id_col), F.col(text_col), F.coalesce(target, F.lit(False)).alias("_target")),
                    f"{id_col} {kind}, n_tokens long, ce_target double, ce_background double, ce_difference double", make)


def _packed(values: np.ndarray) -> bytes:
    """Compressed by byte places, as the upper bytes hardly differ."""
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, n * size, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def _digests(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=10).digest() for w in words), _DIGEST)


_DIGEST = np.dtype([("key", "<u8"), ("check", "<u2")])
#: Words hold no blanks, so these two stand beside all words: the place before a text, and "counted alone".
_START, _ALONE = _digests([b" start", b" alone"])


def numbered_slices(df: DataFrame, id_col: str, text_col: str, target: Column, slice_chars: int = 6_000_000) -> DataFrame:
    """One row per slice of a task: its documents as numbers into the slice's own words, and digests of these."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        context, state = TaskContext.get(), {"made": 0}

        def start():
            state.update(numbers=Numbering(), ids=[], inside=[], lengths=[], words=[], chars=0)

        def flush():
            if not state["ids"]:
                return
            lengths, inside = np.array(state["lengths"], np.int64), np.array(state["inside"], bool)
            some = lengths > 0
            words = list(state["numbers"])
            yield ((context.partitionId() << 32) + state["made"], int(lengths.sum()), int(lengths[inside].sum()), int(some.sum()),
                   int((some & inside).sum()), len(words), state["ids"], state["inside"], state["lengths"],
                   _packed(np.concatenate(state["words"]).astype(np.uint32)), _digests(words).tobytes())
            state["made"] += 1
            start()

        def row(*values):
            if not values:
                return flush()
            words = _words(values[1])
            state["ids"].append(values[0])
            state["inside"].append(values[2])
            state["lengths"].append(len(words))
            state["words"].append(np.asarray(state["numbers"].of(words), np.uint32))
            state["chars"] += len(values[1] or "") + 16
            return flush() if state["chars"] >= slice_chars else ()
        start()
        return row

    schema = (f"slice long, n long, n_target long, texts long, texts_target long, n_words long, ids array<{kind}>, inside array<boolean>, "
              "lengths array<long>, words binary, digests binary")
    return map_rows(df.select(F.col(id_col), F.col(text_col), F.coalesce(target, F.lit(False)).alias("_target")), schema, make, finish=True)


class Slice:
    """The words and pairs of a slice: a gram is a word (0 to ``n_words``) or, after these, a distinct pair."""

    def __init__(self, lengths, inside, n_words: int, words: bytes, digests: bytes, buckets: int):
        self.lengths, self.inside = np.array(lengths, np.int64), np.array(inside, bool)
        self.ids = _unpacked(words, int(self.lengths.sum()), np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])[:len(self.ids)]
        self.n_words = n_words
        before = np.where(self.first, n_words, np.roll(self.ids, 1))
        pairs, self.pair = np.unique(before * (n_words + 1) + self.ids, return_inverse=True)
        self.n_pairs = len(pairs)
        own = np.frombuffer(digests, _DIGEST)
        known = np.append(own, _START)
        left = np.append(np.full(n_words, _ALONE), known[pairs // (n_words + 1)])
        right = np.append(own, own[pairs % (n_words + 1)])
        # Sums of uniform digests are uniform; 64 bits and 15 more keep different grams apart: among 10 billion of them
        # two are expected to meet in 0.0001 cases. The lowest bit of the check tells words from pairs.
        key = left["key"] * _MIX + right["key"]
        check = (left["check"] * np.uint16(0x9E37) + right["check"]) & np.uint16(0xFFFE)
        check[:n_words] |= np.uint16(1)
        self.order = np.argsort(key, kind="stable")
        self.key, self.check = key[self.order], check[self.order]
        self.bucket = ((self.key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """Occurrences of every gram among the chosen tokens."""
        return np.concatenate([np.bincount(self.ids[tokens], minlength=self.n_words), np.bincount(self.pair[tokens], minlength=self.n_pairs)])

    def questions(self):
        """``bucket, grams, keys, checks, target counts, background counts`` per bucket, by rising key."""
        both = [self.counts(tokens)[self.order].astype(np.uint32) for tokens in (self.inside[self.doc], slice(None))]
        edges = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.bucket) else []
        for a, b in zip(edges, [*edges[1:], len(self.bucket)]):
            yield (int(self.bucket[a]), int(b - a), _packed(np.diff(self.key[a:b], prepend=np.uint64(0))), _packed(self.check[a:b]),
                   _packed(both[0][a:b]), _packed(both[1][a:b]))

    def losses(self, totals: np.ndarray, n: int, texts: int, factor: float, vocabulary: int, weight: float, held: np.ndarray) -> np.ndarray:
        """Mean loss per document in a model of ``totals`` per gram; ``held`` documents are taken off it first."""
        if not len(self.ids):
            return np.full(len(self.lengths), np.nan)
        off = held[self.doc]

        def own(number, size):
            _, at, times = np.unique(self.doc * size + number, return_inverse=True, return_counts=True)
            return np.where(off, times[at], 0)

        words, seen = totals[self.ids], totals[self.n_words + self.pair]
        mine = own(self.ids, self.n_words)
        context = np.where(self.first, texts - off, np.roll(words - mine, 1))
        share = (factor * (words - mine) + 1.0) / (factor * (n - np.where(off, self.lengths[self.doc], 0)) + vocabulary + 1)
        p = (factor * (seen - own(self.pair, self.n_pairs)) + weight * share) / (factor * context + weight)
        with np.errstate(invalid="ignore"):
            return np.bincount(self.doc, -np.log(p), len(self.lengths)) / self.lengths


_SLICE = ["lengths", "inside", "n_words", "words", "digests"]


def _totals(table: pa.Table) -> pa.Table:
    """Answers of one bucket: the counts of all slices added by key, for each slice in the order it asked."""
    sizes = table["grams"].to_numpy()

    def parts(name, kind):
        return [_unpacked(blob, n, kind) for blob, n in zip(table[name].to_pylist(), sizes.tolist())]

    key, check = np.concatenate([np.cumsum(d, dtype=np.uint64) for d in parts("key", np.uint64)]), np.concatenate(parts("check", np.uint16))
    order = np.lexsort((check, key))
    key, check = key[order], check[order]
    new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
    group, ends, found = np.cumsum(new) - 1, np.cumsum(sizes), []
    for name in ("t", "b"):
        total, out = np.bincount(group, np.concatenate(parts(name, np.uint32))[order]).astype(np.int64), np.empty(len(order), np.int64)
        out[order] = total[group]
        found.append([_packed(out[e - n:e]) for e, n in zip(ends.tolist(), sizes.tolist())])
    words = int((check[new] & 1).sum())
    return pa.table({"slice": table["slice"], "bucket": table["bucket"], "grams": table["grams"], "t": pa.array(found[0], pa.binary()),
                     "b": pa.array(found[1], pa.binary()), "vocabulary": pa.array([words] + [0] * (len(sizes) - 1), pa.int64())})


def score_exactly(df: DataFrame, id_col: str, text_col: str, target: Column, weight: float = 16.0, slice_chars: int = 6_000_000,
                  bucket_words: int = 2_000_000) -> DataFrame:
    """``score_documents`` with models of all words and all pairs; memory is that of a slice or a bucket.

    A bucket is planned for ``bucket_words`` words of text, so their number grows with the input, and holds
    each word or pair once per slice, so frequent ones do not gather in it.
    """
    slices = materialise(numbered_slices(df, id_col, text_col, target, slice_chars))
    n, n_target, texts, texts_target = (v or 0 for v in slices.agg(F.sum("n"), F.sum("n_target"), F.sum("texts"), F.sum("texts_target")).first())
    buckets = n // bucket_words + 1

    def make_questions():
        return lambda at, *values: ((at, *q) for q in Slice(*values, buckets).questions())

    asked = map_rows(slices.select("slice", *_SLICE), "slice long, bucket long, grams long, key binary, check binary, t binary, b binary",
                     make_questions)
    answers = materialise(asked.groupBy("bucket").applyInArrow(_totals, "slice long, bucket long, grams long, t binary, b binary, vocabulary long"))
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    scale = n_target / n if n and n_target else 1.0
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ce_target double, ce_background double, ce_difference double"

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        s, found = Slice(*[own[c][0].as_py() for c in _SLICE], buckets), found.sort_by("bucket")
        totals = []
        for name in ("t", "b"):
            got = [_unpacked(blob, k, np.int64) for blob, k in zip(found[name].to_pylist(), found["grams"].to_pylist())]
            totals.append(np.empty(len(s.order), np.int64))
            totals[-1][s.order] = np.concatenate([np.zeros(0, np.int64), *got])
        t = s.losses(totals[0], n_target, texts_target, 1.0, vocabulary, weight, s.inside)
        b = s.losses(totals[1], n, texts, scale, vocabulary, weight, np.ones(len(s.inside), bool))
        values = [pa.array(v, pa.float64(), mask=s.lengths == 0) for v in (t, b, t - b)]
        return pa.table([own["ids"].combine_chunks().flatten(), pa.array(s.lengths), *values],
                        names=[id_col, "n_tokens", "ce_target", "ce_background", "ce_difference"])

    return (slices.select("slice", "ids", *_SLICE).groupBy("slice")
            .cogroup(answers.select("slice", "bucket", "grams", "t", "b").groupBy("slice")).applyInArrow(score, schema))


def cross_entropy_difference(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, target: Column, vocabulary_size: int | None = None,
                             slots: int | None = None) -> DataFrame:
    """Fit both models on ``df`` and score all of it; ``target`` is a condition on ``labels`` (one row per id).

    The background is every document, the target the documents whose label satisfies ``target``. Null and
    empty texts have no words and null losses; ids without a label and null ids are background; an id
    labelled twice is a target if any of its labels is; repeated rows count and are scored each; other
    columns are ignored; an empty table gives an empty table. Without target documents the target model
    is uniform.

    All words and all pairs of words count, and the first word of a text follows the start of a text, which is
    counted once per text with words. Only a caller that gives both ``vocabulary_size`` and ``slots`` gets
    bounded models, which merge rare words and share counts between pairs.
    """
    if (vocabulary_size is None) != (slots is None):
        raise ValueError("give both vocabulary_size and slots, or neither")
    chosen = labels.where(target).select(F.col(id_col)).distinct().withColumn("_t", F.lit(True))
    marked = df.select(F.col(id_col), F.col(text_col))
    words = None if slots is None else vocabulary(marked, text_col, vocabulary_size)
    chosen = materialise(chosen)
    marked = marked.join(broadcast_if(chosen, chosen.count() * 32), id_col, "left")
    if words is None:
        return score_exactly(marked, id_col, text_col, F.col("_t"))
    models = count_models(marked, text_col, F.col("_t"), words, slots)
    return score_documents(marked, id_col, text_col, F.col("_t"), words, models, slots)
