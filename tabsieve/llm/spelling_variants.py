"""Spelling variants: one-edit neighbours of words over a reduced alphabet, verified on the words themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.batches import map_rows
from tabsieve.session import broadcast_if, materialise

#: Distinct words a task counts before it sends what it has.
COUNT_ENTRIES = 300_000
#: Symbols of the reduced alphabet, and the letters that are reduced.
SYMBOLS = "abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def word_counts(df: DataFrame, id_col: str, text_col: str, least_chars: int = 6, least_count: int = 5, delete_every: int = 0) -> DataFrame:
    """``word, n``: words of at least ``least_chars`` letters that occur ``least_count`` times or more in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With ``delete_every`` a run
    loses one letter where that number divides the CRC-32 of ``<id>:<run>`` (a null id counts as empty), the
    one at that CRC modulo its length. Null texts have no words; repeated rows count each time.
    """
    def make():
        total: Counter = Counter()

        def sent():
            out = list(total.items())
            total.clear()
            return out

        def row(*values):
            if not values:
                return sent()
            doc_id, text = values
            if text:
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(lower_ascii(text))).items():
                    if len(word) >= least_chars:
                        if delete_every:
                            h = zlib.crc32(word.encode(), start)
                            if h % delete_every == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1:]
                                if len(word) < least_chars:
                                    continue
                        total[word] += n
            return sent() if len(total) >= COUNT_ENTRIES else ()
        return row

    parts = map_rows(df.select(id_col, text_col), "word string, n long", make, finish=True)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reduced(word: Column) -> Column:
    """``word`` with each letter replaced by its symbol; characters outside ``LETTERS`` stay."""
    symbols = "".join(SYMBOLS[zlib.crc32(c.encode()) % len(SYMBOLS)] for c in LETTERS)
    return F.translate(word, LETTERS, symbols)


def neighbourhood(word: Column) -> Column:
    """All reduced words one edit or none away from a reduced word that are not longer than it.

    Insertions are left to the longer word of a pair, whose deletions are the same pairs seen from its side.
    """
    places = F.sequence(F.lit(1), F.char_length(word))

    def replaced(i):
        head, tail = F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))
        return F.transform(F.array(*map(F.lit, SYMBOLS)), lambda s: F.concat(head, s, tail))

    deleted = F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.array_distinct(F.concat(F.flatten(F.transform(places, replaced)), deleted))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every pair of words that differ by one edit, in both directions.

    The reduced words of a pair are equal or one edit apart as well, so the neighbourhoods joined with the
    reduced vocabulary give every pair once; the words themselves decide. ``words`` has each word once.
    """
    small = words.select(F.col("word").alias("u"), F.col("n").alias("u_n"), reduced(F.col("word")).alias("_reduced"))
    keys = small.select("u", "u_n", F.explode(neighbourhood(F.col("_reduced"))).alias("_near")).select("u", "u_n", F.xxhash64("_near").alias("_key"))
    vocabulary = words.select(F.col("word").alias("v"), F.col("n").alias("v_n"), F.xxhash64(reduced(F.col("word"))).alias("_key"))
    longer = F.char_length("u") > F.char_length("v")
    found = (keys.join(vocabulary.hint("shuffle_hash"), "_key")
             .where((longer | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1)))
    both = F.array(F.struct(F.col("u").alias("word"), F.col("u_n").alias("n"), F.col("v").alias("other"), F.col("v_n").alias("other_n")),
                   F.struct(F.col("v").alias("word"), F.col("v_n").alias("n"), F.col("u").alias("other"), F.col("u_n").alias("other_n")))
    return found.select(F.inline(both))


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``words`` (``word, n``, each word once, none null).

    ``form`` is the near word of largest count (of equal ones the smallest) if it occurs at least ``ratio`` times
    as often, else null; ``root`` follows the forms to the last. Counts grow along forms, so the chains end
    after a logarithm of the largest count. A word has at most some hundred near words per letter, so no
    group grows with the corpus. An empty table gives an empty table; other columns are ignored.
    """
    words = materialise(words.select("word", "n"))
    best = (near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b")))
    fits = -F.col("b.m") >= ratio * F.col("n")
    table = materialise(words.join(best, "word", "left")
                        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.other")).alias("form"),
                                F.when(fits, -F.col("b.m")).alias("form_n")))
    # Pointer jumping over the words that have a form: each round doubles the steps of every chain.
    jumps = materialise(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    size = jumps.agg(F.sum(F.octet_length("word") + F.octet_length("root") + 64)).first()[0] or 0
    while True:
        step = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = jumps.join(broadcast_if(step, size), "root", "left")
        jumps = materialise(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if jumps.where("_moved").isEmpty():
            break
    out = table.join(broadcast_if(jumps.select("word", "root"), size), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
