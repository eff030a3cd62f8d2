"""Quality rules by host: failures per domain, shrunk towards an empirical beta prior, judged back onto documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.batches import free_name, give_back, map_rows
from tabsieve.session import broadcast_if, materialise, spread_lookup

#: Documents that the prior weighs at least.
LEAST_WEIGHT = 8.0
_SYMBOLS = "#*$%&|<>"
_WINDOW = 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Number of words inside an 8-word window that occurs at least twice, first occurrences included."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    mixed = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)  # equal within this process, which is all that counts
    sums = np.zeros(n, np.uint64)
    for k in range(_WINDOW):
        sums += mixed[k:k + n] * _ODD[k]
    order = np.sort(sums)
    if not (order[1:] == order[:-1]).any():
        return 0
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}  # equal sums are confirmed on the words themselves
    for i in np.flatnonzero(maybe).tolist():
        seen.setdefault(tuple(words[i:i + _WINDOW]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for starts in seen.values():
        if len(starts) > 1:
            for i in starts:
                edge[i] += 1
                edge[i + _WINDOW] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_measures(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of a whole text; null counts as empty."""
    text = text or ""
    words = text.encode().split()  # splits at the six ASCII white-space characters only
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\v\f\r"):
            seen.add(line)
    repeated = repeated_words(words)
    return len(words), chars, symbols, dup, repeated, len(words) < 20 or 100 * repeated > 30 * len(words)


def rule_measures(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``id_col, host_col`` and the base measures per row."""
    kinds = dict(df.dtypes)
    schema = (f"{id_col} {kinds[id_col]}, {host_col} {kinds[host_col]}, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long, base_failed boolean")
    return map_rows(df.select(id_col, host_col, text_col), schema, lambda: lambda i, h, t: [(i, h, *base_measures(t))])


def host_rates(measured: DataFrame, host_col: str, max_rate: float = 0.5) -> DataFrame:
    """``host_col, n, failed, rate, rejected`` per host: the failure rate shrunk by a beta prior.

    The prior has the mean of all documents; its weight comes from the spread of the hosts' rates beyond
    what chance gives (moments), and is at least ``LEAST_WEIGHT`` documents, so that a few pages alone never
    condemn a host. Hosts without spread share the mean. A host is rejected when its shrunk
    rate exceeds ``max_rate``. Documents without a host belong to none.
    """
    hosts = materialise(measured.where(F.col(host_col).isNotNull()).groupBy(host_col)
                        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    total = hosts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("failed"), F.sum(F.col("n") * F.col("n"))).first()
    if not total[0]:
        alpha, beta = 1.0, 1.0
    else:
        k, n, failed, squares = total
        mean = (failed + 0.5) / (n + 1.0)
        scatter = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - mean, 2))).first()[0]
        # E[scatter] = mean (1 - mean) ((k - 1) + rho (n - k - (squares / n - 1)))  with rho = 1 / (alpha + beta + 1)
        room = n - squares / n - (k - 1)
        rho = (scatter / (mean * (1 - mean)) - (k - 1)) / room if k > 1 and room > 0 else 0.0
        weight = max(LEAST_WEIGHT, 1 / min(max(rho, 1e-6), 0.999999) - 1)
        alpha, beta = mean * weight, (1 - mean) * weight
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("rejected", rate > max_rate)


def rejected_hosts(measured: DataFrame, host_col: str, max_rate: float = 0.5) -> tuple[DataFrame, float]:
    """The rejected hosts as a stored table, and its size in bytes."""
    bad = materialise(host_rates(measured, host_col, max_rate).where("rejected").select(host_col, "n", "rate"))
    return bad, bad.agg(F.sum(F.octet_length(F.col(host_col).cast("string")) + 48)).first()[0] or 0


def _with_verdict(rows: DataFrame, bad: DataFrame, size: float, host_col: str, flag: str = "_bad") -> DataFrame:
    """Adds ``flag``: true for rows of a rejected host, null for others."""
    verdict = bad.select(host_col, F.lit(True).alias(flag))
    if broadcast_if(verdict, size) is not verdict:
        return rows.join(F.broadcast(verdict), host_col, "left")
    total = bad.agg(F.sum("n")).first()[0]
    return spread_lookup(rows, verdict, [host_col], bad.select(host_col, F.col("n").alias("_rows")), total, "left")


def host_verdicts(df: DataFrame, id_col: str, text_col: str, host_col: str, max_rate: float = 0.5) -> DataFrame:
    """Base measures, ``base_failed``, ``host_rejected`` and ``kept`` per row of ``df``.

    A document is kept unless it fails the base rules or its host is rejected. Null and empty texts have
    no words and fail; a null host is no host, so only the base rules judge its documents; null ids and
    repeated rows stay; other columns are ignored; an empty table gives an empty table.
    """
    measured = materialise(rule_measures(df, id_col, text_col, host_col))
    bad, size = rejected_hosts(measured, host_col, max_rate)
    rejected = F.coalesce("_bad", F.lit(False))
    return (_with_verdict(measured, bad, size, host_col)
            .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept")))


def keep_documents(df: DataFrame, text_col: str, host_col: str, max_rate: float = 0.5) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns, whatever their names. Texts are read twice rather than shuffled.

    Null and empty texts fail; a null host is no host; repeated rows pass or fail together; an empty table
    gives an empty table.
    """
    import pyarrow as pa

    at, columns, schema = df.columns.index(text_col), df.columns, df.schema
    measured = materialise(rule_measures(df.select(F.lit(0).alias("_row"), F.col(host_col), F.col(text_col)), "_row", text_col, host_col)
                           .select(host_col, "base_failed"))
    bad, size = rejected_hosts(measured, host_col, max_rate)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not base_measures(v.as_py())[-1] for v in batch.column(at)], pa.bool_()))
        give_back()

    flag = free_name(columns, "_bad")
    return _with_verdict(df.mapInArrow(run, schema), bad, size, host_col, flag).where(F.col(flag).isNull()).select(*[F.col(f"`{c}`") for c in columns])
