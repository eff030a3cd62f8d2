"""SpotSigs: chains of content words after common-word anchors, compared by set length and pruned Jaccard.

DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsieve.llm.histogram_sort import find_splitters, hash62, range_of
from tabsieve.session import materialise, partitions, spread_join

#: Common words of English, French, German and Spanish that open a chain.
ANCHORS = ("a an and are as at be by for from in is it of on or that the this to was with "
           "au avec dans de des du elle en est et la le les ne par pas pour que qui se sur un une "
           "als auf das dem den der die ein eine im ist mit nicht sich und von zu "
           "como con del el es las los no por su una y").split()
#: Content words of a chain.
CHAIN = 3
WORD_BREAK = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds ``name``: the sorted distinct hashes of (anchor, next ``CHAIN`` content words) of a text.

    The start of the text opens a chain too, cut short where words end. A text without a complete chain
    after an anchor is signed by every run of ``CHAIN`` consecutive words instead (fewer words: all of
    them), so that its whole text counts. An anchor at place i with j anchors before it has i - j content
    words before it; that is where its chain begins. Null and empty texts, and texts without a letter or
    digit, have none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
    out = df.withColumn("_w", words)
    out = out.withColumn("_c", F.filter("_w", lambda w: ~w.isin(ANCHORS)))
    spots = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(ANCHORS), F.struct(i.alias("i"), w.alias("w")))), lambda s: s.isNotNull())

    def chain(spot, j):
        at = spot["i"] - j
        whole = at + CHAIN <= F.size("_c")
        return F.when(whole, F.xxhash64(spot["w"], *[F.get("_c", at + k) for k in range(CHAIN)]))

    opening = F.xxhash64(*[F.get("_c", F.lit(k)) for k in range(CHAIN)], F.get("_w", F.lit(0)))
    out = out.withColumn("_found", F.filter(F.transform(spots, chain), lambda h: h.isNotNull()))
    last = F.greatest(F.size("_w") - CHAIN, F.lit(0))
    plain = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(""), *[F.get("_w", i + k) for k in range(CHAIN)]))
    every = (F.when(F.size("_found") > 0, F.array_append("_found", opening)).when(F.size("_w") > 0, plain)
             .otherwise(F.array().cast("array<long>")))
    return out.withColumn(name, F.sort_array(F.array_distinct(every))).drop("_w", "_c", "_found")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature arrays; 1 for two empty sets.

    Sets whose lengths alone keep it below ``least`` are pruned: 0 without a comparison.
    """
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (n + m - shared)
    return (F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0)
            .when(F.least(n, m) < F.greatest(n, m) * F.lit(float(least)), 0.0).otherwise(exact).cast("double"))


def spot_links(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> dict[str, DataFrame]:
    """Near-duplicate search: ``members`` (id, class_id) and ``links`` (u, v) between class representatives.

    A class holds the rows with one signature set; its id is the smallest id, and copies are not expanded.
    Sets are partitioned by length: a range of lengths meets only itself and the next, as others cannot
    reach ``threshold``. Inside, two sets meet on their rarest signatures only: sets that reach the
    threshold share one among the first ``n - ceil(threshold * n) + 1`` by rising frequency. Pairs are
    confirmed on the whole sets. Rows without signatures are classes of their own and have no links.
    """
    signed = with_signatures(df.select(F.col(id_col), F.col(text_col)), F.col(text_col), "_sig").select(id_col, "_sig")
    signed = materialise(signed.withColumn("_cls", F.when(F.size("_sig") > 0, F.md5(fingerprint(F.col("_sig"))))))
    named = signed.where("_cls IS NOT NULL").groupBy("_cls").agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("_rows"))
    heads = materialise(named.join(signed.select("_cls", "_sig").dropDuplicates(["_cls"]), "_cls"))
    rarity = heads.select(F.explode("_sig").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    # Ranges of lengths grow by 1 / threshold, so a set reaches into the next range at most.
    part = F.floor(F.log(F.size("_sig").cast("double")) / F.lit(-math.log(threshold)))
    ranked = (spread_join(heads.select("class_id", F.size("_sig").alias("n"), part.alias("part"), F.explode("_sig").alias("sig")), rarity, ["sig"])
              .withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))))
    first = materialise(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("class_id", "n", "part", "sig"))
    left = first.withColumn("_p", F.explode(F.array("part", F.col("part") + 1)))
    a, b = left.alias("a"), first.alias("b")
    met = (a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a._p") == F.col("b.part")) & (F.col("a.n") <= F.col("b.n"))
                  & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9) & (F.col("a.class_id") != F.col("b.class_id")))
           .select(F.least("a.class_id", "b.class_id").alias("u"), F.greatest("a.class_id", "b.class_id").alias("v")).distinct())
    pairs = (met.join(heads.select(F.col("class_id").alias("u"), F.col("_sig").alias("_a")), "u")
             .join(heads.select(F.col("class_id").alias("v"), F.col("_sig").alias("_b")), "v"))
    links = pairs.where(likeness(F.col("_a"), F.col("_b"), threshold - 1e-9) >= threshold).select("u", "v")
    members = (signed.select(id_col, "_cls").join(named.select("_cls", "class_id"), "_cls", "left")
               .select(id_col, F.coalesce("class_id", id_col).alias("class_id")))
    return {"members": members, "links": links}


def fingerprint(signature: Column) -> Column:
    """The whole signature set as text: 16 hex digits a signature, in order."""
    return F.array_join(F.transform(signature, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " ")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, text, next_text``: each row beside the next one by ascending id; the last is followed by the first.

    Ranges of ids come from the histogram sort, so that no task orders more than its share; the first
    row of a range also goes to the range before. Rows with one id follow each other by a hash of the
    row; null ids come first.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"))
    rows = rows.withColumn("_k1", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)))).withColumn("_k2", hash62(id_col, "text"))
    sizes = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    keys = materialise(rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), sizes.alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    n = max(1, partitions(df.sparkSession))
    splitters, _, _ = find_splitters(keys, [total * j // n for j in range(1, n)], total // n // 8)
    for s in splitters:
        s.copies = 0  # identical rows stay together: their order among themselves means nothing here
    part = lambda a, b: range_of(splitters, F.col(a), F.col(b), F.lit(0))
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in
                    keys.withColumn("p", part("k1", "k2")).groupBy("p").agg(F.min(F.struct("k1", "k2"))).collect())
    lead_of = {p: firsts[i - 1][0] for i, (p, _, _) in enumerate(firsts)}
    held = {p: {"k1": a, "k2": b, "to": lead_of[p]} for p, a, b in firsts}
    table = [held.get(p) for p in range(n)]
    first = F.from_json(F.lit(json.dumps(table)), "array<struct<k1:long,k2:long,to:int>>")
    placed = (rows.withColumn("_p", part("_k1", "_k2")).withColumn("_f", F.get(first, F.col("_p")))
              .withColumn("_to", F.when((F.col("_f.k1") == F.col("_k1")) & (F.col("_f.k2") == F.col("_k2")), F.col("_f.to")))
              .withColumn("_at", F.explode(F.filter(F.array(F.struct(F.col("_p").alias("p"), F.lit(0).alias("guest")),
                                                            F.struct(F.col("_to").alias("p"), F.lit(1).alias("guest"))),
                                                    lambda s: s["p"].isNotNull())))
              .select(id_col, "text", "_k1", "_k2", F.col("_at.p").alias("_p"), F.col("_at.guest").alias("_guest")))
    return placed.repartitionById(n, F.col("_p"))  # one range a task


def edited_likeness(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to that and to the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's. Null texts are empty; an only document is its own next; repeated rows stay; other
    columns are ignored; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = with_next(df.select(F.col(id_col), text.alias(text_col)), id_col, text_col)
    signed = with_signatures(placed, F.col("text"), "_sig")
    order = Window.partitionBy("_p").orderBy("_guest", "_k1", "_k2")
    paired = (signed.withColumn("_next", F.lead("text").over(order)).withColumn("_next_sig", F.lead("_sig").over(order))
              .where("_guest = 0").withColumn("n_chars", F.length("text").cast("long")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("_next", F.lit(1), half))
    both = with_signatures(paired.withColumn("_edited", edited), F.col("_edited"), "_edited_sig")
    return both.select(id_col, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
                       fingerprint(F.col("_sig")).alias("fingerprint"), fingerprint(F.col("_edited_sig")).alias("edited_fingerprint"),
                       likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"),
                       likeness(F.col("_sig"), F.col("_next_sig")).alias("near_next"))
