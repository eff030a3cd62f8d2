"""Periodic runs, chat formatting and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabsieve.llm import chat_format, periodic_runs, spelling_variants
from tabsieve.llm.queries import op11_periodic_runs, op12_chat_format, op13_spelling_variants


def hexdigest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            smallest = next(p for p in range(1, q + 1) if all(part[k] == part[k + p] for k in range(len(part) - p)))
            if len(part) >= max(6, 4 * q) and smallest == q:
                out.append((i, len(part), q))
            i = j
    return sorted(out)


def loops(draw, n, letters):
    """Random words with planted loops, nested ones too."""
    words = []
    while len(words) < n:
        block = [draw.choice(letters) for _ in range(draw.randint(1, 6))]
        words += block * draw.choice([1, 1, 2, 4, 5, 9]) + block[:draw.randint(0, len(block))]
    return words


def test_runs_equal_brute_force():
    draw = random.Random(5)
    for trial in range(400):
        words = loops(draw, draw.randint(0, 90), "ab" if trial % 3 == 0 else "abcdef" if trial % 3 == 1 else [f"w{i}" for i in range(30)])
        if trial % 5 == 0:
            words = words + ["end"] + words * 4 + words[:3]
        assert periodic_runs.find_runs(words) == brute_runs(words), words
    assert periodic_runs.find_runs(["a"] * 5) == [] and periodic_runs.find_runs(["a"] * 6) == [(0, 6, 1)]


def test_runs_of_long_texts_end_soon():
    assert periodic_runs.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    half = [f"w{i}" for i in range(50_000)]
    assert periodic_runs.find_runs(half * 4 + half[:7]) == [(0, 200_007, 50_000)]
    draw = random.Random(1)
    noise = [draw.choice("ab") for _ in range(20_000)]
    found = periodic_runs.find_runs(noise)
    assert found == sorted(set(found)) and all(length >= max(6, 4 * q) for _, length, q in found)


def test_segments_hold_no_rare_word():
    draw = random.Random(2)
    for _ in range(50):
        ids = [draw.randint(0, 12) for _ in range(draw.randint(1, 80))]
        import numpy as np
        for low, high in periodic_runs.surviving_segments(np.array(ids)):
            assert min(Counter(ids[low:high]).values()) >= 4


def test_periodic_runs_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b " * 4, "x"), (3, "a b " * 4, "x"), (3, "a b " * 4, "x"), (4, "no loop here", "y"), (5, "é " * 7 + "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1))
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(df, "doc_id", "text").collect())
    assert got == [(0, [(0, 8, 2)], "a b"), (1, [], ""), (2, [], ""), (3, [(0, 8, 2)], "a b"), (3, [(0, 8, 2)], "a b"), (4, [], "no loop here"), (5, [(0, 7, 1)], "é z")]
    assert periodic_runs.periodic_runs(df.limit(0), "doc_id", "text").count() == 0


def test_op11_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, small).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 1500 else periodic_runs.find_runs(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = got[doc_id]
        some += len(runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hexdigest("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r["collapsed_sha256"] == hexdigest(" ".join(w for i, w in enumerate(words) if i not in dropped))
    assert some > 5


PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]", "\\", "<", "[", "]", ">", " ", "a", "é", "\n", "<\\s>", "[\\\\INST]", "%", "S"]


def test_template_reads_back_any_text():
    draw, t = random.Random(3), chat_format.INSTRUCT
    for _ in range(3000):
        turns = [(draw.choice(["user", "assistant", "system", "tool", None, "", "a]b[/ROLE]", "%"]), "".join(draw.choices(PIECES, k=draw.randint(0, 8)))) for _ in range(draw.randint(0, 5))]
        text = "".join(t.turn(r).before + t.escape(x) + t.turn(r).after for r, x in turns)
        assert list(t.read(text)) == turns
    plain = "nothing to escape < here [or there]"
    assert t.escape(plain) == plain


def facts_of(turns):
    """Expected facts of ordered ``(role, text)`` turns."""
    t, before, accepted, size = chat_format.INSTRUCT, None, True, 0
    for i, (role, text) in enumerate(turns):
        accepted &= (before is not None or i == 0) and role in t.follows.get(before, ())
        before, size = role, size + len(t.turn(role).before + t.escape(text or "") + t.turn(role).after)
    said = [x or "" for r, x in turns if r == "assistant"]
    return (len(turns), hexdigest("".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)), len("".join(said)), hexdigest("".join(said)), size, accepted)


@pytest.mark.parametrize("row_chars", [1_000_000, 40])
def test_conversations_equal_brute_force(spark, monkeypatch, row_chars):
    monkeypatch.setattr(chat_format, "ROW_CHARS", row_chars)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", row_chars > 40)
    draw = random.Random(9)
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"turn {i} [INST]") for i in range(400)]  # a third of all turns
    for conv in range(1, 90):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "assistant", "system", "tool", None]), draw.choice([None, "", "x" * 50, "</s>", "two\nlines é"])))
    for conv in range(90, 120):
        rows += [(conv, t, r, "hello") for t, r in enumerate(["system", "user", "assistant", "user"])]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (200, None, "user", "same"), (200, None, "user", "same"), (200, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("conv", F.lit(1)).repartition(7)
    formatted = chat_format.format_conversations(df, "conv_id", "turn", "role", "text")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["conv"]: tuple(r)[1:] for r in chat_format.conversation_facts(formatted).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", hashlib.md5((text or "").encode()).hexdigest(), role, text))
    want = {conv: facts_of([x[5:] for x in sorted(turns, key=lambda x: x[:5])]) for conv, turns in by.items()}
    assert got == want and got[0][-1] and not got[200][-1]
    for r in formatted.collect():
        assert "".join(r["text"][s["start"]:s["end"]] for s in r["segments"]) == r["text"]
        if row_chars == 40:
            assert len(r["text"]) <= 40 + 100
    if row_chars == 40:
        assert formatted.where("conv = 0").select("part").distinct().count() > 1  # the large conversation is no one task's
    empty = chat_format.format_conversations(df.limit(0), "conv_id", "turn", "role", "text")
    assert chat_format.conversation_facts(empty).count() == 0


def test_op12_plants_its_conversation(spark, small):
    got = {r["conv_id"]: r for r in op12_chat_format(spark, small).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["loss_chars"] == len(said) and got[-7]["loss_sha256"] == hexdigest(said) and got[-7]["accepted"]


def brute_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute_variants(words, ratio=5):
    out, form = {}, {}
    for w, n in words.items():
        near = [(-words[v], v) for v in words if brute_near(w, v)]
        top = min(near, default=None)
        form[w] = top[1] if top and -top[0] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), words[form[w]] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def test_variants_equal_brute_force(spark):
    draw, words = random.Random(4), {}
    for _ in range(120):
        base = "".join(draw.choice("abcéz") for _ in range(draw.randint(6, 8)))
        for _ in range(draw.randint(1, 5)):
            i = draw.randint(0, len(base) - 1)
            other = draw.choice([base[:i] + base[i + 1:], base[:i] + draw.choice("abÿ") + base[i:], base[:i] + draw.choice("abc") + base[i + 1:]])
            words[other] = draw.choice([5, 5, 9, 25, 26, 130, 700, 4000])
        words[base] = draw.choice([5, 60, 4000])
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaab": 625, "aaaaaaabb": 3125, "aaaaaabbb": 15625, "ßßßßßß日": 7, "ßßßßß日": 70}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("root", F.lit("clash")).withColumn("u", F.lit(1))
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(words) and got["aaaaaa"][1] == "aaaaaabbb"
    assert spelling_variants.spelling_variants(df.limit(0)).count() == 0


def brute_counts(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1:]
            if len(low) >= 6:
                total[low] += 1
    return {w: n for w, n in total.items() if n >= 5}


def test_word_counts_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(spelling_variants, "COUNT_ENTRIES", 500)
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "Straße ÉCOLE×école " * 6), (None, None), (7, ""), (7, "Straße ÉCOLE×école " * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = spelling_variants.word_counts(df, "doc_id", "text", delete_every=199)
    assert {r["word"]: r["n"] for r in got.collect()} == brute_counts(docs)
    assert spelling_variants.word_counts(df.limit(0), "doc_id", "text").count() == 0


def test_op13_equals_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: tuple(r)[1:] for r in op13_spelling_variants(spark, small).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(brute_counts(docs))
