"""Archives, shards, fingerprints, registered queries and the pipeline against brute force."""

import gzip
import hashlib
import io
import json
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tabsieve.llm import histogram_sort, host_rules, queries, spot_signatures, warc
from test_documents import brute_components, brute_spans, measures, shingles
from tools.check_queries import TABLES, compare


def big(seed, n=1500):
    rng = random.Random(seed)
    return "".join(chr(rng.choice([97, 98, 233, 0x1F600, 10])) for _ in range(n))


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    a, b = big(1), big(2)
    rows = ([(i, f"http://h/{i}", a) for i in range(30)] + [(i, None, "small") for i in range(30, 40)] + [(40, "x\r\ny: z", b), (41, "u", None), (42, "u", "")]
            + [(None, "u", a), (None, "u", big(3)), (None, "u", big(3)), (50, "u", big(4)), (50, "u", big(4)), (51, "u", "e" * 999), (52, "u", "e" * 999),
               (53, "u", "f" * 1000), (54, "u", "f" * 1000)])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("path", F.lit("p"))
    out = warc.archive_round_trip(df, "page_id", "url", F.col("html"), folder=f"file://{tmp_path}/made")
    got = sorted(((r["source_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) for r in out.collect()), key=repr)
    want = []
    for i, u, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if x == h and j is not None]
        top = max(same, default=None) if len(body) >= 1000 else i
        refers = None if top == i or top is None else str(top)
        want.append((None if i is None else str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers else "response", refers,
                     None if u is None else u.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")))
    assert got == sorted(want, key=repr)
    bodies = {(r["source_id"], r["record_type"]): bytes(r["payload"]) for r in out.collect()}
    assert bodies["29", "response"] == a.encode() and bodies["0", "revisit"] == b"" and bodies["41", "response"] == b""
    members = list((tmp_path / "made").glob("*.members.warc.gz"))
    assert len(members) > 1
    for path in members:
        data, index = path.read_bytes(), [json.loads(x) for x in open(f"{path}.idx")]
        assert sum(x["length"] for x in index) == len(data)
        for x in index:
            one = zlib.decompressobj(31)
            text = one.decompress(data[x["offset"]:x["offset"] + x["length"]])
            assert one.eof and not one.unused_data and x["record"].encode() in text and text.endswith(b"\r\n\r\n")
    assert warc.archive_round_trip(df.limit(0), "page_id", "url", F.col("html")).count() == 0


def test_normaliser_takes_streams_of_many_members(spark, tmp_path):
    record = lambda i: warc._record("response", f"<urn:x:{i}>", None, hashlib.sha1(b"b").hexdigest(), 1, b"b", {})
    data = gzip.compress(record(0) + record(1)) + gzip.compress(record(2)) + gzip.compress(b"") + gzip.compress(record(3)[:50]) + gzip.compress(record(3)[50:])
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    found = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in ("x", "empty")], "path string"))
    assert sorted(r["records"] for r in found.collect()) == [0, 4]
    index = warc.read_index(spark, found)
    assert index.count() == 4 and warc.read_records(index).count() == 4
    assert warc.read_record(io.BytesIO(record(7)))[2] == record(7)


def law_of_bytes(rows, shards, tolerance=0.001):
    total, per = sum(r["size"] for r in rows), {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r)
    largest = max(r["size"] for r in rows)
    for k in range(shards):
        mine = per.get(k, [])
        assert abs(sum(r["size"] for r in mine) - total / shards) <= 2 * (largest + tolerance * total / shards) + 2
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))


def test_shards_near_equal_with_groups_and_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    out = histogram_sort.histogram_shards(docs, "doc_id", "text", 8)
    assert out.columns == ["doc_id", "text", "lang", "size", "shard", "slot"]
    rows = out.collect()
    law_of_bytes(rows, 8)
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r[0], r[1]) for r in docs.collect())
    rng = random.Random(2)
    made = ([(1, "same row", None)] * 700 + [(i, "same text", "x") for i in range(700)] + [(None, None, None)] * 300 + [(5, "", "e")]
            + [(10_000 + i, "t" * rng.randint(0, 40), "y") for i in range(400)] + [(-(1 << 63), "low", "z"), ((1 << 63) - 1, "high", "z")])
    df = spark.createDataFrame(made, "doc_id long, text string, slot string").withColumn("_k", F.lit(1))
    rows = histogram_sort.histogram_shards(df, "doc_id", "text", 8).collect()
    law_of_bytes(rows, 8)
    assert sorted((repr((r["doc_id"], r["text"])) for r in rows)) == sorted(repr(m[:2]) for m in made)
    shards_of = {}
    for r in rows:
        shards_of.setdefault(r["text"], set()).add(r["shard"])
    assert all(s == set(range(min(s), max(s) + 1)) for s in shards_of.values())  # equal texts are neighbours
    assert histogram_sort.histogram_shards(df.limit(0), "doc_id", "text", 8).count() == 0
    assert [r["slot"] for r in histogram_sort.histogram_shards(df.limit(1), "doc_id", "text", 8).collect()] == [0]


def brute_signatures(text):
    import regex
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    found = set()
    for i, w in enumerate(words):
        if w in spot_signatures.ANCHORS:
            chain = [x for x in words[i + 1:] if x not in spot_signatures.ANCHORS][:spot_signatures.CHAIN]
            if len(chain) == spot_signatures.CHAIN:
                found.add((w, *chain))
    if found:
        found.add(("start", words[0], *[x for x in words if x not in spot_signatures.ANCHORS][:spot_signatures.CHAIN]))
        return found
    return {tuple(words[i:i + spot_signatures.CHAIN]) for i in range(max(len(words) - spot_signatures.CHAIN + 1, 1))} if words else found


def ratio(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("parts", ["4", "40"])
def test_fingerprints_equal_brute_force(spark, small, parts):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, None), (20_000, ""), (20_001, "the"), (20_002, "zebra"), (20_003, "the quick brown fox " * 5), (20_004, "🙂 the é ü ö ä the"), (1 << 40, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r for r in spot_signatures.edited_likeness(df, "doc_id", "text").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(got) == len(rows)
    rows = sorted((d, t or "") for d, t in rows)
    prints = {}
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r, mine, theirs = got[d], brute_signatures(text), brute_signatures(edited)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"].split()) == len(mine) and len(r["edited_fingerprint"].split()) == len(theirs)
        assert abs(r["near_edited"] - ratio(mine, theirs)) < 1e-9 and abs(r["near_next"] - ratio(mine, brute_signatures(after))) < 1e-9
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_of_odd_tables(spark):
    shape = "doc_id long, text string"
    one = spot_signatures.edited_likeness(spark.createDataFrame([(3, "the one two three four")], shape), "doc_id", "text").collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert spot_signatures.edited_likeness(spark.createDataFrame([], shape), "doc_id", "text").count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "x"), (7, "x"), (7, "the y z w v")]
    assert spot_signatures.edited_likeness(spark.createDataFrame(rows, shape), "doc_id", "text").count() == 5


def test_texts_without_a_chain_are_signed_whole(spark):
    """One opening and different rests are different; only the likeness of the whole text counts."""
    opening, rests = "red green blue yellow ", ["one two three four five six", "seven eight nine ten eleven twelve"]
    rows = [(1, opening + rests[0]), (2, opening + rests[1]), (3, opening + rests[1] + " the"), (4, "red green"), (5, "red green"), (6, "!!!"), (7, None)]
    got = {r["doc_id"]: r for r in spot_signatures.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert len({got[d]["fingerprint"] for d in (1, 2, 3, 4)}) == 4 and got[4]["fingerprint"] == got[5]["fingerprint"]
    want = {d: ratio(brute_signatures(a), brute_signatures(b)) for (d, a), (_, b) in zip(rows, rows[1:] + rows[:1])}
    assert {d: r["near_next"] for d, r in got.items()} == pytest.approx(want) and 0 < got[1]["near_next"] < 0.2
    assert got[6]["fingerprint"] == got[7]["fingerprint"] == ""


def test_spot_links_equal_brute_force(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()] + [(10_000, None), (10_001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spot_signatures.spot_links(df, "doc_id", "text", 0.8)
    classes = {r["doc_id"]: r["class_id"] for r in got["members"].collect()}
    sets = {d: frozenset(brute_signatures(t)) for d, t in rows}
    least = {}
    for d in sorted(sets):
        least.setdefault(sets[d], d)
    assert classes == {d: least[s] if s else d for d, s in sets.items()}
    heads = [(d, s) for s, d in least.items() if s]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(heads) for b, y in heads[:i] if ratio(x, y) >= 0.8}
    assert {(r["u"], r["v"]) for r in got["links"].collect()} == want and want


def test_queries_match_sql(spark, small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries()) and set(queries.SQL) <= set(queries.QUERIES)
    for name in queries.SQL:
        text, _, ok = compare(spark, con, name, small)
        assert ok, (name, text)


def test_pipeline_equals_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    frame = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_duplicates", "secret_scans", "packing"]
    good = stage["quality_rules"](spark, frame, small)
    assert good.columns == frame.columns
    verdict = {r["source"]: r["rejected"] for r in host_rules.host_rates(host_rules.rule_measures(frame, "doc_id", "text", "source"), "source").collect()}
    want = [d for d in docs if not measures(d[1])[-1] and not verdict.get(d[3], False)]
    assert sorted(map(tuple, good.collect())) == sorted(want) and 0 < len(want) < len(docs)
    good = spark.createDataFrame(want, frame.schema)
    single = stage["near_duplicates"](spark, good, small)
    kept = {d for d, _, _, k in brute_components([(d[0], d[1]) for d in want], 5, 80) if k}
    want = [d for d in want if d[0] in kept]
    assert sorted(map(tuple, single.collect())) == sorted(want)
    clean = {r["doc_id"]: r for r in stage["secret_scans"](spark, spark.createDataFrame(want, frame.schema), small).collect()}
    assert set(clean) == kept and all(not brute_spans(r["text"]) for r in clean.values())
    assert all(clean[d[0]]["text"] == d[1] for d in want if not brute_spans(d[1]))
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in packed} == kept
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= corpus_pipeline.CAPACITY
    assert shingles("a b", 5) == {("a", "b")}
