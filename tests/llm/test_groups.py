"""Near duplicates, substring dedup, decontamination, WARC and the pipeline against brute force and odd rows."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import queries as Q
from panelforge.llm import suffix_dedup, warc
from panelforge.llm.components import components
from panelforge.llm.decontaminate import align, benchmark_leaks, without_leaks
from panelforge.llm.frames import load, scratch_path
from panelforge.llm.minhash_dedup import near_duplicates, parities
from panelforge.llm.sharding import interleave_shards
from panelforge.llm.suffix_dedup import remove_repeats
from tests.conftest import SF_SMALL
from tests.llm.conftest import prose


def edited(rng: random.Random, text: str, share: float) -> str:
    out = []
    for w in text.split():
        u = rng.random()
        if u < share / 3:
            continue
        out.append(prose(rng, 1) + "q" if u < 2 * share / 3 else w)
        if u > 1 - share / 3:
            out.append(prose(rng, 1))
    return " ".join(out)


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def near_twin(rows: list) -> list:
    """Every pair compared: sorted ``(doc_id, n_shingles, component_id)``."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(d if not s else least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randint(40, 120)) for _ in range(25)]
    rows = list(enumerate([*base, *[edited(rng, rng.choice(base), s) for s in (0.01, 0.03, 0.06, 0.1) for _ in range(25)],
                           *[edited(rng, base[0], 0.05) for _ in range(60)], base[3].upper(), "One two", "one TWO", ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == near_twin(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(odd_rows, no_rows):
    got = near_duplicates(odd_rows).collect()
    want = near_twin([(r["doc_id"], r["text"]) for r in odd_rows.collect()])
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert near_duplicates(no_rows).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[301] == 300
    assert 200 not in got


def cut_twin(texts: list[bytes], length: int) -> list[tuple]:
    times = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if times[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_plain_search(spark, monkeypatch):
    rng = random.Random(9)
    parts = [prose(rng, 60) for _ in range(6)]
    texts = [prose(rng, 40) + p + prose(rng, 30) for p in parts for _ in range(3)]
    texts += [edited(rng, texts[0], 0.02), texts[1], texts[1], "the " * 400, "the " * 130, parts[0][:399], parts[0][:400],
              parts[1] + parts[1], "", "é" * 450, "xé" * 300, prose(rng, 500)]
    texts += [texts[-1][:900] + "#" + texts[-1][900:2000] + "#" + texts[-1][2001:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = cut_twin([t.encode() for t in texts], 400)
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(docs, 400).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # the same with chunks that cut every long text
    for text in ("the " * 400, texts[-2], texts[1]):
        whole = {(int(a), int(b)) for s in suffix_dedup.samples(text.encode(), 400) for a, b in [(s.offset, len(s.data))]}
        assert whole == {(0, len(text.encode()))}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    data = texts[-2].encode()
    found = np.concatenate([s.offset + s.place for s in suffix_dedup.samples(data, 400)])
    monkeypatch.undo()
    assert set(found.tolist()) == set(np.concatenate([s.place for s in suffix_dedup.samples(data, 400)]).tolist())


def test_passages_shorter_than_the_length_stay(spark):
    """Passages of over 50 words, but under 400 bytes: kept at 400, gone at a length that they reach."""
    rng = random.Random(21)
    passages = [prose(rng, 51 + k) for k in range(4)]
    assert all(len(p.split()) > 50 and len(p.encode()) < 400 for p in passages)
    texts = [f"{prose(rng, 90)}\n{p}\n{prose(rng, 70)}" for p in passages for _ in range(3)] + [prose(rng, 200) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    least = min(len(p.encode()) for p in passages)
    for length, caught in ((400, 0), (least, 12)):
        got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(docs, length).collect()}
        assert [got[i] for i in range(len(texts))] == cut_twin([t.encode() for t in texts], length)
        assert sorted(i for i in got if got[i][1] > 0) == list(range(caught))


def test_repeats_of_odd_rows(odd_rows, no_rows):
    rows = odd_rows.collect()
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, cut_twin([(r["text"] or "").encode() for r in rows], 400)))
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, remove_repeats(odd_rows).collect())) == want
    assert remove_repeats(no_rows).count() == 0


def align_twin(item: list, words: list) -> int:
    best, table = 0, np.zeros((len(item) + 1, len(words) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a == b else -1), table[i - 1, j] - 2, table[i, j - 1] - 2)
            best = max(best, table[i, j])
    return int(best)


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(0, 25))
        assert align(a.astype(np.uint64), b.astype(np.uint64))[0] == align_twin(a.tolist(), b.tolist())


def test_leaks_equal_full_alignment(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randint(22, 50))) for k in range(12)] + [(12, None), (13, ""), (14, "two words"), (None, prose(rng, 30))]
    docs = []
    for k in range(120):
        text = prose(rng, rng.randint(20, 90))
        if k % 3 == 0:
            text = prose(rng, 20) + " " + edited(rng, items[k % 12][1], (k % 5) * 0.08) + " " + text
        docs.append((k, text.upper() if k % 7 == 0 else text))
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        least=0.55, block_words=150).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            a = (item or "").split()
            if len(a) >= 3:
                score = align_twin(a, text.lower().split()) / (2 * len(a))
                if score >= 0.55:
                    want[d, i] = score
    assert {k: pytest.approx(r["score"]) for k, r in got.items()} == want and len(want) >= 20
    texts = dict(docs)
    for (d, i), r in got.items():
        if r["score"] == 1:
            assert " ".join(texts[d].lower().split()[r["first_word"]:r["last_word"] + 1]) == dict(items)[i]


def test_leaks_of_odd_rows(spark, odd_rows, no_rows):
    items = spark.createDataFrame([(1, "x y z"), (None, None)], "item_id long, text string")
    assert benchmark_leaks(odd_rows, items).count() == 0 and benchmark_leaks(no_rows, items).count() == 0
    assert benchmark_leaks(odd_rows, items.limit(0)).count() == 0
    same = odd_rows.where("doc_id = 1").selectExpr("doc_id as item_id", "text")
    assert {r["doc_id"] for r in benchmark_leaks(odd_rows, same).collect()} == {1, 2, 10}
    kept = without_leaks(odd_rows, same)
    assert kept.columns == odd_rows.columns and kept.count() == 11


def pages(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, payload_bytes int")


def test_archive_round_trip(spark):
    rng = random.Random(13)
    long = prose(rng, 900)
    rows = [(1, "u", long), (2, "v", long), (3, None, None), (4, "", ""), (None, "a b\r\nc", "é\r\n\r\nWARC/1.1\r\n"),
            (9, "z", "é\r\n\r\nWARC/1.1\r\n"), (2, "v", long), (7, "t", "0\r\n\r\n"), (None, "n", "only nulls"), (8, "w", "\x00\x7f")]
    path = scratch_path(spark, "test")
    warc.write_archive(pages(spark, rows), path, segment_bytes=700, chunk_bytes=333, records_per_file=3)
    got = warc.read_archive(spark, path).collect()
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        data, top = (h or "").encode(), best[h or ""]
        first = (-1 if p is None else p) == top
        want.append((str(p), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if first else "revisit", str(None if first else top)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]))
                  for r in got) == sorted(want)
    assert all(r["complete"] for r in got)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    kinds = collections.Counter(f["warc-type"] for x in files for f, _ in warc.parsed(bytes(x["content"])))
    assert kinds["continuation"] > 10 and kinds["revisit"] == 3


def test_archive_options_and_damage(spark):
    path = scratch_path(spark, "test")
    warc.write_archive(pages(spark, [(1, "u", "abc"), (2, "u", "abc")]), path, min_revisit_bytes=4)
    assert {r["record_type"] for r in warc.read_archive(spark, path).collect()} == {"response"}
    whole, broken = scratch_path(spark, "test"), scratch_path(spark, "test")
    warc.write_archive(pages(spark, [(1, "u", "abc" * 500)]), whole, segment_bytes=400, records_per_file=1)
    files = spark.read.format("binaryFile").load(whole).select("content").collect()
    records = [gzip.decompress(bytes(f["content"])) for f in files]
    left = [(r.decode().removesuffix("\r\n\r\n"),) for r in records if b"Segment-Number: 2" not in r]
    assert len(left) == len(records) - 1 >= 3
    spark.createDataFrame(left, "value string").write.option("lineSep", "\r\n\r\n").text(broken)
    got = warc.read_archive(spark, broken).collect()
    assert [(r["page_id"], r["complete"], r["payload_bytes"]) for r in got] == [(1, False, None)]
    assert warc.unchunked(warc.chunked(b"a\r\nb" * 50, 7)) == b"a\r\nb" * 50
    assert list(warc.parsed(b"no record\r\n\r\n")) == []
    empty = scratch_path(spark, "test")
    warc.write_archive(pages(spark, []), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_damaged_archives_are_read_on(spark):
    """Broken chunks, wrong and missing lengths, cut files, other archives' records: the rest is read."""
    def made(page, body, chunked=False, length=None, kind="response"):
        head = b"HTTP/1.1 200 OK\r\n" + (b"Transfer-Encoding: chunked\r\n" if chunked else b"") + b"\r\n"
        block = head + body
        out = warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x:{page}>"), ("WARC-Page-ID", page)], block)
        if length is not None:
            out = out.replace(b"Content-Length: %d" % len(block), b"Content-Length: " + length)
        return out + b"\r\n\r\n"

    data = (made(1, b"one") + made(2, b"zz\r\nbad", True) + made(3, b"three", length=b"999999") + made(4, b"four", length=b"x")
            + made(None, b"other") + made("seven", b"seven") + made(8, b"info", kind="warcinfo") + b"junk without a record\r\n\r\n" + made(5, b"five"))
    cut = made(6, b"six" * 100)[:-200]
    got = [(f.get("warc-page-id"), b if b is None else b.partition(b"\r\n\r\n")[2]) for f, b in warc.parsed(data + cut)]
    assert got == [("1", b"one"), ("2", b"zz\r\nbad"), ("3", None), (None, b"other"), ("seven", b"seven"), ("8", b"info"), ("5", b"five"), ("6", None)]
    each = gzip.compress(made(1, b"one")) + gzip.compress(made(2, b"two"))
    assert [f["warc-page-id"] for f, _ in warc.parsed(each)] == ["1", "2"]
    assert [f["warc-page-id"] for f, _ in warc.parsed(each[:-12])] == ["1", "2"]
    path = scratch_path(spark, "test")
    spark.createDataFrame([(data.decode().removesuffix("\r\n\r\n"),)], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    rows = {(r["page_id"], r["payload_bytes"]) for r in warc.read_archive(spark, path).collect()}
    assert rows == {(1, 3), (2, None), (3, None), (None, 5), (None, 5), (5, 4)}


def test_pages_query(spark):
    got = Q.QUERIES["op9_warc"](spark, SF_SMALL).collect()
    html = {r["page_id"]: (r["html"] or "").encode() for r in load(spark, SF_SMALL, "pages").collect()}
    assert {r["page_id"]: r["payload_bytes"] for r in got} == {k: len(v) for k, v in html.items()}


def test_pipeline_stages_on_small_documents(spark):
    docs = load(spark, SF_SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.good_quality(spark, docs, SF_SMALL)
    labels = {r["doc_id"]: r["quality"] for r in load(spark, SF_SMALL, "labels").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns
    assert np.mean([(d in ids) == bool(q) for d, q in labels.items() if d in texts]) > 0.9
    unique = corpus_pipeline.one_of_each(spark, docs, SF_SMALL)
    twin = near_twin(sorted(texts.items()))
    assert {str(r["doc_id"]) for r in unique.collect()} == {d for d, _, c in twin if d == c}
    clean = corpus_pipeline.without_benchmark(spark, docs, SF_SMALL)
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in load(spark, SF_SMALL, "benchmark").collect()]
    whole = {d for d, t in texts.items() if any(i in " ".join(re.findall(r"[^\W_]+", t.lower())) for i in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert whole and not whole & left and len(left) >= len(texts) - len(whole) - 2
    last = corpus_pipeline.run(spark, SF_SMALL)
    counts = collections.Counter(r["shard"] for r in last.collect())
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) > 100


def test_pipeline_stages_judge_rows(spark, odd_rows, no_rows):
    """Repeated and null ids, clashing columns, rows alike, and empty tables in every stage."""
    rng = random.Random(9)
    one, two = prose(rng, 60), prose(rng, 80)
    item = [r["text"] for r in load(spark, SF_SMALL, "benchmark").collect() if len(r["text"].split()) > 20][0]
    rows = [(1, one), (1, item), (None, two), (None, two), (None, prose(rng, 50)), (2, one), (2, one), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "a", 1, 2.0, "k", 0) for i, t in rows], odd_rows.schema)
    # _own, mark and the like are names that the stages use inside
    docs = docs.withColumns({"_own": F.lit(1), "mark": F.lit(2), "kept": F.lit(3), "_text": F.lit("x"), "bands": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, no_rows):
            out = stage(spark, table, SF_SMALL)
            assert out.columns == table.columns
            out.collect()
    dedup = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, SF_SMALL).collect()]
    assert sorted(dedup, key=repr) == sorted([(1, one), (1, item), rows[2], rows[4], (3, ""), (4, None)], key=repr)
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_benchmark(spark, docs, SF_SMALL).collect()]
    assert sorted(clean, key=repr) == sorted([r for r in rows if r[1] != item], key=repr)
    last = corpus_pipeline.shard(spark, docs, SF_SMALL)
    assert last.count() == len(rows) and corpus_pipeline.shard(spark, no_rows, SF_SMALL).count() == 0


def test_copies_spread_over_shards(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    got = collections.defaultdict(list)
    for r in interleave_shards(docs.union(docs), 10).collect():
        got[r["doc_id"]].append(r["shard"])
    together = sum(a == b for a, b in got.values())
    assert 10 <= together <= 80  # one in ten
    many = spark.range(900).select(F.lit(5).alias("doc_id"), F.lit("same").alias("text"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"))
    counts = collections.Counter(r["shard"] for r in interleave_shards(many, 9).collect())
    assert set(counts.values()) == {100}


def test_near_copies_of_one_text_below_the_limit_among_themselves(spark):
    """Most copies link to the text but not to one another; some link to nothing; equal to all pairs."""
    rng = random.Random(12)
    base = prose(rng, 120).split()
    docs = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.choice([2, 3, 4, 5, 6, 8])):
            words[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(near_twin(docs))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(40)] + [np.zeros(0, np.uint64)]
    bits = parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in bits[i] ^ bits[j])
            assert differ <= len(np.setxor1d(a, b))
            assert i != j or differ == 0


def test_registered_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))
