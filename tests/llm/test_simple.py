"""Fingerprints, quality, shards, licences, mixing and token counts against brute force and odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from panelforge.llm import queries as Q
from panelforge.llm.frames import load
from panelforge.llm.licences import BASE_PHRASES, evaluate, licence_scan, postfix
from panelforge.llm.lz_fingerprint import compare_fingerprints, fingerprint
from panelforge.llm.mixing import mix, mix_plan
from panelforge.llm.pu_quality import estimated_prior, fit_network, learn_quality, score_quality
from panelforge.llm.sharding import interleave_shards
from panelforge.llm.token_counts import default_tokenizer, token_counts
from tests.conftest import SF_SMALL
from tests.llm.conftest import prose


def phrases(text: str) -> set[str]:
    found, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in found:
            found.add(text[start:end])
            start = end
    return found


def test_fingerprints_follow_the_phrase_sets(spark):
    rng = random.Random(1)
    texts = [prose(rng, 50 + 10 * i) for i in range(25)] + ["", "a", "ab" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in compare_fingerprints(docs, size=512).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        keep = len(text) - len(text) // 2
        edited = text[:keep] + after[:len(text) // 2]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[i]["near_edited"]), (after, got[i]["near_next"])):
            a, b = phrases(text), phrases(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.12)
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) >= 25


def test_fingerprints_of_odd_rows(odd_rows, no_rows):
    got = compare_fingerprints(odd_rows).collect()
    assert len(got) == 14 and not any(v is None for r in got for k, v in r.asDict().items() if k != "doc_id")
    marks = {r["doc_id"]: r["fingerprint"] for r in got}
    assert marks[1] == marks[2] and marks[4] == marks[5] == ""
    assert len(fingerprint("a" * 100_000, 128)) == 128
    assert compare_fingerprints(no_rows).count() == 0
    alone = compare_fingerprints(odd_rows.where("doc_id = 6")).first()
    assert alone["near_next"] == 1.0


def test_prior_and_network_on_made_samples():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 4)), rng.normal(4, 1, (3000, 4))
    mixed = np.concatenate([good[:1600], bad[:400]])
    network = fit_network(good[1600:], mixed, epochs=20)
    assert network.prior == pytest.approx(0.8, abs=0.06)
    assert (network.score(good[:500]) >= 0.3).mean() > 0.97 and (network.score(bad[400:]) < 0.3).mean() > 0.97
    assert estimated_prior(np.ones(10), np.ones(10)) <= 0.99


def test_quality_held_out_accuracy(spark):
    out = Q.QUERIES["op2_pu_quality"](spark, "/root/testdata/sf0.01")
    labels = load(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert out.count() == load(spark, "/root/testdata/sf0.01", "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_of_odd_rows(spark, odd_rows, no_rows):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 0), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    network = learn_quality(odd_rows, labels, epochs=2)
    got = score_quality(odd_rows, network).collect()
    assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got)
    assert learn_quality(no_rows, labels) is None and learn_quality(odd_rows, labels.limit(0)) is None
    assert {r["score"] for r in score_quality(odd_rows, None).collect()} == {0.5}
    assert score_quality(no_rows, network).count() == 0


def shard_twin(rows: list, shards: int) -> collections.Counter:
    """Rows per (source, shard) if each source's rows stand at (rank + 1/2) / rows of the whole order."""
    sizes = collections.Counter(s for _, s in rows)
    order = sorted(((r + 0.5) / n, str(s)) for s, n in sizes.items() for r in range(n))
    return collections.Counter((s, k * shards // len(order)) for k, (_, s) in enumerate(order))


def test_shards_hold_the_mixture(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = interleave_shards(docs, 40).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    per = collections.defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
    assert sorted(per) == list(range(40)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    mine = collections.Counter((str(r["source"]), r["shard"]) for r in got)
    twin = shard_twin([(r["doc_id"], r["source"]) for r in got], 40)
    assert max(abs(mine[k] - twin[k]) for k in mine | twin) <= 1  # equal fractions may stand either way
    again = interleave_shards(docs.repartition(13), 40, rows_per_bucket=50).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_shards_of_odd_rows(odd_rows, no_rows):
    got = interleave_shards(odd_rows, 3).collect()
    assert sorted(collections.Counter(r["shard"] for r in got).values()) == [4, 5, 5]
    assert interleave_shards(no_rows, 3).count() == 0
    assert len({(r["shard"], r["slot"]) for r in interleave_shards(odd_rows, 40).collect()}) == 14


def test_mix_sql_twin(spark):
    for folder in (SF_SMALL, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
        got = Q.QUERIES["op7_mix"](spark, folder)
        want = con.execute(Q.ORACLE["op7_mix"])
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * max(1, int(rng.lognormvariate(3, 1)))), "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_plan(docs, rows_per_bucket=100).collect()
    longest = max(r["size"] for r in got)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert all(abs(taken[s] - target[s]) <= longest + 0.02 * target[s] for s in target)


def test_mix_of_odd_rows(odd_rows, no_rows):
    plan = mix_plan(odd_rows).collect()
    assert len(plan) == 14 and all(r["copies"] in (0, 1, 2) for r in plan)
    out = mix(odd_rows)
    assert out.columns == odd_rows.columns and out.count() == sum(r["copies"] for r in plan)
    assert mix_plan(no_rows).count() == 0 and mix(no_rows).count() == 0
    assert mix_plan(odd_rows.where("text is null")).agg({"taken": "sum"}).first()[0] == 0


def test_licences_against_plain_search(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in licence_scan(docs).collect()}
    for r in docs.collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in BASE_PHRASES.items() for k in range(len(words))
                  if words[k] == p.split()[0] and words[k:k + len(p.split())] == p.split()]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"]) == (len(words), len(places))
        assert g["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (g["first_word"], g["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_licence_expressions():
    assert postfix("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0") == (
        ["MIT", "Apache-2.0", "or", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and"], True)
    assert evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, 0.1, True)
    assert evaluate("MIT AND GPL-3.0-only") == ({"mit", "gpl"}, 0.8, True)
    assert evaluate("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl"}, 0.4, True)
    assert evaluate("MIT the rest is prose") == ({"mit"}, 0.1, True)
    assert evaluate("foo OR MIT")[2] is False and evaluate("MIT AND")[2] is False and evaluate("(MIT")[2] is False
    assert evaluate("") == (set(), None, False)


def test_licences_of_odd_rows(spark, odd_rows, no_rows, monkeypatch):
    assert licence_scan(odd_rows).count() == 14 and licence_scan(no_rows).count() == 0
    rows = [(1, "Mit-LICENSE, mit license; cc by cc by"), (2, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode"),
            (3, "gnu general public license" * 2), (4, None), (5, "SPDX-License-Identifier: (")]
    got = {r["doc_id"]: r for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (4, 0, 6, "cc-by,mit")
    assert (got[2]["labels"], got[2]["base_labels"], got[2]["restriction"]) == ("apache,mit", "", 0.1)
    assert (got[3]["n_base"], got[3]["n_words"]) == (0, 7) and got[4]["score"] == got[5]["score"] == 0
    from panelforge.llm import licences
    monkeypatch.setattr(licences, "SLICE_BYTES", 7)
    text = b"by the gnu general public license, mit license cc by"
    assert licences.scan(text, licences.automaton())[:5] == (10, 3, 2, 8, "cc-by,gpl,mit")


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer
    rng = random.Random(3)
    odd = ["", "  a  b ", "don't stop\tnow", "x<|endoftext|>y <|STARTOFTEXT|>", "É colée İstanbul ΟΔΟΣ", "a b\x1cc\x85d",
           "12345 ...!!! $$$ a.b,c", "w" * 3000, " ́a", "line\r\nend\n\n"] + [prose(rng, 300) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts(docs, limit=100).collect()}
    library = Tokenizer.from_file(default_tokenizer())
    for i, text in enumerate(odd):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(text.encode()), n > 100), text


def test_token_counts_of_odd_rows(odd_rows, no_rows, monkeypatch):
    from panelforge.llm import token_counts as T
    got = token_counts(odd_rows).collect()
    assert len(got) == 14 and token_counts(no_rows).count() == 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 9)} == {0}
    counter = T.PieceCounter(default_tokenizer())
    text = "the quick brown fox jumps over it " * 50
    whole = len(counter.tokenizer.encode(text, add_special_tokens=False).ids)
    monkeypatch.setattr(T, "SLICE_CHARS", 40)
    monkeypatch.setattr(T, "KEPT_PIECES", 5)
    assert sum(counter.count(list(T._slices(text)))) == whole
    assert not math.isnan(whole)
