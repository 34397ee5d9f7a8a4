"""Line dedup, source divergence and hard negatives against brute force and odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm.divergence import index_runs, pair_corrections, pieces, source_divergence
from panelforge.llm.frames import ship
from panelforge.llm.hard_negatives import best, hard_negatives, products
from panelforge.llm.line_dedup import line_bitmaps, without_lines

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return text.encode().lower().decode()


# --- lines


def lines_by_hand(rows, min_docs, min_chars=1, keep="none"):
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for d in docs:
        for line in d[1].split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    common, out, met = {k for k, v in held.items() if len(v) >= min_docs}, {}, set()
    for d in docs:
        kept = []
        for line in d[1].split("\n"):
            if key(line) in common and (keep == "none" or key(line) in met):
                continue
            met.add(key(line))
            kept.append(line)
        out[d] = "\n".join(kept)
    return [(i, len((t or "").split("\n")), out[i, t or ""]) for i, t in rows]


def run_lines(df, **settings):
    got = without_lines(df, line_bitmaps(df, **settings))
    return [(r["doc_id"], r["n_lines"], r["kept"]) for r in got.collect()], {r["doc_id"]: r["n_dropped"] for r in got.collect()}


def by_repr(rows):
    return sorted(rows, key=repr)


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    lines = ["Menu", " menu\t", "MENU\r", "Home | About", "é", "É", "", " ", *[f"line {i}" for i in range(60)]]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Menu")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for min_docs, min_chars in ((10, 1), (3, 1), (10, 0), (2, 6)):
        got, dropped = run_lines(df, min_docs=min_docs, min_chars=min_chars)
        want = lines_by_hand(rows, min_docs, min_chars)
        assert by_repr(got) == by_repr(want)
        for i, n, kept in want:
            stay = 0 if kept == "" and dropped[i] == n else len(kept.split("\n"))
            assert n - dropped[i] == stay


def test_first_lines_stay_once(spark):
    rows = [(i, f"top\nown {i}\ntop\nshared {i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, dropped = run_lines(df, min_docs=5, keep="first")
    texts = dict((i, kept) for i, _, kept in got)
    assert texts[0] == "top\nown 0\nshared 0" and texts[1] == "own 1\nshared 1" and texts[9] == "own 9"
    assert dropped[0] == 1 and dropped[9] == 3


def test_long_documents_use_many_words_of_bits(spark):
    text = "\n".join("same" if i % 7 else f"own {i}" for i in range(3000))
    df = spark.createDataFrame([(i, text + f"\nlast {i}") for i in range(12)], "doc_id long, text string")
    got, dropped = run_lines(df, min_docs=12)
    assert {kept for _, _, kept in got} == {f"last {i}" for i in range(12)}
    assert set(dropped.values()) == {3000}
    bitmaps = line_bitmaps(df, min_docs=13)
    assert bitmaps.count() == 0


def test_lines_of_odd_rows(odd_rows, no_rows):
    clash = odd_rows.withColumn("mark", F.lit("x")).withColumn("bits", F.lit(3)).withColumn("at", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in odd_rows.collect()]
    for min_docs in (2, 3):
        got, _ = run_lines(clash, min_docs=min_docs)
        assert by_repr(got) == by_repr(lines_by_hand(rows, min_docs))
    got, _ = run_lines(odd_rows, min_docs=2, keep="first")
    assert len(got) == len(rows)
    assert line_bitmaps(no_rows).count() == 0 and run_lines(no_rows)[0] == []


def test_ranges_need_no_python(odd_rows):
    plan = without_lines(odd_rows, line_bitmaps(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" not in plan  # the ranges were written


# --- sources


def divergence_by_hand(rows, min_docs, top):
    rows = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
        for _, source, terms in mine:
            docs.update(set(terms))
            counts[source].update(terms)
        kept = [t for t, n in docs.items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + (10**9 * (count[t] + 2)) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum(counts.values(), collections.Counter()))
        own = {s: shares(c) for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in own:
            pairs = sorted(((-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in own if o != s))
            terms = sorted((-f(own[s][t], whole[t]), t.encode()) for t in kept if counts[s][t] and own[s][t] > whole[t])
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])}
    return out


def divergence_rows(df, **settings):
    ship(df.sparkSession)
    rows = source_divergence(df, **settings).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_divergence_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["Alpha", "alpha", "beta", "ÄRGER", "Ärger", "日本", "o'clock", "a1b", "the", "The", *[f"w{c}" for c in "abcdefghij"]]
    rows = []
    for i in range(160):
        source = rng.choice(["a", "b", "c", "d", None, "Ω"])
        pool = words if source in ("a", None) else words[3:]
        rows.append((rng.choice(["en", "de", None]), source, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))))
    rows += [("en", "empty", None), ("en", "empty", "12 34"), ("lone", "a", "x"), ("lone", "b", "y"), ("one", "only", "z z z")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    for min_docs, postings in ((10, 300_000), (3, 7), (1, 1)):
        assert divergence_rows(df, min_docs=min_docs, most_postings=postings) == divergence_by_hand(rows, min_docs, 10)


def test_divergence_of_odd_rows(odd_rows, no_rows):
    df = odd_rows.withColumn("lang", F.lit("en")).withColumn("term", F.lit(1)).withColumn("p", F.lit(1)).withColumn("count", F.lit(1))
    rows = [("en", r["source"], r["text"]) for r in odd_rows.collect()]
    for min_docs in (1, 2, 50):
        assert divergence_rows(df, min_docs=min_docs, top=3) == divergence_by_hand(rows, min_docs, 3)
    assert source_divergence(no_rows.withColumn("lang", F.lit("x"))).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr("panelforge.llm.divergence.PIECE_BYTES", 10)
    text = "Über die lange Straße, 99 mal; " * 20 + "x" * 50
    found = [t for piece in pieces(text.encode()) for t in piece]
    assert [t.decode() for t in found] == TERM.findall(lowered(text))


def test_runs_are_sorted_and_bounded(spark):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 40, "source": [str(i % 4) for i in range(40)],
                                        "text": [" ".join(f"t{chr(97 + (i * j) % 26)}" for j in range(12)) for i in range(40)]})
    for most in (1, 10, 1000):
        runs = list(index_runs([batch], most))
        assert sum(sum(r.column("count").to_pylist()) for r in runs) == 480
        for r in runs:
            order = list(zip(*(r.column(c).to_pylist() for c in ("lang", "term", "source")), strict=True))
            assert order == sorted(order)
    assert len(list(index_runs([batch], 10))) > 3


def test_pair_sums_written_early_add_up():
    import pyarrow as pa
    rows = [("x", f"t{t:02d}", f"s{s}", 10**6 + 7919 * t * s, 10**5) for t in range(30) for s in range(6)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("lang", "term", "source", "p", "p0"), map(list, zip(*rows[i:i + 7], strict=True)), strict=True)))
               for i in range(0, len(rows), 7)]

    def sums(most):
        out = collections.Counter()
        for part in pair_corrections(batches, most):
            for r in part.to_pylist():
                out[r["a"], r["b"]] += r["value"]
        return out

    assert sums(1) == sums(10**6) and len(sums(1)) == 15


# --- negatives


def negatives_by_hand(rows, n_pos=5, n_neg=10):
    vecs = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in vecs:
        if i % 10:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, l2) for j, l2, w in vecs), key=lambda t: t[:2])
        for s, j, _ in [t for t in scored if t[2] == lab and t[1] != i][:n_pos]:
            inside = [(-t, k) for t, k, l2 in scored if l2 != lab and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(inside)]
    return sorted(out)


def negatives(df, **settings):
    ship(df.sparkSession)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, **settings).collect())


VECTORS = "vec_id long, embedding array<double>, label int"


def test_negatives_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], int(rng.integers(0, 4))) for i in range(150)]
    vecs += [(200 + i, vecs[20][1], i % 3) for i in range(40)]  # one very common vector: ties by id
    df = spark.createDataFrame(vecs, VECTORS).repartition(7)
    want = negatives_by_hand([(i, lab, v) for i, v, lab in vecs])
    assert want and negatives(df) == want
    assert negatives(df, cell_rows=9) == want
    assert negatives(df, n_positives=2, n_negatives=3) == negatives_by_hand([(i, lab, v) for i, v, lab in vecs], 2, 3)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 2),
            (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [0.5, 0.4], None), (None, [0.6, 0.4], 2), (8, [0.7], 2), (9, [], 2),
            (10, [0.0, 0.0], 3), (11, [0.0, 0.0], 3), (20, [-1.0, -1.0], 5), (21, [1.0, 1.0], 5)]
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("n"), F.lit(2).alias("cell"), F.lit("s").alias("score"),
                                                     F.lit(0).alias("anchor"))
    want = negatives_by_hand([(i, lab, v) for i, v, lab in rows])
    assert negatives(df) == want and {w[0] for w in want} == {0, 10}
    assert negatives(df.limit(0)) == []
    words = df.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert negatives(words) == want


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(4)
    for top in (10, 10**4, 10**8, 2**40):
        a, b = (rng.integers(-top, top, (5, 3)) for _ in range(2))
        want = [[max(-2**63 + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
        assert products(a, b).tolist() == want
    for scores in (rng.integers(-5, 5, (6, 40)), rng.integers(-2**62, 2**62, (6, 40))):
        among = rng.random((6, 40)) < 0.5
        for k in (1, 7, 100):
            row, col = best(scores, among, k)
            for r in range(6):
                want = sorted(np.flatnonzero(among[r]), key=lambda c: (-int(scores[r, c]), c))[:k]
                assert sorted(col[row == r]) == sorted(want)


def test_query_digests(spark):
    from panelforge.llm.queries import QUERIES
    from tests.conftest import SF_SMALL
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want = {i: (n, hashlib.sha256(kept.encode()).hexdigest()) for i, n, kept in lines_by_hand(list(rows.items()), 10)}
    got = {r["doc_id"]: (r["n_lines"], r["kept_sha256"]) for r in QUERIES["op13_line_dedup"](spark, SF_SMALL).collect()}
    assert got == want
