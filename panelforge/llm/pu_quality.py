"""A quality classifier by positive-unlabelled learning.

Only trusted positives (documents labelled 1) and unlabelled web text are learnt from. The
class prior, the share of good documents in the web text, is estimated first. Then a small
network minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

where R_p(+) and R_p(-) are the mean losses of calling the positives good and bad, and R_u(-)
that of calling the unlabelled bad. Learning runs on a bounded sample; every document is
scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, unit53
from panelforge.llm.hashing import SPACED, sliced, text_bytes, word_hashes

#: Classes of bytes whose shares are features; the last takes whatever is in none.
BYTE_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n",
                b".,;:", b"!?", b"|", b"$#%&*@^~+=<>", b"()[]{}'\"`", b"_/\\-", bytes(range(128, 256)))
N_FEATURES = len(BYTE_CLASSES) + 1 + 10

_CLASS_OF = np.full(256, len(BYTE_CLASSES), np.uint8)
for _k, _members in enumerate(BYTE_CLASSES):
    _CLASS_OF[list(_members)] = _k


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text of a string array without nulls: shares of kinds of
    characters, and how far words, word pairs and lines repeat. Empty texts have zeros."""
    data, bounds = text_bytes(texts)
    words, rows = word_hashes(texts, SPACED)
    word_bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    out = np.zeros((len(texts), N_FEATURES))
    k = len(BYTE_CLASSES) + 1
    for i in range(len(texts)):
        own = data[bounds[i]:bounds[i + 1]]
        if not len(own):
            continue
        counts = np.bincount(_CLASS_OF[own], minlength=k)
        out[i, :k] = np.sqrt(counts / len(own))
        letters = counts[0] + counts[1]
        lines = own.tobytes().split(b"\n")
        out[i, k:k + 4] = (np.log1p(len(own)) / 10, np.sqrt(counts[1] / max(1, letters)),
                           1 - len(set(lines)) / len(lines), np.log1p(len(lines)) / 5)
        w = words[word_bounds[i]:word_bounds[i + 1]]
        if not len(w):
            continue
        _, often = np.unique(w, return_counts=True)
        out[i, k + 4:k + 8] = (np.log1p(len(own) / len(w)), 1 - len(often) / len(w), often.max() / len(w),
                               np.log1p(len(w)) / 10)
        if len(w) > 1:
            pairs = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
            out[i, k + 8:] = (1 - len(np.unique(pairs)) / len(pairs), np.sqrt(np.mean(w[1:] == w[:-1])))
    return out


@dataclass
class Network:
    """One hidden layer over standardised features; ``score`` is the chance of label 1."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, self.scaled(x))[1], -30, 30)))


def _forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ weights[0] + weights[1])
    return hidden, hidden @ weights[2] + weights[3]


def _fit(positive: np.ndarray, unlabelled: np.ndarray, slope, seed: int, epochs: int, batch: int,
         width: int = 24, rate: float = 0.01, decay: float = 1e-4) -> list[np.ndarray]:
    """Adam over batches of both samples; ``slope`` gives the risk's slope at each one's outputs."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    weights = [rng.normal(0, d ** -0.5, (d, width)), np.zeros(width), rng.normal(0, width ** -0.5, width), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rounds = max(1, -(-max(len(positive), len(unlabelled)) // batch))
    for epoch in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_at, u_at in zip(np.array_split(p_order, rounds), np.array_split(u_order, rounds), strict=True):
            if not len(p_at) or not len(u_at):
                continue
            x = np.concatenate([positive[p_at], unlabelled[u_at]])
            hidden, out = _forward(weights, x)
            back = slope(out[:len(p_at)], out[len(p_at):])
            inner = np.outer(back, weights[2]) * (1 - hidden ** 2)
            slopes = [x.T @ inner + decay * weights[0], inner.sum(0), hidden.T @ back + decay * weights[2],
                      back.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                now = rate * (1 - epoch / epochs)
                weights[i] = weights[i] - now * first[i] / (1 - 0.9 ** step) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return weights


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _told_apart(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Slope of the logistic loss of telling positives from unlabelled."""
    return np.concatenate([(_sigmoid(p) - 1) / len(p), _sigmoid(u) / len(u)]) / 2


def estimated_prior(p_scores: np.ndarray, u_scores: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores that rank positives higher.

    Above any threshold the unlabelled hold at least their positives, so share(u) / share(p)
    bounds the prior from above; the least bound is taken, each with an allowance for
    the sample's size so that thin tails do not win by chance.
    """
    cuts = np.quantile(p_scores, np.linspace(0.0, 0.9, 91))
    p_share = 1 - np.searchsorted(np.sort(p_scores), cuts) / len(p_scores)
    u_share = 1 - np.searchsorted(np.sort(u_scores), cuts) / len(u_scores)
    slack = np.sqrt(np.log(200) / 2) * (len(u_scores) ** -0.5 + len(p_scores) ** -0.5)
    best = np.argmin((u_share + slack) / p_share)
    return float(np.clip(u_share[best] / p_share[best], 0.01, 0.99))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5, epochs: int = 30,
                batch: int = 1_000) -> Network:
    """Estimates the prior, then minimises the non-negative risk with the logistic loss.

    Where the negative part of the risk falls below zero on a batch, the step goes the other way
    and undoes the over-fit (as in Kiryo et al., 2017).
    """
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    shell = Network(mean, spread, [], 0.5)
    p, u = shell.scaled(positive), shell.scaled(unlabelled)
    guess = _fit(p, u, _told_apart, seed, max(1, epochs // 3), batch)
    prior = estimated_prior(_forward(guess, p)[1], _forward(guess, u)[1])

    def slope(zp: np.ndarray, zu: np.ndarray) -> np.ndarray:
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down_p, down_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if bad < 0:
            return np.concatenate([-down_p, -down_u])
        return np.concatenate([prior * (_sigmoid(zp) - 1) / len(zp) + down_p, down_u])

    return Network(mean, spread, _fit(p, u, slope, seed + 1, epochs, batch), prior)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learnt from: crc32 of the id's text is a multiple of 5. Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` rows, or all if there are fewer, by a hash of the id."""
    rate = min(1.0, most / max(1, rows.count()))
    return rows.where(unit53(F.lit(seed), F.col("doc_id")) < int(rate * 2**53)) if rate < 1 else rows


def learn_quality(docs: DataFrame, labels: DataFrame, most_positive: int = 15_000, most_unlabelled: int = 15_000,
                  seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  epochs: int = 30) -> Network | None:
    """A network from a sample of rows that are not held out; None without a positive or a document.

    Positives are ids whose labels are all 1; an id labelled both ways is none. The unlabelled
    are documents of any kind, whatever their label. Of rows that share an id one text counts, and
    texts count whole at any length. ``most_positive`` and ``most_unlabelled`` bound the samples (in the mean of a draw by hash), so the features that reach the driver are
    a few megabytes at any size.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).where(F.col("doc_id").isNotNull())
    rows = rows.where(~held_out(F.col("doc_id"))).withColumn("text", F.coalesce("text", F.lit("")))
    good = (pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull())
            .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            .where("lo = 1 and hi = 1").select("doc_id"))
    good = _sampled(good, most_positive, seed).withColumn("kind", F.lit(1))
    any_row = _sampled(rows.select("doc_id"), most_unlabelled, seed + 1).distinct().withColumn("kind", F.lit(0))
    # of rows that share an id, the first text in order
    chosen = (rows.join(F.broadcast(good.unionByName(any_row)), "doc_id")
              .groupBy("kind", "doc_id").agg(F.min("text").alias("text")))

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            x = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))],
                names=["kind", "doc_id", "x"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    got = (chosen.select("kind", "doc_id", "text").mapInArrow(featured, f"kind int, doc_id {id_type}, x array<double>")
           .toPandas())
    if not len(got):
        return None
    got = got.assign(key=[tuple(v) for v in got["x"]]).sort_values(["kind", "doc_id", "key"])
    x = {k: np.array(got.loc[got["kind"] == k, "x"].tolist(), dtype=float) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return None
    return fit_network(x[1], x[0], seed, epochs)


def score_quality(docs: DataFrame, network: Network | None, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted``, one per document, from the text alone.

    ``predicted`` is 1 from ``threshold`` up. Null texts count as empty; those are scored like
    others, with all features zero. Without a network every score is 0.5. Null or repeated ids
    are rows like others; columns beyond the two named ones are not read. One pass, no shuffle.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            x = text_features(batch.column("text"))
            got = network.score(x) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, network: Network | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept.

    Each row is judged by its own text, whatever its id; see ``score_quality`` for odd texts. One pass, no shuffle.
    """
    at = docs.columns.index(text_col)

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(at), "")], names=["text"])
            good = [np.zeros(0, bool)]
            for part in sliced(texts):
                x = text_features(part.column("text"))
                good.append(network.score(x) >= threshold if network else np.full(len(x), 0.5 >= threshold))
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(passed, docs.schema)
