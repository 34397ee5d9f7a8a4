"""Token counts: batch encoding inside Arrow functions that hand back lengths only.

The tokenizer never joins or drops anything across a space or a line feed: its
pre-tokenizer removes white space, and composition, lower-casing and the special strings
do not reach over it. So a text may be cut at any space, and its count is the sum of the
counts of its pieces. Each task encodes the distinct pieces that it has not met lately,
in batches of about equal bytes, and sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import pick

#: Characters of text that are cut into pieces at a time.
SLICE_CHARS = 1_000_000
#: Bytes of pieces in one encoding, and encodings in one batch.
ENCODE_CHARS, ENCODE_TEXTS = 32_000, 64
#: Counts that a worker remembers (of pieces up to KEPT_CHARS long) before it starts afresh.
KEPT_PIECES, KEPT_CHARS = 700_000, 48

_LOADED: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens by a Hugging Face ``tokenizers`` file whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # pieces come once, so its own cache only costs
        self.kept: dict[str, int] = {"": 0}

    def learn(self, pieces: Iterable[str]) -> dict[str, int]:
        """Counts of pieces that are not kept yet; the short ones are kept."""
        long: dict[str, int] = {}
        batch: list[list[str]] = [[]]
        room = ENCODE_CHARS
        for piece in pieces:
            if room <= 0:
                if len(batch) == ENCODE_TEXTS:
                    self._encode(batch, long)
                    batch = []
                batch.append([])
                room = ENCODE_CHARS
            batch[-1].append(piece)
            room -= len(piece) + 1
        self._encode(batch, long)
        return long

    def _encode(self, batch: list[list[str]], long: dict[str, int]) -> None:
        """Encodes lists of pieces, each joined by spaces; a token's offset tells its piece."""
        for pieces, got in zip(batch, self.tokenizer.encode_batch(
                [" ".join(p) for p in batch], add_special_tokens=False), strict=True):
            if not pieces:
                continue
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
            starts = np.cumsum(lengths) - lengths
            at = np.fromiter((o[0] for o in got.offsets), np.int64, len(got))
            counts = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(pieces))
            for piece, count in zip(pieces, counts.tolist(), strict=True):
                (self.kept if len(piece) <= KEPT_CHARS else long)[piece] = count

    def count(self, texts: list[str]) -> list[int]:
        cut = [_pieces(t) for t in texts]
        new = set().union(*cut).difference(self.kept)
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept = {"": 0}
            new = set().union(*cut).difference(self.kept)
        long = self.learn(new)
        if not long:
            known = self.kept.__getitem__
            return [sum(map(known, p)) for p in cut]
        return [sum(long[x] if x in long else self.kept[x] for x in p) for p in cut]


def _pieces(text: str) -> list[str]:
    """The text cut at spaces and line feeds.

    Letters of a pure ASCII text are lower-cased here, as the tokenizer would do next, unless
    that could make up one of its special strings.
    """
    if text.isascii() and "<|" not in text:
        text = text.lower()
    return text.replace("\n", " ").split(" ")


def _slices(text: str) -> Iterator[str]:
    """Slices of about SLICE_CHARS that end at a space, or the whole text if it has none there."""
    start = 0
    while len(text) - start > SLICE_CHARS:
        end = text.find(" ", start + SLICE_CHARS)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:] if start else text


def _counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_bytes, n_tokens, over_limit``, one per input row.

    ``tokenizer`` is a ``tokenizers`` JSON file at the same path on every executor; without one,
    each executor takes word_bpe_49k.json from its own ``public_tokenizers``. The file's
    pre-tokenizer must drop white space. No special tokens are added; special strings in a
    text count as the library's default has it. ``n_bytes`` is the UTF-8 length.

    Null and empty texts have 0 bytes and 0 tokens. Null or repeated ids are rows like others.
    Very long texts go through in slices cut at spaces. Columns beyond the two are not read.

    Work: one pass without a shuffle. A worker holds one Arrow batch, one slice's pieces and
    at most KEPT_PIECES remembered counts.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer or default_tokenizer())
        for batch in batches:
            texts = batch.column(1)
            total = np.zeros(len(texts), np.int64)
            rows: list[int] = []
            group: list[str] = []
            room = SLICE_CHARS
            for i in range(len(texts)):
                for part in _slices(texts[i].as_py() or ""):
                    rows.append(i)
                    group.append(part)
                    room -= len(part)
                    if room <= 0:
                        np.add.at(total, rows, counter.count(group))
                        rows, group, room = [], [], SLICE_CHARS
            if group:
                np.add.at(total, rows, counter.count(group))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return (rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
