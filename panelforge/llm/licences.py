"""Licence scans.

One Aho-Corasick automaton over a text's words finds notice phrases and identifier tags.
What follows a tag is a licence expression; a shunting-yard parser brings it into postfix
order, and evaluating that gives the licences and how restrictive their combination is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import pick

#: Notice phrases, as lower-case words, and their labels. These four are the base.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases that the method adds.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license": "apache",
    "free software foundation either version": "gpl",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: Words of the tags that a licence expression follows, and the tags as they are written.
TAGS = ("spdx license identifier", "spdx license expression", "spdx packagelicensedeclared")
TAG_TEXT = re.compile(rb"(?i:SPDX-License-(?:Identifier|Expression)|SPDX-PackageLicenseDeclared)[ \t]*:[ \t]*([^\r\n]*)")
#: Licence families by how their identifiers begin, with how much each restricts, from 0 to 1.
FAMILIES = {
    "0bsd": ("bsd", 0.0), "afl-": ("afl", 0.2), "agpl-": ("agpl", 0.9), "apache-": ("apache", 0.2),
    "artistic-": ("artistic", 0.4), "bsd-": ("bsd", 0.1), "bsl-": ("bsl", 0.1), "cc-by-nc": ("cc-by-nc", 0.8),
    "cc-by-nd": ("cc-by-nd", 0.8), "cc-by-sa": ("cc-by-sa", 0.6), "cc-by-": ("cc-by", 0.2), "cc0-": ("cc0", 0.0),
    "epl-": ("epl", 0.5), "gpl-": ("gpl", 0.8), "isc": ("isc", 0.1), "lgpl-": ("lgpl", 0.6),
    "licenseref-": ("licenseref", 1.0), "mit": ("mit", 0.1), "mpl-": ("mpl", 0.5), "unlicense": ("unlicense", 0.0),
    "zlib": ("zlib", 0.1),
}
#: How tightly each operator binds.
BINDS = {"or": 1, "and": 2, "with": 3}
#: What a base notice, another notice and a sound tag each say for a licence being there.
EVIDENCE = {"base": 0.7, "notice": 0.5, "tag": 0.9}

#: Words are runs of 0-9, letters without case, and everything beyond ASCII; the rest separates.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
#: Bytes of text that are taken to words at a time.
SLICE_BYTES = 4_000_000


def family(identifier: str) -> tuple[str, float] | None:
    """Label and restriction of an identifier, by the longest beginning that is known."""
    low = identifier.lower()
    found = [k for k in FAMILIES if low == k.rstrip("-") or low.startswith(k if k.endswith("-") else k + "-")]
    found += [k for k in FAMILIES if k.startswith("cc-by-n") and low.startswith(k)]
    return FAMILIES[max(found, key=len)] if found else None


def postfix(expression: str) -> tuple[list[str], bool]:
    """The longest sound beginning of an expression in postfix order; whether all was sound.

    Dijkstra's shunting yard: operands go out at once; operators wait on a stack until a looser
    one, a closing bracket or the end comes. Operators match in either case. After a whole
    operand only an operator or a closing bracket can follow, so prose behind the
    expression ends it. A missing operand or bracket makes it unsound.
    """
    out: list[str] = []
    waiting: list[str] = []
    want = True  # an operand
    sound = True
    for token in re.findall(r"[A-Za-z0-9.+-]+|[()]|[^\sA-Za-z0-9.+()-]", expression):
        low = token.lower()
        if want:
            if token == "(":
                waiting.append("(")
            elif re.match(r"[A-Za-z0-9]", token) and low not in BINDS:
                out.append(token)
                want = False
            else:
                sound = False
                break
        elif low in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            want = True
        elif token == ")" and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            break
    if want and waiting and waiting[-1] in BINDS:
        waiting.pop()
        sound = False
    sound = sound and bool(out) and "(" not in waiting
    return out + [w for w in reversed(waiting) if w != "("], sound


def evaluate(expression: str) -> tuple[set[str], float | None, bool]:
    """Labels, restriction and soundness of a licence expression.

    ``or`` leaves the choice, so the lighter side counts; ``and`` binds to both, so the heavier
    counts; ``with`` names an exception, which halves the licence's restriction and is no licence
    itself. An unknown identifier makes the expression unsound; known ones still count.
    """
    order, sound = postfix(expression)
    labels: set[str] = set()
    stack: list[tuple[float | None, str | None]] = []  # restriction, identifier not looked up yet

    def value(entry: tuple[float | None, str | None]) -> float | None:
        nonlocal sound
        if entry[1] is None:
            return entry[0]
        known = family(entry[1])
        if known is None:
            sound = False
            return None
        labels.add(known[0])
        return known[1]

    for token in order:
        if token not in BINDS:
            stack.append((None, token))
            continue
        if len(stack) < 2:
            sound = False
            break
        right, left = stack.pop(), stack.pop()
        if token == "with":
            have = value(left)
            stack.append((None if have is None else have / 2, None))
            continue
        both = [v for v in (value(left), value(right)) if v is not None]
        stack.append(((min if token == "or" else max)(both) if both else None, None))
    rests = [value(entry) for entry in stack]
    known = [r for r in rests if r is not None]
    return labels, known[-1] if known else None, sound


def automaton():
    """All phrases and tags, each between single spaces."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICE_PHRASES), ("base", BASE_PHRASES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    found.make_automaton()
    return found


LONGEST_PHRASE = max(p.count(" ") + 1 for p in [*BASE_PHRASES, *NOTICE_PHRASES, *TAGS])


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time; slices end at separators."""
    start = 0
    while start < len(text):
        end = start + SLICE_BYTES
        while end < len(text) and WORD_BYTES[text[end]] != 32:
            end += 1
        yield text[start:end].translate(WORD_BYTES).split()
        start = end


def scan(text: bytes, phrases) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, restriction`` of a text."""
    seen, carry = 0, []  # words before this slice, of which the last few are looked at again
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    kinds: set[str] = set()
    for words in word_slices(text):
        joined = (b" " + b" ".join(carry + words) + b" ").decode("latin-1")
        for end, (kind, label, size, n) in phrases.iter(joined):
            place = joined.count(" ", 0, end + 1 - size)
            if place + n <= len(carry):
                continue  # met in the slice before
            kinds.add(kind)
            if kind == "tag":
                continue
            labels.add(label)
            if kind == "base":
                base.add(label)
                n_base += 1
                place += seen - len(carry)
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
        seen += len(words)
        carry = (carry + words)[-(LONGEST_PHRASE - 1):]
    restriction = None
    sound_tag = False
    if "tag" in kinds:
        for tag in TAG_TEXT.finditer(text):
            got, weight, sound = evaluate(tag[1].decode("utf-8", "replace"))
            labels |= got
            sound_tag |= sound
            if weight is not None:
                restriction = weight if restriction is None else max(restriction, weight)
    doubt = 1.0
    for kind in sorted(kinds - {"tag"}) + ["tag"] * sound_tag:
        doubt *= 1 - EVIDENCE[kind]
    return (seen, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, restriction)


_PHRASES: list = []

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, restriction double")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its licence notices and what its licence expressions amount to.

    Columns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    restriction``. Words are counted after lower-casing A-Z. ``n_base`` counts all places where a
    base phrase's words follow one another, overlapping ones too; ``first_word`` and
    ``last_word`` are the smallest and largest of their first words, from 0, or null.
    ``labels`` adds further notices and the licences named in expressions behind SPDX tags.
    ``score`` is the chance that a licence is there, from the kinds of evidence met.
    ``restriction`` is the heaviest expression's, null where there is none.

    Null and empty texts give zeros, nulls, empty labels and score 0. Null or repeated ids are
    rows like others. Columns beyond the two named ones are not read.

    Work: one pass without a shuffle; a long text is taken to words in slices that overlap by the
    longest phrase.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _PHRASES:
            _PHRASES.append(automaton())
        for batch in batches:
            columns = list(zip(*[scan(t.as_py(), _PHRASES[0]) for t in batch.column(1)], strict=True))
            columns = columns or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=["doc_id", *fields])

    return rows.mapInArrow(scanned, f"doc_id {kind}, {SCHEMA}")
