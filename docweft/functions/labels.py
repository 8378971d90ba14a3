"""Labelled values of whole documents, as an Arrow function: where labels stand, what follows them, and which blocks bear them out.

This is the one step of extraction that runs in Python: which of a document's
values occur in which of its blocks is a search for a set of strings, which
takes an automaton to be linear; built-in functions would compare every value
with every block. Results hold numbers of blocks, not their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions.text import WHITE

#: Of each leaf: values with the page (from 1) that completes them, and numbers of blocks with the page from which on they are evidence.
MATCHES = "array<struct<vals:array<struct<page:int,raw:string>>,evs:array<struct<page:int,block:int>>>>"
_VALS = pa.struct([("page", pa.int32()), ("raw", pa.string())])
_EVS = pa.struct([("page", pa.int32()), ("block", pa.int32())])
_ANY = "[" + WHITE + "]*+"
_SAME_LINE = "[" + WHITE.replace("\n", "") + "]*+"
#: Comparisons of values with blocks up to which no automaton is built.
FEW = 64


@lru_cache(8192)
def label_regex(label: str) -> re.Pattern:
    """A line that begins with a label, perhaps behind a bullet, and a colon; group 1 is the value. No step back is ever needed, so it is linear."""
    return re.compile(rf"(?m)^{_SAME_LINE}(?:[-*•]{_ANY})?{re.escape(label)}{_ANY}[:：]{_ANY}([^\n\r]++)$")


def _open_end(text: str, label: str) -> str:
    """The end of a text in which a match has begun that the next page may complete; empty if there is none."""
    end = text.rstrip(WHITE)
    if end[-1:] in (":", "："):
        end = end[:-1].rstrip(WHITE)
    if not end.endswith(label):
        return ""
    return text[text.rfind("\n", 0, len(end) - len(label)) + 1 :]


def page_values(pages: list[str], label: str) -> Iterator[tuple[int, str]]:
    """(page, value) of a label in the pages' texts joined by line feeds: the page, from 1, is that where the value ends."""
    find = label_regex(label).finditer
    rest = ""
    for number, text in enumerate(pages, 1):
        if not text:
            continue
        whole = f"{rest}\n{text}" if rest else text
        if not rest and label not in whole:
            continue
        end = 0
        for m in find(whole):
            end = m.end()
            value = m[1].strip(WHITE)
            if value:
                yield number, value
        rest = _open_end(whole[end:], label)


def _contained(values: list[str], pages: list[int], texts: list[str], which: list[int]) -> list[tuple[int, int, int]]:
    """(first value, block, least page of a value) of the blocks that hold a value."""
    out = []
    if len(values) * len(which) <= FEW:
        for b in which:
            held = [k for k, v in enumerate(values) if v in texts[b]]
            if held:
                out.append((held[0], b, min(pages[k] for k in held)))
        return out
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, v in enumerate(values):
        automaton.add_word(v, k)
    automaton.make_automaton()
    for b in which:
        first, page = len(values), 1 << 30
        for _, k in automaton.iter(texts[b]):
            first, page = min(first, k), min(page, pages[k])
        if first < len(values):
            out.append((first, b, page))
    return out


def leaf_matches(page_texts: list[str], block_pages: list[int], block_texts: list[str], labels: list[str]) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """Values (page, raw) of a leaf in the order of its labels, text before blocks, and the page from which on each block is evidence."""
    found: list[tuple[int, str]] = []
    evidence: dict[int, int] = {}
    for label in labels:
        which = [b for b, t in enumerate(block_texts) if label in t]
        seen: dict[str, int] = {}
        for page, value in page_values(page_texts, label):
            seen.setdefault(value, page)
        found += [(page, value) for value, page in seen.items()]
        if seen and which:
            for _, b, page in sorted(_contained(list(seen), list(seen.values()), block_texts, which)):
                page = max(page, block_pages[b])
                evidence[b] = min(evidence.get(b, page), page)
        find = label_regex(label).finditer
        for b in which:
            own: set[str] = set()
            for m in find(block_texts[b]):
                value = m[1].strip(WHITE)
                low = value.lower()
                if value and low not in own:
                    own.add(low)
                    found.append((block_pages[b], value))
                    evidence[b] = min(evidence.get(b, block_pages[b]), block_pages[b])
    return found, evidence


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _array(per_document: list[list[tuple[list[tuple[int, str]], dict[int, int]]]]) -> pa.Array:
    leaves = [leaf for doc in per_document for leaf in doc]
    vals = [v for found, _ in leaves for v in found]
    evs = [e for _, evidence in leaves for e in evidence.items()]
    val = pa.StructArray.from_arrays([pa.array([p for p, _ in vals], pa.int32()), pa.array([r for _, r in vals], pa.string())], fields=list(_VALS))
    ev = pa.StructArray.from_arrays([pa.array([p for _, p in evs], pa.int32()), pa.array([b for b, _ in evs], pa.int32())], fields=list(_EVS))
    of_leaf = pa.StructArray.from_arrays([_lists([len(f) for f, _ in leaves], val), _lists([len(e) for _, e in leaves], ev)], ["vals", "evs"])
    return _lists([len(d) for d in per_document], of_leaf)


def _blocks(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """(pages, texts) of each document's blocks; a block equal to an earlier one of its page has an empty text, which holds no label."""
    by_document, by_page = column.offsets.to_pylist(), column.values.offsets.to_pylist()
    flat = column.values.values
    texts = flat.field("text").to_pylist()
    # ids tell blocks of a page apart, so they are read only where a page has several
    several = any(b - a > 1 for a, b in zip(by_page[:-1], by_page[1:], strict=True))
    ids = flat.field("id").to_pylist() if several else texts
    for first, last in zip(by_document[:-1], by_document[1:], strict=True):
        pages, own = [], []
        if last == first + 1 and by_page[last] == by_page[first] + 1:  # one page with one block
            yield [1], [texts[by_page[first]] or ""]
            continue
        for number, p in enumerate(range(first, last), 1):
            seen: set[tuple] = set()
            for k in range(by_page[p], by_page[p + 1]):
                key = (ids[k], texts[k])
                own.append("" if key in seen else texts[k] or "")
                seen.add(key)
                pages.append(number)
        yield pages, own


def find_labels(page_texts: Column, blocks: Column, labels: Column | list[list[str]]) -> Column:
    """Matches of the labels of each leaf, as MATCHES.

    ``page_texts`` are strings, ``blocks`` a list of structs of id and text for each page. ``labels``
    is a list of labels for each leaf, the same for all documents, or a column of such lists.
    """
    fixed = None if isinstance(labels, Column) else labels

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        known: dict[tuple, list] = {}  # documents of a batch that have the same texts are searched once
        for own, (pages, block_texts) in zip(texts.to_pylist(), _blocks(found), strict=True):
            key = (tuple(own or ()), tuple(pages), tuple(block_texts))
            leaves = known.get(key)
            if leaves is None:
                leaves = known[key] = [leaf_matches([t or "" for t in own or []], pages, block_texts, leaf) for leaf in fixed]
            out.append(leaves)
        return _array(out)

    @F.arrow_udf(MATCHES)
    def run_own(texts: pa.Array, found: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        known: dict[tuple, tuple] = {}
        for own, (pages, block_texts), leaves in zip(texts.to_pylist(), _blocks(found), asked.to_pylist(), strict=True):
            labels = tuple(tuple(leaf or ()) for leaf in leaves or ())
            key = (tuple(own or ()), tuple(pages), tuple(block_texts), labels)
            held = known.get(key)
            if held is None:
                held = known[key] = [leaf_matches([t or "" for t in own or []], pages, block_texts, leaf) for leaf in labels]
            out.append(held)
        return _array(out)

    # said to be nondeterministic, so that the optimizer neither copies the call into several expressions nor runs it twice
    if fixed is not None:
        return run.asNondeterministic()(page_texts, blocks)
    return run_own.asNondeterministic()(page_texts, blocks, labels)
