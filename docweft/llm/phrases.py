"""Collocations by pattern growth: frequent contiguous phrases of each language, and how firmly their parts hold together.

A phrase grows to the right. Its projected table is the list of pointers to
where it goes on: an occurrence of its prefix and the words behind it, up to
the end of the piece or the greatest length. Pointers are dealt by prefix, so
one task holds the whole projected table of a prefix; there the pattern is
extended depth first, each frequent extension keeping the pointers that lead
on from it.

A prefix with very many pointers is not dealt as a whole: it is extended once
before the deal, and its extensions are prefixes of their own. Which prefixes
are that long is marked in a bitmap of fixed size (``FILTER_BITS``); a chance
match in it only means that a prefix is dealt by its extensions, which gives
the same counts. Equal pointers of a block of texts are one row with a number.

Defined results: null texts are empty; a null language is ``und``; columns
beside these two are not looked at; repeated rows count as often as they stand
there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import hot_keys, salted_join, written

#: Bytes of text that are split at once.
BLOCK_BYTES = 4 << 20
#: Pointers that a prefix may have to be dealt as a whole: a share of all words, within bounds.
PREFIX_SHARE, PREFIX_LEAST, PREFIX_MOST = 2000, 2_000, 200_000
#: Bits of the bitmap of long prefixes: 2 MB.
FILTER_BITS = 1 << 24
PHRASES = "lang string, phrase string, f long"
#: Pointers that a task looks at together; a prefix is never split between two looks.
LOOK = 200_000

#: What ends a piece, what stands between words.
_PIECE_ENDS, _BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in _BLANKS]] = 1
_KIND[[ord(c) for c in _PIECE_ENDS]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts (each followed by what ends a piece), the number of each word's text, and of its piece.

    All work is on the bytes: what parts words is ASCII, so no byte of a longer character is taken for it.
    """
    whole = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    data = b"\n".join(whole) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    offsets = (np.flatnonzero(inside[1:] != inside[:-1]) + 1).astype(np.int32)
    if inside[0]:
        offsets = np.r_[np.int32(0), offsets]
    if not len(offsets):
        return pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int32)
    starts = offsets[::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    ends = np.cumsum(np.array([len(x) + 1 for x in whole]))
    text = np.searchsorted(ends, starts, side="right").astype(np.int32)
    # words and the gaps between them lie side by side, so where they begin and end are the offsets of both
    both = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LOWER[raw].tobytes())])
    return both.take(pa.array(np.arange(0, len(offsets) - 1, 2))), text, piece


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, distinct words, language and word of each word, its piece) of blocks of texts."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = np.asarray(langs.indices)
        sizes = np.asarray(pc.binary_length(batch.column(1)).fill_null(0)).astype(np.int64)
        block = np.cumsum(sizes) // BLOCK_BYTES
        cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(sizes)] if len(sizes) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            words, text, piece = split_words(batch.column(1).slice(a, z - a))
            if len(words):
                coded = words.dictionary_encode()
                yield langs.dictionary.to_pylist(), coded.dictionary, code[a:z][text], np.asarray(coded.indices), piece


def _grouped(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each stands first, and how often (or how much) it occurs."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.empty(0, np.int64)
    if weights is None:
        amount = np.diff(np.r_[starts, len(keys)])
    else:
        amount = np.add.reduceat(weights[order], starts) if len(keys) else weights[:0]
    return ordered[starts], order[starts], amount


def _hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit number of each word, the same in all tasks: its bytes as digits of a number to an odd base, mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]].astype(np.uint64) if len(words) else np.empty(0, np.uint64)
    size = int(offsets[-1]) if len(words) else 0
    power, back = (np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)]) for base in (_BASE, _BACK))
    sums = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * power[:-1])]
    value = (sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]]
    value = (value ^ (value >> np.uint64(31))) * _MIX
    return value ^ (value >> np.uint64(29))


#: An odd number, and the number whose product with it is 1 modulo 2**64.
_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _lang_number(langs: list[str]) -> np.ndarray:
    return _hashed(pa.array(langs, pa.string()))


def _marked(bits: np.ndarray | None, numbers: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(numbers), bool)
    at = numbers % np.uint64(FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, lang, word, _ in _blocks(batches):
            keys, _, n = _grouped(lang.astype(np.int64) * len(words) + word)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs).take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))), pa.array(n)], ["lang", "phrase", "f"]
            )

    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _numbers(langs: list[str], words: pa.Array, lang: np.ndarray, word: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """For each occurrence the number of its prefix of 1, 2, ... ``most`` words, one length after another."""
    own = _hashed(words)
    value = _lang_number(langs)[lang]
    for d in range(most):
        following = np.append(word[d:], np.repeat(word[-1:], min(d, len(word))))
        value = (value * _MIX) ^ (own[following] + np.uint64(d + 1))
        value ^= value >> np.uint64(29)
        yield value


def _goes_on(piece: np.ndarray, most: int) -> list[np.ndarray]:
    """For d = 1 to most - 1: whether the word d places on is in the same piece."""
    out = []
    for d in range(1, most):
        same = np.zeros(len(piece), bool)
        if len(piece) > d:
            same[:-d] = piece[d:] == piece[:-d]
        out.append(same)
    return out


def _bitmap(counted: DataFrame, limit: int, bits: np.ndarray | None) -> np.ndarray | None:
    """``bits`` with those of (bit, n) that have more than ``limit``; the driver gets a row for every 32,768 bits."""
    found = counted.groupBy("bit").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    span = F.lit(32_768)
    rows = found.groupBy(F.floor(F.col("bit") / span).alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % span).alias("b")).collect()
    if not rows:
        return None
    out = np.zeros(FILTER_BITS // 8, np.uint8) if bits is None else bits.copy()
    for at, b in rows:
        out[at * 4096 : (at + 1) * 4096] |= np.frombuffer(bytes(b), np.uint8)
    return out


def long_prefixes(texts: DataFrame, words: DataFrame, most: int, limit: int) -> tuple[np.ndarray | None, int]:
    """The bitmap of the prefixes of up to most - 1 words that have more than ``limit`` pointers, and the most words of one."""

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang, word = np.asarray(langs.indices), np.arange(batch.num_rows)
            number = next(_numbers(langs.dictionary.to_pylist(), batch.column(1), lang, word, 1)) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), batch.column(2)], ["bit", "n"])

    bits = _bitmap(words.select("lang", "phrase", "f").mapInArrow(of_words, "bit long, n long"), limit, None) if most > 1 else None
    depth = 1
    while bits is not None and depth < most - 1:
        depth += 1
        longer = _bitmap(_of_marked(texts, bits, depth, most, "bit long, n long", _as_bits), limit, bits)
        if longer is None:
            return bits, depth - 1
        bits = longer
    return bits, depth if bits is not None else 0


def _of_marked(texts: DataFrame, bits: np.ndarray, depth: int, most: int, schema: str, tell) -> DataFrame:
    """``tell`` of the occurrences of ``depth`` words all of whose shorter prefixes are marked."""
    marks = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, lang, word, piece in _blocks(batches):
            valid = _goes_on(piece, most)
            take = np.ones(len(word), bool)
            for d, number in enumerate(_numbers(langs, words, lang, word, depth)):
                if d < depth - 1:
                    take &= valid[d] & _marked(marks.value, number)
            yield tell(marks.value, langs, words, lang, word, number, np.flatnonzero(take), depth)

    return texts.mapInArrow(run, schema)


def _as_bits(bits, langs, words, lang, word, number, which, depth) -> pa.RecordBatch:
    keys, _, n = _grouped(number[which] % np.uint64(FILTER_BITS))
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["bit", "n"])


def _as_phrases(bits, langs, words, lang, word, number, which, depth) -> pa.RecordBatch:
    which = which[_marked(bits, number[which])]
    columns = [word[which + d] for d in range(depth)]
    first, n = _distinct(lang[which], columns, len(words))
    spelled = pc.binary_join_element_wise(*(words.take(pa.array(c[first])) for c in columns), " ")
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[which][first])), spelled, pa.array(n)], ["lang", "phrase", "f"])


def _distinct(lang: np.ndarray, columns: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row stands first, in the order of language and words, and how often it occurs."""
    key, room = lang.astype(np.int64), int(lang.max()) + 1 if len(lang) else 1
    for c in columns:
        if room * (words + 1) >= 2**62:
            distinct, key = np.unique(key, return_inverse=True)
            room = len(distinct)
        key, room = key * (words + 1) + c, room * (words + 1)
    _, first, n = _grouped(key)
    return first, n


def marked_counts(texts: DataFrame, bits: np.ndarray, depth: int, most: int) -> DataFrame:
    """(lang, phrase, f) of the marked prefixes of ``depth`` words: no task holds all of their pointers."""
    return _of_marked(texts, bits, depth, most, PHRASES, _as_phrases).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


POINTERS = "lang string, prefix string, rests string"


def project(texts: DataFrame, most: int, bits: np.ndarray | None) -> DataFrame:
    """The projected tables: (lang, prefix, rests), the rests of a prefix in a block of texts with their numbers.

    A prefix has as many words as it takes for it not to be marked. A rest is
    the words behind, a tab behind each, empty ones where the piece ends, then
    its number; rests are lines.
    """
    marks = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, words, lang, word, piece in _blocks(batches):
            valid = _goes_on(piece, most)
            columns = [word] + [np.where(v, np.append(word[d + 1 :], np.repeat(word[-1:], min(d + 1, len(word)))), np.int32(len(words))) for d, v in enumerate(valid)]
            # only what goes on is a pointer; a prefix is the shortest that isn't marked
            some, size = valid[0].copy(), np.ones(len(word), np.int8)
            for d, number in enumerate(_numbers(langs, words, lang, word, most - 1)):
                size += (size == d + 1) & _marked(marks.value, number)
            for d in range(1, most):
                some &= (size <= d) | valid[d - 1]
            held = [c[some] for c in columns]
            first, n = _distinct(lang[some], held, len(words))
            size, lang_of = size[some][first], lang[some][first]
            held = [c[first] for c in held]
            texted = pa.concat_arrays([words, pa.array([""], pa.string())])
            spelled = [texted.take(pa.array(c)) for c in held]
            number = pc.cast(pa.array(n), pa.string())
            for d in range(1, most + 1):
                which = np.flatnonzero(size == d)
                if not len(which):
                    continue
                at = pa.array(which)
                prefix = pc.binary_join_element_wise(*(s.take(at) for s in spelled[:d]), " ")
                rest = pc.binary_join_element_wise(*(s.take(at) for s in spelled[d:]), number.take(at), "\t")
                # rows came out in the order of language and words, so those of a prefix stand together
                same = np.ones(len(which), bool)
                same[1:] = lang_of[which][1:] != lang_of[which][:-1]
                for c in held[:d]:
                    same[1:] |= c[which][1:] != c[which][:-1]
                begins = np.flatnonzero(same)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(which)].astype(np.int32)), rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs).take(pa.array(lang_of[which][begins])), prefix.take(pa.array(begins)), pc.binary_join(lists, "\n")], ["lang", "prefix", "rests"]
                )

    return texts.mapInArrow(run, POINTERS)


def _grow(out: list, prefix: str, rests: np.ndarray, weights: np.ndarray, rows: np.ndarray, depth: int, names: pa.Array, least: int) -> None:
    """All frequent extensions of a prefix, depth first; ``rows`` are its pointers, ``rests[rows, depth]`` the next words."""
    if depth == rests.shape[1]:
        return
    following = rests[rows, depth]
    order = np.argsort(following, kind="stable")
    following, rows = following[order], rows[order]
    starts = np.flatnonzero(np.r_[True, following[1:] != following[:-1]])
    totals = np.add.reduceat(weights[rows], starts)
    ends = np.r_[starts[1:], len(rows)]
    for k in np.flatnonzero((totals >= least) & (following[starts] >= 0)):
        longer = f"{prefix} {names[int(following[starts[k]])]}"
        out.append((longer, int(totals[k])))
        _grow(out, longer, rests, weights, rows[starts[k] : ends[k]], depth + 1, names, least)


def _look(rows: pa.Table, most: int, least: int) -> list[tuple[str, str, int]]:
    """The frequent phrases that begin with some prefixes; all rows of a prefix stand together."""
    found: list[tuple[str, str, int]] = []
    depths = np.asarray(pc.count_substring(rows["prefix"], " ")) + 1
    for d in np.unique(depths):
        own = rows.filter(pa.array(depths == d)).combine_chunks()
        langs, prefixes, lines = (own[c].combine_chunks() for c in ("lang", "prefix", "rests"))
        wide = most - d
        counts = np.asarray(pc.count_substring(lines, "\n")).astype(np.int64) + 1
        cells = pc.split_pattern(pc.replace_substring(lines, "\n", "\t"), "\t").flatten()
        weights = np.asarray(cells.take(pa.array(np.arange(wide, len(cells), wide + 1))).cast(pa.int64()))
        rests = np.empty((len(weights), wide), np.int64)
        names = pa.array([], pa.string())
        if wide:
            taken = np.ones(len(cells), bool)
            taken[wide :: wide + 1] = False
            coded = cells.filter(pa.array(taken)).dictionary_encode()
            names = coded.dictionary
            rests = np.asarray(coded.indices).astype(np.int64).reshape(-1, wide)
            blank = names.index("").as_py()
            if blank >= 0:
                rests = np.where(rests == blank, -1, rests)
        new = _begins(langs, prefixes)
        group = np.repeat(np.cumsum(new) - 1, counts)
        at = np.flatnonzero(new)
        langs, prefixes = langs.take(pa.array(at)), prefixes.take(pa.array(at))
        totals = np.bincount(group, weights, len(at)).astype(np.int64)
        if d > 1:
            often = np.flatnonzero(totals >= least)
            found += zip(langs.take(pa.array(often)).to_pylist(), prefixes.take(pa.array(often)).to_pylist(), totals[often].tolist(), strict=True)
        if not wide:
            continue
        # prefixes none of whose extensions are frequent are passed over together
        keys, first, amount = _grouped(group * (len(names) + 1) + rests[:, 0] + 1, weights)
        alive = np.unique(group[first[(amount >= least) & (keys % (len(names) + 1) > 0)]])
        heads = zip(langs.take(pa.array(alive)).to_pylist(), prefixes.take(pa.array(alive)).to_pylist(), strict=True)
        begins, ends = np.searchsorted(group, alive), np.searchsorted(group, alive, side="right")
        for (lang, prefix), a, z in zip(heads, begins, ends, strict=True):
            grown: list = []
            _grow(grown, prefix, rests, weights, np.arange(a, z), 0, names, least)
            found += [(lang, phrase, n) for phrase, n in grown]
    return found


def _begins(langs: pa.Array, prefixes: pa.Array) -> np.ndarray:
    """Where another prefix begins."""
    out = np.ones(len(langs), bool)
    if len(langs) > 1:
        out[1:] = np.asarray(pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(prefixes[1:], prefixes[:-1])))
    return out


def grow(pointers: DataFrame, most: int, least: int) -> DataFrame:
    """Frequent phrases of two words or more, from the projected tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tell(rows: list) -> pa.RecordBatch:
            langs, phrases, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            size = np.asarray(pc.count_substring(held["rests"], "\n")) + 1
            while size.sum() >= LOOK:
                # up to where a prefix begins behind LOOK pointers; the last prefix may go on in the next batch
                new = np.flatnonzero(_begins(held["lang"].combine_chunks(), held["prefix"].combine_chunks()))[1:]
                if not len(new):
                    break
                behind = new[np.cumsum(size)[new - 1] >= LOOK]
                cut = int(behind[0] if len(behind) else new[-1])
                yield tell(_look(held.slice(0, cut), most, least))
                held, size = held.slice(cut).combine_chunks(), size[cut:]
        if held is not None and held.num_rows:
            yield tell(_look(held, most, least))

    dealt = pointers.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(run, PHRASES)


def frequent(texts: DataFrame, most: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words, and of all phrases of 2 to ``most`` words with f of at least ``least``."""
    words = written(word_counts(texts), "words")
    total = words.agg(F.sum("f")).first()[0] or 0
    limit = min(PREFIX_MOST, max(PREFIX_LEAST, total // PREFIX_SHARE))
    bits, depth = long_prefixes(texts, words, most, limit)
    found = grow(project(texts, most, bits), most, least)
    for d in range(2, depth + 1):
        found = found.unionByName(marked_counts(texts, bits, d, most).where(F.col("f") >= least))
    return words, written(found, "phrases")


def _cut(words: Column, a: Column, z: Column) -> Column:
    return F.array_join(F.slice(words, a, z), " ")


def _looked_up(rows: DataFrame, part: str, known: DataFrame, name: str) -> DataFrame:
    """``rows`` with the count of their phrase ``part``; parts that very many rows share are spread."""
    few = known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    return salted_join(rows, few, ["lang", part], hot_keys(rows, ["lang", part]), ["phrase", "k"])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` are the counts of a phrase and of the two parts of
    its weakest cut, ``n`` of all words. Phrases inside a longer one that has
    ``inside_percent`` of their count or more are left out.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, phrases = frequent(texts, most, least)
    known = words.where(F.col("f") >= least).unionByName(phrases)
    split = phrases.withColumn("w", F.split("phrase", " ", -1)).withColumn("m", F.size("w"))
    one = F.lit(1)
    cuts = split.select(
        "lang", "phrase", F.col("f").alias("a"), "w", "m", F.explode(F.sequence(one, F.col("m") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", _cut(F.col("w"), one, F.col("k")).alias("head"), _cut(F.col("w"), F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    scored = _looked_up(written(_looked_up(written(cuts, "cuts"), "head", known, "l"), "cuts"), "tail", known, "r")
    # counts have 13 digits at most where a score of 38 digits is exact
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    scored = scored.select("lang", "phrase", "a", "k", "l", "r", *(v.alias(f"d{c}") for c, v in wide.items())).withColumn("score", F.expr("cast(1000000 * da * da div (dl * dr) as long)"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*")
    begin, size = F.col("s.b"), F.col("s.z")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda z: F.transform(F.sequence(one, F.col("m") - z + 1), lambda b: F.struct(b.alias("b"), z.alias("z")))))
    inner = split.where("m > 2").select("lang", "w", "f", F.explode(spans).alias("s")).select("lang", _cut(F.col("w"), begin, size).alias("phrase"), "f")
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
