"""Phrase collocations by Suffix-sigma: every phrase of up to ``max_n`` words is counted from suffixes cut to that many words.

One row for each place of a word is shuffled, not one for each phrase: the words from that place on. Suffixes are dealt by
language and first word, sorted in reverse, and one stack of open prefixes counts every prefix as it closes. Three things
keep this small. Equal suffixes of a block of text are counted together before they are shuffled. A suffix ends early
where it meets a word or pair of words that is too rare to be part of any candidate; a first pass counts hashes of words
and pairs, and only a bitmap of fixed size of those that are frequent reaches the tasks, so a wrong bit lets a suffix grow
and never ends one. And a first word's suffixes are dealt in parts by the second word, whose counts of the first word
alone are added up. (Berberich and Bedathur, "Computing n-Gram Statistics in MapReduce", 2013.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.llm.common import cut, small_batches
from copse.llm.tiles import merged

#: Words of the longest phrase; occurrences of a candidate; percent of a phrase's occurrences that lie in a longer one
#: which covers it; rows of a language; factor of scores.
MAX_N, MIN_COUNT, COVERED, FIRST, FACTOR = 4, 30, 80, 2000, 2_000_000
#: Bytes of a block of text; bits of the bitmap; parts of a first word; parts from which a language's first rows are merged.
BLOCK, BITS, PARTS, LISTS = 1 << 22, 1 << 27, 16, 64
#: Bits of the bitmap that one row holds.
_CHUNK = 32768
NO_LANG = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD, _SPACE, _END = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of a word that are hashed or compared a column at a time; what is longer is hashed and compared whole.
_COLUMNS = 48


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Block:
    """The words of a block of text: where they start and end, which piece they stand in, and a hash of each."""

    def __init__(self, lang: str, text: bytes):
        self.data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
        kind = _KIND[self.data]
        edges = np.flatnonzero(np.diff(np.r_[False, kind == _WORD, False]))
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == _END, dtype=np.int32)[self.start]
        self.order = np.argsort(self.start - self.end, kind="stable")  # the longest first
        size = (self.end - self.start)[self.order]
        self.reach = [int(np.searchsorted(-size, -j)) for j in range(_COLUMNS + 1)]  # words longer than j bytes
        at, h = self.start[self.order], np.full(len(size), xxhash.xxh64_intdigest(lang), dtype=np.uint64)
        for j in range(_COLUMNS):
            n = self.reach[j]
            h[:n] = (h[:n] ^ self.data[at[:n] + j]) * _MIX[0]
            h[:n] ^= h[:n] >> np.uint64(32)
        for i in range(self.reach[_COLUMNS]):
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.word(self.order[i])))
        self.hash = np.empty_like(h)
        self.hash[self.order] = _mixed(h + size.astype(np.uint64))
        #: Whether the next word stands in the same piece, and the hash of both.
        self.paired = self.piece[1:] == self.piece[:-1]
        self.pair = _mixed(self.hash[:-1] * _MIX[0] + self.hash[1:])

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its distinct word, and a place of each distinct word. Words are told by their bytes, not by their hash."""
        _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        at, like = self.start[self.order], self.start[first[number[self.order]]]
        size = self.end - self.start
        same = bool((size == size[first[number]]).all())
        for j in range(_COLUMNS if same else 0):
            n = self.reach[j]
            same = same and bool((self.data[at[:n] + j] == self.data[like[:n] + j]).all())
        same = same and all(self.word(i) == self.word(first[number[i]]) for i in self.order[: self.reach[_COLUMNS]])
        if not same:  # two words with one hash
            known: dict[bytes, int] = {}
            number = np.array([known.setdefault(self.word(i), len(known)) for i in range(len(self))], dtype=np.int64)
            _, first = np.unique(number, return_index=True)
        return number, first


def _cuts(text: bytes, max_n: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts: each with the words that follow it, as far as a suffix reaches, and the bytes that are its own."""
    start = 0
    while start < len(text):
        end = start + BLOCK
        while end < len(text) and not _KIND[text[end]]:
            end += 1
        more = end
        for _ in range(max_n - 1):
            while more < len(text) and _KIND[text[more]]:
                more += 1
            while more < len(text) and not _KIND[text[more]]:
                more += 1
        yield text[start:more], min(end, len(text)) - start
        start = end


def _blocks(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[tuple[str, Block, int]]:
    """Texts of a language together, as blocks of about ``BLOCK`` bytes, and how many of a block's words are its own."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def block(lang: str) -> tuple[str, Block, int]:
        whole = Block(lang, b"\n".join(held.pop(lang)))
        del sizes[lang]
        return lang, whole, len(whole)

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            if len(text) > BLOCK:
                for part, own in _cuts(text, max_n):
                    one = Block(lang, part)
                    yield lang, one, int(np.searchsorted(one.start, own))
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sum(sizes.values()) > BLOCK:
                yield block(max(sizes, key=sizes.get))
    while held:
        yield block(next(iter(held)))


def _hashes(max_n: int):
    """How often each hash of a word or of a pair of words occurs, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, own in _blocks(batches, max_n):
            pairs = block.pair[:own][block.paired[:own]]
            found, n = np.unique(np.r_[block.hash[:own], pairs].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["hash", "n"])

    return run


def _suffixes(max_n: int, bits):
    """``key, lang, suffix, n`` of each block: its suffixes, as far as they can matter, each word followed by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, dtype=np.uint8)
        at = np.uint64(len(bitmap) * 8 - 1)
        often = lambda h: (bitmap[((h & at) >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 != 0
        for lang, block, own in _blocks(batches, max_n):
            number, first = block.names()
            n = len(block)
            known = often(block.hash)
            goes_on = np.r_[block.paired & known[1:] & often(block.pair), np.zeros(min(1, n), dtype=bool)]
            length, open_ = known.astype(np.int64), known
            for j in range(max_n - 1):
                open_ = open_ & np.r_[goes_on[j:], np.zeros(min(j, n), dtype=bool)]
                length += open_
            whole = block.data.tobytes()
            names = [whole[a:b] + b" " if k else b"" for a, b, k in zip(block.start[first].tolist(), block.end[first].tolist(), known[first].tolist(), strict=True)]
            suffixes, counts, keys = [b""], [int((length[:own] == 0).sum())], [xxhash.xxh64_intdigest(lang)]
            code, some = number.astype(np.int64), np.flatnonzero(length[:own] > 0)
            for size in range(1, max_n + 1):
                done = length[some] == size
                _, place, c = np.unique(code[some[done]], return_index=True, return_counts=True)
                places = some[done][place]
                suffixes += map(b"".join, zip(*([names[x] for x in number[places + j]] for j in range(size)), strict=True))
                counts += c.tolist()
                second = block.hash[places + 1] % np.uint64(PARTS) if size > 1 else np.uint64(0)
                keys += (block.hash[places] + second).tolist()
                some = some[~done]
                if size < max_n:
                    _, code[some] = np.unique(code[some], return_inverse=True)
                    code[some] = code[some] * len(names) + number[np.minimum(some + size, n - 1)]
            columns = [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array([lang] * len(keys)), pa.array(suffixes, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "suffix", "n"])

    return run


def _prefixes(min_count: int):
    """Counts of all prefixes of suffixes that come in reverse order: a prefix is closed when a suffix without it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int, int]] = []
        now, last, words, counts = None, None, [], [0]  # counts[i] is what the first i words have so far

        def close(keep: int) -> None:
            while len(words) > keep:
                n = counts.pop()
                counts[-1] += n
                if n >= min_count or len(words) == 1:  # the other parts of a first word may have more
                    out.append((now, " ".join(words), len(words), n))
                words.pop()

        def whole() -> None:
            close(0)
            if now is not None:
                out.append((now, "", 0, counts[0]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "phrase", "words", "f"])

        for batch in batches:
            for lang, suffix, n in zip(batch["lang"].to_pylist(), batch["suffix"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if lang != now:
                    whole()
                    now, counts[0] = lang, 0
                elif suffix == last:  # of another block
                    counts[-1] += n
                    continue
                last = suffix
                parts, common = suffix.split(" ")[:-1], 0
                while common < min(len(parts), len(words)) and parts[common] == words[common]:
                    common += 1
                close(common)
                words += parts[common:]
                counts += [0] * (len(parts) - common)
                counts[-1] += n
            yield batch_of()
        whole()
        yield batch_of()

    return run


def counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, bits: int = BITS) -> DataFrame:
    """``lang, phrase, words, f``: how often each phrase of up to ``max_n`` words occurs, if ``min_count`` times or more.

    A row with no words has the number of all words of its language.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").where("text IS NOT NULL")
    hashes = texts.mapInArrow(_hashes(max_n), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    chunks = hashes.groupBy(F.shiftright(bit, 15).cast("int").alias("chunk")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(_CHUNK - 1))).alias("bits"))
    bitmap = bytearray(bits // 8)
    for chunk, part in chunks.toLocalIterator():  # of a fixed size
        bitmap[chunk * _CHUNK // 8 : chunk * _CHUNK // 8 + len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    found = texts.mapInArrow(_suffixes(max_n, shared), "key long, lang string, suffix string, n long")
    dealt = found.repartition("key").sortWithinPartitions("lang", F.desc("suffix"))
    partial = dealt.select("lang", "suffix", "n").mapInArrow(_prefixes(min_count), "lang string, phrase string, words int, f long")
    return partial.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= min_count))


def _part(start, size) -> F.Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, size), " ")


def mine(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, covered: int = COVERED, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases by score, then ``a``, then phrase.

    Texts (``lang, text``) are lower-cased (A to Z), cut into pieces at punctuation and line ends and into words at spaces
    and tabs. A candidate has 2 to ``max_n`` words of a piece and ``a >= min_count`` occurrences, overlaps included. Of its
    cuts in two parts, with ``l`` and ``r`` occurrences, the one with the least ``FACTOR * a / (l + r)``, floored, counts
    (the first of equal ones). A candidate is dropped if a longer phrase contains it and has ``covered`` percent of its
    occurrences. ``n`` is the number of words of the language.

    A null text is an empty one and a null language is ``und``; repeated rows are texts of their own; texts and words may
    have any length; an empty table gives an empty result; other columns are left out.
    """
    known = cut(counts(docs, max_n, min_count, bits))
    phrases, totals = known.where("words > 0"), known.where("words = 0").select("lang", F.col("f").alias("n"))
    candidates = phrases.where("words > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, n: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(n))
    joined = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    joined = joined.withColumn("product", (exact("a") * FACTOR).cast("decimal(38,0)")).withColumn("total", (exact("l") + exact("r")).cast("decimal(38,0)"))
    scored = joined.withColumn("score", F.expr("product div total")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # how often the most frequent longer phrase around each occurs
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    around = candidates.where("words > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where((F.coalesce("longer", F.lit(0)).cast("decimal(38,0)") * 100) < exact("a") * covered)
    rows = kept.select("lang", "phrase", "a", "best.score", "best.l", "best.r", F.pmod(F.xxhash64("phrase"), F.lit(LISTS)).cast("int").alias("part"))
    # the first of each part of a language, then of parts together, so that no task orders a whole language
    order = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ahead = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    row = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("b"), "phrase", "l", "r")
    ranked = merged(ahead, ["lang"], row, first, LISTS, "part").join(totals, "lang").select("lang", "n", F.posexplode("list").alias("at", "x"))
    long = lambda c, name: c.cast("long").alias(name)
    return ranked.select(
        "lang", long(F.col("at") + 1, "rank"), "x.phrase", long(-F.col("x.b"), "a"), long(F.col("x.l"), "l"), long(F.col("x.r"), "r"), long(F.col("n"), "n"), long(-F.col("x.s"), "score")
    )
