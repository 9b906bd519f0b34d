"""Phrases whose words keep company, mined by Rabin-Karp fingerprints of n-grams.

Texts are cut at marks into pieces and these at blanks into words. Prefix polynomials over the
hashed words of a lot of texts give the fingerprint of every n-gram by a subtraction. Inside a lot
equal fingerprints are held against the text. Across lots the shuffle sums counts by fingerprint
and carries a pointer to a document with the phrase, not the phrase. A longer phrase is counted
only where its two shorter parts are frequent, which a bitmap of bounded size tells: it lets some
more pass, but none that counts is lost. Frequent phrases only are then read from the documents
they point to, where their fingerprints are worked out again.
"""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.sieve import passes, sieve_of
from dayloom.llm.skew import salted_lookup
from dayloom.llm.words import lots, mix
from dayloom.runtime import cut_lineage

#: Characters worked on at a time, and fingerprints that a task holds before it hands them on.
LOT, MOST = 500_000, 1_500_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ONE = np.uint64(1)

#: Per byte: 0 belongs to a word, 1 is a blank, 2 ends a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


#: By the bytes that are left of a word: what belongs to it in the next eight.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * LOT:
            _POWERS[base] = have
    return have[:n]


class Lot:
    """The words of some texts: where they start and end, their text and piece, and two hashes of each.

    A word's first hash is a polynomial of its bytes, the second sums hashes of eight bytes and their
    place, so that texts made to defeat one of them don't defeat the other.
    """

    def __init__(self, texts: list[str]):
        coded = [t.encode().lower() for t in texts]
        self.bytes = b"\n".join(coded) + b"\n"
        data = np.frombuffer(self.bytes, np.uint8)
        kind = _KIND[data]
        edge = np.diff((kind == 0).astype(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), self.start, side="right")
        # A text ends with a mark, so its words share no piece with the next one's.
        self.piece = np.cumsum(kind == 2)[self.start]
        size = self.end - self.start
        if not len(size):
            self.hash = self.check = np.zeros(0, np.uint64)
            return
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data] * _powers(_BASE, len(data)))])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_INVERSE, len(data))[self.start] + size.astype(np.uint64))
        # The bytes of every word, eight at a time, the last ones filled up with zeros.
        self.chunks = (size + 7) >> 3
        self.first = np.cumsum(self.chunks) - self.chunks
        self.place = np.arange(self.chunks.sum()) - np.repeat(self.first, self.chunks)
        eights = np.ndarray(len(data), "<u8", self.bytes + bytes(8), strides=(1,))
        left = np.repeat(size, self.chunks) - 8 * self.place
        self.eight = eights[np.repeat(self.start, self.chunks) + 8 * self.place] & _MASKS[np.minimum(left, 8)]
        spread = mix(mix(self.eight) + (self.place.astype(np.uint64) + _ONE) * np.uint64(0xA0761D6478BD642F))
        self.check = mix(np.add.reduceat(spread, self.first) + size.astype(np.uint64))

    def numbers(self) -> np.ndarray:
        """A number for every word, the same for equal words only: those of one hash are compared by their bytes."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        order = np.argsort(self.hash)
        new = np.concatenate([[True], self.hash[order][1:] != self.hash[order][:-1]])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        size, leader = self.end - self.start, order[new][number]
        same = size == size[leader]
        # Where the sizes differ, a word is held against itself here.
        other = np.where(same, self.first[leader], self.first)
        unlike = self.eight != self.eight[np.repeat(other, self.chunks) + self.place]
        odd = np.flatnonzero(np.logical_or.reduceat(unlike, self.first) | ~same)
        named: dict[bytes, int] = {}
        for i in odd:
            word = self.bytes[self.start[i] : self.end[i]]
            number[i] = named.setdefault(word, len(order) + len(named))
        return number

    def grams(self, size: int, salts: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, fingerprint, check) of every run of `size` words inside a piece.

        `salts` has a number per text; n-grams of texts with different ones are different. `known`
        tells where known runs, one word shorter, begin: only runs that begin and end with one are made.
        """
        words = len(self.start)
        at = np.arange(max(words - size + 1, 0))
        at = at[self.piece[at] == self.piece[at + size - 1]] if size else np.arange(words)
        if known is not None:
            at = at[known[at] & known[at + 1]]
        made = []
        salted = mix(salts + np.uint64(size))[self.text[at]]
        for values, base in ((self.hash, 0xC2B2AE3D27D4EB4F), (self.check, 0xD6E8FEB86659FD93)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(base, words))])
            run = (sums[at + size] - sums[at]) * _powers(pow(base, -1, 1 << 64), words)[at]
            made.append(mix(run + salted))
        return at, made[0], made[1] & np.uint64(0x7FFFFFFF)

    def phrase(self, first: int, size: int) -> str:
        return b" ".join(self.bytes[self.start[i] : self.end[i]] for i in range(first, first + size)).decode()


def _combined(key: np.ndarray, check: np.ndarray, n: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """Counts summed and pointers minimised by fingerprint and check."""
    order = np.argsort(key)
    if ((np.diff(key[order]) == 0) & (np.diff(check[order]) != 0)).any():
        order = np.lexsort((check, key))  # Keys that collide, which is rare.
    key, check, n, where = key[order], check[order], n[order], where[order]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])) if len(key) else np.zeros(0, np.int64)
    if not len(starts):
        return [key, check, n, where]
    return [key[starts], check[starts], np.add.reduceat(n, starts), np.minimum.reduceat(where, starts)]


def _lot_counts(lot: Lot, sizes: Sequence[int], salts: np.ndarray, where: np.ndarray, sieve: np.ndarray | None = None) -> list[np.ndarray]:
    """Fingerprints, checks, counts and pointers of a lot's n-grams of some sizes.

    Size 0 is the run of no words, which occurs once a word. With a sieve only n-grams count whose
    first and last part, one word shorter, pass it. A fingerprint that two different runs of words
    share in the lot stays apart by its check.
    """
    number = lot.numbers()
    parts = []
    for size in sizes:
        known = None
        if sieve is not None:
            known = np.zeros(len(lot.start), bool)
            shorter, part, _ = lot.grams(size - 1, salts)
            known[shorter] = passes(sieve, part)
        at, key, check = lot.grams(size, salts, known)
        order = np.argsort(key)
        at, key, check = at[order], key[order], check[order]
        if not len(at):
            continue
        new = np.concatenate([[True], key[1:] != key[:-1]])
        leader = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        differs = np.zeros(len(at), bool)
        for j in range(size):
            differs |= number[at + j] != number[at[leader] + j]
        if (differs & (check == check[leader])).any():
            raise ValueError("two phrases share a fingerprint and its check")
        part = [key, check, np.ones(len(at), np.int64), where[lot.text[at]]]
        if differs.any():
            parts.append(_combined(*part))
        else:
            # Equal keys are the same run of words and stand together already.
            starts = np.flatnonzero(new)
            parts.append([key[starts], check[starts], np.diff(starts, append=len(at)), np.minimum.reduceat(part[3], starts)])
    if not parts:
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _salts(langs: list[str]) -> np.ndarray:
    """A number per language name, the same in every task."""
    made: dict[str, int] = {}
    for name in langs:
        if name not in made:
            made[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
    return np.array([made[name] for name in langs], np.uint64)


def _pointer() -> Column:
    """What leads to a document: a digest of its language and text. Copies of a text share it, and any of them will do."""
    return F.xxhash64("lang", "body")


def _fingerprints(rows: DataFrame, sizes: Sequence[int], sieve: np.ndarray | None = None) -> DataFrame:
    """(key, check, n, pointer) of the n-grams of rows (pointer, lang, body), summed as far as a task sees them together."""
    sent = rows.sparkSession.sparkContext.broadcast(sieve)

    def handed_on(sums: list[np.ndarray]) -> pa.RecordBatch:
        key, check, n, where = sums
        columns = [pa.array(key.view(np.int64)), pa.array(check.astype(np.int32)), pa.array(n), pa.array(where)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "check", "n", "pointer"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        fresh = 0
        for batch in batches:
            texts, langs = batch.column(2).to_pylist(), _salts(batch.column(1).to_pylist())
            where, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for lot in lots(texts, LOT):
                here = slice(at, at + len(lot))
                at += len(lot)
                held.append(_lot_counts(Lot(lot), sizes, langs[here], where[here], sent.value))
                fresh += len(held[-1][0])
                if fresh >= MOST:
                    merged = _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    # What combining hardly shrinks is handed on.
                    if len(merged[0]) >= MOST // 2:
                        yield handed_on(merged)
                        held, fresh = [], 0
                    else:
                        held, fresh = [merged], len(merged[0])
        if held:
            yield handed_on(_combined(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return rows.select("pointer", "lang", "body").mapInArrow(run, "key bigint, check int, n bigint, pointer bigint")


def _found(wanted: pa.StructArray, first: np.ndarray, key: np.ndarray, check: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, check, first word) of one occurrence of each wanted fingerprint that a text has."""
    order = np.lexsort((check, key.view(np.int64)))
    own, mark = key.view(np.int64)[order], check.astype(np.int64)[order]
    want, want_mark = wanted.field("key").to_numpy(), wanted.field("check").to_numpy()
    place, live = np.searchsorted(own, want), np.arange(len(want))
    while len(live):
        live = live[place[live] < len(own)]
        live = live[own[place[live]] == want[live]]
        # One key may belong to several runs of words; the check tells them apart.
        right = mark[place[live]] == want_mark[live]
        for j in live[right]:
            yield int(want[j]), int(want_mark[j]), int(first[order[place[j]]])
        live = live[~right]
        place[live] += 1


def _materialised(rows: DataFrame, frequent: DataFrame, longest: int) -> DataFrame:
    """(lang, size, phrase, f) of frequent fingerprints, read from the documents they point to.

    A task passes on a pointed-to text once, so the copies of a hot text are few when they meet.
    """

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for x in batch.column(0).to_pylist():
                fresh.append(x not in seen)
                seen.add(x)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            lists = batch.column(2)
            out: list[tuple] = []
            at = 0
            for texts in lots(batch.column(1).to_pylist(), LOT):
                lot, salts = Lot(texts), _salts(langs[at : at + len(texts)])
                edge = np.searchsorted(lot.text, np.arange(len(texts) + 1))
                for size in range(longest + 1):
                    first, key, check = lot.grams(size, salts)
                    cut = np.searchsorted(first, edge)
                    for i in range(len(texts)):
                        here = slice(cut[i], cut[i + 1])
                        for k, c, word in _found(lists[at + i].values, first[here], key[here], check[here]):
                            out.append((k, c, langs[at + i], size, lot.phrase(word, size)))
                at += len(texts)
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "check", "lang", "size", "phrase"])

    kinds = "pointer bigint, lang string, body string"
    pointed = frequent.groupBy("pointer").agg(F.collect_list(F.struct("key", "check")).alias("wanted"))
    texts = rows.select("pointer", "lang", "body").mapInArrow(once, kinds).join(pointed, "pointer").select("lang", "body", "wanted")
    found = texts.mapInArrow(run, "key bigint, check int, lang string, size int, phrase string")
    # Every frequent fingerprint must have been read from a text, and as one phrase.
    named = found.groupBy("key", "check").agg(F.min(F.struct("lang", "size", "phrase")).alias("low"), F.max(F.struct("lang", "size", "phrase")).alias("high"))
    named = frequent.join(named, ["key", "check"], "left")
    sound = F.when(F.col("low").eqNullSafe(F.col("high")) & F.col("low").isNotNull(), F.col("low.phrase")).otherwise(F.raise_error(F.lit("a fingerprint doesn't lead to one phrase")))
    return named.select("low.lang", "low.size", sound.alias("phrase"), F.col("n").alias("f"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, unknown: str = "und") -> DataFrame:
    """(lang, size, phrase, f) of all runs of up to `longest` words that occur `least` times in a language.

    Runs stay inside pieces, and overlapping occurrences count. Size 0 is the phrase of no words,
    which stands for the number of words of the language. Runs jobs while the plan is built.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(unknown)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("lang", "body", _pointer().alias("pointer"))
    frequent = last = None
    for sizes in ([0, 1], *([n] for n in range(2, longest + 1))):
        sieve = None if last is None else sieve_of(last)
        counted = _fingerprints(rows, sizes, sieve).groupBy("key", "check").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))
        last = cut_lineage(counted.filter(F.col("n") >= least))
        frequent = last if frequent is None else frequent.union(last)
    return cut_lineage(_materialised(rows, frequent, longest))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, top: int = 2000, unknown: str = "und") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `longest` words of every language.

    A phrase occurs a times; the cut with the lowest score floor(10^6 a^2 / (l r)), the shortest
    first part among equals, gives l and r, the counts of its parts; n counts all words of the
    language. A phrase goes when a longer one, itself kept or not, holds it and occurs at least
    half as often. Ranks go by falling score, falling count, and the phrase in the order of its
    UTF-8 bytes. NULL texts are empty and rows without a language are of language `unknown`; every
    row counts, whatever its id. Languages without such phrases, and empty tables, give no rows.
    Other columns are ignored, whatever their names.
    """
    counts = frequent_phrases(docs, text, lang, longest, least, unknown)
    candidates = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))

    # A frequent word begins or ends very many phrases: these are dealt over salts to meet its count.
    def part(first: str, last: str) -> Column:
        return F.expr(f"array_join(slice(split(phrase, ' '), {first}, {last}), ' ')")

    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumn("head", F.struct("lang", part("1", "k").alias("phrase"))).withColumn("tail", F.struct("lang", part("k + 1", "size - k").alias("phrase")))
    parts = counts.filter(F.col("size").between(1, longest - 1)).select(F.struct("lang", "phrase").alias("part"), "f")
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = salted_lookup(cuts, parts.select(F.col("part").alias(side), F.col("f").alias(name)), side, "phrase", 8)
    exact = "cast({0} as decimal(15, 0))"
    a, l, r = (exact.format(c) for c in "alr")
    cuts = cuts.withColumn("score", F.expr(f"cast(({a} * {a} * cast(1000000 as decimal(7, 0))) div ({l} * {r}) as bigint)"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Each phrase tells the shorter ones inside it how often it occurs.
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), i -> array_join(slice(split(phrase, ' '), i + 1, m), ' '))))")
    inside = candidates.filter("size > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = best.join(inside, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 50 * a")
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = open_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(words, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
