"""Packing of tokenised documents into sequences by best two fit.

A document is its token ids and an end id; only longer ones are cut into pieces of a sequence's
length. Pieces are dealt at random to groups of bounded size, and each group is packed by one
task. A bin is filled greedily with the longest piece that fits. If a gap remains, the bin's
smallest piece is replaced by the two unpacked pieces that fill its place and the gap best,
provided they fill more than it did. A group leaves at most a few bins part empty, so the number
of groups costs a vanishing share of the sequences.

Token ids stay in the task that made them; only lengths and checksums are shuffled.

Defined results: a missing or empty text is the end id alone; repeated rows are packed once each;
groups are dealt by place in the written pieces, so no key gathers rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from panelforge.session import materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 2048
END = 0
GROUP = 16_384
# Words remembered with their ids, and characters tokenised at a time: they bound a task's memory.
REMEMBERED = 800_000
CHARACTERS = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Stands between texts as a word of its own: a private character that ordinary text does not hold.
MARK, MARKED = "\U0010fffd", 1
# A word of letters and the marks that may end it; an apostrophe could belong to a contraction.
SIMPLE = re.compile(r"([^\W\d_]+)([!#$%&)*,.:;?|]*)")
# All words of a line of words: letters and marks, or anything else.
SIMPLE_OR_NOT = re.compile(r"(?:^| )(?:([^\W\d_]+)([!#$%&)*,.:;?|]*)(?= |$)|([^ ]+))")


class WordIds:
    """Token ids of whole texts from a tokenizer that drops white space.

    Such a tokenizer never joins characters across a space, so texts are split at spaces and line
    feeds and every word is tokenised once while it is remembered. Most new words are letters with
    closing marks: the tokenizer separates the two, so both parts are looked up on their own, and
    letters that are lower-cased and composed already go to the tokenizer's model without its
    normalisation. Everything else takes the tokenizer as it is. Tests compare with the ids of
    whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self):
        """Starts anew with the empty word and the mark between texts, which have no ids."""
        self.place: dict[str, int] = {"": 0, MARK: MARKED}
        self.ids, self.begin, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, "i8"), np.zeros(1 << 14, "i8")
        self.words, self.used = 2, 0

    def _add(self, words: list[str], flat: np.ndarray, size: np.ndarray):
        words_now, used_now = self.words + len(words), self.used + len(flat)
        # Tables double when they are full, so growing them takes time in proportion to the words.
        while words_now > len(self.size):
            self.begin, self.size = np.concatenate((self.begin, self.begin)), np.concatenate((self.size, self.size))
        while used_now > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids))
        self.place.update(zip(words, range(self.words, words_now)))
        self.begin[self.words : words_now] = self.used + np.cumsum(size) - size
        self.size[self.words : words_now] = size
        self.ids[self.used : used_now] = flat
        self.words, self.used = words_now, used_now

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and how many each has."""
        size = self.size[at]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.begin[at] - before, size) + np.arange(int(size.sum()))], size

    def _learn_letters(self, words: list[str]):
        if words:
            found = self.plain.encode(" ".join(words), add_special_tokens=False)
            self._add(words, np.array(found.ids, "<u4"), np.bincount(found.word_ids, minlength=len(words)).astype("i8"))

    def _learn_others(self, words: list[str]):
        if words:
            found = [e.ids for e in self.whole.encode_batch(words, add_special_tokens=False)]
            size = np.fromiter(map(len, found), "i8", len(found))
            self._add(words, np.fromiter(itertools.chain.from_iterable(found), "<u4", int(size.sum())), size)

    def _learn(self, words: list[str]):
        """Adds new words, letters first, as the others are put together from them."""
        low = " ".join(words).lower()
        # Lower case is taken letter by letter, which differs for a final sigma only; the dotted capital
        # I is the one letter whose lower case is not a letter. Such lots are looked at word by word.
        if "\u03c3" not in low and "\u03c2" not in low and "i\u0307" not in low and unicodedata.is_normalized("NFC", low):
            parts = SIMPLE_OR_NOT.findall(low)
        else:
            parts = [self._parts_of(word) for word in words]
        cores, marks, rest = zip(*parts)
        self._learn_letters([c for c in dict.fromkeys(cores) if c and c not in self.place])
        others = [w for w, r in zip(words, rest) if r]
        self._learn_others(list(dict.fromkeys(others + [m for m in dict.fromkeys(marks) if m and m not in self.place])))
        joined = [i for i, (w, c) in enumerate(zip(words, cores)) if c and c != w]
        if joined:
            take = itemgetter(*joined) if len(joined) > 1 else lambda x: (x[joined[0]],)
            pairs = np.array([list(map(self.place.__getitem__, take(x))) for x in (cores, marks)])
            flat, size = self._gather(pairs.T.ravel())
            self._add(take(words), flat, size.reshape(-1, 2).sum(1))

    @staticmethod
    def _parts_of(word: str) -> tuple[str, str, str]:
        """(letters, closing marks, "") of a simple word, ("", "", word) of any other."""
        if m := SIMPLE.fullmatch(word):
            core = m[1].lower()
            if core.isalpha() and unicodedata.is_normalized("NFC", core) and "\u03a3" not in word:
                return core, m[2], ""
        return "", "", word

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each; the texts are of bounded size.

        Texts are joined around a mark, so that one split and one look-up serve them all.
        """
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, "i8")
        whole = f" {MARK} ".join(texts)
        if whole.count(MARK) >= len(texts) or any(t in whole for t in self.special):
            return self._apart(texts)
        words = whole.replace("\n", " ").split(" ")
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), "i8", len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
            if len(self.place) + 2 * len(new) > REMEMBERED and len(self.place) > 2:
                self.forget()
                new, missing = list(dict.fromkeys(w for w in words if w and w != MARK)), np.arange(len(words))
            self._learn(new)
            at[missing] = np.fromiter(map(self.place.__getitem__, map(words.__getitem__, missing.tolist())), "i8", len(missing))
        ids, size = self._gather(at)
        ends = np.cumsum(size)[np.append(np.flatnonzero(at == MARKED), len(words) - 1)]
        return ids, np.diff(ends, prepend=0)

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`joined` when a text holds the mark or a special token: such texts go whole."""
        out = []
        for whole, some in itertools.groupby(texts, lambda t: MARK in t or any(x in t for x in self.special)):
            if whole:
                found = [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") for t in some]
                out.append((np.concatenate(found), np.array([len(x) for x in found])))
            else:
                out.append(self.joined(list(some)))
        return np.concatenate([i for i, _ in out]), np.concatenate([n for _, n in out])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, size = self.joined(texts)
        return np.split(ids, np.cumsum(size)[:-1]) if texts else []


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts that end at a space."""
    begin = 0
    while len(text) - begin > CHARACTERS:
        end = text.rfind(" ", begin, begin + CHARACTERS)
        end = begin + CHARACTERS if end < 0 else end
        if end == begin + CHARACTERS:
            end = text.find(" ", end)
            if end < 0:
                break
        yield text[begin:end]
        begin = end + 1
    yield text[begin:]


def _cut(texts: pa.Array, encode: WordIds, length: int) -> Iterator[tuple[list[int], list[tuple]]]:
    """(rows, (piece, start, length, checksum) of each) for the texts of a batch, some at a time."""
    at, n = 0, len(texts)
    while at < n:
        some, size = [], 0
        while at + len(some) < n and (not some or size < CHARACTERS):
            parts = list(_parts(texts[at + len(some)].as_py() or ""))
            some.append(parts)
            size += sum(map(len, parts))
        flat = [t for parts in some for t in parts]
        if size < 2 * CHARACTERS:
            ids, sizes = encode.joined(flat)
        else:
            found = [encode.joined([t]) for t in flat]
            ids, sizes = np.concatenate([i for i, _ in found]), np.concatenate([n for _, n in found])
        ends = np.cumsum(sizes)[np.cumsum([len(parts) for parts in some]) - 1]
        # An end id closes every document.
        stream = np.insert(ids, ends, END).astype("<u4")
        ends = (ends + np.arange(1, len(some) + 1)).tolist()
        view, taken, rows, begin = memoryview(stream).cast("B"), [], [], 0
        for i, end in enumerate(ends, at):
            for piece, start in enumerate(range(begin, end, length)):
                stop = min(start + length, end)
                taken.append(i)
                rows.append((piece, start - begin, stop - start, zlib.crc32(view[4 * start : 4 * stop])))
            begin = end
        yield taken, rows
        at += len(some)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(path)
        for batch in batches:
            for taken, rows in _cut(batch.column("text"), encode, length):
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(taken)), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _two(mask: int, counts: list[int], room: int, least: int) -> tuple[int, int] | None:
    """Two available lengths with the largest sum that is above ``least`` and at most ``room``."""
    near = mask & ((2 << room) - 1)
    mirrored = int(format(near, f"0{room + 1}b")[::-1], 2)
    for total in range(room, least, -1):
        both = near & (mirrored >> (room - total))
        if total % 2 == 0 and counts[total // 2] == 1:
            both &= ~(1 << (total // 2))
        if both:
            a = both.bit_length() - 1
            return a, total - a
    return None


def best_two_fit(lengths: np.ndarray, capacity: int) -> Iterator[list[int]]:
    """Bins as lists of lengths. The available lengths are the bits of one number."""
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    mask = sum(1 << n for n, c in enumerate(counts) if c)

    def take(n):
        nonlocal mask
        counts[n] -= 1
        if not counts[n]:
            mask ^= 1 << n

    while mask:
        gap, filled = capacity, []
        while gap and (fits := mask & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            take(n)
            filled.append(n)
            gap -= n
        if gap and mask:
            smallest = filled[-1]
            if pair := _two(mask, counts, gap + smallest, smallest):
                filled.pop()
                if not counts[smallest]:
                    mask |= 1 << smallest
                counts[smallest] += 1
                for n in pair:
                    take(n)
                filled += pair
        yield filled


def pack(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset. ``rows`` are pieces written to a table."""
    groups = rows.count() // group + 1
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        size = table.column("length").to_numpy()
        order = np.argsort(size, kind="stable")
        end = np.cumsum(np.bincount(size, minlength=length + 1)).tolist()
        sequence, offset = np.empty(len(size), "i8"), np.empty(len(size), "i8")
        first = table.column("_group")[0].as_py() << 32
        for b, filled in enumerate(best_two_fit(size, length)):
            at = 0
            for n in filled:
                end[n] -= 1
                row = order[end[n]]
                sequence[row], offset[row] = first + b, at
                at += n
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("_group").applyInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    return pack(materialize(pieces(docs, path or tokenizer_path(), length)), length)
