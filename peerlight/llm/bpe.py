"""Byte-level BPE of whole texts by a rank file, and back.

A pattern splits a text into words, white space included, and each word is encoded alone, so what is needed is the ids of distinct words.  ``encode_words`` does that with Spark's
higher-order functions: a word is an array of its bytes, and a fold merges, as often as there are bytes, the leftmost adjacent pair with the lowest rank.  Ranks of pairs of tokens come
from a literal map, an array of numbers that is looked up by numbers.  Bytes are handled as characters of ISO-8859-1, one for each.

``encode`` folds every word of the texts this way: the words that are most frequent in a sample once, for all tasks; any other word in the task that has its text, when the task meets it for
the first time.  Python splits the texts before the fold, into ids and numbers of words that are to be folded, and puts their ids in place after it; texts are never shuffled.  What is in the table changes no result.
``decode`` concatenates the bytes of the ids, by a literal array of tokens.

Cases: null texts are encoded as empty ones, without ids.  Repeated rows and null ids are encoded each.  Long texts are read whole; a long word takes time in proportion to
its length times its merges.  An empty table gives an empty result.  Special tokens in a text are ordinary text.  Other columns are kept by name.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from functools import cache
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from .common import materialize, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Documents from which the frequent words are picked, about, and how many words are kept, of at most so many bytes.
SAMPLE_DOCS, WORDS, WORD_BYTES = 20_000, 262_144, 48
#: Stretches of text that a Python worker remembers, and words outside the table that it remembers in a task; two workers and the JVM share an executor's memory with others.
STRETCHES, REMEMBERED = 1 << 17, 1 << 18
#: Bits of a rank and of a place in a word; the rank of a pair that is no token, above all others.
RANK, PLACE = 18, 27
_NONE = (1 << RANK) - 1


@cache
def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """Rank of each token; the path of a public vocabulary's file comes from its name."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merges(of: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Ranks of the two parts that a token of two bytes or more is merged from at last, with its own rank.

    Every token must be what the merges of its bytes end with, each of a lower rank than its own; else the vocabulary is refused.  What happens between two boundaries that no merge has
    crossed doesn't depend on what is outside.  So whenever two adjacent pieces of a word make up a token, they are its two parts here, and a word that is a token ends as that token.
    """
    out = {}
    for token, rank in of.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min([(of.get(a + b, _NONE), i) for i, (a, b) in enumerate(pairwise(parts))])
            if low >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 2 or not all(p in of for p in parts):
            raise ValueError(f"tokens that merges of lower ranks don't make up don't fit the fold: {token!r}")
        if len(parts) == 2:
            out[of[parts[0]], of[parts[1]]] = rank
    return out


def pair_slots(pairs: dict[tuple[int, int], int], tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """``slots`` and ``shifts`` that have the rank of a pair: the slot at (shifts[a] + b) mod the number of slots holds a << RANK | rank.

    Slots of other pairs hold another token in place of a, or none.  Tokens of many pairs are placed first, by shifts drawn until their slots are free.
    """
    seconds: dict[int, list[int]] = {}
    for a, b in pairs:
        seconds.setdefault(a, []).append(b)
    size = 1 << max(tokens, 2 * len(pairs)).bit_length()
    slots, shifts, r = np.full(size, -1, "i8"), np.zeros(tokens, "i8"), np.random.default_rng(1)
    for a, bs in sorted(seconds.items(), key=lambda x: -len(x[1])):
        at = np.array(bs)
        while True:
            shifts[a] = r.integers(size)
            where = (at + shifts[a]) & (size - 1)
            if (slots[where] < 0).all():
                break
        slots[where] = [a << RANK | pairs[a, b] for b in bs]
    slots[slots < 0] = _NONE << RANK | _NONE
    return slots, shifts


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a fold of no elements ends with it, without a copy."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def folded(word: Column, known: tuple[Column, int, int]) -> Column:
    """Ids of a word of one byte at least, given as ISO-8859-1 characters of its bytes; ``known`` are the ``constants`` of a vocabulary.

    The state is a number for each piece: the rank of the pair of it and the next piece, its place and its id, highest bits first, so that the smallest number is the first pair of the
    lowest rank.  That rank is the id of what the pair becomes.  A step puts it in place of the first piece, drops the second and looks up the ranks of the pairs on its two sides.
    """
    table, slots, tokens = known
    top = RANK + PLACE
    id_of = lambda x: x.bitwiseAND(_NONE)
    place_of = lambda x: x.bitwiseAND(((1 << PLACE) - 1) << RANK)

    def merged(t: Column) -> Column:
        def number(a: Column, b: Column, place: Column) -> Column:
            """Of the piece ``a`` before ``b``, which may be null; what isn't a's slot differs from it above the bits of a rank."""
            slot = t[(t[a + slots] + b).bitwiseAND(slots - 1)]
            return F.shiftleft(F.least(slot.bitwiseXOR(F.shiftleft(a, RANK)), F.lit(_NONE).cast("long")), top) + (place + a)

        def step(s: Column, _: Column) -> Column:
            def join(x: Column) -> Column:
                new = F.shiftright(x, top)

                def piece(y: Column, i: Column) -> Column:
                    after = F.when(y == x, number(new, id_of(F.get(s, i + 2)), place_of(x)))
                    return after.when(F.get(s, i + 1) == x, number(id_of(y), new, place_of(y))).when(F.get(s, i - 1) == x, F.lit(None)).otherwise(y)

                return F.when(x >= _NONE << top, s).otherwise(F.array_compact(F.transform(s, piece)))

            return _let(F.array_min(s), join)

        bytes_ = F.transform(F.split(word, ""), lambda x: t[F.ascii(x) + (slots + tokens)])
        start = _let(bytes_, lambda c: F.transform(c, lambda a, i: number(a, F.get(c, i + 1), F.shiftleft(i.cast("long"), RANK))))
        return F.aggregate(F.sequence(F.lit(2), F.length(word)), start, step, lambda s: F.transform(s, lambda x: id_of(x).cast("int")))

    return _let(table, merged)


def as_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a text as ISO-8859-1 characters."""
    return F.decode(word.cast("binary"), "ISO-8859-1")


@cache
def fold_table(vocabulary: str) -> tuple[str, int, int]:
    """Slots and shifts of a vocabulary's pairs and the ids of the 256 bytes, one after the other as JSON, and how many slots and shifts there are."""
    of = ranks(vocabulary)
    if max(of.values()) >= _NONE or not all(bytes([i]) in of for i in range(256)):
        raise ValueError(f"{vocabulary}: ranks from {_NONE} and bytes without a rank don't fit the fold")
    slots, shifts = pair_slots(merges(of), max(of.values()) + 1)
    return json.dumps([*slots.tolist(), *shifts.tolist(), *(of[bytes([i])] for i in range(256))]), len(slots), len(shifts)


def constants(vocabulary: str) -> tuple[Column, int, int]:
    """What ``folded`` needs to know of a vocabulary, whose ranks must fit the numbers of its pieces."""
    table, slots, tokens = fold_table(vocabulary)
    return F.from_json(F.lit(table), "array<bigint>"), slots, tokens


def encode_words(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, ids) of each row of ``words`` (word)."""
    return words.select("word", folded(as_bytes(F.col("word")), constants(vocabulary)).alias("ids"))


def split(text: Column) -> Column:
    """The words of a text as Spark's regular expressions see them."""
    import public_tokenizers

    return F.regexp_extract_all(text, F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))


def frequent_words(documents: DataFrame, docs: int = SAMPLE_DOCS, words: int = WORDS, longest: int = WORD_BYTES) -> DataFrame:
    """(word): the ``words`` most frequent words of about ``docs`` documents, picked by a hash."""
    share = min(1.0, docs / max(documents.count(), 1))
    picked = documents.filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) < int(share * (1 << 62)))
    counted = picked.select(F.explode(split(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.octet_length("word") <= longest).orderBy(F.desc("n"), "word").limit(words).select("word")


def stretches(text: str) -> tuple[str, list[str]]:
    """What stands before the first single space, and the stretches after each.

    No word goes on across a space that follows something else than white space, so a stretch can be split, with its space, without its surroundings.
    """
    first, *rest = SPACE_AFTER_SPACE.search(text) and LONE_SPACE.split(text) or text.split(" ")
    return first, rest


#: ASCII marks that the pattern never begins a word of letters with, in contrast to the apostrophe.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> list[str]:
    """Words of a stretch; of letters after one space, with or without marks at the end, and of two such lines, they are known without the pattern."""
    if text[:1] == " ":
        if text[1:].isalpha():
            return [text]
        line, newline, after = text.partition("\n")
        first, second = line.rstrip(MARKS), after.rstrip(MARKS)
        if first[1:].isalpha() and (second.isalpha() or not newline):
            return [w for w in (first, line[len(first) :], newline, second, after[len(second) :]) if w]
    return _pattern().findall(text)


class Known(dict):
    """Ids of the stretches of a text between single spaces, as 32-bit numbers, as they are met.

    A word outside the table has a number below zero in place of its ids: -1 for the first one of a task, -2 for the next one.  ``new`` are those since they were last taken.  With
    ``room`` of them their numbers are forgotten; one that comes again gets another.
    """

    def __init__(self, table: dict[str, bytes]):
        super().__init__()
        self.table, self.left = table, STRETCHES
        self.start(REMEMBERED)

    def start(self, room: int) -> None:
        self.room, self.own, self.new, self.numbers = room, {}, [], count(-1, -1)

    def word(self, word: str) -> bytes:
        found = self.table.get(word)
        if found is None:
            self.whole = False
            found = self.own.get(word)
            if found is None:
                if len(self.own) >= self.room:
                    self.own = {}
                found = self.own[word] = next(self.numbers).to_bytes(4, sys.byteorder, signed=True)
                self.new.append(word)
        return found

    def __missing__(self, stretch: str) -> bytes:
        text, self.whole = " " + stretch, True
        ids = self.table.get(text)  # a word of a text is one word when it stands alone, too
        if ids is None:
            ids = b"".join(map(self.word, words_of(text)))
        if self.whole and self.left and len(stretch) <= WORD_BYTES:
            self.left -= 1
            self[stretch] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        first, rest = stretches(text)
        return np.frombuffer(b"".join(map(self.word, words_of(first))) + b"".join(map(self.__getitem__, rest)), "i4")

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Folded:
    """Ids of the new words of a task, one after the other; ``ends`` is where each word's begin and the last one's end."""

    def __init__(self):
        self.flat, self.ends = array("i"), array("q", [0])

    def learn(self, words: pa.ListArray) -> None:
        self.ends.frombytes((self.ends[-1] + np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False), dtype="i8")).tobytes())
        self.flat.frombytes(words.flatten().to_numpy(zero_copy_only=False).astype("i4").tobytes())

    def put(self, rows: pa.ListArray) -> pa.ListArray:
        """The rows with the ids of each new word in its place."""
        ids, stops = rows.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, rows.value_lengths().to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(ids < 0)
        ends, which = np.frombuffer(self.ends, "i8"), -1 - ids[at].astype("i8")
        start, size = ends[which], ends[which + 1] - ends[which]
        sizes = np.ones(len(ids), "i8")
        sizes[at] = size
        places = np.cumsum(np.append(0, sizes))
        out = np.repeat(ids, sizes)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(places[at], size) + within] = np.frombuffer(self.flat, "i4")[np.repeat(start, size) + within]
        return pa.ListArray.from_arrays(pa.array(places[stops].astype("i4")), pa.array(out))


def numbers_in(rows: pa.BinaryArray) -> pa.ListArray:
    """Bytes as lists of the 32-bit numbers that they hold."""
    stops = np.cumsum(np.append(0, pc.binary_length(rows).to_numpy(zero_copy_only=False) // 4))
    return pa.ListArray.from_arrays(pa.array(stops.astype("i4")), pa.array(np.frombuffer(b"".join(rows.to_pylist()), "i4")))


#: Both classes have all white space, so that a space that is in doubt is never taken for a boundary.
SPACE_AFTER_SPACE, LONE_SPACE = re.compile(r"\s "), re.compile(r"(?<=\S) ")


@cache
def _pattern():
    """The pattern with white space as Unicode has it; the module's own class also has the separators from U+001C on."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace("[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))


_KNOWN: list[tuple[pa.Table, Known]] = []


def ids_by_word(table: pa.Table) -> dict[str, bytes]:
    """``Known``'s table of (word, ids)."""
    ids = table.column("ids").combine_chunks()
    flat, ends = ids.flatten().to_numpy().astype("i4").tobytes(), np.cumsum(np.append(0, 4 * ids.value_lengths().to_numpy().astype("i8"))).tolist()
    return {w: flat[a:b] for w, (a, b) in zip(table.column("word").to_pylist(), pairwise(ends))}


def _known(shared) -> Known:
    """The last table of a Python worker is kept for its next tasks."""
    if not _KNOWN or _KNOWN[0][0] is not shared.value:
        _KNOWN[:] = [(shared.value, Known(ids_by_word(shared.value)))]
    return _KNOWN[0][1]


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, room: int = REMEMBERED, **sample) -> DataFrame:
    """``documents`` (doc_id, text, ..) with ``ids``, an array of integers, in place of ``text``.

    Both Python steps see a task's rows in one order, so the second has met every word that the first left out.  Only the first has the table and the texts.  Between them ids are bytes,
    which Spark hands on without a look at each.
    """
    table = materialize(encode_words(materialize(frequent_words(documents, **sample), "bpe-words").repartition(12), vocabulary), "bpe-ids")
    shared = documents.sparkSession.sparkContext.broadcast(table.toArrow())  # WORDS rows of bounded length at most; never as Python objects on the driver
    others = [c for c in documents.columns if c not in ("text", "ids")]
    rows = small_batches(documents).select(*others, F.coalesce("text", F.lit("")).alias("text"))

    def split_texts(batches):
        known = _known(shared)
        known.start(room)
        for b in batches:
            ids, words = [], []
            for t in b.column("text"):
                ids.append(known.ids(t.as_py()).tobytes())
                words.append(known.taken())
            yield b.select(others).append_column("ids", pa.array(ids, pa.binary())).append_column("_words", pa.array(words, pa.list_(pa.string())))
        known.start(room)  # an idle worker holds none

    def put_together(batches):
        folded = Folded()
        for b in batches:
            folded.learn(b.column("_folded").flatten())
            yield b.select(others).append_column("ids", folded.put(numbers_in(b.column("ids"))))

    schema = StructType([*(rows.schema[c] for c in others), StructField("ids", ArrayType(IntegerType()))])
    new = rows.mapInArrow(split_texts, StructType([*schema.fields[:-1], StructField("ids", BinaryType()), StructField("_words", ArrayType(StringType()))]))
    known_ranks = constants(vocabulary)
    return new.select(*others, "ids", F.transform("_words", lambda w: folded(as_bytes(w), known_ranks)).alias("_folded")).mapInArrow(put_together, schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``bytes``, what its ``ids`` stand for; an id that the vocabulary lacks is an error."""
    of = {rank: token.decode("latin-1") for token, rank in ranks(vocabulary).items()}
    tokens = F.from_json(F.lit(json.dumps([of.get(i) for i in range(max(of) + 1)], ensure_ascii=False)), "array<string>")
    pieces = F.transform("ids", lambda i: F.coalesce(F.get(tokens, i), F.raise_error(F.lit("an id that the vocabulary lacks"))))
    return encoded.withColumn("bytes", F.encode(F.array_join(pieces, ""), "ISO-8859-1"))


def digest(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode``'s rows."""
    back = decode(encoded.select("doc_id", "ids"), vocabulary)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
