"""Token ids of documents in keyed binary segments.

Format (a table in the shared storage, one row per segment; Spark's commit
protocol makes a rewritten task harmless and any file system usable):

* ``shard``, ``segment``  place in the order: ascending, by document key
* ``low``, ``high``       smallest and largest key (null keys aside)
* ``n_docs``, ``n_ids``
* ``width``               bytes per id: 2 while the vocabulary fits, else 4
* ``keys``                int64 per document, ascending; null keys come first
* ``nulls``               how many documents have no key
* ``ends``                int64 per document: where its ids end in ``payload``
* ``index``               minimal perfect hash of the distinct keys
* ``payload``             raw little-endian ids, document after document

The index has levels of bits. A key sits at its hashed position of the first
level where no other key met it; the number of bits set before it is its slot.
A slot stores a 32-bit fingerprint of the key (another key is refused with
probability 1 - 2**-32) and the place of the key's first document. A lookup
reads a few bits per level, about 1.6 levels on average, whatever the size.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throughdoor.llm.stored import Shelf
from throughdoor.llm.words import mix, trimmed

SEGMENT_BYTES = 4 << 20  # a longer document is a segment of its own
SEGMENT_DOCS = 1 << 16
TEXT_BYTES = 8 << 20  # encoded at a time
CACHED_WORDS = 300_000  # per Python worker
END_ID = 0

SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("width", T.IntegerType()), T.StructField("nulls", T.LongType()),
    T.StructField("keys", T.BinaryType()), T.StructField("ends", T.BinaryType()),
    T.StructField("index", T.BinaryType()), T.StructField("payload", T.BinaryType())])


# white space of the pre-tokenizer besides the plain space and the line feed
OTHER_SPACE = "\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def gathered(flat: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``wanted`` of ``flat``, one after the other, and where each ends.

    ``size`` is the length of every run; runs follow each other in ``flat``.
    """
    n = size[wanted]
    ends = np.cumsum(n)
    begin = (np.cumsum(size) - size)[wanted]
    at = np.repeat(begin - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


class Encoder:
    """Ids of whole texts, word by word through a cache.

    The byte-level pre-tokenizer never carries a piece across the start of a
    white-space run, so a text is the concatenation of its words, each encoded
    with the white space before it. Nor does a piece go from letters to
    punctuation, so a word of letters is encoded apart from the marks behind it.
    Arrow splits the texts and finds the distinct words and stems of a call;
    only those are looked up, only stems not in the cache go to the tokenizer,
    and numpy lays their ids out in the order of the texts. Texts for which the
    argument does not hold in full (runs of white space, other separators) are
    encoded as pieces or whole. The ids are always those of encoding the whole
    text.
    """

    HARD = f"[ \n{OTHER_SPACE}][ \n{OTHER_SPACE}]|[{OTHER_SPACE}]"  # anything but single spaces and line feeds
    ODD = re.compile(r"[^\S \t\n\r]")  # white space other than the four plain kinds
    PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
    STEM = f"^\n?[{LETTERS}]+$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        probe = self.tokenizer.encode("a\n b\nc", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 and probe.count(feed[0]) == 2 else None
        self.feed_bytes = self.packed(feed)
        # a word of letters is one piece, so the model alone can encode it, in the byte level's letters
        self.alone = (isinstance(self.tokenizer.model, models.BPE) and self.tokenizer.normalizer is None
                      and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = lambda c: level.pre_tokenize_str(c)[0][0]
        self.space = shown(" ")
        self.level = {c: shown(chr(c)) for c in range(0xC0, 0x100)}
        self.ltrimmed = "\n" + "".join(filter(re.compile(f"[{LETTERS}]").match, map(chr, range(0x100))))
        # "word" is held as encoded behind a space, "\nword" behind a line feed
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words without white space (or empty), each behind ``before``, in one call."""
        if not words:
            return []
        text = "\n".join([before + w for w in words])
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = np.flatnonzero(ids == self.feed).tolist()
        if len(cuts) != len(words) - 1:
            raise AssertionError("a word holds the separator")
        raw, size = ids.tobytes(), ids.itemsize
        begin = [0, *[(c + 1) * size for c in cuts]]
        return [raw[a:b] for a, b in zip(begin, [*[c * size for c in cuts], len(raw)])]

    def _cut(self, ids: np.ndarray, ends: list[int]) -> list[bytes]:
        raw, width = ids.tobytes(), ids.itemsize
        return [raw[a * width: b * width] for a, b in zip([0, *ends], ends)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each behind a space or its line feed."""
        tokenize, level, space = self.tokenizer.model.tokenize, self.level, self.space
        ids, ends = [], []
        for word in words:
            shown = word if word.isascii() else word.translate(level)
            if word[0] == "\n":
                ids.append(self.feed)
                shown = shown[1:]
            else:
                shown = space + shown
            ids += [t.id for t in tokenize(shown)]
            ends.append(len(ids))
        return self._cut(np.asarray(ids, dtype=self.dtype), ends)

    def words(self, keys: list[str], letters: list[bool]) -> list[bytes]:
        """Ids of distinct words; ``letters`` tells which have nothing but letters.

        Words asked for lately are held in two dictionaries. Once the newer one
        has half of ``CACHED_WORDS`` it becomes the older one, which is dropped.
        """
        if len(self.held) > CACHED_WORDS // 2:
            self.held, self.older = {}, self.held
        found = list(map(self.held.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        known = list(map(self.older.get, [keys[i] for i in missing]))
        new = [i for i, x in zip(missing, known) if x is None]
        for i, x in zip(missing, known):
            found[i] = x
        alone = [i for i in new if letters[i]] if self.alone else []
        for i, x in zip(alone, self._letters([keys[i] for i in alone])):
            found[i] = x
        spaced = [i for i in new if found[i] is None and keys[i] and keys[i][0] != "\n"]
        lined = [i for i in new if found[i] is None and keys[i] and keys[i][0] == "\n"]
        for i, x in zip(spaced, self._joined([keys[i] for i in spaced], " ")):
            found[i] = x
        for i, x in zip(lined, self._joined([keys[i][1:] for i in lined], "")):
            found[i] = self.feed_bytes + x
        for i in new:
            if not keys[i]:
                found[i] = self.whole([" "])[0]
        self.held.update([(keys[i], found[i]) for i in missing])
        return found

    def _flat(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        return np.frombuffer(b"".join(ids), self.dtype), size

    def _split(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts whose white space is single spaces and line feeds."""
        # a feed before the first word, cut off below, makes it a word like those behind a feed
        lines = pc.replace_substring(texts, "\n", " \n")
        feed, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        lines = pc.split_pattern(pc.binary_join_element_wise(feed, lines, nothing), " ")
        place, bounds = lines.values.dictionary_encode(), lines.offsets.to_numpy()
        words = place.dictionary
        stems = pc.utf8_rtrim(words, MARKS)
        letters = pc.match_substring_regex(stems, self.STEM)
        own = pc.if_else(letters, stems, words).dictionary_encode()
        tails = pc.if_else(letters, pc.utf8_ltrim(words, self.ltrimmed), nothing).dictionary_encode()
        keys, marks = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (own, tails))
        plain = pc.match_substring_regex(own.dictionary, self.STEM).to_numpy(zero_copy_only=False).tolist()
        ids = self.words(keys, plain) + self.whole(marks)
        # a word is its stem and its marks, if any
        parts = np.stack([own.indices.to_numpy(), tails.indices.to_numpy() + len(keys)], axis=1)
        flat, ends = gathered(*self._flat(ids), parts.ravel())
        size = np.diff(ends[1::2], prepend=0)
        flat, ends = gathered(flat, size, place.indices.to_numpy())
        raw, width = flat.tobytes(), self.dtype.itemsize
        cuts = (np.concatenate([[0], ends])[bounds] * width).tolist()
        return [raw[a + width: b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text, none of them null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.cast(pa.large_string())
        if self.feed is None or not len(texts):
            return self.whole(texts.to_pylist())
        hard = pc.match_substring_regex(texts, self.HARD)
        easy = self._split(texts.filter(pc.invert(hard)))
        if len(easy) == len(texts):
            return easy
        rest = texts.filter(hard).to_pylist()
        cut = {i: self.PIECE.findall(t) for i, t in enumerate(rest) if not self.ODD.search(t)}
        odd = [i for i in range(len(rest)) if i not in cut]
        own = {p for words in cut.values() for p in words}
        new = [p for p in own if p not in self.pieces]
        if len(self.pieces) + len(new) > CACHED_WORDS:
            self.pieces, new = {}, list(own)
        self.pieces.update(zip(new, self.whole(new)))
        done = {i: b"".join(map(self.pieces.__getitem__, words)) for i, words in cut.items()}
        done.update(zip(odd, self.whole([rest[i] for i in odd])))
        slow, fast = iter([done[i] for i in range(len(rest))]), iter(easy)
        return [next(slow if h else fast) for h in hard.to_pylist()]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs in parallel
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- the index ---------------------------------------------------------------

GAMMA = 2.0
LEVELS = 40


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys ^ mix(np.uint64([level + 1]))) % np.uint64(bits)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, first: np.ndarray) -> bytes:
    """Index of distinct ``keys`` (uint64) to ``first``, the place of each."""
    left, sizes, fields = keys, [], []
    for level in range(LEVELS):
        if len(left) == 0:
            break
        bits = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
        at = _place(left, level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        fields.append(np.packbits(alone, bitorder="little"))
        sizes.append(bits)
        left = left[~alone[at]]
    if len(left):
        raise ValueError("keys are not distinct")
    index = Index(np.array(sizes, np.int64), np.concatenate(fields) if fields else np.zeros(0, np.uint8),
                  np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
    slots = index.slots(keys)
    index.prints[slots] = fingerprint(keys)
    index.first[slots] = first
    return index.to_bytes()


@dataclass
class Index:
    sizes: np.ndarray  # bits of each level
    field: np.ndarray  # the levels' bits, packed
    prints: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        words = self.field.view(np.uint64)
        self._words = words
        self._rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 where no level holds it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            if len(open_) == 0:
                break
            at = _place(keys[open_], level, bits) + base
            word, bit = self._words[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self._rank[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + bits
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key's first document, -1 if the key is not here."""
        slots = self.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprint(keys[known])
        out = np.full(len(keys), -1, dtype=np.int64)
        out[known] = self.first[slots[known]]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.prints)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.sizes, self.field, self.prints, self.first))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        levels, n = np.frombuffer(raw, np.int64, 2).tolist()
        sizes = np.frombuffer(raw, np.int64, levels, 16)
        at = 16 + 8 * levels
        bits = int(sizes.sum()) // 8
        return cls(sizes, np.frombuffer(raw, np.uint8, bits, at), np.frombuffer(raw, np.uint32, n, at + bits),
                   np.frombuffer(raw, np.uint32, n, at + bits + 4 * n))


# --- writing and reading -----------------------------------------------------

def _segment(shard: int, number: int, keys: list, ids: list[bytes], width: int) -> pa.RecordBatch:
    known = np.array([k for k in keys if k is not None], dtype=np.int64)
    nulls = len(keys) - len(known)
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    distinct, first = np.unique(known, return_index=True)
    index = build_index(distinct.view(np.uint64), (first + nulls).astype(np.uint32))
    row = {"shard": shard, "segment": number, "low": int(known[0]) if len(known) else None,
           "high": int(known[-1]) if len(known) else None, "n_docs": len(keys), "n_ids": int(ends[-1]),
           "width": width, "nulls": nulls, "keys": known.tobytes(), "ends": ends.tobytes(), "index": index,
           "payload": b"".join(ids)}
    types = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array([row[f.name]], types[f.dataType]) for f in SCHEMA.fields], names=SCHEMA.names)


def segments(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the format for ``docs``, to be written as they come.

    Rows are dealt by ranges of the key, and rows of one key in the order they
    are read, so a key that many rows share still spreads over shards. Every
    text (null: empty) is followed by ``END_ID``.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("seen"))
    ordered = rows.repartitionByRange("key", "seen").sortWithinPartitions("key", "seen").select("key", "text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width, end = encode.dtype.itemsize, encode.packed([END_ID])
        shard, number, size = TaskContext.get().partitionId(), 0, 0
        keys, ids = [], []
        for batch in batches:
            # the more texts at a time, the more words they share
            step = max(1, batch.num_rows * TEXT_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = part.column(1).fill_null("")
                for k, x in zip(part.column(0).to_pylist(), encode.encode(texts)):
                    x += end
                    if ids and (size + len(x) > SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS):
                        yield _segment(shard, number, keys, ids, width)
                        keys, ids, size, number = [], [], 0, number + 1
                    keys.append(k)
                    ids.append(x)
                    size += len(x)
        if ids:
            yield _segment(shard, number, keys, ids, width)

    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as segments to ``path``; null texts are empty."""
    (segments(docs, tokenizer, key, text).write.option("compression", "none")
     .option("parquet.block.size", str(4 * SEGMENT_BYTES)).parquet(path))


def starts(table: DataFrame) -> DataFrame:
    """(shard, segment, before): ids that stand before each segment.

    Totals per shard first, so the one ordered pass over everything sees a row
    per written shard.
    """
    sizes = table.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ordered = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("local"))
    return local.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("local")).alias("before"))


def _documents(row: dict, wanted: np.ndarray | None = None) -> Iterator[tuple]:
    """(key, place in the segment's ids, ids) of a segment, through its index.

    All documents in order, or those of the ``wanted`` keys.
    """
    index = Index.from_bytes(row["index"])
    keys = np.frombuffer(row["keys"], np.int64)
    ends = np.frombuffer(row["ends"], np.int64)
    ids = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    if wanted is None:
        for i in range(row["nulls"]):
            yield None, int(begins[i]), ids[begins[i]: ends[i]]
        wanted = np.unique(keys)
    places = index.find(wanted.view(np.uint64))
    for key, place in zip(wanted[places >= 0].tolist(), places[places >= 0].tolist()):
        at = place - row["nulls"]
        while at < len(keys) and keys[at] == key:  # rows of one key follow each other
            i = at + row["nulls"]
            yield key, int(begins[i]), ids[begins[i]: ends[i]]
            at += 1


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids array<long>) of the documents with the given keys.

    The keys become a filter on ``low`` and ``high``, which prunes files and row
    groups; only segments whose range holds a key are read, and each is
    answered through its index. For a stated, short list of keys.
    """
    wanted = np.unique(np.array(keys, dtype=np.int64))
    if len(wanted) > 1000:
        raise ValueError("lookup answers at most 1000 keys at a time; join on documents() for more")
    near = F.lit(False)
    for k in wanted.tolist():
        near = near | ((F.col("low") <= k) & (F.col("high") >= k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for k, _, ids in _documents(row, wanted):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k]), pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64()))],
                        names=["key", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).where(near).mapInArrow(run, "key long, ids array<long>")


def documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """What the files hold, one row per document: key, start, n_tokens, ids_crc32."""
    names = [key, "local", "n_tokens", "ids_crc32", "shard", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = [(k, place, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], row["segment"])
                         for k, place, ids in _documents(row)]
                types = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    table = spark.read.schema(SCHEMA).parquet(path)
    read = table.mapInArrow(
        run, f"`{key}` long, local long, n_tokens long, ids_crc32 long, shard int, segment int")
    before = starts(table)
    return read.join(before, ["shard", "segment"]).select(
        key, (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) to the shared folder and read them back.

    doc_id, start, n_tokens, ids_crc32 per row of ``docs``, in ascending doc_id
    order of the files. Null doc_ids come first; rows that share a doc_id
    follow each other in the order they are read.
    """
    shelf = Shelf(docs.sparkSession, "token-ids")
    path = f"{shelf.root}/segments"
    write(docs, path, tokenizer)
    return documents(docs.sparkSession, path)
