"""Token ids in binary shards whose document boundaries are Elias-Fano encoded.

A shard holds the documents of one range of keys: a header, the keys, the boundaries, the concatenated ids. The
i-th boundary is the number of ids up to the end of document i. With n boundaries over u ids, each keeps
log2(u/n) low bits in a packed array and its high part in unary in a bit vector: about 2 + log2(u/n) bits a
document, no 64-bit table. Keys, which ascend too, are held the same way above the least of them. select() finds one value,
and select_range() a run of them, from counts of ones sampled every 64 words: neither decodes the rest.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache
from itertools import chain, groupby, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm._shared import byte_slices, drop_written, get_file, new_folder, put_file, tasks, written

MAGIC = b"EFTOKEN1"
_HEAD = struct.Struct("<8sQQQqBBBxxxxxQQQQ")  # magic, documents, ids, null keys, least key, bytes an id, low bits of boundaries, of keys, bytes of low, of high, of keys' low, of high
_EVERY = 64  # words of high bits between two sampled counts


class EliasFano:
    """Non-decreasing integers below or at u."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        words = np.frombuffer(np.pad(high, (0, -len(high) % 8)).tobytes(), "<u8")
        self.words, self.ones = words, np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))][::_EVERY]

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        runs = [np.packbits(((values[a : a + 8192, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, 8192)]
        high = np.zeros((u >> bits) + n, np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, bits, np.concatenate(runs) if runs else np.zeros(0, np.uint8), np.packbits(high, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value, from the sampled counts and one stretch of words."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ones, i, side="right")) - 1
        left, w = i - int(self.ones[block]), block * _EVERY
        counts = np.cumsum(np.bitwise_count(self.words[w : w + _EVERY]).astype(np.int64))
        k = int(np.searchsorted(counts, left, side="right"))
        left -= int(counts[k - 1]) if k else 0
        bits = np.unpackbits(self.words[w + k : w + k + 1].view(np.uint8), bitorder="little")
        at = (w + k) * 64 + int(np.flatnonzero(bits)[left])
        return (at - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        a, value = i * self.low_bits, 0
        for j in range(self.low_bits):
            value |= (int(self.low[(a + j) >> 3]) >> ((a + j) & 7) & 1) << j
        return value

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1 as unsigned numbers, from the stretch of words between two sampled counts."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.uint64)
        first, last = np.searchsorted(self.ones, [a, b - 1], side="right") - 1
        stretch = self.words[first * _EVERY : (last + 1) * _EVERY]
        at = np.flatnonzero(np.unpackbits(stretch.view(np.uint8), bitorder="little")) + first * _EVERY * 64
        skip = a - int(self.ones[first])
        high = (at[skip : skip + b - a] - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        lo = a * self.low_bits
        raw = np.unpackbits(self.low[lo >> 3 : -(-b * self.low_bits // 8)], bitorder="little")[lo & 7 :][: (b - a) * self.low_bits]
        return high | (raw.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def pack(keys: np.ndarray, nulls: int, counts: np.ndarray, ids: np.ndarray, width: int) -> list[bytes]:
    """A shard of documents whose keys ascend after `nulls` null ones."""
    ends, known = EliasFano.build(np.cumsum(counts)), keys[nulls:].astype(np.int64)
    least = int(known[0]) if len(known) else 0
    above = EliasFano.build(known.view(np.uint64) - np.int64(least).astype(np.uint64))  # modulo 2**64
    head = _HEAD.pack(MAGIC, len(counts), len(ids), nulls, least, width, ends.low_bits, above.low_bits, len(ends.low), len(ends.high), len(above.low), len(above.high))
    return [head, above.low.tobytes(), above.high.tobytes(), ends.low.tobytes(), ends.high.tobytes(), ids.astype(f"<u{width}").tobytes()]


class Shard:
    def __init__(self, data: bytes):
        magic, self.docs, self.size, self.nulls, self.least, width, bits, key_bits, low, high, key_low, key_high = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, parts = _HEAD.size, []
        for n in (key_low, key_high, low, high):
            parts.append(np.frombuffer(data, np.uint8, n, at))
            at += n
        self.above, self.ends = EliasFano(self.docs - self.nulls, key_bits, *parts[:2]), EliasFano(self.docs, bits, *parts[2:])
        self.ids = np.frombuffer(data, f"<u{width}", self.size, at)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def boundaries(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b - 1 begin, and where the last of them ends."""
        ends = self.ends.select_range(max(0, a - 1), b).astype(np.int64)
        return ends if a else np.r_[0, ends]

    def keys(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of documents a to b - 1, and which are null."""
        known = self.above.select_range(max(0, a - self.nulls), max(0, b - self.nulls)) + np.int64(self.least).astype(np.uint64)
        null = np.arange(a, b) < self.nulls
        return np.r_[np.zeros(int(null.sum()), np.int64), known.view(np.int64)], null

    def find(self, key: int) -> range:
        """Places of the documents of a key, by selects alone."""
        place = lambda k: self.nulls + bisect_left(range(self.above.n), k, key=lambda i: self.above.select(i) + self.least)
        return range(place(key), place(key + 1))


class WordEncoder:
    """The library's ids of whole texts, with each distinct word encoded once.

    Valid for a tokenizer that composes (NFC), lower-cases and drops white space: a text's ids are those of its
    pieces between white space, one after another. Latin-1 texts, and the Latin-1 words of others, which NFC leaves as they are,
    are lower-cased and cut further, as the tokenizer's own pattern cuts them, so that capitals and punctuation don't multiply
    the pieces. They are cut all at once, by the bytes at which the class of a character changes, and their new pieces go to the
    library's model many in a string: an id that ends a word ends a piece.
    """

    #: Pieces kept in a worker; at the bound the later half goes, since the commonest pieces come early.
    CACHE = 800_000
    #: Pieces encoded at once, which bounds the library's own objects for them, and pieces in one string.
    AT_ONCE, IN_ONE = 4096, 256
    #: The file's pattern of words, with the Latin-1 members of its classes.
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    LETTERS, NUMBERS, SPACES = "a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
    BEYOND = re.compile("[^\x00-\xff]")
    SPACE, LETTER, NUMBER, OTHER = range(4)
    WHITE = re.compile("[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps, model = [s["type"] for s in spec["normalizer"]["normalizers"]], spec["model"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or split["pattern"]["Regex"] != self.PATTERN or any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("not a tokenizer that drops white space")
        suffix = model["end_of_word_suffix"]
        if level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or not suffix or not all({c, c + suffix} <= model["vocab"].keys() for c in pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("not a tokenizer of bytes whose last id of a word shows")
        self.whole = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer(self.whole.model)  # of pieces: they are composed, lower-cased and cut already
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.width = 2 if len(vocab) <= 1 << 16 else 4
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        latin = [chr(i) for i in range(256)]
        self.lower = "".join(latin).lower().encode("latin-1")
        self.kind = np.array([next((k for k, of in ((self.SPACE, self.SPACES), (self.LETTER, self.LETTERS), (self.NUMBER, self.NUMBERS)) if re.match(f"[{of}]", c)), self.OTHER) for c in latin], np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[bytes | str | None, int] = {}  # of pieces in Latin-1, of words of other texts, of the end id
        self.flat, self.start, self.count = np.zeros(0, f"u{self.width}"), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _halve(self) -> None:
        n = len(self.codes) // 2
        self.codes = dict(islice(self.codes.items(), n))  # codes count up in the order of entry
        self.flat, self.start, self.count = self.flat[: self.start[n]].copy(), self.start[:n].copy(), self.count[:n].copy()

    def _other(self, text: str) -> bool:
        """Whether the whole tokenizer has to see the text: not Latin-1, or with what may be an added token, found before lower-casing."""
        return self.BEYOND.search(text) is not None or "<|" in text

    def _segments(self, text: str) -> list[bytes | list[str]]:
        """The text in Latin-1, or else its words in order: runs in Latin-1 as one text, runs of others as they are."""
        if not self._other(text):
            return [text.encode("latin-1")]
        runs = groupby([w for w in self.WHITE.split(text) if w], self._other)
        return [list(run) if other else " ".join(run).encode("latin-1") for other, run in runs]

    def _cut(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pieces of Latin-1 texts, each piece's place among them, and the number of pieces up to each text's end."""
        data = np.frombuffer(b" ".join([*texts, b"  "]).translate(self.lower), np.uint8)
        kind = self.kind[data]
        first = kind == self.NUMBER
        first[0] = True
        first[1:] |= kind[1:] != kind[:-1]
        quote = np.flatnonzero(first & (data == ord("'")))
        one, two = data[quote + 1], data[quote + 2]
        pair = np.any([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)
        short = pair | np.isin(one, np.frombuffer(b"stmd", np.uint8))
        first[quote[short] + 1] = False
        first[(quote + 2 + pair)[short]] = True
        kept = kind != self.SPACE
        first &= kept
        offsets = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]).dictionary_encode()
        ends = np.searchsorted(np.flatnonzero(first), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
        return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), ends

    def _piece_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [b" ".join(pieces[a : a + self.IN_ONE]).decode("latin-1") for a in range(0, len(pieces), self.IN_ONE)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), f"u{self.width}")
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), f"u{self.width}"), np.fromiter(map(len, ids), np.int32, len(ids))

    def _coded(self, pieces: list, ids_of) -> np.ndarray:
        """Codes of pieces; ids_of gives the ids of those never met, and how many each has."""
        codes = self.codes
        fresh, base = list(dict.fromkeys([w for w in pieces if w not in codes])), len(codes)
        if fresh:
            flats, counts = [self.flat], [self.count]
            for a in range(0, len(fresh), self.AT_ONCE):
                flat, count = ids_of(part := fresh[a : a + self.AT_ONCE])
                if len(count) != len(part):
                    raise ValueError("the ids don't show where pieces end")
                flats.append(flat), counts.append(count.astype(np.int32))
            codes.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            self.flat, self.count = np.concatenate(flats), np.concatenate(counts)
            ends = np.cumsum(self.count[base:], dtype=np.int64) + (self.start[-1] + self.count[base - 1])
            self.start = np.concatenate([self.start, ends - self.count[base:]])
        return np.fromiter(map(codes.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each with the end id, and their counts."""
        if len(self.codes) > self.CACHE:
            self._halve()
        if None not in self.codes:
            self.codes[None] = 0
            self.flat, self.start, self.count = np.array([end], f"u{self.width}"), np.zeros(1, np.int64), np.ones(1, np.int32)
        segments = [self._segments(t) for t in texts]
        runs = [x for of in segments for x in of if isinstance(x, list)]
        pieces, at, ends = self._cut([x for of in segments for x in of if isinstance(x, bytes)])
        cut = iter(np.split(self._coded(pieces, self._piece_ids)[at], ends))
        rest = iter(np.split(self._coded(list(chain.from_iterable(runs)), self._word_ids), np.cumsum([len(x) for x in runs], dtype=np.int64)))
        parts, stop = [], np.zeros(1, np.int64)  # the end id's code
        for of in segments:
            parts += [next(cut if isinstance(x, bytes) else rest) for x in of]
            parts.append(stop)
        at = np.concatenate(parts) if parts else stop[:0]
        lens = self.count[at]
        ends = np.cumsum(lens, dtype=np.int64)
        out = self.flat[np.repeat(self.start[at] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.diff(np.r_[0, ends[at == 0]])


@lru_cache(maxsize=2)
def load_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, shard_ids: int = 8_000_000) -> DataFrame:
    """Write all rows' ids in ascending key order; the manifest (path, part, seq, docs, ids) as a written table.

    Rows are dealt by ranges of key and of a hash of the text in Spark's own sampled bounds and sorted by both within each, so
    that a key of many rows, or a null one, is dealt over many tasks. A task rolls over to another file after shard_ids ids,
    which bounds its memory, or with one longer text; files carry the attempt's number, and the manifest names those of the attempt that
    counted. Null keys come first, a null text counts as empty (the end id alone), repeated keys keep a row each, next to each
    other; no rows: no shards. Other columns aren't read, whatever their names.
    """
    folder = new_folder(df.sparkSession, "tokens")

    def run(batches):
        encoder, task, seq = load_encoder(tokenizer_path), TaskContext.get(), 0
        part = task.partitionId()
        keys, counts, ids, nulls = [], [], [], 0

        def flush():
            nonlocal keys, counts, ids, nulls, seq
            path = f"{folder}/{part:06d}-{seq:04d}-{task.taskAttemptId()}.tok"
            all_counts, all_ids = np.concatenate(counts), np.concatenate(ids)
            put_file(path, pack(np.concatenate(keys), nulls, all_counts, all_ids, encoder.width))
            row = pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "docs": [len(all_counts)], "ids": [len(all_ids)]})
            keys, counts, ids, nulls, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for a, b in byte_slices(batch.column(1), 2 << 20):  # a slice's words and places take many times its bytes
                cut = batch.slice(a, b - a)
                flat, n = encoder.encode([t or "" for t in cut.column(1).to_pylist()], end_id)
                nulls += cut.column(0).null_count
                keys.append(cut.column(0).fill_null(0).to_numpy(zero_copy_only=False)), counts.append(n), ids.append(flat.astype(f"u{encoder.width}"))
                if sum(map(len, ids)) >= shard_ids:
                    yield flush()
        if counts:
            yield flush()

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    order = [F.col("k"), F.xxhash64("t")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.mapInArrow(run, "path string, part long, seq long, docs long, ids long"), "manifest")


def read_shards(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the shard files, by selects in their Elias-Fano boundaries and keys."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(get_file(row["path"]))
                for a in range(0, shard.docs, 10_000):
                    b = min(shard.docs, a + 10_000)
                    cuts = shard.boundaries(a, b)
                    keys, null = shard.keys(a, b)
                    crc = [zlib.crc32(shard.ids[s:e].astype("<u4")) for s, e in pairwise(cuts.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(cuts[:-1] + row["base"]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], names=["k", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    n = min(max(1, manifest.count()), 4 * tasks(manifest.sparkSession))
    return placed.repartition(n).mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


__all__ = ["EliasFano", "Shard", "WordEncoder", "drop_written", "pack", "read_shards", "write_shards"]
