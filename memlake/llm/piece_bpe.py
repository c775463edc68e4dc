"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file's pieces become flat tables: characters to symbols, sorted (left, right) keys to a rank and
the merged symbol. Distinct words of a batch lie in one flat symbol array; each round finds every word's
least-ranked pair (leftmost at ties) by a segmented minimum, merges at once, and compacts, until no pair
remains. A word merges all disjoint occurrences of its best pair in one round only where no pair that this
makes could come before the rest; else it merges the leftmost alone, so results equal one merge at a time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import byte_slices

SPACE = "▁"
_NONE = np.iinfo(np.int64).max
# Kinds of pieces as the model file numbers them.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _read_model(path: str) -> tuple[list[tuple[str, float, int]], dict[str, bool]]:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("only identity normalisation with byte fallback is supported")
    return [(p.piece, p.score, p.type) for p in model.pieces], {"prefix": n.add_dummy_prefix, "unk": model.trainer_spec.unk_surface}


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lens[i]-1 of all i, one after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceModel:
    #: Words kept in a worker; at the bound the cache starts anew.
    CACHE = 400_000

    def __init__(self, path: str):
        pieces, spec = _read_model(path)
        self.prefix, self.unk_surface, self.kinds = spec["prefix"], spec["unk"], np.array([k for _, _, k in pieces])
        own = {p: i for i, (p, _, k) in enumerate(pieces) if k in (_NORMAL, _USER, _UNUSED)}
        self.bytes = np.zeros(256, np.int64)
        for i, (p, _, k) in enumerate(pieces):
            if k == _BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.size = len(pieces)
        chars = sorted({c for p in own for c in p})
        self.chars = np.array([ord(c) for c in chars], np.int64)
        extra = {c: self.size + i for i, c in enumerate(c for c in chars if c not in own)}
        self.char_ids = np.array([own.get(c, extra.get(c)) for c in chars], np.int64)
        self.width = self.size + len(extra) + 1
        self.unknown = self.width - 1
        ranks = {s: r for r, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        keys = {}
        for p, i in own.items():
            for cut in range(1, len(p)):
                left, right = own.get(p[:cut], extra.get(p[:cut])), own.get(p[cut:], extra.get(p[cut:]))
                if left is not None and right is not None:
                    keys[left * self.width + right] = (ranks[pieces[i][1]], i)
        order = sorted(keys)
        self.keys = np.array(order, np.int64)
        self.ranks = np.array([keys[k][0] for k in order], np.int64)
        self.merged = np.array([keys[k][1] for k in order], np.int64)
        joined = {c for p in own if len(p) > 1 for c in p}
        # A line feed stands in no longer piece and no piece holds a space after another character: words end there.
        if "\n" in joined or any(SPACE in p.lstrip(SPACE) for p in own):
            raise ValueError("pieces cross word ends")
        self.words = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        text = [b"" if k == _CONTROL else self.unk_surface.encode() if k == _UNKNOWN else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.out_len = np.array([len(x) for x in text], np.int64)
        self.out_start = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(text), np.uint8)
        self.starts_space = np.array([k in (_NORMAL, _USER, _UNUSED) and p.startswith(SPACE) for p, _, k in pieces])
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[at] == k
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty words and the number of each word's ids."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        sym = np.where(self.chars[at] == points, self.char_ids[at], self.unknown)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word, done_at = [], [], []
        where = np.arange(len(sym))  # first character of each symbol
        while len(sym):
            rank, into = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner], into[inner] = self._pairs(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            live = np.repeat(best != _NONE, size)
            if not live.all():
                done_sym.append(sym[~live]), done_word.append(word[~live]), done_at.append(where[~live])
                sym, word, where, rank, into = sym[live], word[live], where[live], rank[live], into[live]
                size, best = size[best != _NONE], best[best != _NONE]
                if not len(sym):
                    break
            segment = np.repeat(np.arange(len(size)), size)
            hits = np.flatnonzero(rank == best[segment])
            # Of chains of overlapping hits, every other one from the left.
            new = np.r_[True, (np.diff(hits) != 1)]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
            seg = segment[hits]
            lead = np.r_[True, seg[1:] != seg[:-1]]
            if not lead.all():  # words with several hits: may all merge at once?
                new_sym, ahead, after = into[hits], hits - 1, hits + 2
                limit = best[seg]
                bad = np.zeros(len(hits), bool)
                ok = (ahead >= 0) & (segment[ahead] == seg)
                bad[ok] |= self._pairs(sym[ahead[ok]], new_sym[ok])[0] <= limit[ok]
                ok = after < len(sym)
                ok[ok] = segment[after[ok]] == seg[ok]
                bad[ok] |= self._pairs(new_sym[ok], sym[after[ok]])[0] <= limit[ok]
                next_to = np.flatnonzero((np.diff(hits) == 2) & (seg[1:] == seg[:-1]))
                bad[next_to] |= self._pairs(new_sym[next_to], new_sym[next_to + 1])[0] <= limit[next_to]
                unsafe = np.zeros(len(size), bool)
                unsafe[seg[bad]] = True
                hits = hits[lead | ~unsafe[seg]]
            sym[hits] = into[hits]
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            sym, word, where = sym[stay], word[stay], where[stay]
        sym, word, where = np.concatenate(done_sym), np.concatenate(done_word), np.concatenate(done_at)
        order = np.argsort(where, kind="stable")
        sym, word, where = sym[order], word[order], where[order]
        lost = sym >= self.size
        if not lost.any():
            return sym.astype(np.int32), np.bincount(word, minlength=len(words))
        out, owner = [], []
        for s, w, p in zip(sym.tolist(), word.tolist(), where.tolist(), strict=True):  # rare: characters without a piece become bytes
            ids = [s] if s < self.size else [int(self.bytes[b]) for b in chr(int(points[p])).encode("utf-8", "surrogatepass")]
            out += ids
            owner += [w] * len(ids)
        return np.array(out, np.int32), np.bincount(np.array(owner, np.int64), minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of each text's ids; an empty text has none."""
        if len(self.codes) > self.CACHE:
            self._reset()
        words: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                words += self.words.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE))
            ends[i] = len(words)
        fresh = list({w for w in words if w not in self.codes})
        if fresh:
            ids, count = self.merge_words(fresh)
            base = len(self.codes)
            self.codes.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(count) - count]
            self.count, self.flat = np.r_[self.count, count], np.r_[self.flat, ids]
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        lens = self.count[codes]
        total = np.r_[0, np.cumsum(lens)][np.r_[0, ends]]
        return self.flat[_ranges(self.start[codes], lens)], np.diff(total)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids, as the library's decode gives it."""
        ids = ids.astype(np.int64)
        stop = np.cumsum(counts)
        lens = self.out_len[ids]
        data = self.out[_ranges(self.out_start[ids], lens)].tobytes()
        edge = np.r_[0, np.cumsum(lens)]
        texts = []
        for a, b in zip((stop - counts).tolist(), stop.tolist(), strict=True):
            if a == b:
                texts.append("")
                continue
            lo, hi = int(edge[a]), int(edge[b])
            first = a
            while first < b - 1 and self.kinds[ids[first]] == _CONTROL:
                first += 1
            lo += bool(self.prefix and self.starts_space[ids[first]])
            try:
                texts.append(data[lo:hi].decode())
            except UnicodeDecodeError:
                texts.append(self._decode_broken(ids[a:b]))
        return texts

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Ids whose bytes aren't whole characters: each byte that starts none becomes U+FFFD."""
        out, run, seen = "", b"", False
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.kinds[i] == _BYTE:
                run += self.out[self.out_start[i] : self.out_start[i] + 1].tobytes()
                continue
            while run:
                n = next((n for n in range(1, min(4, len(run)) + 1) if _valid(run[:n])), 0)
                out, run = out + (run[:n].decode() if n else "�"), run[n or 1 :]
            if i >= 0:
                piece = self.out[self.out_start[i] : self.out_start[i] + self.out_len[i]].tobytes().decode()
                if self.prefix and not out and not seen and self.starts_space[i]:
                    piece, seen = piece[1:], True
                out += piece
        return out


def _valid(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", batch_bytes: int = 2_000_000) -> DataFrame:
    """(key, ids array<int>, decoded string) of every row: whole texts, each encoded and its ids decoded again.

    A null text counts as empty and gives no ids and an empty decoded text; a null key stays null; repeated
    rows each give a row; other columns are not read, whatever their names. Work is per row in one pass
    without a shuffle; a batch is cut into pieces of about batch_bytes bytes of text to bound memory; an empty table gives no rows.
    """

    def run(batches):
        model = load_model(model_path)
        for batch in batches:
            for a, b in byte_slices(batch.column(1), batch_bytes, 10_000):
                cut = batch.slice(a, b - a)
                ids, counts = model.encode([t or "" for t in cut.column(1).to_pylist()])
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(model.decode(ids, counts), pa.string())], names=["k", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encode_decode's rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
