"""Problem 6: every text of a corpus as token ids of a byte-level BPE vocabulary.

Method: contiguous rank array. A word is a list of part boundaries with, beside each, the rank of the merge of that part
and its right neighbour. The smallest rank is found by scanning, its right boundary is deleted, and the two neighbouring
ranks are looked up anew, until no merge is left. The scan costs the square of the length, so words above
``SHORT_WORD`` bytes keep the same state in a linked list with a heap instead; ids are the same.

Texts are cut where a single space stands between two non-blank characters. No pre-token reaches over such a place except
by taking the space as its first character, so each chunk can be encoded by itself and be remembered.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cliploom.session import spread

#: Fixed value: the pattern that splits a text before the merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT_WORD = 64
#: Bytes of text encoded and handed on at a time, or one text where it is longer.
BATCH_BYTES = 1 << 21
MEMO_CHUNK_CHARS = 64
MEMO_ENTRIES = 1 << 18
NO_RANK = 1 << 60

_LOADED: dict[str, "ByteBPE"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def rank_array_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while rank:
        best = min(rank)
        if best == NO_RANK:
            break
        at = rank.index(best)
        del bounds[at + 1], rank[at]
        if at:
            rank[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], NO_RANK)
        if at < len(rank):
            rank[at] = ranks.get(word[bounds[at] : bounds[at + 2]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word in n log n: parts in a linked list, merges in a heap, stale entries skipped."""
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n

    def pair_rank(i: int) -> int:
        j = end[i]
        return ranks.get(word[i : end[j]], NO_RANK) if j < n else NO_RANK

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NO_RANK)) < NO_RANK]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = 0, stop
        if stop < n:
            left[stop] = i
        for k in (left[i], i):
            if k >= 0 and (r := pair_rank(k)) < NO_RANK:
                heapq.heappush(heap, (r, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class ByteBPE:
    """A rank file and the memo of chunks met so far; one per worker process and file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.words = regex.compile(SPLIT_PATTERN)
        self.unsafe = regex.compile(r"\s\s|^\s|\s$")
        self.safe_cut = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> "ByteBPE":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def word_ids(self, word: str) -> list[int]:
        got = self.word_memo.get(word)
        if got is None:
            raw = word.encode("utf-8", "surrogatepass")
            got = rank_array_merge(raw, self.ranks) if len(raw) <= SHORT_WORD else heap_merge(raw, self.ranks)
            if len(raw) <= SHORT_WORD:
                if len(self.word_memo) >= MEMO_ENTRIES:
                    self.word_memo.clear()
                self.word_memo[word] = got
        return got

    def chunk_bytes(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in self.words.findall(chunk):
            ids += self.word_ids(word)
        return np.array(ids, dtype=np.int32).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        first, *parts = self.safe_cut.split(text) if self.unsafe.search(text) else text.split(" ")
        memo, out = self.memo, [self.chunk_bytes(first)]
        for part in parts:
            got = memo.get(part)
            if got is None:
                got = self.chunk_bytes(" " + part)
                if len(part) <= MEMO_CHUNK_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[part] = got
            out.append(got)
        return b"".join(out)

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


def _over_batches(text_col: str, path: str, build: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(path)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(whole.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + BATCH_BYTES, side="right")))
                batch = whole.slice(at, to - at)
                texts = batch.column(batch.schema.get_field_index(text_col))
                yield build(batch, [bpe.packed(t) if t else b"" for t in (x.as_py() for x in texts)])
                at = to

    return run


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens. An empty and a null text get an empty list.

    Rows with a null id and repeated rows are kept as they are; other columns are not read, whatever their names.
    ``vocabulary`` is a rank file that every executor can open. One narrow stage, no shuffle.
    """
    source = spread(df.select(df[id_col].alias("_id"), df[text_col].alias("_text")))
    path = vocabulary or default_vocabulary()

    def build(batch: pa.RecordBatch, packed: list[bytes]) -> pa.RecordBatch:
        offsets = np.zeros(len(packed) + 1, dtype=np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["_id", "_ids"])

    kind = source.schema["_id"].dataType.simpleString()
    out = source.mapInArrow(_over_batches("_text", path, build), f"_id {kind}, _ids array<int>")
    return out.select(out["_id"].alias(id_col), out["_ids"].alias(ids_col))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, count_col: str = "tokens") -> DataFrame:
    """(id, tokens): the number of ids each text has; 0 for an empty or null text."""
    source = spread(df.select(df[id_col].alias("_id"), df[text_col].alias("_text")))
    path = vocabulary or default_vocabulary()

    def build(batch: pa.RecordBatch, packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64())], names=["_id", "_n"])

    kind = source.schema["_id"].dataType.simpleString()
    out = source.mapInArrow(_over_batches("_text", path, build), f"_id {kind}, _n bigint")
    return out.select(out["_id"].alias(id_col), out["_n"].alias(count_col))
