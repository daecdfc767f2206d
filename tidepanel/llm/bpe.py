"""Byte-level BPE by corpus-level merge replay.

``encode`` splits texts with the vocabulary's pattern, collects the distinct pieces of a slice of the corpus and replays
the merges over all of them together: an inverted index leads from a pair's rank to the positions of that pair in the
pieces, ranks are taken in order, and a merge looks again only at the two neighbours it touched. A slice is bounded in
bytes of text, so a task's memory is too, and nothing is shuffled. ``decode`` turns ids into bytes.

Null texts count as empty; an empty text has no ids. Rows, repeated ones too, come out one for one, in their order, with
all their other columns.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import list_array, offsets_of, once, ranges, small_batches

#: The pattern that the fast splitter below stands for.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What may follow an apostrophe as a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, WHITE, SPACE = range(5)
#: Bytes of text whose pieces are encoded together.
SLICE_BYTES = 6 << 20
#: Distinct pieces of earlier slices whose ids a worker keeps.
KEPT_PIECES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def _classes() -> np.ndarray:
    """The class of each code point, from the properties that the pattern names."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(prop, everything):
            shift = 0x800 if m.start() >= 0xD800 else 0
            table[m.start() + shift : m.end() + shift] = kind
    table[32] = SPACE
    return table


class Splitter:
    """Cuts text where the pattern's matches begin; the pattern above by array operations, any other by ``regex``."""

    def __init__(self, pattern: str):
        self.pattern = None if pattern == GPT2_PATTERN else regex.compile(pattern)
        self.table = _classes() if self.pattern is None else None

    def __call__(self, text: str) -> list[str]:
        if self.pattern is not None:
            return [m.group() for m in self.pattern.finditer(text)]
        if not text:
            return []
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.table[code]
        white = kind >= WHITE
        before = np.empty_like(kind)
        before[0], before[1:] = WHITE, kind[:-1]
        begins = kind != before  # runs of one class, and runs of white space whatever it is made of
        begins &= ~(white & (before >= WHITE))
        begins[0] = True
        ends_white = ~white & (before >= WHITE)
        ends_white[0] = False
        at = np.flatnonzero(ends_white)
        # The last of a run of white space before a word: a space belongs to the word, anything else stands alone.
        begins[at - 1] = True
        begins[at] = before[at] != SPACE
        quotes = np.flatnonzero((code == 39) & begins)  # behind a space the apostrophe is no start of a match
        if len(quotes):
            for q in quotes.tolist():
                for tail in CONTRACTIONS:
                    if text.startswith(tail, q + 1):
                        end = q + 1 + len(tail)
                        begins[q + 1 : end] = False
                        if end < len(code) and not (white[end] and white[end - 1]):
                            begins[end] = True
                        break
        cuts = np.flatnonzero(begins).tolist()
        cuts.append(len(code))
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


class Merges:
    """The ranks, and the rank of each pair of tokens that join to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.full(256, -1, np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where it joins to no token."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def one(self, piece: bytes) -> list[int]:
        """A single piece by the definition: join the pair of the least rank, leftmost first, until none joins."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
        n = len(token)
        if not n:
            return token.astype(np.int64), lengths
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends[lengths > 0] - 1] = -1
        back = np.arange(-1, n - 1, dtype=np.int32)
        back[(ends - lengths)[lengths > 0]] = -1
        pair = np.full(n, -1, np.int32)  # the rank of the pair that starts at each position
        odd: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray, rank: np.ndarray) -> None:
            """Adds positions to the index by rank."""
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(rank)]
            for r, a, b in zip(rank[starts[:-1]].tolist(), starts, starts[1:]):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        at = np.flatnonzero(after >= 0).astype(np.int32)
        pair[at] = self.rank(token[at], token[after[at]])
        at = at[pair[at] >= 0]
        if len(at):
            post(at, pair[at])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[pair[at] == r]
            if len(lists) > 1:
                at = _distinct(at)
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that overlap, as in aaa, every other one, from the left
                joined = np.zeros(len(at), bool)
                joined[1:] = after[at[:-1]] == at[1:]
                if joined.any():
                    step = np.arange(len(at))
                    at = at[(step - np.maximum.accumulate(np.where(joined, 0, step))) % 2 == 0]
            gone = after[at]
            right = after[gone]
            token[at], token[gone] = r, -1
            pair[at] = pair[gone] = -1
            after[at] = right
            back[right[right >= 0]] = at[right >= 0]
            left = back[at]
            touched = np.concatenate([left[left >= 0], at[right >= 0]])
            touched = _distinct(touched[token[touched] >= 0])
            if not len(touched):
                continue
            rank = self.rank(token[touched], token[after[touched]]).astype(np.int32)
            pair[touched] = rank
            some = rank >= 0
            if some.any():
                touched, rank = touched[some], rank[some]
                if (rank < r).any():  # a lower rank came up late: such pieces are done one by one below
                    odd.update(owner[touched[rank < r]].tolist())
                post(touched, rank)
        alive = token >= 0
        ids, counts = token[alive].astype(np.int64), np.bincount(owner[alive], minlength=len(pieces))
        if odd:
            cuts = np.cumsum(counts) - counts
            parts = [self.one(p) if i in odd else ids[c : c + k].tolist() for i, (p, c, k) in enumerate(zip(pieces, cuts.tolist(), counts.tolist()))]
            ids, counts = np.array([x for p in parts for x in p], np.int64), np.array([len(p) for p in parts])
        return ids, counts


class Pieces:
    """The distinct pieces met so far, numbered, and their ids. Of those of past slices a bounded number is kept."""

    def __init__(self, keep: int = KEPT_PIECES):
        self.keep, self.numbers = keep, {}
        self.ids = np.zeros(0, np.int32)
        self.counts = self.starts = np.zeros(0, np.int64)

    def number(self, words: list[str]) -> list[int]:
        numbers = self.numbers
        found = list(map(numbers.get, words))
        if None in found:
            found = [numbers.setdefault(w, len(numbers)) if x is None else x for w, x in zip(words, found)]
        return found

    def learn(self, merges: Merges) -> None:
        """Replays the merges over the pieces that have no ids yet."""
        fresh = list(islice(reversed(self.numbers), len(self.numbers) - len(self.counts)))[::-1]
        if fresh:
            ids, counts = merges.replay([w.encode() for w in fresh])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts])
            self.starts = np.cumsum(self.counts) - self.counts

    def forget(self) -> None:
        for _ in range(len(self.numbers) - self.keep):
            self.numbers.popitem()
        self.counts, self.starts = self.counts[: self.keep], self.starts[: self.keep]
        self.ids = self.ids[: int(self.counts.sum())]


def _append(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names, columns = batch.schema.names, list(batch.columns)
    if name in names:
        columns[names.index(name)] = column
        return pa.RecordBatch.from_arrays(columns, names=names)
    return pa.RecordBatch.from_arrays([*columns, column], names=[*names, name])


IDS = T.ArrayType(T.IntegerType())


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    if name in schema.names:
        return T.StructType([T.StructField(name, kind) if f.name == name else f for f in schema])
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def _encoder(shipped, pattern: str, text: str, out: str, slice_bytes: int, call: str):
    """Adds the ids to Arrow batches, inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split, known = once(call, lambda: (Merges(shipped.value), Splitter(pattern), Pieces()))
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            known.learn(merges)
            for batch, pieces, per_row in held:
                n = known.counts[pieces]
                flat = known.ids[ranges(known.starts[pieces], n)]
                yield _append(batch, out, list_array(flat, offsets_of(n)[offsets_of(per_row)], pa.int32()))
            held.clear()
            known.forget()

        for batch in batches:
            counts, numbers = [], []
            for value in batch.column(text):
                row = known.number(split(value.as_py() or ""))
                counts.append(len(row))
                numbers.append(np.array(row, np.int32))
            held.append((batch, np.concatenate(numbers) if numbers else np.zeros(0, np.int32), np.array(counts, np.int64)))
            size += batch.column(text).nbytes
            if size >= slice_bytes:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _decoder(shipped, ids: str, out: str):
    """Adds the bytes to Arrow batches, inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(shipped.value.values(), default=-1) + 1)
        for token, rank in shipped.value.items():
            tokens[rank] = token
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            n = lengths[flat]
            body = data[ranges(starts[flat], n)].tobytes()
            cuts = offsets_of(n)[offsets_of(rows)].tolist()
            yield _append(batch, out, pa.array([body[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()))

    return run


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str = GPT2_PATTERN, text: str = "text", out: str = "ids", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``df`` with ``out``, the ids of ``text``; a column of that name is replaced."""
    small_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(ranks)  # as many entries as the vocabulary has, whatever the corpus
    return df.mapInArrow(_encoder(shipped, pattern, text, out, slice_bytes, uuid.uuid4().hex), _with(df.schema, out, IDS))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the bytes that ``ids`` stand for; null ids decode to no bytes."""
    shipped = df.sparkSession.sparkContext.broadcast(ranks)
    return df.mapInArrow(_decoder(shipped, ids, out), _with(df.schema, out, T.BinaryType()))


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str = GPT2_PATTERN, text: str = "text", ids: str = "ids", out: str = "decoded", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``decode`` of ``encode`` in one pass, so that a task needs one Python worker and the ids cross to it once."""
    small_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(ranks)
    there, back = _encoder(shipped, pattern, text, ids, slice_bytes, uuid.uuid4().hex), _decoder(shipped, ids, out)
    return df.mapInArrow(lambda batches: back(there(batches)), _with(_with(df.schema, ids, IDS), out, T.BinaryType()))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The columns of the registered query, from ids and bytes."""
    joined = F.array_join(F.col(ids).cast("array<string>"), " ")
    return df.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs, ranks, public_tokenizers.PATTERN))
