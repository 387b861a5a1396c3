"""Token ids in patched frame-of-reference blocks.

A file is a Parquet table of segments; a segment is one byte string:

    magic "PFR1" | u32 docs, blocks | u64 ids, packed bytes | u32 exceptions
    i64 doc_id[docs] | u8 has_id[docs] | u64 n_tokens[docs]
    u32 minimum[blocks] | u8 width[blocks] | u64 start[blocks]
    u32 first_exception[blocks] | u16 position[exceptions] | u32 high[exceptions]
    packed bits

Each block of BLOCK ids holds the ids less the block's minimum, in as many
bits as PERCENTILE of them need; the high bits of the others stand in the
exception list. start[] is a block's first byte among the packed bits, so any
block is read alone.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cached, shared_dir, ship, small_batches

BLOCK = 1024
PERCENTILE = 90
#: Ids after which a segment is closed; a document is never cut.
SEGMENT = 1 << 20
END = 2
#: Pieces of text whose ids a worker remembers, and the longest such piece.
REMEMBERED, PIECE = 600_000, 64
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIQQI")


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """minimum, width, start, first_exception, position, high, packed bits of a stream of uint32 ids."""
    n = -(-len(ids) // BLOCK)
    padded = np.empty(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    grid = padded.reshape(n, BLOCK)
    low = grid.min(axis=1) if n else np.zeros(0, np.uint32)
    delta = grid - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    most = np.partition(delta, at, axis=1)[:, at] if n else np.zeros(0, np.uint32)
    width = np.frexp(most.astype(np.float64))[1].astype(np.uint8)
    largest = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    block, position = np.nonzero(delta > largest[:, None])
    high = (delta[block, position] >> width[block]).astype(np.uint32)
    first = np.searchsorted(block, np.arange(n)).astype(np.uint32)
    per = width.astype(np.uint64) * np.uint64(BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint64) if n else np.zeros(0, np.uint64)
    packed = np.zeros(int(per.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.nonzero(width == w)[0]
        kind, size = (("<u2", 2) if w <= 16 else ("<u4", 4))
        for part in np.array_split(rows, -(-len(rows) // 256)):
            bit = np.unpackbits(delta[part].astype(kind).view(np.uint8).reshape(len(part), BLOCK, size), axis=2, bitorder="little")[:, :, :w]
            body = np.packbits(bit.reshape(len(part), -1), axis=1, bitorder="little")
            packed[(start[part][:, None] + np.arange(body.shape[1], dtype=np.uint64)).astype(np.int64)] = body
    return low, width, start, first, position.astype("<u2"), high, packed.tobytes()


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """doc_ids and lengths of the documents whose ids follow each other in ids."""
    low, width, start, first, position, high, packed = encode_blocks(ids)
    parts = [HEAD.pack(MAGIC, len(doc_ids), len(low), len(ids), len(packed), len(high))]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes()]
    parts += [a.astype(k).tobytes() for a, k in ((low, "<u4"), (width, "u1"), (start, "<u8"), (first, "<u4"), (position, "<u2"), (high, "<u4"))]
    return b"".join([*parts, packed])


class Segment:
    """A segment for reading: its documents, and any block or range of ids."""

    def __init__(self, data: bytes | pa.Buffer) -> None:
        magic, docs, blocks, self.n_ids, _, exceptions = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.n_tokens = take("<u8", docs).astype(np.int64)
        self.low, self.width, self.start, self.first = take("<u4", blocks), take("u1", blocks), take("<u8", blocks), take("<u4", blocks)
        self.position, self.high = take("<u2", exceptions), take("<u4", exceptions)
        self.packed = np.frombuffer(data, np.uint8, offset=at)

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b - 1, the last one padded."""
        out = np.zeros((b - a, BLOCK), np.uint32)
        width = self.width[a:b]
        for w in map(int, np.unique(width[width > 0])):
            rows = np.nonzero(width == w)[0]
            for part in np.array_split(rows, -(-len(rows) // 256)):
                where = self.start[a + part][:, None].astype(np.int64) + np.arange(w * BLOCK // 8)
                kind = np.uint32 if w <= 25 else np.uint64  # holds a value and the bits before it
                body = self.packed[where].reshape(len(part), BLOCK // 8, w).astype(kind)
                eight = np.empty((len(part), BLOCK // 8, 8), np.uint32)
                for k in range(8):  # eight values fill w bytes, so the k-th always has the same bits
                    bit, shift = k * w // 8, k * w % 8
                    value = body[:, :, bit].copy()
                    for more in range(1, (shift + w + 7) // 8):
                        value |= body[:, :, bit + more] << kind(8 * more)
                    eight[:, :, k] = (value >> kind(shift)) & kind((1 << w) - 1)
                out[part] = eight.reshape(len(part), BLOCK)
        bounds = np.append(self.first, len(self.high))
        lo, hi = int(bounds[a]), int(bounds[b])
        block = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1].astype(np.int64)))
        out[block, self.position[lo:hi]] += self.high[lo:hi] << width[block].astype(np.uint32)
        return out + self.low[a:b, None]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else end
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        return self.blocks(a, b).reshape(-1)[start - a * BLOCK : end - a * BLOCK]


_CUT = re.compile(r"(?= \S)")
#: A space before white space or the end (for RE2, which knows ASCII white space only).
_LOOSE = r" (?:[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"
_SPACES = re.compile(r"\s")
_LINE = re.compile(r"(\S+)\n(\S+)")


def cuts_at_spaces(path: str) -> bool:
    """Whether the file's tokenizer starts a token at every space before another character, whatever stands around.

    True for byte-level BPE without normalizer, prefix space, dropout or
    affixes, split by the library's own expression, whose added tokens hold no
    white space and take none from around them.
    """
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre, model = t.get("pre_tokenizer") or {}, t.get("model") or {}
    plain = not t.get("normalizer") and not t.get("truncation") and not t.get("padding")
    plain &= pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all(not any(a.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and a["content"] and not _SPACES.search(a["content"]) for a in t.get("added_tokens", ()))
    return bool(plain and added)


class Encoder:
    """A tokenizer file's ids, each distinct piece of text encoded once where that gives the same ids.

    Where cuts_at_spaces() is false, whole texts are encoded. Otherwise: the
    byte-level pre-tokenizer always starts a new token at a space that
    precedes a character other than white space, so the ids of a text are the
    ids of its pieces between such places. Pieces not seen before are encoded
    in one call, as a text of their own, and told apart by the tokens that
    begin with a space.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not cuts_at_spaces(path)
        self.remembered = remembered
        if self.whole:
            return
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")  # the byte-level alphabet's space
        self.newline = self.tokenizer.token_to_id("\u010a")
        self.feed = array("I", [self.newline]).tobytes()
        self.tails = {c: self._encode([c])[0] for c in ".,;:!?"}
        self.inner: dict[str, bytes] = {}  # pieces without the space they begin with
        self.bare: dict[str, bytes] = {}  # pieces that begin a line

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], mark: str) -> dict[str, bytes]:
        """Ids of " " + piece (mark " ") or of the piece alone (mark "\n"), from one call as far as that can be told apart."""
        plain = [p for p in pieces if p and not _SPACES.search(p) and not any(s in p for s in self.special)]
        out: dict[str, bytes] = {}
        if plain:
            body = self._encode([mark + mark.join(plain)])[0]
            ids = np.frombuffer(body, np.uint32)
            at = np.flatnonzero(self.opens[ids] if mark == " " else ids == self.newline)
            if len(at) == len(plain):
                skip, cut = (0 if mark == " " else 4), [*(at * 4).tolist(), len(body)]
                out = {p: body[x + skip : y] for p, x, y in zip(plain, cut, cut[1:])}
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, self._encode([mark + p if mark == " " else p for p in rest])))
        return out

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of " " + word. A mark that ends a known word, and a line break inside one, are tokens of their own."""
        out, rest, lines = {}, [], []
        known, tails = self.inner.get, self.tails
        for w in words:
            t = tails.get(w[-1:])
            if t is not None and w[-2:-1].isalnum() and (h := known(w[:-1])) is not None:
                out[w] = h + t
            elif "\n" in w and (m := _LINE.fullmatch(w)) and not any(s in w for s in self.special):
                lines.append((w, m[1], m[2]))
            else:
                rest.append(w)
        if lines:
            heads = {h for _, h, _ in lines if h not in self.inner and h not in out}
            for h in list(heads):
                t = tails.get(h[-1:])
                if t is not None and h[-2:-1].isalnum() and (x := known(h[:-1])) is not None:
                    out[h] = x + t
                    heads.discard(h)
            rest += heads.difference(rest)
            new = list({b for _, _, b in lines}.difference(self.bare))
            fresh = self._joined(new, "\n")
            self.bare.update(islice(((k, v) for k, v in fresh.items() if len(k) <= PIECE), self.remembered // 8 - len(self.bare)))
        out.update(self._joined(rest, " "))
        self.inner.update(islice(((k, v) for k, v in out.items() if len(k) <= PIECE), self.remembered - len(self.inner)))
        for w, h, b in lines:
            out[w] = (known(h) or out[h]) + self.feed + (self.bare.get(b) or fresh[b])
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by end, and how many each has.

        Splitting and looking for repeated pieces is Arrow's work; only the
        distinct pieces of a batch are looked up.
        """
        if self.whole:
            last = np.array([end], np.uint32)
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([x for ids in found for x in (ids, last)] or [last[:0]]), np.array([len(ids) + 1 for ids in found], np.int64)
        loose = pc.match_substring_regex(texts, _LOOSE).to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(texts, " ")
        if loose.any():
            odd = iter([p[i > 0 :] for i, p in enumerate(_CUT.split(texts[int(k)].as_py()))] for k in np.flatnonzero(loose))
            pieces = pa.array([next(odd) if x else p.as_py() for x, p in zip(loose, pieces)], pa.list_(pa.string()))
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values[int(bounds[0]) : int(bounds[-1])].dictionary_encode()
        bounds = bounds - bounds[0]
        at = flat.indices.to_numpy().astype(np.int32)
        words = flat.dictionary.to_pylist()
        del pieces, flat
        firsts = [words[i] for i in at[bounds[:-1]]]
        ids = list(map(self.inner.get, words))
        new = [w for w, v in zip(words, ids) if v is None]
        if new:
            found = self._encode_words(new)
            ids = [found[w] if v is None else v for w, v in zip(words, ids)]
        ids += self._encode(firsts)
        ids.append(array("I", [end]).tobytes())
        at[bounds[:-1]] = np.arange(len(words), len(words) + len(firsts), dtype=np.int32)  # no space precedes a text's first piece
        at = np.insert(at, bounds[1:], len(ids) - 1)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        per = size[at]
        upto = np.cumsum(per, dtype=np.int32)  # a batch holds far fewer than 2^31 ids
        take = np.repeat(start[at] - (upto - per), per)
        take += np.arange(len(take), dtype=np.int32)
        ends = bounds[1:] + np.arange(1, len(bounds))
        counts = np.diff(upto[ends - 1].astype(np.int64), prepend=0)
        return np.frombuffer(b"".join(ids), np.uint32)[take], counts


def encoder_for(path: str, remembered: int = REMEMBERED) -> Encoder:
    """This process's encoder; a worker keeps it from task to task."""
    return cached(("tokens", path, remembered), lambda: Encoder(path, remembered))


def _slices(batch: pa.RecordBatch, most: int = 6 << 20) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of a batch, in parts of about most bytes of text; nulls are empty."""
    texts = pc.fill_null(batch.column("text"), "")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.column("doc_id").slice(a, b - a).to_pylist(), texts.slice(a, b - a)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END, remembered: int = REMEMBERED) -> None:
    """Write the ids of all texts, each closed by the id end, in ascending doc_id order.

    Null texts are empty, so the end id only. Rows without doc_id come first;
    rows of one doc_id follow each other by text. Other columns are ignored;
    an empty table gives a file without segments. tokenizer: a file of the
    tokenizers library that every executor has. remembered: pieces of text a
    worker keeps, about 0.2 kB each; fewer cost time, not results.
    """
    ship(docs.sparkSession)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer, remembered)
        number, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        streams: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            held = sum(lengths)
            data = encode_segment(ids, lengths, np.concatenate(streams))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["shard", "seq", "n_ids", "data"])

        for batch in batches:
            for some, texts in _slices(batch):
                stream, counts = encoder.encode(texts, end)
                pa.default_memory_pool().release_unused()
                to = np.cumsum(counts)
                part = (to + sum(lengths)) // SEGMENT  # a document goes to the segment in which it would end
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(some)]
                for a, b in zip(cuts, cuts[1:]):
                    if lengths and (sum(lengths) + int(to[b - 1]) - int(to[a] - counts[a]) > SEGMENT):
                        yield row()
                        seq, ids, lengths, streams = seq + 1, [], [], []
                    ids += some[a:b]
                    lengths += counts[a:b].tolist()
                    streams.append(stream[int(to[a] - counts[a]) : int(to[b - 1])])
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession, 4_000, 8 << 20):
        rows.mapInArrow(shard, "shard int, seq int, n_ids long, data binary").write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, seq, data in zip(*(batch.column(c) for c in ("shard", "seq", "data"))):
            s = Segment(data.as_buffer())
            ends = np.cumsum(s.n_tokens)
            raw = memoryview(s.ids().astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), s.n_tokens.tolist())]
            n = len(sums)
            columns = [pa.array([shard.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(ends - s.n_tokens, pa.int64()), pa.array(s.n_tokens, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files at path."""
    ship(spark)
    files = spark.read.schema("shard int, seq int, n_ids long, data binary").parquet(path)
    head = files.select("shard", "seq", "n_ids")
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = head.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # a row per file
    base = shards.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = head.withColumn("at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(base, "shard").select("shard", "seq", (F.col("base") + F.col("at")).alias("from"))
    docs = files.select("shard", "seq", "data").mapInArrow(_read, "shard int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "seq"]).select("doc_id", (F.col("from") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer: str, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write docs as token files (in the shared folder unless path is given) and read them back."""
    path = path or shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer, path, remembered=remembered)
    return read_digest(docs.sparkSession, path)
