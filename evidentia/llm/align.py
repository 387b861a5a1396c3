"""Alignment of two tokenizers' tokens by the bytes they cover.

A is a byte-level BPE file, B a sentencepiece model; both read the same bytes,
a space and the text. The ends of their tokens are marked in packed bitsets
over these bytes. AND of both marks the shared cuts, which close the groups; OR
marks the ends of links, since between two neighbouring ends of either kind
lies a part of just one token of each. Ranks by population counts turn a byte
place into token numbers.

No token of either crosses from a character that is no white space to a space,
so texts are cut there, and a worker remembers what it has found of a part: its
groups, as they are shown, and its links. Where this can't be relied on (text
that a tokenizer changes, a literal U+2581), a text is one part.

How many documents hold a linked pair of ids is a count over the corpus. The
most frequent pairs, HOT of them at most, go to all tasks; the others are
joined with the links they concern.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import bpe_automaton
from evidentia.llm.common import cached, ship, written

#: Pairs of ids that are sent to all tasks, 21 bytes each.
HOT = 1 << 20
#: Parts of texts that a worker remembers, and the longest such part; and pieces that it remembers for B in texts that are one part.
REMEMBERED, PIECE = 300_000, 48
WHOLE = 50_000
#: Parts that are encoded at once.
AT_ONCE = 10_000
#: Bits of a pair's code that hold B's id.
B_BITS = 24

_PIECE = re.compile(r" +[^ ]*")
#: From a space up to the next one behind a character that is no white space.
_PART = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _packed(ends: np.ndarray, size: int) -> np.ndarray:
    """Bits at the places in ends, size + 1 places, as words of 64."""
    flags = np.zeros(((size >> 6) + 1) << 6, bool)
    flags[ends] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def _rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set below each place."""
    upto = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return upto[word] + np.bitwise_count(bits[word] & below)


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rows of tokens over the same bytes, by their sizes: a_to and b_to, the tokens up to each shared cut; link_a and link_b, token numbers of each link.

    Sizes of 0 are not allowed. Texts that follow each other can be aligned at
    once, as every text's end is a cut.
    """
    a_ends, b_ends = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
    size = int(a_ends[-1]) if len(a_ends) else 0
    a, b = _packed(a_ends, size), _packed(b_ends, size)
    cuts, ends = _places(a & b), _places(a | b)
    return _rank(a, cuts) + 1, _rank(b, cuts) + 1, _rank(a, ends), _rank(b, ends)


class Pieces:
    """A sentencepiece model's ids and the bytes they stand for."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.labels = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]
        self.known: dict[str, list[int]] = {}
        probe = "  a  b　ﬁ\t\n é Ω "
        same = b"".join(self.labels[i] for i in self.model.encode(probe)) == f" {probe}".encode()
        # No piece has a space after another character, and texts are not changed: so a text's ids are those of its parts that begin with spaces.
        self.parted = same and not any(" " in n.replace("▁", " ").lstrip(" ") for n in names)

    def encode(self, text: str) -> list[int]:
        """Ids of text, to which the model adds a space; none for the empty text."""
        if not self.parted or not text or "▁" in text:
            return self.model.encode(text)
        parts, known = _PIECE.findall(f" {text}"), self.known
        try:
            return [i for p in parts for i in known[p]]
        except KeyError:
            pass
        new = list({p for p in parts if p not in known})
        found = dict(zip(new, self.model.encode([p[1:] for p in new], num_threads=1)))
        if " " in found:
            found[" "] = [self.model.piece_to_id("▁")]
        out = [i for p in parts for i in (known.get(p) or found[p])]
        for p, ids in found.items():
            if len(known) >= WHOLE:
                break
            if len(p) <= PIECE:
                known[p] = ids
        return out


class Bytes:
    """A byte-level BPE file's ids, as the tokenizers library finds them without added tokens, and the bytes they stand for."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = bpe_automaton.read_spec(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.model = Tokenizer.from_str(json.dumps(told | {"added_tokens": [], "truncation": None, "padding": None, "post_processor": None}))
        alphabet, added = bpe_automaton.byte_alphabet(), {t["content"]: t["id"] for t in spec["added"]}
        self.labels = [b""] * (1 + max([*spec["vocab"].values(), *added.values()]))
        for token, i in spec["vocab"].items():
            if token not in added:
                self.labels[i] = bytes(map(alphabet.__getitem__, token))
        for token, i in added.items():
            self.labels[i] = token.encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class _Pair:
    """Both tokenizers of a worker, and tables of their labels' sizes and decimal ids."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = Bytes(a), Pieces(b)
        self.a_size, self.b_size = (np.array([len(x) for x in t.labels], np.int64) for t in (self.a, self.b))
        self.shift, self.space = max(len(self.a_size), len(self.b_size)), self.b.model.piece_to_id("▁")
        #: Ids that stand for some bytes.
        self.full_a, self.full_b = (frozenset(np.flatnonzero(x).tolist()) for x in (self.a_size, self.b_size))
        #: Numbers of remembered parts; by number their groups and n_a, n_b, n_groups, n_links, and all their links' pairs.
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sizes, self.pairs = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        #: An id and the mark behind it: , inside one side of a group, | between its sides, ; between groups.
        self.shown = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(self.shift)]

    def ids(self, text: str | None) -> tuple[list[int], list[int]] | None:
        if not text:
            return None
        b = self.b.encode(text)
        labels = self.b.labels
        if b"".join([labels[i] for i in b]) != b" " + text.encode():
            return None
        a = self.a.encode(f" {text}")
        return (a, b) if 0 not in (self.a_size[a].min(), self.b_size[b].min()) else None

    def ids_of_parts(self, parts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """ids of parts that begin with a space; None where bytes are changed."""
        labels, out = self.b.labels, []
        for at in range(0, len(parts), AT_ONCE):
            some = parts[at : at + AT_ONCE]
            for p, a, b in zip(some, self.a.encode_all(some), self.b.model.encode([p[1:] for p in some], num_threads=1)):
                b = b or [self.space]
                same = b"".join([labels[i] for i in b]) == p.encode() and self.full_a.issuperset(a) and self.full_b.issuperset(b)
                out.append((array("i", a), array("i", b)) if same else None)
        return out

    def shown_groups(self, a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> list[bytes]:
        """Every token's id and mark, in the order of the groups, A's before B's."""
        out = np.empty(len(a) + len(b), np.int64)
        a_group, b_group = np.searchsorted(a_to, np.arange(len(a)), "right"), np.searchsorted(b_to, np.arange(len(b)), "right")
        a_at = np.arange(len(a)) + np.concatenate([[0], b_to])[a_group]
        b_at = np.arange(len(b)) + a_to[b_group]
        out[a_at], out[b_at] = a, b
        out[a_at[a_to - 1]] += self.shift
        out[b_at[b_to - 1]] += 2 * self.shift
        return list(map(self.shown.__getitem__, out.tolist()))


    def found(self, ids: list[tuple[list[int], list[int]]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Groups, sizes and pairs of ids, each of which is aligned by itself."""
        flat_a, flat_b = array("i"), array("i")
        for a, b in ids:
            flat_a.extend(a)
            flat_b.extend(b)
        n_a, n_b = [len(a) for a, _ in ids], [len(b) for _, b in ids]
        ids_a, ids_b = np.frombuffer(flat_a, np.int32).astype(np.int64), np.frombuffer(flat_b, np.int32).astype(np.int64)
        end_a, end_b = np.cumsum(n_a, dtype=np.int64), np.cumsum(n_b, dtype=np.int64)
        a_to, b_to, link_a, link_b = align(self.a_size[ids_a], self.b_size[ids_b])
        n_groups = np.diff(np.searchsorted(a_to, end_a, "right"), prepend=0)
        n_links = np.diff(np.searchsorted(link_a, end_a, "left"), prepend=0)
        shown = self.shown_groups(ids_a, ids_b, a_to, b_to)
        ends = [0, *(end_a + end_b).tolist()]
        groups = [b"".join(shown[x:y]) for x, y in zip(ends, ends[1:])]
        return groups, np.stack([n_a, n_b, n_groups, n_links], axis=1).astype(np.int64), ids_a[link_a] << B_BITS | ids_b[link_b]

    def aligned(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its groups and sizes; and doc (a text's place) and pair of every link."""
        number, n = self.number, len(self.groups)
        fresh: dict[str | tuple[str], int] = {}
        rows: list[list[int]] = []
        for text in texts:
            if not text:
                rows.append([])
            elif not self.b.parted or "▁" in text:
                rows.append([fresh.setdefault((text,), n + len(fresh))])
            else:
                parts = _PART.findall(" " + text)
                try:
                    rows.append([number[p] for p in parts])
                except KeyError:
                    rows.append([number[p] if p in number else fresh.setdefault(p, n + len(fresh)) for p in parts])
        parts = [p for p in fresh if type(p) is str]
        ids = dict(zip(parts, self.ids_of_parts(parts)))
        changed = {fresh[p] for p in parts if ids[p] is None}
        if changed:
            for i, (text, row) in enumerate(zip(texts, rows)):
                if not changed.isdisjoint(row):
                    rows[i] = [fresh.setdefault((text,), n + len(fresh))]
        groups, sizes, pairs = self.found([(ids[p] if type(p) is str else self.ids(p[0])) or ((), ()) for p in fresh])
        all_groups, all_sizes, all_pairs = self.groups + groups, np.concatenate([self.sizes, sizes]), np.concatenate([self.pairs, pairs])
        first = np.cumsum(all_sizes[:, 3]) - all_sizes[:, 3]
        ends = np.cumsum([0, *map(len, rows)])
        flat = np.fromiter((x for row in rows for x in row), np.int64, int(ends[-1]))
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(all_sizes[flat], axis=0)])
        told, n_links = np.diff(upto[ends], axis=0), all_sizes[flat, 3]
        at = np.repeat(first[flat] - upto[:-1, 3], n_links) + np.arange(upto[-1, 3])
        shown = [b"".join([all_groups[x] for x in row])[:-1] for row in rows]
        keep = [p for p in parts if len(p) <= PIECE and ids[p] is not None][: max(REMEMBERED - n, 0)]
        if keep:
            mine = np.zeros(len(fresh), bool)
            mine[[fresh[p] - n for p in keep]] = True
            self.pairs = np.concatenate([self.pairs, pairs[np.repeat(mine, sizes[:, 3])]])
            self.sizes = np.concatenate([self.sizes, sizes[mine]])
            self.groups += [groups[fresh[p] - n] for p in keep]
            number.update((p, n + i) for i, p in enumerate(keep))
        return shown, told, np.repeat(np.arange(len(rows)), told[:, 3]), all_pairs[at]


DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def alignments(docs: DataFrame, a: str, b: str, hashed: bool = False) -> DataFrame:
    """Every row's alignment, written to the shared folder: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    a: a byte-level BPE file that bpe_automaton follows, b: a sentencepiece
    model, both on every executor. groups: `a1,a2|b1;a3|b2,b3`, decimal ids in
    order, or its SHA-256 if hashed; '' without tokens. pairs: the distinct
    linked pairs of ids (A's shifted by B_BITS, plus B's), times: how many
    links each has. Special tokens' strings are ordinary text. Null texts,
    empty texts and those whose bytes a tokenizer changes have no tokens. Null
    and repeated doc_ids and repeated rows are rows of their own; other
    columns are ignored. Texts are aligned whole.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = cached(("align", a, b), lambda: _Pair(a, b))
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for some in bpe_automaton.slices(batch):
                groups, sizes, doc, pair = both.aligned(some.column("text").to_pylist())
                n_a, n_b, n_groups, n_links = sizes.T
                if hashed:
                    groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                else:
                    groups = [g.decode() for g in groups]
                bits = int(pair.max(initial=0)).bit_length()
                if bits + len(sizes).bit_length() < 64:  # one number a link sorts faster
                    key = np.sort(doc << bits | pair)
                    doc, pair = key >> bits, key & ((1 << bits) - 1)
                else:
                    order = np.lexsort((pair, doc))
                    doc, pair = doc[order], pair[order]
                first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])[: len(pair)])
                times = np.diff(first, append=len(pair)).astype(np.int32)
                offsets = pa.array(np.searchsorted(doc[first], np.arange(len(n_a) + 1)).astype(np.int32))
                rows = np.arange(number, number + len(n_a))
                number += len(n_a)
                columns = [pa.array(rows), some.column("doc_id"), *(pa.array(np.asarray(x, np.int64)) for x in (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(pair[first])), pa.ListArray.from_arrays(offsets, pa.array(times))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DOCS.split(", ")])

    return written(bpe_automaton.with_text(docs).mapInArrow(run, DOCS), texts=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: in how many rows of the input, summed over parts of bounded size."""

    def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, n = (np.concatenate(x) for x in zip(*parts))
        pair, at = np.unique(pair, return_inverse=True)
        return pair, np.bincount(at, n).astype(np.int64)

    def rows(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pair), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], ["pair", "n"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        pair, n = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        held.append((pair, n))
        size += len(pair)
        if size > 4 << 20:
            held = [told(held)]
            size = len(held[0][0])
            if size > 2 << 20:
                yield from rows(*held.pop())
                size = 0
    if held:
        yield from rows(*told(held))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of every linked pair of ids: pair, a, n (documents that hold it), best (no pair of its A id has more)."""
    ship(aligned.sparkSession)
    parts = aligned.select("pairs").mapInArrow(_counts, "pair long, n long")
    pairs = written(parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", B_BITS)))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return written(pairs.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent(pairs: DataFrame, most: int = HOT) -> tuple[DataFrame, DataFrame]:
    """pairs in two: the most frequent, at most most of them, and the others. Cut at a step of an eighth of a doubling, so ties stay together."""
    step = F.floor(8 * F.log2("n"))
    per = sorted(((r["step"], r["rows"]) for r in pairs.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    room, cut = most, None
    for s, rows in per:
        if rows > room:
            break
        room, cut = room - rows, s
    return (pairs.limit(0), pairs) if cut is None else (pairs.where(step >= cut), pairs.where(step < cut))


def link_sums(aligned: DataFrame, pairs: DataFrame, hot: int = HOT) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of aligned.

    n_best: links whose pair is best; count_sum: the pairs' n over all links.
    """
    spark = aligned.sparkSession
    many, few = frequent(pairs, hot)
    sent = many.select("pair", "n", "best").toArrow()
    order = np.argsort(sent["pair"].to_numpy())
    table = spark.sparkContext.broadcast(tuple(sent[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            links, times = batch.column("pairs"), batch.column("times")
            ends = links.offsets.to_numpy().astype(np.int64)
            ends, key, time = ends - ends[0], links.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            hit = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            at = at[hit]
            gain, won, rest = (np.zeros(len(key) + 1, np.int64) for _ in range(3))
            gain[1:][hit], won[1:][hit], rest[1:][~hit] = n[at] * time[hit], best[at] * time[hit], 1
            gain, won, rest = (np.cumsum(x)[ends] for x in (gain, won, rest))
            offsets = pa.array((rest - rest[0]).astype(np.int32))
            columns = [batch.column(c) for c in kept] + [pa.array(np.diff(won)), pa.array(np.diff(gain)), pa.ListArray.from_arrays(offsets, pa.array(key[~hit])), pa.ListArray.from_arrays(offsets, pa.array(time[~hit]))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "won", "gain", "pairs", "times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    told = written(aligned.select(*kept, "pairs", "times").mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, won long, gain long, pairs array<long>, times array<long>"))
    left = told.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = left.join(few, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("gain_few"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("won_few"))
    out = told.drop("pairs", "times").join(met, "row", "left")
    return out.select(*kept[:6], (F.col("won") + F.coalesce("won_few", F.lit(0))).alias("n_best"), (F.col("gain") + F.coalesce("gain_few", F.lit(0))).alias("count_sum"), "groups")


def digest(docs: DataFrame, a: str, b: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs."""
    aligned = alignments(docs, a, b, hashed=True)
    return link_sums(aligned, pair_counts(aligned), hot).drop("row").withColumnRenamed("groups", "groups_sha256")
