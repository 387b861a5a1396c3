"""Byte-level BPE by a deterministic tokenization automaton.

The automaton reads tokens, not bytes: its arcs are labelled by the bytes of a
token, and it accepts a row of tokens only if BPE makes exactly this row of
the bytes they spell. It starts as one state that takes any byte. A gadget for
each merge (a, b) -> c, in the order of the merges, then

    adds an arc c wherever a could be followed by b,
    lets c lead where b leads, and
    takes the arc b away after a.

So c's state begins as a copy of b's, c can follow whatever a can follow, and
a state is the token last read. Arcs that are missing are kept as ranges:
tokens are numbered so that a token's successors by merges on its right side
(c after a) follow it, the oldest first; what a gadget takes away from a state
is then b itself and the end of b's range, all made of b later on.

Encoding a pre-split word means finding the one accepted path whose labels
spell it; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cached, ship

#: Words whose tokens a worker remembers, and the longest such word.
REMEMBERED, WORD = 400_000, 48
#: Bytes of text that are encoded before a batch goes back to Spark.
SLICE = 2 << 20
# The pre-tokenizer's expression, and the same for texts of ASCII only.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are token ids and, before the first arc, -1.

    merges: (a, b, c) in order, ids below len(labels); roots: the ids of
    single bytes. A merge whose pair no accepted row holds has no effect, as in BPE.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], roots: list[int]) -> None:
        n = len(labels)
        self.labels = labels
        age: dict[int, int] = {}
        grown: list[array] = [array("i") for _ in range(n)]
        for r, (a, _, c) in enumerate(merges):
            if c not in age:  # a result spelt by two merges is numbered below the first
                age[c] = r
                grown[a].append(c)
        self.order, end, at = array("i", [-1]) * n, array("i", [0]) * n, 0
        for root in roots:
            stack = [(root, False)]
            while stack:
                u, done = stack.pop()
                if done:
                    end[u] = at
                    continue
                self.order[u], at = at, at + 1
                stack.append((u, True))
                stack += [(k, False) for k in reversed(grown[u])]
        missing: list[array] = [array("i") for _ in range(n)]
        live = set(roots)
        for r, (a, b, c) in enumerate(merges):
            o = self.order[b]
            pairs = missing[a]
            if a not in live or b not in live or any(pairs[i] <= o < pairs[i + 1] for i in range(0, len(pairs), 2)):
                continue
            if c in live:
                raise ValueError("two merges that both apply spell the same token")
            live.add(c)
            missing[c] = missing[b][:]
            later = bisect_left(grown[b], r, key=age.__getitem__)
            pairs.extend((o, o + 1) if later == len(grown[b]) else (o, o + 1, self.order[grown[b][later]], end[b]))
        self.first, self.low, self.high = array("i", [0]), array("i"), array("i")
        for pairs in missing:
            ranges = sorted(zip(pairs[::2], pairs[1::2]))
            for lo, hi in ranges:
                if len(self.low) > self.first[-1] and lo <= self.high[-1]:
                    self.high[-1] = max(self.high[-1], hi)
                else:
                    self.low.append(lo)
                    self.high.append(hi)
            self.first.append(len(self.low))
        self.tokens = {labels[u]: u for u in live}
        self.longest = max(map(len, self.tokens))
        #: Trie of the labels: a node has the next bytes' nodes and, at -1, the token that ends there.
        self.trie: dict = {}
        for label, u in self.tokens.items():
            node = self.trie
            for byte in label:
                node = node.setdefault(byte, {})
            node[-1] = u

    def follows(self, state: int, token: int) -> bool:
        """Whether an arc with this token leaves the state of a token."""
        o, a = self.order[token], self.first[state]
        i = bisect_right(self.low, o, a, self.first[state + 1])
        return i == a or self.high[i - 1] <= o

    def encode(self, word: bytes) -> list[int]:
        """The tokens of the one accepted path that spells word.

        Longest labels first; the path to a place is unique, so a place from
        which no arc leads on is never entered again. Linear in the bytes,
        times the length of the longest label at most.
        """
        whole = self.tokens.get(word)
        if whole is not None:  # a live token is the tokenization of its own bytes
            return [whole]
        labels, trie, follows, longest, size = self.labels, self.trie, self.follows, self.longest, len(word)
        path: list[int] = []
        choices: list[list[int]] = []
        dead: set[int] = set()
        at, state, back = 0, -1, False
        while at < size:
            if back:
                left = choices.pop()
            else:
                left, node = [], trie
                for byte in word[at : at + longest]:
                    node = node.get(byte)
                    if node is None:
                        break
                    if -1 in node:
                        left.append(node[-1])
            while left:
                u = left.pop()
                to = at + len(labels[u])
                if to not in dead and (state < 0 or follows(state, u)):
                    path.append(u)
                    choices.append(left)
                    at, state, back = to, u, False
                    break
            else:
                if not path:
                    raise ValueError("a byte that the vocabulary lacks")
                dead.add(at)
                at -= len(labels[path.pop()])
                state, back = path[-1] if path else -1, True
        return path


class Tokenizer:
    """A file's whole encoding: added tokens, pre-tokenizer, automaton; and its decoding.

    plain: the added tokens' strings inside a text are ordinary text.
    """

    def __init__(self, spec: dict, plain: bool = False) -> None:
        self.alphabet = byte_alphabet()
        vocab = spec["vocab"]
        added = {t["content"]: t["id"] for t in spec["added"]}
        labels = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            labels[i] = bytes(map(self.alphabet.__getitem__, token))
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["merges"]]
        self.automaton = Automaton(labels, merges, [i for t, i in vocab.items() if len(t) == 1])
        self.labels = [*labels]
        for token, i in added.items():
            self.labels[i] = token.encode()
        self.added = {} if plain else added
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.split, self.split_ascii = regex.compile(SPLIT).findall, re.compile(SPLIT_ASCII, re.A).findall
        self.words: dict[str, list[int]] = {}

    def _library_split(self, text: str) -> list[bytes]:
        from tokenizers.pre_tokenizers import ByteLevel

        return [bytes(map(self.alphabet.__getitem__, w)) for w, _ in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def _part(self, text: str, out: list[int]) -> None:
        words, known = (self.split_ascii if text.isascii() else self.split)(text), self.words
        start = len(out)
        for w in words:
            try:
                out += known[w]
            except KeyError:
                if not w.isascii() and any(unicodedata.category(c) == "Cn" for c in w):
                    # Of characters newer than the library's tables its own splitter decides, for this text.
                    del out[start:]
                    for b in self._library_split(text):
                        out += self.automaton.encode(b)
                    return
                ids = self.automaton.encode(w.encode())
                if len(w) <= WORD and len(known) < REMEMBERED:
                    known[w] = ids
                out += ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            self._part(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        self._part(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, as UTF-8; bytes that are none become U+FFFD. Ids without a label are left out."""
        labels = self.labels
        return b"".join([labels[i] for i in ids if 0 <= i < len(labels)]).decode("utf-8", "replace")


def read_spec(path: str) -> dict:
    """Vocabulary, merges and added tokens of a tokenizer file that this module can follow; ValueError for others.

    Followed: byte-level BPE split by the library's own expression, without
    normalizer, prefix space, dropout, affixes or post-processor, all bytes in
    the vocabulary, added tokens without options. Truncation and padding are
    not used.
    """
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre, model, added = t.get("pre_tokenizer") or {}, t.get("model") or {}, t.get("added_tokens") or []
    fits = not t.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    fits = fits and (t.get("decoder") or {}).get("type") == "ByteLevel" and model.get("type") == "BPE"
    fits = fits and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    fits = fits and all(a["content"] and not any(a.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for a in added)
    fits = fits and set(byte_alphabet()) <= set(model.get("vocab", ()))
    if not fits:
        raise ValueError("not a plain byte-level BPE file")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "added": added}


def tokenizer_for(path: str, plain: bool = False) -> Tokenizer:
    """This process's tokenizer; a worker compiles it once and keeps it from task to task."""
    return cached(("automaton", path, plain), lambda: Tokenizer(read_spec(path), plain))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of about SLICE bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """doc_id, ids array<int> and decoded string (the text that the ids give) of every row of docs.

    path: a tokenizer file that read_spec() follows and every executor has.
    Null texts are empty; empty texts have no ids and decode to the empty
    text. Null and repeated doc_ids and repeated rows stay as rows of their
    own; other columns are ignored. An empty table gives none. Texts are
    encoded whole, whatever their length.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_for(path, plain)
        for batch in batches:
            for some in slices(batch):
                flat, offsets, texts = array("i"), [0], []
                for text in some.column("text").to_pylist():
                    ids = t.encode(text or "")
                    flat.extend(ids)
                    offsets.append(len(flat))
                    texts.append(t.decode(ids))
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), column, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return with_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of tokens (doc_id, ids); null ids give the empty text."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_for(path)
        for batch in batches:
            texts = [t.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs, from round_trip()."""
    rows = round_trip(docs, path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
