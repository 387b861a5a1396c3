"""The best sentences of every (claim, document), where the documents lie.

Every document is a corpus of its own, so once its sentences stand together
nothing has to be shuffled: the claims' terms, a table of bounded size, go to
all tasks, and each batch of whole documents is scored as arrays. Pairs of
claim and sentence are cells of an array; only the best n leave a task.
Statistics, weights and rounding are those of `retrieval`'s joined form, which
serves more claims than can be sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells, and meetings of a claim's term with a sentence's, that are held at once; claims are taken in parts for it.
CELLS = 1 << 20


@dataclass
class Terms:
    """The claims' terms by claim: names of the distinct terms, and rows (claim, term, qf) with claim ascending; q2 per claim."""

    names: pa.Array
    claim: np.ndarray
    term: np.ndarray
    qf: np.ndarray
    q2: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, ids: pa.Array) -> Terms:
        claim = pc.index_in(rows["claim_id"], value_set=ids).to_numpy().astype(np.int64)
        coded = rows["term"].combine_chunks().dictionary_encode()
        order = np.argsort(claim, kind="stable")
        qf = rows["qf"].to_numpy().astype(np.int64)
        return cls(coded.dictionary, claim[order], coded.indices.to_numpy().astype(np.int64)[order], qf[order], np.bincount(claim, qf * qf, len(ids)))


class Postings:
    """Distinct terms of each sentence that has any: row (sentence), f, and by document df; own: the claims' number of the term, -1 for none."""

    def __init__(self, lists: pa.ListArray, doc: np.ndarray, names: pa.Array) -> None:
        self.len = np.diff(lists.offsets.to_numpy().astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        n_terms = max(len(coded.dictionary), 1)
        each = np.repeat(np.arange(len(self.len)), self.len) * n_terms + coded.indices.to_numpy().astype(np.int64)
        key, self.f = np.unique(each, return_counts=True)
        self.row, code = key // n_terms, key % n_terms
        self.doc = doc[self.row]
        terms, self.at, df = np.unique(self.doc * n_terms + code, return_inverse=True, return_counts=True)
        self.df, self.doc_of_term, self.df_of_term = df[self.at], terms // n_terms, df
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.own = found[code] if len(key) else np.zeros(0, np.int64)


def _bm25_parts(p: Postings, doc: np.ndarray, n_docs: int, k1: float, b: float, epsilon: float) -> np.ndarray:
    n = np.bincount(doc[p.len > 0], minlength=n_docs)
    with np.errstate(divide="ignore", invalid="ignore"):
        avgdl = np.bincount(doc, p.len, n_docs) / n
    idf = np.log(n[p.doc_of_term] - p.df_of_term + 0.5) - np.log(p.df_of_term + 0.5)
    mean = np.bincount(p.doc_of_term, idf, n_docs) / np.maximum(np.bincount(p.doc_of_term, minlength=n_docs), 1)
    weight = np.where(idf < 0, epsilon * mean[p.doc_of_term], idf)[p.at]
    return weight * p.f * (k1 + 1) / (p.f + k1 * (1 - b + b * p.len[p.row] / avgdl[p.doc]))


class Batch:
    """Whole documents: doc (number of each sentence's document), cell (of its doc and sent_ix, ascending), start (first cell of each document)."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        coded = batch.column("doc_id").dictionary_encode(null_encoding="encode")
        self.ids, self.doc = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        ix = batch.column("sent_ix").to_numpy().astype(np.int64)
        cells, self.cell = np.unique(self.doc << 32 | ix, return_inverse=True)
        self.cell_doc, self.cell_ix = cells >> 32, cells & 0xFFFFFFFF
        self.n_docs, self.n_cells = len(self.ids), len(cells)
        self.start = np.searchsorted(self.cell_doc, np.arange(self.n_docs))


class Meetings:
    """The rows of postings that meet terms of the claims from lo up to hi."""

    def __init__(self, p: Postings, terms: Terms, lo: int, hi: int) -> None:
        x, y = np.searchsorted(terms.claim, [lo, hi])
        order = x + np.argsort(terms.term[x:y], kind="stable")
        first = np.searchsorted(terms.term[order], np.arange(len(terms.names) + 1))
        mine = np.flatnonzero(p.own >= 0)
        n = np.diff(first)[p.own[mine]]
        self.post = np.repeat(mine, n)
        at = np.arange(len(self.post)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[p.own[mine]], n)
        self.claim, self.qf = terms.claim[order][at] - lo, terms.qf[order][at]


def _widths(p: Postings, terms: Terms, n_cells: int, n_claims: int) -> int:
    """How many claims are taken at once."""
    met = np.bincount(terms.term, minlength=len(terms.names))[p.own[p.own >= 0]].sum()
    return int(max(1, min(n_claims, n_claims * CELLS // max(int(met), n_cells * n_claims, 1))))


def _best(scores: np.ndarray, b: Batch, n: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of scores (cell, claim) the n best positive of each document and claim, ties to the later: claim, cell, score times scale, rank."""
    with np.errstate(invalid="ignore"):
        units = np.floor(scores * scale + 0.5)
    key = np.where(units > 0, units, -1).astype(np.int64) * b.n_cells + np.arange(b.n_cells)[:, None]
    out = []
    for rank in range(1, n + 1):
        top = np.maximum.reduceat(key, b.start, axis=0)
        doc, claim = np.nonzero(top >= b.n_cells)
        top = top[doc, claim]
        cell = top % b.n_cells
        key[cell, claim] = -1
        out.append((claim, cell, top // b.n_cells, np.full(len(cell), rank)))
    return tuple(np.concatenate(x) for x in zip(*out))


def bm25(lists: pa.ListArray, b: Batch, terms: Terms, n: int, scale: int, k1: float, b_len: float, epsilon: float) -> Iterator[tuple[np.ndarray, ...]]:
    p, n_claims = Postings(lists, b.doc, terms.names), len(terms.q2)
    part, width = _bm25_parts(p, b.doc, b.n_docs, k1, b_len, epsilon), _widths(p, terms, b.n_cells, n_claims)
    for lo in range(0, n_claims, width):
        m, w = Meetings(p, terms, lo, lo + width), min(width, n_claims - lo)
        scores = np.bincount(b.cell[p.row[m.post]] * w + m.claim, m.qf * part[m.post], b.n_cells * w).reshape(b.n_cells, w)
        claim, *rest = _best(scores, b, n, scale)
        yield claim + lo, *rest


def tfidf(lists: pa.ListArray, b: Batch, terms: Terms, n: int, scale: int) -> Iterator[tuple[np.ndarray, ...]]:
    p, n_claims = Postings(lists, b.doc, terms.names), len(terms.q2)
    size = np.bincount(b.doc, minlength=b.n_docs)
    # a term's weight depends on whether the claim has it
    without, having = (np.log((2 + size[p.doc]) / (1 + p.df + has)) + 1 for has in (0, 1))
    alone, shared = p.f * without, p.f * having
    s2 = np.bincount(b.cell[p.row], alone * alone, b.n_cells)
    absent, width = np.log((2 + size) / 2.0) + 1, _widths(p, terms, b.n_cells, n_claims)
    for lo in range(0, n_claims, width):
        m, w = Meetings(p, terms, lo, lo + width), min(width, n_claims - lo)
        at, pair = b.cell[p.row[m.post]] * w + m.claim, p.doc[m.post] * w + m.claim
        dot = np.bincount(at, (shared * having)[m.post] * m.qf, b.n_cells * w).reshape(b.n_cells, w)
        change = np.bincount(at, (shared * shared - alone * alone)[m.post], b.n_cells * w).reshape(b.n_cells, w)
        # the claim's norm in a document: over its postings a met term counts once; words the document lacks have df 0
        q2 = m.qf * m.qf
        in2 = np.bincount(pair, q2 * (having * having / p.df)[m.post], b.n_docs * w).reshape(b.n_docs, w)
        inq = np.bincount(pair, q2 / p.df[m.post], b.n_docs * w).reshape(b.n_docs, w)
        c2 = in2 + np.round(terms.q2[lo : lo + w] - inq) * (absent * absent)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = dot / np.sqrt((s2[:, None] + change) * c2[b.cell_doc])
        claim, *rest = _best(scores, b, n, scale)
        yield claim + lo, *rest


def fused(t: tuple[np.ndarray, ...], s: tuple[np.ndarray, ...], b: Batch, texts: pa.Array, n: int, scale: int, share: float) -> tuple[np.ndarray, ...]:
    """The rows of TF-IDF (t) and BM25 (s) by equal sentence: claim, row of the batch, sent_ix, both scores, combined, rank."""
    claim, cell, units, rank = (np.concatenate(x) for x in zip(t, s))
    by = np.repeat([0, 1], [len(t[0]), len(s[0])])
    # rows of one doc_id may share a sent_ix: every one of them counts
    rows = np.argsort(b.cell, kind="stable")
    n_rows = np.bincount(b.cell, minlength=b.n_cells)
    first, times = (np.cumsum(n_rows) - n_rows)[cell], n_rows[cell]
    row = rows[np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    claim, cell, units, rank, by = (np.repeat(x, times) for x in (claim, cell, units, rank, by))
    text, doc = texts.dictionary_encode().indices.to_numpy().astype(np.int64)[row], b.cell_doc[cell]
    order = np.lexsort((rank, by, text, doc, claim))
    claim, cell, units, rank, by, row, text, doc = (x[order] for x in (claim, cell, units, rank, by, row, text, doc))
    new = np.ones(len(claim), bool)
    new[1:] = (claim[1:] != claim[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return claim, row, cell, units * 1.0, units * 1.0, units * 1.0, rank
    n_t, score = np.add.reduceat(by == 0, at, dtype=np.int64), units / scale
    tf = np.where(n_t > 0, score[at + np.maximum(n_t, 1) - 1], 0.0)
    bm = np.add.reduceat(np.where(by == 1, score, 0.0), at)
    ix = np.minimum.reduceat(b.cell_ix[cell], at)
    place = np.where(n_t > 0, 0, 1_000) + rank[at]
    sums = np.floor((share * tf + bm) * scale + 0.5)
    claim, doc, row = claim[at], doc[at], row[at]
    order = np.lexsort((place, -sums, doc, claim))
    claim, doc, row, ix, tf, bm, sums = (x[order] for x in (claim, doc, row, ix, tf, bm, sums))
    new = np.ones(len(claim), bool)
    new[1:] = (claim[1:] != claim[:-1]) | (doc[1:] != doc[:-1])
    rank = np.arange(len(claim)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    few = rank <= n
    return tuple(x[few] for x in (claim, row, ix, tf, bm, sums / scale, rank))


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, in which a document's rows follow each other, cut so that each holds whole documents."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        last = int(np.flatnonzero(ids == ids[-1])[0])
        if last or (held and held[-1].column("doc_id")[-1].as_py() != batch.column("doc_id")[0].as_py()):
            # a document that has begun before this batch ends in it, before its last one begins
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
