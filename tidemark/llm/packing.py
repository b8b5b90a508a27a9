"""Packing: concatenate and cut.

Documents are tokenised once, in the order of the scan, and their ids kept in a scratch table with
running sums within each partition. Sums of partitions give each document's global offset, and
fixed windows of that axis are the sequences; a document over a boundary has a piece on either side.
Only the last sequence can have padding.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, in_arrow, slices, span_hashes, spans, text_or_empty
from .sharding import RUNNING, global_offsets, running

LENGTH = 4096
END_ID = 2
#: Entries of a worker's cache of words; when there are more, the half that is used most stays.
CACHE = 300_000
#: Seed of the words' second hash.
SECOND = 0x2545F4914F6CDD1D


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fast_merges(path: str):
    """The file's merges for tiktoken, which encodes a single piece several times faster than tokenizers does.

    Ids of this kind of vocabulary are in the order of its merges, those of a byte that ends a word
    before all others, so ids are ranks. The end of a word is written as byte 255, which no UTF-8 has.
    None for a vocabulary of another order.
    """
    import tiktoken

    vocab = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [i for i in range(256) if i not in set(plain)]
    byte = {chr(c): i for i, c in [*((i, i) for i in plain), *((i, 256 + n) for n, i in enumerate(others))]}
    ranks = {}
    for token, i in vocab.items():
        if not token.startswith("<|"):
            end = token.endswith("</w>") and len(token) > 4
            ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = i
    if sorted(len(t) for t, i in ranks.items() if i < 512) != [1] * 256 + [2] * 256 or len(ranks) != max(ranks.values()) + 1:
        return None
    return tiktoken.Encoding("words", pat_str="", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordEncoder:
    """ids of texts by a word-level BPE tokenizer, through a cache of words.

    No token of it spans white space, and neither composition nor lower-casing looks across it, so
    a text's ids are those of its words in turn. Words are known by 64-bit hashes of their bytes, taken
    from whole batches at once; only a word that the cache lacks becomes a Python object. A second,
    independent hash is compared for every word: a batch where it differs is encoded word by word. New words of plain Latin letters and signs
    are cut into the tokenizer's own pre-tokens, whose merges are then applied; any other is encoded whole.
    """

    _odd = re.compile(r"[^!-~À-ÖØ-öø-ā\n]|<\|")
    _pieces = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ā]+|[0-9]|[^a-z0-9ß-öø-ā\n]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._piece = _fast_merges(path)
        # Of each known word, by sorted hash: where its ids begin, how many there are, in how many batches it was.
        self._keys, self._seconds = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._starts, self._sizes, self._uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """ids of each word."""
        joined = b"\n".join(words).decode("utf-8", "replace")
        texts = joined.split("\n")
        if self._piece is None:
            odd = list(range(len(texts)))
        else:
            odd = np.unique(np.searchsorted(np.cumsum([len(w) + 1 for w in texts]), [m.start() for m in self._odd.finditer(joined)], "right")).tolist()
        whole, plain = [texts[i] for i in odd], joined
        if odd:
            for i in odd:
                texts[i] = ""
            plain = "\n".join(texts)
        out: list[list[int]] = []
        if self._piece is not None:
            piece, own, known = self._piece, [], {}
            for p in self._pieces.findall(plain.lower()):
                if p == "\n":
                    out.append(own)
                    own = []
                    continue
                ids = known.get(p)
                if ids is None:
                    ids = known[p] = piece(p.encode() + b"\xff")
                own = own + ids if own else ids
            out.append(own)
        else:
            out = [[] for _ in words]
        for at in range(0, len(whole), 2000):
            for i, e in zip(odd[at : at + 2000], self._t.encode_batch_fast(whole[at : at + 2000], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, seconds: np.ndarray, words: list[bytes]) -> None:
        got = self._encoded(words)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        starts = len(self._flat) + np.cumsum(sizes) - sizes
        self._flat = np.concatenate([self._flat, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum()))])
        order = np.argsort(merged := np.concatenate([self._keys, keys]), kind="stable")
        self._keys, self._seconds = merged[order], np.concatenate([self._seconds, seconds])[order]
        self._starts, self._sizes = np.concatenate([self._starts, starts])[order], np.concatenate([self._sizes, sizes])[order]
        self._uses = np.concatenate([self._uses, np.zeros(len(keys), np.int64)])[order]

    def _thin(self) -> None:
        """Leaves half of CACHE, the words used most."""
        keep = np.zeros(len(self._keys), bool)
        keep[np.argsort(-self._uses, kind="stable")[: CACHE // 2]] = True
        starts, sizes = self._starts[keep], self._sizes[keep]
        fresh = np.cumsum(sizes) - sizes
        self._flat = self._flat[np.repeat(starts - fresh, sizes) + np.arange(sizes.sum())]
        self._keys, self._seconds, self._starts, self._sizes, self._uses = self._keys[keep], self._seconds[keep], fresh, sizes, self._uses[keep] // 2

    def ids(self, texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's followed by end; and where each text's begin, one entry more."""
        data, starts, stops, at = spans(texts)
        words, which = distinct(span_hashes(data, starts, stops, fold=False))
        seconds = span_hashes(data, starts, stops, fold=False, seed=SECOND)
        if len(self._keys) > CACHE:
            self._thin()
        row = np.searchsorted(self._keys, words)
        new = np.flatnonzero(self._keys[np.minimum(row, len(self._keys) - 1)] != words) if len(self._keys) else np.arange(len(words))
        if len(new):
            first = np.empty(len(words), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            first = first[new]
            raw = data.tobytes()
            self._learn(words[new], seconds[first], [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())])
            row = np.searchsorted(self._keys, words)
        self._uses[row] += 1
        row = row[which]
        flat = self._flat
        if (self._seconds[row] == seconds).all():
            begins, sizes = self._starts[row], self._sizes[row]
        else:
            raw = data.tobytes()
            own = self._encoded([raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            begins, flat = np.cumsum(sizes) - sizes, np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(begins - upto[:-1], sizes)
        places += np.arange(len(places))
        bounds = upto[at] + np.arange(len(at))
        out = np.empty(bounds[-1], np.uint32)
        own = np.ones(len(out), bool)
        own[bounds[1:] - 1] = False
        out[own] = flat[places]
        out[bounds[1:] - 1] = end
        return out, bounds


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """key, n (tokens with the end), ids as binary (unsigned 32-bit, little-endian), and the running sums of n, all in one pass of Python."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        enc = encoder(path)
        for b in slices(batches, 1):
            ids, at = enc.ids(b.column(1), end_id)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), packed], ["key", "n", "ids"])

    return in_arrow(docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(F.col(f"`{text}`").cast("string")).alias("text")), lambda batches: running(run(batches), "n"), f"key {kind}, n long, ids binary, {RUNNING}")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text is empty: its end alone. Rows repeated are packed each; a null key is kept. A text
    longer than a sequence fills several. An empty table gives an empty one; docs' other columns,
    whatever their names, don't matter.
    """
    kind = dict(docs.dtypes)[key]
    placed, _, _ = global_offsets(tokenised(docs, path or tokenizer_path(), key, text, end_id), "n", "tokens")
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, before = (b.column(i).to_numpy() for i in (1, 3))
            first = before // length
            pieces = (before + n - 1) // length - first + 1
            row = np.repeat(np.arange(b.num_rows), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(seq * length, before[row])
            size = np.minimum((seq + 1) * length, (before + n)[row]) - begin
            start = begin - before[row]
            ids = b.column(2)
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids)].astype(np.int64)
            raw = memoryview(ids.buffers()[2])
            low = at[row] + 4 * start
            cuts = [raw[x:y] for x, y in zip(low.tolist(), (low + 4 * size).tolist())]
            cols = [start, size, np.fromiter(map(zlib.crc32, cuts), np.int64, len(cuts)), n[row], seq, begin - seq * length]
            more = [pa.array([bytes(c) for c in cuts], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, cols), *more], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return in_arrow(placed.select("key", "n", "ids", "__before"), cut, schema).withColumnRenamed("key", key)
