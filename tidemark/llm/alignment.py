"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids then meet how often.

1. Each text is encoded by both; byte offsets where tokens of both end cut them into groups, and the last two
   tokens of a group are linked. A linked pair of ids is packed into one 64-bit key, b's id above a's.
2. Each task counts its keys with np.unique; the counts are range-partitioned by key, sorted, and runs of a key
   summed: each partition is a shard of the sorted table of counts.
3. Shards reach executors as files and are memory-mapped there; each text's keys are looked up by binary search.
   A key is known by the shard's first keys, and the table can't outgrow the product of the vocabularies.

A text is encoded in segments, cut at single spaces between two characters that aren't white space: no token of
either tokenizer spans such a place (checked against the vocabulary), so the tokens of a text are those of
its segments, and a segment that was seen before needn't be encoded again. New segments are encoded many
at a time, as one text, and their groups found by arrays; a's plain Latin ones by `tiktoken` with the
file's own vocabulary, whose ids are the order of its merges (checked as well).
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import os
import re
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, save, slices

#: Segments that a worker remembers, twice, and characters that such a segment has at most.
CACHE, LONGEST = 150_000, 64
#: Characters of a text that are cut at once, and segments that are encoded as one text.
WINDOW, TOGETHER = 1 << 18, 500
#: Keys that a task gathers before it counts them.
GATHER = 4_000_000


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {chr(i): i for i in plain} | {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in plain)}


class Pair:
    """A byte-level BPE of `tokenizers` (a) and a piece model of `sentencepiece` (b), side by side.

    a encodes a space and the text; b puts a space before the text itself.
    """

    _cut = re.compile(r" (?<=\S )(?=\S)")
    #: Characters that every version of Unicode takes alike go through tiktoken.
    _odd = re.compile(r"[^\n -~À-ÖØ-öø-ſ]")

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self._a.encode_special_tokens = True
        letters = _letters()
        vocab = self._a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bits = (len(self.a_bytes) - 1).bit_length()
        self.wide = (len(pieces) << self.bits) > 1 << 32
        # A space inside a piece, or a normaliser, could reach over a cut.
        same = "a  b　cﬁ\t d"
        self._cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self._b.decode(self._b.encode(same)) == same and self._pre_tokens_keep_spaces()
        self._fast = self._by_ranks(a_path) if self._cuts else None
        # Each id as it is written in groups: with a comma, or with what ends its side of the group.
        inner, last = ([f"{i}{sep}" for n, sep in pairs for i in range(n)] for pairs in (((len(self.a_bytes), ","), (len(pieces), ",")), ((len(self.a_bytes), "|"), (len(pieces), ";"))))
        self._names = np.array(inner + last, object)
        self._name_sizes = np.fromiter(map(len, inner + last), np.int64, len(inner + last))
        self._a_sizes, self._b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        if not self._a_sizes.all() or not self._b_sizes.all():
            raise ValueError("a token without bytes ends where the one before does")
        self._new: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}

    def _pre_tokens_keep_spaces(self) -> bool:
        """Whether a's pieces of text, before any merge, never go on over a space."""
        if self._a.normalizer is not None or self._a.pre_tokenizer is None:
            return False
        cut = self._a.pre_tokenizer.pre_tokenize_str(" it's 12 a, é、 ?! b\nc d")
        return all("Ġ" not in p.lstrip("ĠĊ") for p, _ in cut) and len(cut) > 8

    @property
    def key_type(self) -> str:
        return "<i8" if self.wide else "<u4"

    def _by_ranks(self, path: str):
        """a for tiktoken, if its ids are ranks: bytes first, then merges in their order. Else None."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        split = file.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or len(vocab) != 256 + len(merges):
            return None
        if any(vocab.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values()}, special_tokens={})

    def _encode(self, segments: list[str]) -> list[tuple]:
        """A record of each segment: its groups as text, packed keys as bytes, n_a << 32 | n_b, and b's bytes where they aren't its own (else None)."""
        out: list = [None] * len(segments)
        kinds: dict[bool, list[int]] = {}
        for i, s in enumerate(segments):
            kinds.setdefault(self._fast is not None and not self._odd.search(s), []).append(i)
        for fast, places in kinds.items():
            for low in range(0, len(places), TOGETHER):
                some = places[low : low + TOGETHER]
                texts = [segments[i] for i in some]
                for i, r in zip(some, self._together(texts, fast) or (self._alone(t) for t in texts)):
                    out[i] = r
        return out

    def _together(self, segments: list[str], fast: bool) -> list[tuple] | None:
        """Records of segments encoded as one text; None where some aren't given back, or segments aren't such as may stand in one."""
        if not self._cuts or any(s[:1].isspace() or s[-1:].isspace() or not s for s in segments):
            return None
        whole = " ".join(segments)
        a = np.array(self._fast.encode_ordinary(" " + whole) if fast else self._a.encode(" " + whole, add_special_tokens=False).ids, np.int64)
        b = np.array(self._b.encode(whole), np.int64)
        want = (" " + whole).encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != want or b"".join([self.b_bytes[i] for i in b.tolist()]) != want:
            return None
        end_a, end_b = np.cumsum(self._a_sizes[a]), np.cumsum(self._b_sizes[b])
        cuts, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        keys = (b[last_b] << self.bits | a[last_a]).astype(self.key_type).tobytes()
        # A group's tokens of a are followed by its tokens of b.
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        order = np.empty(len(a) + len(b), np.int64)
        up_to = lambda last: np.concatenate([[0], last + 1])
        order[np.arange(len(a)) + up_to(last_b)[group_a]] = a + len(self._names) // 2 * (end_a == cuts[group_a])
        order[np.arange(len(b)) + up_to(last_a)[group_b + 1]] = b + len(self.a_bytes) + len(self._names) // 2 * (end_b == cuts[group_b])
        text, places = "".join(self._names[order].tolist()), np.concatenate([[0], np.cumsum(self._name_sizes[order])])
        # Segments end at cuts.
        ends = np.cumsum([len(s.encode()) + 1 for s in segments])
        at = np.concatenate([[0], np.searchsorted(cuts, ends) + 1])
        of_a, of_b = up_to(last_a)[at], up_to(last_b)[at]
        written, width = places[of_a + of_b].tolist(), np.dtype(self.key_type).itemsize
        sizes = ((of_a[1:] - of_a[:-1]) << 32 | (of_b[1:] - of_b[:-1])).tolist()
        links = (at * width).tolist()
        return [(text[t : u - 1], keys[k:m], n, None) for t, u, k, m, n in zip(written, written[1:], links, links[1:], sizes)]

    def _alone(self, segment: str) -> tuple:
        """The record of one segment, or of a whole text."""
        a, b = self._a.encode(" " + segment, add_special_tokens=False).ids, self._b.encode(segment)
        of_a, of_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        want, own = b" " + segment.encode(), b"".join(of_b)
        if own != want or b"".join(of_a) != want:
            return "", b"", 0, own if own != want else b""
        ends = [list(itertools.accumulate(map(len, x))) for x in (of_a, of_b)]
        groups, keys, i0, j0 = [], [], 0, 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            i, j = bisect.bisect_right(ends[0], end), bisect.bisect_right(ends[1], end)
            groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
            keys.append(b[j - 1] << self.bits | a[i - 1])
            i0, j0 = i, j
        return ";".join(groups), np.array(keys, self.key_type).tobytes(), len(a) << 32 | len(b), None

    def _known(self, segments: list[str]) -> list[tuple]:
        new = self._new
        missing = [s for s in dict.fromkeys(segments) if s not in new]
        if missing:
            lacking = []
            for s in missing:
                found = self._old.get(s)
                if found is None:
                    lacking.append(s)
                else:
                    new[s] = found
            new.update(zip(lacking, self._encode(lacking)))
        found = [new[s] for s in segments]
        for s in missing:
            if len(s) > LONGEST:
                del new[s]
        if len(new) > CACHE:
            self._old, self._new = new, {}
        return found

    def _windows(self, text: str):
        """The text's segments in lists: all between two cuts, about WINDOW characters a list."""
        if not self._cuts:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = self._cut.search(text, at + WINDOW)
            yield self._cut.split(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)

    def align(self, texts: list[str | None]):
        """Of each text: the groups (parts to be joined by `;`), packed keys, and numbers of a's and b's tokens; nothing where either changes the text."""
        cut = [list(self._windows(t or "")) if len(t or "") <= WINDOW else None for t in texts]
        self._known([s for windows in cut if windows for segments in windows for s in segments if len(s) <= LONGEST])
        for text, windows in zip(texts, cut):
            yield self._one(text or "", self._windows(text) if windows is None else windows)

    def _one(self, text: str, windows) -> tuple[list[str], bytes, int, int]:
        groups, keys, both, odd = [], [], 0, False
        for segments in windows:
            found = self._known(segments)
            odd = odd or any([r[3] is not None for r in found])
            groups.append(";".join([r[0] for r in found]))
            keys.append(b"".join([r[1] for r in found]))
            both += sum([r[2] for r in found])
        if odd:
            return self._unlike(text)
        return groups, b"".join(keys), both >> 32, both & 0xFFFFFFFF

    def _unlike(self, text: str) -> tuple[list[str], bytes, int, int]:
        """Some segment isn't given back by a tokenizer: the text has no tokens, unless others make up for it."""
        own = b"".join(b" " + s.encode() if r[3] is None else r[3] for segments in self._windows(text) for s, r in zip(segments, self._known(segments)))
        if own == b" " + text.encode():
            whole = self._alone(text)
            if whole[3] is None:
                return [whole[0]], whole[1], whole[2] >> 32, whole[2] & 0xFFFFFFFF
        return [], b"", 0, 0


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One for each worker process and pair of files."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """key, n_a, n_b, n_groups, groups_sha256, keys (packed, one for each link) and, if asked for, groups as text."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        both = pair(a_path, b_path)
        width = np.dtype(both.key_type).itemsize
        for b in slices(batches, 1):
            rows = []
            for groups, keys, n_a, n_b in both.align(b.column(1).to_pylist()):
                digest = hashlib.sha256()
                for i, g in enumerate(groups):
                    digest.update((";" * (i > 0) + g).encode())
                rows.append((n_a, n_b, len(keys) // width, digest.hexdigest() if groups else "", keys, ";".join(groups) if with_groups else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())[: 5 + with_groups]
            names = ["n_a", "n_b", "n_groups", "groups_sha256", "keys", "groups"][: 5 + with_groups]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["key", *names])

    schema = f"key {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, keys binary" + ", groups string" * with_groups
    return in_arrow(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")), run, schema)


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """All keys of the rows, one row after another."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind).astype(np.int64)


def counts(found: DataFrame, kind: str) -> DataFrame:
    """(pair, n), sorted over the whole table, saved: each file is a shard."""

    def partial(batches):
        held, size = [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

        for b in slices(batches, 0):
            held.append(_unpacked(b.column(0), kind))
            size += len(held[-1])
            if size >= GATHER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def summed(batches):
        """Of sorted rows, each key once; the last key of a batch may go on in the next."""
        last, n_last = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            begins = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            own, total = keys[begins], np.add.reduceat(n, begins)
            if last is not None and own[0] == last:
                total[0] += n_last
            elif last is not None:
                own, total = np.concatenate([[last], own]), np.concatenate([[n_last], total])
            last, n_last = int(own[-1]), int(total[-1])
            yield pa.RecordBatch.from_arrays([pa.array(own[:-1]), pa.array(total[:-1])], ["pair", "n"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([n_last], pa.int64())], ["pair", "n"])

    some = save(in_arrow(found.select("keys"), partial, "pair long, n long"), "partial-counts")
    return save(some.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(summed, "pair long, n long"), "counts")


class Shards:
    """The sorted table of counts on one machine: files of keys and of counts, memory-mapped."""

    def __init__(self, shards: list[tuple[int, str]]):
        """shards: the first key and the name of each file, sorted."""
        self.firsts = np.array([s[0] for s in shards], np.int64)
        self.maps = [tuple(np.load(p, mmap_mode="r") for p in self._files(SparkFiles.get(name))) for _, name in shards]

    @staticmethod
    def _files(path: str) -> list[str]:
        """The shard's columns as arrays beside it, made by whoever needs them first."""
        import pyarrow.parquet as pq

        out = [f"{path}.{c}.npy" for c in ("pair", "n")]
        if not all(map(os.path.exists, out)):
            rows = pq.read_table(path, columns=["pair", "n"])
            for c, p in zip(rows.columns, out):
                own = f"{p}.{os.getpid()}"
                with open(own, "wb") as f:
                    np.save(f, c.to_numpy())
                os.replace(own, p)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys, 0 for a key that isn't there."""
        out = np.zeros(len(keys), np.int64)
        borders = [*np.searchsorted(keys, self.firsts).tolist(), len(keys)]
        for (own, n), a, b in zip(self.maps, borders, borders[1:]):
            if a < b:
                at = np.minimum(np.searchsorted(own, keys[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == keys[a:b], n[at], 0)
        return out


def _handed_out(table: DataFrame) -> list[tuple[int, str]]:
    """The first key and file name of each shard; executors fetch the files from the shared folder."""
    files = table.select("pair", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.min("pair").alias("first")).collect()
    for r in files:
        where = urlparse(r.file)
        table.sparkSession.sparkContext.addFile(unquote(where.path) if where.scheme == "file" else r.file)
    return sorted((r.first, unquote(r.file).rpartition("/")[2]) for r in files)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    n_best: links whose pair is met as often as any with the same id of b. Null and empty texts, and those
    that either tokenizer doesn't give back byte for byte, have no tokens: zeros and empty strings. Strings
    like special tokens are text. A very long text is cut and encoded in windows, and aligned whole. Repeated
    rows count each; a null key is kept; an empty table gives an empty one; docs' other columns, whatever
    their names, don't matter.
    """
    a_path, b_path = a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")
    found = save(aligned(docs, a_path, b_path, key, text, with_groups), "aligned")
    by = pair(a_path, b_path)
    kind, bits = by.key_type, by.bits
    table = counts(found, kind)
    shards = _handed_out(table)
    highest = np.zeros(len(by.b_bytes), np.int64)  # as long as the vocabulary
    for r in table.groupBy(F.expr(f"cast(shiftright(pair, {bits}) as int)").alias("b")).agg(F.max("n").alias("n")).collect():
        highest[r.b] = r.n
    kind_of_key = dict(found.dtypes)["key"]
    more = ["groups"] if with_groups else []

    def run(batches):
        by_range = None
        for b in slices(batches, 5):
            by_range = by_range or Shards(shards)
            keys = _unpacked(b.column(5), kind)
            own, back = np.unique(keys, return_inverse=True)
            n = by_range.find(own)
            best = n == highest[own >> bits]
            upto = np.concatenate([[0], np.cumsum(b.column(3).to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x[back].astype(np.int64))]) for x in (best, n)]
            best, n = (pa.array(s[upto[1:]] - s[upto[:-1]]) for s in sums)
            cols = [b.column(0), b.column(1), b.column(2), b.column(3), b.column(3), best, n, b.column(4), *(b.column(6) for _ in more)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *more])

    schema = f"key {kind_of_key}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return in_arrow(found.select("key", "n_a", "n_b", "n_groups", "groups_sha256", "keys", *more), run, schema).withColumnRenamed("key", key)


def dictionary(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(b_id, a_id, n, best): how often two ids are linked in docs, and whether no id of a is linked more often with that id of b."""
    a_path, b_path = a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")
    by = pair(a_path, b_path)
    table = counts(save(aligned(docs, a_path, b_path, key, text), "aligned"), by.key_type)
    ids = table.select(F.expr(f"shiftright(pair, {by.bits})").alias("b_id"), F.col("pair").bitwiseAND((1 << by.bits) - 1).alias("a_id"), "n")
    return ids.join(F.broadcast(ids.groupBy("b_id").agg(F.max("n").alias("top"))), "b_id").select("b_id", "a_id", "n", (F.col("n") == F.col("top")).alias("best"))
