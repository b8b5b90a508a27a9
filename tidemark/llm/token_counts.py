"""Token counts that follow edits.

A document's state is a segment tree: leaves are runs of BLOCK pre-tokens with their characters and
tokens, inner nodes are sums. An edit finds its leaves from the root, cuts their text anew with a
little context before, stops at the first old boundary that is a boundary again, and replaces those
leaves; everything else stays, and sums on the paths to the root are brought up to date.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, text_or_empty

BLOCK = 64
#: Characters after a pre-token that can decide where it ends: a letter after an apostrophe, and
#: one after white space.
CONTEXT = 4
CACHE = 400_000


class Counter:
    """Numbers of tokens by a byte-level BPE, of whole pre-tokens, which are counted once each."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.pattern = public_tokenizers.PATTERN
        self.split = regex.compile(self.pattern)
        self.bpe = tiktoken.Encoding("counts", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self.bpe.encode_single_piece(p.encode("utf-8", "surrogatepass")))
        return list(map(known.__getitem__, pieces))

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each run of BLOCK pre-tokens."""
        pieces = self.split.findall(text)
        n = self.counts(pieces)
        at = range(0, len(pieces), BLOCK)
        return [sum(map(len, pieces[i : i + BLOCK])) for i in at], [sum(n[i : i + BLOCK]) for i in at]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tree:
    """A segment tree of (characters, tokens); a leaf is a list of runs, one at first."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self._fill([[(c, t)] for c, t in zip(chars, tokens)])

    def _fill(self, leaves: list[list[tuple[int, int]]]) -> None:
        self.width = 1
        while self.width < len(leaves):
            self.width *= 2
        self.leaf = leaves + [[] for _ in range(self.width - len(leaves))]
        self.sums = [(0, 0)] * (2 * self.width)
        for i, own in enumerate(self.leaf):
            self.sums[self.width + i] = (sum(c for c, _ in own), sum(t for _, t in own))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character, the last one for the end; and where it starts."""
        i, start = 1, 0
        while i < self.width:
            left = self.sums[2 * i][0]
            go = at - start >= left and self.sums[2 * i + 1][0] > 0
            start += left * go
            i = 2 * i + go
        return i - self.width, start

    def put(self, leaf: int, runs: list[tuple[int, int]]) -> None:
        self.leaf[leaf] = runs
        i = self.width + leaf
        self.sums[i] = (sum(c for c, _ in runs), sum(t for _, t in runs))
        while i > 1:
            i //= 2
            self._sum(i)

    def runs(self) -> list[tuple[int, int]]:
        return [r for own in self.leaf for r in own if r[0]]


def edit(text: str, tree: Tree, start: int, end: int, put: str, by: Counter) -> tuple[str, int]:
    """Replaces text[start:end]; the tree then counts the new text. Returns that, and the characters encoded anew."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    new, shift = text[:start] + put + text[end:], len(put) - (end - start)
    first, at = tree.find(max(0, start - CONTEXT))
    if at and at + CONTEXT > start - CONTEXT:  # the run before may end otherwise
        first, at = tree.find(max(0, at - 1 - CONTEXT))
    last, ends, stop = first, {}, at
    while True:  # old boundaries from the edit's end on
        stop += tree.sums[tree.width + last][0]
        if stop >= end + CONTEXT:
            ends[stop + shift] = last
        if stop >= len(text) or len(ends) >= 2 or last + 1 >= tree.width:
            break
        last += 1
    pieces, pos, met = [], at, None
    while met is None:
        for m in by.split.finditer(new, pos):
            pieces.append(m.group())
            pos = m.end()
            if pos in ends and pos < len(new):
                met = ends[pos]
                break
        else:
            met = tree.width - 1  # to the end of the text
        if met is None or pos >= len(new):
            met = tree.width - 1
    n = by.counts(pieces)
    runs = [(sum(map(len, pieces[i : i + BLOCK])), sum(n[i : i + BLOCK])) for i in range(0, len(pieces), BLOCK)]
    tree.put(first, runs)
    for i in range(first + 1, met + 1):
        if tree.leaf[i]:
            tree.put(i, [])
    if len(runs) > 8 or not tree.leaf[tree.width - 1] and tree.sums[1][0] == 0:
        tree._fill([[r] for r in tree.runs()])
    return new, pos - at


_LEAVES = "leaf_chars array<int>, leaf_tokens array<int>"


def count(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, text, n_chars, n_tokens and the tree's leaves (leaf_chars, leaf_tokens) of every row: the state that update() takes.

    Columns in keep ride along; they may not have these names. A null text is empty and has no tokens
    and no leaves. A very long text is counted whole. Repeated rows are counted each; an empty table
    gives an empty one; docs' other columns don't matter.
    """
    path, keep = path or ranks_path(), keep or []
    kinds = dict(docs.dtypes)
    cols = [F.col(f"`{key}`").alias("key"), text_or_empty(F.col(f"`{text}`").cast("string")).alias("text"), *[F.col(f"`{c}`") for c in keep]]

    def run(batches):
        by = counter(path)
        for b in slices(batches, 1):
            texts = b.column(1).to_pylist()
            found = [by.leaves(t) for t in texts]
            new = [
                pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(n) for _, n in found], pa.int64()),
                pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], ["key", "text", *keep, "n_chars", "n_tokens", "leaf_chars", "leaf_tokens"])
        by.known = {}  # workers outlive tasks

    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return in_arrow(docs.select(*cols), run, f"key {kinds[key]}, text string{more}, n_chars long, n_tokens long, {_LEAVES}").withColumnsRenamed({"key": key, "text": text})


def update(state: DataFrame, edits: str = "edits", path: str | None = None, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The state after its rows' edits, in count()'s form, with encoded_chars: how many characters were encoded anew.

    state: what count() gave, with a column edits of array<struct<start int, stop int, put string>>,
    applied in turn. Each tree is set up from the leaves as they were kept; only the runs that an edit
    touches, and at most the one before, are encoded. Positions are cut to the text; null edits are none.
    Columns in keep ride along.
    """
    path, keep = path or ranks_path(), keep or []
    types = dict(state.dtypes)

    def run(batches):
        by = counter(path)
        for b in slices(batches, 1):
            out: list[list] = [[] for _ in range(6)]
            for t, chars, tokens, todo in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                tree, anew = Tree(chars, tokens), 0
                for e in todo or ():
                    if e is not None:
                        t, n = edit(t, tree, e["start"] or 0, e["stop"] or 0, e["put"] or "", by)
                        anew += n
                runs = tree.runs()
                for c, v in zip(out, (t, len(t), tree.tokens, [c for c, _ in runs], [n for _, n in runs], anew)):
                    c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            new = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new, *b.columns[5:]], ["key", "text", "n_chars", "n_tokens", "leaf_chars", "leaf_tokens", "encoded_chars", *keep])
        by.known = {}

    cols = [F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), "leaf_chars", "leaf_tokens", F.col(f"`{edits}`").alias("edits"), *[F.col(f"`{c}`") for c in keep]]
    more = "".join(f", `{c}` {types[c]}" for c in keep)
    return in_arrow(state.select(*cols), run, f"key {types[key]}, text string, n_chars long, n_tokens long, {_LEAVES}, encoded_chars long{more}").withColumnsRenamed({"key": key, "text": text})
