"""Hidden Markov language model over words.

Training words are counted over the whole corpus. The HEAD most frequent ones are symbols of their
own, the others share BUCKETS symbols by hash and are told apart within a bucket by their smoothed
counts: p(word) = p(symbol | state) * p(word | symbol). STATES latent states are trained by
Baum-Welch: each pass, every partition's expected counts are added up over all training documents.
A text's likelihood comes from the scaled forward recursion, exactly.

Counts of the HOT most frequent words are broadcast. Rarer words, whose number grows with the
corpus, meet their counts in a shuffle.

Sequences are trained on and scored whole: longest first, side by side, a step at a time. Of a long
one only the states at the ends of blocks are kept on the way forward; on the way back each block is
gone through again, so that memory is bounded by CELLS and nothing is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, in_arrow, save, slices, text_or_empty, word_hashes

STATES = 8
HEAD, BUCKETS = 4096, 1024
#: Words whose counts are broadcast, at most: 16 bytes each.
HOT = 1_000_000
PASSES = 3
#: The passes start from a mixture fitted on so many training documents at most, those whose key and
#: symbols have the least hashes; only their counts of symbols reach the driver.
START_DOCS = 1500
#: Sequences side by side, and cells (steps times sequences) whose states are held at once.
WIDTH, CELLS = 512, 300_000
#: Tokens that a task gathers before it sorts them by length.
GATHER = 6_000_000
ALPHA = 0.1
#: Weight, in tokens, of the symbols' overall frequencies in each state.
PRIOR = 20.0
END = np.uint64(0x5EED0E4D0FD0C5AA)

SYMBOLS = HEAD + BUCKETS


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each text followed by END; and where each begins."""
    h, at = word_hashes(texts)
    at = at + np.arange(len(at))
    out = np.full(at[-1], END, np.uint64)
    word = np.ones(len(out), bool)
    word[at[1:] - 1] = False
    out[word] = h
    return out, at


# Counts.


def _counts(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        for b in slices(batches, 0, 4 << 20):
            u, which = distinct(tokens(b.column(0))[0])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(which, minlength=len(u)).astype(np.int64))], ["word", "n"])

    rows = in_arrow(docs.select(text_or_empty(F.col(f"`{text}`").cast("string")).alias("text")), run, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What encoding needs to know of the counts."""

    def __init__(self, counts: DataFrame):
        """counts: (word, n), saved. The driver gets HOT words and one row per bucket at most."""
        self.tokens, self.distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        end = np.int64(END.view(np.int64))
        head = counts.filter(F.col("word") != int(end)).orderBy(F.desc("n"), "word").limit(HEAD - 1)
        head = head.toArrow()
        words = np.concatenate([[END], head.column("word").to_numpy().view(np.uint64)]).astype(np.uint64)
        level = F.floor(F.log2(F.col("n").cast("double")) * 16)
        sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level).count().collect()), reverse=True)
        cut, total = None, 0
        for lev, size in sizes:
            if total + size > HOT and total:
                break
            cut, total = lev, total + size
        self.cut = cut if total < self.distinct else None  # None: every word is hot
        hot = counts.filter(level >= cut) if self.cut is not None else counts
        hot = hot.toArrow()
        w, n = hot.column("word").to_numpy().view(np.uint64), hot.column("n").to_numpy()
        order = np.argsort(w)
        self.words, self.n = w[order], n[order]
        self.rare = counts.filter(level < cut) if self.cut is not None else None
        self.symbol = (np.uint64(HEAD) + self.words % np.uint64(BUCKETS)).astype(np.uint16)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            own = self.words[at] == words
            self.symbol[at[own]] = np.flatnonzero(own).astype(np.uint16)
        symbol = F.pmod("word", F.lit(BUCKETS))  # a power of two, so the sign is no matter
        tail = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(x),) for x in words.view(np.int64)], "word long")), "word", "left_anti")
        self.mass, self.kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
        for b, m, k in tail.groupBy(symbol).agg(F.sum("n"), F.count("*")).collect():
            self.mass[HEAD + b], self.kinds[HEAD + b] = m, k
        known = np.flatnonzero(self.symbol < HEAD)
        self.mass[self.symbol[known]] = self.n[known]

    def plain(self) -> dict:
        """For broadcasting."""
        return {
            "words": self.words, "symbol": self.symbol, "log": np.log10(self.n + ALPHA), "all": self.cut is None,
            "bucket": np.log10(self.mass[HEAD:] + ALPHA * (self.kinds[HEAD:] + 1)),
        }


def encode(v: dict, texts):
    """Per text: symbols, log10 sums of counts (head, other), of buckets, known tokens; and the rare words."""
    h, at = tokens(texts)
    u, back = distinct(h)
    n = len(v["words"])
    i = np.minimum(np.searchsorted(v["words"], u), max(n - 1, 0))
    hit = v["words"][i] == u if n else np.zeros(len(u), bool)
    symbol = (np.uint64(HEAD) + u % np.uint64(BUCKETS)).astype(np.uint16)
    symbol[u == END] = 0
    log = np.full(len(u), np.log10(ALPHA) if v["all"] else 0.0)
    if n:
        symbol[hit] = v["symbol"][i[hit]]
        log[hit] = v["log"][i[hit]]
    in_bucket = symbol >= HEAD
    bucket = np.where(in_bucket, v["bucket"][np.maximum(symbol.astype(np.int64) - HEAD, 0)], 0.0)
    sums = [np.add.reduceat(x[back], at[:-1]) for x in (np.where(in_bucket, 0, log), np.where(in_bucket, log, 0), bucket, hit.astype(float))]
    rare = ~hit[back] if not v["all"] else np.zeros(len(h), bool)
    return symbol[back], at, sums, h, rare


def _encoded(docs: DataFrame, vocabulary, key: str, text: str, fold: str) -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches):
        v = vocabulary.value
        for b in slices(batches, 3):
            symbols, at, sums, h, rare = encode(v, b.column(3))
            seqs = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(symbols.astype("<u2"))])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)])[at].astype(np.int32)), pa.array(h[rare].view(np.int64)))
            cols = [*b.columns[:3], pa.array(np.diff(at)), seqs, *map(pa.array, sums), lists]
            yield pa.RecordBatch.from_arrays(cols, ["row", "key", "held_out", "n_tokens", "symbols", "head", "other", "bucket", "known", "rare"])

    ready = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(fold).alias("held_out"), text_or_empty(F.col(f"`{text}`").cast("string")).alias("text"))
    return in_arrow(ready, run, f"row long, key {kind}, held_out boolean, n_tokens long, symbols binary, head double, other double, bucket double, known double, rare array<long>")


def _sequences(column: pa.Array) -> list[np.ndarray]:
    """The symbols of each row, as views."""
    if not len(column):
        return []
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
    flat = np.frombuffer(column.buffers()[2] or b"", "<u2")
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _gathered(batches, col: int):
    """Lists of batches that have about GATHER symbols together, with the symbols of their rows."""
    held, seqs, size = [], [], 0
    for b in batches:
        own = _sequences(b.column(col))
        held.append(b)
        seqs += own
        size += sum(map(len, own))
        if size >= GATHER:
            yield held, seqs
            held, seqs, size = [], [], 0
    if seqs:
        yield held, seqs


# The model.


class Hmm:
    """States are rows and sequences columns in all arrays, so that each step works on long rows."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """first: states; move: states x states; emit: symbols x states."""
        self.first, self.move, self.emit = first, move, emit

    @staticmethod
    def batches(seqs: list[np.ndarray]):
        """(indices, symbols as time x sequence, how many sequences are as long as each time), longest first."""
        order = np.argsort([-len(s) for s in seqs], kind="stable")
        for at in range(0, len(order), WIDTH):
            some = order[at : at + WIDTH]
            size = np.array([len(seqs[i]) for i in some])
            grid = np.zeros((len(some), size[0]), np.uint16)
            for row, i in zip(grid, some):
                row[: len(seqs[i])] = seqs[i]
            yield some, np.ascontiguousarray(grid.T), np.searchsorted(-size, -np.arange(size[0]), side="left")

    def log_likelihood(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms; needs a column of states a sequence, however long that is."""
        out = np.zeros(len(seqs))
        emit, move, first = np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T), self.first[:, None]
        for some, grid, active in self.batches(seqs):
            alpha, total = None, np.zeros(len(some))
            for t, n in enumerate(active.tolist()):
                seen = emit.take(grid[t, :n], 1)
                alpha = first * seen if alpha is None else move @ alpha[:, :n] * seen
                scale = alpha.sum(0)
                alpha /= scale
                total[:n] += np.log(scale)
            out[some] = total
        return out

    def expected(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Expected counts of first states, moves and emissions, in one vector. Single precision, sums in double."""
        k, kinds = len(self.first), len(self.emit)
        emit, move = np.ascontiguousarray(self.emit.T, np.float32), self.move.astype(np.float32)
        turn, first = np.ascontiguousarray(move.T), self.first.astype(np.float32)[:, None]
        firsts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, kinds))
        for _, grid, active in self.batches(seqs):
            steps, width = grid.shape
            count = active.tolist()
            size = max(1, min(steps, CELLS // width))
            alpha, beta, seen = (np.zeros((size, k, width), np.float32) for _ in range(3))

            def forward(begin, before):
                """States of a block's steps, given those before it; seen becomes the symbols' share of each step."""
                for i, t in enumerate(range(begin, min(begin + size, steps))):
                    n = count[t]
                    s, a = seen[i, :, :n], alpha[i, :, :n]
                    np.take(emit, grid[t, :n], 1, out=s, mode="clip")
                    if t:
                        np.matmul(turn, before[:, :n], out=a)
                        a *= s
                    else:
                        np.multiply(first, s, out=a)
                    scale = a.sum(0)
                    a /= scale
                    s /= scale
                    before = alpha[i]
                return before

            begins, borders, before = list(range(0, steps, size)), [None], None
            for begin in begins:
                before = forward(begin, before)
                borders.append(before.copy() if begin != begins[-1] else None)
            later = None  # beta before the block that was gone through last, already times what it saw
            for b in reversed(range(len(begins))):
                begin, end = begins[b], min(begins[b] + size, steps)
                if b < len(begins) - 1:
                    forward(begin, borders[b])
                own = np.zeros((k, k))
                for t in range(end - 1, begin - 1, -1):
                    i, n = t - begin, count[t]
                    m = count[t + 1] if t + 1 < steps else 0
                    x = beta[i, :, :n]
                    if m:
                        np.matmul(move, later[:, :m], out=x[:, :m])
                        own += alpha[i, :, :m] @ later[:, :m].T
                    x[:, m:] = 1  # where a sequence ends
                    later = seen[i, :, :n]
                    later *= x
                    x *= alpha[i, :, :n]  # the states' probabilities
                if b:
                    later = later.copy()  # the arrays serve the block before
                moves += own
                have = end - begin
                for i in range(have):
                    beta[i, :, count[begin + i] :] = 0
                gamma = beta[:have]
                gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-30)
                if not b:
                    firsts += gamma[0].sum(1)
                flat = grid[begin:end].reshape(-1).astype(np.int64)
                for s in range(k):
                    emits[s] += np.bincount(flat, gamma[:, s].reshape(-1), kinds)
        return np.concatenate([firsts, (self.move * moves).reshape(-1), emits.T.reshape(-1)])

    @classmethod
    def from_counts(cls, counts: np.ndarray, overall: np.ndarray) -> Hmm:
        k = STATES
        first, move, emit = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k :].reshape(-1, k)
        emit = emit + PRIOR * overall[:, None]
        move = move + 0.5 + 0.5 * np.eye(k)
        return cls((first + 0.1) / (first + 0.1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def start(bags: np.ndarray, overall: np.ndarray) -> Hmm:
    """Sticky states whose symbols are those of a mixture, fitted to whole documents' counts of symbols."""
    k, rng, n = STATES, np.random.default_rng(7), len(bags)
    share = rng.dirichlet(np.full(k, 0.3), n) if n else np.zeros((0, k))
    emit = None
    for _ in range(40):
        emit = bags.T @ share + 50 * overall[:, None]
        emit /= emit.sum(0)
        score = bags @ np.log(emit) * 0.05 + np.log(share.mean(0) + 1e-9) if n else share
        share = np.exp(score - score.max(1, keepdims=True)) if n else share
        share /= share.sum(1, keepdims=True)
    move = np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1))
    first = share.mean(0) + 0.01 if n else np.ones(k)
    return Hmm(first / first.sum(), move, emit)


def _bags(rows: DataFrame) -> np.ndarray:
    """Counts of symbols of the START_DOCS distinct rows (key, symbols) with the least hashes, whatever the partitions."""
    hashed = rows.select(F.xxhash64(F.col("key"), F.col("symbols")).alias("h"), "symbols")
    cut = hashed.select("h").orderBy("h").limit(START_DOCS).agg(F.max("h")).first()[0]
    if cut is None:
        return np.zeros((0, SYMBOLS), np.float32)

    def run(batches):
        for b in batches:
            for h, s in zip(b.column(0), _sequences(b.column(1))):
                u, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()]), pa.array([u.tolist()], pa.list_(pa.int32())), pa.array([n.tolist()], pa.list_(pa.int64()))], ["h", "symbol", "n"])

    some = in_arrow(hashed.filter(F.col("h") <= cut), run, "h long, symbol array<int>, n array<long>").dropDuplicates(["h"]).orderBy("h").collect()
    out = np.zeros((len(some), SYMBOLS), np.float32)
    for row, r in zip(out, some):
        row[r["symbol"]] = r["n"]
    return out


def train(encoded: DataFrame, vocabulary: Vocabulary, passes: int = PASSES) -> Hmm:
    """Baum-Welch over all training rows of encoded."""
    sc = encoded.sparkSession.sparkContext
    overall = (vocabulary.mass + ALPHA) / (vocabulary.mass + ALPHA).sum()
    rows = encoded.filter("not held_out").select("key", "symbols")
    hmm = start(_bags(rows), overall)
    for _ in range(passes):
        now = sc.broadcast(hmm)

        def run(batches, now=now):
            total = None
            for _, seqs in _gathered(batches, 0):
                found = now.value.expected(seqs)
                total = found if total is None else total + found
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])

        # One vector of bounded length for each partition; they meet by position.
        sums = in_arrow(rows.select("symbols"), run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(STATES + STATES**2 + SYMBOLS * STATES)
        counts[sums.column("i").to_numpy()] = sums.column("n").to_numpy()
        hmm = Hmm.from_counts(counts, overall)
    return hmm


def score(docs: DataFrame, fold: str, key: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where fold is false.

    Null and empty texts, and those of white space, are their end alone. Repeated rows are counted
    and scored each. With no row to learn from, every word is unknown; an empty table gives an empty one.
    A very long text is scored whole. docs' other columns, whatever their names, don't matter.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(*{f"`{c}`": 0 for c in (key, text, fold)})
    counts = save(_counts(docs.filter(~F.col(fold)), text), "word-counts")
    v = Vocabulary(counts)
    encoded = save(_encoded(docs, sc.broadcast(v.plain()), key, text, fold), "symbols")
    shared = sc.broadcast(train(encoded, v, passes))
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for held, seqs in _gathered(batches, 4):
            ll, at = shared.value.log_likelihood(seqs) / np.log(10), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *b.columns[5:], pa.array(ll[at : at + b.num_rows])], ["row", "key", "held_out", "n_tokens", "head", "other", "bucket", "known", "ll"])
                at += b.num_rows

    cols = ["row", "key", "held_out", "n_tokens", "symbols", "head", "other", "bucket", "known"]
    scored = in_arrow(encoded.select(*cols), run, f"row long, key {kind}, held_out boolean, n_tokens long, head double, other double, bucket double, known double, ll double")
    if v.rare is not None:
        words = encoded.select("row", F.explode("rare").alias("word"))
        met = words.join(v.rare, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("rare"), F.count("n").alias("rare_known"))
        scored = scored.join(met, "row", "left").withColumn("other", F.col("other") + F.coalesce("rare", F.lit(0.0))).withColumn("known", F.col("known") + F.coalesce("rare_known", F.lit(0)))
    base = float(np.log10(v.tokens + ALPHA * (v.distinct + 1)))
    return scored.select(
        F.col("key").alias(key), "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(int(v.tokens)).cast("long").alias("train_tokens"),
        (F.col("head") + F.col("other") - F.col("n_tokens") * base).alias("base_score"), (F.col("ll") + F.col("other") - F.col("bucket")).alias("score"),
    )
