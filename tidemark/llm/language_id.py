"""Language ID: language-bitmask n-gram filters.

One table of m words is a Bloom filter for every language at once: bit l of a slot is language l's
bit, so and-ing an n-gram's slots gives all languages that contain it. Per language the hits over a
text are counted, corrected for the filter's false positives, and set against the hits usual in
that language; the best language wins.

A language's filter holds the n-grams that it uses at least SHARE times as often as the language
that uses them most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_name, in_arrow, mix, save, slices, small_batches

ORDERS = (2, 3, 4)
#: Slots that an n-gram has.
K = 3
SHARE = 0.5
#: The classifier is fitted on a sample of about so many labelled documents of each language, drawn by a hash.
SAMPLE_DOCS = 5_000
#: n-grams seen less often in a language's sample don't enter its filter; fewer suffice where the sample has
#: less than so many documents, as many as its share of them.
LEAST_COUNT, LEAST_DOCS = 4, 80
UNKNOWN = "und"
#: Documents with a lower score don't resemble any learned language.
LEAST_SCORE = 0.25

_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(texts: list[str]) -> np.ndarray:
    """The texts' letters, lower-cased; runs of anything else are one space, also at both ends; 0 between texts and at both ends."""
    low = [t.lower() for t in texts]
    raw = "\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, "<u4").copy()
    code[~_is_letter()[code]] = 32
    seps = np.cumsum([0, *(len(t) + 1 for t in low)])
    code = np.insert(code, np.concatenate([seps[:-1] + 1, seps[1:]]), 32)
    marks = np.zeros(len(code), bool)
    marks[seps + 2 * np.arange(len(seps))] = True
    code[marks] = 0
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    return code[keep]


def ngrams(texts: list[str], window: int = 1 << 18):
    """For each order and window of characters: hashes of the n-grams that begin there, and where each text's begin.

    The second has one entry more than there are texts. Windows bound memory; an n-gram that runs over a
    window's end belongs to it, so a very long text has the n-grams that it has as a whole.
    """
    code = _codes(texts)
    begins = np.flatnonzero(code == 0)
    for low in range(0, len(code), window):
        part = code[low : low + window + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            size = max(0, min(window, len(part) - n + 1))
            ok = part[:size] != 0
            h = np.full(size, n, np.uint64)
            for j in range(n):
                ok &= part[j : j + size] != 0
                h += part[j : j + size] * _STEPS[j]
            places = np.flatnonzero(ok)
            yield mix(h[places]), np.searchsorted(places, begins - low)


@dataclass
class Model:
    """Tables of 64 languages each, with what the decision needs."""

    langs: list[str]
    bits: int
    tables: list[np.ndarray]
    false: np.ndarray
    usual: np.ndarray

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of n-grams of each text, and their hits in each language, corrected."""
        total = np.zeros(len(texts))
        hits = np.zeros((len(texts), len(self.langs)))
        for h, at in ngrams(texts):
            total += np.diff(at)
            slots = _slots(h, self.bits)
            for g, table in enumerate(self.tables):
                mask = table[slots[0]]
                for s in slots[1:]:
                    mask &= table[s]
                for l in range(64 * g, min(64 * g + 64, len(self.langs))):
                    sums = np.concatenate([[0], np.cumsum((mask >> table.dtype.type(l - 64 * g)) & table.dtype.type(1), dtype=np.int64)])
                    hits[:, l] += sums[at[1:]] - sums[at[:-1]]
        return total, np.maximum(0, hits - total[:, None] * self.false) / (1 - self.false)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the language with the largest share of hits against its usual one; the score ends at 1."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        for a, b in chunks(texts):
            total, hits = self.counts([t or "" for t in texts[a:b]])
            share = hits / np.maximum(total, 1)[:, None] / self.usual
            best = share.argmax(1)
            for j in np.flatnonzero(total > 0):
                if any(map(str.isalpha, texts[a + j] or "")):
                    langs[a + j], scores[a + j] = self.langs[best[j]], min(1.0, share[j, best[j]])
        return langs, scores


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    g = mix(h + _STEPS[0])
    return [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (h, g, mix(g ^ _STEPS[1]))[:K]]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from rows with text and lang, all languages there are; without any, the model knows no language.

    Null and empty texts teach nothing but that their language exists; a very long text is learned whole;
    repeated rows count each. Keys only draw the sample; a null key counts as empty.
    """
    known = docs.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], 1, [], np.zeros(0), np.zeros(0))
    part = F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.lit(1 << 30))
    limit = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(min(1.0, sample_docs / sizes[name]) * (1 << 30)))])
    sample = known.filter(part < F.coalesce(F.try_element_at(limit, F.col("lang")), F.lit(0.0)))
    code = {name: i for i, name in enumerate(langs)}

    def grams(batches):
        for b in slices(batches, 0):
            texts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in sorted(set(names)):
                own = [t for t, x in zip(texts, names) if x == name]
                for first, last in chunks(own):
                    for h, _ in ngrams(own[first:last]):
                        u, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), code[name], np.int32)), pa.array(u.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = save(
        in_arrow(sample.select("text", "lang"), grams, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    docs_of = [min(sizes[name], sample_docs) for name in langs]
    least = F.element_at(F.array(*[F.lit(max(1, min(LEAST_COUNT, LEAST_COUNT * n // LEAST_DOCS))) for n in docs_of]), F.col("lang") + 1)
    rate = counts.filter(F.col("n") >= least).join(F.broadcast(totals), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("rate"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = save(rate.join(top, "gram").filter(F.col("rate") >= F.col("top") * SHARE).select("lang", "gram", "rate"), "chosen")
    # The driver gets sums by language and the words of the tables, whose number follows the sample, not the languages.
    sums = {r.lang: (r.n, r.usual) for r in chosen.groupBy("lang").agg(F.count("*").alias("n"), F.sum("rate").alias("usual")).collect()}
    bits = bits_for(max((n for n, _ in sums.values()), default=1))

    def words(batches):
        for b in batches:
            own, slots = b.column(0).to_numpy().astype(np.int64), _slots(b.column(1).to_numpy().view(np.uint64), bits)
            mask = (np.uint64(1) << (own % 64).astype(np.uint64)).view(np.int64)
            for s in slots:
                yield pa.RecordBatch.from_arrays([pa.array((own // 64).astype(np.int32)), pa.array(s), pa.array(mask)], ["part", "slot", "mask"])

    packed = chosen.select("lang", "gram").mapInArrow(words, "part int, slot long, mask long").groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    part, slot, mask = (packed.column(i).to_numpy() for i in range(3))
    return _model(langs, bits, part, slot, mask.view(np.uint64), [sums.get(i, (0, 0.0))[1] for i in range(len(langs))])


def bits_for(most: int) -> int:
    """The logarithm of a table's size: at least 16 slots for each n-gram of the largest filter."""
    return max(10, int(np.ceil(np.log2(16 * max(1, most)))))


def _model(langs: list[str], bits: int, part: np.ndarray, slot: np.ndarray, mask: np.ndarray, usual: list[float]) -> Model:
    """usual: the share of a language's own n-grams that its filter holds."""
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    tables = [np.zeros(1 << bits, kind) for _ in range(0, len(langs), 64)]
    for i, table in enumerate(tables):
        table[slot[part == i]] = mask[part == i].astype(kind)
    fill = np.array([((tables[l // 64] >> kind(l % 64)) & kind(1)).mean() for l in range(len(langs))])
    return Model(langs, bits, tables, fill**K, np.maximum(np.array(usual, float), 1e-9))


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, rate: np.ndarray) -> Model:
    """A model of given n-grams, for small ones."""
    bits = bits_for(int(np.bincount(lang, minlength=len(langs)).max()) if len(lang) else 1)
    slots = np.concatenate(_slots(gram, bits))
    own = np.tile(lang, K)
    at, back = np.unique(np.stack([own // 64, slots]), axis=1, return_inverse=True)
    mask = np.zeros(at.shape[1], np.uint64)
    np.bitwise_or.at(mask, back.ravel(), np.uint64(1) << (own % 64).astype(np.uint64))
    return _model(langs, bits, at[0], at[1], mask, [rate[lang == l].sum() for l in range(len(langs))])


def judged(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """docs with language and score under the names, which docs may not have. Only the text goes to Python, and only the verdict comes back.

    Null, and texts without a letter, are UNKNOWN with score 0; rows alike are judged alike, a very long text whole;
    an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def verdict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for a in parts:
            langs, scores = [], []
            for b in slices([pa.RecordBatch.from_arrays([a], ["t"])], 0):
                found = m.predict(b.column(0).to_pylist())
                langs += found[0]
                scores.append(found[1])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang", "score"])

    small_batches(docs.sparkSession)
    own = free_name("__verdict", docs.columns)
    found = docs.withColumn(own, verdict(F.col(f"`{text}`").cast("string")))
    return found.withColumns({names[0]: F.col(f"{own}.lang"), names[1]: F.col(f"{own}.score")}).drop(own)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) with lang_pred and score; lang_pred_found and score_found where docs has such columns.

    `und` with score 0 for null, for texts without a letter, and when no language was learned.
    Every row is judged by itself, so repeated rows agree; a very long text is judged whole; an empty
    table gives an empty one.
    """
    keep = docs.columns if keep is None else keep
    names = [free_name(c, keep) for c in ("lang_pred", "score")]
    inner = [free_name(c, [*keep, text]) for c in ("__lang", "__score")]
    found = judged(docs.select(*{f"`{c}`": 0 for c in [*keep, text]}), model, text, tuple(inner))
    return found.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{i}`").alias(n) for i, n in zip(inner, names)])
