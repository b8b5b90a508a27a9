"""MinHash near-dedup: a Chosen Path set similarity join.

1. Each document becomes its set of 5-word shingles; equal sets are one class from here on.
2. Trees: at a node, each class follows the minwise values at BRANCHES coordinates that the node
   picks, so two classes of similarity s share each branch with probability s. Nodes of at most LEAF
   classes are compared exhaustively by their signatures; larger ones branch again, TREES times
   independently. In a large node each class is first compared with a few leaders, and one that is
   nearly a leader's copy (from DEPTH on: half alike) goes no further; the others branch on, at DEEPEST
   alone with no bound on leaders. What is linked to a leader is loose enough that by the triangle
   inequality no pair is lost: a partner of a class within a distance d of its leader is within d + 0.25
   of that leader. From DEPTH on, what goes further is less than half alike with the leaders, so that of
   its two branches it shares less than one with each of them: unlike classes come apart, and the number
   of rows hardly grows.
3. What the leaves link loosely (estimated similarity of a half and more) falls into clusters; in a
   cluster the full sets are compared, skipping pairs that are already connected, so that a group of
   thousands of copies costs one comparison each. Clusters over BLOCK are compared in blocks.

A pair at the threshold meets in a tree with a chance q that is 0.9375 at one level, about 0.90 at the
third and never below 8/9, so trees miss it with (1 - q) ** trees; there are as many trees as RECALL
asks for at DEEPEST.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, mix, save, slices, tasks_for, text_or_empty, word_hashes
from .components import Groups, components
from .exact_dedup import known_filter, suspects

WORDS = 5
#: Linked from 100 * intersection >= PERCENT * union.
PERCENT = 75
BRANCHES, DEPTH, DEEPEST = 2, 3, 16
#: Share of the pairs at the threshold that meet in some leaf.
RECALL = 0.9999
LEAF = 200
BLOCK = 1000
COORDS = 64
#: Of 64 equal signature bytes: 3.46 is a deviation at the threshold, 48 its mean.
LOOSE = 32
#: Followers of a leader, and links to it: distances of 1/8 and 3/8; from DEPTH on 1/2 and 3/4.
NEAR, FAR = (56, 27), (32, 8)
#: Leaders of a node above DEPTH, and from there to DEEPEST.
LEADERS, MORE_LEADERS = 64, 256
SALTS = 64



def trees_for(recall: float, similarity: float = PERCENT / 100) -> int:
    """How many trees a pair of the similarity needs to meet in one with the recall: a branching process of DEEPEST levels."""
    q = 1.0
    for _ in range(DEEPEST):
        q = 1 - (1 - similarity * q) ** BRANCHES
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - q))))


TREES = trees_for(RECALL)
_rng = np.random.default_rng(6)
_A = _rng.integers(0, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
_W = _rng.integers(0, 2**63, 2 * WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words are one shingle, none an empty set."""
    h, at = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += h[j : j + n] * _W[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _W[: b - a]).sum(dtype=np.uint64)[None] + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minwise values of 32 bits for each set, none of which may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), COORDS), np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches):
        import xxhash

        for b in slices(batches, 4, 1 << 18):
            sets = shingles(b.column(4))
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = [None] * len(sets)
            if full:
                for i, s in zip(full, signatures([sets[i] for i in full])):
                    sig[i] = s.astype("<u4").tobytes()
            cls = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["row", "key", "th", "th2", "n", "cls", "sig"])

    return in_arrow(_texts(docs, key, text), run, f"row long, key {kind}, th long, th2 long, n long, cls binary, sig binary")


def _hashes(key: str, text: str) -> list:
    """Two independent hashes of key and text, 128 bits together."""
    return [F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.xxhash64(F.lit("th2"), F.col(f"`{text}`"), F.col(f"`{key}`"))]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    th, th2 = _hashes(key, text)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), th.alias("th"), th2.alias("th2"), text_or_empty(F.col(f"`{text}`").cast("string")).alias("text"))


# Trees.


def _children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """BRANCHES children of each row's node: which coordinates they take depends on the node alone."""
    pick = mix(node)
    first = (pick % np.uint64(COORDS)).astype(np.int64)
    step = (pick >> np.uint64(32)) % np.uint64(COORDS - 1) + np.uint64(1)
    out = []
    for j in range(BRANCHES):
        at = (first + (step * np.uint64(j)).astype(np.int64)) % COORDS
        out.append(mix(mix(node + np.uint64(j + 1)) + sig[np.arange(len(sig)), at].astype(np.uint64)))
    return out


def _branch(rows: DataFrame, roots: bool) -> DataFrame:
    """(node, cid, sig) of children; with roots, of every tree's root.

    Only a byte of each minwise value rides along; large nodes look theirs up again.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(-1, COORDS)
                if roots:
                    nodes = [mix(np.full(len(sig), 1000 + t, np.uint64)) for t in range(TREES)]
                else:
                    nodes = [part.column("node").to_numpy().view(np.uint64)]
                slim = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
                for node in nodes:
                    for child in _children(node, sig):
                        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column("cid"), slim], ["node", "cid", "sig"])

    return rows.mapInArrow(run, "node long, cid long, sig binary")


def _bytes(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)


def _alike(sig: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (rows == sig).sum(1)


def leaf_links(cids: list[int], sigs: list[bytes]) -> list[tuple[int, int]]:
    """A star for each group that signatures join loosely, around its smallest."""
    order = np.argsort(cids)
    cids, m = [cids[i] for i in order], _bytes([sigs[i] for i in order])
    left = np.ones(len(cids), bool)
    out = []
    for i in range(len(cids)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            at = np.flatnonzero(left)
            if not len(at):
                break
            found = at[_alike(m[queue.pop()], m[at]) >= LOOSE]
            left[found] = False
            queue += found.tolist()
            out += [(cids[i], cids[j]) for j in found]
    return out


def _walk(rows: DataFrame, level: int) -> DataFrame:
    """Rows sorted by node: links of small nodes as (a, b), and rows (node, cid) of large nodes that follow no leader.

    Memory is bounded by LEAF rows and the leaders. A row is linked to one leader of each group that
    it touches, groups so joined are one from then on: no more links than rows and leaders. From DEPTH
    on, leaders are settled as well: what is near them, or near what follows them, is linked to them.
    """
    follow, touch = NEAR if level < DEPTH else FAR
    most = LEADERS if level < DEPTH else MORE_LEADERS if level < DEEPEST else None

    def run(batches):
        links, more = [], []
        node, cids, sigs, large = None, [], [], False
        leaders, groups, matrix = [], None, None

        def out():
            a = pa.array([x[0] for x in links] + [None] * len(more), pa.int64())
            b = pa.array([x[1] for x in links] + [None] * len(more), pa.int64())
            cols = [pa.array([None] * len(links) + [x[i] for x in more], k) for i, k in enumerate((pa.int64(), pa.int64()))]
            links.clear()
            more.clear()
            return pa.RecordBatch.from_arrays([a, b, *cols], ["a", "b", "node", "cid"])

        def end():
            if not large and len(set(cids)) > 1:
                links.extend(leaf_links(cids, sigs))

        def lead(n, cid, sig):
            nonlocal matrix
            own = np.frombuffer(sig, np.uint8)
            same = _alike(own, matrix[: len(leaders)])
            touched = {}
            for i in np.flatnonzero(same >= touch).tolist():
                touched.setdefault(groups.find(i), i)
            first = None
            for i in touched.values():
                links.append((leaders[i], cid))
                first = i if first is None else first
                groups.join(first, i)
            if len(same) and same.max() >= follow:
                return
            leads = most is None or len(leaders) < most
            if leads:
                if len(leaders) == len(matrix):
                    matrix = np.concatenate([matrix, np.empty_like(matrix)])
                matrix[len(leaders)] = own
                leaders.append(cid)
                groups.up.append(len(groups.up))
                if first is not None:
                    groups.join(first, len(leaders) - 1)
            if level < DEPTH or not leads:
                more.append((n, cid))

        for b in batches:
            for n, cid, sig in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if n != node:
                    end()
                    node, cids, sigs, large = n, [], [], False
                if large:
                    lead(n, cid, sig)
                else:
                    cids.append(cid)
                    sigs.append(sig)
                    if len(cids) > LEAF:
                        large, leaders, groups, matrix = True, [], Groups(0), np.empty((64, len(sig)), np.uint8)
                        for c, s in zip(cids, sigs):
                            lead(n, c, s)
                        cids, sigs = [], []
            if len(links) + len(more) > 2000:
                yield out()
        end()
        yield out()

    return rows.mapInArrow(run, "a long, b long, node long, cid long")


def candidate_links(classes: DataFrame, count: int) -> DataFrame:
    """Loose links (a, b) between count classes (cid, sig)."""
    links, rows, count = None, classes, count * TREES
    for level in range(1, DEEPEST + 1):
        children = _branch(rows, level == 1)
        walked = save(_walk(children.repartition("node").coalesce(tasks_for(count * BRANCHES)).sortWithinPartitions("node"), level), f"tree-{level}")
        found = walked.filter("a is not null").select("a", "b")
        links = found if links is None else links.union(found)
        large = walked.filter("cid is not null").select("node", "cid")
        count = large.count()
        if not count:
            break
        rows = large.join(classes.select("cid", "sig"), "cid").coalesce(tasks_for(count)).select("node", "cid", "sig")
    return links


# Confirmation on full sets.


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def confirm(cids: list[int], comps: list[int], sigs: list[bytes], sets: list[bytes]) -> list[tuple[int, int]]:
    """Links that join all rows whose sets are linked, given what comps joins already."""
    n = len(cids)
    arrays = [np.frombuffer(s, "<u8") for s in sets]
    size, m = np.array([len(a) for a in arrays]), _bytes(sigs)
    known: dict[int, int] = {}
    groups = Groups(n)
    for i, c in enumerate(comps):
        groups.join(known.setdefault(c, i), i)
    out = []
    for i in range(n - 1):
        near = np.flatnonzero((_alike(m[i], m[i + 1 :]) >= LOOSE) & (100 * np.minimum(size[i], size[i + 1 :]) >= PERCENT * np.maximum(size[i], size[i + 1 :]))) + i + 1
        for j in near.tolist():
            if groups.find(i) != groups.find(j) and linked(arrays[i], arrays[j]):
                groups.join(i, j)
                out.append((cids[i], cids[j]))
    return out


def _confirmed(rows: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b) within groups; rows: group, part, cid, comp, sig, set."""

    def run(batches):
        group, held = None, []

        def links():
            seen: dict[int, tuple] = {}
            for r in held:
                seen.setdefault(r[0], r)
            cols = list(zip(*seen.values()))
            found = confirm(*map(list, cols)) if len(seen) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in slices(batches, 5):
            for *g, cid, comp, sig, own in zip(*(c.to_pylist() for c in b.columns)):
                if g != group:
                    yield links()
                    group, held = g, []
                held.append((cid, comp, sig, own))
        yield links()

    ready = rows.select("group", "part", "cid", "comp", "sig", "set").repartition("group", "part").coalesce(tasks).sortWithinPartitions("group", "part")
    return ready.mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, count: int, key: str, text: str) -> DataFrame:
    """cid, cluster, size, sig (a byte a value) and set of count wanted classes (th, cls, cid, cluster, size)."""
    found = known_filter(wanted, "th", count, "wanted-filter")
    maybe = suspects(_texts(docs, key, text).select("th", "text"), "th", found, "hit").filter("hit").select("th", "text")
    ready = maybe.join(wanted, "th").coalesce(tasks_for(count, 2_000)).select("cls", "cid", "cluster", "size", "text")

    def run(batches):
        import xxhash

        for b in slices(batches, 4, 1 << 18):
            cls = b.column(0).to_pylist()
            sets = shingles(b.column(4))
            ok = [i for i, s in enumerate(sets) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == cls[i]]
            if ok:
                sig = signatures([sets[i] for i in ok]).astype("<u4").view(np.uint8)[:, ::4]
                own = b.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*own.columns[1:4], pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([sets[i].tobytes() for i in ok], pa.binary())], ["cid", "cluster", "size", "sig", "set"])

    return in_arrow(ready, run, "cid long, cluster long, size long, sig binary, set binary")


def exact_links(sets: DataFrame, count: int) -> DataFrame:
    """Confirmed links that connect what is linked in each cluster.

    Clusters over BLOCK: links within blocks first; then the first members of each block's largest
    part among themselves; then whatever is still apart from the cluster's largest part against
    every block, in portions of at most about BLOCK.
    """
    tasks = tasks_for(count, 2_000)
    sized = save(sets, "sets")
    blocks = F.ceil(F.col("size") / BLOCK)
    small = sized.withColumn("group", F.col("cluster")).withColumn("part", F.pmod(F.xxhash64("cid"), blocks)).withColumn("comp", F.col("cid"))
    links = save(_confirmed(small, tasks), "links-within")
    large = small.filter(F.col("size") > BLOCK)
    if large.isEmpty():
        return links

    def joined(links):
        labels = components(links)
        return large.drop("comp").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")

    now = joined(links)
    heads = now.groupBy("group", "part", "comp").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).groupBy("group", "part").agg(F.max_by("cid", F.struct("n", -F.col("cid"))).alias("cid"))
    heads = now.join(heads.select("cid"), "cid", "left_semi").withColumn("part", F.lit(0).cast("long"))
    links = links.union(save(_confirmed(heads, tasks), "links-heads"))
    now = save(joined(links), "joined")
    main = now.groupBy("group", "comp").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    now = now.join(F.broadcast(main) if main.count() < 100_000 else main, "group").withColumn("portions", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    now = now.filter("portions > 0").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    apart = now.filter("comp != main").withColumn("portion", F.expr("cast(pmod(xxhash64(cid), portions) as int)"))
    every = now.withColumn("portion", F.explode(F.expr("sequence(0, portions - 1)"))).withColumn("part", F.expr("part * 1000000 + portion"))
    again = apart.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("part", F.expr("cast(block as long) * 1000000 + portion"))
    keep = ["group", "part", "cid", "comp", "sig", "set"]
    return links.union(_confirmed(every.select(*keep).union(again.select(*keep)), tasks))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: row, key, th and th2 (hashes of key and text), n_shingles, component_id.

    Null and empty texts, and texts of white space, have no shingles and stay alone, each with its own
    key as component; a null key stays null where it is alone and else yields to its component's
    smallest. Rows with equal sets are one class however many there are. An empty table gives an
    empty one; other columns don't matter.
    """
    rows = save(_sketch(docs, key, text), "sketches")
    classes = save(
        rows.filter("cls is not null").groupBy("cls").agg(F.min("row").alias("cid"), F.first("sig").alias("sig"), F.first("th").alias("th"), F.min("key").alias("low")), "classes"
    )
    count = classes.count()
    clusters = components(candidate_links(classes.select("cid", "sig"), count))
    wanted = save(classes.join(clusters.select(F.col("node").alias("cid"), F.col("label").alias("cluster")), "cid").select("th", "cls", "cid", "cluster").coalesce(tasks_for(count)), "wanted")
    some = wanted.count()
    # How large a cluster is, is told before full sets are made; few are over BLOCK, the others count as 1.
    sizes = wanted.groupBy("cluster").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    wanted = wanted.join(sizes, "cluster", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    labels = components(exact_links(_full_sets(docs, wanted, some, key, text), some))
    # Only classes that are linked need to look for their component's smallest key.
    labelled = save(classes.select("cls", "cid", "low").join(labels.withColumnRenamed("node", "cid"), "cid", "left").coalesce(tasks_for(count)), "labelled")
    lowest = labelled.filter("label is not null").groupBy("label").agg(F.min("low").alias("component_id")).coalesce(tasks_for(some))
    of_class = labelled.join(lowest, "label", "left").coalesce(tasks_for(count)).select("cls", F.coalesce("component_id", "low").alias("component_id"))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    salted = rows.select("row", F.col("key").alias(key), "th", "th2", F.col("n").alias("n_shingles"), "cls", salt.alias("salt"))
    parts = salted.filter("cls is not null").select("cls", "salt").distinct().join(of_class, "cls")
    full = salted.filter("cls is not null").join(parts, ["cls", "salt"]).drop("cls", "salt")
    none = salted.filter("cls is null").drop("cls", "salt").withColumn("component_id", F.col(key))
    return full.unionByName(none)


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept."""
    found = near_components(docs, key, text)
    return found.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component one row of docs: that with the smallest key, with all columns.

    Rows without shingles are no component and all stay, as near_components() says; of rows alike in
    key and text one stays, of rows that share the smallest key the one whose text has the least hash.
    A row goes by 128 bits of its key and text. An empty table gives an empty one; columns of any name,
    but for those that begin with two underscores, may ride along.
    """
    marks = save(near_dedup_marks(near_components(docs, key, text), key), "marks")
    found = known_filter(marks, "th", marks.count(), "marks-filter")
    th, th2 = _hashes(key, text)
    cols = [f"`{c}`" for c in docs.columns]
    marked = suspects(docs.withColumn("__th", th).withColumn("__th2", th2), "__th", found, "__hit")
    rest = marked.filter("__hit").join(marks.select(F.col("th").alias("__th"), F.col("th2").alias("__th2"), F.col("goes").alias("__goes")), ["__th", "__th2"], "left")
    rest = rest.filter("not coalesce(__goes, false)")
    again = rest.filter("__goes is not null").groupBy("__th", "__th2").agg(F.first(F.struct(*cols)).alias("__row")).select("__row.*")
    return marked.filter("not __hit").select(*cols).unionByName(rest.filter("__goes is null").select(*cols)).unionByName(again)


def near_dedup_marks(found: DataFrame, key: str) -> DataFrame:
    """th, th2 and goes: true for rows that go, false for those that are repeated and of which one stays."""
    sets = found.filter("n_shingles > 0").groupBy(key, "component_id", "th", "th2").agg(F.count("*").alias("n"))
    first = F.col(key).eqNullSafe(F.col("component_id"))
    best = sets.filter(first & F.col("component_id").isNotNull()).groupBy("component_id").agg(F.min(F.struct("th", "th2")).alias("best"))
    stays = first & (F.col("best").isNull() | (F.struct("th", "th2") == F.col("best")))
    marked = sets.join(best, "component_id", "left").withColumn("goes", ~stays & F.col("component_id").isNotNull())
    return marked.filter("goes or n > 1").select("th", "th2", "goes")
