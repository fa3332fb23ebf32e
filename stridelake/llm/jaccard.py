"""Operator 6: n-gram Jaccard join by a count-vector R-tree.

Words are hashed, k-word shingles are hashed from them, and a document is its set of shingles. Two documents link when
100 * intersection >= percent * union. The join runs in four steps:

1. Dealing. Linked sets differ in at most D shingles, so when all shingles are hashed into D + 1 groups or more, linked
   sets agree on one whole group at least. Each document sends the hash of each of its groups (per size class and the next),
   so linked documents meet under one signature at least, whatever words are frequent; with some groups more, each
   document leaves out as many of its groups of frequent shingles (passages that many documents share), and linked
   ones still meet. A task first joins its own
   documents, as in 3, and lets the smallest of those that are linked speak for all of them; so a signature has at most
   one row per map task, and a group of near copies few speakers. Under each signature all speakers, with those for
   whom they speak, are tied to the smallest, so linked documents stand together in a star at least. Stars are never
   closed over one another: a passage that many documents share ties them to a few heads, and does not tie what these
   are tied to.
2. Texts of a star's members (equal sets count once, by their smallest doc_id) are cut into tiles of bounded size; the
   star's head goes along with every tile.
3. In a tile, tokens are hashed into GROUPS groups, group counts are points, and an R-tree over the points is
   searched with the overlap bound sum(min(x_i, hi_i)); pairs that survive and are not yet connected are verified on
   the exact sets.
4. Stars of several tiles: what did not connect to the head is searched in all tiles of its star in the same way;
   nothing is capped. The links that were found are closed into components.

Defined cases: null text and text without words give an empty set, linked with nothing; fewer than k words are one
shingle; very long texts are read whole (a text longer than a slice is a slice of its own, and a tile of its own);
equal doc_ids are one node (each row is returned); doc_id null has component null; an empty table gives no rows; other
columns of docs are not read and clash with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.components import connected
from stridelake.llm.shared import U64, batches_of, id_text, mix, pack, return_memory, segments, slices, unpack, utf8, word_hashes, written

GROUPS = 64
FANOUT = 16
TILE_SHINGLES = 2_000_000
BATCH_ROWS = 1_000
SIGNATURE_BYTES = 5  # kept beside the bucket, which grows with the input; equal ones only make candidates


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and how many each has."""
    h, words = word_hashes(data, offs)
    n = len(words)
    first = np.cumsum(words) - words
    many = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    doc = segments(many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    s = np.zeros(len(doc), U64)
    for j in range(k):
        there = j < words[doc]
        s[there] = mix(s[there] * U64(0xD6E8FEB86659FD93) + h[at[there] + j] + U64(j + 1))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=n)


def text_sets(column, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of a text column that have a shingle, and the set of each."""
    data, offs = utf8(column)
    rows, sets = [], []
    for i, j in slices(offs):
        s, sizes = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
        cut = np.cumsum(sizes) - sizes
        some = np.flatnonzero(sizes)
        rows.append(some + i)
        sets += [s[cut[x] : cut[x] + sizes[x]].copy() for x in some]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), sets


def size_classes(most: int, percent: int) -> np.ndarray:
    """Largest size of each class; linked sets lie in one class or in two that follow each other."""
    tops, low = [], 1
    while not tops or tops[-1] < most:
        tops.append(low * 100 // percent)
        low = tops[-1] + 1
    return np.array(tops)


def group_counts(tops: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of each size class, and how many more than the differences (plus one) these are.

    With x groups more, linked sets agree on x + 1 groups at least. In any order of groups that is the same for all sets,
    a set may so leave out its first x groups: of what linked sets agree on, the last one stands behind x others. Empty
    groups go first, then groups of shingles that are frequent. x is chosen above the usual number of empty groups.
    """
    k = 2 * tops * (100 - percent) // (100 + percent) + 1
    low = np.maximum(1, (np.append(0, tops[:-1]) + 1) * percent // 100)
    empty = k * np.exp(-low / k)
    more = np.where(k < 10, 0, np.ceil(empty + 4 * np.sqrt(empty)).astype(np.int64) + 1) + k // 6
    return k + more, more


class Frequent:
    """Frequent shingles (sorted) and how often each was seen; only the order in which groups are left out depends on it."""

    def __init__(self, shingles=(), counts=()):
        order = np.argsort(np.array(shingles, U64))
        self.shingles, self.counts = np.array(shingles, U64)[order], np.array(counts, np.int64)[order]

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.counts[at], 0)


def signatures(s: np.ndarray, sizes: np.ndarray, percent: int, frequent: Frequent = Frequent()) -> tuple[np.ndarray, np.ndarray]:
    """Signature and document number, for each group that each document sends at its own class and the next."""
    tops = size_classes(int(sizes.max(initial=1)) * 2, percent)
    groups, more = group_counts(tops, percent)
    level0, out = np.searchsorted(tops, np.maximum(sizes, 1)), []
    doc_of, seen_often = segments(sizes), frequent.of(s)

    def grouped(pick, level, seed):
        """Owner, group and hash of each group of the picked documents, and which groups have a shingle."""
        k = np.where(pick, groups[level], 0)
        base = np.cumsum(k) - k
        keep = pick[doc_of]
        d, v = doc_of[keep], mix(s[keep] + U64(seed))
        slot = base[d] + (v % k[d].astype(U64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, v = slot[order], mix(v[order] ^ U64(0xA5A5A5A5))
        total, common = np.zeros(int(k.sum()), U64), np.zeros(int(k.sum()), np.int64)
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else slot
        total[slot[first]] = np.add.reduceat(v, first) if len(slot) else v
        if len(slot):  # a group is as frequent as its rarest shingle
            common[slot[first]] = np.minimum.reduceat(seen_often[keep][order], first)
        seen = np.zeros(len(total), bool)
        seen[slot] = True
        owner = segments(k)
        group = (np.arange(len(total)) - base[owner]).astype(U64)
        return owner, group, mix(total + mix(level[owner].astype(U64) * U64(1 << 32) + group + U64(seed))), seen, common

    for up in (0, 1):
        level = level0 + up
        owner, group, sig, seen, common = grouped(sizes > 0, level, 0)
        empty = np.bincount(owner[~seen], minlength=len(sizes))
        spare = np.maximum(0, more[level] - empty)  # groups that may be left out: the most frequent ones
        hot = np.flatnonzero(common > 0)
        hot = hot[np.lexsort((sig[hot], -common[hot], owner[hot]))]
        turn = np.arange(len(hot)) - np.searchsorted(owner[hot], owner[hot])
        sent = seen.copy()
        sent[hot[turn < spare[owner[hot]]]] = False
        out.append((sig[sent], owner[sent]))
        # An empty group says little, so where it must be sent, it goes with each group of a second grouping.
        often = empty > more[level]
        if often.any():
            owner2, _, sig2, _, _ = grouped(often, level, 1)
            cut = np.searchsorted(owner2, np.arange(len(sizes) + 1))
            for d, g in zip(owner[~seen & often[owner]], group[~seen & often[owner]]):
                part = sig2[cut[d] : cut[d + 1]]
                out.append((mix(part + g), np.full(len(part), d)))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


class RTree:
    """Packed R-tree over count vectors: leaves of FANOUT points in order of size, nodes of FANOUT nodes above."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = int(np.argmax(points.var(0))) if len(points) else 0
        slab = np.argsort(np.argsort(sizes, kind="stable")) // (FANOUT * FANOUT)
        self.order = np.lexsort((points[:, spread], slab))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            hi, low, top = self.levels[-1]
            cut = np.arange(0, len(hi), FANOUT)
            self.levels.append((np.maximum.reduceat(hi, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)))

    def search(self, x: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Numbers of the points whose bound admits a link with x."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, low, top = (v[nodes] for v in self.levels[depth])
            least = np.maximum(low, -(-percent * n // 100))
            need = -(-percent * (n + least) // (100 + percent))
            ok = (top >= least) & (low * percent <= 100 * n) & (np.minimum(x, hi).sum(1, dtype=np.int64) >= need)
            nodes = nodes[ok]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(x) for x in sets])
    group = (np.concatenate(sets) >> U64(58)).astype(np.int64)
    return np.bincount(segments(sizes) * GROUPS + group, minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def tile_labels(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest id that each document of a tile is connected with."""
    label = ids.copy()
    if len(ids) < 2:
        return label
    points, sizes = count_vectors(sets), np.array([len(x) for x in sets])
    tree = RTree(points, sizes)
    for q in np.argsort(ids, kind="stable"):
        if (label == label[q]).all():
            continue
        for c in tree.search(points[q], int(sizes[q]), percent):
            if label[c] != label[q] and linked(sets[q], sets[c], percent):
                low, high = sorted((label[c], label[q]))
                label[label == high] = low
    return label


def cross_links(ids, sets, is_query, percent) -> list[tuple[int, int]]:
    """Links between queries and the other documents of a tile."""
    points, sizes = count_vectors(sets), np.array([len(x) for x in sets])
    rest, out = np.flatnonzero(~is_query), []
    if not len(rest):
        return out
    tree = RTree(points[rest], sizes[rest])
    for q in np.flatnonzero(is_query):
        out += [(int(ids[q]), int(ids[c])) for c in rest[tree.search(points[q], int(sizes[q]), percent)] if ids[c] != ids[q] and linked(sets[q], sets[c], percent)]
    return out


def by_key(batches, key: str):
    """Tables of equal key from batches that are sorted by it; one at a time is held."""
    held, last = [], None
    for b in batches:
        keys = np.asarray(b.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else [0]
        for i, j in zip(cuts, cuts[1:]):
            if held and keys[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = keys[i]
    if held:
        yield pa.Table.from_batches(held)


def speakers(sig: np.ndarray, who: np.ndarray, ids: np.ndarray, sets: list[np.ndarray], percent: int):
    """For the documents of one task (who: numbers in ids and sets): distinct signatures and who speaks for each,
    (speaker, document) of all it may have to answer for, and the links (smallest, document) among them all."""
    order = np.lexsort((ids[who], sig))
    sig, who = sig[order], who[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    head = who[new][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([head[~new], who[~new]], 1), axis=0)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for h, w in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
        x, y = find(h), find(w)
        if x != y and linked(sets[h], sets[w], percent):
            low, high = (x, y) if (ids[x], x) < (ids[y], y) else (y, x)
            root[high] = low
    of = np.array([find(x) for x in range(len(ids))])
    stars = np.concatenate([np.stack([of[pairs[:, 0]], pairs[:, 1]], 1), np.stack([of, np.arange(len(of))], 1)])
    stars = np.unique(stars[stars[:, 0] != stars[:, 1]], axis=0)
    links = [np.zeros((0, 2), np.int64)]
    for part in np.split(stars, np.flatnonzero(np.diff(stars[:, 0])) + 1) if len(stars) else ():
        inside = np.append(part[0, 0], part[:, 1])
        label = tile_labels(ids[inside], [sets[x] for x in inside], percent)
        apart = label != ids[inside]
        links.append(np.stack([label[apart], ids[inside][apart]], 1))
    return sig[new], ids[of[who[new]]], ids[stars], np.concatenate(links)


def frequent_shingles(source: DataFrame, k: int, rows: int, sample: int = 2_000, most: int = 200_000) -> Frequent:
    """Shingles that occur in two or more of about `sample` documents (drawn by a hash of text and id), at most `most`.

    What is left out by their order never changes what links (see group_counts), so the sample decides cost alone."""

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column("text"))
            for i, j in slices(offs):
                s, _ = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                yield pa.record_batch([pa.array(s.view(np.int64))], names=["s"])

    drawn = source.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows // sample))) == 0)
    got = drawn.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(most).collect()
    return Frequent(np.array([r.s for r in got], np.int64).view(U64), [r.n for r in got])


def _scan(percent: int, k: int, buckets: int, frequent: Frequent, flush: int = 500_000):
    """Base rows (kind 0), signatures by bucket (kind 1); within the task whom a speaker answers for (kind 3) and links (kind 4)."""
    names = ["kind", "a", "b", "n", "f1", "f2", "blob", "blob2"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def rows(kind, **cols):
        n = len(next(iter(cols.values())))
        out = [pa.array(np.full(n, kind, np.int32))]
        out += [pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names[1:], types[1:], strict=True)]
        return pa.record_batch(out, names=names)

    def dealt(sigs, who, ids, sets):
        sig, speaker, stars, links = speakers(np.concatenate(sigs), np.concatenate(who), np.concatenate(ids), sets, percent)
        for kind, pairs in ((3, stars), (4, links)):
            if len(pairs):
                yield rows(kind, a=pairs[:, 0], b=pairs[:, 1])
        cut = np.searchsorted(sig, (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets)[1:-1].astype(U64))
        for x, (i, j) in enumerate(zip([0, *cut], [*cut, len(sig)])):
            if j > i:
                yield rows(1, a=[x], n=[int(j - i)], blob=[pack(sig[i:j], SIGNATURE_BYTES)], blob2=[pack(speaker[i:j].astype(U64))])

    def run(batches):
        return_memory()
        sigs, who, ids, sets, seen, held = [], [], [], [], set(), 0
        for b in batches:
            data, offs = utf8(b.column("text"))
            doc_id = b.column("doc_id")
            known = np.asarray(doc_id.is_valid())
            doc = np.asarray(doc_id.fill_null(0))
            for i, j in slices(offs):
                s, sizes = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                cut = np.append(np.cumsum(sizes) - sizes, 0)[:-1]
                some = sizes > 0
                f = np.zeros((2, j - i), U64)
                for x in (0, 1):
                    if len(s):
                        f[x][some] = np.add.reduceat(mix(s + U64(x + 11)), cut[some])
                yield rows(0, a=doc_id.slice(i, j - i), n=sizes, f1=f[0].view(np.int64), f2=f[1].view(np.int64))
                fresh = np.zeros(j - i, bool)
                for x in np.flatnonzero(some & known[i:j]):  # one of equal sets is enough
                    key = (int(f[0][x]), int(f[1][x]))
                    fresh[x] = key not in seen
                    seen.add(key)
                if fresh.any():
                    sig, owner = signatures(s[fresh[segments(sizes)]], np.where(fresh, sizes, 0), percent, frequent)
                    number = np.cumsum(fresh) - 1 + len(sets)
                    sigs.append(sig)
                    who.append(number[owner])
                    ids.append(doc[i:j][fresh])
                    sets += [s[cut[x] : cut[x] + sizes[x]].copy() for x in np.flatnonzero(fresh)]
                    held += len(sig)
                if held >= flush:
                    yield from dealt(sigs, who, ids, sets)
                    sigs, who, ids, sets, seen, held = [], [], [], [], set(), 0
        if held:
            yield from dealt(sigs, who, ids, sets)

    return run


def _meet(batches):
    """Signatures by bucket turned into star edges (kind 2: head, other) of the documents that share one; other rows as they are."""
    aside, names = [], ["kind", "a", "b", "n", "f1", "f2"]

    def dealt():
        for b in batches:
            is_sig = pc.equal(b.column("kind"), 1)
            aside.append(b.filter(pc.invert(is_sig)).select(names))
            yield b.filter(is_sig)

    return_memory()
    for group in by_key(dealt(), "a"):
        yield from aside
        aside.clear()
        n = group.column("n").to_pylist()
        sig = np.concatenate([unpack(x.as_py(), m, SIGNATURE_BYTES) for x, m in zip(group.column("blob"), n)])
        who = np.concatenate([unpack(x.as_py(), m) for x, m in zip(group.column("blob2"), n)]).astype(np.int64)
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        head = who[np.flatnonzero(new)][np.cumsum(new) - 1]
        pairs = np.stack([head, who], 1)[head != who]
        if len(pairs):
            pairs = np.unique(pairs, axis=0)
            rest = [pa.nulls(len(pairs), pa.int64())] * 3
            yield pa.record_batch([pa.array(np.full(len(pairs), 2, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *rest], names=names)
    yield from aside


def join(docs: DataFrame, percent: int = 90, k: int = 3, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _join(docs, percent, k, tile_shingles)


def _join(docs: DataFrame, percent: int, k: int, tile_shingles: int) -> DataFrame:
    source = id_text(docs)
    size, rows = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets, frequent = max(64, size // (8 << 20)), frequent_shingles(source, k, rows)
    kind = "kind int, a long, b long, n long, f1 long, f2 long"
    scan = source.mapInArrow(_scan(percent, k, buckets, frequent), f"{kind}, blob binary, blob2 binary")
    # Signatures go to their bucket; the other rows, which are small, stay together by task.
    keyed = scan.withColumn("key", F.when(F.col("kind") == 1, F.col("a")).otherwise(F.spark_partition_id() % buckets)).repartition("key")
    scan = written(keyed.drop("key").sortWithinPartitions("kind", "a").mapInArrow(_meet, kind), "shingles")
    base = scan.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "f1", "f2")
    # One representative for each set: the smallest doc_id. Tables are written so that the joins can split hot sets.
    one = written(base.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "reps")
    rep = written(base.join(one, ["f1", "f2", "n"]).select("doc_id", "rep", "n"), "sets")
    near, for_whom = scan.where("kind = 2").select("a", "b").distinct(), scan.where("kind = 3").select("a", "b")
    answered = near.alias("x").join(for_whom.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
    own = near.select("a").distinct().join(for_whom, "a").select("a", "b")  # a head's own documents are in its star
    pairs = near.unionByName(answered).unionByName(own).withColumn("sure", F.lit(False)).unionByName(scan.where("kind = 4").select("a", "b", F.lit(True).alias("sure"))).distinct()
    pairs = pairs.join(rep.select(F.col("doc_id").alias("a"), F.col("rep").alias("head")), "a").join(rep.select(F.col("doc_id").alias("b"), F.col("rep").alias("node")), "b")
    pairs = written(pairs.where("head <> node").select("head", "node", "sure").distinct(), "pairs")
    stars = pairs.where("not sure").select("head", "node")
    stars = stars.unionByName(stars.select("head", F.col("head").alias("node")).distinct())
    members = stars.join(rep.where("doc_id = rep").select(F.col("rep").alias("node"), "n").distinct(), "node")
    large = members.groupBy("head").agg(F.ceil(F.sum("n") / tile_shingles).cast("int").alias("tiles")).where("tiles > 1")
    members = members.join(written(large, "large"), "head", "left").select(F.col("node").alias("doc_id"), "head", F.coalesce("tiles", F.lit(1)).alias("tiles")).distinct()
    members = written(members.withColumn("tile", F.expr("pmod(xxhash64(doc_id), tiles)").cast("int")), "members")
    # Members grow with the input, so they are not broadcast, at any size.
    placed = source.join(members.hint("merge"), "doc_id").select("doc_id", "head", "tiles", "tile", "text")
    parts = max(32, buckets // 4)

    def in_tiles(batches):
        return_memory()
        for t in by_key(batches, "tile_key"):
            rows, sets = text_sets(t.column("text"), k)
            ids, heads, tiles = (np.asarray(t.column(c))[rows] for c in ("doc_id", "head", "tiles"))
            label = tile_labels(ids, sets, percent)
            of = dict(zip(ids.tolist(), label.tolist()))
            apart = (tiles > 1) & (label != np.array([of.get(h, -1) for h in heads.tolist()], np.int64))
            yield pa.record_batch([pa.array(ids), pa.array(label), pa.array(heads), pa.array(apart)], names=["doc_id", "label", "head", "apart"])

    # Texts are moved, not their sets: a shingle's hash takes more bytes than its text.
    spread = placed.withColumn("tile", F.explode(F.when((F.col("doc_id") == F.col("head")) & (F.col("tiles") > 1), F.expr("sequence(0, tiles - 1)")).otherwise(F.array("tile"))))
    keyed = spread.withColumn("tile_key", F.xxhash64("head", "tile")).repartition(parts, "tile_key").sortWithinPartitions("tile_key")
    found = written(keyed.mapInArrow(in_tiles, "doc_id long, label long, head long, apart boolean"), "links")
    links = found.where("doc_id <> label").select("doc_id", "label").unionByName(pairs.where("sure").select(F.col("node").alias("doc_id"), F.col("head").alias("label")))
    if found.where("apart").limit(1).count():
        links = links.unionByName(_across(placed.where("tiles > 1"), found, percent, k, tile_shingles, parts))
    several = rep.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    ties = rep.join(several, "doc_id").where("rep <> low").select(F.col("rep").alias("doc_id"), F.col("low").alias("label"))
    links = connected(links.unionByName(ties), "doc_id", "label")
    label = one.join(links.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    label = written(label, "labels")  # so that the join below can split hot sets
    rows = base.join(label, ["f1", "f2", "n"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _across(placed: DataFrame, found: DataFrame, percent: int, k: int, tile_shingles: int, parts: int) -> DataFrame:
    """Links of what stands apart from its star's head with all tiles of the star."""
    # Written, so that Spark knows the size and moves the sets only where these are too many to be sent to all.
    apart = written(found.where("apart").select("doc_id", "head").distinct(), "apart")
    queries = placed.join(apart, ["doc_id", "head"], "left_semi")
    size = F.sum(F.octet_length("text")) / (tile_shingles * 6)  # about six bytes a shingle
    turns = written(queries.groupBy("head").agg(F.ceil(size).cast("int").alias("turns")), "turns")
    queries = queries.join(turns, "head").select(
        "doc_id", "head", "text", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.expr("pmod(xxhash64(doc_id), turns)").cast("int").alias("turn"), F.lit(True).alias("query")
    )
    rest = placed.join(turns, "head").select("doc_id", "head", "text", "tile", F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"), F.lit(False).alias("query"))
    keyed = queries.unionByName(rest).withColumn("tile_key", F.xxhash64("head", "tile", "turn")).repartition(parts, "tile_key").sortWithinPartitions("tile_key")

    def run(batches):
        for t in by_key(batches, "tile_key"):
            rows, sets = text_sets(t.column("text"), k)
            got = cross_links(np.asarray(t.column("doc_id"))[rows], sets, np.asarray(t.column("query").combine_chunks())[rows], percent)
            if got:
                x, y = np.array(got).T
                yield pa.record_batch([pa.array(x), pa.array(y)], names=["doc_id", "label"])

    return keyed.mapInArrow(run, "doc_id long, label long")
