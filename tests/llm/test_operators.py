"""Each operator on small tables with nulls, empty and repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.llm import ann, components, decontam, jaccard, linededup, lm_score, packing, quality, queries, suffix, tokencount, warc
from stridelake.llm.queries import tokenizer_path

WORDS = ["The", "of", "and", "ground", "Water", "is", "under", "é", "naïve", "x1", "stone", "old", "long", "tree", "way", "seen"]


def make_texts(seed=3, n=60):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    base = ["\n".join(line(rng.randint(3, 30)) for _ in range(rng.randint(1, 7))) for _ in range(n)]
    near = [t.replace("stone", "rock", 1) for t in base[:10]]
    return [*base, *near, base[0], base[0], base[1] + "\n" + base[2], base[2] + " end", None, "", " \n\t ", "a", "a b", "tree " * 900]


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 0, "r") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no id at all here", "k", 0, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, n int, rid string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())


def brute_mixture(rows, rounds=12):
    """log10 probability of each document by plain dictionaries: order 3, buckets of both contexts, EM on fold 1."""
    fold = lambda d: 2 if d is None else zlib.crc32(str(d).encode()) % 10
    sents = [(d, fold(d), [b"<s>", b"<s>", *[w.decode() for w in tokens(t)], b"</s>"]) for d, t in rows]

    def counts(folds):
        grams, contexts = collections.Counter(), collections.Counter()
        for _, f, s in sents:
            if f in folds:
                for i in range(2, len(s)):
                    for m in (1, 2, 3):
                        grams[tuple(s[i - m + 1 : i + 1])] += 1
                        contexts[tuple(s[i - m + 1 : i])] += 1
        return grams, contexts

    kinds = sum(len(g) == 1 for g in counts(set(range(1, 10)))[0])

    def events(s, model):
        grams, contexts = model
        for i in range(2, len(s)):
            p, level = [1 / (kinds + 1)], []
            for m in (1, 2, 3):
                c = contexts[tuple(s[i - m + 1 : i])]
                p.append(grams[tuple(s[i - m + 1 : i + 1])] / max(c, 1))
                level.append(min(23, c.bit_length()))
            yield (level[2], level[1]), p

    allowed = lambda b: [1, 1, int(b[1] > 0), int(b[0] > 0)]
    weights = lambda b: known.get(b) or [x / sum(allowed(b)) for x in allowed(b)]
    known, kept = {}, counts(set(range(2, 10)))
    seen = [e for _, f, s in sents if f == 1 for e in events(s, kept)]
    for _ in range(rounds):
        total = collections.defaultdict(lambda: [0.0] * 4)
        for b, p in seen:
            parts = [w * x for w, x in zip(weights(b), p)]
            total[b] = [t + x / sum(parts) for t, x in zip(total[b], parts)]
        whole = [sum(t[k] for t in total.values()) + 1e-3 for k in range(4)]
        overall = [x / sum(whole) for x in whole]
        known = {}
        for b in {(i, j) for i in range(24) for j in range(24)}:
            smooth = [(t + o) * a for t, o, a in zip(total[b], overall, allowed(b))]
            known[b] = [x / sum(smooth) for x in smooth]
    final = counts(set(range(1, 10)))
    return {d: sum(math.log10(sum(w * x for w, x in zip(weights(b), p))) for b, p in events(s, final)) for d, _, s in sents}


def test_lm_score(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 != 0
    count = collections.Counter(w for d, t in rows if train(d) for w in [*tokens(t), None])
    n, v = sum(count.values()), len(count)
    got = {(r.doc_id): r for r in lm_score.score(docs).collect()}
    for d, t in rows:
        ws, r = [*tokens(t), None], got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.held_out == (not train(d)) and r.score < 0
    want = brute_mixture(rows)
    assert all(got[d].score == pytest.approx(want[d], rel=1e-9) for d, _ in rows)
    held = [r for r in got.values() if r.held_out]
    # These words are drawn independently, so longer contexts can teach nothing; mixing them must cost next to nothing.
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)
    assert lm_score.score(none).count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), length=64).orderBy("sequence_id", "offset").collect()
    at = 0
    for r in got:
        assert r.sequence_id * 64 + r.offset == at and r.length <= 64
        at += r.length
    pieces = collections.defaultdict(dict)
    for r in got:
        pieces[r.doc_id][r.start] = list(np.frombuffer(r.ids, "<u4"))
    assert sum(r.length for r in got if r.doc_id == 0) == 2 * next(r.doc_tokens for r in got if r.doc_id == 0)  # there twice
    for i, t in list(enumerate(TEXTS))[1:]:
        assert [x for _, p in sorted(pieces[i].items()) for x in p] == enc.encode(t or "", add_special_tokens=False).ids + [1]
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def ann_brute(ids, x, q):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    d[ids == q] = np.inf
    order = np.lexsort((ids, d))[:10]
    return ids[order].tolist(), d[order]


def test_ann(spark):
    """Every case of the docstring with the whole index visited, so that results are exact."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8)).round(3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, x[0].tolist(), 0), (500, None, 0), (501, [0.0] * 8, 0), (502, [float("nan")] * 8, 0), (503, [None] * 8, 0), (504, [1.0], 0), (None, x[1].tolist(), 0), rows[7], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")
    ids, all_x = np.array([*range(400), 1000]), np.concatenate([x, x[:1]])
    for group_rows in (20_000, 5):
        got = collections.defaultdict(list)
        for r in ann.search(df, share=1.0, group_rows=group_rows).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert len(got) == 5
        for q in (0, 100, 200, 300, 1000):
            want, d = ann_brute(ids, all_x, q)
            assert [v for v, _ in got[q]] == want and np.allclose([s for _, s in got[q]], d)
    assert ann.search(df.where("false")).count() == 0
    assert [(r.query_id, r.vec_id) for r in ann.search(df.where("vec_id in (100, 3)")).collect()] == [(100, 3)]


@pytest.mark.parametrize("clustered", [True, False])
def test_ann_recall(spark, clustered):
    """Recall of the pruned search on 6,000 vectors; clustered ones need a small share of the index."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32))
    if clustered:
        x = rng.standard_normal((150, 32))[rng.integers(0, 150, 6000)] * 3 + 0.3 * x
    ids = np.arange(6000)
    shares = []
    real = ann.needed_share
    ann.needed_share = lambda *a, **k: shares.append(real(*a, **k)) or shares[-1]
    try:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found = collections.defaultdict(set)
        for r in ann.search(df, group_rows=1000).collect():
            found[r.query_id].add(r.vec_id)
    finally:
        ann.needed_share = real
    hits = sum(len(found[q] & set(ann_brute(ids, x, q)[0])) for q in range(0, 6000, 100))
    assert hits >= 0.9 * 600 and shares[0] < (0.15 if clustered else 0.8)


def test_warc(spark):
    long = "<p>" + "é" * 80
    rows = [(5, "u", long), (3, None, long), (3, None, long), (9, "a\r\nb", "short"), (10, "c", "short"), (11, "d", None), (12, "e", "x" * 70000), (None, "f", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    members = warc.normalise(warc.archives(pages, archive_bytes=50))
    got = {r.page_id: r for r in warc.read_back(members).collect()}
    assert got[5].refers_to == 3 and got[5].record_type == "revisit" and got[3].record_type == "response"
    assert got[9].record_type == got[10].record_type == "response" and got[11].payload_bytes == 0
    assert got[12].payload_digest == hashlib.sha256(b"x" * 70000).hexdigest() and got[None].refers_to == 3
    assert bytes(got[12].payload) == b"x" * 70000
    assert warc.sidecar(members).count() == len(rows)
    assert warc.read_back(warc.normalise(warc.archives(pages.where("false")))).count() == 0
    clash = pages.withColumns({"payload": F.lit(1), "sha256": F.lit("x"), "first": F.lit(2), "n": F.lit(3)})
    assert {r.page_id for r in warc.read_back(warc.normalise(warc.archives(clash))).collect()} == set(got)


@pytest.mark.parametrize("members", [False, True])
def test_warc_cut_short(members):
    """A stream that lost its end raises, wherever it was cut."""
    recs = [warc.record(i, f"u{i}", bytes([65 + i]) * 300, "ab", None) for i in range(5)]
    pack = lambda x: zlib.compressobj(3, zlib.DEFLATED, 31)
    z, whole = pack(0), b""
    for r in recs:
        whole += z.compress(r)
        if members:
            whole, z = whole + z.flush(), pack(0)
    whole += b"" if members else z.flush()
    assert len(list(warc.records(warc.inflate(whole)))) == 5
    for cut in (1, 9, 30, len(whole) // 2):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(warc.inflate(whole[:-cut])))


@pytest.mark.parametrize("most_shard", [32 << 20, 500])
def test_suffix(docs, none, most_shard):
    length = 60
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = collections.Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    want = []
    for d, b in rows:
        keep, spans = np.ones(len(b), bool), 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                keep[i : i + length] = False
        gone = np.concatenate([[False], ~keep])
        spans = int((gone[1:] & ~gone[:-1]).sum())
        want.append((d, len(b), int((~keep).sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest()))
    got = [tuple(r) for r in suffix.digest(docs, length=length, most_shard=most_shard).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert suffix.repeats(none).count() == 0


def test_suffix_windows_of_a_heavy_anchor_give_joined_spans(spark):
    common = bytes(np.random.default_rng(5).integers(97, 123, 100).astype(np.uint8))
    blobs = [b"." * 40 + common + b"," * 40, b";" * 30 + common, b":" * 70, b"(" + common[:70] + b")" * 9 + common[30:] + b"("]
    parts = spark.createDataFrame([(7, i, len(x), x) for i, x in enumerate(blobs)], "anchor long, seg long, size long, blob binary")
    got = {r.seg: (r.anchor, r.size, r.spans) for r in suffix._by_window(parts.union(parts), 60).collect()}
    assert got == {0: (7, 180, [40, 140]), 1: (7, 130, [30, 130]), 2: (7, 70, [0, 70]), 3: (7, 151, [1, 71, 80, 150])}


def test_suffix_query_shows_what_is_kept_of_planted_passages(spark, tmp_path):
    """Passages of 60 words: of 400 bytes or more they go, of less they stay, and n_bytes is the whole text's either way."""
    rng = random.Random(11)
    prose = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    passages = [prose(60, size) for size in (5, 5, 5, 7, 7, 7)]  # 359 and 479 bytes
    texts = [f"{prose(80, 6)} {c}\n{p}\n{c} {prose(40, 6)}" for p in passages for c in "xyz"] + [prose(150, 6) for _ in range(9)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_suffix(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        gone = "\n" + passages[i // 3] + "\n" if 9 <= i < 18 else ""
        kept = text.replace(gone, "") if gone else text
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_bytes) == (len(text), len(gone), len(kept))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def brute_classes(rows, percent, k):
    sets = {}
    for d, t in rows:
        w = tokens(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("percent", "k", "tile"), [(90, 3, 2_000_000), (80, 5, 2_000_000), (90, 3, 40)])
def test_jaccard(docs, none, percent, k, tile):
    want = brute_classes([(i, t) for i, t in enumerate(TEXTS)], percent, k)
    got = [r for r in jaccard.join(docs, percent, k, tile_shingles=tile).collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert tile < 100 or jaccard.join(none).count() == 0


def test_jaccard_descending(spark):
    """One task meets equal sets in several slices, the smallest doc_id last."""
    text = " ".join(f"w{i}" for i in range(100))
    fill = lambda x: " ".join(f"f{x}n{i}" for i in range(250_000))
    rows = [(50, text), (40, fill(0)), (20, text.replace("w99", "other")), (15, fill(1)), (10, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {50: 10, 40: 40, 20: 10, 15: 15, 10: 10}


def test_jaccard_many_tasks(spark):
    """Near copies, shared passages and equal ids in many orders and tasks, with stars of one tile and of several."""
    rng = random.Random(8)
    words = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    shared, rows = [words(30) for _ in range(3)], []
    for _ in range(40):
        base = words(rng.choice([9, 40, 80]))
        for _ in range(rng.randint(1, 6)):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            rows.append(near + (shared[rng.randrange(3)] if rng.random() < 0.5 else []))
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want = brute_classes(rows, 80, 3)
    for order, tile in ((1, 2_000_000), (-1, 2_000_000), (1, 150)):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(7 if order > 0 else 1)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, 80, 3, tile_shingles=tile).collect()}
        assert got == want
    twice = [(1, "a b c d e f"), (2, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (4, None)]
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(twice, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 51), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}
    assert components.connected(edges.where("false")).count() == 0


def test_components_hub(spark):
    """Hubs far above `hub_edges`, a node with many lower neighbours, and random links."""
    rng = random.Random(2)
    links = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(100, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {x: find(x) for link in links for x in link if link[0] != link[1]}
    got = components.connected(spark.createDataFrame(links + links[:9], "a long, b long"), hub_edges=7).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_tokencount(spark, docs):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(tokenizer_path())
    count = lambda t: len(enc.encode(t, add_special_tokens=False).ids)
    rng, edits, after = random.Random(1), [], {}
    for i, t in enumerate(TEXTS):
        t = t or ""
        for seq in range(i % 4):
            at, gone, more = rng.randint(0, len(t) + 2), rng.randint(0, 9), rng.choice(["", " ", "it's", "\n\n ", "new words go here, 12."])
            edits.append((i, seq, at, gone, more))
            at = min(at, len(t))
            t = t[:at] + more + t[at + gone :]
        after[i] = t
    assert tokencount.apply_edits(docs.where("false"), spark.createDataFrame(edits, "doc_id long, seq int, at int, removed int, inserted string"), tokenizer_path()).count() == 0
    table = spark.createDataFrame([*edits, (999, 0, 0, 0, "x"), (0, None, None, None, None)], "doc_id long, seq int, at int, removed int, inserted string")
    for r in tokencount.apply_edits(docs, table, tokenizer_path()).collect():
        if r.doc_id is not None:
            assert (r.text_after, r.n_after, r.n_tokens) == (after[r.doc_id], count(after[r.doc_id]), count(TEXTS[r.doc_id] or ""))


def brute_lines(rows, least=2):
    """Text that is left of each (doc_id, text), and lines removed: runs of `least` lines with text that occur before go."""
    rows, seen, cut = set(rows), {}, {}
    order = lambda d: (1 << 63) - 1 if d is None else d
    runs = {}
    for d, t in rows:
        b = (t or "").encode()
        lines, at = [], 0
        for x in b.split(b"\n"):
            lines.append((at, at + len(x)))
            at += len(x) + 1
        solid = [(u, v) for u, v in lines if b[u:v].strip(b" \t\r\v\f")]
        runs[d, t] = [(solid[i][0], solid[i + least - 1][1]) for i in range(len(solid) - least + 1)]
        for u, v in runs[d, t]:
            place = (order(d), t, u)
            seen[b[u:v]] = min(seen.get(b[u:v], place), place)
    for (d, t), spans in runs.items():
        b = (t or "").encode()
        keep = np.ones(len(b) + 1, bool)
        for u, v in spans:
            if seen[b[u:v]] != (order(d), t, u):
                keep[u : v + 1] = False
        starts = [i for i in range(len(b)) if i == 0 or b[i - 1] == 10]
        left = np.frombuffer(b, np.uint8)[keep[: len(b)]].tobytes().decode()
        cut[d, t] = (None if t is None else left, len(starts), sum(not keep[i] for i in starts))
    return cut


def test_linededup(spark, none):
    a, b, c = "first line here\nsecond line there", "third thing\nfourth thing\nfifth thing", "only one line"
    rows = [(1, a), (2, a), (3, b), (4, b + "\n"), (5, c), (6, c), (7, None), (8, ""), (2, a), (9, "x\n\n" + a.replace("\n", "\n\n")), (10, "y\n" + a.replace("\n", "\n\n"))]
    docs = spark.createDataFrame([(i, t, 1, 2, "k", 3) for i, t in rows], "doc_id long, text string, h int, n_lines int, rid string, id int")
    got = collections.defaultdict(set)
    for r in linededup.dedup(docs).collect():
        got[r.doc_id].add((r.text, r.rid, r.id, r.h))
    left = {1: a, 2: "", 3: b, 4: "", 5: c, 6: c, 7: None, 8: "", 9: rows[9][1], 10: "y\n"}
    assert {d: {x[0] for x in v} for d, v in got.items()} == {d: {t} for d, t in left.items()} and len(got) == 10
    assert all(x[1:] == ("k", 3, 1) for v in got.values() for x in v)
    assert linededup.dedup(none).count() == 0


def test_linededup_passages(spark):
    """Passages of two to six lines in unlike contexts, repeats within a text, long texts, at production parameters."""
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12)))
    passages, rows = [[line() for _ in range(k)] for k in (2, 2, 3, 4, 5, 6)], []
    for i in range(120):
        lines = [line() for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = passages[rng.randrange(6)]
        if rng.random() < 0.2:
            lines.insert(rng.randint(0, len(lines)), " \t")
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    rows += [(500, "\n".join([line() for _ in range(30_000)] + passages[5])), (None, "\n".join(passages[3])), rows[0], rows[1], (3, "other\ntext"), (600, None), (601, "")]
    want = brute_lines(rows)
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("was", F.col("text")).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        if (r.doc_id, r.was) != (3, rows[3][1]):  # ties within one doc_id go by the text's hash
            assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id, r.was]
    table = spark.createDataFrame(rows[:120], "doc_id long, text string")
    for least, spread in ((3, 2), (3, 3), (4, 3)):  # no run is lost at any spread
        some = {r.doc_id: r.n_removed for r in linededup.dedup(table, spread, least).collect()}
        most = brute_lines(rows[:120], least)
        assert all(some[d] == most[d, t][2] for d, t in rows[:120]) and 0 < sum(some.values())
    with pytest.raises(ValueError):
        linededup.dedup(table, 1, 2)


def test_linededup_boundaries():
    """Boundaries move with their lines, are fewer than the lines, and each run of `least` lines holds a whole chunk."""
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(9))
    shared = [line() for _ in range(40)]

    def chosen(lines, spread, least):
        data = np.frombuffer("\n".join(lines).encode(), np.uint8)
        _, at, h = linededup.line_chunks(data, np.array([0, len(data)]), spread, least)
        return dict(zip(at.tolist(), h.tolist()))

    for least, spread in ((2, 2), (4, 2), (5, 4)):
        rolled = least - spread + 1
        one, two = (chosen([line() for _ in range(k)] + shared + [line() for _ in range(3)], spread, least) for k in (2, 7))
        inner = range(spread, 40 - least - spread)
        assert {i: one[i + 2] for i in inner if i + 2 in one} == {i: two[i + 7] for i in inner if i + 7 in two}
        assert all(any(i + j in one for j in range(least - rolled + 1)) for i in range(45 - least + 1)) and len(one) < 40


def test_quality(spark, none):
    rng = random.Random(4)
    good = [" ".join(rng.choice(WORDS) for _ in range(200)) for _ in range(80)]
    bad = [g[:600] + " " + " ".join(rng.choice(["###", "!!!", "BUY", "$$$"]) for _ in range(80)) for g in good[:40]]
    rows = [(i, t, 0.0) for i, t in enumerate([*good, *bad])] + [(500, None, 0.0), (501, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)] + [(3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [i for i in range(120) if got[i].held_out]
    assert len(got) == 122 and 0 <= got[500].score <= 1
    assert sum(got[i].predicted == int(i < 80) for i in held) >= 0.95 * len(held)
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_decontam(spark, docs, none):
    item = "Seven grey herons stood along the flooded canal while the miller counted out his last copper coins"
    edited = item.replace("flooded", "floded").replace("miller", "millerr").upper()
    rows = [(1, "x " * 50 + item + " y" * 30), (2, edited), (3, item[:40]), (4, None), (5, ""), (6, "tiny bird"), (6, item)]
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "tiny b")], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in decontam.matches(table, bench).collect()}
    assert got == {(1, 0): (100, 100 + len(item), 0), (2, 0): (0, len(edited), 2), (6, 3): (0, 6, 0), (6, 0): (0, len(item), 0)}
    assert sorted(r.doc_id for r in decontam.clean(table, bench).collect()) == [3, 4, 5]
    assert decontam.matches(none, bench).count() == decontam.matches(table, bench.where("false")).count() == 0


def least_edits(item, text):
    """Fewest edits between the item and any part of the text, by the whole table."""
    d = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(d[1:] + 1, d[:-1] + np.array([c != x for x in text], int))])
        d = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new)) if len(text) else new
    return int(d.min())


def fold(t):
    return re.sub("[\\t-\\r ]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).encode()


def test_decontam_brute(spark):
    """Which items occur within their edit budget, and every place of short ones, against whole-table alignment."""
    rng = random.Random(12)
    words = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    items = [words(rng.randint(8, 25)) for _ in range(12)] + ["old", "is un", "           x           y", None]
    rows = []
    for i in range(60):
        t = words(rng.randint(5, 60))
        if rng.random() < 0.7:
            item = list(items[rng.randrange(12)])
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
            t = t + " " + "".join(item) + "\n" + words(5)
        rows.append((i, t, "x", 1))
    rows += [(90, " " * 3000 + items[0], "x", 1), (91, (words(20_000) + "\n") * 2 + items[1] + words(20_000), "x", 1), (92, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, start int").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = collections.defaultdict(set)
    for r in decontam.matches(docs, bench).collect():
        got[r.doc_id, r.item_id].add((r.start, r.end, r.edits))
    for d, t, *_ in rows:
        text = fold(t)
        for k, item in enumerate(items):
            size = len(fold(item))
            if not size:
                assert not got.get((d, k))
            elif size < decontam.Q:
                assert got.get((d, k), set()) == {(m.start(), m.start() + size, 0) for m in re.finditer(b"(?=" + re.escape(fold(item)) + b")", text)}
            elif len(text) < 5000:
                most = max(0, min(int(size * decontam.EDIT_RATE), size // decontam.Q - 1))
                assert bool(got.get((d, k))) == (least_edits(fold(item), text) <= most), (d, k)
    assert got[90, 0] and got[91, 1] and got[90, 0] <= {(3000, 3000 + len(fold(items[0])), 0)}
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, *_ in rows} - {d for d, _ in got if got[d, _]}


def test_pipeline_stages(spark, none):
    """Each stage against brute force, on texts with copies, passages and items; cases of the docstring."""
    import corpus_pipeline

    stages, at = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    items = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    rng = random.Random(3)
    words = lambda k: " ".join(f"word{rng.randrange(900)}" for _ in range(k))
    passage = words(40) + "\n" + words(40)
    texts = [words(60) + "\n" + words(70) for _ in range(20)]
    texts += [t.replace("word1", "other", 1) for t in texts[:8]] + [texts[0], words(50) + "\n" + passage, passage + "\n" + words(30)]
    texts += [f"{words(30)} {t} {words(30)}" for t in items] + ["", None, "single line"]
    rows = [(i, t, "k", i, float(i)) for i, t in enumerate(texts)] + [(None, words(20), "k", 1, 0.0), (5, "a second text of one id", "k", 1, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, kept_rows int, score double").repartition(3)
    table = lambda d: {(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()}

    lines = brute_lines([(r[0], r[1]) for r in rows])
    got = stages["line dedup"](spark, docs, at)
    assert got.columns == docs.columns
    assert table(got) == {(d, left) for (d, _), (left, _, gone) in lines.items() if not gone or left.strip()}

    classes = brute_classes([(r[0], r[1]) for r in rows[:-2]], 80, 5)
    got = stages["near duplicates"](spark, docs.unionByName(docs.where("doc_id = 3")), at)
    kept = table(got)
    assert {(d, t) for d, t in kept if d is not None} == {(d, t) for d, t, *_ in rows if d is not None and classes[d][1] == d}
    assert got.where("doc_id = 3").count() == 1 and got.where("doc_id = 5").count() == 2 and got.where("doc_id is null").count() == 1

    got = table(stages["decontamination"](spark, docs, at))
    assert got == {(r[0], r[1]) for r in rows if not any(i in (r[1] or "") for i in items)}

    model = quality.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    scores = [r for r in quality.score(docs, model).collect() if r.score >= 0.3]
    assert collections.Counter(r.doc_id for r in stages["quality"](spark, docs, at).collect()) == collections.Counter(r.doc_id for r in scores)

    packed = stages["packing"](spark, docs, at).collect()
    assert sum(r.start == 0 for r in packed) == len(rows)
    for stage in stages.values():
        assert stage(spark, docs.where("false"), at).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).select("doc_id").distinct().count() == len(kept)
