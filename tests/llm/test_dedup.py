"""Deduplicating operators against brute force on small frames."""

import hashlib
import random
import re

import numpy as np
import pytest

from navette.llm import common, embedding_dedup, ngram_join, suffix_dedup
from navette.llm.common import components
from navette.llm.count_tree import CountTree, count_vectors, least_overlap, overlap_bound

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n long, cls string, route string, settled string"


def texts_with_copies():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(12)]
    passage = " ".join(word() for _ in range(30))
    out = {}
    for i in range(70):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5, 9))):
            words[rng.randrange(len(words))] = word()
        text = " ".join(words)
        if i % 7 == 0:
            text = f"{text}\n{passage} {word()}"
        if i % 11 == 0:
            text = text.upper()
        out[i + 1] = text
    out |= {100: "", 101: None, 102: "one two", 103: "ONE  two", 104: "  \n ", 105: "é" * 60, 106: "é" * 60, 107: "a" * 5000}
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 9, "x", "y", "z") for i, t in texts.items()], DOCS)


def expected_groups(texts):
    sets = {}
    for i, t in texts.items():
        words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_components(spark):
    texts = texts_with_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, texts)).collect()}
    assert got == expected_groups(texts)


def test_ngram_components_of_long_texts(spark):
    """Long texts that share a passage, each with a near copy: links stay, and no others come."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    passage = " ".join(word() for _ in range(3000))
    texts = {}
    for i in range(8):
        words = [word() for _ in range(4000)]
        texts[i] = " ".join(words) + " " + passage
        words[7] = "changed"
        texts[i + 20] = " ".join(words) + " " + passage
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, texts)).collect()}
    assert got == expected_groups(texts) and all(got[i + 20][1] == i for i in range(8))


def test_ngram_remaining_pairs_in_small_blocks(spark):
    """Without any link known, the tree search alone must give every linked pair around a centre."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.05], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(40)]
    rows = []
    for i, s in enumerate(sets):
        vector = count_vectors(s, np.array([0, len(s)]))[0].tobytes()
        rows.append((i, i, len(s), bytearray(vector)))
    classes = spark.createDataFrame(rows, "cls long, rep long, n long, vec binary")
    groups = spark.createDataFrame([(0, i, 1) for i in range(40)], "centre long, cls long, place int")
    none = spark.createDataFrame([], "node long, component long")
    got = {(r.a, r.b) for r in ngram_join.remaining_pairs(groups, classes, none, 75, block=7).collect()}
    linked = {
        (a, b)
        for a in range(40)
        for b in range(a + 1, 40)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    }
    assert linked and linked <= got


def test_only_cut_classes_search_again(spark):
    """Eight near copies and far ones around one centre: the searches after the first ask for the cut classes only."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.append(base[1:], rng.integers(0, 2**63, 1, dtype=np.uint64))) for _ in range(8)]
    sets += [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(20)]
    rows = [(i, i, len(s), bytearray(count_vectors(s, np.array([0, len(s)]))[0].tobytes())) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "cls long, rep long, n long, vec binary")
    groups = spark.createDataFrame([(0, i, 1) for i in range(28)], "centre long, cls long, place int")
    none = spark.createDataFrame([], "node long, component long")
    rest = ngram_join.remaining_pairs(groups, classes, none, 75, block=9, most=1)
    first, cut = {(r.a, r.b) for r in rest.where("b is not null").collect()}, rest.where("b is null")
    assert {(r.a, r.centre) for r in cut.collect()} <= {(i, 0) for i in range(8)}
    again = cut.selectExpr("centre", "a AS cls")
    more = ngram_join.remaining_pairs(groups, classes, none, 75, block=9, most=64, again=again).collect()
    second = {(r.a, r.b) for r in more}
    linked = {(a, b) for a in range(8) for b in range(a + 1, 8)}
    assert linked <= first | second and not linked <= first
    asked = {r.cls for r in again.collect()}
    assert asked and all(a in asked or b in asked for a, b in second)
    nobody = spark.createDataFrame([], "centre long, cls long")
    assert ngram_join.remaining_pairs(groups, classes, none, 75, again=nobody).isEmpty()


def test_written_steps_hand_over_batches_cut_by_bytes(spark):
    texts = spark.range(0, 400, 1, 1).selectExpr("repeat(char(97 + id % 26), 100000) AS text")

    def sizes(batches):
        for batch in batches:
            yield type(batch).from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    found = common.written(texts.mapInArrow(sizes, "rows long, size long"), "test-batches").collect()
    assert sum(r.rows for r in found) == 400 and max(r.size for r in found) <= common.BATCH_BYTES + (1 << 20)
    assert spark.conf.get(setting) == before


def test_ngram_dealt_tokens_lose_nothing(spark):
    texts = texts_with_copies()
    docs = frame(spark, texts).select("doc_id", "text")
    cells = np.zeros(ngram_join.CELLS, np.int64)
    cells += np.arange(ngram_join.CELLS) % 2 * 50
    whole = {tuple(r) for r in ngram_join.shared_tokens(docs, cells, 75).collect()}
    dealt = {tuple(r) for r in ngram_join.shared_tokens(docs, cells, 75, spread=1).collect()}
    assert whole and whole <= dealt


def test_one_of_each_with_repeated_and_null_keys(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (2, "a b c d e f g"), (7, "other words stand here now ok"),
            (7, "quite different words of some other text"), (None, "left alone by all the others"), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS root", "2 AS component_id")
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()]
    kept = [rows[2], rows[3], rows[4], rows[5], rows[6], rows[7]]
    assert sorted(map(str, got)) == sorted(map(str, kept))


def test_near_texts_with_null_keys_link_and_bridge(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda changed: " ".join("zzzzzz" if i in changed else w for i, w in enumerate(words))
    bare = [(None, text({20})), (None, text({40})), (None, "quite other words that stand alone in this table")]
    docs = spark.createDataFrame(bare, "doc_id long, text string")
    rows = ngram_join.ngram_components(docs).collect()
    assert len(rows) == 3 and sorted(sum(r.root == q.root for q in rows) for r in rows) == [1, 2, 2]
    assert ngram_join.one_of_each(docs).count() == 2
    # keyed texts link to texts without a key
    mixed = spark.createDataFrame([(5, text({60})), *bare, (7, text({80}))], "doc_id long, text string")
    rows = ngram_join.ngram_components(mixed).collect()
    assert len({r.root for r in rows}) == 2 and {r.component_id for r in rows} == {5, None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert ngram_join.ngram_components(docs).count() == 0
    assert ngram_join.one_of_each(docs).count() == 0
    assert suffix_dedup.without_repeats(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(vectors).count() == 0


def test_count_tree_is_complete():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(300)]
    sets += [s[rng.random(len(s)) < 0.9] for s in sets[:50]]
    sets = [s for s in sets if len(s)]
    bounds = np.cumsum([0, *map(len, sets)])
    vectors, sizes = count_vectors(np.concatenate(sets), bounds), np.diff(bounds)
    tree = CountTree(vectors, sizes)
    for q in range(0, len(sets), 7):
        found = set(tree.search(vectors[q], int(sizes[q]), 75)[0].tolist())
        linked = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, sets[q])) >= 75 * len(np.union1d(s, sets[q]))}
        assert linked <= found
    big = [np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64)) for _ in range(12)]
    big += [b[rng.random(len(b)) < 0.95] for b in big] + [sets[0]]
    ends = np.cumsum([0, *map(len, big)])
    points, sizes = count_vectors(np.concatenate(big), ends), np.diff(ends)
    longer = [count_vectors(b, np.array([0, len(b)]), 4096)[0] if len(b) > 2048 else None for b in big]
    tree, coarse = CountTree(points, sizes, longer), CountTree(points, sizes)
    for q in range(24):
        found = set(tree.search(points[q], int(sizes[q]), 75, longer[q])[0].tolist())
        assert found == {q % 12, q % 12 + 12} < set(coarse.search(points[q], int(sizes[q]), 75)[0].tolist())
    full = np.full((1, 256), 255, np.uint8)
    assert overlap_bound(full, full)[0] > least_overlap(np.array([10**9]), 10**9, 75)[0]


def removed_by_brute_force(texts):
    seen, out = {}, {}
    for i, t in sorted(texts.items()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 49):
            if seen.setdefault(data[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [1, 8192])
def test_suffix_dedup(spark, monkeypatch, crowd):
    hits = suffix_dedup.window_hits
    monkeypatch.setattr(suffix_dedup, "window_hits", lambda found: hits(found, crowd))
    texts = texts_with_copies() | {200: "x" + texts_with_copies()[7][:300], 201: texts_with_copies()[7][10:59]}
    found = suffix_dedup.without_repeats(frame(spark, texts)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found}
    assert got == removed_by_brute_force(texts)


def test_suffix_dedup_of_repeated_keys(spark):
    text = "abcdefghij" * 8
    rows = [(1, text), (1, text), (1, "zz" + text), (2, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(docs).collect())
    assert got == [("1", 80, 0), ("1", 80, 0), ("1", 82, 0), ("2", 80, 80), ("None", 80, 0)]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(70, 90), (90, 80)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 1 for i in range(1, 61)} | {70: 70, 80: 70, 90: 70} | {i: 100 for i in range(100, 160)}


@pytest.mark.parametrize("block", [5, 1024])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in base[i % 20] + rng.normal(scale=0.06, size=16)], i % 2) for i in range(200)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(12)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1e300] * 16, [1.0, None] + [0.0] * 14, [1.0, 2.0]]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, rows[0][1], None), (3001, [1e-300] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS unit")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame, block=block).collect()}
    assert len(got) == len(rows)
    links = {i: set() for i, _, _ in rows}
    usable = [(i, np.array(v), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, v, c in usable:
        for j, w, d in usable:
            if i < j and c == d and len(v) == len(w):
                v1, w1 = v / np.abs(v).max(), w / np.abs(w).max()
                if v1 @ w1 / np.linalg.norm(v1) / np.linalg.norm(w1) >= 0.93:
                    links[i].add(j), links[j].add(i)
    found, all_links = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert found >= 0.9 * all_links > 0
    assert got[2004].n_links == 1 and got[3001].component_id == 2004 and not got[3001].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2005, 3000))


@pytest.mark.parametrize("copies", [40, 200])
def test_links_of_a_growing_group_stay_few(spark, monkeypatch, copies):
    """Copies with several edits each and a passage that all share: about one link a copy, not one for each centre."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, body = [word() for _ in range(60)], [word() for _ in range(140)]
    texts = {}
    for i in range(copies):
        words = passage + body
        for at in rng.sample(range(len(words)), rng.randint(1, 5)):
            words[at] = word()
        texts[i] = " ".join(words)
    for i in range(40):  # others that share the passage only
        texts[1000 + i] = " ".join([*(word() for _ in range(200)), *passage])
    found, real = [], ngram_join.verified

    def counted(*args):
        links = real(*args)
        found.append(links.count())
        return links

    monkeypatch.setattr(ngram_join, "verified", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, texts)).collect()}
    assert got == expected_groups(texts)
    assert sum(found) <= 17 * copies, found


def test_links_join_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(120)]
    frames = [spark.createDataFrame(x, "a long, b long") for x in (edges, more)]
    parts = ngram_join.joined_components(common.components(frames[0], "test"), frames[1])
    whole = common.components(common.forest(frames[0].union(frames[1])), "test")
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in whole.collect()}
