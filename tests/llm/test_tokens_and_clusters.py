"""Token counts, token alignment and centroid clusters against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from navette.llm import alignment, centroid_clusters, token_counts
from navette.llm.centroid_tree import CentroidTree, squared_distances
from navette.llm.encoding import Encoder, Vocabulary

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCRAPS = [" ", "  ", "\n", "\t", "\r\n", "\v", "\f", "\x1c", "\x85", " ", " ", "　", " ", "é", "́", "é", "É", "ß",
          "İ", "Σ", "ﬁ", "①", "日本", "😀", "a", "the", "The cat", "it's", "'S", "'s", "don't", "12", "3.5", "...", "<|endoftext|>", "<|startoftext|>",
          "<s>", "</s>", "<unk>", "<0x41>", "▁", "\x00", "word", "être", "straße", "_", "%", "가", "“x”", "–"]


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(SCRAPS, rng.integers(0, 14))) for _ in range(n)]


def counted(path, texts):
    if path.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(x) for x in library.encode(texts)]
    library = Tokenizer.from_file(path)
    return [len(library.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_token_counts_equal_the_library(spark, path):
    texts = [*random_texts(1500, 3), " ".join(random_texts(3000, 4)), "x" * 5000, " " * 3000, ""]
    texts += [t for t in ("a ", " a", "  a  b  ", "\n a", "a\n", " ") for _ in range(2)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, None, 7), (1, "again", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    n = counted(path, texts)
    want = [(False, i, len(t.encode()), n[i]) for i, t in enumerate(texts)]
    want += [(True, 0, 0, 0), (False, 1, 5, counted(path, ["again"])[0])]
    assert got == sorted(want)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def tokens_of(text, one, two, names):
    whole = b" " + text.encode()
    ids = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    if any(b"".join(n[i] for i in x) != whole for x, n in zip(ids, names, strict=True)):
        return [], []
    return ids


def spans(ids, names):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(names[i])))
        at = out[-1][1]
    return out


def aligned_by_hand(texts):
    """Rows of the contract from overlaps of all byte ranges."""
    one, two = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    one.encode_special_tokens = True
    names = [Encoder(Vocabulary.read(p), plain=True).token_bytes() for p in (BYTE, PIECE)]
    rows, held = [], Counter()
    for text in texts:
        ids = tokens_of(text, one, two, names) if text else ([], [])
        a, b = (spans(x, n) for x, n in zip(ids, names, strict=True))
        links = [(ids[0][i], ids[1][j]) for i, x in enumerate(a) for j, y in enumerate(b) if max(x[0], y[0]) < min(x[1], y[1])]
        held.update(set(links))
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        told = []
        for start, stop in zip([0, *cuts], cuts, strict=False):
            inside = [[str(i) for i, (s, e) in zip(x, y, strict=True) if start <= s and e <= stop] for x, y in zip(ids, (a, b), strict=True)]
            told.append("|".join(map(",".join, inside)))
        rows.append((len(a), len(b), len(cuts), links, ";".join(told)))
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    return [
        (n, m, g, len(links), sum(held[x] == highest[x[0]] for x in links), sum(held[x] for x in links), told)
        for n, m, g, links, told in rows
    ]


@pytest.mark.parametrize("most", [alignment.TABLE_PAIRS, 300, 0])
def test_alignment_equals_overlaps_of_all_ranges(spark, most):
    texts = [*random_texts(250, 5), "the cat sat on the mat. " * 40, "x" * 300, " ", "a ", "", None, None]
    texts += ["".join(t for t in random_texts(60, 9) if "▁" not in t), "again", "again"]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int").repartition(3)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = alignment.aligned_tokens(docs, BYTE, PIECE, table_pairs=most).collect()
    want = [(i if i != 3 else None, *r) for i, r in enumerate(aligned_by_hand(texts))]
    assert sorted(map(str, ((r.doc_id, *(r[c] for c in columns)) for r in got))) == sorted(map(str, want))


def test_digest_is_that_of_the_groups(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "▁")], "doc_id long, text string")
    told = {r.doc_id: r.groups for r in alignment.aligned_tokens(docs, BYTE, PIECE).collect()}
    digests = {r.doc_id: r.groups for r in alignment.aligned_tokens(docs, BYTE, PIECE, digest=True).collect()}
    assert told[2] == told[3] == digests[2] == digests[3] == ""
    assert digests[1] == hashlib.sha256(told[1].encode()).hexdigest() and "|" in told[1]
    assert alignment.aligned_tokens(docs.limit(0), BYTE, PIECE).count() == 0


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64, 10_000])
def test_merge_does_not_depend_on_its_pieces(work):
    rng = np.random.default_rng(work)
    for _ in range(60):
        total = int(rng.integers(1, 200))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, total), rng.integers(0, total), replace=False)), total) for _ in "ab")
        links, groups = alignment.merged(a, b, work)
        i, j = alignment.diagonals(a, b, work)
        assert (np.diff(i + j) <= work).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        ranges = [list(zip(np.append(0, x[:-1]).tolist(), x.tolist(), strict=True)) for x in (a, b)]
        want = {(p, q) for p, x in enumerate(ranges[0]) for q, y in enumerate(ranges[1]) if max(x[0], y[0]) < min(x[1], y[1])}
        assert sorted(zip(*map(np.ndarray.tolist, links), strict=True)) == sorted(want)
        both = np.intersect1d(a, b)
        assert a[groups[0]].tolist() == both.tolist() == b[groups[1]].tolist()


def clusters_by_hand(rows, k, rounds, dim):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == dim and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(256 * x) for x in vector]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    centroids = [list(v) for _, v in order[:k]]

    def nearest():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = nearest()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = nearest()
    own = Counter()
    for d, n in found:
        own[n] += d
    return sorted(
        (key is None, key or 0, n, d, own[n], sum(own.values()), tuple(centroids[n])) for (key, _), (d, n) in zip(kept, found, strict=True)
    )


@pytest.mark.parametrize("k", [1, 5, 12, 500])
def test_clusters_equal_exact_rounds(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, rng.integers(-3, 4, 6) / rng.choice([1, 64, 256]) + 0.0) for i in range(120)]
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1]), (201, None), (202, []), (203, [1.0] * 5), (204, [1.0] * 5 + [None])]
    rows += [(205, [math.nan] * 6), (206, [math.inf] + [0.0] * 5), (207, [0.0] * 6), (208, [9000.0, -9000.0] * 3)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    found, centroids = centroid_clusters.centroid_clusters(frame, k=k, components=6)
    got = sorted(
        (r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(centroids[r.cluster].tolist()))
        for r in found.collect()
    )
    assert got == clusters_by_hand(rows, k, 5, 6)


def test_clusters_of_nothing_and_of_huge_components(spark):
    schema = "vec_id long, embedding array<float>"
    empty, centroids = centroid_clusters.centroid_clusters(spark.createDataFrame([], schema))
    assert empty.count() == 0 and len(centroids) == 0
    frame = spark.createDataFrame([(1, [1e30] * 64), (2, [0.5] * 64)], schema)
    found, _ = centroid_clusters.centroid_clusters(frame)
    assert [tuple(r) for r in found.collect()] == [(2, 0, 0, 0, 0)]


def test_tree_finds_the_smallest_number_of_equal_distances():
    rng = np.random.default_rng(8)
    for size in (1, 3, 40, 90):
        for scale in (2, 200, 1 << 27):
            points = rng.integers(-scale, scale + 1, (size, 3))
            points[size // 2 :] = points[: size - size // 2]  # copies
            vectors = rng.integers(-scale, scale + 1, (400, 3))
            who, best = CentroidTree(points, leaf=2).nearest(vectors)
            exact = np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(v, p, strict=True)) for p in points] for v in vectors])
            assert (squared_distances(vectors, points) == exact).all()
            assert (who == exact.argmin(1)).all() and (best == exact.min(1)).all()
