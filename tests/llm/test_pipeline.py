"""The whole pipeline, row by row, against a chain of plain versions on a small corpus with planted cases."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_dedup import WORD, expected_groups
from test_text import REGEX, base_spans, distance_by_table

import corpus_pipeline
from navette.llm import decontaminate, quality
from navette.llm.common import utf8
from navette.llm.queries import ORACLE


def corpus():
    """(documents, labels, items, what was planted)."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(f"q{i}", prose(9)) for i in range(5)] + [("q8", None), ("q9", "")]
    texts, good, planted = {}, {}, defaultdict(set)
    for i in range(90):
        texts[i], good[i] = prose(rng.randint(40, 70)) + ".", 1
    for i in range(100, 130):
        texts[i], good[i] = "BUY NOW!! $$$ " * rng.randint(8, 14), 0
    for i in range(200, 212):  # copies and near copies of a few
        words = texts[i % 4].split()
        if i % 3:
            words[rng.randrange(len(words))] = word()
        texts[i], good[i] = " ".join(words), 1
        planted["copy"].add(i)
    for i in range(220, 228):  # items with an edit or none, amid prose
        leak = items[i % 5][1]
        leak = leak[:20] + "z" * (i % 2) + leak[20:]
        texts[i], good[i] = f"{prose(25)} {leak} {prose(25)}.", 1
        planted["leak"].add(i)
    secrets = ["jan.doe@mail.example.org", "10.20.30.40", "4111 1111 1111 1111", "+33 6 12 34 56 78"]
    for i in range(240, 252):
        texts[i], good[i] = f"{prose(30)} {secrets[i % 4]} {prose(20)}.", 1
        planted["personal"].add(i)
    texts |= {300: None, 301: "", 302: " \n "}
    docs = [(i, t, "en", [None, "a", "b", "b", "c"][i % 5], len(t or "")) for i, t in texts.items()]
    rng.shuffle(docs)
    return docs, list(good.items()), items, planted


def plain_scores(docs, labels):
    """Ridge on all rows at once by least squares, calibrated by the min-max form of isotonic regression."""
    stats = quality.statistics(*utf8(pa.array([t for _, t, *_ in docs], pa.string())))
    mean, spread = stats.mean(axis=0), stats.std(axis=0)
    x = quality.fourier(np.divide(stats - mean, spread, out=np.zeros_like(stats), where=spread > 1e-6))
    at = {d[0]: row for row, d in enumerate(docs)}
    learnt = [(at[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    calibrates = [zlib.crc32(f"part{docs[row][0]}".encode()) % 5 == 0 for row, _ in learnt]
    rows, y = np.array(learnt).T
    fits, checks = ~np.array(calibrates), np.array(calibrates)
    width = x.shape[1]
    penalty = np.sqrt(np.diag([quality.RIDGE * fits.sum() / width] * (width - 1) + [0.0]))
    weights = np.linalg.lstsq(np.vstack([x[rows[fits]], penalty]), np.concatenate([y[fits], np.zeros(width)]), rcond=None)[0]
    raw = x @ weights
    cell = np.clip((raw[rows[checks]] + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = sorted(set(cell.tolist()))
    n, g = (np.array([f(cell == b) for b in bins], float) for f in (np.sum, lambda m: y[checks][m].sum()))
    level = [
        max(min(g[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))
    ]
    knots, levels = [], []
    for value in sorted(set(level)):
        mine = np.array(level) == value
        knots.append(((np.array(bins)[mine] + 0.5) / quality.BINS * 2 - 0.5) @ n[mine] / n[mine].sum())
        levels.append((g[mine].sum() + 0.5) / (n[mine].sum() + 1))
    return np.interp(raw, knots, levels)


def plain_mask(text):
    if not text:
        return text
    kinds, out, at = list(REGEX), [], 0
    for start, kind, end in base_spans(text):
        assert start >= at  # planted spans stand apart
        out += [text[at:start], f"[{kinds[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    docs, labels, items, _ = corpus()
    path = tmp_path_factory.mktemp("corpus")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*docs)))), pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    )), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, _ in labels], "quality": [y for _, y in labels], "toxic": [0] * len(labels)}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), path / "benchmark.parquet")
    return str(path)


def test_run_equals_a_chain_of_plain_versions(spark, folder):
    docs, labels, items, planted = corpus()
    scores = plain_scores(docs, labels)
    assert np.abs(scores - 0.5).min() > 1e-6  # no row hangs on the last digits
    kept = [d for d, s in zip(docs, scores, strict=True) if s >= 0.5]
    assert {d[0] for d in docs} - {d[0] for d in kept} >= set(range(100, 130))

    groups = expected_groups({d[0]: d[1] for d in kept})
    kept = [d for d in kept if groups[d[0]][1] == d[0]]
    assert not planted["copy"] & {d[0] for d in kept}

    def leaks(text):
        text = decontaminate.normal(text)
        wanted = [decontaminate.normal(item) for _, item in items if item]
        return any(distance_by_table(item, text) <= decontaminate.edits_allowed(len(item)) for item in wanted)

    kept = [d for d in kept if not leaks(d[1])]
    assert not planted["leak"] & {d[0] for d in kept}

    kept = [(i, plain_mask(t), lang, source, len(t and plain_mask(t) or "")) for i, t, lang, source, _ in kept]
    assert all("[" in d[1] for d in kept if d[0] in planted["personal"])

    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    got = found.collect()
    clean = {d[0]: d for d in kept}
    assert all(tuple(r)[:4] == clean[r.doc_id][:4] and (r.n_chars or 0) == clean[r.doc_id][4] for r in got)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    copies = Counter(r.doc_id for r in got)

    base = duckdb.connect()
    base.register("documents", pa.table(dict(zip(["doc_id", "text", "lang", "source", "n_chars"], map(list, zip(*kept))))))
    mix = base.execute(ORACLE["op7_mix"]).df()
    sized = mix[mix["size"] > 0]
    assert {i: n for i, n in copies.items() if WORD.search((clean[i][1] or "").encode())} == {
        i: t // s for i, t, s in zip(sized["doc_id"], sized["taken"], sized["size"], strict=True) if t
    }
    assert all(n <= 2 for n in copies.values())


def test_run_of_nothing(spark, tmp_path, folder):
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
