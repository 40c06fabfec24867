"""Scoring, formatting, filtering and mixing operators on small frames."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from navette.llm import chat_format, decontaminate, mixing, personal_data, quality, toxicity, url_filter
from navette.llm.common import ByteHash
from navette.llm.queries import URL_RULES

REGEX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(REGEX.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and personal_data.passes_luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_personal_spans_equal_regular_expressions():
    rng = np.random.default_rng(5)
    find = personal_data.SpanFinder()
    pieces = ["a@b.c", "@", "x.y@z", ".de", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111",
              "+1 (555) 123-4567", "+", "12", " ", "-", ".", "é", "😀", "a", "0", "user@mail.example.com", "5500-0000-0000-0004"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 12)))
        assert [s for s in find(text) if s[1] < 4] == base_spans(text), text


def test_personal_method_adds_spans_and_masks(spark):
    text = "see http://x.org/a, or https://me:pw@host.de/ and account no: DE4450010517 now; discount 12345"
    spans = personal_data.SpanFinder()(text)
    assert [(personal_data.KINDS[k], text[a:b]) for a, k, b in spans] == [
        ("url", "http://x.org/a"), ("url", "https://me:pw@host.de/"), ("email", "pw@host.de"), ("account", "DE4450010517"),
    ]
    assert personal_data.masked(text, spans) == "see http://x.org/a, or [URL] and account no: [ACCOUNT] now; discount 12345"
    rows = [(1, "mail a@b.de"), (2, None), (3, ""), (3, "clean"), (None, "1" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS n_email")
    got = sorted(personal_data.found_spans(docs).collect(), key=str)
    assert len(got) == 5 and {r.spans for r in got} == {"", "email:5:11"}
    assert {r.base_sha256 for r in got if not r.spans} == {hashlib.sha256(b"").hexdigest()}
    assert {r.text for r in personal_data.without_personal_data(docs).collect()} == {"mail [EMAIL]", None, "", "clean", "1" * 5000}
    assert personal_data.found_spans(docs.limit(0)).count() == 0


def distance_by_table(item, window):
    last = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(window, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (a != b)))
        last = row
    return min(last)


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefg hijk"))
    draw = lambda n: "".join(rng.choice(letters, n))
    items = [(i, draw(int(rng.integers(10, 120)))) for i in range(20)] + [(50, None), (51, "  "), (52, "ABC def ghi")]
    texts = []
    for _ in range(80):
        text = draw(200)
        if rng.random() < 0.7:
            leak = list(items[rng.integers(20)][1])
            for _ in range(rng.integers(0, 8)):
                leak[rng.integers(len(leak))] = rng.choice(["", "x", "zz"])
            text = text[:90] + "".join(leak) + text[90:]
        texts.append(text)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "so ABC  DEF\nghi it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS distance")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in rows:
        for i, item in items:
            item_n, text_n = decontaminate.normal(item), decontaminate.normal(text)
            if item_n and distance_by_table(item_n, text_n) <= decontaminate.edits_allowed(len(item_n)):
                want.add((d, i, distance_by_table(item_n, text_n)))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and any(x[2] for x in want)
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in want}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_many_blocks_and_text_ids_give_the_same_leaks(spark):
    rng = np.random.default_rng(3)
    items = [(f"item-{i}", " ".join(rng.choice(["red", "green", "blue", "one", "two"], 20))) for i in range(30)]
    rows = [(i, f"before {items[i % 30][1]} after" if i % 3 else "nothing here") for i in range(60)] + [(None, items[4][1]), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS item_id")
    bench = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "3 AS block")
    assert decontaminate.item_blocks(bench, 400)[1] > 3
    told = lambda chars: sorted(map(str, decontaminate.leaks(docs, bench, chars=chars).collect()))
    assert told(400) == told(1 << 20) and len(told(400)) >= 41
    kept = lambda chars: sorted(map(str, decontaminate.without_leaks(docs, bench, chars=chars).collect()))
    assert kept(400) == kept(1 << 20) and len(kept(400)) == 21


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chats_round_trip(spark):
    odd = "\\### Assistant: </turn> ok\n### user:\n😀\\\\#<"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "as:sis\ntant", None), (2, 0, "assistant", ""), (2, None, "user", "a"),
            (None, 1, None, "b"), (3, 0, "assistant", "é" * 1000), (3, 0, "assistant", "é" * 1000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    chats = {r.conv_id: r for r in chat_format.formatted_chats(frame).collect()}
    assert len(chats) == 4
    for conv, chat in chats.items():
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        assert chat_format.parsed(chat.formatted) == [(r[2] or "", r[3] or "") for r in turns]
        loss = [chat_format.plain(chat.formatted[s.begin : s.end]) for s in chat.loss]
        assert loss == [r[3] or "" for r in turns if r[2] == "assistant"]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted_chats(frame)).collect()}
    told = "".join(f"{role}\n{text}\n" for role, text in (("user", odd), ("assistant", odd), ("as:sis\ntant", "")))
    assert back[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and back[1].loss_chars == len(odd)
    assert chat_format.formatted_chats(frame.limit(0)).count() == 0


def test_chats_are_cut_by_bytes(spark, monkeypatch):
    sizes = []
    whole = chat_format.format_turns
    monkeypatch.setattr(chat_format, "format_turns", lambda table: sizes.append(table.nbytes) or whole(table))
    rows = [(c, t, "user", "é" * (400_000 if c == 3 else 20_000)) for c in range(40) for t in range(5)]
    columns = {name: [r[i] for r in rows] for i, name in enumerate(("conv_id", "turn", "role", "text"))}
    table = pa.table(columns)
    got = [r for part in chat_format.whole_groups(chat_format.slices(iter(table.to_batches()), most=1 << 16), ["conv_id"], 4000, 1 << 19)
           for r in chat_format.format_turns(part).to_pylist()]
    assert [r["conv_id"] for r in got] == list(range(40))
    assert all(len(chat_format.parsed(r["formatted"])) == 5 for r in got)
    assert len(sizes) > 8 and sorted(sizes)[-2] < 2_000_000 < 4_000_000 < max(sizes)


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 17), "abc"[i % 3] if i % 5 else None) for i in range(900)] + [(7, None, "a"), (7, None, "a"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS copies", "3 AS class")
    mix = mixing.mix_copies(docs).collect()
    assert len(mix) == len(rows) and all(0 <= r.copies <= 2 for r in mix)
    total = sum(r.size for r in mix)
    by = {}
    for r in mix:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6
    for members in by.values():
        size = sum(r.size for r in members)
        assert members[0].source_size == size and members[0].target <= 2 * size + 1e-9
        assert abs(sum(r.copies * r.size for r in members) - members[0].target) <= 40
    again = sorted(map(str, mixing.mix_copies(docs.repartition(5)).collect()))
    assert again == sorted(map(str, mix))
    taken = mixing.mixed(docs)
    assert taken.columns == [*docs.columns, "copy"] and taken.count() == sum(r.copies for r in mix)
    assert mixing.mix_copies(docs.limit(0)).count() == 0


def test_isotonic_rises():
    places, levels = quality.isotonic(np.array([0.0, 3, 1, 9]), np.array([4.0, 4, 4, 9]), np.arange(4.0))
    assert (np.diff(places) > 0).all() and (np.diff(levels) > 0).all()


def test_quality_learns_and_handles_odd_texts(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else "BUY!! " * 40, int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "x" * 100_000), (902, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]] + [(5, None), (901, None)], "doc_id long, label int")
    model, stats = quality.train(docs.selectExpr("*", "1 AS stats"), labels)
    score = [(r.doc_id, r.score) for r in quality.scored(stats, model).collect()]
    assert len(score) == 304 and all(0 <= s <= 1 for _, s in score)
    assert all((s >= 0.5) == bool(rows[i][2]) for i, s in score if 200 <= i < 300)
    column = {r.doc_id: r.s for r in docs.where("doc_id < 300").select("doc_id", quality.quality_score(model, docs.text).alias("s")).collect()}
    assert all(abs(column[i] - s) < 1e-9 for i, s in score if i < 300)
    unlabelled, _ = quality.train(docs, labels.limit(0))
    assert unlabelled.score(np.zeros((1, quality.N_FEATURES)))[0] == 0.5
    assert quality.scored(quality.train(docs.limit(0), labels)[1], unlabelled).count() == 0


def test_disguised_words_are_restored(spark):
    plain = "you are such an idiot and a stupid loser they told the old idiot it is stupid to be a loser " * 50
    docs = spark.createDataFrame([(1, plain)], "doc_id long, text string")
    restorer = toxicity.Restorer.of(toxicity.trigram_counts(docs))
    for disguised in ("1d10t", "i d i o t", "i.d.i.o.t", "idiiiiot", "!d!0t"):
        assert restorer.text(f"such an {disguised} they") == "such an idiot they", disguised
    assert restorer.text("(l0s3r, plain words. 1234 a b") == "(loser, plain words. 1234 a b"
    assert restorer.text("nothing to do here; a b, 12") == "nothing to do here; a b, 12"
    assert restorer.text("") == "" and restorer.text(None) is None


def test_runs_of_letters_are_cut_into_words_of_any_alphabet(spark):
    plain = "you are such a scum and an idiot i say a schlöch told you and such a müßig élan of scum i told you schlöch " * 50
    docs = spark.createDataFrame([(1, plain)], "doc_id long, text string")
    restorer = toxicity.Restorer.of(toxicity.trigram_counts(docs))
    for disguised, clear in (
        ("such a s c u m told", "such a scum told"), ("are y o u i d i o t told", "are you idiot told"),
        ("such s c h l ö c h told", "such schlöch told"), ("such l.ö.c.h told", "such löch told"), ("such s-c-h-l-ö-c-h, told", "such schlöch, told"),
        ("such a s c h l o\u0308 c h told", "such a schlo\u0308ch told"), ("such é l a n told", "such élan told"), ("such m ü ß i g told", "such müßig told"),
    ):
        assert restorer.text(disguised) == clear
    assert restorer.text("told — – … them") == "told — – … them"


def test_channel_costs_keep_double_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    counts = Counter(w for r in docs.collect() for w in re.findall("[a-z]{4,}", (r.text or "").lower()))
    double = sorted(w for w, n in counts.items() if n >= 3 and re.search(r"(.)\1", w))
    single = sorted(w for w, n in counts.items() if n >= 3 and not re.search(r"(.)\1", w))[::10]
    restorer = toxicity.Restorer.of(toxicity.trigram_counts(docs))
    signs = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "$", "t": "7", "g": "9", "b": "8", "l": "|"}
    for group in (double, single):
        for disguise in (
            lambda w: re.sub("[oieastgbl]", lambda m: signs[m[0]], w, count=1), ".".join,
            lambda w: w if w[0] == w[1] else w[0] * 3 + w[1:],
        ):
            shown = [(w, disguise(w)) for w in group]
            right = [restorer.word(seen) == w for w, seen in shown if seen != w]
            assert len(right) > 20 and np.mean(right) >= 0.9


def test_null_keys_are_not_the_document_minus_one(spark):
    rows = [(-1, "plain words", 1)] + [(i, "plain words", 0) for i in range(100)] + [(None, "strange words", None)] * 100
    rows += [(1000, "strange words", None), (1001, "plain words", None)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, label int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(rows.drop("label"), rows.select("doc_id", "label")).collect()}
    assert score[1000] == score[1001]


def test_toxicity_learns_and_handles_odd_texts(spark):
    rng = np.random.default_rng(2)
    words = np.array(["the", "house", "stands", "near", "water", "and", "people", "walk", "there", "often"])
    rows = []
    for i in range(600):
        text = list(rng.choice(words, 40))
        if i % 4 == 0:
            text[5] = ["moron", "scum"][i % 8 // 4]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    more = [(900, None), (901, ""), (902, "the m0r0n walks"), (903, "the water walks"), (904, "s c u m and water")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string").selectExpr("*", "1 AS evidence")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:500]] + [(900, None)], "doc_id long, label int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(score) == 605 and all(0 <= s <= 1 for s in score.values())
    assert all((score[i] >= 0.3) == bool(y) for i, _, y in rows[500:])
    assert score[902] >= 0.3 > score[903] and score[904] >= 0.3
    assert set(r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()) == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_tells_features_apart_that_shared_a_cell(spark):
    # pairs of four-letter words whose hashes are equal modulo 2^20
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    buf = np.ascontiguousarray(np.stack(np.meshgrid(*[letters] * 4, indexing="ij"), -1)).ravel()
    at = np.arange(0, len(buf), 4)
    cell = ByteHash(buf).spans(at, at + 4) % np.uint64(1 << 20)
    order = np.argsort(cell, kind="stable")
    mates = np.flatnonzero(cell[order][1:] == cell[order][:-1])[[0, 10]]
    name = lambda i: buf[at[order[i]] : at[order[i]] + 4].tobytes().decode()
    (lost, common), (known, stray) = ((name(i), name(i + 1)) for i in mates)
    rows = [(i, f"plain words {lost if i % 4 else known}", 1) for i in range(200)]
    rows += [(i, f"plain words {common}", 0) for i in range(200, 600)]
    rows += [(1000, f"plain words {lost}", None), (1001, f"plain words {stray}", None), (1002, "plain words", None)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, label int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(rows.drop("label"), rows.select("doc_id", "label")).collect()}
    assert score[1000] > score[1002] + 0.3 and score[1001] == score[1002]


def test_url_verdicts(spark):
    rows = [("http://A.Net/x", "net/"), ("https://www.example.net/en/1?q#f", "example.net/en/"), ("http://net", None),
            ("http://x.example.com/de/3", "example.com/de/"), ("http://b.org/fr/", "org/fr/"), ("http://borg/fr/", None), ("nothing", None), (None, None)]
    spam = [(f"http://s.com/bad/{i}", None) for i in range(40)] + [(f"http://s.com/good/{i}", None) for i in range(40)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows + spam)] + [(500, "http://s.com/bad/1")] * 2, "page_id long, url string")
    labels = spark.createDataFrame([(len(rows) + i, int(i < 40)) for i in range(0, 80, 2)] + [(1, None)], "page_id long, label int")
    got = url_filter.verdicts(pages.selectExpr("*", "1 AS host", "2 AS n", "3 AS bad"), labels, URL_RULES).collect()
    assert len(got) == 90
    by = {r.page_id: r for r in got}
    for i, (_, rule) in enumerate(rows):
        assert by[i].rule == rule and by[i].verdict == (URL_RULES[rule] if rule else "allow")
    assert (by[0].host, by[0].path, by[6].host, by[7].path) == ("a.net", "/x", "", "")
    assert all(by[len(rows) + i].verdict == ("block" if i < 40 else "allow") for i in range(80)) and by[500].verdict == "block"
    assert by[len(rows)].template == "s.com/bad/*"
    assert url_filter.verdicts(pages.limit(0), labels, URL_RULES).count() == 0


def test_url_sections_of_small_share_and_great_depth(spark):
    # 100 even sections of one host, the last one bad; a bad section below seven common segments
    rows = [(f"http://hot.com/s{i % 100}/{i}", int(i % 100 == 99)) for i in range(2000)]
    deep = "http://deep.com/" + "/".join("abcdefg")
    rows += [(f"{deep}/{'bad' if i % 4 == 0 else 'good'}/{i}/x", int(i % 4 == 0)) for i in range(200)]
    rows += [("http://one.com/" + "/".join("abcdefghij"), None)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if y is not None], "page_id long, label int")
    by = {r.page_id: r for r in url_filter.verdicts(pages, labels, {}).collect()}
    assert len(by) == len(rows)
    assert all(by[i].verdict == ("block" if y else "allow") for i, (_, y) in enumerate(rows))
    assert by[99].template == "hot.com/s99/*" and by[0].template == "hot.com/*/*"
    assert by[2000].template == "deep.com/*/*/*/*/*/*/*/bad/*/*" and by[2200].template == "one.com" + "/*" * 10


def plain_templates(pages):
    """(host, steps) to template by walking one node at a time; pages: (host, path, bad or None)."""

    def differ(a, n, b, m, tests):
        share, inverse = (a + b + 1) / (n + m + 2), 1 / n + 1 / max(m, 1)
        bound = np.sqrt(url_filter.DIFFERENT**2 + 2 * np.log(tests)) * np.sqrt(share * (1 - share) * inverse)
        return abs(a / n - b / max(m, 1)) - inverse / 2 >= bound

    out = {}

    def walk(name, rows, level):
        for host, steps, _ in rows:
            if len(steps) <= level:
                out[host, steps] = name
        rows = [r for r in rows if len(r[1]) > level]
        by = defaultdict(list)
        for r in rows:
            by[r[1][level]].append(r[2])
        count = {s: (len(v), sum(b is not None for b in v), sum(b or 0 for b in v)) for s, v in by.items()}
        labelled, bad = sum(c[1] for c in count.values()), sum(c[2] for c in count.values())
        if len(rows) < url_filter.LEAST_COUNT or not 0 < bad < labelled:
            for host, steps, _ in rows:
                out[host, steps] = name + "/*" * (len(steps) - level)
            return
        tested = {s: c for s, c in count.items() if c[0] >= url_filter.LEAST_COUNT and c[1]}
        sides = {True: [], False: []}
        for s, (_, n, a) in tested.items():
            if labelled > n and differ(a, n, bad - a, labelled - n, len(tested)):
                sides[a * (labelled - n) > (bad - a) * n].append((a / n, s))
        names = {}
        for side in sides.values():
            groups = []
            for _, s in sorted(side):
                last = groups and tested[groups[-1][-1]]
                if last and not differ(tested[s][2], tested[s][1], last[2], last[1], len(tested)):
                    groups[-1].append(s)
                else:
                    groups.append([s])
            for group in groups:
                names.update({s: "/" + min(group) if len(group) > 1 else s for s in group})
        below = defaultdict(list)
        for r in rows:
            below[names.get(r[1][level], "*")].append(r)
        for step, part in below.items():
            walk(f"{name}/{step}", part, level + 1)

    hosts = defaultdict(list)
    for host, path, bad in pages:
        hosts[host].append((host, tuple(s for s in path.split("/") if s), bad))
    for host, rows in hosts.items():
        walk(host, rows, 0)
    return out


def test_url_tree_equals_a_plain_walk_and_merges_alike_branches(spark):
    rng = np.random.default_rng(11)
    share = {"spam": 0.8, "junk": 0.75, "news": 0.05, "blog": 0.05, "shop": 0.35}
    rows = []
    for _ in range(4000):
        host, section = str(rng.choice(["a.com", "b.org"])), str(rng.choice(list(share)))
        part = str(rng.choice(["x", "y", "z"]))
        odds = share[section] if host == "a.com" else {"x": 0.9, "y": 0.05, "z": 0.05}[part] if section == "shop" else 0.1
        bad = int(rng.random() < odds) if rng.random() < 0.6 else None
        rows.append((host, f"/{section}/{part}/{rng.integers(10**6)}" + "/t" * int(rng.integers(0, 3)), bad))
    rows += [("a.com", "", 1), ("a.com", "/", None), ("c.net", "/only", 1), ("a.com", "//spam//x", 0)]
    pages = spark.createDataFrame(rows, "host string, path string, bad int")
    want = plain_templates(rows)
    got = {(r.host, r.path): r.template for r in url_filter.templates(pages).collect()}
    assert len(got) == len({r[:2] for r in rows})
    assert all(t == want[h, tuple(s for s in p.split("/") if s)] for (h, p), t in got.items())
    assert any("//" in t for t in got.values())
    assert got["a.com", "//spam//x"].startswith("a.com//junk")


def test_url_labels_of_a_low_base_reject_their_sections_and_even_labels_reject_none(spark):
    rng = np.random.default_rng(12)
    rows = [(f"http://h{i % 9}.com/{'low' if i % 6 == 0 else 'main'}/{i}", i) for i in range(6000)]
    bad = {i: int(rng.random() < (0.42 if i % 9 < 3 and i % 6 == 0 else 0.06)) for i in range(6000)}
    pages = spark.createDataFrame([(i, u) for u, i in rows], "page_id long, url string")
    learnt = spark.createDataFrame([(i, b) for i, b in bad.items() if i % 2], "page_id long, label int")
    even = spark.createDataFrame([(i, int(b)) for i, b in enumerate(rng.random(6000) < 0.1)], "page_id long, label int")
    # only the section low of h0 is bad; half of its labels with even numbers are held out
    learnt = learnt.union(spark.createDataFrame([(i, b) for i, b in bad.items() if i % 6 == 0 and i % 4 == 0], learnt.schema))
    blocked = {r.page_id for r in url_filter.verdicts(pages, learnt, {}).collect() if r.verdict == "block"}
    held = [i for i in blocked if i % 4 == 2]
    assert blocked == {i for i in range(6000) if i % 9 < 3 and i % 6 == 0}
    assert np.mean([bad[i] for i in held]) > 0.3
    assert all(r.verdict == "allow" for r in url_filter.verdicts(pages, even, {}).collect())


@pytest.mark.parametrize("host,path,url", [("", "", "x//y"), ("h", "", "a://H?x"), ("h:1", "/p", "a://H:1/p#q"), ("", "/p", "://" + "/p")])
def test_host_and_path(spark, host, path, url):
    from pyspark.sql import functions as F

    columns = url_filter.host_and_path(F.lit(url))
    assert tuple(spark.range(1).select(*columns).first()) == (host, path)


def test_mixed_keeps_columns_of_clashing_names(spark):
    rows = [(1, "a b c", "x", "mine", 5, 7), (2, "d e f", "y", "yours", 6, 8), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string, __key int, __ROWS int")
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "_copy"]
    plain = mixing.mixed(docs.select("doc_id", "text", "source"))
    assert plain.columns[-1] == "copy"
    key = lambda r, n: (r["doc_id"], r[n])
    assert sorted(key(r, "_copy") for r in got.collect()) == sorted(key(r, "copy") for r in plain.collect())
    assert {(r["doc_id"], r["copy"], r["__key"], r["__ROWS"]) for r in got.collect()} <= {(i, c, k, n) for i, _, _, c, k, n in rows}
    assert mixing.mixed(docs.limit(0)).count() == 0
