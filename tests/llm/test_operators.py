"""Each operator against brute force on small tables with nulls, blanks, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkboard.llm import decontaminate, embedding_dedup, fm_index, html_text, language_id, license_scan, minhash_dedup, mixing, sharding, substring_dedup, url_filter
from sparkboard.llm import wordhash as wh
from sparkboard.llm.shared import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, items string, spans string, key long, id long, label string"
LETTERS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def table(spark, rows):
    """Rows (doc_id, text, lang, source) as documents with columns whose names clash."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "r", "i", "s", 1, 2, "l") for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice(LETTERS) + rng.choice(["", ",", "."]) for _ in range(n))
    shared = draw(30)
    rows = [(k, draw(rng.randint(1, 60)), "en", f"s{k % 4}") for k in range(40)]
    rows += [(100 + k, f"{draw(12)} {shared}\n{draw(9)}", "en", "s1") for k in range(6)]
    rows += [(200, None, None, None), (201, "", "en", None), (202, " \t\n ", "en", "s0"), (None, shared, "en", "s2"), (203, "!!! ???", "en", "é"), (204, draw(3000), "en", "s9"), (100, rows[40][1], "en", "s1")]
    return rows


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(900 + k, 901 + k) for k in range(64)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, texts):
    docs = table(spark, texts)
    rows = mixing.mixed(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(x[0] for x in texts)
    sizes, total = collections.Counter(), 0
    for _, t, _, s in texts:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        total += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 1
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, rows))
    out = mixing.mix(docs)
    plan, got = collections.Counter(), collections.Counter()
    for r in rows:
        plan[r.doc_id, r.source] += r.taken
    for r in out.collect():
        got[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert out.columns == docs.columns and got == +plan
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_schedule_against_a_plain_loop(spark, monkeypatch):
    """Words taken of each document against a walk through the golden-ratio points, block by block."""
    monkeypatch.setattr(mixing, "LARGEST_BLOCK", 16)
    rng = random.Random(2)
    docs = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "b", None])) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mixed(df).collect()
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    size, target = ({r.source: r[c] for r in rows} for c in ("source_size", "target"))
    total = sum(size.values())
    block = max(1, min(16, total // (len(order) * mixing.SLOTS_PER_SOURCE)))
    slots, edges = -(-total // block), np.cumsum([target[s] for s in order]) / sum(target.values())
    drawn = collections.Counter(order[min(int(np.searchsorted(edges, x, "right")), len(order) - 1)] for x in ((k + 1) * mixing.GOLDEN % 1 for k in range(slots)))
    draws = {(r.doc_id, r.size): r.d for r in df.select("doc_id", mixing.n_words(F.col("text")).alias("size")).withColumn("d", F.xxhash64("doc_id", "size")).collect()}
    for s in order:
        own = sorted((r for r in rows if r.source == s), key=lambda r: (draws[r.doc_id, r.size] % mixing.BUCKETS, draws[r.doc_id, r.size]))
        words = round(target[s])
        stream = [r.doc_id for r in own for _ in range(r.size)]  # a source's words in shuffled order
        need = words // size[s] * -(-size[s] // block) + -(-(words % size[s]) // block)
        assert abs(drawn[s] - need) <= max(3, 0.02 * need)  # the points alone give each source nearly its slots
        taken, left = collections.Counter(), words
        while left > 0:  # round and round, until the target ends
            taken.update(stream[: min(left, size[s])])
            left -= size[s]
        assert {r.doc_id: r.taken for r in own} == {r.doc_id: taken[r.doc_id] for r in own}


def test_alike_rows_share_their_plan(spark):
    rows = [(1, "a b c d e f g h", "s")] * 3 + [(2, "x " * 30, "t"), (3, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, got = collections.Counter(), collections.Counter()
    for r in mixing.mixed(docs).collect():
        plan[r.source] += r.taken
    for r in mixing.mix(docs).collect():
        got[r.source] += len(r.text.split())
    assert got == plan and 8 < plan["s"] < 24


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    rows = [(k, (base[k % 12] + 0.15 * rng.normal(size=6)).astype("f4").tolist(), k % 2) for k in range(160)]
    rows += [(500, rows[3][1], 1), (501, rows[3][1], 0), (502, None, 1), (503, [0.0] * 6, 1), (504, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (505, [float("nan")] * 6, 0), (506, rows[3][1], None), (507, [1.0, 2.0], 1), (508, [2.0 * x for x in rows[3][1]], 1), (509, [float("inf")] + [0.0] * 5, 1)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep long, cell string")).collect()}
    sound = [(i, np.array(v, "f8"), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, g in sound:
        for j, b, h in sound:
            if i != j and g == h and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert links and len(got) == len(rows)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {r[0]: (links[r[0]], find(r[0]), r[0] == find(r[0])) for r in rows}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header class="site">Logo</header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&nbsp;line &amp; more</h1><p>First <b>bold</b>
 text.<br>Next<div class="ad">Buy</div><p>Short.<form><input><label>Mail</label></form><table><tr><td>1<td>2</table>
<section id="comments"><p>Nice!</p></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head line & more First bold text. Next Short. 1 2"
    long = "This paragraph has rather a lot of words in it, as articles do. " * 2
    free = f"<body><ul class=menu><li><a href=x>a</a></ul><div><p>{long}</p><p>Yes.</p><p>{long}</p></div><form>f</form></body>"
    assert html_text.main_text(free) == f"{long.strip()} Yes. {long.strip()}"
    rows = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (4, "w", "plain"), (4, "w", "plain"), (5, "x", "<p>a" * 3000), (6, "y", "<<>><!-- <p>")]
    got = html_text.extract_pages(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.n_chars == len(r.text)) for r in got) == [(r[0], True) for r in rows]
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""] and next(r for r in got if r.page_id == 5).n_chars == 5999


def test_sharding(spark, texts):
    docs = table(spark, texts)
    rows = sharding.shard_plan(docs, shards=5, old=F.coalesce(F.col("source"), F.lit("none"))).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"}
    crc = collections.Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, _, _ in texts)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == crc
    for k in range(5):
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
    many = table(spark, [(k, "x" * (1 + k * 37 % 300), "en", "s") for k in range(600)])
    sums = collections.Counter()
    for r in sharding.shard_plan(many, shards=5, old=F.col("source")).collect():
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) < 0.03 * max(sums.values())
    assert sharding.shard_plan(docs.limit(0), shards=5, old=F.col("source")).count() == 0


def test_min_cost_flow():
    rng = random.Random(2)
    for _ in range(20):
        supply = [rng.randrange(0, 30) for _ in range(4)]
        capacity = [rng.randrange(0, 20) for _ in range(6)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        flow = sharding.min_cost_flow(supply, capacity, {(i, j): int(i != j) for i in range(4) for j in range(6)})
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(4)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in range(6))
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - sum(min(a, b) for a, b in zip(supply, capacity))


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": "the and ing tion of".split(), "bb": "der und ung sch zu".split(), "cc": "que los ción ado y".split()}
    make = lambda la, n=40: " ".join("".join(rng.choices(parts[la], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(la), la, "s") for k in range(240) for la in [sorted(parts)[k % 3]]]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "123 !?", "bb", "s"), (903, make("bb"), None, "s"), (None, make("cc"), "cc", "s"), (0, rows[0][1], "aa", "s"), (904, make("aa", 30000), "aa", "s")]
    docs = table(spark, rows)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: la for i, _, la, _ in rows if i is not None and i < 240} | {904: "aa"}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())
    assert {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def test_fm_index():
    rng = np.random.default_rng(6)
    seq = rng.integers(0, 5, 3000)
    seq[1000:1400], seq[-1] = seq[2000:2400].copy(), 0
    index = fm_index.FMIndex(seq, 4)
    for n in (1, 3, 6):
        phrases = np.unique(rng.integers(1, 5, (200, n)), axis=0)
        low, high = index.find(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            places = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_decontamination(spark, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)  # several blocks of items
    items = [(1, " ".join((texts[40][1]).upper().split()[10:30])), (2, "Alpha"), (3, None), (4, "..."), (5, texts[2][1]), (5, texts[2][1]), (6, "iota kappa é"), (None, "eta theta iota")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = collections.Counter()
    for i, t, _, _ in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert collections.Counter(tuple(r) for r in decontaminate.contamination(docs, bench).collect()) == want
    monkeypatch.undo()
    clean = decontaminate.decontaminate(docs, bench.where("item_id = 1"))
    assert clean.columns == docs.columns and clean.count() == len(texts)
    assert not decontaminate.contamination(clean, bench.where("item_id = 1")).where("contaminated").count()
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_weighted_sampling_matches_similarity():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.ones(200), np.where(np.arange(200) < 100, 1.0, 2.0)
    x = minhash_dedup.consistent_samples(np.concatenate([h[:200], h[100:]]), np.concatenate([a, b]), np.array([0, 200, 400]), 2000)
    assert abs((x[0] == x[1]).mean() - 100 / (200 + 300 - 100)) < 0.03


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(4000)}" for _ in range(150)] for _ in range(30)]
    rows = [(k, " ".join(w), "en", "s") for k, w in enumerate(base)]
    for k in range(20):  # one word of 150 changed: about 0.94 of the shingles stay
        w = list(base[0])
        w[rng.randrange(150)] = f"x{k}"
        rows.append((100 + k, " ".join(w), "en", "s"))
    rows += [(200, rows[5][1].upper() + " !", "en", "s"), (201, None, "en", "s"), (202, "", "en", "s"), (203, "one two", "en", "s"), (204, "One, two", "en", "s"), (None, rows[6][1], "en", "s"), (7, rows[7][1], "en", "s")]
    docs = table(spark, rows)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    classes = {r.doc_id: r.class_id for r in got}
    assert {classes[100 + k] for k in range(20)} == {0} == {classes[0]}
    assert classes[200] == 5 and classes[204] == 203 and classes[None] is None
    assert all(classes[k] == k for k in [*range(1, 30), 201, 202, 203])
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([*range(30), 201, 202, 203, None])
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_substrings(spark, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 1 << 11)  # the longest text comes in pieces
    docs = table(spark, texts)
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
    want = collections.Counter()
    first = {}
    for i, t, _, _ in order:
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            first.setdefault(b" ".join(w[k : k + 20]), (i, k))
            first[b" ".join(w[k : k + 20])] = min(first[b" ".join(w[k : k + 20])], (i, k), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    for i, t, _, _ in order:
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 19):
            if first[b" ".join(w[k : k + 20])] != (i, k):
                gone |= set(range(k, k + 20))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    collide = np.array([7, 7, 7, 9], np.uint64)
    *_, later = substring_dedup._order(collide, np.array([1, 2, 1, 1], np.uint64), np.array([4, 5, 6, 7]), np.array([0, 0, 0, 0]))
    assert later.tolist() == [False, True, False, False]  # equal in one hash alone: not a repeat
    for levels in (1, 2):
        assert collections.Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, 20, levels, digest=True).collect()) == want
    assert any(x[2] for x in want)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_windows_that_collide_are_no_repeats(spark):
    """Texts that share 15 words and end in five whose 44-bit hashes agree: found among random words, kept whole."""
    rng = np.random.default_rng(12)
    vocabulary = np.array([f"v{k}" for k in range(5000)])
    _, _, _, hashes = wh.words(np.frombuffer(" ".join(vocabulary).encode(), np.uint8), np.array([0, len(" ".join(vocabulary))]), "space")
    top, words = [], []
    for _ in range(16):
        own = rng.integers(0, 5000, 1 << 20)
        top.append(wh.windows(hashes[own], 5) >> np.uint64(substring_dedup.POSITION_BITS))
        words.append(own)
    every = np.concatenate(top)
    values, counts = np.unique(every, return_counts=True)
    n, pairs = len(top[0]), []
    for value in values[counts > 1]:
        a, b = np.flatnonzero(every == value)[:2].tolist()
        one, two = (" ".join(vocabulary[words[x // n][x % n : x % n + 5]]) for x in (a, b))
        if one != two:
            pairs.append((one, two))
    assert pairs  # about eight of 44 bits among 16 million
    head = [" ".join(f"h{k}_{j}" for j in range(15)) for k in range(len(pairs))]
    rows = [(2 * k + j, f"{head[k]} {tail}") for k, both in enumerate(pairs) for j, tail in enumerate(both)]
    rows += [(len(rows), f"{head[0]} {pairs[0][1]}")]  # and one true repeat
    docs = spark.createDataFrame(rows, "`doc.id` long, text string")
    for levels in (1, 2):
        got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, 20, levels, id_column="doc.id").collect()}
        assert got == {k: 20 * (k == len(rows) - 1) for k in range(len(rows))}


def test_licenses(spark):
    rows = [(1, "Hello\nReleased under the MIT license\nbye", "en", "s"), (2, license_scan.TEMPLATES[9][1].replace(" ", "\n"), "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (5, "licensed to nobody", "en", "s"), (1, "Licensed under CC BY-NC 4.0.", "en", "s"), (None, "Licensed under the Apache License, Version 2.0", "en", "s")]
    got = {r.doc_id: (r.license, r.score, r.n_units) for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert got[1] == ("CC-BY-NC-4.0", 1.0, 3) and got[2] == ("MIT", 1.0, 1) and got[None] == ("Apache-2.0", 1.0, 1)
    assert all(got[k] == (None, None, 0) for k in (3, 4, 5))


def test_key_words_lose_no_match():
    """Whatever reaches the threshold holds a key word: bags of bigrams without any stay under it."""
    keys = license_scan.key_words(license_scan.TEMPLATES, 0.8)
    for _, text in license_scan.TEMPLATES:
        w = [x.lower() for x in re.findall(license_scan.WORD, text)]
        pairs = list(zip(w, w[1:]))
        left = sum(not any(x in keys for x in p) for p in pairs)
        assert 2 * left / (left + len(pairs)) < 0.8


def test_urls(spark):
    d = lambda s: __import__("datetime").date.fromisoformat(s)
    entries = [("host", "A.example.com", True, d("2024-01-10")), ("host", "a.example.com", False, d("2024-02-01")), ("host", "a.example.com", True, d("2024-03-01")), ("domain", "bad.org", True, d("2024-01-01")), ("prefix", "c.net/x", True, d("2024-01-01")), (None, "z", True, d("2024-01-01")), ("host", "e.com", True, d("2024-01-05")), ("host", "e.com", False, d("2024-01-05"))]
    captures = [(1, "http://a.example.com/", "2024-01-09", False), (2, "https://u@A.example.com:80/p?q", "2024-01-10", True), (3, "http://a.example.com", "2024-02-01", False), (4, "http://a.example.com", "2024-05-01", True), (5, "http://www.bad.org/", "2024-01-02", True), (6, "http://notbad.org/", "2024-01-02", False), (7, "http://c.net/x/y", "2024-01-02", True), (8, "http://c.net/xy", "2024-01-02", False), (9, None, "2024-01-02", False), (10, "garbage", "2024-01-02", False), (11, "http://e.com", "2024-02-02", False), (5, "http://www.bad.org/", "2024-01-02", True), (12, "http://bad.org", None, False)]
    t = spark.createDataFrame([(i, u, a and d(a), True, "k") for i, u, a, _ in captures], "page_id long, url string, fetched_at date, blocked boolean, kind string")
    e = spark.createDataFrame(entries, "kind string, value string, listed boolean, dated date")
    want = collections.Counter((i, b) for i, _, _, b in captures)
    assert collections.Counter((r.page_id, r.blocked) for r in url_filter.filter_urls(t, e).collect()) == want
    url_filter_limit = url_filter.MOST_BROADCAST
    try:
        url_filter.MOST_BROADCAST = 0  # the shuffled form
        assert collections.Counter((r.page_id, r.blocked) for r in url_filter.filter_urls(t, e).collect()) == want
    finally:
        url_filter.MOST_BROADCAST = url_filter_limit
