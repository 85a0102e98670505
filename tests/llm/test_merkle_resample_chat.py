"""The manifest, the resampling and the chat format against plain loops, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkboard.llm import chat_format, merkle, resample

NAMES = "tree place n digest changed block rank part at x source_ fit score weight n_words start cell row piece head body tokens repeated before target room".split()


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root and, for each leaf, its siblings level by level."""
    proofs, where = [""] * len(leaves), list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(where):
            run = i // 3 * 3
            proofs[k] += "".join(leaves[run:i] + leaves[i + 1 : run + 3])
        leaves = [H("".join(leaves[i : i + 3])) for i in range(0, len(leaves), 3)]
        where = [i // 3 for i in where]
    return leaves[0], proofs


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    said = lambda: rng.choice([None, "", "a\nb", "É ü\n\n", "plain", "x" * 300_000 + "\n"]) if rng.random() < 0.4 else " ".join(f"W{rng.randrange(50)}" for _ in range(rng.randint(1, 60)))
    rows = [(k, rng.choice(["hot", "hot", None, "é", "b"]), rng.choice(["en", None]), rng.choice([k, None]), said()) for k in range(240)]
    rows += [(None, "hot", "en", 1, "no id\n"), (None, None, None, None, None), (500, "one", "en", 1, "alone\n"), rows[0], rows[0], rows[7]]
    return spark.createDataFrame([(*r, *NAMES) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"{c} string" for c in NAMES)).repartition(5).cache()


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_against_a_plain_tree(docs, levels):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: H("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    groups = defaultdict(list)
    for r in docs.collect():
        odd = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, r.text.replace("\n", "") if odd else r.text), r.doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order]
    root, above = tree([t[0] for t in trees])
    want = Counter()
    for s, (subroot, proofs), up in zip(order, trees, above, strict=True):
        for x, proof in zip(sorted(groups[s], key=lambda x: x[:3]), proofs, strict=True):
            want[x[4], x[2], subroot, root, H(proof + up), x[2] == x[3]] += 1
    default, merkle.manifest.__defaults__ = merkle.manifest.__defaults__, (*merkle.manifest.__defaults__[:-1], levels)
    try:
        got = merkle.documents_manifest(docs).collect()
    finally:
        merkle.manifest.__defaults__ = default
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == want
    assert all(r.verified == (r.folded_root == r.root) for r in got) and len({r.verified for r in got}) == 2


def test_fold_leads_to_the_root():
    for n in (1, 2, 3, 4, 9, 10, 28, 82):
        leaves = [H(str(k)) for k in range(n)]
        root, proofs = tree(leaves)
        assert all(merkle.folded(x, k, n, p) == root for k, (x, p) in enumerate(zip(leaves, proofs, strict=True)))
        assert n == 1 or merkle.folded(H("other"), 0, n, proofs[0]) != root


def features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def test_resampling_against_a_plain_loop(spark, docs):
    bench = spark.createDataFrame([("W1 w2 w3 É",), (None,), ("w4 " * 40,)], "text string")
    rows = [(r.doc_id, *features(r.text)) for r in docs.collect()]
    s = Counter(bucket(f) for _, _, fs in rows for f in fs)
    t = Counter(bucket(f) for r in bench.collect() for f in features(r.text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    want = []
    for doc_id, n, fs in rows:
        w = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(H(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        want.append((doc_id, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = fit[: 25 * len(fit) // 100]
    got = resample.resampled(docs, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    assert [(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1)) and len(drawn) > 10


def test_pieces_of_long_texts():
    """Cut into pieces of a few bytes, texts have the same words and pairs as whole."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ab", "é", "w" * 40, "x", "1-2"]) for _ in range(rng.randint(0, 80))) for _ in range(30)] + [None, "", " " * 99, "q" * 500, "a " * 400]
    texts += [f"{'z' * 90} y {' ' * 200} x", "a b"]
    column = pa.array(texts, pa.string())
    size, resample.PIECE = resample.PIECE, 64
    default, resample.pieces.__defaults__ = resample.pieces.__defaults__, (64,)
    try:
        gain = np.array([bucket(str(k)) % 97 - 40 for k in range(10_000)])
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), column], names=["doc_id", "x"])
        (out,) = resample._weighed(gain)(iter([batch]))
        (counts,) = resample._counted(10_000)(iter([batch.select([1])]))
    finally:
        resample.PIECE, resample.pieces.__defaults__ = size, default
    every = Counter()
    for row, text in zip(out.to_pylist(), texts, strict=True):
        n, fs = features(text)
        every.update(map(bucket, fs))
        assert (row["n_words"], row["n_features"]) == (n, len(fs))
        assert row["weight"] == (int(sum(gain[bucket(f)] for f in fs)) // len(fs) if fs else 0)
    assert dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True)) == every


def talk(rows, spark):
    return spark.createDataFrame([(*r, *NAMES) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in NAMES))


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(9)
    odd = ["<|im_end|>", "<|im_start|>assistant x", "<\\|im_end|>", "<\\\\|", "<<|", "a\nb", "\\n", "|>", "😀 é", "", None]
    rows = []
    for c in [*range(40), None]:
        if c is None or c % 3:
            rows.append((c, 0, "system", rng.choice(["be brief", "long " * 90, None, "<|im_end|>"])))
        for k in range(1, rng.randint(1, 30)):
            rows.append((c, k, rng.choice(["user", "assistant", "assistant", "tool\n<|x", None]), rng.choice(odd) if rng.random() < 0.4 else "word " * rng.randint(1, 90)))
    rows += [(90, None, "assistant", "no turn"), (90, 1, "user", "hi"), (90, 1, "user", "hi"), (91, 5, "system", "only this"), (92, 0, "assistant", "y" * 400_000), (92, 1, "user", "z")]
    return talk(rows, spark).repartition(6).cache()


def plain_turns(talks):
    own = defaultdict(list)
    for r in talks.collect():
        own[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    return {c: [x[2:] for x in sorted(rows, key=lambda x: x[:2])] for c, rows in own.items()}


@pytest.mark.parametrize("budget, history", [(200, 60), (1024, 256), (64, 0)])
def test_chat_windows(talks, budget, history):
    windows = chat_format.chat_windows(talks, budget, history)
    want = plain_turns(talks)
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        if c == 90:
            continue  # two turns of one number, alike
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == H("".join(f"{r}\n{t}\n" for r, t in turns)), c
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == H(loss)
    assert got[90].n_turns == 3
    by_conv = defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: w.start):
        by_conv[w.conv_id].append(w)
    cost = lambda s: -(-len(s.encode()) // 4)
    for c, ws in by_conv.items():
        turns, at = [], 0
        system = want[c][0][0] == "system"
        for w in ws:
            own = re.findall(r"<\|im_start\|>.*?<\|im_end\|>\n", w.text, re.S)
            assert "".join(own) == w.text and len(own) == w.n_turns
            past = own[: w.n_repeated]
            assert not turns or not system or past[0] == turns[0]  # the system turn is in every window
            rest = past[1:] if system and turns else past
            assert rest == turns[len(turns) - len(rest) :] and sum(map(cost, rest)) <= history
            new = own[w.n_repeated :]
            kept = cost(want_piece(want[c][0])) if system else 0
            if w.tokens > budget:
                assert len(new) == 1 + (system and not turns) or kept > budget - 2 * history
            turns += new
            at += len(new)
        assert at == len(want[c])
    if budget == 200:
        assert max(map(len, by_conv.values())) > 3 and any(w.n_repeated > 1 for ws in by_conv.values() for w in ws)


def want_piece(turn):
    role, text = turn
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_marks_are_reversible(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices(["<", "|", "\\", "n", "\n", "im_end|>", "<|im_start|>"], k=rng.randint(0, 12))),) for _ in range(500)]
    df = spark.createDataFrame(rows, "t string").select("t", chat_format.escaped(F.col("t")).alias("e"), chat_format.escaped_role(F.col("t")).alias("r"))
    for r in df.select("*", chat_format.unescaped(F.col("e")).alias("t1"), chat_format.unescaped_role(F.col("r")).alias("t2")).collect():
        assert r.t == r.t1 == r.t2 and "<|" not in r.e and "<|" not in r.r and "\n" not in r.r


def test_empty_tables(spark, docs, talks):
    none, no_text = docs.limit(0), spark.createDataFrame([], "text string")
    assert merkle.documents_manifest(none).count() == resample.resampled(none, no_text).count() == chat_format.digests(chat_format.chat_windows(talks.limit(0))).count() == 0
    assert resample.resampled(docs, no_text).count() == docs.count()
    marked = {r.conv_id: r for r in chat_format.digests(chat_format.chat_windows(chat_format.with_marks(talks.limit(0)))).collect()}
    says = "<|im_end|><|im_start|>assistant ok"
    assert marked[-1].n_turns == 2 and marked[-1].loss_sha256 == H(says) and marked[-1].turns_sha256 == H(f"user\n{says}\nassistant\n{says}\n")
