"""Corpus operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import bpe, chat, decontam, html_extract, licenses, ngram_join, quality, secrets, topk, toxicity
from helixframe.llm.common import Words, hash_words
from helixframe.llm.registry import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "É über ñ 漢字 🙂"), (6, "x" * 300_000), (6, "x" * 300_000), (None, "no id here at all, none"), (7, "w " * 20_000)]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'n' AS n", "1 AS id", "'c' AS component_id", "0.5D AS score", "'s' AS spans") if extra else df


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9))).replace(" ", "") or "z" for _ in range(3000)} | {"a" * 70_000, "a" * 70_001, "a" * 5_000_000})
    h = hash_words(words)
    assert len(set(h.tolist())) == len(words)
    assert Words([" ".join(words).encode()]).hash.tolist() == h.tolist()


# --- n-gram join


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(UP))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    shared = [rng.choice(vocab) for _ in range(24)]
    rows = []
    for i in range(160):
        kind = rng.randint(0, 3)
        if kind == 0 and rows:  # a near copy of an earlier document
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 1:  # a passage that many share, with words of its own
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 12))] + shared
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(w)))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()}
    assert out == brute_groups(rows)


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW_EDGES", few)
    rng = random.Random(14)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, 1000 + k) for k in range(200)] + [(2000 + k, 2001 + k) for k in range(60)] + [(5, 5)]
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for a in sorted(near):
        todo = [] if a in want else [a]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = a
                todo += near[x]
    got = {r.id: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_large_group_of_near_copies(spark):
    """2,000 copies of one text with words of their own: some link to it, some only to each other, some to none."""
    rng = random.Random(15)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(0, " ".join(base))]
    for k in range(1, 2001):
        w = list(base)
        for at in rng.sample(range(80), rng.choice([1, 2, 3, 4, 6])):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(2001, 2041):  # near copies of copies
        w = rows[rng.randrange(1, 2001)][1].split()
        w[rng.randrange(80)] = "y"
        rows.append((k, " ".join(w)))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for _, t in rows]
    first = sorted(sets[0])
    has = np.array([[g in x for g in first] for x in sets], np.int32)
    shared, where = has @ has.T, collections.defaultdict(list)
    for i, x in enumerate(sets):
        for g in x - sets[0]:
            where[g].append(i)
    for own in where.values():  # shingles that are not the first text's stand in few texts
        for i in own:
            shared[i, own] += 1
    size = np.array(list(map(len, sets)))
    link = 100 * shared >= 75 * (size[:, None] + size[None, :] - shared)
    root = np.arange(len(sets))
    for _ in range(20):
        root = np.where(link, root[None, :], len(sets)).min(1)
    assert {i: r for i, (_, r) in out.items()} == dict(enumerate(root.tolist())) and {n for n, _ in out.values()} == set(size.tolist())
    assert 700 < (root == 0).sum() < 1500 and len(set(root.tolist())) > 500


def test_ngram_join_edges(spark):
    out = ngram_join.ngram_jaccard_join(docs(spark, EDGE)).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert got == collections.Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 1, 4): 1, (5, 1, 5): 1, (6, 1, 6): 2, (None, 2, None): 1, (7, 1, 7): 1})
    assert ngram_join.ngram_jaccard_join(docs(spark, [])).count() == 0


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = "a b c d e f", "p q r s t u"
    out = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs(spark, [(5, a), (5, b), (7, a), (9, b), (8, "z z z z z")])).collect()}
    assert out == {5: 5, 7: 5, 9: 5, 8: 8}


def test_more_matches_need_longer_prefixes():
    assert ngram_join._matches(100, 75, np.ones(100, np.int64)) == 1
    assert ngram_join._matches(100, 75, np.full(100, 50)) > 1


# --- tokenization


@pytest.fixture(scope="module")
def tokenizer():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


def test_bpe_is_the_librarys(tokenizer):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(2)
    vocab = [k.replace("Ġ", " ") for k in ref.get_vocab()]
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "aaaaaaaaaaaa", "  \n\n x  ", "日本語🙂👩‍👩‍👧", "\x00\x01", "!" * 999, "'s 'LL don't", "=-" * 200]
    texts += ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["".join(rng.choice("abehinorst") for _ in range(40)) for _ in range(200)]
    for t in texts:
        ids = ref.encode(t, add_special_tokens=False).ids
        mine = tokenizer.encode(t)
        assert mine == ",".join(map(str, ids))
        assert tokenizer.decode(mine).decode() == ref.decode(ids, skip_special_tokens=False)


def test_bpe_edges(spark, tokenizer):
    out = bpe.bpe_encode(docs(spark, EDGE), vocabulary_path(), digests=True, keep=("n",)).collect()
    assert len(out) == len(EDGE)
    for r, (i, t) in zip(sorted(out, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(EDGE, key=lambda x: (x[0] or 0, len(x[1] or ""))), strict=True):
        assert r.doc_id == i and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and len(r.ids) == r.n_tokens
    back = bpe.bpe_decode(bpe.bpe_encode(docs(spark, EDGE), vocabulary_path()), vocabulary_path()).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in EDGE)
    assert bpe.bpe_encode(docs(spark, []), vocabulary_path()).count() == 0


# --- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_secrets_against_regexes():
    scan, rng = secrets.scanner(secrets.RULES), random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "apikey", "API_KEY", "=", ":", " ", '"', "'", "AKIA", "abcdef0123456789", "ABCDEFGH12345678", "é", "🙂", "secret=token = abcdefgh", "\n", "_", "deadbeefdeadbeefdeadbeef"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in scan.spans(t.encode()) if s[0] in secrets.BASE_KINDS] == brute_secrets(t)


def test_long_runs_of_digits_take_little_memory():
    import tracemalloc

    scan, run = secrets.scanner(secrets.RULES), "0123456789abcdef" * 20_000
    tracemalloc.start()
    spans = scan.spans((run + " " + run[:30] + "\ntoken=" + run).encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(run)
    assert spans == [("hex", 0, n), ("hex", n + 1, n + 31), ("assign", n + 32, 2 * n + 38), ("hex", n + 38, 2 * n + 38)] and peak < 10 * n


def test_more_secret_kinds_and_redaction():
    t = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " xoxb-1234567890ab"
    spans = secrets.scanner(secrets.RULES).spans(t.encode())
    assert [s[0] for s in spans] == ["pem", "github", "hex", "slack"]
    assert secrets.redact(t, spans) == "[pem] [github] [slack]"


def test_private_keys_are_redacted_whole():
    scan = secrets.scanner(secrets.RULES)
    clean = lambda t: secrets.redact(t, scan.spans(t.encode()))
    begin, end, lines = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", ["MIIE" + "aB3+/xYz" * 7, "Qw9Z" * 16, "Ab=="]
    for eol in ("\n", "\r\n", "\\n", "\n  "):
        body = eol.join(lines)
        assert clean(f"é a {begin}{eol}{body}{eol}{end} b") == "é a [pem] b"
        assert clean(f"a {begin}{eol}Proc-Type: 4,ENCRYPTED{eol}DEK-Info: AES-128-CBC,00AA{eol}{eol}{body}{eol}{end}{eol}b") == f"a [pem]{eol}b"
        assert clean(f"a {begin}{eol}{body}") == "a [pem]" and clean(f"a {begin}{eol}{body}{eol}that was the key.") == f"a [pem]{eol}that was the key."
    assert clean(f"a {begin} {' '.join(lines)} {end} {begin} b") == "a [pem] [pem] b"


def test_secret_edges(spark):
    out = secrets.scan_secrets(docs(spark, EDGE).drop("spans"), keep=("doc_id", "n"), redacted=True).collect()
    assert len(out) == len(EDGE) and all(r.spans == [] for r in out) and [r.text for r in out if r.doc_id == 1] == [None]
    assert secrets.scan_secrets(docs(spark, []).drop("spans")).count() == 0


# --- licences


def brute_licenses(t):
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UP).encode())]
    hits = [(k, b.label) for b in licenses.BASE for k in range(len(w)) if tuple(w[k : k + len(b.words)]) == b.words]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses_against_brute_force(spark):
    rng = random.Random(4)
    parts = ["gnu", "GNU", "general", "public", "license", "Apache", "cc", "by", "mit", "MIT", "foo", "é", "nc", "all", "rights", "reserved", "version", "3", "\n"]
    rows = [(i, rng.choice([" ", "-", "."]).join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    out = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for i, t in rows:
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_notices_tolerate_changed_words(spark):
    text = "x Permission is hereby granted, free of charge, to each person obtaining one copy of this software and associated documentation"
    r = licenses.scan_licenses(docs(spark, [(1, text), (2, "permission is hereby granted to all")])).orderBy("doc_id").collect()
    assert r[0].labels == "mit-notice" and 0.5 < r[0].score < 1 and r[1].labels == ""


def test_license_edges(spark):
    out = licenses.scan_licenses(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and all(r.n_base == 0 and r.first_word is None and r.labels == "" and r.score == 0 for r in out)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


# --- top-k


def brute_top(rows, k, every):
    sound = [(n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in sound:
        if i % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, j, w in sound if m != n and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 5, 40])
def test_top_k_against_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, dim), 1 if i % 3 else 3).astype(np.float32)]) for i in range(150)]
    rows += [(None, [1.0] * dim), (500, None), (510, []), (520, [float("nan")] * dim), (530, [None] * dim), (7, rows[7][1]), (0, rows[0][1]), (541, [1.0] * (dim + 1)), (540, [2.0] * (dim + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'b' AS block")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 5, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1.0e7, 1.0]), (1, [1.0e7, 2.0]), (2, [-1.0, 5.0]), (3, [9.0e6, 3.0e3])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") < 2, 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [x for x in brute_top(rows, 3, 1) if x[0] < 2]
    assert max(r.score for r in got) == 2_560_000_000**2 + 256 * 512


@pytest.mark.parametrize("dim", [4, 8, 32, 64])
def test_top_k_of_negative_scores(spark, dim):
    rng = np.random.default_rng(dim)
    one = rng.uniform(1, 40, dim)
    rows = [(0, [float(x) for x in one])] + [(i, [float(x) for x in -one * rng.uniform(0.2, 3)]) for i in range(1, 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, 5).collect()
    want = [x for x in brute_top(rows, 5, 1) if x[0] == 0]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want and len(want) == 5 and want[0][3] < 0


def test_blocks_keep_the_candidates_that_their_floors_come_from():
    rng = np.random.default_rng(11)
    for size in (3, 10**3, 10**6, 10**8):
        for dim in (4, 40, 64):
            cells = -rng.integers(size // 2, size, (dim, 30))
            query = rng.integers(size // 2, size, (dim, 1))
            ids, own = np.arange(30), np.array([-1])
            ((_, at, scores),) = topk.block_best(query, cells, ids, np.array([-np.inf]), own, 5)
            ((_, again, _),) = topk.block_best(query, cells, ids, np.array([topk._floor(int(scores[-1]))]), own, 5)
            exact = sorted((-sum(int(a) * int(b) for a, b in zip(query[:, 0], cells[:, j], strict=True)), j) for j in range(30))[:5]
            assert [(-s, int(j)) for s, j in zip(scores.tolist(), at, strict=True)] == exact and again.tolist() == at.tolist()


# --- classifiers


def texts_for_training(rng, n):
    good = [f"word{k}" for k in range(200)]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        w = [rng.choice(good) for _ in range(rng.randint(5, 150))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "blackguardly", "blackguardish"])
        rows.append((" ".join(w), int(bad)))
    return rows


def test_toxicity_learns_words_and_stems():
    rng = random.Random(6)
    rows = texts_for_training(rng, 500)
    model = toxicity.train([t.encode() for t, _ in rows], np.array([y for _, y in rows]), steps=150)
    held = texts_for_training(rng, 200) + [("word1 word2 blackguardest word3", 1)]
    s = toxicity.score(model, [t.encode() for t, _ in held])
    assert np.mean((s >= 0.5) == np.array([y for _, y in held], bool)) > 0.95 and ((s >= 0) & (s <= 1)).all()
    assert (toxicity.score(model, [b"", b" \n", b"word1"]) < 0.5).all()


def test_toxicity_reads_long_words_whole():
    rng = random.Random(7)
    rows, y = [], np.array([rng.random() < 0.4 for _ in range(400)])
    for k, bad in enumerate(y):
        t = [chr(0x4E00 + rng.randrange(300)) for _ in range(rng.randint(60, 200))]
        if bad:
            t[rng.randint(40, len(t) - 8)] = "愚蠢混蛋"
        rows.append("".join(t) if k % 2 else f"{'ab' * 20}{rng.choice(['qp', 'mn'])}{'idiot' if bad else 'plain'}")
    model = toxicity.train([t.encode() for t in rows[:300]], y[:300].astype(int))
    s = toxicity.score(model, [t.encode() for t in rows[300:]])
    right = (s >= 0.5) == y[300:]
    assert right[::2].mean() > 0.95 and right[1::2].mean() > 0.9


def test_toxicity_steps_keep_every_gram():
    text = ("x" + "漢字é" * 40 + "end short " + "q" * 100).encode()
    s = toxicity.Steps([text])
    assert b"".join(text[a:b] for a, b in zip(s.starts, s.ends, strict=True)) == text.replace(b" ", b"") and (s.ends - s.starts).max() <= toxicity.LONG + 3
    assert all(text[a:b].decode() for a, b in zip(s.starts, s.ends, strict=True))
    grams = set(np.concatenate([g for g, _ in s.grams()]).tolist())
    for word in text.split():
        edged = [1, *word, 1]
        for n in toxicity.GRAMS:
            for k in range(len(edged) - n + 1):
                acc = 0
                for b in edged[k : k + n]:
                    acc = (acc * 257 + b) % (1 << 64)
                assert int(toxicity.mix64(np.array([(acc + (n << 56)) % (1 << 64)], np.uint64))[0] >> np.uint64(64 - toxicity.BITS)) in grams


def test_toxicity_gradients():
    net, g = toxicity.BiGru(3), np.random.default_rng(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = g.normal(size=(5, 3, toxicity.INPUTS)), np.ones((5, 3))
    mask[3:, 1] = 0
    y, weight = np.array([1.0, 0, 1]), np.ones(3)
    loss = lambda: float(np.mean(np.logaddexp(0, net.forward(x, mask)) - y * net.forward(x, mask)))
    grads = net.gradients(x, mask, y, weight)
    for name, at in (("x", (0, 1, 3)), ("h", (1, 2, 5)), ("h", (0, 3, 20)), ("b", (1, 17)), ("a", (4,)), ("o", (9,)), ("c", (0,))):
        old = net.w[name][at]
        net.w[name][at] = old + 1e-3
        up = loss()
        net.w[name][at] = old - 1e-3
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3


def test_windows_cover_all():
    for n in (0, 1, 63, 64, 65, 120, 121, 1000):
        at = toxicity.windows_of(n)
        assert set(range(n)) <= {k for a in at for k in range(a, a + toxicity.WINDOW)} and all(b - a <= toxicity.STRIDE for a, b in zip(at, at[1:], strict=False))


def test_passages_stand_whole_in_a_window():
    for n in (64, 65, 96, 97, 130, 1000):
        at = toxicity.windows_of(n)
        assert all(any(a <= p and p + 32 <= a + toxicity.WINDOW for a in at) for p in range(n - 31))


def test_quality_pairwise_term_is_the_sum_over_pairs():
    model = quality.train([b"a b c", b"!! !! ##"] * 20, np.array([1, 0] * 20), epochs=2)
    rows, cols, x = quality.features([b"one two two THREE 4", b""])
    z, _ = quality.logits(model, 2, rows, cols, x)
    for t in range(2):
        c, v = cols[rows == t], x[rows == t]
        pairs = sum(float(model["v"][c[a]] @ model["v"][c[b]]) * v[a] * v[b] for a in range(len(c)) for b in range(a))
        assert abs(model["w0"] + float(model["w"][c] @ v) + pairs - z[t]) < 1e-4


def test_quality_separates():
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcdefgh") * rng.randint(2, 5) + ("### " if bad else "") for _ in range(40)), int(not bad)) for bad in [k % 4 == 0 for k in range(300)]]
    model = quality.train([t.encode() for t, _ in rows[:200]], np.array([y for _, y in rows[:200]]))
    s = quality.score(model, [t.encode() for t, _ in rows[200:]])
    assert np.mean((s >= 0.3) == np.array([y for _, y in rows[200:]], bool)) > 0.97


@pytest.mark.parametrize("module,score,column", [(toxicity, toxicity.score_toxicity, "toxic"), (quality, quality.score_quality, "quality")])
def test_classifier_edges(spark, module, score, column):
    df = docs(spark, EDGE).drop("score")
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 1), (3, None), (None, 1)], f"doc_id long, {column} int")
    texts, y = toxicity.labelled_sample(df, labels, column, 100)
    import zlib

    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (4, 5, 7))
    out = score(df, module.train(texts, y)).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.held_out for r in out if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in EDGE if i}
    none, _ = toxicity.labelled_sample(df, labels.limit(0), column, 100)
    assert none == [] and score(docs(spark, []).drop("score"), module.train([], np.array([]))).count() == 0


# --- decontamination

ITEM = "Tom has 5 apples and then Ann gives 3 apples to Mary before he buys 12 kg of sugar for the cake"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short it"), (3, None)], "item_id long, text string")
    rows = [
        (10, "before. " + ITEM + " and after"), (11, "So Bob has 7 apples and then Zoe gives 2 apples to Lea before he buys 20 lb of sugar for the cake"),
        (12, "he has some apples and buys sugar for the cake"), (13, None), (14, ""), (15, ITEM.upper()), (16, "too short it"), (10, "other text"), (None, ITEM),
    ]
    out = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    assert set(out) == {(10, 1), (11, 1), (15, 1), (None, 1)} and out[10, 1].verbatim and not out[11, 1].verbatim and out[10, 1].coverage > 0.9
    assert sorted(str(r.doc_id) for r in decontam.drop_leaks(docs(spark, rows), bench).collect()) == ["10", "12", "13", "14", "16"]
    assert decontam.find_leaks(docs(spark, EDGE), bench.limit(0)).count() == decontam.find_leaks(docs(spark, []), bench).count() == 0


def template(text):
    """Template tokens (token, slot value) of a text, by the letter of the rules, in plain Python."""
    out, at = [], 0
    for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        w, low = m[0], m[0].lower()
        opens = m.start() <= 1 or any(chr(text[k]) in ".!?:;|\n\r\"'([{*-" for k in (m.start() - 1, m.start() - 2) if k >= 0)
        before = at and digit
        digit, at = w[:1].isdigit() and w[-1:].isdigit(), 1
        name = w[:1].isupper() and len(w) > 1 and (97 <= w[1] < 123 or w[1] >= 128) and not opens
        kind = "num" if digit else "unit" if low.decode() in decontam.UNITS and before else "name" if name else None
        if kind and out and out[-1][0] == (kind,):
            out[-1][1].append(low)
        else:
            out.append(((kind,), [low]) if kind else (low, None))
    return [(t, None if v is None else frozenset(collections.Counter(v).items())) for t, v in out]


def brute_leaks(docs, items):
    """Covered tokens, windows and verbatim of each (document, item) found, by comparing every place of every document with every place of every item."""
    found = {}
    for item, text in items:
        it = template((text or "").encode())
        n = len(it)
        if n < decontam.LEAST:
            continue
        width, word = min(decontam.WINDOW, n), [v is None for _, v in it]
        spans = set()
        for p in range(n - width + 1):
            if 2 * sum(word[p : p + width]) >= width:
                spans.add((p, width, False))
                continue
            spans.add((p, width, True))
            longer = [(w, a) for w in range(width + 1, min(decontam.SPAN, n) + 1) for a in range(max(p + width - w, 0), min(p, n - w) + 1) if 2 * sum(word[a : a + w]) >= decontam.WINDOW]
            spans |= {(a, w, False) for w, a in longer[:1]}
        for doc, body in docs:
            dt, hits = template((body or "").encode()), set()
            for a, w, exact in spans:
                for q in range(len(dt) - w + 1):
                    if all(x[0] == y[0] and (not exact or x[1] == y[1]) for x, y in zip(it[a : a + w], dt[q : q + w], strict=True)):
                        hits |= {(q - a, a + k) for k in range(w - width + 1)}
            counts = collections.Counter(d for d, _ in hits)
            there, back, covered, windows, verbatim = {}, {}, set(), 0, True
            for d, p in sorted(hits, key=lambda h: (-counts[h[0]], h)):
                pairs = [(it[p + k][1], dt[d + p + k][1]) for k in range(width) if it[p + k][1]]
                if any(there.get(x, y) != y or back.get(y, x) != x for x, y in pairs):
                    continue
                there.update(pairs)
                back.update((y, x) for x, y in pairs)
                verbatim &= all(x == y for x, y in pairs)
                covered |= set(range(p, p + width))
                windows += 1
            if len(covered) >= min(decontam.COVERED, decontam.COVERAGE * n) and covered:
                found[doc, item] = (len(covered), windows, verbatim)
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(21)
    words = ["the", "price", "of", "apples", "Ann", "Bob", "pays", "5", "7", "12", "kg", "km", "for", "then", "gives", "Lea.", "buys", "sugar", "and", "what", "is", "left?"]
    opening = "A shop sells fruit and a customer asks for some of them today".split()
    items = [(k, " ".join([*(opening if k % 3 == 0 else []), *(rng.choice(words) for _ in range(rng.randint(1, 30)))])) for k in range(40)] + [(100, None), (101, ""), (7, "one more 5 kg of sugar for Ann and Bob")]
    items.append((102, items[4][1]))
    rows = []
    for k in range(80):
        w = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            w += own + [rng.choice(words) for _ in range(rng.randint(0, 5))]
        rows.append((k, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS key", "2 AS hash")
    got = {(r.doc_id, r.item_id): (r.covered, r.windows, r.verbatim) for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    want = brute_leaks(rows, items)
    assert got == want and len(got) > 50
    local = decontam.Benchmark([i for i, _ in items], [(t or "").encode() for _, t in items])
    assert {(rows[d][0], local.ids[k]): (c, w, v) for d, k, c, _, w, v in local.find([t.encode() for _, t in rows])} == want
    same = decontam.find_leaks(docs(spark, rows).withColumnRenamed("doc_id", "id_").selectExpr("cast(id_ AS smallint) AS item_id", "text"), bench, id_col="item_id").collect()
    assert {(r.item_id, r.item_item_id): r.covered for r in same} == {k: v[0] for k, v in want.items()}


def test_many_items_with_one_opening():
    import time

    opening = "in the town there is a shop that sells fruit and a man who asks for"
    items = [f"{opening} {w} and pays with a coin of gold" for w in (f"thing{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600))]
    windows = list(decontam.item_windows([t.encode() for t in items]))
    assert all(spare >= 1 for *_, spare in windows)
    start = time.time()
    found = list(decontam.Benchmark(list(range(600)), [t.encode() for t in items]).find([" . ".join(items[:20]).encode()]))
    assert len(found) >= 20 and time.time() - start < 30


def test_inconsistent_slots_are_no_leak():
    b = decontam.Benchmark([1], [b"if x pays 5 coins and y pays 5 coins then both pay 10 coins and we owe 5 coins"])
    good = b"if x pays 7 coins and y pays 7 coins then both pay 14 coins and we owe 7 coins"
    bad = b"if x pays 7 coins and y pays 8 coins then both pay 14 coins and we owe 9 coins"
    (g,), worse = list(b.find([good])), list(b.find([bad]))
    assert g[2] == 20 and (not worse or worse[0][2] < g[2])


def test_scattered_edits_are_found():
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["va", "vb", "vc", "vd", "ve"]
    b = decontam.Benchmark([1], [" ".join(words).encode()])
    edited = " ".join("edit" if k in (7, 15, 23) else w for k, w in enumerate(words))
    (found,) = list(b.find([edited.encode()]))
    assert found[2] == 28 and found[4] == 8 and found[5]


def test_items_of_mostly_slots():
    dense = b"we ran 5 km then 3 days with Ann 7 kg less 40 lb"
    b = decontam.Benchmark([1, 2, 3], [b"Convert 5 km to 5000 m", dense, b"5 km Ann 7 kg"])
    assert [(r[1], r[2], r[4], r[5]) for r in b.find([b"please: Convert 5 km to 5000 m now"])] == [(0, 6, 1, True)]
    assert list(b.find([b"Convert 6 km to 6000 m"])) == []
    ((_, item, covered, share, windows, verbatim),) = b.find([b"we ran 9 km then 4 days with Zoe 8 kg less 30 lb"])
    assert (item, covered, share, windows, verbatim) == (1, int(b.n[1]), 1, int(b.n[1]) - decontam.WINDOW + 1, False)
    assert [(r[1], r[5]) for r in b.find([b"x 5 km Ann 7 kg x", dense, b"x 6 km Ann 8 kg x"])] == [(2, True), (1, True)]


# --- HTML


def test_html():
    page = (
        '<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><header>Site</header><nav><ul><li><a href=1>a</a></ul></nav><div class="sidebar-left">s</div>'
        "<article><header><h1>T &amp; U</h1></header><p>Hello,  <b>big</b>\n<a href='x'>world</a>.<p>Second &lt;b&gt; para.<br>after<ul><li>one<li>two</ul>"
        '<div id="comments"><p>bad</p></div><form>f</form><aside>no</aside></article><div class="cookie_notice">c</div><!-- <p>hidden</p> --><footer>x</footer>'
    )
    assert html_extract.extract(page) == "T & U\nHello, big world.\nSecond <b> para.\nafter\none\ntwo"
    assert html_extract.extract("plain &eacute; text") == "plain é text" and html_extract.extract("") == "" and html_extract.extract("</p></div><b>x") == "x"
    assert html_extract.extract('<div class="menu"><a>x</a></div><div><p>Only text, here. It is long.</p><p>Short</p></div>') == "Only text, here. It is long.\nShort"


def test_html_without_article():
    prose = "A sentence, with some words in it; and more of them. " * 7
    parts = ["A title of few words", "Part one", prose.strip(), "first", "second", "Name", "Size", "box", "12"]
    page = '<html><body><div class="menu"><a>x</a></div><div><h1>{}</h1><h2>{}</h2><p>{}</p><ul><li>{}</li><li>{}</li></ul><table><tr><th>{}</th><th>{}</th></tr><tr><td>{}</td><td>{}</td></tr></table></div><div class="footer">f</div></body></html>'
    assert html_extract.extract(page.format(*parts)) == "\n".join(parts)
    assert html_extract.extract(f"<h1>Title</h1><p>{prose}</p>") == "Title\n" + prose.strip()


def test_inline_boilerplate_ends():
    x = html_extract.extract
    assert x('<article><p>A <span class="ad">x<p>B</p><p>C <span>c</span></p></article>') == "A\nB\nC c"
    assert x('<article>A <span class="ad">x<p>B</p><p>C <span>c</span></p></article>') == "A\nB\nC c"
    assert x('<article><p>A <span class="ad">x <span>y</span> z<br>w</span> B</p></article>') == "A B"
    assert x('<article><p>A</p><a class="promo"><div>x <b>y</b></div><p>z</a><p>B</p></article>') == "A\nB"
    assert x('<article><p>A <i hidden>x</p><p>B</p></article>') == "A\nB"


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 3000 + "deep"), (3, "u", "<p>x"), (None, "u", "<" * 500), (4, "u", "<div>" + "word " * 100_000)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out) and [r.text for r in out if r.page_id in (1, 2)] == ["", ""]


# --- chat


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good <b>&amp;", 0.9), (1, 4, 3, "user", "thanks", 0.0), (1, 5, 3, "user", "no", 0.0), (2, 1, 9, "user", "orphan", 0.0),
            (3, 1, 2, "user", "a", 0.0), (3, 2, 1, "user", "b", 0.0), (3, 3, 2, "user", "c", 0.0), (None, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {r.tree: r for r in chat.format_trees(df).collect()}
    assert set(out) == {1, 2, None} and out[1].leaf == 4 and out[1].n_turns == 3 and out[None].formatted == "<>\n</turn>\n"
    assert out[1].formatted == "<user>\nq</turn>\n<assistant>\ngood &lt;b&gt;&amp;amp;</turn>\n<user>\nthanks</turn>\n"
    assert [out[1].formatted[s.start : s.end] for s in out[1].loss] == ["good &lt;b&gt;&amp;amp;"]
    every = chat.format_trees(df, None)
    assert sorted((r.leaf, r["rank"]) for r in every.collect() if r.tree == 1) == [(2, 3), (4, 1), (5, 2)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_reply_trees_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "BROADCAST_STEPS", most)
    rng = random.Random(12)
    rows = []
    for tree in range(6):
        for node in range(rng.randint(1, 40)):
            parent = rng.choice([None, *range(node)]) if node and rng.random() < 0.1 else node - 1 if node and rng.random() < 0.6 else rng.randrange(node) if node else None
            rows.append((tree, node, parent, rng.choice(["user", "assistant"]), f"t{node}<", rng.randint(-3, 3) / 4))
    df = spark.createDataFrame(rows + rows[:5] + [(0, None, None, "user", "no id", 0.0)], "tree long, node long, parent long, role string, text string, score double").selectExpr("*", "1 AS leaf", "'u' AS up", "2 AS total")
    want = {}
    for tree in range(6):
        own = {r[1]: r for r in rows if r[0] == tree}
        ends = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = own[at][2]
            ends.append((-sum(own[x][5] for x in path), leaf, path[::-1]))
        for k, (total, leaf, path) in enumerate(sorted(ends)[:2], 1):
            want[tree, leaf] = (k, -total, len(path), "".join(f"<{own[x][3]}>\n{own[x][4].replace('<', '&lt;')}</turn>\n" for x in path), [own[x][3] for x in path])
    out = chat.format_trees(df, 2)
    assert {(r.tree, r.leaf): (r["rank"], r.score, r.n_turns, r.formatted) for r in out.collect()} == {k: v[:4] for k, v in want.items()}
    back = {(r.tree, r.leaf): r.turns for r in chat.read_turns(out).collect()}
    assert {k: [t.role for t in v] for k, v in back.items()} == {k: v[4] for k, v in want.items()}
    assert all((t.learned == t.text) if t.role == "assistant" else t.learned is None for v in back.values() for t in v)


def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["</turn>\n", "<user>\n", "&lt;", "&amp;", "\\", "\n", "é🙂", ">", "", "plain"]
    rows = [(c, t, rng.choice(["user", "assistant", "a>b\n"]), "".join(rng.choice(bits) for _ in range(4))) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, "user", None), (50, 0, "user", None), (None, None, None, "x")] + [(60, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS tree", "2 AS node")
    made = chat.format_trees(chat.chain(df, "conv_id", "turn", "role", "text"))
    back = collections.defaultdict(list)
    for r in chat.read_back(made).collect():
        back[r.tree].append((r.at, r.role, r.text, r.learned))
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [x[1:3] for x in sorted(v)] for c, v in back.items()} == dict(want)
    assert all((learned is not None) == (role == "assistant") and learned in (None, text) for v in back.values() for _, role, text, learned in v)
    assert chat.format_trees(chat.chain(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0


def test_a_worker_keeps_little_memory(spark):
    """Workers of all stages of the pipeline share an executor: short-lived arrays stay far below the 12 MB of text, and no words stay after a task."""
    import tracemalloc

    g = np.random.default_rng(5)
    texts = [b" ".join(b"%d" % x for x in g.integers(0, 50_000, 2000)) for _ in range(1000)]
    model = {"w0": 0.0, "w": np.zeros((1 << quality.BITS) + quality.STATS * quality.BINS, np.float32), "v": np.zeros(((1 << quality.BITS) + quality.STATS * quality.BINS, quality.RANK), np.float32)}
    tracemalloc.start()
    quality.score(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 11 << 20 and peak < 64 << 20
    with open(vocabulary_path(), encoding="utf-8") as f:
        tok = bpe.Tokenizer(f.read())
    ids = tok.encode("some words of a text")
    tok.forget()
    assert not (tok.words or tok.older or tok.auto.known or tok.auto.older) and tok.encode("some words of a text") == ids
