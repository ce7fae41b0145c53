"""Language models, language identification, the token store, paragraphs and HTML."""

import itertools
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from chronoloom.llm import lm_score, near, token_store
from chronoloom.llm.common import words_of
from chronoloom.llm.html_text import UNSEEN, VOID, extract_text, render
from chronoloom.llm.lang_crf import Labeller, Messages, fit_crf, predict_languages, train_languages
from chronoloom.llm.lm_score import MU, cross_entropy_difference
from chronoloom.llm.near import tune_bands
from chronoloom.llm.paragraphs import drop_repeats, edit_similarity, find_repeats
from chronoloom.llm.token_store import Feistel, read_training_order, write_training_order

EDGE = [(None, "a b"), (None, None), (900, None), (901, ""), (902, "!?"), (903, "x " * 30_000), (904, "same same"), (904, "same same")]


def frame(spark, rows, extra="score"):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id long, text string, {extra} string").repartition(3)


# --- cross-entropy difference --------------------------------------------------------------------------------


def brute_lm(rows, targets, others=()):
    """The same losses from dictionaries, token by token, with each document left out of its own models."""
    docs = [(i, ["$", *words_of(t.encode()), "$"] if t and words_of(t.encode()) else ["$"]) for i, t in rows]
    corpora = [[w for i, w in docs if i in targets], [w for _, w in docs]]
    uni = [Counter(x for w in c for x in w[1:]) for c in corpora]
    two = [Counter(p for w in c for p in itertools.pairwise(w)) for c in corpora]
    size = len(uni[1]) + 1
    out = []
    for n, (i, w) in enumerate([*docs, *((i, ["$", *words_of(t.encode()), "$"]) for i, t in others)]):
        h = []
        for k in range(2):
            inside = n < len(docs) and (k or i in targets)
            u, p = (c - Counter(own) if inside else c for c, own in ((uni[k], w[1:]), (two[k], itertools.pairwise(w))))
            total = sum(u.values())
            prob = lambda v, x: (p[v, x] + MU * (u[x] + 1) / (total + size)) / (u[v] + MU)  # noqa: B023, E731
            if len(w) > 1:
                assert sum(prob(w[0], x) for x in [*uni[1], None]) == pytest.approx(1)
                h.append(-np.mean([np.log(prob(v, x)) for v, x in itertools.pairwise(w)]))
            else:
                h.append(None)
        out.append((str(i), max(0, len(w) - 2), *h))
    return out


def same_scores(out, expected):
    key = lambda r: (r[0], r[1], r[3] or 0)
    got = sorted(((str(r.doc_id), r.n_tokens, r.h_target, r.h_background) for r in out.collect()), key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


@pytest.mark.parametrize(("counted", "block", "frequent"), [(2_000_000, 400_000, 1e-4), (60, 100, 0.03), (200, 7, 1.1), (50, 400_000, 0.0)])
def test_cross_entropy_difference(spark, monkeypatch, counted, block, frequent):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocab, [1 / (1 + k) for k in range(40)], k=rng.choice([0, 1, 2, 30, 80])))) for i in range(60)] + [e for e in EDGE if e[0] != 903]
    targets = set(range(0, 60, 3))
    ids = spark.createDataFrame([(i,) for i in [*targets, 0, None, 5000]], "doc_id long")
    others = [(2000, "w1 w2 never w1 w2"), (0, rows[5][1] + " w3")]
    same_scores(cross_entropy_difference(frame(spark, rows), ids, others=frame(spark, others), counted=counted), brute_lm(rows, targets, others))


def test_frequent_bigrams_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 0.05)
    rows = [(i, f"of the a{i} b{i} c{i}") for i in range(50)]
    flagged = lm_score.flag_documents(frame(spark, rows), spark.createDataFrame([(1,)], "doc_id long"), "doc_id", "text")
    totals = lm_score.count_words(flagged)
    of, the = lm_score.word_keys([[b"of", b"the"]], {})
    wanted = lm_score.pair_keys(np.array([the, of]), np.array([of, lm_score.MARK]))
    assert set(wanted) == set(totals.pairs) and totals.pair_counts.tolist() == [[1, 50], [1, 50]]
    first, *events = lm_score.bigram_events([[b"of", b"the", b"x"]] * 3, np.array([2, 2, 3]), {}, totals, 4, MU)
    sizes, target, background = lm_score._spread(first[1], "<u4", "<i8", "<i8")
    assert first[0] == -1 and sizes.tolist() == [3, 3, 3] and (target > 0).all() and (background > 0).all()
    dealt = np.concatenate([lm_score._spread(data, "<u8")[0] for _, data in events])
    assert len(dealt) and not np.isin([of, the], dealt).any()


def test_rare_words_of_a_large_input_are_known(spark):
    rows = [(i, "x " * 150_000) for i in range(3)] + [(20, "p q r s"), (21, "p q t"), (22, "x p q")]
    same_scores(cross_entropy_difference(frame(spark, rows), spark.createDataFrame([(20,)], "doc_id long")), brute_lm(rows, {20}))


def test_documents_that_occur_twice_are_scored_apart(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(300)], k=60))
    rows = [(i, text()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    out = {r.doc_id: r.h_background for r in cross_entropy_difference(frame(spark, rows), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert max(out[i] for i in range(10)) < min(out[i] for i in range(10, 60))


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert cross_entropy_difference(none, none.select("doc_id")).count() == 0
    out = cross_entropy_difference(frame(spark, EDGE), none.select("doc_id")).collect()
    assert len(out) == len(EDGE) and all((r.score is None) == (r.n_tokens == 0) for r in out)


# --- language identification ---------------------------------------------------------------------------------

LANGS = {"aa": ["la", "ke", "lo", "mi"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ião", "çõ", "nha", "que"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(LANGS[lang], k=rng.choice([1, 2, 3]))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        lang = rng.choice(list(LANGS))
        rows.append((i, speak(rng, lang, rng.choice([3, 30, 400])), lang if i % 11 else None))
    docs = spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, lang string, score string")
    model = train_languages(docs, max_docs=150)
    assert model.languages == ("aa", "bb", "cc")
    out = {r.doc_id: r for r in predict_languages(docs, model).collect()}
    for i, _, lang in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= out[i].score <= 1
    held = [(i, lang) for i, _, lang in rows if lang and out[i].held_out]
    assert len(held) > 40 and np.mean([out[i].lang_pred == lang for i, lang in held]) > 0.97
    mixed = speak(rng, "aa", 60) + " " + speak(rng, "bb", 40)
    edge = frame(spark, [(1, mixed), (2, None), (3, "12 34"), (4, ""), (None, speak(rng, "cc", 9)), (2, None)], "lang")
    got = predict_languages(edge, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].lang_pred == "aa" and 0.5 < by[1].score < 0.7 and by[1].n_switches >= 1
    assert {by[i].lang_pred for i in (2, 3, 4)} == {"und"} and by[None].lang_pred == "cc" and not by[None].held_out
    assert train_languages(docs.where("lang is null")) is None
    assert {r.lang_pred for r in predict_languages(edge, None).collect()} == {"und"}
    assert predict_languages(edge.limit(0), model).count() == 0


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (time x chains x labels) and expected transition counts, of chains padded to the
    same length. ``emit``: logarithmic scores."""
    steps, chains, labels = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(transitions)
    alpha = np.empty_like(e)
    a = np.full((chains, labels), 1.0 / labels, dtype=e.dtype)
    for k in range(steps):
        a = (a @ t if k else a) * e[k]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[k] = a
    beta = np.ones((chains, labels), dtype=e.dtype)
    marginals = np.empty_like(e)
    pairs = np.zeros((labels, labels))
    for k in range(steps - 1, -1, -1):
        if k + 1 < steps:
            inner = e[k + 1] * beta
            inside = (k + 1 < lengths)[:, None]
            joint = alpha[k][:, :, None] * t[None] * inner[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True))[inside[:, 0]].sum(axis=0)
            beta = np.where(inside, inner @ t.T, 1.0)
            beta = beta / beta.sum(axis=1, keepdims=True)
        m = alpha[k] * beta
        marginals[k] = m / m.sum(axis=1, keepdims=True)
    return marginals, pairs


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    lengths, labels = np.array([4, 2, 1]), 3
    emit, t = rng.normal(size=(4, 3, labels)), rng.normal(size=(labels, labels))
    marginals, pairs = forward_backward(emit, lengths, t)
    expected = np.zeros((labels, labels))
    for c, n in enumerate(lengths):
        weight = {p: np.exp(sum(emit[k, c, y] for k, y in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product(range(labels), repeat=int(n))}
        z = sum(weight.values())
        for k in range(n):
            assert np.allclose(marginals[k, c], [sum(w for p, w in weight.items() if p[k] == y) / z for y in range(labels)])
        for p, w in weight.items():
            for a, b in itertools.pairwise(p):
                expected[a, b] += w / z
    assert np.allclose(pairs, expected)


@pytest.mark.parametrize("kind", [np.float64, np.float32])
def test_stretches_give_the_marginals_of_one_chain(kind):
    rng = np.random.default_rng(1)
    sizes, t = np.array([700, 1, 16, 0, 17, 333, 64]), np.array([[3.0, 0, 0.5], [0, 4, 0], [0.2, 0, 3]])
    emit = rng.normal(size=(sizes.sum(), 3)) * rng.choice([0, 0, 0, 2], size=(sizes.sum(), 1))  # long stretches without evidence
    got = Messages(np.exp(emit).astype(kind), sizes, t, stretch=16).marginals()
    at = 0
    for n in sizes[sizes > 0]:
        whole, _ = forward_backward(emit[at : at + n, None, :], np.array([n]), t)
        assert np.allclose(got[at : at + n], whole[:, 0], atol=1e-9 if kind == np.float64 else 1e-4)
        at += n


def test_chains_are_labelled_together():
    chains = [([b"x1", b"y1"] * 20, [0] * 40), ([b"x2", b"y2"] * 20, [1] * 40)]
    model = fit_crf(chains, ("p", "q"), steps=30)
    assert model.transitions[0, 0] > model.transitions[0, 1]
    texts = [[b"x1"] * 300, [], [b"x2"] * 5, [b"7"]]
    p, letter, doc = Labeller(model).marginals(texts)
    assert len(p) == 306 and letter.sum() == 305 and np.allclose(p.sum(axis=1), 1, atol=1e-5) and set(doc) == {0, 2, 3}
    one_by_one = [Labeller(model).marginals([x])[0] for x in texts]
    assert np.allclose(p, np.concatenate(one_by_one), atol=1e-5)


# --- token store ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    a = Feistel(n, 5)(np.arange(n))
    assert sorted(a.tolist()) == list(range(n))
    if n == 1000:
        assert (a != Feistel(n, 6)(np.arange(n))).any() and (np.diff(a) == 1).mean() < 0.05


def test_a_language_that_only_long_texts_have(spark):
    rng = random.Random(8)
    vocab = {"en": ["the", "and", "with", "ing", "house"], "de": ["der", "und", "mit", "ung", "haus"], "xx": ["zzz", "qqq"]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=n)), lang) for i, (lang, n) in enumerate([("en", 40)] * 60 + [("de", 4000)] * 12 + [("xx", 9)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r.doc_id: r.lang_pred for r in predict_languages(docs, train_languages(docs)).collect()}
    assert all(told[i] == lang for i, _, lang in rows)
    two = train_languages(docs, max_languages=2)
    assert two.languages == ("de", "en") and {r.lang_pred for r in predict_languages(docs, two).collect()} == {"de", "en"}


def test_token_store(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, f"word{i} and so on " * (i % 40)) for i in range(150)] + EDGE
    path = tmp_path / "in"
    frame(spark, rows, "slot").write.parquet(str(path))
    docs = spark.read.parquet(str(path))
    out_dir = f"file://{tmp_path}/out"
    out = write_training_order(docs, out_dir, length=64, shard_slots=50).collect()
    order = list(read_training_order(out_dir))
    assert sorted(r.slot for r in out) == list(range(len(out))) and len(order) == len(out)
    by_doc = {}
    for r in out:
        ids = order[r.slot]
        assert not ids[r.n_tokens :].any() and r.shard == r.slot // 50 and r.offset == r.slot % 50 * 128
        assert r.ids_crc32 == zlib.crc32(ids[: r.n_tokens].astype("<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.seq_no, ids[: r.n_tokens].tolist()))
    for i, text in rows[:150]:
        assert [x for _, s in sorted(by_doc[i]) for x in s] == t.encode(text, add_special_tokens=False).ids + [1]
    assert [x.tolist() for x in read_training_order(out_dir, 77)] == [x.tolist() for x in order[77:]]
    again = write_training_order(docs, out_dir, length=64, shard_slots=50).collect()
    assert sorted(again, key=lambda r: r.slot) == sorted(out, key=lambda r: r.slot)
    # a write that was interrupted leaves shards that are whole as they are
    first, second = sorted((tmp_path / "out").glob("*.bin"))[:2]
    first.unlink()
    before = second.stat().st_mtime_ns
    write_training_order(docs, out_dir, length=64, shard_slots=50).collect()
    assert first.exists() and second.stat().st_mtime_ns == before
    assert [x.tolist() for x in read_training_order(out_dir)] == [x.tolist() for x in order]
    write_training_order(docs, out_dir, length=64, shard_slots=50, key=7).collect()
    other = [x.tolist() for x in read_training_order(out_dir)]
    assert other != [x.tolist() for x in order] and sorted(other) == sorted(x.tolist() for x in order)
    assert write_training_order(docs.limit(0), f"file://{tmp_path}/none").count() == 0 and list(read_training_order(f"file://{tmp_path}/none")) == []


@pytest.mark.parametrize("tasks", [20_000, 2])
def test_token_store_in_another_order(spark, tmp_path, monkeypatch, tasks):
    """The same documents with their parts swapped: rows and shards agree after each write."""
    monkeypatch.setattr(token_store, "MAX_TASKS", tasks)
    one, two = ([(i, f"word{i} and so on " * (i % 9)) for i in range(a, a + 60)] for a in (0, 60))
    out_dir = f"file://{tmp_path}/out"
    for k, parts in enumerate(((one, two), (two, one), (one, two))):
        for j, rows in enumerate(parts):
            spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}/{j}")
        docs = spark.read.parquet(f"{tmp_path}/{k}/0").unionByName(spark.read.parquet(f"{tmp_path}/{k}/1"))
        out = write_training_order(docs, out_dir, length=16, shard_slots=20).collect()
        order = list(read_training_order(out_dir))
        assert len(order) == len(out) and all(r.ids_crc32 == zlib.crc32(order[r.slot][: r.n_tokens].astype("<u4").tobytes()) for r in out)
    # a shard of full length with other bytes is replaced
    shard = next((tmp_path / "out").glob("*.bin"))
    good = shard.read_bytes()
    shard.write_bytes(good[::-1])
    shard.with_suffix(".crc32").write_text("00000000")
    write_training_order(docs, out_dir, length=16, shard_slots=20).collect()
    assert shard.read_bytes() == good


# --- paragraphs ----------------------------------------------------------------------------------------------


def test_bands_reach_the_recall():
    for threshold, recall, most in ((0.8, 0.99, 24), (0.8, 0.95, 64), (0.5, 0.9, 32)):
        b, r = tune_bands(threshold, recall, most)
        assert b * r <= most and 1 - (1 - threshold**r) ** b >= recall
    for most in (2, 0, 257):
        with pytest.raises(ValueError):
            tune_bands(0.3, 0.99, most)


def brute_edit(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_edit_similarity():
    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        s = 1 - brute_edit(x, y) / max(len(x), len(y)) if x or y else 0.0
        assert edit_similarity(" ".join(x).encode(), " ".join(y).encode(), 0.5) == pytest.approx(s if s >= 0.5 else 0.0)


@pytest.mark.parametrize("small", [24, 3])
def test_paragraphs(spark, monkeypatch, small):
    monkeypatch.setattr(near, "SMALL_BUCKET", small)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    para = lambda n: " ".join(word() for _ in range(n))
    passages = [para(60) for _ in range(5)]
    rows, i = [], 0
    for i in range(40):
        lines = [para(rng.choice([3, 15, 40])) for _ in range(4)]
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            w = p.split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            lines.insert(rng.randrange(5), " ".join(w))
        rows.append((i, "\n".join([*lines, "short line"])))
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "\n\n")]
    items = [((i, k), line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 20]
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in (line.split() for _, line in items)]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(items)):
        groups.setdefault(find(k), []).append(items[k][0])
    repeated, removed = Counter(), {}
    for ids in groups.values():
        if len(ids) > 1:
            for doc, no in ids:
                repeated[doc] += 1
                if (doc, no) != min(ids):
                    removed.setdefault(doc, []).append(no)
    docs = frame(spark, rows, "removed")
    out = {r.doc_id: r for r in find_repeats(docs).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        assert out[i].n_lines == (0 if t is None else len(t.split("\n")))
        assert (out[i].n_repeated, sorted(out[i].removed), out[i].n_removed) == (repeated[i], sorted(removed.get(i, [])), len(removed.get(i, [])))
    left = {r.doc_id: r for r in drop_repeats(docs).collect()}
    assert list(left[0].asDict()) == docs.columns
    for i, t in rows:
        assert left[i].text == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed.get(i, [])))


def test_passages_inside_lines(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    shared, rows = [some(50) for _ in range(20)], []
    for k, p in enumerate(shared):
        rows.append((2 * k, f"{some(rng.randrange(90))} {p} {some(rng.randrange(90))}"))
        w = p.split()
        short = "\n".join(" ".join(w[at : at + 7]) for at in range(0, 50, 7))  # lines of under MIN_WORDS words
        rows.append((2 * k + 1, f"{some(60)}\n{short}\n{some(9)}" if k % 2 else f"{some(300)} {p.upper()}"))
    rows += [(100, some(400)), (101, "x " * 300), (102, " ".join(shared[0].split()[:19])), (103, None), (None, shared[1])]
    out = {r.doc_id: r for r in find_repeats(frame(spark, rows)).collect()}
    for i in range(40):
        assert out[i].n_passages and out[i].passage_docs == [i - i % 2]
        w = rows[i][1].lower().split()
        assert all(" ".join(w[p : p + 20]) in shared[i // 2] for p in out[i].passages)
    assert all(out[i].n_passages == 0 and out[i].passages == [] for i in (100, 101, 102, 103, None))
    assert len(out) == len(rows)


def test_paragraphs_by_edits(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, pairs = [], []
    for k in range(40):
        w = [word() for _ in range(40)]
        rows.append((3 * k, " ".join(w)))
        v = w[:]
        for at in rng.sample(range(40), edits := rng.choice([2, 5, 8, 12])):
            v[at] = word()
        rows += [(3 * k + 1, " ".join(v)), (3 * k + 2, " ".join(sorted(w)))]  # the same words in another order aren't a repeat
        pairs.append(edits <= 8)
    out = {r.doc_id: r.n_repeated for r in find_repeats(frame(spark, rows), verify="edit").collect()}
    assert [(out[3 * k], out[3 * k + 1], out[3 * k + 2]) for k in range(40)] == [(1, 1, 0) if p else (0, 0, 0) for p in pairs]


def test_recall_on_a_table(spark):
    """Documents whose id is divisible by 100 against all: each run of 50 words that another document holds is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r.doc_id: words_of((r.text or "").encode()) for r in docs.collect()}
    holders = {}
    for i, w in words.items():
        for p in range(len(w) - 49):
            holders.setdefault(tuple(w[p : p + 50]), set()).add(i)
    shares = {i for ids in holders.values() if len(ids) > 1 for i in ids}
    out = {r.doc_id: r for r in find_repeats(docs).collect()}
    assert shares and all(out[i].n_passages for i in shares)
    asked = [i for i in words if i % 100 == 0]
    assert asked and all(out[i].n_passages for i in asked if i in shares)


def test_paragraphs_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find_repeats(empty).count() == 0 and drop_repeats(empty).count() == 0
    odd = frame(spark, [e for e in EDGE if e[0] != 903] + [(None, "w " * 40), (None, "w " * 40)])
    assert find_repeats(odd, verify="edit").count() == len(EDGE) + 1


# --- HTML ----------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<title>t</title><style>x</style><script>var a='<p>';</script><p>a &amp; b&copy;</p>", "a & b©"),
    ("<ul><li>a<li>b<ol start=3><li>x<li value=7>y</ol></ul>z", "- a\n- b\n  3. x\n  7. y\n\nz"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>long one<td>2</table>", "name      n\na         10\nlong one  2"),
    ("<table><caption>cap</caption><td>x<td>y<tr><td colspan=2>wide<td>z</table>", "cap\nx     y\nwide     z"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre>  x\n    y</pre>", "  x\n    y"),
    ("<p style='DISPLAY : none'>no</p><p hidden>no</p><p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<!-- c --><!doctype html>x<!-- open", "x"),
    ("<b>a</b> <i>b</i>c", "a bc"),
    ("x < y > z & w", "x < y > z & w"),
    ("<a href=\"a>b\">k</a>", "k"),
    ("<head><meta x><p>body text", "body text"),
    ("<textarea> a\n b</textarea><input type=submit value=Go><input value=no>", " a\n bGo"),
    ("<select><option>a<option selected>b</select> c", "b c"),
    ("<select><optgroup label=g><option>a<option>b</select>", "a"),
    ("<p hidden=until-found>no<p>x<math><mi>y</mi></math><svg><title>t</title><text>z</text></svg>", "xyz"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_render(page, text):
    assert render(page) == text


def test_odd_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert render(deep) == "x"
    assert render("<table>" * 3000 + "y").strip() == "y"
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b", "<!--", "-->", "&#0;", "&lt", "x", " ", "\n", "<script>", "</script>", "<td colspan=99999999>", "<ol start=a>", "</", "<>", "\"", "='"]
    for _ in range(500):
        render("".join(rng.choices(bits, k=30)))


class Words(HTMLParser):
    """The visible words of well-formed pages, whatever their layout."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        gone = "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "") or tag in UNSEEN
        if tag not in VOID:
            self.open.append((tag, gone))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if not any(gone for _, gone in self.open):
            self.found += data.split()


def test_words_of_a_table_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    same = 0
    for r in extract_text(pages).collect():
        brute = Words()
        brute.feed(html[r.page_id] or "")
        brute.close()
        marks = re.compile(r"^\s*(?:-|\d+\.) ", re.M)
        a, b = (sorted("".join(x).replace("-", "")) for x in ("".join(marks.sub("", r.text).split()), "".join(brute.found)))
        same += a == b
    assert same >= 0.97 * len(html), same / len(html)


@pytest.mark.parametrize("bit", ["<a ", "<div x=\"", "<div x='", "<", "</", "</a ", "<!", "<!--", "<a b=", "<p ", "&", "<table><td>", "<a\n"])
def test_hostile_pages_take_linear_time(bit):
    began = time.perf_counter()
    render("<p>seen</p>" + bit * (1_000_000 // len(bit)))
    assert time.perf_counter() - began < (10 if bit == "<table><td>" else 1.5)


def test_unclosed_tags():
    assert render("<p>a</p>b<i c") == "a\n\nb" and render("x</b") == "x" and render("<a x=\"1>2") == "2"


def test_tables_stay_in_proportion():
    wide = "<table>" + f"<tr><td>{'w' * 20_000}<td>x" + "<tr><td>a<td>b" * 2000 + "</table>"
    assert len(render(wide)) < 8 * len(wide) + 100_000 and "a  b" in render(wide)
    far = "<table>" + "<tr>" + "<td>c" * 3000 + "<tr><td colspan=1000>" * 3 + ("<tr>" + "<td colspan=1000>" * 2 + "<td>z") * 3000 + "</table>"
    assert len(render(far)) < 8 * len(far) + 100_000
    nested = "<table><tr><td>a<td>" * 60 + "x" * 300 + "</table>" * 60
    assert len(render(nested)) < 8 * len(nested) + 100_000


def test_pages_that_are_not_utf8(spark):
    (r,) = extract_text(spark.sql("select 1L as page_id, cast(unhex('3C703E61FF62') as string) as html")).collect()
    assert r.text == "a\ufffdb"


def test_pages(spark):
    rows = [(i, h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, "<p>a", "x"), (3, PAGES[3][0], "x")]
    out = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id is not None:
            assert r.text == PAGES[r.page_id][1] and r.n_lines == (len(r.text.split("\n")) if r.text else 0)
