"""The training-data operators on small fixtures: brute force, round trips, and odd input."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skyloom.llm import catalog, op1_lm_scoring, op2_language, op3_packing, op4_bpe, op5_minhash, op6_secrets, op7_topk, op8_token_counts, op9_fingerprints, op10_url_filter, storage

SF_DIR = "/root/testdata/sf0.001"
JSON, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
ODD = [
    (1, None), (2, ""), (3, "   \n "), (4, "!!! 123"), (5, "a"), (6, "the same text, twice over and over"), (6, "the same text, twice over and over"), (7, "the same text, twice over and over"),
    (None, "no id here at all"), (8, "x" * 3000), (9, "word " * 5000), (10, "<|endoftext|> it's  é 中文 😀\t\tend "), (11, "Ein kurzer deutscher Satz über nichts"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", "s", 0, -1.0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


# 1


def brute_scores(texts, order, least):
    counts, total = {}, 0
    for t in texts:
        w = words(t)
        total += len(w)
        for n in range(1, order + 1):
            for i in range(len(w) - n + 1):
                counts[tuple(w[i : i + n])] = counts.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for t in texts:
        w, micro = words(t), 0
        for i in range(len(w)):
            longest = min(i + 1, order)
            for n in range(longest, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[g] >= least:
                    p = counts[g] / (counts[g[:-1]] if n > 1 else total)
                    micro += round(1e6 * np.log(p)) + (longest - n) * round(1e6 * np.log(0.4))
                    break
        out.append((len(w), micro))
    return out


def test_lm_scoring(odd, none):
    for order in (1, 2, 3):
        got = sorted((r.n_words, r.score_micro) for r in op1_lm_scoring.score(odd, order=order).collect())
        assert got == sorted(brute_scores([t for _, t in ODD], order, 2))
    assert op1_lm_scoring.score(none).count() == 0
    assert {r.doc_id for r in op1_lm_scoring.score(odd).where("lm_score is null").collect()} == {1, 2, 3}


# 2


def test_language_held_out_accuracy(spark):
    got = catalog.op2_language_id(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 20 and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def brute_phrases(train, text):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_against_brute_force():
    rng = random.Random(1)
    train = [rng.randrange(3, 7) for _ in range(300)]
    automaton = op2_language.Automaton(train, 8)
    spell = lambda s: "".join(map(chr, s))
    for _ in range(30):
        row = [rng.randrange(3, 8) for _ in range(rng.randint(1, 60))]
        assert automaton.phrases(np.array(row, np.uint16)[:, None])[0] == brute_phrases(spell(train), spell(row))


@pytest.mark.parametrize("letters", ["abcd", "a"])
def test_long_texts_are_parsed_whole(letters):
    rng = random.Random(2)
    spell = lambda n, more="": "".join(rng.choice(letters + more) for _ in range(n))
    train = {"x": spell(400), "y": spell(333)}
    model = op2_language.Languages(tuple(train.items()))
    texts = [spell(rng.randint(1, 1500), "e" * (k % 2)) for k in range(40)]
    for text, name, score in zip(texts, *model.classify(texts), strict=True):
        n = {k: brute_phrases(t, text) for k, t in train.items()}
        assert name == min(n, key=n.get) and score == pytest.approx(abs(n["x"] - n["y"]) / max(n.values()))


def test_training_texts_are_whole(spark):
    rows = [(i, "ab " * (10 + i), "x") for i in range(9)] + [(20, "long " * 900, "x"), (21, "long " * 700, "y"), (22, "longer " * 700, "y"), (23, None, "y"), (24, "...", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (x, own), (y, other) = op2_language.learn(df, most_docs=9)
    assert (x, y) == ("x", "y") and sorted(own.split("\n")) == sorted(t for _, t, g in rows[:9]) and sorted(other.split("\n")) == [rows[10][1], rows[11][1]]
    assert op2_language.learn(df, most_docs=1)[1][1] == rows[10][1]


def test_language_odd(odd, none):
    model = (("de", "ein kurzer satz über nichts und wieder nichts"), ("en", "the same text twice over and over no id here at all word"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in op2_language.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[11][0] == "de" and got[6][0] == "en" and 0 <= got[6][1] <= 1
    assert op2_language.identify(none, model).count() == 0 and op2_language.learn(none) == ()
    assert {r.lang_pred for r in op2_language.identify(odd, ()).collect()} == {"und"}


# 3


def check_packing(placed, texts):
    tokenizer = Tokenizer.from_file(JSON)
    pieces = {}
    for r in placed:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0 and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and 0 < own[0].length <= 2048 and (len(own) == 1) == (len(ids) <= 2048)
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
    at = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= 2048
    return len(at), -(-sum(at.values()) // 2048)


def test_packing(docs, odd, none):
    used, bound = check_packing(op3_packing.pack(docs, JSON).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert used <= bound * 1.02 + 1
    unique = odd.where("doc_id <> 6 and doc_id is not null")
    check_packing(op3_packing.pack(unique, JSON).collect(), {r.doc_id: r.text for r in unique.collect()})
    assert op3_packing.pack(odd, JSON).select("doc_id").where("doc_id is null").count() == 1
    assert op3_packing.pack(none, JSON).count() == 0
    assert op3_packing.pack(odd, JSON, with_ids=True).where("size(ids) <> length").count() == 0


def best_fit(lengths, capacity):
    """How many sequences best fit takes, longest first, document by document."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_sweep_equals_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 500))]
    runs, docs_left, _ = op3_packing.sweep([(n, 0, lengths.count(n)) for n in set(lengths)], [], 64, True)
    assert len({s + k for _, _, c, s, _ in runs for k in range(c)}) == best_fit(lengths, 64) and docs_left == []
    assert sum(c for _, _, c, _, _ in runs) == len(lengths)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_of_ranges_pack_all(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice((9, 30, 64))) for _ in range(900)] + [7] * 400
    df = spark.createDataFrame([(n, lengths.count(n)) for n in set(lengths)], "length long, n long")
    exact = best_fit(lengths, 64)
    for range_runs, slack in ((4, 1.03), (16, 1.03), (10**6, 1.0)):
        runs = op3_packing.match(df, 64, range_runs).collect()
        placed, at = {}, set()
        for r in runs:
            for k in range(r.n):
                assert (r.length, r.first + k) not in at
                at.add((r.length, r.first + k))
                placed.setdefault(r.sequence + k, []).append((r.offset, r.length))
        assert at == {(n, k) for n in set(lengths) for k in range(lengths.count(n))}
        for own in placed.values():
            ends = [a + n for a, n in sorted(own)]
            assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 64
        assert exact <= len(placed) + 1 and len(placed) <= exact * slack + 1


# 4 and 8


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, odd, none, encoding):
    for rows in (docs, odd):
        encoded = op4_bpe.encode(rows, RANKS, public_tokenizers.PATTERN)
        got = sorted((tuple(r.ids), bytes(r.decoded)) for r in op4_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect())
        texts = [r.text or "" for r in rows.select("text").collect()]
        assert got == sorted((tuple(encoding.encode_ordinary(t)), t.encode()) for t in texts)
    assert op4_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


PARTS = [" ", "  ", "\n", " \n", "\t", " ", " ", "\x1c", "\x85", "'s", "'ll", "12", "³", "é", "é", "<|endoftext|>", "<|startoftext|>", "😀", "中文", "!!", "a", "Zz", "_", "İ", "ǅ", "\x00", "ab" * 400]


def test_odd_texts_against_the_libraries(encoding):
    rng = random.Random(2)
    ids, words_ = Tokenizer.from_file(JSON), Tokenizer.from_file(WORDS)
    bpe, own = op4_bpe.bpe(RANKS, public_tokenizers.PATTERN), op3_packing.Ids(JSON, op3_packing.prove_ranks(JSON))
    library = op3_packing.Ids(JSON, None)
    assert own.by_rank is not None
    counter = op8_token_counts.Counter(WORDS, op8_token_counts.prove_single(WORDS))
    for _ in range(400):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(bpe.encode([t])[0], np.int32).tolist() == encoding.encode_ordinary(t)
        assert np.frombuffer(own.encode(t), np.uint32).tolist() == ids.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == library.encode(t)
        assert counter.count(t) == len(words_.encode(t, add_special_tokens=False).ids)


def test_long_pre_tokens_against_the_library(encoding):
    rng = random.Random(13)
    bpe = op4_bpe.bpe(RANKS, public_tokenizers.PATTERN)
    assert all(rank > max(key >> 32, key & 0xFFFFFFFF) or rank < 256 for key, rank in op4_bpe.own_pairs(bpe.ranks).items())
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyzABCDEF", "aaab", "é中文字的a", "=-+") for n in (513, 4000)] + ["x" * 900_000, "ab" * 300_001, " " * 5000]
    texts += ["".join(rng.choice("abc ") for _ in range(600_000))]
    for t in texts:
        want = encoding.encode_ordinary(t)
        assert np.frombuffer(bpe.encode([t])[0], np.int32).tolist() == want
        assert bpe.decode(np.array(want)) == t.encode()


def test_ranks_equal_the_library_on_all_kinds_of_letters():
    own, ids = op3_packing.Ids(JSON, op3_packing.prove_ranks(JSON)), Tokenizer.from_file(JSON)
    rng = random.Random(12)
    points = [c for c in rng.sample(range(0x110000), 20_000) if not 0xD800 <= c < 0xE000] + list(range(0x3000))
    for lo in range(0, len(points), 64):
        t = "a".join(f"a{c} {c}1{c}{c}!{c}  {c}'s{c}\n{c}\t {c}" for c in map(chr, points[lo : lo + 64]))
        assert np.frombuffer(own.encode(t), np.uint32).tolist() == ids.encode(t, add_special_tokens=False).ids


def test_ranks_are_not_proven_for_other_files(tmp_path):
    import json

    assert op3_packing.prove_ranks(WORDS) is None
    with open(JSON, encoding="utf-8") as text:
        file = json.load(text)
    file["model"]["merges"] = file["model"]["merges"][::-1]
    (tmp_path / "other.json").write_text(json.dumps(file), encoding="utf-8")
    assert op3_packing.prove_ranks(str(tmp_path / "other.json")) is None


def test_token_counts(odd, none):
    tokenizer = Tokenizer.from_file(WORDS)
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in op8_token_counts.token_counts(odd, WORDS, 2048).collect())
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert got == sorted((len((t or "").encode()), size(t or ""), size(t or "") > 2048) for _, t in ODD)
    assert op8_token_counts.token_counts(none, WORDS, 2048).count() == 0


# 5


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_components(texts, n, percent):
    ids, sets, up = list(texts), {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_brute_force(spark, docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {10_000 + i: t for i, t in enumerate(near_copies(rng, 80, base, 8))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    for n, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash.near_duplicates(df, n, percent).collect()}
        assert got == brute_components(texts, n, percent)


def test_near_duplicates_odd(odd, none, spark, monkeypatch):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op5_minhash.near_duplicates(odd, 3, 85).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (6, 5, 6, True), (7, 5, 6, False), (None, 3, None, False), (9, 1, 9, True)} <= got
    assert op5_minhash.near_duplicates(none).count() == 0
    monkeypatch.setattr(op5_minhash, "BUCKET", 20)
    monkeypatch.setattr(op5_minhash, "BLOCK", 1500)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = dict(enumerate(near_copies(rng, 120, base, 5)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash.near_duplicates(df, 3, 85).collect()} == brute_components(texts, 3, 85)


def test_links_in_a_crowded_bucket_of_loosely_alike_texts(spark, monkeypatch):
    """Every pair is decided in a bucket beyond the bound, whose nodes are mostly not alike."""
    monkeypatch.setattr(op5_minhash, "BUCKET", 10)
    rng = random.Random(15)
    base = [f"w{i}" for i in range(100)]
    texts = {k: " ".join(base[:60] + [f"x{rng.randrange(10**6)}" for _ in range(40)]) for k in range(0, 120, 2)}
    texts |= {k + 1: t.rsplit(" ", rng.randrange(1, 4))[0] for k, t in texts.items() if k % 3}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash.near_duplicates(df, 3, 85).collect()}
    assert got == brute_components(texts, 3, 85) and len({c for _, c in got.values()}) == 60


# 6


def test_secrets(docs, odd, none):
    field = op6_secrets.learn(docs)
    for r in op6_secrets.scan(docs, field).join(docs, "doc_id").collect():
        base = [(s.start, s.kind, s.end) for s in r.spans if s.kind != "field"]
        want = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r.text) if len(m[2]) >= 12]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r.text) if len(m[0]) >= 18] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", r.text) if len(m[0]) >= 16]
        assert sorted(base) == sorted(want)
    found = op6_secrets.find(field, ['pwd = "hG7kQ2_zLw9pXv3TnB5r"', "the token of the day", "plain words only", "", "password : token : abcdefghijklmnop"])
    assert found[0] and found[0][0][0] == "field" and found[1] == found[2] == found[3] == []
    assert not any(k == "assign" for k, _, _ in found[4])
    assert op6_secrets.scan(odd, field).count() == len(ODD) and op6_secrets.scan(none, field).count() == 0
    assert op6_secrets.find(op6_secrets.fit([], rounds=5), ["a b"]) is not None


def brute_viterbi(e, steps):
    score, back = e[0] + steps[0], []
    for t in range(1, len(e)):
        paths = score[:, None] + steps
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + e[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


def path_score(e, steps, path):
    return e[0][path[0]] + steps[0][path[0]] + sum(steps[a][b] + e[t + 1][b] for t, (a, b) in enumerate(zip(path, path[1:], strict=False)))


@pytest.mark.parametrize("seed", range(8))
def test_decoding_is_exact(seed):
    rng = np.random.default_rng(seed)
    steps = rng.uniform(-1, 1, (3, 3)) * (1, 4)[seed % 2]
    steps[0, 2] = -np.inf
    field = op6_secrets.Field(np.zeros((5, 1, 3)), np.zeros((1, 3)), steps)
    n = (60, 64, 65, 700)[seed % 4]
    e = rng.normal(0, 2, (n, 3))
    e[:, 0] += rng.choice([0, 20], n) * (seed < 6)
    starts = np.array([0, 20, 20, 45, n])  # one text has no token, nor the last
    got = field.decode(e, starts)
    for a, b in ((0, 20), (20, 45), (45, n)):
        _, best = brute_viterbi(e[a:b], steps)
        assert path_score(e[a:b], steps, got[a:b].tolist()) == pytest.approx(best)
    assert len(field.decode(e[:0], starts[:0])) == 0


def test_added_spans_are_right(docs):
    """Precision and recall of the field on made secrets in documents that it hasn't seen, and on addresses and numbers."""
    texts = sorted(r.text for r in docs.where("length(text) < 20000").collect())
    field, rng = op6_secrets.fit(texts[::2]), random.Random(99)
    found = by_base = right = wrong = 0
    for text in texts[1::2]:
        own, marked = op6_secrets.planted(rng, text, 3, 6)
        (spans,) = op6_secrets.find(field, [own])
        meets = lambda x, y: any(a < y and x < b for a, b in marked)  # noqa: B023,E731
        found += sum(any(a < y and x < b for _, x, y in spans) for a, b in marked)
        by_base += sum(any(k != "field" and a < y and x < b for k, x, y in spans) for a, b in marked)
        right += sum(k == "field" and meets(x, y) for k, x, y in spans)
        wrong += sum(k == "field" and not meets(x, y) for k, x, y in spans)
    made = 3 * len(texts[1::2])
    assert by_base < 0.8 * made and found > 0.95 * made and right > 0.15 * made and wrong < 0.05 * (right + wrong)
    plain = ["10.143.123.131", "write to anna.12@mail7.example.com or 555-0134", "see https://a.example.com/x/12345.html", "at 2024-10-11T12:30", "the password of the day is secret", "key/value_pairs and some-long-name", "4111 1111 1111 1111"]
    assert not any(op6_secrets.find(field, plain))


def test_secrets_in_long_texts():
    """One text beyond a block beside short ones, and one without a blank."""
    field, secret = op6_secrets.fit([], rounds=40), 'password = "0123456789abcdef01234567" '
    texts = ["plain words " * 60_000 + secret + "more " * 60_000, "", "x" * 700_000, secret]
    got = op6_secrets.find(field, texts)
    assert [(k, a) for k, a, _ in got[0]] == [("assign", 720_000), ("hex", 720_012)] and [k for k, *_ in got[3]] == ["assign", "hex"] and got[1] == []
    assert not any(k != "field" for k, *_ in got[2])


# 7


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 12)).round(2)
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 12), (None, v[0].tolist()), (1003, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in op7_topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(x)) for i, x in rows[:400]} | {1003: np.pad(np.floor(256 * np.array([0.5])), (0, 11))}
    for q in range(0, 400, 20):
        best = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert op7_topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_top_k_of_large_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 6)).round(2)
    v[80] = np.abs(v[80])
    v[11], v[40], v[80], v[81] = 4e5 * v[11], 1e6 * v[40], 3e6 * v[80], 3e6 * v[80]
    v[81, 0] += 1 / 256
    v[100] = 0
    v[100, 0] = -1e30
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    whole = [[int(np.floor(256 * c)) for c in x] for x in v]
    dot = lambda a, b: sum(s * t for s, t in zip(whole[a], whole[b], strict=True))
    asked = [q for q in range(0, 300, 20) if v[q, 0] > 0 and max(dot(q, i) for i in range(300) if i != q) < 2**63]
    assert len(asked) > 4 and 80 in asked
    got = {}
    for r in op7_topk.top_k(df, F.col("vec_id").isin(asked), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in asked:
        best = sorted((-dot(q, i), i) for i in range(300) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_pivots_save_work():
    """On groups of alike vectors most candidates are never evaluated; among vectors equally far apart all are."""
    rng = np.random.default_rng(4)
    for centres, most in ((np.eye(16)[:10] * 900, 0.35), (np.zeros((10, 16)), 1.0)):
        x = np.concatenate([rng.normal(c, 9, (400, 16)).round() for c in centres])
        rng.shuffle(x)
        p = op7_topk.far_apart(x[:500], 48)
        assert len(p) == 48 and len(np.unique(p, axis=0)) == 48
        norms, ids, share = (x * x).sum(axis=1), np.arange(len(x)), []
        for q in range(0, len(x), 100):
            best = []
            for lo in (0, 2000):
                far = op7_topk._distances(x[lo : lo + 2000], p).T.astype(np.float32)
                best, seen = op7_topk.search(x[q], op7_topk._distances(x[q : q + 1], p)[0], q, ids[lo : lo + 2000], x[lo : lo + 2000], norms[lo : lo + 2000], far, 5, best)
                share.append(seen / 2000)
            assert best == sorted(((int(x[q] @ y), i) for i, y in enumerate(x) if i != q), key=lambda b: (-b[0], b[1]))[:5]
        assert np.mean(share) <= most
    assert len(op7_topk.far_apart(np.ones((9, 3)), 4)) == 1 and len(op7_topk.far_apart(np.zeros((0, 3)), 4)) == 0


def test_top_k_of_repeated_rows_in_passes(spark, monkeypatch):
    rows = [(0, [1.0])] * 2 + [(i, [float(i)]) for i in range(1, 6)] + [(3, [3.0]), (50, [2.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit("clash")).withColumn("rank", F.lit(0))
    whole = {i: 256 * int(v[0]) for i, v in rows}
    for size in (op7_topk.PASS_BYTES, 1):
        monkeypatch.setattr(op7_topk, "PASS_BYTES", size)
        got = {}
        for r in op7_topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, k=5).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        for q in (0, 50):
            best = sorted((-whole[q] * whole[i], i) for i, _ in rows if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


# 9


def brute_cuts(data):
    out, at, n = [], 0, len(data)
    h, hashes = 0, []
    for k, b in enumerate(data):
        h = sum(int(op9_fingerprints._GEAR[data[k - j]]) << j for j in range(min(32, k + 1))) & 0xFFFFFFFF
        hashes.append(h)
    while n - at > op9_fingerprints.LEAST:
        end = None
        for k in range(at + op9_fingerprints.LEAST, min(at + op9_fingerprints.GREATEST, n) + 1):
            bits = op9_fingerprints.STRICT if k <= at + op9_fingerprints.USUAL else op9_fingerprints.LOOSE
            if hashes[k - 1] >> (32 - bits) == 0:
                end = k
                break
        end = end or min(at + op9_fingerprints.GREATEST, n)
        out.append(end)
        at = end
    return [*out, n] if at < n else out


def test_chunks_against_brute_force():
    rng = random.Random(9)
    for size in (0, 1, 31, 32, 33, 400, 3000):
        data = bytes(rng.randrange(97, 110) for _ in range(size))
        assert op9_fingerprints.cuts(data) == brute_cuts(data)


def test_chunks_survive_a_shift():
    rng = random.Random(10)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    a, b = op9_fingerprints.chunks(text), op9_fingerprints.chunks("inserted " + text)
    assert op9_fingerprints.containment(a, b) > 0.9 and op9_fingerprints.containment(a, a) == 1.0
    assert op9_fingerprints.containment({}, {}) == 1.0 and op9_fingerprints.containment({}, a) == 0.0 == op9_fingerprints.containment(a, {})


def test_fingerprints(docs, odd, none, monkeypatch):
    monkeypatch.setattr(op9_fingerprints, "PART_BYTES", 60_000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op9_fingerprints.fingerprints(docs.repartition(5)).collect()}
    order = sorted(texts, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        new = op9_fingerprints.edited(texts[i], texts[after])
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own = op9_fingerprints.chunks(texts[i])
        assert got[i].near_edited == op9_fingerprints.containment(own, op9_fingerprints.chunks(new)) and got[i].near_next == op9_fingerprints.containment(own, op9_fingerprints.chunks(texts[after]))
    assert op9_fingerprints.fingerprints(odd).count() == len(ODD) and op9_fingerprints.fingerprints(none).count() == 0
    assert op9_fingerprints.fingerprints(odd.where("doc_id = 5")).first().near_next == 1.0


def test_fingerprints_of_null_ids_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op9_fingerprints, "PART_BYTES", 40_000)
    rng = random.Random(14)
    rows = [(None, f"text {k} " * 900) for k in range(30)] + [(k, f"other {k} " * 700) for k in range(30)] + [(99, "".join(rng.choice("abcdef \n") for _ in range(1_500_000)))]
    got = op9_fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + sorted((r for r in rows if r[0] is None), key=lambda r: hashlib.sha256(r[1].encode()).hexdigest(), reverse=True)
    want = [(i, len(t), hashlib.sha256(op9_fingerprints.edited(t, after).encode()).hexdigest()) for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    with pytest.raises(ValueError):
        op9_fingerprints.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# 10


def test_urls_of_many_labels_and_one_host(spark):
    rules = spark.createDataFrame(catalog.URL_RULES, "host string, path string, verdict string")
    urls = ["http://" + "a." * 20_000 + "net/x", "http://" + "." * 5000 + "/", "http://net./"] + ["http://b.example.com/de/1"] * 500
    got = op10_url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    found = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert len(found) == got.count() == len(urls) and found[0] == ("net/", "block") and found[1] == found[2] == (None, "allow")
    assert all(found[k] == ("example.com/de/", "block") for k in range(3, len(urls)))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.net/x", "HTTP://A.NET", "https://www.example.net/en/1?q", "https://example.net/english", "http://b.example.com/de/", "http://example.com/de#x", "https://x.org/fr/a/b", "http://notnet/", "http://net/", "http://u@example.net:80/en/", "http:///path"]
    rules = spark.createDataFrame(catalog.URL_RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "c"), (None, "http://a.net/x", "c")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op10_url_filter.judge(df, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") == got[None] and got[4] == ("a.net", "", None, "allow")
    assert got[5] == ("www.example.net", "/en/1", "example.net/en/", "allow") and got[6][2:] == ("net/", "block")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == (None, "allow") and got[9][2:] == ("org/fr/", "allow")
    assert got[10][2:] == (None, "allow") and got[11][2:] == ("net/", "block") and got[12][0] == "u@example.net:80" and got[13] == ("", "/path", None, "allow")
    assert op10_url_filter.judge(df, rules).count() == len(urls) + 2 and op10_url_filter.judge(df.where("false"), rules).count() == 0
    assert {r.verdict for r in op10_url_filter.judge(df, rules.where("false")).collect()} == {"allow"}


# the pipeline


def test_stages_on_odd_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF_DIR).columns == odd.columns and stage(spark, none, SF_DIR).count() == 0
    known = corpus_pipeline.language(spark, odd, SF_DIR)
    assert {r.doc_id for r in known.collect()} == {5, 6, 7, None, 8, 9, 10, 11} and known.columns == odd.columns
    once = corpus_pipeline.near_duplicates(spark, odd, SF_DIR)
    assert sorted(r.doc_id for r in once.where("doc_id in (6, 7)").collect()) == [6] and once.where("doc_id is null").count() == 1 and once.count() == len(ODD) - 2
    secret = odd.withColumn("text", F.when(F.col("doc_id") == 5, 'a token = "0641917ea4e9feb9cda83477b57ac2654884f485" b').otherwise(F.col("text")))
    masked = {r.doc_id: r for r in corpus_pipeline.secrets(spark, secret, SF_DIR).collect()}
    assert masked[5].text == 'a [SECRET]" b' and masked[5].n_chars == len(masked[5].text) and masked[11].text == ODD[-1][1] and masked[1].text is None


def test_stages_keep_columns_of_any_name(spark, odd):
    more = {"__text": "a", "__spans": "b", "__gone": "c", "_own_0": "d", "_spread": "e", "mark": "f", "node": "g", "kept": "h", "key": "i", "label": "j"}
    clash = odd.select("*", *[F.lit(v).alias(k) for k, v in more.items()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, clash, SF_DIR), stage(spark, odd, SF_DIR)
        assert got.columns == clash.columns and got.where(" and ".join(f"{k} = '{v}'" for k, v in more.items())).count() == plain.count()
    packed = corpus_pipeline.packing(spark, clash, SF_DIR)
    assert packed.select("doc_id").distinct().count() == 12 and packed.where("piece = 0").count() == len(ODD) and corpus_pipeline.packing(spark, clash.where("false"), SF_DIR).count() == 0


def test_hubs_and_chains(spark):
    hub = [(b"\x00", bytes([1, k % 256, k // 256])) for k in range(700)]
    chain = [(bytes([2, k]), bytes([2, k + 1])) for k in range(90)]
    got = {bytes(r.node): bytes(r.label) for r in op5_minhash.components(spark.createDataFrame(hub + chain, "a binary, b binary").repartition(5)).collect()}
    assert got == {b"\x00": b"\x00"} | {b: b"\x00" for _, b in hub} | {bytes([2, k]): bytes([2, 0]) for k in range(91)}


def test_unlabelled_corpus_stays(spark, odd):
    blank = corpus_pipeline.language(spark, odd.withColumn("lang", F.lit(None).cast("string")), SF_DIR)
    known = corpus_pipeline.language(spark, odd, SF_DIR)
    assert sorted(map(str, blank.collect())) == sorted(str(r).replace("lang='clash'", "lang=None") for r in known.collect()) and blank.count() == 9


def test_repeated_ids_lose_only_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:-1], "end"]), " ".join(f"v{i}" for i in range(40))
    rows = [(1, " ".join(base)), (2, near), (2, other), (3, "q " * 30 + "one"), (3, "q " * 30 + "One"), (4, other + " more"), (5, " ".join(f"u{i}" for i in range(30))), (5, " ".join(f"t{i}" for i in range(30)))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR)
    left = [tuple(r) for r in got.collect()]
    assert got.columns == ["doc_id", "text"] and sorted(r for r in left if r[0] != 3) == sorted([rows[0], rows[2], rows[6], rows[7]]) and sum(r[0] == 3 for r in left) == 1


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r.doc_id for r in op5_minhash.near_duplicates(docs, 5, 80).where("kept").collect()}
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == kept
    storage.release(spark)
