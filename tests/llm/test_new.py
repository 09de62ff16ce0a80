"""Vector codes, importance resampling and BPE with shared chunks, against brute force and on edge rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from plain import LETTERS, lower
from tokenizers import Tokenizer

from holdfast.llm import chunk_bpe, importance, vector_codes
from holdfast.llm import queries as registered

SF = "/root/testdata/sf0.001"


# Vector codes


def _codes_by_hand(rows, parts=4, k=256, rounds=4):
    """Every round compares every part with every entry, in plain whole numbers."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])),
                  key=lambda r: (r[0] is None, r[0] or 0, np.array([math.floor(1024 * x) for x in r[1]], "<i4").tobytes()))
    vecs = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    width = len(vecs[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in vecs]
    books = [[c[p] for c in cut[:k]] for p in range(parts)]

    def best(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for turn in range(rounds + 1):
        found = [[best(c[p], p) for p in range(parts)] for c in cut]
        for p in range(parts) if turn < rounds else ():
            for i in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == i]
                if own:
                    books[p][i] = tuple(sum(x) // len(own) for x in zip(*own))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, error)]


def _coded(frame, **options):
    books, coded = vector_codes.fit(frame, **options)
    return [(r.vec_id, r.code.hex(), r.error, r.label_error, books.digest()) for r in vector_codes.with_label_error(coded).collect()]


def test_codes_against_full_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-3, 4, 8) / 4).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(700)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    for k in (256, 9):
        assert sorted(_coded(frame, entries=k)) == sorted(_codes_by_hand(rows, k=k))


def test_active_entries_give_what_all_entries_give():
    rng = np.random.default_rng(7)
    for scale in (3, 3_000_000):  # small numbers tie, large ones leave double precision
        parts = rng.integers(-scale, scale + 1, (400, 3))
        entries = rng.integers(-scale, scale + 1, (40, 3))
        code, far = vector_codes.nearest(parts, entries)
        assert all(far == ((parts - entries[code]) ** 2).sum(1))
        for _ in range(6):
            moved = rng.random(40) < 0.3
            entries[moved] += rng.integers(-1, 2, (int(moved.sum()), 3))
            code, far = vector_codes.reassign(parts, entries, moved, code, far)
            want = vector_codes.nearest(parts, entries)
            assert (code == want[0]).all() and (far == want[1]).all()


def test_codes_on_edge_rows(spark):
    rows = [(1, [0.5, -0.5, 1.0, 2.0], 1, "x"), (1, [0.5, -0.5, 1.0, 2.0], 1, "x"), (2, None, 1, "x"), (3, [], 1, "x"),
            (4, [1.0, None, 0.0, 0.0], 1, "x"), (5, [float("nan"), 0.0, 0.0, 0.0], 1, "x"), (6, [float("inf")] * 4, 1, "x"),
            (None, [9.0, 9.0, 9.0, 9.0], None, "x"), (7, [0.0, 0.0, 0.0, -0.001], None, "x"), (8, [1.0] * 8, 2, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = _coded(frame)
    assert sorted(got, key=repr) == sorted(_codes_by_hand([r[:3] for r in rows if r[0] != 8]), key=repr)
    books, coded = vector_codes.fit(frame)
    back = {r.vec_id: r.restored for r in vector_codes.decode(coded, books).collect()}
    assert back[7] == [0.0, 0.0, 0.0, -2 / 1024] and books.entries.shape == (4, 4, 1)
    empty, none = vector_codes.fit(frame.limit(0))
    assert none.count() == 0 and empty.entries.size == 0 and vector_codes.with_label_error(none).columns[-1] == "label_error"
    with pytest.raises(ValueError):
        vector_codes.fit(frame.where("vec_id = 1"), parts=3)


# Importance resampling


def _grams(text):
    words = LETTERS.findall(lower(text))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def _resampled_by_hand(docs, items):
    """(doc_id, n_features, weight, score) of every row, and the drawn (score, doc_id) in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    source, target = Counter(), Counter()
    for counts, texts in ((source, docs), (target, items)):
        for _, text in texts:
            counts.update(map(bucket, _grams(text)[0]))
    s, t = sum(source.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000))))
    out, able = [], []
    for doc, text in docs:
        features, n = _grams(text)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(features), weight, score))
        if n >= 20:
            able.append((-score, doc is None, doc, len(features)))
    return out, sorted(able)[: 25 * len(able) // 100]


def _check_draw(got, docs, items):
    rows, drawn = _resampled_by_hand(docs, items)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:4]) for r in got), key=key) == sorted(rows, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"], r["n_features"]) for r in ranked] == drawn


def test_op12(spark):
    tables = [[tuple(r) for r in spark.read.parquet(f"{SF}/{n}.parquet").select(i, "text").collect()]
              for n, i in (("documents", "doc_id"), ("benchmark", "item_id"))]
    _check_draw(registered.op12_importance(spark, SF).collect(), *tables)


def test_resampling_on_edge_rows(spark):
    rng = random.Random(8)
    words = ["Alpha", "beta", "é", "9x", "x" * 70, "漢字"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)] + [(None, text(30)) for _ in range(6)]
    docs += [(5, docs[5][1])] * 3 + [(200, None), (201, ""), (202, " .,; "), (203, text(40_000)), (7, text(25))]
    same = text(50)
    docs += [(300, same)] * 60  # a group of equal rows that the cut may fall into
    items = [(1, "alpha beta alpha"), (2, None), (3, "")]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, rank string, score string").repartition(4)
    target = spark.createDataFrame(items, "item_id long, text string")
    _check_draw(importance.resample(frame, target).collect(), docs, items)
    assert importance.resample(frame.limit(0), target).count() == 0
    assert {r["rank"] for r in importance.resample(frame.where("doc_id = 201"), target.limit(0)).collect()} == {None}


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    scores = spark.range(20_000).selectExpr("CAST(pow(id % 5000, 2) AS LONG) AS score")
    values = sorted((r[0] for r in scores.collect()), reverse=True)
    for k in (1, 137, 9_999, 20_000):
        for accuracy in (10, 10_000):  # a sketch this coarse misses its quantiles
            low, high, above = importance.bracket(scores, 20_000, k, accuracy, margin=1e-6)
            assert low <= values[k - 1] <= high and above == sum(v > high for v in values) < k


# BPE with shared chunks


@pytest.fixture(scope="module")
def tokenizer(spark):
    path = public_tokenizers.path(registered.TOKENIZER)
    return Tokenizer.from_file(path), chunk_bpe.read_tokenizer(spark, path)


def _odd_texts(seed=9):
    rng = random.Random(seed)
    alphabet = " \n\tab'sé1. \x1c!漢\0re't"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 700))) for _ in range(300)]
    out += ["a" * 5000, " " * 5000 + "x", "ab" * 9000, "漢字テ" * 3000, "x <|endoftext|> y<|endoftext|>", "<|endoftext|>", "it's 'd",
            "\u0085 a b ١٢٣ Ⅷ ² _x'RE 's", "".join(rng.choice("etaoinsh") for _ in range(20_000)), "<|endoftext" * 200]
    return out


def test_joins_agree_with_the_library(tokenizer, monkeypatch):
    library, source = tokenizer
    m = chunk_bpe.Model(source, public_tokenizers.PATTERN)
    texts = _odd_texts()
    raws = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for bits, least in ((chunk_bpe.CUT_BITS, chunk_bpe.LEAST), (3, 4)):
        monkeypatch.setattr(chunk_bpe, "CUT_BITS", bits)
        monkeypatch.setattr(chunk_bpe, "LEAST", least)
        part = chunk_bpe.Slice(b"".join(raws), at, m.special)
        ready = {}
        for bad in (False, True):  # with chunks from elsewhere, some of them of other bytes
            got = chunk_bpe.encode_slice(m, part, ready)
            assert [g.tolist() for g in got] == want
            chunks = list(dict.fromkeys(c for _, c in part.chunks()))
            codes = m.chunks(chunks)
            keys = [chunk_bpe.digest(c) for c in chunks]
            ready = {k: (i.astype(m.kind).tobytes(), n.astype("<u4").tobytes()) for k, (i, n) in zip(keys, codes)}
            ready[keys[0]] = ready[keys[-1]]
    assert [m.decode(np.array(w, np.int64)).tobytes().decode() for w in want] == texts


def test_cuts_follow_the_content(tokenizer):
    passage = " ".join(f"word{i * i}" for i in range(3000))
    begins = []
    for before in ("", "some other words first. " * 7):
        raw = (before + passage).encode()
        part = chunk_bpe.Slice(raw, np.array([0, len(raw)]), {})
        begins.append({c for _, c in part.chunks()})
    assert len(begins[0] & begins[1]) >= 0.8 * len(begins[0]) > 5


def test_shared_chunks_over_slices(spark, tokenizer):
    library, source = tokenizer
    rng = random.Random(10)
    passages = [" ".join(rng.choice(["one", "two's", "drei", "été", "x<|endoftext|>y"]) + str(rng.randrange(99)) for _ in range(900)) for _ in range(5)]
    rows = [(i, f"start {i}\n" + "\n".join(rng.sample(passages, 2)) + f" end{i}") for i in range(60)]
    rows += [(None, passages[0]), (None, None), (70, None), (71, ""), (3, rows[3][1]), (72, passages[1] * 40)]
    rows += [(80, passages[2])] * 5
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(6)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in
                  chunk_bpe.token_digests(frame, source, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    tokens = chunk_bpe.encode(frame, source, public_tokenizers.PATTERN)
    texts = chunk_bpe.decode(tokens, source, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, r.decoded) for r in texts if r.doc_id) == sorted((d, t or "") for d, t in rows if d)
    assert chunk_bpe.encode(frame.limit(0), source, public_tokenizers.PATTERN).count() == 0
    cut = spark.createDataFrame([(1, b"\xff\x00"[:0]), (2, None)], "doc_id long, ids binary")
    assert [r.decoded for r in chunk_bpe.decode(cut, source, public_tokenizers.PATTERN).collect()] == ["", ""]


def test_op13(spark, tokenizer):
    library, _ = tokenizer
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registered.op13_chunk_bpe(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for doc, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_tokenizers_are_refused(tokenizer):
    with pytest.raises(ValueError):
        chunk_bpe.Model(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), public_tokenizers.PATTERN)


def test_op13_looks_up_few_pairs_and_writes_ids_at_once(tokenizer, monkeypatch):
    """A round of merges looks up the two pairs that it changed, and ids and bytes are written without an object each."""
    library, source = tokenizer
    m = chunk_bpe.Model(source, public_tokenizers.PATTERN)
    words = ["".join(p) for p in itertools.product("etaoin", repeat=5)]
    asked, ranks = [], m._ranks
    monkeypatch.setattr(m, "_ranks", lambda *pairs: (asked.append(pairs[0].size), ranks(*pairs))[1])
    m.learn(set(words))
    want = {w: e.ids for w, e in zip(words, library.encode_batch(words, add_special_tokens=False))}
    assert {w: np.frombuffer(m.known[w], "<u4").tolist() for w in words} == want
    assert sum(asked) <= 2 * sum(5 - len(ids) for ids in want.values())
    ids = np.concatenate([np.array(x, "<u4") for x in want.values()])
    assert bytes(m.written(ids)) == ",".join(map(str, ids.tolist())).encode()
    assert bytes(m.decode(ids)) == "".join(words).encode()
    assert bytes(m.written(ids[:0])) == bytes(m.decode(ids[:0])) == b""
