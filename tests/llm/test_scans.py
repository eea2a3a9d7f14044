"""Operators 11 to 13 against plain versions: periodic runs, license scans, importance resampling. Odd rows as in test_operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skarn.llm import common, importance, licenses, periodic, queries

LONG = "lorem ipsum  dolor\n" * 9000 + "x" * 3000
TEXTS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, LONG), (5, "a b c d " * 9), (5, "a b c d " * 9), (None, "no id no id no id no id no id no id no id"), (7, "é中😀 don't\t\n\x00 \r\n<|endoftext|></s>"), (8, " \x0b "), (9, "a" * 5000)]
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with columns named like the operators' own."""
    rows = [(i, t, [], 1, "k", 2.0, {"a": 1}) for i, t in TEXTS]
    return common.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, __g int, score string, weight double, `a.b` map<string, int>").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(common.prepare(spark), sf_dir, "documents")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def plain_runs(w, least=12):
    """All lags, all stretches, smallest period by trying every one."""
    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
    v, out = np.asarray([number[x] for x in w], "i8"), []
    for q in range(1, len(w) // 2 + 1):
        same = np.r_[False, v[:-q] == v[q:], False]
        for begin, end in zip(np.flatnonzero(~same[:-1] & same[1:]).tolist(), np.flatnonzero(same[:-1] & ~same[1:]).tolist()):
            s = v[begin : end + q]
            if len(s) >= max(least, 2 * q) and not any((s[d:] == s[:-d]).all() for d in range(1, q)):
                out.append((begin, len(s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run_digests(doc_id, text):
    w = planted(doc_id, text)
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    most = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    tail = (most[0], most[1], most[2], 1000 * most[1] // most[2]) if most else (None,) * 4
    return (doc_id, len(found), *tail, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUN_COLS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_against_all_lags(monkeypatch):
    rng = random.Random(5)
    for chunk in (40, 1 << 16):
        monkeypatch.setattr(periodic, "PAIRS", chunk)
        for _ in range(50):
            texts = []
            for _ in range(rng.randint(1, 6)):
                n, kinds = rng.randint(0, 120), rng.choice([1, 2, 3, 5, 30])
                w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
                for _ in range(rng.randint(0, 3) if n > 5 else 0):
                    s, p = rng.randrange(n), rng.randint(1, 20)
                    for i in range(s, min(n, s + rng.randint(1, 80))):
                        w[i] = w[s + (i - s) % p]
                texts.append(w)
            for least in (12, 3, 25):
                assert [list(map(tuple, r.tolist())) for r in periodic.runs_of(texts, least)] == [plain_runs(w, least) for w in texts]


def test_levels_sample_a_seed_of_every_guaranteed_stretch():
    for least in (1, 5, 12, 40):
        found = list(periodic.levels(5000, least))
        assert [q for low, high, _, _ in found for q in range(low, high + 1)][:2500] == list(range(1, 2501))
        for low, high, k, step in found:
            assert all(max(least - q, q) >= k + step - 1 for q in range(low, high + 1))
        assert [k for _, _, k, _ in found] == sorted(k for _, _, k, _ in found)


def test_one_word_a_hundred_thousand_times_costs_few_pairs(monkeypatch):
    pairs, seeds = [], periodic._seeds
    monkeypatch.setattr(periodic, "_seeds", lambda *a: (pairs.append(len(x[0])) or x for x in seeds(*a)))
    assert periodic.runs_of([[b"a"] * 100_000])[0].tolist() == [[0, 100_000, 1]]
    assert sum(pairs) <= 100_000 * 2 * 15 and max(pairs) <= periodic.PAIRS
    assert periodic.runs_of([[b"a", b"b"] * 30_000, [b"a"] * 5])[0].tolist() == [[0, 60_000, 2]]


def test_run_query_on_all_texts_and_odd_rows(spark, sf_dir, docs, odd, empty):
    want = sorted((run_digests(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted(map(tuple, queries.op11_periodic_runs(spark, sf_dir).select(*RUN_COLS).collect()), key=str) == want
    got = rows(periodic.digests(periodic.find_runs(odd)), *RUN_COLS)
    assert len(got) == len(TEXTS)
    by = {r[0]: r for r in got}
    assert by[4][1:5] == (1, 0, 27000, 3) and by[5][1:5] == (1, 0, 36, 4) and by[None][1:5] == (1, 0, 14, 2)
    assert by[2] == by[2][:1] + (0, None, None, None, None, sha(""), sha("")) and by[8][7] == sha("") and by[9][7] == sha("a" * 5000)
    assert len([r for r in got if r[0] == 5]) == 2
    assert periodic.digests(periodic.find_runs(empty)).collect() == [] and periodic.with_tails(empty).collect() == []
    assert rows(periodic.with_tails(odd), "doc_id", "text") and {(r.doc_id, tuple((r.text or "").split())) for r in periodic.with_tails(odd).collect()} == {(i, tuple(" ".join(planted(i, t)).split())) for i, t in TEXTS}


def plain_scan(text, weights, templates=licenses.TEMPLATES):
    """Every template at every relative position."""
    w = [x.decode() for x in WORD.findall((text or "").encode().translate(LOWER))]
    out = []
    for label, base, t, phrases in templates:
        t = t.split()
        total = sum(weights[x] for x in t)
        for p in range(-len(t) + 1, len(w)):
            agree = [0 <= p + i < len(w) and w[p + i] == x for i, x in enumerate(t)]
            own = sum(weights[x] for x, a in zip(t, agree) if a)
            if own >= licenses.SHARE * total and all(agree[i] for i in licenses.mandatory(t, phrases)):
                out.append((label, base, p, len(t), own / total))
    return len(w), out


def noticed():
    """Texts with notices, some with words changed, cut or at the very ends."""
    rng, out = random.Random(8), []
    for i in range(400):
        w = [rng.choice(["the", "license", "of", "cc", "by", "mit", "software", "foo", "under", "nc", "version", "é"]) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(licenses.TEMPLATES)[2].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                t[rng.randrange(len(t))] = rng.choice(["x", "the", t[0]])
            at = rng.choice([0, len(w), rng.randint(0, len(w))])
            w[at:at] = t[rng.choice([0, 0, 1]) :]
        out.append((i, rng.choice([" ", "-", ", "]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    return out


def test_license_scan_against_every_position(spark, odd, empty):
    made = spark.createDataFrame([*noticed(), *TEXTS], "doc_id long, text string")
    weights = licenses.word_weights(made)
    sets = [set(WORD.findall((t or "").encode().translate(LOWER))) for _, t in [*noticed(), *TEXTS]]
    assert all(weights[w] == math.floor(1000 * (1 + math.log((len(sets) + 1) / (sum(w.encode() in s for s in sets) + 1))) + 0.5) for w in weights)
    got = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.places))) for r in licenses.scan(made, weights).collect()), key=str)
    want = sorted(((i, n, tuple(p)) for i, t in [*noticed(), *TEXTS] for n, p in [plain_scan(t, weights)]), key=str)
    assert got == want and sum(len(p) for _, _, p in got) > 250
    assert {p[0] for _, _, ps in got for p in ps} == {t[0] for t in licenses.TEMPLATES}
    assert len(rows(licenses.digests(licenses.scan(odd)), "doc_id", "n_words", "score")) == len(TEXTS)
    assert licenses.digests(licenses.scan(empty)).collect() == []


def test_license_digests_and_repeated_phrases(spark):
    text = "Under the MIT-License! " * 3000 + "cc by nc, cc-by-NC 4.0"
    made = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "Apache License, Version 2.0")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digests(licenses.scan(made)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (3002, 0, 12003, "cc-by-nc,mit", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].base_labels, got[2].labels, got[2].score) == (0, None, "", "", 0.0)
    assert (got[3].n_words, got[3].n_base, got[3].labels) == (5, 1, "apache-2")


def plain_features(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return w, [zlib.crc32(x) % 10000 for x in w] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(w, w[1:])]


def plain_resample(texts, target, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, x in texts:
        s.update(plain_features(x)[1])
    for x in target:
        t.update(plain_features(x)[1])
    a, b = sum(s.values()), sum(t.values())
    out = []
    for i, x in texts:
        w, f = plain_features(x)
        g = sum(math.floor(1000 * math.log((t[k] + 1) * (a + 10000) / ((s[k] + 1) * (b + 10000)))) for k in f)
        weight = g // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    take = len(able) * percent // 100
    nth = {id(r): n + 1 for n, r in enumerate(able[:take])}
    return [(*r[:4], nth.get(id(r))) for r in out]


def test_features_equal_single_texts():
    texts = [(t or "").encode() for _, t in TEXTS] + [b"x" * 700 + b" y " + b"z" * 300, b"One-two THREE"]
    bucket, of, n = importance.featurize(texts, 2, 10000, importance._Words(), importance.Combine())
    for i, t in enumerate(texts):
        w, f = plain_features(t.decode())
        assert sorted(bucket[of == i].tolist()) == sorted(f) and n[i] == len(w)
    bucket, of, _ = importance.featurize([b"a bb ccc", b"d", b"", b"e f"], 3, 1 << 31, importance._Words(), importance.Combine())
    grams = [b"a", b"bb", b"ccc", b"d", b"e", b"f", b"a bb", b"bb ccc", b"e f", b"a bb ccc"]
    assert sorted(bucket.tolist()) == sorted(zlib.crc32(g) % (1 << 31) for g in grams)


def test_resampling_against_a_plain_version(spark, sf_dir, docs, odd, empty):
    cols = ("doc_id", "n_features", "weight", "score", "rank")
    target = common.table(spark, sf_dir, "benchmark")
    goal = [r.text for r in target.collect()]
    assert rows(queries.op13_importance_resampling(spark, sf_dir), *cols) == sorted(plain_resample([(r.doc_id, r.text) for r in docs.collect()], goal), key=lambda r: tuple((x is not None, str(x)) for x in r))
    got = rows(importance.resample(odd, target, percent=50, least_words=5), *cols)
    assert sorted(got, key=str) == sorted(plain_resample(TEXTS, goal, 50, 5), key=str)
    assert importance.resample(empty, target).collect() == []
    assert all(r.rank is None for r in importance.resample(odd, empty, percent=0).collect())


def test_noise_is_gumbels():
    x = np.asarray([importance.noise(i, 7) for i in range(20_000)]) / 1000
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - math.pi**2 / 6) < 0.1


def test_a_vocabulary_too_large_for_its_pair_numbers_is_refused(tmp_path):
    import base64

    from skarn.llm import bpe

    path = tmp_path / "large.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)) + base64.b64encode(b"ab") + b" 131072\n")
    with pytest.raises(ValueError, match="131072"):
        bpe.Bpe(str(path))
