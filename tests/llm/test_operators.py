"""The ten operators: brute force, round trips, held-out accuracy, and odd rows (nulls, empty and long texts, repeats, empty tables, clashing columns)."""

import base64
import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import Writer, classes, jaccard, predict, simhash
from pyspark.sql import functions as F

from skarn.llm import bpe, chat, common, hnsw, packing, quality, simhash as sh, token_counts, token_output, toxicity, webp, word_ids

JSON, RANKS, PIECES = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
LONG = "lorem ipsum  dolor\n" * 9000 + "x" * 3000
TEXTS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, LONG), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (None, "no id"), (7, "é中😀 don't\t\n  '' \r\n<|endoftext|></s>"), (8, "   "), (9, "a" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with columns named like the operators' own."""
    rows = [(i, t, "x", 1, 2, "k", 0) for i, t in TEXTS]
    return common.prepare(spark) and spark.createDataFrame(rows, "doc_id long, text string, ids string, part int, length int, fp string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(common.prepare(spark), sf_dir, "documents").select("doc_id", "text")


def ids_of(text, end):
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault("t", Tokenizer.from_file(JSON))
    return np.asarray([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def key(r):
    return tuple((x is not None, x) for x in r)


def test_token_files_hold_the_librarys_ids(spark, odd, empty, docs, tmp_path):
    for n, (df, encoding) in enumerate(((odd, "delta"), (docs, "dictionary"))):
        path = f"file://{tmp_path}/{n}"
        token_output.write_tokens(df, path, JSON, 2, encoding=encoding, page_rows=10)
        got = token_output.with_checksum(token_output.read_tokens(spark, path)).orderBy("start").collect()
        want, start = [], 0
        for r in sorted(df.select("doc_id", "text").collect(), key=key):
            ids = ids_of(r["text"], 2)
            want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert list(map(tuple, got)) == want
        assert token_output.read_metadata(spark, path).count() == len(want)
    path = f"file://{tmp_path}/none"
    token_output.write_tokens(empty, path, JSON, 2)
    assert token_output.with_checksum(token_output.read_tokens(spark, path)).count() == 0


def test_token_files_have_indexes_and_the_chosen_encoding(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    for encoding, mark in (("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")):
        token_output.write_tokens(docs, f"file://{tmp_path}/{encoding}", JSON, 2, encoding=encoding)
        m = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/{encoding}/part-*"))[0]).metadata.row_group(0)
        column = next(m.column(i) for i in range(m.num_columns) if m.column(i).path_in_schema.startswith("ids"))
        assert any(mark in e for e in column.encodings) and column.has_column_index and column.has_offset_index


def test_word_encoder_is_the_library(monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    library, e, rng = Tokenizer.from_file(JSON), word_ids.TextEncoder(JSON), random.Random(1)
    signs = ["a", "bc", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "'s", "don't", "!!", "$$$", "é", "中", "😀", "\x01", "\xa0", "\u2003", "<|endoftext|>", "12", "Ġ", "\x1c", "\u200b", "x" * 120, " a", " b.", "\nc!\n"]
    for bound in (word_ids.REMEMBERED, 400):  # also where it forgets all the time
        monkeypatch.setattr(word_ids, "REMEMBERED", bound)
        for size in (4, 10, 40, 2000):
            texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, size))) for _ in range(200 if size < 2000 else 5)] + [None, "", " ", "\n", "\x01", "\x01\n", "a \x01"]
            ids, n = e.many(pa.array(texts))
            ends = n.cumsum()
            for t, a, b in zip(texts, ends - n, ends, strict=True):
                assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_word_encoder_remembers_few_bytes():
    import pyarrow as pa

    rng, e = np.random.default_rng(0), word_ids.TextEncoder(JSON)
    for _ in range(4):  # texts without blanks, and many short words
        e.many(pa.array(["".join(map(chr, rng.integers(0x4E00, 0x9000, 20_000))) for _ in range(10)] + [" ".join(map(str, rng.integers(0, 1 << 40, 50_000)))]))
        assert e.words.nbytes + e.flat.nbytes + e.size.nbytes <= word_ids.REMEMBERED and max(map(len, e.words.to_pylist())) <= word_ids.LONG


def test_filters_read_few_pages_and_hot_ids_are_dealt(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    token_output.write_tokens(df, f"file://{tmp_path}/a", JSON, 2, page_rows=100, parts=2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for cols in (["doc_id", "n_tokens"], ["doc_id", "ids"]):
            q = spark.read.parquet(f"file://{tmp_path}/a").where("doc_id = 1234").select(*cols)
            assert q.count() == 1 and len(q.collect()) == 1
            scan = q._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
            assert scan.metrics().apply("numOutputRows").value() <= 300  # of 4,000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for hot in (5, None):
        rows = [(hot, f"hot {i % 7}") for i in range(300)] + [(i, str(i)) for i in range(100)]
        token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/{hot}", JSON, 2, parts=8)
        got = token_output.read_tokens(spark, f"file://{tmp_path}/{hot}").orderBy("start").collect()
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert ids == sorted(ids) and len(ids) == 400 and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
        files = spark.read.parquet(f"file://{tmp_path}/{hot}").where(F.col("doc_id").eqNullSafe(hot)).groupBy("part").count().collect()
        assert len(files) > 4 and max(r["count"] for r in files) < 100


def test_counts_are_the_librarys(spark, odd, empty, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (odd, docs):
        got = token_counts.count_tokens(df, PIECES, limit=40, chunk_chars=500, overlap=4)
        want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 40) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(empty, PIECES, limit=1).count() == 0


def test_literal_word_marks_count_as_the_library_has_them(spark):
    c = token_counts.PieceCounter(PIECES)
    rng = np.random.default_rng(1)
    texts = ["▁", "b▁ ", "▁ ▁", "▁ 的", "a ▁b▁ c▁▁", " ▁"] + ["".join(rng.choice(list("ab的e\n ▁"), rng.integers(1, 15))) for _ in range(2000)]
    long = ["".join(rng.choice(list("abcde的\n ▁"), 3000)) for _ in range(20)]
    for t in texts:
        assert c.count(t) == len(c.model.encode(t)), repr(t)
    for t in long:
        assert token_counts.count_by_chunks(c, t, 200, 2) == len(c.model.encode(t))
    df = spark.createDataFrame(list(enumerate(texts[:50] + long)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, PIECES, limit=10, chunk_chars=500, overlap=4).collect()}
    for i, t in enumerate(texts[:50] + long):
        n = len(c.model.encode(t))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 10)


def test_overlaps_widen_until_chunks_align(monkeypatch):
    c = token_counts.PieceCounter(PIECES)
    assert c.plain and c.stable
    rng = np.random.default_rng(0)
    for _ in range(40):
        t = "".join(rng.choice(list("ab c  \n.é▁龘"), 300, p=[0.25, 0.25, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]))
        for chunk, overlap in ((20, 2), (7, 1), (299, 1), (100, 30)):
            assert token_counts.count_by_chunks(c, t, chunk, overlap) == c.count(t) == len(c.model.encode(t))
    asked = []
    right = c.starts
    monkeypatch.setattr(c, "starts", lambda t: asked.append(len(t)) or right(t))
    t = "word " * 20 + "e" * 300 + " word" * 20  # one overlap falls into a stretch without boundaries
    assert token_counts.count_by_chunks(c, t, 200, 8) == len(c.model.encode(t))
    assert max(asked) > 208  # it was widened
    asked.clear()
    t = "word and more " * 500
    assert token_counts.count_by_chunks(c, t, 200, 20) == len(c.model.encode(t)) and max(asked) == 220  # it never was


def test_stable_boundaries_hold_without_blanks():
    """Texts in which no blank helps: boundaries are proven by the vocabulary alone."""
    c = token_counts.PieceCounter(PIECES)
    rng = np.random.default_rng(3)
    for signs in ("的一是不了人我在有他这为之大来", "あいうえお。、漢字かな", "xyzqjk0123", "=+/AbC9"):
        t = "".join(rng.choice(list(signs), 3000))
        assert token_counts.count_by_chunks(c, t, 100, 4) == len(c.model.encode(t))
        ends = set(c.starts(t).tolist())
        assert all(p in ends for p in range(1, len(t)) if c.cuts(t, p))


def test_word_counts_remember_few_bytes():
    rng, c = np.random.default_rng(0), token_counts.PieceCounter(PIECES)
    c.count(" ".join(["".join(map(chr, rng.integers(0x4E00, 0x9000, 5000))) for _ in range(40)]))
    assert not c.words and not c.words.old
    c.count("short words are kept")
    assert len(c.words) == 4 and c.words.size < 1000


def packed_right(rows, texts, capacity):
    lengths = {}
    for r in rows:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in lengths.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc, text in texts:
        ids = ids_of(text, 0)
        cut = (len(ids) - 1) % capacity + 1
        at = [0, *range(cut, len(ids) + 1, capacity)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    return len(lengths), sum(r["length"] for r in rows)


def test_packing(spark, odd, empty, docs):
    n, total = packed_right(packing.pack_documents(odd, JSON, 0, 2048).collect(), TEXTS, 2048)
    n, total = packed_right(packing.pack_documents(docs, JSON, 0, 2048).collect(), [tuple(r) for r in docs.collect()], 2048)
    assert n <= -(-total // 2048) * 1.05 + 1
    assert packing.pack_documents(empty, JSON).count() == 0


def test_plan_equals_best_fit_decreasing_piece_by_piece():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 33), 12, False), rng.integers(1, 30, 12), strict=True)}
        plan = packing.plan_slots(counts, 32)
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [r for r in rooms if r >= length]
                if fit:
                    rooms.remove(min(fit))
                rooms.append((min(fit) if fit else 32) - length)
        used = {}
        for length, _, n, each, first, offset in plan.tolist():
            for s in range(first, first + n):
                used.setdefault(s, []).append((offset, each * length))
        assert len(used) == len(rooms)
        for parts in used.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= 32
        assert {k: sum(n * e for q, _, n, e, _, _ in plan.tolist() if q == k) for k in counts} == counts


def test_severity_on_held_out_rows(spark, docs, sf_dir, odd, empty):
    labels = common.table(spark, sf_dir, "labels")
    fit_on = labels.where("doc_id % 3 <> 0")
    model = toxicity.train(docs, fit_on)
    assert np.all(np.diff(model["t"]) > 0)
    p = toxicity.severity(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("severity", labels["toxic"], F.col("grade")).collect()
    assert all(0 <= r["severity"] <= 3 for r in p)
    clean = [r["severity"] for r in p if not r["toxic"]]
    assert np.mean(np.asarray(clean) < 1) > 0.9
    got = toxicity.severity(odd, model)
    assert got.count() == len(TEXTS) and got.where("severity is null").count() == 0
    assert toxicity.severity(empty, model).count() == 0
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.severity(docs, none).where("toxic = 1").count() == 0
    assert toxicity.harmless(odd, model).columns == odd.columns


def plain_severity(text, model):
    """Severity and chances by the formulas alone: 1 + log(count) of each known feature, a logistic link per threshold."""
    import re

    counts = {}
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for f in [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) > n]:
            j = model["columns"].get(zlib.crc32(f.encode()) % toxicity.WIDTH)
            if j is not None:
                counts[j] = counts.get(j, 0) + 1
    z = sum(model["w"][j] * (1 + np.log(n)) for j, n in counts.items())
    over = [1 / (1 + np.exp(-(z - t))) for t in model["t"]]
    each = [a - b for a, b in zip([1, *over], [*over, 0], strict=True)]
    return sum(over), int(np.argmax(each)), over[0], int(over[0] >= toxicity.TOXIC)


def test_severity_against_a_plain_scorer_and_held_out_recall(spark, odd):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(common.prepare(spark), d, "documents"), common.table(spark, d, "labels")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 1"))
    for df in (docs, odd):
        got = sorted((tuple(r) for r in toxicity.severity(df, model).collect()), key=key)
        want = sorted(((r["doc_id"], *plain_severity(r["text"], model)) for r in df.select("doc_id", "text").collect()), key=key)
        assert all(a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-9) for a, b in zip(got, want, strict=True))
    found = {r["doc_id"]: r["toxic"] for r in toxicity.severity(docs, model).collect()}
    held = [(r["toxic"], found[r["doc_id"]]) for r in labels.where("doc_id % 2 = 0 and toxic is not null").collect() if r["doc_id"] in found]
    assert np.mean([f for t, f in held if t]) >= 0.6 and np.mean([f for t, f in held if not t]) <= 0.05


def test_the_fit_is_a_minimum_of_the_cumulative_link_loss():
    """The plain loss (a logistic loss per threshold, weights shared) has no lower neighbour, and separates grades by one weight vector."""
    rng = np.random.default_rng(2)
    rows = []
    for g in rng.integers(0, 4, 400).tolist():
        x = {10 + int(k): 1 for k in rng.integers(0, 5, 2)}
        if g:
            x |= {1: g, 2: 1}
        rows.append((x, g, int(g > 0)))
    m = toxicity.fit(rows, steps=4000)
    n1 = sum(t for _, _, t in rows)
    share = n1 / len(rows)

    def loss(w, thresholds):
        total = 0.0
        for x, g, t in rows:
            z = sum(w[m["columns"][k]] * (1 + np.log(n)) for k, n in x.items() if k in m["columns"])
            for k, th in enumerate(thresholds):
                s = z - th if g > k else th - z
                total += (share / n1 if t else (1 - share) / (len(rows) - n1)) * np.logaddexp(0, -s)
        return total + 1e-6 * (w @ w)

    best = loss(m["w"], m["t"])
    assert len(m["columns"]) and best < loss(0 * m["w"], m["t"])
    for k in range(len(m["w"])):
        for step in (-0.3, 0.3):
            assert loss(m["w"] + step * (np.arange(len(m["w"])) == k), m["t"]) >= best - 1e-4
    for k in range(3):
        for step in (-0.3, 0.3):
            assert loss(m["w"], m["t"] + step * (np.arange(3) == k)) >= best - 1e-4


def test_ordered_grades_are_learned():
    rng = np.random.default_rng(0)
    rows = [({1: 1 + g, 2 + int(rng.integers(3)): 1} if g else {2 + int(rng.integers(3)): 1}, g, int(g > 0)) for g in rng.integers(0, 4, 600).tolist()]
    m = toxicity.fit(rows)
    over = lambda x: 1 / (1 + np.exp(-(sum(m["w"][m["columns"][k]] * (1 + np.log(n)) for k, n in x.items() if k in m["columns"]) - m["t"])))
    means = [over({1: 1 + g} if g else {}).sum() for g in range(4)]
    assert means == sorted(means) and means[0] < 0.5 < means[3]


@pytest.fixture(scope="module")
def quality_model(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    return quality.train(common.table(common.prepare(spark), d, "documents"), common.table(spark, d, "labels"))


def test_quality_on_held_out_rows(spark, quality_model, odd, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    got = quality.scored(docs, quality_model)
    rows = got.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert len(rows) > 50 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.85
    one = quality.scored(odd, quality_model).collect()
    assert len(one) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in one)
    assert len({r["score"] for r in one if r["doc_id"] in (1, 5)}) == 1
    assert quality.scored(empty, quality_model).count() == 0
    assert {r["score"] for r in quality.scored(odd, None).collect()} == {0.5}
    kept = quality.accepted(odd, quality_model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] for r in one)


def plain_quality(text, model):
    """Pooling, network and temperature word by word."""
    index, context = quality.index_vectors().astype("f8"), model["context"].astype("f8")
    words, d = (text or "").split(), quality.DIM
    pooled = np.zeros(3 * d + 4)
    if words:
        vectors, own = [], []
        for word in words:
            w, s = (zlib.crc32(t.encode()) % quality.BUCKETS for t in (f"w {word}", f"s {quality.shape(word)}"))
            v = context[w] + context[s] + index[s]
            vectors.append(v / max(1e-6, np.sqrt(v @ v)))
            own.append(index[w])
        n, mean = len(words), sum(vectors) / len(words)
        pooled[:d] = mean
        pooled[d : 2 * d] = np.sqrt(np.maximum(sum(v * v for v in vectors) / n - mean * mean, 0))
        pooled[2 * d : 3 * d] = sum(own) / n
        pooled[3 * d] = sum(a @ b for a, b in zip(own, own[1:])) / n  # noqa: B905
        pooled[3 * d + 1] = sum(a @ b for a, b in zip(own, own[2:])) / n  # noqa: B905
        pooled[3 * d + 2] = np.sqrt(pooled[2 * d : 3 * d] @ pooled[2 * d : 3 * d])
        pooled[3 * d + 3] = np.log1p(n) / 10
    x, net = (pooled - model["mean"]) / model["sd"], model["net"]
    hidden = [max(0.0, float(x @ net["w1"][:, j] + net["b1"][j])) for j in range(len(net["b1"]))]
    return 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net["w2"].tolist(), strict=True)) + float(net["b2"][0])) / model["temperature"]))


def test_quality_against_a_plain_scorer(spark, quality_model, docs, odd):
    for df in (docs.limit(60), odd.where("length(text) < 10000 or text is null")):
        text = df.select("doc_id", "text").collect()
        want = sorted(((r["doc_id"], plain_quality(r["text"], quality_model)) for r in text), key=key)
        got = sorted(((r["doc_id"], r["score"]) for r in quality.scored(spark.createDataFrame(text, "doc_id long, text string"), quality_model).collect()), key=key)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 for a, b in zip(got, want, strict=True))


def test_temperature_calibrates_noisy_labels():
    """With a quarter of the labels wrong no honest score is near 0 or 1."""
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 2, 900)
    texts = [" ".join(rng.choice([f"plain{k}" for k in range(40)] if c else [f"LOUD{k}!" for k in range(40)], 30)) for c in kind]
    y = np.where(rng.random(900) < 0.25, 1 - kind, kind)
    m = quality.fit(texts[:600], y[:600])
    s = quality._scores(texts[600:], m, quality._Rows(m["context"].astype("f4"), quality.index_vectors()))
    z, held = np.log(s / (1 - s)), y[600:]
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - held * z / t)
    assert all(loss(1) < loss(t) for t in (1 / 3, 1 / 2, 2, 3))  # no other temperature does better on unseen rows
    assert 0.6 < s[kind[600:] == 1].mean() < 0.9 and 0.1 < s[kind[600:] == 0].mean() < 0.45


def test_labels_held_out_are_never_read(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x) for x in (labels, flipped))
    assert all(np.array_equal(a["net"][k], b["net"][k]) for k in a["net"])


def test_chat_escapes_are_undone_and_masked():
    for t in ("", "\\", "</s>", "<\\/s>", "<|end|>", "<\\\\|end|>", "[INST] [\\/INST]", "<<SYS>>", "<", "<|turn:user|>"):
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROLS)
        text, spans = chat.format_turns([("user", t), ("assistant", t), ("odd|role>", t)], "assistant")
        assert chat.read_turns(text) == [("user", t), ("assistant", t), ("odd|role>", t)]
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t]


def test_reply_trees(spark):
    m = spark.createDataFrame(
        [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good", 1.0), (1, 4, 3, "user", "more", 1.0), (1, 5, 4, "assistant", "end", 1.0),
         (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (3, 9, 8, None, None, None), (None, 1, None, "user", "lost", 1.0)],
        "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["rank"]): r for r in chat.format_trees(m, top_k=2).collect()}
    assert set(got) == {(1, 1), (1, 2), (3, 1)}
    assert [t for _, t in chat.read_turns(got[1, 1]["formatted"])] == ["q", "good", "more", "end"]
    assert [t for _, t in chat.read_turns(got[1, 2]["formatted"])] == ["q", "bad"]
    assert chat.read_turns(got[3, 1]["formatted"]) == [("", "")]
    assert chat.format_trees(m.where("false")).count() == 0


def best_paths(messages, top_k):
    """Node ids of each tree's best paths by plain walking; messages: (tree, node, parent, score)."""
    out = {}
    for tree in {m[0] for m in messages}:
        parent, score = {}, {}
        for t, node, up, s in messages:
            if t == tree:
                old = parent.get(node)
                parent[node] = up if old is None else old if up is None else min(old, up)
                score[node] = max(score.get(node, -1e9), s)
        inner = {p for p in parent.values() if p in parent}
        found = []
        for leaf in parent:
            path, seen = [], set()
            node = leaf
            while node in parent and node not in seen:
                seen.add(node)
                path.append(node)
                node = parent[node]
            if leaf not in inner and node not in seen:
                found.append((-sum(score[x] for x in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:top_k], 1):
            out[tree, rank] = leaf, path
    return out


def test_trees_against_plain_walks(spark):
    """Broad, deep, cyclic and repeated trees with ties of score, and columns named like the operator's own."""
    rng = np.random.default_rng(6)
    rows = []
    for tree in range(12):
        n = int(rng.integers(1, 60))
        for node in range(n):
            up = None if not node or rng.random() < 0.05 else int(rng.integers(max(0, node - 3) if tree % 2 else 0, node))
            rows.append((tree, node, up, float(rng.integers(0, 4)) / 4))
        if tree % 3 == 0:
            rows += [(tree, 100, 101, 1.0), (tree, 101, 100, 1.0), (tree, 102, 101, 1.0), (tree, 0, None, 0.5), (tree, n - 1, 0, 0.25)]
    rows += [(50, k, 0 if k else None, 0.5) for k in range(400)]  # as broad as can be
    df = common.prepare(spark) and spark.createDataFrame([(a, b, c, "user", f"{b}", s, 1, 2, 3, "x", 0) for a, b, c, s in rows], "tree_id long, node_id int, parent_id int, role string, text string, score double, leaf int, rank int, anc int, total string, n int")
    got = {(r["tree_id"], r["rank"]): (r["leaf"], [int(t) for _, t in chat.read_turns(r["formatted"])]) for r in chat.format_trees(df, top_k=3).collect()}
    want = best_paths(rows, 3)
    assert {k: (leaf, list(dict.fromkeys(path))) for k, (leaf, path) in got.items()} == want


def test_only_chosen_paths_are_expanded(spark):
    n = 64  # a chain with a leaf at each of its messages: 64 leaves, 64 * 65 / 2 path rows
    rows = [(1, k, k - 1 if k else None, 1.0) for k in range(n)] + [(1, 1000 + k, k, 0.0) for k in range(n - 1)]
    tables = chat.jumps(spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double"))
    leaves = chat.best_leaves(tables, 1)
    assert [tuple(r) for r in leaves.collect()] == [(1, n - 1, 1)]
    reach = chat.paths(tables, leaves)
    assert sorted((r["node_id"], r["up"]) for r in reach.collect()) == [(k, n - 1 - k) for k in range(n)] and len(tables) == 7


def test_long_texts_and_clashing_columns_of_turns(spark):
    text = LONG + "</s>" * 1000
    c = common.prepare(spark) and spark.createDataFrame([(1, 0, "user", text, 7, 8, 9), (1, 1, "assistant", text, 7, 8, 9)], "conv_id long, turn long, role string, text string, tree_id int, node_id int, rank int")
    r = chat.read_back(chat.format_trees(chat.turns_as_trees(c), null_tree=True)).first()
    assert (r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (1, 2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_chat_query_against_its_sql(spark):
    import duckdb

    from skarn.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = db.sql(queries.oracle_sql()["op5_chat_format"])
    names = [d[0] for d in want.description]
    got = queries.op5_chat_format(spark, sf).select(names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)


def test_vector_query_against_its_sql(spark):
    import duckdb

    from skarn.llm import queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = db.sql(queries.oracle_sql()["op6_embedding_dedup"])
    names = [d[0] for d in want.description]
    got = queries.op6_embedding_dedup(spark, sf).select(names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)


def test_long_chain(spark):
    n = 300
    m = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(n)], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    r = chat.format_trees(m).collect()
    assert len(r) == 1 and [t for _, t in chat.read_turns(r[0]["formatted"])] == [str(i) for i in range(n)]


def test_turns_without_a_conversation_are_one(spark):
    c = common.prepare(spark) and spark.createDataFrame([(None, 1, "user", "a"), (None, 2, "assistant", "b"), (0, 1, "user", "zero")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_trees(chat.turns_as_trees(c), null_tree=True)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {None: 2, 0: 1}
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()


def test_repeated_turns_all_count(spark):
    c = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5), (1, None, None, None, 5)], "conv_id long, turn long, role string, text string, score int")
    r = chat.read_back(chat.format_trees(chat.turns_as_trees(c))).first()
    assert (r["n_turns"], r["loss_chars"]) == (3, 0)


def test_vectors_against_all_pairs(spark, sf_dir):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 1) for i in range(900)]).reshape(900, 16).astype("f4")
    rows = [(i, v.tolist(), "L") for i, v in enumerate(x)] + [(900 + i, x[0].tolist(), "L") for i in range(40)]
    rows += [(2000, None, "n"), (2001, [0.0] * 16, "z"), (2002, [float("nan")] * 16, "n"), (2003, [None] * 16, "n"), (2004, [1.0, 2.0], "d"), (2005, [], "e"), (2006, [float("inf")] * 16, "i"), (None, x[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(common.prepare(spark) and df, 0.9, shards=3).collect()}
    good = [(i, np.asarray(v, "f4").astype("f8")) for i, v, _ in rows if i is not None and i < 2000]
    u = np.stack([v / np.sqrt(v @ v) for _, v in good])
    ids = [i for i, _ in good]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in ids) / link.sum()
    assert 0.99 <= found <= 1
    want = classes(range(len(ids)), lambda a, b: link[a, b])
    assert np.mean([got[i]["component_id"] == ids[want[k]] for k, i in enumerate(ids)]) > 0.99
    for i in range(2000, 2007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert hnsw.near_duplicates(df.where("false")).count() == 0 and len(got) == len(rows)


def shard_of_groups(n, seed=3):
    """Odd ids, vectors of which some are in groups of 2 to 5 near copies, and each one's links by brute force."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 64))
    for i in range(0, n // 2, 8):
        v[i : i + rng.integers(2, 6)] = v[i] + 0.3 * rng.normal(size=64)
    v += 0.15 * rng.normal(size=v.shape)
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = v[rng.permutation(n)]
    return np.arange(n) * 2 + 1, v, np.concatenate([(v[i : i + 1000] @ v.T >= 0.9).sum(1) - 1 for i in range(0, n, 1000)])


def in_batches(shard, ids, v, step=2048):
    return np.concatenate([shard.query(ids[i : i + step], v[i : i + step])[0] for i in range(0, len(ids), step)])


def test_links_come_from_the_graph_at_20000_vectors_a_shard(monkeypatch):
    ids, v, true = shard_of_groups(20000)
    shard = hnsw.Shard(ids, v, np.ones(len(ids), "i8"), 0.9)
    shard.settle(ids[:4096], v[:4096])
    monkeypatch.setattr(shard, "_scanned", None)  # no query is compared with the shard
    assert len(shard.graph.layers) >= 2
    got = in_batches(shard, ids, v)
    assert shard.beam and (got <= true).all() and got.sum() >= 0.99 * true.sum() and true.sum() > 5000
    queries, links, found, recall = shard.audit
    assert queries == 4096 and links == true[:4096].sum() and found == got[:4096].sum() and recall >= hnsw.RECALL


def test_a_clump_is_found_by_one_of_its_members():
    ids, v, true = shard_of_groups(3000)
    shard = hnsw.Shard(ids, v, np.ones(len(ids), "i8"), 0.9)
    shard.settle(ids, v)
    right = shard.graph.search
    shard.graph.search = lambda q, beam: tuple(x[:, :2] for x in right(q, beam))  # itself and one more
    assert (in_batches(shard, ids, v) == true)[true > 0].mean() > 0.95 and true.max() > 2


def test_audit_sees_lost_links_of_small_groups_beside_a_hot_one():
    rng = np.random.default_rng(4)
    hot = rng.normal(size=64) + 0.1 * rng.normal(size=(1500, 64))
    pairs = np.repeat(rng.normal(size=(300, 64)), 2, axis=0) + 0.1 * rng.normal(size=(600, 64))
    v = np.concatenate([hot, pairs])
    v = (v / np.linalg.norm(v, axis=1)[:, None])[rng.permutation(len(v))]
    true = (v @ v.T >= 0.9).sum(1) - 1
    for worst, beams in ((64, (64, 128, 256)), (1024, (0,))):  # beams up to that miss the pairs; where all do, the shard is compared whole
        ids = np.arange(len(v)) * 16 + 3
        shard = hnsw.Shard(ids, v, np.ones(len(v), "i8"), 0.9)
        right = shard.graph.search

        def blind(q, beam):
            near, sims = right(q, beam)
            return near, np.where(((sims >= 0.9).sum(1) < 3)[:, None] & (beam < worst), -np.inf, sims)

        shard.graph.search = blind
        shard.settle(ids, v)
        assert shard.beam in beams and (in_batches(shard, ids, v) == true).all()


def test_a_hot_group_never_has_all_its_links_in_memory():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(6000, 64))
    v[:2500] = v[0] + 0.1 * rng.normal(size=(2500, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None])[rng.permutation(len(v))]
    ids = np.arange(len(v))
    shard = hnsw.Shard(ids, v, np.ones(len(v), "i8"), 0.9)
    tracemalloc.start()
    shard.settle(ids[:512], v[:512])
    n, rows, to = shard.query(ids[:4000], v[:4000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    true = (v[:4000] @ v.T >= 0.9).sum(1) - 1
    assert shard.beam and (n == true).all() and true.sum() > 4_000_000 and (rows == np.flatnonzero(true)).all()
    assert len(np.unique(shard._root(np.flatnonzero((v @ v[rows[true[rows] > 1000][0]]) >= 0.95)))) == 1 and (np.einsum("ij,ij->i", v[rows], v[to]) >= 0.9).all()
    assert peak < 300e6, peak


def brute_links(rows, threshold=0.9):
    """n_links and component of (vec_id, vector) rows, vectors of one dimension with one another only."""
    unit = [np.asarray(v, "f8") / np.abs(v).max() for _, v in rows]
    unit = [v / np.sqrt(v @ v) for v in unit]
    link = np.asarray([[i != k and len(a) == len(b) and a @ b >= threshold for k, b in enumerate(unit)] for i, a in enumerate(unit)])
    want = classes(range(len(rows)), lambda a, b: link[a, b])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[want[k]] = min(least.get(want[k], i), i)
    return sorted((i, int(link[k].sum()), least[want[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_small_tables_of_vectors(spark, n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(3, 4))
    rows = [(100 - i, (base[i % 3] + 0.05 * rng.normal(size=4)).tolist()) for i in range(n)]
    df = common.prepare(spark) and spark.createDataFrame([(i, v, 1, 2, "k", 3) for i, v in rows], "vec_id long, embedding array<double>, rep int, copies int, shard string, kind int")
    got = hnsw.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_of_any_dimension_and_magnitude(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [1e200, 0.0]), (4, [1e200, 1.0]), (5, [1e-200, 0.0]), (6, [2e-200, 0.0]), (7, [5e-324, 0.0]), (8, [-1.0, 0.0]), (9, [0.9, 0.4358898943540674]),
            (20, [1.0, 0.0, 0.0]), (21, [1.0, 0.0, 0.1]), (22, [0.0, 1.0, 0.0]), (23, [0.0, 1.0, 0.0]), (20, [0.0, 0.0, 3.0]), (31, [2.0]), (30, [7.0]), (32, [-7.0]), (40, [1.0] * 9)]
    df = common.prepare(spark) and spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, audits = hnsw.with_audits(df)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == brute_links(rows)
    assert sorted(r["members"] for r in audits.collect()) == [1, 3, 4, 9] and audits.where("recall < 0.99").count() == 0  # equal vectors are one member


@pytest.mark.parametrize("n,shards", [(500, 1), (2000, 2), (7000, 6)])
def test_every_shard_of_a_few_hundred_members_is_a_hierarchy(spark, n, shards):
    """Links of all sizes come from navigated layers: no shard is compared whole."""
    ids, v, true = shard_of_groups(n)
    df = common.prepare(spark) and spark.createDataFrame(list(zip(ids.tolist(), v.tolist(), strict=True)), "vec_id long, embedding array<double>")
    got, audits = hnsw.with_audits(df)
    found = audits.collect()
    assert len(found) == shards and all(r["beam"] > 0 and r["layers"] >= 2 and r["recall"] >= 0.99 for r in found) and sum(r["members"] for r in found) == n
    n_links = {r["vec_id"]: r["n_links"] for r in got.collect()}
    got = np.asarray([n_links[i] for i in ids.tolist()])
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum()


def test_of_two_shards_one_asks_the_other(spark, monkeypatch):
    """Links between shards are looked for once and count for both ends, copies included; large tables get further shards, whose first beams do."""
    ids, v, _ = shard_of_groups(4000)
    v = np.concatenate([v, v[:700]])  # equal vectors: copies on either side of a link
    ids = np.arange(len(v)) * 2 + 1
    true = (v @ v.T >= 0.9).sum(1) - 1
    df = common.prepare(spark) and spark.createDataFrame(list(zip(ids.tolist(), v.tolist(), strict=True)), "vec_id long, embedding array<double>")
    for most, n in ((700, 6), (600, 7), (500, 8)):  # even and odd numbers of shards
        monkeypatch.setattr(hnsw, "MEMBERS", most)
        got, audits = hnsw.with_audits(df, shards=1)
        assert audits.count() == n and audits.where(f"beam <> {hnsw.BEAM} or recall < 0.99").count() == 0
        n_links = {r["vec_id"]: r["n_links"] for r in got.collect()}
        got = np.asarray([n_links[i] for i in ids.tolist()])
        assert (got <= true).all() and got.sum() >= 0.99 * true.sum()


def test_graph_search_recall_over_several_layers(monkeypatch):
    monkeypatch.setattr(hnsw, "DIRECT", 256)  # else 6,000 vectors have one layer below the one compared directly
    rng = np.random.default_rng(3)
    c = rng.normal(size=(60, 24))
    v = np.concatenate([c[rng.integers(60, size=6000)] + rng.normal(size=(6000, 24)) * 0.4]).astype("f4")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph(v)
    assert len(g.layers) >= 2
    q = v[::40]
    near, _ = g.search(q, 64)
    true = np.argsort(-(q @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:64]) & set(b)) / 10 for a, b in zip(near, true, strict=True)]) >= 0.9


def test_simhash_against_all_pairs(spark, odd, empty, docs):
    for df, texts in ((odd, TEXTS), (docs, [tuple(r) for r in docs.collect()])):
        got = sh.near_duplicates(df).collect()
        assert len(got) == len(texts)
        fp = {}
        for i, t in texts:
            fp.setdefault(i, set()).add(simhash(t))
        for r in got:
            assert r["fp"] % (1 << 64) in fp[r["doc_id"]]
        ids = sorted(i for i in fp if i is not None)
        want = classes(ids, lambda a, b: any((x ^ y).bit_count() <= 3 for x in fp[a] for y in fp[b]))
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, want.get(i)) for i in fp}
    assert sh.near_duplicates(empty).count() == 0


def test_simhash_lists_in_blocks(spark, monkeypatch):
    """Many fingerprints near one another: one long list, dealt out as pairs of blocks."""
    monkeypatch.setattr(sh, "BLOCK", 16)
    rng = np.random.default_rng(2)
    fps = {int(x) for x in (0x0123456789ABCDEF ^ (np.uint64(1) << rng.integers(0, 63, 400).astype("u8")) ^ (np.uint64(1) << rng.integers(0, 63, 400).astype("u8"))).astype("i8")} | {int(x) for x in rng.integers(-(2**63), 2**63, 300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    c = {r["node"]: r["component_id"] for r in common.components(sh.links(df, 3)).collect()}
    want = classes(range(len(fps)), lambda a, b: ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 3)
    assert {i: c.get(i, i) for i in range(len(fps))} == want


def test_positions_cover_every_shared_set():
    from itertools import combinations

    sets = sh.position_sets(5, 4)
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 5)) and len(sets) <= 24


def test_one_of_each_group_stays(odd):
    kept = sh.keep_one(odd, sh.near_duplicates(odd))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 7, 9] and kept.where("doc_id is null").count() == 1


def test_similar_texts_are_one_group_and_others_are_not(spark, odd, empty, docs):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    rows, of = [], []
    for k in range(150):
        base = [words[i] for i in rng.integers(0, 4000, 220)]
        for edits in (0, 1, 2, 3, 60):
            t = list(base)
            for p in rng.choice(220, edits, replace=False):
                t[p] = "edited"
            rows.append((len(rows), " ".join(t)))
            of.append((k, edits))
    got = {r["doc_id"]: r["component_id"] for r in sh.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [(i, j) for i, (a, x) in enumerate(of) for j, (b, y) in enumerate(of) if i < j and a == b and max(x, y) < 60]
    close = [(i, j) for i, j in near if jaccard(rows[i][1], rows[j][1]) >= 0.85]
    assert len(close) > 400 and np.mean([got[i] == got[j] for i, j in close]) >= 0.99
    assert all(got[i] == i for i, (_, x) in enumerate(of) if x == 60) and len(set(got.values())) >= 300  # far ones stay apart
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r["component_id"] for r in sh.similar(docs).collect()}
    ids = sorted(texts)
    pairs = [(a, b, jaccard(texts[a], texts[b])) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    assert all(found[a] == found[b] for a, b, s in pairs if s >= 0.9)
    linked = classes(ids, lambda a, b: jaccard(texts[a], texts[b]) >= 0.7)
    assert all(linked[a] == linked[b] for a, b, _ in pairs if found[a] == found[b])  # nothing below 0.7 is joined
    one = {(r["doc_id"], r["component_id"]) for r in sh.similar(odd).collect()}
    assert one == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (None, None), (7, 7), (8, 2), (9, 9)} and sh.similar(empty).count() == 0


def test_bpe_is_tiktokens(spark, odd, empty, docs):
    import tiktoken

    b = bpe.Bpe(RANKS)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.rank, special_tokens={})
    rng = np.random.default_rng(4)
    signs = ["a", "B", "'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "1", "23", "!", "é", "中", "😀", " ", "́", "x" * 50, "'ve'd", "'S", "\r\n", "²", "_"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(800)]
    for t, ids in zip(texts, b.encode(texts), strict=True):
        assert ids.tolist() == e.encode_ordinary(t) and b.decode(ids) == t.encode()
        assert b.offsets(ids)[-1] == len(t.encode())
    for df in (odd, docs):
        got = bpe.round_trip(df, RANKS).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = e.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.round_trip(empty, RANKS).count() == 0
    again = bpe.decode(bpe.encode(odd, RANKS), RANKS).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["text"])) for r in again) == sorted((i or 0, (t or "").encode()) for i, t in TEXTS)


def test_media_round_trip(spark, odd, empty, docs):
    for df in (odd, docs):
        got = webp.features(webp.store(df)).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            raw = (r["text"] or "").encode()
            p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            want.append((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert len({(r["media_sha256"], r["feature"]) for r in webp.features(webp.store(odd.where("doc_id in (1, 5)"))).collect()}) == 1
    assert webp.features(webp.store(empty)).count() == 0


def riff(data):
    return b"RIFF" + (12 + len(data) + len(data) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)


def read(data):
    return webp.read_images(webp.chunks(riff(data)))[0]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rng = np.random.default_rng(mode)
    p = rng.integers(0, 1 << 32, (9, 13), dtype="u8").astype("u4")
    modes = np.full((3, 4), mode)
    w = Writer()
    w.header(13, 9)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    w.image(modes << 8 | 255 << 24, False)
    w.put(0, 1)
    w.image(predict(p, modes, 2), True)
    assert np.array_equal(read(w.data()), p)


def test_cross_colour_and_subtracted_green():
    rng = np.random.default_rng(9)
    p = rng.integers(0, 256, (6, 10, 4))  # blue, green, red, alpha
    t = rng.integers(-128, 128, (2, 3, 3))  # green to red, green to blue, red to blue
    s8 = lambda v: (int(v) + 128) % 256 - 128
    q = p.copy()
    for y in range(6):
        for x in range(10):
            b, g, r, _ = p[y, x]
            gr, gb, rb = t[y >> 2, x >> 2]
            q[y, x, 2] = r - (gr * s8(g) >> 5)
            q[y, x, 0] = b - (gb * s8(g) >> 5) - (rb * s8(r) >> 5)
    q[..., 2] -= q[..., 1]  # green is taken off last, so it is added back first
    q[..., 0] -= q[..., 1]
    argb = lambda a: (a[..., 0] & 255) | (a[..., 1] & 255) << 8 | (a[..., 2] & 255) << 16 | (a[..., 3] & 255) << 24
    w = Writer()
    w.header(10, 6)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    w.image((t[..., 0] & 255) | (t[..., 1] & 255) << 8 | (t[..., 2] & 255) << 16 | 255 << 24, False)
    w.put(1, 1), w.put(2, 2)
    w.put(0, 1)
    w.image(argb(q), True)
    assert np.array_equal(read(w.data()), argb(p).astype("u4"))


@pytest.mark.parametrize("n", [2, 3, 9, 40])
def test_palettes(n):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 1 << 32, n, dtype="u8").astype("u4")
    index = rng.integers(0, n, (5, 11))
    k = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    c = colours.view("u1").reshape(-1, 4)
    step = np.diff(np.concatenate([np.zeros((1, 4), "u1"), c]), axis=0).astype("u1").view("u4").ravel()
    packed = np.zeros((5, -(-11 // (1 << k))), "i8")
    for y in range(5):
        for x in range(11):
            packed[y, x >> k] |= int(index[y, x]) << ((x & ((1 << k) - 1)) * (8 >> k))
    w = Writer()
    w.header(11, 5)
    w.put(1, 1), w.put(3, 2), w.put(n - 1, 8)
    w.image(step, False)
    w.put(0, 1)
    w.image(packed << 8, True)
    assert np.array_equal(read(w.data()), colours[index])


def kinds(media):
    """Transforms of all images, and whether they have meta codes."""
    return [(tuple(x[0] for x in o[3]), o[0].meta is not None) for m in media for o in map(webp._open, webp.chunks(m))]


def test_the_writer_chooses_among_all_parts_of_the_format(docs):
    media = [bytes(r["media"]) for r in webp.store(docs).collect()]
    assert {t for t, _ in kinds(media)} == {(), (3,)}  # predictors never pay in prose, palettes do in texts of few letters
    rng = np.random.default_rng(1)
    binary = [np.cumsum(rng.integers(0, 5, (n, 16, 4)), axis=1).astype("u1").tobytes() for n in (4, 40, 128)]
    written = webp.write_media([*binary, webp.payload("the cat sat on the mat " * 30)])
    assert webp.read_media(written) == [*binary, webp.payload("the cat sat on the mat " * 30)]
    assert [0 in t for t, _ in kinds(written)] == [True, True, True, False] and all(len(m) < len(p) for m, p in zip(written[1:3], binary[1:], strict=True))
    texts = [webp.payload(t) for t in ["", "a", "ab" * 4000, "x" * 100_000, "A1;" * 50]]
    media = webp.write_media(texts)
    assert webp.read_media(media) == texts and (3,) in {t for t, _ in kinds(media)}
    assert max(map(len, media)) < 6000  # palettes and references
    rng = np.random.default_rng(2)
    words = [w.encode() for w in "the quick brown fox jumps over lazy dogs and runs away from home".split()]
    prose = b" ".join(words[i] for i in rng.integers(0, len(words), 5000))
    mixed = b"".join((prose[k * 700 : k * 700 + 700], bytes(rng.integers(33, 64, 500, dtype="u1"))[:500])[k % 2] for k in range(40))
    payloads = [mixed[: 64 * n] for n in range(64, 128)]
    media = webp.write_media(payloads)
    assert webp.read_media(media) == payloads and any(m for _, m in kinds(media))


def test_every_predictor_and_multiplier_is_written_and_read():
    """Pictures of different kinds: each image goes through predictors and cross-colour chosen for it."""
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:48, 0:16]
    pictures = []
    for k in range(300):
        a = rng.normal(size=4)
        base = a[0] * x + a[1] * y + 20 * np.sin(a[2] * x + a[3] * y) + rng.normal(size=(48, 16)).cumsum(k % 2) * (k % 5)
        rgba = np.stack([base * s + rng.integers(0, 1 + k % 4, base.shape) for s in (1, 0.5, -0.7, 0.1)], axis=-1)
        pictures.append(rgba.astype("i8").astype("u1").tobytes())
    media = webp.write_media(pictures)
    assert webp.read_media(media) == pictures and [webp.read_media([m])[0] for m in media[:40]] == pictures[:40]
    opened = [o for m in media for o in map(webp._open, webp.chunks(m)) if o[3]]
    modes = {int(v) >> 8 & 15 for o in opened for t in o[3] if t[0] == 0 for v in t[3].ravel()}
    assert len(modes) >= 8 and any((t[3] & 0xFFFFFF).any() for o in opened for t in o[3] if t[0] == 1)


def test_predictors_undone_together_are_those_undone_alone():
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 1 << 32, (h, 16), dtype="u8").astype("u4") for h in (1, 5, 16, 33, 40, 40)]
    for k in (2, 4):
        modes = [rng.integers(0, 16, (-(-len(p) >> k), 16 >> k)).astype("u4") for p in images]
        alone = [webp._undo(p, (0, 16, k, m << np.uint32(8))) for p, m in zip(images, modes, strict=True)]
        together = webp._undo_together(images, [(0, 16, k, m << np.uint32(8)) for m in modes])
        assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))


def test_back_references_and_cache_are_written_and_read():
    run = (b"abcdefghijklmnop" * 40 + b"0123" * 30 + bytes(range(256)) * 3)[: 64 * 20]
    m = webp.write_media([run, b"\0" * 6400])
    assert webp.read_media(m) == [run, b"\0" * 6400] and len(m[1]) < 400


def test_an_image_of_the_public_library():
    """The one-pixel lossless image by which web pages test for the format: a palette of one colour, every code a lone symbol."""
    image = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.read_images(webp.chunks(image))[0].tolist() == [[0]]
    assert kinds([image]) == [((3,), False)]


def test_the_coding_of_an_image_is_its_own_affair():
    """Equal payloads give equal media whatever stands beside them."""
    rng = np.random.default_rng(6)
    some = [webp.payload("some words " * k) for k in (1, 9, 300)] + [np.cumsum(rng.integers(0, 3, (k, 16, 4)), axis=1).astype("u1").tobytes() for k in (1, 30, 90)] + [b"ab" * 320]
    alone = [webp.write_media([p])[0] for p in some]
    assert webp.write_media(some) == alone and webp.write_media(some[::-1]) == alone[::-1]


def test_broken_media_is_refused():
    with pytest.raises(ValueError):
        webp.chunks(b"nothing of the kind")
    with pytest.raises(ValueError):
        read(b"\0" * 20)
