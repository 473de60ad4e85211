"""Nulls in any column, repeated ids, empty texts, clashing extra columns: each case has a defined result."""

import base64
import hashlib
import io
import tarfile
import time
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import bpe, files, graph_index, language, media, minhash, mixing, pii, queries, shared, suffix, toxicity, warc

DIR = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the input.
CLASH = ("key", "bucket", "n", "row", "gram", "size", "digest", "shard", "draw", "_part", "spans", "weight")
TEXTS = [(None, "no id, mail a@b.org"), (None, None), (1, None), (2, ""), (3, "some words of a text, mail a@b.org"), (3, "another text under this id"), (3, "another text under this id"), (4, "x" * 300), *((i, f"number {i} of a few") for i in range(5, 9))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 1, "s"), "n_chars": F.lit(None).cast("long")})
    return rows.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def pairs(df, column):
    return sorted(((r["doc_id"], r[column]) for r in df.collect()), key=str)


def test_rows_stay_one_by_one(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    length = lambda t: len((t or "").encode())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = lambda f: sorted(((i, f(t)) for i, t in TEXTS), key=str)
    assert pairs(suffix.remove_repeats(odd), "kept_sha256") != want(lambda t: sha((t or "").encode()))  # 300 times x repeats itself
    assert pairs(suffix.remove_repeats(odd), "n_bytes") == pairs(media.media_columns(odd), "n_bytes") == want(length)
    assert pairs(media.media_columns(odd), "payload_sha256") == want(lambda t: sha(media.pad((t or "").encode())))
    assert pairs(pii.find(odd), "n_email") == want(lambda t: int("@" in (t or "")))
    encoder = bpe.TextEncoder(open(path, encoding="utf-8").read())
    assert pairs(bpe.encode(odd, path), "n_tokens") == want(lambda t: len(encoder.encode([t or ""])[0]))
    assert pairs(mixing.mix(odd), "size") == want(lambda t: len((t or "").split()))
    assert pairs(toxicity.score(odd, labels), "score") == want(lambda t: 0.0)
    assert pairs(language.identify(odd), "lang_pred") == want(lambda t: "en" if t and any(c.isalpha() for c in t) else "und")
    kept = minhash.near_duplicates(odd)
    assert pairs(kept, "component_id") == sorted(((i, i) for i, _ in TEXTS), key=str) and all(r["kept"] for r in kept.collect())


def test_pages(spark):
    html = ["<p>one</p>", None, "", "<p>one</p>", "<p>two</p>", "<p>one</p>", "é" * 70000]
    ids = [5, 6, 7, 3, None, None, 9]
    rows = [(i, None if h == "" else "http://x/\r\nWARC-Type: y", h) for i, h in zip(ids, html)] + [(5, "u", "<p>one</p>"), (5, "u", "<p>other</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "digest": F.lit("d"), "first": F.lit(2), "type": F.lit("t")})
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        refers = first[h or ""] if i is not None and i > first[h or ""] else None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, warc.archive_pages(df).collect()), key=str) == sorted(want, key=str)
    assert {r["record_type"] for r in warc.archive_pages(df, least=10**6).collect()} == {"response"}


def test_pages_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    got = queries.op9_warc(spark, DIR).collect()
    want = con.execute(queries.ORACLE_SQL["op9_warc"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 0


def test_reading_tasks_grow_with_ranges(spark, monkeypatch):
    sizes = spark.createDataFrame([("a", 10_000), ("b", 0), ("c", 30_000)], "file string, size long")
    assert warc.reading_ranges(sizes, 100).rdd.getNumPartitions() == 1
    monkeypatch.setattr(warc, "TASK_BYTES", 1000)
    ranges = warc.reading_ranges(sizes, 100)
    assert ranges.rdd.getNumPartitions() == 40 and ranges.count() == 400
    rows = ranges.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert rows < 40


def test_media_columns_and_shards(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(60)
    monkeypatch.setattr(media, "TASK_BYTES", 4000)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = media.pad(raw)
        image = media.encode_png(payload)
        values = np.frombuffer(payload, np.uint8).astype(float)
        share = [values[(values >= 16 * k) & (values < 16 * k + 16)].size / values.size for k in range(16)]
        p = np.unique(values, return_counts=True)[1] / values.size
        parts = got[i]["feature"].split(";")
        assert (got[i]["n_bytes"], got[i]["media_bytes"], got[i]["media_sha256"]) == (len(raw), len(image), hashlib.sha256(image).hexdigest())
        assert int(parts[0]) == len(payload) // 576 and abs(float(parts[1]) - values.mean()) < 1e-3 and abs(float(parts[2]) - values.std()) < 1e-3
        assert abs(float(parts[3]) + (p * np.log2(p)).sum()) < 1e-3 and np.abs(np.array(parts[4].split(","), float) / 1000 - share).max() < 1e-3
    folder = f"{shared.shared_dir(spark)}/media"
    rows = media.store(docs, folder)
    places = media.addresses(rows)
    assert places.rdd.getNumPartitions() > 5
    system, path = files.open_fs(folder)
    held: dict = {}
    for name in {r["shard"] for r in rows.collect()}:
        with system.open_input_file(f"{path}/{name}") as f:
            body = f.read()
        with tarfile.open(fileobj=io.BytesIO(body)) as tar:
            held |= {m.name: tar.extractfile(m).read() for m in tar}
        assert media.unpack(body).items() <= held.items()
    for r in rows.collect():
        payload = media.decode_png(held[f"{r['digest']}.png"])
        assert hashlib.sha256(payload).hexdigest() == r["digest"] and payload[: r["n_bytes"]] == (texts[r["doc_id"]] or "").encode()


def test_nearest_scores_ranks_and_ties(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-3, 4, (400, 6)).astype(float)
    base[::3] = base[0]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(base) if v.any()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"dim": F.lit("x"), "shard": F.lit(1), "score": F.lit(2.0), "rank": F.lit(3)})
    got: dict = {}
    for r in graph_index.nearest(df, shard=128).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = dict(rows)
    for q, found in got.items():
        a = np.array(vectors[q])
        exact = {i: graph_index.cosines(a, np.array(v)) for i, v in rows if i != q}
        assert [f[0] for f in found] == list(range(1, 6))
        assert all(s == exact[i] for _, i, s in found) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        best = sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert len({i for _, i, _ in found} & {i for i, _ in best}) >= 4
    assert set(got) == {i for i, _ in rows if i % 50 == 0}


def test_every_node_of_a_graph_is_reached():
    rng = np.random.default_rng(4)
    # Far clusters, between which pruned arcs hardly ever lead.
    centres = np.eye(40)[rng.integers(0, 40, 900)]
    unit = centres + rng.normal(0, 0.01, centres.shape)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    arcs, start = graph_index.build_graph(unit, degree=4, beam=8)
    assert graph_index._reached(arcs, start).all()


def test_convolution_against_loops():
    rng = np.random.default_rng(3)
    model = toxicity.TextCnn.start(rng.normal(0, 1, toxicity.BUCKETS), 5)
    texts = [rng.integers(1, toxicity.BUCKETS, (n, 1 + len(toxicity.PREFIXES))).astype(np.int32) for n in (7, 1, 2, 0, 12)]
    ids, first = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    got = model.logits(ids, first)
    for t, value in zip(texts, got):
        x = [sum(model.table[b] for b in word) for word in t]
        pooled = []
        for w, f, b in zip(toxicity.WIDTHS, model.filters, model.offsets):
            for k in range(toxicity.FILTERS):
                values = [sum(float(x[i + j] @ f[j][:, k]) for j in range(w)) + b[k] for i in range(len(x) - w + 1)]
                pooled.append(max([0.0, *values]))
        assert abs(value - (np.dot(pooled, model.head) + model.bias)) < 1e-4


def test_convolution_step_lowers_the_loss():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 200, (20, 1 + len(toxicity.PREFIXES))).astype(np.int32) for _ in range(32)]
    y = (np.arange(32) % 2).astype(np.float32)
    for t, label in zip(texts, y):
        t[5] = 300 + int(label)
    ids, first = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    model, state = toxicity.TextCnn.start(np.zeros(toxicity.BUCKETS), 1), {}
    loss = lambda: np.logaddexp(0, -(2 * y - 1) * model.logits(ids, first)).mean()
    before = loss()
    for _ in range(60):
        model.step(ids, first, y, state, 0.02)
    assert loss() < 0.5 * before


def test_decoding_against_loops():
    rng = np.random.default_rng(2)
    book = language.codebook(9)
    model = language.OutputCodes([str(i) for i in range(9)], book, rng.normal(0, 1, (30, book.shape[1])), rng.normal(0, 1, book.shape[1]), rng.random(book.shape[1]) + 0.5)
    x = rng.normal(0, 1, (50, 30))
    best, p, _ = model.predict(x)
    for row, b, q in zip(x, best, p):
        margin = 4 * np.tanh((row @ model.weights + model.bias) / 4)
        loss = [sum(t * np.log1p(np.exp(-c * m)) for c, m, t in zip(word, margin, model.trust)) for word in book]
        assert b == int(np.argmin(loss)) and abs(q - 1 / sum(np.exp(min(loss) - v) for v in loss)) < 1e-9
    gaps = (book.shape[1] - book @ book.T) // 2 + 99 * np.eye(9, dtype=int)
    assert gaps.min() >= 4


def test_more_languages_than_a_small_sample_holds(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(5)
    words = {f"l{k:03d}": ["".join(rng.choice(list(letters), 5)) for _ in range(8)] for k in range(240)}
    rows = [(n, " ".join(rng.choice(w, 60)), name) for n, (name, w) in enumerate((name, w) for name, w in words.items() for _ in range(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    repeated = df.unionByName(spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(rows[7][1]).alias("text"), F.lit(rows[7][2]).alias("lang")))
    told = language.identify(repeated).filter("doc_id <> 7").join(df.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in told) / len(told)
    assert len({r["lang_pred"] for r in told}) > 210 and right > 0.9


def test_toxicity_sample_is_bounded_by_bytes_not_by_length(spark):
    prose = "alpha beta gamma delta epsilon zeta eta theta " * 20
    rows = [(i, prose + (" awful nasty " if i % 2 else " kind words ") + prose) for i in range(300)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = toxicity.score(df, labels, sample_bytes=1 << 20).collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in told) > 280
    measured = df.withColumn("toxic", F.col("doc_id").cast("int") % 2).withColumn("bytes", F.octet_length("text").cast("long"))
    few = toxicity._chosen(measured, 1, 3000, 20_000)
    assert 5 < len(few) < 20 and sum(r[2] for r in few) <= 20_000
    assert len(toxicity._chosen(measured, 1, 3000, 10)) == 1


@pytest.mark.parametrize("text", ["gone often", "andere woorden"])
def test_a_language_of_one_repeated_text_is_learned(spark, text):
    rows = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words number "), "id").alias("text"), F.lit("en").alias("lang"))
    often = spark.range(6000).select(F.lit(5000).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("xx").alias("lang"))
    found = language.train(rows.unionByName(often), F.lit(False))
    assert found.languages == ["en", "xx"]


def test_many_scaled_copies_tie(spark):
    base = [0.3, -0.7, 0.11, 0.9]
    rows = [(2000 + i, [c * 2.0 ** (i - 100) for c in base]) for i in range(200)] + [(0, [c * 2.0**7 for c in base]), (1, [c * 2.0**3 for c in base])]
    rows += [(4000 + i, [float(i % 7), 1.0, float(i % 3), -float(i)]) for i in range(300)]
    got = {}
    for r in graph_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert [got[0][k][0] for k in range(1, 6)] == [1, 2000, 2001, 2002, 2003]
    assert [got[2000][k][0] for k in range(1, 6)] == [0, 1, 2001, 2002, 2003] and {got[2000][k][1] for k in range(1, 6)} == {got[0][1][1]}


def test_very_many_spans_in_one_text():
    text = " ".join(f"a1b2c3d4e5f6g7h8i9j{i}" for i in range(100_000)) + " x@y.org"
    began = time.time()
    assert len(pii._more_spans(text, pii.base_spans(text))) == 100_000 and time.time() - began < 10
    text, rng = "", np.random.default_rng(2)
    for _ in range(300):
        text += rng.choice(["a@b.org", "me at host dot org", "555-123-4567", "DE89370400440532013000", "0123456789abcdef0123", "+49 301234567", "4111 1111 1111 1111", "-", "x"]) + rng.choice([" ", "", ".", "@"])
    base, want = pii.base_spans(text), []
    used = [(a, b) for _, a, b in base]
    for kind, pattern in (("email_text", pii._EMAIL_TEXT), ("phone_local", pii._PHONE_LOCAL), ("iban", pii._IBAN), ("key", pii._KEY)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(a < y and x < b for x, y in used):
                used.append((a, b))
                want.append((kind, a, b))
    assert pii._more_spans(text, base) == want and len(want) > 20


def test_nothing_staged_is_left_after_cleaning(spark, monkeypatch):
    monkeypatch.setattr(shared, "_MADE", [])
    docs = spark.createDataFrame([(i, f"a text of some words {i % 3}") for i in range(9)], "doc_id long, text string").withColumn("source", F.lit("s"))
    for result in (minhash.near_duplicates(docs), mixing.mix(docs), pii.find(docs), suffix.remove_repeats(docs)):
        result.write.format("noop").mode("overwrite").save()
    made = [Path(m.removeprefix("file://").removeprefix("file:")) for m in shared._MADE]
    assert [p for m in made for p in m.rglob("*.parquet")]
    assert shared.clean(spark) == len(made) and not [m for m in made if m.exists()] and shared.clean(spark) == 0


def test_equal_passages_choose_one_anchor_in_blocks_of_any_size():
    rng = np.random.default_rng(8)
    passage = rng.integers(97, 101, 400).astype(np.uint8)
    codes, found = np.ones(256, np.uint64), []  # every gram hashes by its place only: all ties
    for before in (0, 5, 70_000):
        data = np.concatenate([rng.integers(97, 101, before).astype(np.uint8), passage])
        starts, anchors, _, _ = suffix._anchors(data, np.array([0, len(data)]), 100, codes)
        found.append(((anchors - starts)[starts >= before]).tolist())
        starts, anchors, _, _ = suffix._anchors(data, np.array([0, len(data)]), 100, shared.byte_codes(31))
        found.append(((anchors - starts)[starts >= before]).tolist())
    assert found[0] == found[2] == found[4] and found[1] == found[3] == found[5]


def test_toxicity_learns_from_rows_beyond_the_sample(spark):
    prose = "alpha beta gamma delta epsilon zeta eta theta "
    # Each toxic text has one of 8 words; a warm-up of 2 rows a label cannot have seen them all.
    rows = [(i, prose + (f"vile{i % 8}q" if i % 2 else f"kind{i % 8}q") + " " + prose) for i in range(600)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    told = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample=2).collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in told) > 570


def test_toxicity_parameters_move_and_thresholds_split_cells():
    model = toxicity.TextCnn.start(np.zeros(toxicity.BUCKETS), 3)
    by = np.random.default_rng(1).normal(0, 0.1, len(model.flat()))
    assert np.allclose(model.moved(by).flat()[:-15], (model.flat() + by)[:-15], atol=1e-5)
    assert toxicity._threshold(np.array([3.0, 2.0, 2.0, 1.0]), np.array([1, 1, 0, 0]), np.array([5.0, 5.0, 1.0, 9.0])) == 1.5
