"""Operators that SQL can't express against plain versions of them, and tables with clashing names, odd rows and no rows."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import decontaminate, language_id, language_model, media, packing, quality, queries, simhash, token_records, url_filter
from tracewright.llm.common import materialise, table


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def plain_language(text, dictionaries):
    """Sizes of the letters of a text under each dictionary, block by block."""
    raw = language_id.letters(text)
    sizes = {}
    for name, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[name] = sum(len(c.compress(raw[i : i + language_id.BLOCK])) for i in range(0, len(raw), language_id.BLOCK))
    return sizes


def test_language_by_plain_compression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    dictionaries = language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert max(map(len, dictionaries.values())) <= language_id.DICTIONARY_BYTES
    right = asked = 0
    for r in queries.op1_language_id(spark, sf_dir).collect():
        text = rows[r.doc_id].text
        assert r.held_out == (crc(r.doc_id) % 4 == 2)
        if text is None or not language_id.LETTER.search(text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = plain_language(text, dictionaries)
        best, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == best and r.lang_pred == min(k for k, v in sizes.items() if v == best)
        assert r.score == pytest.approx((second - best) / second / ((second - best) / second + 0.02))
        if r.held_out and rows[r.doc_id].lang:
            asked, right = asked + 1, right + (r.lang_pred == rows[r.doc_id].lang)
    assert right > 0.95 * asked > 20


def test_language_sample_is_bounded(spark):
    """Rows of null id are drawn by their text; rows that repeat id and text are drawn once."""
    rows = [(None, f"the words of number {i}", "en") for i in range(3000)] + [(7, "the same words", "en")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.fit(df)["en"].decode().split("the words of number")
    assert len(found) < 200


def test_media_by_hand(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    for r in queries.op3_media(spark, sf_dir).collect():
        raw = texts[r.doc_id]
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        data = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        at, boxes = 0, {}
        while at < len(data):  # the outermost boxes
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            boxes[kind] = (at + head, at + size)
            at += size
        a, b = boxes[b"mdat"]
        assert set(boxes) == {b"ftyp", b"moov", b"mdat"} and data[a:b] == payload
        n = len(payload) // 64
        keys = [f"{a + k}+64" for k in range(0, len(payload), 1024)]
        assert r.feature == f"codec=raw;duration={n}/25;samples={n};keyframes={len(keys)};first={keys[0]};last={keys[-1]};ranges={zlib.crc32(','.join(keys).encode()):08x}"


def test_ridge_and_calibration_at_once(spark, sf_dir):
    """The summed equations against one matrix of all labelled rows; scores against the calibrated table."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    described = materialise(quality.describe(docs), "statistics")
    model = quality.fit(described, labels)
    x = {r.doc_id: quality.statistics(r.text or "") for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    learned = [i for i in sorted(y) if i in x and crc(i) % 5 != 0]
    every = np.array([x[i] for i in learned])
    assert model.mean == pytest.approx(every.mean(0)) and model.scale == pytest.approx(every.std(0) + 1e-6, rel=1e-4, abs=1e-5)
    ours = [i for i in learned if crc(i) % 5 != 4]
    z, target = model.features(np.array([x[i] for i in ours])), np.array([y[i] for i in ours], float)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(ours) / quality.FEATURES * np.eye(z.shape[1]), z.T @ target)
    assert model.features(every) @ weights == pytest.approx(model.raw(every), abs=1e-5)
    assert (np.diff(model.calibrated) >= 0).all()
    found = {r.doc_id: r for r in queries.op7_quality(spark, sf_dir).collect()}
    assert found.keys() == x.keys()
    for i, r in found.items():
        want = np.interp(model.raw(np.array([x[i]]))[0], np.linspace(quality.LOW, quality.HIGH, quality.BINS), model.calibrated)
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == (r.score >= 0.3) and r.held_out == (crc(i) % 5 == 0)
    held = [i for i in y if i in found and found[i].held_out]
    assert sum(found[i].predicted == y[i] for i in held) >= 0.8 * len(held)


@pytest.fixture(scope="module")
def spoken(spark):
    """Texts of over 384 different words, so that some share classes, and words in the held-out ones that no other has."""
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefgh") for _ in range(4)) + rng.choice("abc.,9é") for _ in range(700)]
    texts = {i: " ".join(rng.choice(names[: 1 + rng.randrange(len(names))]) for _ in range(60)) + (f" only{i}" if i % 3 == 0 else "") for i in range(120)}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def test_model_scores_token_by_token(spark, spoken):
    """Scores by plain sums over the softmax of the model, and its probabilities of all tokens add up to one."""
    texts, df = spoken
    training = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).select("text")
    counted = materialise(language_model.count_tokens(training), "counts")
    v = language_model.summarise(counted)
    model = language_model.train(training, v)
    counts = {bytes(r.word): r.n for r in counted.collect()}
    assert len(counts) > language_model.HEAD and len(v.known) == len(counts)
    tail = lambda w: language_model.HEAD + int(language_model._TAIL_OF[w[-1]])
    own = lambda w: int(v.classes[v.known[w]]) if w in v.known else tail(w)
    inside = {}
    for w, n in counts.items():
        inside.setdefault(own(w), []).append(n)

    def share(w):
        k = own(w)
        if k < language_model.HEAD or k == v.end:
            return 1.0
        held = inside.get(k, [])
        return (counts.get(w, 0) + 0.5) / (sum(held) + 0.5 * (len(held) + 1))

    def chances(one, two):
        s = model.target @ (model.near[one] + model.far[two]) + model.bias
        s = np.exp((s - s.max()).astype(float))
        return s / s.sum()

    for one, two in ((0, 5), (v.end, v.end), (390, 2)):
        p = chances(one, two)
        unseen = sum(p[k] * 0.5 / (sum(inside.get(k, [])) + 0.5 * (len(inside.get(k, [])) + 1)) for k in range(language_model.HEAD, v.end))
        assert sum(p[own(w)] * share(w) for w in counts) + unseen == pytest.approx(1, abs=1e-4)
    marked = df.withColumn("held_out", F.lit(False))
    for r in language_model.score(marked, v, counted, model).collect():
        total, one, two = 0.0, v.end, v.end
        for w in [*texts[r.doc_id].encode().split(), language_model.END]:
            total += math.log10(chances(one, two)[own(w)] * share(w))
            one, two = own(w), one
        assert r.score == pytest.approx(total, rel=1e-4)
        assert r.n_known == sum(w in counts for w in [*texts[r.doc_id].encode().split(), language_model.END])


def test_packed_pieces_by_the_library(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [(i, t) for i, t in enumerate([None, "", "a b", "a b", " lead\n\nrun  of spaces", "x. y\nZ " * 900, "one\n two", "Ünï\tçödé 中 <|endoftext|>", "end\n"])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = packing.pack_documents(df, path, 64)
    assert dict(found.dtypes)["piece"] == "int"
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found.collect())
    want = []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]  # noqa: B905
    assert got == sorted(want)


NAMES = ["_id", "_row", "_row_", "fp", "root", "fingerprint", "component_id", "item_id", "h", "_hashes", "codec", "error", "host", "path", "rule", "verdict", "score", "held_out", "steps", "rank", "task", "x", "n", "word", "key"]


def test_clashing_names(spark):
    """Operators keep rows and columns whatever names the caller has; added columns win, and the caller's are kept beside."""
    rows = [(i, t, "en", *[i] * len(NAMES)) for i, t in ((1, "a few words of some text here"), (None, "a few words of some text here"), (None, None), (4, "quite another text with words of its own"), (4, "yet another text, of the same id"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} long" for n in NAMES))
    items = spark.createDataFrame([(1, "another text with words of its own", 1)], "item_id long, text string, _id long")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert decontaminate.keep_clean(df, items).columns == df.columns and decontaminate.keep_clean(df, items).count() == 4
    assert language_id.keep_identified(df, language_id.fit(df)).columns == df.columns
    assert simhash.cluster(df).count() == 5 and language_model.score_documents(df).count() == 5
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack_documents(df, path).count() == 5 and token_records.token_records(df, public_tokenizers.path("word_bpe_49k.json")).count() == 5
    indexed = media.index(df.withColumn("media", F.lit(bytearray(media.store(bytes(64))))))
    assert indexed.select("codec", "codec_given", "error_given").first()[0] == "raw " and indexed.count() == 5
    judged = url_filter.judge(df.withColumn("url", F.lit("http://a.net/fr/x")))
    assert judged.select("host", "host_given", "score_given").first()[:1] == ("a.net",) and judged.count() == 5
    by_host = url_filter.judge(spark.createDataFrame([("http://a.net/fr/x", 1)], "host string, host_given int"), url="host")
    assert by_host.select("host", "verdict").first() == ("a.net", "block")


def test_hot_shingles_bring_no_crowd(spark):
    """Items that open alike are looked up by what sets them apart, and all that is contained is found."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    opening = " ".join(word() for _ in range(8))
    items = [(i, opening + " " + " ".join(word() for _ in range(24))) for i in range(60)]
    docs = [(i, " ".join(word() for _ in range(30)) + " " + (items[i][1] if i < 20 else opening) + " " + " ".join(word() for _ in range(30))) for i in range(200)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(d, b).collect()) == [(i, i) for i in range(20)]
    keyed = materialise(decontaminate.with_hashes(b.withColumnRenamed("item_id", "_key"), "text"), "items")
    assert decontaminate.candidates(d, keyed).count() == 20


# ---- the pipeline -------------------------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_first(rows):
    """Of rows (key, doc_id, text), those that stay: one of each group of fingerprints that link, by all pairs."""
    prints = [simhash.fingerprint(r[2]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return [min(g, key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "")) for g in groups.values()]


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage's decisions on its own input; what is learned is learned by the operators, what is decided is decided here."""
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf_dir, "documents")
    kept = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    one = materialise(stages["language_id"](spark, docs, sf_dir), "one")
    dictionaries = language_id.fit(docs)
    want = []
    for r in docs.collect():
        if r.text is not None and language_id.LETTER.search(r.text):
            best, second = sorted(plain_language(r.text, dictionaries).values())[:2]
            if (second - best) / second >= language_id.NARROW and second > best:
                want.append((r.doc_id, r.text))
    assert kept(one) == sorted(want)
    two = materialise(stages["quality"](spark, one, sf_dir), "two")
    model = quality.fit(materialise(quality.describe(one), "statistics"), table(spark, sf_dir, "labels"))
    assert kept(two) == sorted((i, t) for i, t in kept(one) if model.score(np.array([quality.statistics(t)]))[0] >= 0.3)
    three = materialise(stages["simhash"](spark, two, sf_dir), "three")
    assert kept(three) == sorted((i, t) for _, i, t in plain_first([(k, *r) for k, r in enumerate(kept(two))]))
    four = materialise(stages["decontamination"](spark, three, sf_dir), "four")
    items = [s for s in (shingles(r.text) for r in table(spark, sf_dir, "benchmark").collect()) if s]
    clean = [(i, t) for i, t in kept(three) if not any(len(s & own) >= 0.8 * len(s) for own in [shingles(t)] for s in items)]
    assert kept(four) == sorted(clean) and len(clean) < three.count()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean}
    packed = stages["packing"](spark, four, sf_dir).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in sizes} == sizes and len({r.sequence_id for r in packed}) <= 1.05 * sum(sizes.values()) / 2048 + 1


ODD = [(1, None), (2, ""), (None, "some words here and there"), (None, "some words here and there"), (None, "other words, not at all alike, without an id"), (4, " ".join(["long"] * 5000)), (5, " \n\t "), (6, "1234 !!"), (8, "the same words again and again"), (8, "the same words again and again"), (8, "different words under that number"), (9, "the same words again and again")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_and_empty_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, fingerprint string, _id long"
    full = [(i, t, "en" if k % 2 else None, None, None, k, "x", 1) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(8, 1, 0), (None, 0, 0), (4, 0, None)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (None, "not at all alike, without an id")][: len(rows)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, str(tmp_path)), name)
        assert name == "packing" or after.columns == docs.columns
        whole = {(r.doc_id, r.text) for r in docs.collect()}
        if name == "simhash" and rows:
            assert (8, "different words under that number") in {(r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()} or (8, "different words under that number") not in whole
        if name == "decontamination" and rows:
            assert not any(t and "not at all alike" in t for _, t in {(r.doc_id, r.text) for r in after.collect()})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= (1 if rows else 0)
    first = simhash.keep_first(table(spark, str(tmp_path), "documents"))
    got = sorted(((r.doc_id, r.text) for r in first.collect()), key=str)
    assert got == sorted(((i, t) for _, i, t in plain_first([(k, i, t) for k, (i, t) in enumerate(rows)])), key=str)
